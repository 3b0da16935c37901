"""Hard negatives: product quantisation with stored residual norms, exact to the last row.

Vectors become integers, floor(scale * x), and a row's score is its integer inner product
with an anchor.  A row is stored as the number of its nearest centre in each of some narrow
groups of columns, and the norm of what these centres leave.  For an anchor a table per
group holds its inner products with all centres, so a row's estimate is a sum of look-ups;
the true score lies within

    |score - estimate|  <=  norm of the anchor * residual norm of the row

(Cauchy-Schwarz), and no row that these bounds leave in doubt is passed over.  What they
leave is scored exactly, in integers.

Two rounds go over all rows, in blocks of a bounded number that any label is dealt to:

1. positives: in each block the rows of the anchor's label whose upper bound reaches the
   k-th largest lower bound; the best of all blocks are the anchor's positives;
2. negatives: each positive asks for a window of scores.  Among rows of other labels that
   may lie in it, those whose upper bound reaches the k-th largest lower bound of rows that
   surely do; the best of all blocks complete the window.

Centres come from k-means on a bounded sample; with poor centres the bounds are wide, more
rows are scored exactly, and the result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ann import matrix
from .common import pa_schema, stored

#: Vectors that train the centres, at most; centres of a group (a byte names one); columns of a group.
TRAIN, CENTRES, COLUMNS = 16_384, 256, 2
#: Rows of a block, about; blocks, at least; pairs of an anchor and a row looked at in one go.
BLOCK, BLOCKS, PAIRS = 1 << 15, 12, 1 << 20
SCALE = 256
#: The contract's window: 50 * positive <= 100 * negative <= 95 * positive.
LOW, HIGH = 50, 95
#: A null id comes after all others in ties.
LAST = (1 << 63) - 1


class Quantiser:
    """Centres of each group of columns, fitted on a sample."""

    def __init__(self, sample: np.ndarray, seed: int = 5, rounds: int = 8):
        rng = np.random.default_rng(seed)
        self.groups = [slice(c, c + COLUMNS) for c in range(0, sample.shape[1], COLUMNS)]
        self.centres = []
        for g in self.groups:
            x = np.unique(sample[:, g].astype(np.float64), axis=0)
            c = x[np.sort(rng.choice(len(x), min(CENTRES, len(x)), replace=False))]
            for _ in range(rounds):
                near, sums = self.nearest(x, c), np.zeros_like(c)
                np.add.at(sums, near, x)
                n = np.bincount(near, minlength=len(c))[:, None]
                c = np.where(n > 0, sums / np.maximum(n, 1), c)
            self.centres.append(c)

    @staticmethod
    def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        own = (c * c).sum(1)[None, :]
        return np.concatenate([(own - 2 * x[i : i + 4096] @ c.T).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, residual norms) of integer vectors."""
        left, codes = x.astype(np.float64), np.zeros((len(x), len(self.groups)), np.uint8)
        for k, (g, c) in enumerate(zip(self.groups, self.centres, strict=True)):
            codes[:, k] = self.nearest(left[:, g], c)
            left[:, g] -= c[codes[:, k]]
        return codes, np.sqrt((left * left).sum(1))

    def tables(self, anchors: np.ndarray) -> list[np.ndarray]:
        """Per group, each anchor's inner products with all centres."""
        a = anchors.astype(np.float64)
        return [a[:, g] @ c.T for g, c in zip(self.groups, self.centres, strict=True)]

    def estimates(self, anchors: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(anchors, rows): sums of look-ups."""
        out = np.zeros((len(anchors), len(codes)))
        for k, t in enumerate(self.tables(anchors)):
            out += t[:, codes[:, k]]
        return out


def bounds(q: Quantiser, anchors: np.ndarray, codes: np.ndarray, residual: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores, wide enough for the rounding of doubles."""
    norm = np.sqrt((anchors.astype(np.float64) ** 2).sum(1))
    about = q.estimates(anchors, codes)
    slack = norm[:, None] * (residual[None, :] * (1 + 1e-9) + 1e-9 * longest)
    return about - slack, about + slack


def at_least(lower: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Per anchor the k-th largest lower bound among the rows that count, -inf if there are fewer."""
    held = np.where(counts, lower, -np.inf)
    return np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k] if held.shape[1] >= k else np.full(len(held), -np.inf)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products of each row of x with that of y."""
    return np.einsum("ij,ij->i", x, y)


def prepared(vectors: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label: Column, scale: int) -> tuple[DataFrame, int, int, float]:
    """Stored (row, id, anchor, label, v) of rows that take part, how many these are, their
    width and their largest norm."""
    x = F.col("v")
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("anchor"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    v = v.where(F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    # Scores must fit 64 bits: by Cauchy-Schwarz they do if squared lengths do.
    whole = F.transform(x, lambda c: F.floor(c * scale).cast("double"))
    v = v.withColumn("v", whole).withColumn("squared", F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)).where(F.col("squared") < 2.0**62)
    widths = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max("squared").alias("most")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not widths:
        return v, 0, 0, 0.0
    d, n, most = widths[0]
    rows = v.where(F.size("v") == d).select(F.monotonically_increasing_id().alias("row"), "id", "anchor", "label", F.transform("v", lambda c: c.cast("long")).alias("v"))
    return stored(rows), n, d, most**0.5


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label", positives: int = 5, negatives: int = 3, low: int = LOW, high: int = HIGH, scale: int = SCALE
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor``: a condition on rows.  An anchor's positives are its ``positives``
    best other rows of the same label, a positive's negatives the ``negatives`` best rows of
    another label whose scores lie between ``low`` and ``high`` percent of the positive's.
    Ties go to the smaller id, null last.

    Rows with a null label or a vector that is null, empty or holds null or non-finite
    components take no part; nor do vectors of another length than the commonest, or so long that
    scores leave 64 bits.  Rows are rows: those that share an id are candidates, anchors and
    positives each.  A row with a null id is a candidate, never an anchor.  Without anchors,
    positives or negatives in a window there are no rows.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    base, n, _, longest = prepared(vectors, is_anchor, id_col, vector_col, label, scale)
    if not n:
        return spark.createDataFrame([], schema)
    step = max(1, -(-n // TRAIN))
    sample = base.where(F.pmod(F.xxhash64("row"), F.lit(step)) == 0).select("v").limit(TRAIN).collect() or base.select("v").limit(1).collect()
    shared = spark.sparkContext.broadcast(Quantiser(np.array([r[0] for r in sample], np.int64)))  # CENTRES times d numbers
    blocks = max(BLOCKS, -(-n // BLOCK))

    put = "row long, id long, anchor boolean, label long, v array<long>, codes binary, residual double"
    coded = pa_schema(spark, put)

    def quantise(batches):
        for b in batches:
            if b.num_rows:
                codes, residual = shared.value.encode(matrix(b.column(4)))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], b.column(4).cast(coded.field("v").type), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(residual)], schema=coded)

    index = stored(base.mapInArrow(quantise, put).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")))
    anchors = index.where("anchor").select("row", "id", "label", "v")
    nothing = F.array().cast("array<long>")
    rows = index.select("block", F.lit(False).alias("asks"), "row", "id", "label", "v", "codes", "residual", nothing.alias("windows"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")

    def asked(df: DataFrame) -> DataFrame:
        """Anchors (row, id, label, v, windows) for each block, after the block's rows."""
        own = df.select(every, F.lit(True).alias("asks"), "row", "id", "label", "v", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("residual"), "windows")
        return rows.union(own).repartition(blocks, "block").sortWithinPartitions("block", "asks")

    def by_block(look):
        """Feeds blocks of rows, and after each the anchors that ask, to ``look``."""

        def run(batches):
            now, parts, held = None, [], None
            for b in batches:
                block, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(block)]
                for a, e in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == e:
                        continue
                    if block[a] != now:
                        now, parts, held = block[a], [], None
                    piece = b.slice(a, e - a)
                    if not asks[a]:
                        ids = piece.column(3)
                        parts.append((*(piece.column(i).to_numpy() for i in (2, 4)), ids.fill_null(LAST).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), matrix(piece.column(5)), np.frombuffer(b"".join(piece.column(6).to_pylist()), np.uint8).reshape(e - a, -1), piece.column(7).to_numpy()))
                        continue
                    if not parts:
                        continue
                    if held is None:
                        held = [np.concatenate(x) for x in zip(*parts, strict=True)]
                    size = max(1, PAIRS // len(held[0]))
                    for at in range(0, e - a, size):
                        yield from look(held, piece.slice(at, size))

        return run

    found = "anchor long, window long, row long, score long, id long"
    out = pa_schema(spark, found)

    def emitted(anchor, window, row, score, ids, named):
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (anchor, window, row, score)), pa.array(ids, pa.int64(), mask=~named)], schema=out)

    def kept(i: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
        """Places of each anchor's k best by (score, id, row)."""
        order = np.lexsort((row, ids, -score, i))
        i = i[order]
        starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
        return order[np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i)))) < k]

    def look_positive(held, piece):
        row, lab, ids, named, v, codes, residual = held
        who, own, x = piece.column(2).to_numpy(), piece.column(4).to_numpy(), matrix(piece.column(5))
        lower, upper = bounds(shared.value, x, codes, residual, longest)
        counts = (own[:, None] == lab[None, :]) & (who[:, None] != row[None, :])
        i, j = np.nonzero(counts & (upper >= at_least(lower, counts, positives)[:, None]))
        score = exact(x[i], v[j])
        best = kept(i, score, ids[j], row[j], positives)
        yield emitted(who[i[best]], np.zeros(len(best), np.int64), row[j[best]], score[best], ids[j[best]], named[j[best]])

    def look_negative(held, piece):
        row, lab, ids, named, v, codes, residual = held
        who, own, x = piece.column(2).to_numpy(), piece.column(4).to_numpy(), matrix(piece.column(5))
        lower, upper = bounds(shared.value, x, codes, residual, longest)
        other = own[:, None] != lab[None, :]
        asked_for = piece.column(8)
        ends, flat = asked_for.offsets.to_numpy(), asked_for.values.to_numpy()
        for w in range(int(np.diff(ends).max(initial=0))):
            a = np.flatnonzero(np.diff(ends) > w)
            score = flat[ends[a] + w]
            # floor(high * score / 100) and ceil(low * score / 100), in integers without overflow
            top = score // 100 * high + score % 100 * high // 100
            bottom = -(-score // 100 * low + -score % 100 * low // 100)
            lo, up = lower[a], upper[a]
            may = other[a] & (lo <= top[:, None]) & (up >= bottom[:, None])
            surely = may & (up <= top[:, None]) & (lo >= bottom[:, None])
            i, j = np.nonzero(may & (up >= at_least(lo, surely, negatives)[:, None]))
            got = exact(x[a[i]], v[j])
            inside = (got <= top[i]) & (got >= bottom[i])
            i, j, got = i[inside], j[inside], got[inside]
            best = kept(i, got, ids[j], row[j], negatives)
            yield emitted(who[a[i[best]]], score[i[best]], row[j[best]], got[best], ids[j[best]], named[j[best]])

    def best(hits: DataFrame, k: int, *key: str) -> DataFrame:
        """The k best of all blocks."""
        rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row"))
        return hits.withColumn("rank", rank).where(F.col("rank") <= k)

    none = anchors.withColumn("windows", nothing)
    positive = stored(best(asked(none).mapInArrow(by_block(look_positive), found), positives, "anchor").select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # Only windows that can hold a score: a negative positive has none.
    windows = positive.where("positive_score >= 0").groupBy(F.col("anchor").alias("row")).agg(F.array_sort(F.collect_set("positive_score")).alias("windows"))  # k at most
    asking = anchors.join(windows, "row")
    negative = best(asked(asking).mapInArrow(by_block(look_negative), found), negatives, "anchor", "window")
    told = positive.join(negative.select("anchor", F.col("window").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "positive_score"])
    named = told.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector, with every seventh label wrong."""
    vec, label = F.col("vec_id"), F.col("label")
    wrong = F.when(vec % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), vec % 50 == 0, label_col=wrong)


SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
