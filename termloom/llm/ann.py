"""Approximate nearest neighbours: inverted lists with an adaptive dimension scan.

Nearness is the inner product.  A further coordinate makes all vectors equally
long, so the largest inner product is the smallest Euclidean distance, and a
random rotation spreads every difference evenly over the coordinates.  Rotated
vectors are held in column blocks.  While a query scans a list, the distance
over the first d of D coordinates is a sample of the whole: a candidate is
abandoned as soon as the test

    partial * D / d  >  r * (1 + e / sqrt(d))^2

rejects that its distance could be within r, the k-th best distance so far.
Candidates that are never abandoned are scored on their original vectors, each by the
same sums in the same order, so equal vectors have equal scores.

Search takes two rounds: with the k-th distance in the training sample as its first r a
query scans its nearest lists; what they give is the r that goes with it to the other lists.  How many lists a query visits follows from the sample
that trains them: as many as hold nearly all near neighbours there.  On clustered
vectors these are few; without any structure no index of lists can do with few.

Lists come from k-means on a bounded sample; every vector is indexed.  There are at most
:data:`LISTS` of them, so from some 17 million vectors on lists grow with their number
(``n_lists`` asks for more, which a larger sample should then train).  A list is
dealt out in blocks of about :data:`BLOCK` rows, so a list that a hot vector
fills is scanned by many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pa_schema, stored

#: Vectors that train the lists, at most; lists, at most; rows of a block, about.
TRAIN, LISTS, BLOCK = 16_384, 2048, 4096
#: Coordinates of a column block; the test's e; pairs of a query and a candidate looked at in one go.
COLUMNS, TEST, PAIRS = 16, 2.1, 1 << 20
#: A null id comes after all others in ties.
LAST = (1 << 63) - 1
#: Share of the sample's near neighbours that the visited lists hold; share of these lists that give the first r.
RECALL, NEAR = 0.95, 0.1


class Space:
    """The rotated space and its lists, fitted on a sample."""

    def __init__(self, sample: np.ndarray, longest: float, n_lists: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = sample.shape[1] + 1
        self.longest, self.sample = longest, sample
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        x = self.rows(sample)
        self.centres = x[np.sort(rng.choice(len(x), min(n_lists, len(x)), replace=False))]
        for _ in range(8):
            near = self.nearest(x)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, near, x)
            n = np.bincount(near, minlength=len(self.centres))
            self.centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.centres)

    def probes(self, sample: np.ndarray, n: int, k: int, recall: float = RECALL, seed: int = 8) -> int:
        """How many of its nearest lists a query visits: as many as hold the share
        ``recall`` of near neighbours in the sample, for up to 256 of its vectors.

        The sample's neighbours are those that k of n rows come to there (one at least),
        so they lie no nearer than those of all rows.
        """
        rng, x = np.random.default_rng(seed), self.rows(sample)
        own = np.sort(rng.choice(len(x), min(256, len(x)), replace=False))
        inner = sample[own].astype(np.float64) @ sample.astype(np.float64).T
        inner[np.arange(len(own)), own] = -np.inf
        few = min(max(1, round(k * len(x) / n)), len(x) - 1)
        if few < 1:
            return len(self.centres)
        best = np.argpartition(-inner, few - 1, axis=1)[:, :few]
        place = np.argsort(np.argsort(self.away(self.queries(sample[own])), axis=1, kind="stable"), axis=1, kind="stable")
        ranks = np.sort(np.take_along_axis(place, self.nearest(x)[best], axis=1).ravel())
        return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]) + 1

    def first_r(self, x: np.ndarray, k: int) -> np.ndarray:
        """For each query a squared distance within which k rows other than itself surely lie:
        those of the sample, which are rows, do."""
        if len(self.sample) <= k:
            return np.full(len(x), np.inf)
        sample, out = self.sample.astype(np.float64), np.empty(len(x))
        for at in range(0, len(x), 512):
            q = x[at : at + 512].astype(np.float64)
            kth = np.partition(q @ sample.T, len(sample) - k - 1, axis=1)[:, len(sample) - k - 1]
            out[at : at + 512] = self.longest**2 + (q * q).sum(1) - 2 * kth
        return out * (1 + 1e-9)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Database vectors, lengthened and rotated."""
        x = x.astype(np.float64)
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        return np.column_stack([x, rest]) @ self.rotation

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x.astype(np.float64), np.zeros(len(x))]) @ self.rotation

    def away(self, x: np.ndarray) -> np.ndarray:
        return (self.centres * self.centres).sum(1)[None, :] - 2 * x @ self.centres.T

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.away(x[i : i + 4096]).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def column_blocks(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors by blocks of columns, each with its rows' squared lengths."""
    cut = [np.ascontiguousarray(x[:, c : c + COLUMNS]) for c in range(0, x.shape[1], COLUMNS)]
    return [(b, np.einsum("ij,ij->i", b, b)) for b in cut]


def scan(columns: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, r: np.ndarray, k: int, slack: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs: rows of a block that may be among the k nearest to each of
    the rotated queries and within its squared distance r.

    Partial distances grow by one column block for all queries at once; after each,
    the test abandons pairs.  Once few are left, only these are looked at.
    """
    n, d, done, alive, part = len(columns[0][0]), q.shape[1], 0, None, np.zeros(1)
    for block, squares in columns:
        own = q[:, done : done + block.shape[1]]
        done += block.shape[1]
        test = (1 + TEST / math.sqrt(done)) ** 2 * done / d if done < d else 1.0
        squared = np.einsum("ij,ij->i", own, own)
        if alive is None or alive.dtype == bool:
            part = part + squares[None, :] - 2 * own @ block.T + squared[:, None]
            ok = part <= (r * test + slack)[:, None]
            alive = ok if alive is None else alive & ok
            if done < d and 4 * np.count_nonzero(alive) < alive.size:
                i, j = np.nonzero(alive)
                part, alive = part[i, j], np.stack([i, j])
        else:
            i, j = alive
            part = part + squares[j] - 2 * np.einsum("ij,ij->i", own[i], block[j]) + squared[i]
            ok = part <= r[i] * test + slack
            part, alive = part[ok], alive[:, ok]
    if alive.dtype == bool:
        if n > k:
            alive &= part <= np.partition(np.where(alive, part, np.inf), k - 1, axis=1)[:, k - 1 : k] + slack
        return np.nonzero(alive)
    return alive[0], alive[1]


def matrix(column) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x with that of y: the same sum in the same order, whatever stands beside them."""
    return np.add.reduce(np.ascontiguousarray(x, np.float64) * np.ascontiguousarray(y, np.float64), axis=1)


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, probes: float | None = None, n_lists: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query.

    ``is_query``: a condition on rows.  Candidates are all rows but the query's own: rows that
    share an id are candidates each, and queries each.
    score is the inner product of the original vectors, in doubles.  ``probes``
    is the share of lists that a query visits, if not as many as the sample asks for
    (in any case as many as hold 4k vectors).

    Vectors that are null, zero, or hold null or non-finite components take no
    part; nor do those of another length than the commonest (of equally common
    ones the longest).  A row with a null id is a candidate, never a query.  Ties go to the
    smaller id, null last.
    Without vectors there are no rows.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    x = F.col("v")
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"), F.coalesce(is_query & F.col(id_col).isNotNull(), F.lit(False)).alias("q"))
    v = v.where(x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    widths = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("longest")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return spark.createDataFrame([], schema)
    d, n, longest = widths[0]
    v = v.where(F.size("v") == d)
    step = max(1, -(-n // TRAIN))
    sample = v.where(F.pmod(F.xxhash64("id", "v"), F.lit(step)) == 0).select("v").limit(TRAIN).collect()
    if not sample:
        sample = v.select("v").limit(1).collect()
    trained = np.array([r[0] for r in sample])
    space = Space(trained, longest, n_lists or min(LISTS, max(16, round(math.sqrt(n) / 2))))
    shared = spark.sparkContext.broadcast(space)  # at most LISTS centres and a rotation
    lists = len(space.centres)
    visited = math.ceil(probes * lists) if probes is not None else space.probes(trained, n, k)

    put = pa_schema(spark, f"id long, v {kind}, q boolean, list int")

    def assign(batches):
        for b in batches:
            if b.num_rows:
                near = shared.value.nearest(shared.value.rows(matrix(b.column(1)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(put.field(1).type), b.column(2), pa.array(near)], schema=put)

    index = stored(v.mapInArrow(assign, f"id long, v {kind}, q boolean, list int").withColumn("part", F.monotonically_increasing_id()))
    counts = np.zeros(lists, np.int64)
    for r in index.groupBy("list").count().collect():  # a row for each list
        counts[r["list"]] = r["count"]
    blocks = np.maximum(1, -(-counts // BLOCK))
    dealt = F.pmod(F.col("part"), F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("list") + 1)).cast("int")
    candidates = index.select("list", dealt.alias("block"), F.lit(float("inf")).alias("r"), F.lit(False).alias("q"), "part", "id", "v")
    visit = f"list int, block int, r double, q boolean, part long, id long, v {kind}"
    asked = pa_schema(spark, visit)

    def visits(queries: DataFrame, first: bool) -> DataFrame:
        """Each query (part, id, v, r) for each block of the lists of one round."""

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                vectors = matrix(b.column(2))
                away = shared.value.away(shared.value.queries(vectors))
                order = np.argsort(away, axis=1, kind="stable")
                r = shared.value.first_r(vectors, k) if first else b.column(3).to_numpy()
                take, li, bl = [], [], []
                for i, o in enumerate(order):
                    enough = int(np.searchsorted(np.cumsum(counts[o]), 4 * k)) + 1
                    near, most = max(enough, math.ceil(NEAR * visited)), max(enough, visited)
                    for c in o[:near] if first else o[near:most]:
                        take += [i] * int(blocks[c])
                        li += [int(c)] * int(blocks[c])
                        bl += range(int(blocks[c]))
                for at in range(0, len(take), 10_000):
                    t = pa.array(take[at : at + 10_000])
                    m = len(t)
                    yield pa.RecordBatch.from_arrays([pa.array(li[at : at + m], pa.int32()), pa.array(bl[at : at + m], pa.int32()), pa.array(r).take(t), pa.array([True] * m), b.column(0).take(t), b.column(1).take(t), b.column(2).take(t).cast(asked.field("v").type)], schema=asked)

        return queries.select("part", "id", "v", "r").mapInArrow(run, visit)

    hit = "query long, query_id long, part long, vec_id long, score double"
    out = pa_schema(spark, hit)
    slack = 1e-9 * max(1.0, longest * longest)

    def scan_blocks(batches):
        """Rows come by block, candidates before queries; a task holds one block."""
        now, held, columns = None, [], None
        for b in batches:
            li, bl, rs, qs, row = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            bid, known, bv = b.column(5).fill_null(LAST).to_numpy(), b.column(5).is_valid().to_numpy(zero_copy_only=False), matrix(b.column(6))
            cuts = [0, *(np.flatnonzero((li[1:] != li[:-1]) | (bl[1:] != bl[:-1]) | (qs[1:] != qs[:-1])) + 1).tolist(), len(li)]
            for a, e in zip(cuts[:-1], cuts[1:], strict=True):
                if a == e:
                    continue
                if (li[a], bl[a]) != now:
                    now, held, columns = (li[a], bl[a]), [], None
                if not qs[a]:
                    held.append((row[a:e], bid[a:e], known[a:e], bv[a:e]))
                    continue
                if not held:
                    continue
                if columns is None:
                    own, ids, named, original = (np.concatenate(x) for x in zip(*held, strict=True))
                    columns = column_blocks(shared.value.rows(original))
                step = max(1, PAIRS // len(own))
                for at in range(a, e, step):
                    to = min(at + step, e)
                    i, j = scan(columns, shared.value.queries(bv[at:to]), rs[at:to], k + 1, slack)  # one may be the query itself
                    other = own[j] != row[at:to][i]
                    i, j = i[other], j[other]
                    score = inner_products(original[j], bv[at:to][i])
                    order = np.lexsort((own[j], ids[j], -score, i))
                    i, j, score = i[order], j[order], score[order]
                    starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
                    best = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i)))) < k
                    i, j = i[best], j[best]
                    yield pa.RecordBatch.from_arrays([pa.array(row[at:to][i]), pa.array(bid[at:to][i]), pa.array(own[j]), pa.array(ids[j], mask=~named[j]), pa.array(score[best])], schema=out)

    def round_of(queries: DataFrame, first: bool) -> DataFrame:
        both = candidates.union(visits(queries, first)).repartition("list", "block").sortWithinPartitions("list", "block", "q")
        return both.mapInArrow(scan_blocks, hit)

    def best(hits: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "part"))
        return hits.withColumn("rank", rank).where(F.col("rank") <= k)

    queries = stored(index.where("q").select("part", "id", "v"))
    near = stored(best(round_of(queries.withColumn("r", F.lit(float("inf"))), True)))
    # The k-th score as a squared distance of lengthened vectors.
    kth = near.where(F.col("rank") == k).select(F.col("query").alias("part"), F.col("score").alias("kth"))
    r = F.coalesce(F.lit(longest * longest) + norm * norm - 2 * F.col("kth"), F.lit(float("inf")))
    rest = round_of(queries.join(kth, "part", "left").withColumn("r", r), False)
    return best(near.drop("rank").union(rest)).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products found of every 20th vector with all others."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
