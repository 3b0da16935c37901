"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash.  A source whose target is k times its
size and a rest takes each document k times, and once more those whose hash lies
below the source's threshold.  The threshold is found without sorting: words are
summed by source and hash bucket (4096 buckets), the bucket in which the budget
runs out is refined into 4096 more, and so on until it holds one hash value.
Budgets nest: what a smaller budget takes, a larger one takes too.

DataFrame functions only.  Per-source tables are small next to the documents and
joined as Spark sees fit: by broadcast only under its size threshold, else by a
sort-merge join that splits skewed sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, stored

HASH_BITS, STEP = 60, 12
#: No document is taken more often.
MOST = 3


def words(text_col: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def hash60(id_col: str, text_col: str) -> Column:
    """The first 60 bits of the id's MD5, or where it is null of the text's after a colon."""
    named = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds rank (from 1, by code point, null last) without one task for all:
    ranges are numbered each for itself and moved by the counts before them."""
    parts = stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before, at = [], 0
    for r in parts.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        before += [F.lit(r["part"]), F.lit(at)]
        at += r["count"]
    start = F.element_at(F.create_map(*before), F.col("part")) if before else F.lit(0)
    number = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("rank", (start + number).cast("long")).drop("part")


def with_targets(sources: DataFrame, total: int) -> DataFrame:
    """Adds target: total by weight, capped at MOST times the size, the excess
    shared anew by weight until no target is above its cap."""
    capped, share = None, 0.0
    cap = F.col("source_size") * MOST
    while True:
        r = sources.agg(F.sum(F.when(cap < F.col("weight") * share, cap)).alias("full"), F.sum(F.when(cap >= F.col("weight") * share, F.col("weight"))).alias("w"), F.sum(F.when(cap < F.col("weight") * share, 1)).alias("n")).first()
        if r.n == capped and share or not r.w:
            break
        capped, share = r.n, (total - (r.full or 0)) / r.w
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(share), cap.cast("double")))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(sizes, sources): doc_id, rank, size, hash of each row; and each source's
    rank, source_size, target, copies and threshold.

    Sources weigh ``weights`` in turn, by code point, null last, and share
    ``total`` words (all, if None).
    """
    sized = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), words(text_col).alias("size"), hash60(id_col, text_col).alias("hash")))
    sources = ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    n = len(weights)
    sources = stored(sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % n + 1).cast("int")).cast("long")))
    total = total if total is not None else sources.agg(F.sum("source_size")).first()[0] or 0
    sources = with_targets(sources, total)
    sources = sources.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = stored(sources.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")))
    keyed = stored(sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.doc_id", "s.rank", "d.size", "d.hash"))
    # The bucket of each source in which its budget runs out; at first all hashes are one bucket.
    edge = sources.where("source_size > 0").select("rank", "budget", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("before"))
    bits = HASH_BITS
    while True:
        inside = keyed.where("size > 0").join(edge, "rank").where(F.shiftright("hash", bits) == F.col("bucket"))
        bits -= STEP
        sums = inside.groupBy("rank", F.shiftright("hash", bits).alias("next")).agg(F.first("budget").alias("budget"), F.first("before").alias("before"), F.sum("size").alias("here"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        run = sums.withColumn("upto", F.col("before") + F.sum("here").over(Window.partitionBy("rank").orderBy("next")))
        over = run.where("upto > budget").groupBy("rank").agg(F.min_by(F.struct("budget", "next", (F.col("upto") - F.col("here")).alias("before"), "here", "low", "high"), "next").alias("x")).select("rank", "x.*")
        edge = stored(over.select("rank", "budget", F.col("next").alias("bucket"), "before", "here", "low", "high"))
        if bits == 0 or not edge.where("low <> high").limit(1).count():
            break
        edge = edge.select("rank", "budget", "bucket", "before")
    # One hash value is left: it is taken if that comes nearer to the budget.
    nearer = F.col("before") + F.col("here") - F.col("budget") < F.col("budget") - F.col("before")
    bound = edge.select("rank", (F.col("low") + F.when(nearer, 1).otherwise(0)).alias("threshold"))
    out = sources.join(bound, "rank", "left").select("rank", "source", "source_size", "target", "copies", F.coalesce("threshold", F.lit(0)).alias("threshold"))
    return keyed, stored(out)


def takes() -> Column:
    """How often a document is taken."""
    return F.least(F.col("copies") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0), F.lit(MOST))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row.

    Null text has size 0, a null source is a source (the last).  Rows with the
    same id share a hash and are taken together.  A source without words has
    target 0.  Reruns agree, whatever the partitions.  An empty table gives no
    rows.  Other columns are ignored.
    """
    keyed, sources = plan(docs, id_col, text_col, source_col, **how)
    return keyed.join(sources, "rank").select("doc_id", "size", "source_size", "target", (F.col("size") * takes()).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixture itself: docs with each row as often as it is taken.

    The documents aren't shuffled: only the small table of sources meets them.
    Rows without words are dropped where their source takes none of them.
    """
    _, sources = plan(docs, id_col, text_col, source_col, **how)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("own"), hash60(id_col, text_col).alias("hash"))
    got = rows.join(sources, F.col("own").eqNullSafe(F.col("source"))).withColumn("n", takes()).where("n > 0")
    return got.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mixture takes of every document."""
    return mix(documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), ':' || coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
o AS (SELECT *, source_size * 3 / w AS ratio FROM p),
l AS (SELECT ratio, ((SELECT sum(source_size) FROM p) - coalesce((SELECT sum(3 * source_size) FROM o AS x WHERE x.ratio < o.ratio), 0)) / (SELECT sum(w) FROM o AS x WHERE x.ratio >= o.ratio) AS share FROM o),
f AS (SELECT arg_min(share, ratio) AS share FROM l WHERE share <= ratio),
t AS (SELECT source, source_size, least(w * share, CAST(3 * source_size AS DOUBLE)) AS target FROM p, f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
r AS (SELECT d.*, source_size, target, copies, target - copies * source_size AS budget, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS here FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(size * least(copies + CASE WHEN upto <= budget OR upto - here <= budget AND upto - budget < budget - (upto - here) THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken FROM r
"""
