"""Line dedup by content-defined chunks.

A rolling hash over the hashes of two neighbouring lines is taken at every line.  Where it
stands once in the corpus, a chunk ends; where it stands again, one goes on.  So chunks are
the runs of lines that are repeated somewhere: their boundaries follow from content alone,
inserted lines move none but those around them, and no passage of two or more lines is
too short to be a chunk.  (Boundaries by the value of the hash leave most passages of
two to ten lines within larger chunks, which stand once.)

Of each pair of neighbouring lines (both with something in them) that stands more than once
the first place, by (doc_id, position), stays, and the lines of the others go.

Equality is that of bytes: hashes only choose candidates, and candidates are grouped by
their text.  DataFrame functions only.  Hashes are counted without texts; a bitmap of fixed
size (8 MB) of the repeated ones keeps the lines of all others out of the shuffle that carries
text.  Counts are combined before each shuffle and the places of a frequent pair are dealt to
many tasks, so one that stands in a third of all documents is as cheap as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hot_join, stored

BITS, PAIR_BITS = 24, 26
#: What a line must have something besides.
BLANK = " \t\r\n"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def rolling(lines: Column) -> Column:
    """At each line but the last a hash over the hashes of it and the next one; null where
    one of them is blank."""
    hashes = F.transform(lines, lambda x: F.when(F.trim(x, F.lit(BLANK)) != "", F.xxhash64(x)))
    n = F.greatest(F.size(lines) - 1, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 2, n), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.xxhash64(a, b)))


def in_bitmap(df: DataFrame, hashes: DataFrame, col: str, bits: int = BITS) -> DataFrame:
    """Rows of df whose hash may be among the hashes: none is lost, few others stay.

    The bitmap has 2^bits bits in rows of 4 KB (2 MB for 24), whatever it is made of.
    """
    low = F.col(col).bitwiseAND(F.lit((1 << bits) - 1))
    bucket, place = (low / 32768).cast("int"), low % 32768
    maps = hashes.select(bucket.alias("_b"), place.alias("_p")).groupBy("_b").agg(F.bitmap_construct_agg("_p").alias("_m"))
    byte = F.conv(F.hex(F.substring("_m", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return df.join(F.broadcast(maps), bucket == F.col("_b")).where(F.pmod(F.floor(byte / F.pow(F.lit(2), place % 8)), F.lit(2)) == 1).select(df.columns)


def repeated(docs: DataFrame) -> DataFrame:
    """(key, th, removed): the numbers of lines that go, for rows (key, th, text) that lose any."""
    cut = docs.where(F.instr("text", "\n") > 0).select("key", "th", lines_of(F.col("text")).alias("lines"))
    # outer: no test for empty arrays, which would cut each text twice
    hashes = cut.select(F.explode_outer(rolling(F.col("lines"))).alias("h")).where("h is not null")
    counts = hashes.groupBy("h").count().where("count > 1")
    at = cut.select("key", "th", "lines", F.posexplode_outer(rolling(F.col("lines"))).alias("pos", "h")).where("h is not null")
    pair = F.concat(F.get("lines", F.col("pos")), F.lit("\n"), F.get("lines", F.col("pos") + 1))
    some = stored(in_bitmap(at, counts.select("h"), "h", PAIR_BITS).select("key", "th", "pos", "h", pair.alias("pair")))
    place = F.struct("key", "th", "pos")
    first = stored(some.groupBy("h", "pair").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"))
    later = hot_join(some, first, ["h", "pair"], "n", ["key", "th", "pos"], by=["h"]).where(place != F.col("first"))
    return later.groupBy("key", "th").agg(F.collect_set("pos").alias("pos")).select("key", "th", F.array_union("pos", F.transform("pos", lambda i: i + 1)).alias("removed"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: bool = False) -> DataFrame:
    """docs with repeated chunks gone from their texts; all rows and columns stay.

    Null texts stay null; empty texts stay empty, and a text may become empty.
    Rows with the same id and text count as one document and keep the same.
    Null ids come last.  An empty table gives no rows.  With ``count``, a column
    ``n_removed`` (lines) follows.
    """
    own = docs.columns
    key = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("key")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), key, F.xxhash64(text_col).alias("th"))
    gone = repeated(base.select("key", "th", F.col(f"row.`{text_col}`").alias("text")))
    text = F.col(f"row.`{text_col}`")
    # Only texts that lose something are cut again; the generator makes their lines a column.
    both = base.join(gone, ["key", "th"], "left").select("row", "removed", F.explode(F.array(F.when(F.col("removed").isNotNull(), lines_of(text)))).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    rest = F.when(F.col("removed").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    out = [rest.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in own]
    if count:
        out.append(F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"))
    return both.select(*out)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without repeated chunks of lines, and how many lines went."""
    return line_dedup(documents(spark, sf_dir).select("doc_id", "text"), count=True)


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS i FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM l),
w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, i) > 1 AS again FROM a WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' AND trim(next, ' ' || chr(9) || chr(13)) <> ''),
g AS (SELECT doc_id, i FROM w WHERE again UNION SELECT doc_id, i + 1 FROM w WHERE again),
r AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept FROM l ANTI JOIN g USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN r USING (doc_id) LEFT JOIN n USING (doc_id)
"""
