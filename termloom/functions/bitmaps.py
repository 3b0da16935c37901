"""Sets of ids as bitmaps, a row for each range of :data:`SPAN` ids.

A bitmap is tested where rows are scanned: it is joined by range and a bit is looked up,
so rows of other documents go before any shuffle.  It is broadcast while it has at most
:data:`ROWS` ranges (of 4 KB each), a checked size; a larger one is joined by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of a range, words of 64 bits that it takes, and ranges of a bitmap that is broadcast (64 MB).
SPAN, WORDS, ROWS = 1 << 15, 512, 16_384
SCHEMA = "span bigint, words array<bigint>"


def _span(doc_id: Column) -> Column:
    return F.floor(doc_id / SPAN)


def _rows(words: DataFrame) -> DataFrame:
    """Bitmaps of (span, word, bits), each word of a span once."""
    held = words.groupBy("span").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))  # WORDS at most
    every = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("long")))
    return held.select("span", every.alias("words"))


def bitmap_of(ids: DataFrame) -> DataFrame:
    """(span, words) of the distinct doc_ids of a table; null ids are left out."""
    inside = F.pmod(F.col("doc_id"), F.lit(SPAN)).cast("int")
    bits = ids.where("doc_id is not null").select(_span(F.col("doc_id")).alias("span"), F.shiftright(inside, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(doc_id, {SPAN}) as int) & 63)").alias("bit"))
    return _rows(bits.groupBy("span", "word").agg(F.bit_or("bit").alias("bits")))


def union(bitmaps: DataFrame) -> DataFrame:
    """Rows of several bitmaps as one bitmap."""
    flat = bitmaps.select("span", F.posexplode("words").alias("word", "bits")).where("bits <> 0")
    return _rows(flat.groupBy("span", "word").agg(F.bit_or("bits").alias("bits")))


def ids_of(bitmap: DataFrame) -> DataFrame:
    """The doc_ids of a bitmap."""
    words = bitmap.select("span", F.posexplode("words").alias("word", "bits")).where("bits <> 0")
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.bit_get("bits", i) == 1)).alias("bit")
    return words.select("span", "word", bit).select((F.col("span") * SPAN + F.col("word") * 64 + F.col("bit")).alias("doc_id"))


def select(df: DataFrame, bitmap: DataFrame, rows: int | None = None, inside: bool = True, doc_id: Column | None = None) -> DataFrame:
    """Rows of df whose document is in the bitmap (or is not).

    rows: how many ranges the bitmap has at most, if known; else they are counted.  A null
    id is in no bitmap.
    """
    own, key = df.columns, F.col("doc_id") if doc_id is None else doc_id
    n = bitmap.limit(ROWS + 1).count() if rows is None else rows
    side = F.broadcast(bitmap) if n <= ROWS else bitmap
    side = side.select(F.col("span").alias("_span"), F.col("words").alias("_words"))
    place = F.pmod(key, F.lit(SPAN)).cast("int")
    bit = F.bit_get(F.get("_words", F.shiftright(place, 6)), place.bitwiseAND(F.lit(63))) == 1
    both = df.join(side, _span(key) == F.col("_span"), "inner" if inside else "left")
    return both.where(bit if inside else ~F.coalesce(bit, F.lit(False))).select(*own)
