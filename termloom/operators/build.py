"""From documents to an index: entries, documents, positions, statistics.

entries (term, doc_id, w) has one row for each term of a document; docs
(doc_id, doc_len) one for each live document, empty ones too; positions (term,
doc_id, ps) the sorted token positions.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import token_rows, tokenised
from ..schema import BLOCK_SIZE, DOCS, POSITIONS, DuplicateDocId, entries_schema


#: Ids that are numbered together.
RANGE = 1 << 16


@dataclass(frozen=True)
class Index:
    entries: DataFrame
    docs: DataFrame
    positions: DataFrame | None = None

    @property
    def stats(self) -> DataFrame:
        return term_stats(self.entries)

    def persist(self) -> Index:
        """Keeps the tables for further queries.

        Positions come first: entries that are made of them then read what is kept.
        """
        positions = self.positions.persist() if self.positions is not None else None
        return replace(self, entries=self.entries.persist(), docs=self.docs.persist(), positions=positions)

    def unpersist(self) -> None:
        for df in (self.entries, self.docs, self.positions):
            if df is not None:
                df.unpersist()


def empty_index(spark: SparkSession) -> Index:
    return Index(spark.createDataFrame([], entries_schema()), spark.createDataFrame([], DOCS), spark.createDataFrame([], POSITIONS))


def require_unique(docs: DataFrame, live: DataFrame | None = None) -> None:
    """Raises DuplicateDocId if an id stands twice, or is live already."""
    twice = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if live is not None:
        twice = twice.union(docs.join(live, "doc_id", "left_semi").select("doc_id"))
    if bad := twice.limit(1).collect():
        raise DuplicateDocId(f"document {bad[0][0]} is live already")


def index_documents(docs: DataFrame, positional: bool = False, checked: bool = False) -> Index:
    """Index of (doc_id, terms): weights are term frequencies, lengths token counts.

    Tokens are grouped once: with positions, an entry's weight is how many there are.
    """
    if checked:
        require_unique(docs)
    rows = token_rows(docs)
    lengths = docs.select("doc_id", F.size("terms").cast("long").alias("doc_len"))
    if not positional:
        return Index(rows.groupBy("term", "doc_id").agg(F.count("*").alias("w")), lengths)
    positions = rows.groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("ps"))
    return Index(positions.select("term", "doc_id", F.size("ps").cast("long").alias("w")), lengths, positions)


def index_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", positional: bool = False, bulk: bool = False) -> Index:
    """Index of texts.

    bulk: for an index that is kept or sealed whole.  Texts are shuffled by document, and then
    their tokens are grouped where they are made; otherwise tokens are shuffled, of which a
    query's terms leave few.
    """
    if bulk:
        docs = docs.select(id_col, text_col).repartition(id_col)
    return index_documents(tokenised(docs, id_col, text_col), positional)


def index_in_place(docs: DataFrame, positional: bool = False) -> Index:
    """Index of (doc_id, terms) whose ids stand once: the tokens of each document are grouped
    where it is read, so nothing is shuffled, and a task's entries are of whole documents."""
    lengths = docs.select("doc_id", F.size("terms").cast("long").alias("doc_len"))
    rows = docs.select("doc_id", "terms")
    if not positional:
        return Index(rows.mapInArrow(_grouped(False), "term string, doc_id bigint, w bigint"), lengths)
    positions = rows.mapInArrow(_grouped(True), POSITIONS)
    return Index(positions.select("term", "doc_id", F.size("ps").cast("long").alias("w")), lengths, positions)


def _grouped(positional: bool):
    """A function over batches (doc_id, terms): a row for each term of a document, with its positions or their number."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids, lists = b.column(0), b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            terms = lists.flatten().dictionary_encode()
            if not len(terms):
                continue
            doc = np.repeat(np.arange(len(ids)), sizes)
            pos = np.arange(len(terms)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            key = terms.indices.to_numpy().astype(np.int64) * len(ids) + doc
            order = np.argsort(key, kind="stable")
            key = key[order]
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            ends = np.append(heads, len(key))
            if positional:
                own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos[order], pa.int32()))
            else:
                own = pa.array(np.diff(ends), pa.int64())
            yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(key[heads] // len(ids))), ids.take(pa.array(key[heads] % len(ids))), own], ["term", "doc_id", "ps" if positional else "w"])

    return run


def index_weighted(docs: DataFrame, checked: bool = False) -> Index:
    """Index of (doc_id, terms: array of struct(term, weight)); duplicates add up.

    A document's length is the sum of integer weights, or with fractional
    weights the number of pairs, duplicates and zeros included.
    """
    if checked:
        require_unique(docs)
    kind = dict(docs.select(F.explode("terms").alias("x")).select("x.*").dtypes)["weight"]
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    pairs = docs.select("doc_id", F.explode("terms").alias("x")).select("doc_id", "x.term", F.col("x.weight").cast("long" if whole else "double").alias("weight"))
    entries = pairs.groupBy("term", "doc_id").agg(F.sum("weight").alias("w"))
    length = F.aggregate("terms", F.lit(0).cast("long"), lambda a, x: a + x["weight"]) if whole else F.size("terms").cast("long")
    return Index(entries, docs.select("doc_id", length.alias("doc_len")))


def index_impacts(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> Index:
    """Dense vectors as signed integer impacts: the term is the dimension."""
    at = F.posexplode(vector_col).alias("term", "x")
    rows = vectors.select(F.col(id_col).cast("long").alias("doc_id"), at)
    entries = rows.select(F.col("term").cast("long").alias("term"), "doc_id", F.round(F.col("x").cast("double") * scale).cast("long").alias("w"))
    return Index(entries, vectors.select(F.col(id_col).cast("long").alias("doc_id"), F.size(vector_col).cast("long").alias("doc_len")))


def _both(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
    return a.unionByName(b) if a is not None and b is not None else None


def add_documents(index: Index, new: Index, checked: bool = True) -> Index:
    """Both indexes as one; ids must not be live already."""
    if checked:
        require_unique(new.docs, index.docs)
    return Index(index.entries.unionByName(new.entries), index.docs.unionByName(new.docs), _both(index.positions, new.positions))


def delete_documents(index: Index, tombstones: DataFrame) -> Index:
    """The index without the documents named by tombstones (doc_id)."""
    gone = tombstones.select("doc_id").distinct()
    anti = lambda df: df.join(gone, "doc_id", "left_anti").select(*df.columns)
    return Index(anti(index.entries), anti(index.docs), None if index.positions is None else anti(index.positions))


def upsert_documents(index: Index, new: Index) -> Index:
    """Deletes the ids of new, then adds it."""
    return add_documents(delete_documents(index, new.docs), new, checked=False)


def latest(versions: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of each key, by a partial aggregate (no sort of versions)."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("x")).select(key, "x.*")


def term_stats(entries: DataFrame, *more: str, **sums: Column) -> DataFrame:
    """(term, df, total_weight, max_weight, min_weight, all_finite), and further aggregates by name."""
    w = F.col("w").cast("double")
    return entries.groupBy(*more, "term").agg(F.count("*").alias("df"), F.sum("w").alias("total_weight"), F.max("w").alias("max_weight"), F.min("w").alias("min_weight"), F.bool_and(~F.isnan(w) & (F.abs(w) < float("inf"))).alias("all_finite"), *[c.alias(n) for n, c in sums.items()])


def blocked(entries: DataFrame, size: int = BLOCK_SIZE, *more: str) -> DataFrame:
    """entries with block_no: the number of each list's block of ``size``, by document.

    Entries are counted by range of ids; each range is numbered by itself, from where
    the ranges before it end, so no list is one task's work.
    """
    own = entries.columns
    ranged = entries.withColumn("_range", F.floor(F.col("doc_id") / RANGE))
    key = [*more, "term", "_range"]
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*more, "term").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy(*key).agg(F.count("*").alias("_n")).select(*key, before.alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*key).orderBy("doc_id")) - 1
    return ranged.join(starts, key).select(*own, F.floor(place / size).cast("long").alias("block_no"))


def block_table(entries: DataFrame, size: int = BLOCK_SIZE, *more: str, bounded: bool = False) -> DataFrame:
    """(term, block_no, base_doc_id, last_doc_id, n, max_weight): a block covers
    documents above base, the last one of the block before (0 at first), up to last.

    bounded: no list has more than RANGE entries, so each is numbered as a whole, in one shuffle.
    """
    if bounded:
        place = F.row_number().over(Window.partitionBy(*more, "term").orderBy("doc_id")) - 1
        rows = entries.withColumn("block_no", F.floor(place / size).cast("long"))
    else:
        rows = blocked(entries, size, *more)
    b = rows.groupBy(*more, "term", "block_no").agg(F.max("doc_id").alias("last_doc_id"), F.count("*").alias("n"), F.max("w").alias("max_weight"))
    before = F.lag("last_doc_id").over(Window.partitionBy(*more, "term").orderBy("block_no"))
    return b.select(*more, "term", "block_no", F.coalesce(before, F.lit(0)).cast("long").alias("base_doc_id"), "last_doc_id", "n", "max_weight")


def visible(df: DataFrame, mask: DataFrame | Column | None) -> DataFrame:
    """Rows whose documents a mask shows: a table of hidden doc_ids, or a condition."""
    if mask is None:
        return df
    if isinstance(mask, Column):
        return df.where(mask)
    return df.join(mask.select("doc_id").distinct(), "doc_id", "left_anti").select(*df.columns)
