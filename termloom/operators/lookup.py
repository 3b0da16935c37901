"""Point lookups, scans and statistics of an index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BLOCK_SIZE, UnknownDocId
from .build import Index, block_table, blocked, term_stats


def corpus_stats(index: Index) -> DataFrame:
    """num_docs, total_doc_len, avg_doc_len, min_doc_id, max_doc_id; without documents 0, 0, 0, null, null."""
    n, total = F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))
    return index.docs.agg(n.alias("num_docs"), total.alias("total_doc_len"), F.when(n > 0, total / n).otherwise(0.0).alias("avg_doc_len"), F.min("doc_id").alias("min_doc_id"), F.max("doc_id").alias("max_doc_id"))


def num_docs(index: Index) -> int:
    return index.docs.count()


def avg_doc_len(index: Index) -> float:
    """Mean length as a 32-bit float; 0 without documents."""
    r = corpus_stats(index).first()
    return float(np.float32(r.total_doc_len) / np.float32(r.num_docs)) if r.num_docs else 0.0


def doc_id_range(index: Index) -> tuple[int, int] | None:
    r = corpus_stats(index).first()
    return None if r.min_doc_id is None else (r.min_doc_id, r.max_doc_id)


def document_ids(index: Index) -> DataFrame:
    return index.docs.select("doc_id")


def document_lengths(index: Index) -> DataFrame:
    """(doc_id, doc_len) by document."""
    return index.docs.orderBy("doc_id")


def document_len(index: Index, doc_id: int, absent: int | None = 0) -> int | None:
    """A document's length; ``absent`` (0, or None as sealed segments have it) if unknown."""
    r = index.docs.where(F.col("doc_id") == doc_id).select("doc_len").first()
    return r[0] if r else absent


def _of(index: Index, term) -> DataFrame:
    return index.entries.where(F.col("term") == F.lit(term))


def document_frequency(index: Index, term) -> int:
    return _of(index, term).count()


def total_weight(index: Index, term):
    return _of(index, term).agg(F.sum("w")).first()[0] or 0


def max_weight(index: Index, term):
    return _of(index, term).agg(F.max("w")).first()[0] or 0


def terms(index: Index) -> DataFrame:
    return index.entries.select("term").distinct()


def term_meta(index: Index) -> DataFrame:
    """(term, df, max_weight, total_weight), a row for each live term."""
    return term_stats(index.entries).select("term", "df", "max_weight", "total_weight")


def term_frequencies(index: Index, pairs: DataFrame) -> DataFrame:
    """pairs (doc_id, term) with w, 0 where the document lacks the term."""
    return pairs.join(index.entries, ["doc_id", "term"], "left").select("doc_id", "term", F.coalesce("w", F.lit(0)).alias("w"))


def term_frequency(index: Index, doc_id: int, term):
    r = _of(index, term).where(F.col("doc_id") == doc_id).select("w").first()
    return r[0] if r else 0


def entries_of(index: Index, term) -> DataFrame:
    """(doc_id, w) of a term."""
    return _of(index, term).select("doc_id", "w")


def entries_with_lengths(index: Index, term) -> DataFrame:
    """(doc_id, w, doc_len) of a term, all that a length-normalised score needs.

    An entry of a document that isn't listed raises UnknownDocId when it is read.
    """
    unknown = F.raise_error(F.concat(F.lit("UnknownDocId: "), F.col("doc_id").cast("string"))).cast("long")
    return _of(index, term).join(index.docs, "doc_id", "left").select("doc_id", "w", F.coalesce("doc_len", unknown).alias("doc_len"))


def require_known_documents(index: Index) -> None:
    """Raises UnknownDocId if an entry's document isn't listed."""
    if bad := index.entries.join(index.docs, "doc_id", "left_anti").limit(1).collect():
        raise UnknownDocId(str(bad[0]))


def entry_blocks(index: Index, term, size: int = BLOCK_SIZE) -> DataFrame:
    return block_table(_of(index, term), size)


def block_entries(index: Index, term, block_no: int, size: int = BLOCK_SIZE, lengths: bool = False) -> DataFrame:
    """(doc_id, w[, doc_len]) of one block.  An unknown term has no rows; of a
    known term a block that it doesn't have raises IndexError."""
    n = document_frequency(index, term)
    if n and not 0 <= block_no * size < n:
        raise IndexError(f"block {block_no} of {-(-n // size)}")
    rows = blocked(_of(index, term), size).where(F.col("block_no") == block_no).select("doc_id", "w")
    return rows.join(index.docs, "doc_id") if lengths else rows


def positions(index: Index, term: str, doc_id: int) -> list[int]:
    r = index.positions.where((F.col("term") == term) & (F.col("doc_id") == doc_id)).select("ps").first()
    return list(r[0]) if r else []


def docs_with_term(index: Index, term: str) -> DataFrame:
    return index.positions.where(F.col("term") == term).select("doc_id")


def term_positions(index: Index, term: str) -> DataFrame:
    """(doc_id, ps) of a term."""
    return index.positions.where(F.col("term") == term).select("doc_id", "ps")


def sorted_entry_lists(index: Index) -> DataFrame:
    """(term, doc_id, ps) by term, then document."""
    return index.positions.orderBy("term", "doc_id")
