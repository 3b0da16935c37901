"""Text to terms.  Callers may bring their own token arrays instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A term is a run of letters and digits of the lower-cased text.
TERM = r"[\p{L}\p{N}]+"


def terms_of(text: Column) -> Column:
    """The terms of a text in order; null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, terms) of a table of texts."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), terms_of(F.col(text_col)).alias("terms"))


def token_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, term), a row for each token of (doc_id, terms); pos from 0.

    The outer form keeps Catalyst from testing for empty arrays first, which
    would tokenize every text twice.
    """
    return docs.select("doc_id", F.posexplode_outer("terms").alias("pos", "term")).where("pos is not null")
