"""Boolean candidates.  Query terms are few and known, so they filter the scan
of entries (the filter reaches below the aggregate that makes entries)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .build import Index, visible


def of_terms(df: DataFrame, query: Iterable) -> DataFrame:
    """Rows of the query's distinct terms."""
    distinct = list(dict.fromkeys(query))
    return df.where(F.col("term").isin(distinct)) if distinct else df.where(F.lit(False))


def candidates_any(index: Index, query: Iterable, mask: DataFrame | Column | None = None) -> DataFrame:
    """doc_ids with at least one query term; no terms: none."""
    return visible(of_terms(index.entries, query), mask).select("doc_id").distinct()


def candidates_all(index: Index, query: Iterable, mask: DataFrame | Column | None = None) -> DataFrame:
    """doc_ids with every distinct query term; no terms, or an unknown one: none."""
    query = list(dict.fromkeys(query))
    rows = visible(of_terms(index.entries, query), mask)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(query)).select("doc_id")


def candidates_all_multiplicity(index: Index, query: Iterable[str], mask: DataFrame | Column | None = None) -> DataFrame:
    """doc_ids that hold each term as often as the query does."""
    need = Counter(query)
    enough = F.lit(False)
    for term, k in need.items():
        enough = enough | ((F.col("term") == term) & (F.col("w") >= k))
    rows = visible(of_terms(index.entries, need), mask).where(enough)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(need)).select("doc_id")


def union(*lists: DataFrame) -> DataFrame:
    """Documents of any of the lists (doc_id)."""
    out = lists[0]
    for x in lists[1:]:
        out = out.union(x)
    return out.distinct()


def intersection(*lists: DataFrame) -> DataFrame:
    """Documents of all of the lists (doc_id)."""
    out = lists[0]
    for x in lists[1:]:
        out = out.join(x, "doc_id", "left_semi")
    return out.distinct()
