"""Cost-based choice between an index's candidates and a scan of everything."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.boolean import candidates_all, candidates_any, of_terms
from ..operators.build import Index


@dataclass(frozen=True)
class PlannerConfig:
    max_candidate_ratio: float = 0.6
    max_candidates: int = 200_000


@dataclass(frozen=True)
class CandidatePlan:
    """Candidate documents, or (scan_all) the advice to read all of them."""

    candidates: DataFrame | None = None

    @property
    def scan_all(self) -> bool:
        return self.candidates is None


def too_broad(estimate: int, n: int, config: PlannerConfig) -> bool:
    """At the count limit or above it; strictly above the ratio, in 32-bit floats."""
    return estimate >= config.max_candidates or bool(np.float32(estimate) / np.float32(n) > np.float32(config.max_candidate_ratio))


def estimate(index: Index, query: Iterable, stats: DataFrame | None = None) -> int:
    """Sum of document frequencies over distinct terms; from stats alone where given."""
    if stats is not None:
        return of_terms(stats, query).agg(F.sum("df")).first()[0] or 0
    return of_terms(index.entries, query).count()


def _plan(index: Index, query: Iterable, config: PlannerConfig, answer, stats: DataFrame | None, n: int | None) -> CandidatePlan:
    query = list(query)
    n = index.docs.count() if n is None else n
    if not query or not n:
        return CandidatePlan(index.docs.select("doc_id").where(F.lit(False)))
    if too_broad(estimate(index, query, stats), n, config):
        return CandidatePlan()
    return CandidatePlan(answer(index, query))


def plan_candidates(index: Index, query: Iterable, config: PlannerConfig = PlannerConfig(), stats: DataFrame | None = None, n: int | None = None) -> CandidatePlan:
    """Documents with any term, unless they are estimated to be too many."""
    return _plan(index, query, config, candidates_any, stats, n)


def plan_candidates_near(index: Index, query: Iterable[str], config: PlannerConfig = PlannerConfig(), stats: DataFrame | None = None, n: int | None = None) -> CandidatePlan:
    """The same estimate; documents with all terms."""
    return _plan(index, query, config, candidates_all, stats, n)


def plan_segments(store, query: Iterable, config: PlannerConfig = PlannerConfig()) -> DataFrame:
    """(segment_id, doc_count, estimate, scan_all) of each sealed segment: the choice for it, from
    the stored statistics of the query's terms and the manifest.  No entry is read."""
    terms = list(dict.fromkeys(query))
    found = of_terms(store.terms(), terms).groupBy("segment_id").agg(F.sum("df").alias("estimate"))
    rows = store.manifest().select("segment_id", "doc_count").join(found, "segment_id", "left").withColumn("estimate", F.coalesce("estimate", F.lit(0).cast("long")))
    ratio = F.col("estimate").cast("float").cast("double") / F.col("doc_count").cast("float").cast("double")
    broad = (F.col("estimate") >= config.max_candidates) | (ratio.cast("float") > F.lit(float(np.float32(config.max_candidate_ratio))).cast("float"))
    return rows.select("segment_id", "doc_count", "estimate", ((F.col("doc_count") > 0) & broad).alias("scan_all") if terms else F.lit(False).alias("scan_all"))


@dataclass(frozen=True)
class SealedPlan(CandidatePlan):
    """A plan over sealed segments: the estimate, and the segments that hold a query term."""

    estimate: int = 0
    segments: tuple[int, ...] = ()


def plan_candidates_sealed(store, query: Iterable, config: PlannerConfig = PlannerConfig(), near: bool = False) -> SealedPlan:
    """Candidates (``near``: documents with all terms) over all sealed segments.

    Planning reads ``terms`` and the manifest; the candidates, once they are read, only the
    folders of segments that hold a term.  Estimates are those of sealing; deleted documents
    are no candidates.
    """
    terms = list(dict.fromkeys(query))
    rows = plan_segments(store, terms, config).collect()  # a row for each segment
    n, total = sum(r.doc_count for r in rows), sum(r.estimate for r in rows)
    if terms and n and too_broad(total, n, config):
        return SealedPlan(None, total)
    held = tuple(sorted(r.segment_id for r in rows if r.estimate))
    entries = store.entries()
    if len(held) < len(rows):
        entries = entries.where(F.col("segment_id").isin(list(held)))
    entries = store.visible(of_terms(entries, terms))
    return SealedPlan((candidates_all if near else candidates_any)(Index(entries, store.docs()), terms), total, held)
