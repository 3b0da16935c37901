"""Exact top-k by sparse inner product.

The plan is one filtered scan, a partial and a final aggregate by document, and
a bounded top-k; the query is a small table, which Spark broadcasts where it is under
its limit, or, for one query of few terms, a case expression that needs no join at all.  Scores are summed in doubles: with
integer or dyadic weights they don't depend on the order of summation.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boolean import of_terms
from .build import Index, visible

#: Query terms above this many go into a table instead of an expression; above the other no filter lists them.
INLINE, LISTED = 64, 1000
#: Ranges that a filter lists, at most.
FILTERED = 4096


def normalise(query: Iterable[tuple]) -> dict:
    """Adds up the weights of each term; terms without weight go."""
    out: dict = {}
    for term, weight in query:
        out[term] = out.get(term, 0.0) + float(weight)
    return {t: w for t, w in out.items() if w != 0}


def scores(entries: DataFrame, query: Iterable[tuple], mask: DataFrame | Column | None = None) -> DataFrame:
    """(doc_id, score) of all documents with a score other than zero."""
    q = normalise(query)
    rows = visible(of_terms(entries, q) if len(q) <= LISTED else entries, mask)
    if len(q) > INLINE:
        table = entries.sparkSession.createDataFrame(list(q.items()), "term " + dict(entries.dtypes)["term"] + ", qw double")
        rows = rows.join(table, "term")
        part = F.col("qw") * F.col("w")
    else:
        part = F.lit(None).cast("double")
        for term, weight in reversed(q.items()):
            part = F.when(F.col("term") == F.lit(term), F.lit(weight) * F.col("w")).otherwise(part)
    return rows.groupBy("doc_id").agg(F.sum(part).alias("score")).where("score <> 0")


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k highest scores, ties to the smaller document."""
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def top_k(index: Index, query: Iterable[tuple], k: int, mask: DataFrame | Column | None = None) -> DataFrame:
    """(doc_id, score) of the k best documents; what a mask hides takes no place."""
    return best(scores(index.entries, query, mask), k)


def top_k_many(index: Index, queries: dict, k: int, mask: DataFrame | Column | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of several queries in one pass over the entries."""
    flat = [(qid, t, w) for qid, q in queries.items() for t, w in normalise(q).items()]
    kind = dict(index.entries.dtypes)["term"]
    table = index.entries.sparkSession.createDataFrame(flat, f"query_id {'bigint' if all(isinstance(x, int) for x in queries) else 'string'}, term {kind}, qw double")
    terms = {t for _, t, _ in flat}
    rows = visible(of_terms(index.entries, terms) if len(terms) <= LISTED else index.entries, mask).join(table, "term")
    scored = rows.groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("w")).alias("score")).where("score <> 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def weight_bounds(index: Index, query: Iterable[tuple]) -> DataFrame:
    """(term, min_weight, max_weight, all_finite) of the query's terms."""
    w = F.col("w").cast("double")
    return of_terms(index.entries, normalise(query)).groupBy("term").agg(F.min("w").alias("min_weight"), F.max("w").alias("max_weight"), F.bool_and(~F.isnan(w) & (F.abs(w) < math.inf)).alias("all_finite"))


def nonnegative(index: Index, query: Iterable[tuple], stats: DataFrame | None = None) -> bool:
    """Whether no entry can lower a score, so that upper bounds hold.

    stats: stored (term, min_weight, all_finite), else taken from the entries.
    """
    q = normalise(query)
    if any(not 0 <= w < math.inf for w in q.values()):
        return False
    bounds = weight_bounds(index, q.items()) if stats is None else of_terms(stats, q)
    r = bounds.agg(F.min("min_weight"), F.bool_and("all_finite")).first()
    return r[0] is None or bool(r[0] >= 0 and r[1])


def bucket_bounds(entries: DataFrame, width: int) -> DataFrame:
    """(term, bucket, max_weight): the largest weight of a term in each range of ``width`` ids."""
    return entries.groupBy("term", F.floor(F.col("doc_id") / width).alias("bucket")).agg(F.max("w").alias("max_weight"))


def top_k_pruned(index: Index, query: Iterable[tuple], k: int, width: int = 4096, mask: DataFrame | Column | None = None) -> DataFrame:
    """The same answer as :func:`top_k` on a live index, skipping id ranges that can't reach it.

    The bounds of ranges come from a pass over the entries of the query's terms, so this is
    for an index that is kept; over sealed segments :func:`top_k_sealed` reads stored bounds
    and opens only the files of some ranges.  The best ranges are scored first; their k-th
    score is the threshold that other ranges' bounds must reach (a tie may still win by its
    id).  Without proof that no entry lowers a score it is the plain plan.
    """
    q = normalise(query)
    if k < 1 or not q or not nonnegative(index, q.items()):
        return top_k(index, q.items(), k, mask)
    bounds = bucket_bounds(of_terms(index.entries, q), width)
    per = scores(bounds.select("term", F.col("bucket").alias("doc_id"), F.col("max_weight").alias("w")), q.items())
    ahead = [r.doc_id for r in best(per, 4).collect()]
    first = best(scores(index.entries.where(within(ahead, width)), q.items(), mask), k).collect()
    if len(first) < k:
        return top_k(index, q.items(), k, mask)
    reach = per.where(F.col("score") >= first[-1].score).select(F.col("doc_id").alias("_bucket"))
    few = [r[0] for r in reach.limit(FILTERED + 1).collect()]
    if len(few) <= FILTERED:
        rows = index.entries.where(within(few, width))
    else:
        rows = index.entries.withColumn("_bucket", F.floor(F.col("doc_id") / width)).join(reach, "_bucket", "left_semi").drop("_bucket")
    return best(scores(rows, q.items(), mask), k)


def within(buckets: Iterable[int], width: int) -> Column:
    """A condition on doc_id for ranges of ids, neighbours joined: one that reaches a scan.

    Of many runs only their ends do, and ranges are looked up: an expression with a term for
    each would be too deep for the optimizer.
    """
    out, runs = F.lit(False), []
    for b in sorted(buckets):
        if runs and runs[-1][1] == b - 1:
            runs[-1][1] = b
        else:
            runs.append([b, b])
    if len(runs) > INLINE:
        inside = F.col("doc_id").between(runs[0][0] * width, (runs[-1][1] + 1) * width - 1)
        return inside & F.floor(F.col("doc_id") / width).isin([b for a, z in runs for b in range(a, z + 1)])
    for a, z in runs:
        out = out | F.col("doc_id").between(a * width, (z + 1) * width - 1)
    return out


@dataclass(frozen=True)
class Round:
    """One job of a pruned search: how many ranges it opened, the entries of the query's terms
    that they hold, and the k-th score after it (None while there are less than k hits)."""

    ranges: int
    entries: int
    threshold: float | None


@dataclass(frozen=True)
class PrunedHits:
    """hits (doc_id, score); the ranges (segment_id, doc_range, bound, n) of the query's terms,
    n being their entries, with whether they were opened; and the rounds."""

    hits: DataFrame
    ranges: DataFrame
    rounds: list[Round]

    @property
    def opened(self) -> int:
        return sum(r.ranges for r in self.rounds)

    @property
    def entries_read(self) -> int:
        return sum(r.entries for r in self.rounds)


def range_bounds(ranges: DataFrame, query: Iterable[tuple]) -> tuple[list, bool]:
    """Rows (segment_id, doc_range, bound, n) by falling bound, and whether bounds hold: all
    weights, of the query and stored, are finite and not negative.  One scan of the query's
    terms in the statistics of ranges; a row for each range that holds one comes back."""
    q = normalise(query)
    part = F.lit(None).cast("double")
    for term, weight in reversed(q.items()):
        part = F.when(F.col("term") == F.lit(term), F.lit(weight) * F.col("max_weight")).otherwise(part)
    per = of_terms(ranges, q).groupBy("segment_id", "doc_range").agg(F.sum(part).alias("bound"), F.sum("df").alias("n"), F.min("min_weight").alias("least"), F.bool_and("all_finite").alias("finite"))
    rows = per.collect()
    safe = all(0 <= w < math.inf for w in q.values()) and all(r.finite and r.least >= 0 for r in rows)
    return sorted(rows, key=lambda r: (-r.bound, r.segment_id, r.doc_range)), safe


def top_k_sealed(store, query: Iterable[tuple], k: int, mask: DataFrame | Column | None = None, seed: Iterable[tuple] = (), first: int = 1) -> PrunedHits:
    """Exact top-k over sealed segments, opening the files of as few ranges as it can.

    Stored statistics bound the score of each range of documents.  Ranges are opened in
    rounds of falling bound, ``first`` ranges and then twice as many each time; each round
    is one job, whose scan gets the ranges as partition filters.  After each the k-th score
    so far is the threshold: a range stays closed if its bound lies below, or equals it (at
    which it could only tie) while all its ids are larger than that of the k-th hit.  With
    weights that may lower scores all ranges are opened at once.

    Deleted documents don't count.  ``seed``: hits (doc_id, score) found elsewhere.  Ties go to
    the smaller id.
    """
    q = normalise(query)
    ranked, safe = range_bounds(store.ranges(), q.items()) if q and k > 0 else ([], True)
    hits = sorted(((int(d), float(x)) for d, x in seed), key=lambda h: (-h[1], h[0]))[: max(k, 0)]
    hidden, entries = store.hidden(), store.entries()
    widths = {r.segment_id: r.range_width for r in store.manifest().select("segment_id", "range_width").collect()}
    rounds: list[Round] = []
    opened: set[tuple[int, int]] = set()

    def can_win(r) -> bool:
        if len(hits) < k or not safe:
            return True
        least, at = hits[-1][1], hits[-1][0]
        return r.bound > least or (r.bound == least and r.doc_range * widths[r.segment_id] < at)

    waiting, size = [r for r in ranked if r.bound or not safe], first if safe else len(ranked)
    while waiting:
        batch, waiting = [r for r in waiting[:size] if can_win(r)], waiting[size:]
        size = min(2 * size, FILTERED)
        if not batch:
            break
        pairs = [(r.segment_id, r.doc_range) for r in batch]
        for at in range(0, len(pairs), FILTERED):
            rows = of_terms(entries.where(in_ranges(pairs[at : at + FILTERED])), q)
            found = best(scores(store.visible(rows, hidden), q.items(), mask), k).collect()  # k rows
            hits = sorted(hits + [(r.doc_id, r.score) for r in found], key=lambda h: (-h[1], h[0]))[:k]
        opened |= set(pairs)
        rounds.append(Round(len(batch), sum(r.n for r in batch), hits[-1][1] if len(hits) == k else None))
    spark = store.spark
    told = [(r.segment_id, r.doc_range, float(r.bound or 0), r.n, (r.segment_id, r.doc_range) in opened) for r in ranked]
    return PrunedHits(spark.createDataFrame(hits, "doc_id bigint, score double"), spark.createDataFrame(told, "segment_id bigint, doc_range bigint, bound double, n bigint, opened boolean"), rounds)


def in_ranges(pairs: Iterable[tuple[int, int]]) -> Column:
    """A condition on (segment_id, doc_range), which are folders: a partition filter; in shared
    files it reaches the scan.  Of many segments it is a look-up, as deep as one of few."""
    by_segment: dict[int, list[int]] = {}
    for segment, part in pairs:
        by_segment.setdefault(segment, []).append(part)
    if len(by_segment) > INLINE:
        keys = [f"{segment}/{part}" for segment, parts in by_segment.items() for part in parts]
        near = F.col("segment_id").isin(list(by_segment)) & F.col("doc_range").isin(sorted({p for parts in by_segment.values() for p in parts}))
        return near & F.concat_ws("/", F.col("segment_id").cast("string"), F.col("doc_range").cast("string")).isin(keys)
    out = F.lit(False)
    for segment, parts in sorted(by_segment.items()):
        out = out | ((F.col("segment_id") == segment) & F.col("doc_range").isin(sorted(parts)))
    return out


@dataclass(frozen=True)
class SegmentedHits:
    hits: DataFrame
    seen: int
    scored: int
    pruned: int


def segment_bounds(segmented: DataFrame, query: Iterable[tuple], maxima: DataFrame | None = None) -> list[tuple[int, float]]:
    """(segment, upper bound) of segments that can score at all, highest first.

    maxima: stored (segment_id, term, max_weight), else taken from the entries.
    """
    q = normalise(query)
    if maxima is None:
        maxima = of_terms(segmented, q).groupBy("segment_id", "term").agg(F.max("w").alias("max_weight"))
    part = F.lit(None).cast("double")
    for term, weight in q.items():
        part = F.when(F.col("term") == F.lit(term), F.lit(weight) * F.col("max_weight")).otherwise(part)
    rows = of_terms(maxima, q).groupBy("segment_id").agg(F.sum(part).alias("bound")).where("bound <> 0").orderBy(F.desc("bound"), "segment_id").collect()  # a row for each segment
    return [(r.segment_id, r.bound) for r in rows]


def top_k_with_stats(segmented: DataFrame, query: Iterable[tuple], k: int, seed: DataFrame | None = None, mask: DataFrame | Column | None = None, maxima: DataFrame | None = None, n_segments: int | None = None, stats: DataFrame | None = None) -> SegmentedHits:
    """Top-k over segments (entries with segment_id) from the highest bound on, in
    batches of one, two, four and so on, each of them one job; segments whose bound
    lies below the k-th score before their batch are skipped.

    seed: hits (doc_id, score) found elsewhere, such as in a live index.  stats: stored
    (term, min_weight, all_finite), else taken from a pass over the entries; with weights
    that may lower scores nothing is skipped.
    """
    spark, q = segmented.sparkSession, normalise(query)
    safe = nonnegative(Index(segmented, segmented), q.items(), stats)
    seen = n_segments if n_segments is not None else segmented.select("segment_id").distinct().count()
    hits = [(r.doc_id, r.score) for r in (best(seed, k).collect() if seed is not None else [])]
    if not safe:
        more = best(scores(segmented, q.items(), mask), k).collect()
        hits += [(r.doc_id, r.score) for r in more]
        done = seen
    else:
        done = 0
        waiting = segment_bounds(segmented, q.items(), maxima)
        while waiting:
            batch = [s for s, bound in waiting[: max(1, done + 1)] if len(hits) < k or bound >= hits[-1][1]]
            if not batch:
                break
            done, waiting = done + len(batch), waiting[len(batch) :]
            rows = best(scores(segmented.where(F.col("segment_id").isin(batch)), q.items(), mask), k).collect()  # k rows
            hits = sorted(hits + [(r.doc_id, r.score) for r in rows], key=lambda x: (-x[1], x[0]))[:k]
    hits = sorted(hits, key=lambda x: (-x[1], x[0]))[:k]
    return SegmentedHits(spark.createDataFrame(hits, "doc_id bigint, score double"), seen, done, seen - done)


def top_k_segments(segmented: DataFrame, query: Iterable[tuple], k: int, mask: DataFrame | Column | None = None) -> DataFrame:
    """Exact top-k over all segments at once; document ids are unique across them."""
    return best(scores(segmented, query, mask), k)


def top_k_segments_and_live(segmented: DataFrame, live: Index, query: Iterable[tuple], k: int, mask: DataFrame | Column | None = None) -> DataFrame:
    """Exact top-k over entries with segment_id and a live index, as one plan."""
    return best(scores(segmented.select("term", "doc_id", "w").unionByName(live.entries.select("term", "doc_id", "w")), query, mask), k)


def top_k_sealed_and_live(store, live: Index, query: Iterable[tuple], k: int, mask: DataFrame | Column | None = None, first: int = 1) -> PrunedHits:
    """Exact top-k over sealed segments and a live index, whose ids are different.

    The live index is searched first: its k-th score decides which ranges of which segments
    are opened at all.
    """
    own = top_k(live, query, k, mask).collect() if k > 0 else []
    return top_k_sealed(store, query, k, mask, [(r.doc_id, r.score) for r in own], first)
