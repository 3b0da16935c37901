"""Phrases and proximity over token positions.

Both work on position lists of documents that hold every term, with built-in
functions that take time in proportion to the lists.  On token rows each token of a
phrase votes for the place where the phrase would start, and a place with all votes
is a match.  All results are distinct doc_ids.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bitmaps
from ..schema import CacheMismatch
from .boolean import of_terms
from .build import Index, visible


def _none(df: DataFrame) -> DataFrame:
    return df.select("doc_id").where(F.lit(False))


def token_table(index: Index) -> DataFrame:
    """(doc_id, pos, term) of an index's positions."""
    return index.positions.select("doc_id", F.explode("ps").alias("pos"), "term")


def phrase_in(tokens: DataFrame, phrase: Sequence[str], mask: DataFrame | Column | None = None) -> DataFrame:
    """doc_ids whose tokens (doc_id, pos, term) hold the phrase; an empty phrase: none."""
    phrase = list(phrase)
    if not phrase:
        return _none(tokens)
    rows = visible(of_terms(tokens, phrase), mask)
    if len(phrase) == 1:
        return rows.select("doc_id").distinct()
    votes = F.lit(None).cast("array<int>")
    for term in dict.fromkeys(phrase):
        offsets = F.array(*[F.lit(i) for i, t in enumerate(phrase) if t == term])
        votes = F.when(F.col("term") == term, offsets).otherwise(votes)
    starts = rows.select("doc_id", F.explode(F.transform(votes, lambda i: F.col("pos") - i)).alias("start")).where("start >= 0")
    return starts.groupBy("doc_id", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(phrase)).select("doc_id").distinct()


def phrase_match(index: Index, phrase: Sequence[str], mask: DataFrame | Column | None = None, stats: DataFrame | None = None) -> DataFrame:
    """doc_ids whose positions hold the phrase.

    Only documents that hold all of its terms are looked at; in them the terms' lists,
    moved to where the phrase would start, must have a place in common.  stats: stored
    (term, df), which name the rarest term as an anchor (see :func:`anchored`).
    """
    phrase = list(phrase)
    if not phrase:
        return _none(index.positions)
    if len(phrase) == 1:
        return visible(of_terms(index.positions, phrase), mask).select("doc_id").distinct()
    names = {t: f"p{i}" for i, t in enumerate(dict.fromkeys(phrase))}
    starts = [F.transform(names[t], (lambda at: lambda p: p - at)(i)) for i, t in enumerate(phrase)]
    common = starts[0]
    for s in starts[1:]:
        common = F.array_intersect(common, s)
    return _lists_of(index, list(names), mask, stats).where(F.size(common) > 0).select("doc_id")


def anchored(rows: DataFrame, terms: Sequence[str], stats: DataFrame) -> DataFrame:
    """rows (term, doc_id, ...) of the documents that hold the rarest of the terms.

    Its documents become a bitmap, against which the lists of the other terms are tested in
    the stage that scans them, so that of frequent terms only these documents' lists are
    shuffled.  stats (term, df) tell which term is the rarest and bound the bitmap: beyond
    the size that is broadcast there is nothing to be won, and rows stay as they are.  A term
    that stats don't know is in no document.
    """
    known = {r.term: r.df for r in of_terms(stats, terms).groupBy("term").agg(F.sum("df").alias("df")).collect()}  # the query's terms
    if any(t not in known for t in terms):
        return rows.where(F.lit(False))
    rarest = min(terms, key=lambda t: (known[t], t))
    key = F.col("doc_id.doc_id") if dict(rows.dtypes)["doc_id"].startswith("struct") else F.col("doc_id")
    if len(set(terms)) < 2 or known[rarest] > bitmaps.ROWS:
        return rows
    bitmap = bitmaps.bitmap_of(rows.where(F.col("term") == rarest).select(key.alias("doc_id")))
    return bitmaps.select(rows, bitmap, rows=known[rarest], doc_id=key)  # no more ranges than documents


def _lists_of(index: Index, terms: Sequence[str], mask, stats: DataFrame | None = None) -> DataFrame:
    """The same from an index: its lists are ready, so they are only brought together."""
    rows = visible(of_terms(index.positions, terms), mask)
    rows = rows if stats is None else anchored(rows, terms, stats)
    lists = [F.max(F.when(F.col("term") == t, F.col("ps"))).alias(f"p{i}") for i, t in enumerate(terms)]
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), *lists).where(F.col("n") == len(terms))


def _places(n: int) -> Column:
    """All occurrences (pos, t) of the lists p0, p1, ... by position."""
    return F.sort_array(F.concat(*[F.transform(f"p{t}", (lambda t: lambda p: F.struct(p.cast("long").alias("pos"), F.lit(t).alias("t")))(t)) for t in range(n)]))


def _unordered(counts: Counter, window: int) -> Column:
    """Some span of the window holds each term often enough.

    One pass: each term's last k places are kept, k being how often it is asked for;
    at every place the earliest of those must lie in the window that ends there.
    """
    needs = list(counts.values())
    start = F.struct(*[F.array(*[F.lit(-(1 << 40))] * k).alias(f"a{t}") for t, k in enumerate(needs)], F.lit(False).alias("ok"))

    def step(acc: Column, x: Column) -> Column:
        held = [F.when(x["t"] == t, F.concat(F.slice(acc[f"a{t}"], 2, k - 1), F.array(x["pos"]))).otherwise(acc[f"a{t}"]) for t, k in enumerate(needs)]
        inside = F.lit(True)
        for a in held:
            inside = inside & (x["pos"] - a[0] <= window)
        return F.struct(*[a.alias(f"a{t}") for t, a in enumerate(held)], (acc["ok"] | inside).alias("ok"))

    return F.aggregate(_places(len(needs)), start, step, lambda acc: acc["ok"])


def _ordered(query: Sequence[str], terms: Sequence[str], window: int) -> Column:
    """Some increasing places of the query's terms lie in the window.

    One pass: for each beginning of the query the latest place where places for it,
    all so far, can start.
    """
    never, at = F.lit(-(1 << 40)), [terms.index(t) for t in query]
    start = F.struct(F.array(*[never] * len(query)).alias("best"), F.lit(False).alias("ok"))

    def step(acc: Column, x: Column) -> Column:
        best = [F.when(x["t"] == t, F.greatest(acc["best"][j], acc["best"][j - 1]) if j else x["pos"]).otherwise(acc["best"][j]) for j, t in enumerate(at)]
        return F.struct(F.array(*best).alias("best"), (acc["ok"] | (x["pos"] - best[-1] <= window)).alias("ok"))

    return F.aggregate(_places(len(terms)), start, step, lambda acc: acc["ok"])


def near_terms(index: Index, query: Sequence[str], window: int, ordered: bool = False, mask: DataFrame | Column | None = None, stats: DataFrame | None = None) -> DataFrame:
    """doc_ids where all query terms stand within a window of positions.

    Unordered: some span with last - first <= window holds each term as often as
    the query does.  Ordered: strictly increasing positions in query order.  Less
    than two terms or a window of 0: none.  stats: as for :func:`phrase_match`.
    """
    query = list(query)
    if len(query) < 2 or window < 1:
        return _none(index.positions)
    counts = Counter(query)
    rows = _lists_of(index, list(counts), mask, stats)
    condition = _ordered(query, list(counts), window) if ordered else _unordered(counts, window)
    return rows.where(condition).select("doc_id")


def near_match(index: Index, a: str, b: str, window: int, mask: DataFrame | Column | None = None, stats: DataFrame | None = None) -> DataFrame:
    """doc_ids where a and b stand at most ``window`` positions apart, either first;
    the same term twice needs two places."""
    return near_terms(index, [a, b], window, False, mask, stats)


def segmented(index: Index, segment_id: Column) -> Index:
    """An index whose tables carry a segment_id (a condition on doc_id gives it)."""
    tag = lambda df: df.withColumn("segment_id", segment_id)
    return Index(tag(index.entries), tag(index.docs), None if index.positions is None else tag(index.positions))


def over_segments(match, index: Index, *args, **kwargs) -> DataFrame:
    """phrase_match, near_match or near_terms on each segment for itself; a
    document of several segments matches if one of them does.

    The segment joins the document key, so one pass serves all segments.  With ``stats``
    (stored, of all segments) the lists of frequent terms are filtered first.
    """
    key = F.struct("segment_id", "doc_id")
    keyed = Index(index.entries, index.docs, index.positions.select("term", key.alias("doc_id"), "ps"))
    mask = kwargs.pop("mask", None)
    hits = match(keyed, *args, **kwargs).select("doc_id.*")
    return visible(hits, mask).select("doc_id").distinct()


class TermCache:
    """Position lists of terms that a caller looks up again and again.

    Each term's rows are persisted on the cluster at its first use, misses too;
    a cache serves the one index that it was made for.
    """

    def __init__(self, index: Index):
        self.index, self._held = index, {}

    def require(self, index: Index) -> None:
        """Raises CacheMismatch unless this cache was made for the index."""
        if not self.index.positions.sameSemantics(index.positions):
            raise CacheMismatch("the cache was made for another index")

    def term_positions(self, term: str) -> DataFrame:
        return self._entry(term)[0]

    def _entry(self, term: str) -> tuple[DataFrame, int, int]:
        if term not in self._held:
            rows = self.index.positions.where(F.col("term") == term).persist()
            n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("ps")), F.lit(0))).first()
            self._held[term] = rows, n, total
        return self._held[term]

    def as_index(self, terms: Iterable[str]) -> Index:
        """The cached part of the index that a query on these terms needs."""
        frames = [self._entry(t)[0] for t in dict.fromkeys(terms)]
        positions = frames[0]
        for f in frames[1:]:
            positions = positions.unionByName(f)
        return Index(positions.select("term", "doc_id", F.size("ps").cast("long").alias("w")), self.index.docs, positions)

    def phrase_match(self, phrase: Sequence[str], mask=None, index: Index | None = None) -> DataFrame:
        if index is not None:
            self.require(index)
        return phrase_match(self.as_index(phrase), phrase, mask) if phrase else _none(self.index.positions)

    def near_terms(self, query: Sequence[str], window: int, ordered: bool = False, mask=None, index: Index | None = None) -> DataFrame:
        if index is not None:
            self.require(index)
        return near_terms(self.as_index(query), query, window, ordered, mask) if query else _none(self.index.positions)

    def near_match(self, a: str, b: str, window: int, mask=None) -> DataFrame:
        return self.near_terms([a, b], window, False, mask)

    def __len__(self) -> int:
        return len(self._held)

    @property
    def is_empty(self) -> bool:
        return not self._held

    def entry_count(self) -> int:
        return sum(n for _, n, _ in self._held.values())

    def position_count(self) -> int:
        return sum(n for *_, n in self._held.values())

    def __contains__(self, term: str) -> bool:
        return term in self._held

    def cached_terms(self) -> list[str]:
        return sorted(self._held)

    def remove_term(self, term: str) -> bool:
        if term not in self._held:
            return False
        self._held.pop(term)[0].unpersist()
        return True

    def clear(self) -> None:
        for term in list(self._held):
            self.remove_term(term)
