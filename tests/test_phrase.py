"""Phrases and proximity against direct definitions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from termloom.operators import phrase
from termloom.operators.build import index_documents


def index_of(spark, rows):
    return index_documents(spark.createDataFrame(rows, "doc_id bigint, terms array<string>"), positional=True).persist()


def ids(df):
    rows = [r.doc_id for r in df.collect()]
    assert len(rows) == len(set(rows))
    return sorted(rows)


def is_phrase(ts, q):
    return bool(q) and any(ts[i : i + len(q)] == q for i in range(len(ts) - len(q) + 1))


def is_near(ts, q, w, ordered):
    if len(q) < 2 or w < 1:
        return False
    places = [[i for i, t in enumerate(ts) if t == x] for x in q]
    for c in itertools.product(*places):
        if len(set(c)) == len(c) and max(c) - min(c) <= w and (not ordered or list(c) == sorted(c)):
            return True
    return False


def test_small(spark):
    i = index_of(spark, [(1, "new york city".split()), (2, "new jersey york".split()), (3, ["a"]), (4, "a x a".split()), (5, "a x x a".split())])
    assert ids(phrase.phrase_match(i, ["new", "york"])) == [1] and ids(phrase.phrase_match(i, [])) == [] and ids(phrase.phrase_match(i, ["york"])) == [1, 2]
    assert ids(phrase.near_match(i, "new", "york", 2)) == [1, 2] and ids(phrase.near_match(i, "york", "new", 1)) == [1] and ids(phrase.near_match(i, "new", "york", 0)) == []
    assert ids(phrase.near_match(i, "a", "a", 2)) == [4] and ids(phrase.near_match(i, "a", "a", 3)) == [4, 5] and ids(phrase.near_terms(i, ["a"], 5)) == []
    j = index_of(spark, [(1, "a x a b".split())])
    assert ids(phrase.near_terms(j, ["a", "a", "b"], 3, True)) == [1] and ids(phrase.near_terms(j, ["b", "a", "a"], 3, True)) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    rng = random.Random(seed)
    rows = [(d, [rng.choice("abcdef") for _ in range(rng.randrange(4, 24))]) for d in range(40)]
    i = index_of(spark, rows)
    for q, w in (("ab", 1), ("aa", 3), ("abc", 5), ("cba", 2), ("aab", 8), ("abca", 5)):
        q = list(q)
        assert ids(phrase.phrase_match(i, q)) == [d for d, ts in rows if is_phrase(ts, q)]
        for ordered in (False, True):
            assert ids(phrase.near_terms(i, q, w, ordered)) == [d for d, ts in rows if is_near(ts, q, w, ordered)], (q, w, ordered)


def test_segments_and_mask(spark):
    rows = [(1, "a b c".split()), (2, "a b".split()), (10, "x a b".split()), (11, "b a".split())]
    i = phrase.segmented(index_of(spark, rows), F.floor(F.col("doc_id") / 10))
    hide = spark.createDataFrame([(2,)], "doc_id bigint")
    assert ids(phrase.over_segments(phrase.phrase_match, i, ["a", "b"])) == [1, 2, 10]
    assert ids(phrase.over_segments(phrase.phrase_match, i, ["a", "b"], mask=hide)) == [1, 10]
    assert ids(phrase.over_segments(phrase.near_match, i, "a", "b", 1, mask=F.col("doc_id") > 1)) == [2, 10, 11]
    assert ids(phrase.over_segments(phrase.near_terms, i, ["a", "b"], 1, ordered=True)) == [1, 2, 10]


def test_cache(spark):
    i = index_of(spark, [(1, "a b a".split()), (2, "b c".split())])
    c = phrase.TermCache(i)
    assert c.is_empty and ids(c.phrase_match(["a", "b"])) == [1] and ids(c.near_match("b", "c", 1)) == [2]
    assert c.term_positions("missing").count() == 0 and "missing" in c and len(c) == 4
    assert c.cached_terms() == ["a", "b", "c", "missing"] and c.entry_count() == 4 and c.position_count() == 5
    assert c.remove_term("a") and not c.remove_term("a") and len(c) == 3
    c.clear()
    assert c.is_empty
