"""Top-k against exact dot products."""

import random

import pytest

from termloom.operators import score
from termloom.operators.build import Index, index_weighted


def index_of(spark, rows, kind="double"):
    return index_weighted(spark.createDataFrame(rows, f"doc_id bigint, terms array<struct<term:string,weight:{kind}>>"))


def brute(rows, query, k, hidden=()):
    q = {}
    for t, w in query:
        q[t] = q.get(t, 0) + w
    s = [(d, sum(q.get(t, 0) * w for t, w in ts)) for d, ts in rows if d not in hidden]
    return sorted(((d, x) for d, x in s if x != 0), key=lambda x: (-x[1], x[0]))[:k]


def got(df):
    return [(r.doc_id, r.score) for r in df.collect()]


def test_fixed_cases(spark):
    tie = index_of(spark, [(4, [("a", 1.0)]), (2, [("a", 1.0)]), (3, [("a", 1.0)])])
    assert got(score.top_k(tie, [("a", 1.0)], 2)) == [(2, 1.0), (3, 1.0)]
    gone = index_of(spark, [(0, [("a", 1.0), ("b", 1.0)]), (1, [("a", 1.0)])])
    assert got(score.top_k(gone, [("a", 1.0), ("b", -1.0)], 5)) == [(1, 1.0)]
    assert got(score.top_k(gone, [("a", 1.0)], 0)) == [] and got(score.top_k(gone, [], 3)) == [] and got(score.top_k(gone, [("a", 0.0)], 3)) == []
    toy = [(0, [("river", 0.75), ("copper", 1.25)]), (2, [("salt", 3.0), ("copper", 0.5)]), (3, [("river", 4.0)])]
    assert got(score.top_k(index_of(spark, toy), [("copper", 2.5), ("salt", 0.5), ("river", 1.0)], 3)) == brute(toy, [("copper", 2.5), ("salt", 0.5), ("river", 1.0)], 3)


@pytest.mark.parametrize("stride", [1, 97])
def test_random_signed(spark, stride):
    rng = random.Random(stride)
    rows = [(d * stride, [(f"t{rng.randrange(20)}", 0.25 * rng.randrange(8)) for _ in range(rng.randrange(16))]) for d in range(40)]
    i = index_of(spark, rows).persist()
    for k in (0, 1, 5, 50):
        q = [(f"t{rng.randrange(20)}", 0.25 * rng.randrange(-8, 8)) for _ in range(6)]
        assert got(score.top_k(i, q, k)) == brute(rows, q, k)
        assert got(score.top_k_pruned(i, q, k, width=8 * stride)) == brute(rows, q, k)
    long = [(f"t{n % 20}", 0.25 * (n % 5)) for n in range(100)] + [(f"x{n}", 1.0) for n in range(80)]
    assert got(score.top_k(i, long, 10)) == brute(rows, long, 10)
    hidden = spark.createDataFrame([(d * stride,) for d in range(0, 40, 3)], "doc_id bigint")
    assert got(score.top_k(i, [("t1", 1.0), ("t2", 0.5)], 4, hidden)) == brute(rows, [("t1", 1.0), ("t2", 0.5)], 4, {d * stride for d in range(0, 40, 3)})


def test_pruning_keeps_ties(spark):
    rows = [(d, [("a", 4.0 if d < 3 else 1.0), ("b", 1.0)]) for d in range(200)] + [(1000, [("a", 4.0), ("b", 1.0)])]
    i = index_of(spark, rows).persist()
    for k in (1, 3, 4, 10):
        assert got(score.top_k_pruned(i, [("a", 1.5), ("b", 1.0)], k, width=16)) == brute(rows, [("a", 1.5), ("b", 1.0)], k)
    assert score.nonnegative(i, [("a", 1.0)]) and not score.nonnegative(i, [("a", -1.0)])


def test_batch(spark):
    rows = [(d, [("a", d % 5 + 1.0), ("b", 1.0)]) for d in range(30)]
    i = index_of(spark, rows)
    r = score.top_k_many(i, {1: [("a", 1.0)], 2: [("b", 2.0), ("a", -0.5)]}, 3).orderBy("query_id", "rank").collect()
    assert [(x.doc_id, x.score) for x in r if x.query_id == 1] == brute(rows, [("a", 1.0)], 3)
    assert [(x.doc_id, x.score) for x in r if x.query_id == 2] == brute(rows, [("b", 2.0), ("a", -0.5)], 3)


def test_segments(spark):
    post = spark.createDataFrame([(0, "t", 10, 100), (1, "t", 1, 1)], "segment_id bigint, term string, doc_id bigint, w bigint")
    r = score.top_k_with_stats(post, [("t", 1.0)], 1)
    assert got(r.hits) == [(10, 100.0)] and (r.seen, r.scored, r.pruned) == (2, 1, 1)
    assert score.top_k_with_stats(post, [("t", -1.0)], 1).pruned == 0
    even = spark.createDataFrame([(0, "t", 10, 5), (1, "t", 1, 5)], "segment_id bigint, term string, doc_id bigint, w bigint")
    assert got(score.top_k_with_stats(even, [("t", 1.0)], 1).hits) == [(1, 5.0)]  # an equal bound is not skipped
    masked = spark.createDataFrame([(0, "t", 1, 10), (0, "t", 2, 9), (0, "t", 3, 9), (1, "t", 10, 8), (1, "t", 11, 1)], "segment_id bigint, term string, doc_id bigint, w bigint")
    hide = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    assert got(score.top_k_segments(masked, [("t", 1.0)], 2, hide)) == [(3, 9.0), (10, 8.0)]
    assert got(score.top_k_with_stats(masked, [("t", 1.0)], 2, mask=hide).hits) == [(3, 9.0), (10, 8.0)]
    live = Index(spark.createDataFrame([("t", 20, 7)], "term string, doc_id bigint, w bigint"), spark.createDataFrame([(20, 7)], "doc_id bigint, doc_len bigint"))
    assert got(score.top_k_segments_and_live(masked, live, [("t", 1.0)], 9)) == [(1, 10.0), (2, 9.0), (3, 9.0), (10, 8.0), (20, 7.0), (11, 1.0)]
    seeded = score.top_k_with_stats(masked, [("t", 1.0)], 1, seed=score.top_k(live, [("t", 2.0)], 1))
    assert got(seeded.hits) == [(20, 14.0)] and seeded.scored == 0
