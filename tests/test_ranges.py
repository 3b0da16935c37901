"""Pruned top-k over sealed ranges of documents: what is read, thresholds, ties, live fusion, plans from metadata."""

import random

import pytest
from plan_metrics import scanned, watched
from pyspark.sql import functions as F

from termloom.operators import score
from termloom.operators.build import Index, index_documents
from termloom.plans import planner
from termloom.sources import store

Q = [("x", 1.0), ("y", 0.5)]


@pytest.fixture(scope="module")
def sealed(spark, tmp_path_factory):
    """20,000 documents in two segments and 41 ranges, ten heavy ones in one range, ties in another."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id").between(4_000, 4_009), 50).when(F.col("id").between(15_000, 15_004), 50).otherwise(F.col("id") % 7 + 1).alias("w"))
    entries = rows.select(F.explode(F.array(F.lit("x"), F.lit("y"), F.lit("z"))).alias("term"), "doc_id", F.col("w").cast("long").alias("w"))
    s = store.SegmentStore(spark, f"file://{tmp_path_factory.mktemp('ranges')}/s", width=512)
    i = Index(entries, rows.select("doc_id", F.lit(2).cast("long").alias("doc_len")))
    s.seal(i, by=F.floor(F.col("doc_id") / 10_000))
    return s, i.persist()


def pairs(df):
    return [(r.doc_id, r.score) for r in df.orderBy(F.desc("score"), "doc_id").collect()]


def test_the_scan_reads_few_entries(spark, sealed):
    s, i = sealed
    with watched(spark) as nodes:
        got = score.top_k_sealed(s, Q, 10)
    with watched(spark) as plain:
        expected = score.top_k_segments(s.entries(), Q, 10).collect()
    assert pairs(got.hits) == [(r.doc_id, r.score) for r in expected] == [(d, 75.0) for d in range(4_000, 4_010)]
    assert scanned(plain, "entries") >= 40_000
    assert 0 < scanned(nodes, "entries") < 0.5 * 40_000
    assert scanned(nodes, "entries") <= 1.5 * 3 * 512  # one range of 41; row groups hold other terms too
    assert got.opened == 1 and got.entries_read == 2 * 512 and got.ranges.count() == 41


def test_rounds_tighten_the_threshold(sealed):
    s, i = sealed
    for k in (3, 12, 15, 40, 4000):
        got = score.top_k_sealed(s, Q, k)
        assert pairs(got.hits) == pairs(score.top_k(i, Q, k))
        found = [r.threshold for r in got.rounds if r.threshold is not None]
        assert found == sorted(found) and (k == 4000 or got.entries_read < 20_000)
        assert all(r.ranges <= 2**n for n, r in enumerate(got.rounds))


def test_ties_are_kept_by_id(sealed):
    s, i = sealed
    got = score.top_k_sealed(s, Q, 12)  # the two ties beyond the first range come from another segment
    assert pairs(got.hits) == [(d, 75.0) for d in [*range(4_000, 4_010), 15_000, 15_001]]
    late = score.top_k_sealed(s, Q, 10, seed=[(30_000 + d, 75.0) for d in range(10)])
    assert pairs(late.hits) == [(d, 75.0) for d in range(4_000, 4_010)]
    early = score.top_k_sealed(s, Q, 10, seed=[(d - 100, 75.0) for d in range(10)])  # nothing can win a tie against these
    assert pairs(early.hits) == [(d - 100, 75.0) for d in range(10)] and early.opened == 0


def test_masks_and_deletes(spark, sealed, tmp_path):
    s, i = sealed
    hidden = F.col("doc_id") % 2 == 0
    assert pairs(score.top_k_sealed(s, Q, 10, ~hidden).hits) == pairs(score.top_k(i, Q, 10, ~hidden))
    table = i.docs.where("doc_id between 4000 and 4004").select("doc_id")
    assert pairs(score.top_k_sealed(s, Q, 10, table).hits) == pairs(score.top_k(i, Q, 10, table))


def test_weights_that_lower_scores_open_everything(spark, sealed):
    s, i = sealed
    q = [("x", 1.0), ("y", -3.0)]
    got = score.top_k_sealed(s, q, 10)
    assert pairs(got.hits) == pairs(score.top_k(i, q, 10)) and got.opened == 41
    assert score.top_k_sealed(s, [("absent", 1.0)], 5).hits.count() == 0 and score.top_k_sealed(s, [], 5).hits.count() == 0 and score.top_k_sealed(s, Q, 0).hits.count() == 0


def test_random_weights(spark, tmp_path):
    rng = random.Random(5)
    rows = [(t, d, rng.choice([1, 1, 2, 3, 9, 40])) for d in range(600) for t in rng.sample("abcdef", 3)]
    i = Index(spark.createDataFrame(rows, "term string, doc_id bigint, w bigint"), spark.range(600).select(F.col("id").alias("doc_id"), F.lit(3).cast("long").alias("doc_len")))
    s = store.SegmentStore(spark, f"file://{tmp_path}/s", width=20)
    s.seal(i, by=F.col("doc_id") % 2)
    for k in (1, 7, 100):
        q = [(t, rng.choice([0.25, 1.0, 2.5])) for t in rng.sample("abcdef", 3)]
        assert pairs(score.top_k_sealed(s, q, k).hits) == pairs(score.top_k(i, q, k))


def test_a_live_index_decides_what_is_opened(spark, sealed):
    s, i = sealed
    live = index_documents(spark.createDataFrame([(50_000 + d, ["x"] * 60) for d in range(10)], "doc_id bigint, terms array<string>"))
    with watched(spark) as nodes:
        got = score.top_k_sealed_and_live(s, live, Q, 10)
    assert pairs(got.hits) == [(d, 75.0) for d in range(4_000, 4_010)] and got.opened == 1
    heavier = index_documents(spark.createDataFrame([(50_000 + d, ["x"] * 80) for d in range(10)], "doc_id bigint, terms array<string>"))
    with watched(spark) as nodes:
        got = score.top_k_sealed_and_live(s, heavier, Q, 10)
    assert pairs(got.hits) == [(50_000 + d, 80.0) for d in range(10)] and got.opened == 0 and scanned(nodes, "entries") == 0


def test_stored_statistics_prove_nonnegativity(spark, sealed):
    s, i = sealed
    with watched(spark) as nodes:
        assert score.nonnegative(s.open(), Q, s.statistics()) and not score.nonnegative(s.open(), [("x", -1.0)], s.statistics())
    assert scanned(nodes, "entries") == 0
    with watched(spark) as nodes:
        got = score.top_k_with_stats(s.entries(), Q, 10, maxima=s.terms(), n_segments=2, stats=s.statistics())
    assert got.pruned == 0 and scanned(nodes, "entries") <= 60_000  # both segments may tie; each is read once


def test_plans_read_metadata_only(spark, sealed):
    s, i = sealed
    with watched(spark) as nodes:
        rows = {r.segment_id: (r.doc_count, r.estimate, r.scan_all) for r in planner.plan_segments(s, ["x", "absent", "x"]).collect()}
        broad = planner.plan_candidates_sealed(s, ["x"])
        none = planner.plan_candidates_sealed(s, ["absent"])
    assert rows == {0: (10_000, 10_000, True), 1: (10_000, 10_000, True)} and broad.scan_all and broad.estimate == 20_000
    assert not none.scan_all and none.segments == ()
    assert scanned(nodes, "entries") == scanned(nodes, "docs") == scanned(nodes, "positions") == 0 and scanned(nodes, "terms") > 0
    assert none.candidates.count() == 0


def test_candidates_open_only_segments_that_hold_a_term(spark, tmp_path):
    s = store.SegmentStore(spark, f"file://{tmp_path}/s")
    for n in range(4):
        s.seal(index_documents(spark.createDataFrame([(10 * n + d, ["a", f"t{n}"] + ["b"] * (d % 2)) for d in range(10)], "doc_id bigint, terms array<string>")), n)
    config = planner.PlannerConfig(max_candidate_ratio=0.9)
    plan = planner.plan_candidates_sealed(s, ["t2", "b"], config, near=True)
    assert plan.segments == (0, 1, 2, 3) and sorted(r.doc_id for r in plan.candidates.collect()) == [21, 23, 25, 27, 29]
    plan = planner.plan_candidates_sealed(s, ["t1", "t3"], config)
    with watched(spark) as nodes:
        assert sorted(r.doc_id for r in plan.candidates.collect()) == [*range(10, 20), *range(30, 40)]
    assert plan.segments == (1, 3) and scanned(nodes, "entries") <= 50
    assert planner.plan_candidates_sealed(s, ["a"]).scan_all and not planner.plan_candidates_sealed(s, ["a"], planner.PlannerConfig(1.0)).scan_all
