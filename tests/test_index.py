"""Building, changing and reading indexes, against direct scans of the documents."""

import random

import pytest
from pyspark.sql import functions as F

from termloom.operators import boolean, lookup
from termloom.operators.build import add_documents, block_table, delete_documents, empty_index, index_documents, index_weighted, term_stats, upsert_documents
from termloom.plans.planner import PlannerConfig, plan_candidates, plan_candidates_near, too_broad
from termloom.schema import DuplicateDocId

DOCS = [(9, ["red", "fox", "red"]), (1, ["blue", "東京", "é"]), (6, []), (3, ["red", "🦊"]), (4, ["fox", "blue", "fox", "fox"])]


def docs_of(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id bigint, terms array<string>")


def ids(df):
    return sorted(r.doc_id for r in df.collect())


@pytest.fixture(scope="module")
def index(spark):
    return index_documents(docs_of(spark), positional=True).persist()


def test_entries_and_lengths(index):
    assert {(r.term, r.doc_id): r.w for r in index.entries.collect()} == {(t, d): ts.count(t) for d, ts in DOCS for t in ts}
    assert {r.doc_id: r.doc_len for r in index.docs.collect()} == {d: len(ts) for d, ts in DOCS}


def test_statistics(index):
    assert lookup.num_docs(index) == 5 and lookup.avg_doc_len(index) == 2.4000000953674316 and lookup.doc_id_range(index) == (1, 9)
    assert lookup.document_len(index, 6) == 0 and lookup.document_len(index, 77) == 0 and lookup.document_len(index, 77, None) is None
    assert lookup.document_frequency(index, "fox") == 2 and lookup.total_weight(index, "fox") == 4 and lookup.max_weight(index, "fox") == 3 and lookup.max_weight(index, "no") == 0
    assert lookup.term_frequency(index, 4, "fox") == 3 and lookup.term_frequency(index, 4, "red") == 0
    assert ids(lookup.document_ids(index)) == [1, 3, 4, 6, 9] and lookup.terms(index).count() == 6
    assert [(r.doc_id, r.doc_len) for r in lookup.document_lengths(index).collect()] == [(1, 3), (3, 2), (4, 4), (6, 0), (9, 3)]
    assert lookup.positions(index, "fox", 4) == [0, 2, 3] and lookup.positions(index, "fox", 1) == []
    assert ids(lookup.docs_with_term(index, "red")) == [3, 9]
    assert {(r.doc_id, r.w, r.doc_len) for r in lookup.entries_with_lengths(index, "red").collect()} == {(9, 2, 3), (3, 1, 2)}
    lookup.require_known_documents(index)


def test_empty_index(spark):
    i = empty_index(spark)
    assert lookup.num_docs(i) == 0 and lookup.avg_doc_len(i) == 0.0 and lookup.doc_id_range(i) is None
    assert ids(boolean.candidates_any(i, ["a"])) == [] and not plan_candidates(i, ["a"]).scan_all


@pytest.mark.parametrize("query", [[], ["red"], ["red", "fox"], ["red", "red", "blue"], ["none"], ["red", "none"], ["東京", "🦊", "é"]])
def test_boolean(index, query):
    assert ids(boolean.candidates_any(index, query)) == sorted(d for d, ts in DOCS if set(query) & set(ts))
    assert ids(boolean.candidates_all(index, query)) == sorted(d for d, ts in DOCS if query and set(query) <= set(ts))
    assert ids(boolean.candidates_all_multiplicity(index, query)) == sorted(d for d, ts in DOCS if query and all(ts.count(t) >= query.count(t) for t in query))


def test_many_terms_and_large_ids(spark):
    big = [(17, ["a", "b"]), (4_000_001, ["b", "c"]), (2**32 - 2, ["a", "z"])]
    i = index_documents(docs_of(spark, big))
    query = ["a", "c", *[f"x{k}" for k in range(35)]]
    assert ids(boolean.candidates_any(i, query)) == [17, 4_000_001, 2**32 - 2]
    assert ids(boolean.candidates_all(i, query)) == []


def test_duplicate_delete_upsert(spark, index):
    with pytest.raises(DuplicateDocId):
        index_documents(docs_of(spark, [(1, ["a"]), (1, ["b"])]), checked=True)
    with pytest.raises(DuplicateDocId):
        add_documents(index, index_documents(docs_of(spark, [(4, ["new"])]), positional=True))
    less = delete_documents(index, spark.createDataFrame([(4,), (4,), (99,)], "doc_id bigint"))
    assert lookup.num_docs(less) == 4 and lookup.document_frequency(less, "fox") == 1
    again = add_documents(less, index_documents(docs_of(spark, [(4, ["new"])]), positional=True))
    assert ids(boolean.candidates_any(again, ["fox"])) == [9] and ids(boolean.candidates_any(again, ["new"])) == [4]
    up = upsert_documents(index, index_documents(docs_of(spark, [(9, ["fox"]), (50, [])]), positional=True))
    assert ids(boolean.candidates_any(up, ["red"])) == [3] and lookup.num_docs(up) == 6 and lookup.positions(up, "fox", 9) == [0]


def test_weighted(spark):
    rows = [(1, [("a", 1.0), ("a", 0.5), ("b", 0.0)]), (2, [("a", -2.0)]), (3, [])]
    i = index_weighted(spark.createDataFrame(rows, "doc_id bigint, terms array<struct<term:string,weight:float>>"))
    assert {(r.term, r.doc_id): r.w for r in i.entries.collect()} == {("a", 1): 1.5, ("b", 1): 0.0, ("a", 2): -2.0}
    assert {r.doc_id: r.doc_len for r in i.docs.collect()} == {1: 3, 2: 1, 3: 0}
    whole = index_weighted(spark.createDataFrame([(1, [(7, 2), (7, 3)])], "doc_id bigint, terms array<struct<term:bigint,weight:bigint>>"))
    assert whole.docs.first().doc_len == 5 and whole.entries.first().w == 5
    nan = index_weighted(spark.createDataFrame([(1, [("a", float("inf"))])], "doc_id bigint, terms array<struct<term:string,weight:float>>"))
    assert nan.stats.first().all_finite is False


def test_blocks(spark):
    i = index_documents(docs_of(spark, [(d, ["t"]) for d in range(130)]))
    got = [(r.block_no, r.base_doc_id, r.last_doc_id, r.n, r.max_weight) for r in block_table(i.entries).orderBy("block_no").collect()]
    assert got == [(0, 0, 127, 128, 1), (1, 127, 129, 2, 1)]
    assert ids(lookup.block_entries(i, "t", 1)) == [128, 129] and ids(lookup.block_entries(i, "no", 5)) == []
    assert lookup.block_entries(i, "t", 1, lengths=True).count() == 2
    with pytest.raises(IndexError):
        lookup.block_entries(i, "t", 2)


def test_planner(spark):
    i = index_documents(docs_of(spark, [(d, ["common", f"u{d}"]) for d in range(100)]))
    assert plan_candidates(i, ["common"], PlannerConfig(0.2, 10)).scan_all
    assert ids(plan_candidates(i, ["u3", "u3", "u4"]).candidates) == [3, 4]
    assert ids(plan_candidates_near(i, ["common", "u4"], PlannerConfig(2.0)).candidates) == [4]
    assert plan_candidates(i, ["absent"], PlannerConfig(max_candidates=0)).scan_all
    assert ids(plan_candidates(i, [], PlannerConfig(max_candidates=0)).candidates) == []
    assert plan_candidates(i, ["common"], stats=i.stats, n=100).scan_all
    # At the count limit it scans, at the ratio it does not; the ratio is compared in 32 bits.
    assert too_broad(10, 100, PlannerConfig(1.0, 10)) and not too_broad(60, 100, PlannerConfig()) and not too_broad(7, 10, PlannerConfig(0.7)) and too_broad(61, 100, PlannerConfig())


def test_random_documents_have_no_false_negatives(spark):
    rng = random.Random(5)
    rows = [(d, [rng.choice("abcdefgh") for _ in range(rng.randrange(12))]) for d in range(29)]
    i = index_documents(docs_of(spark, rows)).persist()
    for _ in range(6):
        q = [rng.choice("abcdefghz") for _ in range(rng.randrange(1, 5))]
        assert ids(boolean.candidates_any(i, q)) == sorted(d for d, ts in rows if set(q) & set(ts))
        assert ids(boolean.candidates_all(i, q)) == sorted(d for d, ts in rows if set(q) <= set(ts))
    assert term_stats(i.entries).where(F.col("df") > 29).count() == 0
