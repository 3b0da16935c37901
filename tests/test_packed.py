"""Segments that share files: the same rows as in folders of their own, few files, faults found, many ranges at once."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from termloom import schema
from termloom.operators import phrase, score
from termloom.operators.build import Index, index_texts
from termloom.plans import planner
from termloom.sources import store

TABLES = ("docs", "entries", "positions", "blocks", "ranges", "terms", "manifest")


def by():
    return F.floor(F.col("doc_id") / 10)


def texts(spark, n=300):
    rng = random.Random(3)
    rows = [(d, None if d == 7 else "" if d % 50 == 1 else " ".join(rng.choice(["a", "b", "c", f"t{d % 9}", "É"]) for _ in range(rng.randint(1, 30)))) for d in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def rows_of(s, name):
    df = s.manifest().drop("path") if name == "manifest" else getattr(s, name)()
    return sorted(map(str, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))


def parts(path):
    return sorted(glob.glob(f"{path}/**/part-*.parquet", recursive=True))


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """The same texts in shared files, and in folders."""
    at = tmp_path_factory.mktemp("packed")
    shared, own = store.SegmentStore(spark, f"file://{at}/shared", 4), store.SegmentStore(spark, f"file://{at}/own", 4)
    shared.seal_texts(texts(spark), positional=True, by=by())
    held, store.FOLDERS = store.FOLDERS, 10**6
    try:
        own.seal(index_texts(texts(spark), positional=True), by=by())
    finally:
        store.FOLDERS = held
    return shared, own


def test_shared_files_hold_the_same_rows(both):
    shared, own = both
    for name in TABLES:
        assert rows_of(shared, name) == rows_of(own, name), name
    files = parts(shared.path.removeprefix("file://"))
    assert len(files) < 60 and len(parts(own.path.removeprefix("file://"))) > 300 and not any("segment_id=" in f for f in files)
    shared.verify()
    assert rows_of(shared, "docs").count("{'doc_id': 7, 'doc_len': 0, 'doc_range': 1, 'segment_id': 0}") == 1


def test_an_index_is_packed_too(spark, tmp_path, both):
    s = store.SegmentStore(spark, f"file://{tmp_path}/s", 4)
    s.seal(index_texts(texts(spark), positional=True), by=by())
    assert all(b.startswith("p") for b in s._batches()) and all(rows_of(s, name) == rows_of(both[1], name) for name in TABLES)
    plain = store.SegmentStore(spark, f"file://{tmp_path}/plain", 4)
    plain.seal_texts(texts(spark), by=by())
    assert all(rows_of(plain, name) == rows_of(both[1], name) for name in TABLES if name != "positions")


def test_queries(spark, both):
    shared, own = both
    q = [("a", 1.5), ("É".lower(), 2.0), ("t3", 0.25)]
    for k in (1, 10, 300):
        assert score.top_k_sealed(shared, q, k).hits.collect() == score.top_k(own.open(), q, k).collect()
    assert {r.doc_id for r in phrase.phrase_match(shared.open(), ["a", "b"], stats=shared.statistics()).collect()} == {r.doc_id for r in phrase.phrase_match(own.open(), ["a", "b"]).collect()}
    assert sorted(map(str, planner.plan_segments(shared, ["a", "t3"]).collect())) == sorted(map(str, planner.plan_segments(own, ["a", "t3"]).collect()))
    shared.delete(spark.createDataFrame([(3,)], "doc_id bigint"))
    assert shared.open().docs.count() == 299


def test_both_kinds_in_one_store(spark, tmp_path):
    s = store.SegmentStore(spark, f"file://{tmp_path}/s", 4)
    s.seal_texts(texts(spark), by=by())
    s.seal_texts(spark.createDataFrame([(10_000, "a b")], "doc_id bigint, text string"), segment_id=5000)
    assert sorted(b[0] for b in s._batches()) == ["b", "p"] and s.docs().count() == 301 and s.open(5000).entries.count() == 2
    s.verify()
    with pytest.raises(schema.DuplicateSegment):
        s.seal_texts(texts(spark), by=by())
    twice = store.SegmentStore(spark, f"file://{tmp_path}/twice", 4)
    with pytest.raises(schema.DuplicateDocId):
        twice.seal_texts(texts(spark).union(texts(spark, 5)), by=by())
    assert twice.manifest().count() == 0


@pytest.mark.parametrize("table", ["entries", "docs", "blocks", "terms", "ranges"])
def test_verification_names_the_block(spark, tmp_path, table):
    s = store.SegmentStore(spark, f"file://{tmp_path}/s", 4)
    s.seal_texts(texts(spark), by=by())
    assert s.faults().count() == 0
    path = max(parts(f"{tmp_path}/s/{table}"), key=os.path.getsize)
    kind = spark.read.parquet(path).schema
    bad = [r.asDict() for r in spark.read.parquet(path).collect()]
    column = {"docs": "doc_len", "entries": "w", "blocks": "n", "terms": "df", "ranges": "df"}[table]
    bad[0][column] += 1
    spark.createDataFrame(bad, kind).coalesce(1).write.parquet(f"{tmp_path}/bad")
    os.replace(parts(f"{tmp_path}/bad")[0], path)
    os.remove(f"{os.path.dirname(path)}/.{os.path.basename(path)}.crc")
    found = s.faults().collect()
    assert [(r.tab, r.segment_id) for r in found] == [(table, bad[0]["segment_id"])] and found[0].stored_n == found[0].n
    with pytest.raises(schema.IndexDataError):
        s.verify()


def test_many_ranges_of_many_segments_are_one_look_up(spark):
    wanted = [(s, 3 * s + p) for s in range(2000) for p in (0, 1)]
    every = spark.range(2000).select(F.col("id").alias("segment_id"), F.explode(F.sequence(3 * F.col("id"), 3 * F.col("id") + 2)).alias("doc_range"))
    assert sorted(map(tuple, every.where(score.in_ranges(wanted)).collect())) == wanted


def test_positions_are_checked_by_document(spark):
    docs = spark.createDataFrame([(1, 3), (2, 1)], "doc_id bigint, doc_len bigint")
    at = lambda *rows: spark.createDataFrame(rows, schema.POSITIONS)
    store.validate_positions(at(("a", 1, [0, 2]), ("b", 1, [1]), ("c", 2, [])), docs)
    for rows, error in ((at(("a", 1, [2, 0])), schema.PositionOutOfRange), (at(("a", 1, [0, 3])), schema.PositionOutOfRange), (at(("a", 1, [-1])), schema.PositionOutOfRange), (at(("a", 3, [0]), ("", 1, [1])), schema.EmptyTerm)):
        with pytest.raises(error):
            store.validate_positions(rows, docs)


def test_seal_checks_an_index(spark, tmp_path):
    s = store.SegmentStore(spark, f"file://{tmp_path}/s", 4)
    i = index_texts(texts(spark))
    with pytest.raises(schema.NonIncreasingDocId):
        s.seal(Index(i.entries.union(i.entries.where("doc_id = 9").limit(1)), i.docs), by=by())
    with pytest.raises(schema.UnknownDocId):
        s.seal(Index(i.entries, i.docs.where("doc_id <> 9")), by=by())
