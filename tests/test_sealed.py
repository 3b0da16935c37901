"""Segments that are sealed twice, readers during a save, stored bounds, lists out of order."""

import threading

import pytest
from pyspark.sql import functions as F

from termloom import schema
from termloom.operators import lookup, phrase
from termloom.operators.build import Index, index_documents
from termloom.sources import store
from termloom.streaming import log


def index_of(spark, rows, positional=False):
    return index_documents(spark.createDataFrame(rows, "doc_id bigint, terms array<string>"), positional)


def test_a_published_segment_is_refused(spark, tmp_path):
    s, i = store.SegmentStore(spark, f"file://{tmp_path}/s"), index_of(spark, [(1, ["a", "b"]), (2, ["a"])], True)
    s.seal(i, 0)
    with pytest.raises(schema.DuplicateSegment):
        s.seal(i, 0)
    assert s.entries().count() == 3 and s.manifest().count() == 1
    with pytest.raises(schema.UnknownDocId):  # a run that fails leaves nothing that a reader sees
        s.seal(Index(i.entries, i.docs.where("doc_id = 1")), 1)
    assert s.entries().count() == 3 and s.manifest().count() == 1
    s.seal(index_of(spark, [(3, ["a"])], True), 1)
    assert sorted(r.doc_id for r in phrase.phrase_match(s.open(), ["a"]).collect()) == [1, 2, 3]


def test_a_reader_finds_a_snapshot_at_any_time(spark, tmp_path):
    path = f"file://{tmp_path}/snap"
    store.save(index_of(spark, [(0, ["a"])]), path)
    seen, done = [], threading.Event()

    def read():
        while not done.is_set():
            seen.append(lookup.num_docs(store.load(spark, path)))

    t = threading.Thread(target=read)
    t.start()
    for k in (2, 3):
        store.save(index_of(spark, [(d, ["a"]) for d in range(k)]), path)
    done.set()
    t.join()
    assert set(seen) <= {1, 2, 3} and seen == sorted(seen) and lookup.num_docs(store.load(spark, path)) == 3


def test_order_is_checked_over_ranges(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("doc_len"), F.col("id").alias("at"))
    store.validate_document_lengths(docs, "at")
    with pytest.raises(schema.UnsortedDocId):
        store.validate_document_lengths(docs.withColumn("at", F.when(F.col("doc_id") == 300, -1).otherwise(F.col("at"))), "at")
    lists = spark.createDataFrame([("a", [(1, 1)], 0), ("b", [(1, 1)], 1)], "term string, entries array<struct<doc_id:bigint,w:bigint>>, at int")
    store.validate_term_lists(lists, "at")
    with pytest.raises(schema.DuplicateTermId):
        store.validate_term_lists(lists.union(lists))
    with pytest.raises(schema.UnsortedTermId):
        store.validate_term_lists(lists.withColumn("at", -F.col("at")), "at")


def test_unknown_documents_and_other_indexes_raise(spark):
    i = index_of(spark, [(1, ["a"]), (2, ["a"])], True)
    with pytest.raises(Exception, match="UnknownDocId"):
        lookup.entries_with_lengths(Index(i.entries, i.docs.where("doc_id = 1")), "a").collect()
    cache = phrase.TermCache(i)
    assert cache.phrase_match(["a"], index=i).count() == 2
    with pytest.raises(schema.CacheMismatch):
        cache.phrase_match(["a"], index=index_of(spark, [(9, ["a"])], True))


def test_late_events_do_not_win(spark, tmp_path):
    kind, source = "event_id bigint, op string, doc_id bigint, terms array<string>", f"{tmp_path}/in"
    for n, rows in enumerate(([(5, "add", 1, ["new"]), (6, "delete", 2, None)], [(3, "add", 1, ["old"]), (4, "add", 2, ["old"])])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        log.follow(spark.readStream.schema(kind).parquet(source), f"{tmp_path}/state", f"{tmp_path}/cp").awaitTermination()
        got = log.LogState(spark, f"{tmp_path}/state").live().collect()
        assert [(r.doc_id, r.terms) for r in got] == [(1, ["new"])]
