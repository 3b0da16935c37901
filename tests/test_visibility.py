"""Deletes on sealed stores, lost and damaged files, order of lists, anchors: no more is shuffled or read than said."""

import glob
import os
import shutil
import threading

import pytest
from plan_metrics import scanned, shuffled, watched
from pyspark.sql import functions as F

from termloom import schema
from termloom.functions import bitmaps
from termloom.operators import lookup, phrase, score
from termloom.operators.build import Index, index_documents
from termloom.sources import store


def index_of(spark, rows, positional=True):
    return index_documents(spark.createDataFrame(rows, "doc_id bigint, terms array<string>"), positional)


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


# Bitmaps


def test_bitmaps(spark):
    some = [0, 1, 63, 64, 32767, 32768, 100_000, 2**32 - 1, 2**40, -1, -32768, -32769]
    df = spark.createDataFrame([(i,) for i in [*some, 5, None, 1]], "doc_id bigint")
    bitmap = bitmaps.bitmap_of(df.where("doc_id <> 5 or doc_id is null"))
    assert ids(bitmaps.ids_of(bitmap)) == sorted(some)
    wanted = spark.createDataFrame([(i,) for i in [*some, 2, 65, 32769, -2, None, 2**40 + 1]], "doc_id bigint")
    assert ids(bitmaps.select(wanted, bitmap)) == sorted(some)
    rest = bitmaps.select(wanted, bitmap, inside=False)
    assert {r.doc_id for r in rest.collect()} == {2, 65, 32769, -2, None, 2**40 + 1}
    both = bitmaps.union(bitmap.unionByName(bitmaps.bitmap_of(spark.createDataFrame([(2,), (1,), (70_000,)], "doc_id bigint"))))
    assert ids(bitmaps.ids_of(both)) == sorted({*some, 2, 70_000}) and both.count() == both.select("span").distinct().count()
    assert bitmaps.bitmap_of(df.limit(0)).count() == 0 and ids(bitmaps.select(df, bitmaps.bitmap_of(df.limit(0)))) == []


def test_large_bitmaps_are_joined_by_range(spark, monkeypatch):
    df = spark.range(0, 300_000, 3).withColumnRenamed("id", "doc_id")
    bitmap = bitmaps.bitmap_of(spark.range(0, 300_000, 2).withColumnRenamed("id", "doc_id"))
    monkeypatch.setattr(bitmaps, "ROWS", 2)
    assert bitmaps.select(df, bitmap).count() == 50_000 and bitmaps.select(df, bitmap, inside=False).count() == 50_000


# Deletes


def test_delete_hides_documents_without_a_shuffle(spark, tmp_path):
    s = store.SegmentStore(spark, f"file://{tmp_path}/s", width=50)
    s.seal(index_of(spark, [(d, ["a", "b"] if d % 2 else ["a", "a"]) for d in range(200)]), by=F.floor(F.col("doc_id") / 100))
    before, files_before = s.open(), sorted(glob.glob(f"{tmp_path}/s/entries/**/*.parquet", recursive=True))
    plain = exchanges(score.scores(before.entries, [("a", 1.0)]))
    s.delete(spark.createDataFrame([(3,), (5,), (5,), (10_000,)], "doc_id bigint"))
    s.delete(spark.createDataFrame([(150,), (3,)], "doc_id bigint"))
    after = s.open()
    assert sorted(glob.glob(f"{tmp_path}/s/entries/**/*.parquet", recursive=True)) == files_before
    assert ids(after.docs) == [d for d in range(200) if d not in (3, 5, 150)]
    assert lookup.document_frequency(after, "a") == 197 and lookup.document_frequency(after, "b") == 98
    assert ids(phrase.phrase_match(after, ["a", "b"])) == [d for d in range(1, 200, 2) if d not in (3, 5)]
    got = score.top_k_sealed(s, [("a", 1.0)], 500)
    assert ids(got.hits) == ids(after.docs)
    one = s.visible(s.entries(), bitmaps.bitmap_of(spark.createDataFrame([(1,)], "doc_id bigint")).persist())
    masked = score.scores(one, [("a", 1.0)])
    with watched(spark) as nodes:
        masked.collect()
    hashed = [d for n, d, _ in nodes if n == "Exchange" and "doc_id" in d]
    assert len(hashed) == plain == 1  # the aggregate's own


# Anchors


def test_lists_of_frequent_terms_are_filtered_before_the_shuffle(spark, tmp_path):
    rows = [(d, ["in", "the"] * 20 + (["rare", "in", "the"] if d % 400 == 0 else ["of"])) for d in range(4000)]
    s = store.SegmentStore(spark, f"file://{tmp_path}/s")
    s.seal(index_of(spark, rows), 0)
    i, stats = s.open(), s.statistics()

    def cost(*args, f=phrase.phrase_match, **kw):
        with watched(spark) as nodes:
            got = ids(f(i, *args, **kw))
        return got, shuffled(nodes)

    plain, much = cost(["rare", "in", "the"])
    got, little = cost(["rare", "in", "the"], stats=stats)
    _, alone = cost(["rare", "rare"])
    assert got == plain == list(range(0, 4000, 400))
    assert little < 0.1 * much and little < alone + 20_000, (little, alone, much)
    near, little = cost(["rare", "of", "the"], 4, f=phrase.near_terms, stats=stats)
    assert near == cost(["rare", "of", "the"], 4, f=phrase.near_terms)[0] == []
    assert cost("rare", "the", 2, f=phrase.near_match, stats=stats)[0] == list(range(0, 4000, 400))
    assert cost(["rare", "unknown"], stats=stats)[0] == [] and cost(["in", "in"], stats=stats)[0] == []
    keyed = phrase.over_segments(phrase.phrase_match, i, ["rare", "in"], stats=stats)
    assert ids(keyed) == list(range(0, 4000, 400))


# Files


def parts(path):
    return sorted(glob.glob(f"{path}/**/part-*.parquet", recursive=True))


def flip(path):
    """One byte in the middle; the local file system's own checksum goes, as other stores have none."""
    side = f"{os.path.dirname(path)}/.{os.path.basename(path)}.crc"
    if os.path.exists(side):
        os.remove(side)
    with open(path, "r+b") as f:
        f.seek(os.path.getsize(path) // 3)
        byte = f.read(1)
        f.seek(-1, 1)
        f.write(bytes([byte[0] ^ 0x55]))


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("saved")
    store.save(index_of(spark, [(d, [f"t{d % 50}", "a"]) for d in range(600)]), f"file://{path}")
    assert store.load(spark, f"file://{path}").entries.count() == 1200
    return path


@pytest.mark.parametrize("table", ["entries", "docs", "positions"])
def test_load_notices_lost_and_damaged_files(spark, tmp_path, saved, table):
    for harm in ("remove", "flip", "add"):
        path = f"{tmp_path}/{harm}"
        shutil.copytree(saved, path)
        own = parts(f"{path}/v*/{table}")
        if harm == "remove":
            os.remove(own[0])
        elif harm == "flip":
            flip(max(own, key=os.path.getsize))
        else:
            with open(own[0], "rb") as a, open(own[0].replace("part-", "part-9"), "wb") as b:
                b.write(a.read())
        with pytest.raises(schema.LostFile):
            store.load(spark, f"file://{path}")
        if harm != "flip":
            with pytest.raises(schema.LostFile):
                store.load(spark, f"file://{path}", verify=False)


def test_open_notices_lost_files(spark, tmp_path):
    s = store.SegmentStore(spark, f"file://{tmp_path}/s")
    s.seal(index_of(spark, [(d, ["a", "b"]) for d in range(100)]), 0)
    s.open()
    os.remove(parts(f"{tmp_path}/s/positions")[0])
    with pytest.raises(schema.LostFile):
        s.open()


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("whole")
    s = store.SegmentStore(spark, f"file://{path}", width=8192)
    s.seal(index_of(spark, [(d, ["a", f"t{d % 40}"]) for d in range(0, 30_000, 10)]), by=F.floor(F.col("doc_id") / 16384))
    assert s.faults().count() == 0
    s.verify()
    return path


@pytest.mark.parametrize("table", ["entries", "docs", "positions", "blocks", "terms", "ranges"])
def test_verification_names_the_block(spark, tmp_path, whole, table):
    """One row of one file is changed, as a writer with a fault would."""
    shutil.copytree(whole, f"{tmp_path}/s")
    s = store.SegmentStore(spark, f"file://{tmp_path}/s", width=8192)
    path = parts(f"{tmp_path}/s/{table}/batch=*/segment_id=1")[0]
    rows = spark.read.parquet(path).collect()
    schema_ = spark.read.parquet(path).schema
    column = {"docs": "doc_len", "entries": "w", "positions": "ps", "blocks": "n", "terms": "df", "ranges": "df"}[table]
    bad = [r.asDict() for r in rows]
    bad[0][column] = [7] if column == "ps" else bad[0][column] + 1
    spark.createDataFrame(bad, schema_).coalesce(1).write.parquet(f"{tmp_path}/bad")
    os.replace(parts(f"{tmp_path}/bad")[0], path)
    side = f"{os.path.dirname(path)}/.{os.path.basename(path)}.crc"
    if os.path.exists(side):
        os.remove(side)
    found = s.faults().collect()
    assert [(r.tab, r.segment_id) for r in found] == [(table, 1)]
    if "doc_id" in bad[0]:
        assert (found[0].part, found[0].block) == (bad[0]["doc_id"] // 8192, bad[0]["doc_id"] // 4096)
    with pytest.raises(schema.IndexDataError):
        s.verify()


def test_only_suspect_ranges_are_read_again(spark, tmp_path):
    s = store.SegmentStore(spark, f"file://{tmp_path}/s", width=100)
    s.seal(index_of(spark, [(d, ["a"]) for d in range(1000)]), 0)
    with watched(spark) as nodes:
        assert s.faults().collect() == []
    assert scanned(nodes, "entries") == 1000


# Publishing


def test_of_two_seals_at_once_one_publishes(spark, tmp_path):
    s, i, out = store.SegmentStore(spark, f"file://{tmp_path}/s"), index_of(spark, [(1, ["a"])]), []

    def seal():
        try:
            s.seal(i, 0)
            out.append("sealed")
        except schema.DuplicateSegment:
            out.append("refused")

    both = [threading.Thread(target=seal) for _ in range(2)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert sorted(out) == ["refused", "sealed"] and s.manifest().count() == 1 and s.entries().count() == 1


def test_lists_out_of_order_are_refused_by_the_writer(spark, tmp_path):
    docs = spark.range(1, 4).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("doc_len"))
    kind = "term string, entries array<struct<doc_id:bigint,w:bigint>>, at bigint"
    good = [(f"t{k:04d}", [(1, 1), (3, 2)], k) for k in range(300)]
    s = store.SegmentStore(spark, f"file://{tmp_path}/s")
    swapped = [(t, e, {40: 41, 41: 40}.get(k, k)) for t, e, k in good]
    far = [(t, e, {0: 299, 299: 0}.get(k, k)) for t, e, k in good]
    for rows, error in ((swapped, schema.UnsortedTermId), (far, schema.UnsortedTermId), ([*good, ("t0299", [(1, 1)], 300)], schema.DuplicateTermId), ([("t0000", [], 0), *good[1:]], schema.EmptyEntryList), ([("t0000", [(3, 1), (1, 1)], 0)], schema.NonIncreasingDocId), ([("t0000", [(9, 1)], 0)], schema.UnknownDocId)):
        with pytest.raises(error):
            s.seal_lists(docs, spark.createDataFrame(rows, kind), "at", 0)
    assert s.manifest().count() == 0
    s.seal_lists(docs, spark.createDataFrame(good, kind), "at", 0)
    assert s.open().entries.count() == 600 and s.manifest().first().term_count == 300
    assert s.open().entries.where("term = 't0007'").select("doc_id", "w").orderBy("doc_id").collect() == [(1, 1), (3, 2)]
    s.seal_lists(docs.limit(0), spark.createDataFrame([], kind), "at", 1)  # no documents, no segment
    assert s.manifest().count() == 1


def test_an_index_is_made_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    docs = spark.createDataFrame([(d, ["a", "b"]) for d in range(10)], "doc_id bigint, terms array<string>")

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    store.SegmentStore(spark, f"file://{tmp_path}/s").seal(index_documents(docs.mapInArrow(count, docs.schema), True), 0)
    assert seen.value == 20  # lengths, and tokens


def test_lists_of_a_live_index_as_a_segment(spark, tmp_path):
    i = index_of(spark, [(1, ["a", "b"]), (2, ["a"])], False)
    lists = i.entries.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("doc_id", "w"))).alias("entries")).withColumn("at", F.ascii("term").cast("long"))
    s = store.SegmentStore(spark, f"file://{tmp_path}/s")
    s.seal_lists(i.docs, lists, "at", 5)
    assert s.open(5).entries.drop("segment_id").exceptAll(i.entries).count() == 0
    assert Index(s.entries(), s.docs()).entries.count() == 3
