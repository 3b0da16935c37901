"""What a run of the pipeline leaves on disk while it goes on: no shuffles, no tables that nothing reads."""

import os
import random
import time

from pyspark.sql import functions as F

import corpus_pipeline
from termloom.llm import common, simhash


def folders(spark):
    top = f"{common.shared_dir(spark).removeprefix('file://')}/termloom"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = manager.getAllFiles()
    return {f for f in (str(found.apply(i)) for i in range(found.size())) if "shuffle_" in f and f.endswith(".data")}


def texts(spark, n=60):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for d in range(n):
        own = [rng.choice(words) for _ in range(60)]
        rows += [(2 * d, " ".join(own)), (2 * d + 1, " ".join([*own[:-1], "other"]))]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_shuffles_end_with_the_table_they_led_to(spark):
    before = shuffle_files(spark)
    out = common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert out.count() == 7
    for _ in range(50):  # they go in the background
        left = shuffle_files(spark) - before
        if len(left) <= 1:
            break
        time.sleep(0.1)
    assert len(left) <= 1  # that of the count
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_lists_go_when_links_are_found(spark):
    before = folders(spark)
    rows = texts(spark).select(simhash.row_number(F.col("doc_id"), F.col("text")).alias("row_id"), "doc_id", "text")
    got = simhash.similar_rows(rows, 5, 0.8)
    assert got.groupBy("root").count().where("count = 2").count() == 60
    top = f"{common.shared_dir(spark).removeprefix('file://')}/termloom"
    kept = [spark.read.parquet(f"{top}/{f}").columns for f in folders(spark) - before]
    assert kept and not any("odd" in c and "h" in c or "head" in c for c in kept)


def test_a_stage_leaves_its_result_only(spark, tmp_path, monkeypatch):
    texts(spark).withColumn("source", F.lit("a")).write.parquet(f"{tmp_path}/documents.parquet")
    stages = [("one", lambda s, d, _: common.stored(common.stored(d).where("doc_id > 3"))), ("two", lambda s, d, _: common.stored(d.where("doc_id > 5"))), ("three", lambda s, d, _: d.where("doc_id > 7"))]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    before = folders(spark)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert len(folders(spark) - before) == 1 and got.count() == 112
