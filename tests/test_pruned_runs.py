"""Pruned top-k over thousands of ranges that are no neighbours."""

from pyspark.sql import functions as F

from termloom.operators import score
from termloom.operators.build import Index


def test_thousands_of_runs(spark):
    ids = spark.range(6000).select((F.col("id") * 8).alias("doc_id"))
    for n in (10, 3000):
        assert ids.where(score.within(range(0, 2 * n, 2), 8)).count() == n
    rows = ids.select(F.lit("a").alias("term"), "doc_id", F.when(F.col("doc_id") % 16 == 0, 5).otherwise(1).cast("long").alias("w"))
    i = Index(rows, ids.withColumn("doc_len", F.lit(1)))
    assert score.top_k_pruned(i, [("a", 1.0)], 2500, width=8).collect() == score.top_k(i, [("a", 1.0)], 2500).collect()
    assert score.top_k_pruned(i, [("a", 1.0)], 10, width=8).collect() == [(16 * d, 5.0) for d in range(10)]
