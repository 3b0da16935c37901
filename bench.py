"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The index is built and kept once (``build``); queries then run against it, as
they would against a served index.  ``topk_batch_100`` answers 100 queries in one
pass, which is how throughput is had from a cluster.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from termloom.operators import boolean, lookup, phrase, score
from termloom.operators.build import delete_documents, index_texts
from termloom.plans.planner import plan_candidates

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
MULTI = [("the", 1.5), ("with", 2.0), ("and", 0.25)]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name, f, repeat=3):
        best = None
        for _ in range(repeat):
            t = time.perf_counter()
            f()
            best = min(best or 1e9, time.perf_counter() - t)
        took[name] = round(best, 4)

    state = {}

    def build():
        if "index" in state:
            state["index"].unpersist()
        # bulk also deals the rows of the table, one file of one row group, to all cores.
        i = index_texts(spark.read.parquet(f"{SF}/documents.parquet"), positional=True, bulk=True).persist()
        state["index"], state["n"] = i, (i.entries.count(), i.positions.count(), i.docs.count())

    timed("build", build, 1)
    i = state["index"]
    frequent = [r.term for r in lookup.term_meta(i).orderBy(F.desc("df"), "term").limit(40).collect()]
    done = lambda df: df.collect()
    timed("term_stats", lambda: i.stats.agg(F.sum("df")).collect())
    timed("conjunctive_2", lambda: done(boolean.candidates_all(i, frequent[:2])))
    timed("conjunctive_5", lambda: done(boolean.candidates_all(i, frequent[:5])))
    timed("disjunctive_2", lambda: done(boolean.candidates_any(i, frequent[:2])))
    timed("disjunctive_5", lambda: done(boolean.candidates_any(i, frequent[:5])))
    timed("plan_candidates_2", lambda: plan_candidates(i, frequent[20:22], n=state["n"][2]))
    timed("topk_1", lambda: done(score.top_k(i, MULTI[:1], 10)))
    timed("topk_5", lambda: done(score.top_k(i, [(t, 1 + 0.5 * k) for k, t in enumerate(frequent[:5])], 10)))
    timed("topk_32", lambda: done(score.top_k(i, [(t, 1 + 0.5 * k) for k, t in enumerate(frequent[:32])], 10)))
    timed("topk_filtered", lambda: done(score.top_k(i, MULTI, 10, F.col("doc_id") % 7 != 0)))
    batch = {n: [(frequent[(n + k) % 40], 1 + 0.5 * k) for k in range(5)] for n in range(100)}
    timed("topk_batch_100", lambda: done(score.top_k_many(i, batch, 10)))
    timed("phrase_3", lambda: done(phrase.phrase_match(i, ["in", "onbleea", "of"])))
    timed("near_pair_4", lambda: done(phrase.near_match(i, "of", "with", 4)))
    timed("near_unordered_3", lambda: done(phrase.near_terms(i, ["of", "with", "by"], 16)))
    timed("near_ordered_3", lambda: done(phrase.near_terms(i, ["of", "with", "by"], 16, ordered=True)))
    gone = spark.range(0, 10_000, 97).withColumnRenamed("id", "doc_id")
    timed("delete_then_topk", lambda: done(score.top_k(delete_documents(i, gone), MULTI, 10)))
    print(json.dumps({"metric": "seconds over headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rstrip("/").rpartition("sf")[2], "entries": state["n"][0]}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
