"""What the plans of finished queries did, from Spark's own metrics."""

import re
import time
from contextlib import contextmanager


def _executions(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    return store, store.executionsList()


def _number(text):
    """A metric as the status store words it: '1,234', or a total with its units before the spread."""
    m = re.search(r"([\d,]+(?:\.\d+)?)(?: (B|KiB|MiB|GiB))?", text.split("\n")[-1])
    return float(m[1].replace(",", "")) * {None: 1, "B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30}[m[2]]


def _scala(seq):
    return [seq.apply(i) for i in range(seq.size())]


@contextmanager
def watched(spark):
    """A list that gets, once the block has ended, a (node, description, {metric: value}) for each
    node of each plan that ran in it."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # whole paths
    _, before = _executions(spark)
    known = {e.executionId() for e in _scala(before)}
    out = []
    yield out
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    time.sleep(0.1)
    store, now = _executions(spark)
    for e in _scala(now):
        if e.executionId() in known:
            continue
        values = store.executionMetrics(e.executionId())
        for node in _scala(store.planGraph(e.executionId()).allNodes().toSeq()):
            metrics = {}
            for m in _scala(node.metrics().toSeq()):
                v = values.get(m.accumulatorId())
                if v.isDefined():
                    metrics[m.name()] = _number(v.get())
            out.append((node.name(), node.desc(), metrics))


def scanned(nodes, table):
    """Rows that scans of a table's folders put out."""
    return int(sum(m.get("number of output rows", 0) for name, desc, m in nodes if name.startswith("Scan parquet") and re.search(rf"/{table}[/,\]]", desc)))


def shuffled(nodes):
    """Bytes that exchanges wrote."""
    return int(sum(m.get("shuffle bytes written", 0) for name, _, m in nodes if name == "Exchange"))
