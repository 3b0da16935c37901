"""A followed log: what its state is, what a batch writes, batches that run again, deletes that are forgotten."""

import glob
import os
import random

from termloom.streaming import log


def events(spark, rows):
    return spark.createDataFrame(rows, log.EVENTS)


def told(df):
    return sorted((r.doc_id, tuple(r.terms)) for r in df.collect())


def expected(rows):
    last = {}
    for e, op, d, t in rows:
        if d not in last or e > last[d][0]:
            last[d] = e, op, t
    return sorted((d, tuple(t)) for d, (_, op, t) in last.items() if op == log.ADD)


def made(n, seed=1, docs=40):
    """Batches of events, some of them later than their number."""
    rng, out, order = random.Random(seed), [], list(range(n * 6))
    for k in range(0, len(order) - 9, 3):
        if rng.random() < 0.3:
            order[k], order[k + 9] = order[k + 9], order[k]
    for b in range(n):
        out.append([(e, log.DELETE, rng.randrange(docs), None) if rng.random() < 0.3 else (e, log.ADD, rng.randrange(docs), [f"t{e}"]) for e in order[6 * b : 6 * b + 6]])
    return out


def size(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/level=*/**/*.parquet", recursive=True))


def test_state_is_that_of_the_whole_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "FAN", 3)
    s, seen = log.LogState(spark, f"file://{tmp_path}/s"), []
    assert s.head() == [] and s.live().count() == 0
    for n, rows in enumerate(made(11)):
        s.apply(events(spark, rows), n)
        seen += rows
        if n in (0, 2, 5, 8, 10):
            assert told(s.live()) == expected(seen) == told(log.state(events(spark, seen)))
    assert max(r.level for r in s.head()) == 2 and len(s.head()) <= 2 * 3
    assert sorted(r.doc_id for r in s.index().docs.collect()) == [d for d, _ in expected(seen)]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "FAN", 2)
    s, batches = log.LogState(spark, f"file://{tmp_path}/s"), made(4, seed=2)
    for n, rows in enumerate(batches):
        s.apply(events(spark, rows), n)
        before = s.head(), told(s.live())
        s.apply(events(spark, rows), n)
        assert (s.head(), told(s.live())) == before
    assert before[1] == expected(sum(batches, []))


def test_bytes_follow_the_batch(spark, tmp_path):
    s = log.LogState(spark, f"file://{tmp_path}/s")
    s.apply(events(spark, [(d, log.ADD, d, [f"w{d * 7919 % 1009}", f"x{d}"] * 4) for d in range(8000)]).coalesce(1), 0)
    first, wrote, total = size(f"{tmp_path}/s"), [], size(f"{tmp_path}/s")
    for n in range(1, 10):
        s.apply(events(spark, [(8000 + n, log.ADD, n, [f"new{n}"]), (9000 + n, log.DELETE, 100 + n, None)]).coalesce(1), n)
        wrote.append(size(f"{tmp_path}/s") - total)
        total += wrote[-1]
    merges = [b for b in wrote if b > 0.2 * first]
    assert len(merges) == 1  # the eighth folder; the next such one comes after 64
    assert all(b < 0.1 * first for b in wrote if b not in merges)
    live = dict(told(s.live()))
    assert len(live) == 8000 - 9 and live[3] == ("new3",) and 103 not in live
    gone = s.clean(1)
    assert len(gone) == 8 and len(dict(told(s.live()))) == 8000 - 9


def test_deletes_are_forgotten_after_a_while(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "FAN", 2)
    s, old = log.LogState(spark, f"file://{tmp_path}/s", keep=50), log.LogState(spark, f"file://{tmp_path}/old")
    batches = [[(1, log.ADD, 1, ["a"]), (2, log.DELETE, 1, None), (3, log.DELETE, 2, None)], [(100, log.ADD, 3, ["c"])], [(101, log.DELETE, 3, None)], [(102, log.ADD, 4, ["d"])]]
    for n, rows in enumerate(batches):
        s.apply(events(spark, rows), n)
        old.apply(events(spark, rows), n)
    assert told(s.live()) == told(old.live()) == [(4, ("d",))]
    assert sorted(r.doc_id for r in s.events().collect()) == [3, 4] and sorted(r.doc_id for r in old.events().collect()) == [1, 2, 3, 4]
