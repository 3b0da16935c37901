"""Hard negatives against a comparison of all pairs."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from termloom.llm import negatives


def brute(rows, every=50, seventh=True, scale=256):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        if seventh and i is not None and i % 7 == 0:
            label = (label + 1) % 10
        kept.append((i, label, [math.floor(scale * float(np.float32(c))) for c in v]))
    out = []
    for at, (a, la, va) in enumerate(kept):
        if a is None or a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v, strict=True)), math.inf if i is None else i, i, lb == la) for k, (i, lb, v) in enumerate(kept) if k != at]
        scored.sort(key=lambda s: s[:2])
        for p in [s for s in scored if s[3]][:5]:
            inside = [s for s in scored if not s[3] and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:3]
            out += [(a, p[2], k, s[2], -p[0], -s[0]) for k, s in enumerate(inside, 1)]
    return sorted(out, key=str)


def made(n, d=16, seed=1, labels=4, spread=1.0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) + spread * rng.standard_normal(d)
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    return [(i, [float(c) for c in v], int(rng.integers(labels))) for i, v in enumerate(x)]


def mined(spark, tmp_path, rows, name="e"):
    at = f"{tmp_path}/{name}"
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.select("*", *[F.lit("x").alias(c) for c in ("row", "id", "v", "block", "anchor", "codes")]).write.parquet(f"{at}/embeddings.parquet")
    return sorted(map(tuple, negatives.op11_negatives(spark, at).collect()), key=str)


def test_all_pairs(spark, tmp_path):
    rows = made(900)
    got = mined(spark, tmp_path, rows)
    assert got == brute(rows) and len(got) > 100


def test_awkward_rows(spark, tmp_path):
    rows = made(300, d=6)
    rows += [(1000, None, 1), (1050, rows[3][1], None), (1100, [None, *rows[3][1][1:]], 2), (1150, [math.nan] * 6, 1), (1200, [math.inf] * 6, 1), (1250, [0.0] * 6, 1)]
    rows += [(None, rows[50][1], 2), (None, rows[50][1], 3), (100, rows[7][1], 2), (50, rows[50][1], rows[50][2]), (None, rows[100][1], rows[100][2])]
    rows += [(2000 + k, rows[50][1], k % 4) for k in range(60)] + [(-50, rows[9][1], 0)]
    got = mined(spark, tmp_path, rows)
    assert got == brute(rows) and got


def test_blocks_of_any_size(spark, tmp_path, monkeypatch):
    rows = made(500, seed=3)
    for block, blocks, pairs in ((40, 1, 256), (10_000, 1, 1 << 20)):
        monkeypatch.setattr(negatives, "BLOCK", block)
        monkeypatch.setattr(negatives, "BLOCKS", blocks)
        monkeypatch.setattr(negatives, "PAIRS", pairs)
        assert mined(spark, tmp_path, rows, f"b{block}") == brute(rows)


def test_one_label_and_few_centres(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(negatives, "TRAIN", 8)  # poor centres: wide bounds, the same rows
    rows = [(i, v, 1 if i % 10 else 2) for i, v, _ in made(400, seed=5)]
    assert mined(spark, tmp_path, rows) == brute(rows)


def test_bounds_hold_and_reject():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.standard_normal((4000, 32)) / 6).astype(np.int64)
    q = negatives.Quantiser(x[:2000])
    codes, residual = q.encode(x)
    lower, upper = negatives.bounds(q, x[:40], codes, residual, float(np.linalg.norm(x, axis=1).max()))
    score = x[:40] @ x.T
    assert (lower <= score).all() and (score <= upper).all()
    wanted = negatives.at_least(lower, np.ones(lower.shape, bool), 5)[:, None]
    assert (upper >= wanted).mean() < 0.1


def test_no_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(empty, F.col("vec_id") == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [], 1)], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(one, F.col("vec_id") == 0).collect() == []
    assert negatives.hard_negatives(one, F.col("vec_id") == 5).collect() == []


def test_numbers_beyond_64_bits_take_no_part(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [3.0, 1.0], 1), (2, [3.0, 1.0], 1), (3, [2.0, 0.5], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = negatives.hard_negatives(df, F.lit(True)).collect()
    assert {r.anchor_id for r in got} == {1, 2} and {r.negative_id for r in got} == {3}
