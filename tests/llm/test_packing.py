"""Packing: the placement rule against brute force, limits that bind, white space and other long runs."""

import random
import zlib
from array import array

import numpy as np
import pytest
from helpers import AWKWARD, corpus, table
from test_map_operators import check_packing, plain  # noqa: F401

from termloom.llm import packing


def brute_placement(pieces, limits, pool):
    """Sequences of (tokens, loss) demands by the rule itself: of the waiting pieces that
    fit, the one with the largest dot product; a piece comes in where one has gone."""
    out, fill, left, waiting, coming = [], [], list(limits), [], list(pieces)
    while coming or waiting:
        while coming and len(waiting) < pool:
            waiting.append(coming.pop(0))
        fits = [p for p in waiting if p[0] <= left[0] and left[1] >= 1 and p[1] <= left[2]]
        if fits:
            p = max(fits, key=lambda p: p[0] * left[0] / limits[0] ** 2 + left[1] / limits[1] ** 2 + p[1] * left[2] / limits[2] ** 2)
            waiting.remove(p)
            fill.append(p)
            left = [left[0] - p[0], left[1] - 1, left[2] - p[1]]
        if not fits or left[0] == 0:
            out.append(fill)
            fill, left = [], list(limits)
    return out + [fill] * bool(fill)


@pytest.mark.parametrize("limits", [(211, 6, 97), (211, 3, 199), (503, 40, 127)])  # primes: no two demands tie
def test_placement_is_the_heuristic(limits):
    rng = random.Random(sum(limits))
    pieces = [(n := rng.randrange(1, 150), rng.randrange(0, min(n, limits[2]) + 1)) for _ in range(400)]
    packer, rows = packing.Packer(limits, 0, cut=False, pool=40), []
    for k, (n, loss) in enumerate(pieces):
        rows += packer.add(k, 0, array("I", range(n)).tobytes(), n, n - loss)
    rows += packer.end()
    mine = {}
    for _, _, n, _, _, loss, seq, _ in rows:
        mine.setdefault(seq, []).append((n, loss))
    assert [mine[s] for s in sorted(mine)] == brute_placement(pieces, limits, 40)


def test_training_limits_bind(spark, plain):  # noqa: F811
    rng = random.Random(4)
    rows = [(d, " ".join(rng.choice(["word", "ünï", "text,", "of 12"]) for _ in range(rng.choice((0, 3, 40, 700, 3000))))) for d in range(300)]
    got = packing.pack(table(spark, rows), **packing.TRAINING).collect()
    assert check_packing(got, rows, plain, segments=8) <= 0.01 * sum(r.length for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
        free = max(1, int(0.25 * r.doc_tokens))
        assert r.n_loss == r.length - min(max(free - r.start, 0), r.length)
    assert max(sum(r.n_loss for r in x) for x in by.values()) == 1792 and max(len(x) for x in by.values()) == 8


def test_uncut_pieces_over_the_loss_limit_are_an_error(spark):
    with pytest.raises(Exception, match="loss-bearing"):
        packing.pack(table(spark, [(1, "many words " * 400)]), max_loss=100, cut=False).collect()


@pytest.mark.parametrize("run", [" ", "\n", "\t \n", "a", "=", "7", "é"])
def test_long_runs(run, plain):  # noqa: F811
    """Two megabytes of one thing, inside a text."""
    text = f"words before{run * (2_000_000 // len(run))}and after it <b> x\n"
    assert np.array_equal(np.array(packing.Tokenizer().ids(text)), np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32))


def test_texts_above_the_part_size(plain):  # noqa: F811
    rng = random.Random(8)
    words = ["plain", "  two", "\n\n", "<|endoftext|>", "ünï", "\t", "12,5", "x" * 300]
    text = " ".join(rng.choice(words) for _ in range(120_000)) + " " * 30_000 + "end"
    assert len(text) > 4 * packing.PART
    ids = packing.Tokenizer().ids(text)
    assert zlib.crc32(ids.tobytes()) == zlib.crc32(np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32).tobytes())


def test_awkward_rows_under_training_limits(spark, plain):  # noqa: F811
    rows = AWKWARD[:8] + AWKWARD[9:10] + [(100 + d, t) for d, t in corpus(20)]
    check_packing(packing.pack(table(spark, rows), **packing.TRAINING).collect(), rows, plain, segments=8)
    assert packing.pack(table(spark, []), **packing.TRAINING).count() == 0
