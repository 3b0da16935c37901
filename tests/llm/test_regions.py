"""Regions of equal bytes, before suffix arrays see them."""

import numpy as np

from termloom.llm import suffix


def test_equal_regions_keep_the_smallest_key():
    data = [b"x" * 60, b"y" * 60, b"x" * 60, b"x" * 60, b"y" * 60]
    r = suffix.Regions([1, 2, 1, 1, 2], [5, 7, 3, 3, 9], [50, 70, 30, 31, 90], [suffix.mark(0, k, 60) for k in range(5)], data)
    left, row, m = suffix.distinct(r)
    assert left.row.tolist() == [70, 30, 31] and row.tolist() == [50, 90] and m.tolist() == [suffix.mark(0, 0, 60), suffix.mark(0, 4, 60)]


def test_arrays_see_strings_with_partners_only(monkeypatch):
    """A passage of two documents reaches the arrays, bytes of one document don't; what goes is as without the cut."""
    rng = np.random.default_rng(2)
    passage, other = (rng.integers(97, 123, k, np.uint8).tobytes() for k in (80, 70))
    noise = [rng.integers(97, 123, 100, np.uint8).tobytes() for _ in range(30)]
    data = [noise[0] + passage + noise[1], passage[10:] + noise[2], other + noise[3] + other, *noise[4:]]
    key = [4, 9, 1, *range(20, 20 + len(noise) - 4)]
    r = suffix.Regions([7, 7, 8, *[7, 8] * 13], key, key, [suffix.mark(0, 1000 * k, len(x)) for k, x in enumerate(data)], data)
    row, m, held = suffix.sort_shard(r)
    seen, whole = [], suffix.sort_shard
    monkeypatch.setattr(suffix, "sort_shard", lambda r, span: seen.append(r.data) or whole(r, span))
    for shard in (suffix.SHARD, 150):
        monkeypatch.setattr(suffix, "SHARD", shard)
        rows, marks, left = suffix.sort_all(r)
        assert np.concatenate(rows).tolist() == row.tolist() == [9] and np.concatenate(marks).tolist() == m.tolist() == [suffix.mark(0, 1000, 70)]
        assert sorted(left.row.tolist()) == sorted(r.row[held].tolist())
    assert sum(map(len, seen[0])) == 140 and b"".join(sum(seen, [])).count(passage[10:]) >= 4
