"""Integer sets as arrays: gaps, prefix sums, varints, checks.

Parquet's own encodings do the storing; these functions keep the semantics for
callers that exchange encoded sets.  All are built-in expressions but prefix sums and
:func:`varint_decode`, which are numpy over Arrow batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MAX_ID


def _shifted(ids: Column) -> Column:
    """Pairs of each element (b) and the one before it (a; null at first)."""
    before = F.slice(F.concat(F.array(F.lit(None).cast("long")), ids), 1, F.size(ids))
    return F.arrays_zip(before.alias("a"), ids.alias("b"))


def first_violation(ids: Column, universe: Column | int | None = None) -> Column:
    """Index of the first element that isn't above the one before it, or not
    below ``universe``; null if there is none."""

    def bad(x: Column) -> Column:
        down = F.coalesce(x["b"] <= x["a"], F.lit(False))
        return down if universe is None else down | (x["b"] >= universe)

    flags = F.transform(_shifted(ids), bad)
    at = F.array_position(flags, True)
    return F.when(at > 0, at - 1)


def gaps_from_sorted_ids(ids: Column) -> Column:
    """First id, then differences; raises unless ids increase strictly."""
    at = first_violation(ids)
    gaps = F.transform(_shifted(ids), lambda x: x["b"] - F.coalesce(x["a"], F.lit(0)))
    return F.when(at.isNotNull(), F.raise_error(F.concat(F.lit("UnsortedIds at index "), at)).cast("array<bigint>")).otherwise(gaps)


def gaps_from_sorted_ids_unchecked(ids: Column) -> Column:
    """Differences, never below zero."""
    return F.transform(_shifted(ids), lambda x: F.greatest(x["b"] - F.coalesce(x["a"], F.lit(0)), F.lit(0)))


def _sums(gaps: Column, limit: int, strict: bool) -> Column:
    """Prefix sums, by numpy: no built-in function gives them in time linear in the array."""

    def one(g):
        if g is None:
            return None
        ids = np.cumsum(np.asarray(g, np.int64))
        if strict and len(ids) and ids.max() > limit:
            raise ValueError("IdOverflow")
        return np.minimum(ids, limit)

    # A local function travels to executors by value, which need no copy of this module.
    return F.pandas_udf(lambda xs: xs.map(one), T.ArrayType(T.LongType()))(gaps)


def ids_from_gaps(gaps: Column) -> Column:
    """Ids from gaps; raises beyond 32 bits."""
    return _sums(gaps, MAX_ID, True)


def ids_from_gaps_unchecked(gaps: Column) -> Column:
    """Ids from gaps, held at the largest 32-bit id."""
    return _sums(gaps, MAX_ID, False)


def varint_hex(x: Column) -> Column:
    """One 32-bit number as the hexadecimal digits of its LEB128 bytes."""
    parts = [F.shiftright(x, 7 * k).bitwiseAND(F.lit(127)) for k in range(5)]
    out = F.lpad(F.hex(parts[4]), 2, "0")
    for k in (3, 2, 1, 0):
        more = F.shiftright(x, 7 * (k + 1)) > 0
        out = F.when(more, F.concat(F.lpad(F.hex(parts[k].bitwiseOR(F.lit(128))), 2, "0"), out)).otherwise(F.lpad(F.hex(parts[k]), 2, "0"))
    return out


def varint_encode(xs: Column) -> Column:
    """An array of 32-bit numbers as LEB128 bytes."""
    return F.unhex(F.array_join(F.transform(xs, varint_hex), ""))


def varint_decode(data: Column | str) -> Column:
    """LEB128 bytes as numbers; a fifth byte above 0x0F or a cut-off end raises."""

    def one(raw):
        if raw is None:
            return None
        x = np.frombuffer(raw, np.uint8).astype(np.int64)
        ends = np.flatnonzero(x < 128)
        if len(x) and (not len(ends) or ends[-1] != len(x) - 1):
            raise ValueError("varint is cut off")
        starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
        place = np.arange(len(x)) - np.repeat(starts, ends - starts + 1)
        if (place > 4).any() or (x[place == 4] > 15).any():
            raise ValueError("varint leaves 32 bits")
        return np.add.reduceat((x & 127) << 7 * place, starts) if len(ends) else ends

    # A local function travels to executors by value, which need no copy of this module.
    return F.pandas_udf(lambda xs: xs.map(one), T.ArrayType(T.LongType()))(data)


def compress_set(ids: Column) -> Column:
    """A strictly increasing set as varints of its gaps."""
    return varint_encode(gaps_from_sorted_ids(ids))


def decompress_set(data: Column) -> Column:
    return ids_from_gaps(varint_decode(data))


def element(ids: Column, i: Column | int) -> Column:
    """The i-th smallest (from 0) of a sorted set, null beyond its end."""
    return F.get(ids, F.lit(i) if isinstance(i, int) else i)


def rank(ids: Column, x: Column | int) -> Column:
    """How many elements of a sorted set lie below x, by halving: 32 steps at most."""
    x = F.lit(x) if isinstance(x, int) else x
    start = F.struct(F.lit(0).alias("low"), F.size(ids).alias("high"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.get(ids, mid) < x
        open_ = s["low"] < s["high"]
        return F.struct(F.when(open_ & below, mid + 1).otherwise(s["low"]).alias("low"), F.when(open_ & ~below, mid).otherwise(s["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, step, lambda s: s["low"].cast("long"))
