"""Exact substring dedup with suffix arrays.

A byte goes if a string of ``span`` bytes that covers it also starts in a
document with a smaller id.  Equal strings are brought together before they are
sorted:

0. A document that equals one with a smaller id loses all of its bytes (if a string
   fits it at all) and is settled by its digest.
1. Every string of ``span`` bytes has a least 16-byte hash; runs of neighbouring
   strings with the same least hash form a region.  Equal strings have equal
   hashes, so a hash that only one row has needs no further look.  Hashes
   are met in sorted partitions, one row after the other.
2. Regions of shared hashes are cut from their texts.  Of equal regions in a batch
   the one with the smallest id is sent, so of a passage with thousands of copies
   each batch sends one.
3. Regions with the same hash meet in a shard.  Of equal ones again only the smallest id's
   goes on; all others lose their bytes.  Of what is left, regions are cut to the strings whose
   hash another document's region in the shard has, and the rest, in which nothing can go, stays
   behind.  The others of a shard are joined into one text whose suffix array is built by induced sorting, and neighbours that share a
   prefix of ``span`` bytes give the strings that stand in several documents.  Of a
   group too large for one shard the regions that hold a first string wait for the
   next; a hash that a sample finds in very many texts is split by the next least
   hash of its strings.

Texts are shuffled once, compressed and by row; the steps that need them read the
same shuffle again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hot_join, map_rows, pa_schema, stored, utf8
from .sais import byte_words, common_prefixes, suffix_array

SPAN, SEED_BYTES = 50, 16
MUL_A, MUL_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Strings of a region at most (its length is kept in 13 bits); bytes after which a shard is sorted.
LONGEST, SHARD = 4095, 1 << 22
#: Bytes of text for which there is one bucket of hashes; buckets at least; packed bytes of a bucket that are sorted at once.
BUCKET, BUCKETS, LARGEST = 1 << 22, 64, 1 << 24
#: The id as which null counts.
LAST = (1 << 63) - 1
#: One text in so many is looked at for common hashes; texts of that sample that make one common; common ones at most.
RATE, OFTEN, COMMON = 64, 64, 1000


def seed_hashes(text: bytes) -> np.ndarray:
    """A hash of each 16-byte string."""
    raw = np.frombuffer(text, np.uint8)
    at = np.ascontiguousarray(np.lib.stride_tricks.as_strided(raw, (len(text) - 7, 8), (1, 1))).view(np.uint64).ravel()
    x = (at[:-8] ^ (at[8:] * MUL_B)) * MUL_A
    x ^= x >> np.uint64(32)
    x *= MUL_B
    x ^= x >> np.uint64(29)
    return x


def window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def least_hashes(text: bytes, span: int = SPAN) -> np.ndarray:
    """For each string of ``span`` bytes, the least hash of its 16-byte strings."""
    return window_least(seed_hashes(text), span - SEED_BYTES + 1) if len(text) >= span else np.zeros(0, np.uint64)


def regions(text: bytes, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first string, number of strings) of each region."""
    m = least_hashes(text, span)
    if not len(m):
        return m, np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
    counts = np.diff(np.append(starts, len(m)))
    if counts.max() > LONGEST:
        parts = -(-counts // LONGEST)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + inner * LONGEST
        counts = np.minimum(np.repeat(counts, parts) - inner * LONGEST, LONGEST)
    return m[starts], starts, counts


def hashes_of(text: bytes, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Regions with their hashes cut to 48 bits: what collides is told apart by its bytes."""
    h, first, n = regions(text, span)
    return (h >> np.uint64(16)).view(np.int64), first, n


def by_next_hash(text: bytes, first: int, count: int, span: int) -> list[tuple[int, int, int]]:
    """(key, first string, strings): a region cut where the next least hash of its strings changes."""
    x = seed_hashes(text[first : first + count + span - 1])
    most = np.uint64(2**64 - 1)
    m = window_least(x, span - SEED_BYTES + 1)[0]
    m2 = window_least(np.where(x == m, most, x), span - SEED_BYTES + 1)
    at = np.flatnonzero(np.append(True, m2[1:] != m2[:-1]))
    keys = ((m2[at] ^ (m >> np.uint64(7))) * MUL_A).view(np.int64)
    return list(zip(keys.tolist(), (at + first).tolist(), np.diff(np.append(at, count)).tolist(), strict=True))


def text_hashes(batch: pa.RecordBatch, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(h, row) of all texts of a batch (row, data), each hash once for a row, by hash."""
    hs, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        hs.append(np.unique(hashes_of(unpack(data), span)[0]))
        rows.append(np.full(len(hs[-1]), k, np.int64))
    h, row = np.concatenate(hs), np.concatenate(rows)
    order = np.argsort(h, kind="stable")
    return h[order], row[order]


def shared(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """(h, row): region hashes that texts (row, data) have in common.

    A hash that several rows of a batch have is known to be shared: two of them
    go on to meet other batches' rows, the others need not meet anything.
    """
    schema = pa_schema(texts.sparkSession, "h long, row long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, row = text_hashes(batch, span)
            if not len(h):
                continue
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            ends = np.append(starts[1:], len(h))
            several = row[starts] != row[ends - 1]  # rows of one text come together
            known = np.repeat(several, ends - starts)
            known[starts], known[ends - 1] = False, False
            h = np.where(known, -1 - h, h)  # below zero: known
            order = np.argsort(row, kind="stable")  # a row's hashes side by side: they compress
            h, row = h[order], row[order]
            for at in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 100_000]), pa.array(row[at : at + 100_000])], schema=schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by hash and row, known ones first.  Of the last run of a batch at most
        the entries of one row wait for the next batch; known: that run is shared already."""
        held, known = (np.zeros(0, np.int64), np.zeros(0, np.int64)), None
        for batch in batches:
            h, row = (batch.column(i).to_numpy() for i in range(2))
            n = int(np.searchsorted(h, 0))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(-1 - h[:n]), pa.array(row[:n])], schema=schema)
            if n == len(h):
                continue
            h, row = np.concatenate([held[0], h[n:]]), np.concatenate([held[1], row[n:]])
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            ends = np.append(starts[1:], len(h))
            differ = row[starts] != row[ends - 1]
            if known is not None and h[0] == known:
                differ[0] = True
            hit = np.repeat(differ, ends - starts)
            known = h[-1] if differ[-1] else None
            last = int(starts[-1])
            held = (h[:0], row[:0]) if differ[-1] else (h[last:], row[last:])
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[hit]), pa.array(row[hit])], schema=schema)

    rows = texts.mapInArrow(cut, "h long, row long")
    return rows.repartition(F.when(F.col("h") < 0, F.col("row")).otherwise(F.col("h"))).sortWithinPartitions("h", "row").mapInArrow(meet, "h long, row long")


def common(texts: DataFrame, span: int = SPAN) -> np.ndarray:
    """Hashes that very many texts have, as a sample shows; at most :data:`COMMON`.
    They are dealt out more finely; results don't depend on which they are."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(text_hashes(batch, span)[0])], names=["h"])

    counts = texts.where(F.pmod("row", F.lit(RATE)) == 0).mapInArrow(cut, "h long").groupBy("h").count().where(F.col("count") >= OFTEN)
    return np.array(sorted(r.h for r in counts.orderBy(F.desc("count"), "h").limit(COMMON).collect()), np.int64)


def pack(text: str | None) -> bytes:
    return zstandard.compress(utf8(text), 5)


def unpack(data: bytes) -> bytes:
    return zstandard.decompress(data)


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals (sorted by first), as maximal ones; touching ones join."""
    reach = np.maximum.accumulate(last)
    new = np.append(True, first[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return first[at], reach[np.append(at[1:], len(first)) - 1]


class Regions:
    """Regions in columns: hash, key and number of the row, mark, bytes."""

    def __init__(self, h, key, row, mark, data: list[bytes]):
        self.h, self.key, self.row, self.mark = (np.asarray(x, np.int64) for x in (h, key, row, mark))
        self.data = data

    @property
    def size(self) -> int:
        return sum(map(len, self.data))

    def take(self, at: np.ndarray) -> Regions:
        data = self.data
        return Regions(self.h[at], self.key[at], self.row[at], self.mark[at], [data[i] for i in at.tolist()])

    def pack(self) -> bytes:
        head = np.array([len(self.data)], np.int64)
        return zstandard.compress(b"".join([x.tobytes() for x in (head, self.h, self.key, self.row, self.mark)] + self.data), 5)

    @staticmethod
    def unpack(packed: list[bytes]) -> Regions:
        columns, data = [[], [], [], []], []
        for x in map(zstandard.decompress, packed):
            n = int(np.frombuffer(x, np.int64, 1)[0])
            for k, c in enumerate(columns):
                c.append(np.frombuffer(x, np.int64, n, 8 + 8 * n * k))
            ends = (8 + 32 * n + np.cumsum(columns[3][-1] & 8191)).tolist()
            data += [x[i:j] for i, j in zip([8 + 32 * n, *ends[:-1]], ends, strict=True)]
        return Regions(*map(np.concatenate, columns), data)

    def join(self, other: Regions) -> Regions:
        return Regions(*(np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("h", "key", "row", "mark")), self.data + other.data)


def distinct(r: Regions) -> tuple[Regions, np.ndarray, np.ndarray]:
    """Of equal regions those with the smallest key, and (row, mark) of the others: each of
    their strings starts in a region with a smaller key, so all of their bytes go."""
    least: dict[bytes, int] = {}
    keys = r.key.tolist()
    for data, key in zip(r.data, keys, strict=True):
        if least.setdefault(data, key) > key:
            least[data] = key
    later = np.fromiter((key > least[data] for data, key in zip(r.data, keys, strict=True)), bool, len(keys))
    return r.take(np.flatnonzero(~later)), r.row[later], r.mark[later]


def string_hashes(data: list[bytes], lengths: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of its region, place in it) of each string of ``span`` bytes; equal strings have equal hashes."""
    n = np.maximum(lengths - span + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(lengths) - lengths)[owner] + place
    words = byte_words(np.frombuffer(b"".join(data), np.uint8), 0)
    x = np.zeros(len(at), np.uint64)
    for k in [*range(0, span - 8, 8), span - 8]:
        x = (x ^ words[at + k]) * MUL_A
        x ^= x >> np.uint64(32)
    return x, owner, place


def partnered(r: Regions, span: int = SPAN) -> tuple[Regions, np.ndarray, np.ndarray]:
    """Of regions by hash those with a string that a region of another key may have, cut to
    all between their first and last such string; their numbers; and which of all regions
    have a string that is no other key's.

    Equal strings are in regions of one hash, so a few groups are looked at at a time.
    """
    lengths = r.mark & 8191
    upto = np.append(0, np.cumsum(lengths))
    ends = np.flatnonzero(np.append(r.h[1:] != r.h[:-1], True)) + 1
    of, begin, end, alone, a = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(lengths), bool), 0
    while a < len(lengths):
        b = int(ends[max(np.searchsorted(upto[ends], upto[a] + SHARD, side="right") - 1, np.searchsorted(ends, a, side="right"))])
        found, i = [], a
        while i < b:  # one large group takes several steps
            j = min(b, max(i + 1, int(np.searchsorted(upto, upto[i] + SHARD, side="right")) - 1))
            x, owner, place = string_hashes(r.data[i:j], lengths[i:j], span)
            found.append((x, owner + i, place))
            i = j
        x, owner, place = (np.concatenate(z) for z in zip(*found, strict=True))
        if len(x):
            order = np.argsort(x)
            x, keys = x[order], r.key[owner[order]]
            starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            several = np.minimum.reduceat(keys, starts) < np.maximum.reduceat(keys, starts)
            with_ = np.zeros(len(x), bool)
            with_[order] = np.repeat(several, np.diff(np.append(starts, len(x))))
            alone[owner[~with_]] = True
            owner, place = owner[with_], place[with_]
        if len(owner):
            firsts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            of.append(owner[firsts])
            begin.append(place[firsts])
            end.append(place[np.append(firsts[1:], len(owner)) - 1] + span)
        a = b
    at, begin, end = (np.concatenate(z) for z in (of, begin, end))
    data = [r.data[k][i:j] for k, i, j in zip(at.tolist(), begin.tolist(), end.tolist(), strict=True)]
    return Regions(r.h[at], r.key[at], r.row[at], (r.mark[at] & -8192) + (begin << 13) + end - begin, data), at, alone


def sort_shard(r: Regions, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, mark) of the intervals that go, and which regions hold a string whose smallest key is theirs."""
    lengths = r.mark & 8191
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.frombuffer(b"\xff".join(r.data), np.uint8)  # no byte of UTF-8
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa, span)
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)[: len(text)]
    whole = np.arange(len(text)) + span <= (begins + lengths)[owner]  # a string of the region starts here
    group = np.cumsum(np.append(0, lcp[sa[1:]] < span))
    inside = whole[sa]
    pos, group = sa[inside], group[inside]
    own = r.key[owner[pos]]
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.repeat(np.minimum.reduceat(own, starts), np.diff(np.append(starts, len(group))))
    held = np.zeros(len(lengths), bool)
    held[owner[pos[own == least]]] = True
    gone = np.sort(pos[own > least]).astype(np.int64)
    if not len(gone):
        return gone, gone, held
    new = np.append(True, (gone[1:] != gone[:-1] + 1) | (owner[gone[1:]] != owner[gone[:-1]]))
    at = np.flatnonzero(new)
    first, last, of = gone[at], gone[np.append(at[1:], len(gone)) - 1], owner[gone[at]]
    return r.row[of], (r.mark[of] & -8192) + (first - begins[of] << 13) + last - first + span, held


def sort_all(r: Regions, span: int = SPAN) -> tuple[list[np.ndarray], list[np.ndarray], Regions]:
    """The same for any regions, a shard at a time; those that hold a first string are left.

    Groups of a hash stay together.  One that is larger than a shard is sorted in parts,
    each with what is left of the parts before it: a string that goes is still there once.
    """
    every = r.take(np.argsort(r.h, kind="stable"))
    r, number, stays = partnered(every, span)
    size = (r.mark & 8191) + 1
    starts = np.flatnonzero(np.append(True, r.h[1:] != r.h[:-1]))[: len(size)]
    ends = np.append(starts[1:], len(size))
    upto = np.append(0, np.cumsum(size))
    rows, marks, a = [], [], 0

    def sort(at: np.ndarray) -> np.ndarray:
        row, m, held = sort_shard(r.take(at), span)
        rows.append(row)
        marks.append(m)
        return at[held]

    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(upto[ends], upto[starts[a]] + SHARD, side="right")))
        at = np.arange(starts[a], ends[b - 1])
        kept = at[:0]
        while len(at):
            n = max(1, int(np.searchsorted(np.cumsum(size[at]), max(SHARD, int(size[kept].sum())), side="right"))) if b == a + 1 else len(at)
            kept, at = sort(np.concatenate([kept, at[:n]])), at[n:]
        stays[number[kept]] = True
        a = b
    return rows, marks, every.take(np.flatnonzero(stays))


def mark(check: int, first: int, length: int) -> int:
    """15 bits that tell rows with the same number apart, 34 of the first byte, 13 of the length."""
    return (check & 0x7FFF) << 47 | first << 13 | length


def spans(texts: DataFrame, firsts: DataFrame, buckets: int, span: int = SPAN) -> DataFrame:
    """(row, mark): byte intervals that go.  texts: (row, check, key, data), dealt out by row.

    Regions travel packed, those of a batch and a bucket of hashes in one row.
    """
    spark = texts.sparkSession
    hits = shared(firsts.select("row", "data"), span).repartition("row").groupBy("row").agg(F.collect_list("h").alias("hits"))
    often = common(firsts.select("row", "data"), span)
    schema = "bucket long, data binary"
    out_schema = pa_schema(spark, "row long, mark long")
    settled = -1

    def cut(batches):
        """Regions by bucket.  Of equal ones in a batch the smallest key's is sent; the
        others are settled, and are marks only."""
        for batch in batches:
            best: dict[tuple, tuple] = {}
            again, done = [], []
            for row, check, key, data, own in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                raw = unpack(data)
                h, first, n = hashes_of(raw, span)
                some = np.isin(h, np.array(own, np.int64))
                fine = some & np.isin(h, often)
                some = np.flatnonzero(some & ~fine)
                cuts = list(zip(h[some].tolist(), first[some].tolist(), n[some].tolist(), strict=True))
                for i in np.flatnonzero(fine).tolist():
                    cuts += by_next_hash(raw, int(first[i]), int(n[i]), span)
                for h1, f, k in cuts:
                    region = raw[f : f + k + span - 1]
                    x = key, row, mark(check, f, len(region))
                    old = best.get((h1, region))
                    if old is None or old[0] > key:
                        best[h1, region] = x
                        if old:
                            done.append(old[1:])
                    elif old[0] < key:
                        done.append(x[1:])
                    else:
                        again.append((h1, *x, region))  # the same document's
            if done:
                row, m = np.array(done, np.int64).T
                order = np.argsort(row, kind="stable")
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([settled]), "data": [zstandard.compress(row[order].tobytes() + m[order].tobytes(), 3)]})
            if not best:
                continue
            all_ = Regions(*map(list, zip(*[(h1, *x, region) for (h1, region), x in best.items()], *again, strict=True)))
            bucket = (all_.h.view(np.uint64) * MUL_B >> np.uint64(16)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)).tolist()
            for n in range(0, len(cuts), 256):
                parts = [order[i:j] for i, j in zip(cuts[n : n + 256], [*cuts, len(order)][n + 1 : n + 257], strict=True)]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(bucket[x[0]]) for x in parts]), "data": [all_.take(x).pack() for x in parts]})

    def settle(batches):
        """Buckets in order.  Of one that grows too large what is left of it after sorting stays."""
        now, packed, held, limit = None, [], None, LARGEST

        def rows_of(row, m):
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array(m)], schema=out_schema)

        def sorted_():
            nonlocal packed, held
            r = Regions.unpack(packed)
            r, *equal = distinct(r if held is None else held.join(r))
            row, m, held = sort_all(r, span)
            packed = []
            return rows_of(np.concatenate([equal[0], *row]), np.concatenate([equal[1], *m]))

        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket == settled:
                    row, m = np.frombuffer(zstandard.decompress(data), np.int64).reshape(2, -1)
                    yield rows_of(row, m)
                    continue
                if bucket != now:
                    if packed:
                        yield sorted_()
                    now, held, limit = bucket, None, LARGEST
                packed.append(data)
                if sum(map(len, packed)) > limit:
                    yield sorted_()
                    limit = max(LARGEST, held.size // 2)
        if packed:
            yield sorted_()

    regions_ = texts.join(hits, "row").mapInArrow(cut, schema)
    dealt = F.when(F.col("bucket") == settled, F.xxhash64("data")).otherwise(F.col("bucket"))
    return regions_.repartition(dealt).sortWithinPartitions("bucket").mapInArrow(settle, "row long, mark long")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Null text counts as empty.  Rows with the same id are one document: they
    don't remove each other's strings, and each loses what other documents take
    from it.  Null counts as the largest id, 2^63 - 1.  Texts are read whole; an
    empty table gives no rows; other columns are ignored.  With ``with_text``,
    the remaining bytes follow (they may break a character, so they are binary).
    """
    if span < SEED_BYTES + 1:
        raise ValueError(f"span must be over {SEED_BYTES} bytes")
    doc_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("key"), text.alias("text"), F.sha2(text, 256).alias("whole"))
    numbers = [F.xxhash64("key", "whole").alias("row"), F.xxhash64(F.lit("check"), "whole", "key").alias("check")]
    small = stored(keyed.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), "whole"))
    least = stored(small.groupBy("whole").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("n")).where("least < most"))
    copies = stored(hot_join(small, least, ["whole"], "n", ["key"]).where("key > least").select("key", "whole", "n_bytes").distinct())

    def compress():
        seen: set = set()

        def row(x):
            if x[:2] in seen:  # the same row again
                return ()
            if len(seen) < 100_000:
                seen.add(x[:2])
            return ((*x[:3], pack(x[3])),)

        return row

    # The condition is one that inner joins would add, and what meets texts is dealt out
    # in the same explicit way: so all uses share one shuffle.
    long_enough = keyed.where(F.octet_length("text") >= span).select(*numbers, "key", "text")
    texts = map_rows(long_enough, compress, "row long, check long, key long, data binary", 2_000).where("row is not null").repartition("row")
    settled = copies.select(*numbers).distinct().select("row", F.col("check").alias("settled")).repartition("row")
    # Not an anti join: Catalyst would move that below the shuffle and shuffle texts again.
    firsts = texts.join(settled, "row", "left").where("settled is null or settled <> check").select("row", "data")
    total = small.agg(F.sum("n_bytes")).first()[0] or 0
    gone = spans(texts, firsts, max(BUCKETS, total // BUCKET), span)
    per_row = gone.repartition("row").groupBy("row").agg(F.collect_list("mark").alias("marks"))

    def make():
        def row(x):
            _, check, key, data, marks = x
            raw = unpack(data)
            own = sorted((m >> 13 & (1 << 34) - 1, m & 8191) for m in marks if m >> 47 == check & 0x7FFF)
            if not own:
                return
            first, length = np.array(own, np.int64).T
            first, end = merged(first, first + length)
            keep, at = [], 0
            for a, b in zip(first.tolist(), end.tolist(), strict=True):
                keep.append(raw[at:a])
                at = b
            kept = b"".join([*keep, raw[at:]])
            yield key, hashlib.sha256(raw).hexdigest(), len(raw) - len(kept), len(first), hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])

        return row

    schema = "key long, whole string, n_removed long, n_spans long, kept string" + ", bytes binary" * with_text
    lost = map_rows(texts.join(per_row, "row"), make, schema, 2_000)
    empty = hashlib.sha256(b"").hexdigest()
    long = copies.where(F.col("n_bytes") >= span).select("key", "whole", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept"), *([F.lit(b"").alias("bytes")] if with_text else []))
    lost = lost.join(long, ["key", "whole"], "left_anti").distinct().union(long.select(*lost.columns))
    all_ = keyed.select("doc_id", "key", "whole", F.octet_length("text").cast("long").alias("n_bytes"), F.encode("text", "utf-8").alias("raw")) if with_text else small
    both = all_.join(lost, ["key", "whole"], "left")
    return both.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept", "whole").alias("kept_sha256"),
        *([F.coalesce("bytes", "raw").alias("bytes")] if with_text else []),
    )


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 50-byte strings of smaller ids take from each document."""
    return substring_dedup(documents(spark, sf_dir))
