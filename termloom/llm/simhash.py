"""SimHash near-duplicates.

A fingerprint takes the majority of each bit over hashes of a text's word
shingles.  Fingerprints of 64 bits that differ in at most 4 share at least 4 of
their 8 positional bytes.  The inverted index lists distinct fingerprints under
every choice of three positions and their bytes.  Of each pair of a list the
shared positional bytes are tallied; pairs that reach the minimum of four are
verified by their differing bits, and verified pairs are linked, each in the first
of the lists that they share.

A share of common shingles (Jaccard similarity) is no number of bits, so texts
are linked at one by their shingle sets.  First the fingerprints' links, found as
above, are checked on the sets; most near copies are connected by that.  What
differs in more bits is found by shared shingles.  Sets of n that overlap by a share s
have s n elements in common, so in any fixed order of all shingles they share
one of their first n - s n + 1: sets are listed under those, and no pair is
lost.  Shingles frequent in a sample come last, which keeps lists short; the
order has no bearing on the result.  Shared lists are tallied per pair of a text
and a list's hub, and the pair with the most is looked at; what that leaves apart
is compared pair by pair.  Pairs pass bounds that hold without exception (sizes;
parities of shingles in 1,024 places, of which no more differ than shingles do), then
the sets themselves are compared.

Hot groups: exact copies are one fingerprint and meet only in partial
aggregates; joins split hot keys.  A long list is looked at by a fourth position
(which a pair with four shared bytes has), and what is long still is searched from
one fingerprint to the next, so it yields a spanning forest instead of all its
pairs.  Links, components and fingerprints stay in distributed tables.
"""

from __future__ import annotations

import math
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, documents, forget, hot_join, map_rows, pa_schema, stored, utf8
from .linededup import in_bitmap

SEED = 42
MUL = np.uint64(0x9E3779B97F4A7C15)
#: Lists up to this long are compared pair by pair, all of a batch at once.
SHORT = 24
#: Texts, about, whose shingles are counted for the order, and shingles at most that are put last.
SAMPLE, FREQUENT = 20_000, 200_000
#: Neighbours of one node above which its links are dealt to many tasks.
WIDE = 100_000
#: Places whose parities are compared.
PLACES = 1024
#: Turns, at most, of comparing components with hubs, before what is left apart is compared pair by pair.
TURNS = 3
#: Longer lists of texts that are not alike are compared part by part.
PART = 2_048
#: Nodes of a list, about, that share a hub in a turn.
HUB = 512
#: A turn that finds less than this part of all links so far is the last.
FEW = 10


#: The three positions of each list, and their bytes' mask.
CHOICES = list(combinations(range(8), 3))
MASKS = np.array([sum(255 << 8 * b for b in c) for c in CHOICES], np.uint64)
#: Positional bytes that fingerprints share at least, if 4 bits differ at most.
MINIMUM = 4


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of each shingle of n lower-cased words (all words, if fewer)."""
    words = utf8(text).translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([h(joined, SEED)], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
    starts = [0, *(e + 1 for e in ends)]
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :], strict=False)), np.uint64, len(words) - n + 1)


def majority(h: np.ndarray) -> int:
    """A bit is 1 if more than half the hashes have it; without hashes all are 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 200):  # sums of a byte each don't overflow
        ones += np.add.reduce(np.unpackbits(h[at : at + 200].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, n: int = 4) -> int:
    """The majority of the hashes of a text's shingles; without words in the text it is 0."""
    return majority(shingle_hashes(text, n))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4) -> DataFrame:
    """row_id, doc_id and node, the fingerprint as a signed 64-bit integer."""

    def make():
        return lambda x: ((x[0], x[1], signed(fingerprint(x[2], n))),)

    return map_rows(docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), make, "row_id long, doc_id long, node long")


def spread(nodes: DataFrame) -> DataFrame:
    """(choice, key, node): each fingerprint under each of its choices of positional bytes."""
    schema = pa_schema(nodes.sparkSession, "choice short, key long, node long")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                fp = batch.column(0).slice(at, 4000).to_numpy(zero_copy_only=False)
                keys = (fp.view(np.uint64)[:, None] & MASKS[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(len(MASKS), dtype=np.int16), len(fp))), pa.array(keys), pa.array(np.repeat(fp, len(MASKS)))], schema=schema)

    return nodes.select("node").mapInArrow(run, "choice short, key long, node long")


def same_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of eight: whether the positional bytes are the same."""
    return np.ascontiguousarray(a ^ b).view(np.uint8).reshape(-1, 8) == 0


def near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which fingerprints reach the minimum of shared positional bytes, and then differ in at most ``most`` bits."""
    out = same_bytes(a, b).sum(1) >= MINIMUM
    out[out] = np.bitwise_count((a ^ b)[out]) <= most
    return out


def pairs_within(fp: np.ndarray, edges: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of positions within short lists that lie one after the other between edges."""
    found, sizes = [], np.diff(edges)
    left = np.repeat(edges[1:], sizes) - np.arange(len(fp)) - 1  # how many of its list follow
    for away in range(1, int(left.max(initial=0)) + 1):
        i = np.flatnonzero(left >= away)
        i = i[near(fp[i], fp[i + away], most)]
        found.append((i, i + away))
    return found


def forest(fp: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of one list: from each fingerprint to those near it that nothing has reached yet."""
    links, rest = [], fp
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = near(rest, np.broadcast_to(x, rest.shape), most)
            if hit.any():
                found = rest[hit]
                links.append((np.repeat(x, len(found)), found))
                queue += list(found)
                rest = rest[~hit]
    return links


def long_list(fp: np.ndarray, choice: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a long list, by each further position in turn."""
    found = []
    for p in set(range(8)) - set(CHOICES[choice]):
        own = fp >> np.uint64(8 * p) & np.uint64(255)
        order = np.argsort(own.astype(np.uint8), kind="stable")
        ends = np.flatnonzero(np.append(own[order][1:] != own[order][:-1], True)) + 1
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            if b - a > 1:
                found += forest(fp[order[a:b]], most)
    return found


def list_links(fp: np.ndarray, edges: np.ndarray, choice: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of several whole lists, of one choice each, that lie one after the other between edges."""
    found, sizes = [], np.diff(edges)
    for k in np.flatnonzero(sizes > SHORT).tolist():
        found += long_list(fp[edges[k] : edges[k + 1]], int(choice[k]), most)
    short = sizes <= SHORT
    inside = np.repeat(short, sizes)
    fp, masks = fp[inside], np.repeat(MASKS[choice[short]], sizes[short])
    for i, j in pairs_within(fp, np.append(0, np.cumsum(sizes[short])), most):
        same = same_bytes(fp[i], fp[j])
        first = (same & (np.cumsum(same, axis=1) <= 3)).astype(np.uint8) * np.uint8(255)
        own = np.ascontiguousarray(first).view(np.uint64).ravel() == masks[i]  # the first list that they share
        found.append((fp[i[own]], fp[j[own]]))
    return found


def links(nodes: DataFrame, most: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints (node) that connect those which
    chains of at most ``most`` differing bits connect.

    Lists are met one after the other in sorted partitions, so a task holds one
    list (8 bytes a fingerprint) and never a whole partition.
    """
    if not 0 <= most <= 8 - MINIMUM:
        raise ValueError("four positional bytes are guaranteed for at most 4 differing bits")
    schema = pa_schema(nodes.sparkSession, "a long, b long")
    listed = spread(nodes).repartition("choice", "key").sortWithinPartitions("choice", "key")

    def run(batches):
        held, last = np.zeros(0, np.uint64), None

        def out(found):
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            choice, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = fp.view(np.uint64)
            starts = np.flatnonzero(np.append(True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])))
            found, of = [], choice[starts]
            if (int(choice[0]), int(key[0])) != last and len(held):
                found += list_links(held, np.array([0, len(held)]), np.array([last[0]]), most)
                held = held[:0]
            fp, n = np.concatenate([held, fp]), len(held)
            edges = np.append(0, starts[1:] + n)
            if len(starts) > 1:
                found += list_links(fp[: edges[-1]], edges, of[:-1], most)
            held, last = fp[edges[-1] :], (int(choice[-1]), int(key[-1]))
            if found:
                yield out(found)
        if len(held) and (found := list_links(held, np.array([0, len(held)]), np.array([last[0]]), most)):
            yield out(found)

    return listed.mapInArrow(run, "a long, b long")


def star_step(e: DataFrame) -> DataFrame:
    """Edges (a, b), a above b, after a large-star and a small-star step: a written table."""
    both = e.union(e.select("b", "a")).toDF("a", "b")
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    # Few nodes have so many neighbours that one task would feel them.
    wide = 2 * e.count() > WIDE and (low.agg(F.max("n")).first()[0] or 0) > WIDE
    e = (hot_join(both, stored(low), ["a"], "n", ["b"]) if wide else both.join(low, "a")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    small = e.join(low, "a")
    return stored(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m")).where("a <> b").distinct())


def downward(edges: DataFrame) -> DataFrame:
    """Edges (a, b), each once and from the larger node to the smaller one: a written table."""
    return stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.

    Alternating large-star and small-star steps; each step is a written table.
    """
    e, before = downward(edges), None
    while True:
        e = star_step(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def shingle_set(text: str | None, n: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, n))


def print_pairs(own: DataFrame, most: int = 4) -> DataFrame:
    """(a, b, row_a, row_b): pairs of sets (node, row, fp) whose fingerprints are the same or linked.

    Sets of one fingerprint are paired with the smallest node among them, which stands for it in links.
    """
    least = stored(own.groupBy("fp").agg(F.min(F.struct("node", "row")).alias("x"), F.count("*").alias("n")).select("fp", F.col("x.node").alias("first"), F.col("x.row").alias("row_first"), "n"))
    same = hot_join(own.select("fp", "node", "row"), least.where("n > 1"), ["fp"], "n", ["node"]).where("node <> first")
    near_ = stored(links(least.select(F.col("fp").alias("node")), most).distinct())
    total, both = near_.count(), near_
    for end, other in (("a", "b"), ("b", "a")):  # one fingerprint may be near very many
        counts = near_.groupBy(end).agg(F.count("*").alias("n")).where("n > 1")
        both = hot_join(both, least.select(F.col("fp").alias(end), F.col("first").alias(f"node_{end}"), F.col("row_first").alias(f"row_{end}")), [end], "n", [other], total=total, counts=counts)
    return same.select(F.col("first").alias("a"), F.col("node").alias("b"), F.col("row_first").alias("row_a"), F.col("row").alias("row_b")).union(both.select("node_a", "node_b", "row_a", "row_b"))


def parities(own: np.ndarray) -> bytes:
    """Bit k is the parity of how many of the hashes fall in place k of 1,024."""
    odd = np.bincount((own >> np.uint64(54)).astype(np.int64), minlength=PLACES).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def odds(column) -> np.ndarray:
    """Parities of an Arrow column, a row of words for each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PLACES // 64)


def shingle_rows(rows: DataFrame, n: int, similarity: float) -> DataFrame:
    """row_id, doc_id, node (a hash of the shingle set), fp (the fingerprint), size, odd (parities)
    and head (the shingles under which the set is listed) of rows (row_id, doc_id, text)."""
    spark = rows.sparkSession
    rate = max(1, rows.count() // SAMPLE)

    def each():
        return lambda x: [(h,) for h in shingle_set(x[0], n).view(np.int64).tolist()]

    sample = rows.select("text").where(F.pmod(F.xxhash64("text"), F.lit(rate)) == 0).distinct()
    counts = map_rows(sample, each, "h long", 200_000).groupBy("h").count().where("count > 2")
    often = counts.orderBy(F.desc("count"), "h").limit(FREQUENT).toPandas().sort_values("h")
    shared = spark.sparkContext.broadcast((often["h"].to_numpy(np.int64), often["count"].to_numpy(np.int64)))

    def make():
        known, times = shared.value

        def row(x):
            every = shingle_hashes(x[2], n)
            own = np.unique(every)
            size, hashes = len(own), own.view(np.int64)
            head = hashes
            if size:
                rank = np.zeros(size, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    rank = np.where(known[at] == hashes, times[at], 0)
                head = hashes[np.lexsort((hashes, rank))[: size - math.ceil(similarity * size - 1e-9) + 1]]
            yield x[0], x[1], signed(xxhash.xxh64_intdigest(own.tobytes(), SEED)), signed(majority(every)), size, parities(own), head.tolist()

        return row

    return map_rows(rows.select("row_id", "doc_id", "text"), make, "row_id long, doc_id long, node long, fp long, size int, odd binary, head array<long>", 2_000)


def hub_pairs(placed: DataFrame, turn: int, similarity: float) -> DataFrame:
    """(a, b, row_a, row_b, of, to): of lists (h, n, node, root, size, row, odd) the first node of
    each with every other one of another root, unless sizes or parities rule the pair out;
    ``of`` and ``to`` are the two roots.  Each turn has an order, and so first nodes, of its own.

    Sets of a share s in common differ in (1 - s) / (1 + s) of their sizes' sum at most.
    A list of more than HUB nodes is dealt to several tasks, each part with a hub of its own.
    """
    kind = "a long, b long, row_a long, row_b long, of long, to long"
    schema, bound = pa_schema(placed.sparkSession, kind), (1 - similarity) / (1 + similarity)

    def run(batches):
        hub = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = [col.to_numpy(zero_copy_only=False) for col in batch.columns[:-1]] + [odds(batch.columns[-1])]
            if hub is not None:
                c = [np.concatenate(z) for z in zip(hub, c, strict=True)]
            h, part, node, root, size, row, odd = c
            starts = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])))
            i = np.repeat(starts, np.diff(np.append(starts, len(h))))
            hub = [z[starts[-1] : starts[-1] + 1].copy() for z in c]
            j = np.flatnonzero((root != root[i]) & (np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]) - 1e-6))
            i = i[j]
            ok = np.bitwise_count(odd[i] ^ odd[j]).sum(1, dtype=np.int64) <= bound * (size[i] + size[j]) + 1e-6
            i, j = i[ok], j[ok]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[i], node[j], row[i], row[j], root[i], root[j])], schema=schema)

    part = F.pmod(F.xxhash64("node", F.lit(-1 - turn)), F.ceil(F.col("n") / HUB)).alias("part")
    ordered = placed.select("h", part, "node", "root", F.col("size").cast("long").alias("size"), "row", "odd", F.xxhash64("node", F.lit(turn)).alias("place"))
    return ordered.repartition("h", "part").sortWithinPartitions("h", "part", "place").drop("place").mapInArrow(run, kind)


def apart(placed: DataFrame) -> DataFrame:
    """(h, n) of the lists whose nodes have several roots."""
    return placed.groupBy("h", "n").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h", "n")


def unlike_pairs(lists: DataFrame, similarity: float) -> DataFrame:
    """(a, b, row_a, row_b): pairs of one list that no links connect so far and that
    no bound rules out, of rows (h, x, y, part, size, root, node, row, odd).

    A group (h, x, y) is one list, or the pairs between two parts of a long one.
    """
    schema = pa_schema(lists.sparkSession, "a long, b long, row_a long, row_b long")
    bound = (1 - similarity) / (1 + similarity)

    def pairs(c: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
        _, x, y, part, size, root, node, row, odd = c
        left = np.repeat(np.append(starts[1:], len(size)), np.diff(np.append(starts, len(size)))) - np.arange(len(size)) - 1  # rows of the group that follow
        found = []
        for away in range(1, int(left.max(initial=0)) + 1):
            i = np.flatnonzero(left >= away)
            i = i[size[i] >= similarity * size[i + away] - 1e-6]  # they come by size
            if not len(i):
                break
            j = i + away
            ok = (root[i] != root[j]) & ((x[i] == y[i]) | (part[i] != part[j]))
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(odd[i] ^ odd[j]).sum(1, dtype=np.int64) <= bound * (size[i] + size[j]) + 1e-6
            found.append((i[ok], j[ok]))
        i, j = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
        less = node[i] < node[j]
        i, j = np.where(less, i, j), np.where(less, j, i)
        return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), pa.array(row[i]), pa.array(row[j])], schema=schema)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = [col.to_numpy(zero_copy_only=False) for col in batch.columns[:-1]] + [odds(batch.columns[-1])]
            if held is not None:
                c = [np.concatenate(z) for z in zip(held, c, strict=True)]
            starts = np.flatnonzero(np.append(True, (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])))
            last = starts[-1]
            held = [z[last:] for z in c]
            if last:
                yield pairs([z[:last] for z in c], starts[:-1])
        if held is not None:
            yield pairs(held, np.array([0]))

    return lists.mapInArrow(run, "a long, b long, row_a long, row_b long")


def alike(pairs: DataFrame, rows: DataFrame, n: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of stored (a, b, row_a, row_b) whose rows' shingle sets overlap by the similarity.

    Texts are joined, not sets, which are three times as large on their way; a bitmap
    of fixed size keeps most texts that no pair needs where they are.
    """

    def make():
        held = [None, None]

        def row(x):
            a, b, row_a, text_a, text_b = x
            if held[0] != row_a:
                held[:] = row_a, shingle_set(text_a, n)
            one, two = held[1], shingle_set(text_b, n)
            common = len(np.intersect1d(one, two, assume_unique=True))
            return ((a, b),) if common / (len(one) + len(two) - common) >= similarity else ()

        return row

    total = pairs.count()
    wanted = pairs.select(F.explode(F.array("row_a", "row_b")).alias("row_id")).select(F.xxhash64("row_id").alias("h"))
    texts = in_bitmap(rows.select("row_id", "text", F.xxhash64("row_id").alias("h")), wanted, "h").groupBy("row_id").agg(F.first("text").alias("text"))
    both = pairs
    for row, other in (("row_b", "row_a"), ("row_a", "row_b")):  # a hub may be in very many pairs
        counts = pairs.groupBy(row).agg(F.count("*").alias("n")).where("n > 1")
        both = hot_join(both, texts.toDF(row, row.replace("row", "text")), [row], "n", [other], total=total, counts=counts)
    return map_rows(both.select("a", "b", "row_a", "text_a", "text_b"), make, "a long, b long", 2_000)


def row_number(doc_id: Column, text: Column) -> Column:
    """A number that rows with the same id and text share, the same whenever a table is read."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def similar_rows(rows: DataFrame, n: int, similarity: float) -> DataFrame:
    """row_id, doc_id, node and root of rows (row_id, doc_id, text): root is the smallest
    node that links reach, a link being a Jaccard similarity of at least ``similarity``.
    Rows that share a row_id (:func:`row_number`) have the same id and text.

    Links of fingerprints (positional index, tally of shared bytes, differing bits) come first and
    are checked on the sets.  Then a few turns compare each component with the hubs of its lists, by
    the pair of most shared lists for each hub's component, so no more pairs than list entries; then,
    of lists whose nodes are not connected by that, the pairs between components are looked at.
    Tables of lists are deleted as soon as the next one is written.
    """
    sets = stored(shingle_rows(rows, n, similarity))
    own = stored(sets.groupBy("node", "size", "odd").agg(F.min("row_id").alias("row"), F.min("fp").alias("fp"), F.count("*").alias("n")))
    new = stored(alike(stored(print_pairs(own)), rows, n, similarity))
    total = new.count()
    tree = components(new) if total else rows.sparkSession.createDataFrame([], "node long, root long")
    linked = tree.toDF("a", "b") if total else None
    heads = sets.select(F.explode("head").alias("h"), "node")
    common = heads.groupBy("h").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("h")  # most shingles list one set only
    some = stored(in_bitmap(heads, common, "h").distinct())
    every = stored(sets.select("row_id", "doc_id", "node"))
    forget(sets)  # the heads are listed
    sizes = stored(some.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    lists = stored(hot_join(some, sizes, ["h"], "n", ["node"]).join(own.drop("n", "fp"), "node").select("h", "n", "node", "size", "row", "odd"))
    forget(some, sizes)
    placed = stored(lists.join(tree, "node", "left").withColumn("root", F.coalesce("root", "node")))
    for turn in range(TURNS):
        tally = hub_pairs(in_bitmap(placed, apart(placed), "h"), turn, similarity).groupBy("a", "b", "row_a", "row_b", "of", "to").count()
        best = tally.groupBy("of", "to").agg(F.max_by(F.struct("a", "b", "row_a", "row_b"), F.struct("count", -F.col("a"), -F.col("b"))).alias("x"))
        new = stored(alike(stored(best.select("x.*")), rows, n, similarity))
        found = new.count()
        if not found:
            break
        tree = components(new if linked is None else linked.union(new))
        linked = tree.toDF("a", "b")
        forget(placed)
        placed = stored(lists.join(tree, "node", "left").withColumn("root", F.coalesce("root", "node")))
        total += found
        if found * FEW < total:  # another turn would find little
            break
    forget(lists)
    several = stored(apart(placed))
    parts = F.ceil(F.col("n") / PART)
    rest = hot_join(placed.drop("n"), several, ["h"], "n", ["node"]).withColumn("part", F.pmod(F.xxhash64("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rest = rest.select("h", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "size", "root", "node", "row", "odd")
    more = stored(unlike_pairs(rest.repartition("h", "x", "y").sortWithinPartitions("h", "x", "y", "size"), similarity).distinct())
    forget(placed)
    if not more.isEmpty():
        new = alike(more, rows, n, similarity)
        linked = new if linked is None else linked.union(new)
    tree = rows.sparkSession.createDataFrame([], "node long, root long") if linked is None else components(linked)
    rooted = stored(own.select("node", "n").join(tree, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root")))
    return hot_join(every, rooted, ["node"], "n", ["row_id"]).drop("n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, most: int = 4, similarity: float | None = None) -> DataFrame:
    """doc_id, node (the fingerprint, signed) and component_id: the smallest
    doc_id that links reach.

    By default fingerprints of 64 bits are linked at up to ``most`` differing
    bits.  With ``similarity`` (above 0) texts are linked whose sets of shingles
    have at least this Jaccard similarity, all of them, and node is a hash of the set.

    Null and empty texts have no words: fingerprint 0 (or the empty set), linked
    like any other.
    Null ids are left out of the minimum and get their component's.  Repeated
    rows give a row each.  An empty table gives no rows.  Other columns are
    ignored.
    """
    if similarity is not None:
        doc_id = F.col(id_col).cast("long")
        rows = docs.select(row_number(doc_id, F.col(text_col)).alias("row_id"), doc_id.alias("doc_id"), F.col(text_col).alias("text"))
        named = stored(similar_rows(rows, n, similarity))
        least = stored(named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")))
        return hot_join(named, least, ["root"], "n", ["row_id"]).select("doc_id", "node", "component_id")
    fps = stored(fingerprints(docs, id_col, text_col, n))
    own = stored(fps.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    tree = components(links(own, most))
    root = stored(own.join(tree, "node", "left").select("node", "n", "least", F.coalesce("root", "node").alias("root")))
    least = stored(root.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes")))
    named = stored(hot_join(root, least, ["root"], "nodes", ["node"]).select("node", "n", "component_id"))
    return hot_join(fps, named, ["node"], "n", ["row_id"]).select("doc_id", "node", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document, and the smallest id its links reach."""
    got = near_duplicates(documents(spark, sf_dir))
    return got.select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")
