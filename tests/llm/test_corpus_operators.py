"""Line dedup, substring dedup, mixing, SimHash, search and the pipeline."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from helpers import AWKWARD, corpus, shuffled, table
from pyspark.sql import functions as F

import corpus_pipeline
from termloom.llm import ann, common, linededup, mixing, quality, sais, simhash, suffix

# Line dedup


def brute_lines(rows):
    """Texts after line dedup, of rows with distinct ids (null last)."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        if t is None:
            out[d] = None
            continue
        lines, gone = t.split("\n"), set()
        for i, pair in enumerate(zip(lines, lines[1:], strict=False)):
            if all(x.strip(" \t\r") for x in pair):
                gone |= {i, i + 1} if pair in seen else set()
                seen.add(pair)
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def distinct(rows):
    return list({d: (d, t) for d, t in rows}.values())


def test_line_dedup(spark):
    rows = distinct(AWKWARD + [(1000 + d, t) for d, t in corpus(100)] + [(5000, "a\x01b\n\x01\x02c\nd\ne\nf\ng"), (5001, "a\x01b\n\x01\x02c\nd\ne\nf\ng"), (5002, "\n\n\n\n\n"), (5003, "\n\n\n\n\n")])
    df = table(spark, shuffled(rows))
    got = linededup.line_dedup(df)
    want = brute_lines(rows)
    assert got.columns == df.columns and {r.doc_id: r.text for r in got.collect()} == want
    assert sum(want[d] != t for d, t in rows) > 20  # something went
    counted = linededup.line_dedup(df, count=True).collect()
    assert all((r.n_removed > 0) == (r.text != dict(rows)[r.doc_id]) for r in counted)
    assert linededup.line_dedup(table(spark, [])).count() == 0
    same = linededup.line_dedup(table(spark, AWKWARD)).where("doc_id = 9").collect()
    assert [r.text for r in same] == [AWKWARD[8][1]] * 2  # repeated rows are one document


def test_shifted_lines_are_found(spark):
    lines = [f"this is line number {k} of the passage" for k in range(60)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["an inserted first line", *lines, "and a last one"])), (3, "\n".join(lines[7:55]))]
    left = {r.doc_id: len(r.text) for r in linededup.line_dedup(table(spark, rows)).collect()}
    assert left[1] == len(rows[0][1]) and left[2] < 0.3 * len(rows[1][1]) and left[3] < 0.3 * len(rows[2][1])


def test_passages_of_any_length_go(spark):
    """Passages of two to ten lines in otherwise different texts, wherever they stand."""
    rng = np.random.default_rng(7)
    line = lambda: " ".join("".join(chr(97 + c) for c in rng.integers(0, 16, 6)) for _ in range(8))
    rows, passages = [], []
    for n in (2, 3, 4, 5, 6, 8, 10):
        for _ in range(12):
            passage = [line() for _ in range(n)]
            for _ in range(2):
                rows.append((len(rows), "\n".join([line() for _ in range(rng.integers(0, 9))] + passage + [line() for _ in range(rng.integers(0, 9))])))
            passages.append(passage)
    got = {r.doc_id: r.text for r in linededup.line_dedup(table(spark, rows)).collect()}
    for k, passage in enumerate(passages):
        assert got[2 * k] == rows[2 * k][1]
        own = rows[2 * k + 1][1].split("\n")
        assert got[2 * k + 1] == "\n".join(x for x in own if x not in passage)


def test_lines_of_very_long_texts(spark):
    text = "\n".join(f"line {k}" for k in range(60_000))
    got = {r.doc_id: r.text for r in linededup.line_dedup(table(spark, [(1, text), (2, "x\n" + text + "\ny"), (3, "line 5\nline 7")])).collect()}
    assert got == {1: text, 2: "x\ny", 3: "line 5\nline 7"}


# Suffix arrays and substring dedup


def test_suffix_array():
    rng = np.random.default_rng(0)
    for t in range(600):
        s = rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(1, 60)))
        if t % 5 == 0:
            s = np.tile(s[: max(1, len(s) // 4)], 4)
        b = s.tolist()
        sa = sais.suffix_array(s)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        for most in (3, 50):
            lcp = sais.common_prefixes(s, sa, most)
            for r, i in enumerate(sa.tolist()):
                want, j = 0, int(sa[r - 1])
                while r and want < most and max(i, j) + want < len(b) and b[i + want] == b[j + want]:
                    want += 1
                assert lcp[i] == want
    wide = rng.integers(0, 5000, 3000)
    assert sais.suffix_array(wide).tolist() == sorted(range(3000), key=lambda i: wide[i:].tolist())


def brute_substrings(rows, span=50):
    raw = [(d if d is not None else suffix.LAST, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in raw:
        for i in range(len(b) - span + 1):
            x = b[i : i + span]
            first[x] = min(first.get(x, d), d)
    out = []
    for (d0, _), (d, b) in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] < d:
                gone[i : i + span] = b"\1" * span
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((str(d0), len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substrings(spark):
    base = corpus(60, 4)
    long = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    extra = [(2000, long), (2001, "x" + long[:50]), (2002, long[:49]), (2003, long[5:57] + long[5:57]), (2004, "ab" * 4000), (2005, "z" + "ab" * 3000), (-7, "ab" * 60), (2006, "é" * 60), (2007, "é" * 40), (2008, long[:30] + "!" + long[30:])]
    # The same id with other texts, and the same row again.
    extra += [(2000, "ab" * 40 + "other"), (2000, long), (2009, base[0][1]), (2009, "not " + base[1][1])]
    rows = base + AWKWARD + extra
    got = suffix.substring_dedup(table(spark, shuffled(rows)))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute_substrings(rows)
    small = base[:30]
    whole = suffix.substring_dedup(table(spark, small), span=20, with_text=True).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in whole) == brute_substrings(small, 20)
    assert all(hashlib.sha256(bytes(r.bytes)).hexdigest() == r.kept_sha256 for r in whole)
    assert suffix.substring_dedup(table(spark, [])).count() == 0


def test_shards_equal_brute():
    rng = np.random.default_rng(1)
    base = bytes(rng.integers(97, 123, 200).astype(np.uint8))
    entries = []
    for _ in range(40):
        a, n = int(rng.integers(0, 140)), int(rng.integers(50, 60))
        b = base[a : a + n] + bytes(rng.integers(97, 99, 10).astype(np.uint8))
        entries.append((k := int(rng.integers(0, 6)), k, suffix.mark(0, int(rng.integers(0, 1000)), len(b)), b))
    strings = defaultdict(lambda: 1 << 60)
    for k, _, _, b in entries:
        for i in range(len(b) - 49):
            strings[b[i : i + 50]] = min(strings[b[i : i + 50]], k)
    want = set()
    for k, _, m, b in entries:
        for i in range(len(b) - 49):
            if strings[b[i : i + 50]] < k:
                want |= {(k, (m >> 13) + j) for j in range(i, i + 50)}
    regions = suffix.Regions([1] * len(entries), *zip(*entries, strict=True))
    regions.data = list(regions.data)
    again = suffix.Regions.unpack([regions.take(np.arange(25)).pack(), regions.take(np.arange(25, 40)).pack()])
    assert again.data == regions.data and (again.mark == regions.mark).all() and (again.key == regions.key).all()
    old = suffix.SHARD
    try:
        for suffix.SHARD in (old, 300):  # in one part, and in many
            row, mark, left = suffix.sort_all(again)
            pairs = zip(np.concatenate(row).tolist(), np.concatenate(mark).tolist(), strict=True)
            assert {(k, j) for k, m in pairs for j in range(m >> 13, (m >> 13) + (m & 8191))} == want and want
            assert {x for b in left.data for x in (b[i : i + 50] for i in range(len(b) - 49))} == set(strings)
    finally:
        suffix.SHARD = old


def test_common_strings_are_split(spark):
    """A rule of signs in all texts, with other words around it: its hash is found and split, results hold."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 7))
    rows = [(d, f"{word()} {word()} {'=' * 40} {word()} {word() if d % 3 else 'the same tail of some more than fifty bytes, word for word'}") for d in range(900)]
    old = suffix.RATE, suffix.OFTEN
    try:
        suffix.RATE, suffix.OFTEN = 2, 100
        texts = spark.createDataFrame([(d, suffix.pack(t)) for d, t in rows], "row long, data binary")
        assert len(suffix.common(texts)) > 0
        got = suffix.substring_dedup(table(spark, shuffled(rows))).collect()
    finally:
        suffix.RATE, suffix.OFTEN = old
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_substrings(rows)


# Mixing


def brute_mix(rows):
    """(doc_id, source) texts to taken words."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, (*_, x) in zip(size, rows, strict=True) if x == s) for s in sources}
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    capped = set()
    while True:
        rest = [s for s in sources if s not in capped]
        share = (sum(size) - sum(3 * total[s] for s in capped)) / sum(weight[s] for s in rest) if rest else 0
        more = {s for s in rest if weight[s] * share > 3 * total[s]}
        if not more:
            break
        capped |= more
    target = {s: 3.0 * total[s] if s in capped else weight[s] * share for s in sources}
    h = [int(hashlib.md5((f":{t or ''}" if d is None else str(d)).encode()).hexdigest()[:15], 16) for d, t, _ in rows]
    out = []
    for i, (d, _, s) in enumerate(rows):
        copies = int(target[s] // total[s]) if total[s] else 0
        budget = target[s] - copies * total[s]
        upto = sum(size[j] for j in range(len(rows)) if rows[j][2] == s and h[j] <= h[i])
        here = sum(size[j] for j in range(len(rows)) if rows[j][2] == s and h[j] == h[i])
        more = upto <= budget or upto - here <= budget and upto - budget < budget - (upto - here)
        out.append((str(d), size[i], total[s], round(target[s], 6), size[i] * min(3, copies + more)))
    return sorted(out)


@pytest.mark.parametrize("n", [0, 3, 90])
def test_mixing(spark, n):
    rows = [(d, t, ["b", None, "aa", "é", "Z", "empty"][d * d % 6]) for d, t in corpus(n)] + [(d, t, "b") for d, t in AWKWARD] * (n > 0) + [(7000, None, "nothing")] * (n > 0)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("hash", F.lit("x")).withColumn("copies", F.lit(1))
    got = mixing.mix(df)
    assert sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6), r.taken) for r in got.collect()) == (brute_mix(rows) if n else [])
    if n:
        again = mixing.mix(df.repartition(7))
        assert got.exceptAll(again).count() == 0
        words = mixing.mixed(df)
        assert words.columns == df.columns
        taken = words.agg(F.sum(mixing.words("text"))).first()[0]
        assert taken == got.agg(F.sum("taken")).first()[0] and words.groupBy("doc_id", "text").count().where("count > 6").count() == 0


# SimHash


def brute_fingerprint(text, n=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, fp, most=4):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= most:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(rows))]


def test_fingerprints():
    for _, t in AWKWARD + corpus(40):
        assert simhash.fingerprint(t) == brute_fingerprint(t) and simhash.fingerprint(t, 5) == brute_fingerprint(t, 5)


def test_simhash(spark):
    rows = AWKWARD + [(1000 + d, t) for d, t in corpus(100)]
    fp = [brute_fingerprint(t) for _, t in rows]
    got = simhash.near_duplicates(table(spark, rows))
    assert sorted((str(r.doc_id), r.node & (1 << 64) - 1, r.component_id) for r in got.collect()) == sorted((str(d), f, c) for (d, _), f, c in zip(rows, fp, brute_components(rows, fp), strict=True))
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_links_of_crowded_fingerprints(spark):
    """Chains and balls of near fingerprints, as components of brute force."""
    rng = np.random.default_rng(3)
    seed = [int(x) for x in rng.integers(0, 2**63, 6)]
    fps = set(seed)
    for s in seed:
        x = s
        for _ in range(60):
            x ^= 1 << int(rng.integers(0, 64))
            fps.add(x)
            fps.add(s ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))))
            fps.add(x ^ int(sum(1 << int(b) for b in rng.choice(64, 5, replace=False))))
    fps = sorted(fps)
    for most in (0, 2, 4):
        edges = simhash.links(spark.createDataFrame([(simhash.signed(f),) for f in fps], "node long"), most).collect()
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= most for r in edges)
        comp = brute_components([(i, None) for i in range(len(fps))], fps, most)
        root = {simhash.signed(f): simhash.signed(f) for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in edges:
            root[find(r.a)] = find(r.b)
        mine = defaultdict(set)
        for i, f in enumerate(fps):
            mine[find(simhash.signed(f))].add(i)
        assert {min(x) for x in mine.values()} == set(comp) and all(len({comp[i] for i in x}) == 1 for x in mine.values())


def test_tally_rejects_and_each_pair_is_found_once():
    """Of a list of three shared bytes only pairs with a fourth go on, each in one list."""
    rng = np.random.default_rng(12)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    three = a ^ np.uint64(0x0101010101000000)  # five bytes differ, by one bit each
    four = a ^ np.uint64(0x0101010100000000)
    assert not simhash.near(a, three, 8).any() and simhash.near(a, four, 4).all() and not simhash.near(a, four, 3).any()
    fps = np.unique(np.concatenate([a, three, four]))
    found = []
    for choice in range(len(simhash.CHOICES)):
        key = fps & simhash.MASKS[choice]
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        for x, y in simhash.list_links(fps[order], np.append(starts, len(fps)), np.full(len(starts), choice), 4):
            found += [tuple(sorted(p)) for p in zip(x.tolist(), y.tolist(), strict=True)]
    want = {(int(x), int(y)) for i, x in enumerate(fps) for y in fps[i + 1 :] if (int(x) ^ int(y)).bit_count() <= 4}
    assert len(found) == len(set(found)) and set(found) == want and len(want) >= 600


def graded_texts():
    """Texts and versions of them with more and more words changed, a crowd of near copies, and a common passage."""
    rng = np.random.default_rng(11)
    word = lambda: f"w{int(rng.integers(0, 10**6))}"
    passage = [word() for _ in range(60)]
    texts = []
    for size in (20, 60, 150):
        for _ in range(12):
            base = [word() for _ in range(size)]
            texts.append(base)
            for part in (0.05, 0.1, 0.14, 0.18, 0.25):
                start = int(rng.integers(0, size))
                other = list(base)
                for k in range(int(part * size)):
                    other[(start + k) % size] = word()
                texts.append(other)
    crowd = [word() for _ in range(100)]
    for k in range(60):
        other = list(crowd)
        other[k] = word()
        other[(37 * k + 11) % 100] = word()
        texts.append(other)
    texts += [passage + [word() for _ in range(int(rng.integers(5, 40)))] for _ in range(60)]
    return [(d, " ".join(t)) for d, t in enumerate(texts)]


def brute_similar(rows, similarity=0.8, n=5):
    """Root (a row's number) of each row: links at Jaccard similarities of whole shingle sets."""
    sets, root = [set(simhash.shingle_hashes(t, n).tolist()) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or both and both / (len(a) + len(sets[j]) - both) >= similarity:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_similarity_equals_brute(spark, similarity):
    rows = [r for r in AWKWARD if r[0]] + [(1000 + d, t) for d, t in graded_texts() + corpus(60)]
    roots = brute_similar(rows, similarity)
    least = {}
    for (d, _), r in zip(rows, roots, strict=True):
        least[r] = min(least.get(r, d), d if d is not None else 10**9)
    got = simhash.near_duplicates(table(spark, shuffled(rows)), n=5, similarity=similarity)
    assert sorted((str(r.doc_id), r.component_id) for r in got.collect()) == sorted((str(d), least[r]) for (d, _), r in zip(rows, roots, strict=True))
    assert simhash.near_duplicates(table(spark, []), similarity=similarity).count() == 0


def test_fingerprints_link_before_shingles_do(spark, monkeypatch):
    """With the search by shared shingles left out, what the fingerprints' index finds and the sets confirm is linked."""
    rows = [(d, t) for d, (_, t) in enumerate(graded_texts() + corpus(60))]
    fp, sets = [brute_fingerprint(t, 5) for _, t in rows], [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    least = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and least[i] != least[j]:
                low, high = sorted((least[i], least[j]))
                least = [low if x == high else x for x in least]
    monkeypatch.setattr(simhash, "TURNS", 0)
    monkeypatch.setattr(simhash, "unlike_pairs", lambda lists, similarity: spark.createDataFrame([], "a long, b long, row_a long, row_b long"))
    got = simhash.near_duplicates(table(spark, shuffled(rows)), n=5, similarity=0.8)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == list(enumerate(least))
    sizes = [least.count(x) for x in set(least)]
    assert sum(n > 1 for n in sizes) > 5 and len({sets.index(s) for s in sets}) > len(sizes)  # sets that differ were linked


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-40, 40, (50, 2))] + [(k, k + 1) for k in range(100, 130)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert got == {x: r for x, r in root.items() if x != r}


# Search


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("list", F.lit("x")).withColumn("q", F.lit(1))


def test_search(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, x[7].tolist()) for i in range(300)]
    bad = [(3000, None), (3020, [0.0] * 24), (3040, [float("nan")] + [1.0] * 23), (3060, [None] + [1.0] * 23), (3080, [float("inf")] * 24), (3100, [1.0] * 3)]
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = defaultdict(list)
    for r in ann.search(vectors(spark, rows + bad), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    asked = [int(i) for i in ids if i % 20 == 0]
    assert sorted(got) == asked
    found = 0
    for q in asked:
        s = m @ m[ids == q][0]
        order = [i for i in np.lexsort((ids, -np.round(s, 9))) if ids[i] != q][:20]
        mine = got[q]
        assert [r["rank"] for r in mine] == list(range(1, 21)) and len({r.vec_id for r in mine}) == 20
        assert all(abs(r.score - s[ids == r.vec_id][0]) < 1e-9 for r in mine) and all(a.score > b.score or a.vec_id < b.vec_id for a, b in zip(mine, mine[1:], strict=False))
        found += len({r.vec_id for r in mine} & set(ids[order].tolist()))
    assert found >= 0.9 * 20 * len(asked)


def test_equal_vectors_come_by_id(spark):
    """One vector 31 times among others, at 64 dimensions: equal scores to the last bit, ids ascending."""
    for seed in range(4):
        rng = np.random.default_rng(seed)
        x = rng.standard_normal((1500, 64)).astype(np.float32)
        rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i if i else 7, (x[40] * 1.5).tolist()) for i in range(31)]
        rows = [r for r in rows if r[0] != 7 or r[1] != x[7].tolist()]
        got = ann.search(vectors(spark, rows), F.col("vec_id") == 40).orderBy("rank").collect()
        assert [r.vec_id for r in got] == [7, *range(5001, 5020)] and len({r.score for r in got}) == 1


def test_search_of_clusters_visits_few_lists(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 32))
    x = (centres[rng.integers(0, 40, 4000)] + 0.15 * rng.standard_normal((4000, 32))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    space = ann.Space(x, 1.0, 32)
    assert space.probes(x, len(x), 20) <= 8
    found, asked = 0, list(range(0, 4000, 100))
    got = defaultdict(set)
    for r in ann.search(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].add(r.vec_id)
    for q in asked:
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -9
        found += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert found >= 0.9 * 20 * len(asked)


def test_search_small(spark):
    got = ann.search(vectors(spark, [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [-1.0, 2.0]), (3, [-1.0, 2.0])]), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 20, 0.5), (0, 2, 3, -1.0), (0, 3, 3, -1.0), (20, 1, 0, 0.5), (20, 2, 3, 0.5), (20, 3, 3, 0.5)]
    for rows in ([], [(0, None)], [(0, [1.0])]):
        assert ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0).count() == 0


def test_scan_equals_brute():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 65))
    misses, q = 0, rng.standard_normal((20, 65))
    away = ((x[None, :, :] - q[:, None, :]) ** 2).sum(2)
    for r in (np.full(20, np.inf), np.sort(away, axis=1)[:, 40], np.sort(away, axis=1)[:, 9] * (1 + 1e-12)):
        i, j = ann.scan(ann.column_blocks(x), q, r, 10)
        for n in range(20):
            misses += len(set(np.argsort(away[n])[:10].tolist()) - set(j[i == n].tolist()))
        assert len(i) < (700 if r[0] < np.inf else 250)
    assert misses <= 12


# Pipeline


def test_pipeline(spark, tmp_path):
    rows = distinct(AWKWARD[:-2] + [(1000 + d, t) for d, t in corpus(80)])
    docs = table(spark, rows, clash=False)
    (tmp_path / "sf").mkdir()
    docs.write.parquet(f"{tmp_path}/sf/documents.parquet")
    at = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        after = common.stored(stage(spark, at, f"{tmp_path}/sf"))
        if name != "packing":
            assert after.dtypes == docs.dtypes, name
        kept.append([(r.doc_id, r.text) for r in after.collect()] if name != "packing" else after.collect())
        at = after
    want = [(d, t) for d, t in rows if not any(r(quality.Features(t)) for r in quality.RULES.values())]
    assert sorted(kept[0]) == sorted(want)
    lines = brute_lines(want)
    assert dict(kept[1]) == lines and len(kept[1]) == len(want)
    left = sorted(lines.items())
    roots = brute_similar(left)
    first = {r: min(d for (d, _), x in zip(left, roots, strict=True) if x == r) for r in set(roots)}
    single = [(d, t) for (d, t), r in zip(left, roots, strict=True) if first[r] == d]
    assert sorted(kept[2]) == single and len(single) < len(left)
    sources = {r.doc_id: r.source for r in docs.collect()}
    taken = {d: n for d, *_, n in brute_mix([(d, t, sources[d]) for d, t in single])}
    words = defaultdict(int)
    for d, t in kept[3]:
        words[str(d)] += len(t.split())
    assert all(words[d] == n for d, n in taken.items())
    assert sum(r.length for r in kept[4]) == sum(r.doc_tokens for r in kept[4] if r.start == 0)
    assert {r.doc_id for r in kept[4]} == {d for d, _ in kept[3]}
    run = corpus_pipeline.run(spark, f"{tmp_path}/sf")
    assert run.count() == len(kept[4]) and len(corpus_pipeline.STAGES) == 5


def test_near_dedup_keeps_one_row_of_each_group(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(None, a), (None, a), (4, b), (4, b), (9, b + " more"), (None, b), (1, c), (7, c), (7, d), (8, d + " more"), (None, None), (3, "")]
    docs = table(spark, rows, clash=False).withColumn("row_id", F.lit("x"))
    got = corpus_pipeline.near_deduplication(spark, docs, "")
    assert got.dtypes == docs.dtypes
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted([("None", a), ("4", b), ("1", c), ("7", d), ("3", "")])
    assert corpus_pipeline.near_deduplication(spark, docs.limit(0), "").count() == 0


def test_ann_rows_are_rows(spark):
    """Null ids are candidates, never queries; rows that share an id are candidates and queries each."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((200, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[20].tolist()), (None, x[3].tolist()), (20, (2 * x[20]).tolist()), (20, x[20].tolist()), (2**60 + 1, x[40].tolist())]
    got = ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=6, probes=1.0).collect()
    full = np.array([v for _, v in rows], np.float32).astype(np.float64)
    expected = []
    for q, (i, _) in enumerate(rows):
        if i is None or i % 20:
            continue
        scored = sorted((-float(full[q] @ full[j]), 2**63 if rows[j][0] is None else rows[j][0], j) for j in range(len(rows)) if j != q)
        expected += [(i, n, rows[j][0]) for n, (_, _, j) in enumerate(scored[:6], 1)]
    key = lambda r: tuple(-1 if c is None else c for c in r)
    assert sorted(((r.query_id, r.rank, r.vec_id) for r in got), key=key) == sorted(expected, key=key)
    assert sum(r.query_id == 20 for r in got) == 18


def test_ann_first_distance_holds(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 6))
    space = ann.Space(x[:200], float(np.linalg.norm(x, axis=1).max()), 8)
    r, q, all_ = space.first_r(x[150:260], 5), space.queries(x[150:260]), space.rows(x)
    distance = ((q[:, None, :] - all_[None, :, :]) ** 2).sum(2)
    distance[np.arange(110), np.arange(150, 260)] = np.inf
    assert (np.sort(distance, axis=1)[:, 4] <= r).all()
