"""Near words against a comparison of all pairs."""

import random
import zlib
from collections import Counter

import numpy as np
from helpers import AWKWARD, corpus, table

from termloom.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {w: (min(near[w], key=lambda x: (-counts[x], x)) if near[w] else None) for w in counts}
    form = {w: f if f and counts[f] >= 5 * counts[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def words_of(rows):
    import re

    counts = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def told(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def random_words(n, seed):
    rng, words = random.Random(seed), {}
    while len(words) < n:
        w = "".join(rng.choice("abcÀéÿ") for _ in range(rng.randrange(5, 8)))
        for _ in range(3):
            words[w] = rng.choice([5, 7, 30, 160, 900, 5000])
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1 :]])
    return words


def test_all_pairs(spark, tmp_path):
    words = random_words(400, 2)
    spark.createDataFrame(list(words.items()), "word string, n long").write.parquet(f"{tmp_path}/w")
    stored = spark.read.parquet(f"{tmp_path}/w")
    expected = brute(words)
    assert told(spelling.variants(stored)) == expected
    assert sum(r[1] is not None for r in expected) > 50 and any(r[1] != r[2] for r in expected if r[1])
    assert told(spelling.variants(stored, bits=18)) == expected  # whatever the filter holds back


def test_a_full_filter_loses_nothing():
    words, letters = ["abcabc", "cabcab"], np.array([97, 98, 99], np.uint64)
    everything = lambda h: np.arange(h.size)
    for w, got in zip(words, spelling.neighbours(words, letters, everything), strict=True):
        cuts = {w[:i] + w[i + 1 :] for i in range(6)}
        swaps = {w[:i] + c + w[i + 1 :] for i in range(6) for c in "abc"} - {w}
        adds = {w[:i] + c + w[i:] for i in range(7) for c in "abc"}
        assert got == cuts | swaps | adds


def test_hashes_of_neighbours_are_hashes_of_strings():
    """What passes for a filter of exactly these strings is all of them."""
    w, letters = "aébÿéa", np.array(sorted(map(ord, "aébÿ")), np.uint64)
    wanted = {"aébÿé", "ébÿéa", "aéébÿéa", "aébÿéaa", "bébÿéa", "aébÿéb", "aaébÿéa", "aéÿÿéa"}
    keys = np.array(spelling.hashes(sorted(wanted)))
    assert spelling.neighbours([w], letters, lambda h: np.flatnonzero(np.isin(h.ravel(), keys))) == [wanted]


def test_chains_end_at_the_last_form(spark, tmp_path):
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb", "bbbbbb", "bbbbbc", "bbbbcc", "bbbccc", "bbcccc", "bccccc", "cccccc"]
    words = {w: 5**k for k, w in enumerate(chain, 1)}
    spark.createDataFrame(list(words.items()), "word string, n long").write.parquet(f"{tmp_path}/w")
    got = told(spelling.variants(spark.read.parquet(f"{tmp_path}/w")))
    assert got == brute(words) and {r[2] for r in got} == {chain[-1]}


def test_many_variants_of_one_word(spark, tmp_path):
    base = "abcdefgh"
    words = {base: 10_000} | {base[:i] + c + base[i:]: 5 for i in range(9) for c in "abcdefghijklmnop"}
    spark.createDataFrame(list(words.items()), "word string, n long").write.parquet(f"{tmp_path}/w")
    assert told(spelling.variants(spark.read.parquet(f"{tmp_path}/w"))) == brute(words)


def test_documents(spark, tmp_path):
    long_word = "ab" * 1500
    rows = AWKWARD + corpus(150) + [(200 + k, f"{long_word} Straße STRASSE Straßen straße") for k in range(4)] + [(300 + k, f"{long_word[:-1]}c {long_word}") for k in range(5)] + [(None, None), (7, "")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = told(spelling.op13_spelling(spark, str(tmp_path)))
    assert got == brute(words_of(rows)) and any(len(r[0]) > 2000 for r in got)


def test_empty(spark):
    docs = table(spark, AWKWARD)
    assert spelling.spelling_variants(docs.limit(0)).collect() == []
    assert spelling.spelling_variants(docs.where("doc_id in (1, 2, 3)")).collect() == []
