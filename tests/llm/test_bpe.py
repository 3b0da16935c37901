"""Encoding and decoding against the library that the vocabulary is written for."""

import random
from array import array

import pytest
from helpers import AWKWARD, corpus, table

from termloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    ours = bpe.Bpe()
    return ours, tokenizers.Tokenizer.from_file(ours.path)


def check(both, texts):
    ours, library = both
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert list(ids) == expected, text[:200]
        assert ours.decode(ids) == library.decode(expected, skip_special_tokens=False)


SPECIAL = ["<|endoftext|>", "a<|startoftext|>b <|STARTOFTEXT|>", "<|endof<|endoftext|>", "e<|endoftext|>́", "<|endoftext|><|endoftext|>", "<"]
UNICODE = ["naïve Ünï", "ΟΔΟΣ Σ ΑΣ", "é é İ ǅ ß ẞ", "漢字 かな 🦊🦊 \U0001f1e9\U0001f1ea", "՘aᲉ࢏", "a b c​d", "٣½Ⅷ", "don't I'LL we'Ve 's 'S '' 'sS"]


def test_whole_texts(both):
    check(both, ["", " \n\t", "Hello  World", *SPECIAL, *UNICODE, *(t for _, t in AWKWARD if t), *(t for _, t in corpus(40))])


@pytest.mark.parametrize("alphabet", ["aabbecdth", "aeinrstlodhcu'é 1ßÄΣσ漢🦊́\n.-A", "x", "!?.,-*"])
def test_random_words(both, alphabet):
    rng = random.Random(len(alphabet))
    check(both, ["".join(rng.choice(alphabet) for _ in range(rng.randrange(70))) for _ in range(3000)])


def test_very_long_words(both):
    check(both, ["ab" * 50_000, "é" * 30_000, "x" * 100_000, "a 1" * 20_000, "!" * 50_000])


def test_only_failing_words_are_merged(both):
    ours = bpe.Bpe()
    words = [w for w in ours.name_of if w and w not in ours.special]
    whole = [w.removesuffix("</w>") for w in words if w.endswith("</w>") and w.isascii() and w.removesuffix("</w>").isalpha()][:5000]
    ours.encode_words(whole)
    assert ours.merged == 0
    assert [len(x) for x in ours.encode_words(whole)] == [1] * len(whole)


def test_verdict_of_each_pair(both):
    """Compatible exactly where merging both tokens' characters gives the two tokens."""
    ours, rng = both[0], random.Random(4)
    inner = [(t, i) for t, i in ours.inner.items() if len(t) < 6]
    ending = [(t, i) for t, i in ours.ending.items() if len(t) < 6]
    pairs = [(rng.choice(inner), rng.choice(ending)) for _ in range(20_000)]
    import numpy as np

    got = ours.compatible(np.array([a[1] for a, _ in pairs]), np.array([b[1] for _, b in pairs]))
    assert got.tolist() == [ours.merge(a[0] + b[0]) == [a[1], b[1]] for a, b in pairs]
    assert 0 < got.sum() < len(pairs)


def test_merging_together_is_merging_alone(both):
    ours, rng = both[0], random.Random(6)
    words = ["".join(rng.choice("abcdeinrst") for _ in range(rng.randrange(1, 100))).encode() for _ in range(2000)]
    assert ours.merged_words(words) == [ours.merge(w) for w in words]


def test_words_without_order_of_ranks_are_merged(both):
    ours = bpe.Bpe()
    ours.ordered = False
    assert ours.encode_words(["hello", "unverified"]) == both[0].encode_words(["hello", "unverified"]) and ours.merged == 2


def test_kept_words_are_bounded(both, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    ours = bpe.Bpe()
    texts = [t for _, t in corpus(60)]
    assert [ours.encode([t])[0] for t in texts] == both[0].encode(texts)
    assert len(ours.words) <= 50 + max(len(set(t.split())) for t in texts)


def test_tables(spark, both):
    docs = table(spark, AWKWARD)
    encoded = bpe.encode(docs, back=True).collect()
    expected = sorted(((d, both[0].encode([t])[0]) for d, t in AWKWARD), key=str)
    assert sorted(((r.doc_id, array("I", bytes(r.ids))) for r in encoded), key=str) == expected
    assert all(r.n_tokens == len(r.ids) // 4 and r.text == both[0].decode(array("I", bytes(r.ids))) for r in encoded)
    assert sorted(map(str, bpe.decode(bpe.encode(docs)).collect())) == sorted(str(r) for r in bpe.encode(docs, back=True).select("doc_id", "text").collect())
    assert bpe.encode(docs.limit(0)).collect() == [] and bpe.decode(bpe.encode(docs.limit(0))).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, b""), (3, array("I", [320]).tobytes())], "doc_id long, ids binary")
    assert [r.text for r in bpe.decode(nulls).orderBy("doc_id").collect()] == [None, "", "a</w>"]


def test_batches_cut_anywhere(spark, both, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH", 100)
    docs = table(spark, corpus(50))
    assert {(r.doc_id, bytes(r.ids)) for r in bpe.encode(docs).collect()} == {(d, both[0].encode([t])[0].tobytes()) for d, t in corpus(50)}


def test_query(spark, both, tmp_path):
    import hashlib

    table(spark, AWKWARD).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in bpe.op12_bpe(spark, str(tmp_path)).collect()}
    expected = set()
    for d, t in AWKWARD:
        ids = both[1].encode(t or "", add_special_tokens=False).ids
        text = both[1].decode(ids, skip_special_tokens=False)
        expected.add((d, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == expected
