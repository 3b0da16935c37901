"""PII, licenses, quality rules, language id and packing, row by row."""

import hashlib
import re
import struct
import time
import zlib

import pytest
from helpers import AWKWARD, corpus, table

from termloom.llm import langid, licenses, packing, pii, quality

# PII


def brute_base(text):
    """The contract's patterns, plainly."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


TRICKY = [
    "a@b.c@d.e x@y @z.z q@.r a@b..c u@v.w.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004 1.2.3 9.9.9.9999", "4111 1111 1111 1111 and 4111-1111-1111-1112 5", "+1 (499) 555-6503 +12 +1234567890123456 ++49 30 1234567",
    "mail: joe.99@mail5.example.com, ip 84.251.36.42", "4111111111111111@x.yz", "é+1 499 555 6503é", "%@-.-", "1" * 300 + ".1.1.1",
]


@pytest.mark.parametrize("text", TRICKY + [t for _, t in AWKWARD if t])
def test_patterns(text):
    assert [s[:3] for s in pii.base_spans(text)] == brute_base(text)


def test_patterns_random():
    import random

    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice("a@.-1 9+(%4") for _ in range(rng.randrange(40)))
        assert [s[:3] for s in pii.base_spans(text)] == brute_base(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "1 " * 150_000):
        pii.base_spans(text)


def test_disclosure(spark):
    filler = [(100 + k, f"common words stand here number {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]} every time") for k in range(60)]
    rows = [(1, "we met Zebulon common at zeb@corp.example today"), (2, "ask zebulon there zeb@corp.example common please"), (3, "copy rareword uno@x.example"), (4, "copy rareword uno@x.example"), *filler]
    got = {r.doc_id: r for r in pii.sensitive(table(spark, rows), support=2).collect()}
    kinds = {d: [(rows[d - 1][1][s.start : s.end], s.kind) for s in got[d].all_spans] for d in (1, 2, 3, 4)}
    assert ("Zebulon", 5) in kinds[1] and ("zebulon", 5) in kinds[2] and ("common", 5) not in kinds[1]
    assert kinds[3] == kinds[4] == [("uno@x.example", 0)]  # copies are no evidence
    assert all(not got[d].all_spans for d, _ in filler)
    clean = {r.doc_id: r.text for r in pii.sanitise(table(spark, rows, clash=False)).collect()}
    assert clean[1] == "we met  common at [EMAIL] today" and clean[100] == rows[4][1]


def test_disclosure_reaches_whole_documents(spark):
    far = [" ".join(f"{a}{b}" for b in ("cat", "dog", "cow", "hen", "ant", "elk", "owl", "bee", "fox", "ape") for a in x) for x in (["red", "wet"], ["old", "raw"])]
    rows = [(1, f"Zebulon heads this page\n{far[0]} zeb@corp.example {far[0]} again Zebulon"), (2, f"{far[1]} zeb@corp.example {far[1]} and zebulon"), (3, "Zebulon without an address")]
    rows += [(100 + k, f"heads this page again and common words {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}") for k in range(90)]
    got = {r.doc_id: r for r in pii.sensitive(table(spark, rows)).collect()}
    tagged = {d: [(s.start, t[s.start : s.end]) for s in got[d].all_spans if s.kind > 3] for d, t in rows}
    assert tagged[1] == [(m.start(), "Zebulon") for m in re.finditer("Zebulon", rows[0][1])] and len(tagged[1]) == 2
    assert [x for _, x in tagged[2]] == ["zebulon"] and not any(tagged[d] for d, _ in rows[2:])


def brute_disclosure(texts, support=2, general=0.8, remove=0.9):
    """Spans of each text, by counting documents plainly."""
    import math
    from collections import defaultdict

    spans = [pii.base_spans(t or "") for t in texts]
    entities = [{(s[1], s[3]) for s in x} for x in spans]
    split = [pii.terms(t or "", x) for t, x in zip(texts, spans, strict=True)]
    words = [set(pii.utf8(t).translate(pii.TERMS).split()) for t in texts]
    holds, n_et, contexts, out = defaultdict(int), defaultdict(int), defaultdict(set), []
    for e in entities:
        for x in e:
            holds[x] += 1
    for e, (found, context) in zip(entities, split, strict=True):
        for x in e:
            for term in {f[0] for f in found}:
                n_et[x, term] += 1
                contexts[x, term].add(context)
    n_t = defaultdict(int)
    for w in words:
        for term in {pii.key(x) for x in w}:
            n_t[term] += 1
    n = len(texts)
    kinds = {}
    for (x, term), k in n_et.items():
        if k >= support and support <= holds[x] < n and len(contexts[x, term]) > 1:
            share = math.log2(k * n / (holds[x] * n_t[term])) / math.log2(n / holds[x])
            if share >= general:
                kinds[x, term] = 5 if share >= remove else 4
    for e, x, (found, _) in zip(entities, spans, split, strict=True):
        more = [(a, max(kinds[y, t] for y in e if (y, t) in kinds), b) for t, a, b in found if any((y, t) in kinds for y in e)]
        out.append(sorted([s[:3] for s in x] + more))
    return out


def test_disclosure_equals_brute_force(spark):
    import random

    rng = random.Random(21)
    vocab = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "su") for b in ("ra", "no", "vi") for c in ("n", "s", "th", "la")]
    people = [(f"p{k}@corp.example", rng.sample(vocab, 4)) for k in range(12)] + [("84.1.2.3", rng.sample(vocab, 2))]
    rows = []
    for d in range(150):
        text = [rng.choice(vocab[:30]) for _ in range(rng.randrange(0, 25))]
        for who, own in rng.sample(people, rng.choice((0, 0, 1, 1, 2))):
            text += [who, *(w for w in own if rng.random() < 0.8)]
        rng.shuffle(text)
        rows.append((rng.choice((d, None, 5)), " ".join(text)))
    rows += rows[:10] + [(1, None), (2, "")]
    want = brute_disclosure([t for _, t in rows])
    got = pii.sensitive(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), [tuple(s) for s in r.all_spans]) for r in got) == sorted((str(d), s) for (d, _), s in zip(rows, want, strict=True))
    assert {k for s in want for _, k, _ in s} >= {0, 1, 4, 5}


def test_sanitise_goes_by_text(spark):
    rows = [(None, "mail joe@corp.example now"), (5, "call joe@corp.example"), (5, "call just text"), (5, "call joe@corp.example"), (6, None), (7, "")]
    docs = table(spark, rows)
    got = pii.sanitise(docs.withColumnRenamed("h", "spans"))
    assert "spans" in got.columns and got.count() == len(rows)
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted([("None", "mail [EMAIL] now"), ("5", "call [EMAIL]"), ("5", "call just text"), ("5", "call [EMAIL]"), ("6", "None"), ("7", "")])


def test_pii_awkward(spark):
    got = pii.sensitive(table(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() and not r.all_spans for r in got)
    assert pii.sensitive(table(spark, [])).count() == 0
    assert pii.redact("0123456789", [(2, 0, 5), (4, 1, 6), (7, 5, 8)]) == "01[EMAIL]689"


# Licenses


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in licenses.PINNED.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


LICENSES = [
    "CC BY 4.0 and cc-by-cc-by", "GNU General Public License version 3, all rights reserved. All Rights Reserved", "SPDX-License-Identifier: Apache-2.0", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0",
    "the general publicist license", "allrights reserved", "BSD 3-Clause", "Creative Commons Attribution ShareAlike", "ccby by cc", "http://www.apache.org/licenses/LICENSE-2.0",
]


def test_licenses(spark):
    rows = [(100 + i, t) for i, t in enumerate(LICENSES)] + AWKWARD
    got = licenses.scan(table(spark, rows), spans=True).collect()
    for r, (d, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words)), sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(t), t
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    labels = {r.doc_id: r.labels for r in got}
    assert labels[100] == "cc-by,cc-by-4.0" and labels[102] == "apache-2.0" and "mit" in labels[103] and "apache-2.0" in labels[104] and labels[105] == "" and labels[110] == "apache-2.0"
    assert "cc-by-sa" in labels[108] and "cc-any" not in labels[108]  # contained in a better one
    assert licenses.scan(table(spark, [])).count() == 0


def test_suppression_brute():
    for text in LICENSES:
        line = licenses.normalise(text)
        got = {(a, b, r.label) for a, b, r in licenses.detections(line) if not r.pinned}
        everything = [(m.start() + 1, m.end(), i, r) for i, r in enumerate(licenses.rules()) if not r.pinned and r.keyword in line for m in r.pattern.finditer(line)]
        better = lambda x, y: (x[3].priority, x[1] - x[0], -x[2]) > (y[3].priority, y[1] - y[0], -y[2])
        want = {(a, b, r.label) for x in everything for a, b, _, r in [x] if not any(y is not x and better(y, x) and y[0] <= a and b <= y[1] for y in everything)}
        assert got == want, text
    assert len(licenses.rules()) > 300


def test_licenses_of_very_long_texts(spark):
    """Time grows with the text, not with its detections' product."""
    text = "cc by x all rights reserved, under the terms of the Apache License 2.0; " * 140_000
    t = time.perf_counter()
    (r,) = licenses.scan(table(spark, [(1, text)], clash=False), spans=True).collect()
    assert time.perf_counter() - t < 40 and len(text) > 10_000_000
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (15 * 140_000, 280_000, 0, 15 * 139_999 + 3)
    assert r.base_labels == "cc-by,reserved" and {(x.first_word, x.n_words) for x in r.spans[:3]} == {(0, 2), (3, 3), (6, 6)}


# Quality


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_quality(spark):
    rows = AWKWARD + corpus(25) + [(900, "good text " * 3 + "### $$$ " * 20), (901, "same line here\n" * 30 + "x"), (902, "1234 5678 " * 20)]
    got = quality.quality(table(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((d if d is not None else 10**9, *brute_quality(t)) for d, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else 10**9, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert not {r.doc_id for r in got if r.kept} & {900, 901, 902}
    kept = quality.keep_good(table(spark, rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept) and kept.columns == table(spark, rows).columns
    assert quality.quality(table(spark, [])).count() == 0 and sorted(quality.estimate(table(spark, []))) == sorted(quality.RULES)


def test_line_rules():
    f = quality.Features
    assert quality.RULES["bullet_lines"](f("- a b\n * c\n\u2022d\n")) and not quality.RULES["bullet_lines"](f("- a\n- b\nc"))
    assert quality.RULES["ellipsis_lines"](f("one...\ntwo\u2026 \t\nthree")) and not quality.RULES["ellipsis_lines"](f("one..\ntwo\nthree"))
    assert quality.RULES["few_unique_words"](f("a b c " * 30)) and not quality.RULES["few_unique_words"](f("a b c " * 10))


def test_order_never_changes_the_verdict(spark):
    rows = table(spark, AWKWARD + corpus(20))
    names = list(quality.RULES)
    a, b = (sorted(str(r.doc_id) for r in quality.keep_good(rows, order=o).collect()) for o in (names, names[::-1]))
    assert a == b
    order = quality.estimate(rows)
    assert sorted(order) == sorted(names)


# Language


def brute_profile(text, top):
    from collections import Counter

    words = re.findall(r"[^\W\d_]+", text.lower())
    c = Counter()
    joined = " " + " ".join(words) + " "
    for n in (1, 2, 3):
        for i in range(len(joined) - n + 1):
            g = joined[i : i + n]
            if (n == 1 and g != " ") or (n == 2) or (n == 3 and g[1] != " "):
                c[g] += 1
    key = lambda g: sum(ord(ch) << 21 * (len(g) - 1 - i) for i, ch in enumerate(g))
    return [key(g) for g, _ in sorted(c.items(), key=lambda x: (-x[1], key(x[0])))[:top]]


def test_profiles():
    for text in ("Der Hund, die Katze und der Hund", "a", "12 ab-cd_ef", "東京 ÜBER straße", "abc " * 400):
        assert langid.profile(*langid.ngram_counts(text), 30).tolist() == brute_profile(text, 30)


def test_languages(spark):
    import random

    rng = random.Random(2)
    vocab = {"xx": ["ka", "kala", "mokala", "lamo"], "yy": ["zu", "zuri", "tizuri", "rit"]}
    rows = [(d, " ".join(rng.choice(vocab[lang]) for _ in range(20)), lang, "s", 0) for d in range(60) for lang in [("xx", "yy")[d % 2]]]
    rows += [(1000, None, "xx", "s", 0), (1001, "123 !!", "yy", "s", 0), (1002, "kala mokala", None, "s", 0), (1003, "", "xx", "s", 0), (None, "zuri tizuri", "yy", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    profiles = langid.learn(docs.where(~langid.held_out("doc_id")))
    got = {r.doc_id: r for r in langid.identify(docs, profiles).collect()}
    assert all(got[d].lang_pred == lang for d, _, lang, _, _ in rows[:60]) and got[1002].lang_pred == "xx" and got[None].lang_pred == "yy"
    assert [got[d].lang_pred for d in (1000, 1001, 1003)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    held = {r.doc_id for r in docs.where(langid.held_out("doc_id")).collect()}
    assert held == {d for d, *_ in rows if d is not None and zlib.crc32(str(d).encode()) % 5 == 0}
    assert langid.learn(docs.limit(0)) == {} and langid.identify(docs, {}).where("lang_pred <> 'und'").count() == 0
    model = langid.Model(profiles)
    own = langid.profile(*langid.ngram_counts(rows[0][1])).tolist()
    away = {lang: sum(abs(i - p.index(k)) if k in p else langid.TOP for i, k in enumerate(own)) for lang, p in profiles.items()}
    assert model.predict(rows[0][1])[0] == min(away, key=lambda x: (away[x], x))


# Packing


def full_ids(text, tok):
    return tok.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def check_packing(got, rows, plain, limit=2048, segments=512):
    """Every id in exactly one piece, sequences gapless and within limits."""
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(full_ids(t, plain))
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids = texts[d][0]
        cover = sorted((p.start, p.length) for p in pieces)
        n = len(texts[d])
        assert sum(x for _, x in cover) == len(ids) * n and all(p.doc_tokens == len(ids) for p in pieces)
        for p in pieces:
            part = ids[p.start : p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part)) and len(part) == p.length > 0
        if n == 1:
            at = 0
            for s, x in cover:
                assert s == at
                at += x
    pad = 0
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limit and len(seq) <= segments
        pad += 0 if at & (at - 1) == 0 else limit - at
    return pad


def test_packing(spark, plain):
    rows = AWKWARD[:8] + AWKWARD[9:10] + corpus(150) + [(5000, "long words of text " * 9000), (5001, "ends <|endoftext|> here"), (5002, "a\n\n  b \t c\xa0 d　e \x1c f")]
    rows = [r for i, r in enumerate(rows) if r[0] not in [x[0] for x in rows[:i]]] + [(5001, "ends <|endoftext|> here")]
    got = packing.pack(table(spark, rows)).collect()
    total = sum(r.length for r in got)
    assert check_packing(got, rows, plain) <= 0.01 * total
    assert packing.pack(table(spark, [])).count() == 0
    whole = packing.pack(table(spark, rows), cut=False, max_segments=7).collect()
    check_packing(whole, rows, plain, segments=7)
    assert all(r.length == min(2048, r.doc_tokens - r.start) for r in whole)


def test_tokenizer_equals_its_library(plain):
    tok = packing.Tokenizer()
    for text in [t for _, t in AWKWARD + corpus(30) if t] + ["don't we'LL 3.14  x\n\n y ", "İßẞ á \U0001f469‍\U0001f4bb", " lead", "trail  ", "\r\n\x0b\x85 x"]:
        assert list(tok.ids(text)) == plain.encode(text, add_special_tokens=False).ids, text
    old, packing.PART = packing.PART, 50
    try:
        for _, text in corpus(20):
            assert list(tok.ids(text)) == plain.encode(text, add_special_tokens=False).ids
    finally:
        packing.PART = old


def test_loss_limit(spark):
    from pyspark.sql import functions as F

    df = table(spark, [(d, "answer words here " * 20) for d in range(40)], clash=False).withColumn("prompt", F.lit("question words " * 10))
    got = packing.pack(df, max_loss=300, prompt_col="prompt", cut=False).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    assert all(sum(r.n_loss for r in x) <= 300 for x in by.values()) and max(len(x) for x in by.values()) > 1


def test_the_same_vocabulary_has_the_same_verdict_at_any_length():
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    text = [rng.choice(words) for _ in range(30_000)]
    for n in (600, 4_990, 4_999, 5_000, 5_010, 30_000):
        assert not quality.RULES["few_unique_words"](quality.Features(" ".join(text[:n]))), n
    few = [w for w in text if w in words[:30]]
    assert len({quality.RULES["few_unique_words"](quality.Features(" ".join((few * 5)[:n]))) for n in (4_990, 5_010, 9_000)}) == 1


def test_rules_are_ordered_among_what_is_left(spark, monkeypatch):
    """The second rule rejects as much as the first, but only the same texts: the third comes before it."""
    rules = {"a": lambda x: "1" in x.text, "b": lambda x: "1" in x.text and x.n_letters >= 0, "c": lambda x: "2" in x.text}
    monkeypatch.setattr(quality, "RULES", rules)
    found = {0: (10, [1.0] * len(quality.FEATURES)), 3: (60, [1.0] * len(quality.FEATURES)), 4: (30, [1.0] * len(quality.FEATURES))}
    needs = {"a": {"words"}, "b": {"words", "n_letters"}, "c": {"words", "lines"}}
    monkeypatch.setattr(quality, "measure", lambda *a: (found, needs))
    assert quality.estimate(None, rules=("a", "b", "c")) == ["a", "c", "b"]


def test_the_sample_is_spread_over_the_rows(spark):
    rows = table(spark, [(k, "sorted " * 20 if k < 500 else "### " * 20) for k in range(1000)]).coalesce(1)
    found, needs = quality.measure(rows, sample=200)
    n = sum(x[0] for x in found.values())
    assert 100 < n < 320 and len(found) == 2 and min(x[0] for x in found.values()) > n // 4
    assert needs["symbols"] == {"words", "n_symbols"} and "lines" in needs["duplicate_lines"]
