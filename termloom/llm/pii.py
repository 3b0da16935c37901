"""Personal data: patterns, then information-theoretic sanitisation.

Pattern spans (email, ip, card, phone) name the protected entities.  A term of
the documents that hold an entity discloses it as far as their co-occurrence in
the corpus goes: with N documents, n(e) that hold the entity, n(t) that hold the
term and n(e,t) that hold both, the disclosure is

    PMI(e; t) / IC(e) = log2(n(e,t) N / (n(e) n(t))) / log2(N / n(e)),

the share of the entity's information that the term alone gives.  Terms with
enough support (at least two documents with different words, so copies of one
text are no evidence) whose share reaches a threshold are generalised, from a
higher threshold on removed, wherever they stand in a document that holds that
entity.

All counts cover whole documents, all of them.  n(t) is counted for terms of
documents with a supported entity only: a bitmap of fixed size (2 MB, whatever the corpus) lets other words be
skipped, and false hits of the bitmap fall out in the join that follows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, documents, hot_join, map_rows, ship, stored, utf8

KINDS = ("email", "ip", "card", "phone", "term-general", "term-remove")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Words: runs of A-Z, a-z and all beyond ASCII.
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
TERMS = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Shorter words are no terms.
SHORT = 3
BITS = 24


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def emails(text: str):
    """Leftmost, non-overlapping; each run of local characters is walked once."""
    low, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > low and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, entity) of the four patterns, by start, then kind."""
    out = [(a, 0, b, text[a:b].lower()) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(x) < 4 or not x[:-3].strip("0") for x in m.groups()) and all(int(x[-3:]) <= 255 for x in m.groups()):
            out.append((m.start(), 1, m.end(), m[0]))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in PHONE.finditer(text):
            digits = "".join(c for c in m[0] if "0" <= c <= "9")
            if 9 <= len(digits) <= 15:
                out.append((m.start(), 3, m.end(), digits))
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


def key(x: bytes) -> int:
    h = xxhash.xxh64_intdigest(x, 42)
    return h - (1 << 64) if h >> 63 else h


def terms(text: str, spans: list[tuple[int, int, int, str]]) -> tuple[list[tuple[int, int, int]], int]:
    """(term, start, end) of each word outside all spans, and a hash of the
    words, the same for copies."""
    out, words, known, at = [], [], {}, 0
    ends, last = [], 0  # spans by start, each with the furthest end so far
    for x in spans:
        last = max(last, x[2])
        ends.append(last)
    for m in TERM.finditer(text):
        word, (a, b) = m[0], m.span()
        while at < len(spans) and spans[at][0] < b:
            at += 1
        if at and ends[at - 1] > a:
            continue
        words.append(word)
        if word not in known:
            term = word.encode("utf-8", "replace").translate(LOWER)
            known[word] = key(term) if len(term) >= SHORT else None
        if known[word] is not None:
            out.append((known[word], a, b))
    return out, key(" ".join(words).encode("utf-8", "replace"))


FOUND = "row_id long, doc_id long, text_a long, text_b long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, terms array<struct<term:long,start:int,end:int>>, context long, entities array<long>"


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pattern spans of every row, and the terms of those that have any."""

    def make():
        def row(x):
            text = x[2] or ""
            spans = base_spans(text)
            n = [sum(s[1] == k for s in spans) for k in range(4)]
            yield *x[:2], *x[3:], *n, hashlib.sha256(joined(spans).encode()).hexdigest(), [s[:3] for s in spans], *(terms(text, spans) if spans else ([], 0)), list({key(f"{s[1]}:{s[3]}".encode("utf-8", "replace")) for s in spans})

        return row

    return map_rows(docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col), *text_keys(F.col(text_col))), make, FOUND, 1_000)


def text_keys(text: Column) -> list[Column]:
    """128 bits that tell texts apart; a text's spans depend on nothing else of its row."""
    return [F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit("pii"), text, F.lit("pii")).alias("text_b")]


def document_frequency(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n_t): documents that hold each of the terms (and perhaps some others)."""
    place = F.col("term").bitwiseAND(F.lit((1 << BITS) - 1))
    maps = terms.select((place / 32768).cast("int").alias("b"), (place % 32768).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()  # at most 512 rows of 4 KB
    bits = np.zeros(1 << BITS - 3, np.uint8)
    for r in maps:
        bits[r.b * 4096 : (r.b + 1) * 4096] = np.frombuffer(bytes(r.m), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def make():
        bits, h, counts = np.frombuffer(shared.value, np.uint8), xxhash.xxh64_intdigest, {}
        low = np.uint64((1 << BITS) - 1)

        def out():
            rows = [(k - (1 << 64) if k >> 63 else k, n) for k, n in counts.items()]
            counts.clear()
            return rows

        def row(x):
            words = set(utf8(x[0]).translate(TERMS).split())
            if not words:
                return ()
            hashes = np.fromiter((h(w, 42) for w in words), np.uint64, len(words))
            at = hashes & low
            hit = hashes[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            for k in hit.tolist():
                counts[k] = counts.get(k, 0) + 1
            return out() if len(counts) > 100_000 else ()

        row.close = out
        return row

    return map_rows(docs.select(F.col(text_col)), make, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing(docs: DataFrame, seen: DataFrame, text_col: str = "text", support: int = 2, general: float = 0.8, remove: float = 0.9) -> DataFrame:
    """(entity, term, n_e, kind): pairs whose disclosure reaches a threshold; kind 4 generalise, 5 remove."""
    n = float(seen.count())
    holds = seen.select("row_id", F.explode("entities").alias("entity"))
    n_e = stored(holds.groupBy("entity").agg(F.count("*").alias("n_e")).where((F.col("n_e") >= support) & (F.col("n_e") < n)))
    holds = stored(hot_join(holds, n_e, ["entity"], "n_e", ["row_id"]))
    words = seen.join(holds.select("row_id").distinct(), "row_id", "left_semi").select("row_id", "context", F.explode(F.array_distinct("terms.term")).alias("term"))
    n_t = stored(document_frequency(docs, words.groupBy("term").count().where(F.col("count") >= support).select("term"), text_col))

    def share(n_et: Column) -> Column:
        return F.log2(n_et * n / (F.col("n_e") * F.col("n_t"))) / F.log2(F.lit(n) / F.col("n_e"))

    # A pair can't be in more documents than the rarer of both: terms too common for that never count.
    together = hot_join(words, n_t, ["term"], "n_t", ["row_id"], total=n_t.agg(F.sum("n_t")).first()[0] or 0)
    may = holds.join(together, "row_id").where(share(F.least("n_e", "n_t")) >= general - 1e-9)
    pairs = may.groupBy("entity", "term", "n_e", "n_t").agg(F.count("*").alias("n_et"), F.min("context").alias("a"), F.max("context").alias("b"))
    known = pairs.where((F.col("n_et") >= support) & (F.col("a") < F.col("b"))).withColumn("share", share(F.col("n_et")))
    return known.where(F.col("share") >= general).select("entity", "term", "n_e", F.when(F.col("share") >= remove, 5).otherwise(4).alias("kind"))


def sensitive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 2, general: float = 0.8, remove: float = 0.9) -> DataFrame:
    """doc_id, counts, base_sha256 and all_spans (start, kind, end) of every row.

    Null text counts as empty: no spans.  Texts are read whole, offsets are code
    points, ends exclusive.  Repeated rows each get their own; they count as
    documents.  Null ids stay null.  An empty table gives no rows.  Other columns
    are ignored.
    """
    seen = stored(found(docs, id_col, text_col))
    bad = stored(disclosing(docs, seen, text_col, support, general, remove))
    told = hot_join(seen.select("row_id", F.explode("entities").alias("entity")), bad, ["entity"], "n_e", ["row_id"]).groupBy("row_id", "term").agg(F.max("kind").alias("kind"))
    places = seen.join(told.select("row_id").distinct(), "row_id", "left_semi").select("row_id", F.explode("terms").alias("x")).select("row_id", "x.term", "x.start", "x.end")
    hits = places.join(told, ["row_id", "term"])
    per_row = hits.groupBy("row_id").agg(F.collect_list(F.struct("start", "kind", "end")).alias("terms"))
    both = seen.drop("terms", "context", "entities").join(per_row, "row_id", "left")
    return both.withColumn("all_spans", F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "terms"))))


def redact(text: str | None, spans) -> str | None:
    """The text without its spans: patterns become [KIND], generalised terms
    [TERM], removed terms nothing; of overlapping spans the union goes."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, k, b in sorted(tuple(s) for s in spans):
        if b > at:
            if a >= at:
                out += [text[at:a], f"[{KINDS[k].upper()}]" if k < 4 else "[TERM]" if k == 4 else ""]
            at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """docs with sanitised texts; all rows and columns stay.

    Spans are matched to rows by their texts, whatever their ids: null and repeated
    ones don't matter.  Null texts stay null, empty ones empty.  An empty table gives
    no rows.
    """
    spans = sensitive(docs, id_col, text_col, **thresholds).where(F.size("all_spans") > 0).groupBy("text_a", "text_b").agg(F.first("all_spans").alias("spans"))
    ship(docs.sparkSession)
    clean = F.pandas_udf(lambda t, s: t.combine(s, lambda x, y: redact(x, None if y is None else [(z["start"], z["kind"], z["end"]) for z in y])), "string")
    text = F.col(f"row.`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *text_keys(F.col(f"`{text_col}`")))
    done = rows.join(spans, ["text_a", "text_b"], "left").select("row", F.when(F.col("spans").isNull(), text).otherwise(clean(text, F.col("spans"))).alias("clean"))
    return done.select(*[(F.col("clean") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data, and the terms that disclose it, of every document."""
    got = sensitive(documents(spark, sf_dir))
    names = F.array(*map(F.lit, KINDS))
    text = F.concat_ws(",", F.transform("all_spans", lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])))
    return got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"))
