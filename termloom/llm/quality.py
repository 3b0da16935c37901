"""Quality rules as a short-circuit cascade.

Every rule is a cheap predicate over lazily computed features of one text.  On a random
sample of the rows each feature is timed and each rule's verdict noted; then rules are put
in order of rejections per second, each time among the sampled texts that the rules before
it let pass and with only the features that these have not computed yet.  A document
leaves the cascade at the first rule that rejects it.  The order changes the work, never the
verdict: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_rows, ship, utf8

#: Rows on which rules are timed, about.
SAMPLE = 2000
SYMBOLS = "#*$%&|<>"
WINDOW = 5


BULLET = re.compile(r"[ \t\x0b-\r]*[-*\u2022\u2023]")
ELLIPSIS = re.compile(r"(?:\.\.\.|\u2026)[ \t\x0b-\r]*\Z")


class Features:
    """What the rules look at; each part is computed once, when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return utf8(self.text).split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_bullets(self) -> int:
        return sum(BULLET.match(x) is not None for x in self.lines)

    @cached_property
    def n_ellipses(self) -> int:
        return sum(ELLIPSIS.search(x) is not None for x in self.lines) if "..." in self.text or "\u2026" in self.text else 0

    @cached_property
    def n_unique(self) -> int:
        return len(set(self.words))

    @cached_property
    def n_letters(self) -> int:
        plain = self.text.encode("ascii", "ignore")
        n = len(plain) - len(plain.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
        return n if len(plain) == len(self.text) else n + sum(c.isalpha() for c in self.text if c > "\x7f")

    @cached_property
    def n_controls(self) -> int:
        return self.text.count("�") + (0 if self.text.isprintable() else len(self.text.encode("ascii", "ignore")) - len(self.text.encode("ascii", "ignore").translate(None, bytes([*range(9), *range(14, 32), 127]))))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.words)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of five that stands twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    new = ids.setdefault
    codes = np.fromiter((new(w, len(ids)) for w in words), np.uint64, len(words))
    if len(ids) == len(words):
        return 0
    mixed, mul = np.zeros(n, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for k in range(WINDOW):
        mixed = (mixed ^ codes[k : k + n]) * mul
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    near = mixed[order]
    same = near[1:] == near[:-1]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    if all((codes[a + k] == codes[b + k]).all() for k in range(WINDOW)):
        hit = np.zeros(n, bool)
        hit[a] = hit[b] = True
    else:  # two windows share a hash: count the windows themselves
        seen: dict[tuple, int] = {}
        windows = list(zip(*(codes[k : k + n].tolist() for k in range(WINDOW)), strict=True))
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        hit = np.array([seen[w] > 1 for w in windows])
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, np.flatnonzero(hit), 1)
    np.add.at(step, np.flatnonzero(hit) + WINDOW, -1)
    return int((step.cumsum()[:-1] > 0).sum())


#: A rule rejects a text where it is true.
RULES: dict[str, Callable[[Features], bool]] = {
    "too_short": lambda x: x.n_words < 10,
    "repeated_windows": lambda x: 100 * x.n_repeat_words > 20 * x.n_words,
    "symbols": lambda x: 10 * x.n_symbols > 3 * x.n_words,
    "duplicate_lines": lambda x: 100 * x.n_dup_lines > 30 * len(x.lines),
    "short_words": lambda x: 10 * x.word_chars < 15 * x.n_words,
    "long_words": lambda x: x.word_chars > 30 * x.n_words,
    "few_letters": lambda x: 100 * x.n_letters < 40 * x.word_chars,
    "controls": lambda x: 100 * x.n_controls > x.word_chars,
    "bullet_lines": lambda x: len(x.lines) > 2 and 100 * x.n_bullets > 90 * len(x.lines),
    "ellipsis_lines": lambda x: len(x.lines) > 2 and 100 * x.n_ellipses > 30 * len(x.lines),
    "few_unique_words": lambda x: 4 * x.n_unique * x.n_unique < x.n_words,  # a text's vocabulary grows about as the root of its length
}
BASE = ("too_short", "repeated_windows")


#: The features by name, each after those it is made of.
FEATURES = [n for n, p in vars(Features).items() if isinstance(p, cached_property)]


def measure(docs: DataFrame, text_col: str = "text", rules: tuple[str, ...] = tuple(RULES), sample: int = SAMPLE) -> tuple[dict[int, tuple[int, list[float]]], dict[str, set[str]]]:
    """Of a random sample of about ``sample`` rows: for each set of rules that reject a text (a
    bit for each) how many texts have it and the seconds of each feature; and each rule's features."""

    def make():
        def row(x):
            f, costs = Features(x[0]), []
            for name in FEATURES:
                t = time.perf_counter()
                getattr(f, name)
                costs.append(time.perf_counter() - t)
            bits, used = 0, []
            for k, name in enumerate(rules):
                alone = Features(x[0])
                bits |= RULES[name](alone) << k
                used.append(sum(1 << FEATURES.index(a) for a in vars(alone) if a != "text"))
            yield bits, costs, used

        return row

    n = docs.count()
    rows = docs.select(F.col(text_col)).where(F.rand(11) * n < sample)
    got = map_rows(rows, make, "bits long, costs array<double>, used array<long>")
    sums = [F.sum(F.get("costs", F.lit(k))).alias(f"c{k}") for k in range(len(FEATURES))] + [F.bit_or(F.get("used", F.lit(k))).alias(f"u{k}") for k in range(len(rules))]
    found, needs = {}, {r: set() for r in rules}
    for r in got.groupBy("bits").agg(F.count("*").alias("n"), *sums).collect():  # no more rows than the sample has
        found[r.bits] = r.n, [r[f"c{k}"] for k in range(len(FEATURES))]
        for k, name in enumerate(rules):
            needs[name] |= {f for j, f in enumerate(FEATURES) if r[f"u{k}"] >> j & 1}
    return found, needs


def estimate(docs: DataFrame, text_col: str = "text", rules: tuple[str, ...] = tuple(RULES), sample: int = SAMPLE, given: tuple[str, ...] = ()) -> list[str]:
    """The rules in the order of the cascade: most rejections per second first, each among the
    texts and with the features that the ones before it leave.  ``given``: features that are
    computed in any case.  Ties and an empty table: by name."""
    found, needs = measure(docs, text_col, rules, sample)
    order: list[str] = []
    done = set(given)
    while len(order) < len(rules):

        def gain(name: str) -> float:
            bit = rules.index(name)
            cost = sum(c[FEATURES.index(f)] for _, c in found.values() for f in needs[name] - done)
            return sum(n for bits, (n, _) in found.items() if bits >> bit & 1) / max(cost, 1e-9)

        best = min((r for r in rules if r not in order), key=lambda r: (-gain(r), r))
        order.append(best)
        done |= needs[best]
        found = {bits: x for bits, x in found.items() if not bits >> rules.index(best) & 1}
    return order


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[str, ...] = tuple(RULES), order: list[str] | None = None) -> DataFrame:
    """doc_id, the base figures, base_failed and kept, a row for each row of docs.

    Null text counts as empty: no words, so it fails the base rule.  Long texts
    are read whole.  Repeated ids are judged row by row; an empty table gives no
    rows; other columns are ignored.
    """
    order = order or estimate(docs, text_col, rules, given=("words", "word_chars", "n_symbols", "lines", "n_dup_lines", "n_repeat_words"))
    rest = [r for r in order if r not in BASE]  # base figures are reported in any case

    def make():
        def row(x):
            f = Features(x[1])
            failed = any(RULES[r](f) for r in BASE)
            kept = not failed and not any(RULES[r](f) for r in rest)
            yield x[0], f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, failed, kept

        return row

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), make, f"doc_id long, {STATS}, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, that pass every rule.

    Here nothing is reported, so a text leaves at the first rule that rejects it.
    """
    order = order or estimate(docs, text_col)
    import pyarrow as pa

    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            good = [not any(RULES[r](f) for r in order) for f in map(Features, batch.column(at).to_pylist())]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document."""
    return quality(documents(spark, sf_dir))


#: The same figures and verdict in SQL.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS pos FROM w),
g AS (SELECT doc_id, pos, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o END AS gram FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, CASE WHEN gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 THEN 1 ELSE 0 END AS again FROM g),
c AS (SELECT doc_id, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM r),
n AS (SELECT doc_id, sum(covered) AS n_repeat FROM c GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, len(list_distinct(ws)) AS n_unique,
  len(list_filter(ls, lambda l: regexp_matches(l, '^[ \x09\x0B-\x0D]*[-*\x{2022}\x{2023}]'))) AS n_bullets, len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|\x{2026})[ \x09\x0B-\x0D]*\z'))) AS n_ellipses, length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS n_letters,
  length(text) - length(regexp_replace(text, '[\x00-\x08\x0E-\x1F\x7F\x{FFFD}]', '', 'g')) AS n_controls FROM w LEFT JOIN n USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 30 * n_lines OR 10 * word_chars < 15 * n_words OR word_chars > 30 * n_words OR 100 * n_letters < 40 * word_chars OR 100 * n_controls > word_chars
    OR n_lines > 2 AND 100 * n_bullets > 90 * n_lines OR n_lines > 2 AND 100 * n_ellipses > 30 * n_lines OR 4 * n_unique * n_unique < n_words) AS kept
FROM b
"""
