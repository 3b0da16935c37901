"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent letter n-grams (one to three
characters, words padded by a blank), by rank.  A document's own profile is
compared to each language's by the out-of-place distance: for each n-gram of the
document, how far its rank lies from its rank in the language, and a fixed
penalty if the language doesn't list it.  The nearest language wins.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_rows

#: Length of a profile, and the longest n-gram (three code points of 21 bits make a 64-bit key).
TOP, LONGEST = 400, 3
FOLDS = 5
UNKNOWN = "und"


@cache
def letter_table() -> np.ndarray:
    """For each code point its own value if it is a letter, else 32, a blank."""
    is_letter = np.fromiter((chr(c).isalpha() for c in range(0x30000)), bool, 0x30000)
    return np.where(is_letter, np.arange(0x30000), 32).astype(np.uint32)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams of a text and how often each stands there."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    table = letter_table()
    codes = table[raw] if raw.max() < len(table) else np.fromiter((ord(c) if c.isalpha() else 32 for c in text.lower()), np.uint32)
    codes = np.concatenate([[32], codes, [32]]).astype(np.int64)
    codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))]  # one blank between words
    if len(codes) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = (codes[:-1] << 21) | codes[1:]
    three = (two[:-1] << 21) | codes[2:]
    three = three[codes[1:-1] != 32]  # none across words
    keys = np.sort(np.concatenate([codes[codes != 32], two, three]))
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.diff(np.append(starts, len(keys)))


def profile(keys: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent keys, most first, ties to the smaller key."""
    if len(keys) > 4 * top:  # what can't be among them goes before the sort
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))[:top]]


def held_out(id_col: str):
    """Whether a row is kept out of learning; rows without an id are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> dict[str, list[int]]:
    """Profiles of all languages of the given rows, counted over all of them.

    Each task sums its counts before they are shuffled; the ``top`` of each
    language reach the driver (a list of fixed length for each language name).
    """

    def make():
        held: dict[str, dict[int, int]] = {}
        size = [0]

        def out():
            rows = [(lang, k, n) for lang, c in held.items() for k, n in c.items()]
            held.clear()
            size[0] = 0
            return rows

        def row(x):
            keys, counts = ngram_counts(x[0])
            own = held.setdefault(x[1], {})
            before = len(own)
            for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
                own[k] = own.get(k, 0) + n
            size[0] += len(own) - before
            return out() if size[0] > 400_000 else ()

        row.close = out
        return row

    counts = map_rows(docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col), make, "lang string, k long, n long", 100_000)
    total = counts.groupBy("lang", "k").agg(F.sum("n").alias("n"))
    best = total.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "k"))).where(F.col("r") <= top)
    out: dict[str, list[int]] = {}
    for r in best.select("lang", "k", "r").orderBy("lang", "r").collect():
        out.setdefault(r.lang, []).append(r.k)
    return out


class Model:
    """All profiles side by side: a rank for each listed n-gram and language."""

    def __init__(self, profiles: dict[str, list[int]], top: int = TOP):
        self.langs, self.top = sorted(profiles), top
        self.keys = np.unique(np.array([k for p in profiles.values() for k in p], np.int64))
        self.ranks = np.full((len(self.keys), len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.keys, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (ties to the smaller name), and by how much it is
        nearer than the next as a share of the next's distance; one language: 1."""
        own = profile(*ngram_counts(text), self.top)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        listed = self.keys[at] == own
        ranks = self.ranks[at]
        away = np.where(listed[:, None] & (ranks >= 0), np.abs(ranks - np.arange(len(own))[:, None]), self.top).sum(axis=0)
        best = int(away.argmin())
        rest = np.delete(away, best)
        return self.langs[best], 1.0 if not len(rest) else float((rest.min() - away[best]) / max(rest.min(), 1))


def identify(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row.

    ``und`` with score 0: null text, a text without a letter, or no profiles.
    Texts are read whole; repeated rows get a row each; an empty table gives no
    rows; other columns are ignored.
    """

    def make():
        model = Model(profiles, top)

        def row(x):
            yield x[0], *model.predict(x[1])

        return row

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), make, "doc_id long, lang_pred string, score double")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by profiles of those that are not held out."""
    docs = documents(spark, sf_dir)
    profiles = learn(docs.where(~held_out("doc_id")))
    return identify(docs, profiles).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
