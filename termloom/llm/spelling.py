"""Spelling variants: words one edit apart, by full neighbourhood generation.

The words that count are those of the corpus with enough letters and occurrences.  Every
one of them emits all distinct strings at one deletion, replacement or insertion over the
alphabet of these words; a hash join with the words themselves leaves the near ones.  What
joins is near by construction, so no distance is computed.

A word of length n has some 2 n |alphabet| such strings, nearly none of which is a word.
Their hashes are polynomials of the code points, so all of a word's come from prefix sums
in a few array operations; strings are made only of those whose hash passes a Bloom filter
of the words.  The filter has a fixed size whatever the corpus; when it fills, more strings
reach the join, and the result is the same.

A word's form is its much more frequent near word, its root the end of the chain of forms.
Each step multiplies the count, so chains are short: pointers are doubled a fixed number of
times.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, pa_schema, stored, to_batch

#: A run of letters.
RUN = r"[A-Za-zÀ-ÿ]+"
#: Fewest code points and occurrences of a word; how often more its form occurs; one run in so many is misspelt by the query.
LETTERS, OCCURRENCES, TIMES, EVERY = 6, 5, 5, 199
#: Bits of the filter (16 MB) and of one of its pages; bits set for each word.
BITS, PAGE, PROBES = 27, 16, 4
#: Base of the hash, odd; strings hashed in one go, about.
BASE, STRINGS = np.uint64(0x9E3779B97F4A7C15), 1 << 20
#: Chains of forms have under log(2^63) / log(TIMES) = 28 links; so many doublings follow 32.
DOUBLINGS = 5


def lowered(text):
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, run, times): the lower-cased runs of letters of whole texts; a null text has none."""
    found = F.regexp_extract_all(lowered(F.col(text_col)), F.lit(RUN), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(found).alias("run"))
    return rows.groupBy("doc_id", "run").agg(F.count("*").alias("times"))


def misspelt(counted: DataFrame, every: int = EVERY) -> DataFrame:
    """Of about one run in ``every`` of a document one letter goes, by a checksum of both
    (a null id counts as an empty string)."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return counted.withColumn("run", F.when(h % every == 0, cut).otherwise(F.col("run")))


def vocabulary(counted: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of (run, times): words with enough letters and occurrences."""
    return counted.where(F.char_length("run") >= letters).groupBy(F.col("run").alias("word")).agg(F.sum("times").alias("n")).where(F.col("n") >= occurrences)


def powers(n: int) -> np.ndarray:
    """BASE ** 0 ... BASE ** (n - 1), modulo 2 ** 64."""
    return np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(max(n - 1, 0), BASE))])[:n].astype(np.uint64)


def codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def matrix(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row for each."""
    return codes("".join(words)).reshape(len(words), -1)


def hashes(words: list[str]) -> np.ndarray:
    """Of each word: the sum of its code points times powers of BASE, the first with the
    zeroth, plus one for the length."""
    out, sizes = np.zeros(len(words), np.uint64), np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == n)
        p = powers(n + 1)
        out[own] = np.add.reduce(matrix([words[k] for k in own]) * p[:-1], axis=1, dtype=np.uint64) + p[-1:]
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


def probe(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th place in the filter of mixed hashes."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h + np.uint64(k) * step) >> np.uint64(7)) & np.uint64((1 << bits) - 1)


def passing(held: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Flat places of the hashes that the filter lets through."""
    h = mixed(h.ravel())
    ok = np.arange(len(h))
    for k in range(PROBES):
        at = probe(h, k, bits)
        hit = np.flatnonzero((held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
        ok, h = ok[hit], h[hit]
    return ok


def filter_of(words: DataFrame, bits: int = BITS) -> np.ndarray:
    """The Bloom filter of all words: tasks set bits, pages are put together by key, and
    2^BITS bits in all come to the driver, whatever the number of words."""
    out = pa_schema(words.sparkSession, "page int, place long")

    def places(batches):
        for b in batches:
            if b.num_rows:
                h = mixed(hashes(b.column(0).to_pylist()))
                at = np.unique(np.concatenate([probe(h, k, bits) for k in range(PROBES)])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((at >> PAGE).astype(np.int32)), pa.array(at & ((1 << PAGE) - 1))], schema=out)

    held = words.select("word").mapInArrow(places, "page int, place long")
    block, place = F.bitmap_bucket_number(F.col("place") + 1), F.bitmap_bit_position(F.col("place") + 1)
    pages = held.groupBy("page", block.alias("block")).agg(F.bitmap_construct_agg(place).alias("bits")).collect()  # at most 2^BITS bits in all
    filled = np.zeros(1 << bits - 3, np.uint8)
    for r in pages:
        own = np.frombuffer(bytes(r.bits), np.uint8)
        start = (r.page << PAGE - 3) + (r.block - 1) * len(own)
        filled[start : start + len(own)] = own
    return filled


def neighbours(words: list[str], alphabet: np.ndarray, passes) -> list[set[str]]:
    """For words of one length: the distinct strings one edit from each, as far as their
    hashes pass (``passes``: of an array of hashes, the flat places that do).

    With prefix sums of the hash, what follows a deletion moves one power down, what
    follows an insertion one up.
    """
    c, n, letters = matrix(words), len(words[0]), len(alphabet)
    found: list[set[str]] = [set() for _ in words]
    p, none = powers(n + 2), np.zeros((len(words), 1), np.uint64)
    before = np.hstack([none, np.add.accumulate(c * p[:n], axis=1, dtype=np.uint64)])
    above = np.hstack([none, np.add.accumulate(c * p[1 : n + 1], axis=1, dtype=np.uint64)])
    below = np.add.accumulate(np.hstack([none, c[:, 1:] * p[: n - 1]]), axis=1, dtype=np.uint64)  # at i: of letters 1 to i
    for x, i in zip(*divmod(passes(before[:, :n] + (below[:, -1:] - below) + p[n - 1 : n]), n), strict=True):
        found[x].add(words[x][:i] + words[x][i + 1 :])
    step = max(1, STRINGS // (letters * len(words)))
    for at in range(0, n + 1, step):
        i = np.arange(at, min(at + step, n))
        if len(i):
            same = c[:, i, None] == alphabet
            h = (before[:, -1:] + p[n : n + 1] - c[:, i] * p[i])[:, :, None] + alphabet * p[i][None, :, None]
            hits = passes(h)
            hits = hits[~same.ravel()[hits]]
            for x, k, a in zip(*np.unravel_index(hits, h.shape), strict=True):
                found[x].add(words[x][: at + k] + chr(alphabet[a]) + words[x][at + k + 1 :])
        i = np.arange(at, min(at + step, n + 1))
        h = (before[:, i] + (above[:, -1:] - above[:, i]) + p[n + 1 :])[:, :, None] + alphabet * p[i][None, :, None]
        for x, k, a in zip(*np.unravel_index(passes(h), h.shape), strict=True):
            found[x].add(words[x][: at + k] + chr(alphabet[a]) + words[x][at + k :])
    return found


def near_words(words: DataFrame, bits: int = BITS) -> DataFrame:
    """(word, n, near, near_n) of (word, n), whose words stand once: all pairs that differ by
    exactly one inserted, deleted or replaced code point, in both directions."""
    spark = words.sparkSession
    # One row for each code point at most; a letter class bounds them, whatever the corpus.
    alphabet = np.array(sorted(ord(r[0]) for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()), np.uint64)
    shared = spark.sparkContext.broadcast((filter_of(words, bits).tobytes(), alphabet))
    out = pa_schema(spark, "word string, n long, near string")

    def emit(batches):
        held, letters = np.frombuffer(shared.value[0], np.uint8), shared.value[1]
        for b in batches:
            words, n = b.column(0).to_pylist(), b.column(1).to_pylist()
            order, at = sorted(range(len(words)), key=lambda k: len(words[k])), 0
            while at < len(order):
                length = len(words[order[at]])
                most = max(1, STRINGS // (2 * len(letters) * (length + 1)))
                own = [k for k in order[at : at + most] if len(words[k]) == length]
                at += len(own)
                got = neighbours([words[k] for k in own], letters, lambda h: passing(held, h, bits))
                rows = [(words[k], n[k], x) for k, near in zip(own, got, strict=True) for x in sorted(near)]
                step = max(1, STRINGS // length)
                for r in range(0, len(rows), step):
                    yield to_batch(rows[r : r + step], out)

    strings = words.select("word", "n").mapInArrow(emit, "word string, n long, near string")
    return strings.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def variants(words: DataFrame, times: int = TIMES, bits: int = BITS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of stored (word, n).

    form: the near word of largest n, of equal ones the first in code-point order, if it
    occurs ``times`` as often; else null, and the root is the word itself.  Without words
    there are no rows.
    """
    if times < 2:
        raise ValueError("chains of forms must rise")
    pairs = near_words(words, bits)
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("near_n"), "near"))
    best = pairs.withColumn("r", rank).groupBy("word").agg(F.count("*").alias("n_near"), F.max(F.when(F.col("r") == 1, F.struct("near", "near_n"))).alias("best"))
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("best.near_n") >= times * F.col("n"), F.col("best")).alias("best"))
    told = stored(told.select("word", "n", "n_near", F.col("best.near").alias("form"), F.col("best.near_n").alias("form_n")))
    links = told.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        links = stored(links)
        then = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not links.join(then, "root", "left_semi").limit(1).count():
            break
        links = links.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return told.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = None) -> DataFrame:
    """The words of whole texts with their near words, forms and roots.

    Null and empty texts have no words; repeated rows count each; an empty table gives no
    rows; very long words are words; other columns are ignored.  ``every``: misspells one
    run in so many first, a test of the operator on a corpus without mistakes.
    """
    counted = runs(docs, id_col, text_col)
    return variants(stored(vocabulary(misspelt(counted, every) if every else counted)))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all documents, misspelt as the contract says."""
    return spelling_variants(documents(spark, sf_dir), every=EVERY).select("word", "form", "root", "n", "n_near", "form_n")


#: The same in SQL: checksums bit by bit (polynomial EDB88320, reflected), near words by the
#: strings that two words share once a letter is left out.
SQL = f"""
WITH RECURSIVE x AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{RUN}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS times, hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run))) AS s FROM x GROUP BY doc_id, run),
h AS (SELECT run, times, xor(list_reduce(list_transform(generate_series(0, 4 * length(s) - 1), lambda i: (CAST(concat('0x', substr(s, 2 * (i // 8) + 1, 2)) AS BIGINT) >> (i % 8)::INT) & 1), lambda crc, b: xor(crc >> 1, 3988292384 * (xor(crc, b) & 1)), 4294967295), 4294967295) AS h FROM r),
m AS (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, times FROM h),
v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM m WHERE length(word) >= {LETTERS} GROUP BY word HAVING sum(times) >= {OCCURRENCES}),
d AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, CAST(unnest(generate_series(1, length(word))) AS INT) AS i FROM v)),
g AS (SELECT DISTINCT d.word, d.n, v.word AS near, v.n AS near_n FROM d JOIN v ON v.word = d.a || d.b),
p AS (SELECT * FROM g UNION SELECT near, near_n, word, n FROM g UNION SELECT c.word, c.n, d.word, d.n FROM d c JOIN d ON c.i = d.i AND c.a = d.a AND c.b = d.b AND c.word <> d.word),
o AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM p),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * v.n THEN near END AS form, CASE WHEN near_n >= {TIMES} * v.n THEN near_n END AS form_n FROM v LEFT JOIN o ON o.word = v.word AND r = 1),
t AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, t.root FROM f JOIN t ON f.form = t.word)
SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n FROM f JOIN t USING (word)
"""
