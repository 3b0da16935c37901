"""Byte-pair encoding and decoding: speculate, verify, merge only where that fails.

A word's tokens are proposed by greedy longest match over the vocabulary.  A sequence
of tokens is what the merges give exactly if each token is what its own characters
merge to and each adjacent pair is compatible: while the merges that built the two
tokens are undone in the reverse of their order, no merge across the border comes
before the next one of them.  That is checked for all pairs of a batch at once, with
table look-ups on arrays.  Words with a pair that fails are merged exactly, by rank and
then from the left.

Rank order is the order of building only if every merge joins tokens of earlier merges
or single bytes; with a vocabulary that breaks this all words are merged exactly.

Texts are split as the vocabulary's file says: special tokens first, then canonical
composition, lower case, and a pattern for words, of which white space is none.  Each
worker keeps the ids of words that it has met, up to a bounded number.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ship, utf8

#: Words that a worker keeps, at most; their bytes, at most; characters of the texts handled in one go, about.
KEPT, KEPT_BYTES, BATCH = 300_000, 1 << 24, 1 << 20
#: Words of up to so many bytes are merged together.
SHORT = 64
#: The only kinds of steps that a vocabulary file may ask for (fixed values of the file format).
NORMAL = ["NFC", "Replace", "Lowercase"]
#: Rank of what no merge makes.
NEVER = np.int64(1) << 40


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Bpe:
    """A word-level BPE vocabulary with word ends, from its JSON file."""

    def __init__(self, path: str | None = None):
        import public_tokenizers as P

        with open(path or P.path("word_bpe_49k.json"), encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if steps != NORMAL or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or not model.get("end_of_word_suffix"):
            raise ValueError("a vocabulary of another kind")
        self.path, self.end = path or P.path("word_bpe_49k.json"), model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.unassigned = regex.compile(r"\p{Cn}")
        self.library = None
        vocab, chars = model["vocab"], byte_characters()
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.name_of = [names.get(i) for i in range(max(names) + 1)]
        byte_of = {c: b for b, c in enumerate(chars)}
        self.n = len(self.name_of)
        self.base = [vocab[c] for c in chars]
        self.last = [vocab[c + self.end] for c in chars]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        a = np.array([vocab[x] for x, _ in merges], np.int64)
        b = np.array([vocab[y] for _, y in merges], np.int64)
        made = np.array([vocab[x + y] for x, y in merges], np.int64)
        self.rank, self.left, self.right = np.full(self.n, -1, np.int64), np.full(self.n, -1, np.int64), np.full(self.n, -1, np.int64)
        self.rank[made[::-1]], self.left[made[::-1]], self.right[made[::-1]] = np.arange(len(made))[::-1], a[::-1], b[::-1]
        #: (left, right) -> (rank, id), for exact merging; the same as sorted arrays, for look-ups of many.
        self.merges = {(x, y): (r, z) for r, (x, y, z) in reversed(list(enumerate(zip(a.tolist(), b.tolist(), made.tolist(), strict=True))))}
        keys = a * self.n + b
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_rank = keys[order], order.astype(np.int64)
        ranked = np.arange(len(made))
        self.ordered = bool((self.rank[a] < ranked).all() and (self.rank[b] < ranked).all() and len(np.unique(made)) == len(made))
        own = np.ones(self.n, bool)
        if self.ordered:
            own[made] = self.compatible(a, b, ranked)
            while True:
                more = own.copy()
                more[made] &= own[a] & own[b]
                if (more == own).all():
                    break
                own = more
        #: Bytes of tokens inside a word, and of those that end one.
        self.inner, self.ending = {}, {}
        for t, i in vocab.items():
            if own[i]:
                ends = t.endswith(self.end) and t not in chars
                (self.ending if ends else self.inner)[bytes(byte_of[c] for c in (t[: -len(self.end)] if ends else t))] = i
        #: The longest token inside a word, by its first two bytes.
        self.reach: dict[bytes, int] = {}
        for t in self.inner:
            self.reach[t[:2]] = max(self.reach.get(t[:2], 0), len(t))
        self.longest = max(map(len, self.ending))
        self.made = made
        self.words: dict[str, bytes] = {}
        self.held = 0
        self.merged = 0

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NEVER where there is none."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the border of each pair comes before the merges that built
        the two tokens or, at last, before the rank ``before`` (never, if not given).

        Of two merges with one rank the one further left comes first: a merge inside the left
        token before one across the border, that before one inside the right token.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), NEVER) if before is None else before.astype(np.int64)
        while len(live):
            fails = self.rank_of(a, b) < limit
            ok[live[fails]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~fails & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[on], a[on], b[on], ra[on], rb[on]
            undo = rb >= ra  # the merge made last is undone first
            limit = np.where(undo, rb + 1, ra)
            a, b = np.where(undo, a, self.right[a]), np.where(undo, self.left[b], b)
        return ok

    def greedy(self, word: bytes) -> list[int]:
        """Longest matches from the left; the last byte belongs to a token that ends the word."""
        out, i, n = [], 0, len(word) - 1
        while True:
            if n - i < self.longest and (t := self.ending.get(word[i:])) is not None:
                out.append(t)
                return out
            for j in range(min(n, i + self.reach.get(word[i : i + 2], 1)), i, -1):
                if (t := self.inner.get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break

    def merge(self, word: bytes) -> list[int]:
        """The merges themselves: the lowest rank first, from the left."""
        ids = [self.base[c] for c in word[:-1]] + [self.last[word[-1]]]
        after, before, gone = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [False] * len(ids)
        heap = [(*m, i, x, y) for i, (x, y) in enumerate(zip(ids, ids[1:], strict=False)) if (m := self.merges.get((x, y)))]
        heapq.heapify(heap)
        while heap:
            _, new, i, x, y = heapq.heappop(heap)
            j = after[i]
            if gone[i] or ids[i] != x or j >= len(ids) or ids[j] != y:
                continue
            ids[i], gone[j], after[i] = new, True, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
                if m := self.merges.get((new, ids[after[j]])):
                    heapq.heappush(heap, (*m, i, new, ids[after[j]]))
            if before[i] >= 0 and (m := self.merges.get((ids[before[i]], new))):
                heapq.heappush(heap, (*m, before[i], ids[before[i]], new))
        return [t for t, g in zip(ids, gone, strict=True) if not g]

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """The same for many short words at once: in each round every word makes its next merge."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids, word = np.array(self.base)[raw], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes) - 1
        ids[ends] = np.array(self.last)[raw[ends]]

        def ranks(at: np.ndarray) -> np.ndarray:
            """Of the pairs that start at these places."""
            then = np.minimum(at + 1, len(ids) - 1)
            return np.where((then > at) & (word[then] == word[at]), self.rank_of(ids[at], ids[then]), NEVER)

        rank = ranks(np.arange(len(ids)))
        while len(ids):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least, each = np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids)))
            over = least == NEVER
            for k in np.flatnonzero(over).tolist():
                out[word[starts[k]]] = ids[starts[k] : starts[k] + each[k]].tolist()
            stays = np.repeat(~over, each)
            ids, word, rank, least = ids[stays], word[stays], rank[stays], np.repeat(least, each)[stays]
            hits = np.flatnonzero(rank == least)
            first = hits[np.append(True, word[hits[1:]] != word[hits[:-1]])] if len(hits) else hits
            ids[first] = self.made[rank[first]]
            stays = np.ones(len(ids), bool)
            stays[first + 1] = False
            at = (np.cumsum(stays) - 1)[first]
            ids, word, rank = ids[stays], word[stays], rank[stays]
            rank[at] = ranks(at)
            at = at[at > 0] - 1
            rank[at] = ranks(at)
        return out

    def merged_words(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of whatever words, the long ones each for itself."""
        self.merged += len(words)
        short = [w for w in words if len(w) <= SHORT]
        done = iter(self.merge_many(short))
        return [next(done) if len(w) <= SHORT else self.merge(w) for w in words]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words: proposed, verified together, merged where a pair fails."""
        raw = [utf8(w) for w in words]
        if not self.ordered:
            return self.merged_words(raw)
        out = [self.greedy(w) for w in raw]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((t for ids in out for t in ids), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(out)), sizes)
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, place = np.unique(flat[inside] * self.n + flat[inside + 1], return_inverse=True)
        bad = ~self.compatible(pairs // self.n, pairs % self.n)[place]
        failing = np.unique(word[inside[bad]]).tolist()
        for k, ids in zip(failing, self.merged_words([raw[k] for k in failing]), strict=True):
            out[k] = ids
        return out

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if not text.isascii():
            if self.unassigned.search(text) or any(unicodedata.category(c) == "Cn" for c in set(text)):
                return self.split_new(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() knows a final sigma, the vocabulary's rule doesn't
        return self.pattern.findall(text.lower())

    def split_new(self, text: str) -> list[str]:
        """Texts with characters that this Python's tables don't know: normalised and split by
        the library that the vocabulary is written for."""
        if self.library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            self.library = Tokenizer.from_file(self.path).normalizer, pre_tokenizers.Split(Regex(self.pattern.pattern), "removed", invert=True)
        normal, splitter = self.library
        return [w for w, _ in splitter.pre_tokenize_str(normal.normalize_str(text))]

    def parts(self, text: str) -> Iterator[int | list[str]]:
        """Ids of special tokens, and the words between them."""
        at = 0
        for m in self.cut.finditer(text) if "<" in text else ():
            yield self.split(text[at : m.start()])
            yield self.special[m[0]]
            at = m.end()
        yield self.split(text[at:] if at else text)

    def encode(self, texts: Iterable[str | None]) -> list[array]:
        """Ids of whole texts as unsigned 32-bit integers; null is empty."""
        cut = [list(self.parts(t)) if t else [] for t in texts]
        met = set().union(*[p for parts in cut for p in parts if isinstance(p, list)])
        new = met - self.words.keys()
        if len(self.words) + len(new) > KEPT or self.held > KEPT_BYTES:
            self.words, self.held, new = {}, 0, met
        words = sorted(new)
        for w, ids in zip(words, self.encode_words(words), strict=True):
            self.words[w] = array("I", ids).tobytes()
            self.held += len(w) + 4 * len(ids)
        get = self.words.__getitem__
        return [array("I", b"".join(b"".join(map(get, p)) if isinstance(p, list) else array("I", [p]).tobytes() for p in parts)) for parts in cut]

    def decode(self, ids) -> str:
        """Tokens by name, with spaces between: this vocabulary has no further decoder.  Unknown ids are left out."""
        name = self.name_of
        return " ".join([name[i] for i in ids if i < self.n and name[i] is not None])


@lru_cache(2)
def tokenizer_of(path: str | None) -> Bpe:
    """One for each Python worker, with the words that it has met."""
    return Bpe(path)


def _mapped(df: DataFrame, made, schema: str, path: str | None) -> DataFrame:
    ship(df.sparkSession)

    def run(batches):
        tokenizer = tokenizer_of(path)
        for b in batches:
            yield from made(tokenizer, b)

    return df.mapInArrow(run, schema)


def packed(ids: array) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids, "<u4").tobytes()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, back: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row: its whole text in tokens of the vocabulary, as
    little-endian unsigned 32-bit integers.  ``back``: with ``text``, what the ids decode to.

    Null and empty texts, and those of white space only, have no ids.  Strings of special
    tokens are these tokens, wherever they stand.  Repeated rows each get their own, null ids
    stay null, an empty table gives no rows, other columns are ignored.  ``path``: the
    vocabulary's JSON file, on every executor.
    """
    schema = "doc_id long, n_tokens long, ids binary" + ", text string" * back

    def made(tokenizer: Bpe, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, at, size = b.column(1), 0, 0
        lengths = pc.coalesce(pc.utf8_length(texts), 0).to_pylist()
        for k, n in enumerate(lengths, 1):
            size += n
            if size >= BATCH or k == len(lengths):
                got = tokenizer.encode(texts.slice(at, k - at).to_pylist())
                out = {"doc_id": b.column(0).slice(at, k - at), "n_tokens": pa.array(map(len, got), pa.int64()), "ids": pa.array(map(packed, got), pa.binary())}
                if back:
                    out["text"] = pa.array(map(tokenizer.decode, got), pa.string())
                yield pa.RecordBatch.from_pydict(out)
                at, size = k, 0

    return _mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), made, schema, path)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): what the ids spell; no ids: empty, null ids: null."""

    def made(tokenizer: Bpe, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = [None if ids is None else tokenizer.decode(np.frombuffer(ids, "<u4").tolist()) for ids in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "text": pa.array(text, pa.string())})

    return _mapped(encoded.select("doc_id", "ids"), made, "doc_id long, text string", path)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    got = encode(documents(spark, sf_dir), back=True)
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
