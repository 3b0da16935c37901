"""Packing: token pieces into fixed-length sequences by vector bin packing.

Each example asks for three resources of a sequence: tokens, one segment, and
loss-bearing tokens.  A sequence is filled by the dot-product heuristic: of the
waiting pieces that fit all three limits, the one whose demand has the largest
dot product with what the sequence has left is placed next.

Work is one pass without a shuffle: each task streams its documents, emits
full-length pieces at once and keeps a bounded pool of pieces (with their ids)
waiting.  A sequence only holds pieces of one task, so a retried task gives the
same sequences again and no other task is concerned.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, n_loss long, sequence_id long, offset long"
#: A text is tokenized in parts of about so many characters, cut only where the tokenizer itself always cuts.
PART = 1 << 19
SPECIAL = "<|endoftext|>"
#: White space from this length on isn't given to the fast encoder.
BLANK = 20_000
#: White space as the tokenizer's pattern knows it.
SPACE = r"\t-\r \x85\xa0  -     　"


class Tokenizer:
    """Ids of the byte-level BPE in ``<folder>/byte_bpe_50k.json``.

    The plain part of a text goes through the same vocabulary's rank file, whose
    encoder is five times as fast and gives the same ids; texts that spell a
    special token go through the JSON file's own library, which knows it.
    """

    def __init__(self, folder: str | None = None):
        import base64
        import re

        import public_tokenizers as P
        import tiktoken

        at = (lambda name: f"{folder}/{name}") if folder else P.path
        with open(at("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json, self.slow = at("byte_bpe_50k.json"), None
        self.cut = re.compile(f" (?=[^{SPACE}])")
        self.blank = re.compile(f"(?<![{SPACE}])[{SPACE}]{{{BLANK},}}")

    def ids(self, text: str) -> array:
        """Token ids, as unsigned 32-bit integers."""
        out, at = array("I"), 0
        while len(text) - at > 2 * PART:
            m = self.cut.search(text, at + PART)
            if not m:
                break
            out.extend(self.part(text[at : m.start()]))
            at = m.start()
        out.extend(self.part(text[at:] if at else text))
        return out

    def part(self, text: str) -> list[int]:
        """Ids of a part.  Special tokens, and white space so long that the fast
        encoder's regular expression would overflow its stack, go to the other library."""
        if SPECIAL in text or self.blank.search(text):
            from tokenizers import Tokenizer as Own

            self.slow = self.slow or Own.from_file(self.json)
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class Packer:
    """Streams pieces into sequences.

    limits: most tokens, segments and loss-bearing tokens of a sequence.  The first
    ``free`` tokens of a piece bear no loss, the others do.  cut: a piece may be cut
    where no waiting piece fits, and what is short at the end is cut into powers of two.
    """

    def __init__(self, limits: tuple[int, int, int], base: int, cut: bool = True, pool: int = 768):
        self.limits, self.cut, self.next = np.array(limits, float), cut, base
        self.left, self.fill = self.limits.copy(), []
        self.want = np.zeros((3, pool))  # demands of the waiting pieces; zero tokens: a free slot
        self.wait: list = [None] * pool
        self.free = list(range(pool))[::-1]
        self.ending = False

    def add(self, doc, start: int, ids: bytes, total: int, free: int) -> list[tuple]:
        """One piece that a sequence can hold; returns rows of sequences closed by it."""
        if len(ids) // 4 == self.limits[0]:  # it fills a sequence of its own
            self.next += 1
            return [(doc, start, len(ids) // 4, zlib.crc32(ids), total, len(ids) // 4 - free, self.next - 1, 0)]
        out: list[tuple] = []
        while not self.free:
            out += self.place()
        self.put(self.free.pop(), (doc, start, ids, total, free))
        return out

    def put(self, k: int, x: tuple) -> None:
        self.wait[k] = x
        self.want[:, k] = demand(x)

    def take(self, k: int) -> tuple:
        x, self.wait[k] = self.wait[k], None
        self.want[:, k] = 0
        self.free.append(k)
        return x

    def put_down(self, x: tuple) -> None:
        self.fill.append(x)
        self.left -= demand(x)

    def best(self) -> int | None:
        """The waiting piece that the heuristic places next; none fits: None."""
        w = self.want
        fits = (w[0] > 0) & (w[0] <= self.left[0]) & (w[1] <= self.left[1]) & (w[2] <= self.left[2])
        score = np.where(fits, (self.left / self.limits**2) @ w, -1.0)
        k = int(score.argmax())
        return k if fits[k] else None

    def longest(self) -> tuple[int, int]:
        """The waiting piece of which most tokens fit, and how many those are."""
        w = self.want
        n = np.minimum(np.minimum(w[0], self.left[0]), w[0] - w[2] + self.left[2]) * (self.left[1] >= 1)
        k = int(n.argmax())
        return k, int(n[k])

    def place(self) -> list[tuple]:
        """Moves one piece, or the head of one, into the open sequence; where nothing fits that is closed."""
        k = self.best()
        if self.cut and (k is None or self.left[1] == 1):  # the last segment should use up what is left
            at, n = self.longest()
            if n > (0 if k is None else self.want[0, k]):
                if n == self.want[0, at]:
                    self.put_down(self.take(at))
                else:
                    head, rest = split(self.wait[at], n)
                    self.put_down(head)
                    self.put(at, rest)
                return self.close() if self.left[0] == 0 else []
        if k is None:
            return self.close()
        self.put_down(self.take(k))
        return self.close() if self.left[0] == 0 else []

    def close(self) -> list[tuple]:
        """Rows of the open sequence, which is then empty."""
        pieces, rows = self.fill, []
        self.fill, self.left = [], self.limits.copy()
        for part in powers(pieces) if self.cut and self.ending and pieces else [pieces] * bool(pieces):
            at = 0
            for doc, start, ids, total, free in part:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, n - free, self.next, at))
                at += n
            self.next += 1
        return rows

    def end(self) -> Iterator[tuple]:
        """Empties the pool."""
        self.ending = True
        while len(self.free) < len(self.wait):
            yield from self.place()
        yield from self.close()


def demand(x: tuple) -> tuple[int, int, int]:
    """Tokens, segments and loss-bearing tokens of a piece."""
    return len(x[2]) // 4, 1, len(x[2]) // 4 - x[4]


def split(x: tuple, n: int) -> tuple[tuple, tuple]:
    """A piece's first n tokens, and the others."""
    doc, start, ids, total, free = x
    return (doc, start, ids[: 4 * n], total, min(free, n)), (doc, start + n, ids[4 * n :], total, max(free - n, 0))


def powers(pieces: list[tuple]) -> Iterator[list[tuple]]:
    """The pieces cut into sequences whose lengths are powers of two, which need no padding."""
    rest, n = pieces[::-1], sum(len(x[2]) // 4 for x in pieces)
    while n:
        room, own = 1 << (n.bit_length() - 1), []
        n -= room
        while room:
            x = rest.pop()
            if len(x[2]) // 4 > room:
                x, tail = split(x, room)
                rest.append(tail)
            own.append(x)
            room -= len(x[2]) // 4
        yield own


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 2048,
    max_segments: int = 512,
    max_loss: int = 2048,
    end_id: int = 1,
    cut: bool = True,
    tokenizer: Callable | None = None,
    tokenizers: str | None = None,
    prompt_col: str | None = None,
    prompt_share: float = 0.0,
) -> DataFrame:
    """One row for each piece: where it comes from and where it stands.

    Each text becomes its token ids and ``end_id``.  A document's prompt bears no
    loss: ``prompt_col`` names a text that precedes the text (instruction data), or
    the prompt is this share of the document's tokens, rounded down, and its first
    token at least.  Examples longer than a sequence holds are cut, so no token is
    lost; with ``cut`` false nothing else is cut, and a piece that bears more loss
    than ``max_loss`` is an error.  ``tokenizers`` is the folder of the vocabulary files.

    Null or empty text: the end id alone.  Very long texts are tokenized part by
    part.  Repeated ids: each row is packed for itself.  Null ids stay null.  An
    empty table gives no rows.  Other columns are ignored.
    """
    limits = (max_tokens, max_segments, max_loss)
    if min(limits) < 1 or not 0 <= prompt_share <= 1:
        raise ValueError("limits must be positive, shares from 0 to 1")

    def make():
        tok = tokenizer() if tokenizer else Tokenizer(tokenizers)
        packer = Packer(limits, TaskContext.get().partitionId() << 40, cut)

        def row(x):
            doc, text, *prompt = x
            ids = tok.ids(prompt[0]) if prompt and prompt[0] else array("I")
            free = len(ids)
            ids.extend(tok.ids(text or ""))
            ids.append(end_id)
            total, out, at = len(ids), [], 0
            if not prompt:
                free = max(1, int(prompt_share * total))
            while at < total:
                own = max(free - at, 0)
                n = min(total - at, max_tokens, own + max_loss) if cut else min(total - at, max_tokens)
                if n - min(own, n) > max_loss:
                    raise ValueError(f"document {doc} has a piece with over {max_loss} loss-bearing tokens")
                out += packer.add(doc, at, ids[at : at + n].tobytes(), total, min(own, n))
                at += n
            return out

        row.close = packer.end
        return row

    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(prompt_col).alias("prompt")] if prompt_col else [])]
    return map_rows(docs.select(*cols), make, SCHEMA)


#: How documents are packed for training: eight segments, a quarter of each document as its
#: prompt, and loss on seven eighths of a sequence at most.
TRAINING = {"max_segments": 8, "max_loss": 1792, "prompt_share": 0.25}


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens, under all three limits."""
    from .common import documents

    return pack(documents(spark, sf_dir), **TRAINING)
