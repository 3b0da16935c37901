"""Documents with every awkward case, and a small corpus."""

import random

AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "the same text again and again " * 5), (6, "the same text again and again " * 5), (7, "ünï cödé 東京 🦊 \x01\x02 tab\there"),
    (8, "x" * 5000), (9, "\n".join(f"line {k} of a longer text" for k in range(200))), (None, "no id here but some words of text"), (9, "\n".join(f"line {k} of a longer text" for k in range(200))), (-5, "negative id"),
]
#: Columns that clash with names used inside the operators.
CLASH = ["key", "h", "row", "th", "chunks", "size", "hash", "rank", "copies", "threshold", "source_size", "fp", "least", "data", "own", "n", "list", "part", "block", "v", "q", "row_id", "removed"]


def table(spark, rows, clash=True, lang="en", sources=("a", None, "b")):
    """(doc_id, text) as a documents table with clashing columns."""
    full = [(d, t, lang, sources[i % len(sources)], len(t or "")) for i, (d, t) in enumerate(rows)]
    df = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(f"x{c}").alias(c) for c in CLASH])
    return df


def corpus(n=120, seed=3):
    """Texts over a small vocabulary with copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "su", "te") for b in ("ra", "no", "vi", "du") for c in ("", "n", "s", "th", "la")]
    passage = "\n".join(" ".join(rng.choice(vocab) for _ in range(12)) for _ in range(8))
    rows = []
    for d in range(n):
        kind = rng.random()
        if kind < 0.15 and rows:
            text = rng.choice(rows)[1]
        elif kind < 0.3 and rows:
            words = rng.choice(rows)[1].split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        else:
            text = "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 25))) for _ in range(rng.randrange(1, 12)))
            if kind < 0.5:
                text = f"{text}\n{passage}\n{rng.choice(vocab)}"
        rows.append((d, text))
    return rows


def shuffled(rows, seed=1):
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    return rows
