"""Small tables with the odd cases that every operator must take."""

import random

TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "Two words",
    "The quick brown fox jumps over the lazy dog. " * 3,
    "The quick brown fox jumps over the lazy dog. " * 3,
    "Élan vital ΑΣ ſtraße ﬁ 漢字 😀 <|endoftext|> <s> it's ▁x  y\r\nz\x1c",
    "x" * 5000,
    "word " * 3000,
    "HELLO!! WORLD!! " * 20,
]


def passage(seed: int, n: int = 70) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


def documents(spark, texts=TEXTS, more=(), ids=None):
    """Documents with a repeated row, a null id and extra columns whose names clash with those that operators use."""
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), 7, "k") for i, t in enumerate([*texts, *more])]
    rows += [rows[5], (None, "a null id", "en", "s1", 9, 7, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, h string")


def plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
