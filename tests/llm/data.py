"""Edge-case documents that every operator has to take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, words string"


def edge_docs():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words) for _ in range(6000))
    block = " ".join(f"shared{i}" for i in range(70))
    texts = [
        (1, "The quick brown fox jumps over the lazy dog."),
        (2, "The quick brown fox  jumps over the lazy dog."),
        (3, "the QUICK brown fox jumps over the lazy dog."),
        (4, None),
        (5, ""),
        (6, " \n \t "),
        (7, long),
        (8, long + " tail"),
        (9, "intro one " + block + " outro one"),
        (10, block),
        (11, "ünïcödé 日本語 😀 　x y \x1c \x85 z\n\n  indented   text\r\nend "),
        (12, "run " * 300),
        (13, "run " * 200 + "stop"),
        (14, "a\n \nb   c\t d"),
        (None, "no id here"),
        (15, "no id here"),
        (16, "same row"),
        (16, "same row"),
        (17, "x" * 40000),
    ]
    return [(i, t, "en", None if k % 3 else "src0", len(t or ""), "k", "clash") for k, (i, t) in enumerate(texts)]


def frame(spark, rows=None):
    return spark.createDataFrame(edge_docs() if rows is None else rows, SCHEMA)
