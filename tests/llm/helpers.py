"""Awkward small tables, and rows of a frame as plain tuples."""

import random

from pyspark.sql import functions as F

WORDS = [a + b for a in ("the", "on", "ér", "sto", "ing", "ver") for b in ("a", "le", "ñd", "ost", "is", "um")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def awkward(spark):
    """Null ids, texts and sources, blanks, repeats, near copies, a long text, clashing column names."""
    base = prose(1, 300)
    near = base.replace(" ", "  ", 1) + " x"
    long = prose(2, 6000)
    rows = [
        (1, base, "a"), (1, base, "a"), (2, base, "b"), (3, near, None), (None, base, "a"), (None, None, None),
        (4, None, "b"), (5, "", "c"), (6, " \n\t ", "c"), (7, long, "a"), (8, prose(3, 60) + "\n" + prose(3, 60) + "\nx\n", "b"),
        (9, "one", "c"), (10, "one two", "c"), (11, "ÀB É ab", None), (12, long[500:9000], "a"), (13, "la " * 700, "b"),
    ] + [(20 + i, prose(50 + i, 40 + i), f"s{i % 3}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("words", "fp", "size", "hash", "k_id", "k_text", "copies", "cell", "edits", "failed", "m", "raw", "places"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
