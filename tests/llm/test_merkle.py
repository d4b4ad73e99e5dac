"""The Merkle manifest against trees built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from nightframe.llm import merkle
from tests.llm.helpers import awkward, prose

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes):
    """(root, per leaf its (place in run, siblings) from the bottom up)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p - p % 3 : p - p % 3 + 3]
            paths[i].append((p % 3, [h for j, h in enumerate(run) if j != p % 3]))
        nodes = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [p // 3 for p in at]
    return (nodes or [None])[0], paths


def plain_manifest(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = own, *plain_tree([plain_leaf(r) for r in own])
    root, upper = plain_tree([trees[s][1] for s in sources])
    for s, above in zip(sources, upper, strict=True):
        for row, path in zip(trees[s][0], trees[s][2], strict=True):
            siblings = [h for _, others in path + above for h in others]
            text, hit = row[4], row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            h = plain_leaf((*row[:4], text.replace("\n", "") if text is not None and hit else text))
            for place, others in path + above:
                h = digest(*others[:place], h, *others[place:])
            out.append((row[0], plain_leaf(row), trees[s][1], root, digest(*siblings), h, h == root))
    return out


def of(spark, rows, **more):
    docs = spark.createDataFrame(rows, FIELDS)
    for name in ("idx", "m", "h", "level", "path", "known", "a.b"):
        docs = docs.withColumn(name, F.lit("clash"))
    return merkle.manifest(docs, merkle.without_newlines())


def test_trees_of_all_sizes_equal_plain_ones(spark):
    rng = random.Random(4)
    rows = []
    for i, size in enumerate((1, 2, 3, 4, 10, 28, 90)):  # sources of many heights, one with two thirds of the rows
        source = None if i == 3 else f"s{i}é" if i % 2 else f"s{i}"
        rows += [(rng.randrange(10**6), source, rng.choice(["en", None]), rng.choice([None, k]), rng.choice(["a\nb", "x" * k, "", None])) for k in range(size)]
    got = [tuple(r) for r in of(spark, rows).collect()]
    assert sorted(got, key=str) == sorted(plain_manifest(rows), key=str)
    assert len({r[3] for r in got}) == 1 and {r[6] for r in got} == {True, False}


def test_awkward_rows(spark):
    docs = awkward(spark).withColumn("lang", F.lit("en")).withColumn("n_chars", F.char_length("text").cast("long"))
    long = (99, "a", None, None, prose(7, 400_000))  # some 1.5 MB
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()] + [long] + [(7, "a", "en", 1, "same\ntext")] * 5
    got = [tuple(r) for r in of(spark, rows).collect()]
    assert sorted(got, key=str) == sorted(plain_manifest(rows), key=str)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)]])
def test_empty_table_and_lone_row(spark, rows):
    got = [tuple(r) for r in of(spark, rows).collect()]
    assert got == plain_manifest(rows)
    if rows:
        assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == digest()
