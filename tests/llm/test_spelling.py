"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from nightframe.llm import spelling
from tests.llm.helpers import awkward

LOWER = {i: i + 32 for i in range(65, 91)}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def plain_variants(rows, every):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    n = {w: c for w, c in seen.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        if others and n[best := min(others, key=lambda v: (-n[v], v))] >= 2 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def of(docs, every):
    got = spelling.variants(docs, every=every).collect()
    assert len({r["word"] for r in got}) == len(got)
    return {r["word"]: tuple(r)[1:] for r in got}


def test_small_alphabet_equals_all_pairs(spark):
    """Few letters make dense tries: long shared stretches, repeated letters, words that begin others."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(4, 9))) for _ in range(700)] + ["a" * k for k in range(5, 40)] + ["ab" * 40 + x for x in ("", "a", "b", "ba")]
    rows = [(i if i % 5 else None, " ".join(rng.choices(words, k=200)) + " " + " ".join(words[-39:])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("word", "n", "wid", "ch", "node", "run", "id", "a.b"):
        docs = docs.withColumn(name, F.lit("clash"))
    got, want = of(docs, 7), plain_variants(rows, 7)
    assert got == want
    assert sum(v[3] for v in want.values()) > 1000 and any(v[0] and v[1] != v[0] for v in want.values())


def test_awkward_rows_and_empty_table(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    long = "ACGT" * 500 + "GATTACA" * 300  # one run of 4,100 letters, and a copy with a letter less
    rows += [(100 + i, f"{long} {long[:3000]}{long[3001:]} colour color Colour× favourite " * 2) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = of(docs, 97)
    assert got == plain_variants(rows, 97) and got[long.lower()][3] == 1
    assert spelling.variants(docs.limit(0), every=97).count() == 0


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    """Tables as small as these would all be broadcast; on large ones Spark's estimate is too low by far."""
    plans, plain = [], spelling.common.staged

    def staged(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, label)

    monkeypatch.setattr(spelling.common, "staged", staged)
    docs = spark.createDataFrame([(i, "colour " * 6 + "color colours colors colouring coloring colourings harbour harbours") for i in range(5)], "doc_id long, text string")
    out = spelling.variants(docs)
    assert out.count() == 9
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("SortMergeJoin") for p in plans) >= 10 and not any("Broadcast" in p for p in plans)
