"""The pipeline stages against plain versions on the smallest tables, and the queries with SQL."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from nightframe.llm import decontaminate, mixing, quality, simhash
from nightframe.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="shared test tables are not here")


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def plain_near(docs):
    """The smallest id of each group, by comparing all pairs of fingerprints."""
    fps = {r["doc_id"]: simhash.set_fingerprints((r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()}
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in fps:
        for b in fps:
            if a < b and any(((x ^ y) & 2**64 - 1).bit_count() <= simhash.NEAR_DISTANCE for x, y in zip(fps[a], fps[b], strict=True)):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted({find(d) for d in fps})


def test_stages_follow_their_operators(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, SF)
    assert ids(good) == ids(quality.judged(docs).filter("kept")) and good.columns == docs.columns
    alone = stages["near_duplicates"](spark, good, SF)
    assert ids(alone) == plain_near(good)
    clean = stages["without_benchmark"](spark, alone, SF)
    assert ids(clean) == ids(decontaminate.contamination(alone, table(spark, SF, "benchmark")).filter("not contaminated"))
    mixed = stages["mixed_sources"](spark, clean, SF)
    assert ids(mixed) == sorted(r["doc_id"] for r in mixing.mixed(clean).collect() for _ in range(r["copies"]))
    last = corpus_pipeline.run(spark, SF)
    assert ids(last) == ids(mixed) and last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_registered_names():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
