"""Packing: every id in one piece, windows without gaps, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nightframe.llm import packing
from nightframe.llm.packing import Windows, placed_online
from tests.llm.helpers import awkward, prose

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def checked(spark, docs, width, **more):
    """Tokens of each sequence, after the pieces were held against whole texts."""
    coder = Tokenizer.from_file(TOKENIZER)
    got = packing.packed(docs, TOKENIZER, width=width, **more).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = sorted((str(d), np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t in texts)
    # documents that share an id cannot be told apart by it: their pieces are held together
    have, need = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and r["start"] + r["length"] <= r["doc_tokens"]
        have[str(r["doc_id"]), r["doc_tokens"]] += [(r["start"] + i, r["ids"][4 * i : 4 * i + 4]) for i in range(r["length"])]
    for d, ids in want:
        need[d, len(ids) // 4] += [(i, ids[4 * i : 4 * i + 4]) for i in range(len(ids) // 4)]
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in need.items()}
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    fills = []
    for pieces in sequences.values():
        upto = 0
        for offset, length in sorted(pieces):
            assert offset == upto and length > 0
            upto += length
        assert upto <= width
        fills.append(upto)
    return fills


def test_awkward_rows(spark):
    docs = awkward(spark).withColumn("a.b", F.lit(1))
    for more in ({}, {"most_open": 2, "cut": 10**6, "fan": 2}, {"most_open": 3, "cut": 1, "fan": 2}):
        checked(spark, docs.repartition(7), 64, **more)
    assert packing.packed(docs.limit(0), TOKENIZER).count() == 0


def test_long_text_and_little_padding(spark):
    rows = [(i, prose(i, 5 + i * 7 % 400)) for i in range(600)] + [(1000, prose(1, 500_000)), (1001, None)]  # some 2 MB
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    fills = checked(spark, docs, 2048)
    assert sum(fills) > 0.99 * 2048 * len(fills)
    report = packing.report(docs, TOKENIZER).filter("doc_id = 1001").first()
    assert report["ids_crc32"] == zlib.crc32(np.uint32(1).tobytes()) and report["doc_tokens"] == 1


def test_online_placing_is_best_fit_and_bounded():
    rng, windows, filled = random.Random(2), Windows(100), []
    for i in range(3000):
        length = rng.randrange(1, 100)
        rooms = [room for room, held in windows.by_room.items() if held and room >= length]
        before = windows.count
        out = list(placed_online(windows, (i, 0), length, 8, 5))
        filled += out
        if rooms and not out:
            assert min(rooms) - length in windows.by_room and windows.count == before
        assert windows.count <= 8
    assert all(95 < sum(n for _, _, n in w) <= 100 for w in filled)
    placed = sorted(p for w in [*filled, *(w for w, _ in windows.drain())] for p in w)
    assert len({d for d, _, _ in placed}) == 3000
