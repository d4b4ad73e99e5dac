"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

Words are lower-cased (A-Z only); every shingle of three, repeats included, is hashed to 64 bits and
a fingerprint bit is 1 where more than half of the hashes have it. Two fingerprints that differ in at
most ``distance`` bits agree in all but that many of ``blocks`` blocks; each choice of the blocks that
agree is a join key, so every close pair meets under some key and is then verified.

Equal fingerprints collapse to one node before any join, so copies never form pairs. A key under which
many distinct fingerprints meet is not compared pair by pair: it is split again, by the same rule, on
the bits outside the key, where a pair must still agree in all but ``distance`` blocks. No link is lost.

``keep_one`` and ``components_of`` follow that rule with three words and three bits. Two texts that share
80 % of their five-word shingles differ by some ten bits under it, beyond what blocks can find. ``keep_near``
is for most of those: sets of two-word shingles, which such texts share to more than 90 %, ``TABLES`` independent
fingerprints, and a link where any of them is within ``NEAR_DISTANCE`` bits.

Null or blank texts have fingerprint zero and are linked like others. Rows without an id take part but
are no component's name unless nothing else is there (then it is null). An empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.llm import common
from nightframe.llm.components import components

SHINGLE, DISTANCE, BLOCKS = 3, 3, 6
BITS, CROWD = 64, 512


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit fingerprint of one UTF-8 text."""
    words = (text or b"").lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    starts = list(accumulate(map(len, words), lambda at, size: at + size + 1, initial=0))
    n = max(1, len(words) - SHINGLE + 1)
    spans = zip(starts, starts[SHINGLE:], strict=False) if len(words) >= SHINGLE else [(0, len(joined) + 1)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i : j - 1], 42) for i, j in spans), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, k_id, k_text, fp for every row."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "k_id", "k_text")] + [pa.array(fps, pa.int64())], ["doc_id", "k_id", "k_text", "fp"])

    rows = common.keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.short_batches(rows).mapInArrow(run, "doc_id long, k_id long, k_text long, fp long")


def _blocks(bits: list[int], count: int) -> list[int]:
    """Masks of `count` blocks, as even as can be, over the given bit positions."""
    size, more = divmod(len(bits), count)
    masks, at = [], 0
    for i in range(count):
        take = size + (i < more)
        masks.append(sum(1 << b for b in bits[at : at + take]))
        at += take
    return masks


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def links(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, crowd: int = CROWD, label: str | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at most ``distance`` bits apart; nodes: fp.

    With a ``label`` (a column of the nodes) only pairs of different labels count, and the labels are what is returned.

    Keys under which more than ``crowd`` fingerprints meet are split by the same rule on their
    free bits, so that pairs agreeing there in too few blocks are never compared.
    """
    choose = blocks - distance
    masks = [sum(m) for m in combinations(_blocks(list(range(BITS)), blocks), choose)]
    keyed = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("which", "key")
    own = [label] if label else []
    rows = nodes.select("fp", *own, keyed)
    crowded = rows.groupBy("which", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("which", "key")
    crowded = common.staged(crowded, "crowded")
    # per key the masks of the next level: the key's bits and enough blocks of the free ones
    finer = [
        F.array(*[F.lit(_signed(m | sum(c))) for c in combinations(_blocks([b for b in range(BITS) if not m >> b & 1], blocks), choose)])
        for m in masks
    ]
    dense = rows.join(crowded, ["which", "key"], "left_semi")
    dense = dense.select("fp", *own, F.col("which"), F.posexplode(F.element_at(F.array(*finer), F.col("which") + 1)).alias("sub", "mask"))
    dense = dense.select("fp", *own, (len(masks) * (F.col("sub") + 1) + F.col("which")).alias("which"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))

    def close(rows: DataFrame) -> DataFrame:
        a, b = rows.withColumnRenamed("fp", "a"), rows.withColumnRenamed("fp", "b")
        near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
        if not label:
            return a.join(b, ["which", "key"]).filter(near).select("a", "b")
        a, b = a.withColumnRenamed(label, "x"), b.withColumnRenamed(label, "y")
        met = a.join(b, ["which", "key"]).filter(near & (F.col("x") != F.col("y")))
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    sparse = rows.join(crowded, ["which", "key"], "left_anti")
    return close(sparse).unionByName(close(dense)).distinct()


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, k_id, k_text, fp, root, component_id for every row.

    ``root`` (the smallest fingerprint) tells components apart; ``component_id`` (the smallest id)
    only names them: it is null where no row has an id, and components may share one.
    """
    rows = common.staged(fingerprints(docs), "fingerprints")
    nodes = common.staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.select("fp", "root").join(names, "root").select("fp", "root", "component_id"), "fp")


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the one with the smallest id (then text hash).

    Rows equal in id and text collapse to one.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "k_id", "k_text")
    best = groups(docs).groupBy("root").agg(F.min(order).alias("first"))
    best = best.select("first.k_id", "first.k_text")
    rows = common.packed(docs).join(best, ["k_id", "k_text"], "left_semi")
    return rows.dropDuplicates(["k_id", "k_text"]).select("row.*")


#: Two-word sets differ by some six bits at a five-word similarity of 0.8; of four independent fingerprints
#: one has to be within four bits. That finds about four of five lone pairs so far apart, more of closer ones,
#: and more in larger groups, whose members are linked through one another.
NEAR_SHINGLE, NEAR_DISTANCE, NEAR_BLOCKS, TABLES = 2, 4, 7, 4


def _remixed(hashes: np.ndarray, table: int) -> np.ndarray:
    """Hashes of their own for every table, from one pass over the text."""
    x = hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * table)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def set_fingerprints(text: bytes | None, shingle: int = NEAR_SHINGLE, tables: int = TABLES) -> list[int]:
    """One signed 64-bit fingerprint per table, over the set of shingles of one UTF-8 text."""
    words = (text or b"").lower().split()
    if not words:
        return [0] * tables
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    hashes = np.unique(np.fromiter((digest(b" ".join(words[i : i + shingle]), 42) for i in range(n)), np.uint64, n))
    out = []
    for table in range(tables):
        ones, own = np.zeros(BITS, np.int64), _remixed(hashes, table)
        for at in range(0, len(own), 1 << 16):
            part = own[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(own), bitorder="little").view(np.int64)[0]))
    return out


def near_groups(docs: DataFrame, shingle: int = NEAR_SHINGLE, distance: int = NEAR_DISTANCE, blocks: int = NEAR_BLOCKS, tables: int = TABLES) -> DataFrame:
    """doc_id, k_id, k_text, node, root for every row: rows of one root are near-duplicates of each other, link by link."""

    def run(batches):
        for batch in batches:
            fps = [set_fingerprints(t, shingle, tables) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "k_id", "k_text")] + [pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "k_id", "k_text", "fps"])

    rows = common.short_batches(common.keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = rows.mapInArrow(run, "doc_id long, k_id long, k_text long, fps array<long>").withColumn("node", F.xxhash64("fps"))
    rows = common.staged(rows, "fingerprints")
    # rows with all fingerprints equal are one node; nodes that share one of them meet at the smallest
    nodes = rows.select("node", F.posexplode("fps").alias("which", "fp")).distinct()
    nodes = common.staged(nodes, "nodes")
    first = nodes.groupBy("which", "fp").agg(F.min("node").alias("first"))
    first = common.staged(first, "first")
    edges = nodes.join(first, ["which", "fp"]).select(F.col("first").alias("a"), F.col("node").alias("b")).filter("a < b")
    # then stars: under every key the smallest and the largest fingerprint, if close enough. A group of many
    # near copies is mostly joined by these, a few links for each member and not one for each pair.
    masks = [sum(m) for m in combinations(_blocks(list(range(BITS)), blocks), blocks - distance)]
    key = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("mask", "key")
    under, place = ["which", "mask", "key"], F.struct("fp", "first")
    keyed = first.select("which", "fp", "first", key)
    ends = keyed.groupBy(*under).agg(F.array(F.min(place), F.max(place)).alias("ends"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = keyed.join(ends.select(*under, F.explode("ends").alias("end")), under)
    stars = stars.filter((F.col("first") != F.col("end.first")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("end.fp"))) <= distance))
    stars = stars.select(F.least("first", "end.first").alias("a"), F.greatest("first", "end.first").alias("b")).distinct()
    joined = common.staged(components(edges.unionByName(stars)), "joined")
    # no link may be missed: all pairs of fingerprints that meet under a key and are not yet in one component
    part = first.join(joined.withColumnRenamed("node", "first"), "first", "left").select("which", "fp", F.coalesce("root", "first").alias("part"))
    part = common.staged(part, "parts")
    open_keys = part.select("which", "fp", "part", key)
    several = open_keys.groupBy(*under).agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select(*under)
    apart = common.staged(open_keys.join(several, under).select("which", "fp", "part").distinct(), "apart")
    across: DataFrame | None = None
    for which in range(tables):
        found = links(apart.filter(F.col("which") == which).select("fp", "part"), distance, blocks, label="part")
        across = found if across is None else across.unionByName(found)
    last = components(across.distinct())
    out = rows.join(joined, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
    out = out.join(last.withColumnRenamed("node", "part"), "part", "left")
    return out.select("doc_id", "k_id", "k_text", "node", F.coalesce("root", "part").alias("root"))


def keep_near(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group stays, as in ``keep_one``."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "k_id", "k_text")
    best = near_groups(docs).groupBy("root").agg(F.min(order).alias("first")).select("first.k_id", "first.k_text")
    rows = common.packed(docs).join(best, ["k_id", "k_text"], "left_semi")
    return rows.dropDuplicates(["k_id", "k_text"]).select("row.*")
