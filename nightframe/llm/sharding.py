"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` cells. Virtual nodes, hashed from shard and number, sit at cells; a document's
place is the hash of its text, so equal texts lie together, and it belongs to the next virtual node
clockwise. A shard takes no more than ``1 + slack`` times the mean size: what a full shard cannot take
continues clockwise to the next virtual node whose shard has room. So sizes are near equal by
guarantee (to within half a document), and a changed shard count moves little besides that share.

Only the sizes of the cells, a fixed number, reach the driver, which decides where a cell's running
size passes to another shard. A document's place in its cell comes from running sums in two levels:
cells are cut by a hash of the id into ``PARTS`` parts, so a text that a third of all rows share is
summed and numbered in many tasks. Numbers within a shard come from the same parts.

A null text has no bytes and size 1. Rows equal in id and text are separate rows, next to each other,
each with its own slot. Null ids are allowed. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightframe.llm import common

CELLS, PARTS, VIRTUAL = 4096, 256, 64


def ring(shards: int, virtual: int = VIRTUAL, cells: int = CELLS) -> list[int]:
    """The shard that owns each cell: that of the next virtual node clockwise."""
    points: dict[int, int] = {}
    for shard in range(shards):
        for v in range(virtual):
            cell = int(hashlib.md5(f"{shard}:{v}".encode()).hexdigest()[:15], 16) * cells >> 60
            points.setdefault(cell, shard)  # where two meet, the lower shard stays
    owners, owner = [0] * cells, points[min(points)]
    for cell in reversed(range(cells)):
        owner = points.get(cell, owner)
        owners[cell] = owner
    return owners


def plan(totals: dict[int, int], shards: int, slack: float, owners: list[int]) -> list[tuple[int, int, int, int]]:
    """(cell, from, upto, shard) of running sizes: own cells first, then what overflows, clockwise."""
    cells, everything = len(owners), sum(totals.values())
    room = [-(-int(everything * (1 + slack) * 1024) // (shards * 1024)) + 1] * shards
    out, spilled = [], []
    for cell in sorted(totals):
        owner, size = owners[cell], totals[cell]
        fits = min(size, room[owner])
        room[owner] -= fits
        if fits:
            out.append((cell, 0, fits, owner))
        if fits < size:
            spilled.append((cell, fits, size))
    for cell, start, size in spilled:
        at = cell
        while start < size:
            at = (at + 1) % cells
            fits = min(size - start, room[owners[at]])
            if fits:
                room[owners[at]] -= fits
                out.append((cell, start, start + fits, owners[at]))
                start += fits
    return out


def assign(docs: DataFrame, shards: int = 16, slack: float = 0.0005) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = docs.sparkSession
    place = F.conv(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    rows = common.keyed(docs, "doc_id", "text").select(
        "doc_id",
        "k_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        place.alias("place"),
    )
    rows = rows.withColumn("cell", F.shiftright("place", 60 - (CELLS.bit_length() - 1)).cast("int"))
    rows = common.staged(rows.withColumn("part", F.pmod(F.xxhash64("k_id"), F.lit(PARTS)).cast("int")), "placed")

    parts = rows.groupBy("cell", "part").agg(F.sum("size").alias("bytes"))
    totals = {r["cell"]: r["bytes"] for r in parts.groupBy("cell").agg(F.sum("bytes").alias("bytes")).collect()}  # CELLS rows at most
    pieces = plan(totals, shards, slack, ring(shards))
    pieces = F.broadcast(spark.createDataFrame(pieces, "cell int, from long, upto long, shard int"))  # a few per cell at most

    upto = Window.unboundedPreceding
    part_start = parts.select("cell", "part", F.coalesce(F.sum("bytes").over(Window.partitionBy("cell").orderBy("part").rowsBetween(upto, -1)), F.lit(0)).alias("start"))
    inside = Window.partitionBy("cell", "part").orderBy("place", "k_id", "text_crc32", "size")
    running = rows.withColumn("before", F.coalesce(F.sum("size").over(inside.rowsBetween(upto, -1)), F.lit(0)))
    at = 2 * (F.col("start") + F.col("before")) + F.col("size")  # twice the middle of the document
    dealt = running.join(part_start, ["cell", "part"]).withColumn("at", at)
    dealt = dealt.join(pieces, "cell").filter((F.col("at") >= 2 * F.col("from")) & (F.col("at") < 2 * F.col("upto")))

    numbered = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("cell", "part", "shard").orderBy("before")))
    counts = dealt.groupBy("shard", "cell", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(upto, -1)
    counts = counts.select("shard", "cell", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    out = numbered.join(counts, ["cell", "part", "shard"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
