"""Connected components of a link table by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.llm.common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour to its larger neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours meet at the smallest of them."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))  # v < u
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    met = down.join(least, "u")
    out = met.filter("v > m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return out.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link and isn't its component's smallest; edges: a < b."""
    state, before = staged(edges.select("a", "b").filter("a < b").distinct(), "links"), None
    while True:
        mark = state.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.pmod(F.hash("a", "b"), F.lit(1 << 20))).alias("s")).first()
        if mark == before:
            return state.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = mark
        state = staged(_small_star(_large_star(state)), "stars")
