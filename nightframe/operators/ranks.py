"""Average ranks over a whole column, and rank correlation.

A rank needs a total order of the column.  The column is first reduced to its distinct
values with counts (ties collapse, however many there are), the distinct values are
range-partitioned, and each partition only needs the total weight of the partitions
before it: one small row per partition.  The range partitioning is checkpointed because
two branches of the plan must see the very same partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from nightframe.session import ensure_checkpoint_dir

HEAVY_SHARE = 1000
#: Long rows (one per row and column) that one task orders or joins; there are as many tasks as that asks for.
TASK_ROWS = 500_000


def row_parts(spark: SparkSession, rows: int) -> int:
    """Partitions for so many long rows: what a task holds does not grow with the table."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def value_ranks(long_df: DataFrame, keys: Sequence[str], value: str = "value", parts: int | None = None) -> DataFrame:
    """(keys, value, weight, average_rank): ties share the mean of their ranks, from 1."""
    spark = long_df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = parts or row_parts(spark, long_df.count())
    distinct = long_df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("weight"))
    ranged = (
        distinct.repartitionByRange(parts, *keys, value)
        .withColumn("_part", F.spark_partition_id())
        .checkpoint()
    )
    totals = ranged.groupBy(*keys, "_part").agg(F.sum("weight").alias("_w"))
    ahead = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # A key starts in at most one partition per boundary, so rows with something
    # ahead of them number fewer than the partitions: safe to broadcast.
    carried = totals.withColumn("_ahead", F.sum("_w").over(ahead)).filter("_ahead > 0").drop("_w")
    local = W.partitionBy(*keys, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    upto = ranged.repartition(parts, *keys, "_part").withColumn("_upto", F.sum("weight").over(local))
    return upto.join(F.broadcast(carried), [*keys, "_part"], "left").select(
        *keys, value, "weight",
        (F.coalesce("_ahead", F.lit(0)) + F.col("_upto") - (F.col("weight") - 1) / 2.0).alias("average_rank"),
    )


def attach_ranks(long_df: DataFrame, ranks: DataFrame, keys: Sequence[str], row_key: Sequence[str],
                 value: str = "value", parts: int | None = None) -> DataFrame:
    """Give each long row the rank of its value.

    A value held by at least 1/1000 of the rows of its key is joined by broadcast: there
    can be at most 1000 of those per key and the keys are column names.  The rest meet in
    a shuffle join, where no value is hot any more; rows already served travel under
    spread-out slots that match nothing.  The data is read once, so row keys stay consistent.
    """
    on = [*keys, value]
    sizes = ranks.groupBy(*keys).agg(F.sum("weight").alias("_n"))
    heavy = (
        ranks.join(F.broadcast(sizes), list(keys))
        .filter(F.col("weight") * HEAVY_SHARE >= F.col("_n"))
        .select(*on, F.col("average_rank").alias("_heavy_rank"))
    )
    named = {k: f"_right_{k}" for k in on}
    light = ranks.select(*[F.col(k).alias(n) for k, n in named.items()], "average_rank", F.xxhash64(*on, F.lit(0)).alias("_right_code"))
    spread = F.pmod(F.xxhash64(*row_key), F.lit(max(64, parts or 0))).cast("int") + 1
    met = long_df.join(F.broadcast(heavy), on, "left").withColumn("_slot", F.when(F.col("_heavy_rank").isNull(), F.lit(0)).otherwise(spread))
    met = met.withColumn("_code", F.xxhash64(*on, "_slot"))
    # the code is the only key: a double as key is normalized by the join, which would then deal both sides anew, to
    # the fixed number of partitions; that the values are the same is asked of the few rows that share a code
    same = (F.col("_code") == F.col("_right_code")) & (F.col("_slot") < 1)
    for k, n in named.items():
        same = same & (F.col(k) <= F.col(n)) & (F.col(k) >= F.col(n))
    if parts:
        met, light = met.repartition(parts, "_code"), light.repartition(parts, "_right_code")
    return (
        met.join(light, same, "left")
        .withColumn("_rank", F.coalesce("_heavy_rank", "average_rank"))
        .drop("_slot", "_heavy_rank", "_code", "_right_code", "average_rank", *named.values())
        .withColumnRenamed("_rank", "average_rank")
    )


def spearman_pairs(df: DataFrame, columns: Sequence[str], row_key: Sequence[str] | None = None) -> DataFrame:
    """(feature_left, feature_right, spearman_correlation) for every pair left < right in column order.

    Without a row key the scan position serves as one.  That is stable only on a table
    scan, so pass a key for anything that comes out of a shuffle.
    """
    source = df
    if row_key is None:
        source = df.withColumn("_row", F.monotonically_increasing_id())
        row_key = ["_row"]
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long_df = source.select(*row_key, F.inline(entries))
    parts = row_parts(df.sparkSession, df.count() * len(columns))
    ranks = value_ranks(long_df.select("feature", "value"), ["feature"], parts=parts)
    ranked = attach_ranks(long_df, ranks, ["feature"], row_key, parts=parts)
    wide = ranked.repartition(parts, *row_key).groupBy(*row_key).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("average_rank"))).alias(c) for c in columns]
    )
    return correlation_pairs(wide, columns, "spearman_correlation")


def correlation_pairs(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Pearson correlation of each unordered column pair: one aggregation, one result row, unpivoted."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    one = df.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    entries = F.array(
        *[
            F.struct(F.lit(a).alias("feature_left"), F.lit(b).alias("feature_right"), F.col(f"_{i}").alias(out))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return one.select(F.inline(entries))
