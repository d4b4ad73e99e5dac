"""Joins and numbering that keep working when one key holds a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nightframe.functions.numeric import as_col
from nightframe.session import ensure_checkpoint_dir

SALTS = 16
BROADCAST_ROWS = 100_000


def lookup_join(large: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner",
                salts: int = SALTS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join data with skewed keys to a table of one row per key.

    The lookup table is computed once, into a checkpoint, and counted.  Up to
    ``broadcast_rows`` rows it is broadcast, and the data is not shuffled at all.  Beyond
    that it is copied ``salts`` times and each data row goes to one copy, chosen by a hash
    of its content and its input partition (both stable under task retries), so a hot key
    is spread over that many tasks.
    """
    ensure_checkpoint_dir(small.sparkSession)
    small = small.checkpoint()
    if small.count() <= broadcast_rows:
        return same_group(large, F.broadcast(small), keys, how)
    salt = F.pmod(F.xxhash64(*large.columns, F.spark_partition_id()), F.lit(salts)).cast("int")
    left = large.withColumn("_salt", salt)
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return same_group(left, right, [*keys, "_salt"], how).drop("_salt")


def same_group(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join in which null matches null, so that no row of ``left`` is lost to a null key."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"_right_{k}" for k in keys])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str) -> DataFrame:
    """Zero-based position within ``keys`` in ``order``, without a whole key in one task.

    ``bucket`` must never decrease along ``order``.  Rows are numbered inside
    (keys, bucket); the rows before a bucket come from running totals over the much
    smaller table of bucket counts.  Keys and bucket are one struct, which is never null and
    equal where its fields are, nulls included; so the join is a plain one and finds the rows
    where the window's exchange has put them.
    """
    tagged = df.withColumn("_group", F.struct(*keys, bucket.alias("_bucket")))
    local = tagged.withColumn("_local", F.row_number().over(W.partitionBy("_group").orderBy(*order)))
    counts = tagged.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"))
    ahead = W.partitionBy(*[f"_group.{k}" for k in keys]).orderBy("_group._bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_group", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_start"))
    joined = local.join(starts, "_group")
    return joined.withColumn(out, (F.col("_start") + F.col("_local") - 1).cast("bigint")).drop("_group", "_local", "_start")


def prefix_totals(totals: DataFrame, order: Sequence[str], value: str, out: str, fan: int = 64) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over all rows before in ``order``, by tree prefix sums.

    Rows are cut into ranges of the order; inside a range a window adds up.  The ranges' totals are added up in
    groups of ``fan``, those groups' totals again, until one group is left: every window has a partition, and
    those above the ranges see ``fan`` rows.  The ranges are checkpointed (totals only, not the rows they
    stand for), because each level must see the same ones.
    """
    ensure_checkpoint_dir(totals.sparkSession)
    ranged = totals.repartitionByRange(*order).withColumn("_range", F.spark_partition_id().cast("bigint")).checkpoint()
    earlier = lambda keys, by: F.coalesce(F.sum("_sum").over(W.partitionBy(keys).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    level = ranged.groupBy(F.col("_range").alias("_at")).agg(F.sum(value).alias("_sum"))
    count = (ranged.agg(F.max("_range")).first()[0] or 0) + 1
    levels = []
    while True:
        grouped = level.withColumn("_up", F.floor(F.col("_at") / fan))
        levels.append(grouped.select("_at", "_up", earlier("_up", ["_at"]).alias("_ahead")))
        count = -(-count // fan)
        if count == 1:
            break
        level = grouped.groupBy(F.col("_up").alias("_at")).agg(F.sum("_sum").alias("_sum"))
    # down again: what is ahead of a range is what is ahead of its group and what is ahead of it there
    ahead = levels[-1].select("_at", "_ahead")
    for below in reversed(levels[:-1]):
        above = ahead.select(F.col("_at").alias("_up"), F.col("_ahead").alias("_more"))
        ahead = below.join(above, "_up").select("_at", (F.col("_ahead") + F.col("_more")).alias("_ahead"))
    inside = ranged.withColumn("_sum", F.col(value)).withColumn("_inside", earlier("_range", order))
    joined = inside.join(ahead.withColumnRenamed("_at", "_range"), "_range")
    return joined.withColumn(out, F.col("_ahead") + F.col("_inside")).drop("_sum", "_range", "_inside", "_ahead")


def globally_numbered(df: DataFrame, order: Sequence[str], lead: str, chunk: Column, out: str) -> DataFrame:
    """Zero-based position in a total order over the whole table.

    Three levels: rows inside (lead, chunk), chunks inside one ``lead`` value, and ``lead`` values among each
    other by tree prefix sums over their counts; nothing is ordered in one place.
    """
    inside = numbered(df, [lead], order, chunk, "_inside")
    totals = df.groupBy(lead).agg(F.count(F.lit(1)).alias("_rows"))
    starts = prefix_totals(totals, [lead], "_rows", "_before").select(lead, "_before")
    return (
        same_group(inside, starts, [lead])
        .withColumn(out, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_before", "_inside")
    )


def following_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                    value: str, out: str) -> DataFrame:
    """``value`` of the next row within ``keys``, where ``value`` is the first order column.

    The next row is in the same bucket, or it is the smallest value of the next bucket.
    """
    tagged = df.withColumn("_group", F.struct(*keys, bucket.alias("_bucket")))
    local = tagged.withColumn("_next", F.lead(value).over(W.partitionBy("_group").orderBy(*order)))
    firsts = tagged.groupBy("_group").agg(F.min(value).alias("_first"))
    by_key = W.partitionBy(*[f"_group.{k}" for k in keys]).orderBy("_group._bucket")
    nexts = firsts.select("_group", F.lead("_first").over(by_key).alias("_after"))
    return local.join(nexts, "_group").withColumn(out, F.coalesce("_next", "_after")).drop("_group", "_next", "_after")


def zero_filled_counts(df: DataFrame, label: str, classes: Sequence[str], by: Sequence[str] = (),
                       out: str = "count") -> DataFrame:
    """Count of every listed class, present or not, in class order; one pass and no join."""
    counts = df.groupBy(*by).agg(*[F.count_if(as_col(label) == c).alias(f"_c{i}") for i, c in enumerate(classes)])
    entries = F.array(
        *[
            F.struct(F.lit(c).alias(label), F.lit(i).alias("class_position"), F.col(f"_c{i}").alias(out))
            for i, c in enumerate(classes)
        ]
    )
    return counts.select(*by, F.inline(entries))
