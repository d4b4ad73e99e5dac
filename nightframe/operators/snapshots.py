"""Comparing two inventories of files by path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

CHANGES = ("created", "modified", "removed", "reused")


def change_type(before_present: Column, after_present: Column, same: Column) -> Column:
    return (
        F.when(~before_present, "created")
        .when(~after_present, "removed")
        .when(same, "reused")
        .otherwise("modified")
    )


def diff(before: DataFrame, after: DataFrame, key: str = "path", attributes: Sequence[str] = ("size", "digest")) -> DataFrame:
    """One row per path on either side, with the attributes of both and the kind of change.

    Paths are unique on each side, so the full outer join has no hot key.
    """
    b = before.select(key, *[F.col(a).alias(f"before_{a}") for a in attributes], F.lit(True).alias("_b"))
    a = after.select(key, *[F.col(c).alias(f"after_{c}") for c in attributes], F.lit(True).alias("_a"))
    same = F.lit(True)
    for c in attributes:
        same = same & F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}"))
    joined = b.join(a, key, "full_outer")
    return joined.withColumn(
        "change_type", change_type(F.col("_b").isNotNull(), F.col("_a").isNotNull(), same)
    ).drop("_a", "_b")


def change_counts(changes: DataFrame, required: DataFrame | None = None, key: str = "path") -> DataFrame:
    """Zero-filled counts per kind of change; invalid when a required path is missing or removed."""
    counts = changes.agg(
        *[F.count_if(F.col("change_type") == c).alias(f"{c}_count") for c in CHANGES]
    )
    if required is None:
        return counts.withColumn("status", F.when(F.col("removed_count") > 0, "invalid").otherwise("valid"))
    present = changes.filter("change_type <> 'removed'").select(key)
    lost = required.select(key).join(present, key, "left_anti").agg(F.count(F.lit(1)).alias("missing_required"))
    return counts.join(F.broadcast(lost), F.lit(True)).withColumn(
        "status", F.when(F.col("missing_required") > 0, "invalid").otherwise("valid")
    )


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """(only_left, only_right): rows, repeats counted, that one table has and the other lacks.

    One signed count per distinct row, combined before the shuffle, reads each table once.
    """
    signed = left.withColumn("_sign", F.lit(1)).unionByName(right.withColumn("_sign", F.lit(-1)))
    surplus = signed.groupBy(*left.columns).agg(F.sum("_sign").alias("_more"))
    return surplus.agg(
        F.coalesce(F.sum(F.greatest(F.col("_more"), F.lit(0))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("_more"), F.lit(0))), F.lit(0)).alias("only_right"),
    )
