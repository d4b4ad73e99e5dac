"""Grouped robust summaries, outlier and box reports, class shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from nightframe.operators.quantiles import exact_quantiles, long_form, wide_quantile
from nightframe.operators.skew import same_group, zero_filled_counts
from nightframe.schemas import KEY_FEATURES, STAGES


def class_distribution(df: DataFrame, label: str = "sleep_stage", classes: Sequence[str] = STAGES) -> DataFrame:
    """Ordered, zero-filled counts and their share in percent; the window sees one row per class."""
    counts = zero_filled_counts(df, label, classes)
    share = 100.0 * F.try_divide(F.col("count"), F.sum("count").over(W.partitionBy()))
    return counts.withColumn("percentage", share)


def grouped_summary(df: DataFrame, key: str, columns: Sequence[str], bounded: bool | None = None) -> DataFrame:
    """count, mean, population std, quartiles, IQR, min and max per (key, feature).

    Stages are few, so their brackets are broadcast; for any other key they are counted first.
    """
    bounded = key.startswith("sleep_stage") if bounded is None else bounded
    moments = {
        "count": F.count(F.lit(1)), "mean": F.avg("value"), "std": F.stddev_pop("value"),
        "minimum": F.min("value"), "maximum": F.max("value"),
    }
    q = exact_quantiles(df, [key], columns, (0.25, 0.5, 0.75), bounded_keys=bounded, extra=moments)
    return q.select(
        key, "feature", "count", "mean", "std", F.col("q1").alias("median"), F.col("q0").alias("q1"),
        F.col("q2").alias("q3"), (F.col("q2") - F.col("q0")).alias("iqr"), "minimum", "maximum",
    )


def grouped_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Epoch count and one median column per feature."""
    medians = wide_quantile(exact_quantiles(df, keys, columns, (0.5,)), keys, columns)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("epoch_count"))
    return counts.join(medians, list(keys))


def key_feature_summary(df: DataFrame, key: str = "sleep_stage", classes: Sequence[str] = STAGES,
                        columns: Sequence[str] = KEY_FEATURES) -> DataFrame:
    """count, median, quartiles and IQR per (stage, key feature), every listed stage present; count is that of the stage's rows."""
    q = exact_quantiles(df.filter(F.col(key).isin(*classes)), [key], columns, (0.25, 0.5, 0.75), bounded_keys=True)
    counts = zero_filled_counts(df, key, classes)
    wanted = counts.select(key, "class_position", "count", F.explode(F.array(*[F.lit(c) for c in columns])).alias("feature"))
    joined = wanted.join(F.broadcast(q), [key, "feature"], "left")  # both sides: classes x features
    return joined.select(
        key, "feature", "count", F.col("q1").alias("median"), F.col("q0").alias("q1"), F.col("q2").alias("q3"), (F.col("q2") - F.col("q0")).alias("iqr")
    )


def extraction_summary(df: DataFrame, keys: Sequence[str] = ("recording_id", "subject_id", "night"), label: str = "sleep_stage",
                       classes: Sequence[str] = STAGES) -> DataFrame:
    """One row per recording: epochs, flagged epochs by kind, two medians at twelve places, and epochs per class."""
    flags = {"quality_issue_count": "quality_issue_flag", "flatline_count": "flatline_flag", "amplitude_artifact_count": "amplitude_artifact_flag"}
    medians = ("std_uv", "total_band_power_uv2")
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("epoch_count"),
        *[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(n) for n, c in flags.items()],
        *[F.count_if(F.col(label) == c).alias(f"count_{c.lower()}") for c in classes],
    )
    wide = wide_quantile(exact_quantiles(df, keys, medians, (0.5,)), keys, medians)
    joined = same_group(counts, wide, keys, "left")
    return joined.withColumns({f"median_{c}": F.bround(f"median_{c}", 12) for c in medians})


def outlier_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Tukey bounds per feature and how many rows lie strictly outside; no row is removed.

    The bounds table has one row per feature, so it is broadcast.
    """
    bounds = exact_quantiles(df, [], columns, (0.25, 0.75), bounded_keys=True).select(
        "feature", F.col("q0").alias("q1"), F.col("q1").alias("q3")
    ).withColumn("iqr", F.col("q3") - F.col("q1"))
    bounds = bounds.withColumns(
        {"lower_bound": F.col("q1") - 1.5 * F.col("iqr"), "upper_bound": F.col("q3") + 1.5 * F.col("iqr")}
    )
    outside = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    return (
        long_form(df, [], columns)
        .join(F.broadcast(bounds), "feature")
        .groupBy("feature", "q1", "q3", "iqr", "lower_bound", "upper_bound")
        .agg(
            F.count_if(outside).alias("outlier_count"),
            (100.0 * F.count_if(outside) / F.count(F.lit(1))).alias("outlier_percentage"),
            F.min("value").alias("minimum"),
            F.max("value").alias("maximum"),
        )
        .orderBy(F.desc("outlier_percentage"), "feature")
    )


def box_statistics(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Quartiles and whiskers: the most extreme value within 1.5 IQR of the box."""
    q = exact_quantiles(df, [key], columns, (0.25, 0.5, 0.75), bounded_keys=True).select(
        key, "feature", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    return (
        long_form(df, [key], columns)
        .join(F.broadcast(q), [key, "feature"])
        .groupBy(key, "feature", "q1", "median", "q3")
        .agg(
            F.least(F.col("q1"), F.min(F.when(inside, F.col("value")))).alias("whisker_low"),
            F.greatest(F.col("q3"), F.max(F.when(inside, F.col("value")))).alias("whisker_high"),
        )
    )


def constant_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, is_constant): at most one distinct value, null counting as a value.

    Equal minimum and maximum say the same as a distinct count of one, without a set.
    """
    def constant(c):
        some, none = F.count(c), F.count_if(F.col(c).isNull())
        return ((some == 0) | ((none == 0) & (F.min(c) == F.max(c)))).alias(c)

    one = df.agg(*[constant(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("is_constant")) for c in columns])
    return one.select(F.inline(entries))


def missing_cells(df: DataFrame) -> DataFrame:
    per_row = sum((F.col(c).isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    return df.agg(F.sum(per_row).alias("missing_cells"))

