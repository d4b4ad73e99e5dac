"""Views over the shared test tables that stand in for epochs, features, signals and scores.

Each view reads its whole base table; columns nobody asks for are pruned from the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nightframe.operators.skew import following_value, numbered
from nightframe.schemas import STAGES

HOUR = 3600
ORIGIN = 1704067200  # 2024-01-01T00:00:00Z
EVENT_CODES = {"error": 0, "view": 1, "click": 2, "purchase": 3, "signup": 4}
EVENT_ANNOTATIONS = {
    "error": "Sleep stage W",
    "view": "Sleep stage 1",
    "click": "Sleep stage 2",
    "purchase": "Sleep stage 4",
    "signup": "Movement time",
}
FT_FEATURES = ("delta_power", "theta_power", "alpha_power", "beta_power", "signal_energy")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan with fewer splits than cores out to all cores, before heavy per-row work.

    A table of many files has more splits than cores and is left as it is.  Only for scans:
    asking a plan with shuffles for its partitions would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def literal_map(mapping: dict, key: Column) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def stage_name(code: Column) -> Column:
    return literal_map(dict(enumerate(STAGES)), code)


def epochs(spark: SparkSession, sf: str, positions: bool = False, dealt: bool = False) -> DataFrame:
    """Epoch rows.  ``positions`` adds epoch_id and start_time_sec, which need an order per recording."""
    ev = table(spark, sf, "events")
    if dealt:
        ev = spread(ev.select("user_id", "event_type", "value", "event_id", "ts"))
    code = literal_map(EVENT_CODES, F.col("event_type"))
    df = ev.select(
        F.col("user_id").alias("subject_id"),
        F.concat(F.lit("R"), F.col("user_id").cast("string")).alias("recording_id"),
        F.lit(1).alias("night"),
        stage_name(code).alias("sleep_stage"),
        code.alias("sleep_stage_encoded"),
        F.col("value").alias("v"),
        (F.col("value") > 200).alias("quality_issue_flag"),
        "event_id",
        "ts",
    )
    if not positions:
        return df
    hour = F.floor(F.unix_timestamp("ts") / HOUR)
    return numbered(df, ["recording_id"], ["ts", "event_id"], hour, "epoch_id").withColumn(
        "start_time_sec", F.col("epoch_id") * 30.0
    )


def four_powers(spark: SparkSession, sf: str, dealt: bool = False) -> DataFrame:
    li = table(spark, sf, "lineitem")
    if dealt:
        li = spread(li.select("l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    code = F.pmod(F.col("l_linenumber") - 1, F.lit(5)).cast("int")
    return li.select(
        F.pmod(F.col("l_suppkey"), F.lit(20)).alias("subject_id"),
        F.concat(F.lit("R"), F.pmod(F.col("l_suppkey"), F.lit(20)).cast("string")).alias("recording_id"),
        stage_name(code).alias("sleep_stage"),
        code.alias("sleep_stage_encoded"),
        F.col("l_quantity").alias("delta_power"),
        (F.col("l_extendedprice") / 1000).alias("theta_power"),
        (F.col("l_discount") * 100).alias("alpha_power"),
        (F.col("l_tax") * 100).alias("beta_power"),
        F.col("l_extendedprice").alias("signal_energy"),
    )


def relative_powers(df: DataFrame) -> DataFrame:
    """Plain shares of the four powers (quantity is never zero in the base table)."""
    total = F.col("delta_power") + F.col("theta_power") + F.col("alpha_power") + F.col("beta_power")
    return df.withColumns(
        {f"relative_{b}_power": F.try_divide(F.col(f"{b}_power"), total) for b in ("delta", "theta", "alpha", "beta")}
    )


def signals(spark: SparkSession, sf: str) -> DataFrame:
    em = spread(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    gain = (100.0 * (1 + F.pmod(F.col("vec_id"), F.lit(7)))).cast("double")
    return em.select(
        F.col("vec_id").alias("epoch_id"),
        F.concat(F.lit("S"), F.floor(F.col("vec_id") / 50).cast("string")).alias("recording_id"),
        F.pmod(F.col("vec_id"), F.lit(50)).alias("chunk"),
        F.transform(F.col("embedding").cast("array<double>"), lambda v: v * gain).alias("x"),
    )


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled segments on an hourly grid, with positive duration."""
    ev = table(spark, sf, "events").select(
        F.concat(F.lit("R"), F.col("user_id").cast("string")).alias("recording_id"),
        F.col("user_id").alias("subject_id"),
        (F.floor((F.unix_timestamp("ts") - ORIGIN) / HOUR) * float(HOUR)).alias("onset"),
        "event_id",
        literal_map(EVENT_ANNOTATIONS, F.col("event_type")).alias("label"),
    )
    six_hours = F.floor(F.col("onset") / (6 * HOUR))
    nexts = following_value(ev, ["recording_id"], ["onset", "event_id"], six_hours, "onset", "_end")
    return nexts.withColumn("duration", F.col("_end") - F.col("onset")).drop("_end").filter("duration > 0")


def scored(spark: SparkSession, sf: str, positions: bool = False) -> DataFrame:
    """Rows with truth, five probabilities (array ``p``) and a prediction that mostly is the argmax."""
    base = epochs(spark, sf, positions, dealt=not positions)
    raw = {f"_r{i}": (1 + F.pmod(F.col("event_id") * (7 + 2 * i) + 13 * i * i, F.lit(97))).cast("double") for i in range(5)}
    with_raw = base.withColumns(raw)
    total = F.col("_r0") + F.col("_r1") + F.col("_r2") + F.col("_r3") + F.col("_r4")
    probs = with_raw.withColumn("p", F.array(*[F.col(f"_r{i}") / total for i in range(5)]))
    top = (F.array_position("p", F.array_max("p")) - 1).cast("int")
    return probs.select(
        "subject_id", "recording_id", "night", *(["epoch_id"] if positions else []), "event_id",
        F.pmod(F.col("subject_id"), F.lit(4)).cast("int").alias("cohort"),
        (F.pmod(F.col("subject_id"), F.lit(4)) + 1).cast("int").alias("outer_fold"),
        F.col("sleep_stage_encoded").alias("y_true"),
        F.when(F.pmod(F.col("event_id"), F.lit(50)) == 0, F.pmod(top + 1, F.lit(5))).otherwise(top).alias("y_pred"),
        "p",
    )
