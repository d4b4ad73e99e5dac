"""The legacy feature-table flow: load, report, clean, engineer, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nightframe.operators.cleaning import clean, require_columns, supported_labels
from nightframe.operators.engineering import engineer
from nightframe.schemas import POWER_COLUMNS


def reports(df: DataFrame) -> dict[str, DataFrame]:
    """The five reports on the loaded table."""
    count = F.count(F.lit(1)).alias("epoch_count")
    return {
        "stage_distribution": df.groupBy("sleep_stage").agg(count).orderBy(F.desc("epoch_count"), "sleep_stage"),
        "band_power_by_stage": df.groupBy("sleep_stage").agg(*[F.avg(c).alias(f"avg_{c}") for c in POWER_COLUMNS]),
        "epoch_count_by_subject": df.groupBy("subject_id").agg(count),
        "sample_rows": df.orderBy("subject_id", "epoch_id").limit(10),
        "total_rows": df.agg(F.count(F.lit(1)).alias("total_rows")),
    }


def model_ready(df: DataFrame) -> DataFrame:
    """Supported labels, cleaned, engineered and scaled on all rows, columns in contract order."""
    require_columns(df, ["subject_id", "sleep_stage", *POWER_COLUMNS])
    return engineer(clean(supported_labels(df)))
