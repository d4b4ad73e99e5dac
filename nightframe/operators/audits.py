"""One-pass violation counts for the table contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from nightframe.functions import probability as PR
from nightframe.functions.numeric import grid_distance, is_close, is_finite, is_integer_valued, normalized_error, row_sum
from nightframe.schemas import (
    BANDS, PROBABILITY_COLUMNS, PROBABILITY_TOLERANCE, RELATION_TOLERANCE, STAGE_CODES, STAGES, TIME_TOLERANCE,
    TRUTH_COLUMNS,
)


def violations(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """(check_name, violations): rows for which a test is true, all tests in one scan."""
    one = df.agg(*[F.count_if(F.coalesce(t, F.lit(True))).alias(n) for n, t in tests.items()])
    entries = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("violations")) for n in tests])
    return one.select(F.inline(entries))


def duplicate_keys(df: DataFrame, keys: Sequence[str], name: str = "unique_key") -> DataFrame:
    """How many key values occur more than once; counts combine before the shuffle."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return repeated.agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("violations"))


def require_clean(report: DataFrame) -> None:
    """Raise with the failed checks of a report; the report has one row per check."""
    failed = report.filter("violations > 0").toPandas()
    if len(failed):
        raise ValueError("; ".join(f"{r.check_name}: {r.violations}" for r in failed.itertuples()))


def epoch_audit(df: DataFrame, epoch_seconds: float) -> DataFrame:
    tests = {
        "duration": ~is_close(F.col("end_time_sec") - F.col("start_time_sec"), F.lit(epoch_seconds), TIME_TOLERANCE),
        "known_label": ~F.col("sleep_stage").isin(*STAGES),
        "sample_order": F.col("stop_sample") <= F.col("start_sample"),
        "grid": grid_distance("start_time_sec", epoch_seconds) > TIME_TOLERANCE,
    }
    return violations(df, tests).unionByName(duplicate_keys(df, ["recording_id", "epoch_id"]))


def inspection_audit(report: DataFrame) -> DataFrame:
    """Seven checks of the recording inspection: there are rows, ids are unique, and each recording
    has the default channel, a positive rate and duration, annotations, and sleep labels among them."""
    tests = {
        "default_channel": ~F.col("default_channel_present"),
        "sampling_rate": F.col("sampling_frequency_hz") <= 0,
        "signal_duration": F.col("signal_duration_seconds") <= 0,
        "annotations": F.col("annotation_count") <= 0,
        "sleep_labels": ~F.contains("sleep_labels_json", F.lit("Sleep stage")),
    }
    empty = report.agg(
        F.lit("non_empty").alias("check_name"), F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("bigint").alias("violations")
    )
    return violations(report, tests).unionByName(empty).unionByName(duplicate_keys(report, ["recording_id"]))


def feature_audit(df: DataFrame, features: Sequence[str], keys: Sequence[str], bands: Sequence[str] = tuple(BANDS)) -> DataFrame:
    finite = F.lit(False)
    for c in features:
        finite = finite | ~is_finite(c)
    tests = {
        "finite_flag": ~F.col("is_finite_signal"),
        "finite_features": finite,
        "relative_sum": F.abs(row_sum([f"relative_{b}_power" for b in bands]) - 1.0) > 1e-10,
    }
    return violations(df, tests).unionByName(duplicate_keys(df, keys))


def algebraic_identities(df: DataFrame, bands: Sequence[str] = tuple(BANDS)) -> DataFrame:
    """Largest normalized error of five identities; an error within 1e-9 passes and is shown as zero."""
    errors = {
        "rms_squared_equals_mean_square": normalized_error(F.col("rms_uv") * F.col("rms_uv"), "mean_square_uv2"),
        "energy_equals_mean_square_times_samples": normalized_error(
            "signal_energy_uv2", F.col("mean_square_uv2") * F.col("sample_count")
        ),
        "hjorth_activity_equals_std_squared": normalized_error("hjorth_activity", F.col("std_uv") * F.col("std_uv")),
        "total_power_equals_band_sum": normalized_error("total_band_power_uv2", row_sum([f"{b}_power_uv2" for b in bands])),
        "relative_power_sum_equals_one": F.abs(row_sum([f"relative_{b}_power" for b in bands]) - 1.0),
    }
    one = df.agg(*[F.max(e).alias(n) for n, e in errors.items()])
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("identity"),
                F.when(F.col(n) <= RELATION_TOLERANCE, 0.0).otherwise(F.round(n, 15)).alias("maximum_normalized_error"),
                (F.col(n) <= RELATION_TOLERANCE).alias("passes"),
            )
            for n in errors
        ]
    )
    return one.select(F.inline(entries))


def identifier_audit(df: DataFrame, ids: Sequence[str] = ("subject_id", "night", "epoch_id")) -> DataFrame:
    tests = {f"{c}_integer": ~is_integer_valued(c, 0) for c in ids}
    tests["recording_present"] = F.col("recording_id").isNull() | (F.trim("recording_id") == "")
    return violations(df, tests).unionByName(duplicate_keys(df, [*ids, "recording_id"]))


def dataset_audit(df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Non-empty, complete, finite, at least two subjects, unique keys, exact label mapping."""
    finite = F.lit(False)
    for c in features:
        finite = finite | ~is_finite(F.col(c).cast("double"))
    null = F.lit(False)
    for c in df.columns:
        null = null | F.col(c).isNull()
    code = F.lit(None).cast("int")
    for name, value in STAGE_CODES.items():
        code = F.when(F.col("sleep_stage") == name, F.lit(value)).otherwise(code)
    row_tests = {
        "null_cell": null,
        "finite_features": finite,
        "integer_codes": ~is_integer_valued("sleep_stage_encoded", 0),
        "label_mapping": ~code.eqNullSafe(F.col("sleep_stage_encoded")),
    }
    shape = df.agg(
        F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("bigint").alias("non_empty"),
        F.when(F.min("subject_id") == F.max("subject_id"), 1).otherwise(0).cast("bigint").alias("two_subjects"),
    ).unpivot([], ["non_empty", "two_subjects"], "check_name", "violations")
    return violations(df, row_tests).unionByName(shape).unionByName(duplicate_keys(df, keys))


def prediction_audit(df: DataFrame, tol: float = PROBABILITY_TOLERANCE) -> DataFrame:
    """Recompute every derived column of a prediction frame and count disagreements."""
    p = F.array(*[F.col(c) for c in PROBABILITY_COLUMNS])
    k = len(STAGES)
    name = lambda code: F.element_at(F.array(*[F.lit(s) for s in STAGES]), code + 1)
    tests = {
        "probabilities": ~PR.is_valid(p, k),
        "predicted_label": F.col("predicted_label") != name(F.col("predicted_label_encoded")),
        "argmax": F.col("probability_argmax_label_encoded") != PR.argmax(p),
        "argmax_label": F.col("probability_argmax_label") != name(F.col("probability_argmax_label_encoded")),
        "agreement": F.col("predict_probability_argmax_agree")
        != (F.col("predicted_label_encoded") == F.col("probability_argmax_label_encoded")),
        "confidence": ~is_close("prediction_confidence", PR.confidence(p), tol),
        "margin": ~is_close("prediction_margin", PR.margin(p), tol),
        "entropy": ~is_close("prediction_entropy", PR.entropy(p, k), tol),
        "normalized_entropy": ~is_close("prediction_normalized_entropy", PR.normalized_entropy(p, k), tol),
    }
    known = [c for c in TRUTH_COLUMNS if c in df.columns]
    if known:
        # truth is there as a whole or not at all, for the table and for each row
        given = sum((F.col(c).isNotNull().cast("int") for c in known), F.lit(0))
        tests["truth_complete"] = F.lit(len(known) < len(TRUTH_COLUMNS)) | ((given > 0) & (given < len(TRUTH_COLUMNS)))
    if len(known) == len(TRUTH_COLUMNS):
        tests["truth"] = (given > 0) & (F.col("is_correct") != (F.col("true_label_encoded") == F.col("predicted_label_encoded")))
        tests["truth_label"] = (given > 0) & (F.col("true_label") != name(F.col("true_label_encoded")))
    return violations(df, tests)


def stored_range_audit(df: DataFrame) -> DataFrame:
    """Column ranges of stored rows."""
    import math

    unit = ["prediction_confidence", "prediction_margin", "prediction_normalized_entropy", *PROBABILITY_COLUMNS]
    tests = {c: (F.col(c) < 0) | (F.col(c) > 1) for c in unit}
    tests["prediction_entropy"] = (F.col("prediction_entropy") < 0) | (F.col("prediction_entropy") > math.log(len(STAGES)))
    return violations(df, tests)
