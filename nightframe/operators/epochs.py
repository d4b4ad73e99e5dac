"""From labelled annotation segments to fixed-length epochs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from nightframe.functions.numeric import grid_distance
from nightframe.operators.skew import lookup_join, numbered
from nightframe.schemas import (
    ANNOTATION_STAGES, EPOCH_SECONDS, IGNORED_ANNOTATIONS, SLEEP_LABEL_PREFIX, STAGES, TIME_TOLERANCE,
    WAKE_PADDING_MINUTES,
)
from nightframe.operators.engineering import encode_stage


def inspect_recordings(annotations: DataFrame, duration: Column, rate: float = 100.0) -> DataFrame:
    """Roll-up of the annotation segments of each recording against its signal duration.

    The label set of a recording is drawn from a short vocabulary; it is made distinct
    before it is gathered, so the gathered list is no longer than that vocabulary.
    """
    end = F.col("onset") + F.col("duration")
    sums = annotations.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("annotation_count"),
        F.min("onset").alias("annotation_start_seconds"),
        F.max(end).alias("annotation_end_seconds"),
        F.sum("duration").alias("annotation_duration_sum_seconds"),
    )
    labels = annotations.select("recording_id", "label").distinct().groupBy("recording_id").agg(
        F.array_sort(F.collect_list("label")).alias("_labels")
    )
    return sums.join(labels, "recording_id").select(
        *sums.columns,
        F.rint(duration * F.lit(rate)).cast("bigint").alias("n_samples"),
        duration.alias("signal_duration_seconds"),
        (duration / 3600.0).alias("signal_duration_hours"),
        (F.col("annotation_end_seconds") - duration).alias("alignment_difference_seconds"),
        F.to_json("_labels").alias("unique_annotation_labels_json"),
        F.to_json(F.filter("_labels", lambda x: F.startswith(x, F.lit(SLEEP_LABEL_PREFIX)))).alias("sleep_labels_json"),
    )


def map_labels(annotations: DataFrame, mapping: Mapping[str, str] = ANNOTATION_STAGES) -> DataFrame:
    """Segments with a known stage; ignored and unknown labels fall out."""
    stage = None
    for label, name in mapping.items():
        stage = F.when(F.col("label") == label, name) if stage is None else stage.when(F.col("label") == label, name)
    known = annotations.filter(~F.col("label").isin(*IGNORED_ANNOTATIONS)).withColumn("sleep_stage", stage)
    return known.filter(F.col("sleep_stage").isNotNull())


def clamp_segments(segments: DataFrame, recording_seconds: Column, epoch_seconds: float = EPOCH_SECONDS) -> DataFrame:
    """Cut segments to [0, recording length]; what is shorter than an epoch is dropped."""
    start = F.greatest(F.lit(0.0), F.col("onset"))
    end = F.least(recording_seconds, F.col("onset") + F.col("duration"))
    cut = segments.withColumns({"segment_start": start, "segment_end": end})
    return cut.filter(F.col("segment_end") - F.col("segment_start") >= F.lit(epoch_seconds - TIME_TOLERANCE))


def off_grid(df: DataFrame, column: str, epoch_seconds: float = EPOCH_SECONDS) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(grid_distance(column, epoch_seconds) > TIME_TOLERANCE).alias("violations"),
    )


def expand(segments: DataFrame, epoch_seconds: float = EPOCH_SECONDS, rate: float = 100.0) -> DataFrame:
    """One row per whole epoch in a segment; a narrow operation, no shuffle."""
    whole = F.floor((F.col("segment_end") - F.col("segment_start") + TIME_TOLERANCE) / F.lit(float(epoch_seconds)))
    rows = segments.filter(whole >= 1).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)))
    start = F.col("segment_start") + F.col("_k") * F.lit(float(epoch_seconds))
    return rows.withColumns(
        {
            "start_time_sec": start,
            "end_time_sec": start + F.lit(float(epoch_seconds)),
            "start_sample": F.rint(start * F.lit(rate)).cast("bigint"),
            "stop_sample": F.rint((start + F.lit(float(epoch_seconds))) * F.lit(rate)).cast("bigint"),
            "sleep_stage_encoded": encode_stage("sleep_stage"),
        }
    ).drop("_k")


def inside_recording(epochs: DataFrame, recording_seconds: Column, sample_count: Column) -> DataFrame:
    return epochs.filter(
        (F.col("end_time_sec") <= recording_seconds + TIME_TOLERANCE) & (F.col("stop_sample") <= sample_count)
    )


def trim_bounds(epochs: DataFrame, padding_minutes: float = WAKE_PADDING_MINUTES) -> DataFrame:
    """Per recording: the kept window, from padding before the first sleep epoch to padding after the last.

    A recording without sleep is an error.  The bounds come from partial aggregates, so a
    long recording is not gathered.
    """
    asleep = F.col("sleep_stage") != "Wake"
    pad = F.lit(float(padding_minutes * 60))
    first = F.min(F.when(asleep, F.col("start_time_sec")))
    last = F.max(F.when(asleep, F.col("end_time_sec")))
    none = F.raise_error(F.lit("recording has no sleep epochs")).cast("double")
    return epochs.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("epochs_before"), first.alias("_first"), last.alias("_last"),
        F.max("end_time_sec").alias("_end"),
    ).select(
        "recording_id", "epochs_before",
        F.greatest(F.lit(0.0), F.coalesce("_first", none) - pad).alias("trim_start_seconds"),
        F.least(F.col("_end"), F.coalesce("_last", none) + pad).alias("trim_end_seconds"),
    )


def trim_wake(epochs: DataFrame, padding_minutes: float = WAKE_PADDING_MINUTES, keep_bounds: bool = False) -> DataFrame:
    bounds = trim_bounds(epochs, padding_minutes)
    kept = lookup_join(epochs, bounds, ["recording_id"]).filter(
        (F.col("start_time_sec") >= F.col("trim_start_seconds")) & (F.col("end_time_sec") <= F.col("trim_end_seconds"))
    )
    return kept if keep_bounds else kept.drop("epochs_before", "trim_start_seconds", "trim_end_seconds")


def number_epochs(epochs: DataFrame, hours_per_bucket: float = 1.0) -> DataFrame:
    """Dense zero-based epoch_id by start time within each recording."""
    bucket = F.floor(F.col("start_time_sec") / F.lit(3600.0 * hours_per_bucket))
    return numbered(epochs, ["recording_id"], ["start_time_sec", "end_time_sec"], bucket, "epoch_id")


def build_epochs(annotations: DataFrame, recording_seconds: Column, epoch_seconds: float = EPOCH_SECONDS,
                 rate: float = 100.0, padding_minutes: float = WAKE_PADDING_MINUTES) -> DataFrame:
    """Segments to numbered, trimmed epochs."""
    segments = clamp_segments(map_labels(annotations), recording_seconds, epoch_seconds)
    expanded = expand(segments, epoch_seconds, rate)
    inside = inside_recording(expanded, recording_seconds, F.rint(recording_seconds * rate).cast("bigint"))
    return number_epochs(trim_wake(inside, padding_minutes), 24.0 * epoch_seconds / EPOCH_SECONDS / 24.0)


def epoch_summary(expanded: DataFrame, padding_minutes: float = WAKE_PADDING_MINUTES,
                  stages: Sequence[str] = STAGES) -> DataFrame:
    """Per recording: epochs before, after and removed, the kept window, and class counts after trimming."""
    kept = trim_wake(expanded, padding_minutes, keep_bounds=True)  # no recording loses all its epochs
    return kept.groupBy("recording_id").agg(
        *[F.first(c).alias(c) for c in ("epochs_before", "trim_start_seconds", "trim_end_seconds")],
        F.count(F.lit(1)).alias("epochs_after"),
        *[F.count_if(F.col("sleep_stage") == s).alias(f"count_{s.lower()}") for s in stages],
    ).withColumn("epochs_removed", F.col("epochs_before") - F.col("epochs_after"))
