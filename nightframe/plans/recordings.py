"""From a samples table to one feature row per epoch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from nightframe.operators import audits
from nightframe.operators.filtering import SPAN, bandpass
from nightframe.operators.spectral import with_all_measures, with_spectral_features
from nightframe.schemas import (
    EPOCH_COLUMNS, IDENTIFIERS, MODEL_INPUT_COLUMNS, SELECTED_FEATURES, SIGNAL_QUALITY_COLUMNS, SPECTRAL_FEATURES, TIME_FEATURES,
    WELCH_SECONDS,
)


def chunk_samples(samples: DataFrame, keys: Sequence[str], per_chunk: int, index: str = "sample_index",
                  value: str = "uv") -> DataFrame:
    """Long samples to arrays: sample i belongs to chunk i div per_chunk.

    Epochs lie on this grid, so the interval join of epochs and samples is an equality
    on (recording, chunk), and each gathered array holds ``per_chunk`` values.
    """
    chunk = F.floor(F.col(index) / per_chunk).alias("chunk")
    gathered = samples.groupBy(*keys, chunk).agg(F.array_sort(F.collect_list(F.struct(index, value))).alias("_s"))
    return gathered.select(*keys, "chunk", F.transform("_s", lambda s: s[value]).alias("x"))


def require_samples(df: DataFrame, signal: str, expected: int) -> DataFrame:
    wrong = F.raise_error(F.concat(F.lit("unexpected sample count: "), F.size(signal).cast("string")))
    return df.withColumn(signal, F.when(F.size(signal) == expected, F.col(signal)).otherwise(wrong.cast("array<double>")))


def epoch_features(chunks: DataFrame, keys: Sequence[str], fs: float, window_seconds: float = WELCH_SECONDS,
                   span: int = SPAN, filtered: bool = True) -> DataFrame:
    """Filter, flag, and compute all time and spectral features of each chunk.

    Samples are shuffled once, to blocks of chunks; the measures are narrow.
    """
    source = bandpass(chunks, keys, "chunk", fs, span=span) if filtered else chunks.withColumn("filtered", F.col("x"))
    ids = [*keys, "chunk"]
    measured = with_spectral_features(with_all_measures(source, ids, "x", "filtered", fs, window_seconds))
    return measured.select(*ids, *SIGNAL_QUALITY_COLUMNS, *TIME_FEATURES, *SPECTRAL_FEATURES)


def feature_table(epochs: DataFrame, features: DataFrame, epoch_seconds: float) -> DataFrame:
    """Epoch metadata with the features of the chunk each epoch covers: 54 columns.

    Epochs start on the chunk grid, so the join is an equality on (recording, chunk) and
    no recording gathers in one task.
    """
    placed = epochs.withColumn("chunk", F.rint(F.col("start_time_sec") / F.lit(float(epoch_seconds))).cast("bigint"))
    joined = placed.join(features, ["recording_id", "chunk"])
    return joined.select(*EPOCH_COLUMNS, *SIGNAL_QUALITY_COLUMNS, *TIME_FEATURES, *SPECTRAL_FEATURES)


def model_input(table: DataFrame) -> DataFrame:
    """The 35 columns a model sees, in contract order, after all checks have passed."""
    audits.require_clean(audits.dataset_audit(table.select(*MODEL_INPUT_COLUMNS), SELECTED_FEATURES, IDENTIFIERS))
    return table.select(*MODEL_INPUT_COLUMNS).orderBy("subject_id", "recording_id", "night", "epoch_id")


def load_model_input(df: DataFrame, scaled: bool = False) -> DataFrame:
    """Strict load: the exact columns in the exact order, not scaled, and clean."""
    if scaled:
        raise ValueError("features were scaled before any split")
    if tuple(df.columns) != MODEL_INPUT_COLUMNS:
        raise ValueError("columns or their order differ from the contract")
    audits.require_clean(audits.dataset_audit(df, SELECTED_FEATURES, IDENTIFIERS))
    return df
