"""Row filters and cleaning of feature tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from nightframe.functions.numeric import is_finite
from nightframe.schemas import STAGES


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def supported_labels(df: DataFrame, label: str = "sleep_stage", labels: Sequence[str] = STAGES) -> DataFrame:
    return df.filter(F.col(label).isin(*labels))


def non_negative(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows whose listed columns are all >= 0; columns the table lacks are skipped.

    NaN is no measurement here, although Spark orders it above every number.
    """
    present = [c for c in columns if c in df.columns]
    tests = [(F.col(c) >= 0) & ~F.isnan(F.col(c).cast("double")) for c in present]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


PHYSICAL = ("signal_energy", "delta_power", "theta_power", "alpha_power", "beta_power")


def clean(df: DataFrame, columns: Sequence[str] = PHYSICAL, surrogate_keys: Sequence[str] = ()) -> DataFrame:
    """Full-row dedupe, then complete rows, then non-negative powers.

    ``surrogate_keys`` names generated keys to leave out of the duplicate test; by default
    the whole row counts, keys included.
    """
    subset = [c for c in df.columns if c not in surrogate_keys]
    distinct = df.dropDuplicates(subset) if surrogate_keys else df.dropDuplicates()
    return non_negative(distinct.dropna("any"), columns)


def keep_statuses(df: DataFrame, statuses: Sequence[str], column: str = "status") -> DataFrame:
    kept = df.filter(F.col(column).isin(*statuses))
    if kept.isEmpty():
        raise ValueError(f"no rows with status in {sorted(statuses)}")
    return kept


def request_table(df: DataFrame, requested: Sequence[str]) -> DataFrame:
    """(recording_id, position) of a request list: trimmed, upper case, first mention kept."""
    names = list(dict.fromkeys(r.strip().upper() for r in requested))
    values = df.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "recording_id string, position int")
    return values


def select_recordings(df: DataFrame, requested: Sequence[str] | None = None) -> DataFrame:
    """All recordings, or the requested ones; an unknown name is an error."""
    if requested is None:
        return df
    wanted = request_table(df, requested)
    known = df.select("recording_id").distinct()
    unknown = wanted.join(known, "recording_id", "left_anti").select("recording_id").toPandas()["recording_id"]
    if len(unknown):
        raise ValueError(f"unknown recordings: {sorted(unknown)}")
    return df.join(F.broadcast(wanted), "recording_id")


def non_finite_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, bad_count) from one pass over the table."""
    one = df.agg(*[F.count_if(~is_finite(F.col(c).cast("double"))).alias(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("bad_count")) for c in columns])
    return one.select(F.inline(entries))


def require_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    bad = non_finite_counts(df, columns).filter("bad_count > 0").toPandas()["feature"]
    if len(bad):
        raise ValueError(f"non-finite values in {sorted(bad)}")
    return df


def reject_flagged(df: DataFrame, flag: str = "quality_issue_flag", allowed: bool = False) -> DataFrame:
    if not allowed:
        flagged = df.agg(F.count_if(F.col(flag)).alias("n")).first()["n"]
        if flagged:
            raise ValueError(f"{flagged} rows carry {flag}")
    return df


def subject_partition(df: DataFrame, subjects: Sequence[int], classes: Sequence[int] | None = None,
                      label: str = "sleep_stage_encoded") -> DataFrame:
    """Rows of the listed subjects.  Unknown, repeated or no subjects, or an absent class, is an error."""
    wanted = [int(s) for s in subjects]
    if not wanted or len(set(wanted)) != len(wanted):
        raise ValueError("subjects must be a non-empty list without repeats")
    part = df.filter(F.col("subject_id").isin(*wanted))
    found = part.groupBy("subject_id").agg(F.collect_set(F.col(label)).alias("seen")).toPandas()
    unknown = sorted(set(wanted) - set(found["subject_id"].astype(int)))
    if unknown:
        raise ValueError(f"unknown subjects: {unknown}")
    if classes is not None:
        missing = sorted(set(classes) - {int(c) for s in found["seen"] for c in s})
        if missing:
            raise ValueError(f"classes without rows: {missing}")
    return part
