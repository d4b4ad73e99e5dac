"""Engineered columns of the legacy table, column roles, and scaling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from nightframe.functions.numeric import epsilon_ratio, row_sum
from nightframe.operators.cleaning import require_columns
from nightframe.schemas import (
    FLOAT_TOLERANCE, LEGACY_OUTPUT_COLUMNS, LEGACY_SCALED_COLUMNS, POWER_COLUMNS, STAGE_CODES,
)


def encode_stage(label: Column | str = "sleep_stage") -> Column:
    label = F.col(label) if isinstance(label, str) else label
    code = None
    for name, value in STAGE_CODES.items():
        code = F.when(label == name, F.lit(value)) if code is None else code.when(label == name, F.lit(value))
    return code


def encode_or_fail(label: Column | str = "sleep_stage") -> Column:
    """Stage code; a label outside the mapping stops the job."""
    name = F.col(label) if isinstance(label, str) else label
    message = F.concat(F.lit("unmapped stage label: "), F.coalesce(name, F.lit("null")))
    return F.coalesce(encode_stage(name), F.raise_error(message).cast("int"))


def power_features(df: DataFrame) -> DataFrame:
    """Total, relative powers, two ratios, log energy and the stage code, unscaled."""
    require_columns(df, [*POWER_COLUMNS, "sleep_stage"])
    with_total = df.withColumn("total_power", row_sum(POWER_COLUMNS))
    new = {f"relative_{c}": epsilon_ratio(c, "total_power") for c in POWER_COLUMNS}
    new["delta_theta_ratio"] = epsilon_ratio("delta_power", "theta_power")
    new["alpha_beta_ratio"] = epsilon_ratio("alpha_power", "beta_power")
    if "signal_energy" in df.columns:
        new["log_signal_energy"] = F.log1p("signal_energy")
    new["sleep_stage_encoded"] = encode_or_fail("sleep_stage")
    return with_total.withColumns(new)


def scaling_parameters(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with mean and population deviation of each column."""
    return df.agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_std_{c}") for c in columns]
    )


def apply_scaling(df: DataFrame, parameters: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / deviation; a constant column is only centred.

    ``parameters`` is a single row, so its broadcast does not grow with the data.
    """
    joined = df.join(F.broadcast(parameters), F.lit(True))
    scaled = {
        c: (F.col(c) - F.col(f"_mean_{c}"))
        / F.when(F.col(f"_std_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_std_{c}"))
        for c in columns
    }
    return joined.withColumns(scaled).select(*df.columns)


def contract_order(df: DataFrame, expected: Sequence[str] = LEGACY_OUTPUT_COLUMNS) -> DataFrame:
    """Expected columns first and in order, then whatever else the table has."""
    first = [c for c in expected if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in expected])


def engineer(df: DataFrame) -> DataFrame:
    """The full legacy feature set, scaled on all rows."""
    features = power_features(df)
    columns = [c for c in LEGACY_SCALED_COLUMNS if c in features.columns]
    return contract_order(apply_scaling(features, scaling_parameters(features, columns), columns))


def classify_roles(columns: Sequence[str], selected: Sequence[str], dropped: Mapping[str, str]) -> list[tuple[str, str]]:
    """Each source feature is selected or dropped, never both and never neither."""
    both = sorted(set(selected) & set(dropped))
    neither = sorted(set(columns) - set(selected) - set(dropped))
    absent = sorted((set(selected) | set(dropped)) - set(columns))
    if both or neither or absent:
        raise ValueError(f"roles unclear: both={both} neither={neither} absent={absent}")
    return [(c, "selected" if c in set(selected) else "dropped") for c in columns]


def require_exact_columns(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    unexpected = sorted(set(df.columns) - set(required) - set(optional))
    if missing or unexpected:
        raise ValueError(f"missing={missing} unexpected={unexpected}")
    return df


def derived_share(df: DataFrame, shares: Sequence[str], out: str) -> DataFrame:
    """One minus the given shares, checked to lie in [0, 1] within 1e-10 and clipped to it."""
    rest = F.lit(1.0) - row_sum(shares)
    checked = F.when(
        (rest < -FLOAT_TOLERANCE) | (rest > 1.0 + FLOAT_TOLERANCE),
        F.raise_error(F.lit(f"{out} outside [0, 1]")).cast("double"),
    ).otherwise(rest)
    return df.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), checked)))


def numeric_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    numeric = {"byte", "tinyint", "smallint", "int", "bigint", "float", "double"}
    return [n for n, t in df.dtypes if (t in numeric or t.startswith("decimal")) and n not in exclude]
