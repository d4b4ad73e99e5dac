"""Single quantities of one epoch held as ``array<double>``, as built-in expressions.

An epoch has a fixed length (3000 samples in the field, 64 in the test tables), so an
array is a bounded value and no shuffle is needed: each row is handled where it lies.
The full feature set walks the samples many times and is an Arrow batch stage instead
(``operators.spectral``).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from nightframe.functions.numeric import as_col, is_finite
from nightframe.schemas import ARTIFACT_ABS_UV, FLATLINE_STD_UV


def fold(x: Column, step) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + step(v))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row.

    An expression written inside a lambda is evaluated for every element; bound to a
    one-element array first, it is a plain variable there.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def mean(x: Column | str) -> Column:
    x = as_col(x)
    return fold(x, lambda v: v) / F.size(x)


def central_moment(x: Column | str, order: int, mu: Column | None = None) -> Column:
    x = as_col(x)

    def moment(m):
        def step(v):
            d = v - m
            out = d
            for _ in range(order - 1):
                out = out * d
            return out

        return fold(x, step) / F.size(x)

    return bind(mean(x), moment) if mu is None else moment(mu)


def median(x: Column | str) -> Column:
    def middle(s):
        n = F.size(s)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0

    return bind(F.array_sort(as_col(x)), middle)


def differences(x: Column | str) -> Column:
    x = as_col(x)
    n = F.size(x)
    return F.zip_with(F.slice(x, 2, n - 1), F.slice(x, 1, n - 1), lambda b, a: b - a)


def line_length(x: Column | str) -> Column:
    return fold(differences(x), lambda d: F.abs(d))


def is_negative(v: Column) -> Column:
    """Sign bit: minus zero counts as negative."""
    return (v < 0) | ((v == 0) & F.startswith(v.cast("string"), F.lit("-")))


def zero_crossing_rate(x: Column | str) -> Column:
    x = as_col(x)
    n = F.size(x)
    changes = F.zip_with(
        F.slice(x, 2, n - 1), F.slice(x, 1, n - 1),
        lambda b, a: F.when(is_negative(b) != is_negative(a), F.lit(1.0)).otherwise(F.lit(0.0)),
    )
    return fold(changes, lambda v: v) / (n - 1)


def quality_flags(raw: Column | str, filtered: Column | str) -> dict[str, Column]:
    """Flatline is judged on the filtered signal, amplitude on the raw one; rows are only flagged."""
    raw, filtered = as_col(raw), as_col(filtered)
    flat = F.coalesce(F.sqrt(central_moment(filtered, 2)) < F.lit(FLATLINE_STD_UV), F.lit(False))
    loud = F.exists(raw, lambda v: F.abs(v) > F.lit(ARTIFACT_ABS_UV))
    return {
        "sample_count": F.size(filtered).cast("bigint"),
        "is_finite_signal": F.forall(filtered, lambda v: is_finite(v)),
        "flatline_flag": flat,
        "amplitude_artifact_flag": loud,
        "quality_issue_flag": flat | loud,
    }
