"""Column functions on numbers; every one is a built-in expression tree."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from nightframe.schemas import LEGACY_EPSILON


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """True only for a real number: isnan alone lets infinities through."""
    x = as_col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def nan_to_null(c: Column | str) -> Column:
    x = as_col(c)
    return F.when(~F.isnan(x), x)


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """Null unless both sides are finite and the denominator is positive."""
    a, b = as_col(a), as_col(b)
    return F.when(is_finite(a) & is_finite(b) & (b > 0), a / b)


def epsilon_ratio(a: Column | str, b: Column | str, eps: float = LEGACY_EPSILON) -> Column:
    return F.try_divide(as_col(a), as_col(b) + F.lit(eps))


def row_sum(columns: Iterable[Column | str]) -> Column:
    """Sum across columns, a null counting as nothing."""
    return reduce(lambda x, y: x + y, [F.coalesce(as_col(c), F.lit(0.0)) for c in columns])


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), as_col(c)))


def is_close(a: Column | str, b: Column | str, atol: float) -> Column:
    return F.abs(as_col(a) - as_col(b)) <= F.lit(atol)


def normalized_error(observed: Column | str, expected: Column | str) -> Column:
    o, e = as_col(observed), as_col(expected)
    return F.abs(o - e) / F.greatest(F.abs(o), F.abs(e), F.lit(1.0))


def canonical_zero(c: Column | str) -> Column:
    """Minus zero and zero become the same value."""
    x = as_col(c)
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


def is_integer_valued(c: Column | str, minimum: int | None = None) -> Column:
    x = as_col(c).cast("double")
    ok = is_finite(x) & (x == F.rint(x))
    return ok if minimum is None else ok & (x >= minimum)


def _brought_near(x: Column) -> Column:
    far = F.lit(1e200)
    return F.when(F.abs(x) < 1e-100, x * far).when(F.abs(x) > 1e100, x / far).otherwise(x)


def _places(near: Column, digits: int) -> Column:
    return F.lit(digits - 1) - F.floor(F.log10(F.abs(near)))


def _power(shift: Column) -> Column:
    return F.pow(F.lit(10.0), F.abs(shift).cast("double"))


def _rounded(x: Column, near: Column, shift: Column, up: Column) -> Column:
    far = F.lit(1e200)
    back = F.when(shift >= 0, F.rint(near * up) / up).otherwise(F.rint(near / up) * up)
    back = F.when(F.abs(x) < 1e-100, back / far).when(F.abs(x) > 1e100, back * far).otherwise(back)
    return F.when(x == 0, F.lit(0.0)).when(is_finite(x), back).otherwise(x)


def round_significant(c: Column | str, digits: int) -> Column:
    """Round to a number of significant digits (the reference text form uses 12 or 17).

    The decimal exponent is read from the value, so the factor is a power of ten
    applied on whichever side keeps it a whole number.  Very small and very large values
    are first brought near one by a fixed power of ten; what is not finite passes through.
    """
    x = as_col(c)
    near = _brought_near(x)
    shift = _places(near, digits)
    return _rounded(x, near, shift, _power(shift))


def rounded_values(values: Column, digits: int) -> Column:
    """An array's values without minus zero and at so many significant digits, value for value as by ``round_significant``.

    Written out for one value, the expression would hold it some thirty times, and Spark evaluates each; here every step
    is a field that the next one reads.
    """
    x = F.transform(values, canonical_zero)
    near = F.transform(x, lambda v: F.struct(v.alias("x"), _brought_near(v).alias("near")))
    shift = F.transform(near, lambda s: F.struct(s["x"].alias("x"), s["near"].alias("near"), _places(s["near"], digits).alias("shift")))
    up = F.transform(shift, lambda s: F.struct(s["x"].alias("x"), s["near"].alias("near"), s["shift"].alias("shift"), _power(s["shift"]).alias("up")))
    return F.transform(up, lambda s: _rounded(s["x"], s["near"], s["shift"], s["up"]))


def with_rounded(df: DataFrame, columns: Sequence[str], digits: int) -> DataFrame:
    """The columns as by ``rounded_values``, again without minus zero."""
    if not columns:
        return df
    out = df.withColumn("_rounded", F.transform(rounded_values(F.array(*[F.col(f"`{c}`") for c in columns]), digits), canonical_zero))
    return out.withColumns({c: F.col("_rounded")[i] for i, c in enumerate(columns)}).drop("_rounded")


def grid_distance(c: Column | str, step: float) -> Column:
    """Distance to the nearest multiple of ``step``."""
    x = as_col(c)
    return F.abs(x - F.rint(x / F.lit(step)) * F.lit(step))
