"""Functions on one array of class probabilities per row."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from nightframe.functions.numeric import as_col, is_finite
from nightframe.schemas import PROBABILITY_TOLERANCE


def items(p: Column | str, classes: int) -> list[Column]:
    """The entries as separate columns, so that sums over them compile instead of being interpreted."""
    p = as_col(p)
    return [F.get(p, F.lit(i)) for i in range(classes)]


def plus(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def argmax(p: Column | str) -> Column:
    """Zero-based position of the largest entry, the first one on a tie."""
    p = as_col(p)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def confidence(p: Column | str) -> Column:
    return F.array_max(as_col(p))


def margin(p: Column | str) -> Column:
    ordered = F.sort_array(as_col(p), asc=False)
    return F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))


def total(p: Column | str, classes: int) -> Column:
    return plus(items(p, classes))


def entropy(p: Column | str, classes: int) -> Column:
    """Natural-log entropy; an empty class adds nothing."""
    return plus([F.when(x > 0, -x * F.ln(x)).otherwise(F.lit(0.0)) for x in items(p, classes)])


def normalized_entropy(p: Column | str, classes: int) -> Column:
    return entropy(p, classes) / F.lit(math.log(classes))


def is_valid(p: Column | str, classes: int, tol: float = PROBABILITY_TOLERANCE) -> Column:
    """Right length, finite, inside [0, 1] and summing to one, each within ``tol``."""
    inside = F.forall(as_col(p), lambda x: is_finite(x) & (x >= -tol) & (x <= 1.0 + tol))
    return F.coalesce(
        (F.size(as_col(p)) == classes) & inside & (F.abs(total(p, classes) - 1.0) <= tol), F.lit(False)
    )


def with_normalized(df: DataFrame, p: str, out: str, classes: int) -> DataFrame:
    """Clip to [0, 1] and divide by the row sum.

    Done in steps so that each intermediate is computed once; written as one expression
    the generated method grows past what the JVM compiles.
    """
    clipped = F.transform(p, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return (
        df.withColumn("_clipped", clipped)
        .withColumn("_total", total("_clipped", classes))
        .withColumn(out, F.transform("_clipped", lambda x: F.when(F.col("_total") > 0, x / F.col("_total"))))
        .drop("_clipped", "_total")
    )


def reorder(p: Column | str, order: list[int]) -> Column:
    """Entry i of the result is entry ``order[i]`` of the input."""
    p = as_col(p)
    return F.array(*[F.get(p, F.lit(i)) for i in order])
