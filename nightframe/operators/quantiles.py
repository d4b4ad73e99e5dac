"""Exact grouped quantiles (linear interpolation) by iterative selection, never gathering a group.

``percentile`` keeps every distinct value of a group in one aggregation buffer, which
fails when a group holds a large share of the table.  Here a bounded sketch
(``percentile_approx``) brackets each wanted rank and one aggregation counts the rows of
every region between the bracket ends; inside a bracket equal values become one cell with a
count.  Then the selection is repeated on the cells: while a region that holds a wanted
rank has more than ``limit`` distinct values it is cut at 255 splitters of its own, the
rows before each part are carried along as counts, and parts without a wanted rank shrink
to one counted row.  Values are ordered only when no more than ``limit`` are left in any
region, so an ordering task sees a fixed number of rows whatever the group.

A sketch decides how much work is left, never the result: a wanted rank that its bracket
missed lies in a region that was only counted, and that region is opened by another pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nightframe.operators.skew import lookup_join, same_group
from nightframe.session import ensure_checkpoint_dir

ACCURACY = 10_000
#: Distinct values of one region that are ordered in one task; above the sketch's accuracy, so that a
#: group which is small enough to be bracketed by its range needs no narrowing.
LIMIT = 16_384
PARTS = 256


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, feature, value) without nulls and NaN."""
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.inline(entries)).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def _ranks(n: Column, probs: Sequence[float]) -> list[tuple[Column, Column]]:
    """The two zero-based ranks that each quantile lies between."""
    places = [(n - 1) * F.lit(float(p)) for p in probs]
    return [(F.floor(r), F.ceil(r)) for r in places]


def _regions(cells: DataFrame, probs: Sequence[float]) -> DataFrame:
    """One row per region: how many values are told apart, whether any are not, and whether a wanted rank lies in it."""
    sums = cells.groupBy("_g", "_region").agg(
        F.sum("_m").alias("_total"), F.first("_n").alias("_n"), F.count("_v").alias("_values"), (F.count_if(F.col("_v").isNull()) > 0).alias("_closed")
    )
    upto = F.sum("_total").over(W.partitionBy("_g").orderBy("_region").rowsBetween(W.unboundedPreceding, 0))
    sums = sums.withColumn("_end", upto)
    wanted = F.lit(False)
    for low, high in _ranks(F.col("_n"), probs):
        for rank in (low, high):
            wanted = wanted | ((rank >= F.col("_end") - F.col("_total")) & (rank < F.col("_end")))
    return sums.withColumn("_wanted", wanted).drop("_n", "_total", "_end")


def _collapsed(cells: DataFrame, regions: DataFrame, extra: Sequence[str]) -> DataFrame:
    """Cells in which a region without a wanted rank is one row."""
    joined = cells.join(regions.select("_g", "_region", "_wanted"), ["_g", "_region"])
    return joined.groupBy("_g", "_region", F.when(F.col("_wanted"), F.col("_v")).alias("_v")).agg(
        F.sum("_m").alias("_m"), F.first("_n").alias("_n"), *[F.first(e).alias(e) for e in extra]
    )


def _cut(cells: DataFrame, wide: DataFrame) -> DataFrame:
    """Cells with the wide regions in parts; a region's number is that of its parent and its part, so order is kept."""
    shares = [i / PARTS for i in range(1, PARTS)]
    splitters = cells.join(wide, ["_g", "_region"], "left_semi").groupBy("_g", "_region").agg(F.percentile_approx("_v", shares, ACCURACY).alias("_splits"))
    joined = cells.join(splitters, ["_g", "_region"], "left")
    part = F.coalesce(F.size(F.filter("_splits", lambda x: x < F.col("_v"))), F.lit(0))
    return joined.withColumn("_region", F.col("_region") * PARTS + F.greatest(part, F.lit(0))).drop("_splits")


def narrowed(cells: DataFrame, probs: Sequence[float], limit: int, extra: Sequence[str], reopen) -> DataFrame:
    """Cells whose wanted regions hold at most ``limit`` distinct values; ``reopen`` tells the values of missed regions apart."""
    while True:
        regions = _regions(cells, probs)
        wanted = regions.filter("_wanted")
        state = wanted.agg(F.max("_values").alias("widest"), F.max(F.col("_closed").cast("int")).alias("missed")).first()
        if state["missed"]:
            missed = wanted.filter("_closed").select("_g", "_region").checkpoint()
            cells = cells.join(missed, ["_g", "_region"], "left_anti").unionByName(reopen(missed)).checkpoint()
        elif (state["widest"] or 0) > limit:
            cut = _cut(cells, wanted.filter(F.col("_values") > limit).select("_g", "_region"))
            cells = _collapsed(cut, _regions(cut, probs), extra).checkpoint()
        else:
            return _collapsed(cells, regions, extra)


def exact_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float],
                    bounded_keys: bool = False, accuracy: int = ACCURACY,
                    extra: Mapping[str, Column] | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per (keys, feature) with columns q0, q1, ... for ``probs``.

    ``bounded_keys`` says that the keys take a small fixed set of values (stages), so the
    bracket table is at most classes x features rows and may be broadcast.  ``extra`` adds
    numeric aggregates of ``value`` to the first pass, so a summary needs no third one.
    """
    ensure_checkpoint_dir(df.sparkSession)
    margin = 4.0 / accuracy
    extra = dict(extra or {})
    data = long_form(df, keys, columns)
    group = [*keys, "feature"]
    k = len(probs)
    lows = [max(0.0, p - margin) for p in probs]
    highs = [min(1.0, p + margin) for p in probs]
    sketch = data.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("value").alias("_min"),
        F.max("value").alias("_max"),
        F.percentile_approx("value", [*lows, *highs], accuracy).alias("_q"),
        *[c.alias(n) for n, c in extra.items()],
    )
    # A sketch of few rows is no better than their range; beyond that its rank error is
    # below a quarter of the margin.
    small = F.col("_n") <= accuracy
    brackets = sketch.select(
        *group, "_n", *extra,
        *[F.when(small, F.col("_min")).otherwise(F.col("_q")[i]).alias(f"_lo{i}") for i in range(k)],
        *[F.when(small, F.col("_max")).otherwise(F.col("_q")[k + i]).alias(f"_hi{i}") for i in range(k)],
    )
    joined = same_group(data, F.broadcast(brackets), group) if bounded_keys else lookup_join(data, brackets, group)
    # The bracket ends cut the number line into regions.  Values in a bracket stay apart,
    # the others are only counted per region; ordering by (region, value) orders by value.
    v = F.col("value")
    region, kept = F.lit(0).cast("bigint"), F.lit(False)
    for i in range(k):
        region = region + (v >= F.col(f"_lo{i}")).cast("int") + (v > F.col(f"_hi{i}")).cast("int")
        kept = kept | v.between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
    placed = joined.select(F.struct(*group).alias("_g"), region.alias("_region"), v.alias("_value"), kept.alias("_kept"), "_n", *extra)

    def counted(rows: DataFrame, value: Column) -> DataFrame:
        return rows.groupBy("_g", "_region", value.alias("_v")).agg(
            F.count(F.lit(1)).alias("_m"), F.first("_n").alias("_n"), *[F.first(n).alias(n) for n in extra]
        )

    cells = counted(placed, F.when(F.col("_kept"), F.col("_value"))).checkpoint()
    cells = narrowed(cells, probs, limit, list(extra), lambda missed: counted(placed.join(missed, ["_g", "_region"], "left_semi"), F.col("_value")))
    running = W.partitionBy("_g").orderBy("_region", F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    ranked = cells.withColumn("_upto", F.sum("_m").over(running))
    picks = []
    for i, ranks in enumerate(_ranks(F.col("_n"), probs)):
        for side, at in zip("ab", ranks, strict=True):
            picks.append(F.min(F.when(F.col("_upto") > at, F.struct("_upto", "_v"))).alias(f"_{side}{i}"))
    picked = ranked.groupBy("_g").agg(F.first("_n").alias("_n"), *picks, *[F.first(n).alias(n) for n in extra])
    out = []
    for i, p in enumerate(probs):
        rank = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.col(f"_a{i}._v"), F.col(f"_b{i}._v")
        out.append((low + (high - low) * (rank - F.floor(rank))).alias(f"q{i}"))
    return picked.select(*[F.col("_g").getField(g).alias(g) for g in group], *extra, *out)


def wide_quantile(quantiles: DataFrame, keys: Sequence[str], columns: Sequence[str], source: str = "q0",
                  prefix: str = "median_") -> DataFrame:
    """One column per feature, from the long quantile table."""
    return quantiles.groupBy(*keys).agg(
        *[F.max(F.when(F.col("feature") == c, F.col(source))).alias(f"{prefix}{c}") for c in columns]
    )
