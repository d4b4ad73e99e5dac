"""Multiclass evaluation of scored rows.

The rows are reduced once to one cell per (group, true class, predicted class), carrying
counts and the sums the averages need; every metric is arithmetic on at most 25 cells
per group.  Groups can be folds, subjects, recordings, candidates, or nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from nightframe.functions import probability as PR
from nightframe.schemas import METRICS, PROBABILITY_COLUMNS, STAGES

EPS = 2.220446049250313e-16


def cells(df: DataFrame, by: Sequence[str] = (), classes: int = len(STAGES), p: str = "p") -> DataFrame:
    """Cell table: the only pass over the rows, combined map-side."""
    chance = F.least(F.lit(1.0 - EPS), F.greatest(F.lit(EPS), F.get(F.col(p), F.col("y_true"))))
    rows = df.select(
        *by, "y_true", "y_pred", (-F.ln(chance)).alias("_nll"), PR.confidence(p).alias("_conf"),
        PR.margin(p).alias("_marg"), PR.normalized_entropy(p, classes).alias("_ent"),
        (PR.argmax(p) == F.col("y_pred")).alias("_agree"),
    )
    return rows.groupBy(*by, "y_true", "y_pred").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_nll").alias("nll"), F.sum("_conf").alias("conf"),
        F.sum("_marg").alias("marg"), F.sum("_ent").alias("ent"), F.count_if("_agree").alias("agree"),
    )


def _class_sums(classes: int) -> list[Column]:
    out = []
    for c in range(classes):
        hit, pred, true = (F.col("y_true") == c) & (F.col("y_pred") == c), F.col("y_pred") == c, F.col("y_true") == c
        for name, test in (("tp", hit), ("pp", pred), ("sup", true)):
            out.append(F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias(f"_{name}{c}"))
    return out


def _div(a: Column, b: Column) -> Column:
    """a / b, nothing divided by nothing being zero."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _precision(c: int) -> Column:
    return _div(F.col(f"_tp{c}"), F.col(f"_pp{c}"))


def _recall(c: int) -> Column:
    return _div(F.col(f"_tp{c}"), F.col(f"_sup{c}"))


def _f1(c: int) -> Column:
    return _div(2.0 * F.col(f"_tp{c}"), F.col(f"_pp{c}") + F.col(f"_sup{c}"))


def _total(terms: Sequence[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def from_cells(table: DataFrame, by: Sequence[str] = (), classes: int = len(STAGES)) -> DataFrame:
    right = F.col("y_true") == F.col("y_pred")
    sums = table.groupBy(*by).agg(
        F.sum("n").alias("row_count"),
        *_class_sums(classes),
        F.sum("nll").alias("_nll"), F.sum("conf").alias("_conf"), F.sum("marg").alias("_marg"),
        F.sum("ent").alias("_ent"), F.sum("agree").alias("_agree"),
        F.coalesce(F.sum(F.when(right, F.col("conf"))), F.lit(0.0)).alias("_conf_right"),
        F.coalesce(F.sum(F.when(~right, F.col("conf"))), F.lit(0.0)).alias("_conf_wrong"),
        F.coalesce(F.sum(F.when(right, F.col("n"))), F.lit(0)).alias("_right"),
    )
    n, hits = F.col("row_count"), F.col("_right")
    ks = range(classes)
    present = _total([F.when(F.col(f"_sup{c}") > 0, 1).otherwise(0) for c in ks])
    chance = _total([F.col(f"_sup{c}").cast("double") * F.col(f"_pp{c}") for c in ks]) / (n.cast("double") * n)
    accuracy = hits / n
    return sums.select(
        *by, "row_count",
        accuracy.alias("accuracy"),
        _div(_total([_recall(c) for c in ks]), present).alias("balanced_accuracy"),
        (_total([_f1(c) for c in ks]) / classes).alias("macro_f1"),
        (_total([_f1(c) * F.col(f"_sup{c}") for c in ks]) / n).alias("weighted_f1"),
        # undefined for a single class; NaN, so that an average over folds shows it instead of skipping it
        F.when(chance < 1, (accuracy - chance) / (1 - chance)).otherwise(F.lit(float("nan"))).alias("cohen_kappa"),
        (F.col("_nll") / n).alias("multiclass_log_loss"),
        (F.col("_agree") / n).alias("predict_probability_argmax_agreement"),
        (n - F.col("_agree")).alias("predict_probability_argmax_mismatch_count"),
        (F.col("_conf") / n).alias("mean_prediction_confidence"),
        (F.col("_marg") / n).alias("mean_prediction_margin"),
        (F.col("_ent") / n).alias("mean_normalized_entropy"),
        _div(F.col("_conf_right"), hits).alias("mean_confidence_correct"),
        _div(F.col("_conf_wrong"), n - hits).alias("mean_confidence_incorrect"),
    )


def classification_metrics(df: DataFrame, by: Sequence[str] = (), classes: int = len(STAGES)) -> DataFrame:
    return from_cells(cells(df, by, classes), by, classes)


def per_class_metrics(df: DataFrame, by: Sequence[str] = (), names: Sequence[str] = STAGES) -> DataFrame:
    counts = df.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy(*by).agg(*_class_sums(len(names)))
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("class_name"), F.col(f"_sup{c}").alias("support"), _precision(c).alias("precision"),
                _recall(c).alias("recall"), _f1(c).alias("f1"),
            )
            for c, name in enumerate(names)
        ]
    )
    return sums.select(*by, F.inline(entries))


def confusion_matrix(df: DataFrame, by: Sequence[str] = (), classes: int = len(STAGES)) -> DataFrame:
    """Every (true, predicted) cell with its count and its share of the true class; empty rows are zero."""
    counts = df.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    wide = counts.groupBy(*by).agg(
        *[
            F.coalesce(F.sum(F.when((F.col("y_true") == t) & (F.col("y_pred") == p), F.col("n"))), F.lit(0)).alias(f"_{t}_{p}")
            for t in range(classes) for p in range(classes)
        ]
    )
    def support(t):
        return _total([F.col(f"_{t}_{p}") for p in range(classes)])

    entries = F.array(
        *[
            F.struct(
                F.lit(t).alias("true_label"), F.lit(p).alias("predicted_label"), F.col(f"_{t}_{p}").alias("count"),
                _div(F.col(f"_{t}_{p}"), support(t)).alias("share_of_true"),
            )
            for t in range(classes) for p in range(classes)
        ]
    )
    return wide.select(*by, F.inline(entries))


def fold_aggregate(metrics: DataFrame, by: Sequence[str] = (), names: Sequence[str] = METRICS) -> DataFrame:
    """Mean and population deviation over folds."""
    return metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("fold_count"),
        *[F.avg(m).alias(f"mean_{m}") for m in names], *[F.stddev_pop(m).alias(f"std_{m}") for m in names],
    )


def stage_label(code: Column, names: Sequence[str] = STAGES) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in names]), code + 1)


def prediction_frame(df: DataFrame, identifiers: Sequence[str], truth: bool = True, p: str = "p",
                     names: Sequence[str] = STAGES) -> DataFrame:
    """Identifiers, labels, agreement, confidence, margin, both entropies and the class probabilities.

    A row whose probabilities are not a distribution stops the job.
    """
    k = len(names)
    bad = F.raise_error(F.lit("invalid probability row")).cast("array<double>")
    checked = df.withColumn("_given", F.when(PR.is_valid(p, k), F.col(p)).otherwise(bad))
    clean = PR.with_normalized(checked, "_given", "_p", k)
    q = F.col("_p")
    clean = clean.withColumns({"_top": PR.argmax(q), "_entropy": PR.entropy(q, k)})
    top = F.col("_top")
    cols = {}
    if truth:
        cols["true_label_encoded"] = F.col("y_true")
        cols["true_label"] = stage_label(F.col("y_true"), names)
    cols["predicted_label_encoded"] = F.col("y_pred")
    cols["predicted_label"] = stage_label(F.col("y_pred"), names)
    cols["probability_argmax_label_encoded"] = top
    cols["probability_argmax_label"] = stage_label(top, names)
    cols["predict_probability_argmax_agree"] = F.col("y_pred") == top
    if truth:
        cols["is_correct"] = F.col("y_true") == F.col("y_pred")
    cols["prediction_confidence"] = PR.confidence(q)
    cols["prediction_margin"] = PR.margin(q)
    cols["prediction_entropy"] = F.col("_entropy")
    cols["prediction_normalized_entropy"] = F.col("_entropy") / F.lit(math.log(k))
    clash = sorted(set(identifiers) & set(cols))
    if clash:
        raise ValueError(f"identifier columns clash with derived ones: {clash}")
    return clean.select(
        *identifiers, *[v.alias(n) for n, v in cols.items()], *[q[i].alias(c) for i, c in enumerate(PROBABILITY_COLUMNS)]
    )


def coverage(df: DataFrame, position: str) -> DataFrame:
    """Is every position 0..n-1 present exactly once?"""
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("row_count"), F.count_distinct(position).alias("distinct_positions"),
        F.min(position).alias("first_position"), F.max(position).alias("last_position"),
        ((F.count_distinct(position) == n) & (F.min(position) == 0) & (F.max(position) == n - 1)).alias("complete"),
    )
