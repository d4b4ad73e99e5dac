"""Counting, averaging and robust summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightframe import proxies as P
from nightframe.operators import cleaning, engineering, summaries
from nightframe.operators.quantiles import exact_quantiles, wide_quantile
from nightframe.operators.skew import zero_filled_counts
from nightframe.plans.oracle import AN, CLASSES, EP, FT, FT_LONG, REL, with_views
from nightframe.plans.registry import query
from nightframe.schemas import STAGES

FEATS = P.FT_FEATURES


# Quantiles interpolate between values of few decimals, so at six digits they often sit on a tie.
FINE = {"median", "q1", "q3", "iqr", "lower_bound", "upper_bound", *(f"median_{c}" for c in FEATS)}


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, 9 if c in FINE else digits) for c in columns})


@query("ag01_epochs_per_stage", with_views(EP, select="SELECT sleep_stage, count(*) AS epoch_count FROM ep GROUP BY 1"))
def _(spark, sf):
    return P.epochs(spark, sf).groupBy("sleep_stage").agg(F.count(F.lit(1)).alias("epoch_count")).orderBy(
        F.desc("epoch_count"), "sleep_stage"
    )


@query("ag02_mean_power_per_stage", with_views(FT, select="""SELECT sleep_stage, round(avg(delta_power),6) AS avg_delta_power,
  round(avg(theta_power),6) AS avg_theta_power, round(avg(alpha_power),6) AS avg_alpha_power,
  round(avg(beta_power),6) AS avg_beta_power FROM ft GROUP BY 1"""))
def _(spark, sf):
    return P.four_powers(spark, sf).groupBy("sleep_stage").agg(
        *[F.round(F.avg(f"{b}_power"), 6).alias(f"avg_{b}_power") for b in ("delta", "theta", "alpha", "beta")]
    )


@query("ag03_epochs_per_subject", with_views(EP, select="SELECT subject_id, count(*) AS epoch_count FROM ep GROUP BY 1"))
def _(spark, sf):
    return P.epochs(spark, sf).groupBy("subject_id").agg(F.count(F.lit(1)).alias("epoch_count"))


@query("ag04_total_rows", "SELECT count(*) AS total_rows FROM events")
def _(spark, sf):
    return P.epochs(spark, sf).agg(F.count(F.lit(1)).alias("total_rows"))


@query("ag05_zero_filled_class_counts", with_views(EP, CLASSES, select="""SELECT cls.sleep_stage, cls.code AS class_position,
  count(ep.event_id) AS "count" FROM cls LEFT JOIN ep ON ep.sleep_stage = cls.sleep_stage GROUP BY 1, 2"""))
def _(spark, sf):
    return zero_filled_counts(P.epochs(spark, sf), "sleep_stage", STAGES)


@query("ag06_class_percentage", with_views(EP, select="""SELECT sleep_stage, sleep_stage_encoded AS class_position, count(*) AS "count",
  round(100.0 * count(*) / (SELECT count(*) FROM ep), 9) AS percentage FROM ep GROUP BY 1, 2"""))
def _(spark, sf):
    return rounded(summaries.class_distribution(cleaning.supported_labels(P.epochs(spark, sf))), ["percentage"], 9)


@query("ag07_class_counts_wide", with_views(EP, select="SELECT recording_id, " + ", ".join(
    f"count(*) FILTER (WHERE sleep_stage = '{s}') AS count_{s.lower()}" for s in STAGES) + " FROM ep GROUP BY 1"))
def _(spark, sf):
    return P.epochs(spark, sf).groupBy("recording_id").agg(
        *[F.count_if(F.col("sleep_stage") == s).alias(f"count_{s.lower()}") for s in STAGES]
    )


_Q = "quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c"


@query("ag08_stage_quartiles", with_views(FT, FT_LONG, select=f"""SELECT sleep_stage, feature, n AS "count", round(b,9) AS median,
  round(a,9) AS q1, round(c,9) AS q3, round(c-a,9) AS iqr FROM (SELECT sleep_stage, feature, count(*) AS n, {_Q} FROM fl GROUP BY 1,2)"""))
def _(spark, sf):
    s = summaries.grouped_summary(P.four_powers(spark, sf, dealt=True), "sleep_stage", FEATS)
    return rounded(s.select("sleep_stage", "feature", "count", "median", "q1", "q3", "iqr"), ["median", "q1", "q3", "iqr"])


@query("ag09_stage_summary", with_views(FT, FT_LONG, select=f"""SELECT sleep_stage, feature, n AS "count", round(m,6) AS mean, round(s,6) AS std,
  round(b,9) AS median, round(a,9) AS q1, round(c,9) AS q3, round(c-a,9) AS iqr, round(lo,6) AS minimum, round(hi,6) AS maximum
  FROM (SELECT sleep_stage, feature, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi, {_Q} FROM fl GROUP BY 1,2)"""))
def _(spark, sf):
    s = summaries.grouped_summary(P.four_powers(spark, sf, dealt=True), "sleep_stage", FEATS)
    return rounded(s, ["mean", "std", "median", "q1", "q3", "iqr", "minimum", "maximum"])


@query("ag10_recording_medians", with_views(FT, select="SELECT subject_id, recording_id, count(*) AS epoch_count, " + ", ".join(
    f"round(quantile_cont({c}, 0.5),9) AS median_{c}" for c in FEATS) + " FROM ft GROUP BY 1, 2"))
def _(spark, sf):
    s = summaries.grouped_medians(P.four_powers(spark, sf, dealt=True), ["subject_id", "recording_id"], FEATS)
    return rounded(s, [f"median_{c}" for c in FEATS])


_OUT = """o AS (SELECT feature, quantile_cont(value,0.25) AS q1, quantile_cont(value,0.75) AS q3 FROM fl GROUP BY 1),
ob AS (SELECT *, q3-q1 AS iqr, q1-1.5*(q3-q1) AS lb, q3+1.5*(q3-q1) AS ub FROM o),
os AS (SELECT feature, round(q1,9) AS q1, round(q3,9) AS q3, round(iqr,9) AS iqr, round(lb,9) AS lower_bound, round(ub,9) AS upper_bound,
  count(*) FILTER (WHERE value < lb OR value > ub) AS outlier_count,
  round(100.0 * count(*) FILTER (WHERE value < lb OR value > ub) / count(*), 6) AS outlier_percentage,
  round(min(value),6) AS minimum, round(max(value),6) AS maximum FROM fl JOIN ob USING (feature) GROUP BY feature, ob.q1, ob.q3, ob.iqr, lb, ub)"""
_OUT_COLS = ["q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_percentage", "minimum", "maximum"]


@query("ag11_outlier_summary", with_views(FT, FT_LONG, _OUT, select="SELECT * FROM os"))
def _(spark, sf):
    return rounded(summaries.outlier_summary(P.four_powers(spark, sf, dealt=True), FEATS), _OUT_COLS)


@query("so08_top_outlier_features", with_views(FT, FT_LONG, _OUT, select="SELECT * FROM os ORDER BY outlier_percentage DESC, feature LIMIT 3"))
def _(spark, sf):
    return rounded(summaries.outlier_summary(P.four_powers(spark, sf, dealt=True), FEATS).limit(3), _OUT_COLS)


@query("ag12_constant_features", with_views(FT, select=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) <= 1 AS is_constant FROM (SELECT *, 1.0 AS unit FROM ft)"
    for c in (*FEATS, "unit"))))
def _(spark, sf):
    return summaries.constant_features(P.four_powers(spark, sf).withColumn("unit", F.lit(1.0)), [*FEATS, "unit"])


@query("ag13_distinct_subjects_recordings", with_views(EP, select="""SELECT count(DISTINCT subject_id) AS subject_count,
  count(DISTINCT recording_id) AS recording_count FROM ep"""))
def _(spark, sf):
    return P.epochs(spark, sf).agg(
        F.count_distinct("subject_id").alias("subject_count"), F.count_distinct("recording_id").alias("recording_count")
    )


@query("ag14_recording_inspection", with_views(AN, select="""SELECT recording_id, count(*) AS annotation_count, min(onset) AS annotation_start_seconds,
  max(onset + duration) AS annotation_end_seconds, sum(duration) AS annotation_duration_sum_seconds,
  CAST(259200000 AS BIGINT) AS n_samples, 2592000.0::DOUBLE AS signal_duration_seconds, 720.0::DOUBLE AS signal_duration_hours,
  max(onset + duration) - 2592000.0::DOUBLE AS alignment_difference_seconds,
  '["' || array_to_string(list_sort(list_distinct(list(label))), '","') || '"]' AS unique_annotation_labels_json,
  '["' || array_to_string(list_filter(list_sort(list_distinct(list(label))), lambda l: starts_with(l, 'Sleep stage')), '","') || '"]' AS sleep_labels_json
  FROM an GROUP BY 1"""))
def _(spark, sf):
    from nightframe.operators.epochs import inspect_recordings

    return inspect_recordings(P.annotations(spark, sf), F.lit(2592000.0))


# faults put in by subject, each check with its own share; 'non_empty' alone has nothing to find in a table with rows
@query("au06_inspection_audit", with_views(AN, "li AS (SELECT recording_id, subject_id AS s, count(*) FILTER (WHERE starts_with(label, 'Sleep stage')) AS n FROM an GROUP BY 1, 2)", select="""SELECT 'default_channel' AS check_name, count(*) FILTER (WHERE s % 7 = 1) AS violations FROM li
  UNION ALL SELECT 'sampling_rate', count(*) FILTER (WHERE s % 11 = 1) FROM li UNION ALL SELECT 'signal_duration', count(*) FILTER (WHERE s % 13 = 1) FROM li
  UNION ALL SELECT 'annotations', count(*) FILTER (WHERE s % 17 = 1) FROM li UNION ALL SELECT 'unique_key', count(*) FILTER (WHERE s % 19 = 1 AND n > 0) FROM li
  UNION ALL SELECT 'sleep_labels', count(*) FILTER (WHERE n = 0 OR s % 5 = 1) FROM li UNION ALL SELECT 'non_empty', 0"""))
def _(spark, sf):
    from nightframe.operators.audits import inspection_audit
    from nightframe.operators.epochs import inspect_recordings

    report = inspect_recordings(P.annotations(spark, sf), F.lit(2592000.0))
    report = report.withColumns({"default_channel_present": F.lit(True), "sampling_frequency_hz": F.lit(100.0)})
    at = lambda n: F.substring("recording_id", 2, 9).cast("bigint") % n == 1
    broken = report.withColumns({
        "default_channel_present": ~at(7), "sampling_frequency_hz": F.when(at(11), 0.0).otherwise(100.0),
        "signal_duration_seconds": F.when(at(13), 0.0).otherwise(F.col("signal_duration_seconds")),
        "annotation_count": F.when(at(17), 0).otherwise(F.col("annotation_count")),
        "sleep_labels_json": F.when(at(5), "[]").otherwise(F.col("sleep_labels_json")),
    })
    again = report.filter(at(19) & F.contains("sleep_labels_json", F.lit("Sleep stage")))
    return inspection_audit(broken.unionByName(again))


@query("ag16_extraction_summary", with_views(FT, select="SELECT recording_id, count(*) AS epoch_count, count(*) FILTER (WHERE signal_energy > 50000) AS quality_issue_count, "
  + ", ".join(f"round(quantile_cont({c},0.5),9) AS median_{c}" for c in ("delta_power", "theta_power")) + ", "
  + ", ".join(f"count(*) FILTER (WHERE sleep_stage='{s}') AS count_{s.lower()}" for s in STAGES) + " FROM ft GROUP BY 1"))
def _(spark, sf):
    df = P.four_powers(spark, sf)
    cols = ["delta_power", "theta_power"]
    med = wide_quantile(exact_quantiles(df, ["recording_id"], cols, (0.5,)), ["recording_id"], cols)
    counts = df.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("epoch_count"),
        F.count_if(F.col("signal_energy") > 50000).alias("quality_issue_count"),
        *[F.count_if(F.col("sleep_stage") == s).alias(f"count_{s.lower()}") for s in STAGES],
    )
    return counts.join(med.withColumns({f"median_{c}": F.bround(f"median_{c}", 9) for c in cols}), "recording_id")


@query("ag18_audit_roll_up", with_views(FT, select="""SELECT count(*) AS row_count, 9 AS column_count, 5 AS feature_count,
  count(DISTINCT recording_id) AS recording_count, count(DISTINCT subject_id) AS subject_count,
  count(*) FILTER (WHERE signal_energy > 50000) AS quality_issue_count FROM ft"""))
def _(spark, sf):
    df = P.four_powers(spark, sf)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(len(FEATS)).alias("feature_count"),
        F.count_distinct("recording_id").alias("recording_count"),
        F.count_distinct("subject_id").alias("subject_count"),
        F.count_if(F.col("signal_energy") > 50000).alias("quality_issue_count"),
    )


@query("ag19_exploration_roll_up", with_views(FT, FT_LONG, _OUT, select="""SELECT (SELECT count(*) FROM ft) AS row_count,
  (SELECT count(DISTINCT subject_id) FROM ft) AS subject_count,
  (SELECT string_agg(feature || ':' || CAST(outlier_count AS VARCHAR), ',' ORDER BY outlier_percentage DESC, feature) FROM os) AS top_outlier_features"""))
def _(spark, sf):
    df = P.four_powers(spark, sf)
    sizes = df.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("subject_id").alias("subject_count"))
    top = (
        summaries.outlier_summary(df, FEATS).limit(10)
        .agg(F.array_sort(F.collect_list(F.struct((-F.round("outlier_percentage", 6)).alias("k"), "feature", "outlier_count"))).alias("t"))
        .select(F.array_join(F.transform("t", lambda t: F.concat_ws(":", t["feature"], t["outlier_count"].cast("string"))), ",").alias("top_outlier_features"))
    )
    return sizes.join(F.broadcast(top), F.lit(True))


@query("ag20_dataset_summary", with_views(EP, select="""SELECT coalesce(CAST(subject_id AS VARCHAR), 'all') AS subject, count(*) AS row_count, count(*) FILTER (WHERE quality_issue_flag) AS flagged_count, """
  + ", ".join(f"count(*) FILTER (WHERE sleep_stage_encoded = {i}) AS class_{i}_count" for i in range(5)) + " FROM ep GROUP BY ROLLUP(subject_id)"))
def _(spark, sf):
    return P.epochs(spark, sf).rollup("subject_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if("quality_issue_flag").alias("flagged_count"),
        *[F.count_if(F.col("sleep_stage_encoded") == i).alias(f"class_{i}_count") for i in range(5)],
    ).withColumn("subject", F.coalesce(F.col("subject_id").cast("string"), F.lit("all"))).drop("subject_id")


@query("ag21_missing_cells", """SELECT CAST(sum((text IS NULL)::INT + (doc_id IS NULL)::INT + (quality IS NULL)::INT + (toxic IS NULL)::INT) AS BIGINT) AS missing_cells
  FROM (SELECT doc_id, text, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))""")
def _(spark, sf):
    docs = P.table(spark, sf, "documents").select("doc_id", "text")
    return summaries.missing_cells(docs.join(P.table(spark, sf, "labels"), "doc_id", "left"))


@query("ag26_relative_power_medians", with_views(FT, REL, select="SELECT sleep_stage, " + ", ".join(
    f"round(quantile_cont(relative_{b}_power,0.5),9) AS median_relative_{b}_power" for b in ("delta", "theta", "alpha", "beta")) + " FROM rel GROUP BY 1"))
def _(spark, sf):
    cols = [f"relative_{b}_power" for b in ("delta", "theta", "alpha", "beta")]
    df = P.relative_powers(P.four_powers(spark, sf, dealt=True))
    wide = wide_quantile(exact_quantiles(df, ["sleep_stage"], cols, (0.5,), bounded_keys=True), ["sleep_stage"], cols)
    return rounded(wide, [f"median_{c}" for c in cols], 9)


@query("ag27_box_statistics", with_views(FT, FT_LONG, f"q AS (SELECT sleep_stage, feature, {_Q} FROM fl GROUP BY 1,2)", select="""
  SELECT sleep_stage, feature, round(a,9) AS q1, round(b,9) AS median, round(c,9) AS q3,
  round(least(a, min(CASE WHEN value >= a-1.5*(c-a) AND value <= c+1.5*(c-a) THEN value END)),6) AS whisker_low,
  round(greatest(c, max(CASE WHEN value >= a-1.5*(c-a) AND value <= c+1.5*(c-a) THEN value END)),6) AS whisker_high
  FROM fl JOIN q USING (sleep_stage, feature) GROUP BY sleep_stage, feature, a, b, c"""))
def _(spark, sf):
    b = summaries.box_statistics(P.four_powers(spark, sf, dealt=True), "sleep_stage", FEATS)
    return rounded(b, ["q1", "median", "q3", "whisker_low", "whisker_high"])


def flagship(spark, sf):
    """Clean, engineer, then summarise every engineered feature by stage."""
    df = engineering.power_features(cleaning.clean(cleaning.supported_labels(P.four_powers(spark, sf, dealt=True))))
    cols = ["log_signal_energy", "relative_delta_power", "relative_theta_power", "relative_alpha_power", "relative_beta_power"]
    s = summaries.grouped_summary(df, "sleep_stage", cols)
    return rounded(s, ["mean", "std", "median", "q1", "q3", "iqr", "minimum", "maximum"])


@query("flagship_clean_engineer_summarise", with_views(FT, """c AS (SELECT DISTINCT * FROM ft WHERE delta_power >= 0 AND theta_power >= 0 AND alpha_power >= 0 AND beta_power >= 0 AND signal_energy >= 0),
 e AS (SELECT *, delta_power + theta_power + alpha_power + beta_power + 1e-8::DOUBLE AS tot FROM c),
 g AS (SELECT sleep_stage, 'log_signal_energy' AS feature, ln(1 + signal_energy) AS value FROM e
  UNION ALL SELECT sleep_stage, 'relative_delta_power', delta_power/tot FROM e UNION ALL SELECT sleep_stage, 'relative_theta_power', theta_power/tot FROM e
  UNION ALL SELECT sleep_stage, 'relative_alpha_power', alpha_power/tot FROM e UNION ALL SELECT sleep_stage, 'relative_beta_power', beta_power/tot FROM e)""",
  select=f"""SELECT sleep_stage, feature, n AS "count", round(m,6) AS mean, round(s,6) AS std,
  round(b,9) AS median, round(a,9) AS q1, round(c,9) AS q3, round(c-a,9) AS iqr, round(lo,6) AS minimum, round(hi,6) AS maximum
  FROM (SELECT sleep_stage, feature, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi, {_Q} FROM g GROUP BY 1,2)"""))
def _(spark, sf):
    return flagship(spark, sf)



