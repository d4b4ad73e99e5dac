"""Splits, metrics, selection tables and scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightframe import proxies as P
from nightframe.functions import probability as PR
from nightframe.operators import audits, metrics as M, selection as S, splits as SP
from nightframe.plans.oracle import EP, PR as PRV, STAGE, with_views
from nightframe.plans.registry import query
from nightframe.schemas import METRICS, STAGES

SPLITS = """su AS (SELECT DISTINCT user_id % 4 AS s FROM events),
sp0 AS (SELECT t.s AS test_subject, v.s AS validation_subject, dense_rank() OVER (ORDER BY t.s) AS outer_fold,
  row_number() OVER (PARTITION BY t.s ORDER BY v.s) AS inner_fold FROM su t JOIN su v ON v.s <> t.s),
sp AS (SELECT *, printf('outer_%02d_inner_%02d', outer_fold, inner_fold) AS split_id FROM sp0),
mb AS (SELECT split_id, outer_fold, inner_fold, s AS subject, CASE WHEN s = test_subject THEN 'test' WHEN s = validation_subject THEN 'validation' ELSE 'train' END AS role FROM sp, su),
cep AS (SELECT user_id % 4 AS cohort, CASE event_type WHEN 'error' THEN 'Wake' WHEN 'view' THEN 'N1' WHEN 'click' THEN 'N2' WHEN 'purchase' THEN 'N3' ELSE 'REM' END AS sleep_stage FROM events),
ps AS (SELECT split_id, outer_fold, inner_fold, role, count(DISTINCT subject) AS subject_count, count(*) AS row_count, """ + ", ".join(
    f"count(*) FILTER (WHERE sleep_stage = '{s}') AS {s}_count" for s in STAGES) + """ FROM mb JOIN cep ON cep.cohort = mb.subject GROUP BY 1,2,3,4)"""


def cohorts(spark, sf):
    return P.epochs(spark, sf).withColumn("subject_id", F.pmod("subject_id", F.lit(4)))


def splits(spark, sf):
    return SP.nested_splits(SP.subject_list(cohorts(spark, sf), expected=4))


@query("sp01_nested_splits", with_views(SPLITS, select="""SELECT split_id, CAST(outer_fold AS INTEGER) AS outer_fold, CAST(inner_fold AS INTEGER) AS inner_fold, test_subject, validation_subject,
  (SELECT string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) FROM su WHERE s <> test_subject AND s <> validation_subject) AS train_subjects FROM sp"""))
def _(spark, sf):
    return splits(spark, sf).select(
        "split_id", "outer_fold", "inner_fold", "test_subject", "validation_subject",
        F.array_join(F.col("train_subjects").cast("array<string>"), ",").alias("train_subjects"),
    )


@query("sp02_role_counts", with_views(SPLITS, select="""SELECT subject, count(*) FILTER (WHERE role='train') AS train_splits, count(*) FILTER (WHERE role='validation') AS validation_splits,
  count(*) FILTER (WHERE role='test') AS test_splits, count(*) FILTER (WHERE role='train') = 6 AND count(*) FILTER (WHERE role='validation') = 3 AND count(*) FILTER (WHERE role='test') = 3 AS balanced FROM mb GROUP BY 1"""))
def _(spark, sf):
    return SP.role_counts(splits(spark, sf))


@query("se04_split_isolation", with_views(SPLITS, select="SELECT split_id, count(*) = count(DISTINCT subject) AS disjoint, count(DISTINCT subject) = 4 AS complete FROM mb GROUP BY 1"))
def _(spark, sf):
    return SP.assignment_checks(splits(spark, sf))


@query("jn08_ag22_sp03_partition_summary", with_views(SPLITS, select="SELECT split_id, CAST(outer_fold AS INTEGER) AS outer_fold, CAST(inner_fold AS INTEGER) AS inner_fold, role, subject_count, row_count, " + ", ".join(
    f"{s}_count" for s in STAGES) + ", concat_ws(',', " + ", ".join(f"CASE WHEN {s}_count = 0 THEN '{s}' END" for s in STAGES) + ") AS missing_classes FROM ps"))
def _(spark, sf):
    return SP.partition_summary(cohorts(spark, sf), splits(spark, sf))


@query("sp04_split_manifest", with_views(SPLITS, select="""SELECT sp.split_id, CAST(sp.outer_fold AS INTEGER) AS outer_fold, CAST(sp.inner_fold AS INTEGER) AS inner_fold, validation_subject, test_subject,
  (SELECT string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) FROM su WHERE s <> test_subject) AS outer_development_subjects,
  (SELECT string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) FROM su WHERE s <> test_subject AND s <> validation_subject) AS train_subjects, """ + ", ".join(
    [f"max(row_count) FILTER (WHERE role='{r}') AS {r}_row_count, '' AS {r}_missing_classes, " + ", ".join(
        f"max({s}_count) FILTER (WHERE role='{r}') AS {r}_{s}_count" for s in STAGES) for r in SP.ROLES]) + " FROM sp JOIN ps USING (split_id) GROUP BY ALL"))
def _(spark, sf):
    return SP.manifest(cohorts(spark, sf), splits(spark, sf))


@query("sp05_manifest_agreement", with_views(SPLITS, select="""SELECT 'row_coverage' AS check_name, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM events WHERE user_id % 5 = 4)) AS violations FROM sp
  UNION ALL SELECT 'missing_class', count(*) FROM ps WHERE least(""" + ", ".join(f"{s}_count" for s in STAGES) + """) = 0
  UNION ALL SELECT 'stable_test_subject', count(*) FROM (SELECT outer_fold FROM sp GROUP BY 1 HAVING count(DISTINCT test_subject) <> 1)
  UNION ALL SELECT 'validation_rotation', count(*) FROM (SELECT outer_fold FROM sp GROUP BY 1 HAVING count(DISTINCT validation_subject) <> 3)
  UNION ALL SELECT 'inner_fold_ids', count(*) FROM (SELECT outer_fold FROM sp GROUP BY 1 HAVING min(inner_fold) <> 1 OR max(inner_fold) <> count(*))"""))
def _(spark, sf):
    # a fifth cohort that the splits do not know leaves rows uncovered in each of them
    wider = cohorts(spark, sf).unionByName(P.epochs(spark, sf).withColumn("subject_id", F.pmod("subject_id", F.lit(5))).filter("subject_id = 4"))
    return SP.agreement_checks(wider, splits(spark, sf))


@query("sp06_leave_one_subject_out", """WITH u AS (SELECT DISTINCT user_id AS s FROM events), l AS (SELECT list_sort(list(s)) AS al FROM u)
  SELECT CAST(row_number() OVER (ORDER BY s) AS INTEGER) AS fold, CAST(s AS BIGINT) AS validation_subject, array_to_string(list_filter(al, lambda x: x <> s), ',') AS train_subjects FROM u, l""")
def _(spark, sf):
    # N lists of N - 1 that differ by one subject from row to row: zstd sees the row before, snappy's window does not reach it
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    rows = SP.leave_one_out(SP.subject_list(P.epochs(spark, sf)))
    return rows.withColumn("train_subjects", F.array_join(F.col("train_subjects").cast("array<string>"), ","))


# --- metrics -------------------------------------------------------------------------


def metric_sql(by: str, source: str = "pr") -> str:
    """All metrics per group, straight from the definitions."""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    part = f"PARTITION BY {by}" if by else ""
    using = f"USING ({by})" if by else "ON true"
    return f"""g0 AS (SELECT {keys}y_true, y_pred, p, list_reverse_sort(p) AS o, y_arg FROM {source}),
base AS (SELECT {keys}count(*) AS row_count, avg((y_true = y_pred)::INT) AS accuracy, avg(-ln(p[y_true+1])) AS multiclass_log_loss,
  avg((y_arg = y_pred)::INT) AS predict_probability_argmax_agreement, count(*) FILTER (WHERE y_arg <> y_pred) AS predict_probability_argmax_mismatch_count,
  avg(o[1]) AS mean_prediction_confidence, avg(o[1]-o[2]) AS mean_prediction_margin,
  avg(-list_sum(list_transform(p, lambda v: v*ln(v)))/ln(5)) AS mean_normalized_entropy,
  coalesce(avg(o[1]) FILTER (WHERE y_true = y_pred), 0) AS mean_confidence_correct, coalesce(avg(o[1]) FILTER (WHERE y_true <> y_pred), 0) AS mean_confidence_incorrect FROM g0 {group}),
kk AS (SELECT unnest(range(5)) AS c),
pc AS (SELECT {keys}c, count(*) FILTER (WHERE y_true = c AND y_pred = c) AS tp, count(*) FILTER (WHERE y_pred = c) AS pp, count(*) FILTER (WHERE y_true = c) AS sup FROM g0, kk GROUP BY {keys}c),
pm AS (SELECT *, CASE WHEN pp > 0 THEN tp/pp ELSE 0 END AS prec, CASE WHEN sup > 0 THEN tp/sup ELSE 0 END AS rec, CASE WHEN pp+sup > 0 THEN 2*tp/(pp+sup) ELSE 0 END AS f1 FROM pc),
cl AS (SELECT {keys}avg(f1) AS macro_f1, sum(f1*sup)/sum(sup) AS weighted_f1, sum(rec)/count(*) FILTER (WHERE sup > 0) AS balanced_accuracy,
  sum(CAST(sup AS DOUBLE)*pp)/(sum(sup)*sum(sup)) AS pe FROM pm {group}),
mt AS (SELECT base.*, macro_f1, weighted_f1, balanced_accuracy, (accuracy-pe)/(1-pe) AS cohen_kappa FROM base JOIN cl {using})"""


METRIC_COLUMNS = (
    "accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "cohen_kappa", "multiclass_log_loss",
    "predict_probability_argmax_agreement", "mean_prediction_confidence", "mean_prediction_margin",
    "mean_normalized_entropy", "mean_confidence_correct", "mean_confidence_incorrect",
)
ROUNDED = ", ".join(f"round({c}, 9) AS {c}" for c in METRIC_COLUMNS)


def r9(df, columns=METRIC_COLUMNS):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query("me03_to_me12_me15_pooled_metrics", with_views(PRV, metric_sql(""), select=f"SELECT row_count, predict_probability_argmax_mismatch_count, {ROUNDED} FROM mt"))
def _(spark, sf):
    return r9(M.classification_metrics(P.scored(spark, sf)))


@query("me14_fold_metrics", with_views(PRV, metric_sql("outer_fold"), select=f"SELECT outer_fold, row_count, predict_probability_argmax_mismatch_count, {ROUNDED} FROM mt"))
def _(spark, sf):
    return r9(M.classification_metrics(P.scored(spark, sf), ["outer_fold"]))


@query("me14_outer_summary_frame", with_views(PRV, metric_sql("outer_fold"), select="""SELECT outer_fold, CAST(outer_fold - 1 AS VARCHAR) AS test_subjects,
  (SELECT string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) FROM (SELECT DISTINCT cohort AS s FROM pr) WHERE s <> outer_fold - 1) AS outer_development_subjects, 'logistic_regression' AS model_name,
  'logistic_regression__candidate_002' AS candidate_id, '{"C":1.0}' AS candidate_parameters_json, (SELECT count(*) FROM pr) - row_count AS development_row_count, row_count AS test_row_count,
  predict_probability_argmax_mismatch_count, """ + ", ".join(f"round({c}, 9) AS {c}" for c in (
    "accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "cohen_kappa", "multiclass_log_loss", "predict_probability_argmax_agreement",
    "mean_prediction_confidence", "mean_prediction_margin", "mean_normalized_entropy")) + " FROM mt"))
def _(spark, sf):
    from nightframe.plans.evaluation import outer_summary

    scored = P.scored(spark, sf)
    heads = SP.nested_splits(SP.subject_list(scored, "cohort", expected=4)).filter("inner_fold = 1").select(
        "outer_fold", F.col("test_subject").cast("string").alias("test_subjects"),
        F.array_join(F.col("outer_development_subjects").cast("array<string>"), ",").alias("outer_development_subjects"),
        F.lit("logistic_regression").alias("model_name"), F.lit("logistic_regression__candidate_002").alias("candidate_id"),
        F.lit('{"C":1.0}').alias("candidate_parameters_json"),
    )
    return r9(outer_summary(scored, heads), [c for c in METRIC_COLUMNS if not c.startswith("mean_confidence")])


@query("me_subject_level_metrics", with_views(PRV, metric_sql("subject_id"), select=f"SELECT subject_id, row_count, predict_probability_argmax_mismatch_count, {ROUNDED} FROM mt"))
def _(spark, sf):
    return r9(M.classification_metrics(P.scored(spark, sf), ["subject_id"]))


@query("me09_per_class_metrics", with_views(PRV, metric_sql(""), select="SELECT " + STAGE.format(c="c") + " AS class_name, sup AS support, round(prec, 9) AS precision, round(rec, 9) AS recall, round(f1, 9) AS f1 FROM pm"))
def _(spark, sf):
    return r9(M.per_class_metrics(P.scored(spark, sf)), ["precision", "recall", "f1"])


@query("me01_me02_confusion_matrix", with_views(PRV, select="""SELECT t AS true_label, q AS predicted_label, count(y_true) AS "count", round(count(y_true) / sum(count(y_true)) OVER (PARTITION BY t), 9) AS share_of_true
  FROM (SELECT CAST(unnest(range(5)) AS INTEGER) AS t) a, (SELECT CAST(unnest(range(5)) AS INTEGER) AS q) b LEFT JOIN pr ON y_true = t AND y_pred = q GROUP BY 1, 2"""))
def _(spark, sf):
    return r9(M.confusion_matrix(P.scored(spark, sf)), ["share_of_true"])


@query("ag23_fold_aggregate", with_views(PRV, metric_sql("outer_fold"), select="SELECT count(*) AS fold_count, " + ", ".join(
    f"round(avg({m}), 9) AS mean_{m}, round(stddev_pop({m}), 9) AS std_{m}" for m in METRICS) + " FROM mt"))
def _(spark, sf):
    agg = M.fold_aggregate(M.classification_metrics(P.scored(spark, sf), ["outer_fold"]))
    return r9(agg, [f"{s}_{m}" for m in METRICS for s in ("mean", "std")])


FRAME = """fr AS (SELECT subject_id, recording_id, night, epoch_id, event_id, y_true AS true_label_encoded, y_pred AS predicted_label_encoded, y_arg AS probability_argmax_label_encoded, """ + \
    STAGE.format(c="y_true") + " AS true_label, " + STAGE.format(c="y_pred") + " AS predicted_label, " + STAGE.format(c="y_arg") + """ AS probability_argmax_label,
  y_pred = y_arg AS predict_probability_argmax_agree, y_true = y_pred AS is_correct, round(list_max(p), 9) AS prediction_confidence,
  round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 9) AS prediction_margin, round(-list_sum(list_transform(p, lambda v: v*ln(v))), 9) AS prediction_entropy,
  round(-list_sum(list_transform(p, lambda v: v*ln(v)))/ln(5), 9) AS prediction_normalized_entropy, """ + ", ".join(
    f"round(p[{i + 1}], 9) AS probability_{s.lower()}" for i, s in enumerate(STAGES)) + " FROM pr)"
FRAME_DOUBLES = ["prediction_confidence", "prediction_margin", "prediction_entropy", "prediction_normalized_entropy", *[f"probability_{s.lower()}" for s in STAGES]]


def frame(spark, sf, positions=False):
    ids = ["subject_id", "recording_id", "night", *(["epoch_id"] if positions else []), "event_id"]
    return M.prediction_frame(P.scored(spark, sf, positions), ids)


@query("me13_prediction_frame", with_views(PRV, FRAME, select="SELECT * FROM fr"))
def _(spark, sf):
    return r9(frame(spark, sf, positions=True), FRAME_DOUBLES)


# faults put in by position; each check has its own share, the others see the consequences
_AU09 = {"predicted_label": 11, "confidence": 23, "margin": 29, "entropy": 31, "normalized_entropy": 37, "argmax": 17, "argmax_label": 17, "truth_label": 43, "truth_complete": 47}


@query("au09_prediction_audit", with_views(PRV, select="SELECT 'probabilities' AS check_name, count(*) FILTER (WHERE abs(list_sum(p) - 1) > 1e-8) AS violations FROM pr UNION ALL " + " UNION ALL ".join(
    f"SELECT '{k}', count(*) FILTER (WHERE event_id % {n} = 0) FROM pr" for k, n in _AU09.items()) + """
  UNION ALL SELECT 'agreement', count(*) FILTER (WHERE ((y_pred = y_arg) <> (event_id % 19 = 0)) <> (y_pred = CASE WHEN event_id % 17 = 0 THEN (y_arg + 1) % 5 ELSE y_arg END)) FROM pr
  UNION ALL SELECT 'truth', count(*) FILTER (WHERE event_id % 41 = 0 OR event_id % 47 = 0) FROM pr"""))
def _(spark, sf):
    at = lambda n: F.col("event_id") % n == 0
    swapped = lambda c, n: F.when(at(n), ~F.col(c)).otherwise(F.col(c))
    moved = {f"prediction_{c}": F.col(f"prediction_{c}") + F.when(at(_AU09[c]), 1e-3).otherwise(0.0) for c in ("confidence", "margin", "entropy", "normalized_entropy")}
    code = F.col("probability_argmax_label_encoded")
    moved |= {
        "predicted_label": F.when(at(11), "N9").otherwise(F.col("predicted_label")),
        "probability_argmax_label_encoded": F.when(at(17), (code + 1) % 5).otherwise(code),
        "predict_probability_argmax_agree": swapped("predict_probability_argmax_agree", 19),
        "is_correct": F.when(~at(47), swapped("is_correct", 41)),
        "true_label": F.when(at(43), "N9").otherwise(F.col("true_label")),
    }
    return audits.prediction_audit(M.prediction_frame(P.scored(spark, sf), ["subject_id", "recording_id", "night", "event_id"]).withColumns(moved))


@query("au12_stored_ranges", with_views(PRV, FRAME, "fz AS (SELECT " + ", ".join(f"{c} + CASE WHEN event_id % {7 + i} = 0 THEN 2 WHEN event_id % {7 + i} = 1 THEN -2 ELSE 0 END AS {c}" for i, c in enumerate(FRAME_DOUBLES)) + " FROM fr)", select=" UNION ALL ".join(
    f"SELECT '{c}' AS check_name, count(*) FILTER (WHERE {c} < 0 OR {c} > {'ln(5)' if c == 'prediction_entropy' else '1'}) AS violations FROM fz" for c in FRAME_DOUBLES)))
def _(spark, sf):
    # faults put in by position, so that every check has something to find
    moved = {
        c: F.col(c) + F.when(F.col("event_id") % (7 + i) == 0, 2).when(F.col("event_id") % (7 + i) == 1, -2).otherwise(0)
        for i, c in enumerate(FRAME_DOUBLES)
    }
    return audits.stored_range_audit(frame(spark, sf, positions=True).withColumns(moved))


@query("au11_identifier_contract", with_views(EP, """ez AS (SELECT CASE WHEN event_id % 101 = 0 THEN -1 ELSE subject_id END AS subject_id, CASE WHEN event_id % 103 = 0 THEN NULL ELSE night END AS night,
  CASE WHEN event_id % 107 = 0 THEN epoch_id + 0.5 ELSE epoch_id END AS epoch_id, CASE WHEN event_id % 109 = 0 THEN ' ' WHEN event_id % 113 = 0 THEN NULL ELSE recording_id END AS recording_id FROM ep
  UNION ALL SELECT subject_id, night, epoch_id, recording_id FROM ep WHERE event_id % 97 = 1)""", select="""SELECT 'subject_id_integer' AS check_name, count(*) FILTER (WHERE subject_id < 0) AS violations FROM ez
  UNION ALL SELECT 'night_integer', count(*) FILTER (WHERE night IS NULL) FROM ez UNION ALL SELECT 'epoch_id_integer', count(*) FILTER (WHERE epoch_id <> floor(epoch_id)) FROM ez
  UNION ALL SELECT 'recording_present', count(*) FILTER (WHERE recording_id IS NULL OR trim(recording_id) = '') FROM ez
  UNION ALL SELECT 'unique_key', (SELECT count(*) FROM (SELECT 1 FROM ez GROUP BY subject_id, night, epoch_id, recording_id HAVING count(*) > 1))"""))
def _(spark, sf):
    ep = P.epochs(spark, sf, positions=True).select("event_id", "subject_id", "night", F.col("epoch_id").cast("double"), "recording_id")
    at = lambda n, k=0: F.col("event_id") % n == k
    seeded = ep.withColumns({
        "subject_id": F.when(at(101), -1).otherwise(F.col("subject_id")),
        "night": F.when(~at(103), F.col("night")),
        "epoch_id": F.col("epoch_id") + F.when(at(107), 0.5).otherwise(0.0),
        "recording_id": F.when(at(109), " ").when(~at(113), F.col("recording_id")),
    })
    return audits.identifier_audit(seeded.unionByName(ep.filter(at(97, 1))))


@query("au07_au08_dataset_contract", with_views(EP, """ez AS (SELECT subject_id, event_id, CASE WHEN event_id % 53 = 0 THEN NULL ELSE recording_id END AS recording_id, CASE WHEN event_id % 59 = 0 THEN 'nan'::DOUBLE ELSE v END AS v,
  CASE WHEN event_id % 61 = 0 THEN -1 ELSE sleep_stage_encoded END AS code, sleep_stage FROM ep UNION ALL SELECT subject_id, event_id, recording_id, v, sleep_stage_encoded, sleep_stage FROM ep WHERE event_id % 97 = 1)""", select="""SELECT 'null_cell' AS check_name, count(*) FILTER (WHERE v IS NULL OR recording_id IS NULL) AS violations FROM ez
  UNION ALL SELECT 'finite_features', count(*) FILTER (WHERE v IS NULL OR isnan(v)) FROM ez
  UNION ALL SELECT 'integer_codes', count(*) FILTER (WHERE code < 0) FROM ez UNION ALL SELECT 'label_mapping', count(*) FILTER (WHERE code <> CASE sleep_stage WHEN 'Wake' THEN 0 WHEN 'N1' THEN 1 WHEN 'N2' THEN 2 WHEN 'N3' THEN 3 ELSE 4 END) FROM ez
  UNION ALL SELECT 'non_empty', (count(*) = 0)::INT FROM ez UNION ALL SELECT 'two_subjects', (count(DISTINCT subject_id) < 2)::INT FROM ez
  UNION ALL SELECT 'unique_key', (SELECT count(*) FROM (SELECT 1 FROM ez GROUP BY event_id HAVING count(*) > 1))"""))
def _(spark, sf):
    ep = P.epochs(spark, sf).drop("ts")
    at = lambda n, k=0: F.col("event_id") % n == k
    seeded = ep.withColumns({
        "recording_id": F.when(~at(53), F.col("recording_id")),
        "v": F.when(at(59), F.lit(float("nan"))).otherwise(F.col("v")),
        "sleep_stage_encoded": F.when(at(61), -1).otherwise(F.col("sleep_stage_encoded")),
    })
    return audits.dataset_audit(seeded.unionByName(ep.filter(at(97, 1))), ["v"], ["event_id"])


@query("wn13_complete_coverage", "SELECT count(*) AS row_count, count(DISTINCT event_id) AS distinct_positions, min(event_id) AS first_position, max(event_id) AS last_position, count(*) = count(DISTINCT event_id) AND min(event_id) = 0 AND max(event_id) = count(*) - 1 AS complete FROM events")
def _(spark, sf):
    return M.coverage(P.scored(spark, sf), "event_id")


@query("se01_so05_concatenated_folds", with_views(PRV, select="SELECT event_id, outer_fold, y_true, y_pred FROM pr"))
def _(spark, sf):
    s = P.scored(spark, sf).select("event_id", "outer_fold", "y_true", "y_pred")
    parts = [s.filter(F.col("outer_fold") == k) for k in (1, 2, 3, 4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("event_id")


# --- probability arrays -----------------------------------------------------------------


@query("ar01_to_ar03_probability_scalars", with_views(PRV, select="""SELECT event_id, y_arg AS argmax, round(list_max(p), 9) AS top, round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 9) AS margin,
  round(-list_sum(list_transform(p, lambda v: v*ln(v))), 9) AS entropy, round(-list_sum(list_transform(p, lambda v: v*ln(v)))/ln(5), 9) AS normalized FROM pr"""))
def _(spark, sf):
    return P.scored(spark, sf).select(
        "event_id", PR.argmax("p").alias("argmax"), F.round(PR.confidence("p"), 9).alias("top"), F.round(PR.margin("p"), 9).alias("margin"),
        F.round(PR.entropy("p", 5), 9).alias("entropy"), F.round(PR.normalized_entropy("p", 5), 9).alias("normalized"),
    )


@query("ar04_ar05_valid_and_reordered", with_views(PRV, select="""SELECT event_id, abs(list_sum(p) - 1) <= 1e-8 AS is_valid, round(p[5], 9) AS first, round(p[1], 9) AS last, round(list_sum(p), 9) AS total FROM pr"""))
def _(spark, sf):
    s = PR.with_normalized(P.scored(spark, sf), "p", "n", 5).withColumn("q", PR.reorder("n", [4, 3, 2, 1, 0]))
    return s.select(
        "event_id", PR.is_valid("p", 5).alias("is_valid"), F.round(F.col("q")[0], 9).alias("first"), F.round(F.col("q")[4], 9).alias("last"),
        F.round(PR.total("q", 5), 9).alias("total"),
    )


# --- candidate tables ------------------------------------------------------------------

CAND_LIST = S.candidates()
CANDS = "cd AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{c['model_name']}', {c['candidate_index']}, '{c['candidate_id']}', '{c['candidate_parameters_json']}', {str(c['eligible_for_selection']).lower()}, {c['complexity_rank']})"
    for i, c in enumerate(CAND_LIST)) + ") t(slot, model_name, candidate_index, candidate_id, candidate_parameters_json, eligible_for_selection, complexity_rank))"
GRID = "gr AS (SELECT pr.*, printf('%d|%d|%d', outer_fold, event_id % 29, user_fold) AS cell FROM (SELECT *, CAST(subject_id % 3 + 1 AS INTEGER) AS user_fold FROM pr) pr)"
AGGC = """fm AS (SELECT CAST(string_split(cell, '|')[1] AS INTEGER) AS outer_fold, CAST(string_split(cell, '|')[2] AS INTEGER) AS slot, mt.* FROM mt),
ag AS (SELECT outer_fold, slot, count(*) AS fold_count, """ + ", ".join(f"avg({m}) AS mean_{m}, stddev_pop({m}) AS std_{m}" for m in METRICS) + """ FROM fm GROUP BY 1, 2),
sm AS (SELECT ag.*, cd.* EXCLUDE (slot), CASE WHEN eligible_for_selection THEN row_number() OVER (PARTITION BY outer_fold, eligible_for_selection ORDER BY round(mean_macro_f1,12) DESC, round(std_macro_f1,12), round(mean_balanced_accuracy,12) DESC,
  round(mean_multiclass_log_loss,12), complexity_rank, model_name, candidate_index) END AS selection_rank FROM ag JOIN cd USING (slot))"""


def fold_metrics(spark, sf):
    """Metrics of each (outer fold, candidate, inner fold) over the whole scored table."""
    table = S.candidate_table(spark)
    ids = F.array(*[F.lit(c["candidate_id"]) for c in CAND_LIST])
    rows = P.scored(spark, sf).withColumns(
        {
            "candidate_id": F.element_at(ids, (F.pmod("event_id", F.lit(29)) + 1).cast("int")),
            "inner_fold": (F.pmod("subject_id", F.lit(3)) + 1).cast("int"),
        }
    )
    return M.classification_metrics(rows, ["outer_fold", "candidate_id", "inner_fold"]), table


def summary(spark, sf):
    fm, table = fold_metrics(spark, sf)
    rounded = fm.withColumns({m: F.col(m) for m in METRICS})
    return S.selection_summary(rounded, table, None)


@query("jn10_wn05_so04_ml11_selection_summary", with_views(PRV, CANDS, GRID, metric_sql("cell", "gr"), AGGC, select="""SELECT outer_fold, model_name, candidate_index, candidate_id, candidate_parameters_json, eligible_for_selection,
  coalesce(selection_rank, 0) AS selection_rank, coalesce(selection_rank = 1, false) AS is_selected, complexity_rank, fold_count, """ + ", ".join(f"round(mean_{m}, 9) AS mean_{m}, round(std_{m}, 9) AS std_{m}" for m in METRICS) + " FROM sm"))
def _(spark, sf):
    s = summary(spark, sf)
    return r9(s, [f"{k}_{m}" for m in METRICS for k in ("mean", "std")]).fillna(0, ["selection_rank"])


@query("au14_au15_selection_checks", with_views(PRV, CANDS, GRID, metric_sql("cell", "gr"), AGGC, select="""SELECT outer_fold, count(*) FILTER (WHERE selection_rank = 1) AS first_ranks, count(*) FILTER (WHERE selection_rank = 1) AS selected,
  count(*) FILTER (WHERE selection_rank = 1) AS selected_is_first, count(DISTINCT candidate_id) AS candidates, count(*) AS rows, CAST(max(selection_rank) AS INTEGER) AS last_rank,
  count(*) FILTER (WHERE eligible_for_selection) AS eligible, min(fold_count) = max(fold_count) AS equal_folds,
  count(*) FILTER (WHERE selection_rank = 1) = 1 AND min(fold_count) = max(fold_count) AS safe FROM sm GROUP BY 1"""))
def _(spark, sf):
    return S.selection_checks(summary(spark, sf))


@query("flt16_eligible_candidates", with_views(PRV, CANDS, GRID, metric_sql("cell", "gr"), AGGC, select="SELECT outer_fold, candidate_id, round(mean_macro_f1, 9) AS mean_macro_f1 FROM sm WHERE eligible_for_selection"))
def _(spark, sf):
    return r9(summary(spark, sf).filter("eligible_for_selection").select("outer_fold", "candidate_id", "mean_macro_f1"), ["mean_macro_f1"])


@query("jn09_ml07_candidate_fold_product", with_views(SPLITS, CANDS, select="SELECT split_id, model_name, candidate_id, candidate_parameters_json FROM sp, cd"))
def _(spark, sf):
    grid = F.array(*[
        F.struct(*[F.lit(c[k]).alias(k) for k in ("model_name", "candidate_id", "candidate_parameters_json")]) for c in CAND_LIST
    ])
    return splits(spark, sf).select("split_id", F.inline(grid))




@query("sp07_stratified_group_folds", with_views(EP, "n AS (SELECT count(DISTINCT subject_id) AS n FROM ep)", select="""SELECT role, count(*) AS folds, n * max(times) AS assignments, max(times) AS per_subject, 0::BIGINT AS impure_subjects, true AS balanced,
  (SELECT count(*) FROM ep) * max(times) AS rows FROM n, (SELECT 'test' AS role, unnest(range(5)) AS f, 1 AS times UNION ALL SELECT 'validation', unnest(range(15)), 4) GROUP BY role, n"""))
def _(spark, sf):
    ep = P.epochs(spark, sf)
    folds = SP.stratified_group_folds(ep)
    times = F.when(F.col("role") == "test", 1).otherwise(4)
    per_subject = folds.groupBy("role", "subject").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("outer_fold").alias("outers"))
    purity = per_subject.groupBy("role").agg(
        F.sum("n").alias("assignments"), F.max("n").cast("int").alias("per_subject"), F.count_if((F.col("n") != times) | (F.col("outers") != times)).alias("impure_subjects")
    )
    balance = SP.fold_balance(ep, folds).groupBy("role").agg(F.count(F.lit(1)).alias("folds"), F.sum("rows").alias("rows"), (F.max("largest_imbalance") < 0.1).alias("balanced"))
    return purity.join(F.broadcast(balance), "role")  # a row per role
