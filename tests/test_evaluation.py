import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from nightframe.operators import audits, metrics as M, models, selection as S, splits as SP
from nightframe.plans import evaluation as EV
from nightframe.schemas import IDENTIFIERS, METRICS, PREDICTION_COLUMNS, STAGES
from nightframe.sources import runs

SF = "/root/testdata/sf0.001"
META = {
    "artifact_type": "final", "model_file_path": "m", "model_file_sha256": "0" * 64, "model_name": "x", "candidate_id": "x__candidate_001",
    "outer_fold": None, "deployment_ready": False, "non_deployment_override": True, "input_scope": "all", "feature_names": ["f"],
    "class_mapping": {s: i for i, s in enumerate(STAGES)},
}


#: (true class, given class) of the epochs of each subject.
HAND = {
    0: [(0, 0), (0, 0), (1, 1), (2, 2), (3, 3), (4, 2)],
    1: [(0, 1), (1, 1), (2, 2), (2, 2), (3, 2), (4, 4)],
    2: [(0, 0), (1, 1), (1, 0), (3, 3), (4, 4), (4, 4)],
    3: [(2, 2), (2, 3), (0, 0), (3, 3), (1, 1), (4, 4)],
}
PAIRS = [pair for pairs in HAND.values() for pair in pairs]


def predictions(spark):
    """The given class at 0.7; a true class that was missed at 0.15; the rest in equal parts."""
    rows = []
    for subject, pairs in HAND.items():
        for epoch, (truth, given) in enumerate(pairs):
            p = [0.075 if truth == given else 0.05] * 5
            p[truth], p[given] = 0.15, 0.7
            rows.append((subject, f"night{subject}", 1, epoch, truth, given, p))
    return spark.createDataFrame(rows, "subject_id int, recording_id string, night int, epoch_id int, y_true int, y_pred int, p array<double>")


# --- metrics ------------------------------------------------------------------------------


def test_metrics_of_the_hand_case(spark):
    m = M.classification_metrics(predictions(spark)).first()
    right = sum(a == b for a, b in PAIRS)
    assert right == 19 and m.accuracy == pytest.approx(19 / 24) and m.predict_probability_argmax_agreement == 1.0
    assert m.mean_prediction_confidence == pytest.approx(0.7)
    assert m.mean_prediction_margin == pytest.approx((19 * 0.625 + 5 * 0.55) / 24)
    assert m.multiclass_log_loss == pytest.approx(-(19 * np.log(0.7) + 5 * np.log(0.15)) / 24)
    chance = sum(sum(a == c for a, _ in PAIRS) * sum(b == c for _, b in PAIRS) for c in range(5)) / 24**2
    assert m.cohen_kappa == pytest.approx((19 / 24 - chance) / (1 - chance))


def test_perfect_and_absent_classes(spark):
    perfect = predictions(spark).withColumn("y_pred", F.col("y_true")).filter("y_true < 3")
    m = M.classification_metrics(perfect).first()
    assert m.accuracy == 1.0 and m.balanced_accuracy == 1.0 and m.macro_f1 == pytest.approx(0.6) and m.weighted_f1 == 1.0
    assert m.mean_confidence_incorrect == 0.0
    c = {(r.true_label, r.predicted_label): (r["count"], r.share_of_true) for r in M.confusion_matrix(perfect).collect()}
    assert len(c) == 25 and c[(0, 0)] == (5, 1.0) and c[(4, 4)] == (0, 0.0)
    pc = {r.class_name: (r.support, r.recall) for r in M.per_class_metrics(perfect).collect()}
    assert pc["N3"] == (0, 0.0)


def test_grouped_metrics_cover_each_group(spark):
    m = {r.subject_id: r.accuracy for r in M.classification_metrics(predictions(spark), ["subject_id"]).collect()}
    assert m == pytest.approx({0: 5 / 6, 1: 4 / 6, 2: 5 / 6, 3: 5 / 6})
    agg = M.fold_aggregate(M.classification_metrics(predictions(spark), ["subject_id"])).first()
    assert agg.fold_count == 4 and agg.mean_accuracy == pytest.approx(19 / 24)


def test_prediction_frame_and_its_audit(spark):
    frame = M.prediction_frame(predictions(spark), IDENTIFIERS)
    assert set(PREDICTION_COLUMNS) <= set(frame.columns)
    assert {r.violations for r in audits.prediction_audit(frame).collect()} == {0}
    broken = frame.withColumn("prediction_margin", F.col("prediction_margin") + 1e-6).withColumn("predicted_label", F.lit("N1"))
    got = {r.check_name: r.violations for r in audits.prediction_audit(broken).collect()}
    assert got["margin"] == 24 and got["predicted_label"] > 10 and got["entropy"] == 0
    out_of_range = frame.withColumn("prediction_entropy", F.lit(2.0))
    assert audits.stored_range_audit(out_of_range).filter("check_name = 'prediction_entropy'").first().violations == 24
    with pytest.raises(ValueError, match="clash"):
        M.prediction_frame(predictions(spark).withColumn("is_correct", F.lit(1)), [*IDENTIFIERS, "is_correct"])
    with pytest.raises(Exception, match="invalid probability"):
        M.prediction_frame(predictions(spark).withColumn("p", F.array(*[F.lit(0.3)] * 5)), IDENTIFIERS).collect()


def test_coverage(spark):
    df = spark.createDataFrame([(0,), (1,), (1,), (3,)], "i int")
    assert not M.coverage(df, "i").first().complete
    assert M.coverage(spark.range(4).withColumnRenamed("id", "i"), "i").first().complete


# --- splits -------------------------------------------------------------------------------


def subjects(spark, *ids):
    return spark.createDataFrame([(i, s, s) for i in ids for s in STAGES], "subject_id int, sleep_stage string, x string")


def test_nested_splits_of_four_subjects(spark):
    df = subjects(spark, 9, 3, 5, 7)
    table = SP.nested_splits(SP.subject_list(df, expected=4))
    rows = table.orderBy("split_id").collect()
    assert len(rows) == 12 and rows[0].split_id == "outer_01_inner_01"
    assert (rows[0].test_subject, rows[0].validation_subject, rows[0].train_subjects) == (3, 5, [7, 9])
    assert all(r.disjoint and r.complete for r in SP.assignment_checks(table).collect())
    assert all(r.balanced for r in SP.role_counts(table).collect())
    assert {r.violations for r in SP.agreement_checks(df, table).collect()} == {0}
    shuffled = SP.nested_splits(SP.subject_list(df.orderBy(F.rand(1)), expected=4)).orderBy("split_id").collect()
    assert shuffled == rows
    flat = SP.manifest(df, table).filter("split_id = 'outer_04_inner_03'").first()
    assert (flat.train_subjects, flat.train_row_count, flat.test_Wake_count, flat.test_missing_classes) == ("3,5", 10, 1, "")


def test_missing_class_is_reported(spark):
    df = subjects(spark, 1, 2, 3, 4).filter("not (subject_id = 4 and sleep_stage = 'REM')")
    table = SP.nested_splits(SP.subject_list(df))
    parts = SP.partition_summary(df, table).filter("role = 'test' and missing_classes <> ''").collect()
    assert {r.missing_classes for r in parts} == {"REM"} and len(parts) == 3
    assert {r.check_name: r.violations for r in SP.agreement_checks(df, table).collect()}["missing_class"] > 0


def test_subject_counts(spark):
    with pytest.raises(Exception, match="unsupported number of subjects: 3"):
        SP.subject_list(subjects(spark, 1, 2, 3), expected=4).collect()
    with pytest.raises(Exception, match="unsupported number of subjects: 1"):
        SP.subject_list(subjects(spark, 1)).collect()
    many = subjects(spark, *range(78))
    folds = SP.leave_one_out(SP.subject_list(many, expected=78)).orderBy("fold").collect()
    assert len(folds) == 78 and all(r.validation_subject == i and r.train_subjects == [s for s in range(78) if s != i] for i, r in enumerate(folds))
    nested = SP.nested_splits(SP.subject_list(subjects(spark, *range(9))))
    assert nested.count() == 72 and {r.train_row_count for r in SP.manifest(subjects(spark, *range(9)), nested).collect()} == {35}


def test_leave_one_out_lists_are_made_in_many_tasks(spark):
    many = spark.range(200).select(F.col("id").alias("subject_id"))
    folds = SP.leave_one_out(SP.subject_list(many)).withColumn("task", F.spark_partition_id())
    rows = folds.select("fold", "validation_subject", F.size("train_subjects").alias("n"), F.array_contains("train_subjects", F.col("validation_subject")).alias("own"), "task").collect()
    assert sorted((r.fold, r.validation_subject) for r in rows) == [(i + 1, i) for i in range(200)]
    assert {(r.n, r.own) for r in rows} == {(199, False)}
    assert max(sum(r.task == t for r in rows) for t in {r.task for r in rows}) < 100


def test_agreement_finds_uncovered_rows(spark):
    df = subjects(spark, 1, 2, 3, 4)
    table = SP.nested_splits(SP.subject_list(df))
    outside = df.unionByName(subjects(spark, 9))
    torn = table.withColumn("train_subjects", F.slice("train_subjects", 1, 1))
    for rows, splits in ((outside, table), (df, torn)):
        assert {r.check_name: r.violations for r in SP.agreement_checks(rows, splits).collect()}["row_coverage"] == 12


def test_stratified_group_folds_are_pure_even_and_repeatable(spark):
    rng = np.random.default_rng(4)
    counts = {s: rng.multinomial(rng.integers(40, 400), [0.4, 0.05, 0.3, 0.15, 0.1]).tolist() for s in range(60)}
    folds = SP.greedy_folds(counts, 5, 42)
    total = np.sum(list(counts.values()), axis=0)
    shares = np.array([np.sum([counts[s] for s in counts if folds[s] == f], axis=0) / total for f in range(1, 6)])
    assert set(folds) == set(counts) and np.abs(shares - 0.2).max() < 0.06
    assert folds == SP.greedy_folds(dict(reversed(counts.items())), 5, 42)
    level = {s: [3, 3] for s in range(40)}  # all tie: the seed decides
    assert SP.greedy_folds(level, 4, 1) != SP.greedy_folds(level, 4, 2)
    with pytest.raises(ValueError, match="do not fill"):
        SP.greedy_folds({1: [1], 2: [1]}, 3, 1)
    df = subjects(spark, *range(9))
    table = SP.stratified_group_folds(df, outer=3, inner=2)
    rows = table.collect()
    assert sum(r.role == "test" for r in rows) == 9 and sum(r.role == "validation" for r in rows) == 18
    for outer in (1, 2, 3):
        test = {r.subject for r in rows if r.outer_fold == outer and r.role == "test"}
        held = [r.subject for r in rows if r.outer_fold == outer and r.role == "validation"]
        assert not test & set(held) and len(held) == len(set(held)) and test | set(held) == set(range(9))
    assert SP.fold_balance(df, table).agg(F.max("largest_imbalance")).first()[0] < 1e-9


# --- selection ------------------------------------------------------------------------------


def test_grid_expansion():
    rows = S.candidates()
    assert len(rows) == 29 and rows[0]["candidate_id"] == "dummy_prior__candidate_001"
    assert S.expand_grid([{"b": [1, 2], "a": [3]}, {}]) == [{"a": 3, "b": 1}, {"a": 3, "b": 2}, {}]
    with pytest.raises(ValueError):
        S.candidates(["svm"])


def candidate(name, index, complexity, eligible=True, **m):
    base = {**{f"mean_{k}": 0.5 for k in METRICS}, **{f"std_{k}": 0.1 for k in METRICS}, **m}
    return {"outer_fold": 1, "model_name": name, "candidate_index": index, "candidate_id": f"{name}{index}", "complexity_rank": complexity,
            "eligible_for_selection": eligible, **base}


def test_ranking_breaks_ties_in_order(spark):
    rows = [
        candidate("b", 1, 2), candidate("a", 1, 2), candidate("c", 1, 1), candidate("d", 1, 3, std_macro_f1=0.05),
        candidate("e", 1, 0, eligible=False, mean_macro_f1=0.9), candidate("a", 2, 2), candidate("f", 1, 9, mean_macro_f1=0.6),
    ]
    got = {r.candidate_id: r.selection_rank for r in S.rank_candidates(spark.createDataFrame(rows)).collect()}
    assert got == {"f1": 1, "d1": 2, "c1": 3, "a1": 4, "a2": 5, "b1": 6, "e1": None}


# --- store ----------------------------------------------------------------------------------


def test_store_is_idempotent_and_recovers(spark, tmp_path):
    root = str(tmp_path / "store")
    frame = M.prediction_frame(predictions(spark), IDENTIFIERS)
    first = runs.persist_run(frame.repartition(5), root, META, "t0")
    again = runs.persist_run(frame.orderBy(F.desc("epoch_id")), root, META, "t1")
    assert first.inserted and not again.inserted and first.run_id == again.run_id
    stored = runs.read_run(spark, root, first.run_id).collect()
    assert [r.row_position for r in stored] == list(range(24)) and [r.epoch_id for r in stored] == [*range(6)] * 4
    other = runs.persist_run(frame, root, {**META, "model_name": "y"}, "t2")
    assert other.inserted and other.run_id != first.run_id
    a = runs.audit_store(spark, root).first()
    assert (a.run_count, a.row_count, a.orphan_count) == (2, 48, 0)
    with pytest.raises(KeyError):
        runs.read_run(spark, root, "nope")
    # rows without a header are an unfinished attempt
    runs.write_attempt(frame, root, "f" * 64)
    assert runs.audit_store(spark, root).first().orphan_count == 24
    with pytest.raises(KeyError):
        runs.read_run(spark, root, "f" * 64)
    left = runs.without_run(runs.read_table(spark, root, "rows"), spark.createDataFrame([(first.run_id,)], "run_id string"))
    assert left.count() == 48


def test_damaged_store_is_noticed(spark, tmp_path):
    root = str(tmp_path / "store")
    frame = M.prediction_frame(predictions(spark), IDENTIFIERS)
    done = runs.persist_run(frame, root, META, "t0")
    header = runs.read_table(spark, root, "runs").first()
    assert sum(f["rows"] for f in header["files"]) == 24 and [f["first_position"] for f in header["files"]][0] == 0
    # an attempt beside the listed one changes nothing
    runs.write_attempt(frame.limit(5), root, done.run_id)
    assert not runs.persist_run(frame, root, META, "t1").inserted and runs.read_run(spark, root, done.run_id).count() == 24
    frame.limit(3).write.mode("overwrite").parquet(f"{root}/rows/run_id={done.run_id}/attempt={header['attempt']}")
    with pytest.raises(ValueError, match="damaged"):
        runs.persist_run(frame, root, META, "t1")


def test_rows_that_change_between_passes_get_no_header(spark, tmp_path):
    root = str(tmp_path / "store")
    frame = M.prediction_frame(predictions(spark), IDENTIFIERS)
    moving = frame.mapInPandas(lambda batches: (b.assign(prediction_margin=np.random.default_rng().random(len(b))) for b in batches), frame.schema)
    with pytest.raises(ValueError, match="changed"):
        runs.persist_run(moving, root, META, "t0")
    assert runs.read_table(spark, root, "runs") is None


# --- models ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(4):
        for i in range(60):
            c = i % 5
            rows.append((s, f"R{s}", 1, i, STAGES[c], c, float(c * 3 + rng.normal(0, 0.3)), float(rng.normal()), 7.0))
    df = spark.createDataFrame(
        rows, "subject_id int, recording_id string, night int, epoch_id int, sleep_stage string, sleep_stage_encoded int, f1 double, f2 double, f3 double"
    ).cache()
    yield df
    df.unpersist()


FEATS = ["f1", "f2", "f3"]


def test_weights_and_prior(spark, separable):
    part = separable.filter("sleep_stage_encoded < 2 and not (sleep_stage_encoded = 1 and epoch_id > 30)")
    counts = models.class_counts(part)
    n = sum(counts.values())
    w = {r.sleep_stage_encoded: r.w for r in part.select("sleep_stage_encoded", models.balanced_weight(counts).alias("w")).distinct().collect()}
    assert w[0] == pytest.approx(n / (2 * counts[0])) and w[1] == pytest.approx(n / (2 * counts[1]))
    p = models.score(models.fit_candidate(part, FEATS, "dummy_prior", {}), separable).first().p
    assert p[0] == pytest.approx(counts[0] / n) and p[2:] == [0.0, 0.0, 0.0]


@pytest.mark.parametrize(
    "name,params",
    [
        ("logistic_regression", {"C": 1.0}), ("sgd_logistic", {"penalty": "elasticnet", "alpha": 0.001, "l1_ratio": 0.5}),
        ("random_forest", {"max_depth": 12, "min_samples_leaf": 1, "max_features": "sqrt"}),
    ],
)
def test_models_learn_and_repeat(spark, separable, name, params):
    fit = lambda: models.score(models.fit_candidate(separable, FEATS, name, params, trees=10, max_iter=100), separable)
    a = fit()
    assert M.classification_metrics(a).first().accuracy > 0.9
    assert a.filter(F.abs(F.aggregate("p", F.lit(0.0), lambda x, y: x + y) - 1) > 1e-8).count() == 0
    one = {(r.subject_id, r.epoch_id): r.p for r in a.collect()}
    two = {(r.subject_id, r.epoch_id): r.p for r in fit().collect()}
    assert one.keys() == two.keys() and max(max(abs(x - y) for x, y in zip(one[k], two[k])) for k in one) < 1e-9


def test_extra_trees_has_no_spark_estimator(spark, separable):
    with pytest.raises(ValueError, match="no estimator"):
        models.fit_candidate(separable, FEATS, "extra_trees", {})
    with pytest.raises(ValueError, match="registry"):
        models.fit_candidate(separable, FEATS, "svm", {})


def test_search_refit_save_and_batch_scoring(spark, separable, tmp_path):
    names = ["dummy_prior", "logistic_regression"]
    summary = EV.inner_search(separable, FEATS, names, outer_folds=[2], max_candidates_per_model=1, expected_subjects=4, max_iter=30)
    rows = summary.collect()
    assert [r.is_selected for r in rows] == [True, False] and rows[0].fold_count == 3 and rows[0].test_subjects == "1"
    assert S.selection_checks(summary).first().safe
    assert not S.selection_checks(summary.withColumn("test_accuracy", F.lit(0.9))).first().safe
    spec = {"model_name": "logistic_regression", "params": {"C": 1.0}}
    scored = EV.outer_evaluation(separable, FEATS, {k: spec for k in range(1, 5)}, IDENTIFIERS, max_iter=30)
    assert scored.count() == separable.count() and scored.select(*IDENTIFIERS).distinct().count() == separable.count()
    fitted, table = EV.final_refit(separable, FEATS, names, 1, max_iter=30)
    assert fitted.candidate["model_name"] == "logistic_regression" and table.count() == 2
    assert models.save_and_verify(fitted, str(tmp_path / "model"), separable) == 0
    root = str(tmp_path / "runs")
    with pytest.raises(PermissionError):
        EV.batch_score(separable, fitted, root, META, "t0")
    done = EV.batch_score(separable, fitted, root, META, "t0", override=True)
    assert done.inserted and runs.read_run(spark, root, done.run_id).count() == separable.count()
    unlabeled = separable.drop("sleep_stage", "sleep_stage_encoded")
    other = EV.batch_score(unlabeled, fitted, root, META, "t0", override=True)
    assert "is_correct" not in runs.read_run(spark, root, other.run_id).columns


def test_scoring_input_contract(spark, separable):
    ok = separable
    with pytest.raises(ValueError, match="unexpected"):
        EV.prepare_scoring(ok.withColumn("zzz", F.lit(1)), FEATS)
    with pytest.raises(ValueError, match="missing"):
        EV.prepare_scoring(ok.drop("f1"), FEATS)
    with pytest.raises(ValueError, match="unique_key"):
        EV.prepare_scoring(ok.unionByName(ok), FEATS)
    with pytest.raises(ValueError, match="f2"):
        EV.prepare_scoring(ok.withColumn("f2", F.lit(float("nan"))), FEATS)
    with pytest.raises(ValueError, match="quality_issue_flag"):
        EV.prepare_scoring(ok.withColumn("quality_issue_flag", F.lit(True)), FEATS)
    assert EV.prepare_scoring(ok.withColumn("quality_issue_flag", F.lit(True)), FEATS, allow_flagged=True).count() == ok.count()


class Seen(Exception):
    pass


@pytest.mark.skipif(not os.path.isdir(SF), reason="shared test tables are not here")
@pytest.mark.parametrize(("name", "folds"), [("ml09_ml10_inner_search", 12), ("ml13_ml14_refit_save_verify", 4)])
def test_search_queries_fit_every_fittable_candidate(spark, monkeypatch, name, folds):
    def seen(df, given, specs, features, **fit):
        raise Seen(len(given), sorted(s["candidate_id"] for s in specs), fit)

    monkeypatch.setattr(EV, "fold_metrics", seen)
    with pytest.raises(Seen) as found:
        entry.queries()[name](spark, SF)
    want = sorted(c["candidate_id"] for c in S.candidates() if c["model_name"] != "extra_trees")
    assert found.value.args == (folds, want, {}) and len(want) == 21


@pytest.mark.skipif(not os.path.isdir(SF), reason="shared test tables are not here")
def test_forest_query_grows_the_trees_of_the_registry(spark, monkeypatch):
    def seen(rows, features, params, weights, classes, trees, seed):
        raise Seen(params["max_depth"], trees)

    monkeypatch.setattr(models, "fit_forest", seen)
    with pytest.raises(Seen) as found:
        entry.queries()["ml04_random_forest"](spark, SF)
    assert found.value.args == (12, 300)


@pytest.fixture(scope="module")
def noisy(spark):
    """Four subjects, classes that overlap, one class missing for one of them, a constant feature."""
    rng = np.random.default_rng(12)
    rows = []
    for s in range(4):
        for i in range(150 + 40 * s):
            c = int(rng.integers(0, 4 if s == 1 else 5))
            rows.append((s, f"R{s}", 1, i, c, float(c + rng.normal(0, 1.5)), float((c % 2) * 30 + rng.normal(100, 20)), 7.0))
    df = spark.createDataFrame(rows, "subject_id int, recording_id string, night int, epoch_id int, sleep_stage_encoded int, f1 double, f2 double, f3 double").repartition(3).cache()
    yield df
    df.unpersist()


def test_batched_linear_fits_equal_single_ones(spark, noisy):
    """All candidates of all folds in common scans: the metrics, and what is selected, are those of one fit after the other."""
    folds = [r.asDict() for r in SP.nested_splits(SP.subject_list(noisy)).orderBy("split_id").limit(4).collect()]
    specs = EV.candidate_specs(["dummy_prior", "logistic_regression", "sgd_logistic"])
    got = {(r.outer_fold, r.inner_fold, r.candidate_id): r for r in EV.fold_metrics(noisy, folds, specs, FEATS).collect()}
    assert len(got) == 4 * 13
    single = {}
    for fold in folds[:1]:
        train, held = EV.pick(noisy, fold["train_subjects"]), EV.pick(noisy, [fold["validation_subject"]])
        for spec in [specs[0], specs[1], specs[6], specs[12]]:  # the prior, ridge, and elastic nets
            one = M.classification_metrics(models.score(models.fit_candidate(train, FEATS, spec["model_name"], spec["params"], max_iter=300), held)).first()
            many = got[fold["outer_fold"], fold["inner_fold"], spec["candidate_id"]]
            assert many.row_count == one.row_count
            assert many.multiclass_log_loss == pytest.approx(one.multiclass_log_loss, rel=2e-4) and many.accuracy == pytest.approx(one.accuracy, abs=0.011)
            single[spec["candidate_id"]] = (one.multiclass_log_loss, many.multiclass_log_loss)
    by_one, by_many = (min(single, key=lambda k: single[k][i]) for i in (0, 1))
    assert single[by_one][0] == pytest.approx(single[by_many][0], rel=2e-4)


def test_fold_facts_are_those_of_the_training_rows(spark, noisy):
    from nightframe.operators import searching

    fold = {"train_subjects": [1, 3], "validation_subject": 0}
    fact = searching.fold_facts(noisy, FEATS, models.LABEL, [fold])[0]
    pdf = noisy.filter("subject_id in (1, 3)").toPandas()
    assert np.allclose(fact.mean, pdf[FEATS].mean()) and np.allclose(fact.scale[:2], pdf[FEATS[:2]].std(ddof=0)) and fact.scale[2] == 1.0
    counts = pdf["sleep_stage_encoded"].value_counts().sort_index()
    assert np.allclose(fact.counts, counts) and np.allclose(fact.class_weights, len(pdf) / (5 * counts))


def test_descent_finds_the_minimum_of_a_penalised_quadratic():
    from nightframe.operators.searching import Descent

    rng = np.random.default_rng(1)
    a = rng.normal(0, 1, (30, 8))
    h, b, l1 = a.T @ a / 30, rng.normal(0, 1, 8), np.array([1.0] * 6 + [0.0] * 2)
    run = Descent(8, l1, 500, 1e-13)
    while not run.done:
        x = run.trial
        run.observe(0.5 * x @ h @ x - b @ x, h @ x - b)
    z, most = np.zeros(8), np.linalg.eigvalsh(h)[-1]
    for _ in range(20000):  # plain proximal gradient
        z = z - (h @ z - b) / most
        z = np.sign(z) * np.maximum(np.abs(z) - l1 / most, 0)
    assert (z == 0).any() and np.abs(run.x - z).max() < 1e-4


def test_descent_with_kinks_comes_to_the_minimum_in_few_scans():
    """An elastic net over classes, where adding the same to all classes changes the penalty only."""
    from nightframe.operators.searching import Descent, _softmax

    rng = np.random.default_rng(1)
    n, k, width, l1, l2 = 800, 5, 3, 5e-4, 5e-4
    y = rng.integers(0, k, n)
    x = np.column_stack([y + rng.normal(0, 1.5, n), (y % 2) * 30 + rng.normal(100, 20, n), rng.normal(0, 1, n)])
    z = np.column_stack([(x - x.mean(axis=0)) / x.std(axis=0), np.ones(n)])
    free = np.tile(np.append(np.ones(width), 0.0), k)

    def smooth(w):
        p = _softmax(z @ w.reshape(k, -1).T)
        loss = -np.log(p[np.arange(n), y]).mean()
        p[np.arange(n), y] -= 1.0
        return loss + l2 / 2 * (w * free) @ (w * free), (p.T @ z).ravel() / n + l2 * w * free

    run, scans = Descent(len(free), l1 * free, 3000), 0
    while not run.done:
        run.observe(*smooth(run.trial))
        scans += 1
    w = ahead = np.zeros(len(free))
    t, most = 1.0, np.linalg.eigvalsh(z.T @ z / n)[-1] / 2 + l2
    for _ in range(8000):  # accelerated proximal gradient
        moved = ahead - smooth(ahead)[1] / most
        moved = np.sign(moved) * np.maximum(np.abs(moved) - l1 * free / most, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = moved + (t - 1) / after * (moved - w), moved, after
    assert run.value - (smooth(w)[0] + l1 * np.abs(w * free).sum()) < 1e-7 and scans < 80


def test_forest_trees_respect_their_bounds_and_sampling_is_bounded(spark, noisy):
    from nightframe.operators import forests, searching

    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, 3))
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] > 0.5)
    xb = forests.binned(x, forests.thresholds(x))
    times = rng.poisson(1.0, 400)
    feature, cut, left, share = tree = forests.grow(xb, y, np.ones(400), np.array([times, times[::-1]]), 5, 3, 10, 2, rng)
    assert np.allclose(share.sum(axis=1), 1) and (feature >= 0).sum() * 2 + 2 == len(feature) and (left[feature >= 0] > 0).all()

    def walk(node, rows, depth):
        assert depth <= 3 and times[rows].sum() >= 10
        if feature[node] >= 0:
            right = xb[rows, feature[node]] > cut[node]
            walk(left[node], rows[~right], depth + 1)
            walk(left[node] + 1, rows[right], depth + 1)
        else:
            mass = np.bincount(y[rows], times[rows], 5)
            assert np.allclose(share[node], mass / mass.sum(), atol=1e-6)

    walk(0, np.arange(400), 0)
    assert (forests.tree_shares(tree, xb).argmax(axis=1) == y).mean() > 0.6
    rows = searching.matrix_rows(noisy, FEATS, models.LABEL)
    one, two = forests.bounded_sample(rows, 50), forests.bounded_sample(rows.repartition(7), 50)
    assert len(one) == 50 and one["x"].tolist() == two["x"].tolist()


def test_search_with_forests_ends_and_saves(spark, noisy, tmp_path):
    summary = EV.inner_search(noisy, FEATS, models.FITTABLE, outer_folds=[1], trees=20, forest_rows=200).collect()
    assert len(summary) == 21 and {r.fold_count for r in summary} == {3} and sum(r.is_selected for r in summary) == 1
    fitted = models.fit_candidate(noisy, FEATS, "random_forest", {"max_depth": None, "min_samples_leaf": 4, "max_features": 0.5}, trees=30)
    assert models.save_and_verify(fitted, str(tmp_path / "forest"), noisy) == 0
    with pytest.raises(Exception, match="not finite"):
        models.score(fitted, noisy.withColumn("f1", F.lit(None).cast("double"))).collect()


def test_forests_walk_distinct_bins_once(monkeypatch):
    from nightframe.operators import forests

    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (300, 2))
    y = (x[:, 0] > 0).astype(int)
    xb = forests.binned(x, forests.thresholds(x))
    blocks = [(2, forests.grow(xb, y, np.ones(300), rng.poisson(1.0, (2, 300)), 5, 4, 5, 2, rng))]
    want, walked, plain = forests.forest_shares(blocks, xb, 5), [], forests.forest_shares
    monkeypatch.setattr(forests, "forest_shares", lambda b, rows, k: (walked.append(len(rows)), plain(b, rows, k))[1])
    known = forests.KnownShares(blocks, 2, 5)
    for part in (xb[:100], xb[50:], np.zeros((3, 2), np.uint8), xb[::-1]):
        assert np.array_equal(known.of(part), plain(blocks, part, 5))
    assert sum(walked) == len(np.unique(np.vstack([xb, np.zeros((1, 2), np.uint8)]), axis=0))
    few = forests.KnownShares(blocks, 2, 5, most=10)  # starts anew, same shares
    assert all(np.array_equal(few.of(xb[i : i + 30]), want[i : i + 30]) for i in range(0, 300, 30))


def test_folds_with_the_same_training_subjects_share_forests(spark, noisy, monkeypatch):
    from nightframe.operators import forests, searching

    folds = [r.asDict() for r in SP.nested_splits(SP.subject_list(noisy)).orderBy("split_id").collect()]
    specs = [{"model_name": "random_forest", "params": {"max_depth": 4, "min_samples_leaf": 4, "max_features": "sqrt"}}]
    rows = searching.matrix_rows(noisy, FEATS, models.LABEL)
    sample = forests.bounded_sample(rows, 200)
    facts = searching.fold_facts(noisy, FEATS, models.LABEL, folds, 5)
    learned, held, grown = [(f.train, f.class_weights) for f in facts], [f["validation_subject"] for f in folds], []
    plain = forests.grow_forests
    monkeypatch.setattr(forests, "grow_forests", lambda *a: (grown.append(1), plain(*a))[1])
    got = {}
    for cells in forests.forest_cells(rows, sample, learned, held, specs, [7], 5, 25, 1):
        got.update({(r.fold, r.y_true, r.y_pred): r for r in cells.groupBy("fold", "candidate", "y_true", "y_pred").agg(F.sum("n").alias("n"), F.sum("nll").alias("nll")).collect()})
    assert len(folds) == 12 and len(grown) == 6 and {r.candidate for r in got.values()} == {7}
    x = np.array(sample["x"].tolist(), float)
    cuts = forests.thresholds(x)
    every = rows.collect()
    for i in (0, 5, 11):  # row by row, forest by forest
        forest = plain(spark, sample, forests.binned(x, cuts), [(specs[0]["params"], *learned[i])], 5, 25, 1)[0]
        own = [r for r in every if r.subject == held[i]]
        want = np.zeros((5, 5, 6))
        searching.cell_sums(forests.forest_shares(forest, forests.binned(np.array([r.x for r in own]), cuts), 5), np.array([r.label for r in own]), 5, want)
        mine = {k[1:]: (r.n, r.nll) for k, r in got.items() if k[0] == i}
        assert set(mine) == {tuple(at) for at in np.argwhere(want[..., 0] > 0)}
        assert all(v[0] == want[k][0] and v[1] == pytest.approx(want[k][1]) for k, v in mine.items())


@pytest.fixture(scope="module")
def rare(spark):
    """Three subjects whose classes follow f1, and one row each of a class and value of its own among 20,001."""
    rows = [(s, f"R{s}", 1, i, i % 4, float(i % 4), float(i % 7)) for s in range(3) for i in range(20_000)]
    rows += [(s, f"R{s}", 1, 20_000, 4, 9.0, 3.0) for s in range(3)]
    df = spark.createDataFrame(rows, "subject_id int, recording_id string, night int, epoch_id int, sleep_stage_encoded int, f1 double, f2 double").repartition(3).cache()
    yield df
    df.unpersist()


FOREST = {"max_depth": 12, "min_samples_leaf": 1, "max_features": 1.0}


@pytest.mark.parametrize("most", [300_000, 3])
def test_forests_learn_from_every_row(spark, rare, monkeypatch, most):
    from nightframe.operators import forests

    monkeypatch.setattr(forests, "CELLS", most)  # 3: more distinct bins than a task may hold
    fitted = models.fit_candidate(rare, ["f1", "f2"], "random_forest", FOREST, trees=20)
    scored = models.score(fitted, rare).groupBy("f1", "y_true", "y_pred").count().collect()
    assert {(r.f1, r.y_true, r.y_pred, r["count"]) for r in scored} == {*[(float(c), c, c, 15_000) for c in range(4)], (9.0, 4, 4, 3)}


def test_stored_forest_scores_more_bins_than_a_task_may_hold(spark, noisy, monkeypatch):
    from nightframe.operators import forests

    fitted = models.fit_candidate(noisy, FEATS, "random_forest", {"max_depth": 6, "min_samples_leaf": 4, "max_features": 0.5}, trees=30)
    want = {(r.subject_id, r.epoch_id): (r.p, r.y_pred) for r in models.score(fitted, noisy).collect()}
    monkeypatch.setattr(forests, "CELLS", 50)
    monkeypatch.setattr(forests, "CHUNK", 20)
    got = {(r.subject_id, r.epoch_id): (r.p, r.y_pred) for r in models.score(fitted, noisy).collect()}
    assert got == want and len(got) == noisy.count()


@pytest.mark.parametrize("seed", [1, 2])
def test_thresholds_are_the_quantiles_of_all_rows(spark, seed):
    from nightframe.operators import forests, searching

    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(0, 1, 3001 + seed), rng.integers(0, 5, 3001 + seed), np.full(3001 + seed, 7.0)])
    rows = spark.createDataFrame([(0, 0, r) for r in x.tolist()], "subject bigint, label int, x array<double>").repartition(5)
    got = forests.exact_thresholds(searching.distinct_rows(rows), 3)
    assert all(np.allclose(g, w, rtol=1e-14, atol=0) for g, w in zip(got, forests.thresholds(x), strict=True))


def test_trees_over_counted_bins_take_the_best_cuts():
    from nightframe.operators import forests

    rng = np.random.default_rng(3)
    xb = np.unique(rng.integers(0, 6, (300, 3)).astype(np.uint8), axis=0)
    draws = rng.poisson(2.0, (2, len(xb), 5))
    weights = np.array([1.0, 2.0, 0.5, 1.0, 3.0])
    feature, cut, left, share = tree = forests.grow_cells(xb, draws, weights, 4, 10, 3, rng)
    drop = lambda m: (m**2).sum() / max(m.sum(), 1e-300)

    def walk(node, rows, times, depth):
        mass = times[rows].sum(axis=0) * weights
        assert depth <= 4 and times[rows].sum() >= 10 and np.allclose(share[node], mass / mass.sum(), atol=1e-6)
        gains = {}
        for f in range(3):
            for c in range(5):
                low = times[rows[xb[rows, f] <= c]].sum(axis=0)
                if low.sum() >= 10 and times[rows].sum() - low.sum() >= 10:
                    gains[f, c] = drop(low * weights) + drop(mass - low * weights) - drop(mass)
        if feature[node] < 0:
            assert depth == 4 or max(gains.values(), default=0) < 1e-6 or times[rows].sum() < 20
            return
        assert gains[feature[node], cut[node]] == pytest.approx(max(gains.values()))
        right = xb[rows, feature[node]] > cut[node]
        walk(left[node], rows[~right], times, depth + 1)
        walk(left[node] + 1, rows[right], times, depth + 1)

    walk(0, np.arange(len(xb)), draws[0], 0)
    walk(1, np.arange(len(xb)), draws[1], 0)
    top, deep = forests.shares_by_depth(tree, xb, 0, [2, 30])
    assert np.array_equal(deep, forests.tree_shares(tree, xb, 0)) and not np.array_equal(top, deep)


@pytest.mark.parametrize("most", [300_000, 3])
def test_searches_learn_from_every_row(spark, rare, monkeypatch, most):
    """A validation row of a class that each training side holds two rows of."""
    from nightframe.operators import forests

    monkeypatch.setattr(forests, "CELLS", most)
    folds = [{"outer_fold": 0, "inner_fold": s, "train_subjects": [t for t in range(3) if t != s], "validation_subject": s} for s in range(3 if most > 3 else 1)]
    specs = [{"model_name": "random_forest", "candidate_id": f"d{d}", "params": {**FOREST, "max_depth": d}} for d in (None, 8, 1)]
    got = {(r.inner_fold, r.candidate_id): r for r in EV.fold_metrics(rare, folds, specs, ["f1", "f2"], trees=10).collect()}
    assert len(got) == 3 * len(folds) and {r.row_count for r in got.values()} == {20_001}
    assert all(r.accuracy == 1.0 and r.balanced_accuracy == 1.0 for (_, c), r in got.items() if c != "d1")
    assert all(got[i, "d1"].multiclass_log_loss > 10 * got[i, "dNone"].multiclass_log_loss for i, _ in got)


def test_searched_forests_equal_fitted_ones(spark, noisy):
    """The trees of a search, less deep ones from deeper ones, are those of a fit on the same rows; equal rows scan as one."""
    twice = noisy.unionByName(noisy.filter("epoch_id % 3 = 0"))
    fold = {"outer_fold": 1, "inner_fold": 1, "train_subjects": [0, 2, 3], "validation_subject": 1}
    specs = [{"model_name": "random_forest", "candidate_id": f"d{d}", "params": {"max_depth": d, "min_samples_leaf": 4, "max_features": 1.0}} for d in (None, 3)]
    specs += EV.candidate_specs(["logistic_regression"], 1)
    got = {r.candidate_id: r for r in EV.fold_metrics(twice, [fold], specs, FEATS, trees=40).collect()}
    train, held = EV.pick(twice, fold["train_subjects"]), EV.pick(twice, [1])
    for spec in specs:
        one = M.classification_metrics(models.score(models.fit_candidate(train, FEATS, spec["model_name"], spec["params"], trees=40), held)).first()
        many = got[spec["candidate_id"]]
        assert many.row_count == one.row_count == held.count()
        # thresholds of a search come from all its subjects, those of a fit from the training ones
        assert many.multiclass_log_loss == pytest.approx(one.multiclass_log_loss, rel=0.05) and many.accuracy == pytest.approx(one.accuracy, abs=0.05)
    assert got["d3"].multiclass_log_loss != got["dNone"].multiclass_log_loss


def test_final_refit_selects_and_fits_forests_on_every_row(spark, rare, tmp_path):
    fitted, summary = EV.final_refit(rare, ["f1", "f2"], ["random_forest"], 1, trees=5)
    assert summary.filter("is_selected").first().mean_accuracy == 1.0
    last = rare.filter("f1 = 9")
    assert [r.y_pred for r in models.score(fitted, last).collect()] == [4, 4, 4]
    assert models.save_and_verify(fitted, str(tmp_path / "refit"), last) == 0


def test_leave_one_out_lists_take_little_disk(spark, tmp_path):
    """Rows of 114 kB that differ by one subject: on disk they are hardly more than the first of them."""
    before = spark.conf.get("spark.sql.parquet.compression.codec")
    users = spark.range(6000).select((F.col("id") + 10**18).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.col("id").alias("event_id"), F.current_timestamp().alias("ts"))
    users.write.parquet(str(tmp_path / "events.parquet"))
    try:
        out = entry.queries()["sp06_leave_one_subject_out"](spark, str(tmp_path)).filter("fold <= 40").coalesce(1)
        out.write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.parquet.compression.codec", before)
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 500_000
    back = spark.read.parquet(str(tmp_path / "out")).select("fold", F.size(F.split("train_subjects", ",")).alias("n")).collect()
    assert sorted((r.fold, r.n) for r in back) == [(i, 5999) for i in range(1, 41)]
