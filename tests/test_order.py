import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from nightframe.operators import ranks
from nightframe.operators.quantiles import exact_quantiles, wide_quantile
from nightframe.operators.skew import following_value, globally_numbered, lookup_join, numbered, zero_filled_counts
from nightframe.operators.summaries import box_statistics, constant_features, grouped_summary, missing_cells, outlier_summary


def hot_table(rows=6000, seed=3):
    """One key holds most rows, one value repeats a lot."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(rows) < 0.7, "hot", np.char.add("k", rng.integers(0, 40, rows).astype(str)))
    value = np.where(rng.random(rows) < 0.35, 5.0, rng.normal(0, 100, rows))
    return pd.DataFrame({"key": key, "value": value, "other": rng.exponential(2, rows), "i": np.arange(rows)})


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
@pytest.mark.parametrize("bounded", [True, False])
def test_quantiles_equal_pandas_whatever_the_sketch(spark, accuracy, bounded):
    pdf = hot_table()
    df = spark.createDataFrame(pdf).repartition(5)
    probs = (0.0, 0.25, 0.5, 0.75, 1.0)
    got = exact_quantiles(df, ["key"], ["value", "other"], probs, bounded, accuracy).toPandas().set_index(["key", "feature"])
    for column in ("value", "other"):
        want = pdf.groupby("key")[column].quantile(list(probs)).unstack()
        for key, row in want.iterrows():
            assert np.allclose(got.loc[(key, column)].astype(float), row.to_numpy(), rtol=0, atol=1e-12)
    assert len(got) == 2 * pdf["key"].nunique()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([0.0, 1.0, -3.5]), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_quantiles_of_any_list(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    row = exact_quantiles(df, [], ["v"], (0.1, 0.5, 0.9), True, accuracy=20).first()
    want = np.quantile(values, [0.1, 0.5, 0.9])
    assert np.allclose([row.q0, row.q1, row.q2], want, rtol=1e-12, atol=1e-9)


@pytest.mark.parametrize("limit", [1, 3, 64])
def test_quantiles_are_narrowed_to_few_values(spark, limit):
    """A sketch this coarse misses ranks and leaves wide brackets: regions are opened and cut again and again."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": np.where(rng.random(9000) < 0.8, None, "b"), "v": np.where(rng.random(9000) < 0.2, 7.0, rng.normal(0, 9, 9000))})
    df = spark.createDataFrame(pdf, "k string, v double").repartition(4)
    probs = (0.0, 0.1, 0.5, 0.77, 1.0)
    got = {r.k: [r[f"q{i}"] for i in range(5)] for r in exact_quantiles(df, ["k"], ["v"], probs, True, accuracy=5, limit=limit).collect()}
    for key, values in ((None, pdf[pdf["k"].isna()]["v"]), ("b", pdf[pdf["k"] == "b"]["v"])):
        assert np.allclose(got[key] if key else got[None], np.quantile(values, probs), rtol=0, atol=1e-12)


def test_a_missed_rank_opens_its_region(spark):
    from nightframe.operators.quantiles import narrowed

    values = np.random.default_rng(5).permutation(1000).astype(float).tolist()
    kept = lambda v: 700 <= v < 800  # the median is not among them
    rows = {}
    for v in values:
        key = (0 if v < 700 else 1 if v < 800 else 2, v if kept(v) else None)
        rows[key] = rows.get(key, 0) + 1
    g = F.struct(F.lit("f").alias("feature")).alias("_g")
    cells = spark.createDataFrame([(r, v, m, 1000) for (r, v), m in rows.items()], "_region bigint, _v double, _m bigint, _n bigint").select(g, "*").checkpoint()
    opened = []

    def reopen(missed):
        opened.extend(r["_region"] for r in missed.collect())
        return spark.createDataFrame([(0, float(v), 1, 1000) for v in values if v < 700], "_region bigint, _v double, _m bigint, _n bigint").select(g, "*")

    left = narrowed(cells, (0.5,), 50, [], reopen).collect()
    apart = sorted(r["_v"] for r in left if r["_v"] is not None)
    assert opened == [0] and len(apart) <= 100 and 499.0 in apart and 500.0 in apart and sum(r["_m"] for r in left) == 1000


def test_quantiles_skip_null_and_nan(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0)], "k string, v double")
    q = exact_quantiles(df, ["k"], ["v"], (0.5,))
    assert q.first().q0 == 2.0
    assert wide_quantile(q, ["k"], ["v"]).first().median_v == 2.0


def test_summary_outliers_and_boxes(spark):
    pdf = hot_table()
    df = spark.createDataFrame(pdf)
    s = grouped_summary(df, "key", ["value"]).toPandas().set_index("key")
    want = pdf.groupby("key")["value"].agg(["count", "mean", "min", "max"])
    assert (s["count"].sort_index() == want["count"].sort_index()).all()
    assert np.allclose(s["mean"].sort_index(), want["mean"].sort_index())
    o = outlier_summary(df, ["value", "other"]).toPandas().set_index("feature")
    q1, q3 = pdf["other"].quantile([0.25, 0.75])
    outside = ((pdf["other"] < q1 - 1.5 * (q3 - q1)) | (pdf["other"] > q3 + 1.5 * (q3 - q1))).sum()
    assert o.loc["other", "outlier_count"] == outside
    b = box_statistics(df, "key", ["other"]).filter("key = 'hot'").first()
    hot = pdf[pdf["key"] == "hot"]["other"]
    assert b.whisker_high == hot[hot <= hot.quantile(0.75) + 1.5 * (hot.quantile(0.75) - hot.quantile(0.25))].max()


def test_constant_and_missing(spark):
    df = spark.createDataFrame([(1.0, None, 2.0, None), (1.0, 4.0, 3.0, None)], "a double, b double, c double, d double")
    got = {r.feature: r.is_constant for r in constant_features(df, ["a", "b", "c", "d"]).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True}
    assert missing_cells(df).first().missing_cells == 3


def test_numbering_matches_a_plain_window(spark):
    pdf = hot_table(2000)
    pdf["t"] = np.random.default_rng(0).integers(0, 5000, len(pdf)).astype(float)
    df = spark.createDataFrame(pdf).repartition(7)
    got = numbered(df, ["key"], ["t", "i"], F.floor(F.col("t") / 60), "n").toPandas()
    ordered = got.sort_values(["key", "t", "i"])
    assert (ordered["n"].to_numpy() == ordered.groupby("key").cumcount().to_numpy()).all() and len(got) == len(pdf)


@pytest.mark.parametrize("fan", [2, 64])
def test_prefix_totals_go_up_and_down_the_tree(spark, fan):
    from nightframe.operators.skew import prefix_totals

    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"k": rng.permutation(300), "w": rng.integers(0, 9, 300)})
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = prefix_totals(spark.createDataFrame(pdf).repartition(3), ["k"], "w", "before", fan=fan)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        got = df.toPandas().sort_values("k")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    want = pdf.sort_values("k")["w"].cumsum() - pdf.sort_values("k")["w"]
    assert got["before"].tolist() == want.tolist() and set(got.columns) == {"k", "w", "before"}
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all(("_up#" in w or "_range#" in w) for w in windows)


def test_global_positions_are_dense_and_ordered(spark):
    pdf = hot_table(1500)
    pdf["e"] = pdf.groupby("key").cumcount()
    df = spark.createDataFrame(pdf).repartition(6)
    got = globally_numbered(df, ["key", "e"], "key", F.floor(F.col("e") / 16), "pos").toPandas().sort_values(["key", "e"])
    assert (got["pos"].to_numpy() == np.arange(len(pdf))).all()


def test_following_value_crosses_empty_buckets(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 2), ("a", 950.0, 3), ("b", 5.0, 4)], "k string, t double, i int")
    got = {r.i: r.nxt for r in following_value(df, ["k"], ["t", "i"], F.floor(F.col("t") / 10), "t", "nxt").collect()}
    assert got == {1: 2.0, 2: 950.0, 3: None, 4: None}


@pytest.mark.parametrize("limit", [0, 100_000])
def test_lookup_join_salted_and_broadcast_agree(spark, limit):
    pdf = hot_table(1000)
    small = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, w int")
    df = spark.createDataFrame(pdf)
    got = lookup_join(df, small, ["key"], broadcast_rows=limit).groupBy("w").count().toPandas().set_index("w")["count"]
    assert got[1] == (pdf["key"] == "hot").sum() and got.get(2, 0) == (pdf["key"] == "k1").sum()


def test_zero_filled_counts(spark):
    df = spark.createDataFrame([("N1",), ("N1",), ("REM",)], "stage string")
    got = [(r.stage, r["count"]) for r in zero_filled_counts(df, "stage", ["Wake", "N1", "REM"]).collect()]
    assert got == [("Wake", 0), ("N1", 2), ("REM", 1)]


def test_average_ranks_and_spearman_match_pandas(spark):
    pdf = hot_table(3000)[["value", "other"]]
    pdf["third"] = -pdf["value"] ** 3 + pdf["other"]
    df = spark.createDataFrame(pdf.reset_index(names="row"))
    long = df.select(F.lit("value").alias("feature"), "value")
    got = ranks.value_ranks(long, ["feature"]).toPandas().set_index("value")["average_rank"]
    want = pdf["value"].rank()
    assert np.allclose(got.loc[pdf["value"]].to_numpy(), want.to_numpy())
    pairs = ranks.spearman_pairs(df, ["value", "other", "third"], ["row"]).toPandas()
    corr = pdf.rank().corr()
    for r in pairs.itertuples():
        assert r.spearman_correlation == pytest.approx(corr.loc[r.feature_left, r.feature_right], abs=1e-12)


def test_rank_tasks_follow_the_rows(spark, monkeypatch):
    pdf = hot_table(3000)[["value", "other"]]
    df = spark.createDataFrame(pdf.reset_index(names="row"))
    assert ranks.row_parts(spark, 10) == 4 and ranks.row_parts(spark, 100 * ranks.TASK_ROWS) == 100
    monkeypatch.setattr(ranks, "TASK_ROWS", 300)
    long = df.select(F.lit("value").alias("feature"), "value")
    got = ranks.value_ranks(long, ["feature"])
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert np.allclose(got.toPandas().set_index("value")["average_rank"].loc[pdf["value"]].to_numpy(), pdf["value"].rank().to_numpy())
    pair = ranks.spearman_pairs(df, ["value", "other"], ["row"]).first()
    assert pair.spearman_correlation == pytest.approx(pdf.rank().corr().iloc[0, 1], abs=1e-12)
