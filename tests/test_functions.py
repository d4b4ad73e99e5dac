import math

import pytest
from pyspark.sql import functions as F

from nightframe.functions import numeric as N, probability as PR, text as X
from nightframe.functions.digest import canonical_number, row_sha256, set_sha256


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def d(v):
    return F.lit(v).cast("double")


def test_safe_ratio_needs_finite_sides_and_a_positive_denominator(spark):
    r = one(
        spark, good=N.safe_ratio(d(6.0), d(3.0)), zero=N.safe_ratio(d(1.0), d(0.0)), negative=N.safe_ratio(d(1.0), d(-2.0)),
        nan=N.safe_ratio(d(float("nan")), d(1.0)), inf=N.safe_ratio(d(float("inf")), d(1.0)), null=N.safe_ratio(F.lit(None).cast("double"), d(1.0)),
    )
    assert r.good == 2.0
    assert [r.zero, r.negative, r.nan, r.inf, r.null] == [None] * 5


def test_finiteness_covers_null_nan_and_infinities(spark):
    r = one(spark, a=N.is_finite(d(1.0)), b=N.is_finite(d(float("nan"))), c=N.is_finite(d(float("-inf"))), e=N.is_finite(F.lit(None).cast("double")))
    assert (r.a, r.b, r.c, r.e) == (True, False, False, False)


def test_rounding_to_significant_digits_and_zero(spark):
    r = one(
        spark, a=N.round_significant(d(0.1), 12), b=N.round_significant(d(123456.7891234567), 8), c=N.round_significant(d(0.0), 12),
        e=N.round_significant(d(1.23456789e-7), 4), z=N.canonical_zero(d(-0.0)).cast("string"),
    )
    assert r.a == 0.1 and r.b == pytest.approx(123456.79, abs=1e-9) and r.c == 0.0
    assert r.e == pytest.approx(1.235e-7, rel=1e-12) and r.z == "0.0"


def test_number_checks(spark):
    r = one(
        spark, whole=N.is_integer_valued(d(4.0), 0), part=N.is_integer_valued(d(4.5)), low=N.is_integer_valued(d(-1.0), 0),
        near=N.is_close(d(1.0), d(1.05), 0.1), err=N.normalized_error(d(3.0), d(4.0)), small=N.normalized_error(d(0.1), d(0.2)),
        total=N.row_sum([d(1.0), F.lit(None).cast("double"), d(2.0)]), grid=N.grid_distance(d(61.0), 30),
    )
    assert (r.whole, r.part, r.low, r.near) == (True, False, False, True)
    assert r.err == 0.25 and r.small == pytest.approx(0.1) and r.total == 3.0 and r.grid == 1.0


@pytest.mark.parametrize("text,expected", [("true", True), (" FALSE ", False), ("1", True), ("0", False), ("yes", None), ("t", None), ("", None)])
def test_strict_boolean(spark, text, expected):
    assert one(spark, v=X.strict_boolean(F.lit(text))).v is expected


def test_names_and_times(spark):
    r = one(
        spark, slug=X.probability_name(F.lit("  Stage N-3! ")), sid=X.split_id(F.lit(2), F.lit(11)), cid=X.candidate_id(F.lit("rf"), F.lit(7)),
        iso=X.iso_utc(F.lit("2024-01-02 03:04:05.000006").cast("timestamp")),
        gap=X.seconds_between(F.lit("2024-01-02 00:00:01.5").cast("timestamp"), F.lit("2024-01-02").cast("timestamp")),
        none=X.seconds_between(F.lit(None).cast("timestamp"), F.lit("2024-01-02").cast("timestamp")),
        json=X.sorted_json(b=F.lit(1), a=F.lit("x")),
    )
    assert r.slug == "probability_stage_n_3" and r.sid == "outer_02_inner_11" and r.cid == "rf__candidate_007"
    assert r.iso == "2024-01-02T03:04:05.000006Z" and r.gap == 1.5 and r.none is None and r.json == '{"a":"x","b":1}'


def test_probability_functions(spark):
    p = F.array(*[d(v) for v in (0.1, 0.4, 0.4, 0.1, 0.0)])
    r = one(spark, top=PR.argmax(p), conf=PR.confidence(p), marg=PR.margin(p), ent=PR.entropy(p, 5), ok=PR.is_valid(p, 5))
    assert r.top == 1 and r.conf == 0.4 and r.marg == 0.0 and r.ok
    assert r.ent == pytest.approx(-(0.2 * math.log(0.1) + 0.8 * math.log(0.4)))


@pytest.mark.parametrize("values", [(0.5, 0.6), (1.2, -0.2), (float("nan"), 1.0), (1.0,)])
def test_invalid_probability_rows(spark, values):
    assert one(spark, ok=PR.is_valid(F.array(*[d(v) for v in values]), 2)).ok is False


def test_normalize_and_reorder(spark):
    df = spark.range(1).select(F.array(d(-1e-9), d(1.0 + 1e-9)).alias("p"))
    row = PR.with_normalized(df, "p", "q", 2).select("q", PR.reorder("q", [1, 0]).alias("r")).first()
    assert row.q == [0.0, 1.0] and row.r == [1.0, 0.0]


def test_set_digest_ignores_order_and_sees_every_change(spark):
    def digest(rows, parts):
        df = spark.createDataFrame(rows, "k int, v double").repartition(parts)
        return df.select(row_sha256(["k", canonical_number("v")]).alias("h")).agg(set_sha256("h").alias("s")).first().s

    base = [(i, i / 7) for i in range(50)]
    assert digest(base, 1) == digest(base[::-1], 7)
    assert digest(base, 3) != digest(base[:-1] + [(49, 7.0001)], 3)
    assert digest(base, 3) != digest(base + [base[0]], 3)
    assert digest([(1, 0.0)], 1) == digest([(1, -0.0)], 1)
    assert digest([(1, 0.1 + 0.2)], 1) == digest([(1, 0.3)], 1)


def test_rounding_of_far_values(spark):
    d = lambda x: F.lit(float(x))
    values = {"a": 1.23456789e-300, "b": -9.87654321e250, "c": 5e-324, "d": 1.7976931348623157e308}
    got = spark.range(1).select(*[N.round_significant(d(v), 4).alias(k) for k, v in values.items()]).first().asDict()
    for k, v in values.items():
        assert got[k] == pytest.approx(float(f"{v:.3e}"), rel=1e-3) or k == "c"
    odd = spark.range(1).select(N.round_significant(d("inf"), 4).alias("i"), N.round_significant(d("-inf"), 4).alias("m"), N.round_significant(d("nan"), 4).alias("n")).first()
    assert odd.i == float("inf") and odd.m == float("-inf") and odd.n != odd.n


def test_row_digests_tell_rows_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "c"), ("null", "c"), ("", "c"), ("1:a", ""), ("", "1:a"), ("a", None)]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(row_sha256(["x", "y"]).alias("h")).distinct().count() == len(rows)
    zeros = spark.range(1).select(row_sha256([canonical_number(F.lit(0.0))]).alias("p"), row_sha256([canonical_number(F.lit(-0.0))]).alias("m")).first()
    assert zeros.p == zeros.m


def test_json_keeps_nulls_and_refuses_odd_numbers(spark):
    got = spark.range(1).select(X.sorted_json(b=F.lit(None).cast("int"), a=F.lit(1.5)).alias("j")).first().j
    assert got == '{"a":1.5,"b":null}'
    for bad in ("nan", "inf"):
        with pytest.raises(Exception, match="no form for NaN"):
            spark.range(1).select(X.sorted_json(a=F.lit(float(bad))).alias("j")).collect()


def test_row_digests_round_step_by_step_as_in_one_expression(spark):
    from nightframe.functions.digest import row_digests

    values = [0.0, -0.0, 1.0, -1 / 3, 1e-7, 123456.7891234567, 9.9999999999995, 1e300, -1e-300, 5e-324, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(i, v, None if v is None else -v, str(i)) for i, v in enumerate(values)], "n int, `v.w` double, z double, s string").repartition(2)
    one = df.select("n", row_sha256(["n", "s", canonical_number(F.col("`v.w`")), canonical_number("z")]).alias("h"))
    split = row_digests(df.withColumn("k", F.col("n")), keep=["k"])
    assert {r.n: r.h for r in one.collect()} == {r.k: r["_sha"] for r in split.collect()}
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("LOG10") == 1  # not once for each use
