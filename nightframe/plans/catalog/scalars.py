"""Scalar functions, digests and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightframe import proxies as P
from nightframe.functions import numeric as N, text as X
from nightframe.functions.digest import row_sha256, set_sha256
from nightframe.operators import metrics as M
from nightframe.plans.catalog.evaluation import metric_sql
from nightframe.plans.oracle import FT, PR as PRV, with_views
from nightframe.plans.registry import query
from nightframe.sources.files import name_parts
from nightframe.session import scratch_path
from nightframe.sources import tables


@query("st01_trim_and_case", "SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_mktsegment) AS low, trim('  ' || c_name || ' ') AS trimmed FROM customer")
def _(spark, sf):
    return P.table(spark, sf, "customer").select(
        "c_custkey", F.upper("c_mktsegment").alias("up"), F.lower("c_mktsegment").alias("low"),
        F.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("trimmed"),
    )


@query("st02_st03_recording_names", """SELECT filename, substr(filename, 1, 6) AS recording_id, substr(filename, 4, 2) AS subject_code, CAST(substr(filename, 4, 2) AS BIGINT) AS subject_id,
  CAST(substr(filename, 6, 1) AS BIGINT) AS night, 'psg' AS file_type FROM (SELECT 'SC4' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || CAST(1 + doc_id % 2 AS VARCHAR) || 'E0-PSG.edf' AS filename FROM documents)""")
def _(spark, sf):
    docs = P.table(spark, sf, "documents")
    name = F.concat(
        F.lit("SC4"), F.lpad(F.pmod("doc_id", F.lit(100)).cast("string"), 2, "0"),
        (1 + F.pmod("doc_id", F.lit(2))).cast("string"), F.lit("E0-PSG.edf"),
    )
    other = docs.select(F.concat(F.lit("notes-"), "lang").alias("filename"))
    return name_parts(docs.select(name.alias("filename")).unionByName(other))


@query("st05_url_parts", r"""SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') AS path,
  list_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/'), -1) AS base, url || '/' || 'PSG.edf' AS joined FROM pages""")
def _(spark, sf):
    bare = F.regexp_replace("url", r"[?#].*$", "")
    return P.table(spark, sf, "pages").select(
        "page_id", F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "").alias("path"),
        F.substring_index(bare, "/", -1).alias("base"), F.concat_ws("/", "url", F.lit("PSG.edf")).alias("joined"),
    )


@query("st06_prefix_and_contains", "SELECT p_partkey, starts_with(p_type, 'STANDARD') AS has_prefix, contains(p_name, 'a') AS has_part FROM part")
def _(spark, sf):
    return P.table(spark, sf, "part").select(
        "p_partkey", F.startswith("p_type", F.lit("STANDARD")).alias("has_prefix"), F.contains("p_name", F.lit("a")).alias("has_part")
    )


@query("st07_strict_boolean", """SELECT doc_id, quality = 1 AS quality, toxic = 1 AS toxic, CAST(NULL AS BOOLEAN) IS NULL AS word_is_null FROM labels""")
def _(spark, sf):
    return P.table(spark, sf, "labels").select(
        "doc_id", X.strict_boolean("quality").alias("quality"),
        X.strict_boolean(F.when(F.col("toxic") == 1, " TRUE ").otherwise("False")).alias("toxic"),
        X.strict_boolean(F.concat(F.lit("yes"), F.col("toxic").cast("string"))).isNull().alias("word_is_null"),
    )


@query("st08_column_safe_names", "SELECT p_partkey, 'probability_' || regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM part")
def _(spark, sf):
    return P.table(spark, sf, "part").select("p_partkey", X.probability_name("p_brand").alias("name"))


@query("st10_st11_formatted_ids", """SELECT l_orderkey, any_value(printf('outer_%02d_inner_%02d', 1 + l_orderkey % 4, 1 + l_orderkey % 3)) AS split_id, any_value(printf('m__candidate_%03d', l_orderkey % 29)) AS candidate_id,
  string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS line_list FROM lineitem GROUP BY 1""")
def _(spark, sf):
    li = P.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    lists = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("lines"))
    return lists.select(
        "l_orderkey", X.split_id(1 + F.pmod("l_orderkey", F.lit(4)), 1 + F.pmod("l_orderkey", F.lit(3))).alias("split_id"),
        X.candidate_id(F.lit("m"), F.pmod("l_orderkey", F.lit(29))).alias("candidate_id"), X.comma_join("lines").alias("line_list"),
    )


@query("st12_digest_shape", "SELECT doc_id, regexp_full_match(sha256(text), '[0-9a-f]{64}') AS digest_ok, regexp_full_match(lang, '[0-9a-f]{64}') AS lang_ok FROM documents")
def _(spark, sf):
    return P.table(spark, sf, "documents").select("doc_id", X.is_sha256(F.sha2("text", 256)).alias("digest_ok"), X.is_sha256("lang").alias("lang_ok"))


@query("dt01_iso_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso FROM events")
def _(spark, sf):
    return P.table(spark, sf, "events").select("event_id", X.iso_utc("ts").alias("iso"))


@query("dt02_time_difference", """SELECT o_orderpriority, count(*) AS lines, round(avg(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6, 3) AS mean_seconds,
  round(max(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6, 3) AS max_seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def _(spark, sf):
    li = P.table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate")
    o = P.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    gap = X.seconds_between("l_shipdate", "o_orderdate")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.avg(gap), 3).alias("mean_seconds"), F.round(F.max(gap), 3).alias("max_seconds")
    )


@query("ma01_to_ma04_ratios", with_views(FT, select="""SELECT sleep_stage, round(sum(ln(1 + signal_energy)), 4) AS log_sum, round(sum(delta_power / (theta_power + 1e-8)), 6) AS epsilon_sum,
  round(sum(CASE WHEN beta_power > 0 THEN alpha_power / beta_power END), 6) AS safe_sum, count(*) FILTER (WHERE beta_power <= 0) AS undefined,
  round(sum(delta_power + theta_power + alpha_power + beta_power), 3) AS row_sum FROM ft GROUP BY 1"""))
def _(spark, sf):
    safe = N.safe_ratio("alpha_power", "beta_power")
    return P.four_powers(spark, sf).groupBy("sleep_stage").agg(
        F.round(F.sum(F.log1p("signal_energy")), 4).alias("log_sum"),
        F.round(F.sum(N.epsilon_ratio("delta_power", "theta_power")), 6).alias("epsilon_sum"),
        F.round(F.sum(safe), 6).alias("safe_sum"), F.count_if(safe.isNull()).alias("undefined"),
        F.round(F.sum(N.row_sum(["delta_power", "theta_power", "alpha_power", "beta_power"])), 3).alias("row_sum"),
    )


@query("ma05_to_ma10_number_tools", """SELECT c_custkey, abs(c_acctbal) AS absolute, round(sqrt(abs(c_acctbal)), 6) AS root, round(ln(abs(c_acctbal) + 1), 6) AS natural, round(log2(abs(c_acctbal) + 1), 6) AS binary_log,
  floor(c_acctbal)::BIGINT AS low, round_even(c_acctbal / 2, 0)::BIGINT AS half_even, least(5000.0, greatest(0.0, c_acctbal)) AS clamped, abs(c_acctbal - round(c_acctbal)) <= 0.25 AS near_whole,
  round(abs(c_acctbal - 100) / greatest(abs(c_acctbal), 100, 1), 9) AS error, c_acctbal = round_even(c_acctbal, 0) AND c_acctbal >= 0 AS whole FROM customer""")
def _(spark, sf):
    a = F.col("c_acctbal")
    return P.table(spark, sf, "customer").select(
        "c_custkey", F.abs(a).alias("absolute"), F.round(F.sqrt(F.abs(a)), 6).alias("root"), F.round(F.ln(F.abs(a) + 1), 6).alias("natural"),
        F.round(F.log2(F.abs(a) + 1), 6).alias("binary_log"), F.floor(a).cast("bigint").alias("low"), F.bround(a / 2).cast("bigint").alias("half_even"),
        N.canonical_zero(N.clamp(a, 0.0, 5000.0)).alias("clamped"), N.is_close(a, F.round(a), 0.25).alias("near_whole"),
        F.round(N.normalized_error(a, F.lit(100.0)), 9).alias("error"), N.is_integer_valued(a, 0).alias("whole"),
    )


@query("js01_sorted_json", """SELECT o_orderkey, '{"orderkey":' || CAST(o_orderkey AS VARCHAR) || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}' AS json FROM orders""")
def _(spark, sf):
    return P.table(spark, sf, "orders").select(
        "o_orderkey", X.sorted_json(status=F.col("o_orderstatus"), orderkey=F.col("o_orderkey"), priority=F.col("o_orderpriority")).alias("json")
    )


@query("js02_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '[' || CAST(event_id AS VARCHAR) || ',' || CAST(user_id AS VARCHAR) || ']' AS pair_json FROM events")
def _(spark, sf):
    return P.table(spark, sf, "events").select(
        "event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.array("event_id", "user_id")).alias("pair_json")
    )


def _field(text: str) -> str:
    return f"CAST(length({text}) AS VARCHAR) || ':' || {text}"


_SHA = "sha256(" + " || ".join(_field(f"CAST({c} AS VARCHAR)") for c in (
    "event_id", "y_true", "y_pred", *[f"CAST(round_even(p[{i + 1}] * 1e12::DOUBLE, 0) AS BIGINT)" for i in range(5)])) + ")"
_SET = "sha256(concat_ws('|', CAST(count(*) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR)))"


def prediction_rows(spark, sf):
    whole = [F.bround(F.col("p")[i] * 1e12).cast("bigint") for i in range(5)]
    return P.scored(spark, sf).select("outer_fold", row_sha256(["event_id", "y_true", "y_pred", *whole]).alias("h"))


@query("ha01_ha02_row_set_digest", with_views(PRV, f"hh AS (SELECT outer_fold, {_SHA} AS h FROM pr)", select=f"SELECT outer_fold, count(*) AS rows, {_SET} AS digest FROM hh GROUP BY 1"))
def _(spark, sf):
    return prediction_rows(spark, sf).groupBy("outer_fold").agg(F.count(F.lit(1)).alias("rows"), set_sha256("h").alias("digest"))


@query("ha03_run_fingerprint", with_views(PRV, f"hh AS (SELECT outer_fold, {_SHA} AS h FROM pr)", f"dg AS (SELECT outer_fold, count(*) AS n, {_SET} AS digest FROM hh GROUP BY 1)",
  select="""SELECT outer_fold, sha256('{"model_name":"logistic_regression","outer_fold":' || CAST(outer_fold AS VARCHAR) || ',"prediction_row_count":' || CAST(n AS VARCHAR) || ',"prediction_sha256":"' || digest || '"}') AS fingerprint FROM dg"""))
def _(spark, sf):
    d = prediction_rows(spark, sf).groupBy("outer_fold").agg(F.count(F.lit(1)).alias("n"), set_sha256("h").alias("digest"))
    text = X.sorted_json(
        model_name=F.lit("logistic_regression"), outer_fold=F.col("outer_fold"), prediction_row_count=F.col("n"), prediction_sha256=F.col("digest")
    )
    return d.select("outer_fold", F.sha2(text, 256).alias("fingerprint"))


@query("snk03_metrics_json", with_views(PRV, metric_sql("outer_fold"), select="""SELECT outer_fold, '{"outer_fold":' || CAST(outer_fold AS VARCHAR) || ',"row_count":' || CAST(row_count AS VARCHAR) || ',"wrong":' || CAST(row_count - CAST(round(accuracy * row_count) AS BIGINT) AS VARCHAR) || '}' AS json FROM mt"""))
def _(spark, sf):
    m = M.classification_metrics(P.scored(spark, sf), ["outer_fold"])
    wrong = F.col("row_count") - F.round(F.col("accuracy") * F.col("row_count")).cast("bigint")
    path = scratch_path(spark, "report")
    tables.write_report(m.select("outer_fold", "row_count", wrong.alias("wrong")), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.outer_fold").cast("int").alias("outer_fold"), F.col("value").alias("json"))


