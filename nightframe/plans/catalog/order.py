"""Epoch building, windows, ranks and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightframe import proxies as P
from nightframe.functions.numeric import grid_distance
from nightframe.operators import audits, epochs as E, ranks
from nightframe.operators.skew import globally_numbered
from nightframe.plans.oracle import AN, EP, FT, FT_LONG, SG, SG_LONG, with_views
from nightframe.plans.registry import query
from nightframe.schemas import HIGH_CORRELATION, HYPNOGRAM_LEVELS, STAGES

LENGTH = 2592000.0  # thirty days of the event table, in seconds
SEG = """seg AS (SELECT recording_id, subject_id, greatest(0.0, onset) AS s, least(2592000.0, onset + duration) AS e,
  CASE label WHEN 'Sleep stage W' THEN 'Wake' WHEN 'Sleep stage 1' THEN 'N1' WHEN 'Sleep stage 2' THEN 'N2' WHEN 'Sleep stage 4' THEN 'N3' END AS sleep_stage
  FROM an WHERE label <> 'Movement time'),
ex0 AS (SELECT recording_id, subject_id, sleep_stage, s, unnest(range(CAST(floor((e - s + 1e-6) / 3600) AS BIGINT))) AS k FROM seg WHERE e - s >= 3600 - 1e-6),
ex AS (SELECT recording_id, subject_id, sleep_stage, CAST(s + k * 3600 AS DOUBLE) AS start_time_sec, CAST(s + (k + 1) * 3600 AS DOUBLE) AS end_time_sec,
  CAST((s + k * 3600) * 100 AS BIGINT) AS start_sample, CAST((s + (k + 1) * 3600) * 100 AS BIGINT) AS stop_sample FROM ex0)"""


def trimmed_sql(pad: int) -> str:
    return f"""tb AS (SELECT recording_id, count(*) AS epochs_before, greatest(0.0, min(start_time_sec) FILTER (WHERE sleep_stage <> 'Wake') - {pad}.0) AS lo,
  least(max(end_time_sec), max(end_time_sec) FILTER (WHERE sleep_stage <> 'Wake') + {pad}.0) AS hi FROM ex GROUP BY 1),
tr AS (SELECT ex.*, tb.lo, tb.hi, tb.epochs_before FROM ex JOIN tb USING (recording_id) WHERE start_time_sec >= lo AND end_time_sec <= hi),
nm AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_time_sec, end_time_sec) - 1 AS epoch_id FROM tr)"""


def segments(spark, sf):
    return E.clamp_segments(E.map_labels(P.annotations(spark, sf)), F.lit(LENGTH), 3600)


def expanded(spark, sf):
    return E.inside_recording(E.expand(segments(spark, sf), 3600), F.lit(LENGTH), F.lit(int(LENGTH * 100)))


@query("flt07_flt08_mapped_clamped_segments", with_views(AN, SEG, select="SELECT recording_id, sleep_stage, s AS segment_start, e AS segment_end FROM seg WHERE e - s >= 3600 - 1e-6"))
def _(spark, sf):
    return segments(spark, sf).select("recording_id", "sleep_stage", "segment_start", "segment_end")


@query("flt09_grid_violations", """SELECT count(*) AS checked, count(*) FILTER (WHERE abs(value - round_even(value / 0.05, 0) * 0.05) > 1e-6) AS violations FROM events""")
def _(spark, sf):
    return P.table(spark, sf, "events").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(grid_distance("value", 0.05) > 1e-6).alias("violations")
    )


@query("wn14_flt10_annotation_epochs", with_views(AN, SEG, select="SELECT recording_id, sleep_stage, start_time_sec, end_time_sec, start_sample, stop_sample FROM ex"))
def _(spark, sf):
    return expanded(spark, sf).select("recording_id", "sleep_stage", "start_time_sec", "end_time_sec", "start_sample", "stop_sample")


@query("flt11_wn01_trimmed_numbered_epochs", with_views(AN, SEG, trimmed_sql(0), select="SELECT recording_id, epoch_id, start_time_sec, sleep_stage FROM nm"))
def _(spark, sf):
    kept = E.number_epochs(E.trim_wake(expanded(spark, sf), 0), hours_per_bucket=24.0)
    return kept.select("recording_id", "epoch_id", "start_time_sec", "sleep_stage")


@query("ag15_epoch_summary", with_views(AN, SEG, trimmed_sql(1800), select="""SELECT recording_id, any_value(epochs_before) AS epochs_before, any_value(lo) AS trim_start_seconds, any_value(hi) AS trim_end_seconds,
  count(*) AS epochs_after, any_value(epochs_before) - count(*) AS epochs_removed, """ + ", ".join(f"count(*) FILTER (WHERE sleep_stage = '{s}') AS count_{s.lower()}" for s in STAGES) + " FROM tr GROUP BY 1"))
def _(spark, sf):
    return E.epoch_summary(expanded(spark, sf))


# faults put in by position, so that every check has something to find
SEEDED = """nz AS (SELECT recording_id, epoch_id, start_time_sec + CASE WHEN epoch_id % 17 = 2 THEN 5 ELSE 0 END AS start_time_sec,
  end_time_sec + CASE WHEN epoch_id % 7 = 3 THEN 1 ELSE 0 END AS end_time_sec, CASE WHEN epoch_id % 11 = 5 THEN 'N9' ELSE sleep_stage END AS sleep_stage, start_sample,
  CASE WHEN epoch_id % 13 = 0 THEN start_sample ELSE stop_sample END AS stop_sample FROM nm UNION ALL
  SELECT recording_id, epoch_id, start_time_sec, end_time_sec, sleep_stage, start_sample, stop_sample FROM nm WHERE epoch_id = 1)"""


@query("au04_epoch_table_audit", with_views(AN, SEG, trimmed_sql(0), SEEDED, select="""SELECT 'duration' AS check_name, count(*) FILTER (WHERE abs(end_time_sec - start_time_sec - 3600) > 1e-6) AS violations FROM nz
  UNION ALL SELECT 'known_label', count(*) FILTER (WHERE sleep_stage NOT IN ('Wake','N1','N2','N3','REM')) FROM nz
  UNION ALL SELECT 'sample_order', count(*) FILTER (WHERE stop_sample <= start_sample) FROM nz
  UNION ALL SELECT 'grid', count(*) FILTER (WHERE abs(start_time_sec - round_even(start_time_sec / 3600, 0) * 3600) > 1e-6) FROM nz
  UNION ALL SELECT 'unique_key', (SELECT count(*) FROM (SELECT 1 FROM nz GROUP BY recording_id, epoch_id HAVING count(*) > 1))"""))
def _(spark, sf):
    kept = E.number_epochs(E.trim_wake(expanded(spark, sf), 0), hours_per_bucket=24.0)
    at = lambda n, k: F.col("epoch_id") % n == k
    seeded = kept.withColumns({
        "start_time_sec": F.col("start_time_sec") + F.when(at(17, 2), 5).otherwise(0),
        "end_time_sec": F.col("end_time_sec") + F.when(at(7, 3), 1).otherwise(0),
        "sleep_stage": F.when(at(11, 5), "N9").otherwise(F.col("sleep_stage")),
        "stop_sample": F.when(at(13, 0), F.col("start_sample")).otherwise(F.col("stop_sample")),
    })
    return audits.epoch_audit(seeded.unionByName(kept.filter("epoch_id = 1")), 3600.0)


@query("wn09_row_positions", with_views(EP, select="SELECT event_id, row_number() OVER (ORDER BY subject_id, recording_id, night, epoch_id) - 1 AS row_position FROM ep"))
def _(spark, sf):
    ep = P.epochs(spark, sf, positions=True)
    block = F.struct("recording_id", "night", F.floor(F.col("epoch_id") / 1024).alias("block"))
    order = ["subject_id", "recording_id", "night", "epoch_id"]
    return globally_numbered(ep, order, "subject_id", block, "row_position").select("event_id", "row_position")


@query("wn10_hypnogram", with_views(EP, select="""SELECT recording_id, epoch_id, round(epoch_id * 30 / 3600.0, 9) AS elapsed_hours,
  CASE sleep_stage WHEN 'N3' THEN 0 WHEN 'N2' THEN 1 WHEN 'N1' THEN 2 WHEN 'REM' THEN 3 ELSE 4 END AS level FROM ep"""))
def _(spark, sf):
    return P.epochs(spark, sf, positions=True).select(
        "recording_id", "epoch_id", F.round(F.col("epoch_id") * 30 / 3600.0, 9).alias("elapsed_hours"),
        P.literal_map(HYPNOGRAM_LEVELS, F.col("sleep_stage")).alias("level"),
    )


@query("wn11_average_ranks", with_views(FT, FT_LONG, select="""SELECT feature, round(value, 6) AS value, count(*) AS weight, CAST(any_value(r) AS DOUBLE) AS average_rank
  FROM (SELECT feature, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS r FROM fl) q
  GROUP BY q.feature, q.value"""))
def _(spark, sf):
    from nightframe.operators.quantiles import long_form

    return ranks.value_ranks(long_form(P.four_powers(spark, sf, dealt=True), [], P.FT_FEATURES), ["feature"]).withColumn(
        "value", F.round("value", 6)
    )


_RANKED = "rk AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in P.FT_FEATURES) + " FROM ft)"
_PAIRS = [(a, b) for i, a in enumerate(P.FT_FEATURES) for b in P.FT_FEATURES[i + 1:]]


@query("au01_spearman_pairs", with_views(FT, _RANKED, select=" UNION ALL ".join(
    f"SELECT '{a}' AS feature_left, '{b}' AS feature_right, round(corr({a}, {b}), 9) AS spearman_correlation FROM rk" for a, b in _PAIRS)))
def _(spark, sf):
    pairs = ranks.spearman_pairs(P.four_powers(spark, sf), P.FT_FEATURES)
    return pairs.withColumn("spearman_correlation", F.round("spearman_correlation", 9))


@query("flt17_so03_high_correlation_pairs", with_views(FT, _RANKED, select="SELECT *, abs(spearman_correlation) AS absolute_correlation FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_left, '{b}' AS feature_right, round(corr({a}, {b}), 9) AS spearman_correlation FROM rk" for a, b in _PAIRS) + ") WHERE abs(spearman_correlation) >= 0.995"))
def _(spark, sf):
    pairs = ranks.spearman_pairs(P.four_powers(spark, sf), P.FT_FEATURES)
    high = pairs.withColumn("spearman_correlation", F.round("spearman_correlation", 9)).withColumn(
        "absolute_correlation", F.abs("spearman_correlation")
    )
    high = high.filter(~F.isnan("absolute_correlation") & (F.col("absolute_correlation") >= HIGH_CORRELATION))
    return high.orderBy(F.desc("absolute_correlation"), "feature_left", "feature_right")


@query("au02_jn15_pearson_pairs", with_views(FT, select=" UNION ALL ".join(
    f"SELECT '{a}' AS feature_left, '{b}' AS feature_right, round(corr({a}, {b}), 9) AS pearson_correlation FROM ft" for a, b in _PAIRS)))
def _(spark, sf):
    pairs = ranks.correlation_pairs(P.four_powers(spark, sf), P.FT_FEATURES, "pearson_correlation")
    return pairs.withColumn("pearson_correlation", F.round("pearson_correlation", 9))


# --- sequences inside one epoch ------------------------------------------------------


@query("wn06_differences", with_views(SG, SG_LONG, select="""SELECT epoch_id, round(sum(abs(d1)), 6) AS first_total, round(sum(abs(d2)), 6) AS second_total FROM (
  SELECT epoch_id, d1, d1 - lag(d1) OVER (PARTITION BY epoch_id ORDER BY i) AS d2 FROM (SELECT epoch_id, i, v - lag(v) OVER (PARTITION BY epoch_id ORDER BY i) AS d1 FROM sl)) GROUP BY 1"""))
def _(spark, sf):
    from nightframe.functions.signal import differences, fold

    d = P.signals(spark, sf).select("epoch_id", differences("x").alias("d1"))
    d = d.withColumn("d2", differences("d1"))
    return d.select(
        "epoch_id", F.round(fold(F.col("d1"), F.abs), 6).alias("first_total"), F.round(fold(F.col("d2"), F.abs), 6).alias("second_total")
    )


@query("wn07_cumulative_edge", with_views(SG, SG_LONG, select="""SELECT epoch_id, min(i) AS edge_index FROM (SELECT epoch_id, i, sum(v*v) OVER (PARTITION BY epoch_id ORDER BY i) AS run, sum(v*v) OVER (PARTITION BY epoch_id) AS tot FROM sl)
  WHERE run >= 0.95 * tot - 1e-6 GROUP BY 1"""))
def _(spark, sf):
    from nightframe.functions.signal import fold

    s = P.signals(spark, sf).select("epoch_id", "x", fold(F.col("x"), lambda v: v * v).alias("tot"))
    edge = F.aggregate(
        "x",
        F.struct(F.lit(0.0).alias("run"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("at")),
        lambda acc, v: F.struct(
            (acc["run"] + v * v).alias("run"), (acc["i"] + 1).alias("i"),
            F.coalesce(acc["at"], F.when(acc["run"] + v * v >= 0.95 * F.col("tot") - 1e-6, acc["i"])).alias("at"),
        ),
        lambda acc: acc["at"],
    )
    return s.select("epoch_id", edge.cast("bigint").alias("edge_index"))


@query("wn08_overlapping_segments", with_views(SG, SG_LONG, select="""SELECT epoch_id, s.segment, round(sum(v), 6) AS total, count(*) AS samples
  FROM sl JOIN (SELECT unnest(range(3)) AS segment) s ON i >= s.segment * 16 AND i < s.segment * 16 + 32 GROUP BY 1, 2"""))
def _(spark, sf):
    from nightframe.functions.signal import fold

    size, hop = 32, 16
    count = F.floor((F.size("x") - size) / hop).cast("int")
    segs = F.transform(F.sequence(F.lit(0), count), lambda k: F.slice("x", k * hop + 1, F.lit(size)))
    rows = P.signals(spark, sf).select("epoch_id", F.posexplode(segs).alias("segment", "part"))
    return rows.select(
        "epoch_id", F.col("segment").cast("bigint").alias("segment"), F.round(fold(F.col("part"), lambda v: v), 6).alias("total"),
        F.size("part").cast("bigint").alias("samples"),
    )
