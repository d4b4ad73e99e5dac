"""Signal features: time domain, spectrum, filter, quality and the composed extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightframe import proxies as P
from nightframe.operators import audits
from nightframe.operators.summaries import extraction_summary, key_feature_summary
from nightframe.operators.filtering import StateSpace, bandpass, sections
from nightframe.operators.spectral import QUALITY_FIELDS, map_signals, quality, with_psd, with_spectral_features, with_time_features
from nightframe.plans.oracle import SG, SG_LONG, with_views
from nightframe.plans.recordings import chunk_samples, epoch_features, require_samples
from nightframe.plans.registry import query
from nightframe.schemas import KEY_FEATURES, SPECTRAL_FEATURES, STAGES, TIME_FEATURES

FS = 64.0
WINDOW = 0.5  # 32 samples, hop 16


# A sum of squares runs to six digits before the point, so it gets fewer after it.
DIGITS = {"signal_energy_uv2": 3}


def r6(df, columns, less=0):
    return df.withColumns({c: F.round(c, DIGITS.get(c, 6) - less) for c in columns})


TF = """d AS (SELECT *, v - lag(v) OVER w AS d1, lag(v) OVER w AS before FROM sl WINDOW w AS (PARTITION BY epoch_id ORDER BY i)),
dd AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY epoch_id ORDER BY i) AS d2 FROM d),
tf AS (SELECT epoch_id, avg(v) AS mean_uv, stddev_pop(v) AS std_uv, median(v) AS median_uv, min(v) AS min_uv, max(v) AS max_uv, sqrt(avg(v*v)) AS rms_uv,
  max(v)-min(v) AS peak_to_peak_uv, avg(v*v) AS mean_square_uv2, sum(v*v) AS signal_energy_uv2,
  avg(CASE WHEN before IS NULL THEN NULL WHEN (v < 0) <> (before < 0) THEN 1.0 ELSE 0.0 END) AS zero_crossing_rate, sum(abs(d1)) AS line_length_uv,
  skewness(v) AS skewness, kurtosis(v) AS kurtosis_excess, var_pop(v) AS hjorth_activity, sqrt(var_pop(d1)/var_pop(v)) AS hjorth_mobility,
  sqrt(var_pop(d2)/var_pop(d1)) / sqrt(var_pop(d1)/var_pop(v)) AS hjorth_complexity, count(*) AS sample_count FROM dd GROUP BY 1)"""

PSD = """ws AS (SELECT epoch_id, s.g, i - s.g*16 AS j, v FROM sl JOIN (SELECT unnest(range(3)) AS g) s ON i >= s.g*16 AND i < s.g*16 + 32),
wc AS (SELECT epoch_id, g, j, (v - avg(v) OVER (PARTITION BY epoch_id, g)) * (0.5 - 0.5*cos(2*pi()*j/32)) AS y FROM ws),
ft AS (SELECT epoch_id, g, k, sum(y*cos(2*pi()*j*k/32)) AS re, sum(y*sin(2*pi()*j*k/32)) AS im FROM wc CROSS JOIN (SELECT unnest(range(17)) AS k) GROUP BY 1,2,3),
ps AS (SELECT epoch_id, k, k*2.0::DOUBLE AS f, avg((re*re+im*im) / (64.0 * (SELECT sum((0.5-0.5*cos(2*pi()*j/32))*(0.5-0.5*cos(2*pi()*j/32))) FROM (SELECT unnest(range(32)) AS j)))) * CASE WHEN k IN (0,16) THEN 1 ELSE 2 END AS p FROM ft GROUP BY 1,2),
bp AS (SELECT epoch_id, sum(p) FILTER (WHERE f>=0.5 AND f<4)*2 AS delta_power_uv2, sum(p) FILTER (WHERE f>=4 AND f<8)*2 AS theta_power_uv2, sum(p) FILTER (WHERE f>=8 AND f<12)*2 AS alpha_power_uv2,
  sum(p) FILTER (WHERE f>=12 AND f<16)*2 AS sigma_power_uv2, sum(p) FILTER (WHERE f>=16 AND f<=30)*2 AS beta_power_uv2 FROM ps GROUP BY 1),
bt AS (SELECT *, delta_power_uv2+theta_power_uv2+alpha_power_uv2+sigma_power_uv2+beta_power_uv2 AS total_band_power_uv2 FROM bp),
an AS (SELECT epoch_id, f, p, sum(p) OVER (PARTITION BY epoch_id) AS tot, sum(p) OVER (PARTITION BY epoch_id ORDER BY f) AS run FROM ps WHERE f>=0.5 AND f<=30),
sh AS (SELECT epoch_id, -sum(CASE WHEN p>0 THEN p/tot*log2(p/tot) ELSE 0 END)/log2(count(*)) AS spectral_entropy, arg_max(f, p) AS dominant_frequency_hz,
  sum(f*p)/any_value(tot) AS spectral_centroid_hz, min(f) FILTER (WHERE run >= 0.95*tot) AS spectral_edge_frequency_95_hz FROM an GROUP BY 1),
sp AS (SELECT *, delta_power_uv2/total_band_power_uv2 AS relative_delta_power, theta_power_uv2/total_band_power_uv2 AS relative_theta_power, alpha_power_uv2/total_band_power_uv2 AS relative_alpha_power,
  sigma_power_uv2/total_band_power_uv2 AS relative_sigma_power, beta_power_uv2/total_band_power_uv2 AS relative_beta_power, delta_power_uv2/theta_power_uv2 AS delta_theta_ratio,
  theta_power_uv2/alpha_power_uv2 AS theta_alpha_ratio, alpha_power_uv2/beta_power_uv2 AS alpha_beta_ratio, sigma_power_uv2/beta_power_uv2 AS sigma_beta_ratio FROM bt JOIN sh USING (epoch_id))"""


def rounded_list(columns, less=0):
    return ", ".join(f"round({c}, {DIGITS.get(c, 6) - less}) AS {c}" for c in columns)


@query("sg02_to_sg16_time_features", with_views(SG, SG_LONG, TF, select=f"SELECT epoch_id, {rounded_list(TIME_FEATURES)} FROM tf"))
def _(spark, sf):
    return r6(with_time_features(P.signals(spark, sf), "x", ["epoch_id"]), TIME_FEATURES)


@query("sg17_welch_density", with_views(SG, SG_LONG, PSD, select="SELECT epoch_id, k AS bin, f AS frequency_hz, round(p, 6) AS density FROM ps"))
def _(spark, sf):
    psd = with_psd(P.signals(spark, sf), FS, "x", WINDOW, keep=["epoch_id"])
    rows = psd.select("epoch_id", "hz", F.posexplode("psd").alias("k", "p"))
    return rows.select(
        "epoch_id", F.col("k").cast("bigint").alias("bin"), (F.col("k") * F.col("hz")).alias("frequency_hz"), F.round("p", 6).alias("density")
    )


@query("sg18_to_sg25_spectral_features", with_views(SG, SG_LONG, PSD, select=f"SELECT epoch_id, {rounded_list(SPECTRAL_FEATURES)} FROM sp"))
def _(spark, sf):
    psd = with_psd(P.signals(spark, sf), FS, "x", WINDOW, keep=["epoch_id"])
    return r6(with_spectral_features(psd).select("epoch_id", *SPECTRAL_FEATURES), SPECTRAL_FEATURES)


@query("flt12_sg26_quality_columns", with_views(SG, SG_LONG, select="""SELECT epoch_id, count(*) AS sample_count, true AS is_finite_signal, stddev_pop(v) < 0.1 AS flatline_flag,
  max(abs(v)) > 500 AS amplitude_artifact_flag, (stddev_pop(v) < 0.1 OR max(abs(v)) > 500) AS quality_issue_flag FROM (SELECT epoch_id, v * 5 AS v FROM sl) GROUP BY 1"""))
def _(spark, sf):
    loud = F.transform("x", lambda v: v * 5)
    s = P.signals(spark, sf).select("epoch_id", loud.alias("raw"), loud.alias("filtered"))
    return map_signals(s, ["epoch_id"], ["raw", "filtered"], QUALITY_FIELDS, quality)


def one_pass(name: str, source: str) -> str:
    """SQL for one pass of the filter over whole recordings, sample by sample: (recording_id, ys) from (recording_id, xs)."""
    space = StateSpace.of(sections(FILTER_FS))
    steady, k = space.steady(), range(len(space.b))

    def dot(row, states, x, own):
        return " + ".join([*(f"({float(v)!r}) * {s}" for v, s in zip(row, states) if v), f"({float(own)!r}) * {x}"])

    def moved(states, x):
        return ", ".join([f"{dot(space.c, states, x, space.d)} AS y", *(f"{dot(space.a[i], states, x, space.b[i])} AS s{i}" for i in k)])

    first = moved([f"({float(v)!r}) * xs[1]" for v in steady], "xs[1]")
    return f"""{name}_s AS (SELECT recording_id, 1 AS u, {first} FROM {source}
  UNION ALL SELECT {name}_s.recording_id, u + 1, {moved([f"s{i}" for i in k], "xs[u + 1]")} FROM {name}_s JOIN {source} USING (recording_id) WHERE u < len(xs)),
{name} AS (SELECT recording_id, list(y ORDER BY u DESC) AS xs FROM {name}_s GROUP BY 1)"""


# Whole recordings, extended by odd reflection of 27 samples at both ends, forward and backward.
FILTER_FS = 100.0
FILTERED = f"""whole AS (SELECT recording_id, list(v ORDER BY chunk, i) AS w, list(chunk ORDER BY chunk, i) AS cs, list(i ORDER BY chunk, i) AS ns FROM sl GROUP BY 1),
ext AS (SELECT recording_id, list_concat(list_transform(range(27, 0, -1), lambda k: 2 * w[1] - w[k + 1]), list_concat(w, list_transform(range(1, 28), lambda k: 2 * w[-1] - w[len(w) - k]))) AS xs FROM whole),
{one_pass("fwd", "ext")},
{one_pass("bwd", "fwd")},
yy AS (SELECT recording_id, unnest(cs) AS chunk, unnest(ns) AS i, unnest(xs[28:len(xs) - 27]) AS y FROM bwd JOIN whole USING (recording_id))"""


@query("sg01_zero_phase_bandpass", with_views(SG, SG_LONG, FILTERED, select="SELECT recording_id, chunk, i AS sample, round(y, 4) + 0.0 AS filtered_uv FROM yy", recursive=True))
def _(spark, sf):
    out = bandpass(P.signals(spark, sf), ["recording_id"], "chunk", FILTER_FS)
    rows = out.select("recording_id", "chunk", F.posexplode("filtered").alias("sample", "y"))
    return rows.select("recording_id", "chunk", F.col("sample").cast("bigint").alias("sample"), (F.round("y", 4) + 0.0).alias("filtered_uv"))


@query("jn07_samples_to_epochs", with_views(SG, SG_LONG, select="""SELECT recording_id, sample_index // 128 AS chunk, count(*) AS samples, round(sum(v), 6) AS total, round(any_value(v) FILTER (WHERE sample_index % 128 = 5), 6) AS sixth
  FROM (SELECT recording_id, chunk * 64 + i AS sample_index, v FROM sl) GROUP BY 1, 2"""))
def _(spark, sf):
    long = P.signals(spark, sf).select("recording_id", "chunk", F.posexplode("x").alias("i", "uv")).select(
        "recording_id", (F.col("chunk") * 64 + F.col("i")).alias("sample_index"), "uv"
    )
    ep = chunk_samples(long, ["recording_id"], 128)
    return ep.select(
        "recording_id", "chunk", F.size("x").cast("bigint").alias("samples"),
        F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.round(F.col("x")[5], 6).alias("sixth"),
    )


# faults put in by chunk: each identity but the last is broken somewhere, by a known share
@query("au03_algebraic_identities", with_views(SG, SG_LONG, TF, PSD, "ids AS (SELECT *, epoch_id % 50 AS c FROM tf JOIN sp USING (epoch_id))", select="""SELECT identity, round(max(err), 9) AS maximum_normalized_error, max(err) <= 1e-9 AS passes FROM (
  SELECT 'rms_squared_equals_mean_square' AS identity, CASE WHEN c = 7 THEN abs(rms_uv*rms_uv*1.002001 - mean_square_uv2) / greatest(rms_uv*rms_uv*1.002001, mean_square_uv2, 1) ELSE 0.0::DOUBLE END AS err FROM ids
  UNION ALL SELECT 'energy_equals_mean_square_times_samples', CASE WHEN c = 11 THEN 0.5 * signal_energy_uv2 / greatest(1.5 * signal_energy_uv2, 1) ELSE 0.0 END FROM ids
  UNION ALL SELECT 'hjorth_activity_equals_std_squared', CASE WHEN c = 13 THEN 1.0 / greatest(hjorth_activity + 1, 1) ELSE 0.0 END FROM ids
  UNION ALL SELECT 'total_power_equals_band_sum', CASE WHEN c = 17 THEN 2.0 / greatest(total_band_power_uv2 + 2, 1) ELSE 0.0 END FROM ids
  UNION ALL SELECT 'relative_power_sum_equals_one', 0.0 FROM ids) GROUP BY 1"""))
def _(spark, sf):
    at = lambda n, c, off: F.when(F.col("chunk") == n, off).otherwise(F.col(c))
    broken = features(spark, sf).withColumns({
        "rms_uv": at(7, "rms_uv", F.col("rms_uv") * 1.001), "signal_energy_uv2": at(11, "signal_energy_uv2", F.col("signal_energy_uv2") * 1.5),
        "hjorth_activity": at(13, "hjorth_activity", F.col("hjorth_activity") + 1.0), "total_band_power_uv2": at(17, "total_band_power_uv2", F.col("total_band_power_uv2") + 2.0),
    })
    return audits.algebraic_identities(broken).withColumn("maximum_normalized_error", F.round("maximum_normalized_error", 9))


def features(spark, sf):
    return epoch_features(P.signals(spark, sf), ["recording_id"], FS, WINDOW, filtered=False)


def staged_features(spark, sf):
    """The feature table with stages dealt out by chunk, a subject per recording, and amplitude flags that occur."""
    df = features(spark, sf).withColumns({"subject_id": F.substring("recording_id", 2, 9).cast("bigint"), "night": F.lit(1)})
    loud, flat = F.col("peak_to_peak_uv") > 300, F.col("std_uv") < 20
    return df.withColumns({"sleep_stage": F.element_at(F.array(*[F.lit(c) for c in STAGES]), F.pmod("chunk", F.lit(7)).cast("int") % 5 + 1),
                           "flatline_flag": flat, "amplitude_artifact_flag": loud, "quality_issue_flag": loud | flat})


STAGED = "st AS (SELECT recording_id, CAST(substr(recording_id, 2) AS BIGINT) AS subject_id, ['Wake','N1','N2','N3','REM'][chunk % 7 % 5 + 1] AS sleep_stage, tf.*, sp.* EXCLUDE (epoch_id) FROM sg JOIN tf USING (epoch_id) JOIN sp USING (epoch_id))"


@query("ag08_key_feature_summary", with_views(SG, SG_LONG, TF, PSD, STAGED, "kf AS (UNPIVOT st ON " + ", ".join(KEY_FEATURES) + " INTO NAME feature VALUE v)",
  select="""SELECT sleep_stage, feature, count(*) AS "count", round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q1,
  round(quantile_cont(v, 0.75), 6) AS q3, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr FROM kf GROUP BY 1, 2"""))
def _(spark, sf):
    return r6(key_feature_summary(staged_features(spark, sf)), ["median", "q1", "q3", "iqr"])


@query("ag16_recording_extraction_summary", with_views(SG, SG_LONG, TF, PSD, STAGED, select="""SELECT recording_id, subject_id, 1 AS night, count(*) AS epoch_count,
  count(*) FILTER (WHERE peak_to_peak_uv > 300 OR std_uv < 20) AS quality_issue_count, count(*) FILTER (WHERE std_uv < 20) AS flatline_count,
  count(*) FILTER (WHERE peak_to_peak_uv > 300) AS amplitude_artifact_count, round(quantile_cont(std_uv, 0.5), 6) AS median_std_uv,
  round(quantile_cont(total_band_power_uv2, 0.5), 6) AS median_total_band_power_uv2, """
  + ", ".join(f"count(*) FILTER (WHERE sleep_stage = '{s}') AS count_{s.lower()}" for s in STAGES) + " FROM st GROUP BY ALL"))
def _(spark, sf):
    return r6(extraction_summary(staged_features(spark, sf)), ["median_std_uv", "median_total_band_power_uv2"])


@query("au05_feature_table_audit", """WITH e AS (SELECT vec_id % 50 AS c FROM embeddings) SELECT 'finite_flag' AS check_name, count(*) FILTER (WHERE c % 11 = 1) AS violations FROM e
  UNION ALL SELECT 'finite_features', count(*) FILTER (WHERE c % 13 = 1) FROM e UNION ALL SELECT 'relative_sum', count(*) FILTER (WHERE c % 17 = 1) FROM e
  UNION ALL SELECT 'unique_key', count(*) FILTER (WHERE c % 19 = 1) FROM e""")
def _(spark, sf):
    df = features(spark, sf)
    at = lambda n: F.col("chunk") % n == 1
    broken = df.withColumns({
        "is_finite_signal": ~at(11) & F.col("is_finite_signal"), "mean_uv": F.when(at(13), float("nan")).otherwise(F.col("mean_uv")),
        "relative_delta_power": F.col("relative_delta_power") + F.when(at(17), 1e-6).otherwise(0.0),
    })
    return audits.feature_audit(broken.unionByName(df.filter(at(19))), [*TIME_FEATURES, *SPECTRAL_FEATURES], ["recording_id", "chunk"])


# the filtered samples, renamed to the names the feature SQL reads, at 100 Hz and 3.125 Hz bins
AGAIN = "sl AS (SELECT sg.epoch_id, yy.recording_id, yy.chunk, yy.y AS v, yy.i FROM yy JOIN sg ON sg.recording_id = yy.recording_id AND sg.chunk = yy.chunk)"
CHAIN = SG_LONG.replace("sl AS", "raw AS"), FILTERED.replace("FROM sl", "FROM raw"), AGAIN, TF, PSD.replace("k*2.0::DOUBLE", "k*3.125::DOUBLE").replace(
    "64.0 *", "100.0 *").replace(")*2 AS", ")*3.125 AS")


# Filter states round differently in matrix products and sample by sample, so two digits fewer are compared.
@query("sg27_recording_features", with_views(SG, *CHAIN, select="SELECT yk.recording_id, yk.chunk, tf.sample_count, true AS is_finite_signal, std_uv < 0.1 AS flatline_flag, rawmax > 500 AS amplitude_artifact_flag, (std_uv < 0.1 OR rawmax > 500) AS quality_issue_flag, "
  + rounded_list([*TIME_FEATURES, *SPECTRAL_FEATURES], 2) + " FROM tf JOIN sp USING (epoch_id) JOIN (SELECT epoch_id, recording_id, chunk, max(abs(v)) AS rawmax FROM raw GROUP BY 1, 2, 3) yk USING (epoch_id)", recursive=True))
def _(spark, sf):
    long = P.signals(spark, sf).select("recording_id", "chunk", F.posexplode("x").alias("i", "uv")).select(
        "recording_id", (F.col("chunk") * 64 + F.col("i")).alias("sample_index"), "uv"
    )
    chunks = require_samples(chunk_samples(long, ["recording_id"], 64), "x", 64)
    return r6(epoch_features(chunks, ["recording_id"], FILTER_FS, 0.32), [*TIME_FEATURES, *SPECTRAL_FEATURES], 2)
