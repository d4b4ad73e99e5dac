import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nightframe.functions.signal import central_moment, median, quality_flags, zero_crossing_rate
from nightframe.operators import filtering
from nightframe.operators.filtering import bandpass
from nightframe.operators.spectral import band_gain, quality, welch, with_psd, with_spectral_features, with_time_features
from nightframe.plans.recordings import chunk_samples, epoch_features, require_samples
from nightframe.schemas import SPECTRAL_FEATURES, TIME_FEATURES

FS = 100.0


def frame(spark, *arrays):
    return spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(arrays)], "epoch_id int, x array<double>")


def test_time_features_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(3, 20, 3000)
    got = with_time_features(frame(spark, x), "x", ["epoch_id"]).first().asDict()
    d1, d2 = np.diff(x), np.diff(x, 2)
    want = {
        "mean_uv": x.mean(), "std_uv": x.std(), "median_uv": np.median(x), "min_uv": x.min(), "max_uv": x.max(),
        "rms_uv": np.sqrt((x**2).mean()), "peak_to_peak_uv": np.ptp(x), "mean_square_uv2": (x**2).mean(), "signal_energy_uv2": (x**2).sum(),
        "zero_crossing_rate": (np.diff(np.signbit(x)) != 0).mean(), "line_length_uv": np.abs(d1).sum(), "skewness": pd.Series(x).skew(),
        "kurtosis_excess": pd.Series(x).kurt(), "hjorth_activity": x.var(), "hjorth_mobility": np.sqrt(d1.var() / x.var()),
        "hjorth_complexity": np.sqrt(d2.var() / d1.var()) / np.sqrt(d1.var() / x.var()),
    }
    assert set(want) == set(TIME_FEATURES)
    for name, value in want.items():
        assert got[name] == pytest.approx(value, rel=1e-9, abs=1e-9), name


def test_constant_signal_is_degenerate_but_defined(spark):
    got = with_time_features(frame(spark, np.ones(3000)), "x", ["epoch_id"]).first()
    assert (got.std_uv, got.hjorth_activity, got.hjorth_mobility, got.hjorth_complexity) == (0.0, 0.0, 0.0, 0.0)
    assert got.zero_crossing_rate == 0.0 and got.line_length_uv == 0.0 and got.skewness is None


def test_expressions_agree_with_the_batch_stage(spark):
    x = np.random.default_rng(3).normal(1, 5, 501)
    df = frame(spark, x)
    e = df.select(central_moment("x", 2).alias("m2"), central_moment("x", 4).alias("m4"), median("x").alias("med"), zero_crossing_rate("x").alias("z")).first()
    d = x - x.mean()
    assert e.m2 == pytest.approx((d**2).mean()) and e.m4 == pytest.approx((d**4).mean()) and e.med == pytest.approx(np.median(x))
    assert e.z == pytest.approx(with_time_features(df, "x", ["epoch_id"]).first().zero_crossing_rate)
    q = quality(np.array([x * 200, x]), np.array([x, x * 0]))
    assert q["amplitude_artifact_flag"].tolist() == [True, False] and q["flatline_flag"].tolist() == [False, True]


def test_minus_zero_counts_as_negative(spark):
    got = frame(spark, [1.0, -0.0, 0.0, 1.0]).select(zero_crossing_rate("x").alias("z")).first().z
    assert got == pytest.approx(2 / 3)


def test_quality_flags(spark):
    rows = frame(spark, np.zeros(100), np.sin(np.arange(100)), np.sin(np.arange(100)) * 501).select(
        "epoch_id", *[c.alias(n) for n, c in quality_flags("x", "x").items()]
    ).orderBy("epoch_id").collect()
    assert [r.flatline_flag for r in rows] == [True, False, False]
    assert [r.amplitude_artifact_flag for r in rows] == [False, False, True]
    assert [r.quality_issue_flag for r in rows] == [True, False, True]
    assert {r.sample_count for r in rows} == {100}


def test_sine_peaks_at_its_frequency(spark):
    t = np.arange(3000) / FS
    df = with_spectral_features(with_psd(frame(spark, np.sin(2 * np.pi * 2 * t)), FS, keep=["epoch_id"]))
    row = df.select("epoch_id", *SPECTRAL_FEATURES).first()
    assert row.dominant_frequency_hz == 2.0
    assert row.relative_delta_power > 0.99
    assert row.total_band_power_uv2 == pytest.approx(0.5, rel=1e-3)
    assert sum(row[f"relative_{b}_power"] for b in ("delta", "theta", "alpha", "sigma", "beta")) == pytest.approx(1, abs=1e-10)


def test_band_power_of_a_flat_spectrum(spark):
    psd = spark.createDataFrame([(0, [2.0] * 5, 1.0)], "epoch_id int, psd array<double>, hz double")
    from nightframe.operators.spectral import _weighted

    inside = lambda p, f: F.when((f >= 1.0) & (f < 4.0), p).otherwise(F.lit(0.0))
    assert psd.select((_weighted(F.col("psd"), inside) * F.col("hz")).alias("v")).first().v == 6.0


def test_empty_band_and_silent_spectrum_are_errors(spark):
    short = spark.createDataFrame([(0, [1.0, 1.0, 1.0], 1.0)], "epoch_id int, psd array<double>, hz double")
    with pytest.raises(Exception, match="no spectral bins"):
        with_spectral_features(short).collect()
    silent = spark.createDataFrame([(0, [0.0] * 60, 1.0)], "epoch_id int, psd array<double>, hz double")
    with pytest.raises(Exception, match="not positive"):
        with_spectral_features(silent).collect()


def test_non_finite_signal_is_refused(spark):
    with pytest.raises(Exception, match="not finite"):
        with_psd(frame(spark, [1.0, float("nan")] * 200), FS, keep=["epoch_id"]).collect()


def test_welch_of_white_noise_keeps_the_power():
    x = np.random.default_rng(0).normal(0, 3, (4, 30000))
    psd, hz = welch(x, FS, 4.0, 0.5)
    assert psd.shape == (4, 201) and hz == 0.25
    assert (psd.sum(axis=1) * hz).mean() == pytest.approx(9, rel=0.05)


def test_mixed_lengths_share_a_batch(spark):
    df = with_psd(frame(spark, np.sin(np.arange(800)), np.sin(np.arange(600))), FS, keep=["epoch_id"])
    assert {r.epoch_id: len(r.psd) for r in df.collect()} == {0: 201, 1: 201}


def recordings(spark, signals, size):
    rows = [(r, c, [float(v) for v in x[c * size : (c + 1) * size]]) for r, x in signals.items() for c in range(-(-len(x) // size))]
    return spark.createDataFrame(rows, "recording_id string, chunk bigint, x array<double>").repartition(5)


def filtered(df, **more):
    out = {}
    for r in bandpass(df, ["recording_id"], "chunk", FS, **more).orderBy("recording_id", "chunk").collect():
        assert len(r.filtered) == len(r.x)
        out.setdefault(r.recording_id, []).extend(r.filtered)
    return {k: np.array(v) for k, v in out.items()}


@pytest.mark.parametrize(("size", "span", "fan"), [(64, 64, 1024), (64, 3, 2), (1000, 2, 2), (7, 50, 3)])
def test_scan_equals_the_filter_over_whole_recordings(spark, size, span, fan):
    """Every value, recording ends included, at several chunk lengths; short recordings and one without a name."""
    rng = np.random.default_rng(3)
    signals = {name: np.cumsum(rng.normal(0, 1, n)) for name, n in (("A", 3220), ("B", 20), ("C", 1), (None, 500))}
    got = filtered(recordings(spark, signals, size), span=span, fan=fan)
    for name, x in signals.items():
        assert np.abs(got[name] - filtering.plain(x, FS)).max() < 1e-9


def test_scan_has_the_gain_of_the_band(spark):
    rng = np.random.default_rng(7)
    x = np.cumsum(rng.normal(0, 1, 36000)) + rng.normal(0, 3, 36000)
    x = x - np.linspace(x[0], x[-1], len(x))
    got = filtered(recordings(spark, {"A": x}, 3000), span=2)["A"]
    whole = np.fft.irfft(np.fft.rfft(x) * band_gain(len(x), FS), n=len(x))
    assert np.abs(got - whole)[6000:-6000].max() < 1e-9


def test_filter_keeps_the_band_and_stops_what_is_outside():
    t = np.arange(6000) / FS
    for hz, gain in ((0.02, 0.0), (0.3, 0.5), (10.0, 1.0), (35.0, 0.5), (48.0, 0.0)):
        y = filtering.plain(np.sin(2 * np.pi * hz * t), FS)[2000:4000]
        assert np.sqrt(2 * (y**2).mean()) == pytest.approx(gain, abs=0.02)


def test_missing_signal_and_sample_that_is_not_finite(spark):
    df = recordings(spark, {"A": np.ones(200)}, 64).unionByName(spark.createDataFrame([("N", 0, None)], "recording_id string, chunk bigint, x array<double>"))
    got = {r.recording_id: r.filtered for r in bandpass(df, ["recording_id"], "chunk", FS).filter("chunk = 0").collect()}
    assert got["N"] == [] and np.abs(got["A"]).max() < 1e-9
    assert bandpass(df.limit(0), ["recording_id"], "chunk", FS).count() == 0
    with pytest.raises(Exception, match="not finite"):
        bandpass(recordings(spark, {"A": np.array([1.0, np.nan] * 50)}, 64), ["recording_id"], "chunk", FS).collect()


def test_cutoff_above_nyquist_is_refused(spark):
    with pytest.raises(ValueError, match="Nyquist"):
        bandpass(frame(spark, [1.0]).withColumn("r", F.lit("A")), ["r"], "epoch_id", 60.0)


def test_samples_meet_epochs_and_features_come_out(spark):
    t = np.arange(9000)
    rows = [("A", int(i), float(np.sin(2 * np.pi * 10 * i / FS) * 30)) for i in t]
    samples = spark.createDataFrame(rows, "recording_id string, sample_index bigint, uv double").repartition(6)
    chunks = require_samples(chunk_samples(samples, ["recording_id"], 3000), "x", 3000)
    out = epoch_features(chunks, ["recording_id"], FS).orderBy("chunk").collect()
    assert [r.chunk for r in out] == [0, 1, 2] and {r.dominant_frequency_hz for r in out} == {10.0}
    with pytest.raises(Exception, match="unexpected sample count"):
        require_samples(chunk_samples(samples, ["recording_id"], 2500), "x", 2500).select("x").collect()
