"""Signal stages.

One Arrow stage does the work on samples: the time-domain features with the Welch estimate
of one epoch, on the rows of its own batch (the filter is in ``filtering``).  Higher-order functions could say most of the time features too, but
they interpret every sample of every pass, which costs some hundred times more per epoch.
Everything that follows from the spectrum is column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from nightframe.functions.numeric import safe_ratio
from nightframe.schemas import (
    ARTIFACT_ABS_UV, BANDS, EDGE_FRACTION, FILTER_HIGH_HZ, FILTER_LOW_HZ, FILTER_ORDER, FLATLINE_STD_UV, FLOAT_TOLERANCE,
    SIGNAL_QUALITY_COLUMNS, TIME_FEATURES, WELCH_OVERLAP, WELCH_SECONDS,
)


def _stacks(*columns: pa.ListArray) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of equal length as matrices: (row positions, one matrix per column)."""
    lengths = np.diff(columns[0].offsets.to_numpy())
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    flats = [c.flatten().to_numpy(zero_copy_only=False) for c in columns]
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        at = starts[rows][:, None] + np.arange(size)
        yield (rows, *[f[at] for f in flats])


def _listed(rows: Sequence[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))


def map_signals(df: DataFrame, keep: Sequence[str], signals: Sequence[str], fields: Sequence[T.StructField], measure) -> DataFrame:
    """Keep some columns and add what ``measure`` says about the signals of each row.

    ``measure`` takes one matrix per signal (rows of equal length) and returns, per field,
    a vector or a matrix with one row per input row.  NaN in a vector becomes null.
    """
    source = df.select(*keep, *signals)
    schema = T.StructType([source.schema[c] for c in keep] + list(fields))
    names = [f.name for f in fields]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = {n: [None] * batch.num_rows for n in names}
            for rows, *matrices in _stacks(*[batch.column(len(keep) + i) for i in range(len(signals))]):
                found = measure(*matrices)
                for n in names:
                    for at, value in zip(rows, found[n]):
                        out[n][at] = value
            made = []
            for f in fields:
                if isinstance(f.dataType, T.ArrayType):
                    made.append(_listed(out[f.name]))
                else:
                    made.append(pa.array(np.asarray(out[f.name]), from_pandas=True))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *made], names=[*keep, *names])

    return source.mapInArrow(stage, schema)


def time_domain(x: np.ndarray) -> dict[str, np.ndarray]:
    """The 16 time-domain features of each row; skewness and kurtosis of a constant are undefined."""
    n = x.shape[1]
    mu = x.mean(axis=1)
    d = x - mu[:, None]
    m2, m3, m4 = ((d**k).mean(axis=1) for k in (2, 3, 4))
    d1 = np.diff(x, axis=1)
    v1, v2 = d1.var(axis=1), np.diff(d1, axis=1).var(axis=1)
    energy = np.cumsum(x**2, axis=1)[:, -1]  # in sample order, like a plain running sum
    with np.errstate(divide="ignore", invalid="ignore"):
        moves = m2 > 0
        mobility = np.where(moves, np.sqrt(v1 / m2), 0.0)
        complexity = np.where(moves & (v1 > 0), np.sqrt(v2 / v1) / np.sqrt(v1 / m2), 0.0)
        skew = np.where(moves & (n > 2), np.sqrt(n * (n - 1.0)) / max(n - 2, 1) * m3 / m2**1.5, np.nan)
        kurt = np.where(moves & (n > 3), (n - 1) / max((n - 2) * (n - 3), 1) * ((n + 1) * (m4 / m2**2 - 3) + 6), np.nan)
    low, high = x.min(axis=1), x.max(axis=1)
    return {
        "mean_uv": mu, "std_uv": np.sqrt(m2), "median_uv": np.median(x, axis=1), "min_uv": low, "max_uv": high,
        "rms_uv": np.sqrt(energy / n), "peak_to_peak_uv": high - low, "mean_square_uv2": energy / n,
        "signal_energy_uv2": energy, "zero_crossing_rate": (np.diff(np.signbit(x), axis=1) != 0).mean(axis=1),
        "line_length_uv": np.abs(d1).sum(axis=1), "skewness": skew, "kurtosis_excess": kurt, "hjorth_activity": m2,
        "hjorth_mobility": mobility, "hjorth_complexity": complexity,
    }


def quality(raw: np.ndarray, filtered: np.ndarray) -> dict[str, np.ndarray]:
    """Flatline is judged on the filtered signal, amplitude on the raw one; rows are only flagged."""
    flat = filtered.std(axis=1) < FLATLINE_STD_UV
    loud = np.abs(raw).max(axis=1) > ARTIFACT_ABS_UV
    return {
        "sample_count": np.full(len(raw), filtered.shape[1], dtype=np.int64),
        "is_finite_signal": np.isfinite(raw).all(axis=1) & np.isfinite(filtered).all(axis=1),
        "flatline_flag": flat, "amplitude_artifact_flag": loud, "quality_issue_flag": flat | loud,
    }


def spectrum(x: np.ndarray, fs: float, window_seconds: float, overlap: float) -> dict[str, np.ndarray]:
    values, width = welch(x, fs, window_seconds, overlap)
    if values.shape[1] < 2 or not np.isfinite(values).all():
        raise ValueError("spectral density is empty or not finite")
    return {"psd": values, "hz": np.full(len(x), width)}


TIME_FIELDS = tuple(T.StructField(c, T.DoubleType()) for c in TIME_FEATURES)
QUALITY_FIELDS = (T.StructField("sample_count", T.LongType()),) + tuple(
    T.StructField(c, T.BooleanType()) for c in SIGNAL_QUALITY_COLUMNS[1:]
)
SPECTRUM_FIELDS = (T.StructField("psd", T.ArrayType(T.DoubleType())), T.StructField("hz", T.DoubleType()))


def with_time_features(df: DataFrame, signal: str, keep: Sequence[str]) -> DataFrame:
    return map_signals(df, keep, [signal], TIME_FIELDS, time_domain)


def with_all_measures(df: DataFrame, keep: Sequence[str], raw: str, filtered: str, fs: float, window_seconds: float,
                      overlap: float = WELCH_OVERLAP) -> DataFrame:
    """Quality flags, time features and spectrum in one pass over the samples."""
    def measure(r, f):
        return {**quality(r, f), **time_domain(f), **spectrum(f, fs, window_seconds, overlap)}

    return map_signals(df, keep, [raw, filtered], [*QUALITY_FIELDS, *TIME_FIELDS, *SPECTRUM_FIELDS], measure)


def welch(x: np.ndarray, fs: float, window_seconds: float, overlap: float) -> tuple[np.ndarray, float]:
    """One-sided density of each row, averaged over Hann-windowed, mean-free segments."""
    n = x.shape[1]
    size = min(int(round(window_seconds * fs)), n)
    shared = min(int(round(size * overlap)), size - 1)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    segments = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, :: size - shared]
    centred = segments - segments.mean(axis=2, keepdims=True)
    power = np.abs(np.fft.rfft(centred * window, axis=2)) ** 2 / (fs * np.sum(window**2))
    power[:, :, 1 : (-1 if size % 2 == 0 else None)] *= 2.0
    return power.mean(axis=1), fs / size


def with_psd(df: DataFrame, fs: float, signal: str = "x", window_seconds: float = WELCH_SECONDS,
             overlap: float = WELCH_OVERLAP, keep: Sequence[str] | None = None) -> DataFrame:
    """Replace the signal by ``psd`` (array) and ``hz`` (bin width); a non-finite density is an error."""
    keep = [c for c in (keep if keep is not None else df.columns) if c != signal]
    return map_signals(df, keep, [signal], SPECTRUM_FIELDS, lambda x: spectrum(x, fs, window_seconds, overlap))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def _weighted(psd: Column, weight) -> Column:
    """Sum over bins of weight(power, frequency)."""
    return _sum(F.transform(psd, lambda p, k: weight(p, k.cast("double") * F.col("hz"))))


def with_spectral_features(df: DataFrame, bands: Mapping[str, tuple[float, float]] = BANDS) -> DataFrame:
    """Band powers, shares, ratios, entropy, dominant frequency, centroid and 95 % edge from ``psd``/``hz``."""
    psd = F.col("psd")
    names = list(bands)
    last = names[-1]
    low, high = min(b[0] for b in bands.values()), max(b[1] for b in bands.values())

    def inside(f, name):
        lo, hi = bands[name]
        return (f >= lo) & ((f <= hi) if name == last else (f < hi))

    def empty(name):
        hit = F.exists(F.transform(psd, lambda p, k: inside(k.cast("double") * F.col("hz"), name)), lambda b: b)
        return ~hit

    absolute = {}
    for name in names:
        total = _weighted(psd, lambda p, f, name=name: F.when(inside(f, name), p).otherwise(F.lit(0.0))) * F.col("hz")
        failure = F.raise_error(F.lit(f"no spectral bins in band {name}")).cast("double")
        absolute[f"{name}_power_uv2"] = F.when(empty(name), failure).otherwise(total)
    # the analysed bins with their frequencies, and running power over them
    bins = F.filter(
        F.transform(psd, lambda p, k: F.struct((k.cast("double") * F.col("hz")).alias("f"), p.alias("p"))),
        lambda b: (b["f"] >= low) & (b["f"] <= high),
    )
    step = df.withColumns({**absolute, "_bins": bins})
    sum_all = F.col(f"{names[0]}_power_uv2")
    for name in names[1:]:
        sum_all = sum_all + F.col(f"{name}_power_uv2")
    bad_total = F.raise_error(F.lit("total band power is not positive")).cast("double")
    step = step.withColumn("total_band_power_uv2", F.when(sum_all > 0, sum_all).otherwise(bad_total))
    step = step.withColumns(
        {
            **{f"relative_{n}_power": F.col(f"{n}_power_uv2") / F.col("total_band_power_uv2") for n in names},
            "_sum": _sum(F.transform("_bins", lambda b: b["p"])),
            "_peak": F.array_max(F.transform("_bins", lambda b: b["p"])),
        }
    )
    for a, b in zip(names[:-1], names[1:]):
        if (a, b) != ("alpha", "sigma") and (a, b) != ("sigma", "beta"):
            step = step.withColumn(f"{a}_{b}_ratio", safe_ratio(f"{a}_power_uv2", f"{b}_power_uv2"))
    step = step.withColumn("alpha_beta_ratio", safe_ratio("alpha_power_uv2", "beta_power_uv2")).withColumn(
        "sigma_beta_ratio", safe_ratio("sigma_power_uv2", "beta_power_uv2")
    )
    share = lambda b: b["p"] / F.col("_sum")
    surprise = _sum(
        F.transform("_bins", lambda b: F.when(b["p"] > 0, -share(b) * F.log2(share(b))).otherwise(F.lit(0.0)))
    )
    edge = F.aggregate(
        F.col("_bins"),
        F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("at")),
        lambda acc, b: F.struct(
            (acc["run"] + b["p"]).alias("run"),
            F.coalesce(
                acc["at"], F.when(acc["run"] + b["p"] >= F.lit(EDGE_FRACTION) * F.col("_sum"), b["f"])
            ).alias("at"),
        ),
        lambda acc: acc["at"],
    )
    step = step.withColumns(
        {
            "spectral_entropy": surprise / F.log2(F.size("_bins").cast("double")),
            "dominant_frequency_hz": F.filter("_bins", lambda b: b["p"] == F.col("_peak"))[0]["f"],
            "spectral_centroid_hz": _sum(F.transform("_bins", lambda b: b["f"] * b["p"])) / F.col("_sum"),
            "spectral_edge_frequency_95_hz": F.coalesce(edge, F.element_at("_bins", -1)["f"]),
        }
    )
    return step.drop("_bins", "_sum", "_peak")


def relative_sum_violations(df: DataFrame, bands: Sequence[str] = tuple(BANDS)) -> Column:
    total = F.lit(0.0)
    for b in bands:
        total = total + F.col(f"relative_{b}_power")
    return F.abs(total - 1.0) > F.lit(FLOAT_TOLERANCE)


def band_gain(n: int, fs: float, low: float = FILTER_LOW_HZ, high: float = FILTER_HIGH_HZ,
              order: int = FILTER_ORDER) -> np.ndarray:
    """Squared magnitude of the digital Butterworth band-pass at the rfft bins: both passes at once, away from the ends."""
    if high >= fs / 2:
        raise ValueError("high cutoff must be below the Nyquist frequency")
    f = np.arange(n // 2 + 1) * fs / n
    warped = np.tan(np.pi * f / fs)
    lo, hi = np.tan(np.pi * low / fs), np.tan(np.pi * high / fs)
    gain = np.zeros_like(f)
    inner = warped[1:]
    with np.errstate(over="ignore"):
        gain[1:] = 1.0 / (1.0 + ((inner**2 - lo * hi) / (inner * (hi - lo))) ** (2 * order))
    return gain
