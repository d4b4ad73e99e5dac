import numpy as np
import pytest
from pyspark.sql import functions as F

from nightframe.operators import epochs as E
from nightframe.plans import legacy, recordings as R
from nightframe.schemas import EEG_CHANNEL, LEGACY_OUTPUT_COLUMNS, LEGACY_TABLE, MODEL_INPUT_COLUMNS, STAGES


def test_legacy_flow_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [
        (i % 3, i, i * 30.0, "EEG", *[float(v) for v in rng.random(9) + 0.1], (*STAGES, "N9")[i % 6], "raw") for i in range(60)
    ] + [(9, 99, 0.0, "EEG", *[1.0] * 5, -1.0, 1.0, 1.0, 1.0, "Wake", "raw")]
    df = spark.createDataFrame(rows, LEGACY_TABLE)
    out = legacy.model_ready(df)
    assert out.count() == 50 and tuple(out.columns[:23]) == LEGACY_OUTPUT_COLUMNS and out.columns[23:] == ["sleep_stage_raw"]
    m = out.agg(F.avg("delta_power").alias("m"), F.stddev_pop("delta_power").alias("s")).first()
    assert m.m == pytest.approx(0, abs=1e-12) and m.s == pytest.approx(1)
    r = legacy.reports(df)
    assert r["total_rows"].first().total_rows == 61 and r["sample_rows"].count() == 10
    assert r["stage_distribution"].first().epoch_count == 11


def test_signal_flow_end_to_end(spark):
    """Annotations and samples to the 35-column model input."""
    rng = np.random.default_rng(4)
    labels = ["Sleep stage W", "Sleep stage 1", "Sleep stage 2", "Sleep stage 3", "Sleep stage R"]
    an, chunks = [], []
    for s, rec in enumerate(["A", "B"]):
        for k in range(10):
            an.append((rec, s, 1, k * 30.0, 30.0, labels[k % 5]))
            chunks.append((rec, k, [float(v) for v in np.sin(np.arange(3000) * 0.05 * (k + 1)) * 20 + rng.normal(0, 3, 3000)]))
    annotations = spark.createDataFrame(an, "recording_id string, subject_id int, night int, onset double, duration double, label string")
    built = E.build_epochs(annotations, F.lit(300.0)).withColumns(
        {
            "sampling_frequency_hz": F.lit(100.0), "epoch_duration_sec": F.lit(30.0), "eeg_channel": F.lit(EEG_CHANNEL),
            "sleep_stage_raw": F.col("label"),
        }
    )
    signal = spark.createDataFrame(chunks, "recording_id string, chunk bigint, x array<double>")
    table = R.feature_table(built, R.epoch_features(signal, ["recording_id"], 100.0), 30.0)
    assert len(table.columns) == 54
    ready = R.model_input(table)
    assert tuple(ready.columns) == MODEL_INPUT_COLUMNS and ready.count() == 20
    assert R.load_model_input(ready) is ready
    with pytest.raises(ValueError, match="order"):
        R.load_model_input(ready.select(*reversed(ready.columns)))
    with pytest.raises(ValueError, match="scaled"):
        R.load_model_input(ready, scaled=True)
    with pytest.raises(ValueError, match="label_mapping"):
        R.load_model_input(ready.withColumn("sleep_stage", F.lit("REM")))
