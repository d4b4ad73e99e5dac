"""Domain constants and table contracts."""

from __future__ import annotations

from pyspark.sql import types as T

# They must equal the published ones for results to agree.
STAGES = ("Wake", "N1", "N2", "N3", "REM")
STAGE_CODES = {"Wake": 0, "N1": 1, "N2": 2, "N3": 3, "REM": 4}
HYPNOGRAM_LEVELS = {"N3": 0, "N2": 1, "N1": 2, "REM": 3, "Wake": 4}
ANNOTATION_STAGES = {
    "Sleep stage W": "Wake",
    "Sleep stage 1": "N1",
    "Sleep stage 2": "N2",
    "Sleep stage 3": "N3",
    "Sleep stage 4": "N3",
    "Sleep stage R": "REM",
}
IGNORED_ANNOTATIONS = ("Sleep stage ?", "Movement time")
SLEEP_LABEL_PREFIX = "Sleep stage"
EPOCH_SECONDS = 30
SAMPLING_HZ = 100.0
EEG_CHANNEL = "EEG Fpz-Cz"
WAKE_PADDING_MINUTES = 30
FILTER_LOW_HZ, FILTER_HIGH_HZ, FILTER_ORDER = 0.3, 35.0, 4
WELCH_SECONDS, WELCH_OVERLAP = 4.0, 0.5
BANDS = {
    "delta": (0.5, 4.0),
    "theta": (4.0, 8.0),
    "alpha": (8.0, 12.0),
    "sigma": (12.0, 16.0),
    "beta": (16.0, 30.0),
}
FLATLINE_STD_UV = 0.1
ARTIFACT_ABS_UV = 500.0
LEGACY_EPSILON = 1e-8
HIGH_CORRELATION = 0.995
RELATION_TOLERANCE = 1e-9
FLOAT_TOLERANCE = 1e-10
TIME_TOLERANCE = 1e-6
PROBABILITY_TOLERANCE = 1e-8
EDGE_FRACTION = 0.95
SIGNAL_FILE_PATTERN = r"^SC\d{4}[A-Z]\d-PSG\.edf$"
ANNOTATION_FILE_PATTERN = r"^SC\d{4}[A-Z]{2}-Hypnogram\.edf$"

IDENTIFIERS = ("subject_id", "recording_id", "night", "epoch_id")
TARGETS = ("sleep_stage", "sleep_stage_encoded")
QUALITY = ("quality_issue_flag",)

EPOCH_COLUMNS = (
    "subject_id", "night", "recording_id", "epoch_id", "start_time_sec", "end_time_sec",
    "start_sample", "stop_sample", "sampling_frequency_hz", "epoch_duration_sec",
    "eeg_channel", "sleep_stage_raw", "sleep_stage", "sleep_stage_encoded",
)
SIGNAL_QUALITY_COLUMNS = (
    "sample_count", "is_finite_signal", "flatline_flag", "amplitude_artifact_flag", "quality_issue_flag",
)
TIME_FEATURES = (
    "mean_uv", "std_uv", "median_uv", "min_uv", "max_uv", "rms_uv", "peak_to_peak_uv",
    "mean_square_uv2", "signal_energy_uv2", "zero_crossing_rate", "line_length_uv", "skewness",
    "kurtosis_excess", "hjorth_activity", "hjorth_mobility", "hjorth_complexity",
)
SPECTRAL_FEATURES = (
    "delta_power_uv2", "theta_power_uv2", "alpha_power_uv2", "sigma_power_uv2", "beta_power_uv2",
    "total_band_power_uv2", "relative_delta_power", "relative_theta_power", "relative_alpha_power",
    "relative_sigma_power", "relative_beta_power", "delta_theta_ratio", "theta_alpha_ratio",
    "alpha_beta_ratio", "sigma_beta_ratio", "spectral_entropy", "dominant_frequency_hz",
    "spectral_centroid_hz", "spectral_edge_frequency_95_hz",
)
FEATURES = TIME_FEATURES + SPECTRAL_FEATURES
# The features of the stage summary.
KEY_FEATURES = (
    "std_uv", "rms_uv", "peak_to_peak_uv", "total_band_power_uv2", "zero_crossing_rate", "line_length_uv",
    "hjorth_mobility", "hjorth_complexity", "relative_delta_power", "relative_theta_power", "relative_alpha_power",
    "relative_sigma_power", "relative_beta_power", "spectral_entropy", "dominant_frequency_hz",
    "spectral_centroid_hz", "spectral_edge_frequency_95_hz",
)
DROPPED_FEATURES = {
    "rms_uv": "follows from mean and variance",
    "mean_square_uv2": "square of rms_uv",
    "signal_energy_uv2": "mean square times sample count",
    "hjorth_activity": "signal variance",
    "total_band_power_uv2": "sum of the band powers",
    "relative_beta_power": "one minus the other relative powers",
    "delta_theta_ratio": "rank correlation above the limit",
}
SELECTED_FEATURES = tuple(f for f in FEATURES if f not in DROPPED_FEATURES)
MODEL_INPUT_COLUMNS = IDENTIFIERS + TARGETS + QUALITY + SELECTED_FEATURES

POWER_COLUMNS = ("delta_power", "theta_power", "alpha_power", "beta_power")
LEGACY_OUTPUT_COLUMNS = (
    "subject_id", "epoch_id", "start_time_sec", "eeg_channel", "mean", "std", "min", "max",
    "signal_energy", "log_signal_energy", "delta_power", "theta_power", "alpha_power", "beta_power",
    "total_power", "relative_delta_power", "relative_theta_power", "relative_alpha_power",
    "relative_beta_power", "delta_theta_ratio", "alpha_beta_ratio", "sleep_stage", "sleep_stage_encoded",
)
LEGACY_SCALED_COLUMNS = (
    "mean", "std", "min", "max", "signal_energy", "log_signal_energy", "delta_power", "theta_power",
    "alpha_power", "beta_power", "total_power", "relative_delta_power", "relative_theta_power",
    "relative_alpha_power", "relative_beta_power", "delta_theta_ratio", "alpha_beta_ratio",
)
PROBABILITY_COLUMNS = tuple(f"probability_{s.lower()}" for s in STAGES)
PREDICTION_COLUMNS = IDENTIFIERS + (
    "predicted_label_encoded", "predicted_label", "probability_argmax_label_encoded",
    "probability_argmax_label", "predict_probability_argmax_agree", "prediction_confidence",
    "prediction_margin", "prediction_entropy", "prediction_normalized_entropy",
) + PROBABILITY_COLUMNS
TRUTH_COLUMNS = ("true_label_encoded", "true_label", "is_correct")
METRICS = (
    "macro_f1", "balanced_accuracy", "weighted_f1", "accuracy", "cohen_kappa", "multiclass_log_loss",
)

LEGACY_TABLE = T.StructType(
    [
        T.StructField("subject_id", T.LongType()),
        T.StructField("epoch_id", T.LongType()),
        T.StructField("start_time_sec", T.DoubleType()),
        T.StructField("eeg_channel", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in ("mean", "std", "min", "max", "signal_energy", *POWER_COLUMNS)],
        T.StructField("sleep_stage", T.StringType()),
        T.StructField("sleep_stage_raw", T.StringType()),
    ]
)
