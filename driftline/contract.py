"""Data contract: table schemas, vocabularies and default settings."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data contract ------------------------------------------------

ARMS = ("LEAK_GRADUAL", "SAFE", "LEAK_SUDDEN", "FIELD")
END_REASONS = ("CEILING_REACHED", "LEAK_CONFIRMED", "MANUAL_STOP")
CHANNEL_QUALITIES = (
    "OK", "DISCONNECTED", "ADC_SATURATED", "BASELINE_INVALID", "DATA_GAP", "WARMING_UP",
)
SYSTEM_QUALITIES = (
    "INITIALIZING", "NORMAL", "ML_UNAVAILABLE", "FAILSAFE_DEGRADED", "UNSAFE",
)
EVENT_TYPES = (
    "INJECTION_START", "INJECTION_END", "PHYSICAL_LEAK_OBSERVED", "LEAK_FLAG_FIRST",
    "LEAK_FLAG_CONFIRMED", "LIG_CALIBRATION_STARTED", "LIG_CALIBRATION_PASSED",
    "LIG_CALIBRATION_FAILED", "BAG_EMPTIED_LOGGED", "ALERT_RAISED", "ALERT_ACKNOWLEDGED",
    "ALERT_IGNORED", "MANUAL_SESSION_RESET", "DEVICE_RESTART",
)
CLASS_NAMES = ("Safe", "Monitor", "Caution", "Urgent")
PARTITIONS = ("development", "validation", "final_test")
STRUCTURAL_REASONS = (
    "DUPLICATE_TIMESTAMP", "PARTIAL_WINDOW", "TIMING_OUT_OF_TOLERANCE", "INVALID_CAP_QUALITY",
)
ARM_REASONS = ("SUDDEN_ARM", "FIELD_ARM_EXCLUDED")
SCENARIO_REASONS = ("CENSORED_NO_SAFE_HORIZON", "POST_LEAK")
EXCLUSION_REASONS = STRUCTURAL_REASONS + ARM_REASONS + SCENARIO_REASONS
FEATURE_COLUMNS = (
    "cap_delta_mean", "cap_delta_last", "cap_delta_slope_per_s", "cap_delta_variance",
    "cap_delta_range",
)
INJECTION_PROFILES = ("stepwise", "continuous")
INJECTION_METHODS = ("manual_syringe", "pump")
PROTOCOL_VERSION_PATTERN = r"^v0\.1-[A-Za-z0-9][A-Za-z0-9._-]*$"
SHA256_PATTERN = r"^[0-9a-f]{64}$"
MAX_RAW_READING = 4294967295
RULEBOOK_VERSION = "v0.3"
MODEL_ARTIFACT_VERSION = "0.1.0"
FORBIDDEN_FEATURES = (
    "arm", "b1", "b2", "b3", "bag_id", "boundary_config_version", "cap_quality",
    "capacitance_raw", "cumulative_volume_ml", "dataset_partition", "delivered_volume_ml",
    "device_id", "end_reason", "end_timestamp", "event_id", "event_metadata", "event_type",
    "exclusion_reason", "feature_valid", "firmware_version", "fluid_type", "injection_end",
    "injection_start", "injection_volume_ml_per_step", "kind", "label_valid",
    "leak_flag_confirmed", "leak_flag_first", "lig_calibration_failed",
    "lig_calibration_passed", "lig_calibration_started", "lig_quality", "lig_raw",
    "measured_flow_ml_min", "model_version", "operator_id", "physical_leak_observed",
    "protocol_deviation", "protocol_deviation_reason", "risk_label", "risk_label_index",
    "rulebook_version", "sample_count", "scenario_id", "sensor_id", "session_id",
    "start_timestamp", "system_quality", "t_confirm", "t_flag", "t_physical_leak",
    "target_flow_ml_min", "tau", "time_remaining", "time_since_empty", "timestamp",
    "window_end", "window_id", "window_index", "window_start",
)

# Table schemas ----------------------------------------------------------------------

SESSION_FIELDS = (
    "session_id", "arm", "bag_id", "sensor_id", "device_id", "fluid_type", "operator_id",
    "baseline_value", "baseline_std", "start_timestamp", "end_timestamp", "end_reason",
    "model_version", "firmware_version",
)
SAMPLE_FIELDS = (
    "timestamp", "session_id", "capacitance_raw", "lig_raw", "cap_quality", "lig_quality",
    "system_quality", "activity_state", "orientation_position",
)
EVENT_FIELDS = ("event_id", "session_id", "timestamp", "event_type", "event_metadata")
PROTOCOL_FIELDS = (
    "session_id", "protocol_version", "planned_arm", "planned_safe_horizon_s",
    "target_fill_or_volume", "injection_profile", "injection_method", "planned_flow_ml_min",
    "physical_leak_observation_method", "operator_id", "bag_id", "sensor_id", "device_id",
)
PARTITION_FIELDS = (
    "session_id", "dataset_partition", "partition_version", "bag_id", "sensor_id",
)
LOGGER_CHANNELS = ("Res_15", "Res_16", "Kap_4", "Kap_5", "Kap_7")
LOGGER_FIELDS = ("sample_no", "elapsed_ms") + tuple(
    name for channel in LOGGER_CHANNELS for name in (channel, f"{channel}_status")
)
REQUEST_FIELDS = (
    "request_version", "device_id", "session_id", "acquisition_id", "operator_confirmed",
    "source_window_end_ms", "baseline_samples", "window_samples",
)

REQUEST_SAMPLE = T.StructType([
    T.StructField("sample_no", T.LongType()),
    T.StructField("elapsed_ms", T.LongType()),
    T.StructField("kap_7_raw", T.DoubleType()),
    T.StructField("kap_7_status", T.StringType()),
])
REQUEST_SCHEMA = T.StructType([
    T.StructField("request_version", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("acquisition_id", T.StringType()),
    T.StructField("operator_confirmed", T.BooleanType()),
    T.StructField("source_window_end_ms", T.LongType()),
    T.StructField("baseline_samples", T.ArrayType(REQUEST_SAMPLE)),
    T.StructField("window_samples", T.ArrayType(REQUEST_SAMPLE)),
])


def text_schema(fields) -> T.StructType:
    """All-string schema: contract files are validated before they are typed."""
    return T.StructType([T.StructField(name, T.StringType()) for name in fields])
