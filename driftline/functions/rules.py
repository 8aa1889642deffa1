"""Record rules: each returns a boolean, or an array naming the broken rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from driftline import contract
from driftline.functions.parsing import is_finite


def _fails(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def csv_safe_id(value: Column, optional: bool = False) -> Column:
    safe = F.coalesce((value != "") & ~value.rlike(r"[,\r\n]"), F.lit(False))
    return safe | (value == "") if optional else safe


def in_vocabulary(value: Column, vocabulary) -> Column:
    return F.coalesce(value.isin(*vocabulary), F.lit(False))


def reading_in_range(value: Column, status: Column, maximum: float = contract.MAX_RAW_READING) -> Column:
    return is_finite(value) & value.between(0, maximum) & F.coalesce(status != "", F.lit(False))


def system_quality(cap: Column, lig: Column) -> Column:
    """Five system states from two channel states; warming up dominates."""
    ok_cap, ok_lig = cap == "OK", lig == "OK"
    return (
        F.when((cap == "WARMING_UP") | (lig == "WARMING_UP"), "INITIALIZING")
        .when(ok_cap & ok_lig, "NORMAL")
        .when(ok_lig, "ML_UNAVAILABLE")
        .when(ok_cap, "FAILSAFE_DEGRADED")
        .otherwise("UNSAFE")
    )


def ml_available(cap: Column, lig: Column) -> Column:
    return (cap == "OK") & (lig != "WARMING_UP")


def direct_detection_available(lig: Column) -> Column:
    return lig == "OK"


def broken_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition (true = broken) holds, in order."""
    flags = [F.when(_fails(broken), F.lit(name)) for name, broken in rules.items()]
    return F.array_compact(F.array(*flags))


def session_rules(c=F.col) -> dict[str, Column]:
    rules = {
        f"{name}": ~csv_safe_id(c(name))
        for name in ("session_id", "bag_id", "sensor_id", "device_id", "fluid_type",
                     "operator_id", "firmware_version")
    }
    rules["model_version"] = ~csv_safe_id(c("model_version"), optional=True)
    rules["arm"] = ~in_vocabulary(c("arm"), contract.ARMS)
    rules["end_reason"] = ~in_vocabulary(c("end_reason"), contract.END_REASONS)
    rules["baseline_value"] = ~is_finite(c("baseline_value"))
    rules["baseline_std"] = ~is_finite(c("baseline_std")) | (c("baseline_std") < 0)
    rules["negative_timestamp"] = (c("start_timestamp") < 0) | (c("end_timestamp") < 0)
    rules["end_before_start"] = c("end_timestamp") < c("start_timestamp")
    return rules


def sample_rules(c=F.col) -> dict[str, Column]:
    return {
        "timestamp": c("timestamp").isNull() | (c("timestamp") < 0),
        "session_id": ~csv_safe_id(c("session_id")),
        "capacitance_raw": ~is_finite(c("capacitance_raw")),
        "lig_raw": ~is_finite(c("lig_raw")),
        "cap_quality": ~in_vocabulary(c("cap_quality"), contract.CHANNEL_QUALITIES),
        "lig_quality": ~in_vocabulary(c("lig_quality"), contract.CHANNEL_QUALITIES),
        "activity_state": ~csv_safe_id(c("activity_state"), optional=True),
        "orientation_position": ~csv_safe_id(c("orientation_position"), optional=True),
        "system_quality": c("system_quality") != system_quality(c("cap_quality"), c("lig_quality")),
    }


def event_rules(c=F.col) -> dict[str, Column]:
    from driftline.functions.parsing import json_object_is_finite

    return {
        "event_id": ~csv_safe_id(c("event_id")),
        "session_id": ~csv_safe_id(c("session_id")),
        "timestamp": c("timestamp").isNull() | (c("timestamp") < 0),
        "event_type": ~in_vocabulary(c("event_type"), contract.EVENT_TYPES),
        "event_metadata": ~json_object_is_finite(c("event_metadata")),
    }


def window_id(session: Column, index: Column, infix: str = "-win-") -> Column:
    return F.format_string(f"%s{infix}%04d", session, index)


def assert_features_allowed(columns, forbidden=contract.FORBIDDEN_FEATURES) -> None:
    leaked = sorted(set(columns) & set(forbidden))
    if leaked:
        raise ValueError(f"columns may not be model features: {leaked}")


# Published prediction rows ------------------------------------------------------------
# Fixed values of the published-output contract, one entry per state.  The warning
# sentence of each state is deployment text and is passed in by the caller.

OUTPUT_STATES = {
    "UNAVAILABLE": {
        "mode": "LIVE", "data_source": "NONE", "model_status": "UNAVAILABLE",
        "model_input_channel": None, "model_artifact_version": None,
        "evidence_scope": "NO_PREDICTION",
    },
    "TEST": {
        "mode": "ENGINEERING_TEST", "data_source": "SYNTHETIC_FIXTURE",
        "model_status": "TEST_ONLY", "model_input_channel": "SYNTHETIC_CAPACITIVE",
        "model_artifact_version": contract.MODEL_ARTIFACT_VERSION,
        "evidence_scope": "PIPELINE_MECHANICS_ONLY",
    },
    "UNVALIDATED": {
        "mode": "LIVE_EXPERIMENTAL", "data_source": "REAL_SENSOR",
        "model_status": "UNVALIDATED", "model_input_channel": "Kap_7",
        "model_artifact_version": contract.MODEL_ARTIFACT_VERSION,
        "evidence_scope": "EXPERIMENTAL_UNVALIDATED",
    },
}


def output_state_rules(c=F.col, warnings: dict[str, str] | None = None) -> dict[str, Column]:
    """Rules of a published prediction row.

    The mode decides the state; every other column must equal that state's
    value, and class name and index must agree.  ``warnings`` optionally fixes
    the warning sentence per state.
    """
    unavailable = ~c("prediction_available")
    state = (
        F.when(unavailable, "UNAVAILABLE")
        .when(c("mode") == "ENGINEERING_TEST", "TEST")
        .when(c("mode") == "LIVE_EXPERIMENTAL", "UNVALIDATED")
    )
    rules: dict[str, Column] = {"mode": state.isNull()}
    fields = [name for name in OUTPUT_STATES["TEST"]]
    for field in fields:
        expected = F.lit(None).cast("string")
        for name, values in OUTPUT_STATES.items():
            expected = F.when(state == name, F.lit(values[field])).otherwise(expected)
        broken = state.isNotNull() & ~c(field).eqNullSafe(expected)
        rules[field] = rules[field] | broken if field in rules else broken
    rules["warning"] = c("warning").isNull() | (F.trim(c("warning")) == "")
    for name, sentence in (warnings or {}).items():
        rules["warning"] = rules["warning"] | ((state == name) & (c("warning") != sentence))
    names = F.array(*[F.lit(name) for name in contract.CLASS_NAMES])
    index = F.array_position(names, c("risk_class")) - 1
    rules["risk_class"] = F.when(unavailable, c("risk_class").isNotNull()).otherwise(
        ~in_vocabulary(c("risk_class"), contract.CLASS_NAMES))
    rules["risk_class_index"] = F.when(unavailable, c("risk_class_index").isNotNull()).otherwise(
        ~c("risk_class_index").eqNullSafe(index))
    end = c("source_window_end_ms")
    rules["source_window_end_ms"] = F.when(unavailable, end.isNotNull()).otherwise(
        end.isNull() | (end < 0))
    digest = c("model_artifact_sha256")
    rules["model_artifact_sha256"] = F.when(unavailable, digest.isNotNull()).otherwise(
        ~F.coalesce(digest.rlike(contract.SHA256_PATTERN), F.lit(False)))
    return rules


def feature_vector_rules(c=F.col, *, data_source: str = "REAL_SENSOR", channel: str = "Kap_7",
                         basis: str = "RAW_MINUS_SESSION_BASELINE",
                         order=contract.FEATURE_COLUMNS) -> dict[str, Column]:
    """Rules of a feature document: version, source, channel, basis, order, finite values."""
    values = c("features")
    return {
        "feature_input_version": ~c("feature_input_version").eqNullSafe("0.1.0"),
        "data_source": ~c("data_source").eqNullSafe(data_source),
        "model_input_channel": ~c("model_input_channel").eqNullSafe(channel),
        "feature_basis": ~c("feature_basis").eqNullSafe(basis),
        "feature_order": ~c("feature_order").eqNullSafe(F.array(*[F.lit(n) for n in order])),
        "source_window_end_ms": c("source_window_end_ms").isNull() | (c("source_window_end_ms") < 0),
        "features": values.isNull() | (F.size(values) != len(order))
                    | ~F.forall(values, is_finite),
    }
