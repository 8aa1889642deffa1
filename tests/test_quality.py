"""Quality gate on small sessions: golden values, edges, and statuses."""

import pytest

from driftline import contract
from driftline.operators import qc
from driftline.plans.pipelines import quality_gate

CONFIG = qc.QcConfig(block_rows=50, block_ms=20_000)
SAMPLE = ("seq long, session_id string, timestamp long, capacitance_raw double, cap_quality string, "
          "lig_quality string, system_quality string, activity_state string, "
          "orientation_position string")
SESSION = ("session_id string, arm string, bag_id string, sensor_id string, device_id string, "
           "fluid_type string, operator_id string, baseline_value double, baseline_std double, "
           "start_timestamp long, end_timestamp long, end_reason string, model_version string, "
           "firmware_version string, session_order long")
EVENT = "seq long, event_id string, session_id string, timestamp long, event_type string, event_metadata string"
PLAN = ", ".join(f"{name} string" for name in contract.PROTOCOL_FIELDS)


def session(arm="LEAK_GRADUAL", end=300_000, reason="MANUAL_STOP", **kw):
    row = dict(session_id="s", arm=arm, bag_id="b", sensor_id="n", device_id="d", fluid_type="saline",
               operator_id="o", baseline_value=29.5, baseline_std=17.318102, start_timestamp=0,
               end_timestamp=end, end_reason=reason, model_version="", firmware_version="f",
               session_order=0)
    row.update(kw)
    return row


def samples(n=301, at=None):
    """(timestamp, value, cap, lig, system) at 1 Hz; ``at`` overrides single rows."""
    rows = [[1000 * i, float(i % 60), "OK", "OK", "NORMAL"] for i in range(n)]
    for i, (ts, cap, system) in (at or {}).items():
        rows[i][0], rows[i][2], rows[i][4] = ts, cap, system
    return rows


def plan(**kw):
    row = dict(session_id="s", protocol_version="v0.1-a", planned_arm="LEAK_GRADUAL",
               planned_safe_horizon_s="", target_fill_or_volume="250ml", injection_profile="stepwise",
               injection_method="pump", planned_flow_ml_min="", physical_leak_observation_method="eye",
               operator_id="o", bag_id="b", sensor_id="n", device_id="d")
    row.update(kw)
    return row


GOOD = [(130_000, "INJECTION_START"), (200_000, "INJECTION_END"), (250_000, "PHYSICAL_LEAK_OBSERVED"),
        (251_000, "LEAK_FLAG_FIRST"), (252_000, "LEAK_FLAG_CONFIRMED")]


def case(sess=None, rows=None, events=GOOD, plan_row=None):
    return sess or session(), samples() if rows is None else rows, events, plan_row or plan()


# One session per case; the whole gate runs once.
CASES = {
    "clean": case(),
    "declared_baseline": case(session(baseline_value=99.0)),
    "dry_120": case(events=[(120_000, "INJECTION_START"), *GOOD[1:]]),
    "dry_119": case(events=[(119_000, "INJECTION_START"), *GOOD[1:]]),
    "jitter_200": case(rows=samples(at={150: (150_200, "OK", "NORMAL")})),
    "jitter_201": case(rows=samples(at={150: (150_201, "OK", "NORMAL")})),
    "timing": case(rows=samples(at={150: (149_000, "OK", "NORMAL"), 200: (190_500, "OK", "NORMAL"),
                                    250: (252_500, "OK", "NORMAL")})),
    "marked_gap": case(rows=[r for i, r in enumerate(samples(
        at={203: (203_000, "DATA_GAP", "ML_UNAVAILABLE")})) if i not in (201, 202)]),
    "bounds": case(session(end=299_000), samples(at={100: (100_000, "OK", "UNSAFE")})),
    "overlap": case(events=GOOD[:1] + [(140_000, "INJECTION_START")] + GOOD[1:]),
    "no_leak": case(events=GOOD[:2]),
    "no_flags": case(events=GOOD[:3]),
    "two_leaks": case(events=GOOD + [(260_000, "PHYSICAL_LEAK_OBSERVED")]),
    "restart": case(events=GOOD + [(260_000, "DEVICE_RESTART")]),
    "unplanned": case(plan_row=plan(planned_safe_horizon_s="60")),
    "plan_version": case(plan_row=plan(protocol_version="v0.1")),
    "plan_arm": case(plan_row=plan(planned_arm="SAFE")),
    "plan_bag": case(plan_row=plan(bag_id="other")),
    "plan_flow": case(plan_row=plan(planned_flow_ml_min="-1")),
    "plan_absent": case(plan_row=plan(session_id="nobody")),
    "no_samples": case(rows=[]),
    "safe_injected": case(session(arm="SAFE"), plan_row=plan(
        planned_arm="SAFE", planned_safe_horizon_s="60", injection_profile="", injection_method="")),
    "field": case(session(arm="FIELD"), plan_row=plan(planned_arm="FIELD")),
    "confirmed_without_leak": case(session(reason="LEAK_CONFIRMED"), events=GOOD[:2]),
    "bad_id": case(session(operator_id="")),
}


def run_gate(spark, names, with_plan):
    sessions, rows, events, plans = [], [], [], []
    for name in names:
        sess, samples_, events_, plan_ = CASES[name]
        sessions.append(tuple({**sess, "session_id": name}.values()))
        rows += [(i, name, *r, "", "") for i, r in enumerate(samples_)]
        events += [(i, f"{name}-{i}", name, ts, kind, "{}") for i, (ts, kind) in enumerate(events_)]
        owner = name if plan_["session_id"] == "s" else plan_["session_id"]
        plans.append(tuple({**plan_, "session_id": owner}.values()))
    built = quality_gate(
        spark.createDataFrame(sessions, SESSION), spark.createDataFrame(rows, SAMPLE),
        spark.createDataFrame(events, EVENT), CONFIG,
        spark.createDataFrame(plans, PLAN) if with_plan else None)
    codes = {name: set() for name in [*names, ""]}
    for issue in built.issues.collect():
        codes.setdefault(issue.session_id, set()).add(issue.code)
    return {r.session_id: r for r in built.report.collect()}, codes


@pytest.fixture(scope="module")
def gate(spark):
    return run_gate(spark, CASES, True)


@pytest.mark.parametrize("name,codes", [
    ("clean", set()), ("declared_baseline", set()), ("dry_120", set()), ("jitter_200", set()),
    ("dry_119", {"PREINJECTION_DRY_TOO_SHORT"}), ("jitter_201", {"INTERVAL_OUT_OF_TOLERANCE"}),
    ("overlap", {"MALFORMED_REQUIRED_EVENTS"}), ("no_leak", {"MISSING_REQUIRED_EVENT"}),
    ("no_flags", {"MISSING_LIG_FLAG_EVENT"}), ("two_leaks", {"MALFORMED_REQUIRED_EVENTS"}),
    ("restart", {"DEVICE_RESTART_DURING_SESSION"}), ("unplanned", {"UNPLANNED_PHYSICAL_LEAK"}),
    ("marked_gap", {"INTERVAL_OUT_OF_TOLERANCE"}),
    ("bounds", {"SYSTEM_QUALITY_MISMATCH", "SAMPLE_OUTSIDE_SESSION"}),
    ("plan_version", {"INVALID_PROTOCOL_MANIFEST"}), ("plan_flow", {"INVALID_PROTOCOL_MANIFEST"}),
    ("plan_arm", {"MANIFEST_ARM_MISMATCH"}), ("plan_bag", {"MANIFEST_ID_MISMATCH"}),
    ("plan_absent", {"MANIFEST_ID_MISMATCH"}),
    ("no_samples", {"NO_SAMPLES", "BASELINE_WINDOW_INCOMPLETE", "PREINJECTION_DRY_TOO_SHORT"}),
    ("safe_injected", {"MALFORMED_REQUIRED_EVENTS", "UNEXPECTED_PHYSICAL_LEAK_SAFE"}),
    ("field", {"FIELD_ARM_NOT_SUPPORTED"}),
    ("confirmed_without_leak", {"MALFORMED_REQUIRED_EVENTS"}),
    ("bad_id", {"INVALID_RECORD", "MANIFEST_ID_MISMATCH"})])
def test_issue_codes(gate, name, codes):
    assert gate[1][name] == codes


def test_golden_report_row(gate):
    row = gate[0]["clean"]
    assert row.overall_status == "PASS" and row.sample_count == 301
    assert row.baseline_recomputed_median == 29.5 and row.baseline_recomputed_std == 17.318102
    assert row.baseline_value_abs_diff == 0.0 and row.pre_injection_dry_s == 130.0
    assert gate[0]["declared_baseline"].baseline_value_abs_diff == 69.5


def test_timing_counts(gate):
    row = gate[0]["timing"]
    assert row.duplicate_timestamp_count == 1 and row.out_of_order_interval_count == 2
    assert {"DUPLICATE_SAMPLE_TIMESTAMP", "TIMESTAMP_OUT_OF_ORDER",
            "UNMARKED_DATA_GAP"} <= gate[1]["timing"]


def test_statuses(gate):
    assert gate[0]["unplanned"].overall_status == "PASS"
    assert gate[0]["plan_bag"].protocol_status == "FAIL"
    assert gate[0]["bounds"].contract_status == "FAIL"
    assert gate[0]["no_samples"].sample_count == 0


def test_without_plan_is_partial(spark):
    report, codes = run_gate(spark, ["clean"], False)
    assert report["clean"].overall_status == "PARTIAL"
    assert report["clean"].protocol_status == "NOT_EVALUATED"
    assert codes[""] == {"PROTOCOL_MANIFEST_NOT_PROVIDED"}


def test_rows_of_unknown_and_repeated_sessions_are_rejects(spark):
    sess, samples_, events_, plan_ = CASES["clean"]
    names = ["known", "twice", "twice"]
    sessions = [tuple({**sess, "session_id": n}.values()) for n in names]
    rows = [(i, n, *r, "", "") for n in ("known", "twice", "ghost") for i, r in enumerate(samples_)]
    events = [(i, f"{n}-{i}", n, ts, kind, "{}") for n in ("known", "twice", "spirit")
              for i, (ts, kind) in enumerate(events_)]
    plans = [tuple({**plan_, "session_id": n}.values()) for n in ("known", "twice", "shade")]
    built = quality_gate(
        spark.createDataFrame(sessions, SESSION), spark.createDataFrame(rows, SAMPLE),
        spark.createDataFrame(events, EVENT), CONFIG, spark.createDataFrame(plans, PLAN))
    assert {(r.source, r.session_id, r.problem, r.row_count) for r in built.rejects.collect()} == {
        ("sessions", "twice", "REPEATED_SESSION", 2),
        ("samples", "ghost", "UNKNOWN_SESSION", len(samples_)),
        ("events", "spirit", "UNKNOWN_SESSION", len(events_)),
        ("plan", "shade", "UNKNOWN_SESSION", 1)}
    assert {r.session_id: r.overall_status for r in built.report.collect()} == {
        "known": "PASS", "twice": "FAIL"}
    named = {(r.session_id, r.code) for r in built.issues.collect()}
    assert named == {("twice", "REPEATED_SESSION"), ("ghost", "UNKNOWN_SESSION"),
                     ("spirit", "UNKNOWN_SESSION"), ("shade", "UNKNOWN_SESSION")}


def test_gate_reads_events_once_and_collapses_equal_issues(spark, tmp_path):
    """The status is built from stored events, not from the events' files, and from issues per kind."""
    rows = [dict(seq=i, event_id=f"e{i // 2}", session_id="s", timestamp=1000 * i,
                 event_type="DEVICE_RESTART", event_metadata="{}") for i in range(6)]
    folder = str(tmp_path / "happened")
    spark.createDataFrame(rows, EVENT).write.parquet(folder)
    sample_rows = [dict(zip(SAMPLE_NAMES, (i, "s", ts, value, cap, lig, system, "sit", "front")))
                   for i, (ts, value, cap, lig, system) in enumerate(samples(60))]
    built = quality_gate(
        spark.createDataFrame([session()], SESSION), spark.createDataFrame(sample_rows, SAMPLE),
        spark.read.parquet(folder), CONFIG, spark.createDataFrame([plan()], PLAN))
    assert "happened" not in built.status._jdf.queryExecution().toString()
    found = built.status.first()
    codes = [r.code for r in built.issues.filter("session_id = 's'").collect()]
    assert codes.count("DUPLICATE_EVENT_ID") == 3
    assert found.error_count + found.warning_count == len(codes)
    assert found.issue_codes == "|".join(sorted(set(codes)))


SAMPLE_NAMES = [field.split()[0] for field in SAMPLE.split(", ")]
