"""Window validity, features, labels: golden values and boundaries."""

import pytest
from pyspark.sql import functions as F

from driftline.operators import labels as lab, matrix as mx, windows as w
from driftline.operators.ordered import lag_in_order  # noqa: F401

SAMPLES = "session_id string, timestamp long, capacitance_raw double, cap_quality string"
SESSIONS = ("session_id string, bag_id string, sensor_id string, baseline_value double, "
            "end_timestamp long")


def table(spark, samples, end, baseline=12.0, spec=w.WindowSpec(), session="s"):
    rows = spark.createDataFrame([(session, *s) for s in samples], SAMPLES)
    sessions = spark.createDataFrame([(session, "b", "n", baseline, end)], SESSIONS)
    return {r.window_index: r for r in w.feature_table(rows, sessions, spec).collect()}


def ramp(n, step=1000):
    return [(step * i, 12.0 + i, "OK") for i in range(n)]


def test_golden_features(spark):
    row = table(spark, ramp(121), 120_000)[0]
    assert row.sample_count == 120 and row.feature_valid
    assert (row.cap_delta_mean, row.cap_delta_last, row.cap_delta_slope_per_s,
            row.cap_delta_variance, row.cap_delta_range) == (60.5, 120.0, 1.0, 1199.916667, 119.0)


def test_no_window_before_the_session_is_long_enough(spark):
    assert table(spark, ramp(120), 119_999) == {}
    assert list(table(spark, ramp(121), 120_000)) == [0]


def test_empty_windows_survive(spark):
    got = table(spark, ramp(121), 300_000)
    assert sorted(got) == list(range(19))
    assert got[18].sample_count == 0 and got[18].exclusion_reason == "PARTIAL_WINDOW"
    assert got[1].sample_count == 110


@pytest.mark.parametrize("shift,valid", [(200, True), (201, False), (-200, True), (-201, False)])
def test_interval_tolerance_edges(spark, shift, valid):
    rows = [(t + (shift if t == 60_000 else 0), v, q) for t, v, q in ramp(121)]
    row = table(spark, rows, 120_000)[0]
    assert row.feature_valid == valid
    assert row.exclusion_reason == ("" if valid else "TIMING_OUT_OF_TOLERANCE")


def test_interval_across_pane_border_is_judged(spark):
    # 10 s panes: the sample at 10 s ends a pane, the next starts one.
    rows = [(t + (300 if t == 11_000 else 0), v, q) for t, v, q in ramp(121)]
    assert table(spark, rows, 120_000)[0].exclusion_reason == "TIMING_OUT_OF_TOLERANCE"


def test_interval_before_first_member_is_not_judged(spark):
    # The gap from 0 to 1.3 s belongs to no pair inside the window (0, 120 s].
    rows = [(t + (300 if t == 1000 else 0), v, q) for t, v, q in ramp(121)]
    rows[2] = (2200, rows[2][1], "OK")
    assert table(spark, rows, 120_000)[0].feature_valid


def test_reason_priority(spark):
    base = ramp(121)
    duplicated = base + [(50_000, 1.0, "DATA_GAP")]
    assert table(spark, duplicated, 120_000)[0].exclusion_reason == "DUPLICATE_TIMESTAMP"
    missing = [r for r in base if r[0] != 50_000]
    assert table(spark, missing, 120_000)[0].exclusion_reason == "PARTIAL_WINDOW"
    bad = [(t, v, "DISCONNECTED" if t == 50_000 else q) for t, v, q in base]
    row = table(spark, bad, 120_000)[0]
    assert row.exclusion_reason == "INVALID_CAP_QUALITY" and row.cap_delta_mean is None


def test_stride_not_dividing_window(spark):
    spec = w.WindowSpec(window=25_000, stride=10_000, expected=25)
    got = table(spark, ramp(60), 59_000, spec=spec)
    assert [got[k].sample_count for k in sorted(got)] == [25, 25, 25, 25]
    assert got[2].cap_delta_last == 45.0 and got[2].cap_delta_mean == 33.0


def test_large_level_keeps_variance(spark):
    rows = [(t, 1e9 + (t // 1000) % 2, "OK") for t, _, _ in ramp(121)]
    row = table(spark, rows, 120_000, baseline=1e9)[0]
    assert row.cap_delta_variance == 0.25


def test_membership_matches_counts(spark):
    rows = spark.createDataFrame([("s", *s) for s in ramp(150)], SAMPLES)
    sessions = spark.createDataFrame([("s", "b", "n", 12.0, 149_000)], SESSIONS)
    counts = {r.window_index: r["count"] for r in w.sliding_membership(
        rows, sessions, w.WindowSpec()).groupBy("window_index").count().collect()}
    assert counts == {0: 120, 1: 120, 2: 120}


def test_forbidden_feature_is_refused():
    from driftline.functions.rules import assert_features_allowed

    with pytest.raises(ValueError):
        assert_features_allowed(["cap_delta_mean", "lig_raw"])


# labels ---------------------------------------------------------------------------------

def test_time_to_event_boundaries(spark):
    taus = spark.createDataFrame([(190_000,), (180_000,), (90_000,), (30_000,)], "tau long")
    got = [r.c for r in taus.select(
        "tau", lab.time_to_event_class(F.col("tau"), lab.Boundary()).alias("c"))
        .orderBy(F.desc("tau")).collect()]
    assert got == [0, 1, 2, 3]


OUTCOME = ("session_id string, arm string, end_reason string, end_timestamp long, "
           "planned_horizon_s long, safe_anchor long, dataset_partition string")
EVENTS = "session_id string, timestamp long, event_type string, seq int"


def labelled(spark, arm, events, ends, horizon=None, end=1_000_000, reason="", end_reason="MANUAL_STOP"):
    outcomes = spark.createDataFrame(
        [("s", arm, end_reason, end, horizon, 0, "development")], OUTCOME)
    summary = lab.event_summary(spark.createDataFrame(
        [("s", ts, kind, i) for i, (ts, kind) in enumerate(events)], EVENTS))
    judged = lab.protocol_deviation(lab.horizon_completion(lab.session_outcomes(outcomes, summary)))
    faults = [r.fault for r in lab.malformed_events(judged).collect()]
    windows = spark.createDataFrame(
        [("s", i, e - 120_000, e, reason) for i, e in enumerate(ends)],
        "session_id string, window_index long, window_start long, window_end long, "
        "exclusion_reason string")
    rows = lab.label_windows(windows, judged, lab.Boundary()).orderBy("window_index").collect()
    return faults, [(r.risk_label or r.exclusion_reason) for r in rows], rows


def test_gradual_leak_labels(spark):
    events = [(100_000, lab.START), (400_000, lab.END), (500_000, lab.LEAK)]
    ends = [99_000, 310_000, 320_000, 410_000, 470_000, 500_000]
    faults, got, _ = labelled(spark, "LEAK_GRADUAL", events, ends)
    assert faults == []
    assert got == ["Safe", "Safe", "Monitor", "Caution", "Urgent", "POST_LEAK"]


def test_non_leaking_fill_and_deviation(spark):
    events = [(100_000, lab.START), (400_000, lab.END)]
    _, got, _ = labelled(spark, "LEAK_GRADUAL", events, [99_000, 300_000], horizon=600, end=1_000_000)
    assert got == ["Safe", "Safe"]
    _, got, _ = labelled(spark, "LEAK_GRADUAL", events, [99_000, 300_000], horizon=600, end=999_999)
    assert got == ["Safe", "CENSORED_NO_SAFE_HORIZON"]
    _, _, rows = labelled(spark, "LEAK_GRADUAL", [*events, (500_000, lab.LEAK)], [300_000], horizon=600)
    assert rows[0].protocol_deviation and rows[0].protocol_deviation_reason == "UNPLANNED_PHYSICAL_LEAK"


@pytest.mark.parametrize("arm,horizon,want", [
    ("SAFE", 1000, "Safe"), ("SAFE", 1001, "CENSORED_NO_SAFE_HORIZON"),
    ("SAFE", None, "CENSORED_NO_SAFE_HORIZON"), ("LEAK_SUDDEN", None, "SUDDEN_ARM"),
    ("FIELD", None, "FIELD_ARM_EXCLUDED")])
def test_arm_and_horizon(spark, arm, horizon, want):
    events = [(10, "ALERT_RAISED")] + ([(20, lab.LEAK)] if arm == "LEAK_SUDDEN" else [])
    assert labelled(spark, arm, events, [200_000], horizon)[1] == [want]


def test_structural_reason_comes_first(spark):
    assert labelled(spark, "LEAK_SUDDEN", [(20, lab.LEAK)], [200_000],
                    reason="PARTIAL_WINDOW")[1] == ["PARTIAL_WINDOW"]


@pytest.mark.parametrize("arm,events,fault", [
    ("LEAK_GRADUAL", [(1, lab.START), (2, lab.START), (3, lab.END)], "OVERLAPPING_INJECTION"),
    ("LEAK_GRADUAL", [(1, lab.END), (2, lab.START), (3, lab.END)], "END_WITHOUT_START"),
    ("LEAK_GRADUAL", [(1, lab.START)], "START_WITHOUT_END"),
    ("LEAK_GRADUAL", [(1, lab.START), (2, lab.END), (3, lab.LEAK), (4, lab.LEAK)], "SEVERAL_LEAKS"),
    ("LEAK_GRADUAL", [(1, lab.LEAK), (2, lab.START), (3, lab.END)], "LEAK_BEFORE_INJECTION"),
    ("SAFE", [(1, lab.START), (2, lab.END)], "SAFE_WITH_INJECTION"),
    ("SAFE", [(1, lab.LEAK)], "SAFE_WITH_LEAK"),
    ("LEAK_GRADUAL", [(1, "ALERT_RAISED")], "GRADUAL_WITHOUT_START")])
def test_malformed_events(spark, arm, events, fault):
    assert fault in labelled(spark, arm, events, [200_000])[0]


def test_start_sorts_before_end_at_equal_time(spark):
    assert labelled(spark, "LEAK_GRADUAL", [(5, lab.END), (5, lab.START)], [200_000])[0] == []


def test_sensor_values_do_not_change_labels(spark):
    from driftline.plans.pipelines import experiment

    sessions = spark.createDataFrame([("s", "b", "n", 12.0, 200_000)], SESSIONS)
    outcomes = lab.session_outcomes(
        spark.createDataFrame([("s", "LEAK_GRADUAL", "MANUAL_STOP", 200_000, None, 0, "development")],
                              OUTCOME),
        lab.event_summary(spark.createDataFrame(
            [("s", 1000, lab.START, 0), ("s", 150_000, lab.END, 1), ("s", 190_000, lab.LEAK, 2)],
            EVENTS)))

    def run(scale):
        rows = spark.createDataFrame(
            [("s", t, v * scale, q) for t, v, q in ramp(201)], SAMPLES)
        return experiment(rows, sessions, outcomes, w.WindowSpec(), lab.Boundary())

    first, second = run(1.0), run(-7.0)
    assert sorted(map(tuple, first.labels.collect())) == sorted(map(tuple, second.labels.collect()))
    assert first.matrix.count() == 7
    assert mx.reconcile_features(first.features).count() == 0
    assert mx.reconcile_labels(first.labels, lab.Boundary().version).count() == 0
    assert mx.validity_crosscheck(first.features, first.labels).count() == 0
