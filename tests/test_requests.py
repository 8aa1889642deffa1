"""Window requests: golden response, availability order, malformed requests."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from driftline.functions.ordinal import ENGINEERING_MODEL
from driftline.operators import requests as rq

SHA = "a" * 64


def readings(start_s, seconds):
    return [{"sample_no": 10 * s + j, "elapsed_ms": 1000 * s + 100 * j,
             "kap_7_raw": 999999.0 if j == 9 else 1000.0 + s, "kap_7_status": "OK"}
            for s in range(start_s, start_s + seconds) for j in range(10)]


def request(end=120_000, **kw):
    body = {"request_version": "0.1.0", "device_id": "d", "session_id": "s", "acquisition_id": "a",
            "operator_confirmed": True, "source_window_end_ms": end,
            "baseline_samples": readings(0, 60),
            "window_samples": readings(max(0, end // 1000 - 120), 120)}
    body.update(kw)
    return body


def window_with(**kw):
    rows = readings(0, 120)
    rows[700] = {**rows[700], **kw}
    return rows


def swapped():
    rows = readings(0, 120)
    rows[700], rows[701] = rows[701], rows[700]
    return rows


CASES = {
    "ready": (request(), "READY", None),
    "later": (request(end=300_000), "READY", None),
    "unconfirmed": (request(operator_confirmed=False), "OPERATOR_CONFIRMATION_REQUIRED", None),
    "baseline": (request(end=30_000), "COLLECTING_BASELINE", None),
    "window": (request(end=60_000), "COLLECTING_WINDOW", None),
    "short_baseline": (request(baseline_samples=readings(0, 59)), "BASELINE_INCOMPLETE_DATA", None),
    "duplicate": (request(window_samples=window_with(sample_no=699)), "DUPLICATE_SAMPLE", None),
    "disorder": (request(window_samples=swapped()), "OUT_OF_ORDER", None),
    "gap": (request(window_samples=readings(0, 70) + [
        {**r, "sample_no": r["sample_no"] + 1} for r in readings(70, 50)]), "DATA_GAP", None),
    "timing": (request(window_samples=window_with(elapsed_ms=70_021)), "TIMING_OUT_OF_TOLERANCE", None),
    "sensor": (request(window_samples=window_with(kap_7_status="DISCONNECTED")), "SENSOR_PROBLEM", None),
    "operator": (request(window_samples=window_with(kap_7_status="NOT_EVALUATED")), "READY", None),
    "alignment": (request(end=120_001), None, "WINDOW_ALIGNMENT"),
    "reading": (request(window_samples=window_with(kap_7_raw=-1.0)), None, "WINDOW_SAMPLES"),
    "outside": (request(end=130_000, window_samples=readings(0, 120)), None, "SAMPLE_OUT_OF_RANGE"),
    "conflict": (request(baseline_samples=[{**r, "kap_7_raw": 7.0} if i == 5 else r for i, r in
                                           enumerate(readings(0, 60))]), None, "OVERLAP_CONFLICT"),
    "version": (request(request_version="0.2.0"), None, "REQUEST_VERSION"),
    "blank_id": (request(device_id=" "), None, "DEVICE_ID"),
}


@pytest.fixture(scope="module")
def responses(spark):
    df = spark.createDataFrame(
        [(name, json.dumps(body)) for name, (body, _, _) in CASES.items()], "name string, body string")
    parsed = rq.parse_window_request(df.repartition(8))
    return {r["name"]: r for r in rq.evaluate_window_requests(
        parsed, ENGINEERING_MODEL, SHA).collect()}


@pytest.mark.parametrize("name", CASES)
def test_availability(responses, name):
    _, reason, problem = CASES[name]
    row = responses[name]
    assert row.parse_problem is None
    assert (row.availability_reason, row.problem) == (reason, problem)
    assert row.prediction_available == (None if problem else reason == "READY")
    assert (row.risk_class is None) == (reason != "READY")


def test_golden_response(responses):
    row = responses["ready"]
    assert row.baseline_value == 1029.5
    assert (row.cap_delta_mean, row.cap_delta_last, row.cap_delta_slope_per_s, row.cap_delta_variance,
            row.cap_delta_range) == (30.0, 89.5, 1.0, 1199.916667, 119.0)
    assert row.quality_verification == "AUTOMATIC" and row.mode == "LIVE_EXPERIMENTAL"
    assert row.model_artifact_sha256 == SHA and row.risk_class == "Urgent"
    assert responses["operator"].quality_verification == "OPERATOR_ONLY"
    assert responses["baseline"].quality_verification == "UNKNOWN"
    assert responses["baseline"].evidence_scope == "NO_PREDICTION"


def test_extra_fields_are_rejected(spark):
    extra = {**request(), "note": 1}
    sample = request()
    sample["window_samples"] = window_with(extra=1)
    df = spark.createDataFrame([(0, json.dumps(extra)), (1, json.dumps(sample)), (2, "[1]")],
                               "i int, body string")
    got = [r.parse_problem for r in rq.parse_window_request(df).orderBy("i").collect()]
    assert got == ["REQUEST_FIELDS", "SAMPLE_FIELDS", "NOT_AN_OBJECT"]


def test_published_rows_follow_the_state_table(spark, responses):
    from pyspark.sql import functions as F

    from driftline.functions.rules import output_state_rules
    from driftline.operators.integrity import violations

    rows = [(r["name"], r.prediction_available, r.mode, r.data_source, r.model_status,
             r.model_input_channel, r.model_artifact_version, r.evidence_scope, "w", r.risk_class,
             r.risk_class_index, r.source_window_end_ms, r.model_artifact_sha256)
            for r in responses.values() if r.problem is None]
    df = spark.createDataFrame(rows, (
        "name string, prediction_available boolean, mode string, data_source string, "
        "model_status string, model_input_channel string, model_artifact_version string, "
        "evidence_scope string, warning string, risk_class string, risk_class_index int, "
        "source_window_end_ms long, model_artifact_sha256 string"))
    assert violations(df, output_state_rules(F.col), ["name"]).count() == 0


def test_overlap_counts_what_all_pairs_would_find(spark):
    from driftline import contract

    base = [(n, 100 * n, float(n), "OK") for n in range(30)]
    windows = {
        "same": base, "later": base[7:], "changed": [*base[:5], (5, 500, -1.0, "OK"), *base[6:]],
        "moved": [(n, 100 * n + 100, float(n), "OK") for n in range(30)],
        "repeated": [*base[:3], *base[:3], (0, 100, 9.0, "OK"), (0, 100, 9.0, "OK")],
        "null fields": [(None, None, 1.0, "OK"), (3, 300, None, None)], "none in it": [(1, 10 ** 6, 1.0, "OK")],
        "empty": [], "null": None, "zero": [(0, 0, -0.0, "OK")], "holes": [base[0], None, base[9]],
        "backwards": base[::-1]}
    spec = rq.RequestSpec(baseline_seconds=3)
    kind = T.ArrayType(contract.REQUEST_SAMPLE)
    df = spark.createDataFrame(
        [(f"{name}-{i}", b, w) for name, w in windows.items() for i, b in enumerate((base, [], None, [None, *base]))],
        T.StructType([T.StructField("name", T.StringType()), T.StructField("b", kind), T.StructField("w", kind)]))
    early = F.filter("w", lambda x: x["elapsed_ms"] < spec.baseline_ms)
    for row in df.select("name", F.size(F.array_except(early, F.col("b"))).alias("pairs"), rq._overlap_conflicts(
            F.col("b"), F.col("w"), spec).alias("found")).collect():
        assert row.found == row.pairs, row


def test_a_filter_does_not_evaluate_a_request_again(spark):
    from driftline.catalog import live

    built = spark.createDataFrame([], "request_version string, device_id string, session_id string, "
                                  "acquisition_id string, operator_confirmed boolean, source_window_end_ms long, "
                                  "baseline_samples array<struct<sample_no:long,elapsed_ms:long,kap_7_raw:double,"
                                  "kap_7_status:string>>, window_samples array<struct<sample_no:long,"
                                  "elapsed_ms:long,kap_7_raw:double,kap_7_status:string>>")
    answers = rq.evaluate_window_requests(built, live.LIVE_MODEL, live.MODEL_SHA, live.SPEC)
    reduced = rq.reduce_requests(built, live.SPEC)
    for df in (rq.feature_documents(answers), reduced.filter("reduced.overlap_conflicts > 0"),
               reduced.filter("reduced.window_reason is null")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("'DUPLICATE_SAMPLE'") + plan.count("DUPLICATE_SAMPLE") <= 2, plan  # of both arrays


def test_requests_hold_the_samples_of_their_windows(spark, tmp_path, monkeypatch):
    """Blocks of a long session and a short one give the windows that samples give one by one."""
    from driftline.catalog import live

    rows = [("s1", n, 1, n, 100 * n + 25 * (n % 50 == 49), float(n), "OK") for n in range(1500) if n % 97]
    rows += [("s2", n, 2, n, 100 * n, float(n), "OK") for n in range(60)]
    rows += [("s3", n, 3, n, 100 * n, float(n), "OK") for n in range(300, 400)]  # nothing in its baseline
    rows += [("s4", n, 4, n, 100 * n, float(n), "OK") for n in (*range(60), *range(900, 950))]
    df = spark.createDataFrame(rows, "session_id string, arrival long, sup long, sample_no long, elapsed_ms long, "
                               "raw double, status string")
    monkeypatch.setattr(live, "live_rows", lambda *_: df)
    found = {(r.session_id, r.source_window_end_ms): ([x[0] for x in r.baseline_samples],
                                                      [(x[0], x[2]) for x in r.window_samples])
             for r in live.requests(spark, "").collect()}
    expected = {}
    for s in ("s1", "s2", "s3", "s4"):
        mine = [r for r in rows if r[0] == s]
        base = [r[3] for r in mine if r[4] < live.SPEC.baseline_ms]
        for end in range(5000, max(r[4] for r in mine) + 1, 5000):
            held = [(r[3], r[5] + (r[2] % 7 == 1 and r[1] == 150)) for r in mine
                    if end - live.SPEC.window_ms <= r[4] < end]
            if base and held:
                expected[s, end] = base, held
    assert found == expected
