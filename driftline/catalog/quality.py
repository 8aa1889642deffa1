"""Quality-gate operators over the hour-resolution sample and point-event views."""

from pyspark.sql import functions as F

from driftline.catalog import tables as t
from driftline.catalog.registry import query, rounded, with_tables
from driftline.functions import rules
from driftline.operators import qc
from driftline.plans.pipelines import quality_gate

C = t.EVENT_QC
LOW, HIGH, GAP = C.low, C.high, C.unmarked_gap_threshold_ms
BASE = t.QC_SESSIONS


def _samples(spark, sf_dir):
    return t.qc_samples(spark, sf_dir)


def _sessions(spark, sf_dir):
    return t.qc_sessions(spark, sf_dir).withColumn("session_order", F.col("user_id"))


def _intervals(spark, sf_dir):
    return qc.arrival_intervals(_samples(spark, sf_dir), C)


INTERVALS = BASE + """, intervals AS (
  SELECT *, timestamp - lag(timestamp) OVER (PARTITION BY session_id ORDER BY seq) AS delta,
         lag(timestamp) OVER (PARTITION BY session_id ORDER BY seq) AS previous_timestamp,
         row_number() OVER (PARTITION BY session_id, timestamp ORDER BY seq) AS nth
  FROM qc_samples)"""
IS_TOL = f"(delta > 0 AND (delta < {LOW} OR delta > {HIGH}))"
IS_GAP = f"(delta >= {GAP} AND cap_quality <> 'DATA_GAP' AND lig_quality <> 'DATA_GAP')"


@query("duplicate_timestamps", with_tables(INTERVALS, body="""
SELECT session_id, count(*) AS duplicate_timestamp_count,
       arg_min(timestamp, seq) AS first_duplicate_timestamp
FROM intervals WHERE nth > 1 GROUP BY session_id"""))
def duplicate_timestamps(spark, sf_dir):
    return qc.duplicate_timestamps(_samples(spark, sf_dir))


@query("out_of_order_intervals", with_tables(INTERVALS, body="""
SELECT session_id, count(*) FILTER (delta < 0) AS out_of_order_interval_count,
       arg_min(timestamp, seq) FILTER (delta < 0) AS first_out_of_order_timestamp
FROM intervals GROUP BY session_id"""))
def out_of_order_intervals(spark, sf_dir):
    return qc.out_of_order_intervals(_intervals(spark, sf_dir))


@query("out_of_tolerance_intervals", with_tables(INTERVALS, body=f"""
SELECT session_id, count(*) FILTER {IS_TOL} AS out_of_tolerance_interval_count,
       arg_min(timestamp, seq) FILTER {IS_TOL} AS first_out_of_tolerance_timestamp
FROM intervals GROUP BY session_id"""))
def out_of_tolerance_intervals(spark, sf_dir):
    return qc.out_of_tolerance_intervals(_intervals(spark, sf_dir), C)


@query("unmarked_gaps", with_tables(INTERVALS, body=f"""
SELECT session_id, timestamp, delta AS gap_ms FROM intervals WHERE {IS_GAP}"""))
def unmarked_gaps(spark, sf_dir):
    return qc.unmarked_gaps(_intervals(spark, sf_dir), C)


@query("session_order_check", with_tables(INTERVALS, body="""
SELECT session_id, seq, timestamp, previous_timestamp FROM intervals WHERE delta < 0"""))
def session_order_check(spark, sf_dir):
    return qc.session_order_check(_intervals(spark, sf_dir))


BASELINE = BASE + f""", base_rows AS (
  SELECT m.session_id, m.seq, m.timestamp, m.capacitance_raw, start_timestamp, baseline_value,
         baseline_std,
         m.timestamp - lag(m.timestamp) OVER (PARTITION BY m.session_id
                                              ORDER BY m.timestamp, m.seq) AS step
  FROM qc_samples m JOIN qc_sessions s USING (session_id)
  WHERE m.timestamp >= start_timestamp AND m.timestamp < start_timestamp + {C.baseline_ms}),
recomputed AS (
  SELECT session_id, count(*) AS baseline_sample_count,
         {rounded('median(capacitance_raw)')} AS baseline_recomputed_median,
         {rounded('stddev_pop(capacitance_raw)')} AS baseline_recomputed_std,
         any_value(baseline_value) AS bv, any_value(baseline_std) AS bs
  FROM base_rows GROUP BY session_id),
baseline AS (
  SELECT session_id, baseline_sample_count, baseline_recomputed_median, baseline_recomputed_std,
         {rounded('abs(baseline_recomputed_median - bv)')} AS baseline_value_abs_diff,
         {rounded('abs(baseline_recomputed_std - bs)')} AS baseline_std_abs_diff
  FROM recomputed),
coverage AS (
  SELECT s.session_id, coalesce(n, 0) AS baseline_sample_count, first_ts AS first_baseline_timestamp,
         CASE WHEN n IS NULL THEN 'no samples in [start, start+{C.baseline_window_s}s)' ELSE
         concat_ws('; ', CASE WHEN n < 2 THEN 'fewer than two samples' END,
           CASE WHEN first_ts - s.start_timestamp > {HIGH} THEN 'baseline starts too late' END,
           CASE WHEN s.start_timestamp + {C.baseline_ms} - last_ts > {HIGH}
                THEN 'baseline ends too early' END,
           CASE WHEN bad > 0 THEN 'baseline contains an invalid sampling interval' END)
         END AS coverage_reasons
  FROM qc_sessions s LEFT JOIN (
    SELECT session_id, count(*) AS n, min(timestamp) AS first_ts, max(timestamp) AS last_ts,
           count(*) FILTER (step < {LOW} OR step > {HIGH}) AS bad
    FROM base_rows GROUP BY session_id) b USING (session_id))"""


@query("baseline_recompute", with_tables(BASELINE, body="SELECT * FROM baseline"))
def baseline_recompute(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    return qc.baseline_recompute(rows, t.sessions_of(rows), C)


@query("baseline_coverage", with_tables(BASELINE, body="SELECT * FROM coverage"))
def baseline_coverage(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    return qc.baseline_coverage(rows, t.sessions_of(rows), C)


@query("non_ok_counts", with_tables(BASE, body="""
SELECT session_id, count(*) FILTER (cap_quality <> 'OK') AS cap_non_ok_count,
       count(*) FILTER (lig_quality <> 'OK') AS lig_non_ok_count
FROM qc_samples GROUP BY session_id"""))
def non_ok_counts(spark, sf_dir):
    return qc.non_ok_counts(_samples(spark, sf_dir))


@query("first_both_ok", with_tables(BASE, body="""
SELECT session_id, arg_min(timestamp, seq) FILTER (cap_quality = 'OK' AND lig_quality = 'OK')
         AS first_both_ok_timestamp
FROM qc_samples GROUP BY session_id"""))
def first_both_ok(spark, sf_dir):
    return qc.first_both_ok(_samples(spark, sf_dir))


FACTS = INTERVALS + BASELINE[len(BASE):] + ", " + t.POINT_EVENTS[len(t.EV) + 2:] + ", " + t.PLAN \
    + f""", both_ok AS (
  SELECT session_id, arg_min(timestamp, seq) FILTER (cap_quality = 'OK' AND lig_quality = 'OK')
         AS first_both_ok_timestamp FROM qc_samples GROUP BY session_id),
efacts AS (
  SELECT session_id, count(*) AS event_count,
         count(*) FILTER (event_type = 'INJECTION_START') AS start_count,
         count(*) FILTER (event_type = 'INJECTION_END') AS end_count,
         count(*) FILTER (event_type = 'PHYSICAL_LEAK_OBSERVED') AS leak_count,
         count(*) FILTER (event_type = 'LEAK_FLAG_FIRST') AS flag_first_count,
         count(*) FILTER (event_type = 'LEAK_FLAG_CONFIRMED') AS flag_confirmed_count,
         count(*) FILTER (event_type = 'DEVICE_RESTART') AS restart_count,
         min(timestamp) FILTER (event_type = 'INJECTION_START') AS first_start,
         min(timestamp) FILTER (event_type IN ('INJECTION_START', 'INJECTION_END')) AS first_injection,
         min(timestamp) FILTER (event_type = 'PHYSICAL_LEAK_OBSERVED') AS first_leak,
         (list(timestamp ORDER BY timestamp) FILTER (event_type = 'PHYSICAL_LEAK_OBSERVED'))[2]
           AS second_leak,
         arg_min(timestamp, seq) FILTER (event_type = 'DEVICE_RESTART') AS first_restart
  FROM point_events GROUP BY session_id),
pair_rows AS (
  SELECT *, lag(event_type) OVER (PARTITION BY session_id ORDER BY timestamp, seq) AS before,
         lead(event_type) OVER (PARTITION BY session_id ORDER BY timestamp, seq) AS after
  FROM point_events WHERE event_type IN ('INJECTION_START', 'INJECTION_END')),
pairing AS (
  SELECT session_id,
         count(*) FILTER (event_type = 'INJECTION_START' AND before = 'INJECTION_START') AS overlap_count,
         count(*) FILTER (event_type = 'INJECTION_END'
                          AND before IS DISTINCT FROM 'INJECTION_START') AS orphan_end_count,
         count(*) FILTER (event_type = 'INJECTION_END' AND before = 'INJECTION_START') AS pair_count,
         bool_or(after IS NULL AND event_type = 'INJECTION_START') AS unclosed,
         min(timestamp) AS first_pairing_timestamp
  FROM pair_rows GROUP BY session_id),
plan_checked AS (
  SELECT s.session_id, s.arm, p.session_id IS NOT NULL AS plan_present,
         p.session_id IS NOT NULL
           AND p.planned_arm IN ('LEAK_GRADUAL', 'SAFE', 'LEAK_SUDDEN', 'FIELD')
           AND p.planned_arm <> s.arm AS arm_mismatch,
         concat_ws(',', CASE WHEN p.operator_id <> s.operator_id THEN 'operator_id' END,
                   CASE WHEN p.bag_id <> s.bag_id THEN 'bag_id' END,
                   CASE WHEN p.sensor_id <> s.sensor_id THEN 'sensor_id' END,
                   CASE WHEN p.device_id <> s.device_id THEN 'device_id' END) AS id_mismatch,
         concat_ws(',',
           CASE WHEN s.arm = 'SAFE' AND (p.injection_profile <> '' OR p.injection_method <> ''
                     OR p.planned_flow_ml_min <> '') THEN 'injection_fields_must_be_empty' END,
           CASE WHEN (s.arm = 'LEAK_GRADUAL' AND p.injection_method NOT IN ('manual_syringe', 'pump'))
                  OR (s.arm = 'LEAK_SUDDEN' AND p.injection_method NOT IN ('', 'manual_syringe', 'pump'))
                THEN 'injection_method' END,
           CASE WHEN (s.arm = 'LEAK_GRADUAL' AND p.injection_profile NOT IN ('stepwise', 'continuous'))
                  OR (s.arm = 'LEAK_SUDDEN' AND p.injection_profile NOT IN ('', 'stepwise', 'continuous'))
                THEN 'injection_profile' END,
           CASE WHEN s.arm IN ('LEAK_GRADUAL', 'LEAK_SUDDEN')
                     AND p.physical_leak_observation_method = '' THEN
                'physical_leak_observation_method' END,
           CASE WHEN p.planned_arm NOT IN ('LEAK_GRADUAL', 'SAFE', 'LEAK_SUDDEN', 'FIELD')
                THEN 'planned_arm' END,
           CASE WHEN s.arm IN ('LEAK_GRADUAL', 'LEAK_SUDDEN') AND p.planned_flow_ml_min <> ''
                     AND coalesce(try_cast(p.planned_flow_ml_min AS DOUBLE), -1) <= 0
                THEN 'planned_flow_ml_min' END,
           CASE WHEN (s.arm = 'SAFE' AND NOT ok_horizon)
                  OR (s.arm = 'LEAK_GRADUAL' AND p.planned_safe_horizon_s <> '' AND NOT ok_horizon)
                  OR (s.arm IN ('LEAK_SUDDEN', 'FIELD') AND p.planned_safe_horizon_s <> '')
                THEN 'planned_safe_horizon_s' END,
           CASE WHEN NOT regexp_full_match(p.protocol_version, 'v0[.]1-[A-Za-z0-9][A-Za-z0-9._-]*')
                THEN 'protocol_version' END,
           CASE WHEN p.target_fill_or_volume = '' THEN 'target_fill_or_volume' END) AS invalid_fields,
         CASE WHEN s.arm = 'LEAK_GRADUAL' AND p.planned_safe_horizon_s = '' THEN 'PLANNED_LEAK'
              WHEN s.arm = 'LEAK_GRADUAL' AND ok_horizon THEN 'NONLEAKING_FILL'
              ELSE 'UNKNOWN' END AS mode
  FROM qc_sessions s LEFT JOIN (
    SELECT *, regexp_full_match(planned_safe_horizon_s, '[+-]?[0-9]+')
              AND coalesce(try_cast(planned_safe_horizon_s AS BIGINT), 0) > 0 AS ok_horizon
    FROM plan) p USING (session_id)),
plan_rules AS (
  SELECT session_id, plan_present, arm_mismatch, id_mismatch, invalid_fields,
         CASE WHEN plan_present AND NOT arm_mismatch AND id_mismatch = '' AND invalid_fields = ''
              THEN mode ELSE 'UNKNOWN' END AS plan_mode
  FROM plan_checked),
sfacts AS (
  SELECT i.session_id, count(*) AS sample_count,
         count(*) FILTER (delta < 0) AS ooo, arg_min(timestamp, seq) FILTER (delta < 0) AS ooo_ts,
         count(*) FILTER {IS_TOL} AS tol, arg_min(timestamp, seq) FILTER {IS_TOL} AS tol_ts,
         count(*) FILTER {IS_GAP} AS gaps,
         count(*) FILTER (nth > 1) AS dup, arg_min(timestamp, seq) FILTER (nth > 1) AS dup_ts,
         count(*) FILTER (cap_quality <> 'OK') AS cap_non_ok_count,
         count(*) FILTER (lig_quality <> 'OK') AS lig_non_ok_count,
         count(*) FILTER (NOT timestamp BETWEEN start_timestamp AND end_timestamp) AS outside,
         arg_min(timestamp, seq) FILTER (NOT timestamp BETWEEN start_timestamp AND end_timestamp)
           AS outside_ts,
         count(*) FILTER (k = 5) - count(*) FILTER (k = 5 AND derived = 'UNSAFE') AS mismatch,
         arg_min(timestamp, seq) FILTER (k = 5 AND derived <> 'UNSAFE') AS mismatch_ts,
         count(*) FILTER (k = 13) AS metadata, arg_min(timestamp, seq) FILTER (k = 13) AS metadata_ts
  FROM (SELECT *, CASE WHEN cap_quality = 'OK' AND lig_quality = 'OK' THEN 'NORMAL' ELSE '?' END
               AS derived FROM intervals) i JOIN qc_sessions USING (session_id)
  GROUP BY i.session_id),
facts AS (
  SELECT s.*, f.* EXCLUDE (session_id), b.* EXCLUDE (session_id),
         c.coverage_reasons, c.first_baseline_timestamp, e.* EXCLUDE (session_id),
         o.first_both_ok_timestamp, g.* EXCLUDE (session_id), r.* EXCLUDE (session_id),
         first_start - first_both_ok_timestamp AS dry
  FROM qc_sessions s LEFT JOIN sfacts f USING (session_id) LEFT JOIN baseline b USING (session_id)
  LEFT JOIN coverage c USING (session_id) LEFT JOIN efacts e USING (session_id)
  LEFT JOIN both_ok o USING (session_id) LEFT JOIN pairing g USING (session_id)
  LEFT JOIN plan_rules r USING (session_id)),
arm_issues AS (
  SELECT session_id, 'MALFORMED_REQUIRED_EVENTS' AS code, 'ERROR' AS severity,
         CAST(NULL AS BIGINT) AS timestamp, 'protocol' AS domain FROM facts
  WHERE end_reason = 'LEAK_CONFIRMED' AND leak_count = 0
  UNION ALL SELECT session_id, 'DEVICE_RESTART_DURING_SESSION', 'ERROR', first_restart, 'protocol'
  FROM facts WHERE restart_count > 0
  UNION ALL SELECT session_id, 'FIELD_ARM_NOT_SUPPORTED', 'ERROR', NULL, 'protocol'
  FROM facts WHERE arm = 'FIELD'
  UNION ALL SELECT session_id, 'MALFORMED_REQUIRED_EVENTS', 'ERROR', first_injection, 'protocol'
  FROM facts WHERE arm = 'SAFE' AND start_count + end_count > 0
  UNION ALL SELECT session_id, 'UNEXPECTED_PHYSICAL_LEAK_SAFE', 'ERROR', first_leak, 'protocol'
  FROM facts WHERE arm = 'SAFE' AND leak_count > 0
  UNION ALL SELECT session_id, 'MALFORMED_REQUIRED_EVENTS', 'ERROR', first_injection, 'protocol'
  FROM facts WHERE arm IN ('LEAK_GRADUAL', 'LEAK_SUDDEN')
               AND (overlap_count > 0 OR orphan_end_count > 0 OR unclosed)
  UNION ALL SELECT session_id, 'MISSING_REQUIRED_EVENT', 'ERROR', NULL, 'protocol'
  FROM facts WHERE arm = 'LEAK_GRADUAL' AND start_count = 0
  UNION ALL SELECT session_id, 'MISSING_REQUIRED_EVENT', 'ERROR', NULL, 'protocol'
  FROM facts WHERE arm = 'LEAK_GRADUAL' AND end_count = 0
  UNION ALL SELECT session_id, 'MALFORMED_REQUIRED_EVENTS', 'ERROR', second_leak, 'protocol'
  FROM facts WHERE arm IN ('LEAK_GRADUAL', 'LEAK_SUDDEN') AND leak_count > 1
  UNION ALL SELECT session_id, 'MALFORMED_REQUIRED_EVENTS', 'ERROR', first_leak, 'protocol'
  FROM facts WHERE arm = 'LEAK_GRADUAL' AND leak_count = 1 AND first_leak < first_start
  UNION ALL SELECT session_id, 'UNPLANNED_PHYSICAL_LEAK', 'WARNING', first_leak, 'protocol'
  FROM facts WHERE arm = 'LEAK_GRADUAL' AND leak_count = 1 AND plan_mode = 'NONLEAKING_FILL'
  UNION ALL SELECT session_id, 'MISSING_REQUIRED_EVENT', 'ERROR', NULL, 'protocol'
  FROM facts WHERE arm = 'LEAK_GRADUAL' AND leak_count = 0 AND plan_mode = 'PLANNED_LEAK'
               AND end_reason <> 'LEAK_CONFIRMED'
  UNION ALL SELECT session_id, 'MISSING_REQUIRED_EVENT', 'ERROR', NULL, 'protocol'
  FROM facts WHERE arm = 'LEAK_SUDDEN' AND leak_count = 0 AND end_reason <> 'LEAK_CONFIRMED'
  UNION ALL SELECT session_id, 'MISSING_LIG_FLAG_EVENT', 'WARNING', NULL, 'protocol'
  FROM facts WHERE arm IN ('LEAK_GRADUAL', 'LEAK_SUDDEN') AND leak_count = 1
               AND (flag_first_count = 0 OR flag_confirmed_count = 0)),
event_rows AS (
  SELECT e.*, s.start_timestamp, s.end_timestamp,
         first_value(e.session_id) OVER (PARTITION BY event_id ORDER BY s.user_id, e.seq) AS owner,
         row_number() OVER (PARTITION BY event_id ORDER BY s.user_id, e.seq) AS nth
  FROM point_events e JOIN qc_sessions s USING (session_id)),
event_issue_rows AS (
  SELECT session_id, 'INVALID_RECORD' AS code, 'ERROR' AS severity, timestamp, 'contract' AS domain
  FROM event_rows WHERE event_id LIKE '%,%'
  UNION ALL SELECT session_id, 'EVENT_OUTSIDE_SESSION', 'ERROR', timestamp, 'contract'
  FROM event_rows WHERE NOT timestamp BETWEEN start_timestamp AND end_timestamp),
all_issues AS (
  SELECT session_id, severity, code, timestamp, domain FROM arm_issues
  UNION ALL SELECT session_id, severity, code, timestamp, domain FROM event_issue_rows
  UNION ALL SELECT session_id, 'ERROR', 'DUPLICATE_EVENT_ID', timestamp, 'contract'
  FROM event_rows WHERE nth > 1 AND event_id NOT LIKE '%,%'
  UNION ALL SELECT session_id, 'ERROR', 'UNMARKED_DATA_GAP', timestamp, 'protocol'
  FROM intervals WHERE {IS_GAP}
  UNION ALL SELECT session_id, 'ERROR', 'INVALID_RECORD', NULL, 'contract' FROM facts
  WHERE fluid_type LIKE '%,%' OR operator_id = ''
  UNION ALL SELECT session_id, 'ERROR', 'INVALID_RECORD', NULL, 'contract' FROM facts
  WHERE end_timestamp < start_timestamp
  UNION ALL SELECT session_id, 'ERROR', 'INVALID_RECORD', NULL, 'contract' FROM facts
  WHERE baseline_std < 0
  UNION ALL SELECT session_id, 'ERROR', 'SAMPLE_OUTSIDE_SESSION', outside_ts, 'contract'
  FROM facts WHERE outside > 0
  UNION ALL SELECT session_id, 'ERROR', 'SYSTEM_QUALITY_MISMATCH', mismatch_ts, 'contract'
  FROM facts WHERE mismatch > 0
  UNION ALL SELECT session_id, 'ERROR', 'INVALID_RECORD', metadata_ts, 'contract'
  FROM facts WHERE metadata > 0
  UNION ALL SELECT session_id, 'ERROR', 'DUPLICATE_SAMPLE_TIMESTAMP', dup_ts, 'protocol'
  FROM facts WHERE dup > 0
  UNION ALL SELECT session_id, 'ERROR', 'TIMESTAMP_OUT_OF_ORDER', ooo_ts, 'protocol'
  FROM facts WHERE ooo > 0
  UNION ALL SELECT session_id, 'ERROR', 'INTERVAL_OUT_OF_TOLERANCE', tol_ts, 'protocol'
  FROM facts WHERE tol > 0
  UNION ALL SELECT session_id, 'ERROR', 'BASELINE_WINDOW_INCOMPLETE', first_baseline_timestamp,
         'protocol' FROM facts WHERE coverage_reasons <> ''
  UNION ALL SELECT session_id, 'ERROR', 'MANIFEST_ID_MISMATCH', NULL, 'protocol'
  FROM facts WHERE NOT plan_present
  UNION ALL SELECT session_id, 'ERROR', 'MANIFEST_ARM_MISMATCH', NULL, 'protocol'
  FROM facts WHERE arm_mismatch
  UNION ALL SELECT session_id, 'ERROR', 'MANIFEST_ID_MISMATCH', NULL, 'protocol'
  FROM facts WHERE id_mismatch <> ''
  UNION ALL SELECT session_id, 'ERROR', 'INVALID_PROTOCOL_MANIFEST', NULL, 'protocol'
  FROM facts WHERE invalid_fields <> ''
  UNION ALL SELECT session_id, 'ERROR', 'PREINJECTION_DRY_TOO_SHORT', first_start, 'protocol'
  FROM facts WHERE first_start IS NOT NULL
               AND (dry IS NULL OR dry < {C.minimum_pre_injection_dry_s * 1000})
  UNION ALL SELECT session_id, 'ERROR', 'UNKNOWN_SESSION', NULL, 'contract' FROM (
    SELECT DISTINCT 'plan' AS source, session_id FROM plan
    UNION ALL SELECT DISTINCT 'events', session_id FROM point_events)
  WHERE session_id NOT IN (SELECT session_id FROM facts)),
summary AS (
  SELECT session_id, count(*) FILTER (severity = 'ERROR') AS error_count,
         count(*) FILTER (severity = 'WARNING') AS warning_count,
         count(*) FILTER (severity = 'ERROR' AND domain = 'contract') AS contract_errors,
         count(*) FILTER (severity = 'ERROR' AND domain = 'protocol') AS protocol_errors,
         string_agg(DISTINCT code, '|' ORDER BY code) AS issue_codes
  FROM all_issues GROUP BY session_id),
status AS (
  SELECT s.session_id,
         CASE WHEN contract_errors > 0 THEN 'FAIL' ELSE 'PASS' END AS contract_status,
         CASE WHEN protocol_errors > 0 THEN 'FAIL' ELSE 'PASS' END AS protocol_status,
         CASE WHEN contract_errors > 0 OR protocol_errors > 0 THEN 'FAIL' ELSE 'PASS' END
           AS overall_status,
         coalesce(error_count, 0) AS error_count, coalesce(warning_count, 0) AS warning_count,
         coalesce(issue_codes, '') AS issue_codes
  FROM qc_sessions s LEFT JOIN summary USING (session_id))"""


def _inputs(spark, sf_dir):
    rows = _samples(spark, sf_dir)
    sessions = t.sessions_of(rows).withColumn("session_order", F.col("user_id"))
    events = t.point_events(spark, sf_dir)
    return rows, sessions, events, t.plan(spark, sf_dir)


def _gate(spark, sf_dir):
    rows, sessions, events, plan = _inputs(spark, sf_dir)
    return quality_gate(sessions, rows, events, C, plan)


@query("dry_phase", with_tables(FACTS, body=f"""
SELECT session_id, first_both_ok_timestamp, first_start AS first_injection_start_timestamp,
       {rounded('dry / 1000.0e0')} AS pre_injection_dry_s,
       first_start IS NOT NULL AND (dry IS NULL OR dry < {C.minimum_pre_injection_dry_s * 1000})
         AS dry_too_short
FROM facts"""))
def dry_phase(spark, sf_dir):
    rows, sessions, events, _ = _inputs(spark, sf_dir)
    first = qc.event_facts(events).select("session_id", "first_injection_start_timestamp")
    return qc.dry_phase(qc.first_both_ok(rows).join(first, "session_id", "left"), C)


@query("interval_pairing", with_tables(FACTS, body="SELECT * FROM pairing"))
def interval_pairing(spark, sf_dir):
    return qc.interval_pairing(t.point_events(spark, sf_dir), C)


@query("plan_row_rules", with_tables(FACTS, body="SELECT * FROM plan_rules"))
def plan_row_rules(spark, sf_dir):
    return qc.plan_row_rules(t.qc_sessions(spark, sf_dir), t.plan(spark, sf_dir))


@query("arm_rules", with_tables(FACTS, body="""
SELECT session_id, severity, code, timestamp FROM arm_issues"""))
def arm_rules(spark, sf_dir):
    _, sessions, events, plan = _inputs(spark, sf_dir)
    happenings = qc.event_facts(events)
    facts = sessions.join(happenings, "session_id", "left") \
        .join(qc.interval_pairing(events, C), "session_id", "left") \
        .join(qc.second_leak(events, happenings), "session_id", "left") \
        .join(qc.plan_row_rules(sessions, plan), "session_id", "left")
    counts = [c for c in facts.columns if c.endswith("_count")]
    return qc.arm_rules(facts.fillna(0, counts).fillna(False, ["unclosed"])).select(
        "session_id", "severity", "code", "timestamp")


@query("issue_union", with_tables(FACTS, body="""
SELECT session_id, severity, code, timestamp, domain FROM all_issues"""))
def issue_union(spark, sf_dir):
    return _gate(spark, sf_dir).issues.select(
        "session_id", "severity", "code", "timestamp", "domain")


@query("session_status", with_tables(FACTS, body="SELECT * FROM status"))
def session_status(spark, sf_dir):
    return _gate(spark, sf_dir).status


@query("issue_counts", with_tables(FACTS, body="""
SELECT 'severity' AS kind, v.item, count(i.code) AS n
FROM (VALUES ('ERROR'), ('WARNING')) v(item) LEFT JOIN all_issues i ON i.severity = v.item GROUP BY 2
UNION ALL SELECT 'code', code, count(*) FROM all_issues GROUP BY code"""))
def issue_counts(spark, sf_dir):
    return qc.issue_counts(_gate(spark, sf_dir).issues)


@query("status_counts", with_tables(FACTS, body="""
SELECT v.overall_status, count(s.session_id) AS session_count
FROM (VALUES ('PASS'), ('FAIL'), ('PARTIAL')) v(overall_status)
LEFT JOIN (SELECT session_id,
                  CASE WHEN overall_status = 'FAIL' THEN 'FAIL' ELSE 'PASS' END AS overall_status
           FROM status) s USING (overall_status) GROUP BY 1"""))
def status_counts(spark, sf_dir):
    return qc.status_counts(_gate(spark, sf_dir).status)


@query("qc_session_report", with_tables(FACTS, body=f"""
SELECT f.session_id, contract_status, protocol_status, overall_status, sample_count, event_count,
       {rounded('(end_timestamp - start_timestamp) / 1000.0e0')} AS duration_s,
       dup AS duplicate_timestamp_count, ooo AS out_of_order_interval_count,
       tol AS out_of_tolerance_interval_count, gaps AS unmarked_gap_count, cap_non_ok_count,
       lig_non_ok_count, first_both_ok_timestamp, first_start AS first_injection_start_timestamp,
       {rounded('dry / 1000.0e0')} AS pre_injection_dry_s,
       coalesce(baseline_sample_count, 0) AS baseline_sample_count,
       baseline_recomputed_median, baseline_recomputed_std, baseline_value_abs_diff,
       baseline_std_abs_diff, error_count, warning_count, issue_codes
FROM facts f JOIN status USING (session_id)"""))
def qc_session_report(spark, sf_dir):
    return _gate(spark, sf_dir).report


@query("empty_sessions", with_tables(FACTS, body="""
SELECT session_id, planned_arm FROM plan
WHERE session_id NOT IN (SELECT session_id FROM qc_samples)"""))
def empty_sessions(spark, sf_dir):
    planned = t.plan(spark, sf_dir).select("session_id", "planned_arm")
    return qc.empty_sessions(planned, _samples(spark, sf_dir))


@query("check_system_quality", with_tables(t.SAMPLES, body="""
SELECT seq, session_id, system_quality,
       CASE WHEN cap_quality = 'OK' AND lig_quality = 'OK' THEN 'NORMAL'
            WHEN lig_quality = 'OK' THEN 'ML_UNAVAILABLE'
            WHEN cap_quality = 'OK' THEN 'FAILSAFE_DEGRADED' ELSE 'UNSAFE' END AS expected
FROM samples WHERE k = 5"""))
def check_system_quality(spark, sf_dir):
    expected = rules.system_quality(F.col("cap_quality"), F.col("lig_quality"))
    return t.samples(spark, sf_dir).filter(F.col("system_quality") != expected).select(
        "seq", "session_id", "system_quality", expected.alias("expected"))
