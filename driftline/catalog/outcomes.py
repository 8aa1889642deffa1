"""Labels, matrix and reconciliation over the event stream."""

from pyspark.sql import functions as F

from driftline.catalog import tables as t, windows as cw
from driftline.catalog.registry import query, with_tables
from driftline.catalog.signals import RATE
from driftline.operators import labels as lab, matrix as mx, resample as rs, windows as w
from driftline.operators.integrity import duplicate_keys
from driftline.operators.qc import first_both_ok
from driftline.plans.pipelines import experiment

BOUNDARY = lab.Boundary(b1_ms=t.DAY, b2_ms=3 * t.DAY, b3_ms=7 * t.DAY, version="boundary-days",
                        block_ms=t.DAY)

# Recorded outcome of each session: first signup starts, last click ends, last purchase leaks.
OUTCOME_EVENTS = cw.FEATURES + """, marks AS (
  SELECT session_id, user_id, min(timestamp) FILTER (event_type = 'signup') AS t_start,
         max(timestamp) FILTER (event_type = 'click') AS t_end,
         max(timestamp) FILTER (event_type = 'purchase') AS t_leak
  FROM ev GROUP BY session_id, user_id),
outcome_events AS (
  SELECT session_id, t_start AS timestamp, 'INJECTION_START' AS event_type, 0 AS seq FROM marks
  WHERE user_id % 8 IN (0, 1, 2, 3, 6) OR user_id % 40 = 4
  UNION ALL SELECT session_id, t_end, 'INJECTION_END', 1 FROM marks
  WHERE (user_id % 8 IN (0, 1, 2, 3, 6) AND user_id % 24 <> 3) OR user_id % 40 = 4
  UNION ALL SELECT session_id, t_leak, 'PHYSICAL_LEAK_OBSERVED', 2 FROM marks
  WHERE user_id % 8 IN (0, 1, 2, 6)
  UNION ALL SELECT session_id, t_leak - 1, 'PHYSICAL_LEAK_OBSERVED', 3 FROM marks
  WHERE user_id % 56 = 1
  UNION ALL SELECT session_id, t_end, 'INJECTION_END', 4 FROM marks WHERE user_id % 72 = 2)"""


def outcome_events(spark, sf_dir):
    u, kind = F.col("user_id"), F.col("event_type")
    injected = (u % 8).isin(0, 1, 2, 3, 6)

    def at(name, pick):
        return pick(F.when(kind == name, F.col("timestamp")))

    marks = t.ev(spark, sf_dir).groupBy("session_id", "user_id").agg(
        at("signup", F.min).alias("t_start"), at("click", F.max).alias("t_end"),
        at("purchase", F.max).alias("t_leak"))

    def mark(condition, timestamp, name, seq):
        return F.when(condition, F.struct(
            timestamp.alias("timestamp"), F.lit(name).alias("event_type"), F.lit(seq).alias("seq")))

    rows = F.array_compact(F.array(
        mark(injected | (u % 40 == 4), F.col("t_start"), lab.START, 0),
        mark((injected & (u % 24 != 3)) | (u % 40 == 4), F.col("t_end"), lab.END, 1),
        mark((u % 8).isin(0, 1, 2, 6), F.col("t_leak"), lab.LEAK, 2),
        mark(u % 56 == 1, F.col("t_leak") - 1, lab.LEAK, 3),
        mark(u % 72 == 2, F.col("t_end"), lab.END, 4)))
    return marks.select("session_id", F.explode(rows).alias("_e")).select("session_id", "_e.*")


SUMMARY = OUTCOME_EVENTS + """, nested AS (
  SELECT *, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after
  FROM outcome_events WHERE event_type LIKE 'INJECTION%'
  WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, event_type = 'INJECTION_END', seq)),
faults AS (
  SELECT session_id,
         count(*) FILTER (event_type = 'INJECTION_START' AND before = 'INJECTION_START') AS overlap_count,
         count(*) FILTER (event_type = 'INJECTION_END'
                          AND before IS DISTINCT FROM 'INJECTION_START') AS orphan_end_count,
         bool_or(after IS NULL AND event_type = 'INJECTION_START') AS unclosed
  FROM nested GROUP BY session_id),
event_summary AS (
  SELECT e.session_id, min(timestamp) FILTER (event_type = 'INJECTION_START') AS first_injection_start,
         max(timestamp) FILTER (event_type = 'INJECTION_END') AS last_injection_end,
         min(timestamp) FILTER (event_type = 'PHYSICAL_LEAK_OBSERVED') AS physical_leak,
         count(*) FILTER (event_type = 'INJECTION_START') AS start_count,
         count(*) FILTER (event_type = 'INJECTION_END') AS end_count,
         count(*) FILTER (event_type = 'PHYSICAL_LEAK_OBSERVED') AS leak_count,
         coalesce(any_value(overlap_count), 0) AS overlap_count,
         coalesce(any_value(orphan_end_count), 0) AS orphan_end_count,
         coalesce(any_value(unclosed), false) AS unclosed
  FROM outcome_events e LEFT JOIN faults f USING (session_id) GROUP BY e.session_id)"""
OUTCOMES = SUMMARY + ", " + t.PLAN + ", " + t.PARTITION + """, outcomes AS (
  SELECT s.session_id, s.arm, s.end_reason, s.end_timestamp, e.* EXCLUDE (session_id),
         try_cast(CASE WHEN regexp_full_match(planned_safe_horizon_s, '[0-9]+')
                       THEN planned_safe_horizon_s END AS BIGINT) AS planned_horizon_s,
         a.safe_anchor, m.dataset_partition
  FROM sessions s LEFT JOIN event_summary e USING (session_id)
  LEFT JOIN plan USING (session_id) JOIN part_manifest m USING (session_id)
  LEFT JOIN (SELECT session_id, arg_min(timestamp, seq)
                      FILTER (cap_quality = 'OK' AND lig_quality = 'OK') AS safe_anchor
             FROM samples GROUP BY session_id) a USING (session_id)),
malformed AS (
  SELECT session_id, fault FROM (
    SELECT session_id, unnest([
      CASE WHEN overlap_count > 0 THEN 'OVERLAPPING_INJECTION' END,
      CASE WHEN orphan_end_count > 0 THEN 'END_WITHOUT_START' END,
      CASE WHEN unclosed THEN 'START_WITHOUT_END' END,
      CASE WHEN leak_count > 1 THEN 'SEVERAL_LEAKS' END,
      CASE WHEN end_reason = 'LEAK_CONFIRMED' AND coalesce(leak_count, 0) = 0
           THEN 'CONFIRMED_WITHOUT_LEAK' END,
      CASE WHEN arm = 'SAFE' AND start_count + end_count > 0 THEN 'SAFE_WITH_INJECTION' END,
      CASE WHEN arm = 'SAFE' AND leak_count > 0 THEN 'SAFE_WITH_LEAK' END,
      CASE WHEN arm = 'LEAK_GRADUAL' AND coalesce(start_count, 0) = 0 THEN 'GRADUAL_WITHOUT_START' END,
      CASE WHEN arm = 'LEAK_GRADUAL' AND coalesce(end_count, 0) = 0 THEN 'GRADUAL_WITHOUT_END' END,
      CASE WHEN arm = 'LEAK_GRADUAL' AND physical_leak < first_injection_start
           THEN 'LEAK_BEFORE_INJECTION' END]) AS fault
    FROM outcomes) WHERE fault IS NOT NULL)"""
HORIZON = OUTCOMES + """, horizon AS (
  SELECT *, coalesce(end_timestamp >= safe_anchor + planned_horizon_s * 1000, false)
              AS safe_horizon_completed,
         coalesce(end_timestamp >= last_injection_end + planned_horizon_s * 1000, false)
              AS fill_horizon_completed,
         arm = 'LEAK_GRADUAL' AND physical_leak IS NOT NULL AND planned_horizon_s IS NOT NULL
              AS protocol_deviation
  FROM outcomes)"""
LABELS = HORIZON + f""", labels_raw AS (
  SELECT f.window_id, f.session_id, f.window_index, f.window_start, f.window_end, h.arm,
         h.physical_leak, h.first_injection_start, h.dataset_partition, h.protocol_deviation,
         CASE WHEN f.exclusion_reason <> '' THEN f.exclusion_reason
              WHEN arm = 'LEAK_SUDDEN' THEN 'SUDDEN_ARM' WHEN arm = 'FIELD' THEN 'FIELD_ARM_EXCLUDED'
              WHEN arm = 'SAFE' THEN CASE WHEN safe_horizon_completed THEN ''
                                          ELSE 'CENSORED_NO_SAFE_HORIZON' END
              WHEN physical_leak IS NOT NULL THEN
                CASE WHEN window_end >= physical_leak THEN 'POST_LEAK' ELSE '' END
              WHEN window_end < first_injection_start OR fill_horizon_completed THEN ''
              ELSE 'CENSORED_NO_SAFE_HORIZON' END AS exclusion_reason
  FROM features f JOIN horizon h USING (session_id)
  WHERE f.session_id NOT IN (SELECT session_id FROM malformed)),
window_labels AS (
  SELECT window_id, session_id, window_index, window_start, window_end,
         CASE idx WHEN 0 THEN 'Safe' WHEN 1 THEN 'Monitor' WHEN 2 THEN 'Caution'
                  WHEN 3 THEN 'Urgent' ELSE '' END AS risk_label,
         idx AS risk_label_index, exclusion_reason = '' AS label_valid, exclusion_reason,
         'v0.3' AS rulebook_version, '{BOUNDARY.version}' AS boundary_config_version,
         dataset_partition, protocol_deviation,
         CASE WHEN protocol_deviation THEN 'UNPLANNED_PHYSICAL_LEAK' ELSE '' END
           AS protocol_deviation_reason
  FROM (SELECT *, CAST(CASE WHEN exclusion_reason <> '' THEN NULL
                       WHEN arm = 'LEAK_GRADUAL' AND physical_leak IS NOT NULL
                            AND NOT coalesce(window_end < first_injection_start, false) THEN
                         CASE WHEN physical_leak - window_end > {BOUNDARY.b3_ms} THEN 0
                              WHEN physical_leak - window_end > {BOUNDARY.b2_ms} THEN 1
                              WHEN physical_leak - window_end > {BOUNDARY.b1_ms} THEN 2
                              ELSE 3 END
                       ELSE 0 END AS INTEGER) AS idx FROM labels_raw))"""
MATRIX = LABELS + """, matrix AS (
  SELECT window_id, f.session_id, bag_id, sensor_id, dataset_partition, cap_delta_mean,
         cap_delta_last, cap_delta_slope_per_s, cap_delta_variance, cap_delta_range, risk_label,
         risk_label_index
  FROM features f JOIN window_labels l USING (window_id) WHERE feature_valid AND label_valid)"""


def outcomes(spark, sf_dir):
    from driftline.functions.parsing import positive_int

    rows = t.samples(spark, sf_dir)
    anchor = first_both_ok(rows).withColumnRenamed("first_both_ok_timestamp", "safe_anchor")
    plan = t.plan(spark, sf_dir).select(
        "session_id", positive_int(F.col("planned_safe_horizon_s")).alias("planned_horizon_s"))
    summary = lab.event_summary(outcome_events(spark, sf_dir), BOUNDARY.block_ms)
    return (
        lab.session_outcomes(t.sessions_of(rows), summary)
        .join(plan, "session_id", "left")
        .join(t.partition_manifest(spark, sf_dir).select("session_id", "dataset_partition"),
              "session_id")
        .join(anchor, "session_id", "left"))


def experiment_of(spark, sf_dir):
    rows = t.samples(spark, sf_dir)
    return experiment(rows, t.sessions_of(rows), outcomes(spark, sf_dir), cw.SPEC, BOUNDARY)


def labels(spark, sf_dir):
    return experiment_of(spark, sf_dir).labels


def matrix(spark, sf_dir):
    return experiment_of(spark, sf_dir).matrix


@query("event_summary", with_tables(SUMMARY, body="SELECT * FROM event_summary"))
def event_summary(spark, sf_dir):
    return lab.event_summary(outcome_events(spark, sf_dir), BOUNDARY.block_ms)


@query("malformed_events", with_tables(OUTCOMES, body="SELECT * FROM malformed"))
def malformed_events(spark, sf_dir):
    return lab.malformed_events(outcomes(spark, sf_dir))


@query("horizon_completion", with_tables(HORIZON, body="""
SELECT session_id, safe_horizon_completed, fill_horizon_completed FROM horizon"""))
def horizon_completion(spark, sf_dir):
    return lab.horizon_completion(outcomes(spark, sf_dir)).select(
        "session_id", "safe_horizon_completed", "fill_horizon_completed")


@query("protocol_deviation", with_tables(HORIZON, body="""
SELECT session_id, protocol_deviation, CASE WHEN protocol_deviation THEN 'UNPLANNED_PHYSICAL_LEAK'
       ELSE '' END AS protocol_deviation_reason FROM horizon"""))
def protocol_deviation(spark, sf_dir):
    return lab.protocol_deviation(outcomes(spark, sf_dir)).select(
        "session_id", "protocol_deviation", "protocol_deviation_reason")


@query("time_to_event_class", with_tables(HORIZON, body=f"""
SELECT p.session_id, window_index, physical_leak - window_end AS tau_ms,
       CASE WHEN physical_leak - window_end > {BOUNDARY.b3_ms} THEN 0
            WHEN physical_leak - window_end > {BOUNDARY.b2_ms} THEN 1
            WHEN physical_leak - window_end > {BOUNDARY.b1_ms} THEN 2 ELSE 3 END AS class_index
FROM spine p JOIN horizon h USING (session_id) WHERE physical_leak > window_end"""))
def time_to_event_class(spark, sf_dir):
    rows = t.samples(spark, sf_dir)
    spine = w.window_spine(t.sessions_of(rows), w.session_anchors(rows), cw.SPEC)
    leaks = lab.event_summary(outcome_events(spark, sf_dir), BOUNDARY.block_ms).select(
        "session_id", "physical_leak")
    tau = F.col("physical_leak") - F.col("window_end")
    return spine.join(leaks, "session_id").filter(tau > 0).select(
        "session_id", "window_index", tau.alias("tau_ms"),
        lab.time_to_event_class(tau, BOUNDARY).alias("class_index"))


query("label_windows", with_tables(LABELS, body="SELECT * FROM window_labels"))(labels)


@query("label_counts", with_tables(LABELS, body="""
SELECT v.kind, v.item, count(l.window_id) AS n
FROM (VALUES ('class', 'Safe'), ('class', 'Monitor'), ('class', 'Caution'), ('class', 'Urgent'),
  ('exclusion', 'DUPLICATE_TIMESTAMP'), ('exclusion', 'PARTIAL_WINDOW'),
  ('exclusion', 'TIMING_OUT_OF_TOLERANCE'), ('exclusion', 'INVALID_CAP_QUALITY'),
  ('exclusion', 'SUDDEN_ARM'), ('exclusion', 'FIELD_ARM_EXCLUDED'),
  ('exclusion', 'CENSORED_NO_SAFE_HORIZON'), ('exclusion', 'POST_LEAK')) v(kind, item)
LEFT JOIN window_labels l ON v.kind = CASE WHEN label_valid THEN 'class' ELSE 'exclusion' END
     AND v.item = CASE WHEN label_valid THEN risk_label ELSE exclusion_reason END
GROUP BY 1, 2"""))
def label_counts(spark, sf_dir):
    return lab.label_counts(labels(spark, sf_dir))


STRICT = "CASE WHEN exclusion_reason = '' AND sample_count < 9 THEN 'PARTIAL_WINDOW' " \
         "WHEN exclusion_reason IN ('TIMING_OUT_OF_TOLERANCE', 'INVALID_CAP_QUALITY') " \
         "AND sample_count < 9 THEN 'PARTIAL_WINDOW' ELSE exclusion_reason END"


@query("feature_label_crosscheck", with_tables(cw.FEATURES, body=f"""
SELECT session_id, window_index,
       concat_ws(',', CASE WHEN feature_valid <> (strict = '') THEN 'feature_valid' END,
                 'exclusion_reason') AS problem
FROM (SELECT *, {STRICT} AS strict FROM features) WHERE strict <> exclusion_reason"""))
def feature_label_crosscheck(spark, sf_dir):
    from dataclasses import replace

    rows = t.samples(spark, sf_dir)
    sessions = t.sessions_of(rows)
    other = w.window_validity(w.window_statistics(
        rows, sessions.select("session_id", "end_timestamp"), cw.SPEC),
        replace(cw.SPEC, minimum=9))
    return lab.feature_label_crosscheck(w.feature_table(rows, sessions, cw.SPEC), other)


@query("reconcile_features", with_tables(cw.FEATURES, body="""
SELECT window_id, 'valid_with_reason' AS rule FROM features
WHERE window_index = 3 AND NOT feature_valid
UNION ALL SELECT window_id, 'valid_without_values' FROM features
WHERE window_index = 3 AND NOT feature_valid
UNION ALL SELECT window_id, 'invalid_reason_unknown' FROM features
WHERE window_index = 5 AND feature_valid
UNION ALL SELECT window_id, 'invalid_with_values' FROM features
WHERE window_index = 5 AND feature_valid"""))
def reconcile_features(spark, sf_dir):
    index = F.col("window_index")
    altered = cw.feature_table(spark, sf_dir).withColumn(
        "feature_valid", F.when(index == 3, F.lit(True)).when(index == 5, F.lit(False))
        .otherwise(F.col("feature_valid")))
    return mx.reconcile_features(altered)


@query("reconcile_labels", with_tables(LABELS, body="""
SELECT window_id, 'boundary_version' AS rule FROM window_labels WHERE window_index = 2
UNION ALL SELECT window_id, 'partition' FROM window_labels WHERE window_index = 3
UNION ALL SELECT window_id, 'deviation_reason' FROM window_labels
  WHERE window_index = 4 AND protocol_deviation
UNION ALL SELECT window_id, 'label_index' FROM window_labels
  WHERE window_index = 6 AND label_valid AND risk_label_index <> 0
UNION ALL SELECT window_id, 'invalid_with_label' FROM window_labels
  WHERE window_index = 6 AND NOT label_valid"""))
def reconcile_labels(spark, sf_dir):
    index = F.col("window_index")
    altered = labels(spark, sf_dir).withColumns({
        "boundary_config_version": F.when(index == 2, "other").otherwise(
            F.col("boundary_config_version")),
        "dataset_partition": F.when(index == 3, "holdout").otherwise(F.col("dataset_partition")),
        "protocol_deviation_reason": F.when(index == 4, "").otherwise(
            F.col("protocol_deviation_reason")),
        "risk_label_index": F.when(index == 6, 0).otherwise(F.col("risk_label_index"))})
    return mx.reconcile_labels(altered, BOUNDARY.version)


@query("validity_crosscheck", with_tables(LABELS, body="""
SELECT f.window_id, 'label_valid_feature_invalid' AS rule
FROM features f JOIN window_labels l USING (window_id)
WHERE f.window_index = 4 AND l.label_valid
UNION ALL SELECT f.window_id, 'structural_reason_differs'
FROM features f JOIN window_labels l USING (window_id)
WHERE f.window_index = 4 AND f.exclusion_reason <> l.exclusion_reason
UNION ALL SELECT f.window_id, 'structural_reason_on_valid_feature'
FROM features f JOIN window_labels l USING (window_id)
WHERE f.window_index = 7 AND NOT l.label_valid AND l.exclusion_reason IN
  ('DUPLICATE_TIMESTAMP', 'PARTIAL_WINDOW', 'TIMING_OUT_OF_TOLERANCE', 'INVALID_CAP_QUALITY')"""))
def validity_crosscheck(spark, sf_dir):
    features = cw.feature_table(spark, sf_dir)
    index = F.col("window_index")
    altered = features.withColumn(
        "feature_valid", F.when(index == 4, F.lit(False)).when(index == 7, F.lit(True))
        .otherwise(F.col("feature_valid")))
    return mx.validity_crosscheck(altered, labels(spark, sf_dir))


@query("feature_label_join", with_tables(MATRIX, body="""
SELECT window_id, session_id, dataset_partition, risk_label_index FROM matrix"""))
def feature_label_join(spark, sf_dir):
    features = cw.feature_table(spark, sf_dir)
    return mx.feature_label_join(features, labels(spark, sf_dir)).select(
        "window_id", "session_id", "dataset_partition", "risk_label_index")


query("model_matrix", with_tables(MATRIX, body="SELECT * FROM matrix"))(matrix)


@query("class_counts_by_partition", with_tables(LABELS, body="""
SELECT dataset_partition, count(*) AS candidate_count,
       count(*) FILTER (risk_label = 'Safe') AS safe, count(*) FILTER (risk_label = 'Monitor') AS monitor,
       count(*) FILTER (risk_label = 'Caution') AS caution,
       count(*) FILTER (risk_label = 'Urgent') AS urgent
FROM window_labels GROUP BY dataset_partition"""))
def class_counts_by_partition(spark, sf_dir):
    return mx.class_counts_by_partition(labels(spark, sf_dir))


@query("exclusion_audit", with_tables(LABELS, t.LOGGER, body=f"""
SELECT 'logger' AS dataset_origin, session_id, 'raw sample' AS unit, count(*) % {RATE} AS n,
       'incomplete final group' AS reason FROM logger GROUP BY session_id HAVING count(*) % {RATE} > 0
UNION ALL SELECT 'events', session_id, 'window', count(*), exclusion_reason FROM window_labels
WHERE NOT label_valid GROUP BY session_id, exclusion_reason
UNION ALL SELECT 'events', session_id, 'session', 1, fault FROM malformed"""))
def exclusion_audit(spark, sf_dir):
    leftovers = rs.partial_bin_report(t.logger(spark, sf_dir), RATE).filter(
        "leftover_count > 0").select(
        "session_id", F.lit("raw sample").alias("unit"), F.col("leftover_count").alias("n"),
        F.lit("incomplete final group").alias("reason"))
    windows = labels(spark, sf_dir).filter("not label_valid").groupBy(
        "session_id", F.col("exclusion_reason").alias("reason")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("unit", F.lit("window"))
    sessions = lab.malformed_events(outcomes(spark, sf_dir)).select(
        "session_id", F.lit("session").alias("unit"), F.lit(1).cast("bigint").alias("n"),
        F.col("fault").alias("reason"))
    return mx.exclusion_audit({"logger": leftovers, "events": windows.unionByName(sessions)})


@query("count_reconciliation", with_tables(MATRIX, body="""
, counts AS (
  SELECT 'source_candidate_window_count' AS metric, (SELECT count(*) FROM features) AS declared,
         count(*) AS recomputed FROM window_labels
  UNION ALL SELECT 'eligible_row_count', (SELECT count(*) FROM features WHERE feature_valid),
         count(*) FILTER (label_valid) FROM window_labels
  UNION ALL SELECT 'excluded_row_count', (SELECT count(*) FROM features WHERE NOT feature_valid),
         count(*) FILTER (NOT label_valid) FROM window_labels
  UNION ALL SELECT 'class_' || v.c, NULL, (SELECT count(*) FROM window_labels WHERE risk_label = v.c)
  FROM (VALUES ('Safe'), ('Monitor'), ('Caution'), ('Urgent')) v(c)
  UNION ALL SELECT 'partition_' || v.c, NULL,
         (SELECT count(*) FROM window_labels WHERE dataset_partition = v.c)
  FROM (VALUES ('development'), ('validation'), ('final_test')) v(c))
SELECT * FROM counts WHERE declared IS DISTINCT FROM recomputed"""))
def count_reconciliation(spark, sf_dir):
    features = cw.feature_table(spark, sf_dir)
    valid = F.col("feature_valid")
    wide = features.agg(
        F.count(F.lit(1)).alias("source_candidate_window_count"),
        F.count_if(valid).alias("eligible_row_count"),
        F.count_if(~valid).alias("excluded_row_count"))
    declared = wide.unpivot([], wide.columns, "metric", "value")
    return mx.count_reconciliation(declared, mx.matrix_counts(labels(spark, sf_dir)))
