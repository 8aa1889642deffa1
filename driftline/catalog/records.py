"""Parsing, record rules, keys and joins."""

from pyspark.sql import functions as F

from driftline import contract
from driftline.catalog import tables as t
from driftline.catalog.registry import query, rounded, with_tables
from driftline.functions import parsing, rules
from driftline.operators import integrity as n

TEXTS = t.EV + """, texts AS (
  SELECT event_id, k,
         CASE k WHEN 20 THEN '' WHEN 21 THEN 'abc' WHEN 22 THEN '1.5' WHEN 23 THEN ' 12 '
                WHEN 24 THEN '-' || event_id WHEN 25 THEN '99999999999999999999'
                ELSE CAST(event_id AS VARCHAR) END AS int_text,
         CASE k WHEN 30 THEN 'NaN' WHEN 31 THEN 'inf' WHEN 32 THEN 'x' WHEN 33 THEN ''
                WHEN 34 THEN '1e400' WHEN 35 THEN '-2.5e-3'
                ELSE CAST(k AS VARCHAR) || '.' || CAST(event_id AS VARCHAR) END AS number_text,
         CASE event_type WHEN 'view' THEN 'true' WHEN 'click' THEN 'false' WHEN 'signup' THEN 'True'
                         WHEN 'error' THEN '' ELSE '1' END AS bool_text
  FROM ev)"""


def texts(spark, sf_dir):
    k, e = F.col("k"), F.col("event_id").cast("string")
    kind = F.col("event_type")
    return t.ev(spark, sf_dir).select(
        "event_id", "k",
        F.when(k == 20, "").when(k == 21, "abc").when(k == 22, "1.5").when(k == 23, " 12 ")
        .when(k == 24, F.concat(F.lit("-"), e)).when(k == 25, "99999999999999999999")
        .otherwise(e).alias("int_text"),
        F.when(k == 30, "NaN").when(k == 31, "inf").when(k == 32, "x").when(k == 33, "")
        .when(k == 34, "1e400").when(k == 35, "-2.5e-3")
        .otherwise(F.concat(k.cast("string"), F.lit("."), e)).alias("number_text"),
        F.when(kind == "view", "true").when(kind == "click", "false").when(kind == "signup", "True")
        .when(kind == "error", "").otherwise("1").alias("bool_text"))


INT = "CASE WHEN regexp_full_match({0}, '\\s*[+-]?[0-9]+\\s*') THEN try_cast(trim({0}) AS BIGINT) END"
NUM = ("CASE WHEN regexp_full_match({0}, '\\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*')"
       " AND isfinite(coalesce(try_cast(trim({0}) AS DOUBLE), 'inf'::DOUBLE))"
       " THEN try_cast(trim({0}) AS DOUBLE) END")


@query("parse_strict_int", with_tables(TEXTS, body=f"""
SELECT event_id, {INT.format('int_text')} AS parsed, ({INT.format('int_text')}) IS NULL AS rejected
FROM texts"""))
def parse_strict_int(spark, sf_dir):
    parsed = parsing.strict_int(F.col("int_text"))
    return texts(spark, sf_dir).select(
        "event_id", parsed.alias("parsed"), parsed.isNull().alias("rejected"))


@query("parse_finite_double", with_tables(TEXTS, body=f"""
SELECT event_id, {NUM.format('number_text')} AS parsed,
       ({NUM.format('number_text')}) IS NULL AS rejected FROM texts"""))
def parse_finite_double(spark, sf_dir):
    parsed = parsing.finite_double(F.col("number_text"))
    return texts(spark, sf_dir).select(
        "event_id", parsed.alias("parsed"), parsed.isNull().alias("rejected"))


@query("parse_positive_number", with_tables(TEXTS, body=f"""
SELECT event_id, CASE WHEN i > 0 THEN i END AS positive_int, CASE WHEN d > 0 THEN d END AS positive_double
FROM (SELECT event_id, {INT.format('int_text')} AS i, {NUM.format('number_text')} AS d FROM texts)"""))
def parse_positive_number(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "event_id", parsing.positive_int(F.col("int_text")).alias("positive_int"),
        parsing.positive_double(F.col("number_text")).alias("positive_double"))


@query("parse_strict_bool", with_tables(TEXTS, body="""
SELECT event_id, CASE bool_text WHEN 'true' THEN true WHEN 'false' THEN false END AS parsed,
       bool_text NOT IN ('true', 'false') AS rejected FROM texts"""))
def parse_strict_bool(spark, sf_dir):
    parsed = parsing.strict_bool(F.col("bool_text"))
    return texts(spark, sf_dir).select(
        "event_id", parsed.alias("parsed"), parsed.isNull().alias("rejected"))


@query("check_enum", with_tables(t.SAMPLES, body="""
SELECT lig_quality, lig_quality IN ('OK', 'DISCONNECTED', 'ADC_SATURATED', 'BASELINE_INVALID',
       'DATA_GAP', 'WARMING_UP') AS known, count(*) AS n FROM samples GROUP BY ALL"""))
def check_enum(spark, sf_dir):
    known = rules.in_vocabulary(F.col("lig_quality"), contract.CHANNEL_QUALITIES)
    return t.samples(spark, sf_dir).groupBy("lig_quality", known.alias("known")).agg(
        F.count(F.lit(1)).alias("n"))


@query("check_csv_safe_id", with_tables(t.POINT_EVENTS, body="""
SELECT seq, event_id, event_id <> '' AND NOT regexp_matches(event_id, '[,\\r\\n]') AS safe
FROM point_events"""))
def check_csv_safe_id(spark, sf_dir):
    return t.point_events(spark, sf_dir).select(
        "seq", "event_id", rules.csv_safe_id(F.col("event_id")).alias("safe"))


DERIVED = """CASE WHEN cap_quality = 'WARMING_UP' OR lig_quality = 'WARMING_UP' THEN 'INITIALIZING'
            WHEN cap_quality = 'OK' AND lig_quality = 'OK' THEN 'NORMAL'
            WHEN lig_quality = 'OK' THEN 'ML_UNAVAILABLE'
            WHEN cap_quality = 'OK' THEN 'FAILSAFE_DEGRADED' ELSE 'UNSAFE' END"""


@query("derive_system_quality", with_tables(t.SAMPLES, body=f"""
SELECT seq, cap_quality, lig_quality, {DERIVED} AS derived FROM samples"""))
def derive_system_quality(spark, sf_dir):
    return t.samples(spark, sf_dir).select(
        "seq", "cap_quality", "lig_quality",
        rules.system_quality(F.col("cap_quality"), F.col("lig_quality")).alias("derived"))


@query("channel_availability", with_tables(t.SAMPLES, body="""
SELECT session_id, count(*) FILTER (cap_quality = 'OK' AND lig_quality <> 'WARMING_UP') AS ml_available,
       count(*) FILTER (lig_quality = 'OK') AS direct_available, count(*) AS n
FROM samples GROUP BY session_id"""))
def channel_availability(spark, sf_dir):
    cap, lig = F.col("cap_quality"), F.col("lig_quality")
    return t.samples(spark, sf_dir).groupBy("session_id").agg(
        F.count_if(rules.ml_available(cap, lig)).alias("ml_available"),
        F.count_if(rules.direct_detection_available(lig)).alias("direct_available"),
        F.count(F.lit(1)).alias("n"))


@query("check_session_row", with_tables(t.SESSIONS, body="""
SELECT session_id, 'fluid_type' AS rule FROM sessions WHERE fluid_type LIKE '%,%'
UNION ALL SELECT session_id, 'operator_id' FROM sessions WHERE operator_id = ''
UNION ALL SELECT session_id, 'baseline_std' FROM sessions WHERE baseline_std < 0
UNION ALL SELECT session_id, 'end_before_start' FROM sessions WHERE end_timestamp < start_timestamp"""))
def check_session_row(spark, sf_dir):
    return n.violations(t.sessions(spark, sf_dir), rules.session_rules(), ["session_id"])


@query("check_sample_row", with_tables(t.SAMPLES, body=f"""
SELECT seq, 'lig_quality' AS rule FROM samples WHERE lig_quality = 'BOGUS'
UNION ALL SELECT seq, 'activity_state' FROM samples WHERE activity_state LIKE '%,%'
UNION ALL SELECT seq, 'system_quality' FROM samples WHERE system_quality <> {DERIVED}"""))
def check_sample_row(spark, sf_dir):
    return n.violations(t.samples(spark, sf_dir), rules.sample_rules(), ["seq"])


@query("check_event_row", with_tables(t.POINT_EVENTS, body="""
SELECT seq, 'event_id' AS rule FROM point_events WHERE event_id LIKE '%,%'
UNION ALL SELECT seq, 'event_metadata' FROM point_events WHERE k IN (30, 31, 32)"""))
def check_event_row(spark, sf_dir):
    return n.violations(t.point_events(spark, sf_dir), rules.event_rules(), ["seq"])


@query("parse_event_metadata", with_tables(t.POINT_EVENTS, body="""
SELECT seq, k NOT IN (30, 31, 32) AS valid_object,
       CASE WHEN k NOT IN (30, 31, 32) THEN k END AS meta_k FROM point_events"""))
def parse_event_metadata(spark, sf_dir):
    valid = parsing.json_object_is_finite(F.col("event_metadata"))
    number = F.try_variant_get(F.try_parse_json("event_metadata"), "$.k", "bigint")
    return t.point_events(spark, sf_dir).select(
        "seq", valid.alias("valid_object"), F.when(valid, number).alias("meta_k"))


@query("check_version_regex", with_tables(t.PLAN, body="""
SELECT session_id, protocol_version,
       regexp_full_match(protocol_version, 'v0[.]1-[A-Za-z0-9][A-Za-z0-9._-]*') AS tagged
FROM plan"""))
def check_version_regex(spark, sf_dir):
    return t.plan(spark, sf_dir).select(
        "session_id", "protocol_version",
        F.col("protocol_version").rlike(contract.PROTOCOL_VERSION_PATTERN).alias("tagged"))


@query("check_reading_range", with_tables(t.LOGGER, body="""
SELECT session_id, sample_no, price BETWEEN 0 AND 60000 AND price_status <> '' AS usable
FROM logger"""))
def check_reading_range(spark, sf_dir):
    usable = rules.reading_in_range(F.col("price"), F.col("price_status"), maximum=60_000)
    return t.logger(spark, sf_dir).select("session_id", "sample_no", usable.alias("usable"))


# published rows -------------------------------------------------------------------------

OUTPUTS = t.EV + """, outputs AS (
  SELECT event_id, event_type <> 'error' AS prediction_available,
         CASE event_type WHEN 'error' THEN 'LIVE' WHEN 'view' THEN 'ENGINEERING_TEST'
              WHEN 'signup' THEN 'LIVE' ELSE 'LIVE_EXPERIMENTAL' END AS mode,
         CASE event_type WHEN 'error' THEN 'NONE' WHEN 'view' THEN 'SYNTHETIC_FIXTURE'
              ELSE 'REAL_SENSOR' END AS data_source,
         CASE event_type WHEN 'error' THEN 'UNAVAILABLE' WHEN 'view' THEN 'TEST_ONLY'
              ELSE 'UNVALIDATED' END AS model_status,
         CASE event_type WHEN 'error' THEN CASE WHEN k = 1 THEN 'Kap_7' END
              WHEN 'view' THEN 'SYNTHETIC_CAPACITIVE' ELSE 'Kap_7' END AS model_input_channel,
         CASE WHEN event_type <> 'error' THEN '0.1.0' END AS model_artifact_version,
         CASE event_type WHEN 'error' THEN 'NO_PREDICTION' WHEN 'view' THEN
              CASE WHEN k = 2 THEN 'NO_PREDICTION' ELSE 'PIPELINE_MECHANICS_ONLY' END
              ELSE 'EXPERIMENTAL_UNVALIDATED' END AS evidence_scope,
         CASE WHEN k = 3 THEN ' ' ELSE 'not for clinical use' END AS warning,
         CASE WHEN event_type = 'error' THEN CASE WHEN k = 4 THEN 'Safe' END
              WHEN k = 5 THEN 'Severe' WHEN k % 4 = 0 THEN 'Safe' WHEN k % 4 = 1 THEN 'Monitor'
              WHEN k % 4 = 2 THEN 'Caution' ELSE 'Urgent' END AS risk_class,
         CASE WHEN event_type <> 'error' THEN CASE WHEN k = 6 THEN 0 ELSE k % 4 END END
           AS risk_class_index,
         CASE WHEN event_type <> 'error' THEN CASE WHEN k = 7 THEN -1 ELSE timestamp END END
           AS source_window_end_ms,
         CASE WHEN event_type <> 'error' THEN CASE WHEN k = 8 THEN 'ABC' ELSE sha256(props) END END
           AS model_artifact_sha256, k
  FROM ev)"""


def outputs(spark, sf_dir):
    k, kind = F.col("k"), F.col("event_type")
    off = kind == "error"
    return t.ev(spark, sf_dir).select(
        "event_id", (~off).alias("prediction_available"),
        F.when(off, "LIVE").when(kind == "view", "ENGINEERING_TEST").when(kind == "signup", "LIVE")
        .otherwise("LIVE_EXPERIMENTAL").alias("mode"),
        F.when(off, "NONE").when(kind == "view", "SYNTHETIC_FIXTURE").otherwise("REAL_SENSOR")
        .alias("data_source"),
        F.when(off, "UNAVAILABLE").when(kind == "view", "TEST_ONLY").otherwise("UNVALIDATED")
        .alias("model_status"),
        F.when(off, F.when(k == 1, "Kap_7")).when(kind == "view", "SYNTHETIC_CAPACITIVE")
        .otherwise("Kap_7").alias("model_input_channel"),
        F.when(~off, "0.1.0").alias("model_artifact_version"),
        F.when(off, "NO_PREDICTION").when((kind == "view") & (k == 2), "NO_PREDICTION")
        .when(kind == "view", "PIPELINE_MECHANICS_ONLY").otherwise("EXPERIMENTAL_UNVALIDATED")
        .alias("evidence_scope"),
        F.when(k == 3, " ").otherwise("not for clinical use").alias("warning"),
        F.when(off, F.when(k == 4, "Safe")).when(k == 5, "Severe").when(k % 4 == 0, "Safe")
        .when(k % 4 == 1, "Monitor").when(k % 4 == 2, "Caution").otherwise("Urgent")
        .alias("risk_class"),
        F.when(~off, F.when(k == 6, 0).otherwise(k % 4)).alias("risk_class_index"),
        F.when(~off, F.when(k == 7, -1).otherwise(F.col("timestamp"))).alias("source_window_end_ms"),
        F.when(~off, F.when(k == 8, "ABC").otherwise(F.sha2("props", 256)))
        .alias("model_artifact_sha256"))


@query("check_output_state", with_tables(OUTPUTS, body="""
SELECT event_id, 'mode' AS rule FROM outputs WHERE prediction_available AND mode = 'LIVE'
UNION ALL SELECT event_id, 'model_input_channel' FROM outputs
  WHERE NOT prediction_available AND model_input_channel IS NOT NULL
UNION ALL SELECT event_id, 'evidence_scope' FROM outputs
  WHERE mode = 'ENGINEERING_TEST' AND evidence_scope <> 'PIPELINE_MECHANICS_ONLY'
UNION ALL SELECT event_id, 'warning' FROM outputs WHERE trim(warning) = ''
UNION ALL SELECT event_id, 'risk_class' FROM outputs
  WHERE (NOT prediction_available AND risk_class IS NOT NULL) OR risk_class = 'Severe'
UNION ALL SELECT event_id, 'risk_class_index' FROM outputs
  WHERE prediction_available AND risk_class_index IS DISTINCT FROM
    CASE risk_class WHEN 'Safe' THEN 0 WHEN 'Monitor' THEN 1 WHEN 'Caution' THEN 2
                    WHEN 'Urgent' THEN 3 ELSE -1 END
UNION ALL SELECT event_id, 'source_window_end_ms' FROM outputs WHERE source_window_end_ms < 0
UNION ALL SELECT event_id, 'model_artifact_sha256' FROM outputs WHERE model_artifact_sha256 = 'ABC'
"""))
def check_output_state(spark, sf_dir):
    return n.violations(outputs(spark, sf_dir), rules.output_state_rules(), ["event_id"])


@query("check_feature_vector_row", with_tables(t.EV, body="""
SELECT event_id, 'feature_input_version' AS rule FROM ev WHERE k = 1
UNION ALL SELECT event_id, 'data_source' FROM ev WHERE k = 2
UNION ALL SELECT event_id, 'features' FROM ev WHERE k IN (3, 4)
UNION ALL SELECT event_id, 'source_window_end_ms' FROM ev WHERE k = 5
UNION ALL SELECT event_id, 'feature_order' FROM ev WHERE k = 6"""))
def check_feature_vector_row(spark, sf_dir):
    k, v = F.col("k"), F.col("value")
    order = [F.lit(name) for name in contract.FEATURE_COLUMNS]
    values = F.array(v, v, v, v, v)
    document = t.ev(spark, sf_dir).select(
        "event_id",
        F.when(k == 1, "0.2.0").otherwise("0.1.0").alias("feature_input_version"),
        F.when(k == 2, "NONE").otherwise("REAL_SENSOR").alias("data_source"),
        F.lit("Kap_7").alias("model_input_channel"),
        F.lit("RAW_MINUS_SESSION_BASELINE").alias("feature_basis"),
        F.when(k == 6, F.array(*order[::-1])).otherwise(F.array(*order)).alias("feature_order"),
        F.when(k == 3, F.array(v)).when(k == 4, F.array(v, v, v, v, F.lit(float("nan"))))
        .otherwise(values).alias("features"),
        F.when(k == 5, -1).otherwise(F.col("timestamp")).alias("source_window_end_ms"))
    return n.violations(document, rules.feature_vector_rules(), ["event_id"])


# keys and joins -------------------------------------------------------------------------

@query("duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    return n.duplicate_keys(t.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("duplicate_event_id_first_seen", with_tables(t.POINT_EVENTS, body="""
SELECT event_id, session_id, seq, timestamp, first_seen_in FROM (
  SELECT *, row_number() OVER w AS nth, first_value(session_id) OVER w AS first_seen_in
  FROM point_events WHERE event_id NOT LIKE '%,%'
  WINDOW w AS (PARTITION BY event_id ORDER BY user_id, seq)) WHERE nth > 1"""))
def duplicate_event_id_first_seen(spark, sf_dir):
    from driftline.operators.qc import duplicate_event_ids

    return duplicate_event_ids(t.point_events(spark, sf_dir), session_order="user_id")


@query("orphan_rows", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def orphan_rows(spark, sf_dir):
    settled = t.table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("l_orderkey"))
    lines = t.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return n.orphan_rows(lines, settled, "l_orderkey")


@query("extra_manifest_rows", with_tables(t.SESSIONS, t.PLAN, body="""
SELECT session_id, planned_arm FROM plan WHERE session_id NOT IN (SELECT session_id FROM sessions)"""))
def extra_manifest_rows(spark, sf_dir):
    plan = t.plan(spark, sf_dir).select("session_id", "planned_arm")
    return n.extra_manifest_rows(plan, t.sessions(spark, sf_dir))


@query("key_set_difference", """
SELECT coalesce(c_custkey, o_custkey) AS custkey,
       CASE WHEN o_custkey IS NULL THEN 'left_only' ELSE 'right_only' END AS side
FROM customer FULL OUTER JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') o
  ON c_custkey = o_custkey WHERE c_custkey IS NULL OR o_custkey IS NULL""")
def key_set_difference(spark, sf_dir):
    customers = t.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))
    pending = t.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("custkey"))
    return n.key_set_difference(customers, pending, "custkey")


@query("rows_outside_session", with_tables(t.QC_SESSIONS, body="""
SELECT session_id, count(*) AS outside_count, arg_min(timestamp, seq) AS first_outside_timestamp
FROM qc_samples JOIN qc_sessions USING (session_id)
WHERE NOT timestamp BETWEEN start_timestamp AND end_timestamp GROUP BY session_id"""))
def rows_outside_session(spark, sf_dir):
    rows = t.qc_samples(spark, sf_dir)
    return n.rows_outside_session(rows, t.sessions_of(rows))


@query("field_agreement", with_tables(t.SESSIONS, t.PLAN, body="""
SELECT * FROM (
  SELECT s.session_id, concat_ws(',', CASE WHEN s.arm <> p.planned_arm THEN 'arm' END,
         CASE WHEN s.operator_id <> p.operator_id THEN 'operator_id' END,
         CASE WHEN s.bag_id <> p.bag_id THEN 'bag_id' END,
         CASE WHEN s.sensor_id <> p.sensor_id THEN 'sensor_id' END,
         CASE WHEN s.device_id <> p.device_id THEN 'device_id' END) AS mismatched_fields
  FROM sessions s JOIN plan p USING (session_id)) WHERE mismatched_fields <> ''"""))
def field_agreement(spark, sf_dir):
    fields = {"arm": "planned_arm", "operator_id": "operator_id", "bag_id": "bag_id",
              "sensor_id": "sensor_id", "device_id": "device_id"}
    return n.field_agreement(t.sessions(spark, sf_dir), t.plan(spark, sf_dir), "session_id", fields)


GROUPS = t.PARTITION + """, grouped AS (
  SELECT DISTINCT kind AS group_kind, gid AS group_id, dataset_partition FROM (
    SELECT 'session_id' AS kind, session_id AS gid, dataset_partition FROM part_manifest
    UNION ALL SELECT 'bag_id', bag_id, dataset_partition FROM part_manifest
    UNION ALL SELECT 'sensor_id', sensor_id, dataset_partition FROM part_manifest))"""


@query("partition_leakage", with_tables(GROUPS, body="""
SELECT group_kind, group_id, count(*) AS partition_count, min(dataset_partition) AS first_partition,
       max(dataset_partition) AS last_partition
FROM grouped GROUP BY group_kind, group_id HAVING count(*) > 1"""))
def partition_leakage(spark, sf_dir):
    return n.partition_leakage(t.partition_manifest(spark, sf_dir),
                               ["session_id", "bag_id", "sensor_id"])


@query("group_separation", with_tables(GROUPS, body="""
SELECT group_kind, dataset_partition, count(*) AS group_count,
       count(*) FILTER (spread > 1) AS shared_count
FROM (SELECT *, count(*) OVER (PARTITION BY group_kind, group_id) AS spread FROM grouped)
GROUP BY group_kind, dataset_partition"""))
def group_separation(spark, sf_dir):
    return n.group_separation(t.partition_manifest(spark, sf_dir),
                              ["session_id", "bag_id", "sensor_id"])


@query("attach_session", with_tables(t.SESSIONS, body="""
SELECT m.seq, m.session_id, m.timestamp, s.arm, s.bag_id, s.sensor_id
FROM samples m JOIN sessions s USING (session_id)"""))
def attach_session(spark, sf_dir):
    rows = t.samples(spark, sf_dir)
    return n.attach(rows.select("seq", "session_id", "timestamp"), t.sessions_of(rows),
                    ["arm", "bag_id", "sensor_id"])


@query("attach_plan", with_tables(t.SESSIONS, t.PLAN, body="""
SELECT s.session_id, s.arm, p.planned_arm, p.planned_safe_horizon_s,
       p.session_id IS NOT NULL AS plan_present
FROM sessions s LEFT JOIN (SELECT * FROM plan WHERE planned_arm <> 'BOGUS') p USING (session_id)"""))
def attach_plan(spark, sf_dir):
    usable = t.plan(spark, sf_dir).filter("planned_arm <> 'BOGUS'")
    return n.attach_plan(t.sessions(spark, sf_dir).select("session_id", "arm"), usable,
                         ["planned_arm", "planned_safe_horizon_s"])


@query("attach_partition", with_tables(t.SAMPLES, t.PARTITION, body="""
SELECT seq, session_id, dataset_partition FROM samples JOIN part_manifest USING (session_id)"""))
def attach_partition(spark, sf_dir):
    return n.attach(t.samples(spark, sf_dir).select("seq", "session_id"),
                    t.partition_manifest(spark, sf_dir), ["dataset_partition"])


# every scale from 1e-9 to 1e14, both signs, and values without a finite text
SCALED_VALUE = ("CASE k WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN CAST('Infinity' AS DOUBLE) "
                "WHEN 3 THEN CAST('-Infinity' AS DOUBLE) WHEN 4 THEN NULL WHEN 5 THEN -0.0e0 "
                "ELSE (value / 7.0e0) * (CASE WHEN event_id % 3 = 0 THEN -1.0e0 ELSE 1.0e0 END) {} END")
SCALES = tuple(range(-9, 15))
SCALE_SQL = "* CASE event_id % 24 " + " ".join(
    f"WHEN {i} THEN 1.0e{n}" for i, n in enumerate(SCALES)) + " END"


@query("canonical_text", f"""
SELECT event_id, CAST(CAST(k AS DECIMAL(10,0)) AS VARCHAR) AS k_text, is_view,
       rtrim(rtrim(printf('%.6f', {rounded('value')}), '0'), '.') AS value_text,
       CASE WHEN scaled IS NULL THEN '' WHEN isnan(scaled) THEN 'NaN'
            WHEN isinf(scaled) THEN CASE WHEN scaled > 0 THEN 'Infinity' ELSE '-Infinity' END
            WHEN scaled = 0 THEN '0' ELSE printf('%.12g', scaled) END AS significant_text
FROM (SELECT event_id, k, value, is_view, {SCALED_VALUE.format(SCALE_SQL)} AS scaled
      FROM (SELECT event_id, value, CASE WHEN event_type = 'view' THEN 'true' ELSE 'false' END AS is_view,
                   CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))""")
def canonical_text(spark, sf_dir):
    from driftline.functions import rounding

    k, which = F.col("k"), F.col("event_id") % 24
    scale = F.coalesce(*[F.when(which == i, F.lit(float(f"1e{n}"))) for i, n in enumerate(SCALES)])
    sign = F.when(F.col("event_id") % 3 == 0, -1.0).otherwise(1.0)
    special = {1: float("nan"), 2: float("inf"), 3: -float("inf"), 5: -0.0}
    scaled = F.when(k != 4, F.coalesce(
        *[F.when(k == i, F.lit(x)) for i, x in special.items()], F.col("value") / 7.0 * sign * scale))
    rows = t.ev(spark, sf_dir).withColumn("scaled", scaled)
    return rows.select(
        "event_id", rounding.canonical_number(k.cast("double"), 0).alias("k_text"),
        rounding.canonical_boolean(F.col("event_type") == "view").alias("is_view"),
        rounding.canonical_number(F.col("value")).alias("value_text"),
        rounding.canonical_significant(F.col("scaled")).alias("significant_text"))
