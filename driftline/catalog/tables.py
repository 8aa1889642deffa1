"""How the provided tables play the roles of the data contract.

``events`` is the sample and event stream (session = user), ``customer`` the
plan and partition manifests, ``lineitem`` the wide multi-channel logger
(session = supplier).  Faults are derived from the ``k`` of ``events.props``.
Each view exists twice: as a DataFrame and as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftline.functions.rules import system_quality
from driftline.operators.ordered import row_sequence
from driftline.operators.qc import QcConfig
from driftline.operators.windows import WindowSpec

HOUR = 3_600_000
DAY = 24 * HOUR

EVENT_WINDOWS = WindowSpec(
    window=7 * DAY, stride=DAY, expected=None, minimum=8,
    interval_low=60_000, interval_high=2 * DAY, decimals=4, slope_unit_ms=DAY)
EVENT_QC = QcConfig(
    expected_interval_ms=12 * HOUR, jitter_tolerance_ms=10 * HOUR,
    unmarked_gap_threshold_ms=36 * HOUR, minimum_pre_injection_dry_s=5 * 86_400,
    baseline_window_s=5 * 86_400, block_rows=1_000_000, block_ms=DAY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _millis(ts):
    """Epoch milliseconds of a zone-less timestamp, whatever the session zone."""
    return F.expr(f"cast(cast(cast({ts} - timestamp_ntz'1970-01-01 00:00:00' as interval second)"
                  " as decimal(20,6)) * 1000 as bigint)")


# events ------------------------------------------------------------------------------

EV = """ev AS (
  SELECT event_id, user_id, 'u' || user_id AS session_id, epoch_us(ts) // 1000 AS timestamp,
         event_type, value, props, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events)"""


def ev(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.concat(F.lit("u"), F.col("user_id")).alias("session_id"),
        _millis("ts").alias("timestamp"), "event_type", "value", "props",
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"))


SAMPLES = EV + """, samples AS (
  SELECT *, CASE WHEN k = 5 THEN 'UNSAFE'
                 WHEN cap_quality = 'WARMING_UP' OR lig_quality = 'WARMING_UP' THEN 'INITIALIZING'
                 WHEN cap_quality = 'OK' AND lig_quality = 'OK' THEN 'NORMAL'
                 WHEN lig_quality = 'OK' THEN 'ML_UNAVAILABLE'
                 WHEN cap_quality = 'OK' THEN 'FAILSAFE_DEGRADED' ELSE 'UNSAFE' END AS system_quality
  FROM (SELECT event_id AS seq, user_id, session_id, timestamp, value AS capacitance_raw,
               value / 2 AS lig_raw,
               CASE k WHEN 0 THEN 'DISCONNECTED' WHEN 1 THEN 'WARMING_UP' WHEN 2 THEN 'DATA_GAP'
                      ELSE 'OK' END AS cap_quality,
               CASE k WHEN 3 THEN 'ADC_SATURATED' WHEN 1 THEN 'WARMING_UP' WHEN 4 THEN 'WARMING_UP'
                      WHEN 6 THEN 'BOGUS' WHEN 0 THEN 'DISCONNECTED' ELSE 'OK' END AS lig_quality,
               CASE WHEN k = 13 THEN 'sit,stand' ELSE event_type END AS activity_state,
               CASE WHEN k = 14 THEN '' ELSE 'front' END AS orientation_position, k
        FROM ev))"""


def samples(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    cap = F.when(k == 0, "DISCONNECTED").when(k == 1, "WARMING_UP").when(k == 2, "DATA_GAP") \
        .otherwise("OK")
    lig = F.when(k == 3, "ADC_SATURATED").when(k.isin(1, 4), "WARMING_UP").when(k == 6, "BOGUS") \
        .when(k == 0, "DISCONNECTED").otherwise("OK")
    return ev(spark, sf_dir).select(
        F.col("event_id").alias("seq"), "user_id", "session_id", "timestamp",
        F.col("value").alias("capacitance_raw"), (F.col("value") / 2).alias("lig_raw"),
        cap.alias("cap_quality"), lig.alias("lig_quality"),
        F.when(k == 13, "sit,stand").otherwise(F.col("event_type")).alias("activity_state"),
        F.when(k == 14, "").otherwise("front").alias("orientation_position"), "k",
    ).withColumn("system_quality", F.when(F.col("k") == 5, "UNSAFE").otherwise(
        system_quality(F.col("cap_quality"), F.col("lig_quality"))))


_SESSION_SQL = """SELECT session_id, user_id,
         CASE WHEN user_id % 8 < 4 THEN 'LEAK_GRADUAL' WHEN user_id % 8 < 6 THEN 'SAFE'
              WHEN user_id % 8 = 6 THEN 'LEAK_SUDDEN' ELSE 'FIELD' END AS arm,
         'bag-' || (user_id // 2) AS bag_id, 'sen-' || (user_id % 11) AS sensor_id,
         'dev-' || (user_id % 3) AS device_id,
         CASE WHEN user_id % 40 = 3 THEN 'sal,ine' ELSE 'saline' END AS fluid_type,
         CASE WHEN user_id % 30 = 9 THEN '' ELSE 'op-' || (user_id % 5) END AS operator_id,
         arg_min(capacitance_raw, seq) AS baseline_value,
         CASE WHEN user_id % 50 = 7 THEN -1.0e0 ELSE 1.5e0 END AS baseline_std,
         min(timestamp) + CASE WHEN user_id % 9 = 2 THEN 7200000 ELSE 0 END AS start_timestamp,
         max(timestamp) AS end_timestamp,
         CASE user_id % 3 WHEN 0 THEN 'CEILING_REACHED' WHEN 1 THEN 'LEAK_CONFIRMED'
              ELSE 'MANUAL_STOP' END AS end_reason,
         '' AS model_version, 'fw-1' AS firmware_version
  FROM {source} GROUP BY session_id, user_id"""
SESSIONS = SAMPLES + ", sessions AS (" + _SESSION_SQL.format(source="samples") + ")"


def sessions_of(rows: DataFrame) -> DataFrame:
    u = F.col("user_id")
    facts = rows.groupBy("session_id", "user_id").agg(
        F.min_by("capacitance_raw", "seq").alias("baseline_value"),
        F.min("timestamp").alias("_first"), F.max("timestamp").alias("end_timestamp"))
    return facts.select(
        "session_id", "user_id",
        F.when(u % 8 < 4, "LEAK_GRADUAL").when(u % 8 < 6, "SAFE").when(u % 8 == 6, "LEAK_SUDDEN")
        .otherwise("FIELD").alias("arm"),
        F.concat(F.lit("bag-"), F.floor(u / 2)).alias("bag_id"),
        F.concat(F.lit("sen-"), u % 11).alias("sensor_id"),
        F.concat(F.lit("dev-"), u % 3).alias("device_id"),
        F.when(u % 40 == 3, "sal,ine").otherwise("saline").alias("fluid_type"),
        F.when(u % 30 == 9, "").otherwise(F.concat(F.lit("op-"), u % 5)).alias("operator_id"),
        "baseline_value",
        F.when(u % 50 == 7, -1.0).otherwise(1.5).alias("baseline_std"),
        (F.col("_first") + F.when(u % 9 == 2, 7_200_000).otherwise(0)).alias("start_timestamp"),
        "end_timestamp",
        F.when(u % 3 == 0, "CEILING_REACHED").when(u % 3 == 1, "LEAK_CONFIRMED")
        .otherwise("MANUAL_STOP").alias("end_reason"),
        F.lit("").alias("model_version"), F.lit("fw-1").alias("firmware_version"))


def sessions(spark, sf_dir) -> DataFrame:
    return sessions_of(samples(spark, sf_dir))


# quality-gate views: hour-resolution clock, some rows a day late, two channels ---------

QC_SAMPLES = SAMPLES + f""", qc_samples AS (
  SELECT * REPLACE ((timestamp // {HOUR}) * {HOUR} - CASE WHEN k = 10 THEN {DAY} ELSE 0 END
                    AS timestamp)
  FROM samples)"""
QC_SESSIONS = QC_SAMPLES + ", qc_sessions AS (" + _SESSION_SQL.format(source="qc_samples") + ")"


def qc_samples(spark, sf_dir) -> DataFrame:
    hour = F.floor(F.col("timestamp") / HOUR) * HOUR
    return samples(spark, sf_dir).withColumn(
        "timestamp", hour - F.when(F.col("k") == 10, DAY).otherwise(0))


def qc_sessions(spark, sf_dir) -> DataFrame:
    return sessions_of(qc_samples(spark, sf_dir))


POINT_EVENTS = EV + """, point_events AS (
  SELECT event_id AS seq,
         CASE WHEN k = 20 THEN 'e' || (event_id // 2) WHEN k = 21 THEN 'e,x'
              ELSE 'e' || event_id END AS event_id,
         session_id, user_id, timestamp,
         CASE event_type WHEN 'signup' THEN 'INJECTION_START' WHEN 'click' THEN 'INJECTION_END'
              WHEN 'purchase' THEN CASE WHEN k < 5 THEN 'PHYSICAL_LEAK_OBSERVED'
                                        WHEN k < 50 THEN 'LEAK_FLAG_CONFIRMED' ELSE 'ALERT_RAISED' END
              WHEN 'error' THEN CASE WHEN k < 10 THEN 'DEVICE_RESTART' ELSE 'ALERT_IGNORED' END
              ELSE 'LEAK_FLAG_FIRST' END AS event_type,
         CASE k WHEN 30 THEN '{"k": NaN}' WHEN 31 THEN '[1]' WHEN 32 THEN 'oops'
                ELSE props END AS event_metadata, k
  FROM ev)"""


def point_events(spark, sf_dir) -> DataFrame:
    k, t = F.col("k"), F.col("event_type")
    kind = (
        F.when(t == "signup", "INJECTION_START").when(t == "click", "INJECTION_END")
        .when((t == "purchase") & (k < 5), "PHYSICAL_LEAK_OBSERVED")
        .when((t == "purchase") & (k < 50), "LEAK_FLAG_CONFIRMED")
        .when(t == "purchase", "ALERT_RAISED")
        .when((t == "error") & (k < 10), "DEVICE_RESTART").when(t == "error", "ALERT_IGNORED")
        .otherwise("LEAK_FLAG_FIRST"))
    return ev(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        F.when(k == 20, F.concat(F.lit("e"), F.floor(F.col("event_id") / 2)))
        .when(k == 21, "e,x").otherwise(F.concat(F.lit("e"), F.col("event_id"))).alias("event_id"),
        "session_id", "user_id", "timestamp", kind.alias("event_type"),
        F.when(k == 30, '{"k": NaN}').when(k == 31, "[1]").when(k == 32, "oops")
        .otherwise(F.col("props")).alias("event_metadata"), "k")


# manifests ---------------------------------------------------------------------------

PLAN = """plan AS (
  SELECT 'u' || c_custkey AS session_id,
         CASE WHEN c_nationkey = 7 THEN 'v0.1' ELSE 'v0.1-' || lower(c_mktsegment) END
           AS protocol_version,
         CASE WHEN c_nationkey = 3 THEN 'BOGUS' WHEN c_nationkey = 4 THEN 'SAFE'
              WHEN c_custkey % 8 < 4 THEN 'LEAK_GRADUAL' WHEN c_custkey % 8 < 6 THEN 'SAFE'
              WHEN c_custkey % 8 = 6 THEN 'LEAK_SUDDEN' ELSE 'FIELD' END AS planned_arm,
         CASE WHEN c_nationkey = 5 THEN '-5' WHEN c_nationkey = 6 THEN 'soon'
              WHEN c_custkey % 8 IN (2, 3, 4, 5) THEN CAST(86400 * (1 + c_custkey % 5) AS VARCHAR)
              ELSE '' END AS planned_safe_horizon_s,
         CASE WHEN c_nationkey = 8 THEN '' ELSE '250ml' END AS target_fill_or_volume,
         CASE WHEN c_custkey % 8 IN (4, 5) THEN '' WHEN c_nationkey = 9 THEN 'ramp'
              ELSE 'stepwise' END AS injection_profile,
         CASE WHEN c_custkey % 8 IN (4, 5) THEN '' ELSE 'pump' END AS injection_method,
         CASE WHEN c_custkey % 8 IN (4, 5) THEN '' WHEN c_nationkey = 10 THEN 'fast'
              ELSE '1.5' END AS planned_flow_ml_min,
         CASE WHEN c_nationkey = 11 THEN '' ELSE 'camera' END AS physical_leak_observation_method,
         'op-' || (c_custkey % 5) AS operator_id, 'bag-' || (c_custkey // 2) AS bag_id,
         'sen-' || (CASE WHEN c_nationkey = 12 THEN 99 ELSE c_custkey % 11 END) AS sensor_id,
         'dev-' || (c_custkey % 3) AS device_id
  FROM customer)"""


def plan(spark, sf_dir) -> DataFrame:
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    dry = (c % 8).isin(4, 5)
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), c).alias("session_id"),
        F.when(n == 7, "v0.1").otherwise(F.concat(F.lit("v0.1-"), F.lower("c_mktsegment")))
        .alias("protocol_version"),
        F.when(n == 3, "BOGUS").when(n == 4, "SAFE").when(c % 8 < 4, "LEAK_GRADUAL")
        .when(c % 8 < 6, "SAFE").when(c % 8 == 6, "LEAK_SUDDEN").otherwise("FIELD")
        .alias("planned_arm"),
        F.when(n == 5, "-5").when(n == 6, "soon")
        .when((c % 8).isin(2, 3, 4, 5), (86_400 * (1 + c % 5)).cast("string")).otherwise("")
        .alias("planned_safe_horizon_s"),
        F.when(n == 8, "").otherwise("250ml").alias("target_fill_or_volume"),
        F.when(dry, "").when(n == 9, "ramp").otherwise("stepwise").alias("injection_profile"),
        F.when(dry, "").otherwise("pump").alias("injection_method"),
        F.when(dry, "").when(n == 10, "fast").otherwise("1.5").alias("planned_flow_ml_min"),
        F.when(n == 11, "").otherwise("camera").alias("physical_leak_observation_method"),
        F.concat(F.lit("op-"), c % 5).alias("operator_id"),
        F.concat(F.lit("bag-"), F.floor(c / 2)).alias("bag_id"),
        F.concat(F.lit("sen-"), F.when(n == 12, F.lit(99)).otherwise(c % 11)).alias("sensor_id"),
        F.concat(F.lit("dev-"), c % 3).alias("device_id"))


PARTITION = """part_manifest AS (
  SELECT 'u' || c_custkey AS session_id,
         CASE WHEN (c_custkey // 2) % 5 < 3 THEN 'development'
              WHEN (c_custkey // 2) % 5 = 3 THEN 'validation' ELSE 'final_test' END
           AS dataset_partition,
         'p-1' AS partition_version, 'bag-' || (c_custkey // 2) AS bag_id,
         'sen-' || (c_custkey % 11) AS sensor_id
  FROM customer)"""


def partition_manifest(spark, sf_dir) -> DataFrame:
    c = F.col("c_custkey")
    group = F.floor(c / 2) % 5
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), c).alias("session_id"),
        F.when(group < 3, "development").when(group == 3, "validation").otherwise("final_test")
        .alias("dataset_partition"),
        F.lit("p-1").alias("partition_version"),
        F.concat(F.lit("bag-"), F.floor(c / 2)).alias("bag_id"),
        F.concat(F.lit("sen-"), c % 11).alias("sensor_id"))


# wide logger -------------------------------------------------------------------------

CHANNELS = {"qty": "qty_status", "price": "price_status", "disc": "disc_status", "tax": "tax_status"}

LOGGER = """logger AS (
  SELECT 's' || l_suppkey AS session_id, sample_no, 100 + 100 * sample_no AS elapsed_ms,
         l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax,
         l_returnflag AS qty_status, l_linestatus AS price_status,
         CASE WHEN l_discount = 0 AND l_tax = 0 AND l_quantity >= 47 THEN 'DISCONNECTED'
              ELSE 'OK' END AS disc_status,
         CASE WHEN l_quantity <= 25 THEN 'OK' ELSE 'NOT_EVALUATED' END AS tax_status
  FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber,
               l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate,
               l_returnflag, l_linestatus) - 1 AS sample_no FROM lineitem))"""

LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def logger(spark, sf_dir) -> DataFrame:
    numbered = row_sequence(table(spark, sf_dir, "lineitem"), ["l_suppkey"], LINEITEM_ORDER,
                            block_width=5_000_000, name="sample_no")
    idle = (F.col("l_discount") == 0) & (F.col("l_tax") == 0) & (F.col("l_quantity") >= 47)
    return numbered.select(
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("session_id"), "sample_no",
        (100 + 100 * F.col("sample_no")).alias("elapsed_ms"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("qty_status"), F.col("l_linestatus").alias("price_status"),
        F.when(idle, "DISCONNECTED").otherwise("OK").alias("disc_status"),
        F.when(F.col("l_quantity") <= 25, "OK").otherwise("NOT_EVALUATED").alias("tax_status"))
