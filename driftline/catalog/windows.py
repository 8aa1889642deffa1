"""Window operators over the event stream and the logger."""

from pyspark.sql import functions as F

from driftline.catalog import tables as t
from driftline.catalog.registry import query, rounded, with_tables
from driftline.functions.rules import assert_features_allowed
from driftline.operators import windows as w

SPEC = t.EVENT_WINDOWS

SPINE = t.SESSIONS + f""", anchors AS (
  SELECT session_id, min(timestamp) AS t_ref FROM samples GROUP BY session_id),
spine AS (
  SELECT s.session_id, bag_id, sensor_id, baseline_value, window_index,
         t_ref + window_index * {SPEC.stride} AS window_start,
         t_ref + window_index * {SPEC.stride} + {SPEC.window} AS window_end
  FROM (SELECT *, unnest(range(0, (end_timestamp - t_ref - {SPEC.window}) // {SPEC.stride} + 1))
               AS window_index
        FROM sessions JOIN anchors USING (session_id)
        WHERE end_timestamp - t_ref >= {SPEC.window}) s)"""
MEMBERS = SPINE + f""", members AS (
  SELECT p.session_id, p.window_index, p.window_start, m.seq, m.timestamp, m.capacitance_raw,
         m.cap_quality, m.capacitance_raw - p.baseline_value AS delta,
         m.timestamp - lag(m.timestamp) OVER (PARTITION BY p.session_id, p.window_index
                                              ORDER BY m.timestamp, m.seq) AS step
  FROM spine p JOIN samples m ON m.session_id = p.session_id
   AND m.timestamp > p.window_start AND m.timestamp <= p.window_end)"""
STATS = MEMBERS + f""", stats AS (
  SELECT session_id, window_index, count(*) AS n, count(*) - count(DISTINCT timestamp) AS repeats,
         count(*) FILTER (step < {SPEC.interval_low} OR step > {SPEC.interval_high}) AS faults,
         count(*) FILTER (cap_quality <> 'OK') AS bad,
         avg(delta) AS f_mean, arg_max(delta, timestamp) AS f_last,
         CASE WHEN count(*) > 1 THEN
           regr_slope(delta, (timestamp - window_start) / {SPEC.slope_unit_ms}.0e0) END AS f_slope,
         var_pop(delta) AS f_var, max(delta) - min(delta) AS f_range
  FROM members GROUP BY session_id, window_index),
judged AS (
  SELECT p.session_id || '-win-' || lpad(CAST(p.window_index AS VARCHAR), 4, '0') AS window_id,
         p.*, coalesce(n, 0) AS sample_count, f_mean, f_last, f_slope, f_var, f_range,
         CASE WHEN repeats > 0 THEN 'DUPLICATE_TIMESTAMP'
              WHEN coalesce(n, 0) < {SPEC.minimum} THEN 'PARTIAL_WINDOW'
              WHEN faults > 0 THEN 'TIMING_OUT_OF_TOLERANCE'
              WHEN bad > 0 THEN 'INVALID_CAP_QUALITY' ELSE '' END AS exclusion_reason
  FROM spine p LEFT JOIN stats s ON p.session_id = s.session_id
                                AND p.window_index = s.window_index)"""


def _feature(source, condition=None):
    value = rounded(source, SPEC.decimals)
    return f"CASE WHEN {condition} THEN {value} END" if condition else value


def features_sql(condition=None):
    return f"""{_feature('f_mean', condition)} AS cap_delta_mean,
         {_feature('f_last', condition)} AS cap_delta_last,
         {_feature('f_slope', condition)} AS cap_delta_slope_per_s,
         {_feature('f_var', condition)} AS cap_delta_variance,
         {_feature('f_range', condition)} AS cap_delta_range"""


FEATURES = STATS + f""", features AS (
  SELECT window_id, session_id, bag_id, sensor_id, window_index, window_start, window_end,
         sample_count, exclusion_reason = '' AS feature_valid, exclusion_reason,
         {features_sql("exclusion_reason = ''")}
  FROM judged)"""


def feature_table(spark, sf_dir):
    rows = t.samples(spark, sf_dir)
    return w.feature_table(rows, t.sessions_of(rows), SPEC)


query("feature_table", with_tables(FEATURES, body="SELECT * FROM features"))(feature_table)


@query("window_spine", with_tables(SPINE, body="""
SELECT session_id, window_index, window_start, window_end FROM spine"""))
def window_spine(spark, sf_dir):
    rows = t.samples(spark, sf_dir)
    return w.window_spine(t.sessions_of(rows), w.session_anchors(rows), SPEC).select(
        "session_id", "window_index", "window_start", "window_end")


@query("sliding_membership", with_tables(MEMBERS, body="""
SELECT session_id, window_index, seq, timestamp FROM members"""))
def sliding_membership(spark, sf_dir):
    rows = t.samples(spark, sf_dir)
    return w.sliding_membership(rows, t.sessions_of(rows), SPEC).select(
        "session_id", "window_index", "seq", "timestamp")


def _statistics(spark, sf_dir):
    rows = t.samples(spark, sf_dir)
    keep = t.sessions_of(rows).select(
        "session_id", "bag_id", "sensor_id", "baseline_value", "end_timestamp")
    return w.window_statistics(rows, keep, SPEC)


@query("window_validity", with_tables(STATS, body="""
SELECT session_id, window_index, sample_count, exclusion_reason = '' AS feature_valid,
       exclusion_reason FROM judged"""))
def window_validity(spark, sf_dir):
    return w.window_validity(_statistics(spark, sf_dir), SPEC).select(
        "session_id", "window_index", "sample_count", "feature_valid", "exclusion_reason")


@query("window_features", with_tables(STATS, body=f"""
SELECT session_id, window_index, {features_sql()} FROM judged WHERE sample_count > 0"""))
def window_features(spark, sf_dir):
    return w.window_features(_statistics(spark, sf_dir), SPEC).select(
        "session_id", "window_index", *w.contract.FEATURE_COLUMNS)


@query("exclusion_counts", with_tables(FEATURES, body="""
SELECT r.exclusion_reason, count(f.window_id) AS window_count
FROM (VALUES (''), ('DUPLICATE_TIMESTAMP'), ('PARTIAL_WINDOW'), ('TIMING_OUT_OF_TOLERANCE'),
             ('INVALID_CAP_QUALITY')) r(exclusion_reason)
LEFT JOIN features f USING (exclusion_reason) GROUP BY 1"""))
def exclusion_counts(spark, sf_dir):
    return w.exclusion_counts(feature_table(spark, sf_dir))


@query("format_window_id", with_tables(SPINE, body="""
SELECT session_id, window_index,
       session_id || '-win-' || lpad(CAST(window_index AS VARCHAR), 4, '0') AS window_id,
       session_id || '-w' || lpad(CAST(window_index AS VARCHAR), 4, '0') AS grid_window_id
FROM spine"""))
def format_window_id(spark, sf_dir):
    index = F.col("window_index")
    return window_spine(spark, sf_dir).select(
        "session_id", "window_index",
        w.window_id(F.col("session_id"), index).alias("window_id"),
        w.window_id(F.col("session_id"), index, "-w").alias("grid_window_id"))


@query("feature_allowlist", with_tables(FEATURES, body="""
SELECT window_id, cap_delta_mean, cap_delta_last, cap_delta_slope_per_s, cap_delta_variance,
       cap_delta_range FROM features WHERE feature_valid"""))
def feature_allowlist(spark, sf_dir):
    assert_features_allowed(w.contract.FEATURE_COLUMNS)
    return feature_table(spark, sf_dir).filter("feature_valid").select(
        "window_id", *w.contract.FEATURE_COLUMNS)
