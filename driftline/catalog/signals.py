"""Resampling, normalisation, grid windows and statistics over the wide logger."""

from itertools import combinations

from pyspark.sql import functions as F

from driftline.catalog import tables as t
from driftline.catalog.registry import query, rounded, with_tables
from driftline.operators import resample as r, stats as k, windows as w
from driftline.operators.ordered import average_ranks, exact_quantiles
from driftline.plans.pipelines import pilot, pilot_correlations

NAMES = list(t.CHANNELS)
RATE, BASELINE_S = 10, 20
GRID = w.WindowSpec(window=30_000, stride=5_000, expected=30, decimals=5)
GRID_CHANNELS = ["qty", "price", "disc"]

_merge = ("CASE WHEN count(DISTINCT {0}) = 1 THEN min({0}) ELSE 'MIXED:' || "
          "string_agg(DISTINCT {0}, '+' ORDER BY {0}) END AS {0}")
BINS = t.LOGGER + f""", bins AS (
  SELECT session_id, sample_no // {RATE} + 1 AS second_index, max(elapsed_ms) AS elapsed_ms,
         min(sample_no) AS raw_sample_start, max(sample_no) AS raw_sample_end,
         {", ".join(f"median({c}) AS {c}" for c in NAMES)},
         {", ".join(_merge.format(s) for s in t.CHANNELS.values())}
  FROM logger GROUP BY session_id, sample_no // {RATE} HAVING count(*) = {RATE})"""
BASE = BINS + f""", medians AS (
  SELECT session_id, {", ".join(f"median({c}) AS {c}_m" for c in NAMES)}
  FROM bins WHERE second_index <= {BASELINE_S} GROUP BY session_id HAVING count(*) >= {BASELINE_S}),
baseline AS (
  SELECT session_id, {", ".join(
      f"any_value({c}_m) AS {c}_baseline, median(abs({c} - {c}_m)) AS {c}_mad, "
      f"greatest(abs(any_value({c}_m)), 1.4826e0 * median(abs({c} - {c}_m)), 1.0e0) AS {c}_scale"
      for c in NAMES)}
  FROM bins JOIN medians USING (session_id) WHERE second_index <= {BASELINE_S} GROUP BY session_id)"""
NORMAL = BASE + f""", normal AS (
  SELECT b.*, {", ".join(f"{c}_baseline" for c in NAMES)},
         {", ".join(f"({c} - {c}_baseline) / {c}_scale AS {c}_delta_norm" for c in NAMES)}
  FROM bins b JOIN baseline USING (session_id))"""


def bins(spark, sf_dir):
    return r.count_bins_median(t.logger(spark, sf_dir), t.CHANNELS, RATE)


def pilot_of(spark, sf_dir):
    return pilot(t.logger(spark, sf_dir), t.CHANNELS, GRID_CHANNELS, RATE, BASELINE_S, GRID)


def baseline(spark, sf_dir):
    return r.robust_baseline(bins(spark, sf_dir), NAMES, BASELINE_S)


def normal(spark, sf_dir):
    return pilot_of(spark, sf_dir).normalised


def _round_all(names, decimals=6):
    return ", ".join(f"{rounded(n, decimals)} AS {n}" for n in names)


@query("cadence_check", with_tables(t.LOGGER, body="""
SELECT session_id, arrival, sample_no, arrival AS expected_no, elapsed_ms,
       first_elapsed + sample_no * 100 AS expected_elapsed_ms,
       CASE WHEN sample_no <> arrival THEN 'SAMPLE_NO'
            WHEN first_elapsed NOT IN (0, 100) AND arrival = 0 THEN 'FIRST_ELAPSED'
            ELSE 'ELAPSED' END AS problem
FROM (SELECT *, arg_min(elapsed_ms, arrival) OVER (PARTITION BY session_id) AS first_elapsed FROM (
  SELECT session_id, sample_no AS arrival,
         sample_no + CASE WHEN disc_status = 'DISCONNECTED' THEN 1 ELSE 0 END AS sample_no,
         elapsed_ms + CASE WHEN qty = 50 AND disc = 0 THEN 5 ELSE 0 END AS elapsed_ms FROM logger))
WHERE sample_no <> arrival OR elapsed_ms <> first_elapsed + sample_no * 100
   OR (first_elapsed NOT IN (0, 100) AND arrival = 0)"""))
def cadence_check(spark, sf_dir):
    faulty = t.logger(spark, sf_dir).select(
        "session_id", F.col("sample_no").alias("arrival"),
        (F.col("sample_no") + F.when(F.col("disc_status") == "DISCONNECTED", 1).otherwise(0))
        .alias("sample_no"),
        (F.col("elapsed_ms") + F.when((F.col("qty") == 50) & (F.col("disc") == 0), 5).otherwise(0))
        .alias("elapsed_ms"))
    return r.cadence_check(faulty, 100)


@query("count_bins_median", with_tables(BINS, body=f"""
SELECT * REPLACE ({_round_all(NAMES)}) FROM bins"""))
def count_bins_median(spark, sf_dir):
    from driftline.functions.rounding import stable_round

    return bins(spark, sf_dir).withColumns({c: stable_round(F.col(c)) for c in NAMES})


@query("partial_bin_report", with_tables(t.LOGGER, body=f"""
SELECT session_id, count(*) AS raw_row_count, count(*) // {RATE} AS full_bin_count,
       count(*) % {RATE} AS leftover_count FROM logger GROUP BY session_id"""))
def partial_bin_report(spark, sf_dir):
    return r.partial_bin_report(t.logger(spark, sf_dir), RATE)


@query("status_merge", with_tables(BINS, body="""
SELECT session_id, second_index, qty_status, price_status, disc_status, tax_status FROM bins"""))
def status_merge(spark, sf_dir):
    rows = t.logger(spark, sf_dir)
    full = rows.groupBy("session_id", (F.floor(F.col("sample_no") / RATE) + 1).alias("second_index"))
    return full.agg(F.count(F.lit(1)).alias("_n"), *[
        r.merged_status(F.col(s)).alias(s) for s in t.CHANNELS.values()]
    ).filter(F.col("_n") == RATE).drop("_n")


@query("robust_baseline", with_tables(BASE, body=f"""
SELECT session_id, {_round_all([f"{c}_{p}" for c in NAMES for p in ("baseline", "mad", "scale")])}
FROM baseline"""))
def robust_baseline(spark, sf_dir):
    from driftline.functions.rounding import stable_round

    df = baseline(spark, sf_dir)
    return df.select("session_id", *[stable_round(F.col(c)).alias(c) for c in df.columns[1:]])


@query("normalised_delta", with_tables(NORMAL, body=f"""
SELECT session_id, second_index, {_round_all([f"{c}_delta_norm" for c in NAMES])} FROM normal"""))
def normalised_delta(spark, sf_dir):
    from driftline.functions.rounding import stable_round

    return normal(spark, sf_dir).select("session_id", "second_index", *[
        stable_round(F.col(f"{c}_delta_norm")).alias(f"{c}_delta_norm") for c in NAMES])


WINDOW_COUNT = f"CASE WHEN {{0}} >= 30 THEN ({{0}} - 30) // 5 + 1 ELSE 0 END"


@query("pilot_session_qc", with_tables(BASE, body=f"""
SELECT l.*, {WINDOW_COUNT.format("full_1hz_bin_count")} AS window_count,
       {_round_all([f"{c}_{p}" for c in NAMES for p in ("baseline", "mad", "scale")])}
FROM (SELECT session_id, count(*) AS raw_row_count, count(*) // {RATE} AS full_1hz_bin_count,
             count(*) % {RATE} AS partial_final_raw_sample_count,
             min(elapsed_ms) AS first_elapsed_ms, max(elapsed_ms) AS last_elapsed_ms,
             coalesce(min(step), 0) AS interval_min_ms, coalesce(max(step), 0) AS interval_max_ms,
             {", ".join(f"string_agg(DISTINCT {s}, '+' ORDER BY {s}) AS {c}_status_values"
                        for c, s in t.CHANNELS.items())}
      FROM (SELECT *, elapsed_ms - lag(elapsed_ms) OVER (PARTITION BY session_id ORDER BY sample_no)
                   AS step FROM logger) GROUP BY session_id) l
LEFT JOIN baseline USING (session_id)"""))
def pilot_session_qc(spark, sf_dir):
    from driftline.functions.rounding import stable_round

    report = pilot_of(spark, sf_dir).report
    numbers = [f"{c}_{p}" for c in NAMES for p in ("baseline", "mad", "scale")]
    return report.withColumns({c: stable_round(F.col(c)) for c in numbers})


_kinds = {"delta_mean": "avg({0})", "delta_last": "arg_max({0}, second_index)",
          "delta_slope_per_s": "regr_slope({0}, second_index)", "delta_variance": "var_pop({0})",
          "delta_range": "max({0}) - min({0})"}
GRIDDED = NORMAL + f""", ends AS (
  SELECT session_id, unnest(range(0, (last_s - 30) // 5 + 1)) AS window_index
  FROM (SELECT session_id, max(second_index) AS last_s FROM normal GROUP BY session_id)
  WHERE last_s >= 30),
grid AS (
  SELECT e.session_id || '-w' || lpad(CAST(window_index AS VARCHAR), 4, '0') AS window_id,
         e.session_id, window_index, window_index * 5 AS window_start_exclusive_s,
         window_index * 5 + 30 AS window_end_inclusive_s, count(n.second_index) AS sample_count,
         30 - count(n.second_index) AS missing_seconds,
         {", ".join(f"{rounded(sql.format(c + '_delta_norm'), 5)} AS {c}_{kind}"
                    for c in GRID_CHANNELS for kind, sql in _kinds.items())}
  FROM ends e LEFT JOIN normal n ON n.session_id = e.session_id
   AND second_index > window_index * 5 AND second_index <= window_index * 5 + 30
  GROUP BY e.session_id, window_index)"""


def grid(spark, sf_dir):
    return pilot_of(spark, sf_dir).windows


query("multichannel_window_features", with_tables(GRIDDED, body="SELECT * FROM grid"))(grid)


@query("gapless_windows", with_tables(GRIDDED, body="""
SELECT e.session_id, window_index, count(n.second_index) AS sample_count,
       30 - count(n.second_index) AS missing_seconds
FROM ends e LEFT JOIN (SELECT * FROM normal WHERE disc_status = 'OK') n
  ON n.session_id = e.session_id AND second_index > window_index * 5
 AND second_index <= window_index * 5 + 30
GROUP BY e.session_id, window_index
HAVING count(n.second_index) < 30
   AND window_index * 5 + 30 <= (SELECT max(second_index) FROM normal m
                                 WHERE m.session_id = e.session_id AND m.disc_status = 'OK')"""))
def gapless_windows(spark, sf_dir):
    clean = normal(spark, sf_dir).filter("disc_status = 'OK'")
    windows = w.multichannel_windows(clean, {"qty": "qty_delta_norm"}, GRID)
    return w.gapless_windows(windows).select(
        "session_id", "window_index", "sample_count", "missing_seconds")


# statistics -----------------------------------------------------------------------------

LONG = BINS + ", long AS (" + " UNION ALL ".join(
    f"SELECT session_id, second_index, '{c}' AS channel, {c} AS value FROM bins" for c in NAMES) + ")"
RANKED = LONG + """, ranked AS (
  SELECT *, rank() OVER (PARTITION BY session_id, channel ORDER BY value)
            + (count(*) OVER (PARTITION BY session_id, channel, value) - 1) / 2.0e0 AS rk
  FROM long)"""
_pairs = list(combinations(NAMES, 2))
SPEARMAN = RANKED + """, wide AS (
  SELECT session_id, second_index, """ + ", ".join(
    f"max(rk) FILTER (channel = '{c}') AS {c}" for c in NAMES) + """
  FROM ranked GROUP BY session_id, second_index),
spearman AS (""" + " UNION ALL ".join(f"""
  SELECT session_id, '{a}' AS left_channel, '{b}' AS right_channel,
         CASE WHEN count(*) >= 2 AND var_pop({a}) > 1e-9 AND var_pop({b}) > 1e-9 THEN
           {rounded(f'covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b}))')} END AS correlation
  FROM wide GROUP BY session_id""" for a, b in _pairs) + ")"
SUMMARY = SPEARMAN + f""", upper_half AS (
  SELECT left_channel, right_channel, {rounded('median(correlation)')} AS correlation_median,
         {rounded('quantile_cont(correlation, 0.75) - quantile_cont(correlation, 0.25)')}
           AS correlation_iqr, count(correlation) AS valid_sessions
  FROM spearman GROUP BY left_channel, right_channel),
matrix AS (
  SELECT * FROM upper_half
  UNION ALL SELECT right_channel, left_channel, correlation_median, correlation_iqr, valid_sessions
  FROM upper_half
  UNION ALL SELECT c, c, 1.0e0, 0.0e0, (SELECT count(DISTINCT session_id) FROM bins)
  FROM (VALUES {", ".join(f"('{c}')" for c in NAMES)}) v(c))"""


def _spearman(spark, sf_dir):
    return k.spearman_by_session(bins(spark, sf_dir), ["session_id", "second_index"], NAMES)


@query("average_rank", with_tables(RANKED, body="""
SELECT session_id, channel, value, count(*) AS tie_count, any_value(rk) AS average_rank
FROM ranked GROUP BY session_id, channel, value"""))
def average_rank(spark, sf_dir):
    long = k.melt(bins(spark, sf_dir), ["session_id"], NAMES)
    return average_ranks(long, ["session_id", "channel"], "value")


@query("pearson_guarded", with_tables(t.LOGGER, body=f"""
SELECT session_id, CASE WHEN count(*) >= 2 AND var_pop(qty) > 1e-9 AND var_pop(price) > 1e-9
         THEN {rounded('covar_pop(qty, price) / (stddev_pop(qty) * stddev_pop(price))')} END AS r_qty_price,
       CAST(NULL AS DOUBLE) AS r_constant
FROM logger GROUP BY session_id"""))
def pearson_guarded(spark, sf_dir):
    from driftline.functions.rounding import stable_round

    return t.logger(spark, sf_dir).groupBy("session_id").agg(
        stable_round(k.guarded_correlation(F.col("qty"), F.col("price"))).alias("r_qty_price"),
        stable_round(k.guarded_correlation(F.col("qty"), F.lit(3.0))).alias("r_constant"))


query("spearman_by_session", with_tables(SPEARMAN, body="SELECT * FROM spearman"))(_spearman)


@query("correlation_matrix", with_tables(SUMMARY, body=f"""
SELECT left_channel, {", ".join(
    f"max(correlation_median) FILTER (right_channel = '{c}') AS {c}" for c in NAMES)}
FROM matrix GROUP BY left_channel"""))
def correlation_matrix(spark, sf_dir):
    return k.correlation_matrix(_spearman(spark, sf_dir), NAMES)


@query("correlation_iqr", with_tables(SUMMARY, body="SELECT * FROM matrix"))
def correlation_iqr(spark, sf_dir):
    return pilot_correlations(bins(spark, sf_dir), NAMES)


@query("correlation_matrix_checks", with_tables(SUMMARY, body="""
SELECT left_channel, right_channel, correlation_median, 'ASYMMETRIC' AS problem FROM upper_half"""))
def correlation_matrix_checks(spark, sf_dir):
    summary = k.correlation_summary(_spearman(spark, sf_dir), NAMES)
    one_sided = summary.filter(F.array_position(
        F.array(*[F.lit(c) for c in NAMES]), F.col("left_channel"))
        <= F.array_position(F.array(*[F.lit(c) for c in NAMES]), F.col("right_channel")))
    return k.correlation_matrix_checks(one_sided)


@query("linear_quantile", f"""
SELECT l_returnflag, {", ".join(
    f"{rounded(f'quantile_cont(l_extendedprice, {p})', 4)} AS p{int(p * 100)}"
    for p in (0.05, 0.25, 0.5, 0.9))} FROM lineitem GROUP BY l_returnflag""")
def linear_quantile(spark, sf_dir):
    from driftline.functions.rounding import stable_round

    outputs = {f"p{int(p * 100)}": p for p in (0.05, 0.25, 0.5, 0.9)}
    q = exact_quantiles(t.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice",
                        outputs)
    return q.select("l_returnflag", *[stable_round(F.col(c), 4).alias(c) for c in outputs])


RAW_LONG = t.LOGGER + ", raw_long AS (" + " UNION ALL ".join(
    f"SELECT session_id, '{c}' AS channel, {c} AS value, {s} AS status FROM logger"
    for c, s in t.CHANNELS.items()) + ")"
QUARTILES = RAW_LONG + """, quartiles AS (
  SELECT session_id, channel, count(*) AS n_raw, quantile_cont(value, 0.25) AS a,
         median(value) AS b, quantile_cont(value, 0.75) AS c, min(value) AS minimum,
         max(value) AS maximum
  FROM raw_long GROUP BY session_id, channel)"""


@query("channel_statistics", with_tables(QUARTILES, body=f"""
SELECT session_id, channel, n_raw, {rounded('b')} AS median, {rounded('a')} AS q25,
       {rounded('c')} AS q75, {rounded('c - a')} AS iqr, minimum, maximum FROM quartiles"""))
def channel_statistics(spark, sf_dir):
    return k.channel_statistics(t.logger(spark, sf_dir), NAMES)


@query("boxplot_statistics", with_tables(QUARTILES, body=f"""
SELECT session_id, channel, {rounded('max(a)')} AS q25, {rounded('max(b)')} AS median,
       {rounded('max(c)')} AS q75,
       min(value) FILTER (value BETWEEN a - 1.5e0 * (c - a) AND c + 1.5e0 * (c - a)) AS lower_whisker,
       max(value) FILTER (value BETWEEN a - 1.5e0 * (c - a) AND c + 1.5e0 * (c - a)) AS upper_whisker,
       count(*) FILTER (NOT value BETWEEN a - 1.5e0 * (c - a) AND c + 1.5e0 * (c - a)) AS outlier_count
FROM raw_long JOIN quartiles USING (session_id, channel) GROUP BY session_id, channel"""))
def boxplot_statistics(spark, sf_dir):
    return k.boxplot_statistics(t.logger(spark, sf_dir), NAMES)


@query("status_counts_by_channel", with_tables(RAW_LONG, body="""
SELECT session_id, channel, status, count(*) AS n FROM raw_long GROUP BY ALL"""))
def status_counts_by_channel(spark, sf_dir):
    return k.status_counts_by_channel(t.logger(spark, sf_dir), t.CHANNELS)


@query("session_profile", with_tables(t.LOGGER, body=f"""
SELECT session_id, count(*) AS n_raw, min(elapsed_ms) AS first_elapsed_ms,
       max(elapsed_ms) AS last_elapsed_ms, max(elapsed_ms) - min(elapsed_ms) AS span_ms,
       count(*) // {RATE} AS bins, count(*) % {RATE} AS partial_raw_samples,
       {WINDOW_COUNT.format(f"(count(*) // {RATE})")} AS windows FROM logger GROUP BY session_id"""))
def session_profile(spark, sf_dir):
    return k.session_profile(t.logger(spark, sf_dir), RATE, 30, 5)
