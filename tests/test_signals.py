"""Resampling, normalisation and statistics: golden values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import resample as r, stats as k, windows as w


@pytest.fixture(scope="module")
def logger(spark):
    return spark.createDataFrame(
        [("p", i, 100 + 100 * i, 1000.0 + 3 * i, "OK" if i != 7 else "HOLD") for i in range(1255)],
        "session_id string, sample_no long, elapsed_ms long, kap double, kap_status string").cache()


def test_bins_baseline_and_windows(logger):
    bins = r.count_bins_median(logger, {"kap": "kap_status"}, 10).cache()
    assert bins.count() == 125
    first = bins.orderBy("second_index").first()
    assert first.kap == 1013.5 and first.kap_status == "MIXED:HOLD+OK" and first.elapsed_ms == 1000
    assert (first.raw_sample_start, first.raw_sample_end) == (0, 9)
    assert r.partial_bin_report(logger, 10).first().leftover_count == 5
    baseline = r.robust_baseline(bins, ["kap"], 20)
    row = baseline.first()
    assert row.kap_baseline == 1298.5 and row.kap_scale == 1298.5 and row.kap_mad == 150.0
    windows = w.multichannel_windows(
        r.normalised_delta(bins, baseline, ["kap"]), {"kap": "kap_delta_norm"}, w.WindowSpec())
    assert [(x.window_id, x.sample_count) for x in windows.collect()] == [("p-w0000", 120)]
    assert w.gapless_windows(windows).count() == 0
    report = r.pilot_session_qc(logger, {"kap": "kap_status"}, baseline, 10, 120, 10).first()
    assert (report.raw_row_count, report.window_count, report.interval_min_ms) == (1255, 1, 100)


def test_short_session_has_no_baseline(logger):
    bins = r.count_bins_median(logger, {"kap": "kap_status"}, 10)
    assert r.robust_baseline(bins, ["kap"], 126).count() == 0


def test_missing_second_is_reported(logger):
    bins = r.count_bins_median(logger, {"kap": "kap_status"}, 10).filter("second_index <> 60")
    windows = w.multichannel_windows(bins, {"kap": "kap"}, w.WindowSpec())
    assert w.gapless_windows(windows).first().missing_seconds == 1


def test_cadence(spark):
    rows = [("a", i, i, 100 + 100 * i) for i in range(6)]
    rows[3] = ("a", 3, 4, 400)
    df = spark.createDataFrame(rows, "session_id string, arrival long, sample_no long, elapsed_ms long")
    assert [(x.arrival, x.problem) for x in r.cadence_check(df, 100).collect()] == [(3, "SAMPLE_NO")]
    late = df.withColumn("elapsed_ms", F.col("elapsed_ms") + 50)
    assert {x.problem for x in r.cadence_check(late, 100).collect()} == {"SAMPLE_NO", "FIRST_ELAPSED"}


def test_spearman_and_summary(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(5):
        base = rng.integers(0, 8, 40)
        for i, b in enumerate(base):
            rows.append((f"s{s}", i, float(b), float(b + rng.integers(0, 4)), 1.0))
    df = spark.createDataFrame(rows, "session_id string, second_index int, a double, b double, c double")
    by_session = k.spearman_by_session(df, ["session_id", "second_index"], ["a", "b", "c"]).cache()
    frame = df.toPandas()
    want = {s: g["a"].rank().corr(g["b"].rank()) for s, g in frame.groupby("session_id")}
    for x in by_session.collect():
        if (x.left_channel, x.right_channel) == ("a", "b"):
            assert abs(x.correlation - want[x.session_id]) < 1e-6
        else:
            assert x.correlation is None
    summary = {(x.left_channel, x.right_channel): x
               for x in k.correlation_summary(by_session, ["a", "b", "c"]).collect()}
    assert abs(summary["a", "b"].correlation_median - np.median(list(want.values()))) < 1e-6
    assert summary["b", "a"].correlation_median == summary["a", "b"].correlation_median
    assert summary["c", "c"].correlation_median == 1.0 and ("a", "c") not in summary


def test_pearson_guard(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert df.agg(k.guarded_correlation(F.col("x"), F.col("y")).alias("r")).first().r is None


def test_boxplot_hot_session(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=4000), [50.0, -40.0]])
    df = spark.createDataFrame([("hot", float(v)) for v in values] + [("cold", 1.0)],
                               "session_id string, ch double")
    got = {x.session_id: x for x in k.boxplot_statistics(df, ["ch"]).collect()}
    q1, q3 = np.quantile(values, [0.25, 0.75])
    inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
    assert got["hot"].outlier_count == len(values) - len(inside)
    assert got["hot"].lower_whisker == inside.min() and got["hot"].upper_whisker == inside.max()
    assert got["cold"].outlier_count == 0


def test_boxplot_is_the_same_gathered_and_selected(spark):
    """Keys on both sides of the limit; a session without a name and missing values count nowhere."""
    rng = np.random.default_rng(6)
    sizes = {"a": 300, "b": 7, "c": 1, "d": 40}
    values = {s: np.round(rng.normal(size=n) ** 3, 1) for s, n in sizes.items()}
    df = spark.createDataFrame(
        [(s, float(v)) for s, vs in values.items() for v in vs] + [(None, 1.0), ("b", None), ("e", None)],
        "session_id string, ch double")
    columns = ["q25", "median", "q75", "lower_whisker", "upper_whisker", "outlier_count"]

    def summary(gather):
        return {x.session_id: tuple(x[c] for c in columns)
                for x in k.boxplot_statistics(df, ["ch"], gather=gather).collect()}
    got = summary(100_000)
    assert got == summary(20) == summary(0)
    assert set(got) == set(values)
    for s, v in values.items():
        q = np.quantile(v, [0.25, 0.5, 0.75])
        inside = v[(v >= q[0] - 1.5 * (q[2] - q[0])) & (v <= q[2] + 1.5 * (q[2] - q[0]))]
        assert np.allclose(got[s], [*q, inside.min(), inside.max(), len(v) - len(inside)], atol=1e-6)


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_statistics_of_small_keys_sort_no_sketch_and_join_nothing(spark):
    """Many keys of few rows: no sketch per key, and values meet their quartiles without a join."""
    df = spark.createDataFrame([(f"s{i % 50}", float(i % 7)) for i in range(500)],
                               "session_id string, ch double")
    for plan in (_plan(k.channel_statistics(df, ["ch"])), _plan(k.boxplot_statistics(df, ["ch"]))):
        assert "percentile_approx" not in plan and "Join" not in plan
