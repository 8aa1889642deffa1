"""Watermarked resampling and window features on unbounded streams.

State is keyed by (session, bin), (session, pane) or (session, window), so one busy session
spreads over the state store partitions and no state outlives its window plus the delay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from driftline.functions.arrays import adjacent
from driftline.functions.rounding import stable_round
from driftline.operators.windows import WindowSpec, statistics_of_panes, window_validity
from driftline.session import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tumbling_median(stream: DataFrame, keys: list[str], ts: str, value: str, width: str,
                    delay: str, status: Column | None = None) -> DataFrame:
    """Exact median, count and last timestamp per key and bin; late rows are dropped."""
    ok = F.bool_and(status) if status is not None else F.lit(True)
    return (
        stream.withWatermark(ts, delay)
        .groupBy(*keys, F.window(ts, width).alias("_w"))
        .agg(F.count(F.lit(1)).alias("sample_count"),
             F.percentile(value, 0.5).alias("median_value"),
             F.max(ts).alias("last_ts"), ok.alias("all_ok"))
        .select(*keys, F.col("_w.start").alias("bin_start"), F.col("_w.end").alias("bin_end"),
                "sample_count", "median_value", "last_ts", "all_ok"))


def sliding_features(stream: DataFrame, keys: list[str], ts: str, value: str, invalid: Column,
                     spec: WindowSpec, delay: str) -> DataFrame:
    """Features of epoch-aligned ``(t - W, t]`` windows as they close.

    Two chained stateful operators.  The first reduces samples to panes of ``gcd(W, S)``: a sample
    is in one pane, and the times that a pane holds to judge its intervals go when it closes.
    The second merges closed panes into windows by their moments, so what is copied into the
    W/S windows that overlap are panes, never samples.

    Spark windows are ``[start, end)``; event time is moved back one microsecond before the
    watermark so that a sample at ``t`` belongs to the window ending at ``t``.
    """
    def span(milliseconds: int) -> str:
        return f"{milliseconds} milliseconds"

    shifted = stream.withColumns({
        "_event_time": F.col(ts) - F.expr("interval 1 microsecond"), "_invalid": invalid,
    }).withWatermark("_event_time", delay)
    pane = F.window("_event_time", span(spec.pane))
    # time within the pane: absolute times would cost the moments their low digits
    elapsed = F.pmod(F.unix_micros("_event_time"), F.lit(spec.pane * 1000)) + 1
    unit, n = F.lit(spec.slope_unit_ms * 1000.0), F.count(F.lit(1))
    timed = shifted.withColumns({"_t": elapsed / unit, "_v": F.col(value)})
    panes = timed.groupBy(*keys, pane.alias("_pane")).agg(
        n.alias("n"), F.sort_array(F.collect_list(F.unix_millis(ts))).alias("_times"),
        F.count_if("_invalid").alias("bad"),
        F.avg("_t").alias("mean_t"), (F.var_pop("_t") * n).alias("m2_t"),
        F.max_by("_v", F.col(ts)).alias("v_last"), F.min("_v").alias("v_min"),
        F.max("_v").alias("v_max"), F.avg("_v").alias("v_mean"),
        (F.var_pop("_v") * n).alias("v_m2"), (F.covar_pop("_t", "_v") * n).alias("v_c"))
    steps = adjacent(F.col("_times"), lambda a, b: b - a)
    start = F.unix_millis(F.col("_pane.start"))
    fields = [
        start.alias("pane"), "n", F.element_at("_times", 1).alias("first_ts"),
        F.element_at("_times", -1).alias("last_ts"),
        F.size(F.filter(steps, lambda d: d == 0)).cast("bigint").alias("repeats"),
        F.size(F.filter(steps, lambda d: ~d.between(spec.interval_low, spec.interval_high)))
        .cast("bigint").alias("off"), "bad",
        "mean_t", "m2_t", "v_last", "v_min", "v_max", "v_mean", "v_m2", "v_c"]
    closed = panes.select(*keys, "_pane", F.struct(*fields).alias("_fields"))
    window = F.window("_pane", span(spec.window), span(spec.stride))
    merged = closed.groupBy(*keys, window.alias("_w")).agg(
        F.sort_array(F.collect_list("_fields")).alias("_panes"))
    origin = F.unix_millis(F.col("_w.start"))
    merged = merged.select(
        *keys, F.struct(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"))
        .alias("_attributes"),
        F.transform("_panes", lambda p: p.withField("mean_t", p["mean_t"] + (
            p["pane"] - origin) / F.lit(float(spec.slope_unit_ms)))).alias("_panes"))
    found = window_validity(statistics_of_panes(
        merged, keys, ["window_start", "window_end"], spec, ["v"]), spec)

    def feature(column):
        return F.when(F.col("feature_valid"), stable_round(F.col(f"v_{column}"), spec.decimals))

    return found.select(
        *keys, "window_start", "window_end", "sample_count", "exclusion_reason",
        *[feature(c).alias(f"value_{c}") for c in ("mean", "last", "slope", "variance", "range")])


def drain(stream: DataFrame, mode: str = "append", provider: str | None = None) -> DataFrame:
    """Run a stream over everything available into a shared folder and read it back."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if provider:
        spark.conf.set(key, provider)
    try:
        run = (stream.writeStream.format("parquet").outputMode(mode)
               .option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state")
               .trigger(availableNow=True).start())
        run.awaitTermination()
    finally:
        if provider:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
