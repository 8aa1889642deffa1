"""Sliding windows ``(t - W, t]`` anchored at each session's first sample.

Samples are reduced once to panes of ``gcd(W, S)``; windows are merged from
panes.  Only panes, never samples, are replicated into the windows they
belong to, so the second shuffle carries W/S small rows per pane and the
sample table is shuffled once (twice when there are too many sessions to
broadcast their anchors).
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftline import contract
from driftline.functions.rounding import stable_round
from driftline.functions.rules import window_id
from driftline.operators.ordered import per_key_join
from driftline.session import materialise

SPINE_CHUNK = 4096


@dataclass(frozen=True)
class WindowSpec:
    """Window geometry and validity rules, in milliseconds."""

    window: int = 120_000
    stride: int = 10_000
    expected: int | None = 120
    minimum: int | None = None
    interval_low: int = 800
    interval_high: int = 1200
    decimals: int = 6
    slope_unit_ms: int = 1000

    def __post_init__(self) -> None:
        if self.window <= 0 or self.stride <= 0:
            raise ValueError("window and stride must be positive")
        if (self.expected is None) == (self.minimum is None):
            raise ValueError("give exactly one of expected and minimum")

    @property
    def pane(self) -> int:
        return gcd(self.window, self.stride)

    @property
    def panes_per_window(self) -> int:
        return self.window // self.pane

    @property
    def panes_per_stride(self) -> int:
        return self.stride // self.pane


def _ceil_div(numerator: Column, denominator: int) -> Column:
    return -F.floor(-numerator / F.lit(denominator))


def session_anchors(samples: DataFrame, session: str = "session_id",
                    ts: str = "timestamp") -> DataFrame:
    return samples.groupBy(session).agg(F.min(ts).alias("t_ref"))


def window_spine(sessions: DataFrame, anchors: DataFrame, spec: WindowSpec,
                 session: str = "session_id", end: str = "end_timestamp") -> DataFrame:
    """One row per window, empty ones included; sessions without samples have none.

    The index range is exploded in chunks, so a very long session never
    becomes one huge array.
    """
    return _spine_of(sessions.join(anchors, session), spec, end)


def _spine_of(bounds: DataFrame, spec: WindowSpec, end: str = "end_timestamp") -> DataFrame:
    last = F.floor((F.col(end) - F.col("t_ref") - F.lit(spec.window)) / F.lit(spec.stride))
    chunk = F.lit(SPINE_CHUNK)
    return (
        bounds.withColumn("_last", last)
        .filter(F.col("_last") >= 0)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                   F.floor(F.col("_last") / chunk))))
        .withColumn("window_index", F.explode(F.sequence(
            F.col("_chunk") * chunk,
            F.least(F.col("_last"), F.col("_chunk") * chunk + chunk - 1))))
        .withColumn("window_start", F.col("t_ref") + F.col("window_index") * spec.stride)
        .withColumn("window_end", F.col("window_start") + F.lit(spec.window))
        .drop("_last", "_chunk")
    )


def sliding_membership(samples: DataFrame, sessions: DataFrame, spec: WindowSpec,
                       session: str = "session_id", ts: str = "timestamp",
                       end: str = "end_timestamp") -> DataFrame:
    """Each sample with the index of every window that contains it."""
    anchors = session_anchors(samples, session, ts)
    bounds = sessions.select(session, end).join(anchors, session)
    rel = F.col(ts) - F.col("t_ref")
    last = F.floor((F.col(end) - F.col("t_ref") - F.lit(spec.window)) / F.lit(spec.stride))
    first_k = F.greatest(F.lit(0).cast("bigint"), _ceil_div(rel - spec.window, spec.stride))
    last_k = F.least(last, _ceil_div(rel, spec.stride) - 1)
    return (
        per_key_join(samples, bounds, [session], F.col(ts), spec.window)
        .withColumn("_first", first_k).withColumn("_last", last_k)
        .filter(F.col("_last") >= F.col("_first"))
        .withColumn("window_index", F.explode(F.sequence("_first", "_last")))
        .drop("_first", "_last", "t_ref", end)
    )


def _pane_stats(values: dict[str, str], spec: WindowSpec, seconds: Column, ts: str,
                invalid: Column | None) -> list[Column]:
    n = F.count(F.lit(1))
    stats = [
        n.alias("n"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.count_if(F.col("_step") == 0).alias("repeats"),
        F.count_if(~F.col("_step").between(spec.interval_low, spec.interval_high)).alias("off"),
        (F.count_if(invalid) if invalid is not None else F.lit(0).cast("bigint")).alias("bad"),
        F.avg(seconds).alias("mean_t"), (F.var_pop(seconds) * n).alias("m2_t"),
    ]
    for name, column in values.items():
        v = F.col(column)
        stats += [
            F.max_by(v, F.col(ts)).alias(f"{name}_last"),
            F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max"),
            F.avg(v).alias(f"{name}_mean"), (F.var_pop(v) * n).alias(f"{name}_m2"),
            (F.covar_pop(seconds, v) * n).alias(f"{name}_c"),
        ]
    return stats


def pane_statistics(samples: DataFrame, anchors: DataFrame, spec: WindowSpec,
                    values: dict[str, str], quality: Column | None = None,
                    session: str = "session_id", ts: str = "timestamp") -> DataFrame:
    """Mergeable statistics per (session, pane).

    ``anchors`` has ``t_ref`` per session.  A sample exactly at the anchor is in
    no window.  ``quality`` is true where a sample makes its windows invalid.
    """
    keep = [session, ts, *values.values()]
    flagged = samples.withColumn("_invalid", quality) if quality is not None else samples
    keep = keep + (["_invalid"] if quality is not None else [])
    placed = per_key_join(flagged.select(*keep), anchors.select(session, "t_ref"), [session],
                          F.col(ts), spec.window)
    return placed_pane_statistics(
        placed, spec, values, F.col("_invalid") if quality is not None else None, session, ts)


def pane_number(spec: WindowSpec, ts: str) -> Column:
    """Pane ``(t_ref + (p - 1) * width, t_ref + p * width]`` of a sample; 0 and less: none."""
    return _ceil_div(F.col(ts) - F.col("t_ref"), spec.pane)


def placed_pane_statistics(placed: DataFrame, spec: WindowSpec, values: dict[str, str],
                           invalid: Column | None, session: str, ts: str) -> DataFrame:
    """`pane_statistics` of samples that carry their session's ``t_ref``."""
    placed = placed.withColumn("pane", pane_number(spec, ts)).filter(F.col("pane") > 0)
    order = Window.partitionBy(session, "pane").orderBy(ts)
    seconds = (F.col(ts) - F.col("t_ref")) / F.lit(float(spec.slope_unit_ms))
    return (
        placed.withColumn("_step", F.col(ts) - F.lag(ts).over(order))
        .groupBy(session, "pane")
        .agg(*_pane_stats(values, spec, seconds, ts, invalid))
    )


def merge_panes(panes: DataFrame, spine: DataFrame, spec: WindowSpec, names: list[str],
                session: str = "session_id") -> DataFrame:
    """Window statistics from panes; spine rows keep empty windows alive.

    The spine is unioned in before the grouping, so attributes and empty
    windows need no join.  A window gathers at most W/gcd(W,S) panes, and the
    second moments are merged around the window mean, which keeps them stable.
    """
    m, q = spec.panes_per_window, spec.panes_per_stride
    stats = [c for c in panes.columns if c not in (session,)]
    first_k = F.greatest(F.lit(0).cast("bigint"), _ceil_div(F.col("pane") - m, q))
    last_k = F.floor((F.col("pane") - 1) / F.lit(q))
    spread = (
        panes.filter(last_k >= first_k)
        .select(session, F.explode(F.sequence(first_k, last_k)).alias("window_index"),
                F.struct(*stats).alias("_pane"))
    )
    attributes = [c for c in spine.columns if c not in (session, "window_index")]
    frame = spine.select(session, "window_index", F.struct(*attributes).alias("_attributes"))
    merged = (
        frame.unionByName(spread, allowMissingColumns=True)
        .groupBy(session, "window_index")
        .agg(F.max("_attributes").alias("_attributes"),
             F.sort_array(F.collect_list("_pane")).alias("_panes"))
        .filter(F.col("_attributes").isNotNull())
    )
    return statistics_of_panes(merged, [session, "window_index"], attributes, spec, names)


def statistics_of_panes(merged: DataFrame, keep: list[str], attributes: list[str],
                        spec: WindowSpec, names: list[str]) -> DataFrame:
    """Window statistics from ``_panes``, an array of pane structs in time order.

    Rows have the columns ``keep``, a struct ``_attributes`` with ``attributes`` and ``_panes``.
    """
    panes_ = F.col("_panes")

    def total(field):
        return F.aggregate(panes_, F.lit(0).cast("bigint"), lambda acc, p: acc + p[field])

    def weighted_mean(field):
        return F.aggregate(panes_, F.lit(0.0), lambda acc, p: acc + p["n"] * p[field]) \
            / F.nullif(F.col("_n"), F.lit(0))

    steps = F.zip_with(
        F.slice(panes_, 1, F.greatest(F.size(panes_) - 1, F.lit(0))),
        F.slice(panes_, 2, F.greatest(F.size(panes_) - 1, F.lit(0))),
        lambda a, b: b["first_ts"] - a["last_ts"])
    staged = merged.select(
        *keep, "_attributes.*", "_panes",
        total("n").alias("_n"), total("repeats").alias("repeats"),
        total("bad").alias("invalid_count"),
        (total("off") + F.size(F.filter(
            steps, lambda d: ~d.between(spec.interval_low, spec.interval_high)))
         ).alias("interval_faults"),
    )
    staged = staged.select(
        "*", weighted_mean("mean_t").alias("_mean_t"),
        *[weighted_mean(f"{name}_mean").alias(f"{name}_mean") for name in names])

    def second_moment(m2, mean, center):
        return F.aggregate(panes_, F.lit(0.0), lambda acc, p: acc + p[m2]
                           + p["n"] * (p[mean] - center) * (p[mean] - center))

    s_tt = F.when(F.col("_n") > 0, second_moment("m2_t", "mean_t", F.col("_mean_t")))
    newest = F.try_element_at(panes_, F.lit(-1))

    def cross_moment(name):
        return F.aggregate(
            panes_, F.lit(0.0),
            lambda acc, p: acc + p[f"{name}_c"]
            + p["n"] * (p["mean_t"] - F.col("_mean_t"))
            * (p[f"{name}_mean"] - F.col(f"{name}_mean")))

    def extreme(pick, field):
        return pick(F.transform(panes_, lambda p: p[field]))

    columns = []
    for name in names:
        m2 = second_moment(f"{name}_m2", f"{name}_mean", F.col(f"{name}_mean"))
        columns += [
            newest[f"{name}_last"].alias(f"{name}_last"),
            F.when(s_tt > 0, cross_moment(name) / s_tt).alias(f"{name}_slope"),
            (m2 / F.nullif(F.col("_n"), F.lit(0))).alias(f"{name}_variance"),
            (extreme(F.array_max, f"{name}_max") - extreme(F.array_min, f"{name}_min")
             ).alias(f"{name}_range"),
        ]
    return staged.select(
        *keep, *attributes, F.col("_n").alias("sample_count"), "repeats", "interval_faults",
        "invalid_count", *[f"{name}_mean" for name in names], *columns)


def window_statistics(samples: DataFrame, sessions: DataFrame, spec: WindowSpec,
                      value: str = "capacitance_raw", quality: str = "cap_quality",
                      session: str = "session_id", ts: str = "timestamp") -> DataFrame:
    """Statistics of every window of every session, before validity is decided."""
    bounds = materialise(sessions.join(session_anchors(samples, session, ts), session))
    panes = pane_statistics(samples, bounds, spec, {"cap": value},
                            quality=F.col(quality) != "OK", session=session, ts=ts)
    return merge_panes(panes, _spine_of(bounds, spec), spec, ["cap"], session)


def exclusion_reason(spec: WindowSpec) -> Column:
    """First matching reason; null for a valid window."""
    count = F.col("sample_count")
    partial = count != spec.expected if spec.expected is not None else count < spec.minimum
    duplicate, incomplete, timing, quality = contract.STRUCTURAL_REASONS
    return (
        F.when(F.col("repeats") > 0, duplicate)
        .when(partial, incomplete)
        .when(F.col("interval_faults") > 0, timing)
        .when(F.col("invalid_count") > 0, quality)
    )


def window_validity(statistics: DataFrame, spec: WindowSpec) -> DataFrame:
    reason = exclusion_reason(spec)
    return statistics.withColumn("feature_valid", reason.isNull()).withColumn(
        "exclusion_reason", F.coalesce(reason, F.lit("")))


def feature_columns(spec: WindowSpec, baseline: str = "baseline_value") -> dict[str, Column]:
    """The five features; only the level features depend on the baseline."""
    base = F.col(baseline)
    raw = (F.col("cap_mean") - base, F.col("cap_last") - base, F.col("cap_slope"),
           F.col("cap_variance"), F.col("cap_range"))
    return {name: stable_round(expr, spec.decimals)
            for name, expr in zip(contract.FEATURE_COLUMNS, raw)}


def window_features(statistics: DataFrame, spec: WindowSpec) -> DataFrame:
    """Features of every window that has at least one sample, valid or not."""
    return statistics.filter(F.col("sample_count") > 0).withColumns(feature_columns(spec))


def feature_table(samples: DataFrame, sessions: DataFrame, spec: WindowSpec,
                  value: str = "capacitance_raw", quality: str = "cap_quality",
                  session: str = "session_id", ts: str = "timestamp") -> DataFrame:
    """Audit columns plus features, features null where the window is invalid."""
    keep = sessions.select(session, "bag_id", "sensor_id", "baseline_value", "end_timestamp")
    stats = window_validity(
        window_statistics(samples, keep, spec, value, quality, session, ts), spec)
    features = {name: F.when(F.col("feature_valid"), expr)
                for name, expr in feature_columns(spec).items()}
    return stats.select(
        window_id(F.col(session), F.col("window_index")).alias("window_id"),
        session, "bag_id", "sensor_id", "window_index", "window_start", "window_end",
        "sample_count", "feature_valid", "exclusion_reason",
        *[expr.alias(name) for name, expr in features.items()])


def zero_filled_counts(df: DataFrame, column: str, categories, name: str = "n") -> DataFrame:
    """Count per category of a closed vocabulary, absent categories included."""
    spark = df.sparkSession
    spine = spark.createDataFrame([(c,) for c in categories], f"{column} string")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias(name))
    return spine.join(counts, column, "left").select(
        column, F.coalesce(F.col(name), F.lit(0).cast("bigint")).alias(name))


def exclusion_counts(features: DataFrame, reasons=contract.STRUCTURAL_REASONS) -> DataFrame:
    """Windows per reason, zero-filled; the empty reason counts valid windows."""
    return zero_filled_counts(features, "exclusion_reason", ("", *reasons), "window_count")


def multichannel_windows(samples: DataFrame, channels: dict[str, str], spec: WindowSpec,
                         session: str = "session_id", second: str = "second_index") -> DataFrame:
    """Windows over a 1 Hz grid of integer seconds, several channels at once.

    Windows end at W, W+S, ... seconds; the grid starts at second 1.
    ``missing_seconds`` is positive where the grid has gaps.
    """
    timed = samples.withColumn("_ms", F.col(second).cast("bigint") * 1000)
    bounds = materialise(timed.groupBy(session).agg(
        F.max("_ms").alias("end_timestamp"), F.lit(0).cast("bigint").alias("t_ref")))
    panes = pane_statistics(timed, bounds, spec, channels, session=session, ts="_ms")
    stats = merge_panes(panes, _spine_of(bounds, spec), spec, list(channels), session)
    seconds = spec.window // 1000
    output = [
        window_id(F.col(session), F.col("window_index"), "-w").alias("window_id"),
        F.col(session), F.col("window_index"),
        F.floor(F.col("window_start") / 1000).alias("window_start_exclusive_s"),
        F.floor(F.col("window_end") / 1000).alias("window_end_inclusive_s"),
        F.col("sample_count"),
        (F.lit(seconds) - F.col("sample_count")).alias("missing_seconds"),
    ]
    kinds = (("mean", "delta_mean"), ("last", "delta_last"), ("slope", "delta_slope_per_s"),
             ("variance", "delta_variance"), ("range", "delta_range"))
    for name in channels:
        output += [stable_round(F.col(f"{name}_{source}"), spec.decimals).alias(f"{name}_{target}")
                   for source, target in kinds]
    return stats.select(*output)


def gapless_windows(windows: DataFrame) -> DataFrame:
    """Windows with at least one missing second; a clean table yields no rows."""
    return windows.filter(F.col("missing_seconds") > 0)
