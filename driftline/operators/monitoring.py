"""Session-level warning quality, freshness of results and exposure history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from driftline.operators.ordered import block_of, lag_in_order, running_max_before

WARNING_CLASS = 2
HOUR_MS = 3_600_000.0


def first_warnings(scored: DataFrame, minimum: int = WARNING_CLASS) -> DataFrame:
    """First window end per session whose predicted class warns."""
    return scored.filter(F.col("predicted_index") >= minimum).groupBy("session_id").agg(
        F.min("window_end").alias("first_warning"), F.count(F.lit(1)).alias("warning_count"))


def warning_lead_time(scored: DataFrame, leaks: DataFrame, minimum: int = WARNING_CLASS) -> DataFrame:
    """Per leaking session: first warning before the leak and the lead time.

    ``leaks``: ``session_id``, ``physical_leak``.
    """
    joined = leaks.join(first_warnings(scored, minimum), "session_id", "left")
    warned = F.coalesce(F.col("first_warning") < F.col("physical_leak"), F.lit(False))
    return joined.select(
        "session_id", "physical_leak", "first_warning", warned.alias("warned"),
        F.when(warned, F.col("physical_leak") - F.col("first_warning")).alias("lead_time_ms"))


def event_detection_rate(lead_times: DataFrame) -> DataFrame:
    return lead_times.agg(
        F.count(F.lit(1)).alias("leak_sessions"), F.count_if("warned").alias("warned_sessions"),
        F.try_divide(F.count_if("warned").cast("double"), F.count(F.lit(1)).cast("double"))
        .alias("detection_rate"))


def false_alerts_per_hour(scored: DataFrame, safe_sessions: DataFrame,
                          minimum: int = WARNING_CLASS) -> DataFrame:
    """Warning windows of safe sessions per recorded hour."""
    hours = (F.col("end_timestamp") - F.col("start_timestamp")) / F.lit(HOUR_MS)
    alerts = safe_sessions.join(first_warnings(scored, minimum), "session_id", "left")
    return alerts.select(
        "session_id", F.coalesce("warning_count", F.lit(0).cast("bigint")).alias("alert_count"),
        hours.alias("session_hours"),
        F.try_divide(F.coalesce("warning_count", F.lit(0).cast("bigint")).cast("double"), hours)
        .alias("alerts_per_hour"))


def direct_alarm_latency(events: DataFrame) -> DataFrame:
    """First confirmation minus first physical leak, per session that has both."""
    def first(name):
        return F.min(F.when(F.col("event_type") == name, F.col("timestamp")))

    times = events.groupBy("session_id").agg(
        first("PHYSICAL_LEAK_OBSERVED").alias("t_leak"),
        first("LEAK_FLAG_FIRST").alias("t_flag"), first("LEAK_FLAG_CONFIRMED").alias("t_confirm"))
    return times.filter(F.col("t_leak").isNotNull() & F.col("t_confirm").isNotNull()).select(
        "session_id", "t_leak", "t_flag", "t_confirm",
        (F.col("t_confirm") - F.col("t_leak")).alias("latency_ms"))


def status_transitions_per_hour(scored: DataFrame, block_windows: int = 100_000) -> DataFrame:
    """Class changes between consecutive scored windows per covered hour."""
    stepped = lag_in_order(
        scored.select("session_id", "window_index", "window_end", "predicted_index"),
        ["session_id"], ["window_index"], {"predicted_index": "_before"}, block_windows)
    changed = F.count_if(F.col("_before") != F.col("predicted_index"))
    hours = (F.max("window_end") - F.min("window_end")) / F.lit(HOUR_MS)
    return stepped.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("window_count"), changed.alias("transition_count"),
        F.try_divide(changed.cast("double"), hours).alias("transitions_per_hour"))


def result_freshness(results: DataFrame, stale_ms: int = 30_000, late_ms: int = 5_000) -> DataFrame:
    """State of each result by acquisition time and window identity.

    ``results``: ``result_id``, ``device_id``, ``window_end``, ``received_at``,
    ``evaluated_at``.  The first arrival of a window wins; later ones are replays.
    """
    first = results.groupBy("device_id", "window_end").agg(
        F.min(F.struct("received_at", "result_id")).alias("_first"))
    age = F.col("evaluated_at") - F.col("window_end")
    state = (
        F.when(F.col("window_end") > F.col("received_at"), "FUTURE")
        .when(F.col("result_id") != F.col("_first.result_id"), "REPLAYED")
        .when(F.col("received_at") - F.col("window_end") > late_ms, "LATE")
        .when(age > stale_ms, "STALE").otherwise("FRESH"))
    return results.join(first, ["device_id", "window_end"]).select(
        "result_id", "device_id", "window_end", state.alias("freshness"))


def exposure_history(events: DataFrame, horizon_ms: int, counted: dict[str, str],
                     block_ms: int | None = None) -> DataFrame:
    """Rolling counts of event types over the trailing horizon, at every event.

    ``counted`` maps an output name to an event type.  A key is cut into blocks
    no shorter than the horizon and every event is also copied into the next
    block as context, so a frame never needs a third block and a busy session
    spreads over tasks.
    """
    width = max(block_ms or horizon_ms, horizon_ms)
    block = block_of(F.col("timestamp"), width)
    placed = events.select(
        "session_id", "seq", "timestamp", "event_type",
        F.explode(F.array(F.struct(block.alias("_block"), F.lit(True).alias("_own")),
                          F.struct((block + 1).alias("_block"), F.lit(False).alias("_own"))))
        .alias("_b")).select("session_id", "seq", "timestamp", "event_type", "_b.*")
    frame = Window.partitionBy("session_id", "_block").orderBy("timestamp").rangeBetween(
        -horizon_ms, 0)
    return placed.withColumns({
        name: F.count_if(F.col("event_type") == kind).over(frame)
        for name, kind in counted.items()}).filter("_own").select(
        "session_id", "seq", "timestamp", *counted)


def coalesced_intervals(intervals: DataFrame, gap_ms: int, block_ms: int) -> DataFrame:
    """Intervals of a session that overlap, or lie at most ``gap_ms`` apart, as one.

    ``intervals``: ``session_id``, ``seq``, ``start_timestamp``, ``end_timestamp``.  Two segmented
    scans over blocks of start times: one carries the latest end so far, which tells where a new
    interval begins; the other the latest such begin, which names the interval a row belongs to.
    An interval may span any number of blocks, and a session any number of tasks.
    """
    order = ["start_timestamp", "seq"]
    reached = running_max_before(intervals, ["session_id"], order, F.col("end_timestamp"),
                                 "_reached", block_ms)
    opens = F.col("_reached").isNull() | (
        F.col("start_timestamp") > F.col("_reached") + F.lit(gap_ms))
    begun = reached.withColumn("_opens", F.when(opens, F.col("start_timestamp")))
    begun = running_max_before(begun, ["session_id"], order, F.col("_opens"), "_before", block_ms)
    return begun.groupBy("session_id", F.coalesce("_opens", "_before").alias("_begin")).agg(
        F.min("start_timestamp").alias("start_timestamp"),
        F.max("end_timestamp").alias("end_timestamp"), F.count(F.lit(1)).alias("interval_count")
    ).drop("_begin")


def longest_exposure(pairs: DataFrame) -> DataFrame:
    """Exposure count, total and longest duration per session from (start, end) rows."""
    duration = F.col("end_timestamp") - F.col("start_timestamp")
    return pairs.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("exposure_count"), F.sum(duration).alias("total_exposure_ms"),
        F.max(duration).alias("longest_exposure_ms"))
