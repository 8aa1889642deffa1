"""Reduction of high-rate readings to bins, and baseline normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftline.functions.arrays import median_absolute_deviation, median_of_sorted
from driftline.operators.ordered import lag_in_order, per_key_join, row_sequence

MAD_FACTOR = 1.4826


def cadence_check(rows: DataFrame, interval_ms: int, arrival: str = "arrival",
                  session: str = "session_id", block_rows: int = 1_000_000) -> DataFrame:
    """Rows whose sample number or elapsed time breaks the fixed cadence.

    Numbers must count up from 0 in arrival order; elapsed time must be
    ``first + n * interval`` with the first at 0 or one interval.
    """
    numbered = row_sequence(rows, [session], [arrival], block_rows, "expected_no")
    first = rows.groupBy(session).agg(F.min_by("elapsed_ms", arrival).alias("_first"))
    expected = F.col("_first") + F.col("sample_no") * interval_ms
    checked = per_key_join(
        numbered, first, [session], F.col(arrival), block_rows).withColumns({
        "expected_elapsed_ms": expected,
        "problem": F.when(F.col("sample_no") != F.col("expected_no"), "SAMPLE_NO")
        .when(~F.col("_first").isin(0, interval_ms) & (F.col("expected_no") == 0), "FIRST_ELAPSED")
        .when(F.col("elapsed_ms") != expected, "ELAPSED"),
    })
    return checked.filter(F.col("problem").isNotNull()).select(
        session, arrival, "sample_no", "expected_no", "elapsed_ms", "expected_elapsed_ms", "problem")


def merged_status(status: Column) -> Column:
    """One status, or ``MIXED:a+b`` with the sorted distinct statuses."""
    distinct = F.sort_array(F.collect_set(status))
    return F.when(F.size(distinct) == 1, distinct[0]).otherwise(
        F.concat(F.lit("MIXED:"), F.array_join(distinct, "+")))


def count_bins_median(rows: DataFrame, channels: dict[str, str], size: int,
                      session: str = "session_id") -> DataFrame:
    """Median of each full group of ``size`` consecutive samples, per channel.

    ``channels`` maps a value column to its status column.  A group is keyed by
    ``(session, sample_no div size)``, so a long session spreads over tasks and
    a group never holds more than ``size`` readings.
    """
    grouped = rows.groupBy(session, F.floor(F.col("sample_no") / size).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("elapsed_ms").alias("elapsed_ms"),
        F.min("sample_no").alias("raw_sample_start"), F.max("sample_no").alias("raw_sample_end"),
        *[expr for value, status in channels.items() for expr in (
            median_of_sorted(F.sort_array(F.collect_list(value))).alias(value),
            merged_status(F.col(status)).alias(status))])
    return grouped.filter(F.col("_n") == size).withColumn(
        "second_index", F.col("_bin") + 1).drop("_bin", "_n")


def partial_bin_report(rows: DataFrame, size: int, session: str = "session_id") -> DataFrame:
    """Full bins and leftover readings per session."""
    return rows.groupBy(session).agg(F.count(F.lit(1)).alias("raw_row_count")).select(
        session, "raw_row_count", F.floor(F.col("raw_row_count") / size).alias("full_bin_count"),
        (F.col("raw_row_count") % size).alias("leftover_count"))


def robust_baseline(bins: DataFrame, channels: list[str], seconds: int,
                    session: str = "session_id") -> DataFrame:
    """Median, MAD and scale per session and channel over the first ``seconds`` bins.

    Sessions with fewer bins are absent.  A group holds ``seconds`` values, so
    gathering them keeps the two-pass MAD in one aggregation.
    """
    first = bins.filter(F.col("second_index") <= seconds).groupBy(session).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sort_array(F.collect_list(channel)).alias(channel) for channel in channels],
    ).filter(F.col("_n") >= seconds)
    medians = first.withColumns({
        f"{channel}_baseline": median_of_sorted(F.col(channel)) for channel in channels})
    with_mad = medians.withColumns({
        f"{channel}_mad": median_absolute_deviation(F.col(channel), F.col(f"{channel}_baseline"))
        for channel in channels})
    return with_mad.select(session, *[expr for channel in channels for expr in (
        F.col(f"{channel}_baseline"), F.col(f"{channel}_mad"),
        F.greatest(F.abs(F.col(f"{channel}_baseline")), MAD_FACTOR * F.col(f"{channel}_mad"),
                   F.lit(1.0)).alias(f"{channel}_scale"))])


def normalised_delta(bins: DataFrame, baseline: DataFrame, channels: list[str],
                     session: str = "session_id") -> DataFrame:
    """Adds ``(x - baseline) / scale`` per channel."""
    parameters = [f"{channel}_{part}" for channel in channels for part in ("baseline", "scale")]
    joined = per_key_join(bins, baseline.select(session, *parameters), [session],
                          F.col("second_index"), 3600)
    return joined.withColumns({
        f"{channel}_delta_norm":
            (F.col(channel) - F.col(f"{channel}_baseline")) / F.col(f"{channel}_scale")
        for channel in channels}).drop(*[f"{channel}_scale" for channel in channels])


def pilot_session_qc(rows: DataFrame, channels: dict[str, str], baseline: DataFrame, size: int,
                     window_s: int, stride_s: int, session: str = "session_id") -> DataFrame:
    """Counts, time range, interval range, status values and baseline per session."""
    stepped = lag_in_order(rows, [session], ["sample_no"], {"elapsed_ms": "_before"}, 1_000_000)
    step = F.col("elapsed_ms") - F.col("_before")
    n = F.count(F.lit(1))
    facts = stepped.groupBy(session).agg(
        n.alias("raw_row_count"), F.floor(n / size).alias("full_1hz_bin_count"),
        (n % size).alias("partial_final_raw_sample_count"),
        F.min("elapsed_ms").alias("first_elapsed_ms"), F.max("elapsed_ms").alias("last_elapsed_ms"),
        F.coalesce(F.min(step), F.lit(0).cast("bigint")).alias("interval_min_ms"),
        F.coalesce(F.max(step), F.lit(0).cast("bigint")).alias("interval_max_ms"),
        *[F.array_join(F.sort_array(F.collect_set(status)), "+").alias(f"{value}_status_values")
          for value, status in channels.items()])
    bins = F.col("full_1hz_bin_count")
    windows = F.when(bins >= window_s, F.floor((bins - window_s) / stride_s) + 1).otherwise(
        F.lit(0).cast("bigint"))
    return facts.withColumn("window_count", windows).join(baseline, session, "left")
