"""Event-derived ordinal labels: time from a window's end to the recorded event."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from driftline import contract
from driftline.functions.rules import window_id
from driftline.operators.ordered import lag_in_order


@dataclass(frozen=True)
class Boundary:
    """Class boundaries on time to event, in milliseconds."""

    b1_ms: int = 30_000
    b2_ms: int = 90_000
    b3_ms: int = 180_000
    version: str = "boundary-v0.1"
    rulebook: str = contract.RULEBOOK_VERSION
    block_ms: int = 3_600_000


START, END, LEAK = "INJECTION_START", "INJECTION_END", "PHYSICAL_LEAK_OBSERVED"


def event_summary(events: DataFrame, block_ms: int = 3_600_000) -> DataFrame:
    """First start, last end, leak and nesting faults per session.

    At equal timestamps a START sorts before an END.
    """
    kind = F.col("event_type")
    facts = events.groupBy("session_id").agg(
        F.min(F.when(kind == START, F.col("timestamp"))).alias("first_injection_start"),
        F.max(F.when(kind == END, F.col("timestamp"))).alias("last_injection_end"),
        F.min(F.when(kind == LEAK, F.col("timestamp"))).alias("physical_leak"),
        F.count_if(kind == START).alias("start_count"),
        F.count_if(kind == END).alias("end_count"),
        F.count_if(kind == LEAK).alias("leak_count"))
    nested = events.filter(kind.isin(START, END)).select(
        "session_id", "timestamp", F.when(kind == START, 0).otherwise(1).alias("_rank"),
        "seq", "event_type")
    stepped = lag_in_order(nested, ["session_id"], ["timestamp", "_rank", "seq"],
                           {"event_type": "_before"}, block_ms)
    is_start, open_ = kind == START, F.coalesce(F.col("_before") == START, F.lit(False))
    faults = stepped.groupBy("session_id").agg(
        F.count_if(is_start & open_).alias("overlap_count"),
        F.count_if(~is_start & ~open_).alias("orphan_end_count"),
        (F.max_by(kind, F.struct("timestamp", "_rank", "seq")) == START).alias("unclosed"))
    return facts.join(faults, "session_id", "left").fillna(
        0, ["overlap_count", "orphan_end_count"]).fillna(False, ["unclosed"])


def session_outcomes(sessions: DataFrame, summary: DataFrame) -> DataFrame:
    """Sessions with their event summary; sessions without events get zero counts."""
    return sessions.join(summary, "session_id", "left").fillna(
        0, ["start_count", "end_count", "leak_count", "overlap_count", "orphan_end_count"]
    ).fillna(False, ["unclosed"])


def malformed_events(outcomes: DataFrame) -> DataFrame:
    """One row per broken event rule; any row makes its session unusable for labels."""
    c = F.col
    arm, leaks = c("arm"), c("leak_count")
    injected = (c("start_count") + c("end_count")) > 0
    rules = {
        "OVERLAPPING_INJECTION": c("overlap_count") > 0,
        "END_WITHOUT_START": c("orphan_end_count") > 0,
        "START_WITHOUT_END": c("unclosed"),
        "SEVERAL_LEAKS": leaks > 1,
        "CONFIRMED_WITHOUT_LEAK": (c("end_reason") == "LEAK_CONFIRMED") & (leaks == 0),
        "SAFE_WITH_INJECTION": (arm == "SAFE") & injected,
        "SAFE_WITH_LEAK": (arm == "SAFE") & (leaks > 0),
        "GRADUAL_WITHOUT_START": (arm == "LEAK_GRADUAL") & (c("start_count") == 0),
        "GRADUAL_WITHOUT_END": (arm == "LEAK_GRADUAL") & (c("end_count") == 0),
        "LEAK_BEFORE_INJECTION": (arm == "LEAK_GRADUAL")
            & (c("physical_leak") < c("first_injection_start")),
    }
    names = F.array_compact(F.array(*[
        F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]))
    return outcomes.select("session_id", F.explode(names).alias("fault"))


def time_to_event_class(tau_ms: Column, boundary: Boundary) -> Column:
    """Class index of a positive time to event; boundaries belong to the riskier class."""
    return (
        F.when(tau_ms > boundary.b3_ms, 0).when(tau_ms > boundary.b2_ms, 1)
        .when(tau_ms > boundary.b1_ms, 2).otherwise(3)
    )


def horizon_completion(outcomes: DataFrame) -> DataFrame:
    """Whether a planned safe horizon was completed, from the anchor and after the last end.

    ``outcomes`` needs ``safe_anchor`` and ``planned_horizon_s``.
    """
    horizon = F.col("planned_horizon_s") * 1000
    end = F.col("end_timestamp")
    done = F.lit(False)
    return outcomes.withColumns({
        "safe_horizon_completed": F.coalesce(end >= F.col("safe_anchor") + horizon, done),
        "fill_horizon_completed": F.coalesce(end >= F.col("last_injection_end") + horizon, done)})


def protocol_deviation(outcomes: DataFrame) -> DataFrame:
    """A planned non-leaking gradual session that leaked."""
    deviated = ((F.col("arm") == "LEAK_GRADUAL") & F.col("physical_leak").isNotNull()
                & F.col("planned_horizon_s").isNotNull())
    return outcomes.withColumns({
        "protocol_deviation": deviated,
        "protocol_deviation_reason": F.when(deviated, "UNPLANNED_PHYSICAL_LEAK").otherwise("")})


def label_windows(windows: DataFrame, outcomes: DataFrame, boundary: Boundary) -> DataFrame:
    """Label of every window: structural exclusions first, then arm, then scenario.

    ``windows`` carries the structural ``exclusion_reason``; ``outcomes`` is one
    row per session from ``horizon_completion`` and ``protocol_deviation`` with
    ``dataset_partition``.
    """
    per_session = outcomes.select(
        "session_id", "arm", "first_injection_start", "physical_leak", "safe_horizon_completed",
        "fill_horizon_completed", "protocol_deviation", "protocol_deviation_reason",
        "dataset_partition")
    joined = windows.select("session_id", "window_index", "window_start", "window_end",
                            F.col("exclusion_reason").alias("_structural")) \
        .join(per_session, "session_id")
    end, leak = F.col("window_end"), F.col("physical_leak")
    arm = F.col("arm")
    dry = F.coalesce(end < F.col("first_injection_start"), F.lit(False))
    leaking, safe = F.col("physical_leak").isNotNull(), F.lit(0)
    completed = F.when(arm == "SAFE", F.col("safe_horizon_completed")).otherwise(
        dry | F.col("fill_horizon_completed"))
    scenario = (
        F.when(leaking & (arm == "LEAK_GRADUAL") & (end >= leak), "POST_LEAK")
        .when(((arm == "SAFE") | ~leaking) & ~completed, "CENSORED_NO_SAFE_HORIZON"))
    reason = (
        F.when(F.col("_structural") != "", F.col("_structural"))
        .when(arm == "LEAK_SUDDEN", "SUDDEN_ARM")
        .when(arm == "FIELD", "FIELD_ARM_EXCLUDED")
        .otherwise(F.coalesce(scenario, F.lit(""))))
    index = F.when(F.col("exclusion_reason") == "", F.when(
        (arm == "LEAK_GRADUAL") & leaking & ~dry, time_to_event_class(leak - end, boundary)
    ).otherwise(safe))
    names = F.array(*[F.lit(name) for name in contract.CLASS_NAMES])
    return (
        joined.withColumn("exclusion_reason", reason)
        .withColumn("risk_label_index", index)
        .select(
            window_id(F.col("session_id"), F.col("window_index")).alias("window_id"),
            "session_id", "window_index", "window_start", "window_end",
            F.coalesce(F.get(names, F.col("risk_label_index")), F.lit("")).alias("risk_label"),
            "risk_label_index", (F.col("exclusion_reason") == "").alias("label_valid"),
            "exclusion_reason", F.lit(boundary.rulebook).alias("rulebook_version"),
            F.lit(boundary.version).alias("boundary_config_version"), "dataset_partition",
            "protocol_deviation", "protocol_deviation_reason"))


def label_counts(labels: DataFrame) -> DataFrame:
    """Counts per class and per exclusion reason, zero-filled."""
    spark = labels.sparkSession
    spine = spark.createDataFrame(
        [("class", name) for name in contract.CLASS_NAMES]
        + [("exclusion", name) for name in contract.EXCLUSION_REASONS], "kind string, item string")
    item = F.when(F.col("label_valid"), F.col("risk_label")).otherwise(F.col("exclusion_reason"))
    counts = labels.groupBy(
        F.when(F.col("label_valid"), "class").otherwise("exclusion").alias("kind"),
        item.alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, ["kind", "item"], "left").select(
        "kind", "item", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def feature_label_crosscheck(features: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows on one side only, or with different identity, validity or reason."""
    fields = ("window_start", "window_end", "feature_valid", "exclusion_reason")
    keys = ["session_id", "window_index"]
    tagged = features.select(*keys, F.struct(*fields).alias("_f"), F.lit(None).alias("_w")) \
        .unionByName(windows.select(*keys, F.lit(None).alias("_f"), F.struct(*fields).alias("_w")))
    pairs = tagged.groupBy(*keys).agg(F.max("_f").alias("_f"), F.max("_w").alias("_w"))
    differing = F.array_join(F.array_compact(F.array(*[
        F.when(~F.col("_f")[name].eqNullSafe(F.col("_w")[name]), F.lit(name))
        for name in fields])), ",")
    problem = (F.when(F.col("_f").isNull(), "labels_only").when(F.col("_w").isNull(), "features_only")
               .otherwise(differing))
    return pairs.select(*keys, problem.alias("problem")).filter(F.col("problem") != "")
