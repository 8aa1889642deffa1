"""Session-anchored windows with a frozen baseline, scored as they close.

``window()`` is aligned to the epoch; windows anchored at a session's first sample need state.  It
is kept as three tables beside the checkpoint, one version per micro-batch:

* ``sessions``: anchor, baseline, newest sample and next window of each session;
* ``rows``: samples whose pane is still open, or that the baseline waits for;
* ``panes``: statistics of closed panes that a window still to come needs.

A micro-batch reads the version before it and writes its own, both with the batch operators: panes
are dealt by (session, pane) and windows by (session, window), so a busy session spreads over all
tasks, and validity, features and classes are those of `operators.windows` and `operators.model`.
A pane is computed once, from all its samples, when the watermark passes it.  Output and state of a
batch are written under its number: a batch that is run again after a failure overwrites them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from driftline import contract
from driftline.functions.ordinal import OrdinalModel
from driftline.operators.model import ordinal_score
from driftline.operators.ordered import exact_quantiles, per_key_join
from driftline.operators.windows import (
    WindowSpec, feature_columns, merge_panes, pane_number, placed_pane_statistics, window_validity)
from driftline.session import materialise, shared_dir

OUTPUT = ("session_id string, window_index bigint, window_end bigint, sample_count bigint, "
          "valid boolean, exclusion_reason string, baseline_value double, value_mean double, "
          "value_last double, value_slope double, value_variance double, value_range double, "
          "predicted_index int")
SESSIONS = ("session_id string, t_ref bigint, baseline_value double, newest bigint, "
            "next_index bigint")
ROWS = "session_id string, ts_ms bigint, value double, bad boolean"
CHANNEL = "cap"


@dataclass(frozen=True)
class ScoringSpec:
    """Geometry in milliseconds.

    A sample at or before the watermark (the newest sample so far less ``delay``) is late and
    dropped.  A session without samples for ``idle`` is over once a micro-batch ends, and later
    samples start anew; so ``idle`` has no default: it must exceed every gap within a session, and
    is at least the baseline and a window.
    """

    windows: WindowSpec
    baseline: int
    delay: int
    idle: int

    def __post_init__(self) -> None:
        if self.idle < self.baseline + self.windows.window:
            raise ValueError("idle is shorter than the baseline period and a window")


class SessionScoring:
    """State tables and results of one scored stream, in one shared folder."""

    def __init__(self, spark: SparkSession, model: OrdinalModel, spec: ScoringSpec,
                 folder: str | None = None) -> None:
        self.spark, self.model, self.spec = spark, model, spec
        self.folder = folder or f"{shared_dir(spark)}/scoring-{uuid.uuid4().hex}"

    def start(self, stream: DataFrame, session: str, ts: str, value: str, ok: Column,
              available_now: bool = True, **trigger) -> StreamingQuery:
        """Score a stream; samples without a session or a time are not scored."""
        prepared = stream.select(
            F.col(session).alias("session_id"), F.unix_millis(ts).alias("ts_ms"),
            F.col(value).cast("double").alias("value"),
            (~F.coalesce(ok, F.lit(False))).alias("bad")
        ).where("session_id is not null and ts_ms is not null")
        trigger = trigger or ({"availableNow": True} if available_now else {})
        self.write(-1, self.spark.createDataFrame([], OUTPUT))  # results exist from the start
        writer = prepared.writeStream.foreachBatch(self.process).option(
            "checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(**trigger) if trigger else writer).start()

    def results(self) -> DataFrame:
        """Windows of all batches so far."""
        return self.spark.read.schema(OUTPUT).parquet(f"{self.folder}/results/*")

    def process(self, batch: DataFrame, number: int) -> None:
        spec, windows = self.spec, self.spec.windows
        before, seen = self.state(number - 1), None
        rows = batch
        if before:
            seen = before["clock"].first()[0]
            if seen is not None:
                batch = batch.where(F.col("ts_ms") > seen - spec.delay)
            rows = batch.unionByName(before["rows"])  # their panes were open, so they are not late
        rows = self.kept(number, "input", rows)
        newest = rows.agg(F.max("ts_ms")).first()[0]
        newest = max((x for x in (seen, newest) if x is not None), default=None)
        if newest is None:
            return self.commit(number, before)
        watermark = newest - spec.delay
        passed = seen - spec.delay if seen is not None else -(1 << 62)

        # sessions: an anchor or a baseline is final once the watermark has passed it
        facts = rows.groupBy("session_id").agg(
            F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"))
        known = before["sessions"] if before else self.spark.createDataFrame([], SESSIONS)
        sessions = known.join(facts, "session_id", "full").select(
            "session_id", F.coalesce("t_ref", F.when(F.col("first") <= watermark, F.col("first")))
            .alias("t_ref"), "baseline_value", F.greatest("newest", "last").alias("newest"),
            F.coalesce("next_index", F.lit(0).cast("bigint")).alias("next_index"))
        sessions = materialise(sessions)
        placed = materialise(per_key_join(
            rows, sessions.select("session_id", "t_ref", F.col("baseline_value").isNotNull()
                                  .alias("calibrated")),
            ["session_id"], F.col("ts_ms"), windows.window
        ).withColumn("closes", F.col("t_ref") + pane_number(windows, "ts_ms") * windows.pane))
        early = ~F.col("calibrated") & (F.col("ts_ms") < F.col("t_ref") + spec.baseline)
        due = F.col("t_ref") + spec.baseline <= watermark
        found = exact_quantiles(placed.where(early & due), ["session_id"], "value",
                                {"found": 0.5})
        reach = F.floor((F.least(F.lit(watermark), F.col("newest")) - F.col("t_ref")
                         - windows.window) / F.lit(windows.stride)) + 1
        sessions = materialise(sessions.join(found, "session_id", "left").withColumn(
            "baseline_value", F.coalesce("baseline_value", "found")).withColumn(
            "until", F.when(F.col("baseline_value").isNull(), F.col("next_index"))
            .otherwise(F.greatest("next_index", reach))).drop("found"))

        # panes that the watermark has passed since the last batch
        closing = (F.col("closes") > passed) & (F.col("closes") <= watermark)
        panes = placed_pane_statistics(
            placed.where(closing).select("session_id", "ts_ms", "t_ref", "bad",
                                         F.col("value").alias(CHANNEL)),
            windows, {CHANNEL: CHANNEL}, F.col("bad"), "session_id", "ts_ms")
        panes = self.kept(number, "all_panes", panes.unionByName(before["panes"])
                          if before else panes)
        self.write(number, self.scored(panes, sessions))

        # what the next batch needs
        over = F.col("newest") + spec.idle <= watermark
        left = sessions.where(~over)
        bounds = left.select("session_id", "until")
        self.kept(number, "sessions", left.select(
            "session_id", "t_ref", "baseline_value", "newest", F.col("until").alias("next_index")))
        calibrated = left.select("session_id", F.col("baseline_value").isNotNull().alias("done"))
        waits = F.col("t_ref").isNull() | (F.col("closes") > watermark) | (
            ~F.col("done") & (F.col("ts_ms") < F.col("t_ref") + spec.baseline))
        self.kept(number, "rows", per_key_join(
            placed, calibrated, ["session_id"], F.col("ts_ms"), windows.window).where(waits).select(
            "session_id", "ts_ms", "value", "bad"))
        self.kept(number, "panes", panes.join(bounds, "session_id").where(
            F.col("pane") > F.col("until") * windows.panes_per_stride).drop("until"))
        self.kept(number, "clock", self.spark.range(1).select(F.lit(newest).alias("newest")))
        self.forget(number)

    def scored(self, panes: DataFrame, sessions: DataFrame) -> DataFrame:
        """The windows that close now, by the batch operators."""
        windows = self.spec.windows
        closing = sessions.where("until > next_index")
        spine = closing.withColumn("window_index", F.explode(F.sequence(
            F.col("next_index"), F.col("until") - 1))).select(
            "session_id", "window_index", "baseline_value", (
                F.col("t_ref") + F.col("window_index") * windows.stride + windows.window
            ).alias("window_end"))
        inside = (F.col("pane") > F.col("next_index") * windows.panes_per_stride) & (
            F.col("pane") <= (F.col("until") - 1) * windows.panes_per_stride
            + windows.panes_per_window)
        used = panes.join(closing.select("session_id", "next_index", "until"), "session_id").where(
            inside).select(*panes.columns)
        found = window_validity(merge_panes(used, spine, windows, [CHANNEL], "session_id"), windows)
        found = found.withColumns({
            name: F.when(F.col("feature_valid"), column)
            for name, column in feature_columns(windows).items()})
        scored = ordinal_score(found, self.model)
        complete = F.col("feature_valid")
        for name in contract.FEATURE_COLUMNS:
            complete = complete & F.col(name).isNotNull()
        short = ("mean", "last", "slope", "variance", "range")
        return scored.select(
            "session_id", "window_index", "window_end", "sample_count",
            F.col("feature_valid").alias("valid"), "exclusion_reason", "baseline_value",
            *[F.col(name).alias(f"value_{s}") for name, s in zip(contract.FEATURE_COLUMNS, short)],
            F.when(complete, F.col("predicted_index")).alias("predicted_index"))

    # tables of one version ------------------------------------------------------------

    def path(self, number: int, name: str) -> str:
        return f"{self.folder}/state/{number}/{name}"

    def kept(self, number: int, name: str, frame: DataFrame) -> DataFrame:
        frame.write.mode("overwrite").parquet(self.path(number, name))
        return self.spark.read.schema(frame.schema).parquet(self.path(number, name))

    def state(self, number: int) -> dict[str, DataFrame] | None:
        if number < 0:
            return None
        return {name: self.spark.read.parquet(self.path(number, name))
                for name in ("sessions", "rows", "panes", "clock")}

    def write(self, number: int, frame: DataFrame) -> None:
        frame.write.mode("overwrite").parquet(f"{self.folder}/results/{number}")

    def commit(self, number: int, before: dict[str, DataFrame] | None) -> None:
        """A batch without rows hands the state on."""
        for name, frame in (before or self.nothing()).items():
            self.kept(number, name, frame)
        self.write(number, self.spark.createDataFrame([], OUTPUT))

    def nothing(self) -> dict[str, DataFrame]:
        rows = self.spark.createDataFrame([], ROWS)
        panes = placed_pane_statistics(
            rows.select("session_id", "ts_ms", F.lit(0).cast("bigint").alias("t_ref"), "bad",
                        F.col("value").alias(CHANNEL)),
            self.spec.windows, {CHANNEL: CHANNEL}, F.col("bad"), "session_id", "ts_ms")
        return {"sessions": self.spark.createDataFrame([], SESSIONS), "rows": rows, "panes": panes,
                "clock": self.spark.createDataFrame([(None,)], "newest bigint")}

    def forget(self, number: int) -> None:
        """The version before the last one; the last one may be needed to run a batch again."""
        context = self.spark.sparkContext
        old = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state/{number - 2}")
        old.getFileSystem(context._jsc.hadoopConfiguration()).delete(old, True)


def score_available(stream: DataFrame, model: OrdinalModel, spec: ScoringSpec, session: str,
                    ts: str, value: str, ok: Column) -> DataFrame:
    """Score everything that a stream has now and read the windows back."""
    scoring = SessionScoring(stream.sparkSession, model, spec)
    scoring.start(stream, session, ts, value, ok).awaitTermination()
    return scoring.results()
