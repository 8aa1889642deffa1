"""Classification metrics over a fixed ordinal class set, optionally per group.

Predictions collapse to (group, truth, predicted) counts in one map-side
combined aggregation; everything else works on that small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftline.functions.parsing import is_finite


def confusion_counts(predictions: DataFrame, groups: list[str]) -> DataFrame:
    return predictions.groupBy(*groups, "truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def _class_array(classes: int):
    return F.array(*[F.lit(i) for i in range(classes)])


def confusion_matrix(predictions: DataFrame, groups: list[str] | None = None,
                     classes: int = 4) -> DataFrame:
    """Dense matrix as rows (truth, predicted, n), zero cells included."""
    groups = groups or []
    counts = confusion_counts(predictions, groups)
    cells = F.flatten(F.transform(_class_array(classes), lambda t: F.transform(
        _class_array(classes), lambda p: F.struct(t.alias("truth"), p.alias("predicted")))))
    frame = counts.select(*groups).distinct() if groups else counts.groupBy().agg(
        F.count(F.lit(1)).alias("_cells"))
    spine = frame.select(*groups, F.explode(cells).alias("_c")).select(*groups, "_c.*")
    keys = [*groups, "truth", "predicted"]
    return spine.join(counts, keys, "left").select(
        *keys, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def _ratio(top, bottom):
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def per_class_metrics(predictions: DataFrame, groups: list[str] | None = None,
                      classes: int = 4) -> DataFrame:
    """Precision, recall, F1 and support per class; 0/0 counts as 0."""
    groups = groups or []
    cells = confusion_matrix(predictions, groups, classes)
    parts = cells.select(*groups, F.explode(F.array(
        F.struct(F.col("truth").alias("class_index"), F.col("n").alias("s"), F.lit(0).alias("p"),
                 F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("h")),
        F.struct(F.col("predicted").alias("class_index"), F.lit(0).alias("s"),
                 F.col("n").alias("p"), F.lit(0).alias("h")))).alias("_p")).select(*groups, "_p.*")
    sums = parts.groupBy(*groups, "class_index").agg(
        F.sum("s").alias("support"), F.sum("p").alias("_predicted"), F.sum("h").alias("_hits"))
    return sums.select(
        *groups, "class_index",
        _ratio(F.col("_hits"), F.col("_predicted")).alias("precision"),
        _ratio(F.col("_hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("_hits"), F.col("support") + F.col("_predicted")).alias("f1"), "support")


def macro_f1(predictions: DataFrame, groups: list[str] | None = None, classes: int = 4) -> DataFrame:
    """Mean F1 over all fixed classes, absent ones included."""
    groups = groups or []
    return per_class_metrics(predictions, groups, classes).groupBy(*groups).agg(
        (F.sum("f1") / F.lit(float(classes))).alias("macro_f1"))


def _kappa(n="n"):
    """Quadratic weights need only first and second moments of truth and prediction."""
    t, p, w = F.col("truth").cast("double"), F.col("predicted").cast("double"), F.col(n)
    observed = F.sum(w * (t - p) * (t - p))
    expected = F.sum(w * t * t) + F.sum(w * p * p) - 2 * F.sum(w * t) * F.sum(w * p) / F.sum(w)
    single = (F.max(F.greatest("truth", "predicted")) == F.min(F.least("truth", "predicted")))
    return F.when(~single, 1.0 - F.try_divide(observed, expected))


def quadratic_weighted_kappa(predictions: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Null where a single class is seen, which leaves kappa undefined."""
    groups = groups or []
    return confusion_counts(predictions, groups).groupBy(*groups).agg(
        _kappa().alias("quadratic_weighted_kappa"))


def accuracy(predictions: DataFrame, groups: list[str] | None = None) -> DataFrame:
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    return confusion_counts(predictions, groups or []).groupBy(*(groups or [])).agg(
        F.sum("n").alias("row_count"),
        (F.sum(hit).cast("double") / F.sum("n")).alias("accuracy"))


def adjacent_class_error_rate(predictions: DataFrame, groups: list[str] | None = None) -> DataFrame:
    near = F.when(F.abs(F.col("truth") - F.col("predicted")) == 1, F.col("n")).otherwise(0)
    return confusion_counts(predictions, groups or []).groupBy(*(groups or [])).agg(
        (F.sum(near).cast("double") / F.sum("n")).alias("adjacent_error_rate"))


def validate_labels(predictions: DataFrame, classes: int = 4) -> DataFrame:
    """Problem counts: missing or out-of-range truth and prediction."""
    checks = []
    for name in ("truth", "predicted"):
        value = F.col(name)
        checks += [F.count_if(value.isNull()).alias(f"{name}_missing"),
                   F.count_if(value.isNotNull() & ~value.between(0, classes - 1))
                   .alias(f"{name}_out_of_range")]
    return predictions.agg(F.count(F.lit(1)).alias("row_count"), *checks)


def metric_table(predictions: DataFrame, groups: list[str], classes: int = 4) -> DataFrame:
    """Accuracy, macro F1 and weighted kappa per group."""
    return accuracy(predictions, groups).join(macro_f1(predictions, groups, classes), groups).join(
        quadratic_weighted_kappa(predictions, groups), groups)


def truth_support(rows: DataFrame, classes: int = 4, groups: list[str] | None = None) -> DataFrame:
    """Rows and distinct sessions per true class, zero-filled."""
    groups = groups or []
    spine = rows.select(*groups).distinct() if groups else rows.groupBy().agg(
        F.count(F.lit(1)).alias("_n"))
    spine = spine.select(*groups, F.explode(_class_array(classes)).alias("truth"))
    counts = rows.groupBy(*groups, "truth").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("s"))
    zero = F.lit(0).cast("bigint")
    return spine.join(counts, [*groups, "truth"], "left").select(
        *groups, "truth", F.coalesce("n", zero).alias("support"),
        F.coalesce("s", zero).alias("session_count"))


def metric_snapshot_diff(published: DataFrame, recomputed: DataFrame, keys: list[str],
                         metrics: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Metrics that moved by more than the tolerance, or exist on one side only."""
    left = published.unpivot(keys, metrics, "metric", "published")
    right = recomputed.unpivot(keys, metrics, "metric", "recomputed")
    joined = left.join(right, [*keys, "metric"], "full_outer")
    close = is_finite(F.col("published")) & is_finite(F.col("recomputed")) & (
        F.abs(F.col("published") - F.col("recomputed")) <= tolerance)
    both_null = F.col("published").isNull() & F.col("recomputed").isNull()
    return joined.filter(~(F.coalesce(close, F.lit(False)) | both_null))


def prediction_snapshot_diff(snapshot: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, and keys whose class changed."""
    pairs = snapshot.select(key, F.col("predicted").alias("snapshot_class")).join(
        current.select(key, F.col("predicted").alias("current_class")), key, "full_outer")
    problem = (
        F.when(F.col("current_class").isNull(), "snapshot_only")
        .when(F.col("snapshot_class").isNull(), "current_only")
        .when(F.col("snapshot_class") != F.col("current_class"), "class_changed"))
    return pairs.withColumn("problem", problem).filter(F.col("problem").isNotNull())
