"""Feature/label matrix: reconciliation, eligibility, leakage-safe join, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftline import contract
from driftline.functions.parsing import is_finite
from driftline.functions.rules import assert_features_allowed, in_vocabulary
from driftline.operators.integrity import violations

MATRIX_COLUMNS = (
    "window_id", "session_id", "bag_id", "sensor_id", "dataset_partition",
    *contract.FEATURE_COLUMNS, "risk_label", "risk_label_index",
)


def reconcile_features(features: DataFrame, columns=contract.FEATURE_COLUMNS) -> DataFrame:
    """Rows where validity, reason and values contradict each other."""
    valid, reason = F.col("feature_valid"), F.col("exclusion_reason")
    finite = F.lit(True)
    empty = F.lit(True)
    for name in columns:
        finite = finite & is_finite(F.col(name))
        empty = empty & F.col(name).isNull()
    return violations(features, {
        "missing_identity": F.coalesce(F.col("session_id"), F.lit("")) == "",
        "valid_with_reason": valid & (reason != ""),
        "valid_without_values": valid & ~finite,
        "invalid_reason_unknown": ~valid & ~in_vocabulary(reason, contract.STRUCTURAL_REASONS),
        "invalid_with_values": ~valid & ~empty,
    }, ["window_id"])


def reconcile_labels(labels: DataFrame, boundary_version: str,
                     rulebook: str = contract.RULEBOOK_VERSION) -> DataFrame:
    """Rows where version, partition, deviation, label and index contradict each other."""
    names = F.array(*[F.lit(name) for name in contract.CLASS_NAMES])
    valid = F.col("label_valid")
    deviation = F.col("protocol_deviation_reason")
    index = F.array_position(names, F.col("risk_label")) - 1
    return violations(labels, {
        "rulebook_version": F.col("rulebook_version") != rulebook,
        "boundary_version": F.col("boundary_config_version") != boundary_version,
        "partition": ~in_vocabulary(F.col("dataset_partition"), contract.PARTITIONS),
        "deviation_reason": deviation != F.when(
            F.col("protocol_deviation"), "UNPLANNED_PHYSICAL_LEAK").otherwise(""),
        "valid_with_reason": valid & (F.col("exclusion_reason") != ""),
        "label_index": valid & ~F.col("risk_label_index").eqNullSafe(index),
        "invalid_with_label": ~valid & ((F.col("risk_label") != "")
                                        | F.col("risk_label_index").isNotNull()),
        "invalid_reason_unknown": ~valid & ~in_vocabulary(
            F.col("exclusion_reason"), contract.EXCLUSION_REASONS),
    }, ["window_id"])


def _labels_side(labels: DataFrame) -> DataFrame:
    return labels.select(
        "window_id", "label_valid", "risk_label", "risk_label_index", "dataset_partition",
        F.col("exclusion_reason").alias("label_reason"))


def validity_crosscheck(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Windows whose label validity contradicts their feature validity."""
    joined = features.join(_labels_side(labels), "window_id")
    usable, labelled = F.col("feature_valid"), F.col("label_valid")
    return violations(joined, {
        "label_valid_feature_invalid": labelled & ~usable,
        "structural_reason_differs": ~usable & (F.col("label_reason") != F.col("exclusion_reason")),
        "structural_reason_on_valid_feature":
            usable & ~labelled & in_vocabulary(F.col("label_reason"), contract.STRUCTURAL_REASONS),
    }, ["window_id"])


def feature_label_join(features: DataFrame, labels: DataFrame) -> DataFrame:
    """One-to-one join on the window; only windows valid on both sides remain."""
    return features.filter("feature_valid").join(
        _labels_side(labels).filter("label_valid"), "window_id")


def model_matrix(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Eligible rows in the fixed column order."""
    assert_features_allowed(contract.FEATURE_COLUMNS)
    return feature_label_join(features, labels).select(*MATRIX_COLUMNS)


def class_counts_by_partition(labels: DataFrame) -> DataFrame:
    """Class counts per partition; a partition without eligible windows stays visible."""
    eligible = F.col("label_valid")
    return labels.groupBy("dataset_partition").agg(
        F.count(F.lit(1)).alias("candidate_count"),
        *[F.count_if(eligible & (F.col("risk_label") == name)).alias(name.lower())
          for name in contract.CLASS_NAMES])


def exclusion_audit(sources: dict[str, DataFrame]) -> DataFrame:
    """Everything dropped and why, one long table.

    Each source has ``session_id``, ``unit``, ``n`` and ``reason``.
    """
    audit = None
    for origin, frame in sources.items():
        part = frame.select(F.lit(origin).alias("dataset_origin"), "session_id", "unit", "n", "reason")
        audit = part if audit is None else audit.unionByName(part)
    return audit


def matrix_counts(labels: DataFrame) -> DataFrame:
    """Counts a matrix manifest declares, as (metric, value) rows."""
    wide = labels.agg(
        F.count(F.lit(1)).alias("source_candidate_window_count"),
        F.count_if("label_valid").alias("eligible_row_count"),
        F.count_if(~F.col("label_valid")).alias("excluded_row_count"),
        *[F.count_if(F.col("label_valid") & (F.col("risk_label") == name))
          .alias(f"class_{name}") for name in contract.CLASS_NAMES],
        *[F.count_if(F.col("dataset_partition") == name).alias(f"partition_{name}")
          for name in contract.PARTITIONS])
    return wide.unpivot([], wide.columns, "metric", "value")


def count_reconciliation(declared: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Metrics that differ, or that only one side has."""
    left = declared.select("metric", F.col("value").alias("declared"))
    right = recomputed.select("metric", F.col("value").alias("recomputed"))
    return left.join(right, "metric", "full_outer").filter(
        ~F.col("declared").eqNullSafe(F.col("recomputed")))
