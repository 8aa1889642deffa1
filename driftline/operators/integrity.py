"""Keys, references, agreement between tables, and group leakage.

All operators are equi-joins or mergeable aggregates.  The optimizer broadcasts
a side only below its size threshold and splits skewed partitions of the
sort-merge join beyond it; where rows are grouped by the join key right after
the join, ``per_key_join`` keeps a hot key spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftline.operators.ordered import per_key_join


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter(
        F.col("occurrences") > 1)


def orphan_rows(rows: DataFrame, parents: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows whose key has no parent."""
    return rows.join(parents.select(key).distinct(), key, "left_anti")


def extra_manifest_rows(manifest: DataFrame, sessions: DataFrame,
                        key: str = "session_id") -> DataFrame:
    """Manifest rows that name an unknown session."""
    return orphan_rows(manifest, sessions, key)


def key_set_difference(left: DataFrame, right: DataFrame, key: str = "session_id") -> DataFrame:
    """Keys on one side only; no rows means the tables cover each other exactly."""
    tagged = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    sides = tagged.groupBy(key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return sides.filter(F.col("_l") != F.col("_r")).select(
        key, F.when(F.col("_l") == 1, "left_only").otherwise("right_only").alias("side"))


def rows_outside_session(rows: DataFrame, sessions: DataFrame, order: str = "seq",
                         block_rows: int = 1_000_000) -> DataFrame:
    """Per session: rows outside ``[start, end]`` and the first of them in arrival order."""
    bounds = sessions.select("session_id", "start_timestamp", "end_timestamp")
    outside = per_key_join(rows.select("session_id", "timestamp", order), bounds, ["session_id"],
                           F.col(order), block_rows).filter(
        ~F.col("timestamp").between(F.col("start_timestamp"), F.col("end_timestamp")))
    return outside.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("outside_count"),
        F.min_by("timestamp", order).alias("first_outside_timestamp"))


def field_agreement(left: DataFrame, right: DataFrame, key: str,
                    fields: dict[str, str]) -> DataFrame:
    """Joined rows that disagree, with the names of the differing fields.

    ``fields`` maps a left column to the right column it must equal (null-safe).
    """
    other = right.select(key, *[F.col(source).alias(f"_r_{target}")
                                for target, source in fields.items()])
    names = F.array_compact(F.array(*[
        F.when(~F.col(target).eqNullSafe(F.col(f"_r_{target}")), F.lit(target))
        for target in fields]))
    return left.select(key, *fields).join(other, key).select(
        key, F.array_join(names, ",").alias("mismatched_fields")
    ).filter(F.col("mismatched_fields") != "")


def _group_partitions(df: DataFrame, groups: list[str], partition: str) -> DataFrame:
    """Distinct (group kind, group id, partition); duplicates collapse before the shuffle."""
    return df.select(partition, F.explode(F.array(*[
        F.struct(F.lit(g).alias("group_kind"), F.col(g).cast("string").alias("group_id"))
        for g in groups])).alias("_g")).select("_g.*", partition).distinct()


def partition_leakage(df: DataFrame, groups: list[str],
                      partition: str = "dataset_partition") -> DataFrame:
    """Groups that occur in more than one partition."""
    return _group_partitions(df, groups, partition).groupBy("group_kind", "group_id").agg(
        F.count(F.lit(1)).alias("partition_count"),
        F.min(partition).alias("first_partition"), F.max(partition).alias("last_partition"),
    ).filter(F.col("partition_count") > 1)


def group_separation(df: DataFrame, groups: list[str],
                     partition: str = "dataset_partition") -> DataFrame:
    """Per group kind and partition: groups in it, and how many it shares with another one."""
    distinct = _group_partitions(df, groups, partition)
    spread = distinct.groupBy("group_kind", "group_id").agg(
        F.count(F.lit(1)).alias("_n"))
    return distinct.join(spread, ["group_kind", "group_id"]).groupBy("group_kind", partition).agg(
        F.count(F.lit(1)).alias("group_count"),
        F.count_if(F.col("_n") > 1).alias("shared_count"))


def attach(rows: DataFrame, dimension: DataFrame, columns: list[str],
           key: str = "session_id", how: str = "inner") -> DataFrame:
    """Add dimension attributes to rows by key."""
    return rows.join(dimension.select(key, *columns), key, how)


def attach_plan(sessions: DataFrame, plan: DataFrame, columns: list[str],
                key: str = "session_id") -> DataFrame:
    """Left join to the plan; ``plan_present`` is false where it has no row."""
    flagged = plan.select(key, *columns, F.lit(True).alias("plan_present"))
    return sessions.join(flagged, key, "left").fillna(False, ["plan_present"])


def violations(df: DataFrame, rules: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row per broken rule."""
    from driftline.functions.rules import broken_rules

    return df.select(*keep, F.explode(broken_rules(rules)).alias("rule"))
