"""Typed contract tables from all-string rows; unusable rows go to a reject table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftline import contract
from driftline.functions import parsing, rules
from driftline.functions.arrays import once

INTEGERS = ("timestamp", "start_timestamp", "end_timestamp", "sample_no", "elapsed_ms")
DOUBLES = ("baseline_value", "baseline_std", "capacitance_raw", "lig_raw")
VOCABULARIES = {
    "arm": contract.ARMS, "end_reason": contract.END_REASONS,
    "cap_quality": contract.CHANNEL_QUALITIES, "lig_quality": contract.CHANNEL_QUALITIES,
    "system_quality": contract.SYSTEM_QUALITIES, "event_type": contract.EVENT_TYPES,
}


def _typed(name: str) -> Column:
    text = F.col(name)
    if name in INTEGERS:
        return parsing.strict_int(text)
    if name in DOUBLES:
        return parsing.finite_double(text)
    return text


def _rejected(name: str) -> Column:
    if name in VOCABULARIES:
        return ~rules.in_vocabulary(F.col(name), VOCABULARIES[name])
    if name == "event_metadata":
        return ~parsing.json_object_is_finite(F.col(name))
    return _typed(name).isNull()


def type_rows(rows: DataFrame, fields) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected rows with the fields that did not parse).

    A row is rejected when a number, enum or JSON field is unusable; broken
    ids and semantics are left to the record rules and the quality gate.
    """
    bad = rules.broken_rules({name: _rejected(name) for name in fields})
    judged = rows.withColumn("rejected_fields", bad)
    others = [name for name in rows.columns if name not in fields]
    typed = judged.filter(F.size("rejected_fields") == 0).select(
        *[_typed(name).alias(name) for name in fields], *others)
    return typed, judged.filter(F.size("rejected_fields") > 0)


def logger_intake(rows: DataFrame, channels, statuses: dict[str, tuple] | tuple,
                  keep: tuple[str, ...] = ("session_id",)) -> tuple[DataFrame, DataFrame]:
    """(typed wide logger rows, rejected fields) of all-string rows of `scan_logger_csv`.

    Sample number and elapsed time are strict integers, channel values finite numbers, and a status
    is one of the channel's allowed ones (``statuses``: one vocabulary, or one per channel).  A row
    with a rejected field is left out of the typed rows; each such field is a row of the second
    table, with the text that was read.
    """
    allowed = statuses if isinstance(statuses, dict) else {c: statuses for c in channels}
    missing = [c for c in channels if c not in allowed]
    if missing:
        raise ValueError(f"no allowed statuses for {missing}")
    numbers = {"sample_no": parsing.strict_int(F.col("sample_no")),
               "elapsed_ms": parsing.strict_int(F.col("elapsed_ms"))}
    numbers.update({c: parsing.finite_double(F.col(c)) for c in channels})
    parsed = rows.withColumn("_numbers", once(F.struct(*[v.alias(name) for name, v in numbers.items()])))
    faults = [(name, F.col("_numbers")[name].isNull(), "NUMBER") for name in numbers]
    faults += [(f"{c}_status", ~rules.in_vocabulary(F.col(f"{c}_status"), allowed[c]), "STATUS")
               for c in channels]
    judged = parsed.withColumn("_faults", F.filter(F.array(*[
        F.when(F.coalesce(bad, F.lit(True)), F.struct(
            F.lit(name).alias("field"), F.col(name).alias("text"), F.lit(problem).alias("problem")))
        for name, bad, problem in faults]), lambda f: f.isNotNull()))
    typed = judged.where(F.size("_faults") == 0).select(
        *keep, *[F.col("_numbers")[name].alias(name) for name in numbers],
        *[f"{c}_status" for c in channels])
    rejected = judged.where(F.size("_faults") > 0).select(
        *keep, F.col("sample_no").alias("sample_text"), F.explode("_faults").alias("_f")).select(
        *keep, "sample_text", "_f.*")
    return typed, rejected


def channel_rows(typed: DataFrame, channels, keep: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Logger rows with one row per channel: ``channel``, ``value``, ``status``."""
    return typed.select(*keep, "sample_no", "elapsed_ms", F.explode(F.array(*[
        F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value"),
                 F.col(f"{c}_status").alias("status")) for c in channels])).alias("_c")).select(
        *keep, "sample_no", "elapsed_ms", "_c.*")
