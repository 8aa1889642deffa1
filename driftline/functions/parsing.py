"""Strict text parsing: null means rejected."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def strict_int(text: Column) -> Column:
    return F.when(text.rlike(_INTEGER), F.trim(text).try_cast("bigint"))


def finite_double(text: Column) -> Column:
    parsed = F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))
    return F.when(F.abs(parsed) < F.lit(float("inf")), parsed)  # NaN is the greatest value


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def strict_bool(text: Column) -> Column:
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def positive_int(text: Column) -> Column:
    parsed = strict_int(text)
    return F.when(parsed > 0, parsed)


def positive_double(text: Column) -> Column:
    parsed = finite_double(text)
    return F.when(parsed > 0, parsed)


def json_object_is_finite(text: Column) -> Column:
    """True for a JSON object whose numbers are all finite, at any depth.

    The parser rejects the bare tokens NaN and Infinity.  A number too large
    for a double parses as infinity and is written back as ``"Infinity"``; it
    shows as one more such token than the text itself has.
    """
    token = F.lit('"-?Infinity"')
    parsed = F.try_parse_json(text)
    overflow = F.regexp_count(parsed.cast("string"), token) > F.regexp_count(text, token)
    is_object = F.json_object_keys(text).isNotNull()
    return F.coalesce(is_object & parsed.isNotNull() & ~overflow, F.lit(False))
