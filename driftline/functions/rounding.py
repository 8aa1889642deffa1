"""Deterministic rounding and canonical text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from driftline.functions.arrays import let

#: Part of the last kept digit by which a value may miss a tie and still go up.
TIE_GUARD = 1e-6
#: From here on a double has no fraction.
WHOLE = float(2 ** 53)


def stable_round(value: Column, decimals: int = 6) -> Column:
    """Round half up to ``decimals``, with values a hair below a tie also going up.

    Distributed sums differ in the last bits from run to run, and a plain round would let a tie
    fall either way.  Negative zero becomes zero.  Values too large to have so many decimals,
    infinities and NaN stay as they are.
    """
    power = float(10 ** decimals)
    rounded = F.floor(value * F.lit(power) + F.lit(0.5 + TIE_GUARD)).cast("double") / F.lit(power)
    return F.when(F.abs(value) < F.lit(WHOLE / power), rounded).otherwise(value.cast("double"))


def canonical_boolean(value: Column) -> Column:
    return F.when(value, F.lit("true")).when(~value, F.lit("false")).otherwise(F.lit(""))


def canonical_number(value: Column, decimals: int = 6) -> Column:
    """Fixed-point text without trailing zeros; null becomes the empty string."""
    fixed = F.format_string(f"%.{decimals}f", stable_round(value, decimals))
    trimmed = F.regexp_replace(F.regexp_replace(fixed, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(value.isNotNull(), trimmed).otherwise(F.lit(""))


def _power(base: int, exponent: Column) -> Column:
    """``base ** exponent`` as an exact decimal; ``exponent`` from 0 to 37 for 10, to 119 for 2."""
    if base == 10:
        return F.concat(F.lit("1"), F.repeat(F.lit("0"), exponent)).cast("decimal(38,0)")
    low = F.least(exponent, F.lit(60))

    def part(bits: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), bits).cast("decimal(19,0)")

    return (part(low) * part(exponent - low)).cast("decimal(38,0)")


def _significant_digits(size: Column, exponent: Column, digits: int) -> Column:
    """The first ``digits`` digits of a positive double as a long, correctly rounded.

    A double is a whole number ``n`` over a power of two.  Scaled by the power of ten that leaves
    ``digits`` digits before the point, it is a fraction of two exact decimals, so the digits are
    a whole quotient and its remainder tells which side of a tie the double lies on.
    """
    places = F.lit(digits - 1) - exponent

    def fraction(shift: Column) -> Column:
        whole = (size * F.pow(F.lit(2.0), shift)).cast("bigint").cast("decimal(38,0)")
        return F.struct(
            (whole * _power(10, F.greatest(places, F.lit(0)))).cast("decimal(38,0)").alias("over"),
            (_power(2, shift) * _power(10, F.greatest(-places, F.lit(0)))).cast("decimal(38,0)")
            .alias("under"))

    def rounded(f: Column) -> Column:
        twice = ((f["over"] % f["under"]).cast("decimal(38,0)") * F.lit(2)).cast("decimal(38,0)")
        return let(F.call_function("div", f["over"], f["under"]), lambda q: q + (
            (twice > f["under"]) | ((twice == f["under"]) & (q % 2 == 1))).cast("bigint"))

    shift = F.greatest(F.lit(0), F.lit(54) - F.floor(F.log2(size)).cast("int"))
    return let(let(shift, fraction), rounded)


def canonical_significant(value: Column, digits: int = 12) -> Column:
    """Text with at most ``digits`` (up to 15) significant digits, as C's ``%.12g`` writes it.

    Zeros at the end go, negative zero is ``0``, and numbers below 1e-4 or from ``10 ** digits`` on
    have an exponent.  Ties are decided on the exact value from 1e-10 to 2 ** 62; beyond, on the
    shortest decimal text of the double.  Null is empty; NaN and infinities are named.
    """
    def exponent_of(text: Column) -> Column:
        return F.element_at(F.split(text, "e"), 2).cast("int")

    def parts(size: Column) -> Column:
        """``digits`` digits as a whole number, and the exponent of the first one."""
        short = F.format_string(f"%.{digits - 1}e", size)
        exact = let(exponent_of(F.format_string("%.17e", size)), lambda exponent: F.struct(
            _significant_digits(size, exponent, digits).alias("digits"),
            exponent.alias("exponent")))
        rough = F.struct(
            F.regexp_replace(F.element_at(F.split(short, "e"), 1), r"\.", "").cast("bigint")
            .alias("digits"), exponent_of(short).alias("exponent"))
        return F.when((size >= F.lit(1e-10)) & (size < F.lit(2.0 ** 62)), exact).otherwise(rough)

    def carried(found: Column) -> Column:
        over = found["digits"] >= F.lit(10 ** digits)
        return F.struct(
            F.rtrim(F.when(over, F.lit("1")).otherwise(found["digits"].cast("string")), F.lit("0"))
            .alias("kept"), (found["exponent"] + over.cast("int")).alias("exponent"))

    def joined(head: Column, tail: Column) -> Column:
        return F.when(tail == "", head).otherwise(F.concat(head, F.lit("."), tail))

    def shown(found: Column) -> Column:
        kept, exponent = found["kept"], found["exponent"]
        scientific = F.concat(
            joined(F.substring(kept, 1, 1), F.substring(kept, F.lit(2), F.lit(digits))),
            F.format_string("e%s%02d", F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
                            F.abs(exponent)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), kept)
        head = F.rpad(F.substring(kept, F.lit(1), exponent + 1), exponent + 1, F.lit("0"))
        plain = joined(head, F.substring(kept, exponent + 2, F.lit(digits)))
        return (F.when((exponent < -4) | (exponent >= digits), scientific)
                .when(exponent < 0, small).otherwise(plain))

    size = F.abs(value)
    finite = (size > 0.0) & (size < F.lit(float("inf")))
    text = let(let(let(F.when(finite, size).otherwise(F.lit(1.0)), parts), carried), shown)
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    return (F.when(value.isNull(), F.lit(""))
            .when(F.isnan(value), F.lit("NaN"))
            .when(size == F.lit(float("inf")), F.concat(sign, F.lit("Infinity")))
            .when(size == 0.0, F.lit("0")).otherwise(F.concat(sign, text)))


def canonical_string(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))
