import math

import pytest
from pyspark.sql import functions as F

from driftline.functions.rounding import canonical_number, stable_round
from driftline.functions.rules import csv_safe_id


@pytest.mark.parametrize("value,want", [
    (1e13, 1e13), (4.6e18, 4.6e18), (-4.6e18, -4.6e18), (9.3e12 + 0.5, 9.3e12 + 0.5),
    (math.inf, math.inf), (-math.inf, -math.inf), (-0.0, 0.0), (1.0000004992, 1.0),
    (1.0000005, 1.000001), (1.0000004999999999, 1.000001), (-2.5, -2.5), (0.1234565, 0.123457)])
def test_values_keep_their_size(spark, value, want):
    got = spark.range(1).select(stable_round(F.lit(value))).first()[0]
    assert got == want and math.copysign(1, got) == math.copysign(1, want)


def test_nan_stays_visible_and_null_stays_null(spark):
    row = spark.range(1).select(stable_round(F.lit(math.nan)).alias("n"), stable_round(
        F.lit(None).cast("double")).alias("z"), canonical_number(F.lit(2.5)).alias("t")).first()
    assert math.isnan(row.n) and row.z is None and row.t == "2.5"


@pytest.mark.parametrize("text,safe", [("abc", True), ("abc\n", False), ("a,b", False),
                                       ("", False), (None, False), ("a\rb", False)])
def test_safe_ids(spark, text, safe):
    assert spark.range(1).select(csv_safe_id(F.lit(text).cast("string"))).first()[0] is safe


def test_twelve_significant_digits_as_c_writes_them(spark):
    import random
    import struct

    from driftline.functions.rounding import canonical_significant

    draw = random.Random(4)
    values = [0.0, -0.0, 1.0, -1.5, 0.1, 1e-4, 9.9999999999995e-5, 99999999999.95, 999999999999.5,
              1e11, 1e12, 123456789012.5, 1234567890123.5, 1.000000000005, 1.0000000000055, 0.5,
              2.0 ** 53, 2.0 ** 61, 1e22, 1e23, 5e-324, 1.7976931348623157e308, 1e-10, 3e-11, 1 / 3]
    # ties of 13 digits: only the exact value of the double tells which way they go
    values += [float(f"{draw.randrange(10 ** 11, 10 ** 12)}5e{draw.randint(-21, 5)}")
               for _ in range(3000)]
    values += [draw.uniform(-1, 1) * 10 ** draw.randint(-12, 20) for _ in range(3000)]
    values += [draw.randrange(1, 10 ** 6) / 2 ** draw.randint(0, 30) for _ in range(1000)]
    values += [struct.unpack("d", struct.pack("Q", draw.getrandbits(62)))[0] for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.t for r in df.select("i", canonical_significant(df.v).alias("t")).collect()}
    wrong = [(v, got[i], format(v + 0.0, ".12g")) for i, v in enumerate(values)
             if got[i] != format(v + 0.0, ".12g") and (v == 0 or 1e-10 <= abs(v) < 2 ** 62)]
    assert wrong == []
    beyond = [v for i, v in enumerate(values) if got[i] != format(v + 0.0, ".12g")]
    assert all(len(format(v, ".17g")) > 12 for v in beyond) and len(beyond) <= 3
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-float("inf"),)], "v double")
    assert [r.t for r in odd.select(canonical_significant(odd.v).alias("t")).collect()] == [
        "", "NaN", "Infinity", "-Infinity"]
