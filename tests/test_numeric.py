import math
import random

from signalmill.functions.numeric import fixed_sql, half_even, scaled_round_sql, to_float_sql


def test_half_even_equals_decimal_rounding_of_the_binary_value(spark):
    rng = random.Random(7)
    values = [rng.choice([1, -1]) * round(rng.random() * 10 ** rng.randint(0, 6), rng.randint(0, 6)) for _ in range(4000)]
    values += [1278.55, 1.005, 0.285, 2.675, 0.07455, 0.5, 1.5, 2.5, -2.5, -0.5, 1e300, 4503599627370497.0, 0.0]
    values += [k + 0.5 for k in range(100)] + [k / 8 for k in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 4, 8):
        for row in df.select("v", half_even("v", digits).alias("r")).collect():
            assert row.r == round(row.v, digits), (row.v, digits)


def test_half_even_keeps_nan_null_and_infinity(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),)], "v double")
    nan, null, inf = [r[0] for r in df.select(half_even("v", 2)).collect()]
    assert math.isnan(nan) and null is None and inf == float("inf")


def test_column_rounding_uses_the_scaled_product(spark):
    row = spark.sql(f"SELECT {scaled_round_sql('v', 1)} AS r FROM VALUES (1278.55D) t(v)").first()
    assert row.r == 1278.6 and round(1278.55, 1) == 1278.5


def test_text_of_numbers(spark):
    row = spark.sql(f"SELECT {fixed_sql('a', 1)} AS a, {fixed_sql('a', 0)} AS b FROM VALUES (0.25D) t(a)").first()
    assert (row.a, row.b) == (f"{0.25:.1f}", f"{0.25:.0f}")


def test_to_float(spark):
    texts = ["69.50", " 7 ", "1e3", "nan", "1d", "1f", "n/a", "", None, "inf"]
    df = spark.createDataFrame([(t,) for t in texts], "v string").selectExpr(f"{to_float_sql('v')} AS r")
    got = [r.r for r in df.collect()]
    assert got[:3] == [69.5, 7.0, 1000.0] and math.isnan(got[3])
    assert got[4:9] == [None] * 5 and got[9] == float("inf")
