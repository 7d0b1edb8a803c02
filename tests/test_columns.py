import math

from pyspark.sql import functions as F

from navgrid import functions as N


def apply(spark, make, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, c {kind}")
    return [r["o"] for r in df.select("i", make(F.col("c")).alias("o")).orderBy("i").collect()]


def test_identifier(spark):
    got = apply(spark, N.normalise_id, ["12.345.678/0001-95", "1234567890123", "123456789012345", "abc", "", None, "7"])
    assert got == ["12345678000195", "01234567890123", None, None, None, None, "00000000000007"]


def test_trim_covers_all_blanks(spark):
    assert apply(spark, N.trim_all, ["\t  a b  \n", "\x1cx\x1f", "  ", None]) == ["a b", "x", "", None]


def test_subclass_default(spark):
    assert apply(spark, N.subclass_or_blank, [None, "  ", "\tA "]) == ["", "", "A"]


def test_numbers(spark):
    texts = [" 1.5 ", "1e3", ".5", "5.", "+2", "inf", "1d", "0x1p3", "1,5", "nan", "", "1 2", "1_000", None]
    assert apply(spark, N.to_double, texts) == [1.5, 1000.0, 0.5, 5.0, 2.0, math.inf] + [None] * 8


def test_dates(spark):
    texts = ["2024-02-29", "2023-02-29", "05/01/2024", "2024", "2024-1-5", "", None]
    assert [str(d) if d else None for d in apply(spark, N.to_day, texts)] == ["2024-02-29"] + [None] * 6
    got = apply(spark, N.parse_day_first, ["29/02/2024", "30/02/2024", "1/2/2024", "2024-01-01"])
    assert [str(d) if d else None for d in got] == ["2024-02-29", None, None, None]


def test_positive_drops_nan_and_keeps_infinity(spark):
    got = apply(spark, N.positive, [float("nan"), math.inf, 0.0, -1.0, 1e-9], "double")
    assert got == [False, True, False, False, True]


def test_period(spark):
    texts = ["2024-01", "1999-12", "2024-13", "2024-00", "2024-1", "2024-01-01", "2024-01\n", None]
    assert apply(spark, N.valid_period, texts) == [True] + [False] * 7


def test_shorten_and_label(spark):
    got = apply(spark, lambda c: N.shorten(c, 5), ["abcde", "abcdef", "ação plena"])
    assert got == ["abcde", "abcd…", "ação…"]
    df = spark.createDataFrame([("Fundo", "1")], "n string, k string").select(N.label("n", "k").alias("o"))
    assert df.first()["o"] == "Fundo  ·  1"


def test_overlap_bounds_are_optional(spark):
    df = spark.createDataFrame([("2020-01", "2020-12"), ("2021-03", "2021-03")], "a string, b string")
    count = lambda *bounds: df.where(N.overlaps("a", "b", *bounds)).count()
    assert (count(None, None), count("2020-12", None), count("2021-01", None), count(None, "2020-06"),
            count("2020-05", "2021-02")) == (2, 2, 1, 1, 1)
