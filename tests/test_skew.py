"""One key holding most rows: results stay whole, and hot rows are reduced before they are shuffled."""

import pytest
from conftest import values
from pyspark.sql import functions as F

from navgrid.operators import benchmark as B, coverage as C, tables as K


@pytest.fixture(scope="module")
def hot(spark):
    """60,000 rows, 90 % of them under one key."""
    return spark.range(60_000, numPartitions=8).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 97).otherwise(-1).cast("string").alias("cnpj"),
        F.expr("date_add(date'2020-01-01', cast(id % 30 as int))").alias("data"),
        (F.col("id") % 1000).cast("double").alias("valor"), F.col("id").alias("linha"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keep_last_reduces_before_the_shuffle(hot):
    df = K.keep_last(hot, ["cnpj"], ["linha"])
    text = plan(df)
    assert "partial_max_by" in text and "Window" not in text
    got = {r["cnpj"]: r["linha"] for r in df.collect()}
    assert got["-1"] == 59_999 and len(got) == 98


def test_upsert_over_a_hot_key(hot):
    half = hot.where("linha < 30000")
    got = K.upsert(K.keep_last(half, ["cnpj", "data"], ["linha"]), hot, ["cnpj", "data"], ["linha"])
    want = {(r["cnpj"], str(r["data"])): r["m"] for r in hot.groupBy("cnpj", "data").agg(F.max("linha").alias("m")).collect()}
    assert {v[:2]: v[2] for v in values(got, "cnpj", "data", "linha")} == want


def test_coverage_aggregates_before_the_join(spark, hot):
    register = hot.select("cnpj").distinct().withColumn("nome", F.col("cnpj"))
    cov = C.coverage(register, hot)
    text = plan(cov)
    assert "partial_count" in text
    assert sum(r["quantidade_registros"] for r in cov.collect()) == 60_000


def test_clean_series_reduces_a_crowded_day(hot):
    df = B.clean_series(hot.withColumn("data", F.lit("2020-01-01")), value="valor", when="data", seq="linha", name="s")
    assert "partial_max_by" in plan(df) and values(df) == [("s", "2020-01-01", 999.0)]
