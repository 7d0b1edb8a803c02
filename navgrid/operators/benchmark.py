"""Benchmark series: cleaning, compounding, request windows and alignment with a panel."""

from pyspark.sql import DataFrame, Window, functions as F

from navgrid.functions import positive, rate_factor, to_double, utc_day
from navgrid.operators.panel import series_window
from navgrid.schema import SOURCE_WINDOW_YEARS

def clean_series(df: DataFrame, *, value: str, when: str, seq: str, name: str) -> DataFrame:
    """(serie, data, valor): numbers only, UTC days, the last observation in input order per day.

    The reduction per day is an aggregate with partial results before the shuffle, so a day may hold any
    number of observations.
    """
    types = dict(df.dtypes)
    number = to_double(value) if types[value] == "string" else F.col(value).cast("double")
    stamp = F.col(when).try_cast("timestamp") if types[when] == "string" else F.col(when)
    return (df.select(utc_day(stamp).alias("data"), number.alias("valor"), F.col(seq).alias("_seq"))
            .where(F.col("data").isNotNull() & F.col("valor").isNotNull() & ~F.isnan("valor"))
            .groupBy("data").agg(F.max_by("valor", "_seq").alias("valor"))
            .select(F.lit(name).alias("serie"), "data", "valor"))


def compound_rates(series: DataFrame) -> DataFrame:
    """Percent rates to base 100; the rate of the first day drops out."""
    growth = F.product("_fator").over(series_window().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (series.withColumn("_fator", rate_factor("valor")).withColumn("_acumulado", growth)
            .withColumn("valor", F.col("_acumulado") / F.first("_acumulado").over(series_window()) * 100.0)
            .select("serie", "data", "valor"))


def compound_closes(series: DataFrame) -> DataFrame:
    """Closes to base 100: the chained variations between positive closes telescope to close / first close."""
    return (series.where(positive("valor"))
            .withColumn("valor", F.col("valor") / F.first("valor").over(series_window()) * 100.0)
            .select("serie", "data", "valor"))


def daily_variation(series: DataFrame) -> DataFrame:
    """Variation between consecutive positive closes, 0 on the first day."""
    previous = F.lag("valor").over(series_window())
    return (series.where(positive("valor"))
            .withColumn("valor", F.coalesce(F.col("valor") / previous - 1.0, F.lit(0.0)))
            .select("serie", "data", "valor"))


def date_windows(ranges: DataFrame, years: int = SOURCE_WINDOW_YEARS) -> DataFrame:
    """Contiguous request windows of ``years`` less one day covering each [inicio, fim]; inicio > fim is an error.

    Windows chain from the previous start, so after a 29 February start they stay on 28 February.
    """
    backwards = F.raise_error(F.lit("The first date must not be after the last."))
    first = F.when(F.col("inicio") > F.col("fim"), backwards).otherwise(F.col("inicio"))
    most = F.floor(F.date_diff("fim", "inicio") / F.lit(365 * years)) + 1
    chain = F.aggregate(F.sequence(F.lit(1), most.cast("int")), F.array(first), lambda found, _: F.array_append(
        found, F.add_months(F.element_at(found, -1), 12 * years)))
    return (ranges.withColumn("_inicios", F.filter(chain, lambda day: day <= F.col("fim")))
            .select("*", F.posexplode("_inicios").alias("janela", "de"))
            .withColumn("_prox", F.try_element_at("_inicios", F.col("janela") + 2))
            .withColumn("ate", F.coalesce(F.date_sub("_prox", 1), F.col("fim")))
            .drop("_inicios", "_prox"))


def with_benchmark(perf: DataFrame, bench: DataFrame | None, message: str | None = None):
    """Panel and benchmark as one long frame, no forward fill. Without a benchmark the panel is unchanged."""
    if bench is None:
        return perf, message
    return perf.select("serie", "data", "valor").unionByName(bench.select("serie", "data", "valor")), message


def align_on_date(wide: DataFrame, bench: DataFrame, name: str) -> DataFrame:
    """Wide form of the same alignment: full outer on the date. Both sides hold one row per date."""
    return wide.join(bench.select("data", F.col("valor").alias(name)), "data", "full_outer")
