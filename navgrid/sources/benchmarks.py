"""Benchmark tables: rate series, close series and the choice between them."""

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from navgrid.operators.benchmark import clean_series, compound_closes, compound_rates
from navgrid.schema import BENCHMARKS, CLOSES_BENCHMARK, NO_BENCHMARK, PANEL, RATES_BENCHMARK
from navgrid.session import materialise


class BenchmarkError(RuntimeError):
    """A benchmark table without usable rows or without the expected column."""


def check_range(start: date, end: date) -> None:
    if start > end:
        raise ValueError("The first date of the benchmark must not be after the last.")


def in_range(df: DataFrame, when: str, start: date, end: date) -> DataFrame:
    """Rows of the inclusive day range, written as a half-open comparison that reaches the file scan."""
    stamp = F.col(when).try_cast("timestamp") if dict(df.dtypes)[when] == "string" else F.col(when)
    return df.where((stamp >= F.lit(start)) & (stamp < F.date_add(F.lit(end), 1)))


def close_column(columns: Sequence[str], ticker: str = BENCHMARKS[CLOSES_BENCHMARK][2]) -> str:
    """Name of the close column. Two-level headers are flattened as ``Close|ticker``."""
    two_level = [c for c in columns if "|" in c]
    if two_level:
        exact = f"Close|{ticker}"
        for c in [exact] if exact in two_level else two_level:
            if c.split("|")[0] == "Close":
                return c
    elif "Close" in columns:
        return "Close"
    raise BenchmarkError("The close table has no 'Close' column.")


def read_rates(df: DataFrame, start: date, end: date, *, value: str = "valor", when: str = "data",
               seq: str = "seq") -> DataFrame:
    """Daily percent rates of the range as (serie, data, valor)."""
    check_range(start, end)
    name = BENCHMARKS[RATES_BENCHMARK][0]
    return clean_series(in_range(df, when, start, end), value=value, when=when, seq=seq, name=name)


def read_closes(df: DataFrame, start: date, end: date, *, when: str = "data", seq: str = "seq") -> DataFrame:
    """Daily closes of the range, end included, as (serie, data, valor)."""
    check_range(start, end)
    column = close_column(df.columns)
    rows = in_range(df, when, start, end).select(when, seq, F.col(f"`{column}`").alias("_close"))
    return clean_series(rows, value="_close", when=when, seq=seq, name=BENCHMARKS[CLOSES_BENCHMARK][0])


def load_benchmark(spark: SparkSession, choice: str, tables: dict[str, Callable[[], DataFrame]], start: date,
                   end: date) -> DataFrame | None:
    """Base-100 series of the chosen benchmark; the choice of none gives an empty frame.

    The reduced series (one row per day) is written once, so a table is scanned once. Whatever goes wrong while a
    table is read becomes a BenchmarkError.
    """
    if choice == NO_BENCHMARK:
        return spark.createDataFrame([], PANEL)
    if choice not in BENCHMARKS:
        raise ValueError(f"Unknown benchmark: {choice}")
    check_range(start, end)
    if choice not in tables:
        raise BenchmarkError(f"No table for {BENCHMARKS[choice][0]}.")
    try:
        series = materialise((read_rates if choice == RATES_BENCHMARK else read_closes)(tables[choice](), start, end))
    except (PySparkException, OSError, KeyError) as problem:
        raise BenchmarkError(f"{BENCHMARKS[choice][0]} cannot be read: {problem}") from problem
    lowest, days, positive_days = series.agg(F.min("valor"), F.count("valor"), F.count_if(F.col("valor") > 0)).first()
    if not days:
        raise BenchmarkError(f"No valid observations for {BENCHMARKS[choice][0]}.")
    if choice == RATES_BENCHMARK:
        if lowest <= -100:
            raise BenchmarkError(f"{BENCHMARKS[choice][0]} has a daily rate of -100% or less.")
        return compound_rates(series)
    if not positive_days:
        raise BenchmarkError(f"{BENCHMARKS[choice][0]} has no positive closes.")
    return compound_closes(series)


def try_benchmark(spark: SparkSession, choice: str, tables: dict[str, Callable[[], DataFrame]], start: date,
                  end: date) -> tuple[DataFrame | None, str | None]:
    """Benchmark or a message: a failing benchmark must not take the funds down with it."""
    if choice == NO_BENCHMARK:
        return None, None
    try:
        return load_benchmark(spark, choice, tables, start, end), None
    except (BenchmarkError, ValueError) as problem:
        return None, str(problem)
