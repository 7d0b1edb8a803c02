"""Performance of a fund selection, with an optional benchmark (the first analysis of the application)."""

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, functions as F

from navgrid.operators.benchmark import with_benchmark
from navgrid.operators.panel import enough_dates, load_panel, missing_series, with_names
from navgrid.operators.performance import cumulative_return, performance_summary, rebase100, window_metrics
from navgrid.schema import NO_BENCHMARK
from navgrid.session import materialise
from navgrid.sources.benchmarks import try_benchmark


@dataclass
class Performance:
    curves: DataFrame         # cumulative return per series (with nome) and date, benchmark included
    summary: DataFrame        # effective start and total return per series (with nome), best first
    metrics: DataFrame        # first date, last date, number of series
    benchmark_message: str | None


def fund_performance(quotes: DataFrame, register: DataFrame, funds: Sequence[str], start: date, end: date,
                     benchmark: str = NO_BENCHMARK,
                     tables: dict[str, Callable[[], DataFrame]] | None = None) -> Performance:
    """Base-100 performance; two or more funds are compared on their common dates only.

    The benchmark is asked for the panel's own first to last date and rebased on its own first day. A series is told
    apart by its key; ``nome`` is a label and may occur twice.
    """
    panel = window_panel(quotes, funds, start, end)
    metrics = window_metrics(panel)
    first = metrics.first()
    bench, message = try_benchmark(quotes.sparkSession, benchmark, tables or {}, first["primeira_data"], first["fim_efetivo"])
    shown, message = with_benchmark(rebase100(panel), bench, message)
    summary = with_names(performance_summary(shown), register).orderBy(F.desc("rentabilidade"), "serie")
    return Performance(with_names(cumulative_return(shown), register), summary, metrics, message)


def window_panel(quotes: DataFrame, funds: Sequence[str], start: date, end: date) -> DataFrame:
    """Panel of the funds in the window, written once; an error when the window or the data do not allow an analysis."""
    check_window(start, end)
    panel = materialise(load_panel(quotes, funds, start, end, common=len(set(funds)) > 1))
    wanted = quotes.sparkSession.createDataFrame([(f,) for f in funds], "serie string")
    absent = [r["serie"] for r in missing_series(panel, wanted).orderBy("serie").collect()]
    if absent:
        raise ValueError("No common data in the window for: " + ", ".join(absent))
    if not enough_dates(panel).first()["suficiente"]:
        raise ValueError("The window has too few observations.")
    return panel


def check_window(start: date, end: date) -> None:
    """Same rule as functions.window_is_open, for single values."""
    if not start < end:
        raise ValueError("The first date must lie before the last.")
