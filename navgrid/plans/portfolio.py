"""Portfolio simulation and efficient frontier of a fund selection (the second analysis of the application)."""

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from navgrid.operators.benchmark import with_benchmark
from navgrid.operators.frontier import (
    candidate_weights, corner, efficient_flag, score,
)
from navgrid.operators.optimise import frontier, min_variance
from navgrid.operators.performance import cumulative_return, performance_summary, returns
from navgrid.operators.portfolio import (
    allocation_table, buy_and_hold, check_weights, final_allocation, normalise_weights, static_risk_return,
)
from navgrid.operators.risk import annual_cov, annual_mean, fund_points, require_feasible
from navgrid.plans.performance import window_panel
from navgrid.schema import CANDIDATES, FRONTIER_POINTS, MIN_ALLOCATION, NO_BENCHMARK, SEED
from navgrid.session import materialise
from navgrid.sources.benchmarks import try_benchmark

OWN = "Carteira"


@dataclass
class PortfolioHistory:
    base100: DataFrame        # one row per date
    curve: DataFrame          # the same as cumulative return
    shares: DataFrame         # drifting weights per date
    final: DataFrame          # weights on the last date


@dataclass
class PortfolioPage:
    history: PortfolioHistory
    curves: DataFrame         # cumulative return of the portfolio and its benchmark
    summary: DataFrame        # effective dates and total return of both
    allocation: DataFrame     # weights on the last date with the funds' names, largest first
    own_point: DataFrame      # one row: annual return and risk at the initial weights
    panel: DataFrame          # common-date panel, input of efficient_frontier
    benchmark_message: str | None


@dataclass
class FrontierResult:
    points: DataFrame         # minimum-variance curve with the efficient branch marked
    candidates: DataFrame     # scored random allocations
    min_risk_weights: DataFrame
    max_return_weights: DataFrame
    min_risk: DataFrame       # one row: annual return and risk
    max_return: DataFrame     # one row: annual return and risk
    funds: DataFrame          # annual return and risk per fund
    min_risk_table: DataFrame | None = None      # named allocations, with a register
    max_return_table: DataFrame | None = None
    own_point: DataFrame | None = None           # annual return and risk of the given percentages


def simulate(panel: DataFrame, percentages: DataFrame) -> PortfolioHistory:
    """Buy once with the given percentages and never rebalance."""
    weights = normalise_weights(percentages, by=())
    check_weights(weights, panel.select("serie").distinct(), by=())
    history, shares = buy_and_hold(panel, weights, by=())
    named = history.select(F.lit(OWN).alias("serie"), "data", "valor")
    return PortfolioHistory(named, cumulative_return(named), shares, final_allocation(shares, by=()))


def portfolio_page(quotes: DataFrame, register: DataFrame, percentages: DataFrame, start: date, end: date,
                   benchmark: str = NO_BENCHMARK, tables: dict[str, Callable[[], DataFrame]] | None = None) -> PortfolioPage:
    """The whole analysis of one portfolio: (serie, percentual) bought at the first common date of the window.

    A missing fund, a window with fewer than two common dates and wrong percentages are errors; a failing benchmark is a
    message. The list of funds is a selection and small; everything by date stays in Spark.
    """
    funds = [r["serie"] for r in percentages.select("serie").orderBy("serie").collect()]
    panel = window_panel(quotes, funds, start, end)
    history = simulate(panel, percentages)
    base100 = materialise(history.base100)
    ends = base100.agg(F.min("data").alias("de"), F.max("data").alias("ate")).first()
    bench, message = try_benchmark(quotes.sparkSession, benchmark, tables or {}, ends["de"], ends["ate"])
    shown, message = with_benchmark(base100, bench, message)
    own = static_risk_return(returns(panel), normalise_weights(percentages, by=()), by=())
    return PortfolioPage(history, cumulative_return(shown), performance_summary(shown),
                         allocation_table(history.final, register, by=()), own, panel, message)


def efficient_frontier(spark: SparkSession, panel: DataFrame, funds: Sequence[str], points: int = FRONTIER_POINTS,
                       candidates: int = CANDIDATES, floor: float = MIN_ALLOCATION, seed: int = SEED,
                       register: DataFrame | None = None, percentages: DataFrame | None = None) -> FrontierResult:
    """Curve, corners, candidates and fund points of a common-date panel.

    With a register the corner portfolios also come as named tables, with percentages the own portfolio as a point.
    """
    rets = materialise(returns(panel))
    require_feasible(rets, floor)
    order = F.array_position(F.array(*[F.lit(f) for f in funds]), F.col("serie"))
    mean = annual_mean(rets).withColumn("posicao", order)
    lowest, highest = materialise(min_variance(rets, floor)), corner(mean, floor, "high")
    drawn = candidate_weights(spark, funds, candidates, floor, seed)
    tables = {}
    if register is not None:
        tables |= {"min_risk_table": allocation_table(lowest, register, by=()), "max_return_table": allocation_table(highest, register, by=())}
    if percentages is not None:
        tables["own_point"] = static_risk_return(rets, normalise_weights(percentages, by=()), by=())
    return FrontierResult(
        points=efficient_flag(frontier(rets, points, floor)),
        candidates=score(drawn, mean, annual_cov(rets), funds),
        min_risk_weights=lowest, max_return_weights=highest,
        min_risk=static_risk_return(rets, lowest, by=()),
        max_return=static_risk_return(rets, highest, by=()),
        funds=fund_points(rets), **tables)
