"""Weights, buy-and-hold history, static risk and return. Weights are (carteira, serie, peso) rows.

Any number of portfolios is computed at once; with ``by=()`` the frames describe a single one.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from navgrid.operators.panel import attach, series_window
from navgrid.operators.report import refuse
from navgrid.schema import TRADING_DAYS, WEIGHT_EPSILON
from navgrid.session import materialise

PORTFOLIO = ("carteira",)


def equal_weights(members: DataFrame, by: Sequence[str] = PORTFOLIO) -> DataFrame:
    """Default allocation in percent: 100/n with two decimals."""
    sizes = members.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return attach(members, sizes, by, "_n").select(
        *by, "serie", F.bround(100.0 / F.col("_n"), 2).alias("percentual"))


def normalise_weights(percentages: DataFrame, by: Sequence[str] = PORTFOLIO) -> DataFrame:
    """Percentages to weights. A total away from 100 by more than 0.01 + 0.001 fails the job."""
    totals = percentages.groupBy(*by).agg(F.sum("percentual").alias("total"))
    wrong = F.raise_error(F.lit("The allocations must total 100%."))
    return attach(percentages, totals, by, "total").select(
        *by, "serie",
        F.when(F.abs(F.col("total") - 100.0) > 0.011, wrong)
        .otherwise(F.col("percentual") / F.col("total")).alias("peso"))


def weight_problems(weights: DataFrame, members: DataFrame, by: Sequence[str] = PORTFOLIO) -> DataFrame:
    """Portfolios whose weights are incomplete, negative or do not total 1 (default float closeness)."""
    joined = members.select(*by, "serie").join(weights, [*by, "serie"], "left")
    checks = joined.groupBy(*by).agg(
        F.sum("peso").alias("soma"),
        F.count_if(F.col("peso").isNull()).alias("faltantes"),
        F.count_if(F.col("peso") < 0).alias("negativos"))
    return checks.where((F.col("faltantes") > 0) | (F.col("negativos") > 0)
                        | F.col("soma").isNull() | (F.abs(F.col("soma") - 1.0) > 1e-5 + 1e-8))


def check_weights(weights: DataFrame, members: DataFrame, by: Sequence[str] = PORTFOLIO) -> DataFrame:
    """The weights, or an error with the faulty portfolios: the first by name, and the table of all."""
    entry = F.to_json(F.struct(*by, "soma", "faltantes", "negativos"))
    refuse(weight_problems(weights, members, by), "{n} portfolio(s) with missing or negative weights or another total than 1",
           entry, [*by, "faltantes"])
    return weights


def holdings(panel: DataFrame, weights: DataFrame, by: Sequence[str] = PORTFOLIO, *,
             shared: bool = False) -> DataFrame:
    """Value of every holding per date: units bought with the weight at the first price.

    ``shared`` says that all portfolios use one common panel (it has no ``by`` columns); otherwise the panel
    carries its own ``by`` columns.
    """
    own = () if shared else tuple(by)
    first = F.first("valor").over(series_window(own))
    priced = panel.withColumn("_relativo", F.col("valor") / first)
    return (priced.join(weights, [*own, "serie"])
            .select(*by, "serie", "data", (F.col("peso") * F.col("_relativo")).alias("posicao")))


def buy_and_hold(panel: DataFrame, weights: DataFrame, by: Sequence[str] = PORTFOLIO, *,
                 shared: bool = False) -> tuple[DataFrame, DataFrame]:
    """Base-100 history and drifting weights of portfolios that never rebalance. The holdings are computed once."""
    held = materialise(holdings(panel, weights, by, shared=shared))
    totals = portfolio_totals(held, by)
    start = F.first("total").over(Window.partitionBy(*by).orderBy("data"))  # one row per date
    history = totals.select(*by, "data", (F.col("total") / start * 100.0).alias("valor"))
    return history, drifting_weights(held, totals, by)


def portfolio_totals(held: DataFrame, by: Sequence[str] = PORTFOLIO) -> DataFrame:
    """Value of each portfolio per date."""
    return held.groupBy(*by, "data").agg(F.sum("posicao").alias("total"))


def drifting_weights(held: DataFrame, totals: DataFrame, by: Sequence[str] = PORTFOLIO) -> DataFrame:
    """Share of each holding in its portfolio's value of the date."""
    if not by:
        totals = F.broadcast(totals)  # one row per calendar date
    return (held.join(totals, [*by, "data"])
            .select(*by, "serie", "data", (F.col("posicao") / F.col("total")).alias("peso")))


def final_allocation(shares: DataFrame, by: Sequence[str] = PORTFOLIO) -> DataFrame:
    """Weight of every holding on the last date."""
    return shares.groupBy(*by, "serie").agg(F.max_by("peso", "data").alias("peso"))


def allocation_table(weights: DataFrame, names: DataFrame, by: Sequence[str] = PORTFOLIO,
                     least: float = WEIGHT_EPSILON) -> DataFrame:
    """Named weights above the display threshold, largest first."""
    lookup = names.select(F.col("cnpj").alias("serie"), "nome")
    return (weights.where(F.col("peso") > least).join(lookup, "serie", "left")
            .select(*by, F.coalesce("nome", "serie").alias("fundo"), F.col("peso").alias("alocacao"))
            .orderBy(*by, F.desc("alocacao"), "fundo"))


def static_risk_return(returns: DataFrame, weights: DataFrame, by: Sequence[str] = PORTFOLIO, *,
                       shared: bool = False) -> DataFrame:
    """Annualised return and risk at constant weights.

    The variance of the weighted return series equals the quadratic form with the covariance matrix, so no
    pair of funds is ever formed: one pass over returns x weights.
    """
    own = () if shared else tuple(by)
    daily = (returns.join(weights, [*own, "serie"]).groupBy(*by, "data")
             .agg(F.sum(F.col("peso") * F.col("retorno")).alias("_r")))
    return daily.groupBy(*by).agg(
        (F.avg("_r") * TRADING_DAYS).alias("retorno"),
        F.sqrt(F.greatest(F.var_samp("_r") * TRADING_DAYS, F.lit(0.0))).alias("risco"))
