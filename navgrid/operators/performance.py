"""Base 100, returns and summaries over panels."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from navgrid.functions import base100_to_return
from navgrid.operators.panel import common_dates, scalar, series_window


def rebase100(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every series as 100 at its first value; a series without values stays null."""
    first = F.first("valor", ignorenulls=True).over(
        series_window(by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return panel.withColumn("valor", F.try_divide(F.col("valor"), first) * 100.0)


def cumulative_return(perf: DataFrame) -> DataFrame:
    """Base 100 to decimal return."""
    return perf.withColumn("valor", base100_to_return("valor"))


def returns(panel: DataFrame, by: Sequence[str] = (), *, common: bool = True) -> DataFrame:
    """Simple return against the previous date of the panel, first date dropped.

    On a common-date panel (the default) every series has every date. Otherwise a series without a quote on the
    panel's previous date has no return there, and only dates with all returns are kept.
    """
    order = series_window(by)
    moved = panel.withColumn("_antes", F.lag("valor").over(order)).withColumn(
        "retorno", F.try_divide(F.col("valor"), F.col("_antes")) - 1.0)
    if common:
        return moved.where(F.col("_antes").isNotNull()).select(*by, "serie", "data", "retorno")
    dates = Window.partitionBy(*by).orderBy("data")
    calendar = panel.select(*by, "data").distinct().withColumn("_ontem", F.lag("data").over(dates))
    if not by:
        calendar = F.broadcast(calendar)  # one row per calendar date
    size = panel.groupBy(*by).agg(F.countDistinct("serie").alias("_series"))
    kept = (moved.withColumn("_data_antes", F.lag("data").over(order)).join(calendar, [*by, "data"])
            .where((F.col("_data_antes") == F.col("_ontem")) & F.col("retorno").isNotNull())
            .select(*by, "serie", "data", F.col("retorno").alias("valor")))
    if by:
        full = (kept.groupBy(*by, "data").agg(F.count("valor").alias("_n")).join(size, list(by))
                .where("_n = _series").select(*by, "data"))
        kept = kept.join(full, [*by, "data"], "left_semi")
    else:
        kept = common_dates(kept, scalar(size, "_series"))
    return kept.withColumnRenamed("valor", "retorno")


def performance_summary(perf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Effective first and last date and total return of each base-100 series, best first."""
    return (perf.where(F.col("valor").isNotNull()).groupBy(*by, "serie")
            .agg(F.min("data").alias("inicio_efetivo"), F.max("data").alias("fim_efetivo"),
                 base100_to_return(F.max_by("valor", "data")).alias("rentabilidade"))
            .orderBy(F.desc("rentabilidade"), "serie"))


def window_metrics(panel: DataFrame) -> DataFrame:
    """First date of any series, last date and number of series."""
    return (panel.where(F.col("valor").isNotNull())
            .agg(F.min("data").alias("primeira_data"), F.max("data").alias("fim_efetivo"),
                 F.countDistinct("serie").alias("series")))
