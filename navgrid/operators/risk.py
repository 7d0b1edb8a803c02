"""Annualised means and covariances, checks before optimising."""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from navgrid.operators.panel import attach
from navgrid.schema import MIN_ALLOCATION, MIN_RETURNS, TRADING_DAYS
from navgrid.session import spread

BLOCK = 512  # series per block of the covariance product: two blocks of calendar-long vectors per task


def annual_mean(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return returns.groupBy(*by, "serie").agg((F.avg("retorno") * TRADING_DAYS).alias("media"))


def return_vectors(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per series with its returns in date order (one value per date: bounded by the calendar)."""
    pairs = F.array_sort(F.collect_list(F.struct("data", "retorno")))
    return (returns.groupBy(*by, "serie").agg(pairs.alias("_pares"))
            .select(*by, "serie", F.col("_pares.retorno").alias("retornos")))


def annual_cov(returns: DataFrame, by: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Covariance matrix as (serie_i, serie_j, cov) rows with serie_i <= serie_j, by blocks of series.

    ``mirrored`` adds the other half where a reader needs it; ask for few funds by filtering ``returns`` first.

    Panels of up to ``block`` series are one group. Wider ones are hashed into blocks; each pair of blocks is
    one group with at most two blocks of vectors, so a task never sees the whole universe and the shuffle grows
    with n * n/block vectors instead of one row per date and pair.
    """
    by = tuple(by)
    vectors = return_vectors(returns, by)
    sizes = vectors.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    blocks = sizes.select(*by, F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("_blocos"))
    if by:
        wide = blocks.where("_blocos > 1")
        placed = vectors.join(wide, list(by), "left").withColumn("_blocos", F.coalesce("_blocos", F.lit(1)))
    else:
        placed = attach(vectors, blocks, by, "_blocos")
    mine = F.pmod(F.xxhash64("serie"), F.col("_blocos")).cast("int")
    pairs = (placed.withColumn("_meu", mine)
             .withColumn("_outro", F.explode(F.sequence(F.lit(0), F.col("_blocos") - 1)))
             .select(*by, F.least("_meu", "_outro").alias("_a"), F.greatest("_meu", "_outro").alias("_b"),
                     "_meu", "serie", "retornos"))
    fields = [returns.schema[c] for c in by] + [
        T.StructField("serie_i", T.StringType()), T.StructField("serie_j", T.StringType()),
        T.StructField("cov", T.DoubleType())]
    groups = [*by, "_a", "_b"]
    return spread(pairs, *groups).groupBy(*groups).applyInPandas(_block_product(by), T.StructType(fields))


def mirrored(cov: DataFrame) -> DataFrame:
    """Both halves of a covariance table."""
    others = [c for c in cov.columns if c not in ("serie_i", "serie_j")]
    swapped = cov.where("serie_i <> serie_j").select(F.col("serie_j").alias("serie_i"), F.col("serie_i").alias("serie_j"), *others)
    return cov.unionByName(swapped)


def _block_product(by: tuple[str, ...]):
    def product(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        *panel, first, second = key
        left, right = group[group["_meu"] == first], group[group["_meu"] == second]
        if left.empty or right.empty:
            return pd.DataFrame(columns=[*by, "serie_i", "serie_j", "cov"])
        a, b = (_centred(side["retornos"]) for side in (left, right))
        cov = a @ b.T / max(a.shape[1] - 1, 1) * TRADING_DAYS
        if a.shape[1] < 2:
            cov[:] = np.nan
        out = pd.DataFrame({"serie_i": np.repeat(left["serie"].to_numpy(), len(right)),
                            "serie_j": np.tile(right["serie"].to_numpy(), len(left)), "cov": cov.ravel()})
        if first == second:
            out = out[out["serie_i"] <= out["serie_j"]]
        else:
            swap = out["serie_i"] > out["serie_j"]
            out.loc[swap, ["serie_i", "serie_j"]] = out.loc[swap, ["serie_j", "serie_i"]].to_numpy()
        for name, value in zip(by, panel):
            out[name] = value
        return out[[*by, "serie_i", "serie_j", "cov"]]
    return product


def _centred(vectors: pd.Series) -> np.ndarray:
    rows = np.stack(vectors.to_numpy()).astype(float)
    return rows - rows.mean(axis=1, keepdims=True)


def fund_points(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Annualised return and risk of each series; the diagonal needs no matrix."""
    return returns.groupBy(*by, "serie").agg(
        (F.avg("retorno") * TRADING_DAYS).alias("retorno"),
        F.sqrt(F.var_samp("retorno") * TRADING_DAYS).alias("risco"))


def bilinear(weights: DataFrame, cov: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Variance and risk from weights and rows i <= j of a covariance table, in two reductions (rows, then total)."""
    by = list(by)
    twice = F.when(F.col("serie_i") == F.col("serie_j"), F.col("cov")).otherwise(2 * F.col("cov"))
    rows = (cov.withColumn("cov", twice).join(weights.select(*by, F.col("serie").alias("serie_j"), F.col("peso").alias("_wj")),
                     [*by, "serie_j"])
            .groupBy(*by, "serie_i").agg(F.sum(F.col("cov") * F.col("_wj")).alias("_linha")))
    total = (rows.join(weights.select(*by, F.col("serie").alias("serie_i"), F.col("peso").alias("_wi")),
                       [*by, "serie_i"])
             .groupBy(*by).agg(F.sum(F.col("_linha") * F.col("_wi")).alias("variancia")))
    return total.withColumn("risco", F.sqrt(F.greatest("variancia", F.lit(0.0))))


def _not_finite(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))


def bad_estimates(mean: DataFrame, cov: DataFrame) -> DataFrame:
    """One row with the number of unusable means and covariances."""
    bad_means = mean.agg(F.count_if(_not_finite("media")).alias("medias"))
    return attach(cov.agg(F.count_if(_not_finite("cov")).alias("covariancias")), bad_means, (), "medias")


def feasibility(returns: DataFrame, by: Sequence[str] = (), floor: float = MIN_ALLOCATION,
                least: int = MIN_RETURNS) -> DataFrame:
    """Per panel: number of series and of returns, and the first rule it breaks (null when it can be optimised)."""
    per_series = returns.groupBy(*by, "serie").agg(
        F.count("retorno").alias("_n"), F.max(_not_finite("retorno")).alias("_ruim"))
    sizes = per_series.groupBy(*by).agg(
        F.count(F.lit(1)).alias("series"), F.max("_n").alias("retornos"), F.max("_ruim").alias("_ruim"))
    reason = (F.when(F.col("series") < 2, "at least two series are needed")
              .when((F.lit(floor) < 0) | (F.col("series") * floor >= 1.0), "the floor does not fit")
              .when(F.col("retornos") < least, f"at least {least} common returns are needed")
              .when(F.col("_ruim"), "the returns give no valid estimates"))
    return sizes.select(*by, "series", "retornos", reason.alias("motivo"))


def require_feasible(returns: DataFrame, floor: float = MIN_ALLOCATION, least: int = MIN_RETURNS) -> int:
    """Number of series of a single panel, or an error with the broken rule."""
    row = feasibility(returns, (), floor, least).first()
    if row["motivo"] or not row["series"]:
        raise ValueError(f"Cannot optimise: {row['motivo'] or 'at least two series are needed'} "
                         f"({row['series']} series, {row['retornos']} returns).")
    return row["series"]


