"""Corners, target grid, candidate allocations, empirical frontier. See optimise.py for the solver jobs."""

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from navgrid.operators.panel import attach, scalar
from navgrid.schema import CANDIDATES, FRONTIER_POINTS, MIN_ALLOCATION, SEED
from navgrid.session import discard, materialise

SCORED = 20_000  # candidates that a task scores at once
SLICE = 100_000  # distinct risks per range of the Pareto set


def corner(mean: DataFrame, floor: float = MIN_ALLOCATION, side: str = "high", by: Sequence[str] = ()) -> DataFrame:
    """Floor on every series and the remainder on the one with the highest (or lowest) mean.

    ``mean`` has (serie, posicao, media); on a tie the series requested first wins. With ``by``, portfolios that the
    floor does not fit are left out (``risk.feasibility`` names the reason); for a single one that is an error.
    """
    if not 0.0 <= floor < 1.0:
        raise ValueError("The floor must lie in [0, 1).")
    best = (F.max_by("serie", F.struct("media", -F.col("posicao"))) if side == "high"
            else F.min_by("serie", F.struct("media", "posicao")))
    pick = mean.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), best.alias("_escolhida"))
    room = 1.0 - floor * F.col("_n")
    if by:
        pick = pick.where(room > 0)
    else:
        room = F.when(room > 0, room).otherwise(F.raise_error(F.lit(f"A floor of {floor} does not fit the number of series.")))
    rest = F.when(F.col("serie") == F.col("_escolhida"), F.col("_resto")).otherwise(0.0)
    return (attach(mean, pick.withColumn("_resto", room), by, "_resto", "_escolhida")
            .select(*by, "serie", (floor + rest).alias("peso")))


def expected_return(weights: DataFrame, mean: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Annual return of each portfolio from weights and means."""
    return (weights.join(mean, [*by, "serie"]).groupBy(*by)
            .agg(F.sum(F.col("peso") * F.col("media")).alias("retorno")))


def target_grid(low: DataFrame, high: DataFrame, points: int = FRONTIER_POINTS, by: Sequence[str] = ()) -> DataFrame:
    """Evenly spaced return targets, both ends included exactly, at least three."""
    k = max(3, points)
    ends = attach(low.select(*by, F.col("retorno").alias("_lo")), high.withColumnRenamed("retorno", "_hi"), by, "_hi")
    grid = ends.withColumn("alvo_ix", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(k - 1)
    return grid.select(*by, "alvo_ix", F.when(F.col("alvo_ix") == k - 1, F.col("_hi"))
                       .otherwise(F.col("_lo") + F.col("alvo_ix") * step).alias("alvo"))


def fill_to_floor(weights: DataFrame, floor: float = MIN_ALLOCATION, by: Sequence[str] = ()) -> DataFrame:
    """Clip to [floor, 1] and rescale what lies above the floor so that the weights total 1."""
    clipped = weights.withColumn("_excesso", F.least(F.greatest("peso", F.lit(floor)), F.lit(1.0)) - floor)
    totals = clipped.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum("_excesso").alias("_soma"))
    rest = 1.0 - floor * F.col("_n")
    return attach(clipped, totals, by, "_n", "_soma").select(
        *by, "serie", F.when(F.col("_soma") <= 0, 1.0 / F.col("_n"))
        .otherwise(floor + rest * F.col("_excesso") / F.col("_soma")).alias("peso"))


def uniform(seed: int, candidate: Column, fund: Column) -> Column:
    """Number in (0, 1) from a hash of seed, candidate and fund: the same on any partitioning."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), candidate.cast("string"), fund))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)


def candidate_weights(spark: SparkSession, funds: Sequence[str], n: int | DataFrame = CANDIDATES, floor: float = MIN_ALLOCATION,
                      seed: int = SEED) -> DataFrame:
    """Uniform draws from the floored simplex: (candidata, pesos), weights in the order of ``funds``.

    ``n`` is their number or a table of their ids (candidata). One row per candidate, made in place: no join with the funds and no shuffle for any number of candidates.
    """
    if floor < 0 or floor * len(funds) >= 1.0:
        raise ValueError(f"A floor of {floor} does not fit {len(funds)} series.")
    names = F.array(*[F.lit(f) for f in funds])
    draws = F.transform(names, lambda fund: -F.log(uniform(seed, F.col("candidata"), fund)))
    room = 1.0 - floor * len(funds)
    shares = F.aggregate("_e", F.lit(0.0), lambda acc, x: acc + x,
                         lambda total: F.transform("_e", lambda e: floor + room * e / total))
    ids = n.select("candidata") if isinstance(n, DataFrame) else spark.range(n).withColumnRenamed("id", "candidata")
    return (ids.withColumn("_e", draws)
            .select("candidata", shares.alias("pesos")))


def long_weights(candidates: DataFrame, funds: Sequence[str]) -> DataFrame:
    """(candidata, serie, peso) rows from weight arrays."""
    names = F.array(*[F.lit(f) for f in funds])
    return (candidates.select("candidata", F.posexplode("pesos").alias("_i", "peso"))
            .select("candidata", F.element_at(names, F.col("_i") + 1).alias("serie"), "peso"))


def score(candidates: DataFrame, mean: DataFrame, cov: DataFrame, funds: Sequence[str], block: int = SCORED) -> DataFrame:
    """Return and risk of every candidate: (candidata, retorno, risco).

    Candidates are dealt in blocks, each block meets its own copy of the means and covariances of the listed funds (rows
    i <= j of ``risk.annual_cov``) and is scored by two matrix products. The estimates never pass the driver.
    """
    names = F.array(*[F.lit(f) for f in funds])
    place = lambda c: (F.array_position(names, F.col(c)) - 1).cast("int")
    chosen = list(funds)
    estimates = (mean.where(F.col("serie").isin(chosen)).select(place("serie").alias("i"), F.lit(-1).alias("j"), F.col("media").alias("v"))
                 .union(cov.where(F.col("serie_i").isin(chosen) & F.col("serie_j").isin(chosen))
                        .select(place("serie_i"), place("serie_j"), "cov")))
    dealt = candidates.select("candidata", "pesos", F.floor(F.col("candidata") / block).alias("bloco"))
    last = scalar(candidates.agg(F.floor(F.max("candidata") / block).alias("b")), "b")
    copies = estimates.withColumn("bloco", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(last, F.lit(0)))))
    n = len(chosen)

    def work(_, group: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if group.empty:
            return pd.DataFrame(columns=["candidata", "retorno", "risco"])
        media, sigma = np.full(n, np.nan), np.full((n, n), np.nan)
        i, j, v = (rows[c].to_numpy() for c in ("i", "j", "v"))
        media[i[j < 0]] = v[j < 0]
        i, j, v = i[j >= 0], j[j >= 0], v[j >= 0]
        sigma[i, j] = sigma[j, i] = v
        w = np.stack(group["pesos"].to_numpy())
        return pd.DataFrame({"candidata": group["candidata"], "retorno": w @ media,
                             "risco": np.sqrt(np.maximum(np.einsum("kf,kf->k", w @ sigma, w), 0.0))})

    return (dealt.groupBy("bloco").cogroup(copies.groupBy("bloco"))
            .applyInPandas(work, f"candidata {dict(candidates.dtypes)['candidata']}, retorno double, risco double"))


def lowest_risk_per_bucket(scored: DataFrame, buckets: int = FRONTIER_POINTS) -> DataFrame:
    """Candidate of lowest risk in each of ``buckets`` equal return ranges (empty ranges have no row)."""
    ends = scored.agg(F.min("retorno").alias("_lo"), F.max("retorno").alias("_hi"))
    share = F.try_divide(F.col("retorno") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    bucket = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * buckets), F.lit(buckets - 1)).cast("int")
    best = F.min_by(F.struct("candidata", "risco", "retorno"), F.struct("risco", "candidata"))
    return (attach(scored, ends, (), "_lo", "_hi").withColumn("faixa", bucket)
            .groupBy("faixa").agg(best.alias("_m")).select("faixa", "_m.*"))


def pareto_set(scored: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """Candidates that no other beats on both risk and return.

    A running maximum over all rows by risk would be one task. Instead: the best return per risk, ranges of about
    ``slice_rows`` distinct risks, the best return of each range (one row per range), and a running maximum inside each
    range that starts from the best of the ranges before it. Ties in the risk are reduced before the ranges are cut.
    """
    best = F.max_by("candidata", F.struct("retorno", -F.col("candidata")))
    points = materialise(scored.groupBy("risco").agg(F.max("retorno").alias("retorno"), best.alias("candidata")))
    ranges = max(1, math.ceil(points.count() / slice_rows))
    sliced = materialise(points.repartitionByRange(ranges, "risco").withColumn("_fatia", F.spark_partition_id()))
    discard(points)
    before = Window.orderBy("_fatia").rowsBetween(Window.unboundedPreceding, -1)
    carried = (sliced.groupBy("_fatia").agg(F.max("retorno").alias("_melhor"))
               .select("_fatia", F.max("_melhor").over(before).alias("_anterior")))
    inside = Window.partitionBy("_fatia").orderBy("risco").rowsBetween(Window.unboundedPreceding, -1)
    bar = F.greatest(F.max("retorno").over(inside), "_anterior")
    return (sliced.join(carried, "_fatia").withColumn("_barra", bar)
            .where(F.col("_barra").isNull() | (F.col("retorno") > F.col("_barra")))
            .select("candidata", "risco", "retorno"))


def efficient_flag(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mark the branch whose return is at least that of the lowest-risk point. ``points`` is evaluated once."""
    points = materialise(points)
    least = points.groupBy(*by).agg(F.min_by("retorno", F.struct("risco", -F.col("retorno"))).alias("_base"))
    return attach(points, least, by, "_base").withColumn("eficiente", F.col("retorno") >= F.col("_base")).drop("_base")
