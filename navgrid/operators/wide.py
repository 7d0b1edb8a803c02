"""Candidate allocations over selections too wide for one array: weights and covariances in blocks of funds.

A fund has a block and a place in it. Candidates are rows (candidata, bloco, pesos), one per block of funds, and the
covariance is a table of dense blocks. w'Cw is summed over pairs of blocks: a task holds two slices of one block of
candidates and one block of the covariance, whatever the number of funds. No list of funds is in a plan.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from navgrid.operators.frontier import uniform
from navgrid.operators.panel import attach
from navgrid.schema import MIN_ALLOCATION, SEED
from navgrid.session import materialise

FUNDS = 1_024  # funds per block: a covariance block of 8 MB
CANDIDATES = 2_048  # candidates per block: a slice of 16 MB


def fund_blocks(funds: DataFrame, size: int = FUNDS) -> DataFrame:
    """(serie, bloco, lugar) of a table of funds (serie): blocks by hash, places by name inside a block."""
    distinct = funds.select("serie").distinct()
    counts = distinct.agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_blocos"))
    placed = attach(distinct, counts, (), "_blocos").withColumn("bloco", F.pmod(F.xxhash64("serie"), F.col("_blocos")).cast("int"))
    order = Window.partitionBy("bloco").orderBy("serie")  # about `size` rows
    return materialise(placed.select("serie", "bloco", (F.row_number().over(order) - 1).alias("lugar")))


def draw_weights(ids: DataFrame, blocks: DataFrame, floor: float = MIN_ALLOCATION, seed: int = SEED) -> DataFrame:
    """Uniform draws from the floored simplex as (candidata, bloco, pesos), equal to ``frontier.candidate_weights``.

    ``ids`` has candidata. A floor that does not fit is an error."""
    n = blocks.count()
    if floor < 0 or floor * n >= 1.0:
        raise ValueError(f"A floor of {floor} does not fit {n} series.")
    names = blocks.groupBy("bloco").agg(F.array_sort(F.collect_list(F.struct("lugar", "serie"))).alias("_f")).select("bloco", F.col("_f.serie").alias("_nomes"))
    last = blocks.agg(F.max("bloco")).first()[0]
    drawn = (ids.select("candidata", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("bloco")).join(names, "bloco")
             .select("candidata", "bloco", F.transform("_nomes", lambda fund: -F.log(uniform(seed, F.col("candidata"), fund))).alias("_e")))
    drawn = materialise(drawn)
    sums = drawn.groupBy("candidata").agg(F.sum(F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)).alias("_soma"))
    room = 1.0 - floor * n
    return drawn.join(sums, "candidata").select(
        "candidata", "bloco", F.transform("_e", lambda e: floor + room * e / F.col("_soma")).alias("pesos"))


def dense_blocks(cov: DataFrame, mean: DataFrame, blocks: DataFrame) -> DataFrame:
    """(i, j, linhas, colunas, sigma, media) per pair of blocks i <= j, from rows serie_i <= serie_j of a covariance table.

    sigma is the dense block, row by row; media the means of block i, where i = j."""
    place = lambda side: blocks.select(*[F.col(c).alias(f"{c}_{side}") for c in ("serie", "bloco", "lugar")])
    cells = cov.join(place("i"), "serie_i").join(place("j"), "serie_j")
    swap = F.col("bloco_i") > F.col("bloco_j")
    cells = cells.select(
        F.least("bloco_i", "bloco_j").alias("i"), F.greatest("bloco_i", "bloco_j").alias("j"),
        F.when(swap, F.col("lugar_j")).otherwise(F.col("lugar_i")).alias("a"), F.when(swap, F.col("lugar_i")).otherwise(F.col("lugar_j")).alias("b"), F.col("cov").alias("v"))
    means = mean.join(blocks, "serie").select(F.col("bloco").alias("i"), F.col("bloco").alias("j"), F.col("lugar").alias("a"), F.lit(-1).alias("b"), F.col("media").alias("v"))
    sizes = blocks.groupBy("bloco").agg(F.count(F.lit(1)).alias("n"))
    sized = (cells.union(means).join(sizes.select(F.col("bloco").alias("i"), F.col("n").alias("linhas")), "i")
             .join(sizes.select(F.col("bloco").alias("j"), F.col("n").alias("colunas")), "j"))
    return materialise(sized.groupBy("i", "j").applyInPandas(_dense, "i int, j int, linhas long, colunas long, sigma binary, media binary"))


def _dense(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    n, m = int(rows["linhas"].iloc[0]), int(rows["colunas"].iloc[0])
    a, b, v = (rows[c].to_numpy() for c in ("a", "b", "v"))
    sigma, media, own = np.full((n, m), np.nan), np.full(n, np.nan), b < 0
    media[a[own]] = v[own]
    sigma[a[~own], b[~own]] = v[~own]
    if key[0] == key[1]:
        sigma[b[~own], a[~own]] = v[~own]
    return pd.DataFrame([(*key, n, m, sigma.tobytes(), media.tobytes() if key[0] == key[1] else None)],
                        columns=["i", "j", "linhas", "colunas", "sigma", "media"])


def score_wide(candidates: DataFrame, blocks: DataFrame, dense: DataFrame, size: int = CANDIDATES) -> DataFrame:
    """Return and risk of every candidate: (candidata, retorno, risco), what ``frontier.score`` gives for arrays.

    candidates are (candidata, bloco, pesos) with all blocks of each candidate, dense is of ``dense_blocks``. Each
    covariance block goes once to each block of candidates, each slice of candidates once to each pair it is in.
    """
    group = F.floor(F.col("candidata") / size).alias("grupo")
    numbers = blocks.select("bloco").distinct()
    pairs = lambda mine, other: (F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j"))
    others = numbers.agg(F.sort_array(F.collect_list("bloco")).alias("_outros"))  # one number per block of funds
    dealt = attach(candidates.select("candidata", group, "bloco", "pesos"), others, (), "_outros").withColumn("_outro", F.explode("_outros"))
    dealt = dealt.select("grupo", *pairs(F.col("bloco"), F.col("_outro")), "candidata", "bloco", "pesos")
    groups = candidates.select(group).distinct()
    copies = attach(groups, dense.agg(F.collect_list(F.struct("i", "j")).alias("_pares")), (), "_pares").select("grupo", F.inline("_pares")).join(dense, ["i", "j"])
    kind = dict(candidates.dtypes)["candidata"]
    parts = (dealt.groupBy("grupo", "i", "j").cogroup(copies.groupBy("grupo", "i", "j"))
             .applyInPandas(_partial, f"candidata {kind}, retorno double, variancia double"))
    return parts.groupBy("candidata").agg(F.sum("retorno").alias("retorno"), F.sum("variancia").alias("_v")).select(
        "candidata", "retorno", F.sqrt(F.greatest("_v", F.lit(0.0))).alias("risco"))


def _partial(key: tuple, rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    _, i, j = key
    if rows.empty or block.empty:
        return pd.DataFrame(columns=["candidata", "retorno", "variancia"])
    block = block.iloc[0]
    sigma = np.frombuffer(block["sigma"]).reshape(int(block["linhas"]), int(block["colunas"]))
    left, right = (rows[rows["bloco"] == k].sort_values("candidata") for k in (i, j))
    a, b = (np.stack(side["pesos"].to_numpy()) for side in (left, right))
    risk = np.einsum("kf,kf->k", a @ sigma, b) * (1 if i == j else 2)
    gain = a @ np.frombuffer(block["media"]) if i == j else np.zeros(len(a))
    return pd.DataFrame({"candidata": left["candidata"].to_numpy(), "retorno": gain, "variancia": risk})


def long_blocks(candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """(candidata, serie, peso) of block rows."""
    each = candidates.select("candidata", "bloco", F.posexplode("pesos").alias("lugar", "peso"))
    return each.join(blocks, ["bloco", "lugar"]).select("candidata", "serie", "peso")
