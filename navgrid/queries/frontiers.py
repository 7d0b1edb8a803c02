"""Corners, candidates and minimum-variance curves on the driver tables."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from navgrid.operators import frontier as E, optimise as O, panel as P, performance as R, portfolio as H, risk as K, wide as W
from navgrid.queries.common import (
    COMMON, COMMON_BY, COV, MEAN, P_MONTH, P_SUPPLIER, RETURNS, RETURNS_BY, Tables, edge, query, r,
    supplier_portfolio,
)
from navgrid.queries.panels import _SERIES, _common
from navgrid.queries.portfolios import _BY, _MONTH_WEIGHTS, month_weights, panel
from navgrid.session import materialise, spread

_FLOOR = 0.01
_MONTH_SQL = f"WITH {P_MONTH}, {COMMON}, {RETURNS}, {MEAN}"
_SUPP_SQL = (f"WITH {P_SUPPLIER}, {COMMON_BY}, {RETURNS_BY}, mb AS (SELECT carteira, serie, avg(retorno) * 252 AS media, "
             "COUNT(*) OVER (PARTITION BY carteira) AS n FROM ret GROUP BY 1, 2)")


def month_returns(t: Tables) -> DataFrame:
    return R.returns(_common(t.month()))


def _positions(mean: DataFrame) -> DataFrame:
    return mean.withColumn("posicao", F.col("serie").cast("bigint"))


def _corner_sql(pick: str) -> str:
    return (f"cn AS (SELECT carteira, serie, media, {_FLOOR} + CASE WHEN serie = {pick} OVER (PARTITION BY carteira) "
            f"THEN 1 - {_FLOOR} * n ELSE 0 END AS peso FROM mb)")


_HIGH, _LOW = _corner_sql("arg_max(serie, media)"), _corner_sql("arg_min(serie, media)")


def _supplier_mean(t: Tables) -> DataFrame:
    return materialise(_positions(K.annual_mean(R.returns(panel(t), _BY), _BY)))


@query("f6_highest_return_corner", f"{_SUPP_SQL}, {_HIGH} SELECT carteira, serie, {r('peso')} AS peso FROM cn")
def f6(t: Tables) -> DataFrame:
    return edge(E.corner(_supplier_mean(t), _FLOOR, "high", _BY))


@query("f7_lowest_return_corner", f"{_SUPP_SQL}, {_LOW} SELECT carteira, serie, {r('peso')} AS peso FROM cn")
def f7(t: Tables) -> DataFrame:
    return edge(E.corner(_supplier_mean(t), _FLOOR, "low", _BY))


@query("a17_extreme_funds", f"""{_SUPP_SQL} SELECT carteira, arg_max(serie, media) AS maior, arg_min(serie, media) AS menor
    FROM mb GROUP BY 1""")
def a17(t: Tables) -> DataFrame:
    return _supplier_mean(t).groupBy("carteira").agg(
        F.max_by("serie", F.struct("media", -F.col("posicao"))).alias("maior"),
        F.min_by("serie", F.struct("media", "posicao")).alias("menor"))


@query("f8_target_grid", f"""{_SUPP_SQL}, e AS (SELECT carteira, {_FLOOR} * sum(media) + (1 - {_FLOOR} * max(n)) * min(media) AS lo,
    {_FLOOR} * sum(media) + (1 - {_FLOOR} * max(n)) * max(media) AS hi FROM mb GROUP BY 1)
    SELECT carteira, CAST(k AS INTEGER) AS alvo_ix, {r('lo + k * (hi - lo) / 59')} AS alvo FROM e, range(60) g(k)""")
def f8(t: Tables) -> DataFrame:
    mean = _supplier_mean(t)
    low, high = (E.expected_return(E.corner(mean, _FLOOR, side, _BY), mean, _BY) for side in ("low", "high"))
    return edge(E.target_grid(low, high, 60, _BY))


@query("f11_fill_to_floor", f"""WITH x AS (SELECT CAST(s_nationkey AS VARCHAR) || '-' || CAST(s_suppkey // 1000 AS VARCHAR) AS carteira, CAST(s_suppkey AS VARCHAR) AS serie,
    least(greatest(s_acctbal / 10000, 0.001), 1) - 0.001 AS e, COUNT(*) OVER (PARTITION BY s_nationkey, s_suppkey // 1000) AS n FROM supplier),
    y AS (SELECT *, sum(e) OVER (PARTITION BY carteira) AS s FROM x)
    SELECT carteira, serie, {r('CASE WHEN s <= 0 THEN 1.0 / n ELSE 0.001 + (1 - 0.001 * n) * e / s END')} AS peso FROM y""")
def f11(t: Tables) -> DataFrame:
    raw = t.supplier.select(supplier_portfolio(),
                            F.col("s_suppkey").cast("string").alias("serie"), (F.col("s_acctbal") / 10000).alias("peso"))
    return edge(E.fill_to_floor(raw, 0.001, _BY))


# Candidate weights: the same hash in both engines.
_CAND_SQL = f"""u AS (SELECT id AS candidata, serie, -ln((CAST('0x' || substr(md5('42|' || id || '|' || serie), 1, 13) AS BIGINT)
    + 0.5) / 4503599627370496.0) AS e FROM range(3000) g(id), (SELECT DISTINCT serie FROM ret)),
    cw AS (SELECT candidata, serie, {_FLOOR} + (1 - {_FLOOR} * 6) * e / sum(e) OVER (PARTITION BY candidata) AS peso FROM u)"""
_SCORE_SQL = f"""{_CAND_SQL}, {COV}, sc AS (SELECT rr.candidata, rr.retorno, sqrt(greatest(v, 0)) AS risco
    FROM (SELECT candidata, sum(peso * media) AS retorno FROM cw JOIN mu USING (serie) GROUP BY 1) rr
    JOIN (SELECT a.candidata, sum(a.peso * b.peso * cov) AS v FROM cw a JOIN cw b USING (candidata)
          JOIN sg ON sg.serie_i = a.serie AND sg.serie_j = b.serie GROUP BY 1) vv USING (candidata))"""
_SCORED = f"SELECT candidata, {r('retorno')} AS retorno, {r('risco')} AS risco FROM sc"


def _scored(t: Tables) -> DataFrame:
    rets = month_returns(t)
    drawn = E.candidate_weights(t.spark, _SERIES, 3000, _FLOOR)
    return E.score(drawn, K.annual_mean(rets), K.annual_cov(rets), _SERIES)


_F13_SQL = f"""WITH s AS (SELECT DISTINCT l_returnflag || l_linestatus AS serie FROM lineitem),
    u AS (SELECT id AS candidata, serie, COUNT(*) OVER (PARTITION BY id) AS n, -ln((CAST('0x' || substr(md5('42|' || id || '|' || serie), 1, 13)
    AS BIGINT) + 0.5) / 4503599627370496.0) AS e FROM (SELECT DISTINCT o_orderkey AS id FROM orders), s)
    SELECT candidata, serie, {r(f'{_FLOOR} + (1 - {_FLOOR} * n) * e / sum(e) OVER (PARTITION BY candidata)')} AS peso FROM u"""


@query("f13_candidate_weights", _F13_SQL)
def f13(t: Tables) -> DataFrame:
    """One candidate per order over the series that the table has (their list is bounded by flag and status)."""
    series = [x[0] for x in t.lineitem.select(F.concat("l_returnflag", "l_linestatus")).distinct().orderBy(F.col("concat(l_returnflag, l_linestatus)")).collect()]
    ids = t.orders.select(F.col("o_orderkey").alias("candidata")).distinct()
    return edge(E.long_weights(E.candidate_weights(t.spark, series, ids, _FLOOR), series))


@query("f13_wide_weights", _F13_SQL)
def f13_wide(t: Tables) -> DataFrame:
    """The same with the series as a table, in blocks of two."""
    blocks = W.fund_blocks(t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("serie")), 2)
    return edge(W.long_blocks(W.draw_weights(t.orders.select(F.col("o_orderkey").alias("candidata")).distinct(), blocks, _FLOOR), blocks))


@query("f12_score_candidates", f"{_MONTH_SQL}, {_SCORE_SQL} {_SCORED}")
def f12(t: Tables) -> DataFrame:
    return edge(_scored(t))


@query("f12_wide_score", f"{_MONTH_SQL}, {_SCORE_SQL} {_SCORED}")
def f12_wide(t: Tables) -> DataFrame:
    """The same candidates in blocks of two funds, as selections too wide for one array are scored."""
    rets = month_returns(t)
    blocks = W.fund_blocks(rets.select("serie"), 2)
    drawn = W.draw_weights(t.spark.range(3000).withColumnRenamed("id", "candidata"), blocks, _FLOOR)
    return edge(W.score_wide(drawn, blocks, W.dense_blocks(K.annual_cov(rets), K.annual_mean(rets), blocks), 1000))


@query("f14_lowest_risk_per_bucket", f"""{_MONTH_SQL}, {_SCORE_SQL}, e AS (SELECT min(retorno) AS lo, max(retorno) AS hi FROM sc),
    z AS (SELECT sc.*, CAST(least(floor((retorno - lo) / (hi - lo) * 20), 19) AS INTEGER) AS faixa FROM sc, e)
    SELECT faixa, arg_min(candidata, risco) AS candidata, {r('min(risco)')} AS risco,
           {r('arg_min(retorno, risco)')} AS retorno FROM z GROUP BY 1""")
def f14(t: Tables) -> DataFrame:
    return edge(E.lowest_risk_per_bucket(_scored(t), 20))


@query("f14_pareto_set", f"""{_MONTH_SQL}, {_SCORE_SQL} SELECT candidata, {r('risco')} AS risco, {r('retorno')} AS retorno
    FROM (SELECT *, max(retorno) OVER (ORDER BY risco ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS barra FROM sc)
    WHERE barra IS NULL OR retorno > barra""")
def f14_pareto(t: Tables) -> DataFrame:
    return edge(E.pareto_set(_scored(t)))


@query("f15_efficient_flag", f"""{_MONTH_SQL}, {_SCORE_SQL} SELECT candidata, {r('retorno')} AS retorno, {r('risco')} AS risco,
    retorno >= (SELECT arg_min(retorno, risco) FROM sc) AS eficiente FROM sc""")
def f15(t: Tables) -> DataFrame:
    return edge(E.efficient_flag(_scored(t)))


# Two series per portfolio have a closed form, which checks the solver's values; wider ones are certified below.
_PAIR_SQL = f"""WITH {P_MONTH}, {COMMON}, {RETURNS}, r2 AS (SELECT left(serie, 1) AS carteira, serie, data, retorno FROM ret),
    a AS (SELECT x.carteira, x.data, x.serie AS si, y.serie AS sj, x.retorno AS ri, y.retorno AS rj FROM r2 x
          JOIN r2 y ON x.carteira = y.carteira AND x.data = y.data AND x.serie < y.serie),
    m AS (SELECT carteira, si, sj, avg(ri) * 252 AS mi, avg(rj) * 252 AS mj, var_samp(ri) * 252 AS vi,
                 var_samp(rj) * 252 AS vj, covar_samp(ri, rj) * 252 AS cij FROM a GROUP BY 1, 2, 3)"""


def _pairs(t: Tables) -> DataFrame:
    return materialise(month_returns(t).withColumn("carteira", F.left("serie", F.lit(1))))


@query("f9_min_variance_pairs", f"""{_PAIR_SQL}, o AS (SELECT *, least(greatest((vj - cij) / (vi + vj - 2 * cij), {_FLOOR}),
    1 - {_FLOOR}) AS w FROM m) SELECT carteira, si AS serie, {r('w')} AS peso FROM o
    UNION ALL SELECT carteira, sj, {r('1 - w')} FROM o""")
def f9_pairs(t: Tables) -> DataFrame:
    return edge(O.min_variance(_pairs(t), _FLOOR, _BY))


@query("f10_frontier_pairs", f"""{_PAIR_SQL}, e AS (SELECT *, least(mi, mj) + {_FLOOR} * abs(mi - mj) AS lo,
    greatest(mi, mj) - {_FLOOR} * abs(mi - mj) AS hi FROM m),
    g AS (SELECT *, lo + k * (hi - lo) / 59 AS alvo FROM e, range(60) q(k)),
    h AS (SELECT *, (alvo - mj) / (mi - mj) AS w FROM g)
    SELECT carteira, CAST(k AS INTEGER) AS alvo_ix, {r('alvo')} AS alvo, {r('alvo')} AS retorno,
           {r('sqrt(w * w * vi + (1 - w) * (1 - w) * vj + 2 * w * (1 - w) * cij)')} AS risco FROM h""")
def f10_pairs(t: Tables) -> DataFrame:
    return edge(O.frontier(_pairs(t), 60, _FLOOR, _BY).select("carteira", "alvo_ix", "alvo", "retorno", "risco"))


@query("f10_frontier_pair_weights", f"""{_PAIR_SQL}, g AS (SELECT *, CAST(k AS INTEGER) AS alvo_ix, {_FLOOR} + k * (1 - 2 * {_FLOOR}) / 59 AS w
    FROM m, range(60) q(k)) SELECT carteira, alvo_ix, si AS serie, {r('CASE WHEN mi > mj THEN w ELSE 1 - w END')} AS peso FROM g
    UNION ALL SELECT carteira, alvo_ix, sj, {r('CASE WHEN mi > mj THEN 1 - w ELSE w END')} FROM g""")
def f10_weights(t: Tables) -> DataFrame:
    rets = _pairs(t)
    curve = O.frontier(rets, 60, _FLOOR, _BY)
    return edge(O.frontier_weights(curve, rets, _FLOOR, _BY).select("carteira", "alvo_ix", "serie", "peso"))


def _feasible(t: Tables) -> DataFrame:
    rets = materialise(R.returns(panel(t), _BY))
    usable = K.feasibility(rets, _BY, _FLOOR).where("motivo IS NULL")
    return materialise(rets.join(usable.select("carteira"), _BY, "left_semi"))


_FEASIBLE_SQL = (f"WITH {P_SUPPLIER}, {COMMON_BY}, {RETURNS_BY}, ok AS (SELECT carteira FROM ret GROUP BY 1 HAVING "
                 f"COUNT(DISTINCT serie) BETWEEN 2 AND 99 AND COUNT(DISTINCT data) >= 60)")


@query("f9_min_variance_certificate", f"""{_FEASIBLE_SQL} SELECT DISTINCT carteira, serie, true AS no_piso_ou_acima,
    true AS otima FROM ret JOIN ok USING (carteira)""")
def f9_certificate(t: Tables) -> DataFrame:
    """Optimality of every nation's portfolio, checked from the returns and not from the solver.

    At the optimum each holding's covariance with the portfolio is at least the portfolio's own covariance with
    the freely chosen part, with equality above the floor; the SQL side lists what must hold for every series.
    """
    rets = _feasible(t)
    w = O.min_variance(rets, _FLOOR, _BY)
    # Returns are many rows of a small file: by its size they would be broadcast.
    daily = (rets.hint("merge").join(w, [*_BY, "serie"]).groupBy(*_BY, "data").agg(F.sum(F.col("peso") * F.col("retorno")).alias("_p")))
    pull = (rets.hint("merge").join(daily, [*_BY, "data"]).groupBy(*_BY, "serie")
            .agg(F.covar_samp("retorno", "_p").alias("_g"), F.var_samp("retorno").alias("_v")))
    rows = pull.join(w, [*_BY, "serie"])
    free = rows.groupBy(*_BY).agg(
        (F.sum((F.col("peso") - _FLOOR) * F.col("_g")) / F.sum(F.col("peso") - _FLOOR)).alias("_nivel"),
        F.max("_v").alias("_escala"))
    gap = (F.col("_g") - F.col("_nivel")) / F.col("_escala")
    above = F.col("peso") > _FLOOR + 1e-6
    return P.attach(rows, free, _BY, "_nivel", "_escala").select(
        *_BY, "serie", (F.col("peso") >= _FLOOR - 1e-12).alias("no_piso_ou_acima"),
        ((gap >= -1e-7) & (~above | (gap <= 1e-7))).alias("otima"))


@query("f10_frontier", f"""{_FEASIBLE_SQL}, mb AS (SELECT carteira, serie, avg(retorno) * 252 AS media FROM ret JOIN ok USING (carteira)
    GROUP BY 1, 2), e AS (SELECT carteira, {_FLOOR} * sum(media) + (1 - {_FLOOR} * COUNT(*)) * min(media) AS lo,
    {_FLOOR} * sum(media) + (1 - {_FLOOR} * COUNT(*)) * max(media) AS hi FROM mb GROUP BY 1)
    SELECT carteira, CAST(k AS INTEGER) AS alvo_ix, {r('lo + k * (hi - lo) / 59')} AS alvo, {r('lo + k * (hi - lo) / 59')} AS retorno,
           true AS soma_um, true AS no_piso_ou_acima, true AS risco_dos_pesos, true AS otima, true AS ramo FROM e, range(60) q(k)""")
def f10(t: Tables) -> DataFrame:
    """Every point of every curve with its certificate, all from the returns and the weights, not from the solver.

    At the optimum a holding's covariance with the portfolio is a level plus a slope times its mean, and no series lies
    below that line; the line is fitted to the holdings above the floor. The ends of a curve have one holding above
    the floor, for which some slope always does. ``ramo``: a point is marked efficient from the lowest risk on.
    """
    rets, point = _feasible(t), [*_BY, "alvo_ix"]
    curve = E.efficient_flag(O.frontier(rets, 60, _FLOOR, _BY), _BY)
    w = O.frontier_weights(curve, rets, _FLOOR, _BY)
    fields = "alvo_ix int, soma_um boolean, no_piso_ou_acima boolean, _risco double, otima boolean"
    # A portfolio is one group: the floor bounds its series and the calendar their returns. As rows, the two products of
    # returns and weights would be one per series, date and target, and none of them would add up before a shuffle.
    vectors = K.return_vectors(rets, _BY).toDF(*_BY, "serie", "retornos")  # columns of its own, both sides come from the returns
    checked = spread(vectors, *_BY).groupBy(*_BY).cogroup(spread(w, *_BY).groupBy(*_BY)).applyInPandas(
        _certified, f"{_BY[0]} string, {fields}")
    least = curve.groupBy(*_BY).agg(F.min_by("alvo_ix", F.struct("risco", -F.col("retorno"))).alias("_base"))
    return edge(curve.join(checked.hint("merge"), point).join(least, _BY).select(
        *point, "alvo", "retorno", "soma_um", "no_piso_ou_acima",
        (F.abs(F.col("_risco") - F.col("risco")) <= 1e-9 * F.col("_risco")).alias("risco_dos_pesos"), "otima",
        (F.col("eficiente") == (F.col("alvo_ix") >= F.col("_base"))).alias("ramo")))


def _certified(key: tuple, vectors: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
    """Sum, floor, risk and optimality of the points of one curve."""
    columns = [*_BY, "alvo_ix", "soma_um", "no_piso_ou_acima", "_risco", "otima"]
    if vectors.empty or weights.empty:
        return pd.DataFrame(columns=columns)
    peso = weights.pivot(index="alvo_ix", columns="serie", values="peso").reindex(columns=vectors["serie"])
    w, r = peso.to_numpy(), np.stack(vectors["retornos"].to_numpy()).astype(float)
    r_mean, days = r.mean(axis=1), r.shape[1] - 1
    centred = r - r_mean[:, None]
    path = w @ centred
    pull, scale = path @ centred.T / days, (centred ** 2).sum(axis=1).max() / days
    free = w > _FLOOR + 1e-5
    held = np.maximum(free.sum(axis=1, keepdims=True), 1)
    off = lambda x: x - (x * free).sum(axis=1, keepdims=True) / held
    g, m = off(pull), off(np.broadcast_to(r_mean, w.shape))
    spread_m = (m * m * free).sum(axis=1, keepdims=True) / held
    sloped = spread_m > 1e-18
    slope = (g * m * free).sum(axis=1, keepdims=True) / held / np.where(sloped, spread_m, 1.0)
    gap = (g - slope * m) / scale
    fits = ~sloped | ((gap >= -1e-5) & (~free | (gap <= 1e-5)))
    return pd.DataFrame({**dict(zip(_BY, key)), "alvo_ix": peso.index, "soma_um": np.abs(w.sum(axis=1) - 1) < 1e-9,
                         "no_piso_ou_acima": w.min(axis=1) >= _FLOOR - 1e-12, "_risco": np.sqrt((path ** 2).sum(axis=1) / days * 252),
                         "otima": fits.all(axis=1)}, columns=columns)


@query("f10_frontier_ends", f"""{_FEASIBLE_SQL}, mb AS (SELECT carteira, serie, avg(retorno) * 252 AS media, var_samp(retorno) AS x
    FROM ret JOIN ok USING (carteira) GROUP BY 1, 2),
    e AS (SELECT carteira, {_FLOOR} * sum(media) + (1 - {_FLOOR} * COUNT(*)) * min(media) AS lo,
    {_FLOOR} * sum(media) + (1 - {_FLOOR} * COUNT(*)) * max(media) AS hi FROM mb GROUP BY 1)
    SELECT carteira, {r('lo')} AS primeiro, {r('hi')} AS ultimo, CAST(60 AS BIGINT) AS pontos, true AS convexa FROM e""")
def f10_ends(t: Tables) -> DataFrame:
    """Ends of every curve, all targets reached, and variance convex in the return along the grid."""
    from pyspark.sql import Window
    curve = O.frontier(_feasible(t), 60, _FLOOR, _BY).withColumn("_v", F.col("risco") * F.col("risco"))
    order = Window.partitionBy(*_BY).orderBy("alvo_ix")
    bend = F.lag("_v").over(order) + F.lead("_v").over(order) - 2 * F.col("_v")
    return edge(curve.withColumn("_curva", bend).groupBy(*_BY).agg(
        F.min_by("retorno", "alvo_ix").alias("primeiro"), F.max_by("retorno", "alvo_ix").alias("ultimo"),
        F.count(F.lit(1)).alias("pontos"),
        F.coalesce(F.min("_curva") >= -1e-9 * F.max("_v"), F.lit(True)).alias("convexa")))


@query("f9_wide_min_variance", f"""{_PAIR_SQL}, o AS (SELECT *, least(greatest((vj - cij) / (vi + vj - 2 * cij), {_FLOOR}),
    1 - {_FLOOR}) AS w FROM m) SELECT carteira, si AS serie, {r('w')} AS peso FROM o
    UNION ALL SELECT carteira, sj, {r('1 - w')} FROM o""")
def f9_wide(t: Tables) -> DataFrame:
    """From one series at a time, as portfolios too wide for one task are solved, on the same closed form."""
    return edge(O.min_variance(_pairs(t), _FLOOR, _BY, seeds=0, batch=1))


@query("f5_single_portfolio", f"""{_MONTH_SQL}, {COV}, {_MONTH_WEIGHTS} SELECT {r('(SELECT sum(peso * media) FROM mw JOIN mu USING (serie))')}
    AS retorno, {r('sqrt(sum(a.peso * b.peso * cov))')} AS risco
    FROM sg JOIN mw a ON a.serie = serie_i JOIN mw b ON b.serie = serie_j""")
def static_point(t: Tables) -> DataFrame:
    return edge(H.static_risk_return(month_returns(t), month_weights(t), by=()))
