"""Portfolios on the driver tables: one portfolio per nation, its suppliers as holdings."""

from pyspark.sql import DataFrame, functions as F

from navgrid.operators import panel as P, performance as R, portfolio as H, risk as K
from navgrid.queries.common import (
    COMMON, COMMON_BY, COV, MEAN, P_MONTH, P_SUPPLIER, RETURNS, RETURNS_BY, Tables, edge, query, r, text,
    supplier_portfolio,
)
from navgrid.queries.panels import _common
from navgrid.session import materialise

_BY = ["carteira"]
_WEIGHTS_SQL = """w AS (SELECT CAST(s_nationkey AS VARCHAR) || '-' || CAST(s_suppkey // 1000 AS VARCHAR) AS carteira, CAST(s_suppkey AS VARCHAR) AS serie,
    (abs(s_acctbal) + 1) / sum(abs(s_acctbal) + 1) OVER (PARTITION BY s_nationkey, s_suppkey // 1000) AS peso FROM supplier)"""
_HELD_SQL = """held AS (SELECT c.carteira, c.serie, c.data, peso * valor / first_value(valor) OVER
    (PARTITION BY c.carteira, c.serie ORDER BY data) AS posicao FROM c JOIN w USING (carteira, serie)),
    tot AS (SELECT carteira, data, sum(posicao) AS total FROM held GROUP BY 1, 2),
    sh AS (SELECT carteira, serie, data, posicao / total AS peso FROM held JOIN tot USING (carteira, data))"""
_BASE_SQL = f"WITH {P_SUPPLIER}, {COMMON_BY}, {_WEIGHTS_SQL}, {_HELD_SQL}"


def panel(t: Tables) -> DataFrame:
    """Common-date panel of every nation."""
    return P.common_dates_per_group(materialise(t.supplier_month()), t.suppliers(), _BY)


def percentages(t: Tables) -> DataFrame:
    stake = F.abs("s_acctbal") + 1
    rows = t.supplier.select(supplier_portfolio(),
                             F.col("s_suppkey").cast("string").alias("serie"), stake.alias("_valor"))
    totals = rows.groupBy("carteira").agg(F.sum("_valor").alias("_total"))
    return P.attach(rows, totals, _BY, "_total").select(
        "carteira", "serie", (100.005 * F.col("_valor") / F.col("_total")).alias("percentual"))


def weights(t: Tables) -> DataFrame:
    return H.normalise_weights(percentages(t))


def month_weights(t: Tables) -> DataFrame:
    """Weights of the six monthly series by their number of line items."""
    counts = t.lineitem.groupBy(F.concat("l_returnflag", "l_linestatus").alias("serie")).agg(F.count(F.lit(1)).alias("_n"))
    return P.attach(counts, counts.agg(F.sum("_n").alias("_t")), (), "_t").select(
        "serie", (F.col("_n") / F.col("_t")).alias("peso"))


_MONTH_WEIGHTS = """mw AS (SELECT l_returnflag || l_linestatus AS serie, COUNT(*) / (SELECT COUNT(*) FROM lineitem) AS peso
    FROM lineitem GROUP BY 1)"""


@query("f20_equal_weights", """SELECT CAST(s_nationkey AS VARCHAR) || '-' || CAST(s_suppkey // 1000 AS VARCHAR) AS carteira, CAST(s_suppkey AS VARCHAR) AS serie,
    round_even(100.0 / count(*) OVER (PARTITION BY s_nationkey, s_suppkey // 1000), 2) + 0.0 AS percentual FROM supplier""")
def f20(t: Tables) -> DataFrame:
    return edge(H.equal_weights(t.suppliers()))


@query("p25_normalise_weights", f"WITH {_WEIGHTS_SQL} SELECT carteira, serie, {r('peso', 9)} AS peso FROM w")
def p25(t: Tables) -> DataFrame:
    return edge(weights(t), 9)


@query("a16_weight_totals", f"WITH {_WEIGHTS_SQL} SELECT carteira, {r('sum(peso)')} AS total FROM w GROUP BY 1")
def a16(t: Tables) -> DataFrame:
    return edge(weights(t).groupBy("carteira").agg(F.sum("peso").alias("total")))


@query("p26_weight_problems", """
    WITH x AS (SELECT CAST(s_nationkey AS VARCHAR) || '-' || CAST(s_suppkey // 1000 AS VARCHAR) AS carteira, CASE WHEN s_acctbal < 1000 THEN NULL
               ELSE s_acctbal / 10000 - 0.2 END AS peso FROM supplier)
    SELECT carteira, round(sum(peso), 6) + 0.0 AS soma, COUNT(*) FILTER (peso IS NULL) AS faltantes,
           COUNT(*) FILTER (peso < 0) AS negativos FROM x GROUP BY 1
    HAVING COUNT(*) FILTER (peso IS NULL) > 0 OR COUNT(*) FILTER (peso < 0) > 0 OR sum(peso) IS NULL
        OR abs(sum(peso) - 1) > 1e-5 + 1e-8""")
def p26(t: Tables) -> DataFrame:
    some = t.supplier.where("s_acctbal >= 1000").select(
        supplier_portfolio(), F.col("s_suppkey").cast("string").alias("serie"),
        (F.col("s_acctbal") / 10000 - 0.2).alias("peso"))
    return edge(H.weight_problems(some, t.suppliers()))


@query("w7_holdings", f"{_BASE_SQL} SELECT carteira, serie, {text('data')} AS data, {r('posicao')} AS posicao FROM held")
def w7(t: Tables) -> DataFrame:
    return edge(H.holdings(panel(t), weights(t)))


@query("a12_portfolio_totals", f"{_BASE_SQL} SELECT carteira, {text('data')} AS data, {r('total')} AS total FROM tot")
def a12(t: Tables) -> DataFrame:
    return edge(H.portfolio_totals(H.holdings(panel(t), weights(t))))


@query("f4_history", f"""{_BASE_SQL} SELECT carteira, {text('data')} AS data, {r('total / first_value(total) OVER (PARTITION BY carteira ORDER BY data) * 100')} AS valor FROM tot""")
def f4(t: Tables) -> DataFrame:
    return edge(H.buy_and_hold(panel(t), weights(t))[0])


@query("w5_drifting_weights", f"{_BASE_SQL} SELECT carteira, serie, {text('data')} AS data, {r('peso')} AS peso FROM sh")
def w5(t: Tables) -> DataFrame:
    return edge(H.buy_and_hold(panel(t), weights(t))[1])


@query("f18_final_allocation", f"""{_BASE_SQL}, fin AS (SELECT carteira, serie, arg_max(peso, data) AS peso FROM sh
    GROUP BY 1, 2) SELECT carteira, serie, {r('peso')} AS peso FROM fin""")
def f18(t: Tables) -> DataFrame:
    return edge(H.final_allocation(H.buy_and_hold(panel(t), weights(t))[1]))


@query("f16_allocation_table", f"""{_BASE_SQL}, fin AS (SELECT carteira, serie, arg_max(peso, data) AS peso FROM sh
    GROUP BY 1, 2) SELECT carteira, s_name AS fundo, {r('peso')} AS alocacao FROM fin
    JOIN supplier ON CAST(s_suppkey AS VARCHAR) = serie WHERE peso > 0.00005""")
def f16(t: Tables) -> DataFrame:
    names = t.supplier.select(F.col("s_suppkey").cast("string").alias("cnpj"), F.col("s_name").alias("nome"))
    return edge(H.allocation_table(H.final_allocation(H.buy_and_hold(panel(t), weights(t))[1]), names))


@query("p20_weight_threshold", f"WITH {_WEIGHTS_SQL} SELECT carteira, serie AS fundo, {r('peso')} AS alocacao FROM w WHERE peso > 0.05")
def p20(t: Tables) -> DataFrame:
    others = t.supplier.select(F.concat(F.lit("x"), "s_suppkey").alias("cnpj"), F.col("s_name").alias("nome"))
    return edge(H.allocation_table(weights(t), others, least=0.05))


@query("w6_single_portfolio", f"""WITH {P_MONTH}, {COMMON}, {_MONTH_WEIGHTS}, tot AS (SELECT data, sum(posicao) AS total FROM (
    SELECT data, peso * valor / first_value(valor) OVER (PARTITION BY serie ORDER BY data) AS posicao
    FROM c JOIN mw USING (serie)) GROUP BY 1)
    SELECT {text('data')} AS data, {r('total / first_value(total) OVER (ORDER BY data) * 100')} AS valor FROM tot""")
def w6(t: Tables) -> DataFrame:
    return edge(H.buy_and_hold(_common(t.month()), month_weights(t), by=())[0])


@query("a9_annual_mean", f"WITH {P_SUPPLIER}, {COMMON_BY}, {RETURNS_BY} SELECT carteira, serie, {r('avg(retorno) * 252')} AS media FROM ret GROUP BY 1, 2")
def a9(t: Tables) -> DataFrame:
    return edge(K.annual_mean(R.returns(panel(t), _BY), _BY))


@query("a10_annual_cov", f"WITH {P_MONTH}, {COMMON}, {RETURNS}, {COV} SELECT serie_i, serie_j, {r('cov')} AS cov FROM sg")
def a10(t: Tables) -> DataFrame:
    return edge(K.mirrored(K.annual_cov(R.returns(_common(t.month())))))


@query("j8_cov_by_portfolio", f"""WITH {P_SUPPLIER}, {COMMON_BY}, {RETURNS_BY} SELECT a.carteira AS carteira,
    a.serie AS serie_i, b.serie AS serie_j, {r('covar_samp(a.retorno, b.retorno) * 252')} AS cov
    FROM ret a JOIN ret b USING (carteira, data) GROUP BY 1, 2, 3""")
def j8(t: Tables) -> DataFrame:
    """Blocks of eight series, so that wide portfolios take the many-block path here too."""
    return edge(K.mirrored(K.annual_cov(R.returns(panel(t), _BY), _BY, block=8)))


@query("f17_fund_points", f"""WITH {P_SUPPLIER}, {COMMON_BY}, {RETURNS_BY} SELECT carteira, serie,
    {r('avg(retorno) * 252')} AS retorno, {r('sqrt(var_samp(retorno) * 252)')} AS risco FROM ret GROUP BY 1, 2""")
def f17(t: Tables) -> DataFrame:
    return edge(K.fund_points(R.returns(panel(t), _BY), _BY))


@query("f5_static_risk_return", f"""WITH {P_SUPPLIER}, {COMMON_BY}, {RETURNS_BY}, {_WEIGHTS_SQL},
    m AS (SELECT carteira, serie, avg(retorno) * 252 AS media FROM ret GROUP BY 1, 2),
    sg AS (SELECT a.carteira AS carteira, a.serie AS i, b.serie AS j, covar_samp(a.retorno, b.retorno) * 252 AS cov
           FROM ret a JOIN ret b USING (carteira, data) GROUP BY 1, 2, 3),
    v AS (SELECT sg.carteira, sum(wi.peso * wj.peso * cov) AS v FROM sg JOIN w wi ON wi.carteira = sg.carteira AND wi.serie = i
          JOIN w wj ON wj.carteira = sg.carteira AND wj.serie = j GROUP BY 1),
    e AS (SELECT carteira, sum(peso * media) AS retorno FROM m JOIN w USING (carteira, serie) GROUP BY 1)
    SELECT carteira, {r('retorno')} AS retorno, {r('sqrt(greatest(v, 0))')} AS risco FROM e JOIN v USING (carteira)""")
def f5(t: Tables) -> DataFrame:
    return edge(H.static_risk_return(R.returns(panel(t), _BY), weights(t)))


@query("j9_bilinear", f"""WITH {P_MONTH}, {COMMON}, {RETURNS}, {COV}, {_MONTH_WEIGHTS}
    SELECT {r('sum(a.peso * b.peso * cov)')} AS variancia, {r('sqrt(greatest(sum(a.peso * b.peso * cov), 0))')} AS risco
    FROM sg JOIN mw a ON a.serie = serie_i JOIN mw b ON b.serie = serie_j""")
def j9(t: Tables) -> DataFrame:
    return edge(K.bilinear(month_weights(t), K.annual_cov(R.returns(_common(t.month())))))


@query("p24_bad_estimates", f"""WITH {P_MONTH}, {COMMON}, {RETURNS}, {MEAN}, {COV}
    SELECT (SELECT COUNT(*) FROM sg WHERE cov IS NULL OR NOT isfinite(cov)) AS covariancias,
           (SELECT COUNT(*) FROM mu WHERE media IS NULL OR NOT isfinite(media)) AS medias""")
def p24(t: Tables) -> DataFrame:
    rets = R.returns(_common(t.month()))
    return K.bad_estimates(K.annual_mean(rets), K.mirrored(K.annual_cov(rets)))


@query("p27_feasibility", f"""WITH {P_SUPPLIER}, {COMMON_BY}, {RETURNS_BY}, n AS (SELECT carteira, COUNT(DISTINCT serie) AS series,
    COUNT(DISTINCT data) AS retornos FROM ret GROUP BY 1)
    SELECT carteira, series, retornos, CASE WHEN series < 2 THEN 'at least two series are needed'
        WHEN series * 0.2 >= 1 THEN 'the floor does not fit'
        WHEN retornos < 60 THEN 'at least 60 common returns are needed' END AS motivo FROM n""")
def p27(t: Tables) -> DataFrame:
    return K.feasibility(R.returns(panel(t), _BY), _BY, floor=0.2)
