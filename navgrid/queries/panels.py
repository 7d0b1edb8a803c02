"""Panels and performance on the driver tables."""

from datetime import date

from pyspark.sql import DataFrame, functions as F

from navgrid.operators import panel as P, performance as R
from navgrid.queries.common import (
    COMMON, P_DAY, P_MONTH, P_NATION, P_PRIO, P_SUPPLIER, RETURNS, Tables, edge, query, r, text,
)
from navgrid.session import materialise

_PANEL = f"serie, {text('data')} AS data, valor"
_SERIES = ["AF", "AO", "NF", "NO", "RF", "RO"]
_FIRST = "first_value(valor) OVER (PARTITION BY serie ORDER BY data)"
_BASE = f"b AS (SELECT serie, data, valor / {_FIRST} * 100 AS valor FROM c)"
_BASE_ALL = f"b AS (SELECT serie, data, valor / {_FIRST} * 100 AS valor FROM p)"
_NAMES_SQL = "(SELECT CAST(n_nationkey AS VARCHAR) AS serie, n_name AS nome FROM nation)"


def _quotes(t: Tables) -> DataFrame:
    return t.day().toDF("cnpj", "data", "valor_cota")


def _wanted(panel: DataFrame):
    return P.scalar(panel.agg(F.countDistinct("serie").alias("n")), "n")


def _common(panel: DataFrame) -> DataFrame:
    """Common dates of all series. The panel is kept: the fact table below it is read once, not per branch."""
    panel = materialise(panel)
    return P.common_dates(panel, _wanted(panel))


def _names(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").cast("string").alias("cnpj"), F.col("n_name").alias("nome"))


@query("s5_quote_scan", f"""WITH {P_DAY} SELECT {text('data')} AS data, serie AS cnpj, valor AS valor_cota FROM p
    WHERE serie IN ('AF', 'NO', 'RF') AND data BETWEEN DATE '1996-02-01' AND DATE '2000-06-30' ORDER BY data, cnpj""")
def s5(t: Tables) -> DataFrame:
    scan = P.quote_scan(_quotes(t), ["AF", "NO", "RF"], date(1996, 2, 1), date(2000, 6, 30))
    return edge(scan.orderBy("data", "cnpj"), None)


@query("s5_load_panel", f"""WITH {P_DAY}, w AS (SELECT * FROM p WHERE data BETWEEN DATE '1996-02-01'
    AND DATE '2000-06-30') SELECT {_PANEL} FROM w WHERE data IN (SELECT data FROM w GROUP BY data HAVING COUNT(*) = 6)""")
def s5_panel(t: Tables) -> DataFrame:
    return edge(P.load_panel(_quotes(t), _SERIES, date(1996, 2, 1), date(2000, 6, 30)), None)


@query("s5_load_panel_by_register", f"""WITH {P_DAY} SELECT {_PANEL} FROM p WHERE data IN
    (SELECT data FROM p GROUP BY data HAVING COUNT(*) = 6)""")
def s5_register(t: Tables) -> DataFrame:
    funds = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("cnpj")).distinct()
    return edge(P.load_panel(_quotes(t), funds, date(1990, 1, 1), date(2010, 1, 1)), None)


@query("p13_date_range", """SELECT l_suppkey, COUNT(*) AS linhas FROM lineitem
    WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '2000-06-30' GROUP BY 1""")
def p13(t: Tables) -> DataFrame:
    """The range is compared with the stored timestamp, so it reaches the file scan."""
    inside = (F.col("l_shipdate") >= F.lit(date(1996, 2, 1))) & (F.col("l_shipdate") < F.lit(date(2000, 7, 1)))
    return t.lineitem.where(inside).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("linhas"))


@query("a5_common_dates", f"WITH {P_PRIO}, {COMMON} SELECT {_PANEL} FROM c")
def a5(t: Tables) -> DataFrame:
    return edge(_common(t.prio()), None)


@query("a5_common_dates_by_portfolio", f"""WITH {P_SUPPLIER}, n AS (SELECT CAST(s_nationkey AS VARCHAR) || '-' || CAST(s_suppkey // 1000 AS VARCHAR) AS carteira,
    COUNT(*) AS n FROM supplier GROUP BY 1), k AS (SELECT carteira, data FROM p JOIN n USING (carteira)
    GROUP BY carteira, data, n HAVING COUNT(*) = n) SELECT carteira, {_PANEL} FROM p JOIN k USING (carteira, data)""")
def a5_by(t: Tables) -> DataFrame:
    panel = P.common_dates_per_group(materialise(t.supplier_month()), t.suppliers(), ["carteira"])
    return edge(panel.select("carteira", "serie", "data", "valor"), None)


@query("a6_any_data_dates", f"WITH {P_PRIO} SELECT {text('data')} AS data, COUNT(*) AS series FROM p GROUP BY data")
def a6(t: Tables) -> DataFrame:
    return edge(t.prio().groupBy("data").agg(F.count("valor").alias("series")))


@query("a15_missing_series", f"""WITH {P_DAY} SELECT 'x' || s AS serie FROM (SELECT DISTINCT l_linestatus AS s FROM lineitem)
    WHERE 'x' || s NOT IN (SELECT serie FROM p)""")
def a15(t: Tables) -> DataFrame:
    asked = t.lineitem.select(F.concat(F.lit("x"), "l_linestatus").alias("serie")).unionByName(
        t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("serie")))
    return P.missing_series(t.day(), asked)


@query("a15_enough_dates", f"""WITH {P_PRIO}, {COMMON} SELECT COUNT(DISTINCT data) AS datas,
    COUNT(DISTINCT data) >= 2 AS suficiente FROM c""")
def a15_dates(t: Tables) -> DataFrame:
    return P.enough_dates(_common(t.prio()))


@query("v1_pivot", f"""WITH {P_DAY} SELECT {text('data')} AS data, {', '.join(
    f"max(valor) FILTER (serie = '{s}') AS {s}" for s in [*_SERIES, 'ZZ'])} FROM p GROUP BY data""")
def v1(t: Tables) -> DataFrame:
    return edge(P.to_wide(t.day(), [*_SERIES, "ZZ"]), None)


@query("v2_melt", f"""WITH {P_DAY} SELECT serie, {text('data')} AS data, valor
    FROM (SELECT DISTINCT data FROM p) CROSS JOIN (SELECT DISTINCT serie FROM p) LEFT JOIN p USING (data, serie)""")
def v2(t: Tables) -> DataFrame:
    return edge(P.to_long(P.to_wide(t.day(), _SERIES), _SERIES), None)


@query("v3_rename", f"""WITH {P_NATION} SELECT nome, {_PANEL} FROM p LEFT JOIN {_NAMES_SQL} USING (serie)""")
def v3(t: Tables) -> DataFrame:
    return edge(P.with_names(t.nation_day(), _names(t)).select("nome", "serie", "data", "valor"), None)


@query("j6_name_fallback", """SELECT CAST(o_custkey AS VARCHAR) AS serie, coalesce(s_name, CAST(o_custkey AS VARCHAR)) AS nome,
    COUNT(*) AS linhas FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey GROUP BY 1, 2""")
def j6(t: Tables) -> DataFrame:
    counts = t.orders.groupBy(F.col("o_custkey").cast("string").alias("serie")).agg(F.count(F.lit(1)).alias("linhas"))
    names = t.supplier.select(F.col("s_suppkey").cast("string").alias("cnpj"), F.col("s_name").alias("nome"))
    return P.with_names(counts, names).select("serie", "nome", "linhas")


@query("w1_rebase100", f"WITH {P_NATION}, {_BASE_ALL} SELECT {_PANEL} FROM b")
def w1(t: Tables) -> DataFrame:
    return edge(R.rebase100(t.nation_day()), None)


@query("w2_returns", f"WITH {P_PRIO}, {COMMON}, {RETURNS} SELECT serie, {text('data')} AS data, {r('retorno')} AS retorno FROM ret")
def w2(t: Tables) -> DataFrame:
    return edge(R.returns(_common(t.prio())))


@query("w2_returns_with_gaps", f"""WITH {P_DAY}, d AS (SELECT data, lag(data) OVER (ORDER BY data) AS ontem FROM
    (SELECT DISTINCT data FROM p)), x AS (SELECT serie, data, valor / lag(valor) OVER o - 1 AS retorno,
    lag(data) OVER o AS antes FROM p WINDOW o AS (PARTITION BY serie ORDER BY data)),
    y AS (SELECT serie, data, retorno FROM x JOIN d USING (data) WHERE antes = ontem)
    SELECT serie, {text('data')} AS data, {r('retorno')} AS retorno FROM y WHERE data IN (SELECT data FROM y GROUP BY data
    HAVING COUNT(*) = (SELECT COUNT(DISTINCT serie) FROM p))""")
def w2_gaps(t: Tables) -> DataFrame:
    return edge(R.returns(materialise(t.day()), common=False))


@query("p21_cumulative_return", f"""WITH {P_DAY}, {COMMON}, {_BASE} SELECT serie, {text('data')} AS data,
    {r('valor / 100 - 1')} AS valor FROM b""")
def p21(t: Tables) -> DataFrame:
    return edge(R.cumulative_return(R.rebase100(_common(t.day()))))


_SUMMARY = f"""SELECT serie, {text('min(data)')} AS inicio_efetivo, {text('max(data)')} AS fim_efetivo,
    {r('arg_max(valor, data) / 100 - 1')} AS rentabilidade FROM b GROUP BY serie"""


@query("a13_window_return", f"WITH {P_NATION}, {_BASE_ALL} {_SUMMARY}")
def a13(t: Tables) -> DataFrame:
    return edge(R.performance_summary(R.rebase100(t.nation_day())))


@query("a14_window_metrics", f"""WITH {P_NATION} SELECT {text('min(data)')} AS primeira_data,
    {text('max(data)')} AS fim_efetivo, COUNT(DISTINCT serie) AS series FROM p""")
def a14(t: Tables) -> DataFrame:
    return edge(R.window_metrics(t.nation_day()))


@query("f1_fund_performance", f"""WITH {P_MONTH}, {COMMON}, {_BASE} SELECT serie, {text('data')} AS data,
    {r('valor / 100 - 1')} AS valor FROM b""")
def f1(t: Tables) -> DataFrame:
    return edge(R.cumulative_return(R.rebase100(_common(t.month()))))


@query("f3_performance_summary", f"WITH {P_MONTH}, {COMMON}, {_BASE} {_SUMMARY}")
def f3(t: Tables) -> DataFrame:
    return edge(R.performance_summary(R.rebase100(_common(t.month()))))
