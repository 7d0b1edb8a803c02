"""Benchmark series on the driver tables: events as daily rates, orders as closes."""

from datetime import date

from pyspark.sql import DataFrame, functions as F

from navgrid.functions import rate_factor
from navgrid.operators import benchmark as B, performance as R
from navgrid.operators.panel import scalar
from navgrid.plans.performance import Performance, fund_performance
from navgrid.plans.portfolio import OWN, portfolio_page
from navgrid.queries.common import COMMON, P_MONTH, P_PRIO, Tables, edge, query, r, text
from navgrid.queries.panels import _BASE, _common
from navgrid.sources.benchmarks import load_benchmark, read_closes, read_rates

_PANEL = f"serie, {text('data')} AS data, {r('valor')} AS valor"
_START, _END = date(2024, 1, 3), date(2024, 1, 25)
_RATES_SQL = """t AS (SELECT 'Benchmark: CDI' AS serie, CAST(ts AS DATE) AS data, arg_max(value / 1000, event_id) AS valor
    FROM events GROUP BY 2)"""
_RATES_IN = "t2 AS (SELECT * FROM t WHERE data BETWEEN DATE '2024-01-03' AND DATE '2024-01-25')"
_CURVE = """g AS (SELECT serie, data, product(1 + valor / 100) OVER (ORDER BY data) AS a FROM t2),
    cdi AS (SELECT serie, data, a / first_value(a) OVER (ORDER BY data) * 100 AS valor FROM g)"""
_CLOSES_SQL = """k AS (SELECT 'Benchmark: Ibovespa' AS serie, CAST(o_orderdate AS DATE) AS data,
    arg_max(o_totalprice, o_orderkey) AS valor FROM orders WHERE o_orderdate >= DATE '1996-01-01'
    AND CAST(o_orderdate AS DATE) <= DATE '2000-12-31' GROUP BY 2)"""
_ALL_CLOSES = """k AS (SELECT 'Benchmark: Ibovespa' AS serie, CAST(o_orderdate AS DATE) AS data,
    arg_max(o_totalprice, o_orderkey) AS valor FROM orders GROUP BY 2)"""
_INDEX = "ibov AS (SELECT serie, data, valor / first_value(valor) OVER (ORDER BY data) * 100 AS valor FROM k)"


def _rates(t: Tables) -> DataFrame:
    return t.events.select(F.col("ts").alias("data"), (F.col("value") / 1000).alias("valor"),
                           F.col("event_id").alias("seq"))


def _closes(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderdate").alias("data"), F.col("o_totalprice").alias("Close"),
                           F.col("o_orderkey").alias("seq"))


def _closes_in(t: Tables) -> DataFrame:
    return read_closes(_closes(t), date(1996, 1, 1), date(2000, 12, 31))


def _all_closes(t: Tables) -> DataFrame:
    return read_closes(_closes(t), date(1900, 1, 1), date(2200, 1, 1))


@query("p23_clean_series", f"""WITH x AS (SELECT CAST(ts AS DATE) AS data, event_id, CASE event_type WHEN 'error' THEN NULL
    ELSE value END AS valor FROM events) SELECT 'eventos' AS serie, {text('data')} AS data,
    {r('arg_max(valor, event_id)')} AS valor FROM x WHERE valor IS NOT NULL GROUP BY data""")
def p23(t: Tables) -> DataFrame:
    """Text in, as from a request: errors carry words instead of numbers."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    number = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    rows = t.events.select(F.col("ts").cast("string").alias("ts"), "event_id",
                           F.when(F.col("event_type") == "error", "sem valor").otherwise(number).alias("v"))
    return edge(B.clean_series(rows, value="v", when="ts", seq="event_id", name="eventos"))


@query("s7_read_rates", f"WITH {_RATES_SQL}, {_RATES_IN} SELECT {_PANEL} FROM t2")
def s7(t: Tables) -> DataFrame:
    return edge(read_rates(_rates(t), _START, _END))


@query("s8_read_closes", f"WITH {_CLOSES_SQL} SELECT {_PANEL} FROM k")
def s8(t: Tables) -> DataFrame:
    return edge(_closes_in(t))


@query("s9_load_benchmark", f"WITH {_RATES_SQL}, {_RATES_IN}, {_CURVE} SELECT {_PANEL} FROM cdi")
def s9(t: Tables) -> DataFrame:
    return edge(load_benchmark(t.spark, "CDI", {"CDI": lambda: _rates(t)}, _START, _END))


@query("u4_concat_parts", f"WITH {_RATES_SQL} SELECT {_PANEL} FROM t")
def u4(t: Tables) -> DataFrame:
    """Two request windows fetched apart and put together."""
    rows = _rates(t)
    parts = (read_rates(rows, date(2024, 1, 1), date(2024, 1, 15)), read_rates(rows, date(2024, 1, 16), date(2030, 1, 1)))
    return edge(parts[0].unionByName(parts[1]))


@query("p22_rate_factor", f"SELECT event_id, {r('1 + value / 100')} AS fator FROM events")
def p22(t: Tables) -> DataFrame:
    return edge(t.events.select("event_id", rate_factor("value").alias("fator")))


@query("w4_compound_rates", f"WITH {_RATES_SQL}, t2 AS (SELECT * FROM t), {_CURVE} SELECT {_PANEL} FROM cdi")
def w4(t: Tables) -> DataFrame:
    return edge(B.compound_rates(read_rates(_rates(t), date(2000, 1, 1), date(2100, 1, 1))))


@query("w3_compound_closes", f"WITH {_ALL_CLOSES}, {_INDEX} SELECT {_PANEL} FROM ibov")
def w3(t: Tables) -> DataFrame:
    return edge(B.compound_closes(_all_closes(t)))


@query("w3_daily_variation", f"""WITH {_ALL_CLOSES} SELECT serie, {text('data')} AS data,
    {r('coalesce(valor / lag(valor) OVER (ORDER BY data) - 1, 0.0)')} AS valor FROM k""")
def w3_daily(t: Tables) -> DataFrame:
    return edge(B.daily_variation(_all_closes(t)))


@query("t5_date_windows", f"""WITH RECURSIVE f AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS inicio,
    CAST(max(o_orderdate) AS DATE) AS fim FROM orders GROUP BY 1),
    w AS (SELECT o_custkey, fim, 0 AS janela, inicio AS de FROM f
          UNION ALL SELECT o_custkey, fim, janela + 1, CAST(de + INTERVAL 2 YEAR AS DATE) FROM w
          WHERE CAST(de + INTERVAL 2 YEAR AS DATE) <= fim)
    SELECT o_custkey, janela, {text('de')} AS de,
           {text('least(fim, CAST(de + INTERVAL 2 YEAR AS DATE) - 1)')} AS ate FROM w""")
def t5(t: Tables) -> DataFrame:
    ranges = t.orders.groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("inicio"),
                                               F.max(F.to_date("o_orderdate")).alias("fim"))
    return edge(B.date_windows(ranges, years=2).select("o_custkey", "janela", "de", "ate"))


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("j5_align_on_date", f"""WITH {P_PRIO}, w AS (SELECT data, {", ".join(f"max(valor) FILTER (serie = '{s}') AS prioridade_{s[0]}" for s in _PRIORITIES)}
    FROM p GROUP BY data), {_ALL_CLOSES}, {_INDEX}
    SELECT {text('data')} AS data, {", ".join(f"w.prioridade_{s[0]}" for s in _PRIORITIES)}, ibov.valor AS indice FROM w FULL JOIN ibov USING (data)""")
def j5(t: Tables) -> DataFrame:
    wide = t.prio().groupBy("data").pivot("serie", list(_PRIORITIES)).agg(F.first("valor"))
    wide = wide.withColumnsRenamed({s: f"prioridade_{s[0]}" for s in _PRIORITIES})
    return edge(B.align_on_date(wide, B.compound_closes(_all_closes(t)), "indice"), None)


_OWN_RANGE = """k AS (SELECT 'Benchmark: Ibovespa' AS serie, CAST(o_orderdate AS DATE) AS data, arg_max(o_totalprice, o_orderkey) AS valor
    FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN (SELECT min(data) FROM c) AND (SELECT max(data) FROM c) GROUP BY 2)"""


@query("f2_performance_with_benchmark", f"""WITH {P_PRIO}, {COMMON}, {_BASE}, {_OWN_RANGE}, {_INDEX},
    u AS (SELECT * FROM b UNION ALL SELECT * FROM ibov)
    SELECT serie, {text('data')} AS data, {r('valor / 100 - 1')} AS valor FROM u""")
def f2(t: Tables) -> DataFrame:
    """The benchmark is asked for the panel's own first to last date (no date at all leaves both empty)."""
    panel = _common(t.prio())
    ends = panel.agg(F.min("data").alias("de"), F.max("data").alias("ate")).first()
    bench = B.compound_closes(read_closes(_closes(t), ends["de"], ends["ate"])) if ends["de"] else None
    shown, _ = B.with_benchmark(R.rebase100(panel), bench)
    return edge(R.cumulative_return(shown))


# The plans a user calls, on the monthly panel; two funds have one name.
_NAMES = """nm AS (SELECT DISTINCT l_returnflag || l_linestatus AS serie, CASE WHEN l_returnflag = 'N' THEN 'Fundo N'
    ELSE 'Fundo ' || l_returnflag || l_linestatus END AS nome FROM lineitem)"""
_PLAN_SQL = f"""WITH {P_MONTH}, {COMMON}, {_BASE}, {_NAMES}, {_OWN_RANGE}, {_INDEX},
    u AS (SELECT serie, data, valor FROM b UNION ALL SELECT serie, data, valor FROM ibov)"""
_SPAN = (date(1900, 1, 1), date(2200, 1, 1))


def _quotes(t: Tables) -> tuple[DataFrame, DataFrame, list[str]]:
    month = t.month()
    kinds = t.lineitem.select("l_returnflag", F.concat("l_returnflag", "l_linestatus").alias("cnpj")).distinct()
    register = kinds.select("cnpj", F.concat(F.lit("Fundo "), F.when(F.col("l_returnflag") == "N", F.lit("N")).otherwise(F.col("cnpj"))).alias("nome"))
    funds = [x["cnpj"] for x in register.orderBy("cnpj").collect()]  # bounded by flag and status
    return month.select(F.col("serie").alias("cnpj"), "data", F.col("valor").alias("valor_cota")), register, funds


def _performance(t: Tables, choice: str) -> Performance:
    quotes, register, funds = _quotes(t)
    return fund_performance(quotes, register, funds, *_SPAN, choice, {"Ibovespa": lambda: _closes(t)})


@query("f1_plan", f"""{_PLAN_SQL} SELECT serie, nome, {text('data')} AS data, {r('valor / 100 - 1')} AS valor FROM b JOIN nm USING (serie)""")
def f1_plan(t: Tables) -> DataFrame:
    return edge(_performance(t, "Nenhum").curves.select("serie", "nome", "data", "valor"))


@query("f2_plan", f"""{_PLAN_SQL} SELECT serie, coalesce(nome, serie) AS nome, {text('data')} AS data, {r('valor / 100 - 1')} AS valor
    FROM u LEFT JOIN nm USING (serie)""")
def f2_plan(t: Tables) -> DataFrame:
    return edge(_performance(t, "Ibovespa").curves.select("serie", "nome", "data", "valor"))


@query("f3_plan", f"""{_PLAN_SQL} SELECT serie, coalesce(any_value(nome), serie) AS nome, {text('min(data)')} AS inicio_efetivo,
    {text('max(data)')} AS fim_efetivo, {r('arg_max(valor, data) / 100 - 1')} AS rentabilidade FROM u LEFT JOIN nm USING (serie) GROUP BY serie""")
def f3_plan(t: Tables) -> DataFrame:
    return edge(_performance(t, "Ibovespa").summary.select("serie", "nome", "inicio_efetivo", "fim_efetivo", "rentabilidade"))


@query("f4_plan", f"""{_PLAN_SQL}, pc AS (SELECT serie, row_number() OVER (ORDER BY serie) AS i, COUNT(*) OVER () AS n FROM nm),
    w AS (SELECT serie, i * 2.0 / (n * (n + 1)) AS peso FROM pc),
    h AS (SELECT serie, data, peso * valor / 100 AS posicao FROM b JOIN w USING (serie)),
    t AS (SELECT data, sum(posicao) AS total FROM h GROUP BY 1),
    d AS (SELECT data, sum(peso * (valor / antes - 1)) AS ret FROM (SELECT serie, data, valor, lag(valor) OVER (PARTITION BY serie ORDER BY data)
          AS antes FROM c) JOIN w USING (serie) WHERE antes IS NOT NULL GROUP BY 1)
    SELECT nome AS fundo, {r('posicao / total')} AS alocacao, {text('(SELECT min(data) FROM t)')} AS inicio_efetivo,
           {text('(SELECT max(data) FROM t)')} AS fim_efetivo,
           {r('(SELECT arg_max(total, data) / arg_min(total, data) - 1 FROM t)')} AS rentabilidade,
           {r('(SELECT arg_max(valor, data) / 100 - 1 FROM ibov)')} AS indice, {r('(SELECT avg(ret) * 252 FROM d)')} AS retorno,
           {r('(SELECT sqrt(var_samp(ret) * 252) FROM d)')} AS risco
    FROM h JOIN t USING (data) JOIN nm USING (serie) WHERE data = (SELECT max(data) FROM t)""")
def f4_plan(t: Tables) -> DataFrame:
    """The portfolio page: final allocation by name beside the portfolio's and the benchmark's figures."""
    quotes, register, funds = _quotes(t)
    total = sum(range(1, len(funds) + 1))
    parts = t.spark.createDataFrame([(f, 100.0 * (i + 1) / total) for i, f in enumerate(funds)], "serie string, percentual double")
    page = portfolio_page(quotes, register, parts, *_SPAN, "Ibovespa", {"Ibovespa": lambda: _closes(t)})
    own = page.summary.where(F.col("serie") == OWN).select("inicio_efetivo", "fim_efetivo", "rentabilidade")
    index = page.summary.where(F.col("serie") != OWN).select(F.col("rentabilidade").alias("indice"))
    figures = {c: scalar(f, c) for f in (own, index, page.own_point) for c in f.columns}
    return edge(page.allocation.select("fundo", "alocacao", *[v.alias(k) for k, v in figures.items()]))
