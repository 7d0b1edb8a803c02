"""Keyed tables, coverage and file selection on the driver tables."""

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from navgrid.functions import overlaps
from navgrid.operators import coverage as C, tables as K
from navgrid.operators.panel import date_limits
from navgrid.plans.load import ledger_error, ledger_ok
from navgrid.queries.common import P_NATION, Tables, cents, edge, query, r, text
from navgrid.sources.catalog import catalog_rows

_QUOTES_SQL = """q AS (SELECT 'C' || o_custkey AS cnpj, CAST(o_orderdate AS DATE) AS data FROM orders),
    f AS (SELECT 'C' || c_custkey AS cnpj, c_name AS nome FROM customer
          UNION ALL SELECT 'S' || s_suppkey, s_name FROM supplier),
    v AS (SELECT f.cnpj, f.nome, MIN(q.data) AS primeira_data_disponivel, MAX(q.data) AS ultima_data_disponivel,
                 COUNT(q.data) AS quantidade_registros,
                 CASE WHEN COUNT(q.data) = 0 THEN 'SEM DADOS' ELSE 'OK' END AS status
          FROM f LEFT JOIN q USING (cnpj) GROUP BY f.cnpj, f.nome)"""


def _coverage(t: Tables) -> DataFrame:
    """Customers and suppliers as register, orders as quotes: suppliers have none."""
    quotes = t.orders.select(F.concat(F.lit("C"), "o_custkey").alias("cnpj"), F.to_date("o_orderdate").alias("data"))
    register = t.customer.select(F.concat(F.lit("C"), "c_custkey").alias("cnpj"), F.col("c_name").alias("nome"))
    return C.coverage(register.unionByName(t.supplier.select(
        F.concat(F.lit("S"), "s_suppkey").alias("cnpj"), F.col("s_name").alias("nome"))), quotes)


@query("a1_coverage", f"""WITH {_QUOTES_SQL} SELECT cnpj, nome, {text('primeira_data_disponivel')}
    AS primeira_data_disponivel, {text('ultima_data_disponivel')} AS ultima_data_disponivel, quantidade_registros,
    status FROM v""")
def a1(t: Tables) -> DataFrame:
    return edge(_coverage(t))


@query("a2_load_summary", f"""WITH {_QUOTES_SQL} SELECT COUNT(*) AS fundos,
    COUNT(primeira_data_disponivel) AS fundos_com_dados, CAST(SUM(quantidade_registros) AS BIGINT) AS registros,
    {text('MIN(primeira_data_disponivel)')} AS primeira_data, {text('MAX(ultima_data_disponivel)')} AS ultima_data
    FROM v""")
def a2(t: Tables) -> DataFrame:
    return edge(C.load_summary(_coverage(t)))


@query("a3_without_data", f"WITH {_QUOTES_SQL} SELECT cnpj, nome FROM v WHERE status = 'SEM DADOS' ORDER BY nome")
def a3(t: Tables) -> DataFrame:
    return C.without_data(_coverage(t))


@query("a4_date_limits", f"SELECT {text('MIN(CAST(l_shipdate AS DATE))')} AS inicio, "
                         f"{text('MAX(CAST(l_shipdate AS DATE))')} AS fim FROM lineitem")
def a4(t: Tables) -> DataFrame:
    return edge(date_limits(t.lineitem.select(F.to_date("l_shipdate").alias("data"))))


@query("s6_fund_list", f"""WITH {P_NATION} SELECT CAST(n_nationkey AS VARCHAR) AS cnpj, n_name AS nome,
    {text('MIN(data)')} AS primeira_data_disponivel, {text('MAX(data)')} AS ultima_data_disponivel,
    COUNT(data) AS quantidade_registros, CASE WHEN COUNT(data) = 0 THEN 'SEM DADOS' ELSE 'OK' END AS status
    FROM nation LEFT JOIN p ON p.serie = CAST(n_nationkey AS VARCHAR) GROUP BY 1, 2 ORDER BY nome""")
def s6(t: Tables) -> DataFrame:
    register = t.nation.select(F.col("n_nationkey").cast("string").alias("cnpj"), F.col("n_name").alias("nome"))
    return edge(C.fund_list(C.coverage(register, t.nation_day().withColumnRenamed("serie", "cnpj"))))


# Orders as quote rows: fund = customer, date = month, file = year of the order, line = order key.
_ROWS_SQL = """o AS (SELECT CAST(o_custkey AS VARCHAR) AS cnpj, CAST(date_trunc('month', o_orderdate) AS DATE) AS data,
    CAST(round(o_totalprice * 100) AS BIGINT) AS centavos, 'inf_diario_fi_' || year(o_orderdate) || '.zip'
    AS arquivo_origem, o_orderkey AS linha, o_orderstatus AS s FROM orders),
    last_of AS (SELECT cnpj, data, arg_max(centavos, linha) AS centavos, arg_max(arquivo_origem, linha) AS arquivo_origem,
                max(linha) AS linha FROM o WHERE s <> 'P' GROUP BY 1, 2),
    fresh AS (SELECT cnpj, data, arg_max(centavos, linha) AS centavos, arg_max(arquivo_origem, linha) AS arquivo_origem,
                max(linha) AS linha FROM o WHERE s = 'P' GROUP BY 1, 2)"""
_KEYS = ["cnpj", "data"]


def _rows(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_custkey").cast("string").alias("cnpj"), F.trunc("o_orderdate", "month").alias("data"),
        cents("o_totalprice").alias("centavos"),
        F.concat(F.lit("inf_diario_fi_"), F.year("o_orderdate"), F.lit(".zip")).alias("arquivo_origem"),
        F.col("o_orderkey").alias("linha"), F.col("o_orderstatus").alias("s"))


def _loads(t: Tables) -> tuple[DataFrame, DataFrame]:
    """First load: settled orders, one row per key. Second load: the partial ones."""
    rows = _rows(t)
    first, second = (rows.where(F.col("s") != "P").drop("s"), rows.where(F.col("s") == "P").drop("s"))
    return K.keep_last(first, _KEYS, ["linha"]), second


_OUT = "cnpj, CAST(data AS VARCHAR) AS data, centavos, arquivo_origem, linha"


@query("w9_keep_last", f"WITH {_ROWS_SQL} SELECT {_OUT} FROM last_of")
def w9(t: Tables) -> DataFrame:
    return edge(_loads(t)[0])


@query("w9_keep_first", f"""WITH {_ROWS_SQL} SELECT cnpj, CAST(data AS VARCHAR) AS data, arg_min(centavos, linha)
    AS centavos, min(linha) AS linha FROM o GROUP BY 1, 2""")
def w9_first(t: Tables) -> DataFrame:
    return edge(K.keep_last(_rows(t).select("cnpj", "data", "centavos", "linha"), _KEYS, ["linha"], keep="first"))


@query("u1_upsert", f"""WITH {_ROWS_SQL} SELECT {_OUT} FROM fresh UNION ALL
    SELECT {_OUT} FROM last_of ANTI JOIN fresh USING (cnpj, data)""")
def u1(t: Tables) -> DataFrame:
    current, new = _loads(t)
    return edge(K.upsert(current, new, _KEYS, ["linha"]))


@query("u2_replace_by_source", f"""WITH {_ROWS_SQL}, again AS (SELECT * FROM fresh WHERE data >= DATE '1998-01-01')
    SELECT {_OUT} FROM again UNION ALL
    SELECT {_OUT} FROM last_of ANTI JOIN again USING (cnpj, data)
    WHERE arquivo_origem NOT IN (SELECT DISTINCT arquivo_origem FROM o WHERE data >= DATE '1998-01-01')""")
def u2(t: Tables) -> DataFrame:
    """Files from 1998 on come again and now hold only the partial orders."""
    current, new = _loads(t)
    recent = F.col("data") >= F.lit("1998-01-01").cast("date")
    sources = _rows(t).where(recent).select("arquivo_origem")
    return edge(K.replace_by_source(current, new.where(recent), sources, _KEYS, ["linha"]))


@query("u3_sync_register", """
    SELECT CAST(n_nationkey AS VARCHAR) AS cnpj, n_name AS nome, '2026-01-05 10:00:00' AS atualizado_em FROM nation
    WHERE n_regionkey <> 3
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, '2026-01-04 10:00:00' FROM supplier
    WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation)""")
def u3(t: Tables) -> DataFrame:
    """Suppliers are the old register, nations the new list; the funds of one region are excluded."""
    old = t.supplier.select(F.col("s_suppkey").cast("string").alias("cnpj"), F.col("s_name").alias("nome"),
                            F.lit(datetime(2026, 1, 4, 10)).alias("atualizado_em"))
    new = t.nation.select(F.col("n_nationkey").cast("string").alias("cnpj"), F.col("n_name").alias("nome"),
                          F.lit(datetime(2026, 1, 5, 10)).alias("atualizado_em"))
    excluded = [str(row[0]) for row in t.nation.where("n_regionkey = 3").select("n_nationkey").collect()]
    return edge(K.sync_register(old, old.select("cnpj"), new, excluded)[0])


@query("j3_exclude_quotes", f"""WITH {P_NATION} SELECT serie AS cnpj, {text('data')} AS data, valor AS valor_cota
    FROM p WHERE serie NOT IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 3)""")
def j3(t: Tables) -> DataFrame:
    excluded = [str(row[0]) for row in t.nation.where("n_regionkey = 3").select("n_nationkey").collect()]
    return edge(K.without_keys(t.nation_day().toDF("cnpj", "data", "valor_cota"), excluded), None)


@query("j2_wanted_rows", """
    SELECT o_custkey, COUNT(*) AS linhas FROM orders WHERE o_custkey IN
    (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1""")
def j2(t: Tables) -> DataFrame:
    wanted = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(wanted, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("linhas"))


@query("a8_rows_per_file", f"WITH {_ROWS_SQL} SELECT arquivo_origem, COUNT(*) AS linhas FROM o GROUP BY 1")
def a8(t: Tables) -> DataFrame:
    return K.rows_per_source(_rows(t))


# Archive listing made from the order dates: one monthly file per month, one yearly file per year.
_CATALOG_SQL = """cat AS (
    SELECT DISTINCT 'inf_diario_fi_' || strftime(o_orderdate, '%Y%m') || '.zip' AS arquivo,
           strftime(o_orderdate, '%Y-%m') AS periodo_inicial, strftime(o_orderdate, '%Y-%m') AS periodo_final,
           true AS mensal FROM orders
    UNION ALL SELECT DISTINCT 'inf_diario_fi_' || year(o_orderdate) || '.zip', year(o_orderdate) || '-01',
           year(o_orderdate) || '-12', false FROM orders),
    led AS (SELECT DISTINCT 'inf_diario_fi_' || strftime(o_orderdate, '%Y%m') || '.zip' AS arquivo,
            CASE WHEN month(o_orderdate) <= 6 THEN 'OK' ELSE 'ERRO' END AS status FROM orders)"""


def _listing(t: Tables, fmt: str) -> DataFrame:
    name = F.concat(F.lit("file:/dados/inf_diario_fi_"), F.date_format("o_orderdate", fmt), F.lit(".zip"))
    return t.orders.select(name.alias("path")).distinct()


def _catalog(t: Tables) -> DataFrame:
    noise = t.orders.select(F.concat(F.lit("file:/dados/outro_"), "o_orderstatus", F.lit(".zip")).alias("path"))
    monthly = catalog_rows(_listing(t, "yyyyMM").unionByName(noise).unionByName(_listing(t, "yyyy")), True)
    return catalog_rows(_listing(t, "yyyy"), False).unionByName(monthly)


def _ledger(t: Tables) -> DataFrame:
    name = F.concat(F.lit("inf_diario_fi_"), F.date_format("o_orderdate", "yyyyMM"), F.lit(".zip"))
    done = F.when(F.month("o_orderdate") <= 6, "OK").otherwise("ERRO")
    return t.orders.select(name.alias("arquivo"), done.alias("status")).distinct()


_CAT_COLUMNS = ["arquivo", "periodo_inicial", "periodo_final", "mensal"]


@query("s1_catalog", f"WITH {_CATALOG_SQL} SELECT {', '.join(_CAT_COLUMNS)} FROM cat")
def s1(t: Tables) -> DataFrame:
    return _catalog(t).select(*_CAT_COLUMNS)


@query("p14_period_overlap", f"""WITH {_CATALOG_SQL} SELECT {', '.join(_CAT_COLUMNS)} FROM cat
    WHERE periodo_final >= '1996-03' AND periodo_inicial <= '1999-08'""")
def p14(t: Tables) -> DataFrame:
    return _catalog(t).where(overlaps("periodo_inicial", "periodo_final", "1996-03", "1999-08")).select(*_CAT_COLUMNS)


_RECENT_SQL = "rec AS (SELECT arquivo FROM cat WHERE mensal ORDER BY periodo_inicial DESC, arquivo DESC LIMIT 2)"


@query("w8_recent_months", f"WITH {_CATALOG_SQL}, {_RECENT_SQL} SELECT arquivo FROM rec")
def w8(t: Tables) -> DataFrame:
    return K.most_recent(_catalog(t), 2)


@query("u5_select_pending", f"""WITH {_CATALOG_SQL}, {_RECENT_SQL} SELECT {', '.join(_CAT_COLUMNS)},
    arquivo IN (SELECT arquivo FROM rec) AS recente FROM cat
    WHERE arquivo NOT IN (SELECT arquivo FROM led WHERE status = 'OK') OR arquivo IN (SELECT arquivo FROM rec)""")
def u5(t: Tables) -> DataFrame:
    return K.select_pending(_catalog(t), _ledger(t), recent=2).select(*_CAT_COLUMNS, "recente")


@query("j4_forced_files", f"""WITH {_CATALOG_SQL}, {_RECENT_SQL} SELECT {', '.join(_CAT_COLUMNS)},
    arquivo IN (SELECT arquivo FROM rec) AS recente FROM cat""")
def j4(t: Tables) -> DataFrame:
    return K.select_pending(_catalog(t), _ledger(t), force=True, recent=2).select(*_CAT_COLUMNS, "recente")


_LEDGER_SQL = """, n AS (SELECT 'inf_diario_fi_' || strftime(o_orderdate, '%Y%m') || '.zip' AS arquivo, COUNT(*) AS linhas
    FROM orders GROUP BY 1)"""


@query("s11_ledger_ok", f"""WITH {_CATALOG_SQL}{_LEDGER_SQL} SELECT arquivo, 'file:/dados/' || arquivo AS url,
    periodo_inicial, periodo_final, '2026-01-05 10:00:00' AS processado_em, coalesce(linhas, 0) AS linhas_inseridas,
    'OK' AS status, CAST(NULL AS VARCHAR) AS erro FROM cat LEFT JOIN n USING (arquivo)""")
def s11(t: Tables) -> DataFrame:
    counts = (t.orders.groupBy(F.concat(F.lit("inf_diario_fi_"), F.date_format("o_orderdate", "yyyyMM"), F.lit(".zip"))
                               .alias("arquivo")).agg(F.count(F.lit(1)).alias("linhas")))
    return edge(ledger_ok(_catalog(t), counts, datetime(2026, 1, 5, 10)))


@query("s12_ledger_error", f"""WITH {_CATALOG_SQL}, e AS (SELECT CASE WHEN status = 'ERRO' THEN arquivo END AS arquivo,
    repeat(arquivo || ' ', 120) AS erro FROM led)
    SELECT arquivo, 'file:/dados/' || arquivo AS url, periodo_inicial, periodo_final,
    '2026-01-05 10:00:00' AS processado_em, CAST(NULL AS BIGINT) AS linhas_inseridas, 'ERRO' AS status,
    substring(erro, 1, 2000) AS erro FROM cat JOIN e USING (arquivo)""")
def s12(t: Tables) -> DataFrame:
    errors = (_ledger(t).where("status = 'ERRO'")
              .select("arquivo", F.repeat(F.concat("arquivo", F.lit(" ")), 120).alias("erro")))
    return edge(ledger_error(_catalog(t), errors, datetime(2026, 1, 5, 10)))
