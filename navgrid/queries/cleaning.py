"""Column cleaning and coercion on the driver tables."""

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from navgrid import functions as N
from navgrid.operators.tables import without_keys
from navgrid.queries.common import Tables, cents, edge, query, r, text
from navgrid.schema import BENCHMARKS, EXCLUDED_IDS
from navgrid.sources.register import clean_register, duplicate_ids, invalid_ids

# Blanks that a plain trim leaves in place.
_WEIRD = "\t\u00a0 \u2003"
_SQL_WEIRD = "chr(9) || chr(160) || ' ' || chr(8195)"


@query("p3_normalise_id", """
    WITH d AS (SELECT page_id, regexp_replace(url, '[^0-9]', '', 'g') AS digits FROM pages)
    SELECT page_id, CASE WHEN length(digits) BETWEEN 1 AND 14 THEN lpad(digits, 14, '0') END AS cnpj FROM d""")
def normalise_id(t: Tables) -> DataFrame:
    return t.pages.select("page_id", N.normalise_id("url").alias("cnpj"))


@query("p4_trim_text", f"""
    SELECT conv_id, turn, length(c) AS tamanho, md5(c) AS conteudo FROM (
        SELECT conv_id, turn, trim({_SQL_WEIRD} || text || {_SQL_WEIRD}, {_SQL_WEIRD} || chr(10) || chr(13)) AS c
        FROM conversations)""")
def trim_text(t: Tables) -> DataFrame:
    padded = F.concat(F.lit(_WEIRD), "text", F.lit(_WEIRD))
    return (t.conversations.select("conv_id", "turn", N.trim_all(padded).alias("c"))
            .select("conv_id", "turn", F.length("c").cast("bigint").alias("tamanho"), F.md5("c").alias("conteudo")))


# Raw daily text rows made from the orders: the priority decides how the row is written.
_RAW_SQL = """raw AS (
    SELECT o_orderkey,
           'N. ' || o_custkey || '/' || o_orderstatus AS cnpj_bruto,
           CASE left(o_orderpriority, 1) WHEN '1' THEN NULL WHEN '2' THEN '  ' WHEN '3' THEN chr(9) || 'A ' ELSE 'B' END
               AS subclasse_bruta,
           CASE left(o_orderpriority, 1) WHEN '4' THEN strftime(o_orderdate, '%d/%m/%Y')
               ELSE strftime(o_orderdate, '%Y-%m-%d') END AS data_bruta,
           CASE o_orderstatus WHEN 'F' THEN (CASE left(o_orderpriority, 1) WHEN '1' THEN 'nan' WHEN '2' THEN '-1.5'
               WHEN '3' THEN '1d' WHEN '4' THEN '0x1p3' ELSE '1,5' END)
               ELSE ' ' || (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') END AS valor_bruto
    FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders))"""
_CLEAN_SQL = f"""WITH {_RAW_SQL}, typed AS (
    SELECT o_orderkey, lpad(regexp_replace(cnpj_bruto, '[^0-9]', '', 'g'), 14, '0') AS cnpj,
           coalesce(trim(subclasse_bruta, chr(9) || ' '), '') AS id_subclasse,
           CASE WHEN regexp_matches(data_bruta, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')
                THEN TRY_CAST(data_bruta AS DATE) END AS data,
           CASE WHEN regexp_matches(trim(valor_bruto), '^[+-]?[0-9]+([.][0-9]*)?$')
                THEN TRY_CAST(trim(valor_bruto) AS DOUBLE) END AS valor_cota FROM raw)"""


def _raw(t: Tables) -> DataFrame:
    kind = F.left("o_orderpriority", F.lit(1))
    amount = F.concat(F.lit(" "), F.expr("_c div 100").cast("string"), F.lit("."),
                      F.lpad(F.expr("_c % 100").cast("string"), 2, "0"))
    odd = (F.when(kind == "1", "nan").when(kind == "2", "-1.5").when(kind == "3", "1d")
           .when(kind == "4", "0x1p3").otherwise("1,5"))
    return t.orders.withColumn("_c", cents("o_totalprice")).select(
        "o_orderkey", F.concat(F.lit("N. "), "o_custkey", F.lit("/"), "o_orderstatus").alias("cnpj_bruto"),
        F.when(kind == "1", None).when(kind == "2", "  ").when(kind == "3", "\tA ").otherwise("B")
        .alias("subclasse_bruta"),
        F.when(kind == "4", F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("data_bruta"),
        F.when(F.col("o_orderstatus") == "F", odd).otherwise(amount).alias("valor_bruto"))


def _typed(t: Tables) -> DataFrame:
    return _raw(t).select(
        "o_orderkey", N.normalise_id("cnpj_bruto").alias("cnpj"), N.subclass_or_blank("subclasse_bruta").alias("id_subclasse"),
        N.to_day("data_bruta").alias("data"), N.to_double("valor_bruto").alias("valor_cota"))


@query("p5_subclass", _CLEAN_SQL + """
    SELECT id_subclasse, COUNT(*) AS linhas, COUNT(DISTINCT cnpj) AS fundos FROM typed GROUP BY id_subclasse""")
def subclass(t: Tables) -> DataFrame:
    return _typed(t).groupBy("id_subclasse").agg(F.count(F.lit(1)).alias("linhas"),
                                                 F.countDistinct("cnpj").alias("fundos"))


@query("p6_coerce_date", _CLEAN_SQL + f" SELECT o_orderkey, {text('data')} AS data FROM typed")
def coerce_date(t: Tables) -> DataFrame:
    return edge(_typed(t).select("o_orderkey", "data"))


@query("p7_coerce_number", _CLEAN_SQL + f" SELECT o_orderkey, {r('valor_cota')} AS valor_cota FROM typed")
def coerce_number(t: Tables) -> DataFrame:
    return edge(_typed(t).select("o_orderkey", "valor_cota"))


@query("p8_clean_daily", _CLEAN_SQL + f"""
    SELECT o_orderkey, cnpj, id_subclasse, {text('data')} AS data, {r('valor_cota')} AS valor_cota
    FROM typed WHERE data IS NOT NULL AND valor_cota > 0 AND NOT isnan(valor_cota)""")
def clean_daily(t: Tables) -> DataFrame:
    return edge(_typed(t).where(F.col("data").isNotNull() & N.positive("valor_cota")))


@query("p8_positive", """
    SELECT event_type, COUNT(*) AS linhas FROM (
        SELECT event_type, CASE event_type WHEN 'error' THEN CAST('nan' AS DOUBLE) WHEN 'click' THEN value
            ELSE value - 25 END AS v FROM events) WHERE NOT isnan(v) AND v > 0 GROUP BY event_type""")
def positive(t: Tables) -> DataFrame:
    v = (F.when(F.col("event_type") == "error", F.lit(float("nan"))).when(F.col("event_type") == "click", F.col("value"))
         .otherwise(F.col("value") - 25))
    return t.events.withColumn("v", v).where(N.positive("v")).groupBy("event_type").agg(F.count(F.lit(1)).alias("linhas"))


@query("p10_stamp", _CLEAN_SQL + """
    SELECT cnpj, id_subclasse, CAST(data AS VARCHAR) AS data, round(valor_cota, 6) + 0.0 AS valor_cota,
           'inf_diario_fi_' || strftime(data, '%Y%m') || '.zip' AS arquivo_origem,
           '2026-01-05 10:00:00' AS atualizado_em
    FROM typed WHERE data IS NOT NULL AND valor_cota > 0""")
def stamp(t: Tables) -> DataFrame:
    rows = _typed(t).where(F.col("data").isNotNull() & N.positive("valor_cota"))
    source = F.concat(F.lit("inf_diario_fi_"), F.date_format("data", "yyyyMM"), F.lit(".zip"))
    return edge(rows.select("cnpj", "id_subclasse", "data", "valor_cota", source.alias("arquivo_origem"),
                            F.lit(datetime(2026, 1, 5, 10)).alias("atualizado_em")))


def _sheet(t: Tables) -> DataFrame:
    """Customers as a register sheet; one segment has no usable identifiers."""
    key = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("sem registro")).otherwise(F.col("c_name"))
    return t.customer.select((F.col("c_custkey") + 2).alias("linha"), F.concat(F.lit(" "), "c_name").alias("Nome"),
                             key.alias("CNPJ"))


@query("p11_invalid_ids", """
    SELECT c_custkey + 2 AS linha, ' ' || c_name AS "Nome", 'sem registro' AS "CNPJ"
    FROM customer WHERE c_mktsegment = 'BUILDING'""")
def invalid(t: Tables) -> DataFrame:
    return invalid_ids(_sheet(t))


@query("p12_exclude_ids", f"""
    WITH f AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS cnpj, c_name AS nome FROM customer
               UNION ALL SELECT unnest([{', '.join(repr(e) for e in EXCLUDED_IDS)}]), 'fora')
    SELECT cnpj, nome FROM f WHERE nome <> 'fora'""")
def exclude(t: Tables) -> DataFrame:
    funds = t.customer.select(N.normalise_id(F.col("c_custkey")).alias("cnpj"), F.col("c_name").alias("nome"))
    outside = t.spark.createDataFrame([(e, "fora") for e in EXCLUDED_IDS], "cnpj string, nome string")
    return without_keys(funds.unionByName(outside))


@query("a7_duplicate_ids", """
    SELECT lpad(regexp_replace(p_brand, '[^0-9]', '', 'g'), 14, '0') AS cnpj, COUNT(*) AS vezes
    FROM part GROUP BY 1 HAVING COUNT(*) > 1""")
def duplicates(t: Tables) -> DataFrame:
    return duplicate_ids(clean_register(t.part.select(F.col("p_name").alias("Nome"), F.col("p_brand").alias("CNPJ"))))


@query("p15_valid_period", """
    WITH x AS (SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN strftime(o_orderdate, '%Y/%m')
                   WHEN '2' THEN strftime(o_orderdate, '%Y-') || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0')
                   ELSE strftime(o_orderdate, '%Y-%m') END AS periodo FROM orders)
    SELECT o_orderkey, regexp_matches(periodo, '^[0-9]{4}-[0-9]{2}$') AND left(periodo, 4) >= '2000'
           AND right(periodo, 2) BETWEEN '01' AND '12' AS valido FROM x""")
def period(t: Tables) -> DataFrame:
    kind = F.left("o_orderpriority", F.lit(1))
    value = (F.when(kind == "1", F.date_format("o_orderdate", "yyyy/MM"))
             .when(kind == "2", F.date_format("o_orderdate", "yyyy-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM")))
    return t.orders.select("o_orderkey", N.valid_period(value).alias("valido"))


@query("p16_day_first", """
    WITH x AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%m/%d/%Y')
                   ELSE strftime(o_orderdate, '%d/%m/%Y') END AS t FROM orders)
    SELECT o_orderkey, CAST(TRY_STRPTIME(t, '%d/%m/%Y')::DATE AS VARCHAR) AS data FROM x""")
def day_first(t: Tables) -> DataFrame:
    value = (F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "MM/dd/yyyy"))
             .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")))
    return edge(t.orders.select("o_orderkey", N.parse_day_first(value).alias("data")))


@query("p16_window_open", """
    SELECT o_orderkey, o_orderdate < o_orderdate + to_days(CAST(o_orderkey % 5 - 2 AS INTEGER)) AS aberta FROM orders""")
def window_open(t: Tables) -> DataFrame:
    end = F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 5 - 2).cast("int"))
    return t.orders.select("o_orderkey", N.window_is_open(F.to_date("o_orderdate"), end).alias("aberta"))


@query("p17_shorten", """
    SELECT doc_id, md5(CASE WHEN length(text) <= 62 THEN text ELSE substring(text, 1, 61) || '…' END) AS curto
    FROM documents""")
def shorten(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(N.shorten("text")).alias("curto"))


@query("p18_label", "SELECT s_suppkey, s_name || '  ·  ' || s_suppkey AS rotulo FROM supplier")
def label(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", N.label("s_name", F.col("s_suppkey").cast("string")).alias("rotulo"))


@query("t2_utc_day", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS data, COUNT(*) AS linhas FROM events GROUP BY 1")
def utc_day(t: Tables) -> DataFrame:
    return edge(t.events.groupBy(N.utc_day("ts").alias("data")).agg(F.count(F.lit(1)).alias("linhas")))


@query("t3_format_day", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS data FROM orders")
def format_day(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", N.format_day("o_orderdate").alias("data"))


@query("m12_benchmark_names", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Benchmark: CDI' WHEN 'O' THEN 'Benchmark: Ibovespa' END AS nome FROM orders""")
def benchmark_names(t: Tables) -> DataFrame:
    """The display name of a choice in every row; a choice that is none has no name."""
    names = F.create_map(*[F.lit(x) for k, v in BENCHMARKS.items() for x in (k, v[0])])
    choice = F.when(F.col("o_orderstatus") == "F", "CDI").when(F.col("o_orderstatus") == "O", "Ibovespa").otherwise("Nenhum")
    return t.orders.select("o_orderkey", F.try_element_at(names, choice).alias("nome"))
