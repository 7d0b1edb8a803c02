"""Registry, table access and the panels built from the driver tables.

Values are summed in whole cents, so both engines add them exactly. Results leave with rounded doubles and dates
as text, which makes them comparable across engines.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

DIGITS = 6


@dataclass(frozen=True)
class Query:
    run: Callable
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable) -> Callable:
        REGISTRY[name] = Query(run, sql)
        return run
    return add


class Tables:
    """Driver tables and the panels over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def month(self) -> DataFrame:
        return _panel(self.lineitem, _flags(), F.trunc("l_shipdate", "month"), "l_extendedprice")

    def day(self) -> DataFrame:
        return _panel(self.lineitem, _flags(), F.to_date("l_shipdate"), "l_extendedprice")

    def prio(self) -> DataFrame:
        return _panel(self.orders, F.col("o_orderpriority"), F.to_date("o_orderdate"), "o_totalprice")

    def nation_day(self) -> DataFrame:
        rows = self.lineitem.join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        return _panel(rows, F.col("s_nationkey").cast("string"), F.to_date("l_shipdate"), "l_extendedprice")

    def supplier_month(self) -> DataFrame:
        """Monthly panel per supplier with portfolios of one nation's suppliers."""
        panel = _panel(self.lineitem, F.col("l_suppkey"), F.trunc("l_shipdate", "month"), "l_extendedprice")
        lookup = self.supplier.select(F.col("s_suppkey").alias("serie"),
                                      supplier_portfolio())
        return panel.join(lookup, "serie").withColumn("serie", F.col("serie").cast("string"))

    def suppliers(self) -> DataFrame:
        return self.supplier.select(supplier_portfolio(),
                                    F.col("s_suppkey").cast("string").alias("serie"))


def supplier_portfolio() -> Column:
    """A nation's suppliers of one key range: portfolios of bounded width whatever the table size."""
    return F.concat(F.col("s_nationkey").cast("string"), F.lit("-"), F.expr("cast(s_suppkey div 1000 as string)")).alias("carteira")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def _flags() -> Column:
    return F.concat("l_returnflag", "l_linestatus")


def _panel(rows: DataFrame, key: Column, day: Column, value: str) -> DataFrame:
    return (rows.groupBy(key.alias("serie"), day.alias("data"))
            .agg((F.sum(cents(value)).cast("double") / 100.0 / F.count(F.lit(1))).alias("valor")))


def edge(df: DataFrame, digits: int | None = DIGITS) -> DataFrame:
    """Round doubles (none when both engines run the very same operations) and write dates as text."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType) and digits is not None:
            c = F.round(c, digits) + 0.0
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        out.append(c.alias(field.name))
    return df.select(*out)


# --- SQL fragments -------------------------------------------------------------------------------------------

def r(expression: str, digits: int = DIGITS) -> str:
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0)"


def text(expression: str) -> str:
    return f"CAST({expression} AS VARCHAR)"


def _sql_panel(name: str, key: str, day: str, value: str, source: str) -> str:
    return (f"{name} AS (SELECT {key} AS serie, CAST({day} AS DATE) AS data, "
            f"CAST(SUM(CAST(round({value} * 100) AS BIGINT)) AS DOUBLE) / 100.0 / COUNT(*) AS valor "
            f"FROM {source} GROUP BY 1, 2)")


P_MONTH = _sql_panel("p", "l_returnflag || l_linestatus", "date_trunc('month', l_shipdate)", "l_extendedprice",
                     "lineitem")
P_DAY = _sql_panel("p", "l_returnflag || l_linestatus", "l_shipdate", "l_extendedprice", "lineitem")
P_PRIO = _sql_panel("p", "o_orderpriority", "o_orderdate", "o_totalprice", "orders")
P_NATION = _sql_panel("p", "CAST(s_nationkey AS VARCHAR)", "l_shipdate", "l_extendedprice",
                      "lineitem JOIN supplier ON l_suppkey = s_suppkey")
P_SUPPLIER = (_sql_panel("sp", "l_suppkey", "date_trunc('month', l_shipdate)", "l_extendedprice", "lineitem")
              + ", p AS (SELECT CAST(s_nationkey AS VARCHAR) || '-' || CAST(s_suppkey // 1000 AS VARCHAR) AS carteira, CAST(serie AS VARCHAR) AS serie, data, "
                "valor FROM sp JOIN supplier ON serie = s_suppkey)")

# Common dates of one panel (c), of a panel per portfolio (c), and simple returns over them (ret).
COMMON = ("c AS (SELECT * FROM p WHERE data IN (SELECT data FROM p GROUP BY data "
          "HAVING COUNT(*) = (SELECT COUNT(DISTINCT serie) FROM p)))")
COMMON_BY = ("c AS (SELECT p.* FROM p JOIN (SELECT carteira, data FROM p JOIN "
             "(SELECT CAST(s_nationkey AS VARCHAR) || '-' || CAST(s_suppkey // 1000 AS VARCHAR) AS carteira, COUNT(*) AS n FROM supplier GROUP BY 1) z "
             "USING (carteira) GROUP BY carteira, data, n HAVING COUNT(*) = n) USING (carteira, data))")
RETURNS = ("ret AS (SELECT * FROM (SELECT serie, data, valor / lag(valor) OVER (PARTITION BY serie ORDER BY data) "
           "- 1 AS retorno FROM c) WHERE retorno IS NOT NULL)")
RETURNS_BY = ("ret AS (SELECT * FROM (SELECT carteira, serie, data, valor / lag(valor) OVER "
              "(PARTITION BY carteira, serie ORDER BY data) - 1 AS retorno FROM c) WHERE retorno IS NOT NULL)")
MEAN = "mu AS (SELECT serie, avg(retorno) * 252 AS media FROM ret GROUP BY serie)"
COV = ("sg AS (SELECT a.serie AS serie_i, b.serie AS serie_j, covar_samp(a.retorno, b.retorno) * 252 AS cov "
       "FROM ret a JOIN ret b USING (data) GROUP BY 1, 2)")
