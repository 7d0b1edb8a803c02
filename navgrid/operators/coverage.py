"""Coverage control: what the quote table holds for every registered fund."""

from pyspark.sql import DataFrame, functions as F

from navgrid.functions import status
from navgrid.schema import STATUS_EMPTY


def held_by_fund(quotes: DataFrame) -> DataFrame:
    """First and last date and row count per fund. Such rows of parts of the quotes merge by minimum, maximum and sum."""
    return quotes.groupBy("cnpj").agg(
        F.min("data").alias("primeira"), F.max("data").alias("ultima"), F.count("data").alias("linhas"))


def covered(register: DataFrame, held: DataFrame) -> DataFrame:
    """First and last date, row count and status per registered fund, from what is held per fund."""
    total = F.coalesce("linhas", F.lit(0))
    return register.select("cnpj", "nome").join(held.hint("merge"), "cnpj", "left").select(
        "cnpj", "nome", F.col("primeira").alias("primeira_data_disponivel"), F.col("ultima").alias("ultima_data_disponivel"),
        total.cast("bigint").alias("quantidade_registros"), status(total).alias("status"))


def coverage(register: DataFrame, quotes: DataFrame) -> DataFrame:
    """First and last date, row count and status per registered fund.

    Quotes are reduced per fund before the join, so the fact table is shuffled as partial aggregates only.
    ``Store.coverage`` has the same from the store's index, without the quotes.
    """
    return covered(register, held_by_fund(quotes))


def fund_list(cov: DataFrame) -> DataFrame:
    return cov.orderBy("nome", "cnpj")


def load_summary(cov: DataFrame) -> DataFrame:
    return cov.agg(
        F.count(F.lit(1)).alias("fundos"), F.count("primeira_data_disponivel").alias("fundos_com_dados"),
        F.sum("quantidade_registros").alias("registros"), F.min("primeira_data_disponivel").alias("primeira_data"),
        F.max("ultima_data_disponivel").alias("ultima_data"))


def without_data(cov: DataFrame) -> DataFrame:
    return cov.where(F.col("status") == STATUS_EMPTY).select("cnpj", "nome").orderBy("nome", "cnpj")
