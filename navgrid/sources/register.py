"""Fund register: a CSV or Parquet sheet with Nome and CNPJ columns."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from navgrid.functions import normalise_id, trim_all
from navgrid.operators.report import refuse
from navgrid.operators.tables import without_keys
from navgrid.schema import EXCLUDED_IDS
from navgrid.session import materialise


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The sheet as (Nome, CNPJ, linha); header names are trimmed.

    ``linha`` is text: the line of a CSV file, which counts from 2 below the header, or the file and row of a Parquet
    sheet. A CSV file is read as a whole in one task (it may have line breaks inside quotes), so its rows number
    without gaps; a folder of them numbers each file by its own name.
    """
    parquet = path.lower().endswith(".parquet")
    if parquet:
        raw = spark.read.parquet(path)
    else:
        raw = spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=True)
    sheet = raw.select(*[F.col(f"`{c}`").alias(c.strip()) for c in raw.columns], F.col("_metadata.file_name").alias("_arquivo"),
                       F.monotonically_increasing_id().alias("_id"))
    lacking = {"Nome", "CNPJ"} - set(sheet.columns)
    if lacking:
        raise ValueError("The sheet lacks the columns: " + ", ".join(sorted(lacking)))
    sheet = materialise(sheet.select("Nome", "CNPJ", "_arquivo", "_id"))  # numbers of one scan: another may split the files otherwise
    firsts = sheet.groupBy("_arquivo").agg(F.min("_id").alias("_primeira"))
    several = firsts.limit(2).count() > 1
    line = (F.col("_id") - F.col("_primeira") + (1 if parquet else 2)).cast("string")
    line = F.concat("_arquivo", F.lit(":"), line) if parquet or several else line
    return (sheet.join(F.broadcast(firsts), "_arquivo").where("Nome IS NOT NULL OR CNPJ IS NOT NULL")
            .select("Nome", "CNPJ", line.alias("linha")))


def invalid_ids(sheet: DataFrame) -> DataFrame:
    """Lines whose identifier has no digits or too many."""
    return sheet.where(normalise_id("CNPJ").isNull()).select("linha", "Nome", "CNPJ")


def duplicate_ids(register: DataFrame) -> DataFrame:
    """Identifiers that occur more than once."""
    return register.groupBy("cnpj").agg(F.count(F.lit(1)).alias("vezes")).where("vezes > 1")


def clean_register(sheet: DataFrame) -> DataFrame:
    return sheet.select(normalise_id("CNPJ").alias("cnpj"), trim_all("Nome").alias("nome"))


def read_register(sheet: DataFrame, excluded: Iterable[str] = EXCLUDED_IDS) -> DataFrame:
    """Validated (cnpj, nome); an empty sheet, an invalid or a repeated identifier is an error (operators.report)."""
    if sheet.isEmpty():
        raise ValueError("The sheet has no funds.")
    refuse(invalid_ids(sheet), "Invalid identifier in line(s)", F.col("linha"), [F.col("linha").try_cast("long"), "linha"])
    register = clean_register(sheet)
    refuse(duplicate_ids(register), "Repeated identifiers", F.col("cnpj"), ["cnpj"])
    return without_keys(register, excluded)
