"""Catalog of daily-quote archives, from the file listing alone."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from navgrid.schema import ARCHIVE_NAME


def catalog_rows(listing: DataFrame, monthly: bool) -> DataFrame:
    """Catalog of one directory listing (column ``path``).

    History holds whole years whatever the name says; the monthly directory accepts only names with a month.
    """
    name = F.substring_index("path", "/", -1)
    year, month = (F.regexp_extract("arquivo", ARCHIVE_NAME, i) for i in (1, 2))
    named = listing.select(name.alias("arquivo"), F.col("path").alias("url")).distinct()
    named = named.where(F.col("arquivo").rlike(ARCHIVE_NAME))
    if monthly:
        named = named.where(month != "")
        first = last = F.concat_ws("-", year, month)
    else:
        first, last = F.concat(year, F.lit("-01")), F.concat(year, F.lit("-12"))
    return named.select("arquivo", "url", first.alias("periodo_inicial"), last.alias("periodo_final"),
                        F.lit(monthly).alias("mensal"))


def catalog_order() -> list[str | Column]:
    """Load order: first period, name (a whole year sorts before its January), history before monthly."""
    return ["periodo_inicial", "arquivo", "mensal", "url"]


def source_catalog(spark: SparkSession, history: str | None, monthly: str | None) -> DataFrame:
    """All archives of both directories in load order; none at all is an error. File contents are not read."""
    parts = [catalog_rows(listing, is_monthly)
             for path, is_monthly in ((history, False), (monthly, True))
             if path and (listing := _listing(spark, path)) is not None]
    catalog = None
    for part in parts:
        catalog = part if catalog is None else catalog.unionByName(part)
    if catalog is None or catalog.isEmpty():
        raise RuntimeError("No daily-quote archives found.")
    return catalog.orderBy(*catalog_order())


def fingerprints(spark: SparkSession, history: str | None, monthly: str | None, salt: str = "") -> DataFrame:
    """(url, impressao) of every archive: a hash of address, size, time of change and ``salt``."""
    parts = [listing for path in (history, monthly) if path and (listing := _listing(spark, path)) is not None]
    listing = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    state = F.concat_ws("|", "path", "length", F.unix_micros("modificationTime"), F.lit(salt))
    return listing.select(F.col("path").alias("url"), F.sha2(state, 256).alias("impressao")).distinct()


def _listing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "length", "modificationTime")
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return None
        raise
