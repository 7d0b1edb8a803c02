"""Panels: one row per (series, date). Common dates, missing series, pivot and melt, names.

``by`` names columns that split a frame into independent panels (for example one per portfolio).

Sizes: a panel holds at most one row per series and date, so a window over one series, or a table with one row
per date, is bounded by the calendar (about 10,000 days since 2000), however large the table is. Only such
tables get a broadcast hint; every other side is left to the optimiser's size check and adaptive skew handling.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def series_window(by: Sequence[str] = (), *, key: str = "serie"):
    """Rows of one series in date order (bounded by the calendar)."""
    return Window.partitionBy(*by, key).orderBy("data")


def scalar(df: DataFrame, column: str) -> Column:
    """The single value of a one-row, one-column aggregate as an expression (uncorrelated scalar subquery)."""
    return df.select(column).scalar()


def attach(df: DataFrame, totals: DataFrame, by: Sequence[str], *columns: str) -> DataFrame:
    """Add group totals to every row: an equi-join per group, or scalar subqueries for one global group."""
    if by:
        return df.join(totals.select(*by, *columns), list(by))
    return df.select("*", *[scalar(totals, c).alias(c) for c in columns])


OR_TERMS = 200  # values up to which a list is a disjunction of equalities, which Parquet checks by dictionary and Bloom filter


def any_of(column: str, values: Sequence[str]) -> Column:
    """Membership in a list. A long IN reaches Parquet only as the range from its least to its greatest value."""
    terms = [F.col(column) == v for v in dict.fromkeys(values)]
    if not 0 < len(terms) <= OR_TERMS:
        return F.col(column).isin(list(values))
    while len(terms) > 1:  # a balanced tree, not a chain
        terms = [a | b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) - len(terms) % 2:]
    return terms[0]


def quote_scan(quotes: DataFrame, funds: Sequence[str], start, end) -> DataFrame:
    """Quotes of the listed funds inside the inclusive date range. Both filters reach the file scan."""
    return (quotes.where(any_of("cnpj", funds) & F.col("data").between(F.lit(start), F.lit(end)))
            .select("data", "cnpj", "valor_cota"))


def load_panel(quotes: DataFrame, funds: Sequence[str] | DataFrame, start, end, *, common: bool = True,
               series_key: Sequence[str] = ("cnpj",)) -> DataFrame:
    """Panel of the requested funds; ``common`` keeps the dates on which every requested fund has a quote.

    Two quotes of one series on one date (two subclasses under one fund) are an error raised by the job itself.
    Copies of a series and date are reduced before they are shuffled.
    """
    keep = F.col("data").between(F.lit(start), F.lit(end))
    if isinstance(funds, DataFrame):
        chosen = quotes.where(keep).join(funds.select("cnpj").distinct(), "cnpj", "left_semi")
        wanted = scalar(funds.agg(F.countDistinct("cnpj").alias("n")), "n")
    else:
        chosen = quotes.where(keep & any_of("cnpj", funds))
        wanted = len(set(funds))
    keys = [F.col(c) for c in series_key]
    key = keys[0] if len(keys) == 1 else F.concat_ws("|", *keys)
    panel = unique_panel(chosen.select(key.alias("serie"), "data", F.col("valor_cota").alias("valor")))
    if not common:
        return panel
    if tuple(series_key) != ("cnpj",):
        there = chosen.agg(F.countDistinct("cnpj").alias("fundos"), F.countDistinct(key).alias("series"))
        # Null, hence no date, unless every requested fund occurs.
        wanted = scalar(there.select(F.when(F.col("fundos") == wanted, F.col("series")).alias("n")), "n")
    return common_dates(panel, wanted)


def unique_panel(rows: DataFrame) -> DataFrame:
    """Same rows, failing the job when a series has two values on one date."""
    clash = F.raise_error(F.concat(F.lit("Two quotes for one series and date: "), F.col("serie"), F.lit(" "),
                                   F.col("data").cast("string")))
    return (rows.groupBy("serie", "data")
            .agg(F.count(F.lit(1)).alias("_n"), F.first("valor").alias("valor"))
            .select("serie", "data", F.when(F.col("_n") > 1, clash).otherwise(F.col("valor")).alias("valor")))


def common_dates(panel: DataFrame, wanted: Column | int, by: Sequence[str] = ()) -> DataFrame:
    """Rows on dates where all ``wanted`` series have a value; a series without data empties the result.

    Counting the values (not rows) keeps both branches on the same columns, so their exchange is reused.
    """
    full = (panel.groupBy(*by, "data").agg(F.count("valor").alias("_n"))
            .where(F.col("_n") == wanted).select(*by, "data"))
    if not by:
        full = F.broadcast(full)  # one row per calendar date
    return panel.join(full, [*by, "data"], "left_semi")


def common_dates_per_group(panel: DataFrame, members: DataFrame, by: Sequence[str]) -> DataFrame:
    """Common dates of many panels at once; ``members`` lists the requested series of each."""
    sizes = members.groupBy(*by).agg(F.countDistinct("serie").alias("_wanted"))
    full = (panel.groupBy(*by, "data").agg(F.count("valor").alias("_n"))
            .join(sizes, list(by)).where(F.col("_n") == F.col("_wanted")).select(*by, "data"))
    return panel.join(full, [*by, "data"], "left_semi")


def missing_series(panel: DataFrame, funds: DataFrame) -> DataFrame:
    """Requested series with no value in the panel."""
    return funds.select("serie").distinct().join(panel.where("valor IS NOT NULL"), "serie", "left_anti")


def enough_dates(panel: DataFrame, least: int = 2) -> DataFrame:
    """One row: number of dates and whether the window has enough of them."""
    return (panel.select("data").distinct().agg(F.count(F.lit(1)).alias("datas"))
            .select("datas", (F.col("datas") >= least).alias("suficiente")))


def to_wide(panel: DataFrame, funds: Sequence[str]) -> DataFrame:
    """One column per requested series, in that order; a series without data is an all-null column."""
    return panel.groupBy("data").pivot("serie", list(funds)).agg(F.first("valor"))


def to_long(wide: DataFrame, funds: Sequence[str]) -> DataFrame:
    """One row per date and series, missing values included (plot layout)."""
    return wide.unpivot("data", list(funds), "serie", "valor")


def with_names(df: DataFrame, names: DataFrame, key: str = "serie") -> DataFrame:
    """Add ``nome`` from a (cnpj, nome) register; the key itself stands in for an unknown name."""
    lookup = names.select(F.col("cnpj").alias(key), "nome")
    return df.join(lookup, key, "left").withColumn("nome", F.coalesce("nome", key))


def date_limits(quotes: DataFrame, column: str = "data") -> DataFrame:
    """First and last date. No dates at all is an error of the job."""
    empty = F.raise_error(F.lit("The table has no daily quotes."))
    return (quotes.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
            .select(F.when(F.col("_a").isNull(), empty).otherwise(F.col("_a")).alias("inicio"),
                    F.col("_b").alias("fim")))
