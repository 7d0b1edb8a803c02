"""Keyed tables without MERGE: keep last, upsert, replace by source, register sync, file selection."""

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from navgrid.functions import overlaps
from navgrid.schema import EXCLUDED_IDS, RECENT_MONTHS, STATUS_OK


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per key, the last (or first) by ``order``.

    An aggregate and not a window: copies of a hot key are reduced before the shuffle.
    """
    rest = [c for c in rows.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    return (rows.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_linha"))
            .select(*[F.col(c) if c in keys else F.col(f"_linha.`{c}`").alias(c) for c in rows.columns]))


def upsert(current: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    """New rows take over the whole row of their key, source and timestamp included."""
    fresh = keep_last(new, keys, order, keep).select(*current.columns)
    # As many keys as new rows, whatever the size of the files that they come from: never gathered on the driver.
    return current.join(fresh.select(*keys).hint("merge"), list(keys), "left_anti").unionByName(fresh)


def replace_by_source(current: DataFrame, new: DataFrame, sources: DataFrame, keys: Sequence[str],
                      order: Sequence[str], source: str = "arquivo_origem", keep: str = "last") -> DataFrame:
    """Load a batch of files as if they were applied one after the other.

    Rows whose *current* source is one of the loaded files go, even when the file no longer has them; then the
    new rows are upserted in file order. ``sources`` lists the loaded files, also those without rows.
    """
    names = sources.select(source).distinct()
    return upsert(current.join(names, source, "left_anti").select(*current.columns), new, keys, order, keep)


def rows_per_source(rows: DataFrame, source: str = "arquivo_origem") -> DataFrame:
    """Rows read per file, counted before the reduction per key."""
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("linhas"))


def without_keys(df: DataFrame, keys: Iterable[str] = EXCLUDED_IDS, column: str = "cnpj") -> DataFrame:
    """Rows whose key is not in a short fixed list."""
    return df.where(~F.col(column).isin(list(keys)))


def sync_register(register: DataFrame, quotes: DataFrame, new: DataFrame,
                  excluded: Iterable[str] = EXCLUDED_IDS) -> tuple[DataFrame, DataFrame]:
    """Upsert the register and take the excluded funds out of it and out of the quotes.

    Funds that are missing from the new list stay.
    """
    merged = upsert(register, new, ["cnpj"], ["atualizado_em"])
    return without_keys(merged, excluded), without_keys(quotes, excluded)


def most_recent(catalog: DataFrame, n: int = RECENT_MONTHS) -> DataFrame:
    """The ``n`` latest monthly files of a list (top-n, no global window)."""
    return (catalog.where("mensal").orderBy(F.desc("periodo_inicial"), F.desc("arquivo")).limit(n)
            .select("arquivo"))


def select_pending(catalog: DataFrame, ledger: DataFrame, start: str | None = None, end: str | None = None,
                   force: bool = False, recent: int = RECENT_MONTHS) -> DataFrame:
    """Files of the period still to load: without an OK entry, or among the recent months, or all when forced."""
    inside = catalog.where(overlaps("periodo_inicial", "periodo_final", start, end))
    latest = most_recent(inside, recent).withColumn("recente", F.lit(True))
    marked = inside.join(latest, "arquivo", "left").withColumn("recente", F.coalesce("recente", F.lit(False)))
    if force:
        return marked
    done = ledger.where(F.col("status") == STATUS_OK).select("arquivo", F.lit(True).alias("_feito"))
    return (marked.join(done, "arquivo", "left")
            .where(F.col("_feito").isNull() | F.col("recente")).drop("_feito"))
