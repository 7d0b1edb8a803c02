"""Incremental load: catalog, selection, then per group of archives one Spark plan and one commit.

Parsed rows are kept under the fingerprint of their archive (address, size, time of change, funds asked for) until they
are committed, and the ledger names what is. So a load that stops, for whatever reason, opens only the rest when it
runs again.
"""

import re
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from navgrid.operators.coverage import load_summary, without_data
from navgrid.operators.tables import keep_last, select_pending, upsert, without_keys
from navgrid.schema import (
    ERROR_TEXT_LIMIT, EXCLUDED_IDS, LEDGER, QUOTE_KEY, QUOTES, RECENT_MONTHS, STATUS_ERROR, STATUS_OK,
)
from navgrid.sources.archives import BLOCK_ROWS, open_shared, parse_daily, read_archives
from navgrid.sources.catalog import catalog_order, fingerprints, source_catalog
from navgrid.sources.register import read_register, read_sheet
from navgrid.sources.store import Store, month_of

_ORDER = ["ordem", "membro_ix", "linha"]
_PARSED = "membro_ix int, linha long, cnpj string, id_subclasse string, data date, valor_cota double, erro string, impressao string"
_MARK = -2  # member number of the row that says a file was parsed to its end
GROUP = 100  # archives per commit


class LoadError(RuntimeError):
    """A file failed and the load was not told to go on; the files before it are committed."""


@dataclass
class LoadConfig:
    root: str
    sheet: str
    history: str | None = None
    monthly: str | None = None
    start: str | None = None
    end: str | None = None
    force: bool = False
    recent: int = RECENT_MONTHS
    continue_on_error: bool = False
    block_rows: int = BLOCK_ROWS
    group: int = GROUP
    keep: str = "last"
    now: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    opener: Callable = open_shared

    def check(self) -> None:
        for text in (self.start, self.end):
            if text is not None:
                check_period(text)
        if self.start and self.end and self.start > self.end:
            raise ValueError("The first month must not be after the last.")
        if self.recent < 0 or self.block_rows <= 0 or self.group <= 0:
            raise ValueError("Counts must be positive.")


def check_period(text: str) -> str:
    """YYYY-MM from 2000 on; the column form is functions.valid_period."""
    if not re.fullmatch(r"\d{4}-\d{2}", text):
        raise ValueError("Use the form YYYY-MM.")
    if text[:4] < "2000" or not "01" <= text[5:] <= "12":
        raise ValueError("The month is out of range.")
    return text


def ledger_ok(files: DataFrame, counts: DataFrame, now: datetime) -> DataFrame:
    """Success rows: number of rows read per file, before the reduction per key."""
    return files.join(counts, "arquivo", "left").select(
        "arquivo", "url", "periodo_inicial", "periodo_final", F.lit(now).alias("processado_em"),
        F.coalesce("linhas", F.lit(0)).cast("bigint").alias("linhas_inseridas"),
        F.lit(STATUS_OK).alias("status"), F.lit(None).cast("string").alias("erro"))


def ledger_error(files: DataFrame, errors: DataFrame, now: datetime) -> DataFrame:
    """Error rows: no row count, text cut to the ledger's limit."""
    return files.join(errors, "arquivo").select(
        "arquivo", "url", "periodo_inicial", "periodo_final", F.lit(now).alias("processado_em"),
        F.lit(None).cast("bigint").alias("linhas_inseridas"), F.lit(STATUS_ERROR).alias("status"),
        F.substring("erro", 1, ERROR_TEXT_LIMIT).alias("erro"))


def run_load(spark: SparkSession, cfg: LoadConfig) -> DataFrame:
    """Load every pending archive and return the ledger rows of this run.

    The driver handles only the file list (one entry per file, as Spark's own listing does); rows go from the
    archives to one intermediate table beside the store and from there to the changed months, a group of archives at a
    time. A commit that meets another writer's is made again from that version.
    """
    cfg.check()
    store = Store(spark, cfg.root)
    register = read_register(read_sheet(spark, cfg.sheet)).withColumn("atualizado_em", F.lit(cfg.now))
    # The register counts, and excluded funds go, whatever becomes of the files.
    store.update(lambda s: (without_keys(upsert(s.read("fundos"), register, ["cnpj"], ["atualizado_em"])), None, *_without_excluded(s)))
    catalog = source_catalog(spark, cfg.history, cfg.monthly)
    asked = register.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("cnpj").cast("decimal(38,0)")).alias("soma")).first()
    pending = select_pending(catalog, store.read("cargas"), cfg.start, cfg.end, cfg.force, cfg.recent)
    picked = (pending.join(fingerprints(spark, cfg.history, cfg.monthly, f"{asked['n']}/{asked['soma']}"), "url")
              .orderBy(*catalog_order()).collect())
    if not picked:
        return spark.createDataFrame([], LEDGER)
    reached, failure = [], None
    for first in range(0, len(picked), cfg.group):
        names, failure = _load_group(store, cfg, register, picked[first:first + cfg.group])
        reached += names
        if failure and not cfg.continue_on_error:
            break
    if failure and not cfg.continue_on_error:
        raise LoadError(failure)
    names = spark.createDataFrame([(name,) for name in set(reached)], "arquivo string")
    return store.read("cargas").join(names, "arquivo", "left_semi").select(*LEDGER.fieldNames())


def _load_group(store: Store, cfg: LoadConfig, register: DataFrame, picked: list[Row]) -> tuple[list[str], str | None]:
    """Parse and commit some archives; the names in the ledger now, and the first error."""
    spark = store.spark
    files = spark.createDataFrame(
        [(i, r["arquivo"], r["url"], r["periodo_inicial"], r["periodo_final"], r["impressao"]) for i, r in enumerate(picked)],
        "ordem int, arquivo string, url string, periodo_inicial string, periodo_final string, impressao string")
    parsed = _parsed(store, cfg, register, files)
    # One pass over the parsed rows: errors, counts and months of each file (as many entries as files and their months).
    found = (parsed.groupBy("ordem", F.when(F.col("erro").isNull(), month_of()).alias("mes"))
             .agg(F.count_if(F.col("erro").isNull()).alias("linhas"), F.min_by("erro", F.when(F.col("erro").isNotNull(), F.col("membro_ix"))).alias("erro"))
             .collect())
    failed, lines = {}, Counter()
    for r in found:
        lines[r["ordem"]] += r["linhas"]
        if r["erro"] is not None:
            failed[r["ordem"]] = r["erro"]
    stop = len(picked) if cfg.continue_on_error or not failed else min(failed) + 1
    done = [i for i in range(stop) if i not in failed]
    last = {picked[i]["arquivo"]: i for i in done}

    applied = spark.createDataFrame([(i, i == last[picked[i]["arquivo"]]) for i in done],
                                    "ordem int, _vale boolean")
    rows = parsed.where(F.col("erro").isNull()).join(F.broadcast(applied), "ordem").select(
        "ordem", "membro_ix", "linha", "_vale", "cnpj", "id_subclasse", "data", "valor_cota",
        F.col("arquivo").alias("arquivo_origem"), F.lit(cfg.now).alias("atualizado_em"))
    counted = spark.createDataFrame([(i, lines[i]) for i in done], "ordem int, linhas long")
    news = _ledger_rows(files.drop("impressao"), counted, failed, range(stop), cfg.now)
    kept = set(done)
    touched = {r["mes"] for r in found if r["mes"] and r["ordem"] in kept}

    def change(current: Store) -> tuple:
        months = sorted(touched | set(current.months_with(sorted(last))))
        merged = _merge(current, rows, sorted(last), cfg.keep, months)
        return None, upsert(current.read("cargas"), news, ["arquivo"], ["processado_em"]), merged, months

    store.update(change)
    _forget(store, [r["impressao"] for r in picked])
    return [r["arquivo"] for r in picked[:stop]], failed[min(failed)] if failed else None


def _parsed(store: Store, cfg: LoadConfig, register: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of the archives, from what an earlier run has left or parsed now; error rows of an earlier run don't count."""
    left = _left_over(store)
    if left is not None:
        whole = left.groupBy("impressao").agg(F.bool_or(F.col("membro_ix") == _MARK).alias("_todo"), F.count("erro").alias("_erros"))
        whole = whole.where("_todo AND _erros = 0").select("impressao")
        left = left.join(whole, "impressao", "left_semi").join(F.broadcast(files.select("impressao")), "impressao", "left_semi")
        missing = files.join(whole, "impressao", "left_anti")
    else:
        missing = files
    path, columns = f"{store.root}/parcial/lote={uuid.uuid4().hex}", [c.split()[0] for c in _PARSED.split(", ")]
    if missing.limit(1).count():
        rows = (parse_daily(read_archives(missing.drop("impressao"), cfg.opener, cfg.block_rows), register)
                .join(F.broadcast(missing.select("ordem", "impressao")), "ordem"))
        marks = missing.select(F.lit(_MARK).alias("membro_ix"), "impressao")
        rows.select(*columns).unionByName(marks, allowMissingColumns=True).write.partitionBy("impressao").parquet(path)
        fresh = store.spark.read.schema(_PARSED).parquet(path)
        left = fresh if left is None else left.select(*columns).unionByName(fresh.select(*columns))
    return left.where(F.col("membro_ix") != _MARK).join(F.broadcast(files.select("ordem", "arquivo", "impressao")), "impressao")


def _left_over(store: Store) -> DataFrame | None:
    """What finished parsing jobs have written and no commit has used."""
    parent, fs = store._folder(f"{store.root}/parcial")
    done = [s.getPath() for s in fs.listStatus(parent)] if fs.exists(parent) else []
    done = [str(p) for p in done if fs.exists(store.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not done:
        return None
    read = store.spark.read.schema(_PARSED + ", lote string").option("basePath", str(parent)).parquet(*done)
    latest = read.where(F.col("membro_ix") == _MARK).groupBy("impressao").agg(F.max("lote").alias("lote"))  # a file parsed twice counts once
    return read.join(F.broadcast(latest), ["impressao", "lote"], "left_semi").drop("lote")


def _forget(store: Store, prints: list[str]) -> None:
    """Remove the parsed rows of these archives, and folders that hold nothing else."""
    parent, fs = store._folder(f"{store.root}/parcial")
    for lote in fs.listStatus(parent) if fs.exists(parent) else ():
        for each in prints:
            fs.delete(store.spark._jvm.org.apache.hadoop.fs.Path(lote.getPath(), f"impressao={each}"), True)
        if not any(s.isDirectory() for s in fs.listStatus(lote.getPath())):
            fs.delete(lote.getPath(), True)


def _ledger_rows(files: DataFrame, counted: DataFrame, failed: dict[int, str], reached: range,
                 now: datetime) -> DataFrame:
    """Ledger rows of the files that were reached, the last outcome per name."""
    spark = files.sparkSession
    seen = keep_last(files.where(F.col("ordem") < reached.stop), ["arquivo"], ["ordem"])
    errors = spark.createDataFrame(list(failed.items()), "ordem int, erro string")
    bad = seen.join(errors, "ordem")
    good = seen.join(errors, "ordem", "left_anti")
    counts = good.join(counted, "ordem").select("arquivo", "linhas")
    return ledger_ok(good, counts, now).unionByName(
        ledger_error(bad.drop("erro"), bad.select("arquivo", "erro"), now))


def _without_excluded(store: Store) -> tuple[DataFrame | None, list[str]]:
    """Months that hold excluded funds, and their content without them."""
    months = store.months_with(funds=list(EXCLUDED_IDS))
    return (without_keys(store.read("cotas_diarias", months)), months) if months else (None, [])


def _merge(store: Store, rows: DataFrame, sources: list[str], keep: str, months: list[str]) -> DataFrame:
    """Replace by source and upsert, restricted to the months that change.

    The result equals applying the files one by one. A key belongs to the last file that has it; when a file
    name is loaded twice in one run, the second load also removes what the first took over.
    """
    names = store.spark.createDataFrame([(s,) for s in sources], "arquivo_origem string")
    keys = list(QUOTE_KEY)
    order = _ORDER if keep == "last" else ["ordem", -F.col("membro_ix"), -F.col("linha")]
    winners = keep_last(rows, keys, order)
    current = (without_keys(store.read("cotas_diarias", months))
               .join(F.broadcast(names), "arquivo_origem", "left_anti").join(winners.select(*keys).hint("merge"), keys, "left_anti"))
    fresh = winners.where("_vale")
    columns = QUOTES.fieldNames()
    return current.select(*columns).unionByName(fresh.select(*columns))


def final_report(store: Store) -> tuple[DataFrame, DataFrame]:
    """Totals after a load, and the funds that still have no data, both from the store's index."""
    cov = store.coverage()
    return load_summary(cov), without_data(cov)
