"""Archive scan and load job, on archives that Spark writes from the orders.

Every task streams its rows into one archive with two members, one under the old header and one under the new
one, so the number of archives grows with the number of partitions and nothing is gathered anywhere.
"""

import io
import uuid
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from navgrid.plans.load import LoadConfig, run_load
from navgrid.queries.cleaning import _CLEAN_SQL, _raw
from navgrid.queries.common import Tables, edge, query, r, text
from navgrid.session import shared_dir
from navgrid.sources.archives import arrow_uri, parse_daily, read_archives
from navgrid.sources.catalog import catalog_order, source_catalog
from navgrid.sources.register import read_register, read_sheet
from navgrid.sources.store import Store

_HEADERS = {"antigo.csv": " cnpj_fundo ;VL_TOTAL;Vl_Quota;dt_cômptc;Id_Subclasse",
            "novo.CSV": "CNPJ_FUNDO_CLASSE;VL_TOTAL;VL_QUOTA;DT_COMPTC;ID_SUBCLASSE"}
_WANTED = "c_mktsegment <> 'BUILDING'"
_WANTED_SQL = f"""good AS (SELECT t.*, CAST(o_orderkey AS VARCHAR) AS sub FROM typed t
    JOIN customer ON lpad(CAST(c_custkey AS VARCHAR), 14, '0') = cnpj
    WHERE {_WANTED} AND data IS NOT NULL AND valor_cota > 0)"""


def _write_archives(rows: DataFrame, folder: str) -> int:
    """One archive per partition; returns the number of files."""
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        part = TaskContext.get().partitionId()
        system, path = fs.FileSystem.from_uri(arrow_uri(folder))
        system.create_dir(path, recursive=True)
        name = f"{path}/inf_diario_fi_{2000 + part // 12}{part % 12 + 1:02d}.zip"
        kept = list(_HEADERS)
        with system.open_output_stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as pack:
            for i, frame in enumerate(frames):
                member = f"{i:05d}_{kept[i % 2]}"
                table = pd.DataFrame({"a": frame["cnpj_bruto"], "b": "1,0", "c": frame["valor_bruto"],
                                      "d": frame["data_bruta"], "e": frame["o_orderkey"]})
                body = io.StringIO()
                table.to_csv(body, sep=";", index=False, header=False, lineterminator="\n")
                pack.writestr(member, (_HEADERS[kept[i % 2]] + "\n" + body.getvalue()).encode("latin-1"))
            if pack.namelist() == []:
                pack.writestr(kept[0], (_HEADERS[kept[0]] + "\n").encode("latin-1"))
        yield pd.DataFrame({"arquivo": [name]})

    parts = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(parts, "o_orderkey").mapInPandas(write, "arquivo string").count()


def _prepare(t: Tables) -> tuple[str, DataFrame]:
    """A new working folder with archives and register sheet."""
    folder = f"{shared_dir(t.spark)}/navgrid-arquivos/{uuid.uuid4().hex}"
    _write_archives(_raw(t), folder + "/mensal")
    wanted = t.customer.where(_WANTED).select(F.col("c_name").alias("Nome"), F.col("c_custkey").cast("string").alias("CNPJ"))
    wanted.write.csv(folder + "/fundos.csv", header=True)
    return folder, wanted.select(F.lpad("CNPJ", 14, "0").alias("cnpj"))


_ROWS = f"""lpad(cnpj, 14, '0') AS cnpj, sub AS id_subclasse, {text('data')} AS data, {r('valor_cota')} AS valor_cota"""


@query("s2_archive_scan", f"{_CLEAN_SQL}, {_WANTED_SQL} SELECT {_ROWS} FROM good")
def s2(t: Tables) -> DataFrame:
    folder, wanted = _prepare(t)
    catalog = source_catalog(t.spark, None, folder + "/mensal")
    numbered = t.spark.createDataFrame([(i, row["arquivo"], row["url"]) for i, row in enumerate(
        catalog.orderBy(*catalog_order()).collect())], "ordem int, arquivo string, url string")
    rows = parse_daily(read_archives(numbered), wanted).where("erro IS NULL")
    return edge(rows.select("cnpj", "id_subclasse", "data", "valor_cota"))


def _load(t: Tables) -> tuple[Store, DataFrame]:
    folder, _ = _prepare(t)
    cfg = LoadConfig(root=folder + "/banco", sheet=folder + "/fundos.csv", monthly=folder + "/mensal",
                     now=datetime(2026, 1, 5, 10, tzinfo=timezone.utc))
    return Store(t.spark, cfg.root), run_load(t.spark, cfg)


@query("f19_load_quotes", f"{_CLEAN_SQL}, {_WANTED_SQL} SELECT {_ROWS} FROM good")
def f19(t: Tables) -> DataFrame:
    return edge(_load(t)[0].read("cotas_diarias").select("cnpj", "id_subclasse", "data", "valor_cota"))


@query("f19_load_ledger", f"""{_CLEAN_SQL}, {_WANTED_SQL} SELECT 'OK' AS status, COUNT(*) AS linhas,
    '2026-01-05 10:00:00' AS processado_em FROM good""")
def f19_ledger(t: Tables) -> DataFrame:
    ledger = _load(t)[1]
    return edge(ledger.groupBy("status", "processado_em").agg(F.sum("linhas_inseridas").alias("linhas"))
                .select("status", "linhas", "processado_em"))


@query("s4_register_scan", """SELECT lpad(CAST(p_partkey AS VARCHAR), 14, '0') AS cnpj, p_brand || ' "' || p_name || '"' AS nome FROM part""")
def s4(t: Tables) -> DataFrame:
    """A sheet with quotes inside quotes, more columns and padded cells."""
    path = f"{shared_dir(t.spark)}/navgrid-arquivos/{uuid.uuid4().hex}.csv"
    name = F.concat(F.lit("\t"), "p_brand", F.lit(' "'), "p_name", F.lit('" '))
    (t.part.select(F.col("p_type").alias("Tipo"), name.alias(" Nome "), F.concat(F.lit("N."), "p_partkey").alias("CNPJ"))
     .write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False,
                ignoreTrailingWhiteSpace=False))
    return read_register(read_sheet(t.spark, path))


_COVERAGE_SQL = f"""{_CLEAN_SQL}, {_WANTED_SQL} SELECT lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS cnpj, c_name AS nome,
    {text('MIN(data)')} AS primeira_data_disponivel, {text('MAX(data)')} AS ultima_data_disponivel,
    COUNT(data) AS quantidade_registros, CASE WHEN COUNT(data) = 0 THEN 'SEM DADOS' ELSE 'OK' END AS status
    FROM customer LEFT JOIN good ON cnpj = lpad(CAST(c_custkey AS VARCHAR), 14, '0') WHERE {_WANTED} GROUP BY 1, 2"""


@query("s13_coverage_view", _COVERAGE_SQL)
def s13(t: Tables) -> DataFrame:
    _load(t)[0].create_views()
    return edge(t.spark.table("fundos_controle"))


@query("s13_coverage_index", _COVERAGE_SQL)
def s13_index(t: Tables) -> DataFrame:
    """From the index that each commit writes: after the load, a reload of the recent archives and a clean up."""
    folder, _ = _prepare(t)
    for day in (5, 6):
        cfg = LoadConfig(root=folder + "/banco", sheet=folder + "/fundos.csv", monthly=folder + "/mensal",
                         now=datetime(2026, 1, day, 10, tzinfo=timezone.utc))
        run_load(t.spark, cfg)
    store = Store(t.spark, cfg.root)
    store.vacuum()
    return edge(store.coverage())


@query("s5_scan_by_fund", f"""{_CLEAN_SQL}, {_WANTED_SQL} SELECT {_ROWS} FROM good
    WHERE CAST(cnpj AS BIGINT) IN (SELECT c_custkey FROM customer WHERE {_WANTED} ORDER BY c_custkey LIMIT 20)""")
def s5_funds(t: Tables) -> DataFrame:
    """Twenty funds out of all quotes of the store, by the row groups that may hold them (the list is the operator's input)."""
    store = _load(t)[0]
    funds = [r["cnpj"] for r in store.read("fundos").orderBy("cnpj").limit(20).select("cnpj").collect()]
    limits = store.date_limits().first()
    return edge(store.quotes_of(funds, limits["inicio"], limits["fim"]).select("cnpj", "id_subclasse", "data", "valor_cota"))
