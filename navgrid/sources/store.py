"""Versioned Parquet tables: register, quotes and ledger switch together, and only changed months are written.

    root/fundos/versao=ID         root/cargas/versao=ID
    root/cotas_diarias/versao=ID/mes=YYYY-MM
    root/indice/versao=ID         per month of that write: files and funds, each with first and last date and row count
    root/manifesto/versao=N.parquet   where version N holds each table and each month

A version counts once its manifest is there, so an interrupted write leaves the previous version in force and can simply
run again. A manifest is a file that is created only if it does not exist: of two writers of one version one is told so. It
goes on from the new version if the other changed nothing that it replaces, otherwise it gets Conflict, and ``update``
builds its change again. ``vacuum`` removes what no current entry refers to.

Inside a month rows are clustered by fund: ranges of funds per file, small row groups and a Bloom filter, so a scan of a
few funds reads few row groups. Coverage comes from the index alone, whose entries of different months add up.
"""

import uuid
from collections.abc import Callable, Sequence
from datetime import timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from navgrid.operators.coverage import covered
from navgrid.operators.panel import any_of, date_limits
from navgrid.schema import LEDGER, QUOTES, REGISTER

_SMALL = {"fundos": REGISTER, "cargas": LEDGER}
_QUOTES = "cotas_diarias"
_INDEX = "indice"
_INDEX_ROW = "mes string, tipo string, nome string, primeira date, ultima date, linhas long"
_MANIFEST = "tabela string, mes string, versao_dados string"
ROW_GROUP = 16 << 20  # bytes of a row group of quotes
GROUP_FUNDS = 50_000  # funds in a row group that its Bloom filter is made for


class Conflict(RuntimeError):
    """Another writer has replaced a table or month in the meantime."""


def month_of(column: str = "data"):
    return F.date_format(column, "yyyy-MM")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._known = spark, root.rstrip("/"), None

    def _path(self, table: str, version: str) -> str:
        return f"{self.root}/{table}/versao={version}"

    def manifest(self) -> tuple[int, dict[tuple[str, str | None], str]]:
        """Current version and where it keeps each table and month (one entry per calendar month).

        Read once per Store and after each commit; ``refresh`` or a new Store see another writer's version.
        """
        if self._known is None:
            self._known = self._read_manifest()
        return self._known[0], dict(self._known[1])

    def refresh(self) -> None:
        self._known = None

    def _read_manifest(self) -> tuple[int, dict[tuple[str, str | None], str]]:
        version = max(self._versions(), default=0)
        if not version:
            return 0, {}
        rows = self.spark.read.schema(_MANIFEST).parquet(self._manifest_path(version)).collect()
        return version, {(r["tabela"], r["mes"]): r["versao_dados"] for r in rows}

    def _manifest_path(self, version: int) -> str:
        return self._path("manifesto", f"{version:08d}.parquet")

    def _versions(self) -> list[int]:
        folder, fs = self._folder(f"{self.root}/manifesto")
        names = [status.getPath().getName() for status in fs.listStatus(folder)] if fs.exists(folder) else []
        return [int(n[len("versao="):-len(".parquet")]) for n in names if n.startswith("versao=") and n.endswith(".parquet")]

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def vacuum(self, older_than: timedelta = timedelta(0)) -> list[str]:
        """Remove versions and months that the current manifest does not refer to; returns the removed folders.

        Readers of older versions have to be done. Where others may be writing, ``older_than`` keeps what is newer.
        """
        self.refresh()
        version, entries = self.manifest()
        kept, removed = set(entries.items()), []
        newest = self.spark._jvm.java.lang.System.currentTimeMillis() - int(older_than.total_seconds() * 1000)
        for table in (*_SMALL, _QUOTES, _INDEX, "manifesto"):
            parent, fs = self._folder(f"{self.root}/{table}")
            for status in fs.listStatus(parent) if fs.exists(parent) else ():
                folder = status.getPath()
                held = folder.getName().partition("=")[2]
                if status.getModificationTime() > newest:
                    continue
                if table == "manifesto":
                    stale = [folder] if held != f"{version:08d}.parquet" else []
                elif table in _SMALL:
                    stale = [folder] if entries.get((table, None)) != held else []
                elif table == _INDEX:
                    stale = [folder] if not any(t == _QUOTES and v == held for (t, _), v in kept) else []
                else:
                    months = [m.getPath() for m in fs.listStatus(folder) if m.isDirectory()]
                    stale = [m for m in months if ((table, m.getName().split("=")[1]), held) not in kept]
                    stale = [folder] if len(stale) == len(months) else stale
                for path in stale:
                    fs.delete(path, True)
                    removed.append(str(path))
        return removed

    # --- reading ---------------------------------------------------------------------------------------------

    def _index(self) -> DataFrame | None:
        """Index rows of the months that are in force (the list of months is bounded by the calendar)."""
        held = [(month, v) for (table, month), v in self.manifest()[1].items() if table == _QUOTES]
        if not held:
            return None
        index = (self.spark.read.schema(_INDEX_ROW + ", versao string").option("basePath", f"{self.root}/{_INDEX}")
                 .parquet(*sorted({self._path(_INDEX, v) for _, v in held})))
        return index.join(F.broadcast(self.spark.createDataFrame(held, "mes string, versao string")), ["mes", "versao"], "left_semi")

    def months_with(self, sources: Sequence[str] = (), funds: Sequence[str] = ()) -> list[str]:
        """Months that hold rows of these files or funds, from the index: no quote is scanned. Bounded by the calendar."""
        index = self._index()
        if index is None or not (sources or funds):
            return []
        names = self.spark.createDataFrame([("arquivo_origem", s) for s in sources] + [("cnpj", f) for f in funds], "tipo string, nome string")
        return sorted(r["mes"] for r in index.join(names, ["tipo", "nome"], "left_semi").select("mes").distinct().collect())

    def held(self) -> DataFrame:
        """First and last date and number of quotes per fund, from the index: partial results per month are merged."""
        index = self._index()
        if index is None:
            return self.spark.createDataFrame([], "cnpj string, primeira date, ultima date, linhas long")
        return (index.where("tipo = 'cnpj'").groupBy(F.col("nome").alias("cnpj"))
                .agg(F.min("primeira").alias("primeira"), F.max("ultima").alias("ultima"), F.sum("linhas").alias("linhas")))

    def coverage(self) -> DataFrame:
        """What operators.coverage gives over all quotes, from register and index: no quote is scanned."""
        return covered(self.read("fundos"), self.held())

    def date_limits(self) -> DataFrame:
        """First and last date of all quotes, from the index. No quotes at all is an error of the job."""
        return date_limits(self.held().select(F.explode(F.array("primeira", "ultima")).alias("data")))

    def read(self, table: str, months: Sequence[str] | None = None) -> DataFrame:
        """Current content; for the quotes optionally only some months (others are not listed or scanned)."""
        _, entries = self.manifest()
        if table in _SMALL:
            version = entries.get((table, None))
            if version is None:
                return self.spark.createDataFrame([], _SMALL[table])
            return self.spark.read.schema(_SMALL[table]).parquet(self._path(table, version))
        paths = [f"{self._path(table, v)}/mes={m}" for (t, m), v in sorted(entries.items(), key=str)
                 if t == table and (months is None or m in months)]
        if not paths:
            return self.spark.createDataFrame([], QUOTES)
        return (self.spark.read.schema(QUOTES).option("basePath", f"{self.root}/{table}").parquet(*paths)
                .select(*QUOTES.fieldNames()))

    def quotes_between(self, start, end) -> DataFrame:
        """Quotes of the months of a date range."""
        first, last = f"{start:%Y-%m}", f"{end:%Y-%m}"
        months = [m for (t, m), _ in self.manifest()[1].items() if t == _QUOTES and first <= m <= last]
        return self.read(_QUOTES, months)

    def quotes_of(self, funds: Sequence[str], start, end) -> DataFrame:
        """Quotes of some funds in an inclusive date range: only the row groups that may hold them are read."""
        return self.quotes_between(start, end).where(any_of("cnpj", funds) & F.col("data").between(F.lit(start), F.lit(end)))

    # --- writing ---------------------------------------------------------------------------------------------

    def commit(self, register: DataFrame | None = None, ledger: DataFrame | None = None, quotes: DataFrame | None = None,
               months: Sequence[str] = ()) -> int:
        """Write a version. ``quotes`` replaces the listed months; other months, and tables not given, keep their files.

        The frames are changes to the version that this Store has read. Data go to folders of their own, so writers never
        touch each other's files. Raises Conflict if another writer has replaced one of the same tables or months since.
        """
        base, before = self.manifest()
        name = f"{base + 1:08d}-{uuid.uuid4().hex[:8]}"
        written, owned = {}, set()
        for table, frame in (("fundos", register), ("cargas", ledger)):
            if frame is None:
                continue
            frame.select(*_SMALL[table].fieldNames()).write.parquet(self._path(table, name))
            written[table, None] = name
        if quotes is not None and months:
            owned = {(_QUOTES, month) for month in months}
            written |= {(_QUOTES, month): name for month in self._write_quotes(quotes, name)}
        owned |= set(written)
        version, entries = base, before
        while True:
            entries = {k: v for k, v in entries.items() if k not in owned} | written
            if self._publish(version + 1, entries):
                self.refresh()
                return version + 1
            self.refresh()
            version, entries = self.manifest()
            if version == base:
                raise OSError(f"The manifest of version {base + 1} could not be created.")
            changed = {k for k in before.keys() | entries.keys() if before.get(k) != entries.get(k)}
            if changed & owned:
                raise Conflict("Replaced by another writer: " + ", ".join(sorted("/".join(filter(None, k)) for k in changed & owned)))
            base = version

    def update(self, change: Callable[["Store"], tuple], attempts: int = 5) -> int:
        """Commit what ``change`` makes of the current version; after a conflict it is made again from the new one."""
        for attempt in range(1, attempts + 1):
            try:
                return self.commit(*change(self))
            except Conflict:
                if attempt == attempts:
                    raise

    def _write_quotes(self, quotes: DataFrame, name: str) -> list[str]:
        """Months written. Ranges of (month, fund) spread a month with most rows over tasks and keep a fund's rows together."""
        path = self._path(_QUOTES, name)
        (quotes.select(*QUOTES.fieldNames(), month_of().alias("mes")).repartitionByRange("mes", "cnpj")
         .sortWithinPartitions("mes", "cnpj", "data").write.partitionBy("mes")
         .option("parquet.block.size", ROW_GROUP).option("parquet.bloom.filter.enabled#cnpj", "true")
         .option("parquet.bloom.filter.expected.ndv#cnpj", GROUP_FUNDS).parquet(path))
        layout = T.StructType([*QUOTES.fields, T.StructField("mes", T.StringType())])
        counted = self.spark.read.schema(layout).parquet(path).groupBy("mes", "arquivo_origem", "cnpj").agg(
            F.min("data").alias("primeira"), F.max("data").alias("ultima"), F.count(F.lit(1)).alias("linhas"))
        kinds = [F.struct(F.lit(c).alias("tipo"), F.col(c).alias("nome")) for c in ("arquivo_origem", "cnpj")]
        index = counted.select("mes", F.explode(F.array(*kinds)).alias("k"), "primeira", "ultima", "linhas")
        (index.groupBy("mes", "k").agg(F.min("primeira").alias("primeira"), F.max("ultima").alias("ultima"), F.sum("linhas").alias("linhas"))
         .select("mes", "k.*", "primeira", "ultima", "linhas").write.parquet(self._path(_INDEX, name)))
        listed = self.spark.read.schema(_INDEX_ROW).parquet(self._path(_INDEX, name))
        return [row["mes"] for row in listed.select("mes").distinct().collect()]

    def _publish(self, version: int, entries: dict) -> bool:
        """Create the manifest unless it exists: a complete file under another name first, then one atomic step."""
        target, fs = self._folder(self._manifest_path(version))
        draft, _ = self._folder(f"{self.root}/manifesto/_{uuid.uuid4().hex}")
        rows = [(table, month, held) for (table, month), held in entries.items()]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(str(draft))
        part = next(s.getPath() for s in fs.listStatus(draft) if s.getPath().getName().endswith(".parquet"))
        try:
            return self._create_only(fs, part, target)
        finally:
            fs.delete(draft, True)

    def _create_only(self, fs, source, target) -> bool:
        """Local: a hard link. HDFS: a rename, which never replaces a file. Object stores: a create without overwrite, which
        they decide when the object is complete."""
        jvm, scheme = self.spark._jvm, fs.getUri().getScheme()
        try:
            if scheme == "file":
                place = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(place(target), place(source))
                return True
            if scheme in ("hdfs", "viewfs", "webhdfs"):
                return fs.rename(source, target)
            conf = self.spark._jsc.hadoopConfiguration()
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(fs.open(source), fs.create(target, False), conf, True)
            return True
        except Py4JJavaError as problem:
            if "FileAlreadyExists" in problem.java_exception.getClass().getName():
                return False
            raise

    def create_views(self) -> None:
        """Temporary views under the table names, and the coverage view."""
        for table in (*_SMALL, _QUOTES):
            self.read(table).createOrReplaceTempView(table)
        self.coverage().createOrReplaceTempView("fundos_controle")
