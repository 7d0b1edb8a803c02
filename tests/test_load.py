import zipfile
from datetime import datetime, timezone

import pytest
from conftest import values

from navgrid.plans.load import LoadConfig, LoadError, check_period, final_report, run_load
from navgrid.sources.archives import column_name, place_of
from navgrid.sources.store import Store

OLD = "CNPJ_FUNDO;DT_COMPTC;VL_TOTAL;VL_QUOTA\n"
NEW = "TP_FUNDO;CNPJ_FUNDO_CLASSE;ID_SUBCLASSE;DT_COMPTC;VL_QUOTA\n"


class World:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        for name in ("hist", "mensal"):
            (folder / name).mkdir()
        self.register("Nome,CNPJ\nUm,1\nDois,2\n")
        self.clock = 0

    def register(self, text):
        (self.folder / "fundos.csv").write_text(text)

    def archive(self, name, where="mensal", **members):
        path = self.folder / where / f"inf_diario_fi_{name}.zip"
        with zipfile.ZipFile(path, "w") as pack:
            for member, text in members.items():
                pack.writestr(member.replace("_csv", ".csv").replace("_CSV", ".CSV"), text.encode("latin-1"))

    def load(self, **options):
        self.clock += 1
        return run_load(self.spark, LoadConfig(
            root=str(self.folder / "banco"), sheet=str(self.folder / "fundos.csv"), history=str(self.folder / "hist"),
            monthly=str(self.folder / "mensal"), now=datetime(2026, 1, self.clock, tzinfo=timezone.utc), **options))

    @property
    def store(self):
        return Store(self.spark, str(self.folder / "banco"))

    def quotes(self):
        return values(self.store.read("cotas_diarias"), "cnpj", "id_subclasse", "data", "valor_cota", "arquivo_origem")

    def ledger(self):
        return {r["arquivo"][14:-4]: (r["status"], r["linhas_inseridas"]) for r in self.store.read("cargas").collect()}


@pytest.fixture
def world(spark, tmp_path):
    return World(spark, tmp_path)


def q(fund, day, value, source, sub=""):
    return (fund.zfill(14), sub, day, value, f"inf_diario_fi_{source}.zip")


def test_headers(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(["  Dt_cômptç ", "CNPJ_FUNDO", "CNPJ_FUNDO_CLASSE"],)], "h array<string>")
    names = F.transform("h", column_name)
    row = df.select(names.alias("n"), place_of(names, "CNPJ_FUNDO_CLASSE", "CNPJ_FUNDO").alias("a"), place_of(names, "VL_QUOTA").alias("b")).first()
    assert row["n"][0] == "DT_COMPTC" and (row["a"], row["b"]) == (3, None)


def test_header_variants_tokens_and_dirty_values(world):
    world.archive(
        "202101", a_csv=OLD + "00.000.000/0000-01;2021-01-04;5;1.5\n3;2021-01-04;5;1.5\n2;04/01/2021;5;1\n2;2021-02-30;5;1\n",
        b_CSV=" dt_cômptc ;CNPJ_FUNDO_CLASSE;VL_QUOTA;Id_Subclasse\n"
              "2021-01-05;1;2.5;NA\n2021-01-05;1;3.5; A\t\n2021-01-06;2;nan;\n2021-01-06;2;1d;\n2021-01-06;2;1,5;\n"
              "2021-01-06;2;0;\n2021-01-06;2;-1;\n2021-01-06;2;inf;\n2021-01-07;2;\"4\";\"x \"\"y\"\"\"\n",
        leia_txt="nada")
    world.load()
    assert world.quotes() == sorted([
        q("1", "2021-01-04", 1.5, "202101"), q("1", "2021-01-05", 2.5, "202101"), q("1", "2021-01-05", 3.5, "202101", "A"),
        q("2", "2021-01-06", float("inf"), "202101"), q("2", "2021-01-07", 4.0, "202101", 'x "y"')], key=str)
    assert world.ledger() == {"202101": ("OK", 5)}


def test_last_line_wins_and_counts_come_before_the_key(world):
    world.archive("202101", a_csv=OLD + "1;2021-01-04;5;1\n1;2021-01-04;5;2\n")
    world.archive("202102", a_csv=OLD + "1;2021-01-04;5;3\n", b_csv=OLD + "1;2021-01-04;5;4\n")
    world.load()
    assert world.quotes() == [q("1", "2021-01-04", 4.0, "202102")]
    assert world.ledger() == {"202101": ("OK", 2), "202102": ("OK", 2)}


def test_small_blocks_give_the_same_rows(world):
    world.archive("202101", a_csv=OLD + "".join(f"1;2021-01-{d:02d};5;{d}\n" for d in range(1, 29)) + "1;2021-01-05;5;99\n")
    world.load(block_rows=3)
    assert len(world.quotes()) == 28 and q("1", "2021-01-05", 99.0, "202101") in world.quotes()


def test_reload_drops_vanished_rows_also_those_taken_over(world):
    world.archive("2020", "hist", a_csv=OLD + "1;2020-12-30;5;1\n1;2020-12-31;5;1\n")
    world.archive("202101", a_csv=OLD + "1;2020-12-31;5;2\n1;2021-01-04;5;2\n")
    world.load()
    assert world.quotes() == [q("1", "2020-12-30", 1.0, "2020"), q("1", "2020-12-31", 2.0, "202101"),
                              q("1", "2021-01-04", 2.0, "202101")]
    world.archive("202101", a_csv=OLD + "1;2021-01-05;5;3\n")
    world.load()
    assert world.quotes() == [q("1", "2020-12-30", 1.0, "2020"), q("1", "2021-01-05", 3.0, "202101")]
    before = world.quotes()
    world.load()
    assert world.quotes() == before


def test_only_pending_and_recent_files_are_loaded(world):
    for month in ("202101", "202102", "202103"):
        world.archive(month, a_csv=OLD + f"1;{month[:4]}-{month[4:]}-04;5;1\n")
    assert world.load().count() == 3
    assert sorted(v[0][14:-4] for v in values(world.load(), "arquivo")) == ["202102", "202103"]
    assert world.load(recent=0).count() == 0
    assert world.load(recent=0, force=True, end="2021-01").count() == 1
    kept = dict(world.store.manifest()[1])
    assert kept["cotas_diarias", "2021-03"] < kept["cotas_diarias", "2021-01"]  # untouched months keep their files


def test_failing_files(world):
    world.archive("202101", a_csv=OLD + "1;2021-01-04;5;1\n")
    world.archive("202102", a_csv=OLD + "1;2021-02-04;5;1\n")
    world.load()
    world.archive("202101", leia_txt="sem csv")
    world.archive("202102", a_csv=OLD + "1;2021-02-05;5;9\n", b_csv="X;Y\n1;2\n")
    world.archive("202103", a_csv="CNPJ_FUNDO;DT_COMPTC\n1;2021-03-04\n")
    world.archive("202104", a_csv="CNPJ_FUNDO;DT_COMPTC\n8;2021-04-04\n")
    (world.folder / "mensal" / "inf_diario_fi_202105.zip").write_bytes(b"quebrado")
    world.archive("202106", a_csv=OLD + "1;2021-06-04;5;6\n1;2;3;4;5\n")
    world.archive("202107", a_csv=OLD + "1;2021-07-04;5;7\n")
    world.load(force=True, continue_on_error=True)
    assert world.quotes() == [q("1", "2021-01-04", 1.0, "202101"), q("1", "2021-02-04", 1.0, "202102"),
                              q("1", "2021-07-04", 7.0, "202107")]
    assert world.ledger() == {"202101": ("ERRO", None), "202102": ("ERRO", None), "202103": ("ERRO", None),
                              "202104": ("OK", 0), "202105": ("ERRO", None), "202106": ("ERRO", None), "202107": ("OK", 1)}


def test_without_continue_only_files_before_the_failure_count(world):
    world.archive("202101", a_csv=OLD + "1;2021-01-04;5;1\n")
    world.archive("202102", leia_txt="sem csv")
    world.archive("202103", a_csv=OLD + "1;2021-03-04;5;1\n")
    with pytest.raises(LoadError, match="No CSV"):
        world.load()
    assert world.quotes() == [q("1", "2021-01-04", 1.0, "202101")]
    assert world.ledger() == {"202101": ("OK", 1), "202102": ("ERRO", None)}


def test_same_name_in_both_directories(world):
    world.archive("202101", "hist", a_csv=OLD + "1;2021-01-04;5;1\n1;2021-01-05;5;1\n")
    world.archive("202101", a_csv=OLD + "1;2021-01-05;5;2\n")
    world.load()
    assert world.quotes() == [q("1", "2021-01-05", 2.0, "202101")]
    assert world.ledger() == {"202101": ("OK", 1)}


def test_register_changes_and_excluded_funds(world, monkeypatch):
    world.archive("202101", a_csv=OLD + "1;2021-01-04;5;1\n2;2021-01-04;5;1\n")
    world.load()
    import navgrid.operators.tables as tables
    import navgrid.plans.load as load
    out = ("00000000000002",)
    monkeypatch.setattr(load, "EXCLUDED_IDS", out)
    monkeypatch.setattr(load, "without_keys", lambda df, keys=out: tables.without_keys(df, keys))
    world.register("Nome,CNPJ\nUm novo,1\nTres,3\n")
    world.load(recent=0)
    assert values(world.store.read("fundos"), "cnpj", "nome") == [("1".zfill(14), "Um novo"), ("3".zfill(14), "Tres")]
    assert world.quotes() == [q("1", "2021-01-04", 1.0, "202101")]
    summary, empty = final_report(world.store)
    assert tuple(summary.first())[:3] == (2, 1, 1) and values(empty, "nome") == [("Tres",)]
    world.store.create_views()
    assert world.spark.sql("SELECT count(*) FROM fundos_controle WHERE status = 'OK'").first()[0] == 1


def test_an_interrupted_commit_leaves_the_old_version_and_can_be_repeated(world, monkeypatch):
    world.archive("202101", a_csv=OLD + "1;2021-01-04;5;1\n")
    world.load()
    world.archive("202101", a_csv=OLD + "1;2021-01-05;5;2\n")
    original = Store._path

    def lost(self, table, version):
        if table == "manifesto":
            raise OSError("driver lost")
        return original(self, table, version)

    monkeypatch.setattr(Store, "_path", lost)
    with pytest.raises(OSError):
        world.load()
    monkeypatch.undo()
    assert world.quotes() == [q("1", "2021-01-04", 1.0, "202101")]
    world.load()
    assert world.quotes() == [q("1", "2021-01-05", 2.0, "202101")]


def test_a_reloaded_file_without_rows_empties_its_month(world):
    world.archive("202101", a_csv=OLD + "1;2021-01-04;5;1\n")
    world.archive("202102", a_csv=OLD + "1;2021-02-04;5;1\n")
    world.load()
    world.archive("202101", a_csv=OLD)
    world.load()
    assert world.quotes() == [q("1", "2021-02-04", 1.0, "202102")]
    assert world.ledger()["202101"] == ("OK", 0)


def test_the_register_counts_before_the_files(world):
    with pytest.raises(RuntimeError, match="No daily-quote archives"):
        world.load()
    assert values(world.store.read("fundos"), "nome") == [("Dois",), ("Um",)]


def test_months_come_from_the_index_and_old_versions_go(world, spark):
    for month in ("202101", "202102", "202103"):
        world.archive(month, a_csv=OLD + f"1;{month[:4]}-{month[4:]}-04;5;1\n")
    world.load()
    assert world.store.months_with(["inf_diario_fi_202102.zip"]) == ["2021-02"] and world.store.months_with(funds=["1".zfill(14)]) == [
        "2021-01", "2021-02", "2021-03"]
    before = world.quotes()
    world.archive("202102", a_csv=OLD + "1;2021-02-05;5;2\n")
    world.load(force=True, start="2021-02", end="2021-02")
    removed = world.store.vacuum()
    assert any("mes=2021-02" in p for p in removed) and not any("mes=2021-01" in p for p in removed)
    assert len(world.quotes()) == len(before) == 3 and q("1", "2021-02-05", 2.0, "202102") in world.quotes()
    assert world.store.vacuum() == []


def test_parameters(world):
    for bad in ("2021", "1999-01", "2021-13"):
        with pytest.raises(ValueError):
            check_period(bad)
    with pytest.raises(ValueError):
        world.load(start="2021-02", end="2021-01")
    with pytest.raises(ValueError):
        world.load(recent=-1)
    with pytest.raises(RuntimeError, match="No daily-quote archives"):
        world.load()


def test_header_characters(spark):
    """Every character of Latin-1, alone and inside a name, as the compatibility decomposition writes it."""
    import unicodedata
    from pyspark.sql import functions as F

    def expected(text):
        return "".join(c for c in unicodedata.normalize("NFKD", text.strip().upper()) if not unicodedata.combining(c))
    texts = [t for c in map(chr, range(256)) for t in (c, f" a{c}b", f"{c}x{c} ", f"{c}{c}")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", column_name(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == {t: expected(t) for t in texts}


# --- store -----------------------------------------------------------------------------------------------------------

def month_world(world, months=("202101", "202102", "202103")):
    for month in months:
        world.archive(month, a_csv=OLD + f"1;{month[:4]}-{month[4:]}-04;5;1\n2;{month[:4]}-{month[4:]}-05;5;1\n")
    world.load()
    return world.store


def scanned_paths(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), list(df.inputFiles())


def test_coverage_comes_from_the_index(world, monkeypatch):
    from navgrid.operators.coverage import coverage
    month_world(world)
    world.archive("202102", a_csv=OLD + "1;2021-02-09;5;2\n1;2021-02-10;5;2\n")
    world.archive("202103", a_csv=OLD)
    world.register("Nome,CNPJ\nUm,1\nDois,2\nTres,3\n")
    world.load()

    def check():
        store = world.store
        full = coverage(store.read("fundos"), store.read("cotas_diarias"))
        assert values(store.coverage()) == values(full)
        store.create_views()
        for df in (store.coverage(), store.date_limits(), *final_report(store), world.spark.table("fundos_controle")):
            assert df.inputFiles() and not any("cotas_diarias" in f for f in df.inputFiles())
        return values(full, "cnpj", "quantidade_registros", "primeira_data_disponivel", "ultima_data_disponivel")
    assert check() == [("1".zfill(14), 3, "2021-01-04", "2021-02-10"), ("2".zfill(14), 1, "2021-01-05", "2021-01-05"), ("3".zfill(14), 0, None, None)]
    assert tuple(map(str, world.store.date_limits().first())) == ("2021-01-04", "2021-02-10")
    import navgrid.operators.tables as tables
    import navgrid.plans.load as load
    out = ("00000000000001",)
    monkeypatch.setattr(load, "EXCLUDED_IDS", out)
    monkeypatch.setattr(load, "without_keys", lambda df, keys=out: tables.without_keys(df, keys))
    world.load(recent=0)
    assert [v[:2] for v in check()] == [("2".zfill(14), 1), ("3".zfill(14), 0)]
    world.store.vacuum()
    check()
    with pytest.raises(Exception, match="no daily quotes"):
        Store(world.spark, str(world.folder / "novo")).date_limits().collect()


def test_two_writers_of_one_version(world):
    from pyspark.sql import functions as F
    from navgrid.operators.tables import upsert
    from navgrid.sources.store import Conflict
    month_world(world)
    spark, path = world.spark, str(world.folder / "banco")
    one, two = Store(spark, path), Store(spark, path)
    assert one.manifest()[0] == two.manifest()[0]

    def entry(name):
        def change(store):
            old = store.read("cargas")
            return None, upsert(old, old.limit(1).withColumn("arquivo", F.lit(name)), ["arquivo"], ["arquivo"])
        return change
    version = one.commit(*entry("a")(one))
    with pytest.raises(Conflict, match="cargas"):
        two.commit(*entry("b")(two))
    assert two.update(entry("b")) == version + 1
    assert {"a", "b"} <= {r["arquivo"] for r in world.store.read("cargas").collect()} and len(world.quotes()) == 6
    # Different months do not disturb each other: what was written is published on top of the other version.
    one, two = Store(spark, path), Store(spark, path)
    one.manifest(), two.manifest()
    for store, month in ((one, "2021-01"), (two, "2021-02")):
        store.commit(quotes=store.read("cotas_diarias", [month]).withColumn("valor_cota", F.lit(7.0)), months=[month])
    assert [v[3] for v in world.quotes()] == [7.0, 7.0, 1.0, 7.0, 7.0, 1.0]
    one, two = Store(spark, path), Store(spark, path)
    one.manifest(), two.manifest()
    one.commit(quotes=one.read("cotas_diarias", ["2021-03"]).limit(0), months=["2021-03"])
    with pytest.raises(Conflict, match="2021-03"):
        two.commit(quotes=two.read("cotas_diarias", ["2021-03"]), months=["2021-03"])
    assert len(world.quotes()) == 4


def test_writers_at_the_same_time(world):
    """Threads that commit to one store: every ledger entry is there at the end."""
    from concurrent.futures import ThreadPoolExecutor
    from pyspark.sql import functions as F
    from navgrid.operators.tables import upsert
    month_world(world, ("202101",))
    path = str(world.folder / "banco")

    def write(name):
        def change(store):
            old = store.read("cargas")
            return None, upsert(old, old.where("arquivo LIKE 'inf%'").limit(1).withColumn("arquivo", F.lit(name)), ["arquivo"], ["arquivo"])
        return Store(world.spark, path).update(change, attempts=20)
    with ThreadPoolExecutor(3) as pool:
        versions = list(pool.map(write, ["a", "b", "c"]))
    assert len(set(versions)) == 3
    assert {"a", "b", "c"} <= {r["arquivo"] for r in world.store.read("cargas").collect()}


def test_a_manifest_is_never_replaced(world):
    store = month_world(world, ("202101",))
    version, entries = store.manifest()
    assert not store._publish(version, {}) and Store(world.spark, store.root).manifest() == (version, entries)


def noting_opener(log):
    """Opens files and notes which (a local function, so that tasks get its code), and a reader of the notes."""
    def opener(url):
        from navgrid.sources.archives import open_shared
        with open(log, "a") as out:
            out.write(url + "\n")
        return open_shared(url)

    def opened():
        with open(log) as lines:
            names = {line.strip()[-10:-4] for line in lines}
        open(log, "w").close()
        return names
    return opener, opened


def test_a_stopped_load_opens_only_the_rest(world, monkeypatch):
    names = ["202101", "202102", "202103", "202104"]
    for i, month in enumerate(names):
        world.archive(month, a_csv=OLD + f"1;{month[:4]}-{month[4:]}-04;5;{i + 1}\n1;2020-12-31;5;{i + 1}\n")
    (opener, opened), commit, count = noting_opener(str(world.folder / "aberturas")), Store.commit, []

    def stopped(self, *frames, **named):
        count.append(1)
        if len(count) == 4:  # the register, two groups, and the third group is parsed but never committed
            raise OSError("driver lost")
        return commit(self, *frames, **named)
    monkeypatch.setattr(Store, "commit", stopped)
    with pytest.raises(OSError, match="driver lost"):
        world.load(group=1, opener=opener)
    monkeypatch.undo()
    assert opened() == set(names[:3])
    assert world.ledger() == {"202101": ("OK", 2), "202102": ("OK", 2)}
    assert world.load(recent=0, opener=opener).count() == 2
    assert opened() == {"202104"}
    assert world.ledger() == {m: ("OK", 2) for m in names}
    assert world.quotes()[0] == q("1", "2020-12-31", 4.0, "202104") and len(world.quotes()) == 5
    assert not list((world.folder / "banco" / "parcial").iterdir())
    # What is left over counts only for the same file and the same funds.
    count += [1]
    count[:] = count[:2]
    monkeypatch.setattr(Store, "commit", stopped)
    with pytest.raises(OSError):
        world.load(recent=1, opener=opener)
    monkeypatch.undo()
    world.archive("202104", a_csv=OLD + "1;2021-04-04;5;9\n1;2021-04-05;5;9\n1;2021-04-06;5;9\n")
    opened()
    world.load(recent=1, opener=opener)
    assert opened() == {"202104"}
    assert world.ledger()["202104"] == ("OK", 3)


@pytest.mark.parametrize("group", [1, 2, 100])
def test_groups_give_the_same_tables(world, group):
    world.archive("2020", "hist", a_csv=OLD + "1;2020-12-30;5;1\n1;2021-01-04;5;1\n")
    world.archive("202101", "hist", a_csv=OLD + "1;2021-01-04;5;2\n1;2021-01-05;5;2\n")
    world.archive("202101", a_csv=OLD + "1;2021-01-05;5;3\n")
    world.archive("202102", leia_txt="sem csv")
    world.archive("202103", a_csv=OLD + "1;2021-01-05;5;4\n2;2021-03-05;5;4\n")
    world.load(group=group, continue_on_error=True)
    assert world.quotes() == [q("1", "2020-12-30", 1.0, "2020"), q("1", "2021-01-05", 4.0, "202103"), q("2", "2021-03-05", 4.0, "202103")]
    assert world.ledger() == {"2020": ("OK", 2), "202101": ("OK", 1), "202102": ("ERRO", None), "202103": ("OK", 2)}


def scan_rows(df):
    """Rows that the file scans of an executed plan have read."""
    df.collect()
    text, plan, found = [], df._jdf.queryExecution().executedPlan(), 0
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
            continue
        if name == "FileSourceScanExec":
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return found


def test_a_scan_of_few_funds_skips_row_groups(world, monkeypatch):
    """20,000 funds in one month: rows are clustered by fund, and a few of them do not read the month."""
    from datetime import date
    import navgrid.sources.store as module
    from navgrid.operators.panel import load_panel, quote_scan
    monkeypatch.setattr(module, "ROW_GROUP", 20_000)
    spark, n = world.spark, 20_000
    quotes = spark.range(n * 3).selectExpr(
        "lpad(cast(crc32(cast(id % 20000 as string)) as string), 14, '0') as cnpj", "'' as id_subclasse", "date_add(date'2024-01-01', cast(id div 20000 as int)) as data",
        "cast(id as double) as valor_cota", "'f' as arquivo_origem", "timestamp'2024-02-01' as atualizado_em").repartition(3)
    store = Store(spark, str(world.folder / "largo"))
    store.commit(quotes=quotes, months=["2024-01"])
    wanted, span = [r["cnpj"] for r in quotes.select("cnpj").distinct().orderBy("cnpj").limit(15_000).collect()][::1000], (date(2024, 1, 1), date(2024, 1, 31))
    assert len(wanted) == 15
    few = store.quotes_of(wanted, *span)
    assert few.count() == 45 and scan_rows(few) < n
    assert scan_rows(quote_scan(store.read("cotas_diarias"), wanted, *span)) < n
    panel = load_panel(store.read("cotas_diarias"), wanted, *span)
    assert panel.count() == 45
    absent = store.quotes_of(["99999999999999", "5" * 14], *span)
    assert absent.count() == 0 and scan_rows(absent) < n
    assert scan_rows(store.quotes_between(*span)) == 3 * n


def test_lists_of_any_length(spark):
    from navgrid.operators.panel import OR_TERMS, any_of
    df = spark.range(1000).selectExpr("cast(id as string) as x")
    for n in (0, 1, 2, 3, 7, OR_TERMS, OR_TERMS + 1):
        assert df.where(any_of("x", [str(i) for i in range(n)] * 2)).count() == n


@pytest.mark.parametrize("funds", [60_000, 100])
def test_rows_of_archives_are_not_broadcast(world, funds):
    from pyspark.sql import functions as F

    from navgrid.sources.archives import parse_daily, read_archives
    world.archive("202101", a_csv=OLD + f"{funds - 1};2021-01-04;5;1.5\n{funds};2021-01-04;5;1.5\n;2021-01-04;5;1\n7;2021-01-05;5;0\n",
                  b_csv=f"CNPJ_FUNDO;DT_COMPTC\n{funds};2021-01-04\n8;2021-01-04\n")
    catalog = world.spark.createDataFrame([(0, "a", str(world.folder / "mensal" / "inf_diario_fi_202101.zip")), (1, "b", "/nowhere.zip")],
                                          "ordem int, arquivo string, url string")
    wanted = world.spark.range(funds).select(F.lpad(F.col("id").cast("string"), 14, "0").alias("cnpj"))
    rows = parse_daily(read_archives(catalog, lambda url: open(url, "rb")), wanted)
    joins = [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and ("SortMergeJoin" if funds > 50_000 else "BuildRight") in joins[0]
    found = values(rows, "arquivo", "linha", "cnpj", "data", "valor_cota", "erro")
    assert found[:2] == [("a", 0, str(funds - 1).zfill(14), "2021-01-04", 1.5, None), ("a", 1, "8".zfill(14), "2021-01-04", None, "a: no column VL_QUOTA")]
    assert [(r[0], r[2], r[5][:3]) for r in found[2:]] == [("b", "erro", "b: ")]
