from conftest import values

from navgrid.operators import coverage as C, tables as K
from navgrid.plans.load import ledger_error
from navgrid.schema import EXCLUDED_IDS
from navgrid.sources.catalog import catalog_order, catalog_rows
from navgrid.sources.register import read_register, read_sheet

import pytest

ROWS = "cnpj string, data string, valor int, arquivo_origem string, linha int"


def rows(spark, *data):
    return spark.createDataFrame(list(data), ROWS)


def test_upsert_takes_over_source_and_keeps_last(spark):
    current = rows(spark, ("A", "d1", 1, "f1", 0), ("A", "d2", 2, "f1", 1))
    new = rows(spark, ("A", "d2", 9, "f2", 0), ("A", "d2", 8, "f2", 1), ("B", "d1", 7, "f2", 2))
    assert values(K.upsert(current, new, ["cnpj", "data"], ["linha"])) == [
        ("A", "d1", 1, "f1", 0), ("A", "d2", 8, "f2", 1), ("B", "d1", 7, "f2", 2)]
    assert ("A", "d2", 9, "f2", 0) in values(K.upsert(current, new, ["cnpj", "data"], ["linha"], keep="first"))


def test_replace_by_source_drops_rows_the_file_no_longer_has(spark):
    current = rows(spark, ("A", "d1", 1, "f1", 0), ("A", "d2", 2, "f1", 1), ("A", "d3", 3, "f2", 0))
    again = rows(spark, ("A", "d1", 5, "f1", 0))
    sources = spark.createDataFrame([("f1",)], "arquivo_origem string")
    once = K.replace_by_source(current, again, sources, ["cnpj", "data"], ["linha"])
    assert values(once) == [("A", "d1", 5, "f1", 0), ("A", "d3", 3, "f2", 0)]
    assert values(K.replace_by_source(once, again, sources, ["cnpj", "data"], ["linha"])) == values(once)
    assert values(K.replace_by_source(current, again.limit(0), sources, ["cnpj", "data"], ["linha"])) == [
        ("A", "d3", 3, "f2", 0)]


def test_sync_register_keeps_funds_absent_from_the_sheet(spark):
    reg = "cnpj string, nome string, atualizado_em int"
    old = spark.createDataFrame([("1", "velho", 1), ("2", "fica", 1), (EXCLUDED_IDS[0], "fora", 1)], reg)
    quotes = spark.createDataFrame([("2",), (EXCLUDED_IDS[0],)], "cnpj string")
    new = spark.createDataFrame([("1", "novo", 2)], reg)
    register, kept = K.sync_register(old, quotes, new)
    assert values(register) == [("1", "novo", 2), ("2", "fica", 1)]
    assert values(kept) == [("2",)]


def test_catalog_order_and_names(spark):
    history = catalog_rows(spark.createDataFrame([("x/inf_diario_fi_2005.zip",), ("x/inf_diario_fi_200603.zip",)], "path string"), False)
    monthly = catalog_rows(spark.createDataFrame(
        [("y/inf_diario_fi_202101.zip",), ("y/inf_diario_fi_2021.zip",), ("y/inf_diario_fi_2021011.zip",), ("y/a.zip",)],
        "path string"), True)
    got = [tuple(r) for r in history.unionByName(monthly).orderBy(*catalog_order())
           .select("arquivo", "periodo_inicial", "periodo_final", "mensal").collect()]
    assert got == [("inf_diario_fi_2005.zip", "2005-01", "2005-12", False),
                   ("inf_diario_fi_200603.zip", "2006-01", "2006-12", False),
                   ("inf_diario_fi_202101.zip", "2021-01", "2021-01", True)]
    both = spark.createDataFrame([("z/inf_diario_fi_2021.zip",), ("z/inf_diario_fi_202101.zip",)], "path string")
    assert [r["arquivo"] for r in catalog_rows(both, False).orderBy(*catalog_order()).collect()][0] == "inf_diario_fi_2021.zip"


def test_selection(spark):
    cat = spark.createDataFrame(
        [("y", "2020-01", "2020-12", False)] + [(f"m{i}", f"2021-0{i}", f"2021-0{i}", True) for i in range(1, 6)],
        "arquivo string, periodo_inicial string, periodo_final string, mensal boolean")
    ledger = spark.createDataFrame([(n, "OK") for n in ("y", "m1", "m2", "m4", "m5")] + [("m3", "ERRO")],
                                   "arquivo string, status string")
    pick = lambda **kw: [v[0] for v in values(K.select_pending(cat, ledger, **kw), "arquivo")]
    assert pick() == ["m3", "m4", "m5"]
    assert pick(recent=0) == ["m3"]
    assert pick(end="2021-02") == ["m1", "m2"]
    assert pick(start="2021-04", recent=0) == []
    assert pick(force=True) == ["m1", "m2", "m3", "m4", "m5", "y"]


def test_error_text_is_cut(spark):
    files = spark.createDataFrame([("a", "u", "2020-01", "2020-12")],
                                  "arquivo string, url string, periodo_inicial string, periodo_final string")
    errors = spark.createDataFrame([("a", "x" * 5000)], "arquivo string, erro string")
    from datetime import datetime
    row = ledger_error(files, errors, datetime(2026, 1, 5)).first()
    assert len(row["erro"]) == 2000 and row["linhas_inseridas"] is None and row["status"] == "ERRO"


def test_coverage_and_summary(spark):
    register = spark.createDataFrame([("1", "b"), ("2", "a")], "cnpj string, nome string")
    quotes = spark.createDataFrame([("1", "2024-01-02"), ("1", "2024-01-05"), ("9", "2024-01-01")], "cnpj string, data string")
    cov = C.coverage(register, quotes)
    assert [tuple(r) for r in C.fund_list(cov).collect()] == [
        ("2", "a", None, None, 0, "SEM DADOS"), ("1", "b", "2024-01-02", "2024-01-05", 2, "OK")]
    assert tuple(C.load_summary(cov).first()) == (2, 1, 2, "2024-01-02", "2024-01-05")
    assert values(C.without_data(cov)) == [("2", "a")]


def sheet(tmp_path, text):
    path = tmp_path / "fundos.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_register(spark, tmp_path):
    good = sheet(tmp_path, f' Nome ,CNPJ,x\n"  Fundo ""A"" ",12.345.678/0001-95,1\n,,2\nB,7,3\nFora,{EXCLUDED_IDS[1]},4\n')
    assert values(read_register(read_sheet(spark, good))) == [("00000000000007", "B"), ("12345678000195", 'Fundo "A"')]


@pytest.mark.parametrize("text, words", [
    ("Nome,CNPJ\nA,1\nB,sem\nC,123456789012345\n", "3, 4"), ("Nome,CNPJ\nA,1\nB,01\n", "00000000000001"),
    ("Nome,Outro\nA,1\n", "CNPJ"), ("Nome,CNPJ\n", "no funds")])
def test_register_errors(spark, tmp_path, text, words):
    with pytest.raises(ValueError, match=words):
        read_register(read_sheet(spark, sheet(tmp_path, text)))


def test_register_errors_name_every_line(spark, tmp_path):
    from navgrid.sources.register import read_register, read_sheet
    lines = [f"Fundo {i},{'x' if i % 2 else i + 1}" for i in range(500)]
    (tmp_path / "f.csv").write_text("Nome,CNPJ\n" + "\n".join(lines) + "\n")
    with pytest.raises(ValueError) as error:
        read_register(read_sheet(spark, str(tmp_path / "f.csv")))
    assert str(error.value).endswith(": " + ", ".join(str(i + 2) for i in range(1, 500, 2)))
    (tmp_path / "g.csv").write_text("Nome,CNPJ\n" + "\n".join(f"F,{i % 150}" for i in range(300)) + "\n")
    with pytest.raises(ValueError) as error:
        read_register(read_sheet(spark, str(tmp_path / "g.csv")))
    assert all(str(i).zfill(14) in str(error.value) for i in range(150))
    sheet = spark.createDataFrame([(f"F{i}", "" if i == 7 else str(i)) for i in range(20)], "Nome string, CNPJ string")
    sheet.repartition(4).write.parquet(str(tmp_path / "s.parquet"))
    with pytest.raises(ValueError, match=r"part-.*\.parquet:\d$"):
        read_register(read_sheet(spark, str(tmp_path / "s.parquet")))


def test_every_faulty_portfolio_is_named(spark):
    from navgrid.operators.portfolio import check_weights
    weights = spark.createDataFrame([(f"c{i:02d}", "A", 0.5) for i in range(25)], "carteira string, serie string, peso double")
    with pytest.raises(ValueError) as error:
        check_weights(weights, weights.select("carteira", "serie"))
    assert str(error.value).startswith("25 ") and all(f"c{i:02d}" in str(error.value) for i in range(25))


def test_a_missing_fund_empties_the_panel_also_by_subclass(spark):
    from datetime import date
    from navgrid.operators.panel import load_panel
    quotes = spark.createDataFrame([("A", s, f"2024-01-0{d}", 1.0) for s in ("x", "y") for d in (1, 2, 3)],
                                   "cnpj string, id_subclasse string, data string, valor_cota double").selectExpr(
        "cnpj", "id_subclasse", "cast(data as date) as data", "valor_cota")
    span, key = (date(2024, 1, 1), date(2024, 1, 9)), ("cnpj", "id_subclasse")
    assert load_panel(quotes, ["A"], *span, series_key=key).count() == 6
    assert load_panel(quotes, ["A", "B"], *span, series_key=key).count() == 0


def test_long_reports_are_tables(spark, tmp_path, monkeypatch):
    """The error is bounded; the table it names has every faulty row."""
    from navgrid.operators import report
    from navgrid.operators.portfolio import check_weights
    from navgrid.sources.register import read_register, read_sheet
    monkeypatch.setattr(report, "SHOWN", 5)
    (tmp_path / "f.csv").write_text("Nome,CNPJ\n" + "\n".join(f"F,{'x' if i % 2 else i + 1}" for i in range(300)) + "\n")
    with pytest.raises(report.ReportedError, match=r"line\(s\): 3, 5, 7, 9, 11 and 145 more, all listed in ") as error:
        read_register(read_sheet(spark, str(tmp_path / "f.csv")))
    assert error.value.rows == 150 and error.value.place in str(error.value)
    assert {r["linha"] for r in error.value.report(spark).collect()} == {str(i + 2) for i in range(1, 300, 2)}
    (tmp_path / "g.csv").write_text("Nome,CNPJ\n" + "\n".join(f"F,{i % 90}" for i in range(180)) + "\n")
    with pytest.raises(report.ReportedError, match="and 85 more") as error:
        read_register(read_sheet(spark, str(tmp_path / "g.csv")))
    assert values(error.value.report(spark)) == [(str(i).zfill(14), 2) for i in range(90)]
    weights = spark.createDataFrame([(f"c{i:02d}", "A", 0.5) for i in range(25)], "carteira string, serie string, peso double")
    with pytest.raises(report.ReportedError, match="^25 .*c00.*c04.* and 20 more") as error:
        check_weights(weights, weights.select("carteira", "serie"))
    assert error.value.report(spark).count() == 25
    assert check_weights(weights.withColumn("peso", weights.peso * 2), weights.select("carteira", "serie")) is not None


def test_sheet_lines_do_not_depend_on_later_splits(spark, tmp_path):
    """Lines are numbered in one scan: smaller splits afterwards do not move them."""
    from navgrid.sources.register import read_sheet
    spark.range(3000).selectExpr("concat('F', id) as Nome", "cast(id as string) as CNPJ").coalesce(1).write.option("parquet.block.size", 2000).parquet(str(tmp_path / "s.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        sheet = read_sheet(spark, str(tmp_path / "s.parquet"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        assert all(r["linha"].endswith(f":{int(r['CNPJ']) + 1}") for r in sheet.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_growing_keys_are_not_broadcast(spark, tmp_path):
    """Sixty thousand keys are a small file, by whose size Spark would gather them on the driver."""
    from pyspark.sql import functions as F

    from navgrid.operators.coverage import coverage
    from navgrid.operators.tables import upsert
    rows = spark.range(60_000).select(F.lpad(F.col("id").cast("string"), 14, "0").alias("cnpj"), F.lit("x").alias("nome"), F.lit(1).alias("n"),
                                      F.date_add(F.lit("2021-01-01").cast("date"), F.col("id").cast("int") % 7).alias("data"))
    rows.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    for out, n in ((upsert(table, table.withColumn("n", F.lit(2)), ["cnpj"], ["n"]), 60_000), (coverage(table.select("cnpj", "nome"), table), 60_000)):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == out.select("cnpj").distinct().count() == n
