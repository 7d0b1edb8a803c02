from datetime import date

import pytest
from conftest import values

from navgrid.operators import benchmark as B
from navgrid.sources import benchmarks as S

DAYS = ["2026-01-02", "2026-01-05", "2026-01-06"]


def table(spark, numbers, days=DAYS, column="valor"):
    rows = [(d, float(v), i) for i, (d, v) in enumerate(zip(days, numbers))]
    return spark.createDataFrame(rows, f"data string, {column} double, seq int").selectExpr(
        "cast(data as timestamp) as data", column, "seq")


def test_rates_start_at_100_without_the_first_rate(spark):
    got = values(B.compound_rates(S.read_rates(table(spark, [0.10, 0.20, 0.30]), date(2026, 1, 1), date(2026, 1, 31))))
    assert got[0][2] == pytest.approx(100.0) and got[-1][2] == pytest.approx(100.0 * 1.002 * 1.003)


def test_closes_start_at_100(spark):
    rows = table(spark, [100_000, 102_000, 101_000], column="Close")
    got = values(B.compound_closes(S.read_closes(rows, date(2026, 1, 2), date(2026, 1, 6))))
    assert got[0][2] == pytest.approx(100.0) and got[-1][2] == pytest.approx(101.0)


def test_end_date_is_included_to_its_last_instant(spark):
    rows = table(spark, [1, 2], ["2026-01-05 23:59:59", "2026-01-06 00:00:00"])
    assert len(values(S.read_rates(rows, date(2026, 1, 1), date(2026, 1, 5)))) == 1


def test_clean_keeps_the_last_in_input_order_and_drops_the_rest(spark):
    rows = spark.createDataFrame(
        [("2026-01-02T10:00:00Z", "1.5", 0), ("2026-01-02T01:00:00Z", "2.5", 1), ("2026-01-02T23:30:00-03:00", "9", 2),
         ("sem data", "3", 3), ("2026-01-04", "x", 4), ("2026-01-04", "nan", 5)], "d string, v string, seq int")
    got = values(B.clean_series(rows, value="v", when="d", seq="seq", name="s"), "data", "valor")
    assert got == [("2026-01-02", 2.5), ("2026-01-03", 9.0)]


def test_total_loss_rate_is_an_error(spark):
    rows = table(spark, [0.1, -100.0, 0.1])
    with pytest.raises(Exception, match="-100%"):
        B.compound_rates(S.read_rates(rows, date(2026, 1, 1), date(2026, 1, 31))).collect()
    bench, message = S.try_benchmark(spark, "CDI", {"CDI": lambda: rows}, date(2026, 1, 1), date(2026, 1, 31))
    assert bench is None and "-100%" in message


def test_dispatch(spark):
    rows = table(spark, [0.1, 0.2, 0.3])
    load = lambda choice, *days: S.load_benchmark(spark, choice, {"CDI": lambda: rows}, *days)
    span = (date(2026, 1, 1), date(2026, 1, 31))
    assert load("CDI", *span).count() == 3
    assert load("Nenhum", *span).count() == 0
    with pytest.raises(ValueError):
        load("Outro", *span)
    with pytest.raises(ValueError):
        load("CDI", date(2026, 2, 1), date(2026, 1, 1))
    with pytest.raises(S.BenchmarkError):
        load("CDI", date(2030, 1, 1), date(2030, 2, 1))


def test_close_column():
    assert S.close_column(["Open", "Close"]) == "Close"
    assert S.close_column(["Close|X", "Close|^BVSP"]) == "Close|^BVSP"
    assert S.close_column(["Open|X", "Close|X"]) == "Close|X"
    with pytest.raises(S.BenchmarkError):
        S.close_column(["Open"])


def test_closes_without_a_positive_value(spark):
    rows = table(spark, [0, -1, 0], column="Close")
    with pytest.raises(S.BenchmarkError):
        S.load_benchmark(spark, "Ibovespa", {"Ibovespa": lambda: rows}, date(2026, 1, 1), date(2026, 1, 31))


def chained(start: date, end: date, years: int):
    """Plain statement of the rule, one window after the other."""
    out, cursor = [], start
    while cursor <= end:
        day = 28 if (cursor.month, cursor.day) == (2, 29) and (cursor.year + years) % 4 else cursor.day
        following = cursor.replace(year=cursor.year + years, day=day)
        out.append((str(cursor), str(min(end, date.fromordinal(following.toordinal() - 1)))))
        cursor = following
    return out


@pytest.mark.parametrize("start, end, years", [
    (date(2004, 2, 29), date(2050, 1, 1), 9), (date(2000, 1, 1), date(2026, 6, 30), 9), (date(2004, 2, 29), date(2004, 2, 29), 9),
    (date(2000, 2, 29), date(2013, 1, 1), 4), (date(2001, 5, 31), date(2001, 6, 1), 9), (date(2000, 1, 1), date(2008, 12, 31), 9)])
def test_windows(spark, start, end, years):
    got = B.date_windows(spark.createDataFrame([(start, end)], "inicio date, fim date"), years).orderBy("janela").collect()
    assert [(str(r["de"]), str(r["ate"])) for r in got] == chained(start, end, years)


def test_benchmark_joins_without_filling(spark, panel_of):
    perf = panel_of({"A": {"2026-01-02": 100, "2026-01-03": 101}})
    bench = panel_of({"Benchmark: CDI": {"2026-01-02": 100, "2026-01-05": 102}})
    shown, message = B.with_benchmark(perf, bench)
    assert shown.count() == 4 and message is None
    assert B.with_benchmark(perf, None, "falhou") == (perf, "falhou")
    wide = perf.selectExpr("data", "valor as a")
    assert values(B.align_on_date(wide, bench, "cdi")) == [
        ("2026-01-02", 100.0, 100.0), ("2026-01-03", 101.0, None), ("2026-01-05", None, 102.0)]
