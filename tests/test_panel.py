from datetime import date

import pytest
from conftest import values

from navgrid.operators import panel as P, performance as R

TWO = {"A": {"2024-01-01": 10, "2024-01-02": 11, "2024-01-04": 12},
       "B": {"2024-01-02": 20, "2024-01-03": 21, "2024-01-04": 22}}


def quotes(spark, rows):
    return spark.createDataFrame(rows, "cnpj string, id_subclasse string, data string, valor_cota double").selectExpr(
        "cnpj", "id_subclasse", "cast(data as date) as data", "valor_cota")


def test_base100_becomes_decimal_return(spark):
    df = spark.createDataFrame([(1, 100.0), (2, 125.0), (3, 185.0)], "i int, valor double")
    got = [r["valor"] for r in R.cumulative_return(df).orderBy("i").collect()]
    assert got == pytest.approx([0.0, 0.25, 0.85])


def test_common_dates_and_returns_across_gaps(panel_of):
    common = P.common_dates(panel_of(TWO), 2)
    assert sorted({str(r["data"]) for r in common.collect()}) == ["2024-01-02", "2024-01-04"]
    got = {r["serie"]: r["retorno"] for r in R.returns(common).collect()}
    assert got == pytest.approx({"A": 12 / 11 - 1, "B": 0.1})


def test_a_requested_fund_without_data_empties_the_panel(spark):
    q = quotes(spark, [("A", "", "2024-01-01", 1.0), ("B", "", "2024-01-01", 2.0)])
    span = (date(2024, 1, 1), date(2024, 1, 31))
    assert P.load_panel(q, ["A", "B"], *span).count() == 2
    assert P.load_panel(q, ["A", "B", "C"], *span).count() == 0
    assert P.load_panel(q, ["A", "C"], *span, common=False).count() == 1
    assert P.load_panel(q, [], *span, common=False).count() == 0


def test_range_is_inclusive(spark):
    q = quotes(spark, [("A", "", f"2024-01-0{i}", float(i)) for i in range(1, 6)])
    got = P.load_panel(q, ["A"], date(2024, 1, 2), date(2024, 1, 4))
    assert values(got, "data") == [("2024-01-02",), ("2024-01-03",), ("2024-01-04",)]


def test_two_subclasses_on_one_date_fail_unless_keyed(spark):
    q = quotes(spark, [("A", "x", "2024-01-01", 1.0), ("A", "y", "2024-01-01", 2.0)])
    span = (date(2024, 1, 1), date(2024, 1, 31))
    with pytest.raises(Exception, match="Two quotes"):
        P.load_panel(q, ["A"], *span).collect()
    assert values(P.load_panel(q, ["A"], *span, series_key=("cnpj", "id_subclasse")), "serie") == [("A|x",), ("A|y",)]


def test_returns_on_a_panel_with_gaps_need_the_previous_panel_date(panel_of):
    """A lacks the third day and B the first, so no date has both returns; with full days one date has."""
    got = R.returns(panel_of(TWO), common=False)
    assert got.count() == 0
    full = {"A": {"2024-01-01": 10, "2024-01-02": 11, "2024-01-03": 12}, "B": {"2024-01-02": 20, "2024-01-03": 22}}
    assert values(R.returns(panel_of(full), common=False), "serie", "data") == [("A", "2024-01-03"), ("B", "2024-01-03")]


def test_rebase_starts_at_each_series_first_value(panel_of):
    got = values(R.rebase100(panel_of(TWO)), "serie", "data", "valor")
    assert got[0] == ("A", "2024-01-01", 100.0) and got[3] == ("B", "2024-01-02", 100.0)


def test_pivot_keeps_request_order_and_missing_series(panel_of):
    wide = P.to_wide(panel_of(TWO), ["B", "Z", "A"])
    assert wide.columns == ["data", "B", "Z", "A"]
    assert all(r["Z"] is None for r in wide.collect()) and wide.count() == 4
    assert P.to_long(wide, ["B", "Z", "A"]).count() == 12


def test_names_fall_back_to_the_key(spark, panel_of):
    names = spark.createDataFrame([("A", "Fundo A")], "cnpj string, nome string")
    assert {r["nome"] for r in P.with_names(panel_of(TWO), names).collect()} == {"Fundo A", "B"}


def test_missing_series_and_enough_dates(spark, panel_of):
    asked = spark.createDataFrame([("A",), ("C",)], "serie string")
    assert values(P.missing_series(panel_of(TWO), asked)) == [("C",)]
    assert P.enough_dates(panel_of({"A": {"2024-01-01": 1}})).first()["suficiente"] is False


def test_no_quotes_is_an_error(spark):
    with pytest.raises(Exception, match="no daily quotes"):
        P.date_limits(spark.createDataFrame([], "data date")).collect()


def test_summary_order(panel_of):
    got = [r["serie"] for r in R.performance_summary(R.rebase100(panel_of(TWO))).collect()]
    assert got == ["A", "B"]


def test_partitioning_does_not_change_results(panel_of):
    panel = panel_of(TWO)
    one, many = (values(R.rebase100(P.common_dates(panel.repartition(n), 2))) for n in (1, 8))
    assert one == many
