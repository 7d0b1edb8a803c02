import numpy as np
import pytest
from conftest import values
from pyspark.sql import functions as F

from navgrid.operators import portfolio as H
from navgrid.plans.portfolio import efficient_frontier, simulate
from navgrid.plans.performance import fund_performance

PRICES = {"A": {"2024-01-01": 10, "2024-01-02": 20, "2024-01-03": 30},
          "B": {"2024-01-01": 100, "2024-01-02": 50, "2024-01-03": 100}}


def percentages(spark, a, b):
    return spark.createDataFrame([("A", float(a)), ("B", float(b))], "serie string, percentual double")


def test_history_and_drifting_weights(spark, panel_of):
    got = simulate(panel_of(PRICES), percentages(spark, 60, 40))
    assert [v[2] for v in values(got.base100)] == pytest.approx([100.0, 140.0, 220.0])
    assert [v[2] for v in values(got.curve)] == pytest.approx([0.0, 0.4, 1.2])
    shares = {v[:2]: v[2] for v in values(got.shares, "serie", "data", "peso")}
    assert shares["A", "2024-01-02"] == pytest.approx(1.2 / 1.4) and shares["B", "2024-01-01"] == pytest.approx(0.4)
    assert dict(values(got.final)) == pytest.approx({"A": 1.8 / 2.2, "B": 0.4 / 2.2})


def test_total_tolerance(spark):
    good = H.normalise_weights(percentages(spark, 60.0105, 40), by=())
    assert sum(v[1] for v in values(good)) == pytest.approx(1.0)
    with pytest.raises(Exception, match="total 100%"):
        H.normalise_weights(percentages(spark, 60.012, 40), by=()).collect()


def test_weight_checks(spark):
    members = spark.createDataFrame([("p", "A"), ("p", "B"), ("q", "A"), ("r", "A"), ("r", "B")], "carteira string, serie string")
    weights = spark.createDataFrame([("p", "A", 0.6), ("p", "B", 0.4), ("q", "A", 0.9), ("r", "A", 1.5), ("r", "B", -0.5)],
                                    "carteira string, serie string, peso double")
    assert {r["carteira"] for r in H.weight_problems(weights, members).collect()} == {"q", "r"}
    with pytest.raises(ValueError):
        H.check_weights(weights, members)
    fine = weights.where("carteira = 'p'")
    assert H.check_weights(fine, members.where("carteira = 'p'")) is fine
    assert H.weight_problems(fine.limit(1), members.where("carteira = 'p'")).count() == 1


def test_equal_weights(spark):
    members = spark.createDataFrame([(s,) for s in "ABC"], "serie string")
    assert [v[1] for v in values(H.equal_weights(members, by=()))] == [33.33] * 3


def test_shared_panel_gives_the_same_as_one_panel_per_portfolio(spark, panel_of):
    weights = spark.createDataFrame([("p", "A", 0.6), ("p", "B", 0.4), ("q", "A", 0.1), ("q", "B", 0.9)],
                                    "carteira string, serie string, peso double")
    panel = panel_of(PRICES)
    own = weights.select("carteira", "serie").join(panel, "serie")
    shared, separate = H.buy_and_hold(panel, weights, shared=True), H.buy_and_hold(own, weights)
    for a, b in zip(shared, separate):
        assert values(a, *sorted(a.columns)) == values(b, *sorted(a.columns))


def test_allocation_table_threshold(spark):
    weights = spark.createDataFrame([("A", 0.00005), ("B", 0.4), ("C", 0.59995)], "serie string, peso double")
    names = spark.createDataFrame([("B", "Fundo B")], "cnpj string, nome string")
    assert [tuple(r) for r in H.allocation_table(weights, names, by=()).collect()] == [("C", 0.59995), ("Fundo B", 0.4)]


def prices(n=5, days=80, seed=3):
    rng = np.random.default_rng(seed)
    moves = rng.normal(0.0005, 0.01, (n, days)) + rng.normal(0, 0.005, days)
    levels = 100 * np.cumprod(1 + moves, axis=1)
    dates = np.datetime64("2024-01-01") + np.arange(days)
    return {f"F{i}": {str(d): v for d, v in zip(dates, levels[i])} for i in range(n)}, levels


def test_efficient_frontier_as_a_whole(spark, panel_of):
    table, levels = prices()
    got = efficient_frontier(spark, panel_of(table), [f"F{i}" for i in range(5)], points=12, candidates=500)
    rets = levels[:, 1:] / levels[:, :-1] - 1
    mean, cov = rets.mean(axis=1) * 252, np.cov(rets) * 252
    low = np.array([v[1] for v in values(got.min_risk_weights)])
    assert low.sum() == pytest.approx(1) and low.min() >= 0.01 - 1e-12
    least = got.min_risk.first()
    assert least["risco"] == pytest.approx(np.sqrt(low @ cov @ low)) and least["retorno"] == pytest.approx(low @ mean)
    points = sorted((r["alvo_ix"], r["retorno"], r["risco"], r["eficiente"]) for r in got.points.collect())
    assert len(points) == 12 and all(p[2] >= least["risco"] - 1e-9 for p in points)
    assert points[-1][1] == pytest.approx(got.max_return.first()["retorno"]) and points[-1][3] and not points[0][3]
    scored = got.candidates.collect()
    assert len(scored) == 500 and all(r["risco"] >= least["risco"] - 1e-12 for r in scored)
    assert {r["serie"]: r["risco"] for r in got.funds.collect()}["F2"] == pytest.approx(np.sqrt(cov[2, 2]))


def test_frontier_needs_sixty_returns(spark, panel_of):
    table, _ = prices(days=60)
    with pytest.raises(ValueError, match="60 common returns"):
        efficient_frontier(spark, panel_of(table), [f"F{i}" for i in range(5)])
    with pytest.raises(ValueError, match="two series"):
        efficient_frontier(spark, panel_of({"F0": prices()[0]["F0"]}), ["F0"])


def test_fund_performance(spark):
    from datetime import date
    rows = [("A", f"2024-01-0{i}", 10.0 * i) for i in range(1, 5)] + [("B", f"2024-01-0{i}", 5.0) for i in range(2, 5)]
    quotes = spark.createDataFrame(rows, "cnpj string, data string, valor_cota double").selectExpr(
        "cnpj", "cast(data as date) as data", "valor_cota")
    names = spark.createDataFrame([("A", "Fundo A"), ("B", "Fundo B")], "cnpj string, nome string")
    rates = spark.createDataFrame([("2024-01-03", 10.0, 0), ("2024-01-04", 10.0, 1), ("2024-01-09", 9.0, 2)],
                                  "data string, valor double, seq int").selectExpr("cast(data as timestamp) as data", "valor", "seq")
    span = (date(2024, 1, 1), date(2024, 1, 31))
    got = fund_performance(quotes, names, ["A", "B"], *span, benchmark="CDI", tables={"CDI": lambda: rates})
    assert [(r["nome"], str(r["inicio_efetivo"]), round(r["rentabilidade"], 9)) for r in got.summary.collect()] == [
        ("Fundo A", "2024-01-02", 1.0), ("Benchmark: CDI", "2024-01-03", 0.1), ("Fundo B", "2024-01-02", 0.0)]
    assert tuple(str(v) for v in got.metrics.first()) == ("2024-01-02", "2024-01-04", "2")
    broken = fund_performance(quotes, names, ["A"], *span, benchmark="CDI", tables={"CDI": lambda: rates.limit(0)})
    assert broken.benchmark_message and broken.curves.count() == 4
    with pytest.raises(ValueError, match="C"):
        fund_performance(quotes, names, ["A", "C"], *span)
    with pytest.raises(ValueError, match="too few"):
        fund_performance(quotes, names, ["A"], date(2024, 1, 4), date(2024, 1, 9))
    for last in (date(2024, 1, 1), date(2023, 1, 1)):
        with pytest.raises(ValueError, match="before the last"):
            fund_performance(quotes, names, ["A"], date(2024, 1, 1), last)
    same = names.withColumn("nome", F.lit("Um nome"))
    assert {(r["serie"], r["nome"], r["rentabilidade"]) for r in fund_performance(quotes, same, ["A", "B"], *span).summary.collect()} == {
        ("A", "Um nome", 1.0), ("B", "Um nome", 0.0)}
    for tables in ({}, {"CDI": lambda: spark.read.parquet("/nowhere/at/all")}, {"CDI": lambda: rates.drop("valor")}):
        got = fund_performance(quotes, names, ["A"], *span, benchmark="CDI", tables=tables)
        assert got.benchmark_message and got.summary.count() == 1
