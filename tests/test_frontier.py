import itertools

import numpy as np
import pandas as pd
import pytest
from conftest import values
from pyspark.sql import functions as F

from navgrid.operators import frontier as E, optimise as O, risk as K

RNG = np.random.default_rng(11)


def problem(n, days=90, seed=0, twin=False):
    rng = np.random.default_rng(seed)
    r = rng.normal(0, 0.02, (n, days)) + rng.normal(0, 0.01, days) + rng.normal(0, 0.001, (n, 1))
    if twin:
        r[-1] = r[0]
    return r, r.mean(axis=1) * 252, np.cov(r) * 252


def brute(mean, cov, floor, target=None):
    """Best over every choice of the series that stay at the floor, each an equality-constrained problem."""
    n, best = len(mean), None
    for size in range(1, n + 1):
        for free in itertools.combinations(range(n), size):
            a = np.ones((1, size)) if target is None else np.vstack([np.ones(size), mean[list(free)]])
            fixed = np.full(n, floor)
            fixed[list(free)] = 0
            b = np.array([1 - fixed.sum()] if target is None else [1 - fixed.sum(), target - mean @ fixed])
            h, c = cov[np.ix_(free, free)], cov[list(free)] @ fixed
            kkt = np.block([[h, a.T], [a, np.zeros((len(b), len(b)))]])
            x = np.linalg.lstsq(kkt, np.concatenate([-c, b]), rcond=None)[0][:size]
            w = fixed.copy()
            w[list(free)] = x
            if np.abs(a @ x - b).max() < 1e-9 and w.min() >= floor - 1e-10:
                risk = w @ cov @ w
                if best is None or risk < best[0]:
                    best = (risk, w)
    return best


@pytest.mark.parametrize("seed, twin", [(0, False), (1, False), (2, True)])
@pytest.mark.parametrize("floor", [0.0, 0.01, 0.1])
def test_solver_against_all_active_sets(seed, twin, floor):
    _, mean, cov = problem(5, seed=seed, twin=twin)
    w = O.dense_min_variance(mean, cov, floor)
    assert w @ cov @ w == pytest.approx(brute(mean, cov, floor)[0], rel=1e-9)
    total = 1 - 5 * floor
    low, high = (floor * mean.sum() + total * edge for edge in (mean.min(), mean.max()))
    for target in np.linspace(low, high, 7):
        w = O.dense_min_variance(mean, cov, floor, float(target))
        assert w.sum() == pytest.approx(1) and w.min() >= floor - 1e-12 and w @ mean == pytest.approx(target, abs=1e-9)
        assert w @ cov @ w == pytest.approx(brute(mean, cov, floor, target)[0], rel=1e-8)
    with pytest.raises(RuntimeError):
        O.dense_min_variance(mean, cov, floor, high + 0.1)


def test_solver_corner_cases():
    cov = np.diag([1.0, 2.0, 3.0])
    same = np.array([0.1, 0.1, 0.1])
    assert O.dense_min_variance(same, cov, 0.0, 0.1) == pytest.approx(np.array([6, 3, 2]) / 11)
    tied = np.array([0.1, 0.2, 0.2])
    assert O.dense_min_variance(tied, cov, 0.0, 0.2) == pytest.approx([0, 0.6, 0.4])
    assert O.dense_min_variance(np.array([0.3]), np.array([[1.0]]), 0.01) == pytest.approx([1.0])
    assert O.dense_min_variance(same, np.zeros((3, 3)), 0.1).sum() == pytest.approx(1.0)


def returns_frame(spark, **portfolios):
    rows = [(p, f"{p}{i:03d}", f"{2000 + d // 360}-{d % 360 // 30 + 1:02d}-{d % 30 % 28 + 1:02d}", float(v), d)
            for p, r in portfolios.items() for i, line in enumerate(r) for d, v in enumerate(line)]
    df = spark.createDataFrame(rows, "carteira string, serie string, data string, retorno double, d int")
    return df.selectExpr("carteira", "serie", "date_add(date'2000-01-01', d) as data", "retorno")


@pytest.fixture(scope="module")
def returns(spark):
    return returns_frame(spark, p=problem(40, 60, 5)[0], q=problem(7, 90, 6)[0]).persist()


def test_covariance_in_blocks(returns):
    for block in (512, 8):
        half = K.annual_cov(returns, ["carteira"], block=block)
        assert half.count() == 40 * 41 // 2 + 7 * 8 // 2 and not half.where("serie_i > serie_j").count()
        got = {v[:3]: v[3] for v in values(K.mirrored(half))}
        assert len(got) == 40 * 40 + 7 * 7
        for p, (n, days, seed) in {"p": (40, 60, 5), "q": (7, 90, 6)}.items():
            cov = problem(n, days, seed)[2]
            have = [[got[p, f"{p}{i:03d}", f"{p}{j:03d}"] for j in range(n)] for i in range(n)]
            assert np.allclose(have, cov, rtol=1e-10, atol=1e-15)
    single = K.annual_cov(returns.where("carteira = 'q'").drop("carteira"), block=2)
    assert single.count() == 28


@pytest.mark.parametrize("floor", [0.0, 0.002])
def test_column_generation_gets_the_dense_answer(returns, floor):
    """40 series on 60 dates, from all columns at once and from few columns that others join."""
    for seeds, batch in ((128, 64), (2, 5)):
        w = {v[:2]: v[2] for v in values(O.min_variance(returns, floor, ["carteira"], seeds=seeds, batch=batch))}
        assert len(w) == 47
        for p, (n, days, seed) in {"p": (40, 60, 5), "q": (7, 90, 6)}.items():
            _, mean, cov = problem(n, days, seed)
            have = np.array([w[p, f"{p}{i:03d}"] for i in range(n)])
            best = O.dense_min_variance(mean, cov, floor)
            assert have.sum() == pytest.approx(1) and have.min() >= floor - 1e-12
            assert have @ cov @ have == pytest.approx(best @ cov @ best, rel=1e-7)


def test_curve_does_not_depend_on_the_first_columns(returns):
    small = O.frontier(returns, 5, 0.002, ["carteira"])
    wide = O.frontier(returns, 5, 0.002, ["carteira"], seeds=2, batch=5)
    want, got = ({v[:2]: v[2:] for v in values(x, "carteira", "alvo_ix", "alvo", "retorno", "risco")} for x in (small, wide))
    assert got.keys() == want.keys() and len(got) == 10
    for key, row in got.items():
        assert row == pytest.approx(want[key], rel=1e-6)
    held = [{(r["carteira"], r["alvo_ix"]): {a["serie"] for a in r["acima"] if a["excesso"] > 1e-5} for r in x.collect()} for x in (small, wide)]
    assert held[0] == held[1] and max(map(len, held[0].values())) < 40
    assert "Pandas" not in wide._jdf.queryExecution().toString()  # solved once, then a table
    weights = O.frontier_weights(wide, returns, 0.002, ["carteira"])
    assert weights.count() == 5 * 47
    assert all(v[1] == pytest.approx(1) for v in values(weights.groupBy("carteira", "alvo_ix").sum("peso"), "alvo_ix", "sum(peso)"))


def test_single_wide_portfolio(returns):
    own = returns.where("carteira = 'p'").drop("carteira")
    w = np.array([v[1] for v in values(O.min_variance(own, 0.0, seeds=2))])
    _, mean, cov = problem(40, 60, 5)
    best = O.dense_min_variance(mean, cov, 0.0)
    assert w @ cov @ w == pytest.approx(best @ cov @ best, rel=1e-7)
    assert O.frontier(own, 3, 0.0, seeds=2).count() == 3


def test_floor_must_fit(returns):
    with pytest.raises(ValueError):
        O.min_variance(returns, -0.1, ["carteira"])
    own = returns.where("carteira = 'p'").drop("carteira")
    for job in (O.min_variance, O.frontier):
        assert {r["carteira"] for r in job(returns, floor=0.05, by=["carteira"]).select("carteira").collect()} == {"q"}
        with pytest.raises(ValueError, match="does not fit"):
            job(own, floor=0.05)
    mean = K.annual_mean(returns, ["carteira"]).withColumn("posicao", F.expr("cast(substring(serie, 2) as int)"))
    assert {r["carteira"] for r in E.corner(mean, 0.05, by=["carteira"]).collect()} == {"q"}
    with pytest.raises(Exception, match="does not fit"):
        E.corner(mean.where("carteira = 'p'").drop("carteira"), 0.05).collect()
    one = returns.where("serie = 'q001'").drop("carteira")
    with pytest.raises(RuntimeError):
        O.frontier(one)
    assert [v[1] for v in values(O.min_variance(one))] == pytest.approx([1.0])
    reasons = {r["carteira"]: r["motivo"] for r in K.feasibility(returns, ["carteira"], 0.05).collect()}
    assert "floor" in reasons["p"] and reasons["q"] is None


def test_corners_and_ties(spark):
    mean = spark.createDataFrame([("A", 2, 0.5), ("B", 1, 0.5), ("C", 3, 0.1)], "serie string, posicao int, media double")
    assert values(E.corner(mean, 0.1, "high")) == [("A", 0.1), ("B", pytest.approx(0.8)), ("C", 0.1)]
    assert values(E.corner(mean, 0.1, "low")) == [("A", 0.1), ("B", 0.1), ("C", pytest.approx(0.8))]
    low, high = (E.expected_return(E.corner(mean, 0.1, side), mean) for side in ("low", "high"))
    grid = [v[1] for v in values(E.target_grid(low, high, 1))]
    assert len(grid) == 3 and grid == pytest.approx(np.linspace(low.first()[0], high.first()[0], 3))


def test_fill_to_floor(spark):
    raw = spark.createDataFrame([("A", -0.2), ("B", 0.3), ("C", 0.5)], "serie string, peso double")
    got = dict(values(E.fill_to_floor(raw, 0.1)))
    assert sum(got.values()) == pytest.approx(1) and got["A"] == pytest.approx(0.1) and got["B"] == pytest.approx(0.1 + 0.7 / 3)
    flat = spark.createDataFrame([("A", 0.0), ("B", -1.0)], "serie string, peso double")
    assert dict(values(E.fill_to_floor(flat, 0.1))) == {"A": 0.5, "B": 0.5}


def test_candidates_are_floored_and_repeatable(spark):
    draw = lambda parts: {r["candidata"]: list(r["pesos"]) for r in E.candidate_weights(
        spark, ["A", "B", "C"], 400, 0.05).repartition(parts).collect()}
    one, many = draw(1), draw(7)
    assert one == many and len(one) == 400
    w = np.array(list(one.values()))
    assert np.allclose(w.sum(axis=1), 1) and w.min() >= 0.05 and np.abs(w.mean(axis=0) - 1 / 3).max() < 0.03
    with pytest.raises(ValueError):
        E.candidate_weights(spark, ["A", "B"], 10, 0.5)


@pytest.mark.parametrize("kind", ["random", "ties", "all_on_the_curve", "one_risk"])
def test_pareto_set_against_brute_force(spark, kind):
    n = 400
    risk, ret = RNG.random(n), RNG.random(n)
    if kind == "ties":
        risk, ret = np.round(risk, 1), np.round(ret, 1)
    elif kind == "all_on_the_curve":
        ret = risk.copy()
    elif kind == "one_risk":
        risk[: n // 2] = 0.5
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(risk, ret))],
                               "candidata int, risco double, retorno double")
    best = {}
    for a, b in zip(risk, ret):
        best[a] = max(b, best.get(a, -1))
    want, bar = set(), -1.0
    for a in sorted(best):
        if best[a] > bar:
            want.add((a, best[a]))
            bar = best[a]
    for slice_rows in (100_000, 20):
        assert set(values(E.pareto_set(df, slice_rows), "risco", "retorno")) == want


def test_buckets_and_efficient_flag(spark):
    df = spark.createDataFrame([(0, 0.2, 0.0), (1, 0.1, 0.4), (2, 0.3, 0.41), (3, 0.4, 1.0)],
                               "candidata int, risco double, retorno double")
    assert values(E.lowest_risk_per_bucket(df, 2), "faixa", "candidata") == [(0, 1), (1, 3)]
    assert values(E.efficient_flag(df), "candidata", "eficiente") == [(0, False), (1, True), (2, True), (3, True)]
    same = df.selectExpr("candidata", "risco", "0.5D as retorno")
    assert values(E.lowest_risk_per_bucket(same, 3), "faixa", "candidata") == [(0, 1)]


def test_every_answer_meets_the_optimality_conditions():
    """10,000 problems of three to eight series, also singular, badly scaled and with twins, along their curves."""
    rng, worst, solved = np.random.default_rng(5), 0.0, 0
    for k in range(1430):
        n, days, floor = int(rng.integers(3, 9)), int(rng.integers(4, 90)), float(rng.choice([0, 0.01, 0.05]))
        r = rng.normal(0, 0.02, (n, days)) * rng.choice([1, 1e-3, 10], n)[:, None] ** (k % 3 == 0) + rng.normal(0, 0.01, days) * (k % 2)
        if k % 7 == 0:
            r[-1] = r[0]
        if k % 11 == 0:
            r[1] = 0
        mean, cov = r.mean(axis=1) * 252, np.cov(r) * 252
        base, total, near = floor * cov.sum(axis=1), 1 - floor * n, None
        ends = [floor * mean.sum() + total * x for x in (mean.min(), mean.max())]
        for target in [*np.linspace(*ends, 6), None]:
            need = None if target is None else target - floor * mean.sum()
            x, level, slope, edge = O.excess_over_floor(mean, cov, base, total, need, near if target is not None else None)
            near, solved = (x if edge is None else None), solved + 1
            assert abs(x.sum() - total) < 1e-9 and x.min() >= 0
            if edge is None:
                assert need is None or abs(mean @ x - need) < 1e-9 * max(1.0, np.ptp(mean))
                pull = cov @ x + base - level - slope * mean
                worst = max(worst, -pull.min() / np.abs(cov).max(), np.abs(pull[x > 0]).max() / np.abs(cov).max())
    assert solved > 10_000 and worst < 1e-9


def test_small_problems_against_every_active_set():
    rng = np.random.default_rng(8)
    for k in range(60):
        n = int(rng.integers(3, 7))
        _, mean, cov = problem(n, seed=100 + k, twin=k % 5 == 0)
        for target in np.linspace(0.01 * mean.sum() + (1 - 0.01 * n) * mean.min(), 0.01 * mean.sum() + (1 - 0.01 * n) * mean.max(), 5)[1:4]:
            w = O.dense_min_variance(mean, cov, 0.01, float(target))
            assert w @ cov @ w == pytest.approx(brute(mean, cov, 0.01, target)[0], rel=1e-9)


def test_wide_selections_in_blocks(spark):
    """70 funds in blocks of about 16 against whole matrices; no fund is named in a plan."""
    from navgrid.operators import wide as W
    returns, mean, cov = problem(70, 40, 9)
    frame = returns_frame(spark, p=returns).drop("carteira")
    names = [f"p{i:03d}" for i in range(70)]
    blocks = W.fund_blocks(frame.select("serie"), 16)
    assert blocks.count() == 70 and blocks.select("bloco").distinct().count() > 3
    ids = spark.range(90).withColumnRenamed("id", "candidata")
    drawn = W.draw_weights(ids, blocks, 0.002)
    long = {v[:2]: v[2] for v in values(W.long_blocks(drawn, blocks), "candidata", "serie", "peso")}
    plain = {r["candidata"]: r["pesos"] for r in E.candidate_weights(spark, names, 90, 0.002).collect()}
    assert len(long) == 90 * 70 and all(long[c, x] == pytest.approx(w, rel=1e-12) for c in plain for x, w in zip(names, plain[c]))
    dense = W.dense_blocks(K.annual_cov(frame, block=32), K.annual_mean(frame), blocks)
    scored = W.score_wide(drawn, blocks, dense, 40)
    got = {r["candidata"]: (r["retorno"], r["risco"]) for r in scored.collect()}
    for c, w in plain.items():
        w = np.array(w)
        assert got[c] == pytest.approx((w @ mean, np.sqrt(w @ cov @ w)), rel=1e-9)
    for df in (drawn, scored):
        assert "p001" not in df._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="does not fit"):
        W.draw_weights(ids, blocks, 0.02)


def test_certificate_of_a_curve_tells_right_from_wrong_weights():
    from navgrid.operators.optimise import dense_min_variance
    from navgrid.queries.frontiers import _FLOOR, _certified
    r = np.random.default_rng(3).normal(0.001, 0.01, (5, 90))
    mean, cov, names = r.mean(axis=1) * 252, np.cov(r) * 252, list("dbaec")
    low, high = (_FLOOR * mean.sum() + (1 - _FLOOR * 5) * x for x in (mean.min(), mean.max()))
    curve = [dense_min_variance(mean, cov, _FLOOR, low + k * (high - low) / 9) for k in range(10)]
    moved = curve[5] + 0.05 * np.where(np.arange(5) == curve[5].argmax(), -1, 0.25)
    wrong = [moved, curve[5] * 1.001, np.where(curve[0] == curve[0].min(), 0.005, curve[0])]
    points = [*curve, *wrong]
    vectors = pd.DataFrame({"carteira": "x", "serie": names, "retornos": list(r)})
    weights = pd.DataFrame([("x", k, s, p) for k, w in enumerate(points) for s, p in zip(names, w)], columns=["carteira", "alvo_ix", "serie", "peso"])
    found = _certified(("x",), vectors, weights.sample(frac=1, random_state=1))
    assert found["alvo_ix"].tolist() == list(range(13)) and set(found["carteira"]) == {"x"}
    assert found["otima"].tolist()[:11] == [True] * 10 + [False]
    assert found["soma_um"].tolist()[:12] == [True] * 11 + [False]
    assert found["no_piso_ou_acima"].tolist()[:10] + [found["no_piso_ou_acima"].iloc[12]] == [True] * 10 + [False]
    assert np.allclose(found["_risco"], [np.sqrt(w @ cov @ w) for w in points], rtol=1e-12)


def test_certificate_joins_no_returns_by_date(spark):
    import re

    import __spark_entry__ as entry
    plan = entry.queries()["f10_frontier"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Join \[carteira#\d+, data#\d+", plan) and "FlatMapCoGroupsInPandas" in plan
    assert not re.search(r"BroadcastHashJoin \[carteira#\d+, alvo_ix#\d+(, serie#\d+)?\], .* BuildRight", plan)  # rows of points and holdings
