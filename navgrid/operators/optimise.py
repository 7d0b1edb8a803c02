"""Minimum-variance portfolios with a floor per series, for any number of portfolios.

Portfolios of every width go the same way, column generation: a task solves the problem over some of a portfolio's
series (all of them while they are few), Spark prices all series in parallel, and series that would lower the risk join
the next round. The optimum is exact, and only the series that carry more than the floor have to meet in one task.
"""

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from navgrid.operators.panel import attach
from navgrid.operators.risk import return_vectors
from navgrid.schema import FRONTIER_POINTS, MIN_ALLOCATION, TRADING_DAYS
from navgrid.session import discard, materialise, spread

SEEDS = 128  # series of a portfolio that the first round starts from, about
BATCH = 64  # series that enter per target and round
TARGETS = 10  # targets of a curve that one task solves over shared columns
PART = 5_000  # series priced against one copy of a portfolio's solutions


# --- small dense problem, used inside tasks ------------------------------------------------------------------

KKT = 1e-10  # largest violation of an optimality condition, in units of the largest covariance, at which an answer counts


def solve_excess(cov: np.ndarray, base: np.ndarray, total: float, mean: np.ndarray | None = None, target: float = 0.0,
                 near: np.ndarray | None = None) -> tuple[np.ndarray, float, float]:
    """Minimise x'Cx/2 + base'x over x >= 0 with sum(x) = total and, if given, mean'x = target.

    Returns x and the multipliers of the two equalities. An interior point method finds which series are above zero, and
    an active-set method goes on from there to the exact solution; ``near``, the answer to a neighbouring problem, is tried
    first in its place. An answer counts only if it meets all optimality conditions, otherwise RuntimeError.
    """
    n = len(base)
    scale = max(float(np.abs(cov).max()) * total, float(np.abs(base).max()), 1e-300)
    h, c = cov * (total / scale), base / scale       # unknown is x / total
    rows, right = [np.ones(n)], [1.0]
    if mean is not None:
        width = max(float(np.ptp(mean)), 1e-300)
        centre = float(mean.mean())
        rows.append((mean - centre) / width)
        right.append((target / total - centre) / width)
    a, b = np.array(rows), np.array(right)
    for guess in (near, None):
        if guess is not None:
            x, free = guess / total, guess > 0
        elif near is None or found is None:
            x, slack = _interior(h, c, a, b)
            free = x > slack
        else:
            break
        found = _active_set(h, c, a, b, x, free)
    if found is None:
        raise RuntimeError("the optimisation did not converge")
    x, y = found
    slope = scale * y[1] / width if mean is not None else 0.0
    return x * total, scale * y[0] - (slope * centre if mean is not None else 0.0), slope


def _interior(h: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x near the solution and the slack of each x >= 0: primal-dual steps with a predictor and a corrector.

    The corrector is left out, and the step centred, whenever the last round did not bring the gap down. Where the rounds
    end does not matter for the result: it is the start of the active-set method.
    """
    n = len(c)
    x, s, y, last = np.full(n, 1.0 / n), np.ones(n), np.zeros(len(b)), np.inf
    for _ in range(60):
        dual, primal, gap = h @ x + c - a.T @ y - s, a @ x - b, float(x @ s) / n
        if gap < 1e-14 and np.abs(primal).max() < 1e-12 and np.abs(dual).max() < 1e-11:
            break
        kkt = np.block([[h + np.diag(s / x), -a.T], [a, np.zeros((len(b), len(b)))]])

        def step(cross: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            d = _solved(kkt, np.concatenate([-dual - cross / x, -primal]))
            return d[:n], d[n:], -(cross + s * d[:n]) / x

        dx, dy, ds = step(x * s)
        reach = float((x + _reach(x, dx) * dx) @ (s + _reach(s, ds) * ds)) / n
        if gap < 0.9 * last:
            dx, dy, ds = step(x * s + dx * ds - max((reach / gap) ** 3, 1e-8) * gap)
        else:
            dx, dy, ds = step(x * s - 0.3 * gap)
        if not (np.isfinite(dx).all() and np.isfinite(ds).all()):
            break
        move, last = 0.995 * min(_reach(x, dx), _reach(s, ds)), gap
        x, y, s = np.maximum(x + move * dx, 1e-300), y + move * dy, np.maximum(s + move * ds, 1e-300)
    return x, s


def _solved(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    try:
        found = np.linalg.solve(matrix, right)
        if np.abs(matrix @ found - right).max() <= 1e-11 * max(1.0, float(np.abs(right).max())):
            return found
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(matrix, right, rcond=None)[0]


def _active_set(h: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray, x: np.ndarray,
                free: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Exact solution and multipliers, from a guess of x and of the set above zero; None without an optimal answer.

    Solves the equalities over the free set, stops at the first bound on the way and takes that series out, or, with no
    bound in the way, lets the series in that lowers the risk most.
    """
    n, m = len(c), len(b)
    free = free.copy() if free.any() else np.ones(n, bool)
    x = np.where(free, np.maximum(x, 0.0), 0.0)
    for _ in range(20 * n + 100):
        at = np.flatnonzero(free)
        z = _solved(np.block([[h[np.ix_(at, at)], -a[:, at].T], [a[:, at], np.zeros((m, m))]]), np.concatenate([-c[at], b]))
        z, y = z[:len(at)], z[len(at):]
        if np.abs(a[:, at] @ z - b).max() > KKT:  # these series cannot meet the target
            ends = [int(a[-1].argmin()), int(a[-1].argmax())]
            if free[ends].all():
                return None
            free[ends] = True
            continue
        below = z < -1e-14
        if below.any():
            way = np.where(below, x[at] / np.maximum(x[at] - z, 1e-300), np.inf)
            first = int(way.argmin())
            x[at] = np.maximum(x[at] + min(way[first], 1.0) * (z - x[at]), 0.0)
            x[at[first]] = 0.0
            free[at[first]] = False
            continue
        x = np.zeros(n)
        x[at] = np.maximum(z, 0.0)
        price = h @ x + c - a.T @ y
        outside = np.where(free, np.inf, price)
        enters = int(outside.argmin())
        if outside[enters] >= -KKT / 10:
            good = np.abs(a @ x - b).max() <= KKT and np.abs(price[at]).max() <= KKT
            return (x, y) if good else None
        free[enters] = True
    return None


def _reach(x: np.ndarray, d: np.ndarray) -> float:
    falling = d < 0
    return min(1.0, float((-x[falling] / d[falling]).min())) if falling.any() else 1.0


def excess_over_floor(mean: np.ndarray, cov: np.ndarray, base: np.ndarray, total: float, need: float | None,
                      near: np.ndarray | None = None) -> tuple[np.ndarray, float, float, float | None]:
    """Optimal amounts above the floor, the two multipliers, and the mean that binds at an end of the range.

    ``need`` is the return asked of the amounts above the floor (None: no target). At either end of the
    reachable range only the series with that mean can carry more than the floor. ``near`` are the amounts of a
    neighbouring target.
    """
    chosen, edge = np.arange(len(mean)), None
    if need is not None:
        spread = float(np.ptp(mean))
        if spread <= 1e-14 * max(1.0, float(np.abs(mean).max())):
            need = None
        else:
            level = (need / total - float(mean.min())) / spread
            if not -1e-9 <= level <= 1.0 + 1e-9:
                raise RuntimeError("the return target cannot be reached")
            if level <= 1e-12 or level >= 1.0 - 1e-12:
                edge = float(mean.min() if level <= 0.5 else mean.max())
                chosen, need = np.flatnonzero(np.abs(mean - edge) <= 1e-12 * spread), None
    excess, level, slope = np.zeros(len(mean)), 0.0, 0.0
    part = cov[np.ix_(chosen, chosen)]
    if len(chosen) == 1:
        excess[chosen] = total
        level = float(part[0, 0] * total + base[chosen][0])
    else:
        found, level, slope = solve_excess(part, base[chosen], total, None if need is None else mean[chosen], need or 0.0,
                                           None if need is None or near is None else near[chosen])
        excess[chosen] = total * found / found.sum()
    return excess, level, slope, edge


def dense_min_variance(mean: np.ndarray, cov: np.ndarray, floor: float, target: float | None = None) -> np.ndarray:
    """Weights of the lowest variance with a floor per series and, if given, an exact expected return."""
    need = None if target is None else target - floor * float(mean.sum())
    return floor + excess_over_floor(mean, cov, floor * cov.sum(axis=1), 1.0 - floor * len(mean), need)[0]


# --- jobs ----------------------------------------------------------------------------------------------------

def min_variance(returns: DataFrame, floor: float = MIN_ALLOCATION, by: Sequence[str] = (), seeds: int = SEEDS,
                 batch: int = BATCH) -> DataFrame:
    """(serie, peso) of the minimum-variance portfolio of each panel.

    With ``by``, panels that the floor does not fit are left out (``risk.feasibility`` names the reason) and the
    others are solved; a single panel that cannot be solved is an error. ``returns`` is read more than once.
    """
    vectors, totals, keys = _inputs(returns, floor, by)
    problems = totals.withColumn("alvo_ix", F.lit(0)).withColumn("alvo", F.lit(None).cast("double"))
    solved = _column_generation(vectors, problems, keys, seeds, batch)
    if not by and not solved.limit(1).count():
        raise RuntimeError("The minimum-variance portfolio could not be computed.")
    held = solved.select(*keys, F.inline("acima"))
    return (attach(vectors, solved.select(*keys, F.lit(True).alias("_resolvida")), tuple(by), "_resolvida")
            .join(held, [*keys, "serie"], "left")
            .select(*by, "serie", (floor + F.coalesce("excesso", F.lit(0.0))).alias("peso")))


def frontier(returns: DataFrame, points: int = FRONTIER_POINTS, floor: float = MIN_ALLOCATION, by: Sequence[str] = (),
             seeds: int = SEEDS, batch: int = BATCH) -> DataFrame:
    """Minimum-variance curve of each panel: (alvo_ix, alvo, risco, retorno, acima) per reachable target.

    Targets run from the lowest-return corner to the highest-return corner. ``acima`` lists what the series hold above
    the floor; ``frontier_weights`` turns it into full weights. A target that fails is left out. With ``by``, panels
    with one series, an unfit floor or fewer than two points are left out; a single such panel is an error. The curve
    is a written table: reading it again solves nothing again.
    """
    k = max(3, points)
    vectors, totals, keys = _inputs(returns, floor, by)
    low, high = (F.col("piso_retorno") + F.col("total") * F.col(c) for c in ("menor", "maior"))
    problems = (totals.where("n > 1").withColumn("alvo_ix", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
                .withColumn("alvo", F.when(F.col("alvo_ix") == k - 1, high)
                            .otherwise(low + F.col("alvo_ix") * (high - low) / F.lit(k - 1))))
    curve = _column_generation(vectors, problems, keys, seeds, batch)
    enough = curve.groupBy(*keys).count().where("count > 1")
    if not by and not enough.limit(1).count():
        raise RuntimeError("A curve takes two series and two reachable targets at least.")
    return curve.join(enough.select(*keys), keys, "left_semi").select(*by, "alvo_ix", "alvo", "risco", "retorno", "acima")


def frontier_weights(curve: DataFrame, members: DataFrame, floor: float = MIN_ALLOCATION,
                     by: Sequence[str] = ()) -> DataFrame:
    """(alvo_ix, serie, peso): every series of the panel at every target of its curve."""
    targets = curve.groupBy(*by).agg(F.collect_list("alvo_ix").alias("_alvos"))
    grid = (attach(members.select(*by, "serie").distinct(), targets, by, "_alvos")
            .select(*by, "serie", F.explode("_alvos").alias("alvo_ix")))
    above = curve.select(*by, "alvo_ix", F.inline("acima"))  # many rows from a small file: by size it would be broadcast
    return (grid.join(above.hint("merge"), [*by, "alvo_ix", "serie"], "left")
            .select(*by, "alvo_ix", "serie", (floor + F.coalesce("excesso", F.lit(0.0))).alias("peso")))


def _fields(frame: DataFrame, by: Sequence[str], *more: T.StructField) -> T.StructType:
    return T.StructType([*(frame.schema[c] for c in by), *more])


_ABOVE = T.ArrayType(T.StructType([T.StructField("serie", T.StringType()), T.StructField("excesso", T.DoubleType())]))
_SOLVED = (T.StructField("alvo_ix", T.IntegerType()), T.StructField("alvo", T.DoubleType()),
           T.StructField("risco", T.DoubleType()), T.StructField("retorno", T.DoubleType()),
           T.StructField("acima", _ABOVE), T.StructField("centrado", T.ArrayType(T.DoubleType())),
           T.StructField("nivel", T.DoubleType()), T.StructField("inclinacao", T.DoubleType()),
           T.StructField("borda", T.DoubleType()), T.StructField("folga_borda", T.DoubleType()),
           T.StructField("tolerancia", T.DoubleType()))


def _inputs(returns: DataFrame, floor: float, by: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Return vectors (written once, every round reads them) and one row per panel that the floor fits.

    ``base`` is the return series of the floor holdings alone, a sum per date.
    """
    if not 0.0 <= floor < 1.0:
        raise ValueError("The floor must lie in [0, 1).")
    keys = list(by) or ["_tudo"]
    if not by:
        returns = returns.withColumn("_tudo", F.lit(0))
    mean = F.aggregate("retornos", F.lit(0.0), lambda a, x: a + x) / F.size("retornos") * TRADING_DAYS
    vectors = materialise(return_vectors(returns, keys).withColumn("media", mean))
    daily = returns.groupBy(*keys, "data").agg((F.sum("retorno") * floor).alias("_b"))
    base = (daily.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("data", "_b"))).alias("_l"))
            .select(*keys, F.col("_l._b").alias("base")))
    totals = vectors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("media").alias("menor"), F.max("media").alias("maior"),
        (F.sum("media") * floor).alias("piso_retorno"))
    totals = totals.withColumn("total", 1.0 - floor * F.col("n")).withColumn("partes", F.ceil(F.col("n") / PART).cast("int"))
    totals = materialise(totals.where("total > 0").join(base, keys))
    if not by and not totals.limit(1).count():
        raise ValueError(f"A floor of {floor} does not fit the number of series.")
    sized = vectors.join(totals.select(*keys, "n", "partes"), keys) if by else attach(vectors, totals, (), "n", "partes")
    return sized.withColumn("parte", F.pmod(F.xxhash64("serie"), F.col("partes")).cast("int")), totals, keys


def _column_generation(vectors: DataFrame, problems: DataFrame, keys: list[str], seeds: int, batch: int) -> DataFrame:
    """Exact optimum over all series while only those above the floor meet in one task.

    Each round solves the problems restricted to the columns found so far, then prices every series in parallel: a
    series whose marginal variance lies below what the multipliers allow would lower the risk and joins the columns, up
    to ``batch`` per problem and round. No such series left means optimal for the whole panel. The optimum needs about
    as many columns as there are dates at most, so a restricted problem is bounded by the calendar, not by the width.
    """
    problems = materialise(problems.withColumn("bloco", F.expr(f"alvo_ix div {TARGETS}").cast("int")))
    task = [*keys, "bloco"]
    energy = F.aggregate("retornos", F.lit(0.0), lambda a, x: a + x * x)
    ends = vectors.groupBy(*keys).agg(
        F.min_by("serie", F.struct("media", "serie")).alias("_a"),
        F.max_by("serie", F.struct("media", "serie")).alias("_b"),
        F.min_by("serie", F.struct(energy, "serie")).alias("_c"))
    first = (ends.select(*keys, F.explode(F.array("_a", "_b", "_c")).alias("serie"))
             .union(vectors.where(F.pmod(F.xxhash64("serie", F.lit(1)), F.col("n")) < seeds).select(*keys, "serie")).distinct())
    columns, finished = materialise(problems.select(*task).distinct().join(first, keys)), []
    priced = problems.where(F.col("n") > seeds).limit(1).count() > 0  # panels of up to `seeds` series start with all of them
    while True:
        restricted = spread(columns.hint("merge").join(vectors, [*keys, "serie"]).select(*task, "serie", "retornos", "media"), *task)
        solved = materialise(restricted.groupBy(*task).cogroup(spread(problems, *task).groupBy(*task)).applyInPandas(
            _restricted(task), _fields(problems, task, *_SOLVED)))
        if not priced:
            discard(columns, problems)
            return solved.drop("bloco")
        entering = materialise(
            _price(vectors.where(F.col("n") > seeds), solved, problems, keys, task).where(F.col("_ordem") <= batch).select(*task, "serie").distinct()
            .join(columns, [*task, "serie"], "left_anti"))
        if entering.isEmpty():
            discard(columns, entering, problems)
            return reduce(DataFrame.unionByName, [*finished, solved]).drop("bloco")
        open_tasks = entering.select(*task).distinct()
        finished.append(materialise(solved.join(open_tasks, task, "left_anti")))
        left = materialise(problems.join(open_tasks, task, "left_semi"))
        wider = materialise(columns.join(open_tasks, task, "left_semi").unionByName(entering))
        discard(columns, entering, problems, solved)
        columns, problems = wider, left


def _price(vectors: DataFrame, solved: DataFrame, problems: DataFrame, keys: list[str], task: list[str]) -> DataFrame:
    """Series that would lower the risk of a problem, most useful first.

    A wide panel is priced in parts, each with a copy of its solutions, so one panel is not one join key.
    """
    marginal = F.aggregate(F.zip_with("retornos", "centrado", lambda r, p: r * p), F.lit(0.0),
                           lambda a, x: a + x) * TRADING_DAYS / F.greatest(F.size("retornos") - 1, F.lit(1))
    gain = marginal - F.col("nivel") - F.col("inclinacao") * F.col("media")
    allowed = F.col("borda").isNull() | (F.abs(F.col("media") - F.col("borda")) <= F.col("folga_borda"))
    best = Window.partitionBy(*task, "alvo_ix").orderBy("_ganho", "serie")
    parts = problems.select(*keys, "partes").distinct()
    copies = (solved.select(*task, "alvo_ix", "centrado", "nivel", "inclinacao", "borda", "folga_borda", "tolerancia")
              .join(parts, keys).withColumn("parte", F.explode(F.sequence(F.lit(0), F.col("partes") - 1))).drop("partes"))
    return (vectors.select(*keys, "parte", "serie", "retornos", "media").join(copies, [*keys, "parte"])
            .where(allowed).select(*task, "alvo_ix", "serie", "tolerancia", gain.alias("_ganho"))
            .where(F.col("_ganho") < -F.col("tolerancia"))
            .withColumn("_ordem", F.row_number().over(best)))


def _restricted(task: list[str]):
    def solve(key: tuple, group: pd.DataFrame, problems: pd.DataFrame) -> pd.DataFrame:
        group, out = group.sort_values("serie"), []
        if len(group):
            names = group["serie"].tolist()
            rows = np.stack(group["retornos"].to_numpy()).astype(float)
            base, days = np.asarray(problems["base"].iloc[0], dtype=float), rows.shape[1]
            mean = group["media"].to_numpy(dtype=float)
            centred = rows - rows.mean(axis=1, keepdims=True)
            year = TRADING_DAYS / max(days - 1, 1)
            cov, pull = centred @ centred.T * year, centred @ (base - base.mean()) * year
        near = None
        for row in problems.sort_values("alvo_ix").to_dict("records") if len(group) else ():
            target = None if pd.isna(row["alvo"]) else float(row["alvo"])
            need = None if target is None else target - float(row["piso_retorno"])
            try:
                excess, level, slope, edge = excess_over_floor(mean, cov, pull, float(row["total"]), need, near)
                near = excess if edge is None else None
            except RuntimeError:
                continue
            path = base + excess @ rows
            path -= path.mean()
            out.append({
                **dict(zip(task, key)), "alvo_ix": row["alvo_ix"], "alvo": target,
                "risco": float(np.sqrt(float(path @ path) * year)), "retorno": float(row["piso_retorno"] + excess @ mean),
                "acima": [{"serie": s, "excesso": float(x)} for s, x in zip(names, excess) if x > 1e-13],
                "centrado": path, "nivel": level, "inclinacao": slope, "borda": edge,
                "folga_borda": 1e-12 * float(row["maior"] - row["menor"]),
                "tolerancia": 1e-9 * max(float(np.abs(cov).max()), 1e-300)})
        return pd.DataFrame(out, columns=[*task, *(f.name for f in _SOLVED)])
    return solve
