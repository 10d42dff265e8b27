"""Models of outcomes: logistic fits, pairwise odds, priors by method and round, metrics, splits and searches.

Fits loop on the driver over sums that Spark aggregates: a round brings d + d(d+1)/2 numbers for d features, whatever the number of rows. Rows with a
null label or feature are left out; a fit over no rows gives the prior.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boutline.functions.bouts import sigmoid
from boutline.operators.durable import checkpointed


@dataclass(frozen=True)
class Logistic:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float
    means: tuple[float, ...]
    scales: tuple[float, ...]

    def score(self) -> Column:
        """The log-odds of a row."""
        z = F.lit(self.bias)
        for name, weight, mean, scale in zip(self.features, self.weights, self.means, self.scales):
            z = z + weight * (F.col(name) - mean) / scale
        return z

    def predict(self) -> Column:
        return sigmoid(self.score())


#: Rows of a batch that a task multiplies at once.
ROWS = 65_536


def _sums_by_window(rows: DataFrame, starts: list[int | None], width: int, of: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each window the sum over its training rows (day before the start; None: all rows) of `of(window, x, y)`, a vector of `width` numbers from a batch's matrix and labels.
    Tasks add up their own rows, and the vectors' parts are summed by Spark."""

    def run(batches):
        total = np.zeros((len(starts), width))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                y, day = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for w, start in enumerate(starts):
                    inside = slice(None) if start is None else day < start
                    total[w] += of(w, x[inside], y[inside])
        window, part = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(window, pa.int32()), pa.array(part, pa.int32()), pa.array(total.ravel())], names=["window", "part", "value"])

    out = np.zeros((len(starts), width))
    for r in rows.mapInArrow(run, "window int, part int, value double").groupBy("window", "part").agg(F.sum("value").alias("value")).collect():  # width numbers a window
        out[r["window"], r["part"]] = r["value"]
    return out


def _logistic(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = x @ weights
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def prepared(df: DataFrame, features: list[str], label: str, day: str | None = None) -> DataFrame:
    """x (array of the features), y, day (a number) of the rows that have them all, written once: what a fit reads in each of its rounds."""
    number = F.lit(0) if day is None else F.unix_date(day)
    d = df.select(*(F.col(f).cast("double").alias(f"_x{k}") for k, f in enumerate(features)), F.col(label).cast("double").alias("y"), number.alias("day")).dropna()
    return checkpointed(d.select(F.array(*(f"_x{k}" for k in range(len(features)))).alias("x"), "y", "day"))


def fit_windows(
    rows: DataFrame,
    features: list[str],
    windows: list[tuple[str, str]] | None,
    l2: float = 0.01,
    prior: list[float] | None = None,
    intercept: bool = True,
    standardize: bool = True,
    per_row: bool = True,
    rounds: int = 50,
) -> list[Logistic]:
    """For each window the minimum, over the rows before its start, of log-loss + l2/2 |weights - prior|^2 by Newton steps (M06, M13); the bias is free.

    rows: of `prepared`.  All windows take a step in one aggregation, and one that has come to rest keeps its weights.  windows: (start, end) days, or None for one fit
    over all rows.  `per_row`: the loss is a mean, else a sum.  A window without rows gets the prior."""
    starts = [None] if windows is None else [(datetime.date.fromisoformat(a) - datetime.date(1970, 1, 1)).days for a, _ in windows]
    k, n_windows = len(features), len(starts)
    base = np.array(prior or [0.0] * k, float)
    moments = _sums_by_window(rows, starts, 1 + 2 * k, lambda w, x, y: np.concatenate([[len(y)], x.sum(0), (x * x).sum(0)]))
    n = moments[:, 0]
    means, scales = np.zeros((n_windows, k)), np.ones((n_windows, k))
    if standardize:
        some = np.maximum(n, 1)[:, None]
        means = moments[:, 1 : k + 1] / some
        spread = _sums_by_window(rows, starts, k, lambda w, x, y: ((x - means[w]) ** 2).sum(0))
        scales = np.where(spread > 0, np.sqrt(spread / some), 1.0)
    weights = np.tile(np.append(base, 0.0), (n_windows, 1))
    target = weights.copy()
    moving = n > 0
    for _ in range(rounds):
        if not moving.any():
            break

        def step(w: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            if not moving[w]:  # noqa: B023
                return np.zeros((k + 1) * (k + 2))
            z = np.column_stack([(x - means[w]) / scales[w], np.full(len(x), float(intercept))])
            p = _logistic(z, weights[w])  # noqa: B023
            return np.concatenate([z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

        sums = _sums_by_window(rows, starts, (k + 1) * (k + 2), step)
        for w in np.flatnonzero(moving):
            pull = np.diag([l2 * (n[w] if per_row else 1)] * k + [0.0 if intercept else 1.0])
            gradient = sums[w, : k + 1] + pull @ (weights[w] - target[w])
            hessian = sums[w, k + 1 :].reshape(k + 1, k + 1) + pull
            move = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            weights[w] = weights[w] - move
            moving[w] = np.abs(move).max() >= 1e-9
    return [Logistic(tuple(features), tuple(map(float, v[:k])), float(v[k]) if intercept else 0.0, tuple(map(float, m)), tuple(map(float, s))) for v, m, s in zip(weights, means, scales)]


def window_metrics(rows: DataFrame, models: list[Logistic], windows: list[tuple[str, str]]) -> DataFrame:
    """window, part (train or test), log_loss, accuracy (half for even odds), n: each window's model on the rows before its start and on those inside it (M13), in one
    aggregation; null for a part without rows."""
    x = lambda m: [(F.get("x", F.lit(k)) - a) / s for k, (a, s) in enumerate(zip(m.means, m.scales))]
    odds = [sigmoid(sum((w * v for w, v in zip(m.weights, x(m))), F.lit(m.bias))) for m in models]
    day = lambda d: F.lit((datetime.date.fromisoformat(d) - datetime.date(1970, 1, 1)).days)
    parts = [
        F.struct(F.lit(w).alias("window"), F.when(F.col("day") < day(a), "train").when(F.col("day") < day(b), "test").alias("part"), p.alias("p"))
        for w, ((a, b), p) in enumerate(zip(windows, odds))
    ]
    scored = rows.select("y", F.explode(F.array(*parts)).alias("w")).select("y", "w.*").where("part IS NOT NULL")
    loss, right, n = metrics(F.col("p"), F.col("y") == 1)
    return scored.groupBy("window", "part").agg(loss, right, n)


def fit_logistic(df: DataFrame, features: list[str], label: str, l2: float = 0.01, prior: list[float] | None = None, intercept: bool = True, standardize: bool = True, per_row: bool = True, rounds: int = 50) -> Logistic:
    """`fit_windows` over all rows of `df` at once (M01, M06); without rows the prior."""
    return fit_windows(prepared(df, features, label), features, None, l2, prior, intercept, standardize, per_row, rounds)[0]


def slopes(df: DataFrame, model: Logistic, label: str, l2: float = 0.01, prior: list[float] | None = None, per_row: bool = True) -> list[float]:
    """The slope of the fitted loss in each weight and the bias: zero at the minimum. One aggregation."""
    d = df.select(*(F.col(f).cast("double").alias(f) for f in model.features), F.col(label).cast("double").alias("_y")).dropna()
    miss = model.predict() - F.col("_y")
    x = [(F.col(f) - m) / s for f, m, s in zip(model.features, model.means, model.scales)] + [F.lit(1.0)]
    total, *sums = d.agg(F.count("*"), *(F.sum(miss * v) for v in x)).first()
    pull = [(total if per_row else 1) * l2 * (w - b) for w, b in zip(model.weights, prior or [0.0] * len(model.weights))]
    return [(a + b) / max(1, total) for a, b in zip(sums, [*pull, 0.0])]


def compare_runs(one: DataFrame, other: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How two runs of the same computation differ (M16): rows in both, in one only, moved by over 1e-9, mean and largest move. One row."""
    a, b = one.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a")), other.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    d = a.join(b, keys, "full_outer")
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    move = F.when(both, F.abs(F.col("_a") - F.col("_b")))
    return d.agg(F.count_if(both).alias("both"), F.count_if(F.col("_in_b").isNull()).alias("first_only"), F.count_if(F.col("_in_a").isNull()).alias("second_only"), F.count_if(move > 1e-9).alias("moved"), F.avg(move).alias("mean_move"), F.max(move).alias("largest_move"))


def pairwise_odds(rating_a: Column, rd_a: Column, rating_b: Column, rd_b: Column, sure: float = 170, unsure: float = 215) -> Column:
    """struct<win_a, win_b, gap, confidence> of two ratings with their deviations."""
    q = math.log(10) / 400
    g = 1 / F.sqrt(1 + 3 * q * q * (rd_a * rd_a + rd_b * rd_b) / math.pi**2)
    win = 1 / (1 + F.pow(F.lit(10.0), -g * (rating_a - rating_b) / 400))
    worst = F.greatest(rd_a, rd_b)
    return F.struct(win.alias("win_a"), (1 - win).alias("win_b"), (rating_a - rating_b).alias("gap"), F.when(worst <= sure, "high").when(worst <= unsure, "medium").otherwise("low").alias("confidence"))


# The weights of the matchup layer.
MATCHUP_WEIGHTS = {"rating": 0.6633505309529707, "age": -0.13034075946048312, "veteran": -0.2650612454802724, "strikes": 0.19662455261900028, "control": 0.1515534399750711, "knockdowns": -0.1379241803221048, "layoff": -0.20823094827955393, "reach": 0.11174431463867403}


def matchup_terms(win: Column, a: Column, b: Column, knockdowns_per_15: float, veteran: float = 31, layoff: float = 15, minutes: float = 30) -> dict[str, Column]:
    """The eight terms of a matchup, positive where they speak of `a` (M05). Sides are structs of age, reach_cm, months_since (any may be null), minutes,
    landed, absorbed, control, controlled, kd_absorbed; rates are shrunk as by `minutes` more of an even bout."""
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), win))
    both = lambda x, y: F.coalesce(x - y, F.lit(0.0))
    strikes = lambda s: (s["landed"] - s["absorbed"]) / (s["minutes"] + minutes)
    control = lambda s: (s["control"] + 30 * minutes) / (s["control"] + s["controlled"] + 60 * minutes)
    downs = lambda s: 15 * (s["kd_absorbed"] + knockdowns_per_15 * minutes / 15) / (s["minutes"] + minutes)
    old = lambda s: F.when(s["age"].isNotNull(), F.greatest(s["age"] - veteran, F.lit(0.0)))
    away = lambda s: F.when(s["months_since"] > layoff, 1).otherwise(0)
    return {
        "rating": F.ln(p / (1 - p)), "age": both(a["age"], b["age"]) / 5, "veteran": both(old(a), old(b)) / 5, "strikes": strikes(a) - strikes(b), "control": 5 * (control(a) - control(b)),
        "knockdowns": 2 * (downs(a) - downs(b)), "layoff": away(a) - away(b), "reach": both(a["reach_cm"], b["reach_cm"]) / 10,
    }


def predict_matchup(terms: dict[str, Column], weights: dict[str, float] = MATCHUP_WEIGHTS) -> Column:
    """struct<win_a, rating_only, shifts>: the odds, those by the rating alone, and how far each factor moves them (age and veteran are one)."""
    part = {name: weights[name] * column for name, column in terms.items()}
    z = sum(part.values(), F.lit(0.0))
    factors = {"age": part["age"] + part["veteran"]} | {name: part[name] for name in ("strikes", "control", "knockdowns", "layoff", "reach")}
    shifts = F.struct(*((sigmoid(z) - sigmoid(z - x)).alias(name) for name, x in factors.items()))
    return F.struct(sigmoid(z).alias("win_a"), sigmoid(part["rating"]).alias("rating_only"), shifts.alias("shifts"))


def method_priors(df: DataFrame, division: str, scheduled: str, method: str, methods: tuple[str, ...] = ("ko", "sub", "dec"), shrink: float = 30) -> DataFrame:
    """division, method, share of the bouts of three rounds, shrunk to all divisions' mix as by `shrink` more bouts (M08); division null is all of them,
    and `five` is the factor on a method's share in bouts of five rounds."""
    n = lambda m, r: F.count_if((F.col(method) == m) & (F.col(scheduled) == r))
    counts = df.where(F.col(method).isin(*methods)).groupBy(F.col(division).alias("division")).agg(*(n(m, r).alias(f"{m}_{r}") for m in methods for r in (3, 5)))
    total = lambda r: sum((F.col(f"{m}_{r}") for m in methods), F.lit(0))
    overall = counts.agg(*(F.sum(c).alias(c) for c in counts.columns[1:]))
    world = overall.select(*((F.col(f"{m}_3") / total(3)).alias(f"{m}_all") for m in methods), *((F.col(f"{m}_5") / total(5) / (F.col(f"{m}_3") / total(3))).alias(f"{m}_five") for m in methods))
    lines = lambda share: F.explode(F.array(*(F.struct(F.lit(m).alias("method"), share(m).alias("share"), F.col(f"{m}_five").alias("five")) for m in methods))).alias("s")
    # `world` is one row.
    by = counts.where("division IS NOT NULL").join(F.broadcast(world)).select("division", lines(lambda m: (F.col(f"{m}_3") + shrink * F.col(f"{m}_all")) / (total(3) + shrink)))
    return by.unionByName(world.select(F.lit(None).cast(df.schema[division].dataType).alias("division"), lines(lambda m: F.col(f"{m}_all")))).select("division", "s.*")


def round_shares(df: DataFrame, scheduled: str, method: str, finish: str, methods: tuple[str, ...] = ("ko", "sub")) -> DataFrame:
    """scheduled, method, round, share of the finishes, one more counted in each round."""
    inside = F.col(method).isin(*methods) & F.col(scheduled).isin(3, 5) & F.col(finish).between(1, F.col(scheduled))
    n = df.where(inside).groupBy(F.col(scheduled).cast("int").alias("scheduled"), F.col(method).alias("method"), F.col(finish).cast("int").alias("round")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.createDataFrame([(r, m, k) for r in (3, 5) for m in methods for k in range(1, r + 1)], "scheduled int, method string, round int")
    one = spine.join(n, ["scheduled", "method", "round"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    return one.select("scheduled", "method", "round", (F.col("n") / F.sum("n").over(W.partitionBy("scheduled", "method"))).alias("share"))


def metrics(p: Column, happened: Column, least: float = 1e-12) -> list[Column]:
    """log_loss, accuracy (half for even odds) and n of predictions (M09), to be aggregated."""
    own = F.when(happened, p).otherwise(1 - p)
    return [F.avg(-F.ln(F.greatest(F.lit(least), own))).alias("log_loss"), F.avg(F.when(own > 0.5, 1.0).when(own == 0.5, 0.5).otherwise(0.0)).alias("accuracy"), F.count("*").alias("n")]


def calibration(df: DataFrame, p: Column, happened: Column, bins: int = 5) -> DataFrame:
    """bin, predicted, observed, n of equal bins of the odds."""
    at = F.least(F.lit(bins - 1), F.floor(p * bins)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.avg(p).alias("predicted"), F.avg(happened.cast("int")).alias("observed"), F.count("*").alias("n"))


def fit_scale(df: DataFrame, ratio: str, most: float = 50.0, rounds: int = 100) -> float:
    """The k in 0 to `most` under which sigmoid(k x ratio) explains the winners' ratios best (M10); 0 without a signal."""
    if not df.agg(F.max(F.abs(ratio))).first()[0]:
        return 0.0
    k, x = 1.0, F.col(ratio)
    for _ in range(rounds):
        p = sigmoid(k * x)
        slope, curve = df.agg(F.sum((1 - p) * x), F.sum(p * (1 - p) * x * x)).first()
        if curve < 1e-12:
            return most if slope > 0 else k
        last, k = k, min(most, max(0.0, k + slope / curve))
        if abs(k - last) < 1e-9:
            break
    return k


def grid_losses(df: DataFrame, losses: dict[float, Column]) -> DataFrame:
    """parameter, loss of a grid (M14): `losses` are aggregates, one a parameter, and all of them are taken in one pass over the rows."""
    row = df.agg(*(loss.alias(f"_{i}") for i, loss in enumerate(losses.values())))
    return row.select(F.explode(F.array(*(F.struct(F.lit(float(k)).alias("parameter"), F.col(f"_{i}").alias("loss")) for i, k in enumerate(losses)))).alias("x")).select("x.*")


def rounded_parameters(objective: Callable[[dict[str, float]], float], at: dict[str, float], slack: float = 2e-4, digits: int = 2) -> dict[str, float]:
    """`at` with two significant digits each, if that costs `slack` of the objective at most (M14); else as it is."""
    short = {name: float(f"{value:.{digits}g}") for name, value in at.items()}
    return short if objective(short) <= objective(at) + slack else at


@dataclass(frozen=True)
class Range:
    low: float
    high: float
    step: float
    log: bool = False
    whole: bool = False

    def near(self, value: float, step: float) -> list[float]:
        moved = (value * step, value / step) if self.log else (value + step, value - step)
        return [v for v in map(self.inside, moved) if v != value]

    def inside(self, value: float) -> float:
        return min(self.high, max(self.low, round(value) if self.whole else value))

    def finer(self, step: float) -> float:
        return math.sqrt(step) if self.log else max(1, round(step / 2)) if self.whole else step / 2


def pattern_search(
    objective: Callable, start: dict[str, float], space: dict[str, Range], refinements: int = 4, evaluations: int = 2000, gain: float = 1e-7, many: bool = False
) -> tuple[dict[str, float], float, int]:
    """(parameters, objective, evaluations) of a search by single steps that grow finer when none helps.

    With `many`, `objective` takes a list of choices and returns their values: all neighbours of a choice that aren't known yet are asked for together, so that
    a move costs one call (one Spark job, such as `grid_losses` or a replay of many sets), and the search goes the same way as one choice at a time."""
    at = start | {name: spec.inside(start[name]) for name, spec in space.items()}
    steps = {name: spec.step for name, spec in space.items()}
    known: dict[tuple, float] = {}

    def value(trial: dict[str, float]) -> float:
        if not many:
            return objective(trial)
        if tuple(trial.items()) not in known:
            around = [trial, *(at | {name: v} for name, spec in space.items() for v in spec.near(at[name], steps[name]))]
            new = {tuple(t.items()): t for t in around if tuple(t.items()) not in known}
            known.update(zip(new, objective(list(new.values()))))
        return known[tuple(trial.items())]

    best, used = value(at), 1

    def improve(name: str) -> bool:
        nonlocal at, best, used
        for v in space[name].near(at[name], steps[name]):
            if used >= evaluations:
                break
            trial = at | {name: v}
            found, used = value(trial), used + 1
            if found < best - gain:
                at, best = trial, found
                return True
        return False

    for _ in range(refinements + 1):
        while any([improve(name) for name in space]) and used < evaluations:
            pass
        steps = {name: spec.finer(steps[name]) for name, spec in space.items()}
    return at, best, used


def chronological_split(df: DataFrame, day: str, tie: str, train: float = 0.8) -> DataFrame:
    """Adds `is_train`: the first `train` of the rows by (day, tie) (M03). Counts by day find the day of the cut; only that day's rows are ranked."""
    # The counts are a row a day: a calendar's length bounds them, so their running sum may stand in one task.
    days = df.groupBy(day).agg(F.count("*").alias("_n")).withColumn("_one", F.lit("all"))
    w = W.partitionBy("_one").orderBy(F.col(day).asc_nulls_first())
    cut = days.withColumn("_left", F.floor(F.sum("_n").over(W.partitionBy("_one")) * train) - (F.sum("_n").over(w) - F.col("_n"))).drop("_n", "_one")
    joined = df.join(cut.withColumnRenamed(day, "_d"), F.col(day).eqNullSafe(F.col("_d")))
    split = joined.withColumn("_whole", F.col("_left") <= 0)
    ranked = split.withColumn("_rank", F.row_number().over(W.partitionBy(day).orderBy(tie)))
    return ranked.withColumn("is_train", ~F.col("_whole") & (F.col("_rank") <= F.col("_left"))).drop("_d", "_left", "_whole", "_rank")


def walk_forward(df: DataFrame, day: str, windows: list[tuple[str, str]]) -> DataFrame:
    """A row's part in each window (M13): `train` before its start, `test` inside it; rows after its end are left out of it."""
    parts = [F.when(F.col(day) < F.lit(start).cast("date"), F.struct(F.lit(i).alias("window"), F.lit("train").alias("part"))).when(F.col(day) < F.lit(end).cast("date"), F.struct(F.lit(i).alias("window"), F.lit("test").alias("part"))) for i, (start, end) in enumerate(windows)]
    return df.withColumn("_w", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull()))).select(*df.columns, "_w.*")
