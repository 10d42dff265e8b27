"""Replays of many parameter sets at once (M11-M14): gaps before each bout, the scales that fit them, losses by window.

A replay's order doesn't depend on its parameters, nor do days, divisions, streaks and titles.  So one pass over the sorted bouts serves all sets: a participant's
state holds an array with a number a set, and a bout costs a few array operations however many sets there are.  The pass leaves a row a bout, with an
array of gaps; it is written once, and each Newton round of the scales is one aggregation over it, for all sets and windows together.

Windows are (start, end) days: rows before the start are the window's training rows, those from the start to before the end its test rows.  Sets and windows are
few; what comes back to the driver is a number for each pair.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.operators import levels
from boutline.operators.durable import checkpointed
from boutline.operators.levels import stacked
from boutline.operators.replay import Glicko, PointFlow, months, ordered_replay

#: Gaps that a task holds at once while it sums.
HELD = 1_000_000
GAPS = "key long, day int, bout_id long, winner {kind}, loser {kind}, mover boolean, gaps array<double>"


def career_gaps(bouts: DataFrame, key: str, sets: list[Glicko], kind: str = "int") -> DataFrame:
    """key, day, bout_id, winner, loser, mover, gaps: for each decided bout the winner's rating less the loser's before it, under each set; mover: one of them has
    fought in another division.  The bouts of `replay.careers`; a start may also be an array with a number a set.  Rows without a key, day, winner or
    loser are left out; no bouts give no rows."""
    return dealt_gaps(levels.dealt(bouts, key, kind), key, sets, kind)


def dealt_gaps(rows: DataFrame, key: str, sets: list[Glicko], kind: str = "int") -> DataFrame:
    """`career_gaps` of bouts that `levels.dealt` has put in order."""
    gaps = levels.replayed(rows, sets, levels.gap_rows, kind, GAPS.format(kind=kind))
    return gaps.withColumnRenamed("key", key).withColumn("day", F.date_from_unix_date("day"))


@dataclass
class Points:
    points: np.ndarray
    streak: int = 0
    champion: bool = False
    day: int | None = None
    fought_in: set = field(default_factory=set)


@dataclass
class Division:
    of: dict = field(default_factory=dict)
    total: float | np.ndarray = 0.0


def _points_step(p: dict[str, np.ndarray], div: Division, row) -> list[tuple]:
    if row.kind == 0:
        for who in (row.winner, row.loser):
            if who not in div.of:
                div.of[who] = Points(p["base"] * 1.0)
                div.total = div.total + p["base"]
    rated = [div.of[who] for who in (row.winner, row.loser) if who in div.of]
    idle = [months(s.day, row.day) for s in rated]
    now = [np.where(t <= p["grace"], s.points, s.points * np.maximum(p["erosion"] ** (t - p["grace"]), p["erosion_floor"])) for s, t in zip(rated, idle)]
    out = []
    if row.kind == 0:
        (w, x), (own, other) = rated, now
        out = [(row.key, row.day, row.bout_id, row.winner, row.loser, False, np.log(own / other))]
        mean = div.total / len(div.of)
        run = lambda s: 1 + p["streak_step"] * np.minimum(abs(s.streak), p["streak_cap"])
        bonus = run(w) * (p["title_win"] if row.is_title else 1) * (p["five_rounds"] if row.is_five else 1) * (p["former_champion"] if w.champion else 1)
        won = own + bonus * (p["opponent"] * other * (p["gain_base"] + p["gain_slope"] * row.dominance) + p["activity"] * mean)
        loss = p["loss_base"] * mean * (p["lost_base"] + p["lost_slope"] * row.dominance) * run(x) / (p["title_loss"] if row.is_title else 1)
        now = [np.where(won > other, won, other + p["floor_bonus"]), np.maximum(other - loss, p["loser_floor"])]
        w.streak, x.streak = max(w.streak, 0) + 1, min(x.streak, 0) - 1
        w.champion |= bool(row.is_title)
    for s, points in zip(rated, now):
        div.total = div.total + points - s.points
        s.points, s.day = points, row.day
        if row.kind and row.is_draw:
            s.streak = 0
    return out


def point_gaps(bouts: DataFrame, key: str, sets: list[PointFlow], kind: str = "int") -> DataFrame:
    """key, day, bout_id, winner, loser, mover (false: a key is one division), gaps: for each decided bout ln(winner's points / loser's points) before it, eroded to its
    day, under each set.  The bouts of `replay.point_flow`, with the same rows left out."""
    columns = ["day", "kind", "bout_id", "winner", "loser", "dominance", "is_title", "is_five", "is_draw"]
    return ordered_replay(bouts, key, ["day", "kind", "bout_id"], columns, Division, partial(_points_step, stacked(sets)), GAPS.format(kind=kind))


def _elo_step(k: np.ndarray, base: float, state: dict, row) -> list[tuple]:
    (a, m), (b, n) = (state.get(who) or (k * 0.0 + base, 0) for who in (row.winner, row.loser))
    upset = 1 - 1 / (1 + 10 ** ((b - a) / 400))
    weight = lambda bouts: k * max(1.0, 3 - bouts / 5)
    state[row.winner], state[row.loser] = (a + weight(m) * upset, m + 1), (b - weight(n) * upset, n + 1)
    return [(row.key, row.day, row.bout_id, who, won, state[who][0]) for who, won in ((row.winner, True), (row.loser, False))]


def elo_many(bouts: DataFrame, key: str, ks: list[float], kind: str = "int", base: float = 1500.0) -> DataFrame:
    """`replay.elo` for several k at once: key, day, bout_id, participant, won, after: the Elo after the bout, an array with a number a k."""
    schema = f"key long, day int, bout_id long, participant {kind}, won boolean, after array<double>"
    return ordered_replay(bouts, key, ["day", "bout_id"], ["day", "bout_id", "winner", "loser"], dict, partial(_elo_step, np.array(ks, float), base), schema)


def starts_before(history: DataFrame, debuts: DataFrame, picks: list[tuple[int, float]], base: float = 1500.0) -> DataFrame:
    """participant, debut, start: an array over `picks` (which k of the history, scale), each base + scale x (Elo after the last bout strictly before the debut - base); null
    without such a bout.  debuts: participant, debut."""
    h = history.select(F.col("participant").alias("_p"), "day", "bout_id", "after")
    found = debuts.join(h, (F.col("_p") == F.col("participant")) & (F.col("day") < F.col("debut")), "left")
    last = found.groupBy("participant", "debut").agg(F.max_by("after", F.struct("day", "bout_id")).alias("_after"))
    start = F.array(*(F.lit(base) + scale * (F.get("_after", F.lit(at)) - base) for at, scale in picks))
    return last.select("participant", "debut", F.when(F.col("_after").isNotNull(), start).alias("start"))


# ---- scales and losses

SUMS = "window int, part int, set int, n long, slope double, curve double, largest double, loss double, right double"


def _day_number(day: str) -> int:
    return (datetime.date.fromisoformat(day) - datetime.date(1970, 1, 1)).days


def _sums(gaps: DataFrame, windows: list[tuple[str, str]], scales: np.ndarray) -> dict[str, np.ndarray]:
    """For each window, part (0 training, 1 test) and set, at its scale: rows, slope and curve of the loss, largest gap, loss and right picks (even ones are half)."""
    edges = [tuple(map(_day_number, w)) for w in windows]
    n_sets = scales.shape[1]
    rows = max(1, HELD // n_sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(edges), 2, n_sets, 6))
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                day = batch.column(0).to_numpy()
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, n_sets)
                for w, (start, end) in enumerate(edges):
                    for part, inside in enumerate((day < start, (day >= start) & (day < end))):
                        if inside.any():
                            _add(total[w, part], x[inside], scales[w])
        keys = np.indices(total.shape[:3]).reshape(3, -1)
        flat = total.reshape(-1, 6)
        columns = [pa.array(k, pa.int32()) for k in keys] + [pa.array(flat[:, 0].astype(np.int64))] + [pa.array(flat[:, k]) for k in range(1, 6)]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SUMS.split(", ")])

    parts = gaps.select(F.unix_date("day").alias("day"), "gaps").mapInArrow(run, SUMS)
    totals = parts.groupBy("window", "part", "set").agg(F.max("largest").alias("largest"), *(F.sum(c).alias(c) for c in ("n", "slope", "curve", "loss", "right")))
    out = {c: np.zeros((len(edges), 2, n_sets)) for c in ("n", "slope", "curve", "largest", "loss", "right")}
    for r in totals.collect():  # a row for each window, part and set
        for c, values in out.items():
            values[r["window"], r["part"], r["set"]] = r[c]
    return out


def _add(total: np.ndarray, x: np.ndarray, scale: np.ndarray) -> None:
    z = scale * x
    e = np.exp(-np.abs(z))
    p = np.where(z >= 0, 1 / (1 + e), e / (1 + e))
    total[:, 0] += len(x)
    total[:, 1] += ((1 - p) * x).sum(0)
    total[:, 2] += (p * (1 - p) * x * x).sum(0)
    total[:, 3] = np.maximum(total[:, 3], np.abs(x).max(0))
    total[:, 4] -= np.log(np.maximum(p, 1e-12)).sum(0)
    total[:, 5] += (x > 0).sum(0) + 0.5 * (x == 0).sum(0)


def fit_scales(gaps: DataFrame, windows: list[tuple[str, str]], n_sets: int, most: float = 50.0, rounds: int = 100, begin: float = 1.0) -> np.ndarray:
    """By window and set the k in 0 to `most` under which sigmoid(k x gap) explains the training rows best; 0 without a signal (M10).  One aggregation a
    round, for all of them; a pair that has come to rest keeps its k."""
    k = np.full((len(windows), n_sets), begin)
    moving = np.ones_like(k, bool)
    for at in range(rounds):
        sums = {c: v[:, 0] for c, v in _sums(gaps, windows, k).items()}
        if at == 0:
            none = sums["largest"] == 0
            k[none], moving[none] = 0.0, False
        flat = moving & (sums["curve"] < 1e-12)
        k[flat & (sums["slope"] > 0)] = most
        moving &= ~flat
        step = np.divide(sums["slope"], sums["curve"], out=np.zeros_like(k), where=moving)
        new = np.where(moving, np.clip(k + step, 0.0, most), k)
        moving &= np.abs(new - k) >= 1e-9
        k = new
        if not moving.any():
            break
    return k


def window_losses(gaps: DataFrame, windows: list[tuple[str, str]], n_sets: int, begin: float = 1.0) -> DataFrame:
    """window, set, part (train or test), scale, log_loss, accuracy, n: each set's scale is fitted on the window's training rows, and both parts are scored with it (M09,
    M13).  Loss and accuracy are null for a part without rows.  `gaps` is read once for each Newton round: pass it `checkpointed`."""
    scales = fit_scales(gaps, windows, n_sets, begin=begin)
    sums = _sums(gaps, windows, scales)
    rows = []
    for w in range(len(windows)):
        for s in range(n_sets):
            for part, name in enumerate(("train", "test")):
                n = int(sums["n"][w, part, s])
                mean = lambda c: float(sums[c][w, part, s]) / n if n else None  # noqa: B023, E731
                rows.append((w, s, name, float(scales[w, s]), mean("loss"), mean("right"), n))
    return gaps.sparkSession.createDataFrame(rows, "window int, set int, part string, scale double, log_loss double, accuracy double, n long")


def sweep(bouts: DataFrame, key: str, sets: list, windows: list[tuple[str, str]], collect: Callable = career_gaps, kind: str = "int", begin: float = 1.0) -> DataFrame:
    """The losses of a grid of parameter sets by window (M13, M14): one replay of the bouts for all sets, then `window_losses`."""
    return window_losses(checkpointed(collect(bouts, key, sets, kind).select("day", "gaps")), windows, len(sets), begin)


def picked(losses: DataFrame) -> DataFrame:
    """window, set, train_loss, test_loss: in each window the set with the least training loss (the first of equals), and what it gives on the test rows."""
    by = losses.groupBy("window", "set").pivot("part", ["train", "test"]).agg(F.first("log_loss"))
    best = by.groupBy("window").agg(F.min(F.struct(F.col("train").isNull().alias("none"), "train", "set", "test")).alias("b"))
    return best.select("window", "b.set", F.col("b.train").alias("train_loss"), F.col("b.test").alias("test_loss"))


def training_losses(bouts: DataFrame, key: str, make: Callable[[dict[str, float]], object], until: str, collect: Callable = career_gaps, kind: str = "int") -> Callable[[list[dict[str, float]]], list[float]]:
    """An objective for `models.pattern_search(..., many=True)`: the training losses of several parameter choices, from one replay of all of them (M11).  `make` turns a
    choice into a parameter set; training rows are those before `until`.

    No gap depends on later bouts, so those from `until` on are left out of the replays.  For careers the rest is dealt and sorted once, for all calls."""
    bouts = bouts.where(F.col("day") < F.lit(until).cast("date"))
    if collect is career_gaps:
        bouts, collect = checkpointed(levels.dealt(bouts, key, kind)), dealt_gaps

    begin = 1.0

    def losses(choices: list[dict[str, float]]) -> list[float]:
        nonlocal begin
        found = sweep(bouts, key, [make(c) for c in choices], [(until, until)], collect, kind, begin).where("part = 'train'").collect()  # a row a choice
        by_set = {r["set"]: r["log_loss"] for r in found}
        begin = next((r["scale"] for r in found if 0 < r["scale"] < 50), begin)  # the next choices' scales are near: fewer rounds
        return [float("inf") if by_set[k] is None else by_set[k] for k in range(len(choices))]

    return losses
