"""Ordered replays (R02-R07): ratings whose every step depends on the steps before it.

A replay runs within a key that no bout crosses: a division, a league, or the component of the opponent graph (`graph.components`). Rows are dealt by
the key, sorted within partitions by Spark, and folded as they stream past in Arrow batches: memory holds the states of one key's participants, never
its bouts. The recurrence is sequential within a key; keys run side by side. Rows with a null key, day or participant are left out; an empty table gives
an empty result.

Career ratings without places are stepped many bouts at once (`levels`).

Bouts: key, day (date), kind (0 a decided bout, 1 no result), bout_id, winner, loser; on a day, bouts come before no-results, then by id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.operators import levels
from boutline.operators.levels import MONTH, SEED, Q
from boutline.operators.standings import Standing

@dataclass(frozen=True)
class Glicko:
    """The defaults of the career rating."""

    rating: float = 1500.0
    rd: float = 300.0
    rd_month: float = 20.0
    rd_move: float = 50.0
    carry: float = 1.0
    win_floor: float = 0.8
    least_rd: float = 30.0
    unknown: str = "base"


@dataclass(frozen=True)
class PointFlow:
    """The defaults of the point rating."""

    base: float = 0.01
    loser_floor: float = 0.001
    grace: float = 4.0
    erosion: float = 0.96
    erosion_floor: float = 0.65
    streak_cap: int = 20
    streak_step: float = 0.0
    title_win: float = 1.6
    title_loss: float = 8.0
    five_rounds: float = 1.0
    former_champion: float = 1.0
    opponent: float = 0.24
    activity: float = 0.066
    floor_bonus: float = 0.00063
    loss_base: float = 0.1
    gain_base: float = 0.19
    gain_slope: float = 1.1
    lost_base: float = 0.0
    lost_slope: float = 2.6


def ordered_replay(df: DataFrame, key: str, order: list[str], columns: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """`step(state, row)` gives the output rows of one input row; `start()` makes the state of a key."""
    names = [part.split()[0] for part in schema.split(", ")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = now = None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if state is None or row[0] != now:
                    now, state = row[0], start()
                out += step(state, row)
            yield pd.DataFrame(out, columns=names)

    needed = df.dropna(subset=[key, *order, "winner", "loser"])
    dealt = needed.select(F.col(key).alias("key"), *(F.unix_date("day").alias("day") if c == "day" else c for c in columns))
    # By a hash of the key, since Spark drops a repartition by the key itself over a union of frames that stand by the key, whose partitions may hold different keys once they are merged.
    return dealt.repartition(F.xxhash64("key")).sortWithinPartitions("key", *order).mapInPandas(fold, schema).withColumnRenamed("key", key).withColumn("day", F.date_from_unix_date("day"))


def months(since: int | None, day: int) -> float:
    return 0.0 if since is None else max(0, day - since) / MONTH


def _elo_step(k: float, base: float, state: dict, row) -> list[tuple]:
    (a, m), (b, n) = state.get(row.winner, (base, 0)), state.get(row.loser, (base, 0))
    upset = 1 - 1 / (1 + 10 ** ((b - a) / 400))
    weight = lambda bouts: k * max(1.0, 3 - bouts / 5)
    state[row.winner], state[row.loser] = (a + weight(m) * upset, m + 1), (b - weight(n) * upset, n + 1)
    return [(row.key, row.day, row.bout_id, who, won, before[0], state[who][0], before[1]) for who, won, before in ((row.winner, True, (a, m)), (row.loser, False, (b, n)))]


def elo(bouts: DataFrame, key: str, kind: str = "int", k: float = 96.0, base: float = 1500.0) -> DataFrame:
    """Elo before and after each bout (R06), a row a side; a participant's first bouts weigh up to three times k. `kind` is the participants' SQL type."""
    schema = f"key long, day int, bout_id long, participant {kind}, won boolean, before double, after double, bouts_before long"
    return ordered_replay(bouts, key, ["day", "bout_id"], ["day", "bout_id", "winner", "loser"], dict, partial(_elo_step, k, base), schema)


def external_bouts(rows: DataFrame, promotion: str | None = None) -> DataFrame:
    """Decided bouts of owner, opponent, day, result once each, though both sides list them; of rows that disagree, the smallest (owner, result) counts (R06).  `promotion`: bouts whose
    `event` begins with that word are its own, and left out."""
    kept = rows.where(F.col("result").isin("win", "loss") & F.col("day").isNotNull() & (F.col("owner") != F.col("opponent")))
    if promotion is not None:
        kept = kept.where(~F.coalesce(F.trim("event").rlike(rf"(?i)^{promotion}\b"), F.lit(False)))
    won = F.when(F.col("result") == "win", F.struct(F.col("owner").alias("winner"), F.col("opponent").alias("loser"))).otherwise(F.struct(F.col("opponent").alias("winner"), F.col("owner").alias("loser")))
    return kept.groupBy(F.least("owner", "opponent").alias("a"), F.greatest("owner", "opponent").alias("b"), "day").agg(F.min_by(won, F.struct("owner", "result")).alias("o")).select("day", "o.*")


def elo_before(history: DataFrame, debuts: DataFrame, scale: float = 1.2, base: float = 1500.0) -> DataFrame:
    """(participant, debut) with `start`: base + scale x (Elo after the last bout strictly before the debut - base); null if there is none."""
    h = history.select(F.col("participant").alias("_p"), "day", "bout_id", "after")
    found = debuts.join(h, (F.col("_p") == F.col("participant")) & (F.col("day") < F.col("debut")), "left")
    return found.groupBy("participant", "debut").agg((F.lit(base) + scale * (F.max_by("after", F.struct("day", "bout_id")) - base)).alias("start"))


@dataclass
class Careers:
    states: dict = field(default_factory=dict)
    known: float = 0.0
    n_known: int = 0
    standing: Standing = field(default_factory=Standing)  # ratings of those with a bout


@dataclass
class Career:
    rating: float
    rd: float
    day: int | None = None
    division: str | None = None
    bouts: int = 0


def _arrive(p: Glicko, s: Career, division: str, day: int) -> bool:
    """Bring a participant to the day of a bout: deviation grows with idle time and with a change of division."""
    idle = months(s.day, day)
    if idle > 0:
        s.rd = min(p.rd, math.sqrt(s.rd**2 + p.rd_month**2 * idle))
    moved = s.division is not None and s.division != division
    if moved:
        s.rating, s.rd = p.rating + (s.rating - p.rating) * p.carry, min(p.rd, math.hypot(s.rd, p.rd_move))
    s.day, s.division = day, division
    return moved


def glicko_update(p: Glicko, own: tuple[float, float], other: tuple[float, float], score: float) -> tuple[float, float]:
    g = 1 / math.sqrt(1 + 3 * (Q * other[1] / math.pi) ** 2)
    e = 1 / (1 + 10 ** (-g * (own[0] - other[0]) / 400))
    variance = 1 / (own[1] ** -2 + Q * Q * g * g * e * (1 - e))
    return own[0] + Q * variance * g * (score - e), max(p.least_rd, math.sqrt(variance))


def _career_step(p: Glicko, places: bool, all_: Careers, row) -> list[tuple]:
    if row.kind == SEED:
        all_.states[row.winner] = Career(row.start_winner, row.start_loser, row.day, row.division, int(row.dominance))
        if places and row.dominance:
            all_.standing.add(row.start_winner)
        return []
    sides = ((row.winner, row.start_winner), (row.loser, row.start_loser))
    if row.kind == 0:
        for who, given in sides:
            if who not in all_.states:
                begin = p.rating
                if given == given and given is not None:
                    begin, all_.known, all_.n_known = given, all_.known + given, all_.n_known + 1
                elif p.unknown == "average" and all_.n_known:
                    begin = all_.known / all_.n_known
                all_.states[who] = Career(begin, p.rd)
    rated = [(who, all_.states[who]) for who, _ in sides if who in all_.states]
    if places:
        for _, s in rated:  # ratings that may change leave the standing, and come back below
            if s.bouts:
                all_.standing.remove(s.rating)
    moved = [_arrive(p, s, row.division, row.day) for _, s in rated]
    before = [(s.rating, s.rd) for _, s in rated]
    # the place by rating among those with a bout, the other side included; null for a debutant
    beside = lambda s: sum(o.bouts > 0 and o.rating > s.rating for _, o in rated)
    place = [1 + all_.standing.above(s.rating) + beside(s) if places and s.bouts else None for _, s in rated]
    if row.kind == 0:
        score = p.win_floor + (1 - p.win_floor) * min(1.0, max(0.0, row.dominance))
        for (_, s), own, other, mine in zip(rated, before, before[::-1], (score, 1 - score)):
            s.rating, s.rd = glicko_update(p, own, other, mine)
    out = [(row.key, row.day, row.kind, row.bout_id, who, None if row.kind else i == 0, *before[i], s.rating, s.rd, moved[i], s.bouts, place[i], row.division) for i, (who, s) in enumerate(rated)]
    for _, s in rated:
        s.bouts += row.kind == 0
        if places and s.bouts:
            all_.standing.add(s.rating)
    return out


def careers(bouts: DataFrame, key: str, kind: str = "int", params: Glicko = Glicko(), places: bool = False) -> DataFrame:
    """Rating and deviation of each side at and after each bout, over all divisions (R05). A no-result moves no rating but counts as activity for those
    already rated. `places`: also each side's place by rating before the bout. Columns besides the bouts': division, dominance (0 to 1), start_winner, start_loser (null: unknown, see `Glicko.unknown`)."""
    schema = f"key long, day int, kind int, bout_id long, participant {kind}, won boolean, rating_at double, rd_at double, rating double, rd double, moved boolean, bouts_before long, place_at int, division string"
    if not places:
        rows = levels.replayed(levels.dealt(bouts, key, kind), [params], levels.side_rows, kind, schema, sides_too=True)
        return rows.withColumnRenamed("key", key).withColumn("day", F.date_from_unix_date("day"))
    columns = ["day", "kind", "bout_id", "winner", "loser", "division", "dominance", "start_winner", "start_loser"]
    return ordered_replay(bouts, key, ["day", "kind", "bout_id"], columns, Careers, partial(_career_step, params, places), schema)


@dataclass
class Points:
    points: float
    streak: int = 0
    champion: bool = False
    day: int | None = None


@dataclass
class Division:
    states: dict = field(default_factory=dict)
    total: float = 0.0


def eroded(p: PointFlow, points: float, idle: float) -> float:
    return points if idle <= p.grace else points * max(p.erosion ** (idle - p.grace), p.erosion_floor)


def _points_step(p: PointFlow, div: Division, row) -> list[tuple]:
    if row.kind == 0:
        for who in (row.winner, row.loser):
            if who not in div.states:
                div.states[who] = Points(p.base)
                div.total += p.base
    rated = [(who, div.states[who]) for who in (row.winner, row.loser) if who in div.states]
    before = [s.points for _, s in rated]
    now = [eroded(p, s.points, months(s.day, row.day)) for _, s in rated]
    if row.kind == 0:
        (_, w), (_, x) = rated
        mean = div.total / len(div.states)
        run = lambda s: 1 + p.streak_step * min(abs(s.streak), p.streak_cap)
        bonus = run(w) * (p.title_win if row.is_title else 1) * (p.five_rounds if row.is_five else 1) * (p.former_champion if w.champion else 1)
        won = now[0] + bonus * (p.opponent * now[1] * (p.gain_base + p.gain_slope * row.dominance) + p.activity * mean)
        loss = p.loss_base * mean * (p.lost_base + p.lost_slope * row.dominance) * run(x) / (p.title_loss if row.is_title else 1)
        now = [won if won > now[1] else now[1] + p.floor_bonus, max(now[1] - loss, p.loser_floor)]
        w.streak, x.streak = max(w.streak, 0) + 1, min(x.streak, 0) - 1
        w.champion |= bool(row.is_title)
    for (_, s), points in zip(rated, now):
        div.total += points - s.points
        s.points, s.day = points, row.day
        if row.kind and row.is_draw:
            s.streak = 0
    return [(row.key, row.day, row.kind, row.bout_id, who, None if row.kind else i == 0, before[i], s.points, s.streak) for i, (who, s) in enumerate(rated)]


def point_flow(bouts: DataFrame, key: str, kind: str = "int", params: PointFlow = PointFlow()) -> DataFrame:
    """Points of each side before and after each bout of a division (R02, R03); gains and losses rest on the running mean of all its points, kept as a
    sum. Winning a title counts from the next bout on. Columns besides the bouts': dominance, is_title, is_five, is_draw."""
    schema = f"key long, day int, kind int, bout_id long, participant {kind}, won boolean, before double, after double, streak long"
    columns = ["day", "kind", "bout_id", "winner", "loser", "dominance", "is_title", "is_five", "is_draw"]
    return ordered_replay(bouts, key, ["day", "kind", "bout_id"], columns, Division, partial(_points_step, params), schema)


def final_states(history: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The last row of each participant of a replay's history."""
    order = F.struct("day", *(c for c in ("kind",) if c in history.columns), "bout_id")
    return history.groupBy(key, "participant").agg(F.max_by(F.struct("day", *values), order).alias("_s")).select(key, "participant", "_s.*")


def weekly_snapshot(history: DataFrame, key: str, value: str, week: str) -> DataFrame:
    """Rank by `value` within each (key, week), the rank of the participant's week before, if any, and the trend between."""
    from pyspark.sql import Window as W

    from boutline.operators.ordered import keyed_rank

    last = history.groupBy(key, "participant", F.date_trunc(week, "day").cast("date").alias("week")).agg(F.max_by(value, F.struct("day", "bout_id")).alias(value))
    ranked = keyed_rank(last, [key, "week"], [F.col(value).desc(), F.col("participant")], "rank").withColumn("rank", F.col("rank").cast("int"))
    before = F.lag("rank").over(W.partitionBy(key, "participant").orderBy("week"))
    return ranked.withColumn("previous", before).withColumn("trend", F.when(before.isNull(), "new").when(F.col("rank") < before, "up").when(F.col("rank") > before, "down").otherwise("same"))


def seeds(states: DataFrame, key: str) -> DataFrame:
    """Rows for `careers` that set a participant's state before the bouts of later days: key, participant, rating, rd, day, division, bouts.  They take the columns of
    bouts: the rating stands in start_winner, the deviation in start_loser, the number of bouts in dominance."""
    return states.select(key, "day", F.lit(SEED).alias("kind"), F.lit(0).cast("long").alias("bout_id"), F.col("participant").alias("winner"), F.col("participant").alias("loser"), "division", F.col("bouts").cast("double").alias("dominance"), F.col("rating").alias("start_winner"), F.col("rd").alias("start_loser"))


def states_of(history: DataFrame, key: str) -> DataFrame:
    """key, participant, rating, rd, day, division, bouts: where each participant stands after the last row of a career history."""
    last = F.max_by(F.struct("rating", "rd", "day", "division", (F.col("bouts_before") + (F.col("kind") == 0).cast("long")).alias("bouts")), F.struct("day", "kind", "bout_id"))
    return history.groupBy(key, "participant").agg(last.alias("_s")).select(key, "participant", "_s.*")


def resumed(history: DataFrame, bouts: DataFrame, fresh: DataFrame, key: str, kind: str = "int", params: Glicko = Glicko(), places: bool = False) -> DataFrame:
    """A career history after `fresh` bouts came in (T06): each key that they touch goes on from where it stood before the earliest of their days, over its bouts from that day
    on; its earlier rows, and the other keys, stay.

    bouts: all of them, fresh ones included, with their keys of now: where a bout has joined two components, rows of the history take the new key by their bout.  The history
    is the state, so a late bout costs its key's bouts from its day on and one aggregation of the rows before.  For parameters whose unknown participants start at the
    base: the mean of known starts is no part of the history."""
    if params.unknown != "base":
        raise ValueError("only parameters that start unknown participants at the base can be resumed")
    columns = ["day", "kind", "bout_id", "winner", "loser", "division", "dominance", "start_winner", "start_loser"]
    now = history.drop(key).join(bouts.select("bout_id", key), "bout_id").select(*history.columns)
    first = fresh.groupBy(F.col(key).alias("_key")).agg(F.min("day").alias("_from"))
    old = now.join(first, F.col(key) == F.col("_key"), "left").where("_from IS NULL OR day < _from")
    touched = old.where("_from IS NOT NULL").select(*history.columns)
    suffix = bouts.join(first, F.col(key) == F.col("_key")).where("day >= _from").select(key, *columns)
    again = careers(suffix.unionByName(seeds(states_of(touched, key), key).select(key, *columns)), key, kind, params, places)
    return old.select(*history.columns).unionByName(again.select(*history.columns))


def refreshed(history: DataFrame, bouts: DataFrame, fresh: DataFrame, key: str, replay: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A replay's history after `fresh` bouts came in (T06): only the keys that they touch are replayed, over all their `bouts` (fresh ones included, in whatever
    order they come); the history of the other keys stays. With the opponent graph's component as key, a result costs its component."""
    # The hashed side is the keys alone: a merge join would sort the whole history, two rows a bout.
    touched = fresh.select(key).distinct().hint("shuffle_hash")
    return history.join(touched, key, "left_anti").unionByName(replay(bouts.join(touched, key, "left_semi")))
