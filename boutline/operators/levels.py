"""Career replays a level at a time (R05, M11-M14): many bouts as one step over arrays.

Rows come in the order of the replay and are taken in stretches.  A bout's level within its stretch is one more than the highest level of its two participants' earlier
bouts there, so bouts of one level concern different participants, of whatever keys, and may go at once; levels go in order, which gives what one bout at a time
gives.  A stretch costs a few dozen array operations a level: as many levels as the longest chain of bouts in it, however many keys and parameter sets there are.

States are arrays, about 50 bytes a participant and 16 more for each further set.  Those of the key that a stretch ends in are kept for the next; keys that are done are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import fields
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

MONTH = 30.44
#: Kind of a row that isn't a bout but a state that a replay goes on from (see `replay.seeds`).
SEED = -1
Q = math.log(10) / 400
#: Rows that are taken together, divided by the number of parameter sets beyond four.
STRETCH = 200_000
NEVER, NOWHERE, UNFOUGHT = np.iinfo(np.int64).min, -1, -2


def stacked(sets: list) -> dict[str, np.ndarray]:
    """Each field of the parameter sets as an array over the sets."""
    return {f.name: np.array([getattr(s, f.name) for s in sets]) for f in fields(sets[0])}


def levels(winner: np.ndarray, loser: np.ndarray, people: int) -> np.ndarray:
    """The level of each bout, from 0, by its participants' numbers below `people`."""
    free, out = [0] * people, []
    for a, b in zip(winner.tolist(), loser.tolist()):
        at, other = free[a], free[b]
        if other > at:
            at = other
        free[a] = free[b] = at + 1
        out.append(at)
    return np.array(out, np.int64)


def fresh(n: int, n_sets: int) -> dict[str, np.ndarray]:
    """States of participants that nothing is known of: `fought` is the first division that one has won or lost in, `roams` whether there is another."""
    none = {"day": (np.int64, NEVER), "division": (np.int32, NOWHERE), "bouts": (np.int32, 0), "known": (bool, False), "fought": (np.int32, UNFOUGHT), "roams": (bool, False)}
    return {c: np.full((n, n_sets), np.nan) for c in ("rating", "rd")} | {c: np.full(n, value, kind) for c, (kind, value) in none.items()}


class Kept:
    """The states of one key's participants between stretches."""

    def __init__(self, key: int, n_sets: int):
        self.key, self.n_sets, self.n, self.state = key, n_sets, 0, fresh(1024, n_sets)
        self.ids, self.at, self.names = np.zeros(0, np.int64), np.zeros(0, np.int32), {}
        self.known, self.n_known = np.zeros(n_sets), 0

    def places(self, who: np.ndarray) -> np.ndarray:
        """Where the states of these different participants stand; new ones get the next places."""
        if who.dtype == object:
            found = np.array([self.names.setdefault(x, len(self.names)) for x in who], np.int64)
            self.n = len(self.names)
        else:
            near = np.searchsorted(self.ids, who)
            old = near < len(self.ids)
            old[old] = self.ids[near[old]] == who[old]
            found = np.empty(len(who), np.int64)
            found[old] = self.at[near[old]]
            new = np.flatnonzero(~old)
            new = new[np.argsort(who[new])]
            found[new] = np.arange(self.n, self.n + len(new))
            self.ids, self.at = np.insert(self.ids, near[new], who[new]), np.insert(self.at, near[new], found[new].astype(np.int32))
            self.n += len(new)
        room = len(self.state["known"])
        if self.n > room:
            more = fresh(max(room // 2, self.n - room), self.n_sets)
            for c in more:
                self.state[c] = np.concatenate([self.state[c], more[c]])
        return found


def _begin(p: dict[str, np.ndarray], state: dict, kept: Kept, carried: bool, run: np.ndarray, sides: np.ndarray, kind: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, int]:
    """Give each participant who is new its first rating under each set: the given start (one number, or one a set), else the base or the mean of the known starts before it
    in its key.  sides: winner and loser of each row, given their starts.  Returns sum and number of the last key's known starts."""
    before = state["known"].copy()
    before[sides[kind == SEED].ravel()] = True
    decided = np.flatnonzero(np.repeat(kind == 0, 2))
    who, first = np.unique(sides.ravel()[decided], return_index=True)
    new = ~before[who]
    first = decided[first[new]]
    order = np.argsort(first)
    who, first = who[new][order], first[order]
    start = given.reshape(len(kind) * 2, -1)[first]
    fine = ~np.isnan(start).any(1, keepdims=True)
    start = np.where(fine, start, p["rating"])
    total, n = (kept.known, kept.n_known) if carried else (np.zeros(len(p["rating"])), 0)
    if len(who):
        own, one, of = np.where(fine, start, 0.0), fine[:, 0].astype(np.int64), run[first // 2]
        sums, counts = np.cumsum(own, 0) - own, np.cumsum(one) - one
        head = np.searchsorted(of, of)
        known = sums - sums[head] + np.where(of[:, None] == 0, total, 0.0)
        count = counts - counts[head] + np.where(of == 0, n, 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(count[:, None] > 0, known / count[:, None], p["rating"])
        state["rating"][who] = np.where(fine, start, np.where(p["unknown"] == "average", mean, p["rating"]))
        state["rd"][who] = p["rd"]
        if of[-1] == run[-1]:
            total, n = known[-1] + own[-1], int(count[-1] + one[-1])
    if run[-1] and (not len(who) or of[-1] != run[-1]):
        total, n = np.zeros(len(p["rating"])), 0
    return total, n


def _arrived(p: dict[str, np.ndarray], s: dict, who: np.ndarray, day: np.ndarray, division: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rating, deviation and whether it moved of each participant on the day of a bout: the deviation grows with idle time and with a change of division."""
    last, of, rating, rd = s["day"][who], s["division"][who], s["rating"][who], s["rd"][who]
    idle = np.where(last == NEVER, 0, np.maximum(0, day - np.where(last == NEVER, day, last)))[:, None] / MONTH
    rd = np.where(idle > 0, np.minimum(p["rd"], np.sqrt(rd**2 + p["rd_month"] ** 2 * idle)), rd)
    moved = (of != NOWHERE) & (of != division)
    if moved.any():
        rating[moved] = p["rating"] + (rating[moved] - p["rating"]) * p["carry"]
        rd[moved] = np.minimum(p["rd"], np.hypot(rd[moved], p["rd_move"]))
    return rating, rd, moved


def _updated(p: dict[str, np.ndarray], own: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = 1 / np.sqrt(1 + 3 * (Q * other[1] / np.pi) ** 2)
    e = 1 / (1 + 10 ** (-g * (own[0] - other[0]) / 400))
    variance = 1 / (own[1] ** -2 + Q * Q * g * g * e * (1 - e))
    return own[0] + Q * variance * g * (score - e), np.maximum(p["least_rd"], np.sqrt(variance))


def _level(p: dict[str, np.ndarray], s: dict, r: dict[str, np.ndarray], sides: np.ndarray, out: dict[str, np.ndarray], part: slice) -> None:
    """The bouts of one level: new states in `s`, and in `out` what was before and after, by side."""
    kind, day, division = r["kind"][part], r["day"][part], r["division"][part]
    w, x = sides[part, 0], sides[part, 1]
    decided, seed = kind == 0, kind == SEED
    if seed.any():
        who = w[seed]
        s["rating"][who], s["rd"][who] = r["start"][part][seed, 0], r["start"][part][seed, 1]
        s["day"][who], s["division"][who], s["bouts"][who], s["known"][who] = day[seed], division[seed], r["dominance"][part][seed], True
    s["known"][w[decided]] = s["known"][x[decided]] = True
    rated = [s["known"][who] & ~seed for who in (w, x)]
    (own, own_rd, moved), (other, other_rd, moved_x) = (_arrived(p, s, who, day, division) for who in (w, x))
    at = ((own, own_rd), (other, other_rd))
    score = p["win_floor"] + (1 - p["win_floor"]) * np.minimum(1.0, np.fmax(0.0, r["dominance"][part]))[:, None]
    after = (_updated(p, at[0], at[1], score), _updated(p, at[1], at[0], 1 - score))
    fought = [s["fought"][who] for who in (w, x)]
    roams = [s["roams"][who] for who in (w, x)]
    out["mover"][part] = np.logical_or(*(many | ((first != UNFOUGHT) & (first != division)) for first, many in zip(fought, roams)))
    out["gap"][part] = own - other
    for i, who in enumerate((w, x)):
        out["rated"][part, i], out["moved"][part, i] = rated[i], (moved, moved_x & (w != x))[i]
        out["bouts"][part, i] = s["bouts"][who]
        if "at" in out:
            out["at"][part, i, 0], out["at"][part, i, 1] = at[i][0][:, 0], at[i][1][:, 0]
    for i, who in enumerate((w, x)):
        kept = rated[i]
        to = who[kept]
        for c, new, was in zip(("rating", "rd"), after[i], at[i]):
            s[c][to] = np.where(decided[:, None], new, was)[kept]
        s["day"][to], s["division"][to] = day[kept], division[kept]
        won = who[decided]
        s["bouts"][won] += 1
        s["roams"][won] = roams[i][decided] | ((fought[i] != UNFOUGHT) & (fought[i] != division))[decided]
        s["fought"][won] = np.where(fought[i] == UNFOUGHT, division, fought[i])[decided]
    if "after" in out:
        for i, who in enumerate((w, x)):
            out["after"][part, i, 0], out["after"][part, i, 1] = s["rating"][who, 0], s["rd"][who, 0]


def _starts(column: pa.Array, n_sets: int) -> np.ndarray:
    """Given starts, a row each, one number or one a set; NaN where there is none."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False).astype(float)[:, None]
    out = np.full((len(column), n_sets), np.nan)
    out[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_sets)
    return out


def fold(p: dict[str, np.ndarray], emit: Callable, sides_too: bool, stretch: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`emit(rows, order, out, names)` makes the result of a stretch: its rows as an Arrow table, their order by level, what the levels left, and the participants' names by side."""
    n_sets = len(p["rating"])
    divisions: dict = {}
    kept = None
    held: list[pa.RecordBatch] = []

    def run_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal kept
        n = rows.num_rows
        column = lambda c: rows.column(c).to_numpy()
        key = column("key")
        run = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        codes, names = pd.factorize(np.stack([column("winner"), column("loser")], 1).ravel())
        person, pairs = pd.factorize(np.repeat(run, 2) * len(names) + codes)
        named = names[pairs % len(names)]
        sides = person.reshape(n, 2)
        state = fresh(len(pairs), n_sets)
        carried = kept is not None and kept.key == key[0]
        if carried:
            back = np.flatnonzero(pairs // len(names) == 0)
            places = kept.places(named[back])
            for c, values in state.items():
                values[back] = kept.state[c][places]
        kinds = column("kind")
        starts = np.stack([np.broadcast_to(_starts(rows.column(c).combine_chunks(), n_sets), (n, n_sets)) for c in ("start_winner", "start_loser")], 1)
        known = _begin(p, state, kept, carried, run, sides, kinds, starts)
        level = levels(sides[:, 0], sides[:, 1], len(pairs))
        order = np.argsort(level, kind="stable")
        coded = rows.column("division").combine_chunks().dictionary_encode()
        number = np.array([NOWHERE if x is None else divisions.setdefault(x, len(divisions)) for x in [*coded.dictionary.to_pylist(), None]], np.int32)
        at = coded.indices.fill_null(len(number) - 1).to_numpy()
        r = {"kind": kinds[order], "day": column("day")[order].astype(np.int64), "division": number[at][order], "dominance": column("dominance")[order]}
        if (kinds == SEED).any():
            r["start"] = starts[order]
        out = {"mover": np.zeros(n, bool), "gap": np.zeros((n, n_sets)), "rated": np.zeros((n, 2), bool), "moved": np.zeros((n, 2), bool), "bouts": np.zeros((n, 2), np.int64)}
        out |= {c: np.zeros((n, 2, 2)) for c in ("at", "after")} if sides_too else {}
        ordered = sides[order]
        ends = np.cumsum(np.bincount(level))
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            for start, end in zip([0, *ends[:-1]], ends):
                _level(p, state, r, ordered, out, slice(start, end))
        if run[-1] or not carried:
            kept = Kept(int(key[-1]), n_sets)
            back = np.flatnonzero(pairs // len(names) == run[-1])
            places = kept.places(named[back])
        for c, values in state.items():
            kept.state[c][places] = values[back]
        kept.known, kept.n_known = known
        yield from emit(rows, order, out, named[ordered])

    size = max(1, stretch * 4 // max(4, n_sets))
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= size:
            rows, held = pa.Table.from_batches(held), []
            yield from run_of(rows)
    if any(b.num_rows for b in held):
        yield from run_of(pa.Table.from_batches(held))


def _arrow(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "string": pa.string()}[kind]


def side_rows(kind: str, rows: pa.Table, order: np.ndarray, out: dict[str, np.ndarray], names: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each side that has a rating, as `replay.careers` returns it."""
    mask = out["rated"].ravel()
    row, side = np.repeat(order, 2)[mask], np.tile([0, 1], len(order))[mask]
    taken = rows.select(["key", "day", "kind", "bout_id", "division"]).take(pa.array(row))
    at, after = out["at"].reshape(-1, 2)[mask], out["after"].reshape(-1, 2)[mask]
    won = pa.array(side == 0, mask=taken.column("kind").to_numpy() != 0)
    columns = [*(taken.column(c).combine_chunks() for c in ("key", "day", "kind", "bout_id")), pa.array(names.ravel()[mask]).cast(_arrow(kind)), won, *(pa.array(x[:, k]) for x in (at, after) for k in (0, 1))]
    columns += [pa.array(out["moved"].ravel()[mask]), pa.array(out["bouts"].ravel()[mask]), pa.nulls(len(row), pa.int32()), taken.column("division").combine_chunks()]
    names = ["key", "day", "kind", "bout_id", "participant", "won", "rating_at", "rd_at", "rating", "rd", "moved", "bouts_before", "place_at", "division"]
    yield from pa.Table.from_arrays(columns, names=names).to_batches(max_chunksize=50_000)


def gap_rows(kind: str, rows: pa.Table, order: np.ndarray, out: dict[str, np.ndarray], names: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each decided bout, as `sweeps.career_gaps` returns it."""
    mask = rows.column("kind").to_numpy()[order] == 0
    taken = rows.select(["key", "day", "bout_id"]).take(pa.array(order[mask]))
    gaps = out["gap"][mask]
    edges = pa.array(np.arange(0, gaps.size + 1, gaps.shape[1], dtype=np.int32))
    columns = [*(taken.column(c).combine_chunks() for c in taken.column_names), *(pa.array(names[mask, i]).cast(_arrow(kind)) for i in (0, 1)), pa.array(out["mover"][mask]), pa.ListArray.from_arrays(edges, pa.array(gaps.ravel()))]
    yield from pa.Table.from_arrays(columns, names=["key", "day", "bout_id", "winner", "loser", "mover", "gaps"]).to_batches(max_chunksize=50_000)


def dealt(bouts: DataFrame, key: str, kind: str) -> DataFrame:
    """The bouts by key, in the order of the replay; rows without a key, day, kind, id or side are left out."""
    start = lambda c: F.col(c) if isinstance(bouts.schema[c].dataType, ArrayType) else F.col(c).cast("double")
    needed = bouts.dropna(subset=[key, "day", "kind", "bout_id", "winner", "loser"]).select(
        F.col(key).cast("long").alias("key"), F.unix_date("day").alias("day"), F.col("kind").cast("int").alias("kind"), F.col("bout_id").cast("long").alias("bout_id"), *(F.col(c).cast(kind).alias(c) for c in ("winner", "loser")),
        F.col("division").cast("string").alias("division"), F.col("dominance").cast("double").alias("dominance"), start("start_winner").alias("start_winner"), start("start_loser").alias("start_loser"),
    )
    # By a hash of the key, since Spark drops a repartition by the key itself over a union of frames that stand by the key, whose partitions may hold different keys once they are merged.
    return needed.repartition(F.xxhash64("key")).sortWithinPartitions("key", "day", "kind", "bout_id")


def replayed(rows: DataFrame, sets: list, emit: Callable, kind: str, schema: str, sides_too: bool = False) -> DataFrame:
    """The replay of `dealt` rows under each set."""
    return rows.mapInArrow(partial(fold, stacked(sets), partial(emit, kind), sides_too, STRETCH), schema)
