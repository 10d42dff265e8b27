"""Career replays by levels against one bout at a time, and what a level costs."""

import datetime
import random
from functools import partial

import numpy as np
import pytest

from boutline.operators import levels, replay
from boutline.operators.replay import Careers, Glicko

DAY = datetime.date(1969, 6, 1)
SHAPE = "k long, bout_id long, day date, kind int, winner {0}, loser {0}, division string, dominance double, start_winner double, start_loser double"
COLUMNS = ["day", "kind", "bout_id", "winner", "loser", "division", "dominance", "start_winner", "start_loser"]


def bouts(seed, n=300, people=9, keys=4, name=int):
    """Days before 1970, no-results before a first bout, missing divisions and dominances, somebody against themselves."""
    rng, out = random.Random(seed), []
    for i in range(n):
        w, x = rng.sample(range(people), 2) if i % 40 else (1, 1)
        start = lambda: rng.choice([None, None, 1450.0, 1620.0])
        out.append((rng.randrange(keys), i, DAY + datetime.timedelta(days=rng.randrange(900)), int(rng.random() < 0.2), name(w), name(x), rng.choice(["a", "b", None]), rng.choice([None, rng.random(), 1.5]), start(), start()))
    return out


def plain(df):
    rows = sorted((tuple(r) for r in df.select("k", "bout_id", "participant", "won", "kind", "day", "rating_at", "rd_at", "rating", "rd", "moved", "bouts_before", "place_at", "division").collect()), key=str)
    return [tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in rows]


@pytest.mark.parametrize("stretch", [1, 7, 64, 10_000])
@pytest.mark.parametrize("kind, params", [("int", Glicko()), ("long", Glicko(unknown="average", carry=0.4)), ("string", Glicko(rd_month=45.0, least_rd=80.0))])
def test_levels_equal_one_bout_at_a_time(spark, monkeypatch, stretch, kind, params):
    monkeypatch.setattr(levels, "STRETCH", stretch)
    df = spark.createDataFrame([*bouts(1, name=str if kind == "string" else int), (None, 900, DAY, 0, *(["1", "2"] if kind == "string" else [1, 2]), "a", 0.5, None, None)], SHAPE.format(kind))
    schema = f"key long, day int, kind int, bout_id long, participant {kind}, won boolean, rating_at double, rd_at double, rating double, rd double, moved boolean, bouts_before long, place_at int, division string"
    want = replay.ordered_replay(df, "k", ["day", "kind", "bout_id"], COLUMNS, Careers, partial(replay._career_step, params, False), schema)
    assert plain(replay.careers(df, "k", kind, params)) == plain(want)


def test_a_stretch_takes_as_many_steps_as_its_longest_chain(monkeypatch):
    """A thousand leagues of ten bouts among two people are ten steps, not ten thousand."""
    import pyarrow as pa

    made = []
    real = levels._level
    monkeypatch.setattr(levels, "_level", lambda *a: made.append(1) or real(*a))
    n = 10_000
    key = np.arange(n) // 10
    rows = {"key": key, "day": (np.arange(n) % 10).astype(np.int32), "kind": np.zeros(n, np.int32), "bout_id": np.arange(n), "winner": np.ones(n, np.int64), "loser": np.full(n, 2)}
    batch = pa.RecordBatch.from_pydict({**rows, "division": ["a"] * n, "dominance": np.full(n, 0.5), "start_winner": pa.nulls(n, pa.float64()), "start_loser": pa.nulls(n, pa.float64())})
    out = list(levels.fold(levels.stacked([Glicko()]), partial(levels.side_rows, "long"), True, 200_000, iter([batch])))
    assert len(made) == 10 and sum(b.num_rows for b in out) == 2 * n


def test_states_of_a_pool_are_arrays():
    """A hundred thousand participants of one key take less than 8 MB between stretches."""
    kept = levels.Kept(0, 1)
    for start in range(0, 100_000, 10_000):
        kept.places(np.random.default_rng(start).permutation(np.arange(start, start + 10_000)))
    again = kept.places(np.array([99_999, 0, 5]))
    assert kept.n == 100_000 and len(set(again)) == 3
    assert sum(a.nbytes for a in [*kept.state.values(), kept.ids, kept.at]) < 8_000_000
