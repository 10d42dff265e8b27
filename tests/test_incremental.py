"""Replays that go on from a state, and replays in waves, against one replay of everything."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from boutline.operators import replay, waves
from boutline.operators.replay import Glicko

DAY = datetime.date(2015, 1, 1)
SHAPE = "k long, bout_id long, day date, kind int, winner int, loser int, division string, dominance double, start_winner double, start_loser double"


def bouts(seed, n=220, people=14, keys=2):
    rng, out = random.Random(seed), []
    for i in range(n):
        k = i % keys
        w, x = rng.sample(range(100 * k, 100 * k + people), 2)
        out.append((k, i, DAY + datetime.timedelta(days=rng.randrange(900)), int(rng.random() < 0.15), w, x, rng.choice("ab"), rng.random(), rng.choice([None, 1600.0]), None))
    return out


COLUMNS = ["day", "kind", "bout_id", "participant", "won", "rating_at", "rd_at", "rating", "rd", "moved", "bouts_before", "division"]


def plain(df, places=False):
    rows = {(r["bout_id"], r["participant"]): tuple(r[c] for c in [*COLUMNS, *(["place_at"] if places else [])]) for r in df.collect()}
    return {key: tuple(round(v, 7) if isinstance(v, float) else v for v in row) for key, row in rows.items()}


@pytest.mark.parametrize("places", [False, True])
def test_resumed_equals_all_again(spark, places):
    every = bouts(1)
    late = [b for b in every if b[1] % 23 == 0 or b[2] > DAY + datetime.timedelta(days=800)]
    early = [b for b in every if b not in late]
    frame = lambda rows: spark.createDataFrame(rows, SHAPE)
    before = replay.careers(frame(early), "k", places=places)
    got = replay.resumed(before, frame(every), frame(late), "k", places=places)
    assert got.columns == before.columns and plain(got, places) == plain(replay.careers(frame(every), "k", places=places), places)
    # only the latest days of one key
    newest = [b for b in every if b[0] == 1 and b[2] > DAY + datetime.timedelta(days=700)]
    rest = [b for b in every if b not in newest]
    again = replay.resumed(replay.careers(frame(rest), "k"), frame(every), frame(newest), "k")
    assert plain(again) == plain(replay.careers(frame(every), "k"))
    none = replay.resumed(before, frame(early), frame([]), "k", places=places)
    assert plain(none, places) == plain(before, places)


def test_components_that_merge(spark):
    """A bout between two components' people joins their histories under one key."""
    every = bouts(2)
    bridge = (7, 999, DAY + datetime.timedelta(days=600), 0, 3, 104, "a", 0.4, None, None)
    frame = lambda rows: spark.createDataFrame(rows, SHAPE)
    before = replay.careers(frame(every), "k")
    merged = frame([(7, *b[1:]) for b in every] + [bridge])
    got = replay.resumed(before, merged, frame([bridge]), "k")
    assert plain(got) == plain(replay.careers(merged, "k")) and {r["k"] for r in got.select("k").distinct().collect()} == {7}
    with pytest.raises(ValueError):
        replay.resumed(before, merged, frame([bridge]), "k", params=Glicko(unknown="average"))


def chain(rows):
    """The longest chain of bouts that hang on each other."""
    wave, longest = {}, 0
    for b in sorted(rows, key=lambda b: (b[2], b[3], b[1])):
        at = 1 + max(wave.get(b[4], 0), wave.get(b[5], 0))
        wave[b[4]] = wave[b[5]] = at
        longest = max(longest, at)
    return longest


@pytest.mark.parametrize("fold_below, params", [(0, Glicko()), (40, Glicko(carry=0.5, rd_month=40.0)), (10_000, Glicko())])
def test_waves_equal_one_replay(spark, fold_below, params):
    rows = bouts(3, n=90, people=30)
    df = spark.createDataFrame([*rows, (0, 900, None, 0, 1, 2, "a", 0.5, None, None), (0, 901, DAY, 0, None, 2, "a", 0.5, None, None)], SHAPE)
    pool = df.withColumn("k", F.lit(0).cast("long"))
    got = waves.careers(df, params=params, fold_below=fold_below)
    assert got.columns == [c if c != "k" else "key" for c in replay.careers(pool, "k").columns]
    assert plain(got) == plain(replay.careers(pool, "k", params=params))
    assert waves.careers(df.limit(0), fold_below=fold_below).count() == 0


def test_waves_are_the_longest_chain(spark, monkeypatch):
    rows = bouts(4, n=40, people=20)
    made = []
    real = waves.checkpointed
    monkeypatch.setattr(waves, "checkpointed", lambda df: made.append(1) or real(df))
    waves.careers(spark.createDataFrame(rows, SHAPE), fold_below=0)
    assert (len(made) - 1) / 3 == chain(rows)


def test_resumed_with_large_joins(spark):
    """Where the bouts and the states come from shuffled joins on the key, the two sides' partitions aren't the same keys: the fold deals them anew."""
    every = bouts(5, n=40, people=6)
    late = [b for b in every if b[1] % 7 == 0]
    frame = lambda rows: spark.createDataFrame(rows, SHAPE)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        before = waves.checkpointed(replay.careers(frame([b for b in every if b not in late]), "k"))
        got = replay.resumed(before, frame(every), frame(late), "k")
        assert "REPARTITION_BY_COL" in got._jdf.queryExecution().executedPlan().toString()
        assert plain(got) == plain(replay.careers(frame(every), "k"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
