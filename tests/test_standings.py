"""Order statistics against a sorted list, places and wins over the best against a look at everybody, checks on cases with known answers."""

import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boutline.operators import replay, standings

DAY = datetime.date(2019, 1, 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 12)), max_size=300), st.integers(1, 4))
def test_standing_equals_a_sorted_list(steps, load):
    own, plain = standings.Standing(load), []
    for add, x in steps:
        if add or x not in plain:
            own.add(float(x))
            plain.append(x)
        else:
            own.remove(float(x))
            plain.remove(x)
        assert len(own) == len(plain)
        assert [own.above(y) for y in (-1.0, 5.5, float(x), 13.0)] == [sum(p > y for p in plain) for y in (-1.0, 5.5, float(x), 13.0)]


def test_standing_of_many():
    rng, own = random.Random(1), standings.Standing()
    values = [rng.random() for _ in range(20_000)]
    for v in values:
        own.add(v)
    for v in values[:15_000]:
        own.remove(v)
    rest = values[15_000:]
    assert all(own.above(y) == sum(v > y for v in rest) for y in values[::997])


SHAPE = "k long, bout_id long, day date, kind int, winner int, loser int, division string, dominance double, start_winner double, start_loser double"


def bouts(seed, n=400, people=25):
    rng, out = random.Random(seed), []
    for k in range(n):
        w, x = rng.sample(range(people), 2)
        out.append((k % 2, k, DAY + datetime.timedelta(days=int(k * 4.5) + rng.randrange(4)), int(rng.random() < 0.1), min(w, x) if rng.random() < 0.7 else max(w, x), 0, rng.choice("ab"), rng.random(), None, None))
        out[-1] = (*out[-1][:5], x if out[-1][4] == w else w, *out[-1][6:])
    return out


@pytest.fixture(scope="module")
def history(spark):
    return replay.careers(spark.createDataFrame(bouts(5), SHAPE), "k", places=True).cache()


def in_order(history):
    rows = {}
    for r in history.collect():
        rows.setdefault((r["k"], r["day"], r["kind"], r["bout_id"]), []).append(r)
    return [rows[key] for key in sorted(rows)]


def test_places_equal_a_look_at_all(history):
    """The place among everybody with a bout, by rating as the bout begins."""
    now, seen = {}, 0
    for sides in in_order(history):
        k = sides[0]["k"]
        ratings = now.setdefault(k, {})
        there = {p: v for p, (v, n) in ratings.items() if n} | {r["participant"]: r["rating_at"] for r in sides if ratings.get(r["participant"], (0, 0))[1]}
        for r in sides:
            want = 1 + sum(v > r["rating_at"] for p, v in there.items() if p != r["participant"]) if r["participant"] in there else None
            assert r["place_at"] == want
            seen += want is not None
        for r in sides:
            ratings[r["participant"]] = (r["rating"], ratings.get(r["participant"], (0, 0))[1] + (r["kind"] == 0))
    assert seen > 500


@pytest.mark.parametrize("best, active, chunk", [(3, 547, 365), (1, 547, 10_000), (4, 60, 7), (10, 200, 100)])
def test_wins_over_the_best(history, best, active, chunk):
    want, latest = {}, {}
    for sides in in_order(history):
        if sides[0]["kind"]:
            continue
        w, x = sorted(sides, key=lambda r: not r["won"])
        there = latest.setdefault((w["k"], w["division"]), {})
        own = x["rating_at"] - 2 * x["rd_at"]
        above = sum(c > own for p, (c, d) in there.items() if p not in (w["participant"], x["participant"]) and (w["day"] - d).days <= active)
        if above < best and x["bouts_before"]:
            key = (w["k"], w["division"], w["participant"])
            want[key] = want.get(key, 0) + 1
        for r in sides:
            there[r["participant"]] = (r["rating"] - 2 * r["rd"], r["day"])
    found = standings.wins_over_best(history, ["k", "division"], best, active_days=active, chunk_days=chunk).collect()
    assert {(r["k"], r["division"], r["participant"]): r["wins"] for r in found} == want and want
    assert standings.wins_over_best(history.limit(0), ["k", "division"]).count() == 0


RANKED = "division string, participant int, conservative double, is_champion boolean, bouts long"


def ranked(spark, *rows):
    return spark.createDataFrame([("x", p, c, champion, n) for p, c, champion, n in rows], RANKED)


def outcome(df):
    (r,) = df.collect()
    return r["passed"], list(r["details"])


def test_checks(spark, history):
    wins = lambda *rows: spark.createDataFrame([("x", p, n) for p, n in rows], "division string, participant int, wins long")
    titles = lambda *rows: wins(*rows).withColumnRenamed("wins", "titles")
    thin = ranked(spark, (1, 1600.0, False, 6), (2, 1500.0, False, 9))
    assert outcome(standings.check_thin_leaders(thin, wins(), ["division"])) == (False, ["x 1"]) and outcome(standings.check_thin_leaders(thin, wins((1, 1)), ["division"])) == (True, [])
    assert outcome(standings.check_thin_leaders(ranked(spark, (1, 1600.0, False, 7)), wins(), ["division"])) == (True, [])
    four = [(1, 4.0, False, 9), (2, 3.0, False, 9), (3, 2.0, False, 9), (4, 1.0, True, 9)]
    assert outcome(standings.check_defending_champions(ranked(spark, *four), titles((4, 2)), ["division"])) == (False, ["x 4 4"])
    assert outcome(standings.check_defending_champions(ranked(spark, *four), titles((4, 1)), ["division"])) == (True, [])
    assert outcome(standings.check_defending_champions(ranked(spark, four[0], (4, 3.5, True, 9), four[2]), titles((4, 5)), ["division"])) == (True, [])
    assert outcome(standings.check_first_of_all(ranked(spark, *four), titles((2, 1)))) == (False, ["1"]) and outcome(standings.check_first_of_all(ranked(spark, *four), titles((1, 1)))) == (True, []) and outcome(standings.check_first_of_all(ranked(spark), titles())) == (True, [])
    moved = history.where("kind = 0").limit(1).withColumns({"moved": F.lit(True), "bouts_before": F.lit(5).cast("long"), "rating_at": F.lit(1500.0)})
    assert outcome(standings.check_carry_over(moved))[0] is False and outcome(standings.check_carry_over(moved.withColumn("rating_at", F.lit(1800.0)))) == (True, [])
    assert outcome(standings.check_carry_over(moved.withColumn("bouts_before", F.lit(0).cast("long")))) == (True, [])


def test_title_wins(history):
    ids = [r["bout_id"] for r in history.where("kind = 0").select("bout_id").distinct().orderBy("bout_id").limit(40).collect()]
    titles = history.sparkSession.createDataFrame([(i,) for i in ids] * 2, "bout_id long")
    got = {(r["division"], r["participant"]): r["titles"] for r in standings.title_wins(history, titles, ["division"]).collect()}
    want = {}
    for r in history.collect():
        if r["bout_id"] in ids and r["won"]:
            want[r["division"], r["participant"]] = want.get((r["division"], r["participant"]), 0) + 1
    assert got == want
