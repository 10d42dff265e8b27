"""Replays of many parameter sets against replays of one set each, scales against the single fit, the batched search against one choice at a time."""

import dataclasses
import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutline.operators import models, replay, sweeps
from boutline.operators.replay import Glicko, PointFlow
from boutline.plans import sweeps as plans
from boutline.sources.tables import Tables

DAY = datetime.date(2000, 1, 1)
SHAPE = "league long, day date, kind int, bout_id long, winner int, loser int, division string, dominance double, start_winner double, start_loser double, is_title boolean, is_five boolean, is_draw boolean"


def rows(seed, n=300, people=12):
    rng, out = random.Random(seed), []
    for k in range(n):
        w, x = rng.sample(range(people), 2)
        start = lambda: rng.choice([None, 1450.0, 1610.0])
        out.append((k % 2, DAY + datetime.timedelta(days=rng.randrange(1500)), int(rng.random() < 0.1), k, min(w, x) if rng.random() < 0.8 else max(w, x), 0, rng.choice("ab"), rng.random(), start(), start(), rng.random() < 0.1, rng.random() < 0.2, rng.random() < 0.5))
        out[-1] = (*out[-1][:5], x if out[-1][4] == w else w, *out[-1][6:])
    return out


@pytest.fixture(scope="module")
def bouts(spark):
    return spark.createDataFrame(rows(4) + [(None, DAY, 0, 900, 1, 2, "a", 0.5, None, None, False, False, False), (0, None, 0, 901, 1, 2, "a", 0.5, None, None, False, False, False), (0, DAY, 0, 902, None, 2, "a", 0.5, None, None, False, False, False)], SHAPE).cache()


SETS = [Glicko(), Glicko(unknown="average", rd=200.0, least_rd=90.0), Glicko(carry=0.3, rd_month=50.0, rating=1400.0, win_floor=0.5, rd_move=120.0)]
FLOWS = [PointFlow(), PointFlow(streak_step=0.1, streak_cap=2, five_rounds=1.5, former_champion=1.3), PointFlow(base=0.1, grace=1.0, erosion=0.8, erosion_floor=0.2, loss_base=0.5, lost_base=0.4)]


def test_careers_equal_single_replays(bouts):
    many = {r["bout_id"]: r for r in sweeps.career_gaps(bouts, "league", SETS).collect()}
    for n, one in enumerate(SETS):
        sides = {}
        for r in replay.careers(bouts, "league", params=one).where("kind = 0").collect():
            sides.setdefault(r["bout_id"], {})[r["won"]] = r["rating_at"]
        assert sides.keys() == many.keys() and len(many) > 200
        for k, s in sides.items():
            assert many[k]["gaps"][n] == pytest.approx(s[True] - s[False], abs=1e-9)


def test_movers(bouts):
    """Against the bouts before, in order: one of the two has won or lost in another division."""
    seen, want = {}, {}
    for r in bouts.where("league IS NOT NULL AND day IS NOT NULL AND winner IS NOT NULL AND kind = 0").orderBy("day", "bout_id").collect():
        both = [seen.setdefault((r["league"], p), set()) for p in (r["winner"], r["loser"])]
        want[r["bout_id"]] = any(s - {r["division"]} for s in both)
        for s in both:
            s.add(r["division"])
    assert {r["bout_id"]: r["mover"] for r in sweeps.career_gaps(bouts, "league", SETS[:1]).collect()} == want and set(want.values()) == {True, False}


def test_points_equal_single_replays(bouts):
    """The points before a bout, eroded, are what the single replay's last points give."""
    many = {r["bout_id"]: r for r in sweeps.point_gaps(bouts, "league", FLOWS).collect()}
    for n, one in enumerate(FLOWS):
        last, sides = {}, {}
        for r in replay.point_flow(bouts, "league", params=one).orderBy("day", "kind", "bout_id").collect():
            who = (r["league"], r["participant"])
            day = (r["day"] - DAY).days
            if r["kind"] == 0:
                sides.setdefault(r["bout_id"], {})[r["won"]] = replay.eroded(one, r["before"], replay.months(last.get(who), day))
            last[who] = day
        assert sides.keys() == many.keys()
        for k, s in sides.items():
            assert many[k]["gaps"][n] == pytest.approx(np.log(s[True] / s[False]), rel=1e-9, abs=1e-12)


def test_elo_equals_single_replays(spark, bouts):
    decided = bouts.where("kind = 0")
    many = {(r["bout_id"], r["participant"]): r["after"] for r in sweeps.elo_many(decided, "league", [20.0, 96.0]).collect()}
    for n, k in enumerate((20.0, 96.0)):
        one = {(r["bout_id"], r["participant"]): r["after"] for r in replay.elo(decided, "league", k=k).collect()}
        assert one.keys() == many.keys() and all(many[key][n] == pytest.approx(v) for key, v in one.items())
    # starts by k and scale against the single form
    debuts = spark.createDataFrame([(3, DAY + datetime.timedelta(days=700)), (4, DAY), (99, DAY)], "participant int, debut date")
    history = sweeps.elo_many(decided.where("league = 0"), "league", [20.0, 96.0])
    got = {r["participant"]: r["start"] for r in sweeps.starts_before(history, debuts, [(0, 0.5), (1, 1.2)]).collect()}
    for n, (k, scale) in enumerate([(20.0, 0.5), (96.0, 1.2)]):
        one = {r["participant"]: r["start"] for r in replay.elo_before(replay.elo(decided.where("league = 0"), "league", k=k), debuts, scale).collect()}
        assert one[3] == pytest.approx(got[3][n]) and one[99] is None and got[99] is None and got[4] is None


def test_starts_by_set(bouts):
    """A start for each set: the same gaps as a replay with that set's starts alone."""
    low, high = bouts, bouts.withColumns({c: F.col(c) + 100 for c in ("start_winner", "start_loser")})
    both = bouts.withColumns({c: F.when(F.col(c).isNotNull(), F.array(F.col(c), F.col(c) + 100)) for c in ("start_winner", "start_loser")})
    for unknown in ("base", "average"):
        p = Glicko(unknown=unknown)
        one, other = ({r["bout_id"]: r["gaps"][0] for r in sweeps.career_gaps(b, "league", [p]).collect()} for b in (low, high))
        many = {r["bout_id"]: r["gaps"] for r in sweeps.career_gaps(both, "league", [p, p]).collect()}
        assert all(many[k] == pytest.approx([one[k], other[k]]) for k in one) and one != other


WINDOWS = [("2001-01-01", "2002-06-01"), ("2003-01-01", "9999-12-31"), ("1990-01-01", "1991-01-01")]


def test_scales_and_losses_by_window(spark, bouts):
    gaps = sweeps.career_gaps(bouts, "league", SETS).cache()
    found = {(r["window"], r["set"], r["part"]): r for r in sweeps.window_losses(gaps, WINDOWS, len(SETS)).collect()}
    assert len(found) == len(WINDOWS) * len(SETS) * 2
    for w, (start, end) in enumerate(WINDOWS):
        for n in range(len(SETS)):
            x = gaps.select("day", F.col("gaps")[n].alias("x"))
            train, test = x.where(F.col("day") < start), x.where((F.col("day") >= start) & (F.col("day") < end))
            k = models.fit_scale(train, "x")
            for part, df in (("train", train), ("test", test)):
                r = found[w, n, part]
                p = [1 / (1 + np.exp(-k * q["x"])) for q in df.collect()]
                assert r["scale"] == pytest.approx(k, abs=1e-8) and r["n"] == len(p)
                assert r["log_loss"] == (pytest.approx(-np.mean(np.log(p))) if p else None)
                assert r["accuracy"] == (pytest.approx(df.agg(F.avg(F.when(F.col("x") > 0, 1.0).when(F.col("x") == 0, 0.5).otherwise(0.0))).first()[0]) if p else None)
    best = {r["window"]: r for r in sweeps.picked(spark.createDataFrame(list(found.values()))).collect()}
    for w in (0, 1):
        assert best[w]["train_loss"] == min(found[w, n, "train"]["log_loss"] for n in range(3)) and best[w]["test_loss"] == found[w, best[w]["set"], "test"]["log_loss"]


def test_scales_at_the_ends(spark):
    """No signal gives 0, perfect separation the cap, a signal the wrong way 0; each as the single fit."""
    rows_ = [(DAY, [0.0, 1.0, -1.0, 0.5]), (DAY, [0.0, 2.0, -2.0, -0.1])]
    gaps = spark.createDataFrame(rows_, "day date, gaps array<double>")
    k = sweeps.fit_scales(gaps, [("2001-01-01", "2002-01-01")], 4)[0]
    one = [models.fit_scale(gaps.select(F.col("gaps")[n].alias("x")), "x") for n in range(4)]
    assert k == pytest.approx(one, abs=1e-6) and k[0] == 0 and k[2] == 0 and k[1] == pytest.approx(50, abs=1e-3)
    assert sweeps.fit_scales(gaps.limit(0), [("2001-01-01", "2002-01-01")], 4).tolist() == [[0.0] * 4]


def test_batched_search_goes_the_same_way():
    space = {"a": models.Range(-10, 10, 2), "b": models.Range(0.1, 100, 2, log=True), "c": models.Range(0, 9, 2, whole=True)}
    value = lambda q: (q["a"] - 1) ** 2 + np.log(q["b"] / 4) ** 2 + (q["c"] - 3) ** 2 + 0.3 * q["a"] * q["c"]
    start = {"a": 9.0, "b": 50.0, "c": 9.0}
    calls = []

    def many(choices):
        calls.append(len(choices))
        return [value(q) for q in choices]

    for budget in (2000, 17):
        assert models.pattern_search(many, start, space, refinements=5, evaluations=budget, many=True) == models.pattern_search(value, start, space, refinements=5, evaluations=budget)
    assert max(calls) <= 7 and len(calls) < 60


def test_search_over_replays(bouts):
    """The same as a search whose every step replays one set."""
    space = {"rd_month": models.Range(5, 60, 2.0, log=True), "win_floor": models.Range(0.5, 1.0, 0.25)}
    make = lambda at: dataclasses.replace(Glicko(), **at)
    many = sweeps.training_losses(bouts, "league", make, "2003-06-01")
    start = {"rd_month": 20.0, "win_floor": 0.75}
    found = models.pattern_search(many, start, space, refinements=0, evaluations=12, many=True)
    plain = models.pattern_search(lambda at: many([at])[0], start, space, refinements=0, evaluations=12)
    assert found[0] == plain[0] and found[1] == pytest.approx(plain[1]) and found[2] == plain[2]
    assert found[1] <= many([start])[0]
    assert many([start, start])[0] == pytest.approx(many([start])[0]) and sweeps.training_losses(bouts, "league", make, "1990-01-01")([start]) == [float("inf")]


def test_prospect_grid_equals_single_replays(spark):
    """Two of the eight settings, each by an Elo replay, starts and a career replay of its own."""
    t = Tables(spark, "/root/testdata/sf0.001")
    got = {(r["window"], r["k"], r["start_scale"], r["unknown"], r["part"]): r for r in plans.m14_prospects(t).collect()}
    assert len(got) == 2 * 8 * 2
    every = plans.bouts(t)
    outside, own = every.where("kind = 0 AND month(day) % 2 = 1"), every.where("month(day) % 2 = 0").drop("start_winner", "start_loser")
    who = lambda side: F.concat_ws("/", "o_custkey", side)
    debuts = own.where("kind = 0").select("day", F.explode(F.array(who("winner"), who("loser"))).alias("participant")).groupBy("participant").agg(F.min("day").alias("debut"))
    for k, scale, unknown in ((48.0, 1.2, "base"), (96.0, 0.6, "average")):
        history = replay.elo(outside, "o_custkey", k=k).withColumn("participant", who("participant"))
        starts = replay.elo_before(history, debuts, scale).select("participant", "start")
        b = own
        for side in ("winner", "loser"):
            b = b.join(starts.select(F.col("participant").alias(f"_{side}"), F.col("start").alias(f"start_{side}")), who(side) == F.col(f"_{side}"), "left")
        h = replay.careers(b, "o_custkey", params=Glicko(unknown=unknown)).where("kind = 0").groupBy("bout_id", "day").agg(F.sum(F.when(F.col("won"), F.col("rating_at")).otherwise(-F.col("rating_at"))).alias("x"))
        gaps = h.select("day", F.array("x").alias("gaps"))
        for r in sweeps.window_losses(gaps, plans.WINDOWS, 1).collect():
            other = got[r["window"], k, scale, unknown, r["part"]]
            assert (other["n"], other["log_loss"]) == (r["n"], pytest.approx(r["log_loss"], abs=2e-6)) and other["scale"] == pytest.approx(r["scale"], abs=2e-6)


def test_empty(spark, bouts):
    none = bouts.limit(0)
    assert sweeps.career_gaps(none, "league", SETS).count() == 0 and sweeps.point_gaps(none, "league", FLOWS).count() == 0
    assert {r["n"] for r in sweeps.sweep(none, "league", SETS, WINDOWS).collect()} == {0}
