"""Sweeps of replay parameters on the driver's tables.  Each customer's orders are the bouts of a league of five, as in `replays`, but the lower number wins three
of four bouts, so that ratings have something to find.

The SQL twins replay each set by itself with its constants spelt out, and fit the scales by Newton steps over lists."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from boutline.operators import sweeps
from boutline.operators.models import Range, pattern_search
from boutline.operators.replay import Glicko, PointFlow
from boutline.plans import replays
from boutline.plans.registry import query

C = F.col
WINDOWS = [("1996-01-01", "1998-01-01"), ("1998-01-01", "9999-12-31")]
CAREERS = [Glicko(), Glicko(rd_month=35.0, win_floor=0.6, rd_move=90.0), Glicko(rd=220.0, carry=0.5, least_rd=60.0)]
POINTS = [PointFlow(), PointFlow(opponent=0.4, activity=0.03, title_win=1.2, erosion=0.9), PointFlow(streak_step=0.05, lost_base=0.3, title_loss=2.0, grace=2.0)]


def bouts(t):
    """The bouts of `replays`, with the lower number as the winner unless the price's whole part is a multiple of 4."""
    b = replays.bouts(t).join(t.orders.select(C("o_orderkey").alias("bout_id"), (F.floor("o_totalprice") % 4 != 0).alias("_sure")), "bout_id")
    low, high = F.least("winner", "loser"), F.greatest("winner", "loser")
    return b.withColumns({"winner": F.when(C("_sure"), low).otherwise(high), "loser": F.when(C("_sure"), high).otherwise(low)}).drop("_sure")


def _skilled(sql: str) -> str:
    """A replay's SQL over these bouts."""
    pick = "SELECT * REPLACE (CASE WHEN sure THEN least(w, l) ELSE greatest(w, l) END AS w, CASE WHEN sure THEN greatest(w, l) ELSE least(w, l) END AS l) FROM (SELECT floor(o_totalprice) % 4 <> 0 AS sure, "
    return sql.replace("FROM (SELECT o_custkey AS k", f"FROM ({pick}o_custkey AS k").replace("AS title FROM orders)", "AS title FROM orders))")


def _career_gaps(p: Glicko) -> str:
    states = replays._CAREER.split("\nSELECT id AS bout_id")[0]
    own = {
        "+ 400 * greatest(0": f"+ {p.rd_month**2} * greatest(0", "+ 2500)": f"+ {p.rd_move**2})", "least(300,": f"least({p.rd},", "[300::DOUBLE, 300, 300, 300, 300]": f"[{p.rd}::DOUBLE, {p.rd}, {p.rd}, {p.rd}, {p.rd}]",
        "0.8 + 0.2 * dom": f"{p.win_floor} + {1 - p.win_floor} * dom", "greatest(30,": f"greatest({p.least_rd},",
        "r[w] AS rw, r[l] AS rl,": f"CASE WHEN dv[w] <> div THEN 1500 + (r[w] - 1500) * {p.carry} ELSE r[w] END AS rw, CASE WHEN dv[l] <> div THEN 1500 + (r[l] - 1500) * {p.carry} ELSE r[l] END AS rl,",
    }
    for old, new in own.items():
        assert old in states
        states = states.replace(old, new)
    return f"{_skilled(states)} SELECT b.d, s.id AS bout_id, rw - rl AS x FROM s JOIN b ON b.id = s.id WHERE s.kind = 0"


def _point_gaps(p: PointFlow) -> str:
    states = replays._POINTS.split("\nSELECT id AS bout_id")[0]
    run = lambda e: f"(1 + {p.streak_step} * least(abs(st[{e}]), {p.streak_cap}))"
    own = {
        "<= 4 * 30.44": f"<= {p.grace} * 30.44", "pow(0.96,": f"pow({p.erosion},", "/ 30.44 - 4)": f"/ 30.44 - {p.grace})", "ow + CASE WHEN title THEN 1.6 ELSE 1 END": f"ow + {run('w')} * CASE WHEN title THEN {p.title_win} ELSE 1 END",
        "0.24 * ol": f"{p.opponent} * ol", "0.066 * m": f"{p.activity} * m", "0.1 * m * 2.6 * dom": f"0.1 * m * ({p.lost_base} + 2.6 * dom) * {run('l')}", "CASE WHEN title THEN 8 ELSE": f"CASE WHEN title THEN {p.title_loss} ELSE",
        "0 AS sw, 0 AS sl FROM (SELECT DISTINCT": "0 AS sw, 0 AS sl, 0::DOUBLE AS ow, 0::DOUBLE AS ol FROM (SELECT DISTINCT", "bw, bl, aw, al, sw, sl FROM (": "bw, bl, aw, al, sw, sl, ow, ol FROM (",
    }
    for old, new in own.items():
        assert old in states
        states = states.replace(old, new)
    return f"{_skilled(states)} SELECT b.d, s.id AS bout_id, ln(ow / ol) AS x FROM s JOIN b ON b.id = s.id WHERE s.kind = 0"


def _losses(gaps: list[str]) -> str:
    """window, set, part, scale, log_loss, accuracy, n of gaps by set."""
    every = " UNION ALL ".join(f"SELECT {n} AS set, * FROM ({one})" for n, one in enumerate(gaps))
    p, q = "(1 / (1 + exp(-greatest(-700, least(700, k * x)))))", "(1 / (1 + exp(greatest(-700, least(700, k * x)))))"
    step = f"list_sum(list_transform(xs, lambda x: {q} * x)) / list_sum(list_transform(xs, lambda x: {p} * {q} * x * x))"
    windows = ", ".join(f"({n}, DATE '{a}', DATE '{b}')" for n, (a, b) in enumerate(WINDOWS))
    return f"""WITH g AS MATERIALIZED ({every}), v(win, a, z) AS (VALUES {windows}),
 t AS (SELECT win, set, list(x) AS xs FROM g JOIN v ON d < a GROUP BY ALL),
 f AS MATERIALIZED (SELECT win, set, list_reduce(list_prepend(1.0::DOUBLE, range(25)), lambda k, i: CASE WHEN abs(k) > 1e300 THEN k ELSE greatest(0, least(50, k + coalesce({step}, 0))) END) AS k FROM t),
 r AS (SELECT win, set, CASE WHEN d < a THEN 'train' ELSE 'test' END AS part, k, x FROM g JOIN v ON d < z JOIN f USING (win, set))
 SELECT CAST(win AS INT) AS "window", set, part, round(k, 6) AS scale, round(avg(-ln(greatest(1e-12, {p}))), 6) AS log_loss, round(avg(CASE WHEN x > 0 THEN 1 WHEN x = 0 THEN 0.5 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM r GROUP BY win, set, part, k"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("scale", "log_loss", "accuracy")})


@query("m14_career_sweep", _losses([_career_gaps(p) for p in CAREERS]))
def m14_careers(t):
    """Three sets of career constants, judged in two windows by one replay."""
    return _rounded(sweeps.sweep(bouts(t), "o_custkey", CAREERS, WINDOWS))


@query("m14_point_sweep", _losses([_point_gaps(p) for p in POINTS]))
def m14_points(t):
    return _rounded(sweeps.sweep(bouts(t), "o_custkey", POINTS, WINDOWS, sweeps.point_gaps))


@query("m12_gaps", f"""WITH o AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderstatus AS div, CAST(o_orderdate AS DATE) AS d FROM orders), g AS ({_career_gaps(CAREERS[0])}), e AS ({_career_gaps(CAREERS[1])}),
 who AS (SELECT k, id, d, div, unnest([w, l]) AS p FROM ({_skilled(replays._BOUTS.format(where=' WHERE kind = 0')).removeprefix('b AS ')})),
 m AS (SELECT a.id, bool_or(x.id IS NOT NULL) AS mover FROM who a LEFT JOIN who x ON x.k = a.k AND x.p = a.p AND x.div <> a.div AND (x.d, x.id) < (a.d, a.id) GROUP BY a.id)
 SELECT g.bout_id, m.mover, round(g.x, 4) AS gap, round(e.x, 4) AS other_gap FROM g JOIN e USING (bout_id) JOIN m ON m.id = g.bout_id""")
def m12(t):
    g = sweeps.career_gaps(bouts(t), "o_custkey", CAREERS[:2])
    return g.select("bout_id", "mover", F.round(C("gaps")[0], 4).alias("gap"), F.round(C("gaps")[1], 4).alias("other_gap"))


SPACE = {"rd_month": Range(5, 60, 1.5, log=True), "win_floor": Range(0.5, 1.0, 0.1), "rd_move": Range(0, 150, 40)}


@query("m11_career_search")
def m11(t):
    """Career constants by pattern search over the bouts before 1998; each move is one replay of all its neighbours."""
    objective = sweeps.training_losses(bouts(t), "o_custkey", lambda at: dataclasses.replace(Glicko(), **at), "1998-01-01")
    at, loss, used = pattern_search(objective, {"rd_month": 20.0, "win_floor": 0.8, "rd_move": 50.0}, SPACE, refinements=1, evaluations=60, many=True)
    rows = [(name, round(float(value), 6), round(loss, 6), used) for name, value in at.items()]
    return t.spark.createDataFrame(rows, "constant string, value double, log_loss double, evaluations int")


KS, SCALES = [48.0, 96.0], [0.6, 1.2]


@query("m14_prospects")
def m14_prospects(t):
    """The prospect grid: k of the Elo x scale of the start x what unknown debutants get, in one Elo replay and one career replay.  Bouts of odd months are external
    ones, which only give the debut its start."""
    every = bouts(t)
    outside, own = every.where("kind = 0 AND month(day) % 2 = 1"), every.where("month(day) % 2 = 0").drop("start_winner", "start_loser")
    picks = [(k, s) for k in range(len(KS)) for s in SCALES] * 2
    sets = [Glicko(unknown="base")] * 4 + [Glicko(unknown="average")] * 4
    who = lambda side: F.concat_ws("/", "o_custkey", side)
    elo = sweeps.elo_many(outside, "o_custkey", KS).withColumn("participant", who("participant"))
    sides = own.where("kind = 0").select("day", F.explode(F.array(who("winner"), who("loser"))).alias("participant"))
    debuts = sides.groupBy("participant").agg(F.min("day").alias("debut"))
    starts = sweeps.starts_before(elo, debuts, picks).select("participant", "start")
    for side in ("winner", "loser"):
        own = own.join(starts.select(C("participant").alias(f"_{side}"), C("start").alias(f"start_{side}")), who(side) == C(f"_{side}"), "left").drop(f"_{side}")
    losses = _rounded(sweeps.sweep(own, "o_custkey", sets, WINDOWS))
    names = F.array(*(F.struct(F.lit(KS[k]).alias("k"), F.lit(s).alias("start_scale"), F.lit(p.unknown).alias("unknown")) for (k, s), p in zip(picks, sets)))
    return losses.select("window", names[C("set")].alias("_n"), "part", "scale", "log_loss", "accuracy", "n").select("window", "_n.*", "part", "scale", "log_loss", "accuracy", "n")
