"""Recent rates, styles, replay rows and checks on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boutline.operators import models, replay, standings, styles
from boutline.operators.durable import checkpointed
from boutline.plans import replays
from boutline.plans.registry import query

C = F.col


@query("r08_results_only", """SELECT CASE WHEN d IS NULL THEN 'division' ELSE 'result' END AS missing, count(*) AS n FROM (SELECT CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_orderpriority END AS d, o_orderstatus, day(o_orderdate) AS k FROM orders)
 WHERE d IS NULL OR o_orderstatus = 'P' AND k % 3 = 0 GROUP BY 1 UNION ALL SELECT CASE WHEN o_orderstatus = 'P' THEN CASE WHEN day(o_orderdate) % 3 = 1 THEN 'draw' ELSE 'nc' END ELSE 'bout' END, count(*) FROM orders WHERE o_orderpriority NOT LIKE '5%' AND NOT (o_orderstatus = 'P' AND day(o_orderdate) % 3 = 0) GROUP BY 1""")
def r08(t):
    day = F.dayofmonth("o_orderdate")
    rows = t.orders.select(
        C("o_custkey").alias("first"), C("o_orderkey").alias("second"), F.when(C("o_orderstatus") == "F", C("o_custkey")).when(C("o_orderstatus") == "O", C("o_orderkey")).alias("winner_id"), "o_orderpriority",
        F.when(day % 3 == 1, "Draw (majority)").when(day % 3 == 2, "No Contest").otherwise("Decision").alias("method"), (day % 5).alias("round"), (day == 1).alias("is_title"), F.lit(None).cast("boolean").alias("is_main"),
    )
    bouts, skipped = styles.results_only(rows, F.when(~C("o_orderpriority").startswith("5"), C("o_orderpriority")))
    kinds = bouts.groupBy(F.when(C("kind") == 0, "bout").when(C("is_draw"), "draw").otherwise("nc").alias("missing")).agg(F.count("*").alias("n"))
    return skipped.unionByName(kinds)


@query("r10_recent_rates", """SELECT event_id, round(CASE WHEN m > 0 THEN 15 * n / m ELSE 0 END, 5) AS buys_rate, round(coalesce(r, 0.5), 5) AS recent_hit FROM (SELECT event_id, sum(value) OVER w AS m, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS n,
 avg(CASE WHEN value > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))""")
def r10(t):
    d = t.events.select("event_id", "user_id", "ts", "value", (C("event_type") == "purchase").cast("int").alias("buys"), (C("value") > 40).cast("int").alias("hit"))
    return styles.recent_rates(d, "user_id", ["ts", "event_id"], "value", ["buys"], score="hit").select("event_id", F.round("buys_rate", 5).alias("buys_rate"), F.round("recent_hit", 5).alias("recent_hit"))


_RATES = {"takedowns": "CASE WHEN day(o_orderdate) % 3 = 0 THEN 2 ELSE 0 END", "control": "100 + day(o_orderdate)", "ground": "month(o_orderdate)", "submissions": "CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END", "distance": "20 + month(o_orderdate)", "head": "day(o_orderdate)", "clinch": "CASE WHEN o_orderstatus = 'F' THEN 14 ELSE 2 END", "knockdowns": "CASE WHEN o_orderpriority < '2' THEN 2 ELSE 0 END", "sig": "40"}
_W = "(PARTITION BY g, e)"
_SEC = f"sum(CASE WHEN o THEN seconds END) OVER {_W}"


def _sqlz(x: str) -> str:
    return f"CASE WHEN stddev_pop(CASE WHEN o THEN {x} END) OVER {_W} < 1e-9 THEN 0 ELSE ({x} - avg(CASE WHEN o THEN {x} END) OVER {_W}) / stddev_pop(CASE WHEN o THEN {x} END) OVER {_W} END"


_STYLE = f"""WITH t AS (SELECT o_custkey, CAST(count(*) AS INT) AS bouts, 300.0::DOUBLE * count(*) AS seconds, {', '.join(f'sum({v}) AS {k}' for k, v in _RATES.items())} FROM orders GROUP BY 1),
 a AS (SELECT t.*, c_nationkey AS g, c_acctbal > 0 AS ref, bouts >= 3 AND seconds >= 900 AS e FROM t JOIN customer ON c_custkey = o_custkey), b AS (SELECT *, count(*) OVER {_W} AS n, ref OR count(*) FILTER (WHERE ref) OVER {_W} < 10 AS o FROM a),
 c AS (SELECT o_custkey, g, e, n, o, {', '.join(f'900 * ({k} + 2700 * (sum(CASE WHEN o THEN {k} END) OVER {_W}) / ({_SEC})) / (seconds + 2700) AS {k}' for k in _RATES)} FROM b), d AS (SELECT *, clinch / sig AS clinch_share, distance / sig AS distance_share FROM c),
 z AS (SELECT *, {', '.join(f'{_sqlz(k)} AS z_{k}' for k in ('takedowns', 'control', 'ground', 'submissions', 'distance', 'head', 'knockdowns', 'clinch', 'clinch_share'))} FROM d),
 x AS (SELECT *, (z_takedowns + z_control + z_ground) / 3 AS x1, z_submissions AS x2, (z_distance + z_head) / 2 AS x3, z_knockdowns AS x4, (z_clinch + z_clinch_share) / 2 AS x5 FROM z), y AS (SELECT *, {', '.join(f'{_sqlz(f"x{i}")} AS y{i}' for i in range(1, 6))} FROM x),
 v AS (SELECT *, CASE WHEN y1 >= 0.6 AND (takedowns >= 1.8 OR control / 900 >= 0.25) THEN y1 END AS v1, CASE WHEN y2 >= 0.6 AND submissions >= 0.8 THEN y2 END AS v2, CASE WHEN y3 >= 0.6 AND distance_share >= 0.65 THEN y3 END AS v3, CASE WHEN y4 >= 0.6 AND knockdowns >= 0.45 THEN y4 END AS v4, CASE WHEN y5 >= 0.6 AND clinch_share >= 0.19 THEN y5 END AS v5 FROM y),
 m AS (SELECT *, greatest(v1, v2, v3, v4, v5) AS best FROM v) SELECT o_custkey, CASE WHEN NOT e OR n < 10 THEN NULL WHEN best IS NULL THEN 'balanced' WHEN v1 = best THEN 'grappling' WHEN v2 = best THEN 'submission' WHEN v3 = best THEN 'distance' WHEN v4 = best THEN 'power' ELSE 'clinch' END AS style FROM m"""


@query("r10_difference", """WITH p AS (SELECT event_id, user_id, ts, coalesce(15 * sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w / nullif(sum(value) OVER w, 0), 0) AS buys, coalesce(15 * sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w / nullif(sum(value) OVER w, 0), 0) AS clicks, coalesce(avg(CASE WHEN value > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0.5) AS hit FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
 SELECT a.event_id AS a, b.event_id AS b, round(a.buys - b.buys, 5) AS buys_rate_diff, round(a.clicks - b.clicks, 5) AS clicks_rate_diff, round(a.hit - b.hit, 5) AS recent_hit_diff FROM p a JOIN p b ON b.event_id = a.event_id + 1""")
def r10_difference(t):
    """Each event against the next one by number: the differences of their users' recent rates, field by field."""
    is_ = lambda kind: (C("event_type") == kind).cast("int")
    d = t.events.withColumns({"buys": is_("purchase"), "clicks": is_("click"), "hit": (C("value") > 40).cast("int")})
    rated = styles.recent_rates(d, "user_id", ["ts", "event_id"], "value", ["buys", "clicks"], score="hit")
    fields = ["buys_rate", "clicks_rate", "recent_hit"]
    one = rated.select(C("event_id").alias("a"), F.struct(*fields).alias("x"))
    other = rated.select((C("event_id") - 1).alias("a"), C("event_id").alias("b"), F.struct(*fields).alias("y"))
    return styles.profile_diff(one.join(other, "a"), "x", "y", fields).select("a", "b", *(F.round(f"{f}_diff", 5).alias(f"{f}_diff") for f in fields))


@query("r11_styles", _STYLE)
def r11(t):
    totals = t.orders.groupBy("o_custkey").agg(F.count("*").alias("bouts"), *(F.sum(F.expr(v)).alias(k) for k, v in _RATES.items())).withColumn("seconds", 300.0 * C("bouts"))
    d = totals.join(t.customer, C("c_custkey") == C("o_custkey")).withColumn("ref", C("c_acctbal") > 0)
    return styles.styles(d, "c_nationkey", "bouts", "ref").select("o_custkey", "style")


@query("r13_checks", "SELECT 'no empty order' AS name, count(*) = 0 AS passed, count(*) AS n FROM orders WHERE o_totalprice < 0 UNION ALL SELECT 'all rich', count(*) = 0, count(*) FROM customer WHERE c_acctbal < 0")
def r13(t):
    one = styles.check("no empty order", t.orders, C("o_totalprice") < 0, C("o_orderkey"))
    return one.unionByName(styles.check("all rich", t.customer, C("c_acctbal") < 0, C("c_custkey"))).select("name", "passed", "n")


_ENDS = f"""{replays._CAREER.split(chr(10) + "SELECT id AS bout_id")[0]}, x AS (SELECT s.k, b.div, b.d, s.rn, s.id, s.w, s.l, s.mw, s.ml, s.rw, s.rl, s.dl, s.rwa, s.rla, s.dwa, s.dla, b.title FROM s JOIN b ON b.id = s.id WHERE s.kind = 0),
 e AS (SELECT k, div, d, rn, id, w AS p, true AS won, mw AS moved, rw AS pre, rwa - 2 * dwa AS c, title FROM x UNION ALL SELECT k, div, d, rn, id, l, false, ml, rl, rla - 2 * dla, title FROM x)"""
_TOP_WINS = """SELECT x.k, x.div, x.w AS p, count(*) AS wins FROM x LEFT JOIN (SELECT x.id, count(*) AS above FROM (SELECT x.id, x.d, x.rl - 2 * x.dl AS own, e.p, arg_max(e.c, e.rn) AS c, max(e.d) AS last FROM x JOIN e ON e.k = x.k AND e.div = x.div AND e.rn < x.rn AND e.p <> x.w AND e.p <> x.l GROUP BY ALL) x WHERE c > own AND d - last <= 547 GROUP BY x.id) a USING (id)
  WHERE coalesce(above, 0) < 2 AND EXISTS (SELECT 1 FROM e WHERE e.k = x.k AND e.p = x.l AND e.rn < x.rn) GROUP BY ALL"""


def _histories(t):
    """Career histories of the customers' leagues, and their title bouts."""
    b = replays.bouts(t)
    return replay.careers(b, "o_custkey"), b.where("is_title").select("bout_id")


@query("r13_top_wins", f"{_ENDS} SELECT k AS o_custkey, div AS division, p AS participant, wins FROM ({_TOP_WINS})")
def r13_top_wins(t):
    """Wins over one of the two best of a league's division at the time."""
    h, _ = _histories(t)
    return standings.wins_over_best(h, ["o_custkey", "division"], best=2)


@query("r13_places", f"{_ENDS} SELECT y.id AS bout_id, y.p AS participant, CAST(CASE WHEN n > 0 THEN 1 + coalesce(above, 0) END AS INT) AS place FROM (SELECT e.*, (SELECT count(*) FROM e o WHERE o.k = e.k AND o.p = e.p AND o.rn < e.rn) AS n FROM e) y LEFT JOIN (SELECT id, p, count(*) AS above FROM (SELECT e.id, e.p, e.pre, o.p AS other, CASE WHEN o.p = z.w THEN z.rw WHEN o.p = z.l THEN z.rl ELSE arg_max(o.after, o.rn) END AS r FROM e JOIN x z ON z.id = e.id JOIN (SELECT k, rn, w AS p, rwa AS after FROM s WHERE kw AND rn > 0 UNION ALL SELECT k, rn, l, rla FROM s WHERE kl AND rn > 0) o ON o.k = e.k AND o.rn < e.rn AND o.p <> e.p AND EXISTS (SELECT 1 FROM e f WHERE f.k = o.k AND f.p = o.p AND f.rn < e.rn) GROUP BY e.id, e.p, e.pre, o.p, z.w, z.l, z.rw, z.rl) WHERE r > pre GROUP BY ALL) a ON a.id = y.id AND a.p = y.p")
def r13_places(t):
    """The place by rating of each side of a decided bout, before it."""
    h = replay.careers(replays.bouts(t), "o_custkey", places=True)
    return h.where("kind = 0").select("bout_id", "participant", C("place_at").alias("place"))


@query("r13_rating_checks", f"""{_ENDS}, tw AS ({_TOP_WINS}), ti AS (SELECT k, div, p, count(*) AS titles FROM e WHERE won AND title GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY k, div ORDER BY c DESC, p) AS place FROM (SELECT k, div, p, arg_max(c, rn) AS c, count(*) AS bouts FROM e GROUP BY ALL))
 SELECT 'no reset on a change of division' AS name, count(*) = 0 AS passed, count(*) AS n FROM e WHERE moved AND pre = 1500 AND EXISTS (SELECT 1 FROM e f WHERE f.k = e.k AND f.p = e.p AND f.rn < e.rn)
 UNION ALL SELECT 'no leader with a thin record', count(*) = 0, count(*) FROM r WHERE place = 1 AND bouts <= 6 AND NOT EXISTS (SELECT 1 FROM tw WHERE tw.k = r.k AND tw.div = r.div AND tw.p = r.p)
 UNION ALL SELECT 'defending champions lead', count(*) = 0, count(*) FROM r JOIN ti USING (k, div, p) WHERE p = 1 AND titles >= 2 AND place > 1
 UNION ALL SELECT 'the first of all has won a title', count(*) = 0, count(*) FROM (SELECT * FROM (SELECT k * 10 + p AS p, c FROM r ORDER BY c DESC, k * 10 + p LIMIT 1) f WHERE NOT EXISTS (SELECT 1 FROM ti WHERE ti.k * 10 + ti.p = f.p))""")
def r13_rating_checks(t):
    """Everybody is eligible, and the first of a league's five is its champion, who should be the best where the title was defended."""
    h, titles = _histories(t)
    keys = ["o_custkey", "division"]
    h = checkpointed(h)
    decided = h.where("kind = 0")
    ranked = decided.groupBy(*keys, "participant").agg(F.max_by(C("rating") - 2 * C("rd"), F.struct("day", "bout_id")).alias("conservative"), F.count("*").alias("bouts")).withColumn("is_champion", C("participant") == 1)
    won = standings.title_wins(h, titles, keys)
    one = lambda d: d.withColumn("participant", C("o_custkey") * 10 + C("participant"))
    checks = [standings.check_carry_over(decided), standings.check_thin_leaders(ranked, standings.wins_over_best(h, keys, best=2), keys), standings.check_defending_champions(ranked, won, keys, within=1), standings.check_first_of_all(one(ranked), one(won))]
    every = checks[0]
    for c in checks[1:]:
        every = every.unionByName(c)
    return every.select("name", "passed", F.size("details").cast("long").alias("n"))


def _side(k: str):
    fields = {"age": f"CASE WHEN {k}_size > 40 THEN NULL ELSE 20 + {k}_size * 0.5 END", "reach_cm": f"150 + {k}_size", "months_since": f"CAST({k}_size AS DOUBLE)", "minutes": f"{k}_size * 3.0", "landed": f"{k}_size * 9.0", "absorbed": "100.0", "control": f"{k}_size * 20.0", "controlled": "300.0", "kd_absorbed": "1.0"}
    return F.struct(*(F.expr(v).cast("double").alias(n) for n, v in fields.items()))


@query("m05_matchup", """SELECT a, b, round(1 / (1 + exp(-(z + 0.6633505309529707 * r))), 6) AS win_a, round(1 / (1 + exp(-0.6633505309529707 * r)), 6) AS rating_only FROM (SELECT x.k AS a, y.k AS b, ln((x.s + 10) / (y.s + 10.0)) AS r,
 CASE WHEN x.s > 40 OR y.s > 40 THEN 0 ELSE -0.13034075946048312 * (x.s - y.s) * 0.5 / 5 - 0.2650612454802724 * (greatest(x.s * 0.5 - 11, 0) - greatest(y.s * 0.5 - 11, 0)) / 5 END
 + 0.19662455261900028 * ((x.s * 9.0 - 100) / (x.s * 3.0 + 30) - (y.s * 9.0 - 100) / (y.s * 3.0 + 30)) + 0.1515534399750711 * 5 * ((x.s * 20.0 + 900) / (x.s * 20.0 + 2100) - (y.s * 20.0 + 900) / (y.s * 20.0 + 2100))
 - 0.1379241803221048 * 2 * 15 * ((1 + 0.5 * 2) / (x.s * 3.0 + 30) - (1 + 0.5 * 2) / (y.s * 3.0 + 30)) - 0.20823094827955393 * (CASE WHEN x.s > 15 THEN 1 ELSE 0 END - CASE WHEN y.s > 15 THEN 1 ELSE 0 END) + 0.11174431463867403 * (x.s - y.s) / 10.0 AS z
 FROM (SELECT p_partkey AS k, p_size AS s, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nx FROM part) x JOIN (SELECT p_partkey AS k, p_size AS s FROM part) y ON x.nx = y.k)""")
def m05(t):
    w = W.partitionBy("p_brand").orderBy("p_partkey")
    d = t.part.select(C("p_partkey").alias("a"), F.lead("p_partkey").over(w).alias("b"), C("p_size").alias("a_size"), F.lead("p_size").over(w).alias("b_size")).where("b IS NOT NULL")
    d = d.withColumns({"x": _side("a"), "y": _side("b")})
    win = (C("a_size") + 10) / (C("a_size") + C("b_size") + 20)
    p = models.predict_matchup(models.matchup_terms(win, C("x"), C("y"), 0.5))
    return d.select("a", "b", p.alias("p")).select("a", "b", F.round("p.win_a", 6).alias("win_a"), F.round("p.rating_only", 6).alias("rating_only"))
