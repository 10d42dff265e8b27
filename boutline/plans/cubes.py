"""Cubes, ratios, histograms, factors and leaderboards on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boutline.functions import bouts, dates
from boutline.operators import cube as Q
from boutline.operators import factors, ordered
from boutline.operators import relational as R
from boutline.plans import replays
from boutline.plans.registry import query
from boutline.plans.relational import _SIDES, corners

C = F.col
r4 = lambda c: F.round(c, 4)


def measures() -> dict:
    by = lambda s: F.count_if(C("o_orderstatus") == s)
    return {"fights": F.count("*"), "ko": by("F"), "sub": by("P"), "dec": by("O"), "spend": F.sum("o_totalprice")}


_CUBE = """SELECT year(o_orderdate) AS year, coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END, 'Autres') AS division, strftime(o_orderdate, '%m-%d') >= '10-05' AS after_cutoff,
 count(*) AS fights, count(*) FILTER (WHERE o_orderstatus = 'F') AS ko, count(*) FILTER (WHERE o_orderstatus = 'P') AS sub, count(*) FILTER (WHERE o_orderstatus = 'O') AS dec, sum(o_totalprice) AS spend FROM orders GROUP BY ALL"""


def order_cube(t):
    return Q.build_cube(t.orders, "o_orderdate", F.when(C("o_orderpriority") != "5-LOW", C("o_orderpriority")), "10-05", measures())


@query("a09_cube", f"SELECT * REPLACE (round(spend, 2) AS spend) FROM ({_CUBE})")
def a09(t):
    return order_cube(t).withColumn("spend", F.round("spend", 2))


@query("a10_results_cube", "SELECT year(o_orderdate) AS year, o_orderpriority AS division, strftime(o_orderdate, '%m-%d') >= '06-15' AS after_cutoff, count(*) AS fights, count(*) FILTER (WHERE o_orderstatus = 'F') AS ko FROM orders GROUP BY ALL")
def a10(t):
    return Q.build_cube(t.orders, "o_orderdate", C("o_orderpriority"), "06-15", {k: measures()[k] for k in ("fights", "ko")})


@query("a11_slices", f"SELECT year, CAST(sum(fights) AS BIGINT) AS fights, CAST(sum(ko) AS BIGINT) AS ko FROM ({_CUBE}) WHERE division LIKE '%H%' AND after_cutoff GROUP BY year")
def a11(t):
    return Q.slice_cube(order_cube(t), ["fights", "ko"], C("division").contains("H") & C("after_cutoff"), ["year"])


@query("a12_ratios", f"SELECT year, round(sum(ko + sub) / nullif(sum(fights), 0), 4) AS finish_rate, round(sum(dec) / nullif(sum(fights), 0), 4) AS decision_rate, round(CASE WHEN sum(sub) > 100000 THEN sum(ko) / sum(sub) END, 4) AS never FROM ({_CUBE}) GROUP BY year")
def a12(t):
    d = Q.slice_cube(order_cube(t), ["fights", "ko", "sub", "dec"], None, ["year"])
    return d.select("year", r4(Q.metric("finish_rate")).alias("finish_rate"), r4(Q.metric("decision_rate")).alias("decision_rate"), r4(Q.ratio(C("ko"), F.when(C("sub") > 100000, C("sub")))).alias("never"))


@query("a13_histogram", "SELECT CAST(l AS INT) AS l_linenumber, count(l_linenumber) AS n, round(count(l_linenumber) / sum(count(l_linenumber)) OVER (), 4) AS share FROM generate_series(1, 9) s(l) LEFT JOIN lineitem ON l_linenumber = l GROUP BY l")
def a13(t):
    return Q.spine_histogram(t.lineitem, "l_linenumber", 1, 9).withColumn("share", r4("share"))


BUCKETS = [("0-5", 0.0, 5.0), ("5-15", 5.0, 15.0), ("15-30", 15.0, 30.0), ("30+", 30.0, 1e9), ("never", 1e9, 1e10)]
_BOUTS = f"SELECT w.l_orderkey, w.l_quantity - l.l_quantity AS edge, w.l_partkey < l.l_partkey AS a_first FROM ({_SIDES}) w JOIN ({_SIDES}) l ON w.l_orderkey = l.l_orderkey WHERE w.n = 2 AND w.rn = 1 AND l.rn = 2"
_SPINE = "(VALUES ('0-5', 0, 5), ('5-15', 5, 15), ('15-30', 15, 30), ('30+', 30, 1000000000), ('never', 1000000000, 10000000000)) b(bucket, low, high)"


def bout_edges(t):
    """The dearer line won; edge: how many more units it had, oriented from a to b by part number."""
    pairs, _ = R.winner_loser(corners(t), "l_orderkey", "result")
    gap = C("winner.l_quantity") - C("loser.l_quantity")
    first = C("winner.l_partkey") < C("loser.l_partkey")
    return pairs.select("l_orderkey", F.when(first, gap).otherwise(-gap).alias("edge"), first.alias("a_won"))


@query("a14_advantage", f"SELECT bucket, count(edge) AS n, count(*) FILTER (WHERE edge > 0) AS wins, round(count(*) FILTER (WHERE edge > 0) / nullif(count(edge), 0), 4) AS rate FROM {_SPINE} LEFT JOIN ({_BOUTS}) ON edge <> 0 AND abs(edge) > low AND abs(edge) <= high GROUP BY bucket")
def a14(t):
    return Q.bucketed_advantage(bout_edges(t), C("edge"), C("a_won"), BUCKETS).select("bucket", "n", "wins", r4("rate").alias("rate"))


@query("a15_factors", f"""SELECT 'a_side' AS factor, CASE WHEN edge > 10 THEN 'more' WHEN edge < -10 THEN 'less' ELSE 'even' END AS bucket, count(*) AS n, count(*) FILTER (WHERE a_first) AS wins FROM (SELECT CASE WHEN a_first THEN edge ELSE -edge END AS edge, a_first FROM ({_BOUTS})) GROUP BY ALL
UNION ALL SELECT 'parity', CASE WHEN l_orderkey % 2 = 0 THEN 'more' ELSE 'less' END, count(*), count(*) FILTER (WHERE a_first) FROM ({_BOUTS}) GROUP BY ALL""")
def a15(t):
    e = bout_edges(t)
    side = e.select(F.lit("a_side").alias("factor"), F.when(C("edge") > 10, "more").when(C("edge") < -10, "less").otherwise("even").alias("bucket"), "a_won")
    parity = e.select(F.lit("parity").alias("factor"), F.when(C("l_orderkey") % 2 == 0, "more").otherwise("less").alias("bucket"), "a_won")
    return side.unionByName(parity).groupBy("factor", "bucket").agg(F.count("*").alias("n"), F.count_if("a_won").alias("wins"))


_BODY = "CASE WHEN {p} % 11 = 0 THEN NULL ELSE round(date_diff('day', DATE '1960-01-01' + CAST({p} * 37 % 9000 AS INT), o.d) / 365.25, 2) END AS {s}_age, CASE WHEN {p} % 7 = 0 THEN NULL ELSE 150 + {p} % 50 END AS {s}_cm"
_FACTORS_SQL = f"""WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_custkey * 10 + CAST(left(o_orderpriority, 1) AS INT) AS w, o_custkey * 10 + CAST((CAST(left(o_orderpriority, 1) AS INT) + day(o_orderdate) % 4) % 5 + 1 AS INT) AS l, month(o_orderdate) = 6 AS none, day(o_orderdate) % 2 = 0 AS draw FROM orders),
 h AS (SELECT id, d, w AS p, CASE WHEN NOT none THEN 'win' WHEN draw THEN 'draw' ELSE 'nc' END AS r FROM o WHERE w % 13 <> 0 UNION ALL SELECT id, d, l, CASE WHEN NOT none THEN 'loss' WHEN draw THEN 'draw' ELSE 'nc' END FROM o WHERE l % 13 <> 0),
 s AS (SELECT id, d, true AS won, w AS p FROM o WHERE NOT none UNION ALL SELECT id, d, false, l FROM o WHERE NOT none),
 q AS (SELECT s.id, s.won, s.p, s.d, count(h.id) AS n, max(h.d) AS last, list(h.r ORDER BY h.d DESC, h.id DESC) FILTER (WHERE h.id IS NOT NULL)[1:12] AS rs, s.p % 13 <> 0 AS known FROM s LEFT JOIN h ON h.p = s.p AND h.d < s.d GROUP BY s.id, s.won, s.p, s.d),
 k AS (SELECT *, list_filter(coalesce(rs, []), lambda x: x <> 'nc') AS xs FROM q),
 t AS (SELECT id, won, p, d, CASE WHEN known THEN n END AS fights, CASE WHEN known THEN date_diff('day', last, d) END AS days, CASE WHEN NOT known THEN NULL WHEN len(xs) = 0 OR xs[1] = 'draw' THEN 0 ELSE CASE xs[1] WHEN 'win' THEN 1 ELSE -1 END * (coalesce(list_min(list_filter(range(1, len(xs) + 1), lambda i: xs[i] <> xs[1])), len(xs) + 1) - 1) END AS streak FROM k),
 b AS (SELECT o.id, {_BODY.format(p="o.w", s="w")}, {_BODY.format(p="o.l", s="l")}, x.fights AS w_n, y.fights AS l_n FROM o JOIN t x ON x.id = o.id AND x.won JOIN t y ON y.id = o.id AND NOT y.won WHERE NOT none),
 v AS (SELECT 'age' AS factor, abs(w_age - l_age) AS v, w_age < l_age AS won FROM b WHERE w_age <> l_age UNION ALL SELECT 'height', abs(w_cm - l_cm), w_cm > l_cm FROM b WHERE w_cm <> l_cm UNION ALL SELECT 'experience', abs(w_n - l_n), w_n > l_n FROM b WHERE w_n <> l_n
  UNION ALL SELECT 'streak', streak, won FROM t WHERE streak <> 0 UNION ALL SELECT 'layoff', days / 30.44, won FROM t WHERE days IS NOT NULL),
 e(factor, bucket, place, low, high) AS (VALUES {", ".join(f"('{n}', '{label}', {k}, {'-1e300' if low == -factors.LONG else low}::DOUBLE, {'1e300' if high == factors.LONG else high}::DOUBLE)" for n, spans in (("age", factors.AGE), ("height", factors.CENTIMETRES), ("experience", factors.EXPERIENCE), ("streak", factors.STREAK), ("layoff", factors.LAYOFF)) for k, (label, low, high) in enumerate(spans))})
 SELECT e.factor, e.bucket, e.place, count(*) FILTER (WHERE won) AS wins, count(v.v) AS total FROM e LEFT JOIN v ON v.factor = e.factor AND v.v > low AND v.v <= high GROUP BY ALL"""


@query("a15_win_factors", _FACTORS_SQL)
def a15_win_factors(t):
    """Age, height, experience, streak and layoff of the leagues' bouts; some people have no history, some no age or height."""
    b = replays.bouts(t).withColumns({s: (C("o_custkey") * 10 + C(s)).cast("long") for s in ("winner", "loser")})
    result = lambda won: F.when(C("kind") == 0, "win" if won else "loss").when(C("is_draw"), "draw").otherwise("nc")
    side = lambda s, won: F.struct(C(s).alias("person"), F.lit(won).alias("won"), result(won).alias("result"))
    sides = b.select("bout_id", "day", "kind", F.explode(F.array(side("winner", True), side("loser", False))).alias("s")).select("bout_id", "day", "kind", "s.*")
    history = sides.where(C("person") % 13 != 0).select("person", "day", C("bout_id").alias("tie"), "result")
    asked = factors.prior_records(sides.where("kind = 0").select("person", "day", "bout_id", "won"), history)
    p, born = C("person"), F.date_add(F.lit("1960-01-01").cast("date"), (C("person") * 37 % 9000).cast("int"))
    value = F.struct(F.when(p % 11 != 0, dates.age_years(born, C("day"))).alias("age"), F.when(p % 7 != 0, 150 + p % 50).alias("height_cm"), "prior")
    pairs = asked.withColumn("v", value).groupBy("bout_id").agg(F.max_by("v", F.when(C("won"), 1)).alias("winner"), F.max_by("v", F.when(~C("won"), 1)).alias("loser"))
    return factors.win_factors(pairs)


@query("a16_reach_factor", f"SELECT bucket, count(edge) AS n, count(*) FILTER (WHERE edge > 0) AS wins FROM {_SPINE} LEFT JOIN (SELECT w.l_suppkey - l.l_suppkey AS edge FROM ({_SIDES}) w JOIN ({_SIDES}) l ON w.l_orderkey = l.l_orderkey WHERE w.n = 2 AND w.rn = 1 AND l.rn = 2) ON edge <> 0 AND abs(edge) > low AND abs(edge) <= high GROUP BY bucket")
def a16(t):
    pairs, _ = R.winner_loser(corners(t), "l_orderkey", "result")
    d = pairs.select((C("winner.l_suppkey") - C("loser.l_suppkey")).alias("edge"))
    return Q.bucketed_advantage(d, C("edge"), F.lit(True), BUCKETS).select("bucket", "n", "wins")


@query("a17_min_sample_rates", "SELECT c_nationkey, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 4) AS rate FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1 HAVING count(*) >= 300 ORDER BY rate DESC, c_nationkey")
def a17(t):
    d = t.orders.where(C("o_orderdate") >= F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))).join(t.customer, C("c_custkey") == C("o_custkey"))
    g = d.groupBy("c_nationkey").agg(F.count("*").alias("n"), r4(F.avg(F.when(C("o_orderstatus") == "F", 1.0).otherwise(0.0))).alias("rate"))
    return g.where("n >= 300").orderBy(C("rate").desc(), "c_nationkey")


@query("a18_own_and_all", "SELECT coalesce(c_mktsegment, 'all') AS org, n FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), ())) WHERE c_mktsegment IS NULL OR n >= 290")
def a18(t):
    d = t.customer.groupingSets([["c_mktsegment"], []], "c_mktsegment").agg(F.count("*").alias("n"), F.grouping("c_mktsegment").alias("g"))
    return d.where("g = 1 OR n >= 290").select(F.when(C("g") == 1, "all").otherwise(C("c_mktsegment")).alias("org"), "n")


@query("a19_career_rates", "SELECT l_partkey, round(sum(l_quantity) FILTER (WHERE l_tax > 0.02) / nullif(sum(l_linenumber) FILTER (WHERE l_tax > 0.02), 0), 4) AS per_line, round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 4) AS returned FROM lineitem GROUP BY 1")
def a19(t):
    timed = C("l_tax") > 0.02
    d = t.lineitem.groupBy("l_partkey").agg(F.sum(F.when(timed, C("l_quantity"))).alias("q"), F.sum(F.when(timed, C("l_linenumber"))).alias("m"), F.count_if(C("l_returnflag") == "R").alias("r"), F.count("*").alias("n"))
    return d.select("l_partkey", r4(Q.ratio(C("q"), C("m"))).alias("per_line"), r4(C("r") / C("n")).alias("returned"))


@query("a20_record", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS w, count(*) FILTER (WHERE o_orderstatus = 'O') AS l, count(*) FILTER (WHERE o_orderstatus = 'P') AS d, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%') AS w_ko, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority NOT LIKE '1%') AS w_other FROM orders GROUP BY 1")
def a20(t):
    n = F.count_if
    s, ko = C("o_orderstatus"), C("o_orderpriority").startswith("1")
    return t.orders.groupBy("o_custkey").agg(n(s == "F").alias("w"), n(s == "O").alias("l"), n(s == "P").alias("d"), n((s == "F") & ko).alias("w_ko"), n((s == "F") & ~ko).alias("w_other"))


@query("a21_with_opponent", f"WITH s AS (SELECT * FROM ({_SIDES}) WHERE n = 2) SELECT a.l_partkey, count(*) AS n, round(sum(a.l_quantity), 2) AS own, round(sum(b.l_quantity), 2) AS opponent FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.rn <> b.rn GROUP BY 1")
def a21(t):
    d = corners(t)
    o = d.select("l_orderkey", C("result").alias("_r"), C("l_quantity").alias("oq"))
    return d.join(o, "l_orderkey").where("result <> _r").groupBy("l_partkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("own"), F.round(F.sum("oq"), 2).alias("opponent"))


@query("a22_weighted_merge", "SELECT o_custkey, CAST(round(sum(CASE WHEN o_orderkey % 3 = 0 THEN 0.35 ELSE 1 END), 4) AS DOUBLE) AS n FROM orders GROUP BY 1")
def a22(t):
    return t.orders.groupBy("o_custkey").agg(r4(F.sum(F.when(C("o_orderkey") % 3 == 0, 0.35).otherwise(1.0))).alias("n"))


@query("a23_leaderboard", "SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 10 + CASE WHEN value > 50 THEN 5 ELSE 0 END + CASE WHEN value > 50 AND event_id % 5 = 0 THEN 5 ELSE 0 END ELSE 0 END) AS BIGINT) AS score FROM events GROUP BY 1 ORDER BY score DESC, user_id")
def a23(t):
    big, fifth = C("value") > 50, C("event_id") % 5 == 0
    score = bouts.score_pick(C("event_type"), F.when(big, "x").otherwise("y"), F.when(fifth, 1).otherwise(2), F.lit("purchase"), F.lit("x"), F.lit(1))
    return t.events.groupBy("user_id").agg(F.sum(score).alias("score")).orderBy(C("score").desc(), "user_id")


@query("a24_decayed", "SELECT user_id, round(sum(value * pow(0.9, rn - 1)), 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) GROUP BY 1")
def a24(t):
    return R.decayed_sum(t.events, "user_id", [C("ts").desc(), C("event_id").desc()], ["value"], 0.9).withColumn("value", r4("value"))


@query("a25_zscore", "SELECT p_partkey, round(CASE WHEN sd < 1e-9 THEN 0 ELSE (p_retailprice - m) / sd END, 4) AS z FROM (SELECT *, avg(p_retailprice) OVER w AS m, stddev_pop(p_retailprice) OVER w AS sd FROM part WINDOW w AS (PARTITION BY p_brand))")
def a25(t):
    w = W.partitionBy("p_brand")
    m, sd = F.avg("p_retailprice").over(w), F.stddev_pop("p_retailprice").over(w)
    return t.part.select("p_partkey", r4(F.when(sd < 1e-9, 0.0).otherwise((C("p_retailprice") - m) / sd)).alias("z"))


@query("a26_percentile", "SELECT (SELECT c_acctbal FROM customer ORDER BY 1 LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.9) AS BIGINT) FROM customer)) AS c_acctbal")
def a26(t):
    found = ordered.nearest_percentiles(t.customer, "c_acctbal", [0.9])
    return t.spark.createDataFrame([(v,) for v in found.values()], t.customer.select("c_acctbal").schema)


@query("a26_several", "WITH n AS (SELECT count(*) AS n FROM lineitem), r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS at FROM lineitem) SELECT p AS share, v AS value FROM r, n, (VALUES (0.0::DOUBLE), (0.1), (0.5), (0.9), (0.99), (1.0)) s(p) WHERE r.at = least(n - 1, CAST(floor(p * n) AS BIGINT))")
def a26_several(t):
    """Six percentiles of all line prices in the same passes."""
    found = ordered.nearest_percentiles(t.lineitem, "l_extendedprice", [0.0, 0.1, 0.5, 0.9, 0.99, 1.0], small=1000)
    return t.spark.createDataFrame([(p, float(v)) for p, v in found.items()], "share double, value double")


@query("a27_record_text", "SELECT o_custkey, CASE WHEN count(*) >= 12 THEN count(*) FILTER (WHERE o_orderstatus = 'F') || '-' || count(*) FILTER (WHERE o_orderstatus = 'O') || '-' || count(*) FILTER (WHERE o_orderstatus = 'P') ELSE '10-1-1' END AS record FROM orders GROUP BY 1")
def a27(t):
    n = lambda status: F.count_if(C("o_orderstatus") == status)
    d = t.orders.groupBy("o_custkey").agg(n("F").alias("w"), n("O").alias("l"), n("P").alias("d"))
    return d.select("o_custkey", bouts.scraped_or_counts(F.lit("10-1-1"), C("w"), C("l"), C("d")).alias("record"))


@query("a28_then_vs_now", f"SELECT division, CAST(sum(fights) FILTER (WHERE year <= 1997) AS BIGINT) AS before, CAST(sum(fights) FILTER (WHERE year >= 1999) AS BIGINT) AS now FROM ({_CUBE}) GROUP BY 1 HAVING sum(fights) FILTER (WHERE year <= 1997) >= 30 AND sum(fights) FILTER (WHERE year >= 1999) >= 100")
def a28(t):
    d = order_cube(t).groupBy("division").agg(F.sum(F.when(C("year") <= 1997, C("fights"))).alias("before"), F.sum(F.when(C("year") >= 1999, C("fights"))).alias("now"))
    return d.where("before >= 30 AND now >= 100")


@query("a29_explorer", f"SELECT CAST(y AS INT) AS year, CASE WHEN sum(fights) >= 12 THEN round(sum(ko) / sum(fights), 4) END AS rate FROM generate_series(1994, 2002) s(y) LEFT JOIN ({_CUBE}) ON year = y AND after_cutoff AND division = '1-URGENT' GROUP BY y")
def a29(t):
    years = t.spark.range(1994, 2003).select(C("id").cast("int").alias("year"))
    cells = Q.slice_cube(order_cube(t), ["fights", "ko"], C("after_cutoff") & (C("division") == "1-URGENT"), ["year"])
    return years.join(cells, "year", "left").select("year", F.when(C("fights") >= 12, r4(C("ko") / C("fights"))).alias("rate"))


_GROUPS = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Women''s Flyweight' WHEN '2-HIGH' THEN 'Women''s Bantamweight' WHEN '3-MEDIUM' THEN 'Autres' ELSE o_orderpriority END"


def _points_sql(chart: str, view: str, first: int, last: int, group: str, rolling: bool, least: int) -> str:
    inside = {"all": "true", "men": "div NOT LIKE 'Women%' AND div <> 'Autres'", "women": "div LIKE 'Women%'"}.get(group, f"div = '{group}'")
    start = f"AND (y <> {first} OR after)" if rolling else ""
    value = f"count(o.id) FILTER (WHERE {inside} {start}) AS fights, count(o.id) FILTER (WHERE ({inside}) {start} AND status IN ('F', 'P')) AS finished"
    one = f"SELECT CAST({'y' if view == 'year' else 'div'} AS VARCHAR) AS label, {value} FROM o WHERE {f'y BETWEEN {first} AND {last}' if view == 'year' else inside} GROUP BY 1"
    if view != "year":
        one = f"SELECT CAST(div AS VARCHAR) AS label, count(o.id) FILTER (WHERE y BETWEEN {first} AND {last} {start}) AS fights, count(o.id) FILTER (WHERE y BETWEEN {first} AND {last} {start} AND status IN ('F', 'P')) AS finished FROM o WHERE {inside} GROUP BY 1"
    trimmed = f"SELECT * FROM ({one}) WHERE label >= (SELECT min(label) FROM ({one}) WHERE fights > 0)" if view == "year" else one
    return f"SELECT '{chart}' AS chart, label, CASE WHEN fights >= {least} THEN round(finished / fights, 6) END AS value, fights FROM ({trimmed})"


CHARTS = {"years of all": ("year", 1992, 2001, "all", False, 1), "women by year": ("year", 1994, 2000, "women", True, 40), "men by year": ("year", 1996, 2001, "men", False, 60), "one division": ("year", 1995, 1999, "5-LOW", True, 30), "men's divisions": ("division", 1996, 2000, "men", True, 100), "divisions": ("division", 1993, 1997, "all", False, 10), "nobody": ("year", 1995, 1999, "none", False, 1)}


@query("a29_points", f"WITH o AS (SELECT o_orderkey AS id, year(o_orderdate) AS y, strftime(o_orderdate, '%m-%d') >= '06-15' AS after, o_orderstatus AS status, {_GROUPS} AS div FROM orders) " + " UNION ALL ".join(_points_sql(n.replace("'", "''"), *c) for n, c in CHARTS.items()))
def a29_points(t):
    """The points of seven charts, by year and by division, of groups and single divisions, rolling and whole."""
    cube = Q.build_cube(t.orders, "o_orderdate", F.expr(_GROUPS.replace("''s", "\\'s")), "06-15", measures())
    charts = [Q.explorer_points(cube, "finish_rate", view, first, last, group, rolling, least).select(F.lit(n).alias("chart"), "label", F.round("value", 6).alias("value"), "fights") for n, (view, first, last, group, rolling, least) in CHARTS.items()]
    every = charts[0]
    for c in charts[1:]:
        every = every.unionByName(c)
    return every


@query("a30_strongest_bucket", f"SELECT arg_max(bucket, (abs(rate - 0.5), bucket)) AS bucket FROM (SELECT bucket, count(edge) AS n, count(*) FILTER (WHERE edge > 0) / nullif(count(edge), 0) AS rate FROM {_SPINE} LEFT JOIN ({_BOUTS}) ON edge <> 0 AND abs(edge) > low AND abs(edge) <= high GROUP BY bucket) WHERE n >= 100")
def a30(t):
    d = Q.bucketed_advantage(bout_edges(t), C("edge"), C("a_won"), BUCKETS).where("n >= 100")
    return d.agg(F.max_by("bucket", F.struct(F.abs(C("rate") - 0.5), "bucket")).alias("bucket"))


@query("a31_rankings", "SELECT p_brand, min(p_partkey) AS first_seen, arg_min(p_partkey, (p_size, p_partkey)) AS champion, array_to_string(list(p_partkey ORDER BY p_size, p_partkey)[1:5], ',') AS contenders FROM part GROUP BY 1")
def a31(t):
    ranked = R.top_per_key(t.part, ["p_brand"], [C("p_size"), C("p_partkey")], 5)
    first = t.part.groupBy("p_brand").agg(F.min("p_partkey").alias("first_seen"))
    lists = ranked.groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "p_partkey"))), lambda x: x["p_partkey"].cast("string")), ",").alias("contenders"), F.min_by("p_partkey", "rn").alias("champion"))
    return lists.join(first, "p_brand").select("p_brand", "first_seen", "champion", "contenders")
