"""The ordered replays on the driver's tables: each customer's orders are the bouts of a league of five, the order priorities.

The SQL twins step all customers at once, one bout further in each round of a recursive query."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutline.operators import rating, replay, waves
from boutline.operators.durable import checkpointed
from boutline.plans.registry import query

C = F.col

_BOUTS = """b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, kind, id) AS rn FROM (SELECT o_custkey AS k, o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS div, CAST(left(o_orderpriority, 1) AS INT) AS w,
 CAST((CAST(left(o_orderpriority, 1) AS INT) + day(o_orderdate) % 4) % 5 + 1 AS INT) AS l, (CAST(floor(o_totalprice) AS BIGINT) % 100) / 100.0::DOUBLE AS dom, CASE WHEN month(o_orderdate) = 6 THEN 1 ELSE 0 END AS kind, day(o_orderdate) % 2 = 0 AS draw,
 o_orderstatus = 'P' AS title FROM orders){where})"""


def bouts(t):
    day, w = F.dayofmonth("o_orderdate"), F.substring("o_orderpriority", 1, 1).cast("int")
    return t.orders.select(
        "o_custkey", C("o_orderkey").alias("bout_id"), F.to_date("o_orderdate").alias("day"), C("o_orderstatus").alias("division"), w.alias("winner"), ((w + day % 4) % 5 + 1).alias("loser"),
        ((F.floor("o_totalprice") % 100) / 100.0).alias("dominance"), F.when(F.month("o_orderdate") == 6, 1).otherwise(0).alias("kind"), (day % 2 == 0).alias("is_draw"),
        (C("o_orderstatus") == "P").alias("is_title"), F.lit(False).alias("is_five"), F.lit(None).cast("double").alias("start_winner"), F.lit(None).cast("double").alias("start_loser"),
    )


def _put(lst: str, won: str, lost: str) -> str:
    return f"list_transform({lst}, lambda x, i: CASE i WHEN w THEN {won} WHEN l THEN {lost} ELSE x END) AS {lst}"


_ELO = f"""WITH RECURSIVE {_BOUTS.format(where=" WHERE kind = 0")}, s AS (
 SELECT k, CAST(0 AS BIGINT) AS rn, [1500::DOUBLE, 1500, 1500, 1500, 1500] AS r, [0, 0, 0, 0, 0] AS n, CAST(NULL AS BIGINT) AS id, 0 AS w, 0 AS l, 0::DOUBLE AS wb, 0::DOUBLE AS lb, 0::DOUBLE AS wa, 0::DOUBLE AS la FROM (SELECT DISTINCT k FROM b)
 UNION ALL SELECT k, rn, {_put("r", "wa", "la")}, list_transform(n, lambda x, i: CASE WHEN i IN (w, l) THEN x + 1 ELSE x END) AS n, id, w, l, wb, lb, wa, la FROM (
  SELECT *, wb + 96 * greatest(1, 3 - n[w] / 5.0) * u AS wa, lb - 96 * greatest(1, 3 - n[l] / 5.0) * u AS la FROM (
   SELECT s.k, b.rn, s.r, s.n, b.id, b.w, b.l, s.r[b.w] AS wb, s.r[b.l] AS lb, 1 - 1 / (1 + pow(10, (s.r[b.l] - s.r[b.w]) / 400)) AS u FROM s JOIN b ON b.k = s.k AND b.rn = s.rn + 1)))"""


@query("r06_elo", f"{_ELO} SELECT id AS bout_id, w AS participant, true AS won, round(wb, 4) AS before, round(wa, 4) AS after FROM s WHERE rn > 0 UNION ALL SELECT id, l, false, round(lb, 4), round(la, 4) FROM s WHERE rn > 0")
def r06(t):
    h = replay.elo(bouts(t).where("kind = 0"), "o_custkey")
    return h.select("bout_id", "participant", "won", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"))


_LAST = "SELECT DISTINCT ON (k, p) k, p, d, v FROM (SELECT s.k, s.w AS p, b.d, b.id, s.wa AS v FROM s JOIN b USING (id) UNION ALL SELECT s.k, s.l, b.d, b.id, s.la FROM s JOIN b USING (id)) {where} ORDER BY k, p, d DESC, id DESC"


@query("r06_elo_final", f"{_ELO} SELECT k AS o_custkey, p AS participant, d AS day, round(v, 4) AS rating FROM ({_LAST.format(where='')})")
def r06_final(t):
    h = replay.elo(bouts(t).where("kind = 0"), "o_custkey")
    return replay.final_states(h, "o_custkey", ["after"]).select("o_custkey", "participant", "day", F.round("after", 4).alias("rating"))


@query("r07_debut_start", f"{_ELO} SELECT c_custkey, round(coalesce(1500 + 1.2 * (v - 1500), 1500), 4) AS start FROM customer LEFT JOIN ({_LAST.format(where='WHERE d < DATE ' + chr(39) + '1998-01-01' + chr(39))}) ON k = c_custkey AND p = c_custkey % 5 + 1")
def r07(t):
    h = replay.elo(bouts(t).where("kind = 0"), "o_custkey").withColumn("participant", F.concat_ws("/", "o_custkey", "participant"))
    debuts = t.customer.select("c_custkey", F.concat_ws("/", "c_custkey", C("c_custkey") % 5 + 1).alias("participant"), F.lit("1998-01-01").cast("date").alias("debut"))
    found = replay.elo_before(h, debuts.drop("c_custkey"))
    return debuts.join(found, ["participant", "debut"], "left").select("c_custkey", F.round(F.coalesce("start", F.lit(1500.0)), 4).alias("start"))


_GROW = "CASE WHEN la[{e}] IS NULL THEN rd[{e}] ELSE least(300, sqrt(rd[{e}] * rd[{e}] + 400 * greatest(0, d - la[{e}]) / 30.44)) END"
_MOVE = "CASE WHEN {m} THEN least(300, sqrt({g} * {g} + 2500)) ELSE {g} END"
_G = "1 / sqrt(1 + 3 * pow(ln(10) / 400 * {o}, 2) / pow(pi(), 2))"
_E = "1 / (1 + pow(10, -{g} * ({a} - {b}) / 400))"
_VAR = "1 / (1 / ({rd} * {rd}) + pow(ln(10) / 400 * {g}, 2) * {e} * (1 - {e}))"
_CAREER = f"""WITH RECURSIVE {_BOUTS.format(where="")}, s AS (
 SELECT k, CAST(0 AS BIGINT) AS rn, [1500::DOUBLE, 1500, 1500, 1500, 1500] AS r, [300::DOUBLE, 300, 300, 300, 300] AS rd, CAST([NULL, NULL, NULL, NULL, NULL] AS DATE[]) AS la, CAST([NULL, NULL, NULL, NULL, NULL] AS VARCHAR[]) AS dv,
  CAST(NULL AS BIGINT) AS id, 0 AS kind, 0 AS w, 0 AS l, false AS kw, false AS kl, false AS mw, false AS ml, 0::DOUBLE AS rw, 0::DOUBLE AS rl, 0::DOUBLE AS dw, 0::DOUBLE AS dl, 0::DOUBLE AS rwa, 0::DOUBLE AS rla, 0::DOUBLE AS dwa, 0::DOUBLE AS dla FROM (SELECT DISTINCT k FROM b)
 UNION ALL SELECT k, rn, {_put("r", "rwa", "rla")}, {_put("rd", "CASE WHEN kw THEN dwa ELSE x END", "CASE WHEN kl THEN dla ELSE x END")}, {_put("la", "CASE WHEN kw THEN d ELSE x END", "CASE WHEN kl THEN d ELSE x END")},
  {_put("dv", "CASE WHEN kw THEN div ELSE x END", "CASE WHEN kl THEN div ELSE x END")}, id, kind, w, l, kw, kl, mw, ml, rw, rl, dw, dl, rwa, rla, dwa, dla FROM (
 SELECT *, CASE WHEN kind = 1 THEN rw ELSE rw + ln(10) / 400 * vw * gw * (sc - ew) END AS rwa, CASE WHEN kind = 1 THEN rl ELSE rl + ln(10) / 400 * vl * gl * (1 - sc - el) END AS rla,
  CASE WHEN kind = 1 THEN dw ELSE greatest(30, sqrt(vw)) END AS dwa, CASE WHEN kind = 1 THEN dl ELSE greatest(30, sqrt(vl)) END AS dla FROM (
 SELECT *, {_VAR.format(rd="dw", g="gw", e="ew")} AS vw, {_VAR.format(rd="dl", g="gl", e="el")} AS vl FROM (
 SELECT *, {_E.format(g="gw", a="rw", b="rl")} AS ew, {_E.format(g="gl", a="rl", b="rw")} AS el FROM (
 SELECT *, {_G.format(o="dl")} AS gw, {_G.format(o="dw")} AS gl, 0.8 + 0.2 * dom AS sc FROM (
 SELECT *, {_MOVE.format(m="mw", g="hw")} AS dw, {_MOVE.format(m="ml", g="hl")} AS dl FROM (
 SELECT *, r[w] AS rw, r[l] AS rl, {_GROW.format(e="w")} AS hw, {_GROW.format(e="l")} AS hl, coalesce(dv[w] <> div, false) AS mw, coalesce(dv[l] <> div, false) AS ml, kind = 0 OR dv[w] IS NOT NULL AS kw, kind = 0 OR dv[l] IS NOT NULL AS kl FROM (
 SELECT s.k, b.rn, s.r, s.rd, s.la, s.dv, b.id, b.kind, b.w, b.l, b.d, b.div, b.dom FROM s JOIN b ON b.k = s.k AND b.rn = s.rn + 1))))))))
SELECT id AS bout_id, w AS participant, kind, mw AS moved, round(rw, 4) AS rating_at, round(dw, 4) AS rd_at, round(rwa, 4) AS rating, round(dwa, 4) AS rd FROM s WHERE rn > 0 AND kw
UNION ALL SELECT id, l, kind, ml, round(rl, 4), round(dl, 4), round(rla, 4), round(dla, 4) FROM s WHERE rn > 0 AND kl"""


@query("r05_career", _CAREER)
def r05(t):
    h = replay.careers(bouts(t), "o_custkey")
    return h.select("bout_id", "participant", "kind", "moved", *(F.round(c, 4).alias(c) for c in ("rating_at", "rd_at", "rating", "rd")))


@query("r05_pool", f"SELECT bout_id, o_custkey * 10 + participant AS participant, kind, moved, rating_at, rd_at, rating, rd FROM ({_CAREER}) JOIN orders ON o_orderkey = bout_id")
def r05_pool(t):
    """All bouts in one pool, keyed as a single chronological replay: one task, whose state is a participant's. Participants of different customers never meet."""
    b = bouts(t).withColumns({side: (C("o_custkey") * 10 + C(side)).cast("long") for side in ("winner", "loser")}).withColumn("pool", F.lit(0).cast("long"))
    h = replay.careers(b, "pool", "long")
    return h.select("bout_id", "participant", "kind", "moved", *(F.round(c, 4).alias(c) for c in ("rating_at", "rd_at", "rating", "rd")))


@query("r05_waves", f"SELECT bout_id, o_custkey * 10 + participant AS participant, kind, moved, rating_at, rd_at, rating, rd FROM ({_CAREER}) JOIN orders ON o_orderkey = bout_id")
def r05_waves(t):
    """The same pool in waves: each applies all bouts whose participants' earlier ones are done, until few are left, which are folded."""
    b = bouts(t).withColumns({side: (C("o_custkey") * 10 + C(side)).cast("long") for side in ("winner", "loser")})
    h = waves.careers(b.drop("o_custkey"), "long", fold_below=max(1000, min(t.orders.count() // 4, waves.FOLD_BELOW)))
    return h.select("bout_id", "participant", "kind", "moved", *(F.round(c, 4).alias(c) for c in ("rating_at", "rd_at", "rating", "rd")))


_ERODE = "CASE WHEN la[{e}] IS NULL OR d - la[{e}] <= 4 * 30.44 THEN p[{e}] ELSE p[{e}] * greatest(pow(0.96, (d - la[{e}]) / 30.44 - 4), 0.65) END"
_POINTS = f"""WITH RECURSIVE {_BOUTS.format(where="")}, s AS (
 SELECT k, CAST(0 AS BIGINT) AS rn, CAST([NULL, NULL, NULL, NULL, NULL] AS DOUBLE[]) AS p, [0, 0, 0, 0, 0] AS st, CAST([NULL, NULL, NULL, NULL, NULL] AS DATE[]) AS la, CAST(NULL AS BIGINT) AS id, 0 AS kind, 0 AS w, 0 AS l,
  0::DOUBLE AS bw, 0::DOUBLE AS bl, 0::DOUBLE AS aw, 0::DOUBLE AS al, 0 AS sw, 0 AS sl FROM (SELECT DISTINCT k FROM b)
 UNION ALL SELECT k, rn, {_put("p", "aw", "al")}, {_put("st", "sw", "sl")}, {_put("la", "CASE WHEN bw IS NULL THEN x ELSE d END", "CASE WHEN bl IS NULL THEN x ELSE d END")}, id, kind, w, l, bw, bl, aw, al, sw, sl FROM (
 SELECT *, CASE WHEN kind = 1 THEN CASE WHEN draw AND bw IS NOT NULL THEN 0 ELSE st[w] END ELSE greatest(st[w], 0) + 1 END AS sw, CASE WHEN kind = 1 THEN CASE WHEN draw AND bl IS NOT NULL THEN 0 ELSE st[l] END ELSE least(st[l], 0) - 1 END AS sl,
  CASE WHEN kind = 1 THEN ow WHEN won > ol THEN won ELSE ol + 0.00063 END AS aw, CASE WHEN kind = 1 THEN ol ELSE greatest(ol - 0.1 * m * 2.6 * dom / CASE WHEN title THEN 8 ELSE 1 END, 0.001) END AS al FROM (
 SELECT *, ow + CASE WHEN title THEN 1.6 ELSE 1 END * (0.24 * ol * (0.19 + 1.1 * dom) + 0.066 * m) AS won FROM (
 SELECT *, p[w] AS bw, p[l] AS bl, {_ERODE.format(e="w")} AS ow, {_ERODE.format(e="l")} AS ol, list_avg(p) AS m FROM (
 SELECT s.k, b.rn, CASE WHEN b.kind = 1 THEN s.p ELSE list_transform(s.p, lambda x, i: CASE WHEN i IN (b.w, b.l) THEN coalesce(x, 0.01) ELSE x END) END AS p, s.st, s.la, b.id, b.kind, b.w, b.l, b.d, b.dom, b.draw, b.title FROM s JOIN b ON b.k = s.k AND b.rn = s.rn + 1)))))
SELECT id AS bout_id, w AS participant, kind, round(bw, 6) AS before, round(aw, 6) AS after, sw AS streak FROM s WHERE rn > 0 AND bw IS NOT NULL UNION ALL SELECT id, l, kind, round(bl, 6), round(al, 6), sl FROM s WHERE rn > 0 AND bl IS NOT NULL"""


@query("r03_point_flow", _POINTS)
def r03(t):
    h = replay.point_flow(bouts(t), "o_custkey")
    return h.select("bout_id", "participant", "kind", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "streak")


@query("r06_external", """WITH b AS (SELECT CAST(o_orderdate AS DATE) AS day, o_custkey % 40 AS x, o_orderkey % 40 AS y, o_orderstatus AS s, CASE o_orderkey % 4 WHEN 0 THEN ' ufc 12' WHEN 1 THEN 'UFCX Night' WHEN 2 THEN 'Night of UFC' END AS event FROM orders),
 r AS (SELECT day, x AS owner, y AS opponent, CASE s WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' ELSE 'draw' END AS result, event FROM b UNION ALL SELECT day, y, x, CASE s WHEN 'F' THEN 'loss' WHEN 'O' THEN 'win' ELSE 'nc' END, event FROM b),
 k AS (SELECT *, row_number() OVER (PARTITION BY day, least(owner, opponent), greatest(owner, opponent) ORDER BY owner, result) AS n FROM r WHERE result IN ('win', 'loss') AND owner <> opponent AND coalesce(event, '') NOT LIKE '%ufc 12')
 SELECT day, CASE result WHEN 'win' THEN owner ELSE opponent END AS winner, CASE result WHEN 'win' THEN opponent ELSE owner END AS loser FROM k WHERE n = 1""")
def r06_external(t):
    """Bouts that both sides' histories list, once each, without the promotion's own events; on some days two people meet twice, and the rows disagree."""
    x, y, s = (C("o_custkey") % 40).alias("owner"), (C("o_orderkey") % 40).alias("opponent"), C("o_orderstatus")
    event = F.when(C("o_orderkey") % 4 == 0, " ufc 12").when(C("o_orderkey") % 4 == 1, "UFCX Night").when(C("o_orderkey") % 4 == 2, "Night of UFC")
    one = F.struct(x, y, F.when(s == "F", "win").when(s == "O", "loss").otherwise("draw").alias("result"))
    two = F.struct(y.alias("owner"), x.alias("opponent"), F.when(s == "F", "loss").when(s == "O", "win").otherwise("nc").alias("result"))
    rows = t.orders.select(F.to_date("o_orderdate").alias("day"), event.alias("event"), F.explode(F.array(one, two)).alias("r")).select("day", "event", "r.*")
    return replay.external_bouts(rows, "UFC")


@query("r14_weekly", f"""{_ELO}, h AS (SELECT s.k, s.w AS p, b.d, b.id, s.wa AS v FROM s JOIN b USING (id) UNION ALL SELECT s.k, s.l, b.d, b.id, s.la FROM s JOIN b USING (id)),
 x AS (SELECT k, p, CAST(date_trunc('year', d) AS DATE) AS week, arg_max(v, (d, id)) AS v FROM h GROUP BY ALL), y AS (SELECT *, row_number() OVER (PARTITION BY k, week ORDER BY v DESC, p) AS rank FROM x), z AS (SELECT *, lag(rank) OVER (PARTITION BY k, p ORDER BY week) AS previous FROM y)
 SELECT k AS o_custkey, p AS participant, week, rank, previous, CASE WHEN previous IS NULL THEN 'new' WHEN rank < previous THEN 'up' WHEN rank > previous THEN 'down' ELSE 'same' END AS trend FROM z""")
def r14(t):
    h = replay.elo(bouts(t).where("kind = 0"), "o_custkey")
    return replay.weekly_snapshot(h, "o_custkey", "after", "year").select("o_custkey", "participant", "week", "rank", "previous", "trend")


@query("t06_incremental", _CAREER)
def t06(t):
    """The history without the bouts of the last year, then brought up to date; late bouts among them change what came after."""
    late = (F.year("day") == 2001) | (F.dayofmonth("day") == 3)
    run = lambda d: replay.careers(d, "o_custkey")
    h = replay.refreshed(run(bouts(t).where(~late)), bouts(t), bouts(t).where(late), "o_custkey", run)
    return h.select("bout_id", "participant", "kind", "moved", *(F.round(c, 4).alias(c) for c in ("rating_at", "rd_at", "rating", "rd")))


@query("t06_resumed", _CAREER)
def t06_resumed(t):
    """The same late bouts, each league going on from where it stood before the first of them."""
    late = (F.year("day") == 2001) | (F.dayofmonth("day") == 3) & (F.year("day") >= 1998)
    h = replay.resumed(checkpointed(replay.careers(bouts(t).where(~late), "o_custkey")), bouts(t), bouts(t).where(late), "o_custkey")
    return h.select("bout_id", "participant", "kind", "moved", *(F.round(c, 4).alias(c) for c in ("rating_at", "rd_at", "rating", "rd")))


_SHARE = "CASE WHEN {a} + {b} = 0 THEN 0.5 ELSE ({a}) / ({a} + {b})::DOUBLE END"


@query("r01_dominance", f"""WITH x AS (SELECT p_partkey, p_size AS s, CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.0 END AS fin, CASE WHEN p_size % 3 = 2 THEN 0.1 ELSE 0 END AS pen, CASE WHEN p_size % 5 = 0 THEN 0.1 ELSE 0 END + CASE WHEN p_size % 7 = 0 THEN 0.05 ELSE 0 END AS cred, p_size % 3 + 1 AS fr FROM part),
 r AS (SELECT *, CASE WHEN fr = 1 THEN 1 WHEN abs(s + 0.5 - 25.25) / greatest(s + 0.5, 25.25) <= 0.05 THEN 0.5 WHEN s + 0.5 > 25.25 THEN 1 ELSE 0 END AS r1, CASE WHEN fr = 2 THEN 1 WHEN abs(25 - s - 1 / 12.0::DOUBLE) / greatest(25, s + 1 / 12.0::DOUBLE) <= 0.05 THEN 0.5 WHEN 25 > s + 1 / 12.0::DOUBLE THEN 1 ELSE 0 END AS r2 FROM x)
 SELECT p_partkey, s % 4 = 0 AS estimated, round(least(1, greatest(0, CASE WHEN s % 4 = 0 THEN CASE WHEN s % 3 = 2 THEN 0.4 ELSE fin END ELSE 0.3 * fin + 0.35 * (r1 + r2) / 2 + 0.2 * {_SHARE.format(a='s + 10', b='30')} + 0.15 * {_SHARE.format(a='s * 3', b='50')} END - pen + cred)), 6) AS score FROM r""")
def r01(t):
    s = C("p_size")
    one = lambda n, sig, ctrl, kd: F.struct(F.lit(n).alias("round"), sig.cast("int").alias("sig"), ctrl.cast("int").alias("ctrl"), F.lit(kd).alias("kd"))
    none = F.lit(None).cast("int")
    method = F.when(s % 3 == 0, "KO/TKO").when(s % 3 == 1, "Submission").otherwise("Decision - Split")
    side = lambda sig, ctrl, rounds: F.struct(method.alias("method"), (s % 3 + 1).alias("finish_round"), sig.alias("sig_total"), ctrl.alias("ctrl_total"), (s % 5 == 0).alias("bonus_potn"), (s % 7 == 0).alias("bonus_fotn"), F.when(s % 4 != 0, rounds).alias("rounds"))
    winner = side(s + 10, s * 3, F.array(one(1, s, F.lit(60), 0), one(2, F.lit(20), none, 1)))
    loser = side(F.lit(30), F.lit(50), F.array(one(1, F.lit(25), F.lit(30), 0), one(2, s, F.lit(10), 0)))
    d = t.part.select("p_partkey", rating.dominance(winner, loser).alias("d"))
    return d.select("p_partkey", F.round("d.score", 6).alias("score"), "d.estimated")
