"""Method and round of a bout, sided training rows and movers on orders as bouts: the customer wins against another one."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutline.operators import outcomes
from boutline.plans.registry import query

C = F.col
_BOUTS = """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_custkey AS w, o_custkey % 50 + 1 AS l, o_orderpriority AS division, CASE o_orderstatus WHEN 'F' THEN 'ko' WHEN 'O' THEN 'sub' WHEN 'P' THEN 'dec' END AS m,
 CAST(day(o_orderdate) % 6 AS INT) AS r, CASE WHEN o_orderpriority = '5-LOW' THEN 'ext' ELSE 'own' END AS src, month(o_orderdate) = 12 AS five, 1 / (1 + exp(-(o_totalprice - 250000) / 100000)) AS p
 FROM orders WHERE o_custkey <> o_custkey % 50 + 1 AND o_orderdate IS NOT NULL AND o_orderstatus IN ('F', 'O', 'P')"""
_SUMS = ", ".join(
    [f"sum(CASE WHEN {'won' if s == 'win' else 'NOT won'} AND m = '{m}' THEN x ELSE 0 END) AS {s}_{m}" for s in ("win", "loss") for m in outcomes.METHODS]
    + [f"sum(CASE WHEN {test} AND m <> 'dec' AND r > 0 THEN x{by} ELSE 0 END) AS {name}" for test, end in (("won", "won"), ("NOT won", "lost")) for by, name in (("", f"{end}_n"), (" * r", f"{end}_rounds"))]
)
_PROFILES = f"""b AS ({_BOUTS}), e AS (SELECT w AS person, d, true AS won, m, r, CASE src WHEN 'own' THEN 1.0 ELSE 0.5 END AS x FROM b UNION ALL SELECT l, d, false, m, r, CASE src WHEN 'own' THEN 1.0 ELSE 0.5 END FROM b),
 t AS (SELECT person, d, {_SUMS} FROM e GROUP BY ALL), c AS (SELECT person, d, {", ".join(f"CAST(coalesce(sum({x}) OVER z, 0) AS DOUBLE) AS {x}" for x in outcomes.COUNTS)} FROM t WINDOW z AS (PARTITION BY person ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def bouts(t):
    method = F.when(C("o_orderstatus") == "F", "ko").when(C("o_orderstatus") == "O", "sub").when(C("o_orderstatus") == "P", "dec")
    d = t.orders.select(
        C("o_orderkey").alias("bout_id"), F.to_date("o_orderdate").alias("day"), C("o_custkey").alias("winner"), (C("o_custkey") % 50 + 1).alias("loser"), C("o_orderpriority").alias("division"), method.alias("method"),
        (F.dayofmonth("o_orderdate") % 6).alias("finish"), F.when(C("o_orderpriority") == "5-LOW", "ext").otherwise("own").alias("source"), (F.month("o_orderdate") == 12).alias("five"), (1 / (1 + F.exp(-(C("o_totalprice") - 250000) / 100000))).alias("p"),
    )
    return d.where("winner <> loser AND day IS NOT NULL AND method IS NOT NULL")


@query("m17_profiles", f"WITH {_PROFILES} SELECT b.id AS bout_id, {', '.join(f'{s}.{x} AS {n}_{x}' for s, n in (('v', 'w'), ('u', 'l')) for x in outcomes.COUNTS)} FROM b JOIN c v ON v.person = b.w AND v.d = b.d JOIN c u ON u.person = b.l AND u.d = b.d WHERE src = 'own'")
def m17(t):
    d = outcomes.profiles_before(bouts(t))
    return d.select("bout_id", *(C(f"{side}_profile.{x}").alias(f"{n}_{x}") for side, n in (("winner", "w"), ("loser", "l")) for x in outcomes.COUNTS))


# Mixes of the divisions, of all bouts, the factor of five rounds and the rounds' shares are parameters here; m08_methods and m08_rounds count them.
MIXES = {"1-URGENT": (0.5, 0.2, 0.3), "2-HIGH": (0.2, 0.3, 0.5)}
EVERYWHERE, FIVE = (0.34, 0.2, 0.46), (1.1, 0.9, 0.95)
SHARES = {"ko": (0.55, 0.28, 0.17), "sub": (0.42, 0.34, 0.24)}
MEAN_ROUND = 1.7


def _lines_sql() -> str:
    """The six lines, written out in SQL."""
    mix = lambda k: "CASE division " + " ".join(f"WHEN '{d}' THEN {x[k]}" for d, x in MIXES.items()) + f" ELSE {EVERYWHERE[k]} END"
    start = ", ".join(f"{mix(k)} AS g{k}" for k in range(3))
    five = " + ".join(f"g{k} * {FIVE[k]}" for k in range(3))
    prior = ", ".join(f"CASE WHEN five THEN g{k} * {FIVE[k]} / ({five}) ELSE g{k} END AS q{k}" for k in range(3))
    parts = []
    for corner, a, b, win in (("A", "v", "u", "p"), ("B", "u", "v", "1 - p")):
        total = lambda s, side: " + ".join(f"{s}_{side}_{m}" for m in outcomes.METHODS)
        terms = []
        for k, m in enumerate(outcomes.METHODS):
            lift = lambda tally, whole, k=k: f"ln(({tally} + 6 * q{k}) / ({whole} + 6) / q{k})"
            z = f"{lift(f'{a}_win_{m}', total(a, 'win'))} + {lift(f'{b}_loss_{m}', total(b, 'loss'))} + 0.5 * {lift(f'({a}_loss_{m} + {b}_win_{m})', f'{total(a, "loss")} + {total(b, "win")}')}"
            terms.append(f"q{k} * exp({z})")
        late = f"(({a}_won_rounds + {b}_lost_rounds + 6 * {MEAN_ROUND}) / ({a}_won_n + {b}_lost_n + 6) - {MEAN_ROUND})"
        for k, m in enumerate(outcomes.METHODS):
            chance = f"({win}) * {terms[k]} / ({' + '.join(terms)})"
            tilt = [f"{s} * exp(0.3 * {late} * {i})" for i, s in enumerate(SHARES.get(m, ()))]
            first = f"{chance} * {tilt[0]} / ({' + '.join(tilt)})" if tilt else "NULL"
            parts.append(f"SELECT id AS bout_id, '{corner}' AS corner, '{m}' AS method, round({chance}, 6) AS probability, round({first}, 6) AS first_round FROM s")
    names = ", ".join(f"{s}.{x} AS {s}_{x}" for s in ("v", "u") for x in outcomes.COUNTS)
    return f"WITH {_PROFILES}, j AS (SELECT b.*, {start}, {names} FROM b JOIN c v ON v.person = b.w AND v.d = b.d JOIN c u ON u.person = b.l AND u.d = b.d WHERE src = 'own'), s AS (SELECT *, {prior} FROM j) " + " UNION ALL ".join(parts)


@query("m07_outcomes", _lines_sql())
def m07(t):
    mix = lambda x: F.struct(*(F.lit(v).alias(m) for m, v in zip(outcomes.METHODS, x)))
    own = F.coalesce(*(F.when(C("division") == d, mix(x)) for d, x in MIXES.items()))
    d = outcomes.profiles_before(bouts(t), keep=("p", "division", "five"))
    prior = outcomes.context_mix([own], mix(EVERYWHERE), C("five"), mix(FIVE))
    d = d.select("bout_id", "p", "winner_profile", "loser_profile", prior.alias("prior"))
    rounds = {m: F.array(*map(F.lit, s)) for m, s in SHARES.items()}
    d = outcomes.with_outcome_lines(d, "lines", "p", "winner_profile", "loser_profile", "prior", rounds, MEAN_ROUND)
    # outer, as Spark would work out the lines of an inner one three times: for the rows, and for filters that it infers (not null, not empty), which always hold here
    d = d.select("bout_id", F.explode_outer("lines").alias("x")).select("bout_id", "x.*")
    return d.select("bout_id", "corner", "method", F.round("probability", 6).alias("probability"), F.round(F.get("by_round", F.lit(0)), 6).alias("first_round"))


@query("m02_sided", """WITH b AS (SELECT o_orderkey AS id, a.c_acctbal - z.c_acctbal AS gap, a.c_nationkey - z.c_nationkey AS reach FROM orders JOIN customer a ON a.c_custkey = o_custkey JOIN customer z ON z.c_custkey = o_custkey % 50 + 1),
 f AS (SELECT *, left(md5(id || ':7'), 1) < '8' AS heads FROM b) SELECT id AS bout_id, round(CASE WHEN heads THEN gap ELSE -gap END, 2) AS gap, CASE WHEN heads THEN reach ELSE -reach END AS reach, CAST(heads AS INT) AS label FROM f""")
def m02(t):
    a, z = (t.customer.select(C("c_custkey").alias(f"{n}_key"), C("c_acctbal").alias(f"{n}_bal"), C("c_nationkey").alias(f"{n}_nation")) for n in "az")
    d = t.orders.join(a, C("a_key") == C("o_custkey")).join(z, C("z_key") == C("o_custkey") % 50 + 1)
    d = d.select(C("o_orderkey").alias("bout_id"), (C("a_bal") - C("z_bal")).alias("gap"), (C("a_nation") - C("z_nation")).alias("reach"))
    return outcomes.sided(d, "bout_id", ["gap", "reach"]).withColumn("gap", F.round("gap", 2))


@query("m12_movers", f"""WITH b AS ({_BOUTS}), e AS (SELECT w AS person, d, division FROM b UNION ALL SELECT l, d, division FROM b), n AS (SELECT DISTINCT * FROM e),
 x AS (SELECT b.*, EXISTS (SELECT 1 FROM n WHERE n.person IN (b.w, b.l) AND n.d < b.d AND n.division <> b.division) AS mover FROM b) SELECT division, mover, count(*) AS n, round(avg(ln(p / (1 - p))), 6) AS mean_log_ratio FROM x GROUP BY ALL""")
def m12(t):
    d = outcomes.with_movers(bouts(t)).withColumn("z", F.ln(C("p") / (1 - C("p"))))
    return d.groupBy("division", "mover").agg(F.count("*").alias("n"), F.round(F.avg("z"), 6).alias("mean_log_ratio"))
