"""Joins, predicates, aggregates, windows, ordering and set operations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boutline.operators import ordered
from boutline.operators import relational as R
from boutline.plans.registry import query

C = F.col
long = lambda c: F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


# ---- scans and predicates

@query("s01_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def s01(t):
    return t.orders.where("o_orderstatus = 'F' AND o_totalprice > 200000").select("o_orderkey", "o_totalprice")


@query("p01_nested_sides", "SELECT o_orderkey, c_name IS NOT NULL AS matched, c_name AS side_name, c_nationkey AS side_nation FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0")
def p01(t):
    j = t.orders.join(t.customer, (C("o_custkey") == C("c_custkey")) & (C("c_acctbal") >= 0), "left")
    side = F.when(C("c_custkey").isNotNull(), F.struct("c_name", "c_nationkey"))
    return j.select("o_orderkey", side.alias("side")).select("o_orderkey", C("side").isNotNull().alias("matched"), C("side.c_name").alias("side_name"), C("side.c_nationkey").alias("side_nation"))


@query("p02_optional_filters", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name ILIKE '%00001%'")
def p02(t):
    segment, nation, text = "BUILDING", None, "00001"
    d = R.optional(t.customer, c_mktsegment=segment, c_nationkey=nation)
    return (d.where(C("c_name").ilike(f"%{text}%")) if text else d).select("c_custkey", "c_name")


_SIDES = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_quantity) AS rn FROM lineitem"


@query("p03_pair_fold", "SELECT l_orderkey, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice, count(*) = 2 AS complete, CAST(arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS BIGINT) AS l_partkey FROM lineitem GROUP BY l_orderkey")
def p03(t):
    d = R.pair_fold(t.lineitem, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity", "l_extendedprice"], ["l_partkey"])
    return d.select("l_orderkey", F.round("l_quantity", 2).alias("l_quantity"), F.round("l_extendedprice", 2).alias("l_extendedprice"), "complete", "l_partkey")


def corners(t):
    """Orders of exactly two lines as bouts: the dearer line wins."""
    w = W.partitionBy("l_orderkey")
    rn = F.row_number().over(w.orderBy(C("l_extendedprice").desc(), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
    d = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", F.count("*").over(w).alias("n"), rn.alias("rn"))
    return d.where("n = 2").withColumn("result", F.when(C("rn") == 1, "win").otherwise("loss")).drop("n", "rn")


@query("p04_winner_loser", f"SELECT w.l_orderkey, w.l_partkey AS winner, l.l_partkey AS loser, round(w.l_extendedprice - l.l_extendedprice, 2) AS margin FROM ({_SIDES}) w JOIN ({_SIDES}) l ON w.l_orderkey = l.l_orderkey WHERE w.n = 2 AND w.rn = 1 AND l.rn = 2")
def p04(t):
    pairs, _ = R.winner_loser(corners(t), "l_orderkey", "result")
    return pairs.select("l_orderkey", C("winner.l_partkey").alias("winner"), C("loser.l_partkey").alias("loser"), F.round(C("winner.l_extendedprice") - C("loser.l_extendedprice"), 2).alias("margin"))


@query("p05_unpivot_sides", "SELECT k, count(*) AS n FROM (SELECT l_partkey AS k FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem) GROUP BY k")
def p05(t):
    return R.unpivot_sides(t.lineitem.select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey", "k").groupBy("k").agg(F.count("*").alias("n"))


@query("p06_opponent_pick", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey IN (1, 2, 3, 5, 8) THEN l_suppkey ELSE l_partkey END AS other FROM lineitem WHERE l_partkey IN (1, 2, 3, 5, 8) OR l_suppkey IN (1, 2, 3, 5, 8)")
def p06(t):
    ids = [1, 2, 3, 5, 8]
    d = t.lineitem.where(C("l_partkey").isin(ids) | C("l_suppkey").isin(ids))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(C("l_partkey").isin(ids), C("l_suppkey")).otherwise(C("l_partkey")).alias("other"))


@query("p07_membership", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def p07(t):
    c = t.customer.join(t.nation.where("n_regionkey = 1"), C("c_nationkey") == C("n_nationkey"), "left_semi")
    return c.join(t.orders.where("o_orderstatus = 'P'"), C("c_custkey") == C("o_custkey"), "left_anti").select("c_custkey")


@query("p08_regex", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '(?i)^(standard|promo)') AND NOT regexp_matches(p_name, '[05]$')")
def p08(t):
    return t.part.where(C("p_type").rlike("(?i)^(standard|promo)") & ~C("p_name").rlike("[05]$")).select("p_partkey", "p_type")


@query("p09_escaped_ilike", r"SELECT c_custkey FROM customer WHERE c_name ILIKE '%r\_1%' ESCAPE '\' OR c_name ILIKE 'customer#00000001%'")
def p09(t):
    from boutline.functions.text import like_escape

    return t.customer.where(C("c_name").ilike(f"%{like_escape('r_1')}%") | C("c_name").ilike(like_escape("customer#00000001") + "%")).select("c_custkey")


@query("p10_prefix_split", "SELECT starts_with(o_orderpriority, '1-') AS urgent, count(*) AS n FROM orders GROUP BY 1")
def p10(t):
    return t.orders.groupBy(C("o_orderpriority").startswith("1-").alias("urgent")).agg(F.count("*").alias("n"))


_PREV = "(SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_acctbal > 0)"
_CURR = "(SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS bal FROM customer WHERE c_mktsegment <> 'MACHINERY' OR c_acctbal > 0)"


def snapshots(t):
    """Two snapshots of customers: before and after a change."""
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    gone = C("c_custkey") % 7 == 0
    prev = c.where("c_mktsegment <> 'BUILDING' OR c_acctbal > 0").withColumn("bal", F.when(~gone, C("c_acctbal"))).drop("c_acctbal")
    curr = c.where("c_mktsegment <> 'MACHINERY' OR c_acctbal > 0").withColumn("bal", F.when(gone, None).when(C("c_custkey") % 4 == 0, C("c_acctbal") + 1).otherwise(C("c_acctbal"))).drop("c_acctbal")
    return prev, curr


@query("p11_null_safe", f"SELECT p.c_custkey FROM {_PREV} p JOIN {_CURR} c USING (c_custkey) WHERE p.bal IS NOT DISTINCT FROM c.bal")
def p11(t):
    p, c = snapshots(t)
    return p.join(c.select("c_custkey", C("bal").alias("now")), "c_custkey").where(C("bal").eqNullSafe(C("now"))).select("c_custkey")


@query("p12_row_in", "SELECT p_partkey FROM part WHERE (p_brand, p_size) IN (('Brand#11', 1), ('Brand#22', 7), ('Brand#33', 3))")
def p12(t):
    keys = [("Brand#11", 1), ("Brand#22", 7), ("Brand#33", 3)]
    test = F.lit(False)
    for brand, size in keys:
        test = test | ((C("p_brand") == brand) & (C("p_size") == size))
    return t.part.where(test).select("p_partkey")


@query("p13_number_guard", "SELECT c_custkey, CASE WHEN isfinite(TRY_CAST(x AS DOUBLE)) THEN TRY_CAST(x AS DOUBLE) END AS num FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'NaN' WHEN 1 THEN 'oops' WHEN 2 THEN CAST(c_custkey AS VARCHAR) ELSE NULL END AS x FROM customer)")
def p13(t):
    from boutline.functions.text import to_number

    x = F.when(C("c_custkey") % 4 == 0, "NaN").when(C("c_custkey") % 4 == 1, "oops").when(C("c_custkey") % 4 == 2, C("c_custkey").cast("string"))
    return t.customer.select("c_custkey", to_number(x).alias("num"))


@query("p14_has_history", "SELECT c_custkey, CASE WHEN n > 0 THEN n - 1 END AS prior, n IS NOT NULL AND n > 0 AS has_history FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def p14(t):
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    j = t.customer.join(n, C("c_custkey") == C("o_custkey"), "left")
    prior = F.when(C("n") > 0, F.struct((C("n") - 1).alias("prior")))
    return j.select("c_custkey", prior["prior"].alias("prior"), prior.isNotNull().alias("has_history"))


@query("p15_valid_id", r"SELECT x, regexp_matches(x, '^\d{1,9}$') AS ok, CASE WHEN regexp_matches(x, '^\d{1,9}$') THEN TRY_CAST(x AS INT) END AS id FROM (SELECT CAST(c_custkey * 70000 AS VARCHAR) || CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE '' END AS x FROM customer)")
def p15(t):
    x = F.concat((C("c_custkey") * 70000).cast("string"), F.when(C("c_custkey") % 3 == 0, "x").otherwise(""))
    ok = C("x").rlike(r"^\d{1,9}$")
    return t.customer.select(x.alias("x")).select("x", ok.alias("ok"), F.when(ok, C("x").try_cast("int")).alias("id"))


# ---- joins

@query("j01_dimension", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j01(t):
    return t.nation.join(t.region, C("n_regionkey") == C("r_regionkey")).select("n_name", "r_name")


@query("j02_two_roles", "SELECT l_orderkey, l_linenumber, s.n_name AS supplier_nation, c.n_name AS customer_nation FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation s ON s.n_nationkey = s_nationkey LEFT JOIN nation c ON c.n_nationkey = c_nationkey")
def j02(t):
    n = t.nation.select("n_nationkey", "n_name")
    s, c = n.alias("s"), n.alias("c")
    d = t.lineitem.join(t.orders, C("o_orderkey") == C("l_orderkey")).join(t.customer, C("c_custkey") == C("o_custkey")).join(t.supplier, C("s_suppkey") == C("l_suppkey"))
    d = d.join(s, C("s.n_nationkey") == C("s_nationkey"), "left").join(c, C("c.n_nationkey") == C("c_nationkey"), "left")
    return d.select("l_orderkey", "l_linenumber", C("s.n_name").alias("supplier_nation"), C("c.n_name").alias("customer_nation"))


@query("j03_star", "SELECT r_name, n_name, o_orderstatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def j03(t):
    d = t.lineitem.join(t.orders, C("o_orderkey") == C("l_orderkey")).join(t.customer, C("c_custkey") == C("o_custkey")).join(t.nation, C("n_nationkey") == C("c_nationkey")).join(t.region, C("r_regionkey") == C("n_regionkey"), "left")
    return d.groupBy("r_name", "n_name", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum(C("l_extendedprice") * (1 - C("l_discount"))), 2).alias("revenue"))


@query("j04_three_roles", "SELECT a.c_custkey, x.n_name AS n1, y.n_name AS n2, z.n_name AS n3 FROM customer a JOIN nation x ON x.n_nationkey = a.c_nationkey LEFT JOIN nation y ON y.n_nationkey = (a.c_nationkey + 1) % 30 LEFT JOIN nation z ON z.n_nationkey = a.c_custkey % 30 JOIN region ON r_regionkey = x.n_regionkey WHERE r_name <> 'ASIA'")
def j04(t):
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    x, y, z = n.alias("x"), n.alias("y"), n.alias("z")
    d = t.customer.join(x, C("x.n_nationkey") == C("c_nationkey")).join(y, C("y.n_nationkey") == (C("c_nationkey") + 1) % 30, "left").join(z, C("z.n_nationkey") == C("c_custkey") % 30, "left")
    d = d.join(t.region.where("r_name <> 'ASIA'"), C("r_regionkey") == C("x.n_regionkey"))
    return d.select("c_custkey", C("x.n_name").alias("n1"), C("y.n_name").alias("n2"), C("z.n_name").alias("n3"))


@query("j05_left_unmatched", "SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'")
def j05(t):
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), C("o_custkey") == C("c_custkey"), "left").select("c_custkey", "c_name", "o_orderkey")


@query("j06_opponent", f"WITH s AS (SELECT * FROM ({_SIDES}) WHERE n = 2) SELECT a.l_orderkey, a.l_partkey, b.l_partkey AS opponent, b.l_quantity AS opponent_quantity FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.rn <> b.rn")
def j06(t):
    d = corners(t)
    o = d.select("l_orderkey", C("result").alias("_r"), C("l_partkey").alias("opponent"), C("l_quantity").alias("opponent_quantity"))
    return d.join(o, "l_orderkey").where("result <> _r").select("l_orderkey", "l_partkey", "opponent", "opponent_quantity")


@query("j07_siblings", "SELECT a.p_partkey, coalesce(min(b.p_partkey), a.p_partkey) AS canonical, count(b.p_partkey) AS siblings FROM part a LEFT JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND (a.p_size = b.p_size OR a.p_retailprice = b.p_retailprice) GROUP BY a.p_partkey")
def j07(t):
    return R.siblings(t.part, "p_partkey", ["p_brand", "p_type"], "p_size", "p_retailprice")


@query("j08_one_row", "WITH w AS (SELECT max(o_orderdate) AS last FROM orders) SELECT o_orderkey, date_diff('day', o_orderdate, last) AS age FROM orders CROSS JOIN w WHERE date_diff('day', o_orderdate, last) <= 60")
def j08(t):
    last = t.orders.agg(F.max("o_orderdate").alias("last"))
    age = F.datediff("last", "o_orderdate").cast("long")
    return t.orders.crossJoin(F.broadcast(last)).select("o_orderkey", age.alias("age")).where("age <= 60")


@query("j09_composite_left", "WITH p AS (SELECT l_partkey, l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT a.l_partkey, a.l_suppkey, a.n, b.n AS n_returned FROM p a LEFT JOIN p b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND b.l_returnflag = 'R' WHERE a.l_returnflag = 'N'")
def j09(t):
    p = t.lineitem.groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    r = p.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey", C("n").alias("n_returned"))
    return p.where("l_returnflag = 'N'").join(r, ["l_partkey", "l_suppkey"], "left").select("l_partkey", "l_suppkey", "n", "n_returned")


@query("j10_prefix_asof", """SELECT o.o_orderkey, (SELECT count(*) FROM orders p WHERE p.o_custkey = o.o_custkey AND CAST(p.o_orderdate AS DATE) < CAST(o.o_orderdate AS DATE)) AS prior,
  (SELECT max(CAST(p.o_orderdate AS DATE)) FROM orders p WHERE p.o_custkey = o.o_custkey AND CAST(p.o_orderdate AS DATE) < CAST(o.o_orderdate AS DATE)) AS last_prior FROM orders o""")
def j10(t):
    d = R.prefix_asof(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", F.unix_date(F.to_date("o_orderdate")), {"prior": F.count("*"), "last_prior": F.max(F.to_date("o_orderdate"))})
    return d.select("o_orderkey", "prior", "last_prior")


@query("j11_conditional_lateral", "SELECT o_orderkey, l_partkey AS first_part FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey AND o_orderstatus <> 'F'")
def j11(t):
    first = t.lineitem.groupBy("l_orderkey").agg(F.min("l_partkey").alias("first_part"))
    return t.orders.join(first, (C("l_orderkey") == C("o_orderkey")) & (C("o_orderstatus") != "F"), "left").select("o_orderkey", "first_part")


@query("j12_scalar_lookup", "SELECT s_suppkey, (SELECT min(c_custkey) FROM customer WHERE c_nationkey = s_nationkey) AS first_customer FROM supplier")
def j12(t):
    first = t.customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("first_customer"))
    return t.supplier.join(first, C("c_nationkey") == C("s_nationkey"), "left").select("s_suppkey", "first_customer")


@query("j13_eligible_rank", "SELECT a.c_custkey, 1 + count(b.c_custkey) AS rank FROM customer a LEFT JOIN customer b ON b.c_nationkey = a.c_nationkey AND b.c_acctbal > a.c_acctbal AND b.c_mktsegment = 'BUILDING' GROUP BY a.c_custkey")
def j13(t):
    return ordered.keyed_eligible_rank(t.customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), ["c_nationkey"], "c_acctbal", C("c_mktsegment") == "BUILDING").select("c_custkey", C("rank").cast("long").alias("rank"))


@query("j14_order_by_flags", "SELECT c_custkey FROM customer c ORDER BY EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') DESC, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) DESC NULLS LAST, c_custkey LIMIT 25")
def j14(t):
    f = t.orders.groupBy("o_custkey").agg(F.bool_or(C("o_orderstatus") == "P").alias("open"), F.max("o_orderdate").alias("last"))
    return t.customer.join(f, C("o_custkey") == C("c_custkey"), "left").orderBy(F.coalesce("open", F.lit(False)).desc(), C("last").desc_nulls_last(), "c_custkey").limit(25).select("c_custkey")


@query("j15_exists_inequality", "SELECT o_orderkey FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey < a.o_orderkey AND b.o_totalprice > a.o_totalprice)")
def j15(t):
    # an earlier row is dearer if the dearest of the earlier ones is: one sort, no pairs
    before = W.partitionBy("o_custkey").orderBy("o_orderkey").rangeBetween(W.unboundedPreceding, -1)
    return t.orders.select("o_orderkey", "o_totalprice", F.max("o_totalprice").over(before).alias("dearest")).where("dearest > o_totalprice").select("o_orderkey")


@query("j16_semi_distinct", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def j16(t):
    return t.part.join(t.lineitem.where("l_quantity >= 49"), C("p_partkey") == C("l_partkey"), "left_semi").select("p_partkey")


@query("j17_repoint", "WITH m AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS keep FROM part) SELECT keep AS part, count(*) AS n FROM lineitem JOIN m ON p_partkey = l_partkey GROUP BY keep")
def j17(t):
    m = t.part.withColumn("keep", F.min("p_partkey").over(W.partitionBy("p_brand", "p_type", "p_size"))).where("keep <> p_partkey").select("p_partkey", "keep")
    return t.lineitem.join(m, C("l_partkey") == C("p_partkey"), "left").groupBy(F.coalesce("keep", "l_partkey").alias("part")).agg(F.count("*").alias("n"))


@query("j18_sibling_fill", "SELECT c_custkey, coalesce(bal, first_value(bal IGNORE NULLS) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY CASE WHEN bal IS NULL THEN 1 ELSE 0 END, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS bal FROM " + _PREV)
def j18(t):
    p, _ = snapshots(t)
    first = p.where("bal IS NOT NULL").groupBy("c_nationkey", "c_mktsegment").agg(F.min_by("bal", "c_custkey").alias("b"))
    return p.join(first, ["c_nationkey", "c_mktsegment"], "left").select("c_custkey", F.coalesce("bal", "b").alias("bal"))


@query("j19_lookup", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def j19(t):
    return t.supplier.join(t.nation, C("n_nationkey") == C("s_nationkey")).select("s_suppkey", "n_name")


@query("j20_priority", "SELECT s_suppkey, coalesce((SELECT c_custkey FROM customer WHERE c_custkey = s_suppkey * 20), (SELECT min(c_custkey) FROM customer WHERE c_nationkey = s_nationkey)) AS match, EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey * 20) AS by_key FROM supplier")
def j20(t):
    by_key = t.customer.select(C("c_custkey").alias("k1"))
    by_name = t.customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("k2"))
    d = t.supplier.join(by_key, C("k1") == C("s_suppkey") * 20, "left").join(by_name, C("c_nationkey") == C("s_nationkey"), "left")
    return d.select("s_suppkey", F.coalesce("k1", "k2").alias("match"), C("k1").isNotNull().alias("by_key"))


@query("j21_unique_name", "WITH u AS (SELECT p_type, min(p_partkey) AS k FROM part WHERE p_brand = 'Brand#11' GROUP BY p_type HAVING count(*) = 1) SELECT p_partkey, k AS match FROM part LEFT JOIN u USING (p_type) WHERE p_brand = 'Brand#12'")
def j21(t):
    u = t.part.where("p_brand = 'Brand#11'").groupBy("p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("match")).where("n = 1").drop("n")
    return t.part.where("p_brand = 'Brand#12'").join(u, "p_type", "left").select("p_partkey", "match")


@query("j22_two_sided_unique", """WITH a AS (SELECT p_partkey AS a, p_type, p_size FROM part WHERE p_brand < 'Brand#2'), b AS (SELECT p_partkey AS b, p_type, p_size FROM part WHERE p_brand >= 'Brand#2'),
ua AS (SELECT p_type, p_size, min(a) AS a FROM a GROUP BY ALL HAVING count(*) = 1), ub AS (SELECT p_type, p_size, min(b) AS b FROM b GROUP BY ALL HAVING count(*) = 1) SELECT a, b FROM ua JOIN ub USING (p_type, p_size)""")
def j22(t):
    only = lambda d, name: d.groupBy("p_type", "p_size").agg(F.count("*").alias("n"), F.min("p_partkey").alias(name)).where("n = 1").drop("n")
    return only(t.part.where("p_brand < 'Brand#2'"), "a").join(only(t.part.where("p_brand >= 'Brand#2'"), "b"), ["p_type", "p_size"]).select("a", "b")


# ---- aggregates

@query("a01_max_sum_coalesce", "SELECT c_custkey, coalesce(sum(o_totalprice), 0) AS total, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey".replace("coalesce(sum(o_totalprice), 0)", "round(coalesce(sum(o_totalprice), 0), 2)"))
def a01(t):
    o = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.max("o_orderdate").alias("last"))
    return t.customer.join(o, C("o_custkey") == C("c_custkey"), "left").select("c_custkey", F.round(F.coalesce("s", F.lit(0.0)), 2).alias("total"), "last")


@query("a02_global_filters", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(DISTINCT o_custkey) AS people, max(o_orderdate) AS last, count(*) AS n FROM orders")
def a02(t):
    return t.orders.agg(F.count_if(C("o_orderstatus") == "F").alias("done"), F.count_distinct("o_custkey").alias("people"), F.max("o_orderdate").alias("last"), F.count("*").alias("n"))


@query("a03_tallies", """SELECT o_custkey, count(*) FILTER (WHERE src = 'a' AND won AND cat = 'x') AS ax_wins, count(*) FILTER (WHERE src = 'a' AND NOT won AND cat = 'x') AS ax_losses, count(*) FILTER (WHERE src = 'b' AND cat <> 'x') AS b_rest, round(coalesce(sum(o_totalprice) FILTER (WHERE src = 'b' AND won), 0), 2) AS b_won
 FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'b' ELSE 'a' END AS src, o_orderstatus = 'F' AS won, CASE WHEN o_orderpriority < '3' THEN 'x' ELSE 'y' END AS cat FROM orders) GROUP BY 1""")
def a03(t):
    d = t.orders.select("o_custkey", "o_totalprice", F.when(C("o_orderkey") % 3 == 0, "b").otherwise("a").alias("src"), (C("o_orderstatus") == "F").alias("won"), F.when(C("o_orderpriority") < "3", "x").otherwise("y").alias("cat"))
    a, b, x = C("src") == "a", C("src") == "b", C("cat") == "x"
    return d.groupBy("o_custkey").agg(F.count_if(a & C("won") & x).alias("ax_wins"), F.count_if(a & ~C("won") & x).alias("ax_losses"), F.count_if(b & ~x).alias("b_rest"), F.round(F.coalesce(F.sum(F.when(b & C("won"), C("o_totalprice"))), F.lit(0.0)), 2).alias("b_won"))


@query("a04_bool_or", "SELECT o_custkey, bool_or(o_orderstatus = 'P') AS any_open, bool_and(o_totalprice > 1000) AS all_large FROM orders GROUP BY 1")
def a04(t):
    return t.orders.groupBy("o_custkey").agg(F.bool_or(C("o_orderstatus") == "P").alias("any_open"), F.bool_and(C("o_totalprice") > 1000).alias("all_large"))


@query("a05_recent_list", "SELECT o_custkey, array_to_string(list(o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC)[1:12], '') AS recent FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1")
def a05(t):
    recent = ordered.newest(t.orders.where("o_orderpriority <> '5-LOW'"), ["o_custkey"], [C("o_orderdate").desc(), C("o_orderkey").desc()], 12, C("o_orderstatus"), "recent")
    return recent.select("o_custkey", F.array_join("recent", "").alias("recent"))


@query("a06_duplicate_groups", "SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_partkey) AS keep FROM lineitem GROUP BY ALL HAVING count(*) > 1".replace("GROUP BY ALL", "GROUP BY l_orderkey, l_linenumber"))
def a06(t):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("l_partkey").alias("keep")).where("n > 1")


@query("a07_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
def a07(t):
    return t.part.select("p_brand", "p_size").distinct()


@query("a08_latest_per_key", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def a08(t):
    return R.latest_per_key(t.orders, ["o_custkey"], [C("o_orderdate").desc(), C("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_totalprice")


# ---- windows

@query("w01_top_or_pinned", "SELECT p_partkey, p_brand, rn FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 3 OR p_size = 1")
def w01(t):
    return ordered.top_per_key(t.part.select("p_partkey", "p_brand", "p_retailprice", "p_size"), ["p_brand"], [C("p_retailprice").desc(), C("p_partkey")], 3, C("p_size") == 1).select("p_partkey", "p_brand", long("rn").alias("rn"))


@query("w02_total_over", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE c_mktsegment = 'MACHINERY') AS total_count FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_name LIMIT 20 OFFSET 20")
def w02(t):
    return R.page(t.customer.where("c_mktsegment = 'MACHINERY'").select("c_custkey", "c_name"), [C("c_name")], 2, 20)


@query("w03_pinned_rank", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(p_partkey = k, false) DESC, p_retailprice DESC, p_partkey) - CAST(bool_or(coalesce(p_partkey = k, false)) OVER (PARTITION BY p_brand) AS INT) AS rank FROM (SELECT *, min(CASE WHEN p_size = 1 THEN p_partkey END) OVER (PARTITION BY p_brand) AS k FROM part)")
def w03(t):
    first = t.part.where("p_size = 1").groupBy("p_brand").agg(F.min("p_partkey").alias("champion"))  # one a brand
    d = t.part.select("p_partkey", "p_brand", "p_retailprice").join(first, "p_brand", "left")
    return ordered.keyed_pinned_rank(d, ["p_brand"], C("p_partkey") == C("champion"), [C("p_retailprice").desc(), C("p_partkey")], "rank").select("p_partkey", "rank")


@query("w04_global_rank", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier")
def w04(t):
    return R.global_rank(t.supplier.select("s_suppkey", "s_acctbal"), [C("s_acctbal").desc(), C("s_suppkey")], "rank").select("s_suppkey", "rank")


@query("w05_streak", """WITH r AS (SELECT o_custkey, o_orderstatus AS s, row_number() OVER w AS rn, first_value(o_orderstatus) OVER w AS latest FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC)),
x AS (SELECT o_custkey, any_value(latest) AS latest, coalesce(min(rn) FILTER (WHERE s <> latest), max(rn) + 1) - 1 AS n FROM r GROUP BY 1) SELECT o_custkey, CASE latest WHEN 'F' THEN n WHEN 'O' THEN -n ELSE 0 END AS streak FROM x""")
def w05(t):
    return R.current_streak(t.orders, "o_custkey", [C("o_orderdate").desc_nulls_first(), C("o_orderkey").desc()], "o_orderstatus", "F", "O")


@query("w06_pair_dedup", "SELECT a, b, k FROM (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_orderkey AS k, row_number() OVER (PARTITION BY least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) ORDER BY l_returnflag = 'R' DESC, l_quantity DESC NULLS LAST, l_orderkey) AS rn FROM lineitem) WHERE rn = 1")
def w06(t):
    d = t.lineitem.select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"), C("l_orderkey").alias("k"), (C("l_returnflag") == "R").alias("done"), "l_quantity")
    return R.latest_per_key(d, ["a", "b"], [C("done").desc(), C("l_quantity").desc_nulls_last(), C("k")]).select("a", "b", "k")


@query("w07_null_groups", "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (PARTITION BY nullif(c_nationkey, 3), c_mktsegment ORDER BY c_custkey) AS rn FROM customer) WHERE rn = 1")
def w07(t):
    d = t.customer.select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("n"), "c_mktsegment")
    return R.latest_per_key(d, ["n", "c_mktsegment"], [C("c_custkey")]).select("c_custkey")


@query("w08_streak_from_recent", """WITH r AS (SELECT o_custkey, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
k AS (SELECT o_custkey, s, row_number() OVER (PARTITION BY o_custkey ORDER BY rn) AS i FROM r WHERE rn <= 12 AND s <> 'P'), f AS (SELECT *, first_value(s) OVER (PARTITION BY o_custkey ORDER BY i) AS l FROM k),
x AS (SELECT o_custkey, any_value(l) AS l, coalesce(min(i) FILTER (WHERE s <> l), max(i) + 1) - 1 AS n FROM f GROUP BY 1) SELECT c_custkey AS o_custkey, coalesce(CASE l WHEN 'F' THEN n ELSE -n END, 0) AS streak FROM (SELECT DISTINCT o_custkey AS c_custkey FROM orders) LEFT JOIN x ON o_custkey = c_custkey""")
def w08(t):
    from boutline.operators.sequence import streak_from

    recent = ordered.newest(t.orders, ["o_custkey"], [C("o_orderdate").desc(), C("o_orderkey").desc()], 12, C("o_orderstatus"), "x")
    return recent.select("o_custkey", long(streak_from(C("x"), win="F", loss="O", skip="P")).alias("streak"))


@query("w09_last_n_state", "SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0), 4) AS last5, round(coalesce(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0.5), 4) AS last3 FROM events")
def w09(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.round(F.coalesce(F.sum("value").over(w.rowsBetween(-5, -1)), F.lit(0.0)), 4).alias("last5"), F.round(F.coalesce(F.avg("value").over(w.rowsBetween(-3, -1)), F.lit(0.5)), 4).alias("last3"))


@query("w10_prefix_days", "SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS before FROM events")
def w10(t):
    d = R.prefix_asof(t.events, "user_id", F.unix_date(F.to_date("ts")), {"b": F.sum("value")})
    return d.select("event_id", F.round(F.coalesce("b", F.lit(0.0)), 4).alias("before"))


@query("w11_one_per_event", "SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R' DESC, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def w11(t):
    return R.latest_per_key(t.lineitem, ["l_orderkey"], [(C("l_returnflag") == "R").desc(), C("l_partkey"), C("l_suppkey")]).select("l_orderkey", "l_partkey")


@query("w12_neighbours", "WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders), m AS (SELECT o_custkey, rn AS spot FROM r WHERE o_orderkey % 100 = 0) SELECT DISTINCT o_orderkey FROM r JOIN m USING (o_custkey) WHERE rn BETWEEN spot - 2 AND spot + 2")
def w12(t):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 2)
    return t.orders.withColumn("near", F.bool_or(C("o_orderkey") % 100 == 0).over(w)).where("near").select("o_orderkey")


@query("w13_first_appearance", "SELECT o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey)) AS place FROM orders GROUP BY 1")
def w13(t):
    g = t.orders.groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("k"))
    return g.select("o_orderpriority", long(F.row_number().over(W.orderBy("k"))).alias("place"))


# ---- order, limit, set operations

@query("o01_page", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total_count FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 30 OFFSET 60")
def o01(t):
    return R.page(t.orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate"), [C("o_orderdate").desc(), C("o_orderkey")], 3, 30).select("o_orderkey", "total_count")


@query("o02_conditional_order", "SELECT c_custkey FROM customer ORDER BY CASE WHEN '' = '' THEN c_acctbal END DESC NULLS LAST, c_name LIMIT 40")
def o02(t):
    text = ""
    keys = [C("c_acctbal").desc_nulls_last(), C("c_name")] if text == "" else [C("c_name")]
    return t.customer.orderBy(*keys).limit(40).select("c_custkey")


@query("o03_upcoming_first", "SELECT o_orderkey FROM orders ORDER BY (o_orderdate >= TIMESTAMP '2001-07-01') DESC, CASE WHEN o_orderdate >= TIMESTAMP '2001-07-01' THEN o_orderdate END ASC NULLS LAST, o_orderdate DESC NULLS LAST, o_orderkey LIMIT 300")
def o03(t):
    up = C("o_orderdate") >= F.to_timestamp_ntz(F.lit("2001-07-01 00:00:00"))
    return t.orders.orderBy(up.desc(), F.when(up, C("o_orderdate")).asc_nulls_last(), C("o_orderdate").desc_nulls_last(), "o_orderkey").limit(300).select("o_orderkey")


@query("o04_prefix_first", "SELECT p_partkey FROM part WHERE p_type ILIKE '%st%' ORDER BY starts_with(lower(p_type), 'st') DESC, p_retailprice DESC, p_size, p_partkey LIMIT 50")
def o04(t):
    return t.part.where(C("p_type").ilike("%st%")).orderBy(F.lower("p_type").startswith("st").desc(), C("p_retailprice").desc(), "p_size", "p_partkey").limit(50).select("p_partkey")


@query("o05_stable_priority", "SELECT n_nationkey, row_number() OVER (ORDER BY n_regionkey <> 2, n_nationkey) AS place FROM nation")
def o05(t):
    return t.nation.select("n_nationkey", long(F.row_number().over(W.orderBy((C("n_regionkey") != 2), "n_nationkey"))).alias("place"))


@query("o06_champion_outranked", "SELECT p_brand, max(p_retailprice) FILTER (WHERE p_size <> 1) > max(p_retailprice) FILTER (WHERE p_size = 1) AS outranked FROM part GROUP BY 1")
def o06(t):
    champion = C("p_size") == 1
    return t.part.groupBy("p_brand").agg((F.max(F.when(~champion, C("p_retailprice"))) > F.max(F.when(champion, C("p_retailprice")))).alias("outranked"))


@query("o07_domain_order", "SELECT o_orderpriority, row_number() OVER (ORDER BY coalesce(list_position(['5-LOW', '1-URGENT'], o_orderpriority), 99), o_orderpriority) AS place FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def o07(t):
    place = F.array_position(F.array(F.lit("5-LOW"), F.lit("1-URGENT")), C("o_orderpriority"))
    order = W.orderBy(F.when(place > 0, place).otherwise(99), "o_orderpriority")
    return t.orders.select("o_orderpriority").distinct().select("o_orderpriority", long(F.row_number().over(order)).alias("place"))


@query("o08_top_both", "SELECT * FROM (SELECT 'f' AS list, p_partkey FROM part WHERE p_size <= 25 ORDER BY p_retailprice DESC, p_partkey LIMIT 15) UNION ALL SELECT * FROM (SELECT 'm' AS list, p_partkey FROM part WHERE p_size > 25 ORDER BY p_retailprice DESC, p_partkey LIMIT 15)")
def o08(t):
    d = t.part.select(F.when(C("p_size") <= 25, "f").otherwise("m").alias("list"), "p_partkey", "p_retailprice")
    return R.top_per_key(d, ["list"], [C("p_retailprice").desc(), C("p_partkey")], 15).select("list", "p_partkey")


@query("o09_capped_union", "SELECT c_custkey FROM (SELECT DISTINCT ON (c_nationkey, c_mktsegment) c_custkey, c_acctbal FROM customer ORDER BY c_nationkey, c_mktsegment, c_acctbal DESC, c_custkey) ORDER BY c_acctbal > 5000 DESC, c_custkey LIMIT 80")
def o09(t):
    d = R.latest_per_key(t.customer, ["c_nationkey", "c_mktsegment"], [C("c_acctbal").desc(), C("c_custkey")])
    return d.orderBy((C("c_acctbal") > 5000).desc(), "c_custkey").limit(80).select("c_custkey")


@query("o10_best_opponents", "SELECT l_orderkey, c_acctbal FROM (SELECT DISTINCT l_orderkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey ORDER BY c_acctbal DESC NULLS LAST, l_orderkey LIMIT 10")
def o10(t):
    d = t.lineitem.select("l_orderkey").distinct().join(t.orders, C("o_orderkey") == C("l_orderkey")).join(t.customer, C("c_custkey") == C("o_custkey"), "left")
    return d.orderBy(C("c_acctbal").desc_nulls_last(), "l_orderkey").limit(10).select("l_orderkey", "c_acctbal")


@query("o11_best_row", "SELECT c_mktsegment, arg_max(c_custkey, (c_acctbal > 9000, c_nationkey = 5, c_acctbal, -c_custkey)) AS best FROM customer GROUP BY 1")
def o11(t):
    return t.customer.groupBy("c_mktsegment").agg(F.max_by("c_custkey", F.struct(C("c_acctbal") > 9000, C("c_nationkey") == 5, "c_acctbal", -C("c_custkey"))).alias("best"))


@query("o12_single_leader", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def o12(t):
    return t.part.orderBy(C("p_retailprice").desc(), "p_partkey").limit(1).select("p_partkey")


@query("u01_tagged_union", "SELECT 'c' AS src, c_nationkey AS n, count(*) AS k FROM customer GROUP BY ALL UNION ALL SELECT 's', s_nationkey, count(*) FROM supplier GROUP BY ALL")
def u01(t):
    c = t.customer.select(F.lit("c").alias("src"), C("c_nationkey").alias("n"))
    return c.unionByName(t.supplier.select(F.lit("s").alias("src"), C("s_nationkey").alias("n"))).groupBy("src", "n").agg(F.count("*").alias("k"))


@query("u02_concat_first_seen", "SELECT 'open' AS part, o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'past', o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'O') WHERE rn = 1")
def u02(t):
    o = t.orders
    past = R.latest_per_key(o.where("o_orderstatus <> 'O'"), ["o_custkey", "o_orderpriority"], [C("o_orderdate").desc_nulls_last(), C("o_orderkey")])
    return o.where("o_orderstatus = 'O'").select(F.lit("open").alias("part"), "o_orderkey").unionByName(past.select(F.lit("past").alias("part"), "o_orderkey"))


@query("u03_sync_plan", f"SELECT coalesce(p.c_custkey, c.c_custkey) AS c_custkey, CASE WHEN p.c_custkey IS NULL THEN 'insert' WHEN c.c_custkey IS NULL THEN 'delete' WHEN p.bal IS NOT DISTINCT FROM c.bal THEN 'keep' ELSE 'update' END AS action FROM {_PREV} p FULL JOIN {_CURR} c ON p.c_custkey = c.c_custkey")
def u03(t):
    p, c = snapshots(t)
    return R.sync_plan(p, c, ["c_custkey"], ["bal"]).select("c_custkey", "action")


@query("u04_stale", f"SELECT c_custkey FROM {_PREV} WHERE bal > -900 AND c_custkey NOT IN (SELECT c_custkey FROM {_CURR})")
def u04(t):
    p, c = snapshots(t)
    return p.where("bal > -900").join(c, "c_custkey", "left_anti").select("c_custkey")


@query("u05_merge_by_date", "WITH fresh AS (SELECT * FROM orders WHERE o_totalprice > 450000) SELECT o_orderkey, false AS is_fresh FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM fresh) UNION ALL SELECT o_orderkey, true FROM fresh")
def u05(t):
    o = t.orders.withColumn("d", F.to_date("o_orderdate"))
    fresh = o.where("o_totalprice > 450000")
    return o.join(fresh.select("d").distinct(), "d", "left_anti").select("o_orderkey", F.lit(False).alias("is_fresh")).unionByName(fresh.select("o_orderkey", F.lit(True).alias("is_fresh")))


@query("u06_new_only", f"SELECT DISTINCT c_nationkey, c_mktsegment FROM {_CURR} c WHERE c_custkey NOT IN (SELECT c_custkey FROM {_PREV}) AND (c_nationkey, c_mktsegment) NOT IN (SELECT c_nationkey, c_mktsegment FROM {_PREV} WHERE bal > 9000)")
def u06(t):
    p, c = snapshots(t)
    return c.join(p, "c_custkey", "left_anti").join(p.where("bal > 9000"), ["c_nationkey", "c_mktsegment"], "left_anti").select("c_nationkey", "c_mktsegment").distinct()


@query("u07_needs_refresh", f"SELECT c_custkey, c_mktsegment FROM {_CURR} EXCEPT SELECT c_custkey, c_mktsegment FROM {_PREV}")
def u07(t):
    p, c = snapshots(t)
    return c.select("c_custkey", "c_mktsegment").distinct().join(p, ["c_custkey", "c_mktsegment"], "left_anti")


# ---- sinks as plans: the table that the sink writes

@query("s21_upsert", f"SELECT coalesce(p.c_custkey, c.c_custkey) AS c_custkey, CASE WHEN c.c_custkey IS NOT NULL THEN c.bal ELSE p.bal END AS bal FROM {_PREV} p FULL JOIN {_CURR} c ON p.c_custkey = c.c_custkey")
def s21(t):
    p, c = snapshots(t)
    return R.upsert(p.select("c_custkey", "bal"), c.select("c_custkey", "bal"), ["c_custkey"])


@query("s22_insert_ignore", f"SELECT c_custkey, bal FROM {_CURR} WHERE c_custkey NOT IN (SELECT c_custkey FROM {_PREV})")
def s22(t):
    p, c = snapshots(t)
    return R.insert_ignore(p, c, ["c_custkey"]).select("c_custkey", "bal")


@query("s23_last_wins", "SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey * 1000 + l_suppkey DESC")
def s23(t):
    return R.last_wins(t.lineitem.withColumn("at", C("l_partkey") * 1000 + C("l_suppkey")), ["l_orderkey", "l_linenumber"], "at").select("l_orderkey", "l_linenumber", "l_partkey")


@query("s24_natural_key_upsert", f"SELECT c_nationkey, c_mktsegment, coalesce((SELECT min(c_custkey) FROM {_PREV} p WHERE p.c_nationkey = c.c_nationkey AND p.c_mktsegment = c.c_mktsegment), min(c.c_custkey)) AS target FROM {_CURR} c GROUP BY c_nationkey, c_mktsegment")
def s24(t):
    p, c = snapshots(t)
    key = ["c_nationkey", "c_mktsegment"]
    have = p.groupBy(*key).agg(F.min("c_custkey").alias("old"))
    return c.groupBy(*key).agg(F.min("c_custkey").alias("new")).join(have, key, "left").select(*key, F.coalesce("old", "new").alias("target"))


@query("s25_scoped_replace", f"SELECT c_custkey, bal FROM {_PREV} WHERE c_nationkey <> 4 UNION ALL SELECT c_custkey, bal FROM {_CURR} WHERE c_nationkey = 4")
def s25(t):
    p, c = snapshots(t)
    return p.where("c_nationkey <> 4").select("c_custkey", "bal").unionByName(c.where("c_nationkey = 4").select("c_custkey", "bal"))


@query("s26_changed_only", f"SELECT c_custkey, c.bal AS bal FROM {_PREV} p JOIN {_CURR} c USING (c_custkey) WHERE p.bal IS DISTINCT FROM c.bal")
def s26(t):
    p, c = snapshots(t)
    return R.changed_only(p, c, ["c_custkey"], "bal")


@query("s27_clear_then_set", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS flag FROM customer")
def s27(t):
    big = t.orders.where("o_totalprice > 400000").select(C("o_custkey").alias("c_custkey"), F.lit(True).alias("f")).distinct()
    return t.customer.join(big, "c_custkey", "left").select("c_custkey", F.coalesce("f", F.lit(False)).alias("flag"))


@query("s28_assigned_ids", "WITH e AS (SELECT d, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY d) AS id FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS d FROM orders)) SELECT o_orderkey, id AS event_id FROM orders JOIN e ON d = date_trunc('month', o_orderdate)")
def s28(t):
    months = t.orders.select(F.date_trunc("month", "o_orderdate").alias("d"))
    ids = months.distinct().crossJoin(t.orders.agg(F.max("o_orderkey").alias("m"))).select("d", (C("m") + F.row_number().over(W.orderBy("d"))).alias("event_id"))
    return t.orders.withColumn("d", F.date_trunc("month", "o_orderdate")).join(ids, "d").select("o_orderkey", "event_id")


@query("s30_null_out", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN c_name END AS c_name FROM customer")
def s30(t):
    keep = t.orders.where("o_orderstatus = 'P'").select(C("o_custkey").alias("k")).distinct()
    return t.customer.join(keep, C("k") == C("c_custkey"), "left").select("c_custkey", F.when(C("k").isNotNull(), C("c_name")).alias("c_name"))


@query("s33_cascade_delete", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3)")
def s33(t):
    gone = t.orders.where("o_custkey % 10 = 3")
    return t.lineitem.join(gone, C("l_orderkey") == C("o_orderkey"), "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("s19_resume", "SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE url LIKE '%3%')")
def s19(t):
    done = t.pages.where("url LIKE '%3%'").select("url")
    return t.pages.join(done, "url", "left_anti").select("page_id")
