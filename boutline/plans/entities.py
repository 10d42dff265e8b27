"""Entity resolution on the driver's tables: tiered names, claims, labels that spread over a graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutline.operators import graph, matching
from boutline.plans.registry import query

C = F.col
#: Customers a task pairs with suppliers.
CLAIMANTS = 2000

# Part names are variants of a catalogue of brands: the words in another order, joined, with a suffix, with a shortened first word, or with a word more.
_LIST = "SELECT min(p_partkey) AS id, p_name AS cand FROM part GROUP BY p_name"
_ASKED = """SELECT DISTINCT n FROM (SELECT CASE p_size % 6 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) WHEN 2 THEN replace(p_name, ' ', '') WHEN 3 THEN upper(p_name) || ' Jr'
 WHEN 4 THEN left(p_name, 3) || ' ' || split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 1) || ' big ' || split_part(p_name, ' ', 2) END AS n FROM part)"""


def asked():
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    k = C("p_size") % 6
    return (
        F.when(k == 0, C("p_name")).when(k == 1, F.concat_ws(" ", second, first)).when(k == 2, F.replace("p_name", F.lit(" "), F.lit(""))).when(k == 3, F.concat(F.upper("p_name"), F.lit(" Jr")))
        .when(k == 4, F.concat_ws(" ", F.substring("p_name", 1, 3), second)).otherwise(F.concat_ws(" ", first, F.lit("big"), second))
    )


@query("j23_tiered_match", f"""WITH c AS (SELECT id, cand, string_split(cand, ' ') AS b FROM ({_LIST})), a AS (SELECT n, string_split(replace(lower(n), ' jr', ''), ' ') AS a FROM ({_ASKED})),
 m AS (SELECT n, id, CASE WHEN lower(n) = cand THEN -2 WHEN a = b THEN 0 WHEN array_to_string(a, '') = array_to_string(b, '') THEN 1 WHEN list_sort(a) = list_sort(b) THEN 2
  WHEN len(a) >= 2 AND len(b) >= 2 AND ((len(a) = 3 AND (b IN ([a[1], a[2]], [a[1], a[3]], [a[2], a[3]]))) OR (len(b) = 3 AND (a IN ([b[1], b[2]], [b[1], b[3]], [b[2], b[3]])))) THEN 3
  WHEN len(a) >= 2 AND len(a) = len(b) AND a[2:] = b[2:] AND a[1] <> b[1] AND length(a[1]) >= 3 AND length(b[1]) >= 3 AND left(a[1], 3) = left(b[1], 3) THEN 4 END AS level FROM a, c),
 f AS (SELECT n, min(level) AS level FROM m WHERE level IS NOT NULL GROUP BY 1) SELECT n AS asked, CAST(level AS INT) AS level, CASE WHEN count(*) = 1 OR level = -2 THEN min(id) END AS match FROM f JOIN m USING (n, level) GROUP BY n, level""")
def j23(t):
    names = t.part.select(asked().alias("asked"))
    return matching.tiered_match(names, t.part.groupBy("p_name").agg(F.min("p_partkey").alias("id")), "asked", "id", "p_name")


_EXACT = "SELECT DISTINCT c_custkey AS a, s_suppkey AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey AND floor(c_acctbal / 100) = floor(s_acctbal / 100)"
_FUZZY = "SELECT DISTINCT c_custkey AS a, s_suppkey AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey AND floor(c_acctbal / 500) = floor(s_acctbal / 500)"


@query("j24_claims", f"""WITH e AS ({_EXACT}), f AS (SELECT * FROM ({_FUZZY}) x WHERE b NOT IN (SELECT b FROM e) AND a NOT IN (SELECT a FROM e)) SELECT a AS c_custkey, b AS s_suppkey, 'exact' AS by FROM e
 UNION ALL SELECT min(a), b, 'fuzzy' FROM f GROUP BY b HAVING count(*) = 1""")
def j24(t):
    """Customers and suppliers without an exact claim are found by brackets, before fuzzy pairs are made: the pairs of the wide brackets that exact claims would drop are most of them.
    Pairs grow faster than the rows, so the customers are dealt out by bracket, some thousands a task."""
    tasks = max(1, -(-t.customer.count() // CLAIMANTS))
    bracket = lambda c, width: F.floor(C(c) / width).alias("bracket")
    claimants = lambda width: t.customer.select("c_custkey", C("c_nationkey").alias("nation"), bracket("c_acctbal", width))
    targets = lambda width: t.supplier.select("s_suppkey", C("s_nationkey").alias("nation"), bracket("s_acctbal", width))
    place = ["nation", "bracket"]
    pairs = lambda c, s: c.repartition(tasks, *place).join(s, place).select("c_custkey", "s_suppkey")
    held_c = claimants(100).join(targets(100).select(*place).distinct(), place, "left_semi").select("c_custkey").distinct()
    held_s = targets(100).join(claimants(100).select(*place).distinct(), place, "left_semi").select("s_suppkey").distinct()
    free = pairs(claimants(500).join(held_c, "c_custkey", "left_anti"), targets(500).join(held_s, "s_suppkey", "left_anti"))
    return matching.resolve_claims(pairs(claimants(100), targets(100)), free, "c_custkey", "s_suppkey")


def _trade(t):
    """Customers and suppliers that met in an order, as edges of one graph."""
    met = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey"))
    return met.select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))


_EDGES = "SELECT DISTINCT 'c' || o_custkey AS a, 's' || l_suppkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _hops(n: int) -> str:
    """Breadth-first hops as a chain of subqueries: what each reaches that none before it did, without a label where two met."""
    steps = [f"w AS (SELECT a, b FROM ({_EDGES}) UNION SELECT b, a FROM ({_EDGES})), h0 AS (SELECT 'c' || c_custkey AS node, c_nationkey AS label, 0 AS hops FROM customer WHERE c_nationkey IN (0, 1))"]
    for k in range(1, n + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM h{i}" for i in range(k))
        steps.append(f"h{k} AS (SELECT b AS node, CASE WHEN min(label) = max(label) THEN min(label) END AS label, {k} AS hops FROM h{k - 1} JOIN w ON a = node WHERE label IS NOT NULL AND b NOT IN ({seen}) GROUP BY b)")
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT node, label, hops FROM h{k} WHERE label IS NOT NULL" for k in range(n + 1))


@query("j25_labels", _hops(5))
def j25(t):
    seeds = t.customer.where("c_nationkey IN (0, 1)").select(F.concat(F.lit("c"), "c_custkey").alias("node"), C("c_nationkey").alias("label"))
    return graph.spread_labels(seeds, _trade(t))


_ALIKE = """SELECT 'c' || c_custkey AS a, concat_ws('-', 'x', c_nationkey, CAST(floor(c_acctbal / 50) AS BIGINT)) AS b FROM customer UNION SELECT 'c' || c_custkey, concat_ws('-', 'y', c_nationkey, c_mktsegment, CAST(floor(c_acctbal / 70) AS BIGINT)) FROM customer
 UNION SELECT 's' || s_suppkey, concat_ws('-', 'x', s_nationkey, CAST(floor(s_acctbal / 50) AS BIGINT)) FROM supplier"""


def _alike(t):
    """Customers and suppliers of a nation with balances in one bracket, as edges to the bracket."""
    step = lambda c, width: F.floor(C(c) / width).cast("long")
    c = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat_ws("-", F.lit("x"), "c_nationkey", step("c_acctbal", 50)).alias("b"))
    d = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat_ws("-", F.lit("y"), "c_nationkey", "c_mktsegment", step("c_acctbal", 70)).alias("b"))
    s = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat_ws("-", F.lit("x"), "s_nationkey", step("s_acctbal", 50)).alias("b"))
    return c.unionByName(d).unionByName(s)


@query("j25_components", f"""WITH RECURSIVE e AS ({_ALIKE}), w AS (SELECT * FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT a AS node, a AS component FROM w UNION SELECT w.b, r.component FROM r JOIN w ON w.a = r.node)
 SELECT node, min(component) AS component FROM r GROUP BY node""")
def j25_components(t):
    return graph.components(_alike(t))
