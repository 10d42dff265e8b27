"""Sinks, scraped records, page expressions, folds, searches and the weekly batch on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutline.functions.bouts import sigmoid
from boutline.operators import models, replay, sequence, weekly
from boutline.plans import replays
from boutline.plans.models import odds
from boutline.plans.registry import query
from boutline.sources import pages, sinks, tables
from boutline.streaming import ingest

C = F.col


def folder(t, name: str) -> str:
    return ingest.shared_folder(t.spark, name)


# ---- scans and sinks

_ORG = "c_custkey BIGINT, c_name STRING, c_mktsegment STRING"


@query("s02_json", "SELECT CAST(c_nationkey AS INT) AS org, c_custkey, c_name, c_mktsegment FROM customer")
def s02(t):
    out = folder(t, "s02")
    t.customer.select(C("c_nationkey").cast("int").alias("org"), "c_custkey", "c_name", "c_mktsegment").write.partitionBy("org").json(out)
    return tables.read_json(t.spark, out, f"org INT, {_ORG}", multiline=False)


@query("s03_missing", "SELECT 'customer' AS part, count(*) AS n FROM customer UNION ALL SELECT 'missing', 0")
def s03(t):
    none = tables.read_json(t.spark, folder(t, "s03"), _ORG)
    count = lambda d, name: d.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count(t.customer, "customer").unionByName(count(none, "missing"))


@query("s20_scraped", """SELECT o_orderkey, a <> 'not_finished' OR b <> 'not_finished' AS fight_finished, CASE WHEN a = 'win' THEN 'c' || o_custkey WHEN b = 'win' THEN 'd' || o_custkey END AS winner_name, day(o_orderdate) || '-' || month(o_orderdate) || '-0' AS record
 FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' ELSE 'not_finished' END AS a, CASE o_orderstatus WHEN 'F' THEN 'loss' WHEN 'O' THEN CASE WHEN o_orderpriority < '3' THEN 'win' ELSE 'draw' END ELSE 'not_finished' END AS b FROM orders)""")
def s20(t):
    status = C("o_orderstatus")
    d = t.orders.select(
        "o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("first"), F.concat(F.lit("d"), "o_custkey").alias("second"), F.when(status == "F", "win").when(status == "O", "loss").otherwise("not_finished").alias("a"),
        F.when(status == "F", "loss").when(status == "O", F.when(C("o_orderpriority") < "3", "win").otherwise("draw")).otherwise("not_finished").alias("b"), F.dayofmonth("o_orderdate").alias("w"), F.month("o_orderdate").alias("l"),
    )
    finished, winner = pages.scraped_result(C("first"), C("a"), C("second"), C("b"))
    return d.select("o_orderkey", finished.alias("fight_finished"), winner.alias("winner_name"), pages.record_string(C("w"), C("l"), F.lit(0)).alias("record"))


@query("s29_backup", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def s29(t):
    out = folder(t, "s29")
    sinks.backup_once(t.customer.where("c_acctbal > 0").select("c_custkey", "c_acctbal"), out)
    return sinks.backup_once(t.customer.select("c_custkey", (C("c_acctbal") * 0).alias("c_acctbal")), out)  # the first one stays


_WEIGHTS = {"features": ["value", "k"], "weights": [0.8, -0.3], "bias": 0.25, "means": [50.0, 3.0], "scales": [30.0, 2.0]}


@query("s31_model", "SELECT event_id, round(1 / (1 + exp(-(0.25 + 0.8 * (value - 50) / 30 - 0.3 * (event_id % 7 - 3) / 2.0))), 6) AS p FROM events")
def s31(t):
    out = folder(t, "s31")
    sinks.save_model(t.spark, out, _WEIGHTS)
    kept = sinks.load_model(t.spark, out, ["value", "k"])
    model = models.Logistic(tuple(kept["features"]), tuple(kept["weights"]), kept["bias"], tuple(kept["means"]), tuple(kept["scales"]))
    return t.events.withColumn("k", C("event_id") % 7).select("event_id", F.round(model.predict(), 6).alias("p"))


@query("s32_dry_run", "SELECT c_nationkey, count(*) AS n, CASE WHEN count(*) > 5 THEN max(c_name) END AS last FROM customer GROUP BY 1")
def s32(t):
    n = F.count("*")
    return sinks.dry_run(t.customer.groupBy("c_nationkey").agg(n.alias("n"), F.when(n > 5, F.max("c_name")).alias("last")), folder(t, "s32"))


@query("s34_cache", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def s34(t):
    out = folder(t, "s34")
    t.orders.select("o_custkey").limit(1).write.parquet(out)  # an older form, without the count
    make = lambda: t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    sinks.cached(t.spark, out, make)
    return sinks.cached(t.spark, out, lambda: make().where("n < 0"))  # what is there is valid, so nothing is made


# ---- pages

@query("s08_bonuses", "SELECT p_partkey, p_size % 2 = 0 AS fight, p_size % 3 = 0 AS performance FROM part")
def s08(t):
    icon = lambda test, tag: F.when(test, tag).otherwise("")
    html = F.concat(icon(C("p_size") % 2 == 0, '<img src="/i/fight.png">'), F.lit('<img src="x.png">'), icon(C("p_size") % 3 == 0, '<IMG alt="" src="https://h/i/perf.png">'))
    return t.part.select("p_partkey", pages.bonuses(html).alias("b")).select("p_partkey", "b.*")


@query("s10_rankings", """SELECT s_nationkey, caption, CAST(row_number() OVER (PARTITION BY s_nationkey, caption ORDER BY s_acctbal DESC, s_name) - CASE caption WHEN 'Pound-for-pound' THEN 0 ELSE 1 END AS INT) AS rank, s_name AS name
 FROM supplier, (VALUES ('Light'), ('Pound-for-pound')) v(caption)""")
def s10(t):
    row = F.concat(F.lit("<tr><td><a href='/x'> "), "s_name", F.lit("</a></td></tr>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-C("s_acctbal")).alias("k"), "s_name", row.alias("row")))), lambda x: x["row"]), "\n")
    table = lambda caption: F.concat(F.lit(f"<table class='r'><caption>{caption}</caption>"), "rows", F.lit("</table>"))
    html = t.supplier.groupBy("s_nationkey").agg(rows.alias("rows")).select("s_nationkey", F.concat(table("Light"), table("Pound-for-pound"), table("Light")).alias("html"))
    return pages.ranking_lists(html, "s_nationkey", "html")


@query("s12_paths", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'card-' || o_orderkey ELSE 'card-fight-night-' || lower(strftime(o_orderdate, '%B-%d-%Y')) END AS path FROM orders")
def s12(t):
    name = F.when(C("o_orderstatus") == "F", F.concat(F.lit("Card "), "o_orderkey", F.lit(": a vs. b"))).otherwise("Card Night")
    return t.orders.select("o_orderkey", pages.event_path(name, C("o_orderdate"), "Card").alias("path"))


@query("s13_atom", "SELECT event_id, event_type AS title, 'https://x.org/' || event_id AS url, date_trunc('second', ts) AS published_at, 'a c' AS excerpt FROM events WHERE event_type <> 'error'")
def s13_atom(t):
    link = F.when(C("event_type") == "error", "ftp://x.org/1").otherwise(F.concat(F.lit("https://x.org/"), "event_id"))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    xml = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>all</title><entry><title type="html"> '), "event_type", F.lit('</title><link rel="self" href="/me"/><link rel="alternate" type="text/html" href="'), link,
        F.lit('"/><published>'), at, F.lit("Z</published><updated>2030-01-01T00:00:00Z</updated><summary>a &lt;b&gt;c&lt;/b&gt;</summary><content>whole</content></entry></feed>"),
    )
    items = pages.atom_items(t.events.select("event_id", xml.alias("xml")), "xml")
    return items.select("event_id", "title", "url", C("published_at").cast("timestamp_ntz").alias("published_at"), "excerpt")


@query("s16_photos", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'o' || p_partkey WHEN p_size % 3 = 0 THEN 'p' || p_partkey WHEN p_size % 2 = 0 THEN 'fr' ELSE 'en' END AS photo FROM part")
def s16(t):
    named = lambda k, name: F.when(C("p_size") % k == 0, F.concat(F.lit(name), "p_partkey"))
    pages_of = F.map_from_arrays(F.when(C("p_size") % 2 == 0, F.array(F.lit("en"), F.lit("fr"))).otherwise(F.array(F.lit("en"))), F.when(C("p_size") % 2 == 0, F.array(F.lit("en"), F.lit("fr"))).otherwise(F.array(F.lit("en"))))
    return t.part.select("p_partkey", pages.chosen_photo(named(5, "o"), named(3, "p"), pages_of, ["fr", "en"]).alias("photo"))


@query("s17_flags", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'SC' END AS country FROM part")
def s17(t):
    code = F.when(C("p_size") % 3 == 0, "us").when(C("p_size") % 3 == 1, "sct").otherwise("eng")
    return t.part.select("p_partkey", pages.flag_country(F.concat(F.lit("/flags/"), code, F.lit(".png"))).alias("country"))


@query("s35_bad_sources", "SELECT event_id, event_type AS title FROM events WHERE event_type <> 'error'")
def s35(t):
    xml = F.concat(F.lit("<rss><channel><item><title>"), "event_type", F.lit("</title><link>http://x/1</link><pubDate>2024-01-02T03:04:05Z</pubDate></item></channel></rss>"))
    cut = F.when(C("event_type") == "error", F.substring(xml, 1, 40)).otherwise(xml)
    return pages.feed_items(t.events.select("event_id", cut.alias("xml")), "xml").select("event_id", "title")


@query("s35_report", """SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 0 ELSE 1 END AS items, CASE WHEN event_type = 'click' THEN 0 WHEN event_type = 'error' THEN 0 ELSE event_id % 2 END AS dropped, CASE event_type WHEN 'error' THEN 'malformed feed' WHEN 'click' THEN 'empty feed' END AS error FROM events""")
def s35_report(t):
    """A row for each source: how many items it gave, how many were dropped, and its error."""
    item = lambda link: F.concat(F.lit("<item><title>"), "event_type", F.lit(f"</title><link>{link}</link><pubDate>2024-01-02T03:04:05Z</pubDate></item>"))
    xml = F.concat(F.lit("<rss><channel>"), item("http://x/1"), F.when(C("event_id") % 2 == 1, item("javascript:go()")).otherwise(""), F.lit("</channel></rss>"))
    feed = F.when(C("event_type") == "error", F.substring(xml, 1, 40)).when(C("event_type") == "click", " ").otherwise(xml)
    items, report = pages.feeds(t.events.select("event_id", feed.alias("xml")), "xml")
    return report.select("event_id", "items", C("dropped").cast("long").alias("dropped"), "error")


# ---- folds, dedup, searches

@query("r09_fold", "SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, list(value ORDER BY ts, event_id)), lambda s, x: s * 0.5 + x), 6) AS state FROM events GROUP BY 1")
def r09(t):
    return sequence.fold(t.events, "user_id", ["ts", "event_id"], "value", 0.0, lambda s, x: s * 0.5 + x).select("user_id", F.round("state", 6).alias("state"))


@query("r15_greedy", """WITH RECURSIVE k AS (SELECT user_id, event_type, min((ts, event_id)) AS x FROM events GROUP BY ALL
 UNION ALL SELECT k.user_id, k.event_type, min((e.ts, e.event_id)) FROM k JOIN events e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts > k.x[1] + INTERVAL 48 HOUR GROUP BY ALL) SELECT user_id, event_type, x[2] AS event_id FROM k""")
def r15(t):
    return sequence.greedy_dedup(t.events, ["user_id", "event_type"], "ts", "event_id", 48)


@query("m11_search", "SELECT CAST(arg_min(k, (loss, k)) AS DOUBLE) AS best FROM (SELECT k, avg(abs(value - k)) AS loss FROM events, range(0, 201) r(k) GROUP BY k)")
def m11(t):
    def losses(choices):
        """All choices of a step in one aggregation."""
        found = models.grid_losses(t.events, {at["k"]: F.avg(F.abs(C("value") - at["k"])) for at in choices})
        by = {r["parameter"]: r["loss"] for r in found.collect()}
        return [by[float(at["k"])] for at in choices]

    best, _, _ = models.pattern_search(losses, {"k": 100.0}, {"k": models.Range(0, 200, 32, whole=True)}, refinements=6, gain=0.0, many=True)
    return t.spark.createDataFrame([(float(best["k"]),)], "best double")


@query("m14_grid", "SELECT CAST(k AS DOUBLE) AS scale, round(avg(-ln(greatest(1e-12, CASE WHEN y THEN p ELSE 1 - p END))), 6) AS loss FROM (SELECT k, event_type IN ('purchase', 'signup') AS y, 1 / (1 + exp(-(value - 50) / k)) AS p FROM events, range(29, 36) r(k)) GROUP BY 1")
def m14(t):
    d = odds(t)
    losses = {float(k): models.metrics(sigmoid((C("value") - 50) / k), C("y"))[0] for k in range(29, 36)}
    return models.grid_losses(d, losses).select(C("parameter").alias("scale"), F.round("loss", 6).alias("loss"))


# ---- progress

@query("t05_resume", "SELECT c_custkey, c_name FROM customer")
def t05(t):
    source, out, progress = folder(t, "t05-in"), folder(t, "t05"), folder(t, "t05-progress")
    half = F.pmod(F.xxhash64("c_custkey"), F.lit(2)) == 0
    for part in (half, ~half):  # the second call goes on where the first one stopped
        t.customer.where(part).select("c_custkey", "c_name").write.mode("append").parquet(source)
        stream = t.spark.readStream.schema("c_custkey BIGINT, c_name STRING").parquet(source)
        ingest.append_available(stream, out, progress)
    return t.spark.read.schema("c_custkey BIGINT, c_name STRING").parquet(out)


# ---- the batch

_EXACT = replays._CAREER
for _c in ("rwa", "rla", "dwa", "dla"):
    _EXACT = _EXACT.replace(f"round({_c}, 4)", _c)
_STATES = f"""c AS (SELECT x.*, o_custkey AS k, CAST(o_orderdate AS DATE) AS d FROM ({_EXACT}) x JOIN orders ON o_orderkey = bout_id),
 s AS (SELECT k, participant, arg_max(rating, (d, kind, bout_id)) AS rating, arg_max(rating - 2 * rd, (d, kind, bout_id)) AS con, max(d) >= DATE '2001-06-01' - 547 AS idle_ok FROM c GROUP BY ALL)"""
_WEEKLY = f"""WITH {_STATES}, r AS (SELECT *, coalesce(max(con) FILTER (WHERE idle_ok) OVER (PARTITION BY k), max(con) OVER (PARTITION BY k)) AS ref FROM s), g AS (SELECT *, least(100, 200 / (1 + pow(10, (ref - con) / 400))) AS score FROM r)
 SELECT k AS o_custkey, participant, round(rating, 2) AS rating, idle_ok AS eligible, round(CASE WHEN idle_ok THEN score ELSE least(score, 99.9) END, 2) AS display_score FROM g"""


@query("r12_weekly", _WEEKLY)
def r12(t):
    made = weekly.run(t.spark, replays.bouts(t), "o_custkey", folder(t, "r12"), today=F.lit("2001-06-01").cast("date"))
    return made["ratings"].select("o_custkey", "participant", F.round("rating", 2).alias("rating"), "eligible", F.round("display_score", 2).alias("display_score"))


@query("r12_pound_for_pound", f"""WITH {_STATES}, e AS (SELECT *, k % 2 AS g, participant = 1 AS champion, idle_ok OR participant = 1 AS eligible FROM s), r AS (SELECT *, least(100, 200 / (1 + pow(10, (coalesce(max(con) FILTER (WHERE eligible) OVER (PARTITION BY g), max(con) OVER (PARTITION BY g)) - con) / 400))) AS score FROM e),
 t AS (SELECT *, max(CASE WHEN champion THEN score END) OVER (PARTITION BY k) AS top FROM r), o AS (SELECT *, coalesce(NOT champion AND eligible AND score >= top, false) AS above FROM t)
 SELECT k AS o_custkey, participant, eligible, round(CASE WHEN above THEN greatest(0, top - 0.1 * row_number() OVER (PARTITION BY k, above ORDER BY score DESC, participant)) ELSE score END, 3) AS p4p_score FROM o""")
def r12_p4p(t):
    """Leagues are divisions of two scales; the first of a league's five is its champion."""
    champion = C("participant") == 1
    table = weekly.ratings(replay.careers(replays.bouts(t), "o_custkey"), "o_custkey", F.lit("2001-06-01").cast("date"), champion=champion).withColumn("scale", C("o_custkey") % 2)
    scored = weekly.pound_for_pound(table, "scale", "o_custkey", champion, "participant")
    return scored.select("o_custkey", "participant", "eligible", F.round("p4p_score", 3).alias("p4p_score"))
