"""Pages, feeds and streams on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutline.plans.registry import query
from boutline.sources import pages
from boutline.streaming import ingest

C = F.col


@query("s05_links", """SELECT page_id, list_distinct(u).len() AS n FROM (SELECT page_id, list_transform(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>', 1), lambda h: CASE WHEN starts_with(h, 'http') THEN h WHEN starts_with(h, '/') THEN 'http://site' || h ELSE 'http://site/' || h END) AS u FROM pages)""")
def s05(t):
    return t.pages.select("page_id", F.size(pages.table_urls(C("html"), ".*", "http://site/")).cast("long").alias("n"))


@query("s05_next", """SELECT page_id, CASE WHEN len(h) > 0 THEN 'http://site' || h[1] END AS next FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a href="(/[^"]*)">[^<]*th[^<]*</a>', 1) AS h FROM pages)""")
def s05_next(t):
    return t.pages.select("page_id", pages.next_page(C("html"), "th", "http://site/").alias("next"))


@query("s04_title", "SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
def s04_title(t):
    return t.pages.select("page_id", pages.title(C("html")).alias("title"))


@query("s06_table", "SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS opponent, CASE o_orderstatus WHEN 'F' THEN 'win' ELSE 'loss' END AS result FROM orders")
def s06(t):
    row = F.concat(F.lit("<tr class='r'><td><b>"), F.when(C("o_orderstatus") == "F", "win").otherwise("loss"), F.lit("</b></td><td> "), C("o_orderkey").cast("string"), F.lit(" </td></tr>"))
    html = t.orders.groupBy("o_custkey").agg(F.concat(F.lit("<table><tr><td>x</td></tr></table><table><tr><th>Result</th><th>Opponent</th></tr>"), F.array_join(F.collect_list(row), "\n"), F.lit("</table>")).alias("html"))
    return pages.table_records(html, "html", ["Result", "Opponent"], ["result", "opponent"]).select("o_custkey", "opponent", "result")


@query("s07_x_of_y", "SELECT p_partkey, p_size AS landed, p_size + 7 AS attempted FROM part")
def s07(t):
    return t.part.select("p_partkey", pages.x_of_y(F.concat(C("p_size"), F.lit("  of "), C("p_size") + 7)).alias("s")).select("p_partkey", "s.*")


@query("s09_cm", "SELECT p_partkey, CAST(round((60 + p_size % 12) * 2.54) AS INT) AS cm FROM part")
def s09(t):
    return t.part.select("p_partkey", pages.imperial_cm(F.concat(F.lit("5' "), C("p_size") % 12, F.lit('"'))).alias("cm"))


@query("s11_times", """WITH x AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, min((event_id * 7919) % 10007 * 100000 + event_id) AS place FROM events GROUP BY ALL)
 SELECT user_id, to_timestamp(arg_min(s, place))::TIMESTAMP AS first, to_timestamp(arg_max(s, place))::TIMESTAMP AS last FROM x GROUP BY 1""")
def s11(t):
    """The times stand on the page in an order of their own, some of them twice: the first and the last of those not seen before count, not the earliest and the latest."""
    place = (C("event_id") * 7919) % 10007 * 100000 + C("event_id")
    tag = F.concat(F.lit('<div data-timestamp="'), F.unix_seconds("ts"), F.lit('"></div>'))
    html = t.events.withColumn("ts", C("ts").cast("timestamp")).groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("place"), tag.alias("tag")))), lambda x: x["tag"]), "").alias("html"))
    return html.select("user_id", pages.broadcast_times(C("html")).alias("t")).select("user_id", C("t.first").cast("timestamp_ntz").alias("first"), C("t.last").cast("timestamp_ntz").alias("last"))


@query("s13_feed", "SELECT event_id, event_type AS title, 'https://x.org/' || event_id AS url, date_trunc('second', ts) AS published_at FROM events WHERE event_type <> 'error'")
def s13(t):
    link = F.when(C("event_type") == "error", "javascript:go()").otherwise(F.concat(F.lit("https://x.org/"), "event_id"))
    xml = F.concat(F.lit("<rss><channel><item><title> "), "event_type", F.lit("</title><link>"), link, F.lit("</link><pubDate>"), F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate><description>a &lt;b&gt;c&lt;/b&gt;</description></item></channel></rss>"))
    items = pages.feed_items(t.events.select("event_id", xml.alias("xml")), "xml")
    return items.select("event_id", "title", "url", C("published_at").cast("timestamp_ntz").alias("published_at"))


@query("s14_collect", "SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS c_mktsegment, CASE WHEN count(DISTINCT c_acctbal) = 1 THEN min(c_acctbal) END AS c_acctbal FROM customer GROUP BY 1")
def s14(t):
    return pages.collected_items(t.customer, "c_nationkey", ["c_mktsegment"], ["c_acctbal"])


@query("s15_chain", "WITH r AS (SELECT p_type AS source, min(p_brand) AS target FROM part GROUP BY 1), i AS (SELECT p_brand AS page, min(p_name) AS image FROM part WHERE p_size > 25 GROUP BY 1) SELECT DISTINCT p_type AS title, target AS page, image FROM part JOIN r ON source = p_type LEFT JOIN i ON page = target")
def s15(t):
    return pages.chained_lookup(t.part, "p_type", [t.part.select(C("p_type").alias("source"), C("p_brand").alias("target"))], t.part.where("p_size > 25").select(C("p_brand").alias("page"), C("p_name").alias("image")))


@query("t01_ingest", "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'")
def t01(t):
    return ingest.run_to_table(t.spark, lambda: ingest.stream_table(t.spark, t.sf_dir, "events").where("event_type != 'error'").select("event_id", "user_id", "event_type"), "t01")


@query("t02_windows", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def t02(t):
    made = lambda: ingest.closed_windows(ingest.stream_table(t.spark, t.sf_dir, "events").withColumn("ts", C("ts").cast("timestamp")), "ts", ["event_type"], "1 day", "1 hour", {"n": F.count("*"), "cents": F.sum(F.round(C("value") * 100).cast("long"))})
    return ingest.run_to_table(t.spark, made, "t02").withColumn("window_start", C("window_start").cast("timestamp_ntz"))


@query("t02_late", "SELECT o_orderkey, CASE WHEN d >= DATE '2001-06-01' THEN 'current' WHEN d >= DATE '2001-05-02' THEN 'catch-up' ELSE 'late' END AS part FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def t02_late(t):
    return t.orders.select("o_orderkey", ingest.split_late(F.to_date("o_orderdate"), F.lit("2001-06-01").cast("date")).alias("part"))


@query("t03_greedy", """WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, ts FROM events), k AS (SELECT user_id, event_type, min((ts, event_id)) AS x FROM e GROUP BY ALL
 UNION ALL SELECT k.user_id, k.event_type, min((e.ts, e.event_id)) FROM k JOIN e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts > k.x[1] + INTERVAL 48 HOUR GROUP BY ALL) SELECT user_id, event_type, x[2] AS event_id FROM k""")
def t03(t):
    return ingest.run_to_table(t.spark, lambda: ingest.greedy_dedup_stream(ingest.stream_table(t.spark, t.sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", 48), "t03")


@query("t04_insert", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def t04(t):
    out, progress = ingest.shared_folder(t.spark, "t04"), ingest.shared_folder(t.spark, "t04-progress")
    stream = ingest.stream_table(t.spark, t.sf_dir, "events").select("user_id", "event_type", "event_id")
    for _ in range(2):  # the second run finds nothing new
        ingest.insert_available(stream, ["user_id", "event_type"], [C("event_id")], out, progress)
    return t.spark.read.schema(stream.schema).parquet(out).select("user_id", "event_type", "event_id")
