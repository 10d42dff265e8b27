"""The scalar function library on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boutline.functions import bouts, dates, linked, prng, text
from boutline.plans.registry import query

C = F.col


def _listed(cases: list, key: str) -> str:
    """SQL: the case of a row's key, from a list of literals."""
    spelt = ", ".join("NULL" if c is None else str(c).lower() if isinstance(c, bool) else str(c) if isinstance(c, int) else "'" + c.replace("'", "''") + "'" for c in cases)
    return f"([{spelt}])[{key} % {len(cases)} + 1]"


def _case(cases: list, key: str):
    """The same as a Column."""
    return F.get(F.array(*(F.lit(c) for c in cases)), (C(key) % len(cases)).cast("int"))


# DuckDB's own strip_accents does what the table of the operator does; the letters without a decomposition are listed.
_PLAIN = "translate(strip_accents(text), 'łŁøØđĐðÐı', 'lLoOdDdDi')"
_SLUG = f"trim(regexp_replace(lower(regexp_replace({_PLAIN}, '[''‘’`´]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-')"
_NAME = f"trim(regexp_replace(regexp_replace(lower({_PLAIN}), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query("f01_slug", f"SELECT doc_id, {_SLUG} AS slug FROM documents")
def f01(t):
    return t.documents.select("doc_id", text.slugify(C("text")).alias("slug"))


@query("f02_href", "SELECT p_partkey, '/part/' || CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE lower(replace(p_type, ' ', '-')) END AS href FROM part")
def f02(t):
    name = F.when(C("p_partkey") % 2 == 0, C("p_partkey").cast("string")).otherwise(C("p_type"))
    return t.part.select("p_partkey", text.href("part", name, C("p_partkey")).alias("href"))


@query("f03_slug_lookup", f"SELECT doc_id FROM documents WHERE text LIKE '%the%and%' AND {_SLUG} LIKE '%-the-%'")
def f03(t):
    return t.documents.where(C("text").like("%the%and%") & text.slugify(C("text")).contains("-the-")).select("doc_id")


@query("f04_name", f"SELECT doc_id, {_NAME} AS name FROM documents")
def f04(t):
    return t.documents.select("doc_id", text.normalize_name(C("text")).alias("name"))


NAMES = {"St-Pierre Georges": "saint pierre georges", "Cortes\u2011Acosta  Jr.": "cortes acosta", "José Aldo III": "jose aldo", "Ó\u2013Malley\u2010Smith sr": "o malley smith", "Łukasz d'Arc": "lukasz darc", "IV": ""}


@query("f05_name_words", f"SELECT c_custkey, {_listed(list(NAMES.values()), 'c_custkey')} AS words FROM customer")
def f05(t):
    return t.customer.select("c_custkey", F.array_join(text.name_words(_case(list(NAMES), "c_custkey")), " ").alias("words"))


@query("f06_match_levels", """WITH w AS (SELECT DISTINCT p_type || ' ' || p_name AS name FROM part), v AS (SELECT name, string_split(lower(name), ' ') AS w FROM w)
 SELECT a.name AS a, b.name AS b, CASE WHEN a.w = b.w THEN 0 WHEN list_sort(a.w) = list_sort(b.w) THEN 2 WHEN a.w[2:] = b.w[2:] AND a.w[1] <> b.w[1] AND left(a.w[1], 3) = left(b.w[1], 3) THEN 4 END AS level FROM v a JOIN v b ON list_sort(a.w)[-1] = list_sort(b.w)[-1]""")
def f06(t):
    p = t.part.select(F.concat_ws(" ", "p_type", "p_name").alias("name")).distinct().withColumn("w", text.name_words(C("name")))
    a, b = p.alias("x"), p.alias("y")
    key = lambda s: F.array_max(f"{s}.w")
    return a.join(b, key("x") == key("y")).select(C("x.name").alias("a"), C("y.name").alias("b"), text.name_level(C("x.w"), C("y.w")).alias("level"))


_RINGS = ["Jacaré Souza", "SHARA  Magomedov", "Mizuki", "Patrício Pitbull", "No Alias", ""]


@query("f07_aliases", f"SELECT c_custkey, {_listed(['ronaldo souza', 'sharabutdin magomedov', 'mizuki inoue', 'patricio freire', 'no alias', ''], 'c_custkey')} AS name FROM customer")
def f07(t):
    return t.customer.select("c_custkey", text.alias(_case(_RINGS, "c_custkey")).alias("name"))


@query("f08_title", r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM documents")
def f08(t):
    return t.documents.select("doc_id", text.normalize_title(C("text")).alias("title"))


@query("f09_truncate", r"SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(left(text, 120), '\s+\S*$', '') || '…' END AS cut FROM documents")
def f09(t):
    return t.documents.select("doc_id", text.truncate_words(C("text"), 120).alias("cut"))


EVENT_NAMES = {
    "Grand Fighting League - GFL Tampa: One vs. Two": "GFL Tampa: One vs. Two", "One Series - One Friday 168": "One Friday 168", "Org - Night": "Night", "CW 209 - Cage Night 209: Newcastle": "Cage Night 209: Newcastle", "CW 158\t - Cage Night 158: Rome": "Cage Night 158: Rome",
    "GFL 331 - One vs. Two 2": "GFL 331 - One vs. Two 2", "ACB 90 - Moscow": "ACB 90 - Moscow", "Champions Series London - One vs. Two": "Champions Series London - One vs. Two", "GFL 37.5 - As Real": "GFL 37.5 - As Real", "CW 20 - Night 209": "CW 20 - Night 209",
    "  Plain   name ": "Plain name", "Org - One vs. Two: Again": "Org - One vs. Two: Again",
}


@query("f10_event_name", f"SELECT o_orderkey, {_listed(list(EVENT_NAMES.values()), 'o_orderkey')} AS name FROM orders")
def f10(t):
    return t.orders.select("o_orderkey", text.display_event_name(_case(list(EVENT_NAMES), "o_orderkey")).alias("name"))


@query("f11_french", "SELECT o_orderkey, day(o_orderdate) || ' ' || ['janvier', 'février', 'mars', 'avril', 'mai', 'juin', 'juillet', 'août', 'septembre', 'octobre', 'novembre', 'décembre'][month(o_orderdate)] || ' ' || year(o_orderdate) AS d FROM orders")
def f11(t):
    return t.orders.select("o_orderkey", dates.french_date(C("o_orderdate")).alias("d"))


@query("f12_iso_prefix", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS d FROM events")
def f12(t):
    raw = F.when(C("event_id") % 9 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm"))
    return t.events.select("event_id", dates.normalize_date(raw).alias("d"))


@query("f13_long_date", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS d FROM events")
def f13(t):
    k = C("event_id") % 9
    raw = F.when(k == 0, "TBA").when(k < 3, F.date_format("ts", "MMM / d / yyyy")).when(k < 6, F.date_format("ts", "MMMM d, yyyy")).otherwise(F.date_format("ts", "MMM d, yyyy"))
    return t.events.select("event_id", dates.long_date(raw).alias("d"))


@query("f14_week_start", "SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS d FROM orders")
def f14(t):
    return t.orders.select("o_orderkey", dates.week_start(C("o_orderdate")).alias("d"))


@query("f15_by_week", "SELECT CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS sunday, count(*) AS n FROM orders GROUP BY 1")
def f15(t):
    return t.orders.groupBy(dates.week_end(C("o_orderdate")).alias("sunday")).agg(F.count("*").alias("n"))


@query("f16_next_event", "SELECT coalesce((SELECT min(o_orderkey) FROM orders WHERE o_orderdate = (SELECT min(o_orderdate) FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-01')), -1) AS o_orderkey")
def f16(t):
    at = F.to_timestamp_ntz(F.lit("1999-06-01 00:00:00"))
    first = t.orders.groupBy("o_orderdate").agg(F.min("o_orderkey").alias("o_orderkey"))
    return dates.next_event(first, C("o_orderdate"), at).select("o_orderkey")


@query("f16_by_customer", """WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), n AS (SELECT o_custkey, (SELECT x.o_orderkey FROM o x WHERE x.o_custkey = o.o_custkey AND x.d >= DATE '2000-06-01' ORDER BY x.d, x.o_orderkey LIMIT 1) AS a, count(*) AS events, arg_max(o_orderkey, (d, o_orderkey)) AS z FROM o GROUP BY o_custkey)
 SELECT o_custkey, coalesce(a, z) AS o_orderkey, a IS NOT NULL AS is_upcoming, events FROM n""")
def f16_by(t):
    d = t.orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    found = dates.next_events_by(d, "o_custkey", "day", "o_orderkey", F.lit("2000-06-01").cast("date"))
    return found.select("o_custkey", "event.o_orderkey", "is_upcoming", "events")


@query("f16_home", """WITH o AS (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS first, CAST(o_orderdate AS DATE) AS d FROM orders), x AS (VALUES (DATE '1999-06-01'), (DATE '2001-07-30'), (DATE '2050-01-01'))
 SELECT day, coalesce((SELECT o_orderkey FROM o WHERE first AND d >= day ORDER BY d, o_orderkey LIMIT 1), (SELECT o_orderkey FROM o WHERE d >= day ORDER BY d, o_orderkey LIMIT 1), (SELECT o_orderkey FROM o WHERE d < day ORDER BY d DESC, o_orderkey DESC LIMIT 1)) AS o_orderkey, EXISTS (SELECT 1 FROM o WHERE d >= day) AS is_upcoming FROM x v(day)""")
def f16_home(t):
    """On three days: with urgent orders to come, perhaps none, and no order at all to come."""
    d = t.orders.select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"))
    one = lambda at: dates.next_event_for_home(d, C("o_orderpriority") == "1-URGENT", "day", "o_orderkey", at).select(at.alias("day"), "event.o_orderkey", "is_upcoming")
    first, second, third = (one(F.lit(day).cast("date")) for day in ("1999-06-01", "2001-07-30", "2050-01-01"))
    return first.unionByName(second).unionByName(third)


@query("f17_live_dates", "SELECT event_id, CAST(ts AS DATE) < DATE '2024-01-20' AND date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') <= 10 AS recent, date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') > 10 AS missed, CASE WHEN hour(ts) < 12 THEN 2 ELSE 1 END AS live FROM events")
def f17(t):
    day, today = F.to_date("ts"), F.to_date(F.lit("2024-01-20"))
    return t.events.select("event_id", dates.recent_past(day, today, 10).alias("recent"), dates.missed_past(day, today, 10).alias("missed"), F.size(dates.live_dates(C("ts"))).alias("live"))


@query("f18_months", "SELECT o_orderkey, round(greatest(0, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') / 30.44), 4) AS months FROM orders")
def f18(t):
    return t.orders.select("o_orderkey", F.round(dates.months_between(F.to_date("o_orderdate"), F.to_date(F.lit("2000-01-01"))), 4).alias("months"))


@query("f19_ages", "SELECT o_orderkey, round(date_diff('day', o_orderdate, TIMESTAMP '2024-06-30') / 365.25, 2) AS age, CAST(date_sub('year', CAST(o_orderdate AS DATE), DATE '2024-06-30') AS BIGINT) AS birthdays FROM orders")
def f19(t):
    d, at = F.to_date("o_orderdate"), F.to_date(F.lit("2024-06-30"))
    return t.orders.select("o_orderkey", dates.age_years(d, at).alias("age"), dates.calendar_age(d, at).alias("birthdays"))


@query("f20_durations", "SELECT event_id, round(CASE k WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE 5 * r + k + s / 60 END, 4) AS a, round(CASE k WHEN 0 THEN 5 * r + 5 WHEN 1 THEN 5 * r + 5 ELSE greatest(0.5, 5 * r + k + s / 60) END, 4) AS b, CAST(CASE WHEN k < 2 THEN NULL ELSE 300 * r + 60 * k + s END AS DOUBLE) AS d FROM (SELECT event_id, event_id % 5 AS k, event_id % 3 AS r, event_id % 60 AS s FROM events)")
def f20(t):
    k, r = C("event_id") % 5, C("event_id") % 3 + 1
    clock = F.when(k == 0, None).when(k == 1, "bad").otherwise(F.concat(k.cast("string"), F.lit(":"), F.lpad((C("event_id") % 60).cast("string"), 2, "0")))
    return t.events.select("event_id", F.round(F.coalesce(dates.minutes_fought(r, clock), F.lit(0.0)), 4).alias("a"), F.round(dates.fight_minutes(r, clock), 4).alias("b"), dates.fight_seconds(r, clock).alias("d"))


# label: by category, by corner, of a clean result
METHODS = {
    "KO (Punch)": ("ko_tko", "ko", "ko"), "KO/TKO": ("ko_tko", "ko", "ko"), "tko (doctor stoppage)": ("ko_tko", "ko", "ko"), " TKO - Doctor's Stoppage": ("ko_tko", "ko", "ko"), "Submission (Armbar)": ("submission", "sub", "sub"), "Submision (Choke)": ("submission", "other", None),
    "Technical Submission (Kimura)": ("submission", "other", "sub"), "Decision (Split)": ("decision", "dec", "dec"), "DECISION - UNANIMOUS": ("decision", "dec", "dec"), "Technical Decision (Majority)": ("decision", "other", "dec"), "Disqualification": ("other", "other", None), "No Contest (Overturned)": ("other", "other", None),
    "Draw (Majority)": ("other", "other", None), "Technical Draw": ("other", "other", None), "": ("other", "other", None), "Could Not Continue": ("other", "other", None),
}
_METHOD_SQL = ", ".join(f"{_listed([v[k] for v in METHODS.values()], 'event_id')} AS {name}" for k, name in enumerate("abc"))


@query("f21_methods", f"SELECT event_id, {_METHOD_SQL} FROM events")
def f21(t):
    m = _case(list(METHODS), "event_id")
    return t.events.select("event_id", bouts.method_category(m).alias("a"), bouts.corner_method(m).alias("b"), bouts.classify_method(m).alias("c"))


LABELS = ["Lightweight", " interim  Lightweight ", "Strawweight", "Women's Strawweight", "Interim Women's Flyweight", "Catch Weight", "157lb Catchweight", "lightweight", "Atomweight", "Super Heavyweight", None]


@query("f22_weight_class", f"SELECT event_id, {_listed(['Lightweight', 'Lightweight', None, chr(87) + 'omen' + chr(39) + 's Strawweight', chr(87) + 'omen' + chr(39) + 's Flyweight', None, None, None, None, None, None], 'event_id')} AS c FROM events")
def f22(t):
    return t.events.select("event_id", bouts.weight_class(_case(LABELS, "event_id")).alias("c"))


# label: shown for a women's bout, in result lists
SHOWN = {
    "Flyweight": ("Women's Flyweight", "Flyweight"), "Lightweight": ("Women's Lightweight", "Lightweight"), "Welterweight": ("Women's Welterweight", "Welterweight"), "Middleweight": ("Middleweight", "Middleweight"), "Women's Flyweight": ("Women's Flyweight", "Women's Flyweight"),
    "125lb Catchweight": ("125lb Catchweight", None), "Atomweight": ("Women's Atomweight", "Atomweight"), "Women's Welterweight": ("Women's Welterweight", "Women's Welterweight"), "Women's Middleweight": ("Women's Middleweight", None), " Heavyweight ": (" Heavyweight ", "Heavyweight"), "": ("", None),
}


@query("f23_display_class", f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN {_listed([v[0] for v in SHOWN.values()], 'event_id')} ELSE {_listed(list(SHOWN), 'event_id')} END AS c, {_listed([v[1] for v in SHOWN.values()], 'event_id')} AS listed FROM events")
def f23(t):
    label, women = _case(list(SHOWN), "event_id"), F.when(C("event_id") % 3 == 0, True).when(C("event_id") % 3 == 1, False)
    return t.events.select("event_id", bouts.display_weight_class(label, women).alias("c"), bouts.results_division(label).alias("listed"))


# label: division of a men's bout, of a women's bout
RESULT_LABELS = {
    "157lb Catchweight": ("Lightweight", "Women's Featherweight"), "150LB catch weight": ("Featherweight", "Women's Featherweight"), "500lb Catchweight": ("Heavyweight", "Women's Featherweight"), "about 157lb Catchweight": (None, None), "57lb Catchweight": (None, None), "Bantamweight": ("Bantamweight", "Women's Bantamweight"),
    "Women's Bantamweight": ("Women's Bantamweight", "Women's Bantamweight"), "Strawweight": (None, "Women's Strawweight"), "Catchweight": (None, None), "": (None, None), " 120 lb  Catchweight ": ("Flyweight", "Women's Strawweight"),
}


@query("f24_result_division", f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN {_listed([v[1] for v in RESULT_LABELS.values()], 'event_id')} ELSE {_listed([v[0] for v in RESULT_LABELS.values()], 'event_id')} END AS division FROM events")
def f24_result(t):
    return t.events.select("event_id", bouts.results_only_division(_case(list(RESULT_LABELS), "event_id"), C("event_id") % 2 == 0).alias("division"))


@query("f24_catchweight", """WITH d AS (SELECT * FROM (VALUES ('Flyweight', 125, 0), ('Bantamweight', 135, 1), ('Featherweight', 145, 2), ('Lightweight', 155, 3), ('Welterweight', 170, 4), ('Middleweight', 185, 5), ('Light Heavyweight', 205, 6), ('Heavyweight', 265, 7)) v(name, lb, k))
SELECT event_id, (SELECT arg_min(name, (abs(lb - 110 - event_id % 160), k)) FROM d) AS division FROM events""")
def f24(t):
    label = F.concat((C("event_id") % 160 + 110).cast("string"), F.lit("lb Catchweight"))
    return t.events.select("event_id", bouts.nearest_division(label, F.lit(False)).alias("division"))


@query("f25_rounds", "SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 5 ELSE 3 END AS rounds FROM events")
def f25(t):
    return t.events.select("event_id", bouts.scheduled_rounds(C("event_id") % 3 == 0, C("event_id") % 5 == 0).alias("rounds"))


@query("f26_score_pick", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 10 + CASE WHEN event_id % 3 = 0 THEN 5 + CASE WHEN event_id % 5 = 0 THEN 5 ELSE 0 END ELSE 0 END ELSE 0 END AS points FROM events")
def f26(t):
    e = C("event_id")
    return t.events.select("event_id", bouts.score_pick(e % 2, F.when(e % 3 == 0, "ko_tko").otherwise("decision"), e % 5, F.lit(0), F.lit("ko_tko"), F.lit(0)).alias("points"))


@query("f27_locked", "SELECT event_id, TIMESTAMP '2024-01-15 12:00:00' >= CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 2 HOUR WHEN event_id % 3 = 1 THEN ts ELSE date_trunc('day', ts) END AS locked FROM events")
def f27(t):
    ts, k = C("ts").cast("timestamp"), C("event_id") % 3
    now = F.to_timestamp(F.lit("2024-01-15 12:00:00"))
    return t.events.select("event_id", bouts.is_locked(now, F.when(k == 0, ts - F.expr("INTERVAL 2 HOURS")), F.when(k == 1, ts), F.to_date(ts)).alias("locked"))


# method, round, scheduled rounds, locked, fault, kept round
PICKS = [
    ("ko_tko", 1, 3, False, None, 1), ("ko_tko", None, 3, False, "round", None), ("submission", 5, 3, False, "round", 5), ("submission", 5, 5, False, None, 5), ("submission", 0, 5, False, "round", 0), ("decision", None, 3, False, None, None),
    ("decision", 9, 3, False, None, None), ("draw", 1, 3, False, "method", 1), (None, 1, 3, False, "method", None), ("decision", None, 5, True, "locked", None), ("ko_tko", 6, 5, True, "round", 6), ("ko_tko", 2, 3, True, "locked", 2),
]


@query("f28_pick_fault", f"SELECT event_id, {_listed([p[4] for p in PICKS], 'event_id')} AS fault, CAST({_listed([p[5] for p in PICKS], 'event_id')} AS INT) AS kept FROM events")
def f28(t):
    method, round_, scheduled, locked = (_case([p[k] for p in PICKS], "event_id") for k in range(4))
    return t.events.select("event_id", bouts.pick_fault(method, round_, scheduled, locked).alias("fault"), bouts.picked_round(method, round_).alias("kept"))


@query("f29_rank_trend", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'none' WHEN event_id % 5 = 0 THEN 'new' WHEN event_id % 4 = event_id % 3 THEN 'same' WHEN event_id % 4 > event_id % 3 THEN 'up' ELSE 'down' END AS trend FROM events")
def f29(t):
    e = C("event_id")
    return t.events.select("event_id", bouts.rank_trend(e % 3, F.when(e % 5 != 0, e % 4), e % 11 != 0).alias("trend"))


@query("f30_eligible", "SELECT o_custkey, date_diff('day', max(o_orderdate), TIMESTAMP '2001-08-01') / 30.44 <= 18 OR o_custkey % 50 = 0 AS eligible, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS home FROM orders GROUP BY 1")
def f30(t):
    d = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("home"))
    months = dates.months_between(F.to_date("last"), F.to_date(F.lit("2001-08-01")))
    return d.select("o_custkey", bouts.months_eligible(months, C("o_custkey") % 50 == 0).alias("eligible"), "home")


@query("f30_home", """WITH o AS (SELECT o_custkey, o_orderpriority AS div, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY ALL), h AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1),
 x AS (SELECT o.*, CASE WHEN EXISTS (SELECT 1 FROM o f WHERE f.o_custkey = o.o_custkey AND f.div = '3-MEDIUM' AND date_diff('day', f.last, DATE '2001-08-01') <= 18 * 30.44) AND o.o_custkey % 4 <> 0 THEN '3-MEDIUM' ELSE latest END AS home FROM o JOIN h USING (o_custkey))
 SELECT o_custkey, div, home, o_custkey % 10 = 0 AND div = '1-URGENT' OR div = home AND date_diff('day', last, DATE '2001-08-01') <= 18 * 30.44 AS eligible FROM x""")
def f30_home(t):
    """A row for each customer and priority; three of four customers are officially listed under 3-MEDIUM, some lead 1-URGENT."""
    d = t.orders.groupBy("o_custkey", C("o_orderpriority").alias("div")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("x"))
    months = lambda c: dates.months_between(F.to_date(c), F.lit("2001-08-01").cast("date"))
    w = W.partitionBy("o_custkey")
    official = F.when(C("o_custkey") % 4 != 0, "3-MEDIUM")
    there = F.max(F.when(C("div") == official, C("x.o_orderdate"))).over(w)
    home = bouts.home_division(official, F.when(there.isNotNull(), months(there)), F.max_by("div", "x").over(w))
    d = d.withColumn("home", home)
    champion = (C("o_custkey") % 10 == 0) & (C("div") == "1-URGENT")
    return d.select("o_custkey", "div", "home", bouts.eligible_in_division(champion, C("div") == C("home"), months(C("x.o_orderdate"))).alias("eligible"))


@query("f31_reference_score", "SELECT p_partkey, round(least(100, 200 / (1 + pow(10, (1500 - p_retailprice) / 400))), 4) AS score, round(p_retailprice - 2.0 * p_size, 2) AS low FROM part")
def f31(t):
    return t.part.select("p_partkey", F.round(bouts.score_against(C("p_retailprice"), F.lit(1500.0)), 4).alias("score"), F.round(bouts.conservative(C("p_retailprice"), C("p_size")), 2).alias("low"))


@query("f32_display_scores", "SELECT p_partkey, round(CASE WHEN p_partkey = k THEN 100 ELSE least(99.9, least(100, 200 / (1 + pow(10, (top - p_retailprice) / 400)))) END, 4) AS score FROM (SELECT *, min(CASE WHEN p_size = 1 THEN p_partkey END) OVER w AS k, max(p_retailprice) OVER w AS top FROM part WINDOW w AS (PARTITION BY p_brand)) WHERE k IS NOT NULL")
def f32(t):
    from boutline.operators.rating import display_scores

    k = F.min(F.when(C("p_size") == 1, C("p_partkey"))).over(W.partitionBy("p_brand"))
    d = t.part.withColumn("k", k).where("k IS NOT NULL").withColumn("champion", C("p_partkey") == C("k"))
    return display_scores(d, "p_brand", "p_retailprice", C("champion"), F.lit(True)).select("p_partkey", F.round("display_score", 4).alias("score"))


@query("f32_capped", """WITH x AS (SELECT p_partkey, p_brand, p_retailprice AS score, min(CASE WHEN p_size = 1 THEN p_partkey END) OVER (PARTITION BY p_brand) AS k FROM part), y AS (SELECT *, max(CASE WHEN p_partkey = k THEN score END) OVER (PARTITION BY p_brand) AS top FROM x)
 SELECT p_partkey, round(CASE WHEN p_partkey <> k AND score >= top THEN greatest(0, top - 0.1 * row_number() OVER (PARTITION BY p_brand, p_partkey <> k AND score >= top ORDER BY score DESC, p_partkey)) ELSE score END, 4) AS capped FROM y""")
def f32_capped(t):
    from boutline.operators.rating import capped_below_champion

    k = F.min(F.when(C("p_size") == 1, C("p_partkey"))).over(W.partitionBy("p_brand"))
    d = t.part.withColumn("champion", F.coalesce(C("p_partkey") == k, F.lit(False)))
    return capped_below_champion(d, "p_brand", "p_retailprice", C("champion"), "p_partkey").select("p_partkey", F.round("capped", 4).alias("capped"))


@query("f33_flag", "SELECT n_nationkey, chr(127397 + ascii(upper(n_name[1]))) || chr(127397 + ascii(upper(n_name[2]))) AS flag FROM nation")
def f33(t):
    return t.nation.select("n_nationkey", text.country_flag(F.substring("n_name", 1, 2)).alias("flag"))


@query("f33_physique", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size % 5 = 0 THEN NULL WHEN p_size % 3 = 0 THEN 'Allonge ' || (p_size + 150) || ' cm' ELSE '1,' || lpad(CAST(p_size + 40 AS VARCHAR), 2, '0') || ' m' || CASE WHEN p_size % 5 = 0 THEN '' ELSE ' · Allonge ' || (p_size + 150) || ' cm' END END AS line,
 CASE WHEN p_size % 2 = 0 THEN 'https://x.example/image_crop/400/600/a/image_crop/1/2/b.jpg' ELSE 'https://x.example/image/200/300/b.jpg' END AS image, '/people' || CASE WHEN p_size % 4 = 0 THEN CASE WHEN p_size > 1 THEN '?org=7&page=' || p_size ELSE '?org=7' END WHEN p_size > 1 THEN '?page=' || p_size ELSE '' END AS path FROM part""")
def f33_physique(t):
    s = C("p_size")
    image = F.when(s % 2 == 0, "https://x.example/image_crop/200/300/a/image_crop/1/2/b.jpg").otherwise("https://x.example/image/200/300/b.jpg")
    org = F.when(s % 4 == 0, "7").when(s % 4 == 1, "all").when(s % 4 == 2, "x9")
    return t.part.select("p_partkey", text.physique(F.when(s % 3 != 0, s + 140), F.when(s % 5 != 0, s + 150)).alias("line"), text.sharper_image(image).alias("image"), text.listing_path("/people", org, s.cast("string")).alias("path"))


@query("f34_json_ld", """SELECT c_custkey, '{"@type":"Person"' || CASE WHEN c_custkey % 2 = 0 THEN ',"name":"' || c_name || '"' ELSE '' END || ',"segment":"' || c_mktsegment || '"}' AS ld FROM customer""")
def f34(t):
    body = F.struct(F.lit("Person").alias("@type"), F.when(C("c_custkey") % 2 == 0, C("c_name")).alias("name"), C("c_mktsegment").alias("segment"))
    return t.customer.select("c_custkey", F.replace(F.to_json(body), F.lit("<"), F.lit("\\u003c")).alias("ld"))


@query("f34_event", """SELECT o_orderkey, '{"@context":"https://schema.org","@type":"SportsEvent","name":"Night \\u003c' || o_orderkey || '","description":"d","url":"https://s.example/events/' || o_orderkey || '","startDate":"' || strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN 'T20:30:00.000Z' ELSE '' END || '","sport":"Mixed Martial Arts","eventStatus":"https://schema.org/EventScheduled","eventAttendanceMode":"https://schema.org/OfflineEventAttendanceMode"' ||
 CASE WHEN o_orderkey % 3 = 0 THEN ',"image":["https://i.example/p.png"]' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ',"location":{"@type":"Place","name":"Hall","address":"Hall"}' END || ',"organizer":{"@type":"SportsOrganization","name":"ORG","url":"https://s.example/organizations/' || o_custkey || '"}' ||
 CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE ',"competitor":[{"@type":"Person","name":"A Two","url":"https://s.example/f/1"},{"@type":"Person","name":"B","url":"https://s.example/f/2"}]' END || '}' AS ld FROM orders""")
def f34_event(t):
    k, day = C("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    time = F.when(k % 2 == 0, F.to_timestamp(F.concat(day, F.lit(" 20:30:00")))).otherwise(F.to_timestamp(F.concat(day, F.lit(" 00:00:00"))))
    names, urls = F.array(*map(F.lit, ("A", "", None, "B", "A Two"))), F.array(*(F.lit(f"https://s.example/f/{n}") for n in (1, 3, 4, 2, 1)))
    people = F.when(k % 7 != 0, linked.distinct_people(names, urls))
    ld = linked.sports_event("https://s.example", k, F.concat(F.lit("Org - Night <"), k), F.lit("d"), linked.start_date([F.lit(None).cast("timestamp"), time], day), F.when(k % 3 == 0, "https://i.example/p.png").otherwise("/p.png"), F.when(k % 5 != 0, "Hall").otherwise(""), C("o_custkey"), F.lit("ORG"), people)
    return t.orders.select("o_orderkey", ld.alias("ld"))


@query("f34_profile", """SELECT c_custkey, '{"@context":"https://schema.org","@type":"ProfilePage","url":"https://s.example/f/' || c_custkey || '","inLanguage":"fr-FR","mainEntity":{"@type":"Person","@id":"https://s.example/f/' || c_custkey || '#person","name":"' || c_name || '","url":"https://s.example/f/' || c_custkey || '","description":"d","jobTitle":"Combattant de MMA"' ||
 CASE c_custkey % 3 WHEN 0 THEN ',"gender":"https://schema.org/Female"' WHEN 1 THEN ',"gender":"https://schema.org/Male"' ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN ',"birthDate":"1990-05-01"' ELSE '' END || ',"nationality":{"@type":"Country","name":"FR"}' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ',"height":{"@type":"QuantitativeValue","value":180,"unitCode":"CMT"}' END ||
 CASE WHEN c_custkey % 4 = 0 THEN ',"memberOf":{"@type":"SportsOrganization","name":"ORG","url":"https://s.example/organizations/' || c_nationkey || '"}' ELSE '' END || '}}' AS ld,
 '{"@context":"https://schema.org","@type":"SportsOrganization","name":"' || c_mktsegment || '"' || CASE WHEN c_custkey % 2 = 0 THEN ',"alternateName":"SEG"' ELSE '' END || ',"description":"d","url":"https://s.example/organizations/' || c_custkey || '","sport":"Mixed Martial Arts"}' AS org,
 '{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"Accueil","item":"https://s.example/"},{"@type":"ListItem","position":2,"name":"' || c_mktsegment || '","item":"https://s.example/x"}]}' AS crumbs FROM customer""")
def f34_profile(t):
    k = C("c_custkey")
    women = F.when(k % 3 == 0, True).when(k % 3 == 1, False)
    ld = linked.profile("https://s.example", F.concat(F.lit("/f/"), k), C("c_name"), F.lit("d"), F.lit("x.png"), women, F.when(k % 2 == 0, "1990-05-01T00:00").otherwise("May 1990"), F.lit("fr"), F.when(k % 5 == 0, 0).otherwise(180), C("c_nationkey"), F.when(k % 4 == 0, "ORG"))
    org = linked.organization("https://s.example", k, C("c_mktsegment"), F.when(k % 2 == 0, "SEG").otherwise(C("c_mktsegment")), F.lit("d"), F.lit("/logo.png"))
    return t.customer.select("c_custkey", ld.alias("ld"), org.alias("org"), linked.breadcrumbs("https://s.example", F.array(C("c_mktsegment")), F.array(F.lit("/x"))).alias("crumbs"))


@query("f35_meta", "SELECT s_suppkey, 'Supplier ' || s_name || ' - ' || n_name AS meta FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def f35(t):
    return t.supplier.join(t.nation, C("n_nationkey") == C("s_nationkey")).select("s_suppkey", text.truncate_words(F.concat_ws(" - ", F.concat(F.lit("Supplier "), C("s_name")), C("n_name")), 160).alias("meta"))


@query("f36_search_query", r"SELECT doc_id, CASE WHEN length(q) >= 2 THEN q END AS q FROM (SELECT doc_id, trim(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 80)) AS q FROM documents)")
def f36(t):
    return t.documents.select("doc_id", text.search_query(C("text")).alias("q"))


BADGES = {"final_result win": "win", "final_result loss": "loss", "final_result draw": "draw", "final_result no_contest": "nc", "cancelled": "not_finished", "final_result NC": "not_finished", "yet_to_come": "not_finished", "": "not_finished", "no_contest draw": "draw"}


@query("f37_result_of", f"SELECT event_id, {_listed(list(BADGES.values()), 'event_id')} AS r FROM events")
def f37(t):
    return t.events.select("event_id", bouts.result_of(_case(list(BADGES), "event_id")).alias("r"))


@query("f38_finished", "SELECT event_id, event_id % 3 = 0 OR event_id % 4 IN (1, 2) AS finished FROM events")
def f38(t):
    e = C("event_id")
    method = F.when(e % 4 == 0, " ").when(e % 4 == 3, None).otherwise("KO")
    return t.events.select("event_id", bouts.repaired_finished(F.when(e % 3 == 0, True).when(e % 3 == 1, False), method).alias("finished"))


@query("f39_urls", "SELECT page_id, regexp_replace(url, '[?&](utm_[a-z]+|fbclid)=[^&#]*', '', 'g') AS url, regexp_extract(url, '(\\d+)/?$', 1) AS tail FROM pages")
def f39(t):
    return t.pages.select("page_id", text.strip_tracking(C("url")).alias("url"), F.regexp_extract("url", r"(\d+)/?$", 1).alias("tail"))


@query("f40_prng", """WITH a AS (SELECT o_orderkey, (o_orderkey + 1831565813::HUGEINT) & 4294967295 AS a FROM orders), t AS (SELECT o_orderkey, (xor(a, a >> 15) * (a | 1)) & 4294967295 AS t FROM a),
 u AS (SELECT o_orderkey, xor(t, (t + ((xor(t, t >> 7) * (t | 61)) & 4294967295)) & 4294967295) AS t FROM t) SELECT o_orderkey, CAST(xor(t, t >> 14) AS DOUBLE) / 4294967296 AS x FROM u""")
def f40(t):
    """The first draw of the generator seeded with each order's key: a coin for each row, whatever the order of the rows."""
    return t.orders.select("o_orderkey", prng.draw(C("o_orderkey")).alias("x"))


@query("f41_losses", "SELECT event_type, round(avg(-ln(greatest(1e-12, CASE WHEN event_id % 2 = 0 THEN p ELSE 1 - p END))), 5) AS loss, round(avg(ln(p / (1 - p))), 5) AS logit FROM (SELECT *, 1 / (1 + exp(-(value - 50) / 40)) AS p FROM events) GROUP BY 1")
def f41(t):
    d = t.events.withColumn("p", bouts.sigmoid((C("value") - 50) / 40)).withColumn("y", F.when(C("event_id") % 2 == 0, 1).otherwise(0))
    return d.groupBy("event_type").agg(F.round(bouts.log_loss(C("p"), C("y")), 5).alias("loss"), F.round(F.avg(bouts.logit(C("p"))), 5).alias("logit"))
