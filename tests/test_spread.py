"""Rows that are dealt out before they grow, and parser shortcuts against the plain way."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from boutline.operators import matching, sequence
from boutline.plans import entities, readers
from boutline.plans.registry import QUERIES
from boutline.sources import html


def test_pages_are_spread(spark):
    """Pages are made in partitions of so many rows, not in the one that the small rows stand in."""
    part = spark.range(3 * readers.ROWS).coalesce(1).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size")
    pages = readers.fight_pages(SimpleNamespace(part=part))
    assert pages.rdd.getNumPartitions() == 3 and pages.count() == 3 * readers.ROWS


def test_claims_pair_only_what_is_free(spark, monkeypatch):
    """Fuzzy pairs of customers or suppliers with an exact claim aren't made."""
    customer = spark.createDataFrame([(1, 7, 110.0), (2, 7, 190.0), (3, 7, 320.0), (4, 8, 10.0)], "c_custkey long, c_nationkey int, c_acctbal double")
    supplier = spark.createDataFrame([(1, 7, 150.0), (2, 7, 450.0), (3, 9, 10.0)], "s_suppkey long, s_nationkey int, s_acctbal double")
    asked = []
    real = matching.resolve_claims
    monkeypatch.setattr(matching, "resolve_claims", lambda exact, fuzzy, *names: asked.append(sorted(map(tuple, fuzzy.collect()))) or real(exact, fuzzy, *names))
    got = entities.j24(SimpleNamespace(customer=customer, supplier=supplier))
    assert sorted(map(tuple, got.collect())) == [(1, 1, "exact"), (2, 1, "exact"), (3, 2, "fuzzy")]
    assert asked == [[(3, 2)]] and "j24_claims" in QUERIES


def test_plain_tags_as_others(monkeypatch):
    """Tags read whole, and kept for later pages, give what reading them attribute by attribute gives."""
    markup = "<p class='a  b' ID=x>t &lt; u<br><A href=/q/r?s&amp;t title=\"1 > 0\">v</A ><td a b=c>w<input disabled><p class=\"a\">x</p></td>" * 2
    lists = lambda t: (t.last, t.tags, t.attrs, t.texts, dict(t.index))
    fast, again = html.Tree(markup), html.Tree(markup)
    monkeypatch.setattr(html, "_PLAIN", html.re.compile(r"(?!)"))
    assert lists(fast) == lists(again) == lists(html.Tree(markup)) and fast.find("p.a") == [k for k, tag in enumerate(fast.tags) if tag == "p"]


def test_title_as_written(spark):
    """A title's references as the page has them; the query reads three of them, and a cut one stays."""
    page = "<html><head><title>a &quot;b&lt;  &amp;amp; c&amp</title></head></html>"
    assert html.Field((("title", 0),), written=True).of(html.Tree(page), None) == "a &quot;b&lt; &amp;amp; c&amp"
    assert html.Field((("title", 0),)).of(html.Tree(page), None) == 'a "b< &amp; c&'
    got = readers.s04_tree(SimpleNamespace(pages=spark.createDataFrame([(1, page)], "page_id long, html string"))).first()
    assert got["title"] == "a &quot;b< &amp; c&amp"


def test_greedy_across_batches(spark):
    """Keys and runs that go on in the next batch, and text ties, against the rule row by row."""
    rng = random.Random(6)
    rows = [(rng.randrange(3), rng.choice("ab"), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(900)), n) for n in range(160)]
    want, last = set(), {}
    for key, kind, ts, n in sorted(rows, key=lambda r: (*r[:2], r[2], r[3])):
        if (key, kind) not in last or ts - last[key, kind] > timedelta(hours=48):
            last[key, kind] = ts
            want.add((key, kind, n))
    df = spark.createDataFrame(rows, "key int, kind string, ts timestamp, n int")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = [tuple(r) for r in sequence.greedy_dedup(df, ["key", "kind"], "ts", "n", 48).collect()]
        text = [(r[0], r[1], int(r[2])) for r in sequence.greedy_dedup(df.withColumn("n", F.format_string("%05d", "n")), ["key", "kind"], "ts", "n", 48).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert len(got) == len(text) == len(want) and set(got) == set(text) == want
