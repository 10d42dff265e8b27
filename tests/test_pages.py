"""Small pages, made up here, through the expressions that no query covers."""

from pyspark.sql import functions as F

from boutline.sources import pages

C = F.col


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_icons_flags_paths(spark):
    page = '<img src="/i/fight.png"><IMG class="x" src="https://h/i/sub.png">'
    got = values(spark, "h string", [(page,), ("",), (None,)], pages.bonuses(C("h")).alias("b"))
    assert tuple(got[0][0]) == (True, True) and tuple(got[1][0]) == (False, False)
    assert values(spark, "s string", [("/f/us.png",), ("/f/sct.png",), ("/f/eng.png",), (None,)], pages.flag_country(C("s"))) == [("US",), ("SC",), (None,), (None,)]
    rows = [("Card 12: A vs B", "2024-03-02"), ("Card Night", "2024-03-02")]
    assert values(spark, "n string, d string", rows, pages.event_path(C("n"), F.to_date("d"), "Card")) == [("card-12",), ("card-fight-night-march-02-2024",)]


def test_ranking_lists(spark):
    table = lambda caption, *names: f"<table><caption>{caption}</caption>" + "".join(f"<tr><td><a href='/x'>{n}</a></td></tr>" for n in names) + "</table>"
    html = table("Light", "Ann", "Bea") + table("Light", "Zed") + table("Pound-for-pound", "Cy", "Di") + table("", "No")
    got = sorted(tuple(r) for r in pages.ranking_lists(spark.createDataFrame([(1, html), (2, None)], "id int, h string"), "id", "h").collect())
    assert got == [(1, "Light", 0, "Ann"), (1, "Light", 1, "Bea"), (1, "Pound-for-pound", 1, "Cy"), (1, "Pound-for-pound", 2, "Di")]


def test_photo(spark):
    rows = [("o", "p", {"en": "e"}), (None, None, {"fr": "f", "en": "e"}), (None, None, {}), (None, None, None)]
    got = values(spark, "o string, p string, m map<string,string>", rows, pages.chosen_photo(C("o"), C("p"), C("m"), ["fr", "en"]))
    assert got == [("o",), ("f",), (None,), (None,)]


def test_bad_feed(spark):
    good = "<rss><channel><item><title>a</title><link>http://x/1</link><pubDate>2024-01-02T03:04:05Z</pubDate></item></channel></rss>"
    rows = [(1, good), (2, "<rss><chan"), (3, good.replace("/1", "/" + "1" * 990)), (4, None)]
    got = pages.feed_items(spark.createDataFrame(rows, "source int, xml string"), "xml").collect()
    assert [(r.source, r.title, r.url) for r in got] == [(1, "a", "http://x/1")]


def test_slugs_of_real_names(spark):
    from boutline.functions import text

    names = {"Nguyễn Trần": "nguyen-tran", "Jiří Procházka": "jiri-prochazka", "Jan Błachowicz": "jan-blachowicz", "Sean O´Malley": "sean-omalley", "Guðmundur Þór": "gudmundur-or", "Ð. Ñandú": "d-nandu", "á b": "a-b"}
    d = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["s"] for r in d.select("n", text.slugify(d.n).alias("s")).collect()} == names
