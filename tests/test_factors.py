"""Records before a day against plain lists, win factors against plain buckets, explorer points and feed reports on cases with known answers."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from boutline.operators import cube, factors, replay, styles
from boutline.sources import pages

DAY = datetime.date(2020, 1, 1)


def streak(newest_first):
    n = 0
    for r in newest_first:
        if r == "nc":
            continue
        if r == "win" and n >= 0:
            n += 1
        elif r == "loss" and n <= 0:
            n -= 1
        else:
            break
    return n


def test_prior_records(spark):
    rng = random.Random(3)
    day = lambda: DAY + datetime.timedelta(days=rng.randrange(40))
    history = [(rng.choice([1, 1, 1, 2, 3]), day(), k, rng.choice(["win", "win", "win", "loss", "draw", "nc"])) for k in range(150)] + [(None, DAY, 900, "win"), (4, None, 901, "win")]
    asked = [(p, day(), n) for n, p in enumerate([1, 2, 3, 4, 5, None] * 30)] + [(1, None, 999)]
    h = spark.createDataFrame(history, "person int, day date, tie long, result string")
    got = {r["q"]: r for r in factors.prior_records(spark.createDataFrame(asked, "person int, day date, q int"), h).collect()}
    assert len(got) == len(asked)
    for person, at, q in asked:
        own = sorted([(d, k, r) for p, d, k, r in history if p == person and d and p is not None], reverse=True)
        if not own:
            assert got[q]["prior"] is None
            continue
        past = [x for x in own if at and x[0] < at]
        want = (len(past), streak([r for *_, r in past[:12]]), (at - past[0][0]).days if past else None)
        assert tuple(got[q]["prior"]) == want


def test_win_factors(spark):
    rng = random.Random(5)
    some = lambda x: rng.choice([None, x, x, x])
    prior = lambda: some((rng.randrange(20), rng.randrange(-4, 8), some(rng.randrange(1200))))
    side = lambda: (some(float(rng.randrange(20, 45))), some(rng.randrange(160, 200)), prior())
    pairs = [(side(), side()) for _ in range(400)]
    kind = "struct<age: double, height_cm: int, prior: struct<fights: int, streak: int, days_since: int>>"
    got = {(r["factor"], r["place"]): (r["wins"], r["total"]) for r in factors.win_factors(spark.createDataFrame(pairs, f"winner {kind}, loser {kind}")).collect()}
    want = {}

    def add(name, buckets, value, won):
        for k, (_, low, high) in enumerate(buckets):
            if low < value <= high:
                wins, total = want.get((name, k), (0, 0))
                want[name, k] = (wins + won, total + 1)

    for w, x in pairs:
        for name, buckets, get in (("age", factors.AGE, lambda s: None if s[0] is None else -s[0]), ("height", factors.CENTIMETRES, lambda s: s[1]), ("experience", factors.EXPERIENCE, lambda s: s[2] and s[2][0])):
            a, b = get(w), get(x)
            if a is not None and b is not None and a != b:
                add(name, buckets, abs(a - b), a > b)
        for s, won in ((w, 1), (x, 0)):
            if s[2] and s[2][1]:
                add("streak", factors.STREAK, s[2][1], won)
            if s[2] and s[2][2] is not None:
                add("layoff", factors.LAYOFF, s[2][2] / 30.44, won)
    assert {k: v for k, v in got.items() if v[1]} == want and len(got) == 4 + 4 + 4 + 6 + 5
    assert {r["total"] for r in factors.win_factors(spark.createDataFrame([], f"winner {kind}, loser {kind}")).collect()} == {0}


def test_explorer_points(spark):
    cells = [(2019, "A", False, 5, 1), (2019, "A", True, 7, 7), (2020, "A", False, 40, 10), (2020, "Women's A", True, 50, 20), (2021, "Autres", False, 3, 0), (2018, "Autres", True, 2, 1)]
    c = spark.createDataFrame([(y, d, a, n, k, 0, 0) for y, d, a, n, k in cells], "year int, division string, after_cutoff boolean, fights long, ko long, sub long, dec long")
    points = lambda *a, **k: {r["label"]: (r["value"], r["fights"]) for r in cube.explorer_points(c, "finish_rate", *a, **k).collect()}
    assert points("year", 2018, 2021, "men", least=10) == {"2019": (8 / 12, 12), "2020": (0.25, 40), "2021": (None, 0)}
    assert points("year", 2019, 2020, "A", rolling=True, least=10) == {"2019": (None, 7), "2020": (0.25, 40)}
    assert points("year", 2018, 2021, "women", least=1) == {"2020": (0.4, 50), "2021": (None, 0)}
    assert points("year", 2018, 2021, "none") == {}
    assert points("division", 2019, 2020, "all", least=10) == {"A": (18 / 52, 52), "Women's A": (0.4, 50), "Autres": (None, 0)}
    assert points("division", 2019, 2020, "men", rolling=True, least=10) == {"A": (17 / 47, 47)}


def test_feed_reports(spark):
    item = "<item><title>t</title><link>http://x/1</link><pubDate>Tue, 2 Jan 2024 03:04:05 +0000</pubDate></item>"
    feeds = {
        1: f"<rss><channel>{item}{item}<item><title>no link</title></item></channel></rss>", 2: f"<rss><channel>{item}", 3: "", 4: None, 5: "<rss><channel></channel></rss>", 6: "not xml at all", 7: "<rss><other/></rss>", 8: f"<rss><channel>{item}</channel></rss>",
    }
    items, report = pages.feeds(spark.createDataFrame(list(feeds.items()), "source int, xml string"), "xml")
    got = {r["source"]: (r["items"], r["dropped"], r["error"]) for r in report.collect()}
    assert got == {1: (2, 1, None), 2: (0, 0, "malformed feed"), 3: (0, 0, "empty feed"), 4: (0, 0, "empty feed"), 5: (0, 0, got[5][2]), 6: (0, 0, "malformed feed"), 7: (0, 0, "no channel"), 8: (1, 0, None)}
    assert sorted(r["source"] for r in items.collect()) == [1, 1, 8]


def test_external_bouts(spark):
    d = datetime.date(2020, 1, 1)
    rows = [("a", "b", d, "win", "Regional 1"), ("b", "a", d, "loss", "Regional 1"), ("c", "a", d, "win", "UFC 100"), ("c", "b", d, "win", " ufc: Finale"), ("c", "d", d, "loss", "UFCX 3"), ("e", "e", d, "win", "x"), ("e", None, d, "win", "x"), ("e", "f", None, "win", "x"), ("e", "g", d, "draw", "x"), ("h", "i", d, "win", None)]
    df = spark.createDataFrame(rows, "owner string, opponent string, day date, result string, event string")
    assert {(r["winner"], r["loser"]) for r in replay.external_bouts(df, "UFC").collect()} == {("a", "b"), ("d", "c"), ("h", "i")}
    assert len(replay.external_bouts(df).collect()) == 5


@pytest.mark.parametrize("method, winner, fate, last", [("Decision (Split)", 1, 0, None), ("decision - unanimous", 2, 0, None), ("KO", 1, 0, 2), ("Technical Decision", 1, 0, 2), ("Draw (Majority)", None, 1, 2), ("NC", None, 1, 2), ("Drawn out", None, None, None), ("", None, None, None)])
def test_results_only(spark, method, winner, fate, last):
    df = spark.createDataFrame([(1, 2, winner, method, 2, None, True, "x")], "first int, second int, winner_id int, method string, round int, is_title boolean, is_main boolean, division string")
    bouts, skipped = styles.results_only(df, F.col("division"))
    got = [(r["kind"], r["finish_round"], r["winner"], r["loser"]) for r in bouts.collect()]
    assert got == ([] if fate is None else [(fate, last, winner or 1, 3 - (winner or 1))]) and skipped.count() == (fate is None)
