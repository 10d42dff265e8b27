"""Scalar rules on cases with known answers, and against plain Python."""

import json
from itertools import islice

import pytest
from pyspark.sql import functions as F

from boutline.functions import bouts, dates, linked, prng, text
from boutline.plans import scalars


def answers(spark, values, shape, made):
    """made(columns..) for each row of values, in order."""
    rows = [(n, *(v if isinstance(v, tuple) else (v,))) for n, v in enumerate(values)]
    d = spark.createDataFrame(rows, f"n int, {shape}")
    return [r["x"] for r in d.select("n", made(*(F.col(c) for c in d.columns[1:])).alias("x")).orderBy("n").collect()]


@pytest.mark.parametrize(
    "cases, made",
    [
        (scalars.EVENT_NAMES, text.display_event_name),
        (scalars.BADGES, bouts.result_of),
        ({k: v[0] for k, v in scalars.METHODS.items()}, bouts.method_category),
        ({k: v[1] for k, v in scalars.METHODS.items()}, bouts.corner_method),
        ({k: v[0] for k, v in scalars.SHOWN.items()}, lambda c: bouts.display_weight_class(c, F.lit(True))),
        ({k: k for k in scalars.SHOWN}, lambda c: bouts.display_weight_class(c, F.lit(None).cast("boolean"))),
        ({k: v[0] for k, v in scalars.RESULT_LABELS.items()}, lambda c: bouts.results_only_division(c, F.lit(False))),
        ({k: v[1] for k, v in scalars.RESULT_LABELS.items()}, lambda c: bouts.results_only_division(c, F.lit(True))),
        (scalars.NAMES, lambda c: F.array_join(text.name_words(c), " ")),
    ],
)
def test_cases(spark, cases, made):
    assert answers(spark, list(cases), "c string", made) == list(cases.values())


def test_missing_values(spark):
    none = [None]
    assert answers(spark, none, "c string", bouts.method_category) == ["other"] and answers(spark, none, "c string", bouts.corner_method) == ["other"]
    assert answers(spark, none, "c string", lambda c: bouts.display_weight_class(c, F.lit(True))) == [None] and answers(spark, none, "c string", bouts.results_division) == [None]
    assert answers(spark, none, "c string", lambda c: bouts.results_only_division(c, F.lit(None).cast("boolean"))) == [None]
    assert len(bouts.RESULT_DIVISIONS) == 10 and len(bouts.SHARED_DIVISIONS) == 7 and len(text.ALIASES) == 17


def test_picks(spark):
    found = answers(spark, [p[:4] for p in scalars.PICKS], "m string, r int, s int, l boolean", lambda m, r, s, at: F.struct(bouts.pick_fault(m, r, s, at), bouts.picked_round(m, r)))
    assert [tuple(x) for x in found] == [p[4:] for p in scalars.PICKS]


def test_lines_and_paths(spark):
    assert answers(spark, [(193, 215), (180, None), (None, 188), (None, None), (0, 0)], "h int, r int", text.physique) == ["1,93 m · Allonge 215 cm", "1,80 m", "Allonge 188 cm", None, None]
    cases = {(None, None): "/p", ("all", "1"): "/p", ("3", "2"): "/p?org=3&page=2", ("x3", "0"): "/p", ("3", "1.5"): "/p?org=3", (None, " 4 "): "/p?page=4", ("3", "99999999999999"): "/p?org=3"}
    assert answers(spark, list(cases), "o string, p string", lambda o, p: text.listing_path("/p", o, p)) == list(cases.values())
    assert answers(spark, ["https://s/image_crop/200/300/_i/a.jpg", "/b.jpg", None], "u string", text.sharper_image) == ["https://s/image_crop/400/600/_i/a.jpg", "/b.jpg", None]


def test_home_divisions(spark):
    made = lambda o, m, x: bouts.home_division(o, m, x)
    assert answers(spark, [("A", 3.0, "B"), ("A", 18.0, "B"), ("A", 18.1, "B"), ("A", None, "B"), (None, None, "B"), (None, None, None)], "o string, m double, x string", made) == ["A", "A", "B", "B", "B", None]
    assert answers(spark, [(True, False, None), (False, True, 18.0), (False, True, 18.5), (False, False, 1.0), (None, True, None)], "c boolean, h boolean, m double", bouts.eligible_in_division) == [True, True, False, False, False]


def test_next_events(spark):
    rows = [(1, 10, "2024-01-01"), (1, 11, "2024-03-01"), (1, 12, "2024-03-01"), (2, 20, "2023-01-01"), (2, 21, "2023-05-01"), (2, 22, "2023-05-01"), (3, 30, None), (4, 40, "2024-02-01")]
    d = spark.createDataFrame(rows, "org long, id long, day string").withColumn("day", F.to_date("day"))
    as_of = F.lit("2024-02-01").cast("date")
    got = {r["org"]: (r["event"] and r["event"]["id"], r["is_upcoming"], r["events"]) for r in dates.next_events_by(d, "org", "day", "id", as_of).collect()}
    assert got == {1: (11, True, 3), 2: (22, False, 3), 3: (None, False, 1), 4: (40, True, 1)}
    home = lambda org, at: [(r["event"] and r["event"]["id"], r["is_upcoming"]) for r in dates.next_event_for_home(d, F.col("org") == org, "day", "id", F.lit(at).cast("date")).collect()]
    assert home(1, "2024-02-01") == [(11, True)] and home(2, "2024-02-01") == [(40, True)] and home(1, "2025-01-01") == [(12, False)]
    assert [r["event"] for r in dates.next_event_for_home(d.limit(0), F.lit(True), "day", "id", as_of).collect()] == [None]


def test_linked_texts_are_json(spark):
    ld = answers(spark, [("A </script> - x", "https://i/p.png"), ('Q"t', None)], "c string, i string", lambda n, i: linked.sports_event("https://s", F.lit(1), n, F.lit("é"), F.lit("2024-01-01"), i, F.lit(None).cast("string"), F.lit(2), F.lit("O"), F.lit(None).cast("array<struct<name: string>>")))
    assert all("<" not in x for x in ld)
    first, second = map(json.loads, ld)
    assert first["image"] == ["https://i/p.png"] and "image" not in second and "location" not in second and "competitor" not in second and second["name"] == 'Q"t' and first["@context"] == "https://schema.org"


def test_draws(spark):
    seeds = [0, 1, 42, 2**31, 2**32 - 1, 2**32 + 5, -1, -(2**40)]
    for n in (0, 1, 7):
        assert answers(spark, seeds, "s long", lambda s: prng.draw(s, n)) == [next(islice(prng.mulberry32(s), n, None)) for s in seeds]  # noqa: B023
