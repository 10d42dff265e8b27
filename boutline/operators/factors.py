"""Win factors of bouts (A15): age, height, experience, streak and layoff, from what was known of both sides before the day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boutline.operators.sequence import streak_from

LONG = float("inf")
# The buckets of each factor, (label, over, up to).
AGE = (("under 3 years", 0, 3), ("3 to 6 years", 3, 6), ("6 to 9 years", 6, 9), ("9 years and over", 9, LONG))
CENTIMETRES = (("1 to 5 cm", 0, 5), ("6 to 10 cm", 5, 10), ("11 to 15 cm", 10, 15), ("16 cm and over", 15, LONG))
EXPERIENCE = (("1 to 3 bouts", 0, 3), ("4 to 7 bouts", 3, 7), ("8 to 12 bouts", 7, 12), ("13 bouts and over", 12, LONG))
STREAK = (("2 losses or more", -LONG, -2), ("1 loss", -2, -1), ("1 win", 0, 1), ("2 wins", 1, 2), ("3 to 4 wins", 2, 4), ("5 wins or more", 4, LONG))
LAYOFF = (("under 4 months", -LONG, 4), ("4 to 8 months", 4, 8), ("8 to 12 months", 8, 12), ("1 to 2 years", 12, 24), ("over 2 years", 24, LONG))


def prior_records(asked: DataFrame, history: DataFrame, newest: int = 12) -> DataFrame:
    """`asked` (person, day, ...) with `prior`: struct<fights, streak, days_since> of the person's results (person, day, tie, result) on earlier days; null for a person without any
    result at all, which is not the same as a debut (0, 0, null).

    A day's state is its count so far and its `newest` last results, so no list is longer.  Both tables meet in one sort by (person, day): a question stands before the
    results of its own day and takes the state of the last day before."""
    along = W.partitionBy("person").orderBy("day", "tie")
    upto = history.where("person IS NOT NULL AND day IS NOT NULL").select(
        "person", "day", F.row_number().over(along).alias("n"), F.collect_list("result").over(along.rowsBetween(-(newest - 1), 0)).alias("recent"),
    )
    days = upto.groupBy("person", "day").agg(F.max_by(F.struct("n", "recent", "day"), "n").alias("state"))
    row = F.struct(*asked.columns)
    both = asked.select("person", "day", F.lit(0).alias("_kind"), row.alias("_row"), F.lit(None).cast(days.schema["state"].dataType).alias("state"))
    both = both.unionByName(days.select("person", "day", F.lit(1).alias("_kind"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), "state"))
    person = W.partitionBy("person")
    before = person.orderBy("day", "_kind").rowsBetween(W.unboundedPreceding, -1)
    known = both.select("_kind", "_row", "day", F.last("state", ignorenulls=True).over(before).alias("s"), F.count("state").over(person).alias("days"))
    recent = F.reverse(F.coalesce("s.recent", F.array().cast("array<string>")))
    prior = F.struct(F.coalesce("s.n", F.lit(0)).cast("int").alias("fights"), streak_from(recent).cast("int").alias("streak"), F.datediff("day", "s.day").alias("days_since"))
    return known.where("_kind = 0").select("_row.*", F.when(F.col("days") > 0, prior).alias("prior"))


def win_factors(pairs: DataFrame) -> DataFrame:
    """factor, bucket, place, wins, total of bouts with `winner` and `loser`, structs of age, height_cm and prior (see `prior_records`); every value may be null.

    For age, height and experience a bout counts once, by the size of the difference: wins of the younger, the taller, the one with more bouts; equal and missing values are
    left out.  Streak and layoff are of one side, so both count.  Empty buckets stay with 0.  One pass over the bouts."""
    pair = lambda get: (get(F.col("winner")), get(F.col("loser")))
    edges = {
        "age": (lambda s: -s["age"], AGE), "height": (lambda s: s["height_cm"], CENTIMETRES), "experience": (lambda s: s["prior"]["fights"], EXPERIENCE),
    }
    own = {
        "streak": (lambda s: F.when(s["prior"]["streak"] != 0, s["prior"]["streak"]), STREAK), "layoff": (lambda s: s["prior"]["days_since"] / 30.44, LAYOFF),
    }
    hits = []
    for name, (get, _) in edges.items():
        a, b = pair(get)
        hits.append(F.when(a != b, F.struct(F.lit(name).alias("factor"), F.abs(a - b).cast("double").alias("value"), (a > b).alias("won"))))
    for name, (get, _) in own.items():
        for side, won in zip(pair(get), (True, False)):
            hits.append(F.when(side.isNotNull(), F.struct(F.lit(name).alias("factor"), side.cast("double").alias("value"), F.lit(won).alias("won"))))
    buckets = {name: spans for name, (_, spans) in (edges | own).items()}
    place = F.lit(None).cast("int")
    for name, spans in buckets.items():
        for k, (_, low, high) in enumerate(spans):
            place = F.when((F.col("factor") == name) & (F.col("value") > low) & (F.col("value") <= high), k).otherwise(place)
    rows = pairs.select(F.explode(F.array_compact(F.array(*hits))).alias("x")).select("x.*").withColumn("place", place).where("place IS NOT NULL")
    counts = rows.groupBy("factor", "place").agg(F.count_if("won").alias("wins"), F.count("*").alias("total"))
    spine = pairs.sparkSession.createDataFrame([(name, label, k) for name, spans in buckets.items() for k, (label, *_) in enumerate(spans)], "factor string, bucket string, place int")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spine.join(counts, ["factor", "place"], "left").select("factor", "bucket", "place", zero("wins"), zero("total"))
