"""Re-sliceable cubes: build once by (year, division, after cutoff), then filter and sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build_cube(df: DataFrame, date: str, division: Column, cutoff: str, measures: dict[str, Column]) -> DataFrame:
    """One row per (year, division, after_cutoff) (A09).  The year is split at `cutoff` (MM-dd), so that rolling windows of whole years that end there are exact."""
    return df.groupBy(F.year(date).alias("year"), F.coalesce(division, F.lit("Autres")).alias("division"), (F.date_format(date, "MM-dd") >= cutoff).alias("after_cutoff")).agg(*(m.alias(n) for n, m in measures.items()))


def slice_cube(cube: DataFrame, measures: list[str], keep: Column | None = None, by: list[str] = ()) -> DataFrame:
    """Roll the kept cells up."""
    kept = cube if keep is None else cube.where(keep)
    return kept.groupBy(*by).agg(*(F.sum(m).alias(m) for m in measures))


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """num / den * scale, null where den is 0."""
    return F.when(den > 0, num * scale / den)


# The metrics of a cell, as numerator, denominator and scale over its measures; sides are halved where a bout counts two fighters.
METRICS = {
    "finish_rate": ("ko + sub", "fights", 1.0),
    "ko_rate": ("ko", "fights", 1.0),
    "sub_rate": ("sub", "fights", 1.0),
    "decision_rate": ("dec", "fights", 1.0),
    "minutes": ("minutes", "fights", 1.0),
    "sig_per_15": ("sig * 15", "minutes * 2", 1.0),
    "takedowns_per_15": ("td * 15", "minutes * 2", 1.0),
    "accuracy": ("sig", "sig_attempted", 1.0),
    "control_share": ("control", "minutes * 60", 1.0),
    "knockdowns_per_15": ("kd * 15", "minutes * 2", 1.0),
}


def metric(name: str) -> Column:
    num, den, scale = METRICS[name]
    return ratio(F.expr(num).cast("double"), F.expr(den).cast("double"), scale)


def bucketed_advantage(pairs: DataFrame, edge: Column, won: Column, buckets: list[tuple[str, float, float]]) -> DataFrame:
    """Win rate of the side with the larger value, by size of the edge in (low, high] (A14).  edge: a - b; won: whether a won.  Null and
    equal edges are left out, empty buckets stay."""
    spark = pairs.sparkSession
    spine = spark.createDataFrame([(n, i) for i, (n, _, _) in enumerate(buckets)], "bucket string, place int")
    size = F.abs(edge)
    name = F.lit(None).cast("string")
    for n, low, high in reversed(buckets):
        name = F.when((size > low) & (size <= high), n).otherwise(name)
    hits = pairs.where(edge != 0).select(name.alias("bucket"), (won == (edge > 0)).alias("hit")).where("bucket IS NOT NULL")
    got = hits.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("hit").alias("wins"))
    return spine.join(got, "bucket", "left").select("bucket", "place", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("wins", F.lit(0)).alias("wins")).withColumn("rate", ratio(F.col("wins"), F.col("n")))


def spine_histogram(df: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """Counts and shares of low..high, absent ones 0."""
    spine = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias(value))
    counts = spine.join(df.groupBy(value).agg(F.count("*").alias("n")), value, "left").select(value, F.coalesce("n", F.lit(0)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(value, "n", F.coalesce(ratio(F.col("n"), F.col("total")), F.lit(0.0)).alias("share"))


#: Division of what has none of its own.
OTHER = "Autres"


def in_group(group: str) -> Column:
    """Whether a cell's division belongs to a group (A29): all, men (no women's division, nor the rest), women, or a division by name."""
    women = F.col("division").startswith("Women's")
    return {"all": F.lit(True), "men": ~women & (F.col("division") != OTHER), "women": women}.get(group, F.col("division") == group)


def explorer_points(cube: DataFrame, name: str, view: str, first: int, last: int, group: str = "all", rolling: bool = False, least: int = 30) -> DataFrame:
    """label, value, fights of a cube's chart (A29): metric `name` by year or by division over the years `first` to `last`.

    `rolling`: the first year counts from the cutoff on, which with the rows before the last year's cutoff makes whole years.  A point of under `least` bouts has no
    value.  By year, the cube's years stay on the axis from the first one with a bout on; by division, those of the group."""
    measures = [c for c in cube.columns if c not in ("year", "division", "after_cutoff")]
    inside = F.col("year").between(first, last) & in_group(group)
    if rolling:
        inside = inside & ((F.col("year") != first) | F.col("after_cutoff"))
    by = "year" if view == "year" else "division"
    axis = cube.where(F.col("year").between(first, last) if view == "year" else in_group(group)).select(by).distinct()
    sums = axis.join(slice_cube(cube, measures, inside, [by]), by, "left").withColumn("fights", F.coalesce("fights", F.lit(0)))
    points = sums.select(F.col(by).cast("string").alias("label"), F.when(F.col("fights") >= least, metric(name)).alias("value"), F.col("fights").cast("long").alias("fights"))
    if view != "year":
        return points
    begin = points.where("fights > 0").agg(F.min("label").alias("_begin"))  # one row; null where there is no bout
    return points.join(F.broadcast(begin), F.col("label") >= F.col("_begin")).drop("_begin")
