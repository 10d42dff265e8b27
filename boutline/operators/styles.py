"""Recent rates, styles relative to a division, rows made ready for a replay, and checks of its outcome (R08-R11, R13). All are windows and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The axes in their order of preference, each with the rates whose z-scores it averages, its label, and the least rates that count.
AXES = {
    "grappling": ("takedowns", "control", "ground"),
    "submission": ("submissions",),
    "distance": ("distance", "head"),
    "power": ("knockdowns",),
    "clinch": ("clinch", "clinch_share"),
}
COUNTS = ("takedowns", "control", "ground", "submissions", "distance", "head", "clinch", "knockdowns", "sig")
THRESHOLD, PRIOR_SECONDS, LEAST_BOUTS, LEAST_SECONDS, LEAST_POOL = 0.6, 2700, 3, 900, 10


def _floors() -> dict[str, Column]:
    # Fixed values.
    c = F.col
    return {
        "grappling": (c("_takedowns") >= 1.8) | (c("_control") / 900 >= 0.25), "submission": c("_submissions") >= 0.8, "distance": c("_distance_share") >= 0.65,
        "power": c("_knockdowns") >= 0.45, "clinch": c("_clinch_share") >= 0.19,
    }


def _z(value: str, w, of: Column) -> Column:
    """z-score against the rows where `of` holds; 0 where these hardly differ."""
    inside = F.when(of, F.col(value))
    spread = F.stddev_pop(inside).over(w)
    return F.when(spread < 1e-9, 0.0).otherwise((F.col(value) - F.avg(inside).over(w)) / spread)


def styles(totals: DataFrame, division: str, bouts: str, reference: str) -> DataFrame:
    """Adds `style` (R11): the axis on which a participant stands out most from the reference of their division, else balanced; null for too little history
    or a division of fewer than ten. Columns: seconds and COUNTS, decayed over bouts; where fewer than ten are of the reference, all are. Ties go to the
    earlier axis. A division's rows are read by windows that Spark may spill."""
    w = W.partitionBy(division, "_eligible")
    d = totals.withColumn("_eligible", F.coalesce((F.col(bouts) >= LEAST_BOUTS) & (F.col("seconds") >= LEAST_SECONDS), F.lit(False)))
    flagged = F.count_if(F.col(reference)).over(w) >= LEAST_POOL
    d = d.withColumn("_n", F.count("*").over(w)).withColumn("_of", F.coalesce(F.col(reference), F.lit(False)) | ~flagged)
    pool = lambda name: F.sum(F.when(F.col("_of"), F.col(name))).over(w)
    seconds = pool("seconds")
    rate = lambda name: 900 * (F.col(name) + PRIOR_SECONDS * F.when(seconds > 0, pool(name) / seconds).otherwise(0.0)) / (F.col("seconds") + PRIOR_SECONDS)
    d = d.select("*", *(rate(name).alias(f"_{name}") for name in COUNTS))
    part = lambda name: F.when(F.col("_sig") > 0, F.col(f"_{name}") / F.col("_sig")).otherwise(0.0)
    d = d.withColumns({"_clinch_share": part("clinch"), "_distance_share": part("distance")})
    names = sorted({x for axis in AXES.values() for x in axis})
    d = d.select("*", *(_z(f"_{x}", w, F.col("_of")).alias(f"_z_{x}") for x in names))
    d = d.select("*", *((sum((F.col(f"_z_{x}") for x in rates), F.lit(0.0)) / len(rates)).alias(f"_a_{axis}") for axis, rates in AXES.items()))
    d = d.select("*", *(_z(f"_a_{axis}", w, F.col("_of")).alias(f"_s_{axis}") for axis in AXES))
    floors = _floors()
    options = [F.when((F.col(f"_s_{axis}") >= THRESHOLD) & floors[axis], F.struct(F.col(f"_s_{axis}").alias("score"), F.lit(-i).alias("order"), F.lit(axis).alias("label"))) for i, axis in enumerate(AXES)]
    best = F.array_max(F.filter(F.array(*options), lambda x: x.isNotNull()))["label"]
    style = F.when(F.col("_eligible") & (F.col("_n") >= LEAST_POOL), F.coalesce(best, F.lit("balanced")))
    return d.select(*totals.columns, style.alias("style"))


def recent_rates(df: DataFrame, key: str, order: list[str], minutes: str, counts: list[str], bouts: int = 5, score: str | None = None, scores: int = 3) -> DataFrame:
    """Adds for each row the rates per 15 minutes over the key's last `bouts` rows strictly before it, 0 without any (R09, R10), and, of `score`, the mean of
    the last `scores`, 0.5 without any."""
    before = W.partitionBy(key).orderBy(*order).rowsBetween(-bouts, -1)
    total = F.sum(minutes).over(before)
    d = df.select("*", *(F.when(total > 0, 15 * F.sum(c).over(before) / total).otherwise(0.0).alias(f"{c}_rate") for c in counts))
    return d if score is None else d.withColumn(f"recent_{score}", F.coalesce(F.avg(score).over(W.partitionBy(key).orderBy(*order).rowsBetween(-scores, -1)), F.lit(0.5)))


def profile_diff(pairs: DataFrame, a: str, b: str, fields: list[str]) -> DataFrame:
    """Adds the field-by-field differences of two profile structs."""
    return pairs.select("*", *((F.col(f"{a}.{f}") - F.col(f"{b}.{f}")).alias(f"{f}_diff") for f in fields))


def results_only(rows: DataFrame, division: Column) -> tuple[DataFrame, DataFrame]:
    """(bouts for a replay, counts of what was left out) of rows with first, second, winner_id, method, round, is_title, is_main (R08): without a winner a draw or
    no contest is a no-result, anything else is incomplete and skipped.  `finish_round` is null for a decision, whose last round isn't where it was won."""
    method = F.trim(F.coalesce("method", F.lit("")))
    fate = F.when(division.isNull(), "division").when(F.col("winner_id").isNotNull(), "bout").when(method.rlike(r"(?i)^(draw|no contest|nc)\b"), "none").otherwise("result")
    d = rows.withColumns({"division": division, "_fate": fate})
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    won = F.col("_fate") == "bout"
    bouts = d.where("_fate IN ('bout', 'none')").withColumns({
        "kind": F.when(won, 0).otherwise(1), "winner": F.when(won, F.col("winner_id")).otherwise(F.col("first")),
        "loser": F.when(won & (F.col("winner_id") == F.col("second")), F.col("first")).otherwise(F.col("second")),
        "finish_round": F.when(~F.lower(method).startswith("decision"), F.col("round")),
        "is_draw": ~won & method.rlike("(?i)^draw"), "is_five": flag("is_title") | flag("is_main"), "is_title": flag("is_title"),
    }).drop("_fate", "winner_id")
    skipped = d.where("_fate IN ('division', 'result')").groupBy(F.col("_fate").alias("missing")).agg(F.count("*").alias("n"))
    return bouts, skipped


def check(name: str, df: DataFrame, bad: Column, detail: Column) -> DataFrame:
    """One row: name, passed, details (R13): the first 20 rows in breach by detail, which is the report's size; n counts them all."""
    broken = df.where(bad).select(detail.cast("string").alias("detail"))
    shown = broken.orderBy("detail").limit(20).agg(F.array_sort(F.collect_list("detail")).alias("details"))
    # Both sides are one row.
    return broken.agg(F.count("*").alias("n")).join(F.broadcast(shown)).select(F.lit(name).alias("name"), (F.col("n") == 0).alias("passed"), "n", "details")
