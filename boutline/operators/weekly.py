"""The weekly batch in one module (R12): replay, eligibility, display scores, streaks and snapshot, each a frame, written as one version of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.functions.bouts import conservative, score_against
from boutline.operators import ordered, rating, relational, replay
from boutline.sources import sinks


def ratings(history: DataFrame, key: str, today: Column, *, least_bouts: int = 0, most_idle: int = 547, champion: Column | None = None) -> DataFrame:
    """key, participant, day, rating, rd, bouts, conservative (rating - 2 rd), eligible, display_score: the last state of each participant, scored against the best eligible one of
    the key by the conservative rating.  Eligible are champions, and whoever had a bout within 18 months (`most_idle` days)."""
    last = replay.final_states(history, key, ["rating", "rd"])
    bouts = history.where("kind = 0").groupBy(key, "participant").agg(F.count("*").alias("bouts"))
    d = last.join(bouts, [key, "participant"], "left").withColumn("bouts", F.coalesce("bouts", F.lit(0))).withColumn("conservative", conservative(F.col("rating"), F.col("rd")))
    leads = F.lit(False) if champion is None else F.coalesce(champion, F.lit(False))
    d = d.withColumn("eligible", leads | (F.col("bouts") >= least_bouts) & (F.datediff(today, "day") <= most_idle))
    return rating.display_scores(d, key, "conservative", leads, F.col("eligible"))


def pound_for_pound(table: DataFrame, scale: str, division: str, champion: Column, tie: str) -> DataFrame:
    """`table` with p4p_score: conservative ratings of all divisions on one scale (a gender's), against its best eligible one; an eligible challenger at or over the
    champion of the own division goes just below (R12)."""
    leads = F.coalesce(champion, F.lit(False))
    best = table.groupBy(F.col(scale).alias("_scale")).agg(F.coalesce(F.max(F.when(F.col("eligible"), F.col("conservative"))), F.max("conservative")).alias("_best"))  # a row a scale
    against = table.join(best, F.col(scale).eqNullSafe(F.col("_scale"))).drop("_scale")
    scored = against.withColumn("_score", score_against(F.col("conservative"), F.col("_best"))).withColumn("_in", leads | F.col("eligible"))
    capped = rating.capped_below_champion(scored.withColumn("_leads", leads), division, "_score", F.col("_leads"), tie, among=F.col("_in"))
    return capped.withColumn("p4p_score", F.col("capped")).drop("_best", "_score", "_in", "_leads", "capped")


def streaks(history: DataFrame, key: str) -> DataFrame:
    """key, participant, streak: the current run of wins (positive) or losses; a no-result counts 0."""
    who = F.struct(key, "participant")
    d = history.withColumns({"_who": who, "_r": F.when(F.col("kind") == 1, "none").when(F.col("won"), "win").otherwise("loss")})
    newest = [F.col("day").desc(), F.col("kind").desc(), F.col("bout_id").desc()]
    return relational.current_streak(d, "_who", newest, "_r", "win", "loss").select("_who.*", "streak")


def snapshot(table: DataFrame, key: str, week: Column, before: DataFrame | None) -> DataFrame:
    """week, key, participant, rating, rank, previous, trend: the eligible ones' places, against those of the newest earlier week of `before`."""
    place = ordered.keyed_eligible_rank(table.where("eligible").select(key, "participant", "rating"), [key], "rating", F.lit(True)).select(week.alias("week"), key, "participant", "rating", F.col("rank").cast("int").alias("rank"))
    if before is None:
        return place.select("*", F.lit(None).cast("int").alias("previous"), F.lit("new").alias("trend"))
    older = before.where(F.col("week") < week)
    newest = older.agg(F.max("week").alias("_w"))  # one row
    last = older.join(F.broadcast(newest), F.col("week") == F.col("_w"), "left_semi").select(key, "participant", F.col("rank").alias("previous"))
    d = place.join(last, [key, "participant"], "left")
    trend = F.when(F.col("previous").isNull(), "new").when(F.col("rank") < F.col("previous"), "up").when(F.col("rank") > F.col("previous"), "down").otherwise("same")
    return d.select("week", key, "participant", "rating", "rank", "previous", trend.alias("trend"))


def run(
    spark: SparkSession,
    bouts: DataFrame,
    key: str,
    out: str,
    *,
    today: Column,
    kind: str = "int",
    dry_run: str | None = None,
    snapshot_only: bool = False,
    streaks_only: bool = False,
    results_only_since: Column | None = None,
) -> dict[str, DataFrame]:
    """Compute and publish ratings, streaks, history and the week's snapshot under `out`; returns them as written.

    dry_run: write the ratings there as JSON and publish nothing. snapshot_only: from the published ratings, the snapshot alone is written anew.
    streaks_only: from the published history, the streaks alone. results_only_since: bouts from that day on have a result but no
    statistics, so half a dominance is taken for them. A run that dies leaves the version before it current."""
    tables = sinks.Versions(spark, out)
    week = F.date_trunc("week", today).cast("date")
    old = {name: tables.read(name) for name in ("ratings", "streaks", "history", "snapshots")}
    kept = {name: df for name, df in old.items() if df is not None}

    def snapshots(of: DataFrame) -> DataFrame:
        before = old["snapshots"]
        now = snapshot(of, key, week, before)
        return now if before is None else before.where(F.col("week") != week).unionByName(now)

    if snapshot_only:
        new = kept | {"snapshots": snapshots(kept["ratings"])}
    elif streaks_only:
        new = kept | {"streaks": streaks(kept["history"], key)}
    else:
        if results_only_since is not None:
            bouts = bouts.withColumn("dominance", F.when(F.col("day") >= results_only_since, 0.5).otherwise(F.col("dominance")))
        history = replay.careers(bouts, key, kind)
        if dry_run:
            return {"ratings": sinks.dry_run(ratings(history, key, today), dry_run)}
        folder = f"{tables.root}/version={tables.number() + 1}"
        history.write.mode("overwrite").parquet(f"{folder}/replayed")  # read three times
        history = spark.read.schema(history.schema).parquet(f"{folder}/replayed")
        table = ratings(history, key, today)
        new = {"history": history, "ratings": table, "streaks": streaks(history, key), "snapshots": snapshots(table)}
    tables.publish(new)
    return {name: tables.read(name) for name in new}
