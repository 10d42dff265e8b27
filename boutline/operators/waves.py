"""Career ratings of one large pool without a single task (R05): bouts are applied in waves, each a join with a table of states.

A bout is ready once both its participants' earlier bouts are done.  All bouts that are ready at once concern different people, so a wave is one join of the pending bouts
with the states, column arithmetic, and two new states a bout.  There are as many waves as the longest chain of bouts that hang on each other, at least the longest
career.  Waves grow small towards the end, so what is left below `fold_below` bouts goes on in `replay.careers` from the states reached.  States are kept only of people
who have bouts still to come, so the one task of that fold holds a bounded number of bouts and at most two states for each.  Every wave's tables are checkpointed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boutline.operators import replay
from boutline.operators.durable import checkpointed
from boutline.operators.replay import MONTH, Q, Glicko

#: Bouts that one task folds at the end.
FOLD_BELOW = 200_000

STATE = ("done", "rating", "rd", "last", "of", "bouts")


def _arrived(p: Glicko, s: Column, given: Column, day: Column, division: Column, decided: Column) -> Column:
    """struct<rating, rd, moved, bouts, rated> of a side as its bout begins: deviation grown with idle time, and moved between divisions."""
    new = F.coalesce(F.when(~F.isnan(given), given), F.lit(p.rating))
    idle = F.greatest(F.lit(0), F.datediff(day, s["last"])) / MONTH
    grown = F.when(idle > 0, F.least(F.lit(p.rd), F.sqrt(s["rd"] * s["rd"] + p.rd_month**2 * idle))).otherwise(s["rd"])
    moved = F.coalesce(s["of"] != division, F.lit(False))
    old = F.struct(
        F.when(moved, p.rating + (s["rating"] - p.rating) * p.carry).otherwise(s["rating"]).alias("rating"),
        F.when(moved, F.least(F.lit(p.rd), F.sqrt(grown * grown + p.rd_move**2))).otherwise(grown).alias("rd"), moved.alias("moved"), s["bouts"].alias("bouts"),
    )
    begin = F.struct(new.alias("rating"), F.lit(p.rd).alias("rd"), F.lit(False).alias("moved"), F.lit(0).cast("long").alias("bouts"))
    return F.when(s["rating"].isNotNull(), old).when(decided, begin)


def _updated(p: Glicko, own: Column, other: Column, score: Column) -> Column:
    g = 1 / F.sqrt(1 + 3 * F.pow(Q * other["rd"] / math.pi, F.lit(2)))
    e = 1 / (1 + F.pow(F.lit(10.0), -g * (own["rating"] - other["rating"]) / 400))
    variance = 1 / (F.pow(own["rd"], F.lit(-2)) + Q * Q * g * g * e * (1 - e))
    return F.struct((own["rating"] + Q * variance * g * (score - e)).alias("rating"), F.greatest(F.lit(p.least_rd), F.sqrt(variance)).alias("rd"))


def careers(bouts: DataFrame, kind: str = "int", params: Glicko = Glicko(), fold_below: int = FOLD_BELOW) -> DataFrame:
    """The rows of `replay.careers` (without places) for all bouts as one pool: the columns of bouts but the key, and a column `key` that is 0 in the result.

    Rows without a day, winner or loser are left out; equal ids on one day are not told apart.  Only parameters that start unknown participants at the base: the mean
    of the known starts so far hangs on all bouts before.  A pool whose next wave is empty, as where someone meets themself, is folded from there."""
    if params.unknown != "base":
        raise ValueError("only parameters that start unknown participants at the base go in waves")
    given = bouts.select("bout_id", "day", "kind", "winner", "loser", "division", "dominance", *(F.col(c).cast("double").alias(c) for c in ("start_winner", "start_loser"))).dropna(subset=["day", "kind", "bout_id", "winner", "loser"])
    order = W.partitionBy("person").orderBy("day", "kind", "bout_id")
    sides = given.select("bout_id", "day", "kind", F.posexplode(F.array("winner", "loser")).alias("side", "person")).withColumns({"n": F.row_number().over(order) - 1, "final": F.lead("bout_id").over(order).isNull()})
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    turn = sides.groupBy("bout_id", "day", "kind").agg(of(0, "n").alias("turn_w"), of(1, "n").alias("turn_l"), of(0, "final").alias("final_w"), of(1, "final").alias("final_l"))
    pending = checkpointed(given.join(turn, ["bout_id", "day", "kind"]))
    left = pending.count()
    states = pending.sparkSession.createDataFrame([], f"person {kind}, done int, rating double, rd double, last date, of string, bouts long")
    rows: list[DataFrame] = []
    before = None
    while left > fold_below and left != before:
        side = lambda s: states.select(F.col("person").alias(s), F.struct(*STATE).alias(f"_{s}"))  # noqa: B023, E731
        joined = pending.join(side("winner"), "winner", "left").join(side("loser"), "loser", "left")
        done = lambda s: F.coalesce(F.col(f"_{s}.done"), F.lit(0))
        ready = joined.where((done("winner") == F.col("turn_w")) & (done("loser") == F.col("turn_l")))
        decided = F.col("kind") == 0
        for s in ("winner", "loser"):
            ready = ready.withColumn(f"_{s}_at", _arrived(params, F.col(f"_{s}"), F.col(f"start_{s}"), F.col("day"), F.col("division"), decided))
        score = params.win_floor + (1 - params.win_floor) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("dominance")))
        own, other = F.col("_winner_at"), F.col("_loser_at")
        same = lambda s: F.struct(F.col(f"_{s}_at.rating").alias("rating"), F.col(f"_{s}_at.rd").alias("rd"))
        ready = ready.withColumns({"_winner_after": F.when(decided, _updated(params, own, other, score)).otherwise(same("winner")), "_loser_after": F.when(decided, _updated(params, other, own, 1 - score)).otherwise(same("loser"))})
        wave = checkpointed(ready)

        def line(s: str, won: bool) -> Column:
            at, after = F.col(f"_{s}_at"), F.col(f"_{s}_after")
            return F.struct(
                F.col(s).alias("participant"), F.when(decided, won).alias("won"), at["rating"].alias("rating_at"), at["rd"].alias("rd_at"), F.when(at.isNotNull(), after["rating"]).alias("rating"), F.when(at.isNotNull(), after["rd"]).alias("rd"),  # noqa: B023
                at["moved"].alias("moved"), at["bouts"].alias("bouts_before"), (F.coalesce(F.col(f"_{s}.done"), F.lit(0)) + 1).alias("done"), F.col(f"final_{s[0]}").alias("final"),
            )

        both = wave.select("day", "kind", "bout_id", "division", F.explode(F.array(line("winner", True), line("loser", False))).alias("s")).select("day", "kind", "bout_id", "division", "s.*")
        rated = F.col("rating").isNotNull()
        rows.append(both.where(rated).drop("done", "final"))
        new = both.where("NOT final").select(F.col("participant").alias("person"), F.col("done").cast("int").alias("done"), "rating", "rd", F.when(rated, F.col("day")).alias("last"), F.when(rated, F.col("division")).alias("of"), F.when(rated, F.col("bouts_before") + (F.col("kind") == 0).cast("long")).alias("bouts"))
        seen = both.select(F.col("participant").alias("person"))
        states = checkpointed(states.join(seen, "person", "left_anti").unionByName(new))
        pending = checkpointed(pending.join(wave.select("bout_id", "day", "kind"), ["bout_id", "day", "kind"], "left_anti"))
        before, left = left, pending.count()
    if left:
        reached = states.where("rating IS NOT NULL").select(F.lit(0).cast("long").alias("key"), F.col("person").alias("participant"), "rating", "rd", F.col("last").alias("day"), F.col("of").alias("division"), "bouts")
        rest = pending.select(F.lit(0).cast("long").alias("key"), "day", "kind", "bout_id", "winner", "loser", "division", "dominance", "start_winner", "start_loser")
        # a state's day may be that of a bout still to come: states stand before the bouts of their day by their kind
        rows.append(replay.careers(rest.unionByName(replay.seeds(reached, "key").select(*rest.columns)), "key", kind, params).drop("key", "place_at"))
    out = rows[0] if rows else None
    for more in rows[1:]:
        out = out.unionByName(more)
    out = replay.careers(given.select(F.lit(0).cast("long").alias("key"), "*"), "key", kind, params).drop("key", "place_at") if out is None else out
    return out.select(F.lit(0).cast("long").alias("key"), "day", "kind", "bout_id", "participant", "won", "rating_at", "rd_at", "rating", "rd", "moved", "bouts_before", F.lit(None).cast("int").alias("place_at"), "division")
