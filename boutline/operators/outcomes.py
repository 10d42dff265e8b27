"""How and when a bout ends: profiles before the day (M17), method and round by winner (M07), sided training rows (M02), earlier divisions.

A profile is a struct of the weighted counts of a participant's results: wins and losses by method, and number and round sum of finishes won and lost.
All of it is Columns and one window a participant; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METHODS = ("ko", "sub", "dec")
COUNTS = (*(f"{side}_{m}" for side in ("win", "loss") for m in METHODS), "won_n", "won_rounds", "lost_n", "lost_rounds")


@dataclass(frozen=True)
class OutcomeParams:
    """Where the search for the constants starts."""

    shrinkage: float = 6
    winner: float = 1
    loser: float = 1
    cross: float = 0.5
    round_shrinkage: float = 6
    round_tilt: float = 0.3
    external: float = 0.5


def result_rows(bouts: DataFrame, external: float) -> DataFrame:
    """A row a participant (person, day, and their counts) of bouts (day, source, winner, loser, method, finish); `external` weighs sources other than `own`."""
    weight = F.when(F.col("source") == "own", 1.0).otherwise(external)
    finished = F.col("method").isin("ko", "sub") & (F.col("finish") > 0)

    def of(won: bool) -> DataFrame:
        side, other, end = ("win", "loss", "won") if won else ("loss", "win", "lost")
        own = {f"{side}_{m}": F.when(F.col("method") == m, weight) for m in METHODS} | {f"{end}_n": F.when(finished, weight), f"{end}_rounds": F.when(finished, weight * F.col("finish"))}
        return bouts.select(F.col("winner" if won else "loser").alias("person"), "day", *(F.coalesce(own.get(c, F.lit(0.0)), F.lit(0.0)).cast("double").alias(c) for c in COUNTS))

    return of(True).unionByName(of(False)).where("person IS NOT NULL AND day IS NOT NULL")


def profiles_before(bouts: DataFrame, external: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """bout_id, the columns in `keep`, winner_profile, loser_profile for the bouts of source `own` (M17): what each side had done strictly before the day, all sources counted.

    Results are summed by participant and day first, so a participant's window has a row a day; bouts with a method outside ko, sub and dec count
    for nothing and get no row, as do rows without an id, a day or a side."""
    fine = bouts.where(F.col("method").isin(*METHODS) & F.col("bout_id").isNotNull() & F.col("winner").isNotNull() & F.col("loser").isNotNull() & F.col("day").isNotNull())
    days = result_rows(fine, external).groupBy("person", "day").agg(*(F.sum(c).alias(c) for c in COUNTS))
    before = W.partitionBy("person").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    had = days.select("person", "day", F.struct(*(F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(c) for c in COUNTS)).alias("profile"))
    own = fine.where("source = 'own'").select("bout_id", "day", "winner", "loser", *keep)
    for side in ("winner", "loser"):
        own = own.join(had.select(F.col("person").alias(side), "day", F.col("profile").alias(f"{side}_profile")), [side, "day"])
    return own.select("bout_id", *keep, "winner_profile", "loser_profile")


def _shares(of: dict[str, Column]) -> dict[str, Column]:
    total = sum(of.values(), F.lit(0.0))
    return {m: x / total for m, x in of.items()}


def context_mix(mixes: list[Column], everywhere: Column, five_rounds: Column, factor: Column) -> Column:
    """struct<ko, sub, dec> that a bout starts from: the mean of its divisions' mixes (null: that of all), times `factor` for five rounds."""
    mean = {m: sum((F.coalesce(x[m], everywhere[m]) for x in mixes), F.lit(0.0)) / len(mixes) for m in METHODS}
    long = _shares({m: mean[m] * factor[m] for m in METHODS})
    return F.struct(*(F.when(five_rounds, long[m]).otherwise(mean[m]).alias(m) for m in METHODS))


def with_outcome_lines(df: DataFrame, name: str, win_a: str, a: str, b: str, prior: str, rounds: dict[str, Column], mean_round: float, p: OutcomeParams = OutcomeParams()) -> DataFrame:
    """`df` with `name`: array<struct<corner, method, probability, by_round>>, the six ways a bout can end, which add up to 1 (M07).  win_a: the odds of corner A; a, b: the corners'
    records; prior: struct<ko, sub, dec>; `rounds`: base shares by method, as arrays; a decision has no rounds.

    Each step (tallies, moved shares, their total, tilts, their totals) is bound to a variable that the next one reads (`_let`): columns would be put into each other again by the
    optimizer, wherever they are read, and worked out anew each time."""
    corners = ("A", "B")

    def tallies(v: Column) -> Column:
        found = []
        for corner, w, x in (("A", v["a"], v["b"]), ("B", v["b"], v["a"])):
            ways = {"winner": {m: w[f"win_{m}"] for m in METHODS}, "loser": {m: x[f"loss_{m}"] for m in METHODS}, "cross": {m: w[f"loss_{m}"] + x[f"win_{m}"] for m in METHODS}}
            for way, tally in ways.items():
                found += [tally[m].alias(f"{corner}_{way}_{m}") for m in METHODS] + [sum(tally.values(), F.lit(0.0)).alias(f"{corner}_{way}")]
            n, total = w["won_n"] + x["lost_n"], w["won_rounds"] + x["lost_rounds"]
            found.append(((total + p.round_shrinkage * mean_round) / (n + p.round_shrinkage) - mean_round).alias(f"{corner}_late"))
        return F.struct(*found, *(v["q"][m].alias(f"q_{m}") for m in METHODS), v["win"].alias("A_win"), (1 - v["win"]).alias("B_win"))

    def moved(v: Column) -> Column:
        share = lambda corner, way, m: (v[f"{corner}_{way}_{m}"] + p.shrinkage * v[f"q_{m}"]) / (v[f"{corner}_{way}"] + p.shrinkage)
        lift = lambda corner, m: sum((getattr(p, way) * F.ln(share(corner, way, m) / v[f"q_{m}"]) for way in ("winner", "loser", "cross")), F.lit(0.0))
        found = [(v[f"q_{m}"] * F.exp(lift(corner, m))).alias(f"{corner}_{m}") for corner in corners for m in METHODS]
        tilts = [_tilted(base, v[f"{corner}_late"], p.round_tilt).alias(f"{corner}_{m}_tilt") for corner in corners for m, base in rounds.items()]
        return F.struct(*found, *tilts, *(v[f"{corner}_win"].alias(f"{corner}_win") for corner in corners))

    def totals(v: Column) -> Column:
        found = []
        for corner in corners:
            found.append(sum((v[f"{corner}_{m}"] for m in METHODS), F.lit(0.0)).alias(f"{corner}_all"))
            found += [F.aggregate(v[f"{corner}_{m}_tilt"], F.lit(0.0), lambda s, y: s + y).alias(f"{corner}_{m}_sum") for m in rounds]
        return F.struct(v.alias("v"), *found)

    def chances(t: Column) -> Column:
        v = t["v"]
        found = [(v[f"{corner}_win"] * v[f"{corner}_{m}"] / t[f"{corner}_all"]).alias(f"{corner}_{m}") for corner in corners for m in METHODS]
        return F.struct(t.alias("t"), *found)

    def lines(c: Column) -> Column:
        def line(corner: str, m: str) -> Column:
            by_round = F.array().cast("array<double>")
            if m in rounds:
                by_round = F.transform(c["t"]["v"][f"{corner}_{m}_tilt"], lambda x: c[f"{corner}_{m}"] * x / c["t"][f"{corner}_{m}_sum"])
            return F.struct(F.lit(corner).alias("corner"), F.lit(m).alias("method"), c[f"{corner}_{m}"].alias("probability"), by_round.alias("by_round"))

        return F.array(*(line(corner, m) for corner in corners for m in METHODS))

    given = F.struct(F.col(win_a).alias("win"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(prior).alias("q"))
    return df.select("*", _let(_let(_let(_let(_let(given, tallies), moved), totals), chances), lines).alias(name))


def _let(value: Column, body) -> Column:
    """`body(value)`, for which the value is worked out once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tilted(base: Column, late: Column, tilt: float) -> Column:
    return F.transform(base, lambda share, k: share * F.exp(tilt * late * k))


def sided(df: DataFrame, ident: str, features: list[str], seed: int = 7) -> DataFrame:
    """`df` with label 1 and its features (winner less loser) as they are, or label 0 and all of them negated (M02): a coin that the id and the seed decide, so
    that a rerun, a lost executor or another partitioning gives the same rows."""
    heads = F.substring(F.md5(F.concat_ws(":", F.col(ident).cast("string"), F.lit(str(seed)))), 1, 1) < "8"
    return df.withColumns({f: F.when(heads, F.col(f)).otherwise(-F.col(f)) for f in features} | {"label": heads.cast("int")})


def with_movers(bouts: DataFrame) -> DataFrame:
    """`bouts` (bout_id, day, division, winner, loser, ...) with `mover`: whether a side has an earlier bout in another division (M12). The least and greatest of
    the earlier divisions tell; days are summed first."""
    sides = bouts.select("day", "division", F.explode(F.array("winner", "loser")).alias("person"))
    days = sides.dropna().groupBy("person", "day").agg(F.min("division").alias("low"), F.max("division").alias("high"))
    before = W.partitionBy("person").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    seen = days.select("person", "day", F.min("low").over(before).alias("low"), F.max("high").over(before).alias("high"))
    for side in ("winner", "loser"):
        bouts = bouts.join(seen.select(F.col("person").alias(side), "day", F.col("low").alias(f"_{side}_low"), F.col("high").alias(f"_{side}_high")), [side, "day"], "left")
    other = lambda side: (F.col(f"_{side}_low") != F.col("division")) | (F.col(f"_{side}_high") != F.col("division"))
    moved = F.coalesce(other("winner"), F.lit(False)) | F.coalesce(other("loser"), F.lit(False))
    return bouts.withColumn("mover", moved).drop(*(f"_{s}_{x}" for s in ("winner", "loser") for x in ("low", "high")))
