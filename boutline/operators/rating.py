"""Ratings: display scores, dominance and, in boutline.operators.replay, the ordered replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boutline.functions.bouts import method_category, score_against


def display_scores(df: DataFrame, division: str, rating: str, champion: Column, eligible: Column) -> DataFrame:
    """display_score of each row (F32): the champion 100, others against the best eligible rating (the best of all if none is), 99.9 at most where
    there is a champion or the row isn't eligible."""
    w = W.partitionBy(division)
    reference = F.coalesce(F.max(F.when(eligible, F.col(rating))).over(w), F.max(rating).over(w))
    score = score_against(F.col(rating), reference)
    capped = F.when(F.bool_or(champion).over(w) | ~eligible, F.least(score, F.lit(99.9))).otherwise(score)
    return df.withColumn("display_score", F.when(champion, F.lit(100.0)).otherwise(capped))


def capped_below_champion(df: DataFrame, division: str, score: str, champion: Column, tie: str, among: Column | None = None) -> DataFrame:
    """`capped`: challengers at or over the champion's score go 0.1 a place below it, in their order (equal ones by `tie`), never under 0 (F32).  `among`: whom the cap
    concerns, all if None."""
    w = W.partitionBy(division)
    top = F.max(F.when(champion, F.col(score))).over(w)
    over = ~champion & top.isNotNull() & (F.col(score) >= top) & (F.lit(True) if among is None else among)
    place = F.row_number().over(W.partitionBy(division, over).orderBy(F.col(score).desc(), tie))
    return df.withColumn("capped", F.when(over, F.greatest(F.lit(0.0), top - 0.1 * place)).otherwise(F.col(score)))


def share(a: Column, b: Column) -> Column:
    return F.when(a + b == 0, 0.5).otherwise(a / (a + b))


def dominance(winner: Column, loser: Column) -> Column:
    """struct<score, estimated> of a bout's two sides (R01): method, finish_round, sig_total, ctrl_total, bonus_potn, bonus_fotn, rounds array<struct<round, sig, ctrl, kd>>.

    Rounds are paired by place, as many as both sides have; the finish round is the winner's; within 5 % is half."""
    kind = method_category(winner["method"])
    finish = F.when(kind == "ko_tko", 1.0).when(kind == "submission", 0.9).otherwise(0.0)
    m = F.lower(F.trim(winner["method"]))
    penalty = F.when(m.startswith("decision") & m.contains("split"), 0.1).when(m.startswith("decision") & m.contains("majority"), 0.05).otherwise(0.0)
    flag = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    credit = flag(winner["bonus_potn"], 0.1) + flag(winner["bonus_fotn"], 0.05)
    n = F.least(F.coalesce(F.size(winner["rounds"]), F.lit(0)), F.coalesce(F.size(loser["rounds"]), F.lit(0)))
    points = lambda r: r["sig"] + 0.5 * (F.coalesce(r["ctrl"], F.lit(0)) / 60) + 5 * r["kd"]

    def won(a: Column, b: Column) -> Column:
        x, y = points(a), points(b)
        big = F.greatest(x, y)
        even = F.when(big == 0, F.lit(True)).otherwise(F.abs(x - y) / big <= 0.05)
        return F.when(a["round"].eqNullSafe(winner["finish_round"]), 1.0).when(even, 0.5).when(x > y, 1.0).otherwise(0.0)

    rounds = F.aggregate(F.zip_with(F.slice(winner["rounds"], F.lit(1), F.greatest(n, F.lit(0))), F.slice(loser["rounds"], F.lit(1), F.greatest(n, F.lit(0))), won), F.lit(0.0), lambda s, x: s + x)
    zero = F.lit(0)
    full = 0.3 * finish + 0.35 * rounds / n + 0.2 * share(winner["sig_total"], loser["sig_total"]) + 0.15 * share(F.coalesce(winner["ctrl_total"], zero), F.coalesce(loser["ctrl_total"], zero))
    base = F.when(n > 0, full).otherwise(F.when(kind == "decision", 0.4).otherwise(finish))
    return F.struct(F.least(F.lit(1.0), F.greatest(F.lit(0.0), base - penalty + credit)).alias("score"), (n <= 0).alias("estimated"))
