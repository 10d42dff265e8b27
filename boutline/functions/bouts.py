"""Scalar rules of the bout domain: methods, divisions, picks, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight limits in pounds, lightest first.
DIVISIONS = {"Strawweight": 115, "Flyweight": 125, "Bantamweight": 135, "Featherweight": 145, "Lightweight": 155, "Welterweight": 170, "Middleweight": 185, "Light Heavyweight": 205, "Heavyweight": 265}
WOMEN = ("Strawweight", "Flyweight", "Bantamweight", "Featherweight")
MEN = tuple(d for d in DIVISIONS if d != "Strawweight")
# The divisions of result lists, lightest first; women have the first seven.
RESULT_DIVISIONS = ("Atomweight", *DIVISIONS)
SHARED_DIVISIONS = RESULT_DIVISIONS[:7]


def method_category(method: Column) -> Column:
    """ko_tko, submission, decision or other, by how the label starts, whatever its case."""
    m = F.lower(F.trim(method))
    return F.when(m.rlike("^t?ko"), "ko_tko").when(m.rlike("^(submission|submision|technical submission)"), "submission").when(m.rlike("^(technical )?decision"), "decision").otherwise("other")


def corner_method(method: Column) -> Column:
    """ko, sub, dec or other of the detailed source's labels (F21); null is other."""
    m = F.lower(F.trim(method))
    return F.when(m.rlike("^t?ko"), "ko").when(m.startswith("submission"), "sub").when(m.startswith("decision"), "dec").otherwise("other")


def classify_method(method: Column) -> Column:
    """ko, sub or dec of a clean result, else null; a doctor's stoppage anywhere is a ko."""
    m = F.trim(method)
    return F.when(m.rlike("(?i)^(technical )?decision"), "dec").when(m.rlike("(?i)^(technical )?submission"), "sub").when(m.rlike(r"(?i)^(t?ko)\b|^ko/tko|doctor"), "ko")


def sql_method(method: Column) -> Column:
    """The same without a word boundary, as the SQL form has it."""
    return F.when(method.rlike("(?i)^(technical )?decision"), "dec").when(method.rlike("(?i)^(technical )?submission"), "sub").when(method.rlike("(?i)^t?ko|doctor"), "ko")


def weight_class(label: Column) -> Column:
    """One of the twelve ranked divisions, trimmed and without "Interim"; else null."""
    known = [*MEN, *(f"Women's {d}" for d in WOMEN)]
    plain = F.trim(label)
    bare = F.regexp_replace(plain, r"(?i)^interim\s+", "")
    return F.when(plain.isin(known), plain).when(bare.isin(known), bare)


def display_weight_class(label: Column, is_women: Column) -> Column:
    """The label, with "Women's" before a division that both have, where a woman fights."""
    return F.when(F.coalesce(is_women, F.lit(False)) & label.isin(*SHARED_DIVISIONS), F.concat(F.lit("Women's "), label)).otherwise(label)


def results_division(label: Column) -> Column:
    """One of the 17 divisions of result lists, trimmed; else null."""
    plain = F.trim(label)
    return F.when(plain.isin(*RESULT_DIVISIONS, *(f"Women's {d}" for d in SHARED_DIVISIONS)), plain)


def nearest_division(label: Column, is_women: Column) -> Column:
    """"157lb Catchweight" to the nearest limit, the lighter of two; null for a label that is anything else."""
    pounds = F.regexp_extract(F.regexp_replace(F.trim(label), r"\s+", " "), r"(?i)^(\d{3})\s*lb\s*catch\s*weight$", 1).try_cast("int")

    def nearest(names):
        options = F.array(*(F.struct(F.abs(pounds - DIVISIONS[n]).alias("gap"), F.lit(k).alias("k"), F.lit(n).alias("name")) for k, n in enumerate(names)))
        return F.array_min(options)["name"]

    return F.when(pounds.isNotNull(), F.when(is_women, F.concat(F.lit("Women's "), nearest(WOMEN))).otherwise(nearest(MEN)))


def results_only_division(label: Column, is_women: Column) -> Column:
    """The ranked division of a bout known by its result alone: the label, as "Women's" for a women's bout, else the nearest of a catchweight."""
    plain, women = F.trim(F.coalesce(label, F.lit(""))), F.coalesce(is_women, F.lit(False))
    labelled = F.when(women & ~plain.rlike("(?i)^women"), F.concat(F.lit("Women's "), plain)).otherwise(plain)
    return F.coalesce(weight_class(labelled), nearest_division(plain, women))


def scheduled_rounds(is_main: Column, is_title: Column) -> Column:
    return F.when(F.coalesce(is_main, F.lit(False)) | F.coalesce(is_title, F.lit(False)), 5).otherwise(3)


def score_pick(pick_winner: Column, pick_method: Column, pick_round: Column, winner: Column, method: Column, round_: Column) -> Column:
    """10 for the winner, 5 more for the method, 5 more for the round of a finish; 0 without a winner."""
    right = winner.isNotNull() & (pick_winner == winner)
    by = right & (pick_method == method)
    at = by & (method != "decision") & (pick_round == round_)
    part = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    return part(right, 10) + part(by, 5) + part(at, 5)


def is_locked(now: Column, prelims: Column, start: Column, day: Column) -> Column:
    """Whether an event has begun."""
    return now >= F.coalesce(prelims, start, F.to_timestamp(day))


def pick_fault(method: Column, round_: Column, scheduled: Column, locked: Column) -> Column:
    """Why a pick isn't accepted, else null (F28): an unknown method, a finish without a round of those scheduled, an event that has begun.  A decision needs no
    round, and one given with it isn't looked at."""
    known = F.coalesce(method.isin("ko_tko", "submission", "decision"), F.lit(False))
    in_time = F.coalesce(round_.between(F.lit(1), scheduled), F.lit(False))
    return F.when(~known, "method").when((method != "decision") & ~in_time, "round").when(locked, "locked")


def picked_round(method: Column, round_: Column) -> Column:
    """The round that is kept of an accepted pick."""
    return F.when(method != "decision", round_)


def rank_trend(now: Column, before: Column, had_week: Column) -> Column:
    """none, new, same, up or down."""
    return F.when(~had_week, "none").when(before.isNull(), "new").when(before == now, "same").when(before > now, "up").otherwise("down")


def months_eligible(months: Column, champion: Column, cutoff: float = 18.0) -> Column:
    return champion | (months <= cutoff)


def home_division(official: Column, official_months: Column, last: Column, cutoff: float = 18.0) -> Column:
    """The one division that someone is ranked in (F30): the official one, if the last bout there is at most `cutoff` months ago, else the division of the last
    bout.  official_months: months since the last bout in the official division, null for none."""
    return F.when(official.isNotNull() & F.coalesce(official_months <= cutoff, F.lit(False)), official).otherwise(last)


def eligible_in_division(champion: Column, home: Column, months: Column, cutoff: float = 18.0) -> Column:
    """Whether a row is in its division's ranking (F30): champions are, others where it is their home and their last bout there isn't too long ago."""
    return F.coalesce(champion, F.lit(False)) | (F.coalesce(home, F.lit(False)) & F.coalesce(months <= cutoff, F.lit(False)))


def conservative(rating: Column, rd: Column, k: float = 2.0) -> Column:
    return rating - k * rd


def score_against(rating: Column, reference: Column) -> Column:
    """0 to 100 against a reference that counts 100."""
    return F.least(F.lit(100.0), F.lit(200.0) / (1 + F.pow(F.lit(10.0), (reference - rating) / 400)))


def result_of(css: Column) -> Column:
    """win, loss, draw, nc or not_finished of a result badge's classes: the first of win, loss, draw and no_contest that they hold."""
    return F.when(css.contains("win"), "win").when(css.contains("loss"), "loss").when(css.contains("draw"), "draw").when(css.contains("no_contest"), "nc").otherwise("not_finished")


def repaired_finished(finished: Column, method: Column) -> Column:
    return F.coalesce(finished, F.lit(False)) | F.coalesce(F.trim(method) != "", F.lit(False))


def sigmoid(z: Column) -> Column:
    """Stable at both ends."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logit(p: Column, floor: float = 1e-9) -> Column:
    q = F.least(F.greatest(p, F.lit(floor)), F.lit(1 - floor))
    return F.log(q / (1 - q))


def log_loss(p: Column, y: Column, floor: float = 1e-12) -> Column:
    q = F.least(F.greatest(F.when(y == 1, p).otherwise(1 - p), F.lit(floor)), F.lit(1 - floor))
    return F.avg(-F.log(q))


def record(wins: Column, losses: Column, draws: Column) -> Column:
    return F.concat_ws("-", wins.cast("string"), losses.cast("string"), draws.cast("string"))


def scraped_or_counts(record_: Column, wins: Column, losses: Column, draws: Column) -> Column:
    """The record counted from results, unless it holds fewer than the one given (A27).  The counts are aggregates, so no list of results is made."""
    total = lambda k: F.coalesce(F.split_part(record_, F.lit("-"), F.lit(k)).try_cast("int"), F.lit(0))
    given = total(1) + total(2) + total(3)
    return F.when(record_.isNull() | (wins + losses + draws >= given), record(wins, losses, draws)).otherwise(record_)
