"""Dates, durations and ages as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# French month names; a month is 30.44 days and a year 365.25.
FRENCH_MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")


def iso_date(c: Column) -> Column:
    """Date of a text that is exactly an ISO date, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def normalize_date(c: Column, strict: bool = False) -> Column:
    """The ISO date that a text starts with (F12); strict raises where there is none."""
    d = F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1)
    bad = F.raise_error(F.concat(F.lit("not a date: "), c)).cast("string") if strict else F.lit(None).cast("string")
    return F.when(d != "", d).otherwise(bad)


def long_date(c: Column) -> Column:
    """"May / 16 / 2026", "Jul 19, 1987" or "August 15, 2026" to ISO, else null."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(c, r"[/,]", " "), r"\s+", " "))
    parts = F.concat_ws(" ", F.substring(F.split_part(flat, F.lit(" "), F.lit(1)), 1, 3), F.split_part(flat, F.lit(" "), F.lit(2)), F.split_part(flat, F.lit(" "), F.lit(3)))
    return F.when(flat.rlike(r"^[A-Za-z]{3,9} \d{1,2} \d{4}$"), F.date_format(F.try_to_date(parts, "MMM d yyyy"), "yyyy-MM-dd"))


def french_date(d: Column) -> Column:
    """"16 mai 2026" (F11)."""
    months = F.array(*map(F.lit, FRENCH_MONTHS))
    return F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.get(months, F.month(d) - 1), F.year(d).cast("string"))


def paris_time(ts: Column) -> Column:
    """"20h00" in Paris; midnight UTC means unknown."""
    return F.when(F.date_format(ts, "HH:mm:ss") != "00:00:00", F.date_format(F.from_utc_timestamp(ts, "Europe/Paris"), "HH'h'mm"))


def week_start(d: Column) -> Column:
    """Monday of the week."""
    return F.to_date(F.date_trunc("week", d))


def week_end(d: Column) -> Column:
    return F.date_add(week_start(d), 6)


def months_between(a: Column, b: Column) -> Column:
    """Days / 30.44, never negative, 0 if there is no first date."""
    return F.coalesce(F.greatest(F.lit(0.0), F.datediff(b, a) / 30.44), F.lit(0.0))


def age_years(birth: Column, at: Column) -> Column:
    """Age in years of 365.25 days, to 2 places."""
    return F.round(F.datediff(at, birth) / 365.25, 2)


def calendar_age(birth: Column, at: Column) -> Column:
    """Birthdays passed; null outside 0..99."""
    a = F.floor(F.months_between(at, birth) / 12)
    return F.when((a >= 0) & (a <= 99), a)


def _clock(c: Column, k: int) -> Column:
    return F.regexp_extract(c, r"^(\d+):(\d{2})$", k).try_cast("double")


def minutes_fought(round_: Column, clock: Column) -> Column:
    """Duration policy a: 0 where the clock is malformed."""
    return F.when(clock.rlike(r"^\d+:\d{2}$"), (round_ - 1) * 5 + _clock(clock, 1) + _clock(clock, 2) / 60).otherwise(0.0)


def fight_minutes(round_: Column, clock: Column) -> Column:
    """Duration policy b: 5:00 of round 3 by default, half a minute at least."""
    c = F.coalesce(clock, F.lit("5:00"))
    m, s = F.split_part(c, F.lit(":"), F.lit(1)).try_cast("double"), F.split_part(c, F.lit(":"), F.lit(2)).try_cast("double")
    return F.greatest(F.lit(0.5), (F.coalesce(round_, F.lit(3)) - 1) * 5 + F.when(m.isNotNull(), m + F.coalesce(s, F.lit(0.0)) / 60).otherwise(5.0))


def fight_seconds(round_: Column, clock: Column) -> Column:
    """Duration policy d: null where the clock or the round is missing."""
    return F.when(clock.rlike(r"^\d+:\d{2}$") & round_.isNotNull(), (round_ - 1) * 300 + _clock(clock, 1) * 60 + _clock(clock, 2))


def next_event(df, date: Column, as_of: Column):
    """The next dated row, else the last one (F16), as one struct."""
    row = F.struct("*")
    best = df.agg(F.min_by(row, F.when(date >= as_of, date)).alias("next"), F.max_by(row, F.when(date < as_of, date)).alias("last"))
    return best.select(F.coalesce("next", "last").alias("e")).select("e.*")


def next_events_by(df, key: str, date: str, tie: str, as_of: Column):
    """key, event (the next dated row of the key, else its last), is_upcoming, events: how many rows it has (F16).  Of one day the smallest `tie` comes first, and the
    largest is last; rows without a date only count."""
    row, order = F.struct("*"), F.struct(date, tie)
    ahead = F.col(date) >= as_of
    best = df.groupBy(key).agg(F.min_by(row, F.when(ahead, order)).alias("_next"), F.max_by(row, F.when(~ahead, order)).alias("_last"), F.count("*").alias("events"))
    return best.select(key, F.coalesce("_next", "_last").alias("event"), F.col("_next").isNotNull().alias("is_upcoming"), "events")


def next_event_for_home(df, first_of: Column, date: str, tie: str, as_of: Column):
    """event, is_upcoming: the next dated row among those of `first_of`; if it has none to come, the next of all, else the last of all (F16).  One row."""
    row, order = F.struct("*"), F.struct(date, tie)
    ahead = F.col(date) >= as_of
    best = df.agg(F.min_by(row, F.when(ahead & first_of, order)).alias("_own"), F.min_by(row, F.when(ahead, order)).alias("_next"), F.max_by(row, F.when(~ahead, order)).alias("_last"))
    return best.select(F.coalesce("_own", "_next", "_last").alias("event"), F.col("_next").isNotNull().alias("is_upcoming"))


def live_dates(now: Column) -> Column:
    """Today, and yesterday before noon UTC."""
    day = F.to_date(now)
    return F.when(F.hour(now) < 12, F.array(day, F.date_sub(day, 1))).otherwise(F.array(day))


def recent_past(d: Column, today: Column, days: int = 30) -> Column:
    return (d < today) & (F.datediff(today, d) <= days)


def missed_past(d: Column, today: Column, days: int = 30, most: int = 365) -> Column:
    return (F.datediff(today, d) > days) & (F.datediff(today, d) <= most)
