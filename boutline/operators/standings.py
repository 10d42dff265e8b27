"""Places in a pool at the time of a bout (R13), by an order-statistics list; checks of a rating by what they should agree with."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Days within which a bout keeps its fighter in the ranking: 18 months of 30.44 days.
ACTIVE_DAYS = 547


class Standing:
    """Numbers in order, repeats included: `add`, `remove` and `above` (how many are larger) take a search among the buckets, one inside a bucket of bounded
    size, and a walk of a Fenwick tree over the buckets' sizes."""

    def __init__(self, load: int = 256):
        self.load = load
        self.buckets: list[list[float]] = []
        self.last: list[float] = []  # each bucket's largest number
        self.tree: list[int] = []
        self.size = 0

    def __len__(self) -> int:
        return self.size

    def _rebuild(self) -> None:
        self.last = [b[-1] for b in self.buckets]
        self.tree = [len(b) for b in self.buckets]
        for k in range(len(self.tree)):
            up = k | (k + 1)
            if up < len(self.tree):
                self.tree[up] += self.tree[k]

    def _count(self, at: int, by: int) -> None:
        self.size += by
        while at < len(self.tree):
            self.tree[at] += by
            at |= at + 1

    def _before(self, at: int) -> int:
        """Numbers in the buckets before `at`."""
        n = 0
        while at > 0:
            n += self.tree[at - 1]
            at &= at - 1
        return n

    def add(self, x: float) -> None:
        if not self.buckets:
            self.buckets = [[x]]
            self.size = 1
            self._rebuild()
            return
        at = min(bisect_left(self.last, x), len(self.buckets) - 1)
        bucket = self.buckets[at]
        insort(bucket, x)
        self.last[at] = bucket[-1]
        self._count(at, 1)
        if len(bucket) > 2 * self.load:
            self.buckets[at : at + 1] = [bucket[: self.load], bucket[self.load :]]
            self._rebuild()

    def remove(self, x: float) -> None:
        """Takes out one x, which must be there."""
        at = bisect_left(self.last, x)
        bucket = self.buckets[at]
        del bucket[bisect_left(bucket, x)]
        self._count(at, -1)
        if bucket:
            self.last[at] = bucket[-1]
        else:
            del self.buckets[at]
            self._rebuild()

    def above(self, x: float) -> int:
        at = bisect_right(self.last, x)
        if at == len(self.buckets):
            return 0
        return self.size - self._before(at) - bisect_right(self.buckets[at], x)


def bout_rows(history: DataFrame, keys: list[str]) -> DataFrame:
    """keys, day, bout_id, winner, loser, and of each side its values before and after, of the decided bouts of a career history (a row a side)."""
    side = F.struct("participant", "rating_at", "rd_at", "rating", "rd", "bouts_before")
    both = history.where("kind = 0").groupBy(*keys, "day", "bout_id").agg(F.max(F.when(F.col("won"), side)).alias("w"), F.max(F.when(~F.col("won"), side)).alias("l"))
    return both.where("w IS NOT NULL AND l IS NOT NULL")


def wins_over_best(history: DataFrame, keys: list[str], best: int = 10, k: float = 2.0, active_days: int = ACTIVE_DAYS, chunk_days: int = 365) -> DataFrame:
    """keys, participant, wins: bouts won against one of the `best` of the ranking at the time (R13).  keys: the pool and the division, say.

    Ranked by rating - k x deviation after its latest bout there is everybody who fought within `active_days` before the bout, but for the two in it; a loser without an
    earlier bout doesn't count.  Participants without such a win aren't listed.

    A ranking only rests on the `active_days` before it, so a key's bouts are cut into spans of `chunk_days`, each replayed by itself with the bouts of the days before
    that it rests on: a key with a third of all bouts is spread over its spans."""
    b = bout_rows(history, keys)
    cons = lambda s, when: F.col(f"{s}.rating{when}") - k * F.col(f"{s}.rd{when}")
    day = F.unix_date("day")
    rows = b.select(
        *keys, day.alias("_day"), "bout_id", F.col("w.participant").alias("winner"), F.col("l.participant").alias("loser"), cons("l", "_at").alias("at"), cons("w", "").alias("winner_after"), cons("l", "").alias("loser_after"),
        (F.col("l.bouts_before") > 0).alias("seasoned"), F.floor(day / chunk_days).alias("own"), F.floor((day + active_days) / chunk_days).alias("until"),
    )
    spans = rows.withColumn("chunk", F.explode(F.sequence("own", "until"))).withColumn("counts", F.col("chunk") == F.col("own")).drop("own", "until")
    group = [*keys, "chunk"]
    dealt = spans.repartition(*group).sortWithinPartitions(*group, "_day", "bout_id")
    types = dict(dealt.dtypes)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, latest, standing, waiting = None, {}, Standing(), deque()
        for batch in batches:
            won = []
            for row, key in zip(batch.itertuples(index=False), zip(*(batch[c] for c in group))):
                if key != now:
                    now, latest, standing, waiting = key, {}, Standing(), deque()
                while waiting and row._0 - waiting[0][0] > active_days:  # whose latest bout is too long ago
                    then, who = waiting.popleft()
                    if latest.get(who, (0, None))[1] == then:
                        standing.remove(latest.pop(who)[0])
                if row.counts and row.seasoned:
                    above = standing.above(row.at) - sum(who in latest and latest[who][0] > row.at for who in (row.winner, row.loser))
                    if above < best:
                        won.append((*key[:-1], row.winner))
                for who, value in ((row.winner, row.winner_after), (row.loser, row.loser_after)):
                    if who in latest:
                        standing.remove(latest[who][0])
                    standing.add(value)
                    latest[who] = (value, row._0)
                    waiting.append((row._0, who))
            yield pd.DataFrame(won, columns=[*keys, "participant"])

    dealt = dealt.select(F.col("_day").alias("_0"), *(c for c in dealt.columns if c != "_day"))
    shape = ", ".join([*(f"`{c}` {types[c]}" for c in keys), f"participant {types['winner']}"])
    return dealt.mapInPandas(replay, shape).groupBy(*keys, "participant").agg(F.count("*").alias("wins"))


def title_wins(history: DataFrame, titles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, participant, titles: title bouts won.  titles: bout_id of the bouts that were for a title."""
    won = history.where("kind = 0 AND won").join(titles.select("bout_id").distinct(), "bout_id", "left_semi")
    return won.groupBy(*keys, "participant").agg(F.count("*").alias("titles"))


def _check(name: str, found: DataFrame, detail: Column) -> DataFrame:
    """name, passed, details (sorted) of what a check found, one row; passed where that is nothing."""
    details = found.agg(F.sort_array(F.collect_list(detail)).alias("details"))
    return details.select(F.lit(name).alias("name"), (F.size("details") == 0).alias("passed"), "details")


def check_carry_over(history: DataFrame, initial: float = 1500.0) -> DataFrame:
    """Nobody with bouts behind them starts again at the initial rating when they change division.  The details are whom, when and where."""
    found = history.where(F.col("moved") & (F.col("bouts_before") > 0) & (F.col("rating_at") == initial))
    return _check("no reset on a change of division", found, F.concat_ws(" ", F.col("participant").cast("string"), F.col("day").cast("string")))


def _placed(ranked: DataFrame, keys: list[str]) -> DataFrame:
    return ranked.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("conservative"), "participant")))


def check_thin_leaders(ranked: DataFrame, top_wins: DataFrame, keys: list[str], most: int = 6) -> DataFrame:
    """No division is led by somebody of `most` bouts or fewer without a win over the best.  ranked: keys, participant, conservative, is_champion, bouts of the
    eligible; a champion's place by rating counts here."""
    first = _placed(ranked, keys).where((F.col("place") == 1) & (F.col("bouts") <= most))
    return _check("no leader with a thin record", first.join(top_wins, [*keys, "participant"], "left_anti"), F.concat_ws(" ", *(F.col(c).cast("string") for c in (*keys, "participant"))))


def check_defending_champions(ranked: DataFrame, titles: DataFrame, keys: list[str], within: int = 3) -> DataFrame:
    """A champion who has defended the title (two title wins or more there) is among the first `within` by rating."""
    champions = _placed(ranked, keys).where("is_champion").groupBy(*keys).agg(F.min_by(F.struct("participant", "place"), "place").alias("c")).select(*keys, "c.*")
    found = champions.join(titles, [*keys, "participant"]).where((F.col("titles") >= 2) & (F.col("place") > within))
    return _check("defending champions lead", found, F.concat_ws(" ", *(F.col(c).cast("string") for c in (*keys, "participant", "place"))))


def check_first_of_all(ranked: DataFrame, titles: DataFrame) -> DataFrame:
    """The first across divisions has won a title bout; without anybody the check passes."""
    first = ranked.orderBy(F.desc("conservative"), "participant").limit(1)
    return _check("the first of all has won a title", first.join(titles.select("participant").distinct(), "participant", "left_anti"), F.col("participant").cast("string"))
