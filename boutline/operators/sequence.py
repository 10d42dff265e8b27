"""Sequences of one key: streaks over lists, greedy dedup, folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def streak_from(recent: Column, win: str = "win", loss: str = "loss", skip: str = "nc") -> Column:
    """Signed streak of a newest-first list (W08): `skip` is passed over, anything else ends it."""
    begin = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(s: Column, r: Column) -> Column:
        won, lost = r == win, r == loss
        goes = s["open"] & ((won & (s["n"] >= 0)) | (lost & (s["n"] <= 0)))
        return F.when(r == skip, s).otherwise(F.struct(F.when(goes, s["n"] + F.when(won, 1).otherwise(-1)).otherwise(s["n"]).alias("n"), goes.alias("open")))

    return F.aggregate(recent, begin, step, lambda s: s["n"])


def greedy_dedup(df: DataFrame, keys: list[str], ts: str, tie: str, hours: float) -> DataFrame:
    """keys, tie of the rows kept by the rule "the same key within `hours` of anything kept so far is a repeat" (R15), in (ts, tie) order.

    A pause of more than `hours` ends the dependence, so a key is cut there: rows are counted by (key, window of `hours`), and a run of windows begins
    where the first instant of one is more than `hours` after the last of the one before. Runs are dealt out and sorted by Spark, and streamed
    through a state of one number. Only instants and ties move; rows without a key, an instant or a tie are left out."""
    gap = int(hours * 3600 * 1_000_000)
    rows = df.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), F.col(tie).alias("_tie")).dropna().withColumn("_w", F.floor(F.col("_at") / gap))
    along = Window.partitionBy(*keys).orderBy("_w")
    windows = rows.groupBy(*keys, "_w").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    begins = F.coalesce(F.col("_first") - F.lag("_last").over(along) > gap, F.lit(True))
    runs = windows.withColumn("_b", F.when(begins, F.col("_w"))).select(*keys, "_w", F.last("_b", ignorenulls=True).over(along).alias("_run"))
    dealt = rows.join(runs, [*keys, "_w"]).select(*keys, "_run", "_at", "_tie").repartition(*keys, "_run").sortWithinPartitions(*keys, "_run", "_at", "_tie")
    types = {f.name: f.dataType.simpleString() for f in dealt.schema}
    group = [*keys, "_run"]

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, 0
        for b in batches:
            if not len(b):
                continue
            columns = [b[c].to_numpy() for c in group]
            new = np.zeros(len(b), bool)
            new[0] = tuple(c[0] for c in columns) != now
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            head = np.flatnonzero(new).tolist()
            at, stay = b["_at"].to_numpy(), []
            for x, y in zip([0, *head] if not new[0] else head, [*head, len(b)] if not new[0] else [*head[1:], len(b)]):
                if new[x]:
                    last = int(at[x]) - gap - 1
                while (x := x + int(np.searchsorted(at[x:y], last + gap, side="right"))) < y:
                    stay.append(x)
                    last = int(at[x])
            now = tuple(c[-1] for c in columns)
            yield b.iloc[stay][[*keys, "_tie"]].rename(columns={"_tie": tie})

    return dealt.mapInPandas(kept, ", ".join([*(f"{k} {types[k]}" for k in keys), f"{tie} {types['_tie']}"]))


def fold(df: DataFrame, key: str, order: list[str], value: str, start: float, step) -> DataFrame:
    """A state per key folded over its rows in order (R09): step(state, value) -> state, both Columns.  For keys with few rows, such as a person's bouts:
    a key's values are one array."""
    items = F.sort_array(F.collect_list(F.struct(*order, value)))
    return df.groupBy(key).agg(items.alias("_x")).select(key, F.aggregate("_x", F.lit(float(start)), lambda s, x: step(s, x[value])).alias("state"))
