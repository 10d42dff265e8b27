"""Order without hot tasks: places and running sums within a key that may hold most rows, exact percentiles by refinement, lists of the k newest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boutline.operators.durable import checkpointed


def running_before(df: DataFrame, keys: list[str], order: list[Column], amounts: dict[str, Column]) -> DataFrame:
    """`df` with each of `amounts` summed over the rows of its key that come earlier in `order`, which must be total within a key; a key's first row has 0.

    Rows are range-partitioned by key and order, so a key with a third of all rows lies in a third of the partitions; sums run within (partition, key), and what a key has in
    the partitions before is added.  Only keys that cross a border have such an offset, one a partition at most, so the offsets are broadcast.  The sorted rows are
    checkpointed, so that places and offsets are of one partitioning.  Null keys are a key of their own."""
    cells = {f"_amount{n}": c for n, c in enumerate(amounts.values())}
    spread = df.withColumns(cells).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = checkpointed(spread).withColumn("_part", F.shiftright("_at", 33))
    totals = placed.groupBy("_part", *keys).agg(*(F.sum(c).alias(c) for c in cells))
    parts = W.partitionBy(*keys).orderBy("_part")
    earlier = totals.select(F.col("_part").alias("_of"), *(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), *(F.sum(c).over(parts.rowsBetween(W.unboundedPreceding, -1)).alias(f"_before{c}") for c in cells))
    offsets = F.broadcast(earlier.where(" OR ".join(f"`_before{c}` <> 0" for c in cells)))
    inside = W.partitionBy("_part", *keys).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    sums = placed.withColumns({f"_in{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in cells})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)), F.col("_part") == F.col("_of"))
    joined = sums.join(offsets, same, "left")
    return joined.select(*df.columns, *((F.col(f"_in{c}") + F.coalesce(F.col(f"_before{c}"), F.lit(0))).alias(name) for c, name in zip(cells, amounts)))


def keyed_rank(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """`df` with its place, from 1, among the rows of its key in a total order."""
    return running_before(df, keys, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) + 1)


def keyed_pinned_rank(df: DataFrame, keys: list[str], pinned: Column, order: list[Column], name: str) -> DataFrame:
    """`df` with its place among the rows of its key, where a pinned row stands first and counts as 0."""
    flag = F.coalesce(pinned, F.lit(False))
    marked = df.withColumn("_pin", flag.cast("long"))
    placed = running_before(marked, keys, [F.desc("_pin"), *order], {name: F.lit(1).cast("long"), "_pinned": F.col("_pin")})
    return placed.withColumn(name, F.col(name) + 1 - F.when((F.col("_pinned") > 0) | (F.col("_pin") > 0), 1).otherwise(0)).select(*df.columns, name)


def keyed_eligible_rank(df: DataFrame, keys: list[str], score: str, eligible: Column, name: str = "rank") -> DataFrame:
    """`df` with 1 + the number of eligible rows of its key with a higher score (J13).  Rows of one score share it, so they are counted first, and the counts alone are ordered;
    null scores come after all."""
    counts = df.groupBy(*keys, score).agg(F.count_if(F.coalesce(eligible, F.lit(False))).alias("_n"))
    ranks = running_before(counts, keys, [F.col(score).desc_nulls_last()], {name: F.col("_n")})
    ranks = ranks.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.col(score).alias("_score"), (F.col(name) + 1).alias(name))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)), F.col(score).eqNullSafe(F.col("_score")))
    return df.join(ranks, same).select(*df.columns, name)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, pinned: Column) -> DataFrame:
    """The first n of each key with their place `rn`, and pinned rows whatever theirs."""
    return keyed_rank(df, keys, order, "rn").where((F.col("rn") <= n) | F.coalesce(pinned, F.lit(False)))


#: Rows that a range may hold for its ranks to be looked up by sorting it, and the ranges that a refinement cuts it into.
SMALL, CUTS = 100_000, 64


def nearest_percentiles(df: DataFrame, value: str, shares: list[float], small: int = SMALL) -> dict[float, object]:
    """The values at index floor(p n) of the n sorted values, nulls left out, for each p of `shares` (A26); no value at all gives an empty dict.

    Rows are counted by ranges between cuts that a mergeable sketch proposes; a rank that falls on a cut is found, the others go on in their range, all of them in one pass a
    round.  A value that holds much of a range becomes a cut itself, so a range shrinks by about `CUTS` a round, until it has `small` rows, which are sorted."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    n = rows.count()
    if not n:
        return {}
    found: dict[float, object] = {}
    # a range is open at both ends: (lower cut, upper cut, rows up to the lower cut, rows inside)
    where: dict[float, tuple] = {p: (None, None, 0, n) for p in shares}
    rank = {p: min(n - 1, int(p * n)) for p in shares}
    inside = lambda low, high: (F.lit(True) if low is None else F.col("v") > F.lit(low)) & (F.lit(True) if high is None else F.col("v") < F.lit(high))
    while where:
        ranges = list(dict.fromkeys(where.values()))
        for low, high, below, size in [r for r in ranges if r[3] <= small]:
            ordered = [r["v"] for r in rows.where(inside(low, high)).orderBy("v").collect()]  # `small` values at most
            for p in [p for p, r in where.items() if r == (low, high, below, size)]:
                found[p] = ordered[rank[p] - below]
                del where[p]
        ranges = [r for r in ranges if r[3] > small]
        if not ranges:
            break
        shares_of = F.array(*(F.lit(k / CUTS) for k in range(1, CUTS)))
        sketch = rows.agg(*(F.percentile_approx(F.when(inside(low, high), F.col("v")), shares_of, F.lit(100 * CUTS)).alias(f"c{k}") for k, (low, high, *_) in enumerate(ranges))).first()
        cuts = [sorted(set(sketch[f"c{k}"])) for k in range(len(ranges))]
        place = F.lit(None).cast("struct<of: int, at: int>")
        for k, (low, high, *_) in enumerate(ranges):
            known = F.array(*(F.lit(c) for c in cuts[k]))
            at = 2 * F.size(F.filter(known, lambda c: c < F.col("v"))) + F.when(F.array_contains(known, F.col("v")), 1).otherwise(0)  # odd: on a cut
            place = F.when(inside(low, high), F.struct(F.lit(k).alias("of"), at.cast("int").alias("at"))).otherwise(place)
        counts = {(r["p"]["of"], r["p"]["at"]): r["n"] for r in rows.groupBy(place.alias("p")).agg(F.count("*").alias("n")).collect() if r["p"] is not None}  # two numbers a cut
        for k, (low, high, below, size) in enumerate(ranges):
            edges, so_far = [low, *cuts[k], high], below
            for at in range(2 * len(cuts[k]) + 1):
                here = counts.get((k, at), 0)
                for p in [p for p, r in where.items() if r == (low, high, below, size) and so_far <= rank[p] < so_far + here]:
                    if at % 2:
                        found[p] = cuts[k][at // 2]
                        del where[p]
                    else:
                        where[p] = (edges[at // 2], edges[at // 2 + 1], so_far, here, "new")
                so_far += here
        where = {p: r[:4] for p, r in where.items()}
    return found


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int, item: Column, name: str) -> DataFrame:
    """keys and `name`, the items of the first n rows of each key in `order` (A05, W08): rows beyond are dropped before they are shuffled and again before the
    list is made, so no list is longer than n."""
    ranked = df.select(*keys, item.alias("_item"), F.row_number().over(W.partitionBy(*keys).orderBy(*order)).alias("_rank")).where(F.col("_rank") <= n)
    listed = F.sort_array(F.collect_list(F.struct("_rank", "_item")))
    return ranked.groupBy(*keys).agg(F.transform(listed, lambda x: x["_item"]).alias(name))
