"""Generic relational operators: every one takes column names or Columns and returns a lazy frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boutline.operators.durable import checkpointed


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """DISTINCT ON (A08): the first row of each key in an explicit order.  Ties must be settled by `order`."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Top n of each key (W01) with their place `rn`: rows beyond are dropped before the shuffle."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n)


def unpivot_sides(df: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """Two participant columns to one row each (P05), in one pass: nulls are dropped."""
    return df.withColumn(name, F.explode(F.array(first, second))).where(F.col(name).isNotNull())


def pair_fold(df: DataFrame, key: str, order: list[str], sums: list[str], firsts: list[str]) -> DataFrame:
    """Corner rows to one bout (P03): sums of both sides, the first row's other columns, complete = two sides."""
    lead = F.min_by(F.struct(*firsts), F.struct(*order))
    folded = df.groupBy(key).agg(*(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in sums), (F.count("*") == 2).alias("complete"), lead.alias("_first"))
    return folded.select(key, *sums, "complete", "_first.*")


def winner_loser(df: DataFrame, key: str, result: str) -> tuple[DataFrame, DataFrame]:
    """Groups of exactly two rows (P04): (winner, loser) structs, and the keys of bouts without a result."""
    row = F.struct(*[c for c in df.columns if c != key])
    won, lost = F.col(result) == "win", F.col(result) == "loss"
    sides = df.groupBy(key).agg(
        F.count("*").alias("n"),
        F.count_if(won).alias("wins"),
        F.count_if(lost).alias("losses"),
        F.max(F.when(won, row)).alias("winner"),
        F.max(F.when(lost, row)).alias("loser"),
    )
    pairs = sides.where("n = 2 AND wins = 1 AND losses = 1").select(key, "winner", "loser")
    return pairs, sides.where("n = 2 AND wins = 0 AND losses = 0").select(key)


def prefix_asof(df: DataFrame, key: str, day: Column, measures: dict[str, Column]) -> DataFrame:
    """Strictly-before aggregates (J10): `measures` over the rows of the key on earlier days, one sort and no self join."""
    before = W.partitionBy(key).orderBy(day).rangeBetween(W.unboundedPreceding, -1)
    return df.select("*", *(m.over(before).alias(name) for name, m in measures.items()))


def current_streak(df: DataFrame, key: str, order: list[Column], result: str, positive: str, negative: str) -> DataFrame:
    """Signed length of the latest run of one result (W05); any other result counts 0."""
    w = W.partitionBy(key).orderBy(*order)
    marked = df.select(key, F.col(result).alias("_r"), F.row_number().over(w).alias("_rn"), F.first(result).over(w).alias("_latest"))
    runs = marked.groupBy(key).agg(F.first("_latest").alias("latest"), (F.coalesce(F.min(F.when(~F.col("_r").eqNullSafe(F.col("_latest")), F.col("_rn"))), F.max("_rn") + 1) - 1).alias("n"))
    return runs.select(key, F.when(F.col("latest") == positive, F.col("n")).when(F.col("latest") == negative, -F.col("n")).otherwise(0).cast("long").alias("streak"))


def decayed_sum(df: DataFrame, key: str, newest_first: list[Column], values: list[str], decay: float) -> DataFrame:
    """sum(value * decay^(age in rows)) (A24): closed form of the oldest-to-newest recurrence."""
    age = F.row_number().over(W.partitionBy(key).orderBy(*newest_first)) - 1
    aged = df.withColumn("_w", F.pow(F.lit(decay), age))
    return aged.groupBy(key).agg(*(F.sum(F.col(v) * F.col("_w")).alias(v) for v in values))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page with the total of all rows (O01, W02).  The total is a partial-aggregated count, joined as one row, so no row passes a single task but the page."""
    total = df.agg(F.count("*").alias("total_count"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total))


def optional(df: DataFrame, **equal) -> DataFrame:
    """(:p IS NULL OR col = :p) (P02): a filter is built only for parameters that are set, so it can be pushed down."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])) if kv[1] is not None else d, equal.items(), df)


def sync_plan(existing: DataFrame, fresh: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """insert / update / delete / keep per key."""
    e = existing.select(*keys, F.struct(*compare).alias("old"), F.lit(True).alias("had"))
    f = fresh.select(*keys, F.struct(*compare).alias("new"), F.lit(True).alias("has"))
    action = F.when(F.col("had").isNull(), "insert").when(F.col("has").isNull(), "delete").when(F.col("old").eqNullSafe(F.col("new")), "keep").otherwise("update")
    return e.join(f, keys, "full_outer").select(*keys, action.alias("action"), "old", "new")


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """ON CONFLICT DO UPDATE (S21): the merged table, to be written beside the old one.  `update`: the columns that a conflict
    overwrites (all but the keys if None)."""
    values = [c for c in base.columns if c not in keys]
    update = values if update is None else update
    d = delta.select(*keys, F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in values))
    b = base.withColumn("_old", F.lit(True))
    j = b.join(d, keys, "full_outer")
    pick = lambda c: F.when(F.col("_old").isNull(), F.col(f"_{c}")).when(F.col("_new").isNotNull() & F.lit(c in update), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return j.select(*keys, *map(pick, values)).select(*base.columns)


def insert_ignore(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING (S22): only the rows to append."""
    return delta.join(base.select(*keys).distinct(), keys, "left_anti")


def last_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """In-batch key collapse."""
    return latest_per_key(df, keys, [F.col(ordinal).desc()])


def changed_only(base: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """UPDATE ... FROM that touches only rows that differ."""
    j = base.select(*keys, column).join(new.select(*keys, F.col(column).alias("_n")), keys)
    return j.where(~F.col(column).eqNullSafe(F.col("_n"))).select(*keys, F.col("_n").alias(column))


def siblings(df: DataFrame, ident: str, keys: list[str], one: str, other: str) -> DataFrame:
    """ident, canonical, siblings: how many rows share `keys` and either `one` or `other` (J07), itself included, and the smallest id of them. Both counts less the
    rows that share all three: three aggregations, so no pair of siblings is formed. A row that lacks a key has none and is its own canonical row."""
    out = df.select(ident, *keys, one, other)
    for n, group in enumerate(([*keys, one], [*keys, other], [*keys, one, other])):
        out = out.join(df.dropna(subset=group).groupBy(*group).agg(F.count("*").alias(f"_n{n}"), F.min(ident).alias(f"_m{n}")), group, "left")
    zero = lambda n: F.coalesce(f"_n{n}", F.lit(0))
    return out.select(ident, F.coalesce(F.least("_m0", "_m1"), F.col(ident)).alias("canonical"), (zero(0) + zero(1) - zero(2)).alias("siblings"))


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` with its place, from 1, in a total order (W04): range partitions are sorted each for itself, and start after the rows of those before them,
    one number a partition. The sorted rows are checkpointed, so that places and counts are of one partitioning."""
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    starts = F.broadcast(counts.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_before")))  # a row a partition
    return placed.withColumn("_p", part).join(starts, "_p").withColumn(name, at + F.col("_before") + 1).drop("_p", "_at", "_before")
