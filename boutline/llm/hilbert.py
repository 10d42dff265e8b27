"""Sharding along a Hilbert curve, in DataFrame functions only.

Several metadata dimensions are quantised to a few bits each, the cell's index on the Hilbert curve orders the rows, and the order is cut into
runs, so that the files of a shard span a compact box in every dimension and can be pruned by any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.llm.scratch import Scratch


#: Groups of equal texts that hold 1/HOT of all rows or more are broadcast.
HOT = 10_000


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a cell with `bits`-bit coordinates (Skilling's transform: undo the rotations from the top bit down, then
    Gray-code).  A fold over (bit, axis) keeps the expression small however many bits there are."""
    n = len(axes)
    x = F.array(*(a.cast("int") for a in axes))
    steps = F.array(*(F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)))

    def turn(state: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        first, own = F.get(state, F.lit(0)), F.get(state, i)
        swap = first.bitwiseXOR(own).bitwiseAND(q - 1)
        high = own.bitwiseAND(q) != 0
        return F.transform(
            state,
            lambda v, j: F.when(j == 0, F.when(high, first.bitwiseXOR(q - 1)).otherwise(first.bitwiseXOR(swap))).when((j == i) & ~high, own.bitwiseXOR(swap)).otherwise(v),
        )

    turned = F.aggregate(x, F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("out")), _gray, lambda s: s["out"]) if bits < 2 else F.aggregate(
        F.aggregate(steps, x, turn), F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("out")), _gray, lambda s: s["out"]
    )
    flips = F.array(*(F.lit(1 << b) for b in range(bits - 1, 0, -1)), F.lit(0))
    low = F.aggregate(
        flips,
        F.struct(turned.alias("g"), F.lit(0).alias("t")),
        lambda s, q: F.struct(s["g"].alias("g"), F.when(F.element_at(s["g"], -1).bitwiseAND(q) != 0, s["t"].bitwiseXOR(q - 1)).otherwise(s["t"]).alias("t")),
        lambda s: F.transform(s["g"], lambda v: v.bitwiseXOR(s["t"])),
    )
    places = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)))
    return F.aggregate(
        places,
        F.struct(low.alias("g"), F.lit(0).cast("long").alias("h")),
        lambda s, p: F.struct(s["g"].alias("g"), (s["h"] * 2 + F.call_function("shiftright", F.get(s["g"], p["i"]), p["b"]).bitwiseAND(F.lit(1))).alias("h")),
        lambda s: s["h"],
    )


def _gray(state: Column, v: Column) -> Column:
    """Each coordinate xor the one before it, after that one's own change."""
    now = v.bitwiseXOR(state["last"])
    return F.struct(now.alias("last"), F.concat(state["out"], F.array(now)).alias("out"))


def hash_level(value: Column, bits: int) -> Column:
    """A string's cell by hash, for dimensions that are only asked for by equality: a few values spread over all cells, where an order by their letters would
    crowd them into a few next to each other that the curve tells apart last."""
    return F.pmod(F.crc32(F.coalesce(value.cast("string"), F.lit(""))), F.lit(1 << bits)).cast("int")


def size_level(size: Column, bits: int) -> Column:
    """Twice the binary logarithm of a size, from 16 up, within the bits."""
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), F.floor(F.log2(size.cast("double")) * 2 - 8))).cast("int")


def shard_documents(
    spark: SparkSession,
    docs: DataFrame,
    *,
    shards: int = 24,
    bits: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    carry: Column | None = None,
) -> DataFrame:
    """(id, size, text_crc32, lang_level, source_level, curve, shard, slot (, carry: a column to come along)) for every row of `docs`, under the law `rows`:
    shard counts at most one apart.

    Equal texts are a group, and a group has one cell: Hilbert index of (lang, source, size) of its row with the smallest id (null ids last, then by lang and
    source).  Order: the cell, then size, crc32 and hash of the text, then id; so a group is one run of ranks, and is cut only where a shard is full.
    slot counts from 0 in each shard.  size: UTF-8 bytes of the text (null: none) plus 8; null and empty texts are one group.  Null dimensions count
    as the empty string; repeated rows each get their own slot; fewer rows than shards leave shards empty; an empty table gives no rows.

    The rows are range-partitioned by the whole order (a hot cell or group is split by id), a partition's place comes from the counts of
    those before it, one number a partition, and no text is moved unless `carry` holds it.
    """
    scratch = Scratch(spark, "hilbert")
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + 8).cast("long")
    kept = [] if carry is None else ["carry"]
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("hash"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), *([carry.alias("carry")] if kept else []))
    rows = scratch.table(rows, "rows")
    group = ["size", "text_crc32", "hash"]
    levels = [hash_level(F.col("lang"), bits).alias("lang_level"), hash_level(F.col("source"), bits).alias("source_level")]
    # copies are counted with partial sums, and only groups of two and more are joined.  A group of 1/HOT of all rows or more is hot: there are HOT of them
    # at most, so they are broadcast, and no task gets a hot group's rows by its key; the others are small
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "lang", "source")).alias("first")
    groups = rows.groupBy(*group).agg(F.count("*").alias("n"), first).where("n > 1").select(*group, "n", F.col("first.lang").alias("lang"), F.col("first.source").alias("source"))
    groups = scratch.table(groups.select(*group, "n", F.struct(*levels).alias("of_group")), "groups")
    is_hot = F.col("n") * HOT >= rows.count()
    hot, other = F.broadcast(groups.where(is_hot).drop("n")), groups.where(~is_hot).drop("n")
    joined = rows.join(hot, group).unionByName(rows.join(hot, group, "left_anti").join(other, group, "left"))
    celled = joined.withColumn("levels", F.coalesce("of_group", F.struct(*levels)))
    celled = celled.select("id", *group, "levels.*", *kept)
    curve = hilbert_index([F.col("lang_level"), F.col("source_level"), size_level(F.col("size"), bits)], bits)
    order = ["curve", *group, "id"]
    celled = scratch.table(celled.withColumn("curve", curve), "cells")
    place = F.monotonically_increasing_id()
    sorted_rows = scratch.table(celled.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place), "sorted")
    scratch.drop(rows, groups, celled)
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a number a partition
    total, before = sum(r["n"] for r in counts), 0
    starts = []
    for r in counts:
        starts.append((r["part"], before))
        before += r["n"]
    offsets = F.broadcast(spark.createDataFrame(starts, "part long, before long"))  # a row a partition
    ranked = sorted_rows.withColumn("part", part).join(offsets, "part").withColumn("rank", at + F.col("before"))
    # integer arithmetic: rank * shards div total, and the first rank of a shard is the ceiling of shard * total / shards
    ranked = ranked.withColumn("shard", F.expr(f"rank * {shards} div {max(total, 1)}"))
    first_rank = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return ranked.select("id", "size", "text_crc32", "lang_level", "source_level", "curve", F.col("shard").cast("int").alias("shard"), (F.col("rank") - first_rank).alias("slot"), *kept)


def write_shards(spark: SparkSession, docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the rows of `docs`, all columns, into folders `shard=k` under `path`, in the order of their slots, and return the manifest.  A column of
    `docs` named shard is written as it is under the name shard_before."""
    placed = shard_documents(spark, docs, carry=F.struct("*"), **options)
    columns = [F.col(f"carry.`{c}`").alias(f"{c}_before" if c == "shard" else c) for c in docs.columns]
    placed.select(*columns, "shard").write.partitionBy("shard").parquet(path)
    return manifest(placed)


def manifest(placed: DataFrame) -> DataFrame:
    """Per shard its rows, bytes, and the least and greatest level of each dimension: a reader skips shards whose ranges miss its predicate.  A row a shard."""
    ranges = [f(c).alias(f"{name}_{c}") for c in ("lang_level", "source_level", "size") for name, f in (("min", F.min), ("max", F.max))]
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ranges)


def may_hold(shards: DataFrame, dimension: str, low: int, high: int) -> DataFrame:
    """The shards of a manifest that may hold a row with `low` <= dimension <= `high`."""
    return shards.where((F.col(f"min_{dimension}") <= high) & (F.col(f"max_{dimension}") >= low))
