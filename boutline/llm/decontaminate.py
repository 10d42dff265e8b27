"""Benchmark decontamination by exact similarity of item-sized windows, with their SimHash distance, in DataFrame functions only.

1. Words: text lower-cased, everything but letters and digits is a gap.  A window that has any similarity to an item shares a shingle
   with it, so a join on shingles finds every (document, item) there can be.
2. All windows of the item's length are compared, wherever they start.  The j-th occurrence of a shingle that the item has c times adds
   one to the shared count of the windows that hold it but not the occurrence c before it: a range of starts.  A sweep over the ends of
   these ranges gives the exact weighted similarity (sum of minimum counts over sum of maximum counts) of every start.
3. The best window gets a 64-bit SimHash of its shingles; its distance from the item's is reported and drops nothing.  Repeats are
   summed in a SimHash, so at 0.8 weighted similarity one repeated shingle can turn most of the bits: no radius is safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boutline.llm.scratch import Scratch

SHINGLE = 5
#: Rows of a benchmark table up to which it is broadcast (five numbers each, about 100 MB as a hash table); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Words: runs of letters and digits of the lower-cased text."""
    flat = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def shingle_hashes(words: Column, k: int) -> Column:
    """A 64-bit hash for each run of k words.  `words` should be a column, not an expression: it is read for each word."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))
    return F.when(n >= k, runs).otherwise(F.array().cast("array<bigint>"))


def simhash64(hashes: Column) -> Column:
    """64-bit SimHash of a column array of hashes: a bit is 1 if set in over half of them."""
    one, n = F.lit(1).cast("long"), F.size(hashes)
    masks = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.size(F.filter(hashes, lambda h: F.getbit(h, b) == 1)) * 2 > n, F.call_function("shiftleft", one, b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(masks, F.lit(0).cast("long"), lambda acc, m: acc.bitwiseOR(m))


def _bounded(df: DataFrame) -> DataFrame:
    """`df` to be broadcast if it is counted at BROADCAST_ROWS rows or fewer."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def find_leaks(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    similarity: float = 0.8,
) -> DataFrame:
    """(id, row_hash, item, start, n_words, hamming, similarity): for each document and item the best window of `similarity` or more.

    A window over the document's edge is cut there.  Ties go to the first window.  Items of fewer words than a shingle are one
    shingle; items without words, null texts and null items match nothing.  Documents are told apart by id and text (row_hash =
    xxhash64 of both), so repeated ids are fine, null ids come back as null, and repeated rows give one row an item.  Shingles are
    compared by 64-bit hashes.  Other columns are ignored.  Empty tables give no rows.
    """
    scratch = Scratch(spark, "leaks")
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.coalesce(F.col(item_text), F.lit(""))).alias("w")).where("item IS NOT NULL AND size(w) > 0")
    items = items.withColumn("item_hash", F.xxhash64("item", "w")).dropDuplicates(["item_hash"])
    items = scratch.table(items.select("item", "item_hash", "w", F.size("w").alias("n"), F.least(F.lit(SHINGLE), F.size("w")).alias("k")), "items")
    sizes = [r["k"] for r in items.select("k").distinct().orderBy("k").collect()] or [SHINGLE]  # five values at most

    def of_size(words: str, k: Column | None = None) -> Column:
        """The hashes of the shingles of k words, or for each size there is."""
        if k is None:
            return F.array(*(F.struct(F.lit(n).alias("k"), shingle_hashes(F.col(words), n).alias("h")) for n in sizes))
        return F.coalesce(*(F.when(k == n, shingle_hashes(F.col(words), n)) for n in sizes))

    items = scratch.table(items.select("item", "item_hash", "n", "k", of_size("w", F.col("k")).alias("b")), "item-shingles")
    items = scratch.table(items.withColumn("item_fp", simhash64(F.col("b"))), "item-prints")

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row_hash", F.xxhash64("id", "text"))
    words = rows.select("row_hash", words_of(F.col("text")).alias("w"))
    runs = words.select("row_hash", F.size("w").alias("len"), F.explode(of_size("w")).alias("s")).select("row_hash", "len", F.col("s.k").alias("k"), F.posexplode("s.h").alias("p", "h"))
    counts = items.select("item_hash", "n", "k", F.explode("b").alias("h")).groupBy("item_hash", "n", "k", "h").agg(F.count("*").cast("int").alias("c"))
    shared = runs.join(_bounded(counts), ["k", "h"]).groupBy("row_hash", "item_hash", "h", "len", "n", "k", "c").agg(F.sort_array(F.collect_set("p")).alias("ps"))

    def ends(p: Column, j: Column) -> Column:
        """The starts of the windows in which the occurrence at p counts: +1 at the first, -1 after the last."""
        first = F.greatest(p - F.col("n") + F.col("k"), F.get("ps", j - F.col("c")) + 1)
        return F.array(F.struct(first.alias("s"), F.lit(1).alias("d")), F.struct((p + 1).alias("s"), F.lit(-1).alias("d")))

    sweep = shared.select("row_hash", "item_hash", "len", "n", "k", F.explode(F.flatten(F.transform("ps", ends))).alias("e")).select("*", "e.s", "e.d").drop("e")
    along = Window.partitionBy("row_hash", "item_hash").orderBy("s")
    spans = sweep.select("*", F.sum("d").over(along).alias("shared"), F.lead("s").over(along).alias("next")).where("shared > 0 AND next > s")
    # the shared count is the same over a span, and windows are only shorter towards the document's edges: an end of the span is best
    at, start, stop = F.col("at"), F.greatest(F.col("at"), F.lit(0)), F.least(F.col("at") + F.col("n"), F.col("len"))
    ranked = spans.withColumn("at", F.explode(F.array("s", F.col("next") - 1))).withColumn("similarity", F.col("shared") / (stop - start + F.col("n") - 2 * (F.col("k") - 1) - F.col("shared")))
    best = F.min_by(F.struct(start.alias("start"), (stop - start).alias("n_words"), "similarity"), F.struct(-F.col("similarity"), at))
    sure = ranked.where(F.col("similarity") >= similarity).groupBy("row_hash", "item_hash").agg(best.alias("x")).select("row_hash", "item_hash", "x.*")
    sure = scratch.table(sure, "sure")

    hit = rows.join(sure.select(F.col("row_hash").alias("hit")).distinct(), F.col("row_hash") == F.col("hit"), "left_semi").dropDuplicates(["row_hash"])
    hit = hit.select("id", "row_hash", words_of(F.col("text")).alias("w"))
    windows = hit.join(sure, "row_hash").join(_bounded(items.select("item", "item_hash", "k", "item_fp")), "item_hash").withColumn("w", F.slice("w", F.col("start") + 1, F.col("n_words")))
    windows = scratch.table(windows, "windows")
    windows = scratch.table(windows.withColumn("a", of_size("w", F.col("k"))).drop("w"), "window-shingles")
    windows = windows.withColumn("hamming", F.bit_count(simhash64(F.col("a")).bitwiseXOR(F.col("item_fp"))))
    found = F.min_by(F.struct("start", "n_words", "hamming", "similarity"), F.struct(-F.col("similarity"), "start"))
    return windows.groupBy("id", "row_hash", "item").agg(found.alias("x")).select("id", "row_hash", "item", "x.*")


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, with all their columns, in which `find_leaks` finds nothing.  Null and empty texts stay, as do all rows if there are no items; repeated rows go or stay
    together, and rows that share an id by their own text, null ids included."""
    found = find_leaks(spark, docs, benchmark, id_col=id_col, text_col=text_col, **options)
    leaks = found.select(F.col("id").alias("leak_id"), F.col("row_hash").alias("leak_hash")).distinct()
    # by id and hash: a hash that another document shares by chance drops nothing
    return docs.join(leaks, (F.xxhash64(docs[id_col], F.coalesce(docs[text_col], F.lit(""))) == leaks.leak_hash) & docs[id_col].eqNullSafe(leaks.leak_id), "left_anti")
