"""Incremental forms of the batch operators: everything new is read once (T01), progress is checkpointed (T05), and re-runs change nothing.

State is bounded by a watermark or is one number a key. Folders must be shared by driver and executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shared_folder(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, folder: str, table: str, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet table of `folder` as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def append_available(stream: DataFrame, out: str, progress: str) -> None:
    """Process all that is there and stop; a second call goes on from the first."""
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


#: Bits of a bucket's filter, and how many of them a key sets: one key in a hundred is taken for held when a bucket has 50,000 keys.
BITS, MARKS = 1 << 19, 5


def _marks(keys: list[str], buckets: int, bits: int) -> tuple[Column, Column]:
    """A key's bucket, and the (word, bit) pairs that it sets in the bucket's filter."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    places = F.array(*(F.pmod(F.xxhash64(*keys, F.lit(n)), F.lit(bits)) for n in range(1, MARKS + 1)))
    return bucket, F.transform(places, lambda x: F.struct(F.floor(x / 64).cast("int").alias("word"), (x % 64).cast("int").alias("bit")))


def filter_words(df: DataFrame, keys: list[str], buckets: int, bits: int = BITS) -> DataFrame:
    """bucket, word, ones: a Bloom filter of the keys of each bucket (T04), as words of 64 bits.  Filters of several tables are put together by `merged_words`."""
    bucket, marks = _marks(keys, buckets, bits)
    set_ = df.select(bucket.alias("bucket"), F.explode(marks).alias("m")).select("bucket", "m.word", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("m.bit")).alias("ones"))
    return merged_words(set_)


def merged_words(words: DataFrame) -> DataFrame:
    return words.groupBy("bucket", "word").agg(F.bit_or("ones").alias("ones"))


def may_be_held(df: DataFrame, keys: list[str], words: DataFrame, buckets: int, bits: int = BITS) -> DataFrame:
    """The distinct keys of `df` with their `bucket` all of whose bits the filters have set: every key that is held, and few others."""
    bucket, marks = _marks(keys, buckets, bits)
    asked = df.select(*keys, bucket.alias("bucket"), F.explode(marks).alias("m")).select(*keys, "bucket", "m.word", "m.bit")
    found = asked.join(words, ["bucket", "word"], "left")
    on = F.coalesce(F.call_function("shiftrightunsigned", "ones", "bit").bitwiseAND(F.lit(1).cast("long")), F.lit(0).cast("long"))
    return found.groupBy(*keys, "bucket").agg(F.min(on).alias("_on")).where("_on = 1").drop("_on")


def insert_available(stream: DataFrame, keys: list[str], order: list[Column], out: str, progress: str, *, buckets: int = 64, compact: int = 16, bits: int = BITS) -> None:
    """Rows by natural key, first seen wins (T04): a batch goes to a folder of its own that a repeat of the batch overwrites.

    Beside the rows stands a table of their keys, in folders by hash bucket, and a Bloom filter for each bucket.  A batch asks the filters first and reads only the buckets that may
    hold one of its keys, so a batch of new keys reads filters alone; and of both only the last compact form and the batches since, `compact` at most.
    Rows are never read again."""
    known, filters = f"{out.rstrip('/')}-keys", f"{out.rstrip('/')}-filters"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = _marks(keys, buckets, bits)[0].alias("bucket")
        own = batch.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
        base = number // compact * compact  # the compact form holds the batches before this one
        shape = T.StructType([*(batch.schema[k] for k in keys), T.StructField("bucket", T.IntegerType())])
        word = T._parse_datatype_string("word int, ones long, bucket int")

        def folders(root: str, first: int, last: int) -> list[str]:
            return [*([f"{root}/before={first}"] if first else []), *(f"{root}/batch={k}" for k in range(first, last))]

        def held(paths: list[str], kind: T.StructType) -> DataFrame:
            found = [spark.read.schema(kind).option("basePath", p).parquet(p) for p in paths]
            return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], kind)

        def put(df: DataFrame, path: str) -> None:
            df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

        if number and number == base:  # time to put what was written since the last compact form together
            put(held(folders(known, base - compact, base), shape), f"{known}/before={base}")
            put(merged_words(held(folders(filters, base - compact, base), word)), f"{filters}/before={base}")
        if number:
            words = merged_words(held(folders(filters, base, number), word))
            perhaps = may_be_held(own, keys, words, buckets, bits)
            mine = [r["bucket"] for r in perhaps.select("bucket").distinct().collect()]  # `buckets` numbers at most
            if mine:
                own = own.join(held(folders(known, base, number), shape).where(F.col("bucket").isin(mine)).select(*keys), keys, "left_anti")
        own.write.mode("overwrite").parquet(f"{out}/batch={number}")
        written = spark.read.schema(batch.schema).parquet(f"{out}/batch={number}")
        put(written.select(*keys, bucket), f"{known}/batch={number}")
        put(filter_words(written, keys, buckets, bits), f"{filters}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def split_late(day: Column, as_of: Column, days: int = 30) -> Column:
    """current, catch-up or late (T02): a past event is still synced for `days` days, an older one is only reported."""
    age = F.datediff(as_of, day)
    return F.when(age <= 0, "current").when(age <= days, "catch-up").otherwise("late")


def closed_windows(stream: DataFrame, ts: str, keys: list[str], width: str, late: str, measures: dict[str, Column]) -> DataFrame:
    """Aggregates of windows that no row within the allowed lateness can reach any more."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(*(m.alias(name) for name, m in measures.items())).select(F.col("w.start").alias("window_start"), *keys, *measures)


def greedy_dedup_stream(stream: DataFrame, keys: list[str], ts: str, tie: str, hours: float, late: str = "1 day") -> DataFrame:
    """keys, tie of the rows kept by the exact rule (T03): no row of the key within `hours` before it was kept. A key's state is the instant kept last, and is
    dropped once the watermark (`late` behind the newest row) says that no row within `hours` of it can come; later rows are dropped. Rows of
    one trigger come in Arrow batches, of which only the instants are held to be sorted, two numbers a row."""
    gap = int(hours * 3600 * 1_000_000)
    stamp = F.col(ts).cast("timestamp")
    d = stream.select(*keys, stamp.alias("_ts"), F.unix_micros(stamp).alias("_at"), F.col(tie).alias("_tie")).dropna().withWatermark("_ts", late)
    types = {f.name: f.dataType.simpleString() for f in d.schema}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"{tie} {types['_tie']}"])

    def kept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        # Arrays, not frames: a key has few rows, and a frame's own costs would be most of its time.
        parts = [(b["_at"].to_numpy(), b["_tie"].to_numpy()) for b in batches]
        at, ties = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((ties, at)) if ties.dtype != object else np.array(sorted(range(len(at)), key=lambda k: (at[k], ties[k])))
        at, ties, out, x = at[order], ties[order], [], 0
        while x < len(at) and (last is None or (x := int(np.searchsorted(at, last + gap, side="right"))) < len(at)):
            last = int(at[x])
            out.append((*key, ties[x]))
        state.update((last,))
        state.setTimeoutTimestamp(max((last + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[*keys, tie])

    return d.groupBy(*keys).applyInPandasWithState(kept, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Run a stream over all that is there and read what it wrote."""
    out, progress = shared_folder(spark, name), shared_folder(spark, f"{name}-progress")
    stream = make()
    append_available(stream, out, progress)
    return spark.read.schema(stream.schema).parquet(out)
