"""Bloom filters by bucket, and inserts that ask them first."""

from pyspark.sql import functions as F

from boutline.streaming import ingest


def test_filters_lose_no_key(spark):
    held = spark.range(0, 4000, 2).select((F.col("id") % 50).cast("int").alias("a"), F.col("id").cast("string").alias("b"))
    asked = spark.range(4000).select((F.col("id") % 50).cast("int").alias("a"), F.col("id").cast("string").alias("b"), F.lit("x").alias("extra"))
    halves = [held.where(F.pmod(F.xxhash64("b"), F.lit(2)) == k) for k in (0, 1)]
    parts = [ingest.filter_words(h, ["a", "b"], 8, bits=1 << 15) for h in halves]
    words = ingest.merged_words(parts[0].unionByName(parts[1])).cache()
    assert sorted(map(tuple, words.collect())) == sorted(map(tuple, ingest.filter_words(held, ["a", "b"], 8, bits=1 << 15).collect()))
    perhaps = {int(r["b"]) for r in ingest.may_be_held(asked, ["a", "b"], words, 8, bits=1 << 15).collect()}
    assert perhaps >= set(range(0, 4000, 2)) and len(perhaps) < 2040
    assert ingest.may_be_held(asked, ["a", "b"], words.limit(0), 8).count() == 0 and ingest.filter_words(held.limit(0), ["a", "b"], 8).count() == 0
    nulls = spark.createDataFrame([(None, "x"), (1, None)], "a int, b string")
    assert ingest.may_be_held(nulls, ["a", "b"], ingest.filter_words(nulls, ["a", "b"], 8), 8).count() == 2


def test_inserts_over_many_batches(spark, tmp_path):
    """First seen wins over batches and compactions; a batch of new keys opens no bucket of the key table."""
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    batches = [range(0, 40), range(20, 60), range(100, 140), range(0, 5), range(55, 65), range(200, 210)]
    want = {}
    for n, ids in enumerate(batches):
        rows = [(i, n) for i in ids] + [(ids[0], n + 50)]
        for i, v in rows:
            want.setdefault(i, v)
        spark.createDataFrame(rows, "id int, v int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id int, v int").parquet(source)
        ingest.insert_available(stream, ["id"], [F.col("v")], out, f"file://{tmp_path}/progress", buckets=4, compact=2, bits=1 << 12)
    got = [(r["id"], r["v"]) for r in spark.read.schema("id int, v int").parquet(out).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_new_keys_open_no_bucket(spark, tmp_path, monkeypatch):
    """The key table is taken away: a batch of new keys goes in without it."""
    import shutil

    source, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def insert(ids):
        spark.createDataFrame([(i, 0) for i in ids], "id int, v int").coalesce(1).write.mode("append").parquet(f"file://{source}")
        stream = spark.readStream.schema("id int, v int").parquet(f"file://{source}")
        ingest.insert_available(stream, ["id"], [F.col("v")], f"file://{out}", f"file://{tmp_path}/progress", buckets=4)

    insert(range(50))
    shutil.move(f"{out}-keys", f"{out}-gone")
    insert(range(1000, 1020))
    assert spark.read.schema("id int, v int").parquet(f"file://{out}").count() == 70
