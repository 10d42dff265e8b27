"""Places and sums within hot keys, percentiles and bounded lists against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from boutline.operators import ordered

SHAPE = "key string, id long, score double, amount long, pin boolean"


def rows(seed, n=3000):
    """A third of the rows have one key and a fifth one score; some have none."""
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", None, *"abcdef"]), k, rng.choice([7.0, float(rng.randrange(50)), None]), rng.randrange(-3, 9), rng.random() < 0.05) for k in range(n)]


@pytest.fixture(scope="module")
def data(spark):
    made = rows(1)
    return made, spark.createDataFrame(made, SHAPE).repartition(6).cache()


def in_order(made, first=lambda r: ()):
    """Rows by key, highest score first, null scores last, then by id."""
    out = {}
    for r in sorted(made, key=lambda r: (*first(r), r[2] is None, -(r[2] or 0), r[1])):
        out.setdefault(r[0], []).append(r)
    return out


ORDER = ["score", "id"]


def order():
    return [F.col("score").desc_nulls_last(), F.col("id")]


def test_running_sums(data):
    made, df = data
    got = {r["id"]: (r["n"], r["s"]) for r in ordered.running_before(df, ["key"], order(), {"n": F.lit(1).cast("long"), "s": F.col("amount")}).collect()}
    want = {}
    for part in in_order(made).values():
        s = 0
        for n, r in enumerate(part):
            want[r[1]] = (n, s)
            s += r[3]
    assert got == want


def test_ranks(data):
    made, df = data
    ranks = {r["id"]: r["place"] for r in ordered.keyed_rank(df, ["key"], order(), "place").collect()}
    assert ranks == {r[1]: n for part in in_order(made).values() for n, r in enumerate(part, 1)}
    pinned = ordered.keyed_pinned_rank(df, ["key"], F.col("pin"), order(), "place")
    assert pinned.columns == [*df.columns, "place"]
    some = {key: any(r[4] for r in part) for key, part in in_order(made).items()}
    assert {r["id"]: r["place"] for r in pinned.collect()} == {r[1]: n - some[key] for key, part in in_order(made, lambda r: (not r[4],)).items() for n, r in enumerate(part, 1)}
    top = {r["id"]: r["rn"] for r in ordered.top_per_key(df, ["key"], order(), 4, F.col("pin")).collect()}
    assert top == {i: n for i, n in ranks.items() if n <= 4 or made[i][4]}


def test_eligible_ranks(data):
    made, df = data
    got = {r["id"]: r["rank"] for r in ordered.keyed_eligible_rank(df, ["key"], "score", F.when(F.col("amount") > 4, True)).collect()}
    above = lambda r, o: o[0] == r[0] and o[3] > 4 and o[2] is not None and (r[2] is None or o[2] > r[2])
    by_key = in_order(made)
    assert got == {r[1]: 1 + sum(above(r, o) for o in by_key[r[0]]) for r in made}


def test_a_hot_key_is_spread(spark):
    """A key with most rows lies in most range partitions, and no partition holds much more than its share."""
    df = spark.range(40_000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("key"), "id")
    sizes = [r["n"] for r in df.repartitionByRange(8, "key", "id").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 40_000 / 8
    got = ordered.keyed_rank(df, ["key"], [F.col("id")], "place").where("key = 'hot'").agg(F.max("place"), F.countDistinct("place")).first()
    assert tuple(got) == (36_000, 36_000)
    assert ordered.keyed_rank(df.limit(0), ["key"], [F.col("id")], "place").count() == 0


SHARES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("kind", ["spread", "ties", "two", "one", "skewed", "few"])
def test_percentiles(spark, kind):
    rng = random.Random(4)
    values = {
        "spread": [rng.uniform(-1e6, 1e6) for _ in range(20_000)], "ties": [float(rng.choice([1, 1, 1, 2, rng.randrange(5000)])) for _ in range(20_000)], "two": [float(k % 2) for k in range(9000)], "one": [3.5] * 5000,
        "skewed": [math.exp(rng.gauss(0, 8)) for _ in range(20_000)], "few": [2.0, 1.0],
    }[kind]
    df = spark.createDataFrame([(v,) for v in [*values, None, None]], "v double").repartition(5)
    ordered_values = sorted(values)
    want = {p: ordered_values[min(len(values) - 1, int(p * len(values)))] for p in SHARES}
    assert ordered.nearest_percentiles(df, "v", SHARES, small=50) == want
    assert ordered.nearest_percentiles(df.where("v IS NULL"), "v", SHARES) == {}


def test_newest(spark, data):
    made, df = data
    got = {r["key"]: list(r["x"]) for r in ordered.newest(df, ["key"], order(), 5, F.col("id"), "x").collect()}
    assert got == {key: [r[1] for r in part[:5]] for key, part in in_order(made).items()}
    plan = ordered.newest(df, ["key"], order(), 5, F.col("id"), "x")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
