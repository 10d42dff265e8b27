"""Replays in waves: what they keep, and what is left to fold."""

from datetime import timedelta

from pyspark.sql import functions as F
from test_incremental import DAY, SHAPE, bouts, plain

from boutline.operators import replay, waves
from boutline.plans import QUERIES

DATA = "/root/testdata"


def test_waves_fold_the_states_of_those_who_go_on_alone(spark, monkeypatch):
    """A state is dropped with its person's last bout: what is folded grows with the bouts left, not with everybody who has had one."""
    rows = [*bouts(6, n=60, people=8), *((0, 2000 + n, DAY + timedelta(n % 5), 0, 1000 + 2 * n, 1001 + 2 * n, "a", 0.5, None, None) for n in range(200))]
    kept, seeded = [], []
    real, seeds = waves.checkpointed, replay.seeds
    monkeypatch.setattr(waves, "checkpointed", lambda df: kept.append(real(df)) or kept[-1])
    monkeypatch.setattr(replay, "seeds", lambda states, key: seeded.append(states.count()) or seeds(states, key))
    df = spark.createDataFrame(rows, SHAPE)
    want = plain(replay.careers(df.withColumn("k", F.lit(0).cast("long")), "k"))
    assert plain(waves.careers(df, fold_below=30)) == want
    states, pending = kept[2::3], kept[3::3]
    for s, p in zip(states, pending, strict=True):
        people = {x for r in p.collect() for x in (r["winner"], r["loser"])}
        assert {r["person"] for r in s.collect()} <= people
    assert seeded == [states[-1].count()] and seeded[0] <= 16


def test_waves_of_someone_who_meets_themself(spark):
    """No wave can hold such a bout: the pool is folded from there instead of waiting for ever."""
    rows = [(0, 1, DAY, 0, 1, 2, "a", 0.5, None, None), (0, 2, DAY + timedelta(1), 0, 1, 1, "a", 0.5, None, None), (0, 3, DAY + timedelta(2), 0, 1, 2, "a", 0.5, None, None)]
    df = spark.createDataFrame(rows, SHAPE)
    assert plain(waves.careers(df, fold_below=0)) == plain(replay.careers(df.withColumn("k", F.lit(0).cast("long")), "k"))


def test_r05_waves_folds_a_bounded_rest(spark, monkeypatch, tmp_path):
    """The query's fold doesn't grow with the orders."""
    asked = []
    real = waves.careers
    monkeypatch.setattr(waves, "careers", lambda *a, **k: asked.append(k["fold_below"]) or real(*a, **k))
    monkeypatch.setattr(waves, "FOLD_BELOW", 1100)
    spark.read.parquet(f"{DATA}/sf0.01/orders.parquet").limit(6000).write.parquet(f"{tmp_path}/orders.parquet")
    got, one = (QUERIES[q](spark, str(tmp_path)) for q in ("r05_waves", "r05_pool"))
    assert asked == [1100] and sorted(got.collect()) == sorted(one.collect())
