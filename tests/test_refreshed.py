"""Histories brought up to date by whole keys."""

import datetime

from boutline.operators import replay

DAY = datetime.date(2015, 1, 1)
SHAPE = "k long, bout_id long, day date, kind int, winner int, loser int, division string, dominance double, start_winner double, start_loser double"


def test_refreshed_sorts_no_history(spark):
    """The joins with the keys that were touched hash those keys, whatever their size, and neither sort nor hash the history."""
    rows = [(k, 10 * k + i, DAY + datetime.timedelta(days=i), 0, 1, 2 + i % 2, "a", 0.5, None, None) for k in range(6) for i in range(5)]
    every, fresh = spark.createDataFrame(rows, SHAPE), spark.createDataFrame([r for r in rows if r[0] % 2 and r[1] % 10 == 4], SHAPE)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        history = replay.careers(every.join(fresh.select("bout_id"), "bout_id", "left_anti").select(*every.columns), "k")
        got = replay.refreshed(history, every, fresh, "k", lambda d: replay.careers(d, "k"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ShuffledHashJoin") == 2 and "LeftSemi" in plan
        assert sorted(map(str, got.collect())) == sorted(map(str, replay.careers(every, "k").select(*got.columns).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
