"""The career search deals its bouts once."""

import datetime

import pytest
from pyspark.sql import functions as F

from boutline.operators import levels, sweeps
from boutline.operators.replay import Glicko

DAY = datetime.date(2015, 1, 1)
SHAPE = "k long, bout_id long, day date, kind int, winner int, loser int, division string, dominance double, start_winner double, start_loser double"


def test_search_deals_once(spark, monkeypatch):
    rows = [(k, 10 * k + i, DAY + datetime.timedelta(days=30 * i), 0, 1 + (i * k) % 3, 4 + i % 2, "a", 0.5, None, None) for k in range(6) for i in range(9)]
    bouts = spark.createDataFrame([*rows, (0, 900, None, 0, 1, 2, "a", 0.5, None, None)], SHAPE)
    made = []
    real = levels.dealt
    monkeypatch.setattr(levels, "dealt", lambda *a: made.append(1) or real(*a))
    sets, until = [{"rd": 300.0}, {"rd": 150.0}, {"rd": 90.0}], "2015-06-15"
    losses = sweeps.training_losses(bouts, "k", lambda at: Glicko(**at), until)
    got = [*losses(sets[:2]), *losses(sets[2:])]
    assert len(made) == 1
    want = sweeps.sweep(bouts, "k", [Glicko(**s) for s in sets], [(until, until)]).where(F.col("part") == "train").orderBy("set").collect()
    assert got == pytest.approx([r["log_loss"] for r in want], abs=1e-9) and want[0]["n"] == 36
