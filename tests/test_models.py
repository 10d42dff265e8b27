"""Fits against numpy, searches against known minima, labels against a breadth-first walk."""

import datetime
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutline.operators import boosting, graph, models, outcomes, replay, weekly
from boutline.sources import sinks


def test_logistic_is_at_the_minimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.5, -0.7] + 0.3)))).astype(int)
    rows = [(float(a), float(b), int(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 1)]
    m = models.fit_logistic(spark.createDataFrame(rows, "a double, b double, y int"), ["a", "b"], "y")
    z = (x - x.mean(0)) / x.std(0)
    p = 1 / (1 + np.exp(-(z @ m.weights + m.bias)))
    assert np.allclose(z.T @ (p - y) / 400 + 0.01 * np.array(m.weights), 0, atol=1e-7)
    assert abs((p - y).sum()) < 1e-5
    empty = models.fit_logistic(spark.createDataFrame([], "a double, y int"), ["a"], "y", prior=[1.0])
    assert empty.weights == (1.0,)


def test_windows_are_single_fits(spark):
    """All windows' fits in one loop are the fits of their rows alone, and so are the losses."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 2)) * [1, 30] + [0, 5]
    y = (rng.random(500) < 1 / (1 + np.exp(-(x @ [0.8, -0.02])))).astype(int)
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(days=int(d)) for d in rng.integers(0, 900, 500)]
    rows = [(float(a), float(b), int(c), d) for (a, b), c, d in zip(x, y, days)] + [(1.0, None, 1, days[0]), (1.0, 1.0, None, days[0]), (1.0, 1.0, 1, None)]
    df = spark.createDataFrame(rows, "a double, b double, y int, day date")
    windows = [("2020-06-01", "2021-01-01"), ("2021-01-01", "2021-09-01"), ("2022-01-01", "9999-12-31"), ("2019-01-01", "2019-06-01")]
    for options in ({}, {"l2": 5.0, "prior": [1.0, 0.0], "intercept": False, "standardize": False, "per_row": False}):
        ready = models.prepared(df, ["a", "b"], "y", "day")
        fits = models.fit_windows(ready, ["a", "b"], windows, **options)
        found = {(r["window"], r["part"]): r for r in models.window_metrics(ready, fits, windows).collect()}
        for w, (start, end) in enumerate(windows):
            train = df.where(F.col("day") < start)
            one = models.fit_logistic(train, ["a", "b"], "y", **options)
            assert np.allclose(one.weights, fits[w].weights, atol=1e-7) and abs(one.bias - fits[w].bias) < 1e-7
            if train.count():
                assert all(abs(g) < 1e-6 for g in models.slopes(train, fits[w], "y", options.get("l2", 0.01), options.get("prior"), options.get("per_row", True))[: 2 if options else 3])
            for part, of in (("train", train), ("test", df.where((F.col("day") >= start) & (F.col("day") < end)))):
                p = of.dropna().select(fits[w].predict().alias("p"), "y").collect()
                if p:
                    own = [r["p"] if r["y"] else 1 - r["p"] for r in p]
                    assert found[w, part]["n"] == len(p) and abs(found[w, part]["log_loss"] + np.mean(np.log(own))) < 1e-9
                    assert abs(found[w, part]["accuracy"] - np.mean([q > 0.5 for q in own])) < 1e-9
                else:
                    assert (w, part) not in found


def test_scale(spark):
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "x double")
    assert models.fit_scale(df([0.0, 0.0]), "x") == 0
    assert models.fit_scale(df([1.0, 2.0]), "x") == pytest.approx(50)
    k = models.fit_scale(df([1.0, 1.0, 1.0, -1.0]), "x")
    assert k == pytest.approx(np.log(3), abs=1e-6)


def test_pattern_search():
    space = {"a": models.Range(-10, 10, 2), "b": models.Range(0.1, 100, 2, log=True), "c": models.Range(0, 9, 2, whole=True)}
    at, best, used = models.pattern_search(lambda q: (q["a"] - 1) ** 2 + np.log(q["b"] / 4) ** 2 + (q["c"] - 3) ** 2, {"a": 9.0, "b": 50.0, "c": 9.0}, space, refinements=8)
    assert at["c"] == 3 and abs(at["a"] - 1) < 0.05 and abs(np.log(at["b"] / 4)) < 0.05 and best < 0.01 and used < 2000


def walk(seeds, edges):
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b), near[b].add(a)
    known, front = dict(seeds), set(seeds)
    while front:
        reached = defaultdict(set)
        for n in front:
            if known[n] is not None:
                for m in near[n] - known.keys():
                    reached[m].add(known[n])
        known |= {n: v.pop() if len(v) == 1 else None for n, v in reached.items()}
        front = set(reached)
    return {n: v for n, v in known.items() if v is not None}


@pytest.mark.parametrize("seed", [1, 2])
def test_spread_labels(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 40, (45, 2))]
    seeds = {0: "x", 7: "y", 21: "x", 39: "y"}
    got = graph.spread_labels(spark.createDataFrame(list(seeds.items()), "node int, label string"), spark.createDataFrame([*edges, (None, 3)], "a int, b int"))
    assert {r.node: r.label for r in got.collect()} == walk(seeds, edges)


def xor_rows(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, 2))
    return [(int(k), float(a), float(b), int(a * b > 0)) for k, (a, b) in enumerate(x)]


def test_boosting_learns_what_a_line_cannot(spark):
    shape = "id long, a double, b double, y int"
    train, test = spark.createDataFrame(xor_rows(1500, 7), shape), spark.createDataFrame(xor_rows(400, 11), shape)
    model, _ = boosting.fit(train, ["a", "b"], "y", boosting.Boosting(trees=12, rate=0.4, depth=2), key="id")
    right = model.predict(test).where((F.col("p") > 0.5) == (F.col("y") == 1)).count()
    assert right / 400 > 0.9 and model.predict(test).columns == ["id", "a", "b", "y", "p"]


def plain_boost(rows, trees, p):
    """The same trees by sums over plain lists: cells from every row of both children."""
    edges = [sorted(set(float(np.quantile([r[f] for r in rows], k / p.bins, method="inverted_cdf")) for k in range(1, p.bins))) for f in range(2)]
    binned = [[1 + sum(e <= r[f] for e in edges[f]) for f in range(2)] for r in rows]
    z, made = [0.0] * len(rows), []

    def grow(members, depth):
        g = {k: 1 / (1 + math.exp(-z[k])) - rows[k][2] for k in members}
        h = {k: (q := 1 / (1 + math.exp(-z[k]))) * (1 - q) for k in members}
        G, H = sum(g.values()), sum(h.values())
        best, most = None, 1e-9
        if depth and H >= 2 * p.least_hessian:
            for f in range(2):
                for b in sorted({binned[k][f] for k in members})[:-1]:
                    low = [k for k in members if binned[k][f] <= b]
                    gl, hl = sum(g[k] for k in low), sum(h[k] for k in low)
                    if min(hl, H - hl) >= p.least_hessian:
                        gain = gl * gl / (hl + p.l2) + (G - gl) ** 2 / (H - hl + p.l2) - G * G / (H + p.l2)
                        if gain > most + 1e-12:
                            best, most = (f, b), gain
        if not best:
            return p.rate * -G / (H + p.l2)
        f, b = best
        return ("ab"[f], b, *(grow([k for k in members if (binned[k][f] <= b) == side], depth - 1) for side in (True, False)))

    def value(node, k):
        while isinstance(node, tuple):
            node = node[2] if binned[k]["ab".index(node[0])] <= node[1] else node[3]
        return node

    for _ in range(trees):
        tree = grow(range(len(rows)), p.depth)
        made.append(tree)
        z = [x + value(tree, k) for k, x in enumerate(z)]
    return edges, made


def flat(tree):
    return [x for part in tree for x in flat(part)] if isinstance(tree, tuple) else [tree]


def test_boosting_equals_plain_trees(spark):
    """Splits and leaves of three trees of depth 2, every row drawn: the sums of the larger children by subtraction are those of their rows."""
    rows = [(a, b, y) for _, a, b, y in xor_rows(300, 3)]
    p = boosting.Boosting(trees=3, rate=0.5, depth=2, bins=6, subsample=1.0, least_hessian=2.0)
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, a double, b double, y int")
    edges, want = plain_boost(rows, 3, p)
    model, _ = boosting.fit(d, ["a", "b"], "y", p, key="id")
    if [model.edges["a"], model.edges["b"]] != edges:  # the sketch may pick a neighbouring cut
        model_edges = model.edges
        assert all(abs(sum(r[f] <= e for r in rows) - sum(r[f] <= w for r in rows)) <= 1 for f, name in enumerate("ab") for e, w in zip(model_edges[name], edges[f]))
        return
    for own, plain_tree in zip(model.trees, want):
        assert [x if isinstance(x, (str, int)) else pytest.approx(x, abs=1e-9) for x in flat(plain_tree)] == flat(own)


def test_boosting_stops_at_the_best_loss_and_bins_what_is_missing(spark):
    rows = [(k, None if k % 4 == 1 else float("nan") if k % 4 == 3 else k / 400, int(k % 2)) for k in range(400)]
    d = spark.createDataFrame(rows, "id long, a double, y int")
    model, losses = boosting.fit(d, ["a"], "y", boosting.Boosting(trees=8, rate=0.9, patience=2), valid=d)
    assert len(model.trees) == losses.index(min(losses)) + 1
    one = model.predict(spark.createDataFrame([(None,), (float("nan"),), (0.5,)], "a double")).collect()
    assert one[0]["p"] > 0.9 and one[1]["p"] > 0.9 and one[2]["p"] < 0.1


def test_outcome_lines_add_up(spark):
    sides = "struct<" + ", ".join(f"{c}: double" for c in outcomes.COUNTS) + ">"
    mix = "struct<ko: double, sub: double, dec: double>"
    none, striker = (0.0,) * len(outcomes.COUNTS), (9.0, 0.0, 1.0, 0.0, 0.0, 2.0, 9.0, 9.0, 0.0, 0.0)
    prior = (0.3, 0.2, 0.5)
    d = spark.createDataFrame([(1, 0.7, none, none, prior), (2, 0.7, striker, none, prior)], f"id int, p double, a {sides}, b {sides}, q {mix}")
    rounds = {m: F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)) for m in ("ko", "sub")}
    rows = outcomes.with_outcome_lines(d, "x", "p", "a", "b", "q", rounds, 1.7).collect()
    for r in rows:
        assert abs(sum(line["probability"] for line in r["x"]) - 1) < 1e-12
        assert all(abs(sum(line["by_round"]) - line["probability"]) < 1e-12 for line in r["x"] if line["method"] != "dec")
    plain, by_ko = ({(line["corner"], line["method"]): line for line in r["x"]} for r in rows)
    assert abs(plain["A", "ko"]["probability"] - 0.7 * 0.3) < 1e-12  # an empty record leaves the prior
    assert by_ko["A", "ko"]["probability"] > plain["A", "ko"]["probability"]
    assert by_ko["A", "ko"]["by_round"][0] / by_ko["A", "ko"]["probability"] > 0.5  # its finishes came early


def test_a_model_of_other_features_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/model"
    with pytest.raises(FileNotFoundError):
        sinks.load_model(spark, path, ["a"])
    sinks.save_model(spark, path, {"features": ["a", "b"], "weights": [1, 2], "means": [0, 0], "scales": [1, 1]})
    assert sinks.load_model(spark, path, ["a", "b"])["weights"] == [1, 2]
    for wrong in (["b", "a"], ["a"], ["a", "b", "c"]):
        with pytest.raises(ValueError):
            sinks.load_model(spark, path, wrong)
    sinks.save_model(spark, path, {"features": ["a"], "weights": [1, 2], "means": [0], "scales": [1]})
    with pytest.raises(ValueError):
        sinks.load_model(spark, path, ["a"])


def test_rounded_parameters():
    loss = lambda at: (at["k"] - 1.234) ** 2 / 10
    assert models.rounded_parameters(loss, {"k": 1.234}) == {"k": 1.2}
    assert models.rounded_parameters(lambda at: 100 * loss(at), {"k": 1.234}) == {"k": 1.234}


def test_weekly_batch_by_parts(spark, tmp_path):
    """Two weeks, then the snapshot and the streaks alone, and a dry run: what is published and what isn't."""
    shape = "k long, bout_id long, day date, kind int, winner int, loser int, division string, dominance double, start_winner double, start_loser double"
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(7 * n)
    rows = [(1, n, day(n), 0, 1 + n % 3, 1 + (n + 1) % 3, "x", 0.5, None, None) for n in range(12)]
    bouts, out = spark.createDataFrame(rows, shape), f"file://{tmp_path}/out"
    first = weekly.run(spark, bouts.where("bout_id < 10"), "k", out, today=F.lit("2024-03-06").cast("date"))
    assert {r["trend"] for r in first["snapshots"].collect()} == {"new"} and first["ratings"].count() == 3
    second = weekly.run(spark, bouts, "k", out, today=F.lit("2024-03-20").cast("date"))
    got = second["snapshots"].collect()
    assert len(got) == 6 and {r["trend"] for r in got if str(r["week"]) == "2024-03-18"} <= {"up", "down", "same"}
    dry = weekly.run(spark, bouts, "k", out, today=F.lit("2024-03-20").cast("date"), dry_run=f"file://{tmp_path}/dry", results_only_since=F.lit("2024-03-01").cast("date"))
    version = sinks.Versions(spark, out)
    assert version.number() == 2 and dry["ratings"].count() == 3
    again = weekly.run(spark, bouts, "k", out, today=F.lit("2024-03-20").cast("date"), snapshot_only=True)
    assert sorted(map(str, again["snapshots"].collect())) == sorted(map(str, got)) and version.number() == 3
    only = weekly.run(spark, bouts, "k", out, today=F.lit("2024-03-20").cast("date"), streaks_only=True)
    assert {r["participant"]: r["streak"] for r in only["streaks"].collect()} == {r["participant"]: r["streak"] for r in second["streaks"].collect()}
