"""Gradient-boosted trees with quantile bins (M15): a yardstick for the linear models.

Rows stay in Spark, binned once. Each level of a tree is one aggregation of gradient sums by (node, feature, bin) over the smaller children's rows, half at most, so
the driver gets a number of sums that depends on depth, features and bins, never on rows. Null and NaN have a bin of their own, below every value. Sampling is by a hash of the row, so a
lost executor's rows are drawn again alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.functions.bouts import sigmoid
from boutline.operators.durable import checkpointed


@dataclass(frozen=True)
class Boosting:
    """The yardstick's usual parameters."""

    trees: int = 800
    rate: float = 0.05
    depth: int = 3
    least_hessian: float = 5.0
    l2: float = 1.0
    subsample: float = 0.8
    bins: int = 32
    seed: int = 1
    patience: int = 100


@dataclass
class Trees:
    """Cut points by feature, and trees as nested (feature, bin, left, right) with leaf values."""

    edges: dict[str, list[float]]
    trees: list = field(default_factory=list)

    def binned(self) -> list[Column]:
        """The bin of each feature: 0 for null and NaN, else 1 + the number of cut points up to the value."""
        out = []
        for name, cuts in self.edges.items():
            x = F.col(name).cast("double")
            above = F.size(F.filter(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>"), lambda e: e <= x))
            out.append(F.when(x.isNull() | F.isnan(x), 0).otherwise(1 + above).cast("int").alias(f"_b_{name}"))
        return out

    def score(self, only: list | None = None) -> Column:
        """The log-odds of a row with the bins of `binned`."""

        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, cut, left, right = node
            return F.when(F.col(f"_b_{name}") <= cut, value(left)).otherwise(value(right))

        return sum((value(t) for t in (self.trees if only is None else only)), F.lit(0.0))

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        """`df` with the probability of label 1."""
        bins = self.binned()
        d = df.select("*", *bins).withColumn(name, sigmoid(self.score()))
        return d.drop(*(f"_b_{f}" for f in self.edges))


def quantile_edges(df: DataFrame, features: list[str], bins: int, error: float = 1e-3) -> dict[str, list[float]]:
    """Distinct cut points of each feature at the quantiles k/bins, within `error` of the rank."""
    shares = [k / bins for k in range(1, bins)]
    found = df.select(*(F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f) for f in features)).approxQuantile(features, shares, error)
    return {f: sorted(set(cuts)) for f, cuts in zip(features, found)}


def _histograms(d: DataFrame, nodes: list[int], features: list[str]) -> dict[int, dict]:
    """For each node its sums of gradient and hessian by (feature, bin), one aggregation for all of them."""
    cells = d.where(F.col("_node").isin(nodes)).select("_node", "_g", "_h", F.posexplode(F.array(*(f"_b_{f}" for f in features))).alias("f", "b"))
    sums = {n: {} for n in nodes}
    for r in cells.groupBy("_node", "f", "b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect():  # nodes x features x bins
        sums[r["_node"]][r["f"], r["b"]] = (r["g"], r["h"])
    return sums


def _best_split(cells: dict, features: list[str], p: Boosting) -> tuple | None:
    """(feature's number, bin, hessian up to it, hessian beyond) of the split with the largest gain, or None."""
    best, most = None, 1e-9
    for f in range(len(features)):
        bins = sorted((b, g, h) for (of, b), (g, h) in cells.items() if of == f)
        total_g, total_h = math.fsum(g for _, g, _ in bins), math.fsum(h for *_, h in bins)
        if total_h < 2 * p.least_hessian:
            return None
        g = h = 0.0
        for b, gb, hb in bins[:-1]:
            g, h = g + gb, h + hb
            if min(h, total_h - h) >= p.least_hessian:
                gain = g * g / (h + p.l2) + (total_g - g) ** 2 / (total_h - h + p.l2) - total_g**2 / (total_h + p.l2)
                if gain > most:
                    best, most = (f, b, h, total_h - h), gain
    return best


def _value(cells: dict, p: Boosting) -> float:
    one = [(g, h) for (of, _), (g, h) in cells.items() if of == 0]
    return -math.fsum(g for g, _ in one) / (math.fsum(h for _, h in one) + p.l2)


def _grow(d: DataFrame, features: list[str], p: Boosting):
    """One tree over the rows of `d` (bins, _g, _h).  A row's node is a column; the children of node k are 2 k + 1 and 2 k + 2.  Each level is one aggregation, over the
    rows of the smaller child of each split alone: the other's sums are its parent's less these."""
    d = d.withColumn("_node", F.lit(0))
    sums = _histograms(d, [0], features)
    splits: dict[int, tuple] = {}
    level = [0]
    for _ in range(p.depth):
        found = {k: split for k in level if (split := _best_split(sums[k], features, p))}
        if not found:
            break
        splits |= found
        moved = F.col("_node")
        for k, (f, b, *_) in found.items():
            moved = F.when(F.col("_node") == k, F.when(F.col(f"_b_{features[f]}") <= b, 2 * k + 1).otherwise(2 * k + 2)).otherwise(moved)
        d = d.withColumn("_node", moved)
        smaller = [2 * k + 1 if low <= high else 2 * k + 2 for k, (_, _, low, high) in found.items()]
        sums |= _histograms(d, smaller, features)
        for k, small in zip(found, smaller):
            other = 4 * k + 3 - small
            sums[other] = {cell: (g - sums[small].get(cell, (0.0, 0.0))[0], h - sums[small].get(cell, (0.0, 0.0))[1]) for cell, (g, h) in sums[k].items()}
        level = [c for k in found for c in (2 * k + 1, 2 * k + 2)]

    def plain(k: int):
        if k not in splits:
            return p.rate * _value(sums[k], p)
        f, b, *_ = splits[k]
        return features[f], b, plain(2 * k + 1), plain(2 * k + 2)

    return plain(0)


def fit(df: DataFrame, features: list[str], label: str, params: Boosting = Boosting(), valid: DataFrame | None = None, key: str | None = None) -> tuple[Trees, list[float]]:
    """Trees from log-odds 0, and with `valid` its log-loss after each tree: the trees up to its least are kept, and fitting stops after `patience` trees without a
    gain. `key`: the column whose hash decides which rows a tree sees; by default all features' hash. Rows without a label are left out."""
    model = Trees(quantile_edges(df, features, params.bins))
    ident = F.xxhash64(key) if key else F.xxhash64(*features)
    shape = lambda d: checkpointed(d.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_y"), ident.alias("_k"), *model.binned(), F.lit(0.0).alias("_z")))
    rows, held = shape(df), None if valid is None else shape(valid)
    losses: list[float] = []
    for t in range(params.trees):
        p = sigmoid(F.col("_z"))
        drawn = F.pmod(F.xxhash64("_k", F.lit(params.seed), F.lit(t)), F.lit(1_000_000)) < int(params.subsample * 1_000_000)
        tree = _grow(rows.where(drawn).withColumns({"_g": p - F.col("_y"), "_h": p * (1 - p)}), features, params)
        model.trees.append(tree)
        step = F.col("_z") + model.score([tree])
        rows = rows.withColumn("_z", step)
        if t % 10 == 9:
            rows = checkpointed(rows)
        if held is not None:
            held = held.withColumn("_z", step)
            held = checkpointed(held) if t % 10 == 9 else held
            own = F.when(F.col("_y") == 1, sigmoid(F.col("_z"))).otherwise(1 - sigmoid(F.col("_z")))
            losses.append(held.agg(F.avg(-F.ln(F.greatest(own, F.lit(1e-12))))).first()[0])
            if len(losses) - 1 - losses.index(min(losses)) >= params.patience:
                break
    if losses:
        model.trees = model.trees[: losses.index(min(losses)) + 1]
    return model, losses
