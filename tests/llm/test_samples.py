"""Bounded samples: the keys with the smallest hashes, a row each, whatever a key's share of the rows; the quality scores of odd rows against a fit by hand."""

import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from boutline.llm import quality, queries
from boutline.llm.samples import labelled_sample


def sampled(spark, rows, known, bound):
    return sorted(tuple(r) for r in labelled_sample(spark.createDataFrame(rows, "key long, text string"), spark.createDataFrame(known, "key long, y int"), bound).collect())


def test_smallest_hashes_and_one_row_a_key(spark):
    known = [(k, k % 2) for k in range(3000)]
    rows = [(k, f"text {k}") for k in range(3000)] + [(7, f"copy {k}") for k in range(1500)] + [(None, "none")] * 1500
    by_hash = spark.createDataFrame(known, "key long, y int").orderBy(F.shiftrightunsigned(F.xxhash64("key"), 1), "key")
    for bound in (1, 50, 2999, 3000, 5000):
        keys = {r["key"]: r["y"] for r in by_hash.limit(bound).collect()}
        got = sampled(spark, rows, known, bound)
        assert len(got) == len(keys) == min(bound, 3000)
        assert sorted(t for t, _ in got if t.startswith("text")) == sorted(f"text {k}" for k in keys if f"text {k}" in {t for t, _ in got})
        assert {int(t.split()[1]): y for t, y in got if t.startswith("text")} == {k: y for k, y in keys.items() if k != 7 or ("text 7", 1) in got}
    assert sampled(spark, rows, [], 10) == [] and sampled(spark, [], known, 10) == []


def test_one_of_rows_that_share_a_key_holds_whatever_the_order(spark):
    rows = [(1, t) for t in ("b", "a", "c", "")]
    found = {tuple(sampled(spark, rows[k:] + rows[:k], [(1, 1)], 5)) for k in range(4)}
    assert len(found) == 1 and len(found.pop()) == 1


def test_op5_on_odd_rows(spark, small, documents):
    """The query's scores are those of a discriminant that is fitted here on the labelled rows outside the fold, with inverse covariances and determinants."""
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_quality"](spark, small).collect()}
    assert got.keys() == documents.keys()
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{small}/labels.parquet").to_pylist()}
    inside = [i for i in labels if i in documents and zlib.crc32(str(i).encode()) % 4 != 2]
    x, y = np.array([quality.statistics(documents[i]) for i in inside]), np.array([labels[i] for i in inside], float)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z, width = (x - centre) / scale, x.shape[1]
    parts = [z[y == k] for k in (0, 1)]
    pooled = sum(len(p) * np.cov(p.T, bias=True) for p in parts) / len(z)
    kinds = []
    for p in parts:
        own = min(1.0, 0.2 + width / len(p))
        s = (1 - own) * np.cov(p.T, bias=True) + own * pooled
        s = 0.98 * s + (0.02 * np.trace(s) / width + 1e-4) * np.eye(width)
        kinds.append((p.mean(0), np.linalg.inv(s), np.linalg.slogdet(s)[1], np.log(len(p) / len(z))))

    def difference(one):
        v = (one - centre) / scale
        density = [-0.5 * (v - m) @ inv @ (v - m) - 0.5 * det + prior for m, inv, det, prior in kinds]
        return np.sign(density[1] - density[0]) * np.log1p(abs(density[1] - density[0]))

    a, b = quality.calibrate(np.array([difference(r) for r in x]), y)
    for i, text in documents.items():
        d = difference(np.array(quality.statistics(text)))
        assert abs(got[i]["distance"] - d) < 1e-5 and abs(got[i]["score"] - 1 / (1 + np.exp(-np.clip(a * d + b, -30, 30)))) < 1e-5
