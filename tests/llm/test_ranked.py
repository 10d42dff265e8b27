"""Ranked search against SQL and a plain scorer of all documents; when reading ends; odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from boutline.llm import queries, ranked
from test_queries import same_as_sql

DATA = "/root/testdata"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k=10):
    """[(item, rank, id, score)] by scoring every document for every item."""
    words = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n_docs, n_all = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    worth = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for i, w in words:
            m, tf = 100 - 75 + 75 * len(w) * n_docs // n_all, Counter(w)
            score = sum(c * worth[t] * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t, c in asked.items() if t in tf)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def found(df):
    return sorted((r["item"], r["rank"], r["id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("scale", ["small", f"{DATA}/sf0.01"])
def test_query_equals_sql(spark, small, scale):
    sf_dir = small if scale == "small" else scale
    got = [r.asDict() for r in queries.QUERIES["op12_ranked"](spark, sf_dir).collect()]
    same_as_sql(got, "op12_ranked", sf_dir, "documents", "benchmark")
    assert len({(r["item_id"], r["rank"]) for r in got}) == len(got) > 300


def test_whole_texts_and_blocks(spark, small, documents):
    """Against the plain scorer, with queries in blocks, an index in several chunks, and lists that are read in several rounds."""
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{small}/benchmark.parquet").to_pylist()]
    want = sorted(plain(documents.items(), items, 7))
    docs, asked = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    for options in ({}, {"block": 100, "chunk": 500}):
        assert found(ranked.top_documents(spark, docs.repartition(3), asked, k=7, **options)) == want


def test_reading_ends_early():
    """Rare terms at the top of their lists end the reading; equal scores at the threshold do not."""
    rng = np.random.default_rng(3)
    n = 5000
    sizes = np.full(n, 2)
    terms = np.stack([rng.integers(0, 5, n), rng.integers(5, 40, n)], 1).ravel()
    tfs = rng.integers(1, 60, 2 * n)
    lengths = rng.integers(50, 4000, n)
    index = ranked.Chunk(list(range(n)), sizes, terms, tfs, lengths, n, int(lengths.sum()), 40)
    worth = np.zeros(40, np.int64)
    numbers = np.array([1, 7, 9])
    worth[numbers] = [300, 9000, 8000]
    best = []
    looked_up = index.search(numbers, worth, best, 10)
    all_scores = index.scores(np.arange(n), worth)
    assert [(-s, i) for s, _, i in best] == sorted(((int(s), i) for i, s in enumerate(all_scores) if s > 0), key=lambda x: (-x[0], x[1]))[:10]
    assert looked_up < np.isin(terms.reshape(n, 2), numbers).any(1).sum() / 2
    same = ranked.Chunk(list(range(n))[::-1], np.ones(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64), np.full(n, 9), n, 9 * n, 1)
    best = []
    assert same.search(np.array([0]), np.array([5]), best, 3) == n and [i for *_, i in best] == [0, 1, 2]


SHAPE = "doc_id long, text string, item_id string, id string, item string, n string, terms string, part string, rank string, score string"


def test_odd_rows(spark):
    x = ["x"] * 8
    docs = [(1, "red fox"), (1, "red fox"), (None, "red fox"), (2, None), (3, ""), (4, " \t!"), (5, "RED É日本 fox fox"), (6, "é nothing"), (0, "red fox")]
    items = [(1, "red FOX fox"), (1, "red FOX fox"), (None, "red"), (2, None), (3, "-- !"), (4, "absent words"), (5, "É日本")]
    d = spark.createDataFrame([(*r, *x) for r in docs], SHAPE)
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, score string")
    got = sorted((r["item"], r["rank"], str(r["id"]), r["score"]) for r in ranked.top_documents(spark, d, i).collect())
    assert got == sorted((a, b, str(c), s) for a, b, c, s in plain(docs, [r for r in items if r[0] is not None]))
    assert [r[2] for r in got if r[0] == 1][::2] == ["0", "1", "1", "None", "5"]  # equal scores: by id, null ids last
    assert ranked.top_documents(spark, d.limit(0), i).count() == 0 and ranked.top_documents(spark, d, i.limit(0)).count() == 0
    named = ranked.top_documents(spark, d.withColumn("doc_id", F.concat(F.lit("k"), "doc_id")), i).where("item = 1").select("id").distinct()
    assert {r["id"] for r in named.collect()} == {"k0", "k1", "k5", None}
