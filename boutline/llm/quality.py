"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance shrunk first towards the pooled covariance, then towards its own mean variance; the Cholesky factors of both are
computed once and shipped to the tasks, where a score is the difference of log densities, from Mahalanobis distances by one
triangular product a batch.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.llm.arrows import sliced, texts_of
from boutline.llm.samples import labelled_sample

NAMES = ("words", "word_len", "symbols", "punct", "digits", "upper", "distinct", "lines", "line_repeat", "top_word", "stretch", "bars", "short", "sentence", "odd_words")
#: Frequent short words of the corpus's four languages.
COMMON = frozenset("the of and to in is it for that on as with was be by are this from at or an der die das und ist ein eine zu mit auf von den sie es le la les de et un une est que en pour pas dans sur par au avec el los las y del se por con para una no su al lo como".split())
_SYMBOL = re.compile(r"[#$%&*@^~<>={}\[\]\\/_+|]")
_PUNCT = re.compile(r"[.,;:!?]")
_DIGIT = re.compile(r"[0-9]")
_UPPER = re.compile(r"[A-Z]")
_ODD = re.compile(r"\w[#$%&*|@^~]+$|^[#$%&*|@^~]+\w")
_STOP = re.compile(r"[.!?]")


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one whole text: logs of counts, logits and roots of shares."""
    text = text or ""
    n = len(text)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    w, share = len(words), lambda k, total: (k / total) ** 0.5 if total else 0.0
    counts: dict[str, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    return [
        np.log1p(w),
        np.log1p(n / w) if w else 0.0,
        share(len(_SYMBOL.findall(text)), n),
        share(len(_PUNCT.findall(text)), n),
        share(len(_DIGIT.findall(text)), n),
        share(len(_UPPER.findall(text)), n),
        len(counts) / w if w else 0.0,
        np.log1p(len(lines)),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        share(max(counts.values(), default=0), w),
        share(sum(counts.get(x, 0) for x in COMMON), w),
        share(text.count("|"), n),
        share(sum(len(x) <= 2 for x in words), w),
        np.log1p(w / (1 + len(_STOP.findall(text)))),
        share(sum(1 for x in words if _ODD.search(x)), w),
    ]


class Discriminant:
    """Two Gaussians with shrunk covariances; the factors are kept, not the covariances."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pool: float = 0.2, ridge: float = 0.02):
        self.centre, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.centre) / self.scale
        parts = [z[y == k] for k in (0, 1)]
        covs = [np.cov(p.T, bias=True) if len(p) > 1 else np.eye(z.shape[1]) for p in parts]
        pooled = sum(len(p) * c for p, c in zip(parts, covs)) / len(z)
        self.means, self.factors, self.offsets = [], [], []
        for p, c in zip(parts, covs):
            weight = min(1.0, pool + 10 * z.shape[1] / max(1, len(p)) * 0.1)
            s = (1 - weight) * c + weight * pooled
            s = (1 - ridge) * s + (ridge * np.trace(s) / len(s) + 1e-4) * np.eye(len(s))
            factor = np.linalg.cholesky(s)
            self.means.append(p.mean(0) if len(p) else np.zeros(z.shape[1]))
            self.factors.append(np.linalg.inv(factor))  # the inverse of the triangle: whitening is one product
            self.offsets.append(float(np.log(np.diag(factor)).sum()) - np.log(max(1, len(p)) / len(z)))
        self.slope, self.shift = calibrate(self.difference(x), y)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included, on a signed log scale: quadratic tails are long."""
        z = (x - self.centre) / self.scale
        part = [-0.5 * (((z - m) @ f.T) ** 2).sum(1) - o for m, f, o in zip(self.means, self.factors, self.offsets)]
        d = part[1] - part[0]
        return np.sign(d) * np.log1p(np.abs(d))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -30, 30)))


def calibrate(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve from differences to labels (Newton; the slope never turns negative)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -30, 30)))
        r, v = y - p, p * (1 - p) + 1e-9
        h = np.array([[(v * d * d).sum() + 1e-3, (v * d).sum()], [(v * d).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, [(r * d).sum() - 1e-3 * a, r.sum() - 1e-3 * b])
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def held_out(id_col: str | Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is held out."""
    return F.coalesce(F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, bound: int = 20_000) -> Discriminant | None:
    """Fit on at most `bound` labelled ids outside the held-out fold, those with the smallest hashes, with one row each; None without both labels."""
    known = labels.select(F.col(id_col).alias("key"), F.col(label_col).alias("y")).where("key IS NOT NULL AND y IN (0, 1)").groupBy("key").agg(F.max("y").alias("y")).where(~held_out("key"))
    rows = labelled_sample(docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), known, bound)

    def run(batches):
        for batch in sliced(batches, "text"):
            x = [statistics(t) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("y").cast(pa.int32())], names=["x", "y"])

    got = rows.select("text", "y").mapInArrow(run, "x array<double>, y int").collect()  # numbers of a bounded sample
    if len({r["y"] for r in got}) < 2:
        return None
    return Discriminant(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = 20_000) -> DataFrame:
    """(id, score, distance) for every row of `docs`; score is the probability of label 1, distance the transformed log density difference.

    Null texts count as empty, and get a score too.  Without both labels every score is 0.5.  Labels other than 0 and 1 are ignored, of
    repeated labels of an id the largest holds, repeated rows each come back, other columns are never read, an empty table gives no rows."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, bound=bound)

    def run(batches):
        for batch in sliced(batches, "text"):
            x = np.array([statistics(t) for t in texts_of(batch, "text")]).reshape(-1, len(NAMES))
            score, distance = (model.score(x), model.difference(x)) if model else (np.full(len(x), 0.5), np.zeros(len(x)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(distance)], names=["id", "score", "distance"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, score double, distance double")
