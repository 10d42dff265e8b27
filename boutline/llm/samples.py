"""Bounded samples of labelled rows, for the models that are fitted on the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(rows: DataFrame, known: DataFrame, bound: int) -> DataFrame:
    """(text, y) of at most `bound` labelled keys, those with the smallest 64-bit hashes, and one row a key: of rows that share a key, the one whose text has the
    smallest hash.  rows: key, text; known: key, y, each key once and not null.

    A cut on the hash first leaves a few more keys than wanted, so that the ordered limit takes a bounded number of rows from all parts together; the keys are broadcast, and
    a key on many rows leaves each task as one."""
    total = max(1, known.count())
    spare = bound + 8 * math.isqrt(bound) + 32
    at = F.shiftrightunsigned(F.xxhash64("key"), 1)  # 0 to 2^63 - 1
    some = known if total <= spare else known.where(at <= F.lit(min((1 << 63) - 1, (spare << 63) // total)))
    keys = some.orderBy(at, "key").limit(bound)
    one = rows.join(F.broadcast(keys), "key").groupBy("key").agg(F.min_by(F.struct("text", "y"), F.struct(F.xxhash64("text"), F.length("text"))).alias("x"))
    return one.select("x.text", "x.y")
