"""A seeded 32-bit generator with the mulberry32 step (F40): reproducible coin flips and subsamples, by row or in sequence."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
STEP = 0x6D2B79F5  # Fixed values: the generator's constants are this, 61, and the shifts 15, 7 and 14.


def mulberry32(seed: int) -> Iterator[float]:
    """Numbers in [0, 1)."""
    a = seed & MASK
    while True:
        a = (a + STEP) & MASK
        t = ((a ^ (a >> 15)) * (a | 1)) & MASK
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & MASK)) & MASK
        yield (t ^ (t >> 14)) / 4294967296


def draw(seed: Column, n: int = 0) -> Column:
    """The n-th number (from 0) of the generator seeded with a whole number: each row draws for itself, so the order of rows and tasks doesn't matter."""
    mask = F.lit(MASK).cast("long")

    def times(x: Column, y: Column) -> Column:
        """Product modulo 2^32, by halves, as a whole one would overflow."""
        high = ((F.shiftright(x, 16) * y).bitwiseAND(F.lit(0xFFFF).cast("long"))) * 65536
        return (x.bitwiseAND(F.lit(0xFFFF).cast("long")) * y + high).bitwiseAND(mask)

    shifted = lambda x, by: x.bitwiseXOR(F.shiftright(x, by))
    a = (seed.cast("long").bitwiseAND(mask) + F.lit((n + 1) * STEP & MASK).cast("long")).bitwiseAND(mask)
    t = times(shifted(a, 15), a.bitwiseOR(F.lit(1).cast("long")))
    t = t.bitwiseXOR((t + times(shifted(t, 7), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(mask))
    return shifted(t, 14) / 4294967296.0
