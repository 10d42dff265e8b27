"""Record batches in slices of bounded size, for tasks that work on texts in Python."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: UTF-8 bytes of text that a Python worker holds decoded at once (a longer text is a slice of its own).
SLICE = 1 << 20


def cut_at(lengths: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Runs [from, to) of rows with `limit` bytes at most, or one row."""
    ends, at, out = np.cumsum(lengths), 0, []
    while at < len(lengths):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        out.append((at, to))
        at = to
    return out


def sliced(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column `text` holds about `limit` bytes in each.  Empty batches are left out."""
    for batch in batches:
        if batch.num_rows:
            lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
            for a, b in cut_at(lengths.astype(np.int64), limit):
                yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    """A slice's texts; null is empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    """The batch without `drop`, with `new` put in place of columns of the same name or at the end."""
    columns = {n: c for n, c in zip(batch.schema.names, batch.columns) if n not in drop} | new
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
