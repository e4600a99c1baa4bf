"""Arrow batches in slices of bounded size, so that a worker's memory does not follow the rows or the length of texts in a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a slice at most, unless a row alone has more.
SLICE = 1 << 20


def sliced(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `most` bytes, one row at least."""
    most = most or SLICE
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = batch.num_rows - at
            while n > 1 and (size := batch.slice(at, n).nbytes) > most:
                n = max(1, min(n // 2, n * most // size + 1))
            yield batch.slice(at, n)
            at += n


def in_slices(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[list, ...]]:
    """The columns of each slice as lists of Python values."""
    for batch in sliced(batches, most):
        yield tuple(c.to_pylist() for c in batch.columns)
