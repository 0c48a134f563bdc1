"""Arrow batches in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """At most ``rows`` rows or about ``max_bytes`` of data at a time."""
    for batch in batches:
        step = max(1, min(rows, int(batch.num_rows * max_bytes / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
