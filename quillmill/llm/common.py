"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that separate words in every word-based contract here.
WORD = r"[^\x20\x09-\x0D]+"


def whole_row(docs: DataFrame) -> Column:
    """All columns in one struct, so that helper columns beside it can't clash with any of them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, max_bytes: int = 8 << 20, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that at most ``rows`` rows or about ``max_bytes`` of text are unpacked at a time."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if text in batch.schema.names:
            step = max(1, min(rows, int(n * max_bytes / max(1, batch.column(text).nbytes))))
        else:
            step = rows
        for at in range(0, n, step):
            yield batch.slice(at, step)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding it."""
    return column.cast(pa.binary() if column.type != pa.large_string() else pa.large_binary()).to_pylist()
