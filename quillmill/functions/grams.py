"""Hashes of word n-grams over Arrow batches of normalised texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_STEP = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_LETTER = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, size=256, dtype=np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _spread(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
    return h ^ h >> np.uint64(32)


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of values that depends on nothing but these: sums weighted by powers, moved back to its start."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_STEP, len(values)), out=sums[1:])
    return _spread((sums[ends] - sums[starts]) * _powers(_BACK, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


def gram_lists(texts: pa.Array, n: int) -> pa.Array:
    """For each text the sorted distinct 64-bit hashes of ``n`` consecutive words, words being apart by blanks; null if it has none."""
    rows = [t or b"" for t in texts.cast(pa.binary() if texts.type != pa.large_string() else pa.large_binary()).to_pylist()]
    data = np.frombuffer(b"\n".join(rows), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], np.isin(data, (9, 10, 11, 12, 13, 32)), [True]])))
    starts, ends = edge[::2], edge[1::2]
    first = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in rows)]))  # each text's first word
    first[-1] = len(starts)
    found: list[np.ndarray | None] = [None] * len(rows)
    if len(starts) >= n:
        at = np.arange(len(starts) - n + 1)
        grams = _runs(_runs(_LETTER[data], starts, ends), at, at + n).view(np.int64)
        found = [np.unique(grams[a : b - n + 1]) if b - a >= n else None for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    sizes = np.array([0 if g is None else len(g) for g in found])
    values = np.concatenate([g for g in found if g is not None] or [np.empty(0, np.int64)])
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), values, mask=pa.array([g is None for g in found]))
