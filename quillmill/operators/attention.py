"""Scaled dot-product attention over long sequences, by tiles of keys whose partial softmaxes are merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.skew import small

#: Positions in a tile, and tiles in a block at most: what a task holds of the queries.
TILE, TILES = 256, 512
#: Blocks that a sequence is cut into, unless they would be larger than that. So each tile is sent a bounded number of times.
BLOCKS = 8

_PACKED = "sequence {kind}, tile long, n int, data binary"
_TILES = "sequence {kind}, tile long, n int, queries binary, keys binary"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _packed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by sequence and tile: each tile as two values, positions beside the queries and beside keys and values."""
    held: list[np.ndarray] = []
    here = None

    def row() -> pa.RecordBatch:
        whole = np.concatenate(held)
        queries, keys = whole[:, : width + 1].tobytes(), np.delete(whole, np.s_[1 : width + 1], axis=1).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([here[0]], kind), pa.array([here[1]]), pa.array([len(whole)], pa.int32()), pa.array([queries], pa.binary()), pa.array([keys], pa.binary())], ["sequence", "tile", "n", "queries", "keys"])

    kind = None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.column("sequence").type
        rows = np.column_stack([batch.column("position").to_numpy(zero_copy_only=False).astype(np.int64).view(np.float64), *[_matrix(batch.column(c)) for c in ("q", "k", "v")]])
        keys = list(zip(batch.column("sequence").to_pylist(), batch.column("tile").to_pylist(), strict=True))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if held and keys[low] != here:
                yield row()
                held = []
            here = keys[low]
            held.append(rows[low:high])
    if held:
        yield row()


class _Partial:
    """For each query the largest score, the sum of the exponentials and the weighted values, relative to that score."""

    def __init__(self, top: np.ndarray, total: np.ndarray, values: np.ndarray) -> None:
        self.top, self.total, self.values = top, total, values

    @classmethod
    def of(cls, q: np.ndarray, k: np.ndarray, v: np.ndarray, seen: np.ndarray | None) -> _Partial:
        """``seen``: which key each query sees; None for all of them."""
        scores = q @ k.T / np.sqrt(q.shape[1])
        if seen is not None:
            scores = np.where(seen, scores, -np.inf)
        top = scores.max(axis=1, initial=-np.inf)
        weights = np.exp(scores - np.where(np.isfinite(top), top, 0)[:, None])
        return cls(top, weights.sum(axis=1), weights @ v)

    def merge(self, other: _Partial) -> _Partial:
        top = np.maximum(self.top, other.top)
        known = np.where(np.isfinite(top), top, 0)
        a, b = np.exp(self.top - known), np.exp(other.top - known)
        return _Partial(top, a * self.total + b * other.total, a[:, None] * self.values + b[:, None] * other.values)


def dealt(packed: DataFrame, last: DataFrame, causal: bool = True, tiles: int = TILES) -> DataFrame:
    """``sequence, block, share, part, tile, n, data``: for each block of queries and each block of keys that it may see, the queries (part 0) and keys (part 1).

    ``last`` has the last tile of each sequence. Blocks grow with their sequence, so that a tile goes to ``BLOCKS + 1`` pairs of blocks on the whole, and
    more only where a block would be over ``tiles``.
    """
    size = F.least(F.lit(tiles).cast("long"), F.ceil((F.col("last") + 1) / BLOCKS))
    own = packed.join(last, "sequence").withColumns({"at": F.floor(F.col("tile") / size), "end": F.floor(F.col("last") / size)})
    first = F.col("at") if causal else F.lit(0).cast("long")
    as_query = F.transform(F.sequence(F.lit(0).cast("long"), "at" if causal else "end"), lambda x: F.struct(F.col("at").alias("block"), x.alias("share"), F.lit(0).alias("part")))
    as_keys = F.transform(F.sequence(first, "end"), lambda x: F.struct(x.alias("block"), F.col("at").alias("share"), F.lit(1).alias("part")))
    cells = own.withColumn("cell", F.explode(F.concat(as_query, as_keys)))
    return cells.select("sequence", "cell.block", "cell.share", "cell.part", "tile", "n", F.when(F.col("cell.part") == 0, F.col("queries")).otherwise(F.col("keys")).alias("data"))


def tiled_attention(rows: DataFrame, width: int, causal: bool = True, tile: int = TILE, tiles: int = TILES) -> DataFrame:
    """``sequence, position, out``: the mean of the values by the softmax of ``q . k / sqrt(width)``, for each position.

    ``rows``: sequence, position (a non-negative whole number, once a sequence), and arrays q and k of ``width`` and v. With
    ``causal`` a position sees itself and those before it. A sequence is cut into tiles of ``tile`` positions, and tiles into
    blocks (see ``dealt``). A task holds a block of queries with a partial softmax for each, past which a block of keys streams tile by
    tile. Partial ones are merged afterwards, in any order.
    """
    kind = rows.schema["sequence"].dataType.simpleString()
    cut = rows.select("sequence", F.floor(F.col("position") / tile).cast("long").alias("tile"), F.col("position").cast("long").alias("position"), *[F.col(c).cast("array<double>").alias(c) for c in ("q", "k", "v")])
    packed = cut.repartition("sequence", "tile").sortWithinPartitions("sequence", "tile", "position").mapInArrow(lambda it: _packed(it, width), _TILES.format(kind=kind))
    last = small(cut.groupBy("sequence").agg(F.max("tile").alias("last")))

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, kinds = None, None
        held: list[list] = []  # tile, positions, queries, partial softmax

        def rows() -> Iterator[pa.RecordBatch]:
            for number, places, _, state in held:
                if state is not None:
                    whole = np.column_stack([places.view(np.float64), state.top, state.total, state.values])
                    yield pa.RecordBatch.from_arrays([pa.array([here[0]], kinds), pa.array([number]), pa.array([len(whole)], pa.int32()), pa.array([whole.tobytes()], pa.binary())], ["sequence", "tile", "n", "data"])

        for batch in batches:
            kinds = batch.schema.field("sequence").type
            for r in range(batch.num_rows):
                sequence, block, share, part, number, n, data = (batch.column(c)[r].as_py() for c in ("sequence", "block", "share", "part", "tile", "n", "data"))
                if here != (sequence, block, share):
                    yield from rows()
                    here, held = (sequence, block, share), []
                whole = np.frombuffer(data, np.float64).reshape(n, -1)
                at = whole[:, 0].copy().view(np.int64)
                if part == 0:
                    held.append([number, at, whole[:, 1:].copy(), None])
                    continue
                k, v = whole[:, 1 : width + 1], whole[:, width + 1 :]
                for one in held:
                    if causal and one[0] < number:
                        continue
                    new = _Partial.of(one[2], k, v, at[None, :] <= one[1][:, None] if causal and one[0] == number else None)
                    one[3] = new if one[3] is None else one[3].merge(new)
        yield from rows()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, places, state = None, None, None

        def done() -> pa.RecordBatch:
            out = state.values / state.total[:, None]
            return pa.RecordBatch.from_arrays([pa.array([here[0]] * len(out), kinds), pa.array(places), pa.array(list(out), pa.list_(pa.float64()))], ["sequence", "position", "out"])

        kinds = None
        for batch in batches:
            kinds = batch.schema.field("sequence").type
            for r in range(batch.num_rows):
                sequence, number, n, data = (batch.column(c)[r].as_py() for c in ("sequence", "tile", "n", "data"))
                whole = np.frombuffer(data, np.float64).reshape(n, -1)
                new = _Partial(whole[:, 1], whole[:, 2], whole[:, 3:])
                if here is not None and here != (sequence, number):
                    yield done()
                    state = None
                here, places = (sequence, number), whole[:, 0].copy().view(np.int64)
                state = new if state is None else state.merge(new)
        if here is not None:
            yield done()

    cell = ("sequence", "block", "share")
    shares = dealt(packed, last, causal, tiles).repartition(*cell).sortWithinPartitions(*cell, "part", "tile").mapInArrow(partials, _PACKED.format(kind=kind))
    return shares.repartition("sequence", "tile").sortWithinPartitions("sequence", "tile").mapInArrow(merged, f"sequence {kind}, position long, out array<double>")
