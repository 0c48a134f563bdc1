"""Tensors as tables of dense blocks: a row holds a block's place on each axis and its numbers, products are NumPy's."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce as fold
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Output blocks that a task adds up before they are sent on.
HELD = 64


@dataclass
class BlockTensor:
    """``frame``: a long column an axis (the block's number) and ``data``; blocks that are all zero may be missing.

    ``sides`` are the block's lengths on the axes, ``lengths`` those of the tensor; what lies beyond them in the last blocks is zero.
    """

    frame: DataFrame
    sides: dict[str, int]
    lengths: dict[str, int]

    def cells(self) -> DataFrame:
        """A column an axis, and ``value``, of every cell."""
        axes, sides, lengths = list(self.sides), list(self.sides.values()), list(self.lengths.values())

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    at = [batch.column(a)[r].as_py() * s for a, s in zip(axes, sides, strict=True)]
                    block = np.frombuffer(batch.column("data")[r].as_py(), np.float64).reshape(sides)
                    block = block[tuple(slice(0, n - i) for n, i in zip(lengths, at, strict=True))]
                    where = np.unravel_index(np.arange(block.size), block.shape) if axes else ()
                    yield pa.RecordBatch.from_arrays([*[pa.array(w + i) for w, i in zip(where, at, strict=True)], pa.array(block.ravel())], [*axes, "value"])

        return self.frame.select(*axes, "data").mapInArrow(split, ", ".join([*(f"{a} long" for a in axes), "value double"]))


def _filled(batches: Iterator[pa.RecordBatch], axes: list[str], sides: list[int]) -> Iterator[pa.RecordBatch]:
    """Blocks from rows sorted by block: indices inside it and values."""
    here, block = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([i]) for i in here], pa.array([block.tobytes()], pa.binary())], [*axes, "data"])

    for batch in batches:
        keys = np.column_stack([batch.column(a).to_numpy() for a in axes])
        inner = [batch.column(f"_{a}").to_numpy() for a in axes]
        values = batch.column("value").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low == high:
                continue
            key = tuple(keys[low].tolist())
            if key != here:
                if here is not None:
                    yield row()
                here, block = key, np.zeros(sides)
            np.add.at(block, tuple(i[low:high] for i in inner), values[low:high])
    if here is not None:
        yield row()


def from_cells(cells: DataFrame, side: int | dict[str, int] = 64) -> BlockTensor:
    """Of a table with a column an axis (0-based) and ``value``; cells that are there twice are added, others are zero."""
    axes = [c for c in cells.columns if c != "value"]
    found = cells.agg(*[F.max(a).alias(a) for a in axes]).first()
    lengths = {a: int(found[a]) + 1 if found[a] is not None else 0 for a in axes}
    sides = {a: side if isinstance(side, int) else side[a] for a in axes}
    cut = cells.select(*[F.floor(F.col(a) / sides[a]).cast("long").alias(a) for a in axes], *[(F.col(a) % sides[a]).cast("long").alias(f"_{a}") for a in axes], F.col("value").cast("double").alias("value"))
    frame = cut.repartition(*axes).sortWithinPartitions(*axes).mapInArrow(lambda it: _filled(it, axes, list(sides.values())), ", ".join(f"{a} long" for a in axes) + ", data binary")
    return BlockTensor(frame, sides, lengths)


def from_vectors(rows: DataFrame, key: str, vector: str, side: int = 256) -> BlockTensor:
    """Of arrays of one length, ``key`` being their place: axes ``n`` and ``d``; vectors aren't taken apart."""
    found = rows.agg(F.max(key).alias("n"), F.max(F.size(vector)).alias("d")).first()
    lengths = {"n": int(found["n"]) + 1 if found["n"] is not None else 0, "d": max(found["d"] or 0, 1)}
    width = lengths["d"]

    def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, block = None, None
        for batch in batches:
            places = batch.column("place").to_numpy()
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(places), -1) if len(places) else np.empty((0, width))
            cuts = [0, *(np.flatnonzero(np.diff(places // side)) + 1).tolist(), len(places)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if here != int(places[low] // side):
                    if here is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([here]), pa.array([0]), pa.array([block.tobytes()], pa.binary())], ["n", "d", "data"])
                    here, block = int(places[low] // side), np.zeros((side, width))
                block[places[low:high] % side] = vectors[low:high]
        if here is not None:
            yield pa.RecordBatch.from_arrays([pa.array([here]), pa.array([0]), pa.array([block.tobytes()], pa.binary())], ["n", "d", "data"])

    cut = rows.where(F.size(vector) == width).select(F.col(key).cast("long").alias("place"), F.col(vector).cast("array<double>").alias("vector"), F.floor(F.col(key) / side).alias("_block"))
    frame = cut.repartition("_block").sortWithinPartitions("_block", "place").select("place", "vector").mapInArrow(stacked, "n long, d long, data binary")
    return BlockTensor(frame, {"n": side, "d": width}, lengths)


def _product(a: BlockTensor, b: BlockTensor, kept: list[str]) -> BlockTensor:
    """The sum of products over all axes but ``kept``, which one of the two has each."""
    sides, lengths = a.sides | b.sides, a.lengths | b.lengths
    shared = [x for x in a.sides if x in b.sides]
    if wrong := [x for x in shared if a.lengths[x] != b.lengths[x] or a.sides[x] != b.sides[x]]:
        raise ValueError(f"operands differ in {wrong}")
    left, right = a.frame.withColumnRenamed("data", "_left"), b.frame.withColumnRenamed("data", "_right")
    if shared:
        pairs = left.join(right, shared)
    else:  # an outer product: each block of the second meets each row of blocks of the first
        axis = next(iter(a.sides))
        rows = -(-lengths[axis] // sides[axis])
        pairs = left.join(right.withColumn(axis, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long")))), axis)
    letters = {x: chr(97 + i) for i, x in enumerate(sides)}
    spell = lambda axes: "".join(letters[x] for x in axes)
    pattern = f"{spell(a.sides)},{spell(b.sides)}->{spell(kept)}"
    shape, left_shape, right_shape = [sides[x] for x in kept], list(a.sides.values()), list(b.sides.values())
    schema = ", ".join([*(f"{x} long" for x in kept), "data binary"])

    def rows_of(found: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in found], pa.int64()) for i in range(len(kept))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([v.tobytes() for v in found.values()], pa.binary())], [*kept, "data"])

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[r].as_py(), np.float64).reshape(s) for c, s in (("_left", left_shape), ("_right", right_shape)))
                key = tuple(batch.column(k)[r].as_py() for k in kept)
                part = np.einsum(pattern, x, y, optimize=True)
                found[key] = found[key] + part if key in found else part
                if len(found) >= HELD:
                    yield rows_of(found)
                    found = {}
        if found:
            yield rows_of(found)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, total = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                key = tuple(batch.column(k)[r].as_py() for k in kept)
                part = np.frombuffer(batch.column("data")[r].as_py(), np.float64).reshape(shape)
                if here is not None and key != here:
                    yield rows_of({here: total})
                    total = None
                here, total = key, part if total is None else total + part
        if here is not None:
            yield rows_of({here: total})

    parts = pairs.select(*[F.col(k) for k in kept], "_left", "_right").mapInArrow(multiplied, schema)
    parts = parts.repartition(*kept).sortWithinPartitions(*kept) if kept else parts.coalesce(1)
    return BlockTensor(parts.mapInArrow(added, schema), {k: sides[k] for k in kept}, {k: lengths[k] for k in kept})


def einsum(pattern: str, *tensors: BlockTensor) -> BlockTensor:
    """``i k, k j -> i j`` over blocks; operands need not share an axis. Products are added up in a task before they are shuffled.

    An axis that is named twice in one operand isn't read.
    """
    left, _, right = pattern.partition("->")
    inputs, output = [side.split() for side in left.split(",")], right.split()
    if len(inputs) != len(tensors) or any(len(set(names)) < len(names) for names in (*inputs, output)):
        raise ValueError(f"can't read {pattern!r} for {len(tensors)} tensors")
    named = []
    for tensor, names in zip(tensors, inputs, strict=True):
        if len(names) != len(tensor.sides):
            raise ValueError(f"{len(names)} names for the axes {list(tensor.sides)}")
        frame = tensor.frame.select(*[F.col(a).alias(n) for a, n in zip(tensor.sides, names, strict=True)], "data")
        named.append(BlockTensor(frame, dict(zip(names, tensor.sides.values(), strict=True)), dict(zip(names, tensor.lengths.values(), strict=True))))
    if unknown := [x for x in output if not any(x in t.sides for t in named)]:
        raise ValueError(f"no operand has {unknown}")

    def step(done: tuple[BlockTensor, int], other: BlockTensor) -> tuple[BlockTensor, int]:
        tensor, at = done
        later = {x for t in named[at + 1 :] for x in t.sides} | set(output)
        every = list(dict.fromkeys([*tensor.sides, *other.sides]))
        kept = [x for x in output if x in every] + [x for x in every if x in later and x not in output]
        return _product(tensor, other, kept), at + 1

    if len(named) == 1:
        one = BlockTensor(named[0].frame.sparkSession.createDataFrame([(0, bytearray(np.ones(1).tobytes()))], "_one long, data binary"), {"_one": 1}, {"_one": 1})
        return _product(named[0], one, output)
    return fold(step, named[1:], (named[0], 1))[0]


def size(tensor: BlockTensor) -> int:
    """Cells, zeros included."""
    return prod(tensor.lengths.values())
