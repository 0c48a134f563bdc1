"""Tensors as tables: a column an axis (0-based indices) and ``value``; contraction is a join, reduction a group."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GROUP = re.compile(r"\(([^()]*)\)|([A-Za-z_]\w*)|(1)")
REDUCTIONS = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "prod": F.product, "any": lambda c: F.max((c != 0).cast("double")), "all": lambda c: F.min((c != 0).cast("double"))}


def parse_axes(side: str) -> list[list[str]]:
    """Axes of one side of a pattern, each a list of the names it is made of; ``1`` is an axis of length one."""
    if _GROUP.sub("", side).strip():
        raise ValueError(f"can't read the axes {side!r}")
    return [m[1].split() if m[1] is not None else [m[2]] if m[2] else [] for m in _GROUP.finditer(side)]


def parse_shape(pattern: str, lengths: tuple[int, ...]) -> dict[str, int]:
    """Length of each named axis; an underscore skips one."""
    names = pattern.split()
    if len(names) != len(lengths):
        raise ValueError(f"{len(names)} names for {len(lengths)} axes")
    return {n: length for n, length in zip(names, lengths, strict=True) if n != "_"}


def vectors_as_tensor(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, axis, value`` of an array column."""
    return rows.select(key, F.posexplode(vector).alias("axis", "value")).withColumn("value", F.col("value").cast("double"))


def _named(tensor: DataFrame, names: list[str]) -> DataFrame:
    axes = [c for c in tensor.columns if c != "value"]
    if len(axes) != len(names):
        raise ValueError(f"{len(names)} names for the axes {axes}")
    return tensor.select(*[F.col(a).alias(n) for a, n in zip(axes, names, strict=True)], "value")


def einsum(pattern: str, *tensors: DataFrame) -> DataFrame:
    """Sum of products over the axes that ``i k, k j -> i j`` doesn't name on its right; equal names are joined."""
    left, _, right = pattern.partition("->")
    inputs, output = [side.split() for side in left.split(",")], right.split()
    if len(inputs) != len(tensors):
        raise ValueError(f"{len(inputs)} operands for {len(tensors)} tensors")
    parts = [_named(t, names) for t, names in zip(tensors, inputs, strict=True)]

    def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in a.columns if c in b.columns and c != "value"]
        if not shared:
            raise ValueError("operands have to share an axis with those before them")
        return a.withColumnRenamed("value", "_a").join(b.withColumnRenamed("value", "_b"), shared).withColumn("value", F.col("_a") * F.col("_b")).drop("_a", "_b")

    return fold(multiply, parts).groupBy(*output).agg(F.sum("value").alias("value"))


def _flat(names: list[str], sizes: dict[str, int]) -> Column:
    """Index of a composed axis, the last name running fastest."""
    at: Column = F.lit(0).cast("long")
    for n in names:
        at = at * (sizes[n] if n in sizes else 1) + F.col(n)
    return at


def rearrange(tensor: DataFrame, pattern: str, how: str | Callable[[Column], Column] | None = None, **sizes: int) -> DataFrame:
    """Axes split, merged, reordered, reduced (``how``: a name or an aggregate of a column) or repeated as ``b (h w) -> w b`` says.

    Sizes are needed of the names inside a composed axis but the first, and of axes that are new on the right. The
    result's axes are called axis0, axis1 and so on.
    """
    left, _, right = pattern.partition("->")
    before, after = parse_axes(left), parse_axes(right)
    given, wanted = [n for axis in before for n in axis], [n for axis in after for n in axis]
    if len(set(given)) < len(given) or len(set(wanted)) < len(wanted):
        raise ValueError("a name stands twice on one side")
    if missing := [n for axes in (before, after) for axis in axes for n in axis[1:] if n not in sizes] + [n for n in wanted if n not in given and n not in sizes]:
        raise ValueError(f"sizes of {missing} are missing")
    here = _named(tensor, [f"_{i}" for i in range(len(before))])
    for i, axis in enumerate(before):
        rest = 1
        for n in reversed(axis):
            at = F.floor(F.col(f"_{i}") / rest) if rest > 1 else F.col(f"_{i}")
            here = here.withColumn(n, (at if n == axis[0] else at % sizes[n]).cast("long"))
            rest *= sizes.get(n, 1)
    kept = [n for n in wanted if n in given]
    if set(given) - set(wanted):
        if how is None:
            raise ValueError(f"no reduction is named for {sorted(set(given) - set(wanted))}")
        here = here.groupBy(*kept).agg((REDUCTIONS[how] if isinstance(how, str) else how)(F.col("value")).alias("value"))
    for n in wanted:
        if n not in given:
            here = here.withColumn(n, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sizes[n] - 1).cast("long"))))
    return here.select(*[_flat(axis, sizes).alias(f"axis{i}") for i, axis in enumerate(after)], "value")
