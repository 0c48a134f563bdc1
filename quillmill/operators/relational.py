"""Relational extras: as-of and range joins by bucketed equi-joins, and small helpers over star schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, on: str, value: str) -> DataFrame:
    """Each left row with the last right ``value`` of its ``by`` at or before ``on``.

    One union sorted within ``by``: no row is paired with more than its predecessor.
    """
    row = F.struct(*left.columns)
    kind = left.select(row.alias("s")).schema["s"].dataType
    both = left.select(by, on, row.alias("_l"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side")).unionByName(
        right.select(by, on, F.lit(None).cast(kind).alias("_l"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    )
    w = Window.partitionBy(by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("_l.*", F.col("_last").alias(f"asof_{value}"))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points inside [low, high), by an equi-join on cells of ``width``; a range visits the cells it covers."""
    p = points.withColumn("_cell", F.floor(F.col(point) / width))
    r = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "_cell").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_cell")
