"""Equi-join of a large table with a per-key table when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.session import cut_lineage

#: A key is hot when it holds more than one row in HOT_SHARE of all; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


#: Rows up to which a table is handed to every task.
MOST_BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """The table, written down and counted; marked for broadcast if it is small."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= rows else df


def join_keyed(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (one row a key, ``count`` = rows of that key in ``rows``).

    Hot keys number at most ``HOT_SHARE`` by construction, whatever the input, so their
    part of ``keyed`` is broadcast; every other key holds under a thousandth of the rows
    and goes through an ordinary shuffled join.
    """
    limit = max(1, total // HOT_SHARE)
    values = [c for c in keyed.columns if c not in (key, count)]
    hot = keyed.where(F.col(count) > limit).select(key, *[F.col(c).alias(f"_hot_{c}") for c in values], F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    taken = marked.where(F.col("_hot").isNotNull()).select(*rows.columns, *[F.col(f"_hot_{c}").alias(c) for c in values])
    rest = marked.where(F.col("_hot").isNull()).select(*rows.columns)
    cold = keyed.where(F.col(count) <= limit).drop(count)
    return taken.unionByName(rest.join(cold, key).select(*rows.columns, *values))
