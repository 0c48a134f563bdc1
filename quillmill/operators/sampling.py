"""Samples, balanced classes, batches and shuffles, deterministic by hash order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.operators.skew import small
from quillmill.session import cut_lineage


def shuffle_key(key: str, seed: int = 42) -> Column:
    """The same order in every engine: MD5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def sample_rows(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """A uniform sample of exactly ``k`` rows (all, if fewer): the least shuffle keys."""
    return df.orderBy(shuffle_key(key, seed), key).limit(k)


def _least(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k rows of least ``_order``; never more than k and a batch are held."""
    held: pa.Table | None = None
    for batch in batches:
        whole = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if whole.num_rows > k:
            order = whole.column("_order").to_numpy()
            whole = whole.take(pa.array(np.argpartition(order, k - 1)[:k] if k else np.empty(0, np.int64)))
        held = whole.combine_chunks()
    if held is not None:
        yield from held.to_batches()


def merged_reservoirs(held: DataFrame, k: int, fan: int = 16) -> DataFrame:
    """One reservoir of many: rows with ``_order`` are reduced to k a partition, ``fan`` partitions meet in one, and so on."""
    schema, n = held.schema, held.rdd.getNumPartitions()
    held = held.mapInArrow(lambda it: _least(it, k), schema)
    while n > 1:
        n = -(-n // fan)
        held = held.repartition(n).mapInArrow(lambda it: _least(it, k), schema)
    return held


def reservoir(df: DataFrame, key: str, k: int, weight: Column | None = None, seed: int = 42) -> DataFrame:
    """A sample of k rows without replacement, each drawn by its weight, with the ``_order`` that decided it.

    One pass: every row draws an exponential of its weight, from a hash of its key, and the k least stay. Reservoirs
    merge, so partitions keep k rows each and are merged as a tree; no table is sorted. Rows whose weight is null, zero or
    less are never drawn.
    """
    bits = F.conv(F.substring(shuffle_key(key, seed), 1, 13), 16, 10).cast("double")
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.withColumn("_order", F.when(w > 0, -F.log((bits + 0.5) / float(1 << 52)) / w)).where(F.col("_order").isNotNull())
    return merged_reservoirs(rows, k)


def reservoir_sink(path: str, key: str, k: int, weight: Column | None = None, seed: int = 42) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the reservoir of all batches so far, each batch's in a folder of its own.

    A batch that runs again starts from the one before it, so it comes to the same; read the highest with ``read_reservoir``.
    """

    def sink(batch: DataFrame, number: int) -> None:
        new = reservoir(batch, key, k, weight, seed)
        old = read_reservoir(batch.sparkSession, path, number)
        whole = new if old is None else merged_reservoirs(new.unionByName(old), k)
        whole.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def read_reservoir(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The reservoir after the last batch (before a number), or none if there was no batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(folder)] if store.exists(folder) else []
    done = [n for n in (int(x.removeprefix("batch=")) for x in names if x.startswith("batch=")) if before is None or n < before]
    return spark.read.parquet(f"{path}/batch={max(done)}") if done else None


def balanced(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of every class as the smallest has.

    Each class keeps the rows under a hash quantile that surely holds enough, so only about the
    final number of rows is ranked, whatever a class's size.
    """
    counts = small(df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n")))
    least = counts.agg(F.min("_n").alias("_least"))
    spot = F.conv(F.substring(shuffle_key(key, seed), 1, 8), 16, 10).cast("long") / float(1 << 32)
    near = df.join(counts, label).join(F.broadcast(least)).where(spot <= (F.col("_least") + 6 * F.sqrt("_least") + 32) / F.col("_n"))
    order = Window.partitionBy(label).orderBy(shuffle_key(key, seed), key)
    return near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col("_least")).drop("_r", "_n", "_least")


def row_numbers(df: DataFrame, *order: str, name: str = "row_number") -> DataFrame:
    """Adds 0-based numbers in a global order without sending all rows to one task.

    Rows are range-partitioned and sorted; a partition's rows are numbered on from the totals
    of the partitions before it. The partitioning is written down first, as numbers depend on it.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    totals = dealt.groupBy("_p").agg(F.count("*").alias("_t"))
    past = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_p", F.coalesce(F.sum("_t").over(past), F.lit(0)).alias("_s"))
    within = Window.partitionBy("_p").orderBy(*order)
    return dealt.join(F.broadcast(starts), "_p").withColumn(name, (F.col("_s") + F.row_number().over(within) - 1).cast("long")).drop("_p", "_s")


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds ``batch`` (from 0) over consecutive rows, the last one short."""
    return row_numbers(df, order, name="_i").withColumn("batch", F.floor(F.col("_i") / size).cast("long")).drop("_i")
