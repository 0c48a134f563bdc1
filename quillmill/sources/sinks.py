"""Writers: JSON lines, labelled lines, ordered token files, evaluation records."""

from __future__ import annotations

import io
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.text import fasttext_line
from quillmill.operators.dedup import drop_duplicates_of
from quillmill.operators.quality import REASONS
from quillmill.sources.rawfiles import write_files


def write_jsonl(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_fasttext(df: DataFrame, label: Column, text: Column, path: str) -> None:
    df.select(fasttext_line(label, text).alias("value")).write.mode("overwrite").text(path)


def rewrite_without(df: DataFrame, ids: DataFrame, key: str, path: str) -> DataFrame:
    """Write the rows whose key isn't among ``ids``; one row (kept, removed), counted by the pass that writes."""
    counts = Observation()
    gone = F.col("_gone").isNotNull()
    marked = df.join(ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_gone", F.lit(True)), key, "left")
    marked = marked.observe(counts, F.count_if(~gone).alias("kept"), F.count_if(gone).alias("removed"))
    write_jsonl(marked.where(~gone).drop("_gone"), path)
    found = counts.get
    return df.sparkSession.createDataFrame([(found["kept"], found["removed"])], "kept long, removed long")


def write_kept(cascaded: DataFrame, path: str) -> DataFrame:
    """Write the rows that pass a cascade; ``reason, n, pct`` of all rows, counted by the same pass."""
    counts = Observation()
    seen = cascaded.observe(
        counts, F.count("*").alias("total"), F.count_if(F.col("discard_reason").isNull()).alias("kept"), *[F.count_if(F.col("discard_reason") == r).alias(r) for r in REASONS]
    )
    write_jsonl(seen.where(F.col("discard_reason").isNull()).drop("discard_reason"), path)
    found = counts.get
    rows = [(reason, found[reason], found[reason] / found["total"]) for reason in ("kept", *REASONS) if found[reason]]
    return cascaded.sparkSession.createDataFrame(rows, "reason string, n long, pct double")


#: Tokens of a block, which is a row, and blocks of a file.
BLOCK_TOKENS, FILE_BLOCKS = 1 << 16, 256


def write_token_blocks(stream: DataFrame, path: str, block: int = BLOCK_TOKENS, blocks: int = FILE_BLOCKS, dtype: str = "<u2") -> None:
    """The stream for access by position: rows ``block, n, data`` of ``block`` tokens each (the last one fewer), in folders ``file=``.

    ``stream``: start, ids. A document is cut where blocks end; blocks are put together side by side, none is larger than itself.
    """
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.size("ids") - 1) / block)
    cut = stream.where(F.size("ids") > 0).select("start", "ids", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("block") * block - F.col("start"), F.lit(0)).cast("int")
    high = F.least((F.col("block") + 1) * block - F.col("start"), F.size("ids").cast("long")).cast("int")
    parts = cut.select(F.floor(F.col("block") / blocks).alias("file"), "block", (F.col("start") + low).alias("at"), F.slice("ids", low + 1, high - low).alias("part"))
    most = np.iinfo(dtype).max

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        here = None

        def row() -> pa.RecordBatch:
            ids = np.concatenate(held)
            if len(ids) and (ids.min() < 0 or ids.max() > most):
                raise ValueError(f"an id doesn't fit {dtype}")
            return pa.RecordBatch.from_arrays([pa.array([here[0]]), pa.array([here[1]]), pa.array([len(ids)], pa.int32()), pa.array([ids.astype(dtype).tobytes()], pa.binary())], ["file", "block", "n", "data"])

        for batch in batches:
            ids = batch.column("part")
            ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
            values = ids.flatten().to_numpy(zero_copy_only=False)
            for file, number, low, high in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if here is not None and here != (file, number):
                    yield row()
                    held = []
                here = file, number
                held.append(values[low:high].copy())
        if here is not None:
            yield row()

    rows = parts.repartition("file").sortWithinPartitions("file", "block", "at").select("file", "block", "part").mapInArrow(put_together, "file long, block long, n int, data binary")
    rows.write.mode("overwrite").partitionBy("file").parquet(path)


def export_token_files(spark: SparkSession, path: str, out: str, npy: bool = False, dtype: str = "<u2") -> DataFrame:
    """Each file of blocks as one file that trainers map into memory, headerless or with a NumPy header; executors write them.

    Returns the index ``file, start, n``: where each one's tokens stand in the stream.
    """
    blocks = spark.read.parquet(path)
    name = F.format_string("tokens-%06d." + ("npy" if npy else "bin"), F.col("file").cast("long"))
    index = blocks.groupBy(F.col("file").cast("long").alias("file")).agg(F.sum("n").alias("n"), F.min("block").alias("first"))
    rows = blocks.select(name.alias("file"), "block", "data")
    if npy:
        def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = []
                for n in batch.column("n").to_pylist():
                    header = io.BytesIO()
                    np.lib.format.write_array_header_1_0(header, {"descr": dtype, "fortran_order": False, "shape": (n,)})
                    made.append(header.getvalue())
                yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array([-1] * len(made), pa.int64()), pa.array(made, pa.binary())], ["file", "block", "data"])

        rows = rows.unionByName(index.select(name.alias("file"), "n").mapInArrow(headers, "file string, block long, data binary"))
    write_files(rows, out, "block")
    size = blocks.agg(F.max("n")).first()[0] or 0
    return index.select(name.alias("file"), (F.col("first") * size).alias("start"), "n")


def write_tokens(stream: DataFrame, path: str, tokens_per_file: int = 1 << 24) -> None:
    """Ordered token files as rows of little-endian unsigned 16-bit bytes, a row a chunk of the stream.

    ``stream``: start, ids. Chunks are ranges of positions, so tasks write them side by side and
    reading them in order of ``chunk`` gives the stream.
    """
    first, last = F.floor(F.col("start") / tokens_per_file), F.floor((F.col("start") + F.size("ids") - 1) / tokens_per_file)
    cut = stream.where(F.size("ids") > 0).select("start", "ids", F.explode(F.sequence(first, last)).alias("chunk"))
    low = F.greatest(F.col("chunk") * tokens_per_file - F.col("start"), F.lit(0)).cast("int")
    high = F.least((F.col("chunk") + 1) * tokens_per_file - F.col("start"), F.size("ids").cast("long")).cast("int")
    parts = cut.select("chunk", (F.col("start") + low).alias("at"), F.slice("ids", low + 1, high - low).alias("part"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [np.asarray(x, "<u2").tobytes() for x in b.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("at"), pa.array(data, pa.binary())], ["chunk", "at", "data"])

    parts.repartition("chunk").sortWithinPartitions("chunk", "at").mapInArrow(encode, "chunk long, at long, data binary").write.mode("overwrite").parquet(path)


def read_tokens(spark, path: str) -> Iterator[np.ndarray]:
    """The stream back, piece by piece and in order, without holding it."""
    for row in spark.read.parquet(path).orderBy("chunk", "at").toLocalIterator():
        yield np.frombuffer(row["data"], "<u2")


@contextmanager
def _one_file(spark, path: str):
    """A function that appends bytes to one file, on whatever file system Spark writes to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        yield lambda data: [out.write(bytearray(data[at : at + (1 << 20)])) for at in range(0, len(data), 1 << 20)]
    finally:
        out.close()


def export_token_bin(spark, path: str, out: str) -> int:
    """One headerless file, for trainers that map it into memory; returns the number of tokens.

    One file has one writer: the driver passes the stream on chunk by chunk and holds no more than that.
    """
    n = 0
    with _one_file(spark, out) as write:
        for piece in read_tokens(spark, path):
            write(piece.tobytes())
            n += len(piece)
    return n


def export_npy(spark, path: str, out: str) -> int:
    """The same with a NumPy header, so that readers find type and length."""
    n = spark.read.parquet(path).agg(F.coalesce(F.sum(F.octet_length("data")) / 2, F.lit(0)).cast("long")).first()[0]
    header = io.BytesIO()
    np.lib.format.write_array_header_1_0(header, {"descr": "<u2", "fortran_order": False, "shape": (n,)})
    with _one_file(spark, out) as write:
        write(header.getvalue())
        for piece in read_tokens(spark, path):
            write(piece.tobytes())
    return n


def write_representatives(docs: DataFrame, clustered: DataFrame, path: str) -> None:
    """JSON lines of the documents that stay when each cluster keeps its representative."""
    write_jsonl(drop_duplicates_of(docs, clustered), path)


def write_evaluation(scored: DataFrame, metrics: DataFrame, path: str) -> None:
    """Records and a one-row summary beside them."""
    write_jsonl(scored, f"{path}/records")
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
