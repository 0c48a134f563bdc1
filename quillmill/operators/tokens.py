"""Token streams: end-of-document marks, global positions, context windows, packed and padded sequences."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.session import cut_lineage

END = 50256


def with_end(ids: Column, end: int = END) -> Column:
    return F.concat(ids, F.array(F.lit(end)))


def in_order(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Range-partitioned and sorted by key. Before texts are encoded this costs a second look at the keys; afterwards it would
    encode twice, as the ranges come from a sample."""
    return docs.repartitionByRange(key).sortWithinPartitions(key)


def token_stream(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", ordered: bool = False) -> DataFrame:
    """``key, start, ids``: where each document's tokens start in the stream ordered by key, of any orderable type.

    Documents are written once, in order (``ordered``: they are ``in_order`` as they come), with their place inside their
    partition. Starts are these on top of the totals of the partitions before, so no task sees more than a partition, and
    nothing is joined back.
    """
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind, of = rows.schema["key"].dataType.simpleString(), rows.schema["ids"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = np.nan_to_num(pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False)).astype(np.int64)
            ends = at + np.cumsum(sizes)
            if len(ends):
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ends - sizes), batch.column("ids"), pa.array(np.full(len(ends), part))], ["key", "inside", "ids", "part"])
                at = int(ends[-1])

    placed = cut_lineage((rows if ordered else in_order(rows, "key")).mapInArrow(place, f"key {kind}, inside long, ids {of}, part long"))
    totals = placed.groupBy("part").agg(F.sum(F.greatest(F.size("ids"), F.lit(0)).cast("long")).alias("n")).orderBy("part").collect()
    before = list(zip([r["part"] for r in totals], accumulate([0, *(r["n"] for r in totals)]), strict=False))
    past = F.broadcast(encoded.sparkSession.createDataFrame(before, "part long, past long"))  # a row a partition
    return placed.join(past, "part").select(F.col("key").alias(key), (F.col("past") + F.col("inside")).alias("start"), F.col("ids").alias(ids))


def flat_tokens(stream: DataFrame, ids: str = "ids") -> DataFrame:
    """``pos, token``."""
    return stream.select("start", F.posexplode(ids).alias("i", "token")).select((F.col("start") + F.col("i")).alias("pos"), "token")


def packed_sequences(stream: DataFrame, length: int, ids: str = "ids") -> DataFrame:
    """``sequence_id, input_ids, labels``: the whole stream in windows, labels one to the right; a short tail is dropped.

    Documents are cut where windows end, so a window collects a few slices, not single tokens: its own and the one
    token that follows, which the last label needs.
    """
    first = F.greatest(F.floor((F.col("start") - 1) / length), F.lit(0))
    last = F.floor((F.col("start") + F.size(ids) - 1) / length)
    cut = stream.where(F.size(ids) > 0).select("start", ids, F.explode(F.sequence(first, last)).alias("sequence_id"))
    low = F.greatest(F.col("sequence_id") * length - F.col("start"), F.lit(0)).cast("int")
    high = F.least((F.col("sequence_id") + 1) * length + 1 - F.col("start"), F.size(ids).cast("long")).cast("int")
    parts = cut.select("sequence_id", (F.col("start") + low).alias("at"), F.slice(ids, low + 1, high - low).alias("part"))
    whole = parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])).alias("x"))
    whole = whole.where(F.size("x") == length + 1)
    return whole.select("sequence_id", F.slice("x", 1, length).alias("input_ids"), F.slice("x", 2, length).alias("labels"))


def random_windows(blocks: DataFrame, length: int, count: int, seed: int = 42) -> DataFrame:
    """``window, start, x, y``: ``count`` windows at random places of the whole stream, y one to the right of x.

    ``blocks``: what ``write_token_blocks`` has written. Starts are drawn from [0, n - length) by hash. A window is cut at
    the blocks it touches and meets these by number; folders that no window touches aren't read, and of a block that is, only
    the window's bytes go on. Windows run over the ends of documents and files. A stream of ``length`` tokens or fewer has none.
    """
    found = blocks.agg(F.sum("n").cast("long").alias("n"), F.max("n").cast("long").alias("size"), F.min(F.octet_length("data") / F.col("n")).cast("int").alias("width")).first()
    spark = blocks.sparkSession
    if not found["n"] or found["n"] <= length:
        return spark.createDataFrame([], "window long, start long, x array<int>, y array<int>")
    size, width = found["size"], found["width"]
    files = blocks.where(f"n = {size}").groupBy("file").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0]
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long")
    starts = spark.range(count).select(F.col("id").alias("window"), F.pmod(drawn, F.lit(found["n"] - length)).alias("start"))
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + length) / size)
    touched = starts.select("window", "start", F.explode(F.sequence(first, last)).alias("block"))
    touched = touched.withColumn("file", F.floor(F.col("block") / files).cast(blocks.schema["file"].dataType)).where("file >= 0")
    low = F.greatest(F.col("start") - F.col("block") * size, F.lit(0)).cast("int")
    high = F.least(F.col("start") + length + 1 - F.col("block") * size, F.lit(size)).cast("int")
    parts = touched.join(blocks, ["file", "block"]).select("window", "start", "block", F.substring("data", low * width + 1, (high - low) * width).alias("part"))
    whole = parts.groupBy("window", "start").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("parts"))
    whole = whole.select("window", "start", F.aggregate("parts", F.lit(b""), lambda out, p: F.concat(out, p["part"])).alias("data"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(data, f"<u{width}").astype(np.int32) for data in batch.column("data").to_pylist()]
            arrays = [pa.array(x, pa.list_(pa.int32())) for x in ([i[:-1] for i in ids], [i[1:] for i in ids])]
            yield pa.RecordBatch.from_arrays([batch.column("window"), batch.column("start"), *arrays], ["window", "start", "x", "y"])

    return whole.mapInArrow(read, "window long, start long, x array<int>, y array<int>")


def context_windows(ids: Column, start: Column, length: int) -> Column:
    """x and y = x one to the right, from a 0-based start."""
    return F.struct(F.slice(ids, start + 1, length).alias("x"), F.slice(ids, start + 2, length).alias("y"))


def random_start(key: Column, n: Column, length: int, seed: int = 42) -> Column:
    """A start in [0, n - length), by hash."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long"), n - length).cast("int")


def prompt_and_output(prompt: Column, output: Column, width: Column, pad: int) -> Column:
    """input_ids, labels and response_mask of prompt + output, padded to ``width`` and shifted by one."""
    whole = F.concat(prompt, output)
    padded = F.concat(whole, F.array_repeat(F.lit(pad), F.greatest(width - F.size(whole), F.lit(0)).cast("int")))
    before = F.greatest(F.size(prompt) - 1, F.lit(0))
    of = F.greatest(F.size(whole) - 1 - before, F.lit(0))
    after = F.greatest(width - 1 - before - of, F.lit(0))
    mask = F.slice(F.concat(*[F.array_repeat(F.lit(v), n.cast("int")) for v, n in ((0, before), (1, of), (0, after))]), 1, width - 1)
    return F.struct(F.slice(padded, 1, width - 1).alias("input_ids"), F.slice(padded, 2, width - 1).alias("labels"), mask.alias("response_mask"))


def compression(encoded: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
    """One row: documents, bytes, tokens and bytes a token."""
    return encoded.agg(F.count("*").alias("n_docs"), F.sum(F.octet_length(text)).cast("long").alias("n_bytes"), F.sum(F.size(ids)).cast("long").alias("n_tokens")).withColumn(
        "ratio", F.try_divide("n_bytes", "n_tokens")
    )
