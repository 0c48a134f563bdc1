"""Structured Streaming forms: arriving files through the cascade, watermarked dedup, event windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmill.operators.quality import SCALAR, CascadePreset, discard_reason
from quillmill.session import shared_folder


def arriving(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    """A directory of arriving files as a stream."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", str(files_per_trigger)).load(path)


def cascade_stream(stream: DataFrame, preset: CascadePreset = SCALAR) -> DataFrame:
    """The batch cascade, unchanged: it is row by row."""
    return discard_reason(stream, preset)


def running_funnel(cascaded: DataFrame) -> DataFrame:
    return cascaded.groupBy(F.coalesce("discard_reason", F.lit("kept")).alias("reason")).count()


def exact_dedup_stream(stream: DataFrame, time: str, text: str = "text", delay: str = "1 day") -> DataFrame:
    """First of each text within the watermark; state is bounded by the delay."""
    return stream.withColumn("text_hash", F.md5(text)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["text_hash"])


def tumbling(events: DataFrame, time: str = "ts", width: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; late rows beyond the delay are left out."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, time: str = "ts", user: str = "user_id", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    w = F.session_window(time, gap)
    return events.withWatermark(time, delay).groupBy(w.alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, as a table in the shared folder.

    A batch writes a folder of its own, so one that runs again replaces itself; in complete mode the last one counts.
    """
    spark = stream.sparkSession
    out = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}" if mode == "append" else f"{out}/rows")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(f"{out}/rows" + ("/batch=-1" if mode == "append" else ""))
    return spark.read.schema(stream.schema).parquet(f"{out}/rows").select(*stream.columns)


def for_each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Exactly-once hand-over of micro-batches to an idempotent sink."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
