"""Files of plain bytes as a sink: ``df.write.format("rawfiles")`` takes rows ``file, data`` and appends each row to its file.

A file has to be whole in one partition, its rows in order: ``repartition("file").sortWithinPartitions("file", ...)``. Files are
written under hidden names and given their own once all tasks are through; a task that is run again leaves nothing behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quillmill.sources.warc import _opened


@dataclass
class Files(WriterCommitMessage):
    #: hidden name by final name
    names: dict[str, str] = field(default_factory=dict)


class RawWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        store, path = _opened(self.path)
        store.create_dir(path, recursive=True)
        done, name, out = Files(), None, None
        for batch in iterator:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if file != name:
                    if out:
                        out.close()
                    if file in done.names:
                        raise ValueError(f"the rows of {file} aren't together")
                    name, done.names[file] = file, f"_{uuid.uuid4().hex}-{file}"
                    out = store.open_output_stream(f"{path}/{done.names[file]}", compression=None)
                out.write(data)
        if out:
            out.close()
        return done

    def commit(self, messages) -> None:
        store, path = _opened(self.path)
        found = [(file, hidden) for m in messages if m for file, hidden in m.names.items()]
        if len({file for file, _ in found}) < len(found):
            raise ValueError("the rows of a file are in several partitions")
        if self.overwrite and store.get_file_info(path).type == pa.fs.FileType.Directory:
            hidden = {h for _, h in found}
            for old in store.get_file_info(pa.fs.FileSelector(path)):
                if old.is_file and old.base_name not in hidden:
                    store.delete_file(old.path)
        for file, hidden in found:
            store.move(f"{path}/{hidden}", f"{path}/{file}")

    def abort(self, messages) -> None:
        store, path = _opened(self.path)
        for message in messages:
            for hidden in message.names.values() if message else ():
                store.delete_file(f"{path}/{hidden}")


class RawFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawfiles"

    def schema(self) -> str:
        return "file string, data binary"

    def writer(self, schema, overwrite: bool) -> RawWriter:
        return RawWriter(self.options, overwrite)


def write_files(rows: DataFrame, path: str, *order: str) -> None:
    """Files of ``file, data`` rows, each file's rows by ``order``."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(RawFiles)
    rows.repartition("file").sortWithinPartitions("file", *order).select("file", "data").write.format("rawfiles").mode("overwrite").save(path)
