"""Documents out of a stream of chunks: what is left after the last delimiter waits in state for the next chunk."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Characters of chunks that are joined and split at a time, unless a document is longer.
PIECE = 1 << 20
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Remainders(StatefulProcessor):
    """State for each source: the number of the next chunk, that of the next document, the open text; and chunks that came early."""

    def __init__(self, delimiter: str) -> None:
        if not delimiter:
            raise ValueError("the delimiter may not be empty")
        self.delimiter = delimiter

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "chunk long, document long, rest string")
        self.early = handle.getMapState("early", "chunk long", "text string, last boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunk, document, rest = self.open.get() if self.open.exists() else (0, 0, "")
        for frame in rows:
            for number, text, last in zip(frame["chunk_no"], frame["text"], frame["last"], strict=True):
                if int(number) >= chunk:  # a chunk that is sent again is passed over
                    self.early.updateValue((int(number),), (text if isinstance(text, str) else "", bool(last)))
        parts, size, ended = [rest], 0, False
        while True:
            more = self.early.containsKey((chunk,))
            if more:
                text, last = self.early.getValue((chunk,))
                self.early.removeKey((chunk,))
                parts.append(text)
                size += len(text)
                ended |= last
                chunk += 1
            if not more or size >= max(PIECE, len(rest)):  # a long rest is joined again only once it has doubled
                *whole, rest = "".join(parts).split(self.delimiter)
                if not more and ended and rest:
                    whole.append(rest)
                    rest = ""
                parts, size = [rest], 0
                if whole:
                    yield pd.DataFrame({"source": [key[0]] * len(whole), "document_no": range(document, document + len(whole)), "text": pd.Series(whole, dtype=object)})
                document += len(whole)
            if not more:
                break
        self.open.update((chunk, document, rest))

    def close(self) -> None:
        pass


def documents(chunks: DataFrame, delimiter: str = "<|endoftext|>") -> DataFrame:
    """``source, document_no, text`` from a stream of ``source, chunk_no, text, last``.

    Chunks of a source are numbered from 0 and may be cut anywhere, in the delimiter too. They may arrive in any batch and order;
    one that comes early waits. The text after a source's last delimiter comes with the chunk that is marked last.
    """
    spark = chunks.sparkSession
    spark.conf.set(_PROVIDER, _ROCKS)  # the only store with these states
    kind = chunks.schema["source"].dataType.simpleString()
    return chunks.groupBy("source").transformWithStateInPandas(Remainders(delimiter), f"source {kind}, document_no long, text string", "Append", "None")
