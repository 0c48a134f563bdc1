"""Record splitting as a table function for SQL: ``SELECT ... FROM pages, LATERAL split_records(html, '<p>')``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class SplitRecords:
    """``record_no, start, record`` of a text between delimiters; a null text has none.

    Arguments: the text, a delimiter that is a constant, and ``keep_empty`` (true, as by default, or false).
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, delimiter: AnalyzeArgument, keep_empty: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("the text has to be a string")
        if not delimiter.isConstantExpression or not delimiter.value:
            raise ValueError("the delimiter has to be a constant that isn't empty")
        if keep_empty is not None and not isinstance(keep_empty.value, bool):
            raise ValueError("keep_empty has to be true or false")
        return AnalyzeResult(StructType().add("record_no", IntegerType()).add("start", LongType()).add("record", StringType()))

    def eval(self, text: str | None, delimiter: str, keep_empty: bool = True) -> Iterator[tuple[int, int, str]]:
        start = 0
        for number, record in enumerate(text.split(delimiter) if text is not None else ()):
            if record or keep_empty:
                yield number, start, record
            start += len(record) + len(delimiter)


def register(spark: SparkSession) -> None:
    """Makes the function known to the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("split_records", udtf(SplitRecords))
