"""Where queries and their SQL are written down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmill.session import load

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries by name; ``tables`` are read and handed over in order."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, *tables: str, sql: str | None = None):
        def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.queries[name] = lambda spark, sf_dir: f(*[load(spark, sf_dir, t) for t in tables]) if tables else f(spark, sf_dir)
            if sql:
                self.oracles[name] = sql
            return f

        return register
