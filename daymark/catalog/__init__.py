"""Registered queries: every operator bound to the given tables, with an independent SQL form where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daymark.session import tune

Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that results compare with SQL by value."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


class Registry:
    """Collects (name, query, SQL) in order of registration."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def wrap(fn: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return plain(fn(tune(spark), sf_dir))

            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return fn

        return wrap


registry = Registry()


def load() -> Registry:
    from daymark.catalog import audits, days, models, runs, scalars, segments, users  # noqa: F401

    return registry
