"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from civiclake.session import Tables


class Suite:
    """Collects query functions of the form ``Tables -> DataFrame``."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None):
        def add(fn: Callable[[Tables], DataFrame]):
            if name in self.queries:
                raise ValueError(f"query {name} is defined twice")
            self.queries[name] = lambda spark, folder: fn(Tables(spark, folder))
            if oracle:
                self.oracles[name] = oracle
            return fn

        return add
