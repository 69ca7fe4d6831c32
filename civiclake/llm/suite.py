"""Registry of this folder's queries and their SQL twins."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import lru_cache

from pyspark.sql import SparkSession

import civiclake
from civiclake.plans.suite import Suite


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, as ``--py-files`` would, once per application."""
    _ship(spark.sparkContext.applicationId, spark)


@lru_cache(maxsize=4)
def _ship(application: str, spark: SparkSession) -> None:
    top = os.path.dirname(os.path.abspath(civiclake.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="civiclake-"), "civiclake-files.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)


class ShippedSuite(Suite):
    """Queries whose tasks run functions of this package."""

    def query(self, name: str, oracle: str | None = None):
        add = super().query(name, oracle)

        def decorate(fn):
            def run(tables):
                ship(tables.spark)
                return fn(tables)

            add(run)
            return fn

        return decorate


LLM = ShippedSuite()
