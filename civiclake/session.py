"""Session settings, table loading and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package is happy with. They are defaults for
# sessions made here; a session handed in by the caller is never changed.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "civiclake", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session with the package defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def own_session(spark: SparkSession) -> SparkSession:
    """A session beside the given one, with its options but with views and functions of its own."""
    other = spark.newSession()
    have = other.conf.getAll
    for key, value in spark.conf.getAll.items():
        if have.get(key) != value and other.conf.isModifiable(key):
            other.conf.set(key, value)
    return other


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder on the storage the cluster shares.

    ``spark.checkpoint.dir`` names it. Only a local master without that setting
    (a test on one machine) gets a temporary folder; any other raises an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="civiclake-")
    return f"{base.rstrip('/')}/civiclake-{purpose}-{uuid.uuid4().hex}"


def full_shuffle(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for rows that are small when packed and large once they are grouped.

    A shuffle of a given number of partitions is not put together into fewer by its packed size.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Set session options for one statement and put the old values back."""
    conf = {key.replace("__", "."): value for key, value in conf.items()}
    old = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield spark
    finally:
        for key, value in old.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


class Tables:
    """The Parquet tables of one folder, opened on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._open: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._open:
            self._open[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._open[name]

    def register(self, *names: str) -> SparkSession:
        """Make temp views of the named tables so SQL text can use them."""
        for name in names:
            getattr(self, name).createOrReplaceTempView(name)
        return self.spark
