"""Landed tables as Parquet folders plus a registry that is only ever appended to."""

from __future__ import annotations

import datetime as dt
import hashlib
import logging
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from civiclake.operators.registry import REGISTRY_SCHEMA, refresh_plan
from civiclake.operators.staleness import DEFAULT_DAYS, FREQUENCY_DAYS
from civiclake.operators.typing_repair import repair_numeric
from civiclake.sources.manifest import Manifest

log = logging.getLogger(__name__)

EVENT_SCHEMA = REGISTRY_SCHEMA + ", path string, sequence long, removed boolean"
METADATA_SCHEMA = "dataset_id string, metadata string, cached_at timestamp_ntz, sequence long"


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _newest(events: DataFrame) -> DataFrame:
    """The newest event of each resource."""
    last = events.groupBy("resource_id").agg(F.max_by(F.struct(*events.columns), "sequence").alias("e"))
    return last.select("e.*")


class Store:
    """A folder on shared storage.

    A table is written in full under a new path before the registry learns of it, so
    a load that fails, or loses its executors, leaves the former table in place. The
    registry is a log of events under a versioned manifest, which several writers can extend at the same time; the newest event per
    resource is its current state.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._log = Manifest(spark, f"{self.root}/_registry", EVENT_SCHEMA)
        self._records = Manifest(spark, f"{self.root}/_metadata", METADATA_SCHEMA)

    # --- registry ---------------------------------------------------------------

    def _current(self, resource_id: str | None = None) -> DataFrame:
        events = self._log.read()
        if resource_id is not None:  # before grouping, so that the scan does it
            events = events.where(F.col("resource_id") == resource_id)
        return _newest(events).where(~F.col("removed"))

    def registry(self) -> DataFrame:
        return self._current().drop("path", "sequence", "removed")

    def _append(self, event: tuple, check: Callable[[DataFrame], None] | None = None) -> None:
        self._log.add(self.spark.createDataFrame([event], EVENT_SCHEMA).coalesce(1), check)

    def _row(self, resource_id: str) -> Row | None:
        return self._current(resource_id).first()

    def free_name(self, table_name: str, resource_id: str) -> str:
        """The table name, with twelve digits of the id's hash behind it where another resource has the name."""
        other = self._current().where((F.col("table_name") == table_name) & (F.col("resource_id") != resource_id))
        if other.isEmpty():
            return table_name
        return f"{table_name}_{hashlib.sha256(resource_id.encode()).hexdigest()[:12]}"

    # --- tables -----------------------------------------------------------------

    def land(
        self,
        df: DataFrame,
        resource_id: str,
        dataset_id: str,
        table_name: str,
        source_url: str = "",
        update_frequency: str | None = None,
        now: dt.datetime | None = None,
        repair: bool = True,
        keep_for: dt.timedelta | None = None,
    ) -> str:
        """Store (or replace) the table of one resource; returns its path.

        A table name belongs to one resource: a second one under it is refused. ``keep_for`` is the
        time to expiry where ``update_frequency`` is not known.
        """
        now = now or utc_now()

        def free(events: DataFrame) -> None:
            other = _newest(events).where(~F.col("removed") & (F.col("table_name") == table_name) & (F.col("resource_id") != resource_id)).first()
            if other is not None:
                raise ValueError(f"table name {table_name!r} holds resource {other['resource_id']!r}; land {resource_id!r} under another name")

        free(self._log.read())
        path = f"{self.root}/tables/{table_name}/{uuid.uuid4().hex}"
        (repair_numeric(df) if repair else df).write.parquet(path)
        files = self.spark.read.parquet(path).groupBy("_metadata.file_path").agg(
            F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("size"))
        n, size = files.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
        word = (update_frequency or "").lower().strip()
        expires = now + (keep_for or dt.timedelta(days=FREQUENCY_DAYS.get(word, DEFAULT_DAYS)))
        self._append((resource_id, dataset_id, table_name, now, n, size, source_url, expires, path, time.time_ns(), False), free)
        return path

    def table(self, resource_id: str) -> DataFrame:
        row = self._row(resource_id)
        if row is None:
            raise KeyError(f"Resource {resource_id} is not landed; land it first.")
        return self.spark.read.parquet(row["path"])

    def register_views(self, sql: str | None = None, session: SparkSession | None = None) -> list[str]:
        """A temp view per landed table (that the statement mentions), so that SQL can name it; in the given session or the store's own."""
        current = self._current()
        if sql is not None:
            current = current.where(F.contains(F.lit(sql), F.col("table_name")))
        rows = current.select("table_name", "path").collect()
        for row in rows:
            (session or self.spark).read.parquet(row["path"]).createOrReplaceTempView("`" + row["table_name"].replace("`", "``") + "`")
        return [row["table_name"] for row in rows]

    def remove(self, resource_id: str) -> bool:
        row = self._row(resource_id)
        if row is None:
            return False
        self._append(tuple(row[c] for c in row.__fields__[:-2]) + (time.time_ns(), True))
        self.spark.catalog.dropTempView(row["table_name"])
        return True

    def remove_all(self) -> int:
        """Remove every table: one event each, written where the rows are."""
        events = self._current().withColumns({"sequence": F.lit(time.time_ns()), "removed": F.lit(True)})
        n = events.count()
        if n:
            self._log.add(events)
        return n

    def vacuum(self) -> int:
        """Delete the folders of replaced and removed tables; returns how many."""
        events = self._log.read()
        old = events.select("path").distinct().join(self._current().select("path"), "path", "left_anti")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        deleted = 0
        for row in old.toLocalIterator():
            folder = jvm.org.apache.hadoop.fs.Path(row["path"])
            deleted += bool(folder.getFileSystem(conf).delete(folder, True))
        return deleted

    def refresh(
        self, load: Callable[[Row], DataFrame], now: dt.datetime | None = None, resource_id: str | None = None, everything: bool = False,
        at_once: int = 4,
    ) -> DataFrame:
        """Load stale tables (or the one named, or ``everything``) again, ``at_once`` side by side; one failure does not stop the rest.

        Each keeps the time between download and expiry that it was landed with.
        """
        now = now or utc_now()
        registry = self.registry()
        if resource_id is not None:
            chosen = refresh_plan(registry.where(F.col("resource_id") == resource_id), "9999-01-01 00:00:00")
        else:
            chosen = refresh_plan(registry, "9999-01-01 00:00:00" if everything else now)

        def again(row: Row) -> tuple:
            try:
                old = self._row(row["resource_id"])
                keep = old["expires_at"] - old["downloaded_at"] if old["expires_at"] and old["downloaded_at"] else None
                self.land(load(row), row["resource_id"], row["dataset_id"], row["table_name"], row["source_url"], now=now, keep_for=keep)
                return row["resource_id"], row["table_name"], "refreshed", self._row(row["resource_id"])["row_count"], None
            except Exception as exc:  # reported per table
                log.warning("refresh of %s failed", row["resource_id"], exc_info=True)
                return row["resource_id"], row["table_name"], "error", None, str(exc).split("\n")[0]

        with ThreadPoolExecutor(max(1, at_once)) as pool:  # each table is a few Spark jobs of its own
            results = list(pool.map(again, chosen.toLocalIterator()))
        return self.spark.createDataFrame(
            results, "resource_id string, table_name string, status string, row_count long, error string")

    # --- dataset metadata -----------------------------------------------------------

    def put_metadata(self, records: DataFrame, key: str = "id", now: dt.datetime | None = None) -> None:
        """Store whole records as JSON under the named id column."""
        self._records.add(records.select(
            F.col(key).cast("string").alias("dataset_id"),
            F.to_json(F.struct(*records.columns)).alias("metadata"),
            F.lit(str(now or utc_now())).cast("timestamp_ntz").alias("cached_at"),
            F.lit(time.time_ns()).alias("sequence"),
        ))

    def metadata(self) -> DataFrame:
        """The newest JSON per dataset id."""
        rows = self._records.read()
        return rows.groupBy("dataset_id").agg(
            F.max_by("metadata", "sequence").alias("metadata"), F.max("cached_at").alias("cached_at"))
