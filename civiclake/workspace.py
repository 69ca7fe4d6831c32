"""One object for day-to-day work: land resources, search catalogues, ask, check.

Every answer is a DataFrame (or a row); nothing here computes on the driver.
"""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from civiclake.functions.names import bare_id
from civiclake.functions.statements import table_names
from civiclake.operators import catalog as cat
from civiclake.operators import claims as cl
from civiclake.operators import profile as pf
from civiclake.operators import query as q
from civiclake.operators import registry as reg
from civiclake.operators import spatial as sp
from civiclake.operators.freesql import RESULT_CAP, InvalidQuery, check_sql, run_sql, truncation_report
from civiclake.operators.staleness import check_freshness
from civiclake.portals import PORTALS, Portal, portals_frame
from civiclake.session import own_session, work_dir
from civiclake.sources.ingest import ingest
from civiclake.sources.store import Store, utc_now

log = logging.getLogger(__name__)


class Workspace:
    """Landed tables and catalogues under one folder of shared storage."""

    def __init__(self, spark: SparkSession, root: str, portals: Sequence[Portal] = PORTALS):
        self.spark = spark
        self.portals = tuple(portals)
        self.store = Store(spark, root)
        self._catalogs = Store(spark, f"{root.rstrip('/')}/_catalogs")

    def _bare(self, identifier: str) -> str:
        return self.spark.range(1).select(bare_id(F.lit(identifier), self.portals)).first()[0]

    # --- catalogues ---------------------------------------------------------------

    def add_catalog(self, portal: str, records: DataFrame) -> None:
        """Land (or replace) one portal's nested dataset records."""
        for name, df in zip(("datasets", "resources"), cat.split_catalog(records, portal)):
            self._catalogs.land(df, f"{name}-{portal}", portal, f"{name}_{portal}", repair=False)

    def _catalog(self, name: str) -> DataFrame:
        wanted = [f"{name}-{p.key}" for p in self.portals]
        landed = {r["resource_id"] for r in self._catalogs.registry().where(F.col("resource_id").isin(wanted)).select("resource_id").collect()}
        parts = [self._catalogs.table(w) for w in wanted if w in landed]
        if not parts:
            raise LookupError("No catalogue is landed; use add_catalog first")
        return reduce(DataFrame.unionByName, parts)

    def datasets(self) -> DataFrame:
        return self._catalog("datasets")

    def resources(self) -> DataFrame:
        return self._catalog("resources")

    def search(self, query: str = "*:*", limit: int = 5, **options: Any) -> DataFrame:
        return cat.search_datasets(self.datasets(), self.resources(), query, limit, **options)

    def organizations(self) -> DataFrame:
        return cat.list_organizations(self.datasets(), portals=self.portals)

    def topics(self, query: str | None = None, limit: int = 100, portal: str | None = None) -> DataFrame:
        return cat.list_topics(self.datasets(), query, limit, portal, self.portals)

    def related(self, dataset_id: str, limit: int = 10) -> DataFrame:
        everything = self.datasets()
        chosen = cat.pick(everything, [dataset_id], self.portals)
        return cat.related_datasets(everything, chosen, limit)

    def portal_list(self) -> DataFrame:
        return portals_frame(self.spark, self.portals)

    def portal_stats(self) -> DataFrame:
        return cat.portal_stats(self.datasets(), self.portal_list())

    def dataset(self, dataset_id: str) -> DataFrame:
        return cat.dataset_info(cat.pick(self.datasets(), [dataset_id], self.portals))

    def files(self, dataset_id: str) -> DataFrame:
        chosen = cat.pick(self.datasets(), [dataset_id], self.portals).select("portal", F.col("id").alias("package_id"))
        return cat.list_resources(self.resources().join(chosen, ["portal", "package_id"], "left_semi"))

    def compare(self, dataset_ids: Sequence[str]) -> DataFrame:
        return cat.compare_datasets(self.datasets(), self.resources(), dataset_ids, self.portals)

    def geo_datasets(self, format_filter: str | None = None, limit: int = 50, portal: str | None = None) -> DataFrame:
        return cat.list_geo_datasets(self.datasets(), self.resources(), format_filter, limit, portal, self.portals)

    def freshness(self, dataset_id: str | None = None, now: Any = None) -> DataFrame:
        chosen = self.datasets() if dataset_id is None else cat.pick(self.datasets(), [dataset_id], self.portals)
        return check_freshness(chosen, now or utc_now())

    # --- landed tables ---------------------------------------------------------------

    def land(self, path: str, fmt: str | None, resource_id: str, dataset_id: str = "", dataset_name: str | None = None,
             portal: str | None = None, **options: Any) -> dict[str, Any]:
        return ingest(self.store, path, fmt, self._bare(resource_id), dataset_id, dataset_name, portal or self.portals[0].key, **options)

    def table(self, resource_id: str) -> DataFrame:
        return self.store.table(self._bare(resource_id))

    def inventory(self, now: Any = None) -> DataFrame:
        return reg.inventory(self.store.registry(), now or utc_now())

    def totals(self) -> DataFrame:
        return reg.registry_stats(self.store.registry())

    def remove(self, resource_id: str) -> bool:
        return self.store.remove(self._bare(resource_id))

    def clear(self) -> int:
        return self.store.remove_all()

    def refresh(
        self, load: Callable[[Row], DataFrame], resource_id: str | None = None, now: dt.datetime | None = None, everything: bool = False
    ) -> DataFrame:
        """Load stale tables, the one named, or ``everything`` again."""
        return self.store.refresh(load, now, resource_id and self._bare(resource_id), everything)

    # --- questions ---------------------------------------------------------------------

    def query(self, resource_id: str, **options: Any) -> DataFrame:
        return q.query_table(self.table(resource_id), **options)

    def preview(self, resource_id: str, rows: int = 10, sort: str | None = None) -> DataFrame:
        return q.preview(self.table(resource_id), rows, sort)

    def columns(self, resource_id: str, samples: int = 5, sort: str | None = None) -> DataFrame:
        return q.describe_columns(self.table(resource_id), samples, sort)

    def sql(self, sql: str, cap: int | None = RESULT_CAP) -> DataFrame:
        """Free SQL over the landed tables, by their table names, in a session beside the workspace's own."""
        check_sql(sql)
        session = own_session(self.spark)
        self.store.register_views(sql, session)
        try:
            return run_sql(session, sql, cap)
        except Exception as exc:
            names = [r["table_name"] for r in self.store.registry().select("table_name").orderBy("table_name").limit(20).collect()]
            raise InvalidQuery("engine", f"{exc} [tables at hand, 20 at most: {', '.join(names)}]") from exc

    def review(self, sql: str, now: Any = None) -> dict[str, DataFrame]:
        """What to know about a query's result: size and cap, warnings, and sources."""
        path = work_dir(self.spark, "review")
        truncation_report(self.sql(sql, cap=None)).write.parquet(path)  # once for both uses
        report = self.spark.read.parquet(path)
        log = report.select(F.lit(1).alias("query_id"), F.lit(sql).alias("sql"), F.col("returned").alias("result_rows"))
        registry = self.store.registry()
        named = self.spark.range(1).select(F.explode(table_names(F.lit(sql))).alias("table_name")).distinct()
        sizes = reg.registry_by_tables(named, registry).select("table_name", "row_count", "resource_id").collect()
        stats = self.spark.createDataFrame(
            [(r["table_name"], r["row_count"], self.store.table(r["resource_id"]).columns) for r in sizes],
            "table_name string, row_count long, columns array<string>")
        return {"size": report, "warnings": q.query_warnings(log, stats), "sources": q.provenance(log, registry, now or utc_now())}

    def profile(self, resource_id: str) -> DataFrame:
        return pf.profile(self.table(resource_id))

    def quality(self, resource_id: str) -> DataFrame:
        return pf.quality_report(self.table(resource_id))

    def validate(self, claims: Sequence[tuple[str, str]]) -> DataFrame:
        """PASS, FAIL or UNVERIFIABLE for each (sql, claim), by its place in the list.

        Each distinct statement runs once. The statements come from people, one by one;
        what is spread over the cluster is their results and the matching.
        """
        started = utc_now()
        numbers = {sql: f"r{i}" for i, sql in enumerate(dict.fromkeys(sql for sql, _ in claims))}
        rows = [(str(i), numbers[sql], text, sql) for i, (sql, text) in enumerate(claims)]
        asked = self.spark.createDataFrame(rows, "claim_id string, result_id string, claim string, sql string").withColumn(
            "started_at", F.lit(str(started)).cast("timestamp_ntz"))
        indexes = [self.spark.createDataFrame([], "result_id string, column string, num double, str string")]
        for sql, number in numbers.items():
            path = work_dir(self.spark, "claims")
            try:
                result = self.sql(sql, cap=None).select(F.lit(number).alias("result_id"), "*")
                # Run here, so that a statement that fails on some row fails alone.
                cl.value_index(result).unionByName(cl.row_markers(result)).write.parquet(path)
            except Exception:  # noqa: BLE001 - any engine error; the audit or the empty index decides
                log.warning("statement %s failed", number, exc_info=True)
                continue
            indexes.append(self.spark.read.parquet(path))
        return cl.validate_claims(asked, reduce(DataFrame.unionByName, indexes), self.store.registry())

    def containing(self, resource_id: str, lon: float, lat: float, limit: int | None = None) -> DataFrame:
        """Features of a geographic table whose interior holds the point."""
        return sp.contains_point(self.table(resource_id), lon, lat, limit)

    def nearby(self, resource_id: str, lon: float, lat: float, km: float, limit: int | None = None) -> DataFrame:
        """Features within ``km`` of the point, nearest first."""
        return sp.within_radius(self.table(resource_id), lon, lat, km, limit)

    def in_box(self, resource_id: str, box: Sequence[float], limit: int | None = None) -> DataFrame:
        """Features that meet the box."""
        return sp.within_bbox(self.table(resource_id), box, limit)
