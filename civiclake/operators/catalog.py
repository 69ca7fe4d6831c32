"""Operators on landed dataset catalogues.

Two tables: ``datasets`` (one row per dataset and portal) and ``resources`` (one
row per file). ``split_catalog`` makes both from nested catalogue records. Files
are never gathered under their dataset, so a dataset may own any number of them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from civiclake.functions.names import bare_id, id_portal
from civiclake.operators.ordering import sort_columns
from civiclake.operators.skew import spread_join
from civiclake.portals import PORTALS, Portal, keys
from civiclake.session import full_shuffle


# Formats that count as geographic, and those listed with them.
GEO_FORMATS = ("SHP", "KML", "GEOJSON")
GEO_LISTED = ("SHP", "KML", "GEOJSON", "ZIP")

DATASET_COLUMNS = (
    "portal", "id", "name", "title", "notes", "org_name", "org_title", "tags", "update_frequency", "metadata_modified",
    "metadata_created", "license_title", "geographic_coverage", "maintainer", "maintainer_en", "access_level", "current_as_of",
)
RESOURCE_COLUMNS = (
    "portal", "package_id", "id", "name", "format", "size", "url", "last_modified", "datastore_active",
    "data_range_start", "data_range_end",
)


def portal_rank(portal: Column, portals: Sequence[Portal] = PORTALS) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in keys(portals)]), portal)


def filled(text: Column) -> Column:
    """NULL for empty text."""
    return F.nullif(text, F.lit(""))


def prefixed(portal: Column, identifier: Column) -> Column:
    return F.concat(portal, F.lit(":"), identifier)


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("metadata_modified"), F.col("id").asc()]


# --- search -------------------------------------------------------------------------

def match_score(query: str) -> Column:
    """How many of the query's words occur in title, notes or tags."""
    text = F.lower(F.concat_ws(" ", "title", "notes", F.array_join("tags", " ")))
    words = list(dict.fromkeys(query.lower().split()))
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words], F.lit(0))


def matching(
    datasets: DataFrame,
    resources: DataFrame | None = None,
    query: str = "*:*",
    organization: str | None = None,
    resource_format: str | None = None,
    update_frequency: str | None = None,
    portal: str | None = None,
) -> DataFrame:
    """Datasets that match, with their ``score``; filters are all required."""
    found = datasets
    if portal:
        found = found.where(F.col("portal") == portal)
    if organization:
        found = found.where(F.col("org_name") == organization)
    if update_frequency:
        found = found.where(F.col("update_frequency") == update_frequency)
    if query.strip() in ("", "*:*"):
        found = found.withColumn("score", F.lit(0))
    else:
        found = found.withColumn("score", match_score(query)).where(F.col("score") > 0)
    if resource_format:
        having = resources.where(F.upper("format") == resource_format.upper()).select(
            "portal", F.col("package_id").alias("id"))
        found = found.join(having, ["portal", "id"], "left_semi")
    return found


def resource_summary(resources: DataFrame) -> DataFrame:
    """Per dataset: its distinct upper-case formats in order, and its file count."""
    return resources.groupBy("portal", F.col("package_id").alias("id")).agg(
        F.array_sort(F.collect_set(F.upper(filled(F.col("format"))))).alias("formats"),
        F.count(F.lit(1)).alias("num_resources"),
    )


def summary_columns(datasets: DataFrame, resources: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The columns a search shows for each dataset."""
    files = resource_summary(resources.join(
        datasets.select("portal", F.col("id").alias("package_id")), ["portal", "package_id"], "left_semi"))
    return datasets.join(files, ["portal", "id"], "left").select(
        prefixed(F.col("portal"), F.col("id")).alias("id"), "portal", "name", "title",
        F.coalesce("org_title", F.lit("Unknown")).alias("organization"),
        F.substring(F.coalesce("notes", F.lit("")), 1, 200).alias("description"),
        F.coalesce("formats", F.array().cast("array<string>")).alias("formats"),
        F.coalesce("num_resources", F.lit(0)).alias("num_resources"),
        F.col("metadata_modified").alias("last_modified"),
        F.coalesce("update_frequency", F.lit("unknown")).alias("update_frequency"), *extra,
    )


def search_datasets(
    datasets: DataFrame,
    resources: DataFrame,
    query: str = "*:*",
    limit: int = 5,
    sort: str | None = None,
    **filters,
) -> DataFrame:
    """The best matches of each portal, with that portal's total and returned counts.

    The default order is score, then last change. Ranking keeps at most ``limit`` rows
    per portal in every task before the shuffle; files are summed for the hits only.
    """
    k = limit
    found = matching(datasets, resources, query, **filters)
    # "relevance" in a sort text means the score.
    order = sort_columns(re.sub(r"\brelevance\b", "score", sort or "")) or [F.col("score").desc(), F.desc_nulls_last("metadata_modified")]
    place = F.row_number().over(W.partitionBy("portal").orderBy(*order, "id"))
    hits = found.withColumn("place", place).where(F.col("place") <= k)
    totals = found.groupBy("portal").agg(F.count(F.lit(1)).alias("total_count"))
    shown = hits.join(totals, "portal").withColumn("returned", F.least(F.col("total_count"), F.lit(k).cast("long")))
    return summary_columns(shown, resources, ["score", "place", "total_count", "returned"]).orderBy("portal", "place")


def catalog_page(datasets: DataFrame, start: int = 0, rows: int = 10, sort: str | None = None) -> DataFrame:
    """One page of the catalogue; the order ends in a unique key."""
    # "relevance" in a sort text means the score.
    order = sort_columns(re.sub(r"\brelevance\b", "score", sort or "")) or [F.desc_nulls_last("metadata_modified")]
    return datasets.orderBy(*order, "portal", "id").offset(start).limit(rows)


def facet_counts(datasets: DataFrame, names: Sequence[str]) -> DataFrame:
    """Datasets per value of each named column, from one scan."""
    pairs = F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")) for n in names])
    return (
        datasets.select(F.inline(pairs)).where(F.col("value").isNotNull())
        .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def search_resources(
    resources: DataFrame, terms: Sequence[str], order_by: str | None = None, limit: int | None = None, offset: int = 0
) -> DataFrame:
    """Files matching every ``field:text`` term (part of the field, any case)."""
    found = resources
    for term in terms:
        name, _, text = term.partition(":")
        found = found.where(F.lower(F.col(name).cast("string")).contains(text.lower()))
    if order_by or limit is not None or offset:
        found = found.orderBy(*sort_columns(order_by), "portal", "id", "package_id")
    if offset:
        found = found.offset(offset)
    return found if limit is None else found.limit(limit)


# --- organizations, topics, portals ----------------------------------------------------

def organization_counts(datasets: DataFrame) -> DataFrame:
    """Datasets per portal and organization. Counting by title as well keeps the pass over
    the datasets a hash aggregation; the few groups are then put together."""
    by_title = datasets.groupBy("portal", "org_name", "org_title").agg(F.count(F.lit(1)).alias("n"))
    return by_title.groupBy("portal", "org_name").agg(F.max("org_title").alias("org_title"), F.sum("n").alias("n"))


def list_organizations(
    datasets: DataFrame, organizations: DataFrame | None = None, portals: Sequence[Portal] = PORTALS
) -> DataFrame:
    """Organizations with their dataset counts, most first within each portal.

    ``organizations`` (portal, name, title, description) adds descriptions and the
    organizations that have no dataset.
    """
    counted = organization_counts(datasets).where(F.col("org_name").isNotNull()).withColumnRenamed("org_name", "name")
    if organizations is None:
        listed = counted.withColumns({"title": F.col("org_title"), "description": F.lit("")})
    else:
        listed = organizations.join(counted, ["portal", "name"], "full").withColumn("title", F.coalesce("title", "org_title"))
    return listed.select(
        "portal", "name", "title", F.coalesce("n", F.lit(0)).alias("dataset_count"),
        F.substring(F.coalesce("description", F.lit("")), 1, 150).alias("description"),
    ).orderBy(portal_rank(F.col("portal"), portals), F.desc("dataset_count"), "name")


def list_topics(
    datasets: DataFrame, query: str | None = None, limit: int = 100, portal: str | None = None,
    portals: Sequence[Portal] = PORTALS,
) -> DataFrame:
    """Tags by number of datasets, all portals together, with the total before the cut."""
    source = datasets.where(F.col("portal") == portal) if portal else datasets
    tags = source.select("portal", F.explode(F.array_distinct("tags")).alias("name"))
    if query:
        tags = tags.where(F.lower("name").contains(query.lower()))
    counted = tags.groupBy("portal", "name").agg(F.count(F.lit(1)).alias("n"))
    whole = counted.agg(F.count(F.lit(1))).scalar()
    order = [F.desc("n"), portal_rank(F.col("portal"), portals), "name"]
    return counted.orderBy(*order).limit(limit).withColumn("total", whole)


def portal_stats(datasets: DataFrame, portals_df: DataFrame, top: int = 5) -> DataFrame:
    """Per portal: dataset count and its largest organizations, one row each."""
    per_org = organization_counts(datasets).withColumnsRenamed({"org_title": "organization", "n": "datasets"})
    totals = per_org.groupBy("portal").agg(F.sum("datasets").alias("total_datasets"))
    place = F.row_number().over(W.partitionBy("portal").orderBy(F.desc("datasets"), "org_name"))
    best = per_org.where(F.col("org_name").isNotNull()).withColumn("place", place).where(F.col("place") <= top)
    return (
        portals_df.select("portal", "name")
        .join(totals, "portal", "left").join(best.drop("org_name"), "portal", "left")
        .withColumn("total_datasets", F.coalesce("total_datasets", F.lit(0)))
    )


# --- single datasets --------------------------------------------------------------------

def dataset_info(datasets: DataFrame) -> DataFrame:
    """The flat description of each dataset."""
    return datasets.select(
        prefixed(F.col("portal"), F.col("id")).alias("id"), "name", "title", F.col("notes").alias("description"),
        F.col("org_title").alias("organization"), F.coalesce(filled(F.col("maintainer_en")), F.col("maintainer")).alias("maintainer"),
        F.col("license_title").alias("license"), "tags", "update_frequency", F.col("metadata_created").alias("created"),
        F.col("metadata_modified").alias("last_modified"), "access_level", "geographic_coverage",
    )


def list_resources(resources: DataFrame) -> DataFrame:
    """Every file with its size, state and the range its data covers."""
    return resources.select(
        prefixed(F.col("portal"), F.col("package_id")).alias("dataset_id"), "id", "name", "format",
        F.col("size").alias("size_bytes"), "url", F.col("last_modified"),
        F.coalesce("datastore_active", F.lit(False)).alias("datastore_active"),
        F.concat(F.coalesce("data_range_start", F.lit("?")), F.lit(" to "), F.coalesce("data_range_end", F.lit("?"))).alias("data_range"),
    )


def compare_datasets(datasets: DataFrame, resources: DataFrame, ids: Sequence[str], portals: Sequence[Portal] = PORTALS) -> DataFrame:
    """The named datasets side by side, each with the tags that all of them share."""
    chosen = pick(datasets, list(ids), portals)
    files = resource_summary(resources.join(
        chosen.select("portal", F.col("id").alias("package_id")), ["portal", "package_id"], "left_semi"))
    n = chosen.agg(F.count(F.lit(1))).scalar()
    shared = (
        chosen.select("portal", "id", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag")
        .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n)
        .agg(F.array_sort(F.collect_list("tag")))
    ).scalar()
    return chosen.join(files, ["portal", "id"], "left").withColumn("shared_tags", shared).select(
        prefixed(F.col("portal"), F.col("id")).alias("id"), "title", F.col("org_title").alias("organization"),
        F.coalesce("num_resources", F.lit(0)).alias("num_resources"), "formats", "update_frequency",
        F.col("metadata_modified").alias("last_modified"), "tags", F.col("license_title").alias("license"),
        "geographic_coverage", "shared_tags",
    )


def pick(datasets: DataFrame, ids: Sequence[str], portals: Sequence[Portal] = PORTALS) -> DataFrame:
    """The datasets named by prefixed or bare ids; a bare id means its first portal."""
    requested = datasets.sparkSession.createDataFrame([(i,) for i in ids], "request string").distinct()
    # The ids are known, so the scan drops all other rows before anything is grouped.
    known = f"^({'|'.join(re.escape(k) for k in sorted(keys(portals), key=len, reverse=True))}):"
    datasets = datasets.where(F.col("id").isin(sorted({x for i in ids for x in (i, re.sub(known, "", i))})))
    found = resolve_ids(requested, datasets, portals).where("found").select("portal", F.col("bare_id").alias("id")).distinct()
    return datasets.join(found, ["portal", "id"], "left_semi")


def shared_tags(datasets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group, the tags that every one of its datasets carries."""
    sizes = datasets.groupBy(*by).agg(F.count(F.lit(1)).alias("n_datasets"))
    per_tag = (
        datasets.select(*by, F.explode(F.array_distinct("tags")).alias("tag")).groupBy(*by, "tag")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_tag.join(sizes, list(by)).where(F.col("n") == F.col("n_datasets")).select(*by, "tag", "n_datasets")


def resolve_ids(requests: DataFrame, datasets: DataFrame, portals: Sequence[Portal] = PORTALS) -> DataFrame:
    """Where each requested id lives.

    A prefixed id is looked up in its portal only; a bare one in every portal, the
    first in portal order winning. Unknown ids keep a row with the portals tried.
    """
    homes = datasets.groupBy(F.col("id").alias("bare_id")).agg(
        F.array_sort(F.collect_set(portal_rank(F.col("portal"), portals))).alias("ranks"))
    names = F.array(*[F.lit(k) for k in keys(portals)])
    wanted = portal_rank(F.col("wanted_portal"), portals)
    rank = F.when(F.col("wanted_portal").isNull(), F.get("ranks", F.lit(0))).when(F.array_contains("ranks", wanted), wanted)
    asked = requests.withColumns({"wanted_portal": id_portal(F.col("request"), portals), "bare_id": bare_id(F.col("request"), portals)})
    return (
        spread_join(asked, homes, ["bare_id"])
        .withColumn("portal", F.get(names, (rank - 1).cast("int")))
        .withColumn("found", F.col("portal").isNotNull())
        .withColumn("tried", F.when(~F.col("found"), F.coalesce("wanted_portal", F.lit(", ".join(keys(portals))))))
        .drop("ranks", "wanted_portal")
    )


def _by_age(found: str | Column) -> Column:
    """A list of (id, metadata_modified) in the order of ``newest_first``."""
    def order(a: Column, b: Column) -> Column:
        x, y = a["metadata_modified"], b["metadata_modified"]
        by_id = F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
        return F.when(x.eqNullSafe(y), by_id).when(y.isNull() | (x > y), -1).otherwise(1)

    return F.array_sort(found, order)


def related_datasets(datasets: DataFrame, sources: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """For each source dataset the ``limit`` most related ones of the same portal.

    First those that carry one of the source's tags, newest first, then
    others of its organization. ``sources`` (portal, id) defaults to all datasets.

    Newest-first makes this exact without pairing datasets: only the newest
    ``limit + 1`` of a tag can be among a source's results, and if the tags give
    fewer than ``limit``, the newest ``2 * limit`` of the organization must hold the
    rest. A tag or organization of any size thus contributes a bounded list.

    A tag or organization is one row with that list, and so is a source with all it finds; the
    list is sorted and cut in the row, and no task groups the single candidates.
    """
    base = datasets if sources is None else datasets.join(sources.select("portal", "id"), ["portal", "id"], "left_semi")
    source = base.where(F.col("id").isNotNull()).select("portal", F.col("id").alias("source_id"), F.col("tags").alias("source_tags"), "org_name")

    def newest(rows: DataFrame, key: str, n: int) -> DataFrame:
        place = F.row_number().over(W.partitionBy("portal", key).orderBy(*newest_first()))
        first = rows.withColumn("place", place).where(F.col("place") <= n)
        return first.groupBy("portal", key).agg(F.collect_list(F.struct("id", "metadata_modified")).alias("found"))

    # Dealt first, so that no task sorts all that one file holds.
    dealt = datasets.select("portal", "id", "metadata_modified", "org_name", F.array_distinct("tags").alias("tags")).repartition("portal", "id")
    members = dealt.select("portal", "id", "metadata_modified", F.explode("tags").alias("tag"))
    tagged = source.select("portal", "source_id", F.explode(F.array_distinct("source_tags")).alias("tag"))
    in_org = dealt.where(F.col("org_name") != "").select("portal", "id", "metadata_modified", "org_name")
    by_tag = spread_join(tagged, newest(members, "tag", limit + 1), ["portal", "tag"], "inner", merge=True).select(
        "portal", "source_id", F.col("found").alias("by_tag"))
    by_org = spread_join(
        source.select("portal", "source_id", "org_name"), newest(in_org, "org_name", 2 * limit + 1), ["portal", "org_name"], "inner", merge=True,
    ).select("portal", "source_id", F.col("found").alias("by_org"))
    others = lambda found: F.filter(F.array_distinct(F.flatten(found)), lambda c: c["id"] != F.col("source_id"))
    parts = full_shuffle(datasets.sparkSession)
    # Sets, so that a source that is there many times has each list once.
    gathered = by_tag.unionByName(by_org, allowMissingColumns=True).repartition(parts, "portal", "source_id").groupBy("portal", "source_id").agg(
        F.collect_set("by_tag").alias("by_tag"), F.collect_set("by_org").alias("by_org")).withColumns({"by_tag": others("by_tag"), "by_org": others("by_org")})
    ranked = F.concat(F.slice(_by_age("by_tag"), 1, limit), F.slice(_by_age(F.array_except("by_org", "by_tag")), 1, limit))
    chosen = gathered.select("portal", "source_id", F.size("by_tag").alias("n_tagged"), F.posexplode(F.slice(ranked, 1, limit)).alias("place", "c")).select(
        "portal", "source_id", "c.id", "c.metadata_modified", (F.col("place") >= F.col("n_tagged")).cast("int").alias("step"), (F.col("place") + 1).alias("place"))
    about = datasets.select("portal", "id", "title", F.coalesce("org_title", F.lit("Unknown")).alias("organization"), "tags")
    return (
        chosen.join(source.drop("org_name"), ["portal", "source_id"]).repartition(parts, "portal", "id")
        .join(about, ["portal", "id"])
        .select(
            prefixed(F.col("portal"), F.col("source_id")).alias("source_id"), "place",
            prefixed(F.col("portal"), F.col("id")).alias("id"), "title", "organization",
            F.when(F.col("step") == 0, F.array_intersect("tags", "source_tags")).otherwise(F.array().cast("array<string>")).alias("shared_tags"),
            F.when(F.col("step") == 0, "tags").otherwise("same_organization").alias("relevance"),
        )
    )


def list_geo_datasets(
    datasets: DataFrame, resources: DataFrame, format_filter: str | None = None, limit: int = 50, portal: str | None = None,
    portals: Sequence[Portal] = PORTALS,
) -> DataFrame:
    """The geographic files of datasets that have a geographic format.

    Up to ``limit`` datasets per format and portal, newest first; each is
    listed once, and the list as a whole is cut to ``limit`` datasets.
    """
    formats = [format_filter.upper()] if format_filter else list(GEO_FORMATS)
    source = datasets.where(F.col("portal") == portal) if portal else datasets
    carrying = resources.where(F.upper("format").isin(formats)).select(
        "portal", F.col("package_id").alias("id"), F.upper("format").alias("geo_format")).distinct()
    by_format = W.partitionBy("portal", "geo_format").orderBy(*newest_first())
    format_rank = F.array_position(F.array(*[F.lit(f) for f in formats]), F.col("geo_format"))
    listed = (
        source.join(carrying, ["portal", "id"])
        .select("portal", "id", "metadata_modified", "geo_format")
        .withColumn("place", F.row_number().over(by_format)).where(F.col("place") <= limit)
        .groupBy("portal", "id").agg(F.min(F.struct(format_rank, "place")).alias("at"))
        .orderBy(portal_rank(F.col("portal"), portals), "at", "id").limit(limit)
    )
    files = resources.where(F.upper("format").isin(list(GEO_LISTED))).select(
        "portal", F.col("package_id").alias("id"), F.col("id").alias("resource_id"), F.col("name").alias("resource_name"), "format", "size")
    return (
        datasets.join(listed.select("portal", "id"), ["portal", "id"], "left_semi")
        .select("portal", "id", "title", F.col("org_title").alias("organization"))
        .join(files, ["portal", "id"], "left")
        .select(prefixed(F.col("portal"), F.col("id")).alias("id"), "title", "organization", "resource_id", "resource_name", "format", "size")
    )


# --- nested records -----------------------------------------------------------------------

def split_catalog(records: DataFrame, portal: str) -> tuple[DataFrame, DataFrame]:
    """Nested catalogue records to the ``datasets`` and ``resources`` tables.

    Fields a portal does not send become NULL columns.
    """
    have = dict(records.dtypes)

    def optional(name: str, kind: str = "string") -> Column:
        return (F.col(name) if name.split(".")[0] in have else F.lit(None)).cast(kind)

    def nested(parent: str, child: str) -> Column:
        if parent not in have or f"{child}:" not in have[parent]:
            return F.lit(None).cast("string")
        return F.col(f"{parent}.{child}").cast("string")

    tags = F.lit(None).cast("array<string>")
    if "tags" in have:
        tags = F.transform("tags", lambda t: t["name"]) if "struct" in have["tags"] else F.col("tags")
    plain = (
        "update_frequency", "metadata_modified", "metadata_created", "license_title", "geographic_coverage", "maintainer")
    datasets = records.select(
        F.lit(portal).alias("portal"), "id", optional("name").alias("name"), optional("title").alias("title"),
        optional("notes").alias("notes"), nested("organization", "name").alias("org_name"),
        nested("organization", "title").alias("org_title"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
        *[optional(c).alias(c) for c in plain], nested("maintainer_translated", "en").alias("maintainer_en"),
        optional("access_level").alias("access_level"), optional("current_as_of").alias("current_as_of"),
    )
    kinds = {"size": "long", "datastore_active": "boolean"}
    if "resources" not in have or "struct" not in have["resources"]:
        empty = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in RESOURCE_COLUMNS)
        return datasets, records.sparkSession.createDataFrame([], empty)
    files = records.select(F.col("id").alias("package_id"), F.explode("resources").alias("r"))
    inner = set(files.schema["r"].dataType.names)

    def item(name: str) -> Column:
        return (F.col(f"r.{name}") if name in inner else F.lit(None)).cast(kinds.get(name, "string"))

    resources = files.select(
        F.lit(portal).alias("portal"), "package_id", *[item(c).alias(c) for c in ("id", "name", "format", "size", "url")],
        F.coalesce(filled(item("last_modified")), item("data_last_updated")).alias("last_modified"),
        *[item(c).alias(c) for c in ("datastore_active", "data_range_start", "data_range_end")],
    )
    return datasets, resources
