"""Column expressions for table names, slugs and portal-prefixed ids."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from civiclake.portals import PORTALS, Portal, keys


def slug(text: Column, separator: str = "_", length: int = 40) -> Column:
    """Lower case, runs of other characters as one separator, trimmed, then cut."""
    joined = F.regexp_replace(F.lower(text), "[^a-z0-9]+", separator)
    return F.substring(F.btrim(joined, F.lit(separator)), 1, length)


def table_name(dataset: Column, resource_id: Column, portal: Column, geo: bool = False) -> Column:
    """The name a resource always lands under."""
    kind, fallback = ("geo", "geo") if geo else ("ds", "unknown")
    name = F.coalesce(F.nullif(dataset, F.lit("")), F.lit(fallback))
    return F.concat(F.lit(kind + "_"), portal, F.lit("_"), slug(name), F.lit("_"), F.substring(resource_id, 1, 8))


def _any_of(portals: Sequence[Portal]) -> str:
    return "|".join(re.escape(k) for k in sorted(keys(portals), key=len, reverse=True))


def infer_portal(table: Column, portals: Sequence[Portal] = PORTALS) -> Column:
    """The portal a table name was built for; the first portal for other names."""
    found = F.regexp_extract(table, f"^(?:ds|geo)_({_any_of(portals)})_", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(portals[0].key))


def id_portal(identifier: Column, portals: Sequence[Portal] = PORTALS) -> Column:
    """The prefix before the first ``:`` if it is a known portal, else NULL."""
    return F.nullif(F.regexp_extract(identifier, f"^({_any_of(portals)}):", 1), F.lit(""))


def bare_id(identifier: Column, portals: Sequence[Portal] = PORTALS) -> Column:
    return F.regexp_replace(identifier, f"^({_any_of(portals)}):", "")
