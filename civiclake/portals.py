"""The portals whose catalogues are landed. Order matters: first match wins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import astuple, dataclass, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Portal:
    key: str
    name: str
    base_url: str
    portal_type: str  # ckan or arcgis_hub
    description: str
    licence_name: str
    licence_url: str


# Neutral defaults; pass your own sequence wherever portals are asked for.
PORTALS = (
    Portal("province", "Province Open Data", "https://data.province.example", "ckan",
           "Catalogue of the province", "Open Government Licence - Province", "https://data.province.example/licence"),
    Portal("city_a", "City A Open Data", "https://data.city-a.example", "ckan",
           "Catalogue of city A", "Open Government Licence - City A", "https://data.city-a.example/licence"),
    Portal("city_b", "City B Open Data", "https://data.city-b.example", "arcgis_hub",
           "Catalogue of city B", "Open Government Licence - City B", "https://data.city-b.example/licence"),
)


def keys(portals: Sequence[Portal] = PORTALS) -> list[str]:
    return [p.key for p in portals]


def portals_frame(spark: SparkSession, portals: Sequence[Portal] = PORTALS) -> DataFrame:
    """One row per portal, with its place in the order."""
    names = [f.name for f in fields(Portal)]
    schema = ", ".join(f"{'portal' if n == 'key' else n} string" for n in names) + ", rank int"
    return spark.createDataFrame([(*astuple(p), i) for i, p in enumerate(portals)], schema)
