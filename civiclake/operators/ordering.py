"""Sort texts such as ``"date desc, name asc"``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sort_columns(sort: str | None) -> list[Column]:
    """Sort expressions, NULLs last either way; unquoted or double-quoted names."""
    out = []
    for item in (sort or "").split(","):
        words = item.strip()
        if not words:
            continue
        name, _, way = words.rpartition(" ")
        if way.lower() not in ("asc", "desc"):
            name, way = words, "asc"
        column = F.col("`" + name.strip().strip('"').replace("`", "``") + "`")
        out.append(column.desc_nulls_last() if way.lower() == "desc" else column.asc_nulls_last())
    return out
