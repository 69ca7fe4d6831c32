"""SQL functions for free SQL that Spark does not have: geometry on WKT text, seconds since 1970, JSON text, ordered string lists.

Each is a SQL-defined function, declared for one statement only. Spark inlines its body, so the plan holds built-in expressions alone.
The geometry bodies follow ``functions/geometry.py`` term by term. A shape is what ``parse_wkt`` makes there:
an array of ``struct<kind, points, ends, segments>``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

BLANKS = " \t\r\n"
POINT_TYPE = "STRUCT<x: DOUBLE, y: DOUBLE>"
SHAPE_TYPE = (
    f"ARRAY<STRUCT<kind: STRING, points: ARRAY<{POINT_TYPE}>, ends: ARRAY<{POINT_TYPE}>, "
    "segments: ARRAY<STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>>>>"
)


def _number(text: str, place: int) -> str:
    return rf"CAST(get(split(btrim({text}, '{BLANKS}'), '\s+'), {place}) AS DOUBLE)"


def _side(s: str, x: str, y: str) -> str:
    return f"(({s}.x2 - {s}.x1) * ({y} - {s}.y1) - ({s}.y2 - {s}.y1) * ({x} - {s}.x1))"


def _on_edge(segments: str, x: str, y: str) -> str:
    return (f"exists({segments}, e -> {_side('e', x, y)} = 0 AND {x} BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) "
            f"AND {y} BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2))")


def _encloses(segments: str, x: str, y: str) -> str:
    return (f"(size(filter({segments}, s -> (s.y1 > {y}) <> (s.y2 > {y}) AND "
            f"((s.y2 > s.y1 AND {_side('s', x, y)} > 0) OR (s.y2 < s.y1 AND {_side('s', x, y)} < 0)))) % 2 = 1)")


def _holds(shape: str, x: str, y: str) -> str:
    same = f"p -> p.x = {x} AND p.y = {y}"
    return (f"exists({shape}, c -> CASE c.kind WHEN 'area' THEN {_encloses('c.segments', x, y)} AND NOT {_on_edge('c.segments', x, y)} "
            f"WHEN 'line' THEN {_on_edge('c.segments', x, y)} AND size(filter(c.ends, {same})) % 2 = 0 ELSE exists(c.points, {same}) END)")


def _away(shape: str, x: str, y: str) -> str:
    """The planar distance of a point from a shape."""
    along = (f"greatest(0D, least(1D, coalesce(try_divide(({x} - s.x1) * (s.x2 - s.x1) + ({y} - s.y1) * (s.y2 - s.y1), "
             "(s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1)), 0D)))")
    gap = f"sqrt(pow({x} - (s.x1 + {along} * (s.x2 - s.x1)), 2) + pow({y} - (s.y1 + {along} * (s.y2 - s.y1)), 2))"
    corners = f"array_min(transform(c.points, p -> sqrt(pow(p.x - {x}, 2) + pow(p.y - {y}, 2))))"
    return (f"array_min(transform({shape}, c -> CASE WHEN c.kind = 'point' THEN {corners} WHEN c.kind = 'area' AND {_encloses('c.segments', x, y)} THEN 0D "
            f"ELSE coalesce(array_min(transform(c.segments, s -> {gap})), {corners}) END))")


def _bodies() -> dict[str, tuple[str, str, str]]:
    """Name: parameters, type, body."""
    ring = f"transform(split(r, ','), p -> named_struct('x', {_number('p', 0)}, 'y', {_number('p', 1)}))"
    pieces = "slice(r, 1, size(r) - 1), slice(r, 2, size(r) - 1), (a, b) -> named_struct('x1', a.x, 'y1', a.y, 'x2', b.x, 'y2', b.y)"
    crossing = (f"{_side('t', 's.x1', 's.y1')} * {_side('t', 's.x2', 's.y2')} < 0 AND {_side('s', 't.x1', 't.y1')} * {_side('s', 't.x2', 't.y2')} < 0")
    return {
        "civiclake_members": ("wkt STRING", "ARRAY<STRING>", (
            r"CASE WHEN upper(wkt) LIKE '%COLLECTION%' THEN filter(split(regexp_replace(wkt, '(?i)GEOMETRYCOLLECTION\s*(?:ZM|Z|M)?\s*\(', ''), "
            r"',\s*(?=[A-Za-z])'), m -> contains(m, '(')) WHEN contains(wkt, '(') THEN array(wkt) WHEN wkt IS NOT NULL THEN CAST(array() AS ARRAY<STRING>) END")),
        "civiclake_rings": ("members ARRAY<STRING>", f"ARRAY<STRUCT<kind: STRING, rings: ARRAY<ARRAY<{POINT_TYPE}>>>>", (
            "transform(members, m -> named_struct('kind', CASE WHEN contains(upper(m), 'POLYGON') THEN 'area' WHEN contains(upper(m), 'LINESTRING') THEN 'line' "
            rf"ELSE 'point' END, 'rings', transform(split(btrim(substr(m, instr(m, '(')), '(){BLANKS}'), '\)[\s,()]*\('), r -> {ring})))")),
        "civiclake_parts": (f"parts ARRAY<STRUCT<kind: STRING, rings: ARRAY<ARRAY<{POINT_TYPE}>>>>", SHAPE_TYPE, (
            "transform(parts, q -> named_struct('kind', q.kind, 'points', flatten(q.rings), "
            "'ends', flatten(transform(q.rings, r -> array(get(r, 0), element_at(r, -1)))), "
            f"'segments', flatten(transform(q.rings, r -> zip_with({pieces})))))")),
        "civiclake_shape": ("wkt STRING", SHAPE_TYPE, "civiclake_parts(civiclake_rings(civiclake_members(wkt)))"),
        "civiclake_holds": (f"shape {SHAPE_TYPE}, x DOUBLE, y DOUBLE", "BOOLEAN", _holds("shape", "x", "y")),
        "civiclake_away": (f"shape {SHAPE_TYPE}, x DOUBLE, y DOUBLE", "DOUBLE", _away("shape", "x", "y")),
        "civiclake_apart": (f"one {SHAPE_TYPE}, two {SHAPE_TYPE}", "DOUBLE", (
            f"CASE WHEN exists(one, f -> exists(f.segments, s -> exists(two, g -> exists(g.segments, t -> {crossing})))) THEN 0D ELSE least("
            f"array_min(transform(flatten(transform(two, g -> g.points)), v -> {_away('one', 'v.x', 'v.y')})), "
            f"array_min(transform(flatten(transform(one, g -> g.points)), v -> {_away('two', 'v.x', 'v.y')}))) END")),
        "st_geomfromtext": ("wkt STRING", "STRING", "wkt"),
        "st_astext": ("shape STRING", "STRING", "shape"),
        "st_point": ("x DOUBLE, y DOUBLE", "STRING", "concat('POINT (', CAST(x AS STRING), ' ', CAST(y AS STRING), ')')"),
        "st_x": ("point STRING", "DOUBLE", r"try_cast(nullif(regexp_extract(point, '^\s*(?i:POINT)\s*(?:ZM|Z|M)?\s*\(\s*([^\s)]+)\s+([^\s)]+)', 1), '') AS DOUBLE)"),
        "st_y": ("point STRING", "DOUBLE", r"try_cast(nullif(regexp_extract(point, '^\s*(?i:POINT)\s*(?:ZM|Z|M)?\s*\(\s*([^\s)]+)\s+([^\s)]+)', 2), '') AS DOUBLE)"),
        "st_contains": ("shape STRING, point STRING", "BOOLEAN", "civiclake_holds(civiclake_shape(shape), st_x(point), st_y(point))"),
        "st_within": ("point STRING, shape STRING", "BOOLEAN", "st_contains(shape, point)"),
        "st_distance": ("one STRING, two STRING", "DOUBLE", (
            "CASE WHEN st_x(two) IS NOT NULL THEN civiclake_away(civiclake_shape(one), st_x(two), st_y(two)) "
            "WHEN st_x(one) IS NOT NULL THEN civiclake_away(civiclake_shape(two), st_x(one), st_y(one)) "
            "ELSE civiclake_apart(civiclake_shape(one), civiclake_shape(two)) END")),
        "epoch": ("moment TIMESTAMP_NTZ", "DOUBLE", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', moment) / 1e6D"),
        "json_extract_string": ("document STRING, path STRING", "STRING", (
            "get_json_object(document, CASE WHEN path LIKE '$%' THEN path WHEN path LIKE '/%' THEN concat('$', replace(path, '/', '.')) "
            "ELSE concat('$.', path) END)")),
    }


FUNCTIONS = _bodies()
NAMES = re.compile(r"\b(" + "|".join(FUNCTIONS) + r")\s*\(", re.IGNORECASE)


def needed(sql: str) -> list[str]:
    """Names of the functions that the text may call, each after those that its body calls."""
    out: list[str] = []
    for name in dict.fromkeys(n.lower() for n in NAMES.findall(sql)):
        out += [n for n in [*needed(FUNCTIONS[name][2]), name] if n not in out]
    return out


@contextmanager
def functions_for(spark: SparkSession, sql: str) -> Iterator[None]:
    """Declare the functions a statement calls while it is analysed. A function of the same name that the session has is left alone."""
    made = []
    try:
        for name in needed(sql):
            if not spark.catalog.functionExists(name):
                parameters, kind, body = FUNCTIONS[name]
                spark.sql(f"CREATE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
                made.append(name)
        yield
    finally:
        for name in reversed(made):
            spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")


_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\w+|\s+|.", re.DOTALL)


def ordered_lists(sql: str) -> str:
    """``STRING_AGG(x, sep ORDER BY y)`` as ``STRING_AGG(x, sep) WITHIN GROUP (ORDER BY y)``."""
    parts = _TOKEN.findall(sql)
    starts = [i for i, p in enumerate(parts) if p.lower() in ("string_agg", "listagg")]
    for start in reversed(starts):  # inner calls first
        depth, order = 0, None
        for i in range(start + 1, len(parts)):
            word = parts[i].lower()
            if depth == 0 and word != "(" and not word.isspace():
                break
            depth += (word == "(") - (word == ")")
            if depth == 1 and word == "order":
                order = i
            if word == ")" and depth == 0:
                if order is not None:
                    parts[start:i + 1] = [*parts[start:order], ") WITHIN GROUP (", *parts[order:i + 1]]
                break
    return "".join(parts)
