"""Points, polygons and which shape a point lies in, as column expressions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import QueryError

NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def parse_point(wkt: str) -> tuple[float, float]:
    """(lat, lng) of ``Point(lng lat)``; a comma may separate the two."""
    m = re.fullmatch(rf"\s*(?:point)?\s*\(\s*({NUMBER})[\s,]+({NUMBER})\s*\)\s*", wkt, re.I)
    if not m:
        raise QueryError(f"no point: {wkt!r}")
    lng, lat = float(m[1]), float(m[2])
    if not (-90 <= lat <= 90 and -180 <= lng <= 180):
        raise QueryError(f"point out of range: {wkt!r}")
    return lat, lng


def parse_polygon(wkt: str) -> list[list[tuple[float, float]]]:
    """Rings of (lat, lng) of ``Polygon((lng lat, ...), ...)``."""
    m = re.fullmatch(r"\s*polygon\s*\((.*)\)\s*", wkt, re.I | re.S)
    rings = re.findall(r"\(([^()]*)\)", m[1]) if m else []
    if not rings:
        raise QueryError(f"no polygon: {wkt!r}")
    out = []
    for ring in rings:
        points = [p.split() for p in ring.split(",")]
        if any(len(p) != 2 for p in points):
            raise QueryError(f"no polygon: {wkt!r}")
        out.append([(float(lat), float(lng)) for lng, lat in points])
    return out


def edges(shape: list[list[tuple[float, float]]]) -> list[list[float]]:
    """[lat1, lng1, lat2, lng2] of all sides of all rings; each ring closes itself."""
    return [[*a, *b] for ring in shape for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if a != b]


def inside(point: Column, sides: Column) -> Column:
    """Even-odd rule: an odd number of sides is crossed on the way from the point along its meridian. Null points are in none."""
    lat, lng = point["lat"].cast("double"), point["lng"].cast("double")

    def crosses(e: Column) -> Column:
        spans = (e[1] > lng) != (e[3] > lng)
        at = F.try_divide((e[2] - e[0]) * (lng - e[1]), e[3] - e[1]) + e[0]
        return F.when(spans & (lat < at), F.lit(True)).otherwise(F.lit(False))

    return F.coalesce(F.aggregate(sides, F.lit(False), lambda odd, e: odd != crosses(e)), F.lit(False)) & lat.isNotNull() & lng.isNotNull()


def first_shape(point: Column, shapes: list[tuple[str, list[list[tuple[float, float]]]]]) -> Column:
    """The id of the first of the shapes, in the order given, that the point lies in; null if none."""
    out = F.lit(None).cast("string")
    for name, shape in reversed(shapes):
        sides = F.from_json(F.lit(json.dumps(edges(shape))), "array<array<double>>")
        out = F.when(inside(point, sides), F.lit(name)).otherwise(out)
    return out


def rings_of(value: object) -> list[list[tuple[float, float]]]:
    """A shape as a table holds it: WKT, or rings of points."""
    if isinstance(value, str):
        return parse_polygon(value)
    return [[(float(p[0]), float(p[1])) for p in ring] for ring in value]
