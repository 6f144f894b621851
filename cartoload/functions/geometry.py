"""Geometry text: GeoJSON and Esri points to WKT as expressions, WKB to WKT in Arrow batches (V5-V7)."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cartoload.functions.values import plain_numbers

PARSED = "type string, coordinates string, geometries array<string>"
STRICT = "map('mode', 'FAILFAST')"

# How deep the coordinates of a kind are nested.
DEPTH = {"Point": 1, "LineString": 2, "MultiPoint": 2, "Polygon": 3, "MultiLineString": 3, "MultiPolygon": 4}

# WKT bodies are put together as SQL text: one expression to parse, however deep the nesting.


def _each(items: str, variable: str, body: str) -> str:
    return f"concat('(', array_join(transform({items}, {variable} -> {body}), ','), ')')"


def _pair(position: str) -> str:
    return f"concat_ws(' ', {position}[0], {position}[1])"


def _line(positions: str) -> str:
    return _each(positions, "p", _pair("p"))


def _polygon(rings: str) -> str:
    closed = "if(element_at(r, 1) = element_at(r, -1), r, concat(r, slice(r, 1, 1)))"
    return _each(rings, "r", _line(closed))


def _body(kind: str, value: str) -> str:
    if kind == "Point":
        return f"concat('(', {_pair(value)}, ')')"
    if kind == "LineString":
        return _line(value)
    if kind == "MultiPoint":
        return _each(value, "m", f"concat('(', {_pair('m')}, ')')")
    if kind == "Polygon":
        return _polygon(value)
    if kind == "MultiLineString":
        return _each(value, "l", _line("l"))
    return _each(value, "g", _polygon("g"))


def _coordinates(kind: str, text: str, depth: int) -> str:
    """Parsed coordinates of the kinds with this depth, NULL for the others."""
    kinds = ", ".join(f"'{name}'" for name, d in DEPTH.items() if d == depth)
    shape = "array<" * depth + "double" + ">" * depth
    return f"CASE WHEN {kind} IN ({kinds}) THEN from_json({text}, '{shape}', {STRICT}) END"


def _plain_wkt(kind: str, coordinates: dict[int, str], otherwise: str) -> str:
    cases = []
    for name, depth in DEPTH.items():
        value = coordinates[depth]
        if name == "Point":
            cases.append(f"WHEN {kind} = 'Point' AND size({value}) >= 2 THEN concat('POINT', {_body(name, value)})")
        else:
            body = f"if(size({value}) = 0, ' EMPTY', {_body(name, value)})"
            cases.append(f"WHEN {kind} = '{name}' THEN concat('{name.upper()}', {body})")
    return f"CASE {' '.join(cases)} ELSE {otherwise} END"


def _bad(document: str) -> str:
    return f"CAST(raise_error(concat('cannot read the geometry ', {document})) AS string)"


def _collection(members: str, nesting: int) -> str:
    """Members of a collection, which may hold collections ``nesting`` levels down."""
    one = f"c{nesting}"
    inner = _collection(f"{one}.geometries", nesting - 1) if nesting else _bad(f"to_json({one})")
    whole = f"CASE WHEN {one}.type = 'GeometryCollection' THEN {inner} ELSE {_bad(f'to_json({one})')} END"
    text = {d: _coordinates(f"{one}.type", f"{one}.coordinates", d) for d in (1, 2, 3, 4)}
    parsed = f"transform({members}, t -> from_json(t, '{PARSED}', {STRICT}))"
    listed = _each(parsed, one, _plain_wkt(f"{one}.type", text, whole))
    return f"concat('GEOMETRYCOLLECTION', if(size({members}) = 0, ' EMPTY', {listed}))"


def geojson_to_wkt(frame: DataFrame, geometry: str, nesting: int = 0) -> DataFrame:
    """V5: the column of GeoJSON geometry documents turned into WKT, in place.

    NULL stays NULL and a bad geometry fails the job. The document and its coordinates are parsed in
    projections of their own, so each is parsed once per row. ``nesting`` allows for collections
    inside collections.
    """
    others = [c for c in frame.columns if c != geometry]
    parsed = frame.select(*others, geometry, F.expr(
        f"from_json(nullif(`{geometry}`, 'null'), '{PARSED}', {STRICT})").alias("_g"))
    split = parsed.select(
        *others, geometry, F.col("_g.type").alias("_kind"), F.col("_g.geometries").alias("_members"),
        *[F.expr(_coordinates("_g.type", "_g.coordinates", d)).alias(f"_c{d}") for d in (1, 2, 3, 4)])
    collection = (f"CASE WHEN _kind = 'GeometryCollection' THEN {_collection('_members', nesting)} "
                  f"ELSE {_bad(f'`{geometry}`')} END")
    text = _plain_wkt("_kind", {d: f"_c{d}" for d in (1, 2, 3, 4)}, collection)
    shown = split.select(*others, F.expr(
        f"CASE WHEN `{geometry}` IS NULL OR `{geometry}` = 'null' THEN NULL ELSE {text} END").alias("_wkt"))
    return shown.select(*[plain_numbers(F.col("_wkt")).alias(c) if c == geometry else F.col(c) for c in frame.columns])


ESRI_POINT = "x double, y double, Point struct<x:double,y:double>"


def esri_to_geojson(point: Column) -> Column:
    """A parsed Esri point, plain or under its kind, as a GeoJSON document; NULL for others."""
    x, y = F.coalesce(point["x"], point["Point"]["x"]), F.coalesce(point["y"], point["Point"]["y"])
    text = F.concat(F.lit('{"type":"Point","coordinates":['), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]}"))
    return F.when(x.isNotNull() & y.isNotNull(), text)


# --- helpers used inside tasks -------------------------------------------------------------------

def plain(number: float) -> str:
    """V15 for one Python float."""
    text = repr(float(number))
    if "e" in text:
        return np.format_float_positional(float(number), trim="-")
    return text[:-2] if text.endswith(".0") else text


def path_text(points) -> str:
    return "(" + ",".join(f"{plain(x)} {plain(y)}" for x, y in points) + ")"


# WKB geometry codes.
WKB_NAMES = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING",
             6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}


def _wkb_geometry(data: bytes, at: int) -> tuple[str, str, int]:
    """Name, body text and end offset of the geometry that starts at ``at``."""
    order = "<" if data[at] == 1 else ">"
    code, = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    if code & 0x20000000:  # EWKB: spatial reference id
        at += 4
    kind = code & 0x0FFFFFFF
    width = 2 + (code >> 31) + (code >> 30 & 1) + (0, 1, 1, 2)[kind // 1000]
    name = WKB_NAMES[kind % 1000]

    def count(at):
        return struct.unpack_from(order + "I", data, at)[0], at + 4

    def points(at, n):
        block = np.frombuffer(data, order + "f8", n * width, at).reshape(n, width)
        return block[:, :2].tolist(), at + n * width * 8

    if name == "POINT":
        pair, at = points(at, 1)
        return name, path_text(pair), at
    total, at = count(at)
    parts = []
    if name == "LINESTRING":
        line, at = points(at, total)
        parts = [f"{plain(x)} {plain(y)}" for x, y in line]
    elif name == "POLYGON":
        for _ in range(total):
            n, at = count(at)
            ring, at = points(at, n)
            parts.append(path_text(ring))
    else:
        for _ in range(total):
            inner, body, at = _wkb_geometry(data, at)
            parts.append(inner + body if name == "GEOMETRYCOLLECTION" else body)
    return name, f"({','.join(parts)})" if parts else " EMPTY", at


@F.pandas_udf(StringType())
def wkb_wkt(data: pd.Series) -> pd.Series:
    """V6: WKB (or EWKB) to WKT."""
    def one(value):
        if value is None:
            return None
        name, body, _ = _wkb_geometry(bytes(value), 0)
        return name + body

    return data.map(one, na_action="ignore")
