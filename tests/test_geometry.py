import struct

import pytest
from pyspark.sql import functions as F

from cartoload.functions.geometry import ESRI_POINT, esri_to_geojson, geojson_to_wkt, plain, wkb_wkt

SHAPES = [
    ('{"type":"Point","coordinates":[459728.9375,4961124]}', "POINT(459728.9375 4961124)"),
    ('{"type":"Point","coordinates":[1,2,3]}', "POINT(1 2)"),
    ('{"type":"Point","coordinates":[0.0000001,-12345678.5]}', "POINT(0.0000001 -12345678.5)"),
    ('{"type":"LineString","coordinates":[[0,0],[1,1.5]]}', "LINESTRING(0 0,1 1.5)"),
    ('{"type":"LineString","coordinates":[]}', "LINESTRING EMPTY"),
    ('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}', "POLYGON((0 0,1 0,1 1,0 0))"),
    ('{"type":"MultiPoint","coordinates":[[0,0],[1,1]]}', "MULTIPOINT((0 0),(1 1))"),
    ('{"type":"MultiLineString","coordinates":[[[0,0],[1,1]],[[2,2],[3,3]]]}', "MULTILINESTRING((0 0,1 1),(2 2,3 3))"),
    ('{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]]]}', "MULTIPOLYGON(((0 0,1 0,1 1,0 0)))"),
    ('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]}]}', "GEOMETRYCOLLECTION(POINT(1 2))"),
    ('{"type":"GeometryCollection","geometries":[]}', "GEOMETRYCOLLECTION EMPTY"),
    (None, None), ("null", None),
]


def test_geojson_shapes(spark):
    rows = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(SHAPES)], "i int, g string")
    found = dict(geojson_to_wkt(rows, "g").collect())
    assert [found[i] for i in range(len(SHAPES))] == [wkt for _, wkt in SHAPES]


def test_nested_collection_on_request(spark):
    inner = '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]}]}'
    rows = spark.createDataFrame([(f'{{"type":"GeometryCollection","geometries":[{inner}]}}',)], "g string")
    assert geojson_to_wkt(rows, "g", nesting=1).first().g == "GEOMETRYCOLLECTION(GEOMETRYCOLLECTION(POINT(1 2)))"
    with pytest.raises(Exception, match="cannot read the geometry"):
        geojson_to_wkt(rows, "g").collect()


@pytest.mark.parametrize("bad", [
    '{"type":"Circle","coordinates":[1,2]}', '{"type":"Point","coordinates":[]}', '{"type":"Point","coordinates":["x",1]}'])
def test_bad_geometry_fails(spark, bad):
    with pytest.raises(Exception):
        geojson_to_wkt(spark.createDataFrame([(bad,)], "g string"), "g").collect()


def test_esri_points(one):
    shown = lambda text: one(esri_to_geojson(F.from_json(F.lit(text), ESRI_POINT)))
    assert shown('{"x":1.5,"y":2}') == '{"type":"Point","coordinates":[1.5,2.0]}'
    assert shown('{"Point":{"x":1,"y":2}}') == '{"type":"Point","coordinates":[1.0,2.0]}'
    assert shown('{"paths":[]}') is None


def point(x, y, order="<"):
    return struct.pack(order + "BIdd", order == "<", 1, x, y)


def test_wkb(spark):
    ring = struct.pack("<I8d", 4, 0, 0, 1, 0, 1, 1, 0, 0)
    polygon = struct.pack("<BII", 1, 3, 1) + ring
    cases = [
        (point(1, 2.5), "POINT(1 2.5)"), (point(1, 2.5, ">"), "POINT(1 2.5)"),
        (struct.pack("<BII4d", 1, 2, 2, 0, 0, 1, 1), "LINESTRING(0 0,1 1)"),
        (polygon, "POLYGON((0 0,1 0,1 1,0 0))"),
        (struct.pack("<BII", 1, 4, 2) + point(0, 0) + point(1, 1), "MULTIPOINT((0 0),(1 1))"),
        (struct.pack("<BII", 1, 6, 1) + polygon, "MULTIPOLYGON(((0 0,1 0,1 1,0 0)))"),
        (struct.pack("<BII", 1, 7, 1) + point(1, 2), "GEOMETRYCOLLECTION(POINT(1 2))"),
        (struct.pack("<BIddd", 1, 1001, 1, 2, 3), "POINT(1 2)"),
        (struct.pack("<BIIdd", 1, 0x20000001, 4326, 1, 2), "POINT(1 2)"),
        (struct.pack("<BII", 1, 2, 0), "LINESTRING EMPTY"),
        (None, None),
    ]
    rows = spark.createDataFrame([(i, data and bytearray(data)) for i, (data, _) in enumerate(cases)], "i int, g binary")
    found = dict(rows.select("i", wkb_wkt("g")).collect())
    assert [found[i] for i in range(len(cases))] == [wkt for _, wkt in cases]


def test_plain():
    assert [plain(x) for x in (1.0, 1.5, 1e-7, 1.2e22, -3e16)] == [
        "1", "1.5", "0.0000001", "12000000000000000000000", "-30000000000000000"]
