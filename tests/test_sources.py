import datetime as dt
import json
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cartoload.plans import sample_files as files
from cartoload.session import scratch
from cartoload.sources import avro, delimited, geojson, ipc, memo, parquet, shapefile, workbook
from cartoload.sources.dispatch import scan
from cartoload.sources.manifest import classify, parse_options

GOLDEN = """objectid Number, uniqueid Number, featurelabel Text, sitename Text, featurestatus Text, featureowner Text,
wwtp Text, locationdescription Text, address Text, ctu_name Text, co_name Text, zip Number, notes Text, gpsdate Text,
gpsaccuracy Text, gpsdatasource Text, gpsnorthing Number, gpseasting Number, yearopened Number, yearclosed Text,
datasource Text, datasourcedate Number, assetid Text, parentid Text, eamasseturl Text, majorwatershed Text,
secondarywatershed Text, created_user Text, created_date Number, last_edited_user Text, last_edited_date Number,
globalid Text, featurestatus_desc Text, featureowner_desc Text, wwtp_desc Text, ctu_name_desc Text, co_name_desc Text,
datasource_desc Text, geometry Geometry"""


def put(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


# --- dispatch ------------------------------------------------------------------------------------

@pytest.mark.parametrize("options,kind", [
    ({"url": "http://x/0", "file_path": "a.csv"}, "feature_service"), ({"file_path": "/a/b.csv"}, "delimited"),
    ({"file_path": "b.txt"}, "delimited"), ({"file_path": "b.xlsx"}, "excel"), ({"file_path": "b.xls"}, "excel"),
    ({"file_path": "b.geojson"}, "geojson"), ({"file_path": "b.ipc"}, "ipc"), ({"file_path": "b.feather"}, "ipc"),
    ({"file_path": "b.parquet"}, "parquet"), ({"file_path": "b.shp"}, "shape"), ({"file_path": "a.b.avro"}, "avro"),
    ({"file_path": "b.CSV"}, None), ({"file_path": "b"}, None), ({"file_path": ".csv"}, None), ({"file_path": 5}, None), ({}, None)])
def test_dispatch(one, options, kind):
    assert one(classify(F.lit(json.dumps(options)))) == (kind if options.get("file_path") != 5 else None)
    if kind:
        assert parse_options(json.dumps(options))[0] == kind
    else:
        with pytest.raises(ValueError):
            parse_options(options)


def test_options_must_be_an_object():
    with pytest.raises(ValueError, match="must be an object"):
        parse_options("[1]")


# --- delimited -----------------------------------------------------------------------------------

def test_delimited(spark, tmp_path):
    path = put(tmp_path, "ust data.csv", '﻿"Facility ID","Name, full",ZIP\r\n1,"","x\r\ny"\r\n,z,"q""u"\r\n" pad ",é,\r\n')
    for size in (7, None):
        found = delimited.scan(spark, {"file_path": path, "delimiter": ",", "qualified": True, "range_bytes": size})
        assert found.table_name == "ust_data"
        assert found.columns == [("facility_id", "Text"), ("name_full", "Text"), ("zip", "Text")]
        assert sorted(map(str, found.frame.collect())) == sorted(str(Row("facility_id", "name_full", "zip")(*r)) for r in [
            ("1", "", "x\ny"), (None, "z", 'q"u'), (" pad ", "é", None)])


def test_delimited_rows_of_other_width_fail(spark, tmp_path):
    for body in ("1\n", "1,2,3\n"):
        path = put(tmp_path, f"w{len(body)}.txt", "a,b\n" + body)
        with pytest.raises(Exception):
            delimited.scan(spark, {"file_path": path, "delimiter": ",", "qualified": False}).frame.collect()


@pytest.mark.parametrize("size", [1, 5, None])
def test_delimited_blank_lines_and_stray_quotes(spark, tmp_path, size):
    one = put(tmp_path, "one.csv", "a\nx\n\n  \n5\" and 6\"\n\n")
    rows = delimited.scan(spark, {"file_path": one, "delimiter": ",", "range_bytes": size}).frame.collect()
    assert sorted(str(r.a) for r in rows) == ["  ", '5" and 6"', "None", "None", "x"]
    two = put(tmp_path, "two.csv", "a,b\n1,2\n\n")
    with pytest.raises(Exception, match="blank"):
        delimited.scan(spark, {"file_path": two, "delimiter": ",", "range_bytes": size}).frame.collect()
    open_quote = put(tmp_path, "open.csv", 'a,b\n1,5" pipe\n2,3\n')
    with pytest.raises(Exception, match="not closed"):
        delimited.scan(spark, {"file_path": open_quote, "delimiter": ",", "range_bytes": size}).frame.collect()


def test_delimited_split_inside_quoted_values(spark, tmp_path):
    """Splits of a few bytes fall into the middle of values; the records must not notice."""
    values = ["plain", "two\nlines", 'say "x"', "", None, "a,b", "\n\n", "é" * 30 + "\n", '"\n"'] * 12
    cells = lambda v: "" if v is None else '"' + v.replace('"', '""') + '"'
    text = "id,name,rest\n" + "".join(f"{i},{cells(v)},r{i}\n" for i, v in enumerate(values))
    folder = tmp_path / "many.csv"
    folder.mkdir()
    put(folder, "one.csv", text)
    put(folder, "two.csv", text.replace("\n", "\r\n"))
    options = {"file_path": str(folder), "delimiter": ",", "qualified": True}
    for size in (64, 1000, None):
        found = delimited.scan(spark, {**options, "range_bytes": size}).frame
        assert sorted((int(r.id), str(r.name), r.rest) for r in found.collect()) == sorted(
            [(i, str(v), f"r{i}") for i, v in enumerate(values)] * 2)


@pytest.mark.parametrize("size", [3, None])
def test_delimited_odd_values(spark, tmp_path, size):
    text = 'a,b\n\x01,""\n"\x01\x02",\n"two\nlines","x ""y"""\n'
    rows = delimited.scan(spark, {"file_path": put(tmp_path, "o.csv", text), "delimiter": ",", "range_bytes": size}).frame.collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("\x01", ""), ("\x01\x02", None), ("two\nlines", 'x "y"')], key=str)
    stray = put(tmp_path, "s.csv", 'a,b\n1,x"y\nz"w\n2,fine\n')
    with pytest.raises(Exception, match="reaches over a line end"):
        delimited.scan(spark, {"file_path": stray, "delimiter": ",", "range_bytes": size}).frame.collect()
    lone = put(tmp_path, "r.csv", "a\nx\ry\n")
    with pytest.raises(Exception, match="carriage return"):
        delimited.scan(spark, {"file_path": lone, "delimiter": ",", "range_bytes": size}).frame.collect()


def test_colliding_headers_fail(spark, tmp_path):
    with pytest.raises(ValueError, match="collide"):
        delimited.scan(spark, {"file_path": put(tmp_path, "c.csv", "a b,a-b\n1,2\n"), "delimiter": ","})


# --- GeoJSON -------------------------------------------------------------------------------------

# Null in the first feature, and null in all of them.
OPEN_FIRST = {"zip", "gpsnorthing", "gpseasting", "yearopened", "datasourcedate", "address", "datasource"}
ALWAYS_NULL = {"notes", "gpsdate", "gpsaccuracy", "gpsdatasource", "yearclosed"}


@pytest.fixture
def gauges(tmp_path):
    """26 features with 38 properties in upper case: byte order mark, odd type, one feature per line."""
    def value(name, kind, i):
        if name in ALWAYS_NULL or (name in OPEN_FIRST and i == 0):
            return None
        if kind == "Number":
            return 876 + i if name == "objectid" else 1580921416000 + i
        return "" if name == "datasource_desc" else f"{name}, {i}"

    columns = [tuple(c.split()) for c in GOLDEN.replace("\n", " ").split(", ")][:-1]
    lines = [feature({n.upper(): value(n, k, i) for n, k in columns}, {"type": "Point", "coordinates": [459728.9375 + i, 4961124]})
             for i in range(26)]
    text = '\ufeff{\n"type": "Feature Collection",\n"features": [\n' + ",\n".join(lines) + "\n]\n}\n"
    return put(tmp_path, "rain gauges.geojson", text)


def test_geojson_columns(spark, gauges):
    found = geojson.scan(spark, {"file_path": gauges})
    assert found.table_name == "rain_gauges"
    assert found.columns == [tuple(c.split()) for c in GOLDEN.replace("\n", " ").split(", ")]
    assert found.frame.count() == 26
    first = found.frame.filter("objectid = 876").first()
    assert first.geometry == "POINT(459728.9375 4961124)" and first.datasource_desc is None and first.zip is None


def test_geojson_inferred_types(spark, gauges):
    found = geojson.scan(spark, {"file_path": gauges})
    inferred = geojson.infer(geojson.features(spark, gauges)).orderBy("position").collect()
    assert [c.column_type for c in inferred] == [kind for _, kind in found.columns]


@pytest.mark.parametrize("size", [61, 400, None])
def test_geojson_any_layout_any_cut(spark, tmp_path, size):
    """Strings with braces, quotes and backslashes; other keys first; several per line; over several lines."""
    texts = ['has {"type":"Feature", inside', 'end \\\\', 'a "quoted\\" ] } word', "é漢🎉", "", "\\\\\\\""]
    made = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [i, 0]}, "properties": {"A": i, "B": texts[i % len(texts)]}} for i in range(24)]
    shown = [json.dumps(f, ensure_ascii=i % 2 == 0, indent=2 if i % 3 == 0 else None) for i, f in enumerate(made)]
    shown[5] = json.dumps({"id": 5, **made[5]})
    texts = {
        "a": '{"type":"FeatureCollection","features":[' + ",".join(shown[:12]) + '],"crs":{"type":"name"}}',
        "b": '\ufeff{"crs":{"x":[{"y":"}"}]},\n"extra":[{"no":1}],"features" : [\n' + " ,\n".join(shown[12:20]) + '\n],"later":[{"no":2}]}\n',
        "c": "\n".join(json.dumps(f) for f in made[20:])}
    for name, text in texts.items():
        put(tmp_path, f"folder/{name}.geojson", text)
    found = geojson.scan(spark, {"file_path": str(tmp_path / "folder"), "range_bytes": size}).frame.collect()
    assert sorted((int(r.a), r.b or "", r.geometry) for r in found) == [(i, f["properties"]["B"], f"POINT({i} 0)") for i, f in enumerate(made)]


@pytest.mark.parametrize("text", [
    '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":null,"properties":{"A":1}}, 7 {"type":"Feature","geometry":null,"properties":{"A":2}}]}',
    '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":null,"properties":{"A":1}},{"type":"Feature","geom',
    '{"type":"FeatureCollection","features":[]}{"type":"Feature","geometry":null,"properties":{"A":1}}',
    '{"type":"Topology","properties":{}}'])
def test_geojson_left_over_text_fails(spark, tmp_path, text):
    with pytest.raises(Exception, match="feature"):
        geojson.scan(spark, {"file_path": put(tmp_path, "x.geojson", text)}).frame.collect()


def test_geojson_header_is_the_first_file(spark, tmp_path):
    put(tmp_path, "f/a.geojson", feature({"First": 1}))
    put(tmp_path, "f/b.geojson", "\n".join(feature({"Second": i}) for i in range(500)))
    assert [name for name, _ in geojson.scan(spark, {"file_path": str(tmp_path / "f")}).columns] == ["first", "geometry"]


def feature(properties, geometry=None):
    return json.dumps({"type": "Feature", "geometry": geometry, "properties": properties}, separators=(",", ":"))


def test_geojson_positions_and_missing_properties(spark, tmp_path):
    lines = [feature({"A": None, "B": {"x": [1, 2]}}), feature({"A": 1.5, "B": None}), feature(None),
             feature({"Z": "2", "B": [1]}, {"type": "Point", "coordinates": [1, 2]})]
    found = geojson.scan(spark, {"file_path": put(tmp_path, "p.geojson", "\n".join(lines) + "\n")})
    assert found.columns == [("a", "Number"), ("b", "Json"), ("geometry", "Geometry")]
    rows = sorted((str(r.a), r.b, r.geometry) for r in found.frame.collect())
    assert rows == [("1.500000000000000000", None, None), ("2.000000000000000000", "[1]", "POINT(1 2)"), ("None", '{"x":[1,2]}', None)]


def test_geojson_extra_property_fails(spark, tmp_path):
    path = put(tmp_path, "e.geojson", feature({"A": 1}) + "\n" + feature({"A": 1, "B": 2}) + "\n")
    with pytest.raises(Exception, match="2 properties but the first one has 1"):
        geojson.scan(spark, {"file_path": path}).frame.collect()
    with pytest.raises(Exception, match="was not found in the first feature"):
        geojson.infer(geojson.features(spark, path)).collect()


def test_geojson_without_features(spark, tmp_path):
    path = put(tmp_path, "n.geojson", '{"type":"FeatureCollection","features":[]}')
    assert geojson.infer(geojson.features(spark, path)).count() == 0
    assert geojson.scan(spark, {"file_path": path}).columns == []


# --- Parquet, Arrow ------------------------------------------------------------------------------

def test_parquet(spark, tmp_path):
    path = str(tmp_path / "wells.parquet")
    pq.write_table(pa.table({
        "OBJECTID": pa.array([1, 2], pa.int64()), "depth": pa.array([1.5, None]), "note": pa.array(["", "x"]),
        "seen": pa.array([dt.datetime(2020, 1, 1), None], pa.timestamp("us", "UTC")),
        "local": pa.array([dt.datetime(2020, 1, 1), None], pa.timestamp("us")),
        "price": pa.array([1, 2], pa.decimal128(9, 2)), "tags": pa.array([["a", None], None], pa.list_(pa.string())),
        "box": pa.array([{"w": 1, "h": None}, None], pa.struct([("w", pa.int32()), ("h", pa.int32())])),
        "geometry": pa.array([struct.pack("<BIdd", 1, 1, 1, 2), None], pa.binary()),
    }), path)
    found = parquet.scan(spark, {"file_path": path})
    assert dict(found.columns) == {
        "objectid": "BigInt", "depth": "DoublePrecision", "note": "Text", "seen": "Timestamp", "local": "TimestampWithZone",
        "price": "DoublePrecision", "tags": "Json", "box": "Json", "geometry": "Geometry"}
    one, two = found.frame.orderBy("objectid").collect()
    assert (one.note, one.tags, one.box, one.geometry, one.price) == (None, '["a",null]', '{"w":1,"h":null}', "POINT(1 2)", 1.0)
    assert (two.note, two.tags, two.box, two.geometry) == ("x", None, None, None)


def test_arrow_file(spark, tmp_path):
    path = str(tmp_path / "mixed data.feather")
    columns = {
        "small": pa.array([1, None] * 50, pa.uint8()), "big": pa.array(range(100), pa.uint64()), "i": pa.array(range(100), pa.int32()),
        "text": pa.array(["", "x"] * 50), "at": pa.array([dt.time(5, 30, 5)] * 100, pa.time64("us")),
        "took": pa.array([dt.timedelta(milliseconds=20200)] * 100, pa.duration("ms")),
        "zoned": pa.array([dt.datetime(2022, 10, 22, 20, 9, 23)] * 100, pa.timestamp("ms", "America/New_York")),
        "naive": pa.array([dt.datetime(2022, 10, 22, 20, 9, 23)] * 100, pa.timestamp("ns")),
        "day": pa.array([dt.date(2000, 1, 1)] * 100), "kind": pa.array(["a", "b"] * 50).dictionary_encode(),
        "ok": pa.array([True, False] * 50), "real": pa.array([1.5] * 100, pa.float32()),
    }
    data = pa.table(columns)
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, data.schema) as writer:
        writer.write_table(data, max_chunksize=10)
    found = ipc.scan(spark, {"file_path": path, "split_bytes": 4096})
    assert found.table_name == "mixed_data"
    assert [kind for _, kind in found.columns] == [
        "SmallInt", "BigInt", "BigInt", "Text", "Time", "Interval", "Timestamp", "TimestampWithZone", "Date", "Text", "Boolean", "Real"]
    rows = found.frame.orderBy("big").collect()
    assert len(rows) == 100 and found.frame.rdd.getNumPartitions() > 1
    assert (rows[0].small, rows[0].text, rows[1].text, rows[0].at, rows[0].took) == (1, None, "x", "05:30:05", dt.timedelta(seconds=20.2))
    assert (rows[0].naive, rows[0].day, rows[1].kind, rows[0].real) == (dt.datetime(2022, 10, 22, 20, 9, 23), dt.date(2000, 1, 1), "b", 1.5)


# --- Avro ----------------------------------------------------------------------------------------

def test_avro_kinds(spark, tmp_path):
    logical = lambda kind, name: {"type": kind, "logicalType": name}
    schema = {"type": "record", "name": "R", "namespace": "n.s", "fields": [
        {"name": n, "type": t} for n, t in [
            ("int", "int"), ("long", "long"), ("string", "string"), ("boolean", "boolean"), ("float", "float"), ("double", "double"),
            ("bytes", "bytes"), ("intarray", {"type": "array", "items": "int"}), ("map", {"type": "map", "values": "long"}),
            ("union", ["null", "string"]), ("enum", {"type": "enum", "name": "E", "symbols": ["X", "Y"]}),
            ("record", {"type": "record", "name": "Inner", "fields": [
                {"name": "a", "type": "int"}, {"name": "b", "type": ["null", "bytes"]}, {"name": "next", "type": ["null", "Inner"]}]}),
            ("fixed", {"type": "fixed", "name": "F2", "size": 2}), ("decimal", logical("bytes", "decimal")),
            ("uuid", logical("string", "uuid")), ("date", logical("int", "date")), ("time_millis", logical("int", "time-millis")),
            ("time_micros", logical("long", "time-micros")), ("timestamp_millis", logical("long", "timestamp-millis")),
            ("timestamp_micros", logical("long", "timestamp-micros")),
            ("duration", {"type": "fixed", "name": "D12", "size": 12, "logicalType": "duration"}),
            ("choice", ["string", "double", {"type": "array", "items": "int"}]), ("again", "E")]]}
    row = {
        "int": -5, "long": 2**40, "string": "s", "boolean": True, "float": 1.5, "double": 2.5, "bytes": b"\x1a\x55\x60",
        "intarray": [1, 2], "map": {"k": 7}, "union": "u", "enum": "Y",
        "record": {"a": 1, "b": b"\x01", "next": {"a": 2, "b": None, "next": None}}, "fixed": b"\xff\x00",
        "decimal": b"\x01", "uuid": str(uuid.UUID(int=5)), "date": 10957, "time_millis": 19805000, "time_micros": 19805000000,
        "timestamp_millis": 946704605000, "timestamp_micros": 946704605000000, "duration": struct.pack("<III", 1, 5, 1000),
        "choice": (1, 1e-7), "again": "X"}
    rows = [row, {**row, "union": None, "choice": (0, "q"), "string": ""}] + [{**row, "choice": (2, [i]), "int": i} for i in range(5000)]
    for codec in ("null", "deflate"):
        path = put(tmp_path, f"avro {codec}.avro", files.avro_bytes(schema, rows, codec, block_rows=50))
        found = avro.scan(spark, {"file_path": path, "split_bytes": 20000})
        assert found.frame.rdd.getNumPartitions() > 1
        assert [kind for _, kind in found.columns] == [
            "Integer", "BigInt", "Text", "Boolean", "Real", "DoublePrecision", "SmallIntArray", "Json", "Json", "Text", "Text", "Json",
            "SmallIntArray", "SmallIntArray", "UUID", "Date", "Time", "Time", "Timestamp", "Timestamp", "Json", "Json", "Text"]
        assert found.frame.count() == len(rows)
        assert found.frame.filter("int >= 0").agg(F.count_distinct("int"), F.sum("int")).first() == (5000, sum(range(5000)))
        got = found.frame.filter("int = -5 and union is not null").first()
        assert (got.long, got.bytes, got.intarray, got.map, got.enum, got.fixed, got.decimal, got.again) == (
            2**40, [26, 85, 96], "[1,2]", '{"k":7}', "Y", [255, 0], [1], "X")
        assert got.record == '{"a":1,"b":[1],"next":{"a":2,"b":null,"next":null}}'
        assert (got.date, got.time_millis, got.time_micros) == (dt.date(2000, 1, 1), "05:30:05", "05:30:05")
        assert got.timestamp_millis == got.timestamp_micros == dt.datetime(2000, 1, 1, 5, 30, 5)
        assert got.duration == '{"months":1,"days":5,"millis":1000}'
        assert got.choice == '{"type":"double","value":"0.0000001"}'
        none = found.frame.filter("int = -5 and union is null").first()
        assert (none.choice, none.string) == ('{"type":"string","value":"q"}', None)


def test_small_files_share_tasks(spark, tmp_path):
    folder = tmp_path / "many.avro"
    folder.mkdir()
    schema = {"type": "record", "name": "R", "fields": [{"name": "n", "type": "int"}]}
    for i in range(40):
        put(folder, f"{i}.avro", files.avro_bytes(schema, [{"n": i}]))
    frame = avro.scan(spark, {"file_path": str(folder), "split_bytes": 64 << 20}).frame
    assert frame.rdd.getNumPartitions() == 3 and sorted(r.n for r in frame.collect()) == list(range(40))


def test_avro_needs_a_record(spark, tmp_path):
    path = put(tmp_path, "s.avro", files.avro_bytes({"type": "array", "items": "int"}, [[1]]))
    with pytest.raises(Exception, match="not a record"):
        avro.scan(spark, {"file_path": path})


# --- shapefiles ----------------------------------------------------------------------------------

def write_shapes(folder, shapes, fields, rows, name="shape data"):
    for suffix, content in files.shapefile_bytes(shapes, fields, rows).items():
        put(folder, name + suffix, content)
    return str(folder / f"{name}.shp")


FIELDS = [("ITEM_ID", "C", 10, 0), ("AI_ID", "N", 10, 0), ("ACREAGE", "F", 12, 3), ("OPEN", "L", 1, 0), ("SIGNED", "D", 8, 0),
          ("N_INSP", "I", 4, 0), ("COST", "Y", 8, 0), ("STAMP", "T", 8, 0), ("RATIO", "B", 8, 0)]


def test_shapefile_values(spark, tmp_path):
    julian = 2440588 + 10957
    rows = [("é1", "5", "1.500", "T", "20000101", 7, 569800, (julian, 47217000), 0.25),
            ("", "", "***", "?", "", 0, 0, None, 0.0)]
    path = write_shapes(tmp_path, [files.point_record(1, 2.5), None], FIELDS, rows)
    found = shapefile.scan(spark, {"file_path": path})
    assert [kind for _, kind in found.columns] == [
        "Text", "Number", "Real", "Boolean", "Date", "Integer", "Money", "Timestamp", "DoublePrecision", "Geometry"]
    one, two = found.frame.orderBy(F.desc("n_insp")).collect()
    assert (one.item_id, int(one.ai_id), one.acreage, one.open, one.signed, str(one.cost)) == (
        "é1", 5, 1.5, True, dt.date(2000, 1, 1), "56.98")
    assert (one.stamp, one.ratio, one.geometry) == (dt.datetime(2000, 1, 1, 13, 6, 57), 0.25, "POINT(1 2.5)")
    assert (two.item_id, two.ai_id, two.acreage, two.open, two.signed, two.stamp, two.geometry) == (None,) * 7


def test_shapefile_splits_and_kinds(spark, tmp_path):
    square = [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]
    hole = [(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 0.5)]
    far = [(9, 9), (9, 10), (10, 10), (9, 9)]
    shapes = [files.parts_record(5, [square, hole, far]) if i % 2 else files.parts_record(3, [[(i, 0), (i, 1)], [(0, 0), (1, 1)]])
              for i in range(1000)]
    path = write_shapes(tmp_path, shapes, [("ID", "N", 8, 0)], [(i,) for i in range(1000)])
    frame = shapefile.scan(spark, {"file_path": path, "split_records": 90}).frame
    assert frame.rdd.getNumPartitions() == 12 and frame.select("id").distinct().count() == 1000
    found = {int(r.id): r.geometry for r in frame.filter("id in (4, 7)").collect()}
    assert found[4] == "MULTILINESTRING((4 0,4 1),(0 0,1 1))"
    assert found[7] == "MULTIPOLYGON(((0 0,0 2,2 2,2 0,0 0),(0.5 0.5,1 0.5,1 1,0.5 0.5)),((9 9,9 10,10 10,9 9)))"


def memo_file(version, texts, block=512):
    """``(suffix, contents, first block of each text)`` of a memo file."""
    head = bytearray(max(block, 512))
    if version == 0x8B:
        head[20:22] = block.to_bytes(2, "little")
    if version == 0x30:
        head[6:8] = block.to_bytes(2, "big")
    body, places = bytes(head), []
    for text in texts:
        places.append(len(body) // block)
        raw = text.encode()
        if version == 0x83:
            raw += b"\x1a\x1a"
        elif version == 0x8B:
            raw = b"\xff\xff\x08\x00" + (len(raw) + 8).to_bytes(4, "little") + raw
        else:
            raw = (1).to_bytes(4, "big") + len(raw).to_bytes(4, "big") + raw
        body += raw + b"\0" * (-len(raw) % block)
    return ".fpt" if version == 0x30 else ".dbt", body, places


@pytest.mark.parametrize("version, block, width", [(0x83, 512, 10), (0x8B, 1024, 10), (0x30, 64, 4)])
def test_memo_columns(spark, tmp_path, monkeypatch, version, block, width):
    texts = ["one", "", "é" * 70_000, "two\nlines", "x" * 511, "y" * 512, "z" * 513] + [f"memo {i}" * (i % 40) for i in range(300)]
    suffix, content, places = memo_file(version, texts, block)
    order = [(7 * i) % len(texts) for i in range(len(texts))] + [2] * 40 + [None, 0, 0]  # scattered, shared and missing
    cell = lambda k: ("" if width > 4 else 0) if k is None else (str(places[k]).rjust(10) if width > 4 else places[k])
    kind = "M" if width > 4 else "I"  # the writer packs four bytes for I; the letter is put right below
    path = write_shapes(tmp_path, [None] * len(order), [("N", "I", 4, 0), ("BODY", kind, width, 0), ("MORE", kind, width, 0)],
                        [(i, cell(k), cell(order[-1 - i])) for i, k in enumerate(order)], name="memos")
    table = bytearray((tmp_path / "memos.dbf").read_bytes())
    table[0], table[32 + 32 + 11], table[32 + 64 + 11] = version, ord("M"), ord("M")
    put(tmp_path, "memos.dbf", bytes(table))
    put(tmp_path, "memos" + suffix, content)
    found = shapefile.scan(spark, {"file_path": path, "split_records": 60})
    assert found.columns == [("n", "Integer"), ("body", "Text"), ("more", "Text"), ("geometry", "Geometry")]
    want = [None if k is None else texts[k] or None for k in order]
    rows = found.frame.orderBy("n").collect()
    assert [r.body for r in rows] == want and [r.more for r in rows] == want[::-1]
    # Memos of a batch are bounded by their bytes, each record's own counted, and near ones are read together.
    monkeypatch.setattr(memo, "HOLD_BYTES", 100_000)
    with memo.MemoFile(str(tmp_path / "memos.dbf"), version) as opened:
        blocks = np.array([places[k] if k is not None else 0 for k in order])
        runs = list(opened.texts(blocks))
    assert [t or None for _, _, run in runs for t in run.to_pylist()] == want and len(runs) > 15
    assert [a for a, _, _ in runs] == [0, *(b for _, b, _ in runs[:-1])] and runs[-1][1] == len(order)


def test_memo_reads_are_few(tmp_path):
    _, content, places = memo_file(0x8B, [f"memo {i}" for i in range(2000)])
    put(tmp_path, "m.dbt", content)
    with memo.MemoFile(str(tmp_path / "m.dbf"), 0x8B) as opened:
        asked, inner = [], opened.handle
        opened.handle = type("Counted", (), {"seek": inner.seek, "close": inner.close, "read": lambda _, n: asked.append(n) or inner.read(n)})()
        assert sum(len(run) for _, _, run in opened.texts(np.array(places))) == 2000
        assert len(asked) == 1


def test_memo_faults(tmp_path):
    with pytest.raises(FileNotFoundError, match="memo columns need"):
        memo.MemoFile(str(tmp_path / "none.dbf"), 0x8B)
    with pytest.raises(ValueError, match="version without memos"):
        memo.MemoFile(str(tmp_path / "none.dbf"), 3)
    _, content, places = memo_file(0x8B, ["a", "b"])
    put(tmp_path, "cut.dbt", content[:520])
    put(tmp_path, "wrong.dbt", content[:512] + b"\0" * 512)
    for name, block, says in (("cut", 9, "no block 9"), ("cut", 1, "ends within"), ("wrong", 1, "no memo at block 1")):
        with memo.MemoFile(str(tmp_path / f"{name}.dbf"), 0x8B) as opened, pytest.raises(ValueError, match=says):
            list(opened.texts(np.array([block])))


def test_nested_arrow_columns_are_json(spark, tmp_path):
    data = pa.table({"s": pa.array([{"a": 1, "b": "x"}, {"a": None, "b": None}, None]), "l": pa.array([[1, 2], [], None], pa.large_list(pa.uint8()))})
    path = str(tmp_path / "n.ipc")
    with pa.ipc.new_file(path, data.schema) as writer:
        writer.write_table(data)
    found = ipc.scan(spark, {"file_path": path})
    assert found.columns == [("s", "Text"), ("l", "Text")]
    assert [tuple(r) for r in found.frame.collect()] == [('{"a":1,"b":"x"}', "[1,2]"), ('{"a":null,"b":null}', "[]"), (None, None)]


def test_empty_shapefile_fails(spark, tmp_path):
    with pytest.raises(ValueError, match="first feature"):
        shapefile.scan(spark, {"file_path": write_shapes(tmp_path, [], [("ID", "N", 8, 0)], [])})


# --- workbooks -----------------------------------------------------------------------------------

def test_workbook(spark, tmp_path):
    rows = [["Incident #", "When", "Ok", "Note"], [25, ("d", 44856.83985), True, "a_x000d_b"], [0.025698, None, False, None],
            [None, None, None, None], ["x", 1.0, None, "<&>"]]
    path = put(tmp_path, "excel data.xlsx", files.workbook_bytes("tblUST", rows))
    found = workbook.scan(spark, {"file_path": path, "sheet_name": "tblUST"})
    assert found.table_name == "excel_data"
    assert found.columns == [("incident_", "Text"), ("when", "Text"), ("ok", "Text"), ("note", "Text")]
    assert [tuple(r) for r in found.frame.collect()] == [
        ("25", "2022-10-22 20:09:23", "true", "a\nb"), ("0.025698", None, "false", None), (None,) * 4, ("x", "1", None, "<&>")]


def test_workbook_failures(spark, tmp_path):
    with pytest.raises(ValueError, match="Could not find sheet"):
        workbook.scan(spark, {"file_path": put(tmp_path, "a.xlsx", files.workbook_bytes("A", [["x"]])), "sheet_name": "B"})
    bad = put(tmp_path, "b.xlsx", files.workbook_bytes("A", [["x"], [("e", "#DIV/0!")]]))
    with pytest.raises(Exception, match="Cell error, #DIV/0!"):
        workbook.scan(spark, {"file_path": bad, "sheet_name": "A"}).frame.collect()
    wide = put(tmp_path, "c.xlsx", files.workbook_bytes("A", [["x"], [1, 2]]))
    with pytest.raises(Exception, match="wider than"):
        workbook.scan(spark, {"file_path": wide, "sheet_name": "A"}).frame.collect()


def test_scan_by_options(spark, tmp_path):
    path = put(tmp_path, "d.csv", "a\n1\n")
    assert scan(spark, json.dumps({"file_path": path, "delimiter": ",", "qualified": True})).frame.count() == 1
    assert scratch(spark, "x") != scratch(spark, "x")


def test_first_file_without_bytes(spark, tmp_path):
    """A partition without rows leaves an empty file; the header is that of the first file with bytes."""
    folder = tmp_path / "names.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_bytes(b"")
    (folder / "part-1.csv").write_text("name\na\n\n")
    scan = delimited.scan(spark, {"file_path": str(folder), "delimiter": ","})
    assert scan.columns == [("name", "Text")] and sorted(r.name or "" for r in scan.frame.collect()) == ["", "a"]
    (folder / "part-1.csv").write_bytes(b"")
    with pytest.raises(ValueError, match="first line"):
        delimited.scan(spark, {"file_path": str(folder), "delimiter": ","})


def test_decimal_bytes_of_large_ids(spark, tmp_path):
    """Ids of more than two bytes, as larger tables have them."""
    from cartoload.plans import registry, scan_queries  # noqa: F401  (registers its queries)

    rows = [(k, "click", user, 1.5, "{}") for k, user in enumerate([0, 255, 256, 65535, 65536, 70000, 20_000_000])]
    spark.createDataFrame(rows, "event_id bigint, event_type string, user_id bigint, value double, props string").withColumn(
        "ts", F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    found = registry.QUERIES["avro_union_scan"](spark, str(tmp_path))
    assert sorted((r.event_id, r.amount) for r in found.collect()) == [(k, f"{{{user // 256},{user % 256}}}") for k, _, user, _, _ in rows]


def test_files_of_bounded_size(spark, monkeypatch):
    """A partition goes to several files, so that a sample writer never holds all of it."""
    import os
    from cartoload.plans import sample_files

    batch = pa.RecordBatch.from_pydict({"a": list(range(10_000))})
    tables = list(sample_files.chunks([batch, batch.slice(0, 0), batch], 16_000))
    assert sum(t.num_rows for t in tables) == 20_000 and max(t.nbytes for t in tables) <= 32_000
    assert pa.concat_tables(tables)["a"].to_pylist() == [*range(10_000)] * 2
    monkeypatch.setattr(sample_files, "FILE_BYTES", 16_000)
    path = sample_files.write_ipc(spark.range(20_000).coalesce(1).repartition(4), scratch(spark, "ipc") + "/t.ipc")
    assert len(os.listdir(path.removeprefix("file:"))) > 8


def test_rows_of_a_sheet_leave_the_tree():
    import io
    import tracemalloc
    from cartoload.plans import sample_files

    book = io.BytesIO(sample_files.workbook_bytes("S", [["a"], *([k] for k in range(60_000))]))
    tracemalloc.start()
    assert sum(1 for _ in workbook.sheet_rows(book, "S")) == 60_001
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000


def test_ranges_share_tasks(spark):
    from cartoload.sources import base, geojson

    cores = spark.sparkContext.defaultParallelism
    assert base.range_tasks(spark, [("a", 10 << 20)], 1 << 16) == cores
    assert base.range_tasks(spark, [("a", 100), ("b", 0)], 1 << 16) == 1
    assert base.range_tasks(spark, [("a", 6 << 30)], 1 << 16) == 385
    assert geojson.range_bytes(spark, 6 << 30) == delimited.LARGEST_RANGE == 2 << 20
