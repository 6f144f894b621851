"""Queries over the source scans: a given table is written in the format and scanned back."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cartoload.files import resolve
from cartoload.functions.geometry import wkb_wkt
from cartoload.operators.rejects import with_found
from cartoload.operators.stage import stage, text_lines
from cartoload.plans import sample_files as files
from cartoload.plans.load_job import read_rejects, run_load, run_load_by_format
from cartoload.plans.registry import query, table
from cartoload.session import scratch
from cartoload.sources import (
    avro, delimited, featureservice, geojson, ipc, parquet, shapefile, workbook)
from cartoload.sources.manifest import classify

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


DOCUMENTS_SQL = """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, CASE WHEN lang <> 'fr' THEN lang END AS lang,
       CASE WHEN source = 'src0' THEN '' ELSE source END AS source
FROM documents"""


def document_csv(spark, folder):
    """Documents with quotes and line ends, NULL and empty text."""
    rows = table(spark, folder, "documents").select(
        "doc_id", "text", F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"),
        F.when(F.col("source") == "src0", "").otherwise(F.col("source")).alias("source"))
    return files.write_csv(rows, scratch(spark, "delimited") + "/documents.csv")


@query("delimited_scan", DOCUMENTS_SQL)
def delimited_scan(spark, folder):
    """S2 over values that hold line ends."""
    options = {"file_path": document_csv(spark, folder), "delimiter": ",", "qualified": True}
    return delimited.scan(spark, options).frame


@query("delimited_records_scan", DOCUMENTS_SQL)
def delimited_records_scan(spark, folder):
    """S2 in small ranges, most of which begin inside a value."""
    options = {"file_path": document_csv(spark, folder), "delimiter": ",", "range_bytes": 1 << 16}
    return delimited.scan(spark, options).frame


@query("delimited_blank_lines", """
SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus || o_orderkey END AS name FROM orders""")
def delimited_blank_lines(spark, folder):
    """S2 with one column: blank lines are rows without a value."""
    rows = table(spark, folder, "orders").select(
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.concat("o_orderstatus", "o_orderkey")).alias("value"))
    path = scratch(spark, "delimited") + "/names.csv"
    files.write_lines(rows, path, "name")
    return delimited.scan(spark, {"file_path": path, "delimiter": ","}).frame


@query("delimited_split_scan", """
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
       l_returnflag, strftime(l_shipdate, '%Y-%m-%d') AS shipped
FROM lineitem""")
def delimited_split_scan(spark, folder):
    """S2 over pipe-delimited text read in splits."""
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))
    path = scratch(spark, "delimited") + "/lineitem.txt"
    rows.write.csv(path, header=True, sep="|")
    options = {"file_path": path, "delimiter": "|", "qualified": False}
    return delimited.scan(spark, options).frame


def customer_features(spark, folder):
    """Customers as point features, one per line; the balance is missing for households."""
    customer = table(spark, folder, "customer")
    properties = F.to_json(F.struct(
        F.col("c_custkey").alias("CustKey"), F.col("c_name").alias("Name"),
        F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_acctbal")).alias("AcctBal"),
        (F.col("c_acctbal") > 0).alias("In Credit"),
        F.struct("c_nationkey", "c_mktsegment").alias("Home")), {"ignoreNullFields": "false"})
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("c_custkey", "c_nationkey").alias("coordinates")))
    return files.write_geojson_lines(properties, point, customer, scratch(spark, "geojson") + "/customer.geojson")


@query("geojson_scan", """
SELECT c_custkey AS custkey, c_name AS name, CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_acctbal END AS acctbal,
       c_acctbal > 0 AS in_credit,
       '{"c_nationkey":' || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS home,
       'POINT(' || c_custkey || ' ' || c_nationkey || ')' AS geometry
FROM customer""")
def geojson_scan(spark, folder):
    """S4, C7, C8, V4, V5."""
    frame = geojson.scan(spark, {"file_path": customer_features(spark, folder)}).frame
    return frame.withColumn("custkey", F.col("custkey").cast("bigint")).withColumn(
        "acctbal", F.col("acctbal").cast("double"))


@query("geojson_pieces", """
SELECT event_id, event_type, value, props AS props, 'POINT(' || event_id || ' ' || user_id || ')' AS geometry FROM events""")
def geojson_pieces(spark, folder):
    """S4 on features that follow each other without line ends."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("event_id", "user_id").alias("coordinates")).alias("geometry"),
        F.struct("event_id", "event_type", "value", "props").alias("properties"))
    path = scratch(spark, "geojson") + "/events.geojson"
    table(spark, folder, "events").select(F.to_json(feature).alias("value")).write.text(path, lineSep=",")
    frame = geojson.scan(spark, {"file_path": path}).frame
    return frame.withColumns({"event_id": F.col("event_id").cast("bigint"), "value": F.col("value").cast("double")})


@query("geojson_layouts", """
SELECT event_id, event_type, value, 'POINT(' || event_id || ' ' || user_id || ')' AS geometry FROM events""")
def geojson_layouts(spark, folder):
    """S4 on collections of mixed text layout: on the opening line, several per line, over lines, other key order."""
    kept = {"ignoreNullFields": "false"}
    properties = F.to_json(F.struct("event_id", "event_type", "value"), kept)
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("event_id", "user_id").alias("coordinates")))
    shapes = [
        ('{"type":"Feature","geometry":', point, ',"properties":', properties, "}"),
        ('{\n  "type" : "Feature",\n  "properties" : ', properties, ',\n  "geometry" :\n', point, "\n}"),
        ('{"id": "a \\"}]{ \\\\", "type": "Feature", "geometry": ', point, ', "properties": ', properties, " }"),
        ('{"properties":', properties, ',"bbox":[[1,2],[3]],"geometry":', point, ',"type":"Feature"}')]
    kind = F.col("event_id") % 4
    text = None
    for k, parts in enumerate(shapes):
        joined = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        text = F.when(kind == k, joined) if text is None else text.when(kind == k, joined)
    # Fifty events to a collection; their separators differ as well.
    events = table(spark, folder, "events").select(F.floor(F.col("event_id") / 50).alias("part"), F.struct("event_id", text.alias("text")).alias("f"))
    listed = events.groupBy("part").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["text"]).alias("f"))
    separator = F.when(F.col("part") % 2 == 0, ",").otherwise(" ,\n\n ")
    value = F.concat(F.lit('{"type":"FeatureCollection","crs":{"a":[{"b":1}]},"other":[{"c":2}], "features" : ['), F.array_join("f", "\u0001"), F.lit('],"bbox":[0]}'))
    path = scratch(spark, "geojson") + "/layouts.geojson"
    listed.select(F.replace(value, F.lit("\u0001"), separator).alias("value")).write.text(path)
    frame = geojson.scan(spark, {"file_path": path}).frame
    return frame.withColumns({"event_id": F.col("event_id").cast("bigint"), "value": F.col("value").cast("double")})


@query("geojson_infer", """
SELECT * FROM (VALUES (0, 'CustKey', 'Number'), (1, 'Name', 'Text'), (2, 'AcctBal', 'Number'),
  (3, 'In Credit', 'Boolean'), (4, 'Home', 'Json'), (5, 'geometry', 'Geometry'))
  AS t("position", source_name, column_type)""")
def geojson_infer(spark, folder):
    """C8 over every feature."""
    return geojson.infer(geojson.features(spark, customer_features(spark, folder)))


@query("geojson_shapes", """
WITH c AS (SELECT *, c_custkey AS x, c_nationkey AS y FROM customer)
SELECT c_custkey AS id, CASE c_mktsegment
  WHEN 'AUTOMOBILE' THEN format('LINESTRING({} {},{} {})', x, y, x + 1, y + 2)
  WHEN 'BUILDING' THEN format('POLYGON(({} {},{} {},{} {},{} {}))', x, y, x + 1, y, x + 1, y + 1, x, y)
  WHEN 'FURNITURE' THEN format('MULTIPOINT(({} {}),({} {}))', x, y, x + 1, y + 2)
  WHEN 'HOUSEHOLD' THEN format('MULTIPOLYGON((({} {},{} {},{} {},{} {})))', x, y, x + 1, y, x + 1, y + 1, x, y)
  ELSE format('GEOMETRYCOLLECTION(POINT({} {}),LINESTRING({} {},{} {}))', x, y, x, y, x + 1, y + 2) END AS geometry
FROM c""")
def geojson_shapes(spark, folder):
    """V5 for every geometry kind but the plain point."""
    x, y = F.col("c_custkey"), F.col("c_nationkey")
    at = lambda dx, dy: F.array(x + dx, y + dy)
    json = lambda v: F.to_json(v)
    shape = lambda kind, coordinates: F.concat(
        F.lit(f'{{"type":"{kind}","coordinates":'), json(coordinates), F.lit("}"))
    line = F.array(at(0, 0), at(1, 2))
    ring = F.array(F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 0)))
    collection = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), shape("Point", at(0, 0)),
                          F.lit(","), shape("LineString", line), F.lit("]}"))
    geometry = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", shape("LineString", line))
        .when(F.col("c_mktsegment") == "BUILDING", shape("Polygon", ring))
        .when(F.col("c_mktsegment") == "FURNITURE", shape("MultiPoint", line))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", shape("MultiPolygon", F.array(ring)))
        .otherwise(collection)
    )
    customer = table(spark, folder, "customer")
    path = files.write_geojson_lines(
        F.to_json(F.struct(x.alias("id"))), geometry, customer, scratch(spark, "geojson") + "/shapes.geojson")
    frame = geojson.scan(spark, {"file_path": path}).frame
    return frame.select(F.col("id").cast("bigint").alias("id"), "geometry")


@query("parquet_stage", "SELECT * FROM lineitem")
def parquet_stage(spark, folder):
    """Staged and read back."""
    root = scratch(spark, "staging")
    source = parquet.scan(spark, {"file_path": f"{folder}/lineitem.parquet"})
    stage(spark, source, root)
    return spark.read.parquet(f"{root}/{source.table_name}")


# The given tables' columns under the Parquet type map.
COLUMN_TYPES = {
    "region": "r_regionkey Integer, r_name Text",
    "nation": "n_nationkey Integer, n_name Text, n_regionkey Integer",
    "customer": "c_custkey BigInt, c_name Text, c_nationkey Integer, c_acctbal DoublePrecision, c_mktsegment Text",
    "supplier": "s_suppkey BigInt, s_name Text, s_nationkey Integer, s_acctbal DoublePrecision",
    "part": "p_partkey BigInt, p_name Text, p_brand Text, p_type Text, p_size Integer, p_retailprice DoublePrecision",
    "orders": "o_orderkey BigInt, o_custkey BigInt, o_orderstatus Text, o_totalprice DoublePrecision, "
              "o_orderdate TimestampWithZone, o_orderpriority Text",
    "lineitem": "l_orderkey BigInt, l_partkey BigInt, l_suppkey BigInt, l_linenumber Integer, "
                "l_quantity DoublePrecision, l_extendedprice DoublePrecision, l_discount DoublePrecision, "
                "l_tax DoublePrecision, l_returnflag Text, l_linestatus Text, l_shipdate TimestampWithZone",
    "events": "event_id BigInt, ts TimestampWithZone, user_id BigInt, event_type Text, value DoublePrecision, props Text",
    "documents": "doc_id BigInt, text Text, lang Text, source Text, n_chars BigInt",
    "embeddings": "vec_id BigInt, embedding Json, label Integer",
    "pages": "page_id BigInt, url Text, html Text",
    "benchmark": "item_id BigInt, text Text",
    "labels": "doc_id BigInt, quality Integer, toxic Integer",
    "conversations": "conv_id BigInt, turn BigInt, role Text, text Text",
}


def _column_types_sql() -> str:
    parts = []
    for name, columns in COLUMN_TYPES.items():
        for i, entry in enumerate(columns.split(", ")):
            column, kind = entry.split(" ")
            parts.append(f"SELECT '{name}' AS table_name, {i} AS \"position\", '{column}' AS column_name, "
                         f"'{kind}' AS column_type, (SELECT count({column}) FROM {name}) AS filled")
    return " UNION ALL ".join(parts)


@query("column_types", _column_types_sql())
def column_types(spark, folder):
    """C3 for every given table, with the number of filled values per loaded column."""
    found = None
    for name in TABLES:
        source = parquet.scan(spark, {"file_path": f"{folder}/{name}.parquet"})
        counts = source.frame.agg(*[F.count(F.col(c)).alias(c) for c, _ in source.columns])
        listed = F.array(*[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(kind).alias("column_type"),
                     F.col(c).alias("filled"))
            for i, (c, kind) in enumerate(source.columns)])
        part = counts.select(F.lit(name).alias("table_name"), F.inline(listed))
        found = part if found is None else found.unionByName(part)
    return found


@query("ipc_scan", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, CAST(o_orderdate AS DATE) AS day,
       CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS o_orderpriority,
       o_orderstatus = 'F' AS finished
FROM orders""")
def ipc_scan(spark, folder):
    """Many record batches per file; an empty text loads as NULL."""
    rows = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        F.col("o_orderdate").cast("date").alias("day"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        (F.col("o_orderstatus") == "F").alias("finished"))
    path = files.write_ipc(rows, scratch(spark, "ipc") + "/orders.ipc")
    return ipc.scan(spark, {"file_path": path}).frame


PART_AVRO = {
    "type": "record", "name": "Part", "fields": [
        {"name": "p_partkey", "type": "long"},
        {"name": "p_name", "type": ["null", "string"]},
        {"name": "p_type", "type": {"type": "enum", "name": "Kind", "symbols": [
            "ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]}},
        {"name": "p_size", "type": "int"},
        {"name": "p_retailprice", "type": "double"},
        {"name": "raw", "type": "bytes"},
        {"name": "made", "type": {"type": "int", "logicalType": "date"}},
        {"name": "at", "type": {"type": "int", "logicalType": "time-millis"}},
        {"name": "stamped", "type": {"type": "long", "logicalType": "timestamp-millis"}},
        {"name": "words", "type": {"type": "array", "items": "string"}},
        {"name": "box", "type": {"type": "record", "name": "Box", "fields": [
            {"name": "brand", "type": "string"}, {"name": "size", "type": ["null", "int"]}]}},
    ],
}


@query("avro_scan", """
SELECT p_partkey, CASE WHEN p_size > 10 THEN p_name END AS p_name, p_type, p_size, p_retailprice,
       '{' || array_to_string(list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS VARCHAR)), ',') || '}' AS raw,
       CAST(DATE '1970-01-01' + CAST(p_partkey AS INTEGER) AS VARCHAR) AS made,
       strftime(TIMESTAMP '1970-01-01' + to_seconds(CAST(p_size AS BIGINT)), '%H:%M:%S') AS at,
       strftime(TIMESTAMP '1970-01-01' + to_seconds(p_partkey * 60), '%Y-%m-%d %H:%M:%S') AS stamped,
       '["' || replace(p_name, ' ', '","') || '"]' AS words,
       '{"brand":"' || p_brand || '","size":' || CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) ELSE 'null' END || '}' AS box
FROM part""")
def avro_scan(spark, folder):
    """S8, C5, V10, V11, V12, V14."""
    part = table(spark, folder, "part")
    rows = part.select(
        "p_partkey", F.when(F.col("p_size") > 10, F.col("p_name")).alias("p_name"), "p_type", "p_size",
        "p_retailprice", F.encode("p_name", "UTF-8").alias("raw"),
        F.col("p_partkey").cast("int").alias("made"), (F.col("p_size") * 1000 + 7).alias("at"),
        (F.col("p_partkey") * 60000 + 5).alias("stamped"), F.split("p_name", " ").alias("words"),
        F.struct(F.col("p_brand").alias("brand"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("size")).alias("box"))
    path = files.write_avro(rows, scratch(spark, "avro") + "/part.avro", PART_AVRO)
    frame = avro.scan(spark, {"file_path": path, "split_bytes": 1 << 16}).frame
    lines = {"raw": F.concat(F.lit("{"), F.array_join(F.col("raw").cast("array<string>"), ","), F.lit("}")),
             "made": F.col("made").cast("string"),
             "stamped": F.date_format("stamped", "yyyy-MM-dd HH:mm:ss")}
    return frame.withColumns(lines)


EVENT_AVRO = {
    "type": "record", "name": "Event", "fields": [
        {"name": "event_id", "type": "long"},
        {"name": "moment", "type": {"type": "long", "logicalType": "timestamp-micros"}},
        {"name": "clock", "type": {"type": "long", "logicalType": "time-micros"}},
        {"name": "choice", "type": ["null", "string", "long"]},
        {"name": "pairs", "type": {"type": "map", "values": "double"}},
        {"name": "amount", "type": {"type": "bytes", "logicalType": "decimal", "precision": 10}},
    ],
}


def _event_record(row: dict) -> dict:
    kind = row["event_type"]
    choice = (0, None) if kind == "error" else (1, kind) if kind == "click" else (2, row["user_id"])
    return {"event_id": row["event_id"], "moment": row["micros"], "clock": row["micros"] % 86_400_000_000,
            "choice": choice, "pairs": {kind: row["value"]}, "amount": row["user_id"].to_bytes(max(2, -(-row["user_id"].bit_length() // 8)), "big")}


@query("avro_union_scan", """
SELECT event_id, date_trunc('second', ts) AS moment, strftime(ts, '%H:%M:%S') AS clock,
       CASE event_type WHEN 'error' THEN '{"type":"null","value":""}'
            WHEN 'click' THEN '{"type":"string","value":"click"}'
            ELSE '{"type":"long","value":"' || user_id || '"}' END AS choice,
       '{"' || event_type || '":' || CAST(value AS VARCHAR) || '}' AS pairs,
       '{' || (user_id // 256) || ',' || (user_id % 256) || '}' AS amount
FROM events""")
def avro_union_scan(spark, folder):
    """S8, V11, V12, V13, V14."""
    def save(stem, data):
        rows = [_event_record(row) for row in data.to_pylist()]
        content = files.avro_bytes(EVENT_AVRO, rows)
        files.put_file(stem + ".avro", lambda sink: sink.write(content))

    events = table(spark, folder, "events").select(
        "event_id", "event_type", "user_id", "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    path = files.write_files(events, scratch(spark, "avro") + "/events.avro", ".avro", save)
    frame = avro.scan(spark, {"file_path": path}).frame
    # The last byte, and the number that the bytes before it make: of two bytes just these.
    ahead = F.aggregate(F.slice("amount", 1, F.size("amount") - 1), F.lit(0).cast("bigint"), lambda number, byte: number * 256 + byte)
    return frame.withColumn("amount", F.format_string("{%d,%d}", ahead, F.element_at("amount", -1)))


SUPPLIER_DBF = [("S_SUPPKEY", "N", 18, 0), ("S_NAME", "C", 40, 0), ("S_ACCTBAL", "N", 20, 2), ("OPEN", "L", 1, 0),
                ("SINCE", "D", 8, 0), ("S_NATION", "I", 4, 0)]


def supplier_shapes(spark, folder, shape):
    supplier = table(spark, folder, "supplier")
    rows = supplier.select(
        F.col("s_suppkey").alias("S_SUPPKEY"), F.col("s_name").alias("S_NAME"),
        F.format_string("%.2f", "s_acctbal").alias("S_ACCTBAL"),
        F.when(F.col("s_acctbal") > 0, "T").otherwise("F").alias("OPEN"),
        F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("s_nationkey")), "yyyyMMdd").alias("SINCE"),
        F.col("s_nationkey").alias("S_NATION"))
    return files.write_shapefile(rows, scratch(spark, "shape") + "/supplier.shp", SUPPLIER_DBF, shape)


SHAPE_SQL = """
SELECT s_suppkey, s_name, s_acctbal, s_acctbal > 0 AS "open",
       CAST(DATE '2000-01-01' + s_nationkey AS VARCHAR) AS since, s_nationkey AS s_nation, {geometry} AS geometry
FROM supplier"""


def _shape_columns(frame):
    return frame.withColumns({
        "s_suppkey": F.col("s_suppkey").cast("bigint"), "s_acctbal": F.col("s_acctbal").cast("double"),
        "since": F.col("since").cast("string")})


@query("shapefile_scan", SHAPE_SQL.format(geometry="'POINT(' || s_suppkey || ' ' || s_nationkey || '.5)'"))
def shapefile_scan(spark, folder):
    """S5, C6, V7, V9 for points."""
    point = files.point_record
    path = supplier_shapes(spark, folder, lambda row: point(row["S_SUPPKEY"], row["S_NATION"] + 0.5))
    return _shape_columns(shapefile.scan(spark, {"file_path": path, "split_records": 500}).frame)


@query("shapefile_polygons", SHAPE_SQL.format(geometry="""CASE WHEN s_acctbal > 0 THEN
  format('MULTIPOLYGON((({0} 0,{0} 9,{1} 9,{1} 0,{0} 0),({2} 1,{3} 1,{3} 2,{2} 1)))',
         s_suppkey, s_suppkey + 9, s_suppkey + 1, s_suppkey + 2) END"""))
def shapefile_polygons(spark, folder):
    """Polygons with a hole, and records without a shape."""
    parts = files.parts_record

    def shape(row):
        if float(row["S_ACCTBAL"]) <= 0:
            return None
        x = row["S_SUPPKEY"]
        outer = [(x, 0), (x, 9), (x + 9, 9), (x + 9, 0), (x, 0)]
        hole = [(x + 1, 1), (x + 2, 1), (x + 2, 2), (x + 1, 1)]
        return parts(5, [outer, hole])

    return _shape_columns(shapefile.scan(spark, {"file_path": supplier_shapes(spark, folder, shape)}).frame)


MEMO_DBF = [("DOC_ID", "N", 18, 0), ("LANG", "C", 8, 0), ("BODY", "M", 10, 0)]


def document_memos(spark, folder):
    """The documents as shapefiles with a memo column; documents of one text in a file share its memo."""
    rows = table(spark, folder, "documents").select(
        F.col("doc_id").alias("DOC_ID"), F.col("lang").alias("LANG"), F.coalesce("text", F.lit("")).alias("BODY"))
    path = scratch(spark, "memo") + "/documents.shp"

    def save(stem, data):
        held, places, size = [struct.pack("<I16xH", 0, 512).ljust(512, b"\0")], {"": ""}, 1
        for text in data["BODY"].to_pylist():
            if text not in places:
                raw = text.encode()
                block = b"\xff\xff\x08\x00" + struct.pack("<I", len(raw) + 8) + raw
                held.append(block + b"\0" * (-len(block) % 512))
                places[text], size = str(size), size + len(held[-1]) // 512
        cells = [(row["DOC_ID"], row["LANG"], places[row["BODY"]].rjust(10)) for row in data.to_pylist()]
        contents = files.shapefile_bytes([files.point_record(row[0], 0) for row in cells], MEMO_DBF, cells)
        contents = {".dbt": b"".join(held), ".dbf": b"\x8b" + contents[".dbf"][1:], ".shx": contents[".shx"], ".shp": contents[".shp"]}
        for suffix, content in contents.items():
            files.put_file(stem + suffix, lambda sink, c=content: sink.write(c))

    return files.write_files(rows, path, ".shp", save)


@query("shapefile_memos", """
SELECT doc_id, lang, nullif(text, '') AS body, 'POINT(' || doc_id || ' 0)' AS geometry FROM documents""")
def shapefile_memos(spark, folder):
    """Memo columns, whole texts read by their pointers into the memo file."""
    found = shapefile.scan(spark, {"file_path": document_memos(spark, folder), "split_records": 1000}).frame
    return found.withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query("workbook_scan", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus,
       regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
       CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS finished,
       CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS o_orderpriority
FROM orders""")
def workbook_scan(spark, folder):
    """S3, V8."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        (F.col("o_orderstatus") == "F").alias("finished"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("o_orderpriority"))
    path = files.write_workbooks(orders, scratch(spark, "workbook") + "/orders.xlsx", "Orders")
    return workbook.scan(spark, {"file_path": path, "sheet_name": "Orders"}).frame


@query("wkb_wkt", """
SELECT c_custkey, 'POINT(' || c_custkey || '.25 ' || c_nationkey || ')' AS geometry FROM customer""")
def wkb_to_wkt(spark, folder):
    """V6: WKB written from coordinates, then read as WKT."""
    def encode(batches):
        for frame in batches:
            points = [struct.pack("<BIdd", 1, 1, x + 0.25, y) for x, y in zip(frame.c_custkey, frame.c_nationkey)]
            yield pd.DataFrame({"c_custkey": frame.c_custkey.astype(np.int64), "geometry": points})

    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    coded = customer.mapInPandas(encode, "c_custkey bigint, geometry binary")
    return coded.select("c_custkey", wkb_wkt("geometry").alias("geometry"))


@query("classify_sources", """
WITH m AS (SELECT doc_id, CASE lang WHEN 'en' THEN source ELSE lower(source) END AS name,
  CASE source WHEN 'src0' THEN 'avro' WHEN 'src1' THEN 'txt' WHEN 'src2' THEN 'csv' WHEN 'src3' THEN 'xlsx'
    WHEN 'src4' THEN 'xls' WHEN 'src5' THEN 'geojson' WHEN 'src6' THEN 'ipc' WHEN 'src7' THEN 'feather'
    WHEN 'src8' THEN 'parquet' WHEN 'src9' THEN 'shp' WHEN 'src10' THEN 'CSV' ELSE source END AS ext,
  lang = 'de' AS has_url FROM documents)
SELECT doc_id, CASE WHEN has_url THEN 'feature_service' ELSE CASE ext WHEN 'avro' THEN 'avro' WHEN 'txt' THEN 'delimited'
  WHEN 'csv' THEN 'delimited' WHEN 'xlsx' THEN 'excel' WHEN 'xls' THEN 'excel' WHEN 'geojson' THEN 'geojson'
  WHEN 'ipc' THEN 'ipc' WHEN 'feather' THEN 'ipc' WHEN 'parquet' THEN 'parquet' WHEN 'shp' THEN 'shape' END END AS kind
FROM m""")
def classify_sources(spark, folder):
    """S1 over a manifest with one entry per document."""
    extensions = ["avro", "txt", "csv", "xlsx", "xls", "geojson", "ipc", "feather", "parquet", "shp", "CSV"]
    known = F.create_map(*[F.lit(x) for i, e in enumerate(extensions) for x in (f"src{i}", e)])
    path = F.concat(F.lit("/data/"), F.col("doc_id").cast("string"), F.lit("."),
                    F.coalesce(F.try_element_at(known, F.col("source")), F.col("source")))
    url = F.when(F.col("lang") == "de", F.concat(F.lit("http://gis.example.org/"), F.col("source")))
    options = F.to_json(F.struct(path.alias("file_path"), url.alias("url")))
    return table(spark, folder, "documents").select("doc_id", classify(options).alias("kind"))


@query("csv_lines", """
WITH v AS (SELECT CAST(doc_id AS VARCHAR) AS a,
  CASE WHEN regexp_matches(text, '[",\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS b,
  CASE WHEN lang <> 'fr' THEN lang ELSE '' END AS c, CAST(n_chars AS VARCHAR) AS d FROM documents)
SELECT a || ',' || b || ',' || c || ',' || d AS value FROM v""")
def csv_lines(spark, folder):
    """V1, V2, V3, K5: whole documents as load lines."""
    rows = table(spark, folder, "documents").select(
        "doc_id", "text", F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"), "n_chars")
    return text_lines(rows)


@query("load_job_report", """
SELECT * FROM (
  SELECT 1 AS sd_id, 'customer' AS table_name, count(*) AS rows, false AS failed FROM customer
  UNION ALL SELECT 2, 'orders', count(*), false FROM orders
  UNION ALL SELECT 3, 'nation', count(*), false FROM nation
  UNION ALL SELECT 4, 'part', count(*), false FROM part
  UNION ALL SELECT 5, 'supplier', count(*), false FROM supplier
  UNION ALL SELECT 6, NULL, NULL, true) t""")
def load_job_report(spark, folder):
    """Five sources of five kinds and one that cannot be loaded."""
    base = scratch(spark, "sources")
    orders = table(spark, folder, "orders")
    files.write_csv(orders, f"{base}/orders.csv")
    files.write_ipc(table(spark, folder, "nation"), f"{base}/nation.ipc")
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    files.write_avro(part, f"{base}/part.avro", {"type": "record", "name": "Part", "fields": [
        {"name": "p_partkey", "type": "long"}, {"name": "p_name", "type": "string"}]})
    shapes = supplier_shapes(spark, folder, lambda row: None)
    manifest = spark.createDataFrame([
        (1, f'{{"file_path":"{folder}/customer.parquet"}}'),
        (2, f'{{"file_path":"{base}/orders.csv","delimiter":",","qualified":true}}'),
        (3, f'{{"file_path":"{base}/nation.ipc"}}'),
        (4, f'{{"file_path":"{base}/part.avro"}}'),
        (5, f'{{"file_path":"{shapes}"}}'),
        (6, f'{{"file_path":"{base}/missing.parquet"}}'),
    ], "sd_id bigint, options string")
    report = run_load(spark, manifest, scratch(spark, "staging"))
    return report.select(F.col("sd_id").cast("int").alias("sd_id"), "table_name", "rows",
                         F.col("error").isNotNull().alias("failed"))


# --- loads with a reject channel --------------------------------------------------------------------

LINE_COLUMNS = [("l_orderkey", "BigInt"), ("l_linenumber", "SmallInt"), ("l_quantity", "Integer"), ("l_shipdate", "Date"), ("l_comment", "Text"), ("l_price", "Money")]


def faulty_lines(spark, folder):
    """Line items as text in two tables, some with cells that don't fit; where those are, the keys are part of the text."""
    lines = table(spark, folder, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    texts = lines.select(
        "l_returnflag", F.col("l_orderkey").cast("string").alias("l_orderkey"), F.col("l_linenumber").cast("string").alias("l_linenumber"),
        F.when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("q"), key)).when(F.col("l_partkey") % 7 == 1, F.concat(F.lit("9"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0")))
        .otherwise(F.col("l_quantity").cast("int").cast("string")).alias("l_quantity"),
        F.when(F.col("l_suppkey") % 5 == 0, F.concat(F.lit("day "), key)).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("l_shipdate"),
        F.when(F.col("l_linestatus") == "O", F.lit("two\nlines")).otherwise(F.lit("")).alias("l_comment"),
        F.concat(F.lit("$"), F.col("l_extendedprice").cast("decimal(15,2)").cast("string")).alias("l_price"))
    base = scratch(spark, "lines")
    for flag, name in (("R", "returned"), ("N", "kept")):
        files.write_csv(texts.where(F.col("l_returnflag") == flag).drop("l_returnflag"), f"{base}/{name}.csv")
    columns = [{"name": n, "column_type": c} for n, c in LINE_COLUMNS]
    return spark.createDataFrame(
        [(k, f'{{"file_path":"{base}/{name}.csv","delimiter":","}}', columns) for k, name in ((1, "returned"), (2, "kept"))],
        "sd_id bigint, options string, columns array<struct<name:string,column_type:string>>")


FAULTS_SQL = """
WITH l AS (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS key FROM lineitem WHERE l_returnflag IN ('R', 'N')),
q AS (SELECT CASE l_returnflag WHEN 'R' THEN 'returned' ELSE 'kept' END AS target, *,
  CASE l_partkey % 7 WHEN 0 THEN 'q' || key WHEN 1 THEN '9' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') END AS bad_quantity,
  CASE WHEN l_suppkey % 5 = 0 THEN 'day ' || key END AS bad_day FROM l)"""


@query("reject_channel", FAULTS_SQL + """
SELECT target, CASE target WHEN 'returned' THEN 1 ELSE 2 END AS source, 'l_quantity' AS "column", bad_quantity AS text,
  CASE WHEN bad_quantity LIKE 'q%' THEN 'invalid Integer' ELSE 'out of range for Integer' END AS reason, true AS found FROM q WHERE bad_quantity IS NOT NULL
UNION ALL SELECT target, CASE target WHEN 'returned' THEN 1 ELSE 2 END, 'l_shipdate', bad_day, 'invalid Date', true FROM q WHERE bad_day IS NOT NULL""")
def reject_channel(spark, folder):
    """Every cell that doesn't fit, with its reason; ``found`` tells that the file has the text behind the offset."""
    rejects_root = scratch(spark, "rejects") + "/found"
    run_load_by_format(spark, faulty_lines(spark, folder), scratch(spark, "staging"), "keep", rejects_root)
    found = with_found(read_rejects(spark, rejects_root))
    return found.select("target", F.col("source").cast("int").alias("source"), "column", "text", "reason", "found")


@query("reject_staged", FAULTS_SQL + """
SELECT l_orderkey, CAST(l_linenumber AS SMALLINT) AS l_linenumber, CAST(l_quantity AS INTEGER) AS l_quantity, CAST(l_shipdate AS DATE) AS l_shipdate,
  CASE WHEN l_linestatus = 'O' THEN 'two' || chr(10) || 'lines' ELSE '' END AS l_comment, CAST(CAST(l_extendedprice AS DECIMAL(15, 2)) AS DOUBLE) AS l_price
FROM q WHERE bad_quantity IS NULL AND bad_day IS NULL""")
def reject_staged(spark, folder):
    """The rows of both tables whose cells all fit, as staged by the scan that also wrote the rejects."""
    root = scratch(spark, "staging")
    run_load_by_format(spark, faulty_lines(spark, folder), root, "keep")
    rows = spark.read.parquet(f"{root}/returned").unionByName(spark.read.parquet(f"{root}/kept"))
    return rows.withColumn("l_price", F.col("l_price").cast("double"))


@query("load_by_format", FAULTS_SQL + """, c AS (SELECT target, count(*) FILTER (bad_quantity IS NOT NULL OR bad_day IS NOT NULL) AS bad FROM q GROUP BY target)
SELECT CASE target WHEN 'returned' THEN 1 ELSE 2 END AS sd_id, target AS table_name, CAST(NULL AS BIGINT) AS rows, bad AS rejected, bad || ' rows do not fit their columns' AS error FROM c
UNION ALL SELECT 3, 'customer', count(*), 0, NULL FROM customer
UNION ALL SELECT 4, 'orders', count(*), 0, NULL FROM orders""")
def load_by_format(spark, folder):
    """Text sources of one shape in one job, refused as they have rejects, and Parquet sources beside them."""
    others = spark.createDataFrame([(k, f'{{"file_path":"{folder}/{name}.parquet"}}', None) for k, name in ((3, "customer"), (4, "orders"))],
                                   "sd_id bigint, options string, columns array<struct<name:string,column_type:string>>")
    report = run_load_by_format(spark, faulty_lines(spark, folder).union(others), scratch(spark, "staging"))
    return report.select(F.col("sd_id").cast("int").alias("sd_id"), "table_name", "rows", "rejected", "error")


# --- feature services ----------------------------------------------------------------------------

def customer_layers(spark, folder):
    """One layer per customer with orders: description, row count and id range.

    A layer without pagination gets a page as wide as its average id gap, so that it has about as
    many windows as rows.
    """
    orders = table(spark, folder, "orders")
    profile = featureservice.id_range(orders, "o_custkey", "o_orderkey")
    layers = profile.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    fields = F.lit(
        '[{"name":"OBJECTID","type":"esriFieldTypeOID"},{"name":"Name","type":"esriFieldTypeString"},'
        '{"name":"Placed","type":"esriFieldTypeDate"},{"name":"Shape","type":"esriFieldTypeGeometry"}]')
    segment = F.col("c_mktsegment")
    gap = F.floor((F.col("max_oid") - F.col("min_oid")) / F.col("count")) + 1
    page = F.when(segment.isin("BUILDING", "MACHINERY"), F.col("c_nationkey") + 1).otherwise(gap)
    metadata = F.concat(
        F.lit('{"name":"'), F.col("c_name"), F.lit('","maxRecordCount":'), page.cast("string"),
        F.lit(',"type":"'), F.when(segment == "BUILDING", "Table").otherwise("Feature Layer"),
        F.lit('","geometryType":"esriGeometryPoint","supportedQueryFormats":"'),
        F.when(segment == "FURNITURE", "JSON").otherwise("JSON, geoJSON, PBF"),
        F.lit('","advancedQueryCapabilities":{"supportsPagination":'),
        F.when(segment.isin("BUILDING", "MACHINERY"), "true").otherwise("false"),
        F.lit('},"fields":'), fields, F.lit("}"))
    documents = layers.select(
        F.concat(F.lit("http://gis.example.org/"), F.col("c_custkey").cast("string")).alias("url"),
        metadata.alias("metadata"), "count", "min_oid", "max_oid")
    return featureservice.describe(documents)


LAYERS_SQL = """
WITH profile AS (SELECT o_custkey, count(*) AS count, min(o_orderkey) AS min_oid, max(o_orderkey) AS max_oid
  FROM orders GROUP BY o_custkey),
layers AS (SELECT 'http://gis.example.org/' || c_custkey AS url, c_name AS name,
  CAST(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_nationkey + 1
    ELSE least((max_oid - min_oid) // count + 1, 10000) END AS INTEGER) AS page_size,
  c_mktsegment = 'BUILDING' AS is_table, c_mktsegment IN ('BUILDING', 'MACHINERY') AS paginated,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 'json' ELSE 'geojson' END AS query_format,
  count, min_oid, max_oid FROM profile JOIN customer ON o_custkey = c_custkey)"""


@query("layer_profile", LAYERS_SQL + """
SELECT url, name, page_size, is_table, paginated, query_format, 'OBJECTID' AS oid_field, count, min_oid, max_oid
FROM layers""")
def layer_profile(spark, folder):
    """S13, G7, S11 format choice."""
    return customer_layers(spark, folder).select(
        "url", "name", "page_size", "is_table", "paginated", "query_format", "oid_field", "count", "min_oid", "max_oid")


@query("page_plan", LAYERS_SQL + """,
pages AS (SELECT *, unnest(generate_series(0, CASE WHEN paginated THEN (count + page_size - 1) // page_size - 1
  ELSE (max_oid - min_oid) // page_size END)) AS page FROM layers)
SELECT url, page, url || '/query?' || CASE WHEN is_table THEN '' ELSE 'geometryType=esriGeometryPoint&outSR=4326&' END
  || 'f=' || query_format || CASE WHEN paginated THEN '&where=1%3D1' ELSE '' END
  || '&outFields=OBJECTID%2CName%2CPlaced&'
  || CASE WHEN paginated THEN 'resultOffset=' || (page * page_size) || '&resultRecordCount=' || page_size
     ELSE 'where=OBJECTID+%3E%3D+' || (min_oid + page * page_size) || '+and+OBJECTID+%3C%3D+'
       || (min_oid + page * page_size + page_size - 1) END AS query
FROM pages""")
def page_plan(spark, folder):
    """S10."""
    return featureservice.page_plan(customer_layers(spark, folder))


@query("layer_columns", LAYERS_SQL + """
SELECT url, c.pos AS "position", c.source_name, c.column_type FROM layers, (VALUES (0, 'OBJECTID', 'Integer'),
  (1, 'Name', 'Text'), (2, 'Placed', 'Timestamp'), (3, 'geometry', 'Geometry')) AS c(pos, source_name, column_type)
WHERE c.pos < 3 OR NOT is_table""")
def layer_columns(spark, folder):
    """C9, C10."""
    return featureservice.layer_columns(customer_layers(spark, folder))


EVENT_LAYER = "http://gis.example.org/events"
EVENT_PAGE = 100


def saved_event_pages(spark, folder):
    """Answers of a paged layer of all events, one row per query; a page holds at most 100 features."""
    events = table(spark, folder, "events")
    feature = F.struct(
        F.struct(
            F.col("event_id").alias("OBJECTID"), F.col("event_type").alias("Kind"),
            F.unix_millis(F.col("ts").cast("timestamp")).alias("Seen"),
            F.when(F.col("event_type") != "error", F.col("value")).alias("Value")).alias("attributes"),
        F.struct(F.col("user_id").alias("x"), F.col("value").alias("y")).alias("geometry"))
    page = F.call_function("div", F.col("event_id"), F.lit(EVENT_PAGE).cast("bigint"))
    bodies = events.groupBy(page.alias("page")).agg(F.collect_list(feature).alias("features")).select(
        "page", F.to_json(F.struct("features"), {"ignoreNullFields": "false"}).alias("body"))
    metadata = ('{"name":"Events","maxRecordCount":%d,"type":"Feature Layer","geometryType":"esriGeometryPoint",'
                '"supportedQueryFormats":"JSON","supportsPagination":true,"fields":['
                '{"name":"OBJECTID","type":"esriFieldTypeOID"},{"name":"Kind","type":"esriFieldTypeString"},'
                '{"name":"Seen","type":"esriFieldTypeDate"},{"name":"Value","type":"esriFieldTypeDouble"}]}' % EVENT_PAGE)
    lead = (f"{EVENT_LAYER}/query?geometryType=esriGeometryPoint&outSR=4326&f=json&where=1%3D1"
            "&outFields=OBJECTID%2CKind%2CSeen%2CValue&resultOffset=")
    answers = bodies.select(
        F.concat(F.lit(lead), (F.col("page") * EVENT_PAGE).cast("string"),
                 F.lit(f"&resultRecordCount={EVENT_PAGE}")).alias("query"), "body")
    about = spark.createDataFrame([(f"{EVENT_LAYER}?f=json", metadata)], "query string, body string")
    count = events.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit(f"{EVENT_LAYER}/query?where=1%3D1&returnCountOnly=true&f=json").alias("query"),
        F.to_json(F.struct("count")).alias("body"))
    path = scratch(spark, "pages") + "/answers"
    answers.unionByName(about).unionByName(count).write.parquet(path)
    return path


@query("feature_pages", """
SELECT CAST(event_id AS INTEGER) AS objectid, event_type AS kind, date_trunc('second', ts) AS seen,
       CASE WHEN event_type <> 'error' THEN value END AS value,
       'POINT(' || user_id || ' ' || regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') || ')' AS geometry
FROM events""")
def feature_pages(spark, folder):
    """S9, S11, S12 on saved answers, V19."""
    return featureservice.scan(spark, {"url": EVENT_LAYER, "saved_pages": saved_event_pages(spark, folder)}).frame


@query("id_windows", """
WITH ids AS (SELECT o_custkey % 50 AS layer, CASE WHEN o_orderkey % 997 = 0 THEN o_orderkey + 5000000000 ELSE o_orderkey END AS oid FROM orders),
placed AS (SELECT *, (row_number() OVER (PARTITION BY layer ORDER BY oid) - 1) // (10 + layer) AS page FROM (SELECT DISTINCT * FROM ids))
SELECT 'http://gis.example.org/' || layer AS url, page, 'http://gis.example.org/' || layer || '/query?f=json&outFields=OBJECTID&where=OBJECTID+%3E%3D+' || min(oid) || '+and+OBJECTID+%3C%3D+' || max(oid) AS query
FROM placed GROUP BY layer, page""")
def id_windows(spark, folder):
    """Windows of existing ids; a few ids lie five thousand millions further on."""
    layer = F.col("o_custkey") % 50
    far = F.when(F.col("o_orderkey") % 997 == 0, F.col("o_orderkey") + 5_000_000_000).otherwise(F.col("o_orderkey"))
    url = F.concat(F.lit("http://gis.example.org/"), layer.cast("string"))
    ids = table(spark, folder, "orders").select(url.alias("url"), far.alias("oid"))
    layers = table(spark, folder, "orders").select(url.alias("url"), (layer + 10).alias("page_size")).distinct().select(
        "*", F.lit(True).alias("is_table"), F.lit(None).cast("string").alias("geometry_type"), F.lit(False).alias("paginated"), F.lit("OBJECTID").alias("oid_field"),
        F.lit("json").alias("query_format"), F.array(F.struct(F.lit("OBJECTID").alias("name"))).alias("fields"))
    return featureservice.windowed_plan(layers, featureservice.id_windows(spark, ids, layers))


SHELF_PAGES = 100


def shelf_of(offset):
    """The folder of a page's answer in ``shelved``, by its offset."""
    return offset // (EVENT_PAGE * SHELF_PAGES)


def shelved(spark, saved):
    """Saved pages in folders of ``SHELF_PAGES``, so that a service finds an answer in a small file."""
    path = scratch(spark, "pages") + "/shelves"
    pages = spark.read.parquet(saved).where("query like '%resultOffset%'")
    shelf = F.expr(f"cast(regexp_extract(query, 'resultOffset=([0-9]+)', 1) as bigint) div {EVENT_PAGE * SHELF_PAGES}")
    pages.withColumn("shelf", shelf).repartition("shelf").write.partitionBy("shelf").parquet(path)
    return path


def busy_service(path: str):
    """A service over the answers of ``shelved`` that is busy the first two times that a page is asked."""
    asked: dict[str, int] = {}
    shelves: dict[int, dict[str, str]] = {}

    def ask(url: str):
        import pyarrow.parquet

        asked[url] = asked.get(url, 0) + 1
        if asked[url] <= 2:
            return 503, None
        del asked[url]
        shelf = shelf_of(int(url.split("resultOffset=")[1].split("&")[0]))
        if shelf not in shelves:
            while len(shelves) >= 8:
                del shelves[next(iter(shelves))]
            system, inner = resolve(path)
            rows = pyarrow.parquet.read_table(f"{inner}/shelf={shelf}", columns=["query", "body"], partitioning=None, filesystem=system)
            shelves[shelf] = dict(zip(rows["query"].to_pylist(), rows["body"].to_pylist()))
        return 200, shelves[shelf][url]

    return ask


@query("resumable_pages", """
SELECT (event_id // 100) * 100 AS first_id, count(*) AS features, CAST(3 AS INTEGER) AS tries, CAST(0 AS BIGINT) AS asked_again FROM events GROUP BY event_id // 100""")
def resumable_pages(spark, folder):
    """Pages of a service that is busy at first, with the tries of each; a second run asks for nothing."""
    saved, kept = saved_event_pages(spark, folder), scratch(spark, "ledger") + "/pages"
    shelves = shelved(spark, saved)
    queries = spark.read.parquet(saved).where("query like '%resultOffset%'").select("query")
    # The first run has half of the pages, the second one all of them, the third none to ask for.
    for part in (queries.where(F.xxhash64("query") % 2 == 0), queries):
        featureservice.ledger_fetcher(kept, 4, wave=100, ask=busy_service(shelves))(part)
    before = featureservice.ledger(spark, kept).count()
    featureservice.ledger_fetcher(kept, 4, wave=100, ask=busy_service(shelves))(queries)
    again = featureservice.ledger(spark, kept).count() - before
    features = F.size(F.from_json("body", "features array<struct<attributes:string>>")["features"]).cast("bigint")
    first = F.regexp_extract("query", "resultOffset=([0-9]+)", 1).cast("bigint")
    return featureservice.ledger(spark, kept).select(first.alias("first_id"), features.alias("features"), "tries", F.lit(again).cast("bigint").alias("asked_again"))
