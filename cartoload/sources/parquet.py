"""Parquet, read by Spark's vectorised reader; the footer gives the logical types."""

from __future__ import annotations

import json

import pyarrow.parquet as pq
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartoload.files import first_file, open_input
from cartoload.functions.geometry import wkb_wkt
from cartoload.functions.names import table_name
from cartoload.functions.types import from_parquet
from cartoload.functions.values import empty_to_null, nested_json
from cartoload.sources.base import Scan, project, quoted


def footer_types(path: str) -> dict[str, str]:
    """Logical type per top-level column, from one footer."""
    with open_input(first_file(path, ".parquet")) as handle:
        reader = pq.ParquetFile(handle)
        arrow, parquet = reader.schema_arrow, reader.schema
        leaves = {parquet.column(i).path: parquet.column(i) for i in range(len(parquet))}
    found = {}
    for item in arrow:
        leaf = leaves.get(item.name)
        if leaf is None:
            found[item.name] = "Json"
            continue
        logical = leaf.logical_type.type
        utc = logical == "TIMESTAMP" and json.loads(leaf.logical_type.to_json())["isAdjustedToUTC"]
        found[item.name] = from_parquet(item.name, logical, leaf.physical_type, utc)
    return found


def _value(name: str, kind: T.DataType, column_type: str) -> Column:
    value = quoted(name)
    if column_type == "Geometry" and isinstance(kind, T.BinaryType):
        return wkb_wkt(value)
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return nested_json(value)
    if isinstance(kind, T.BinaryType):
        text = value.cast("string")
        return F.when(F.is_valid_utf8(text), text).otherwise(F.hex(value))
    if isinstance(kind, T.DecimalType):
        return value.cast("double")
    if isinstance(kind, T.StringType):
        return empty_to_null(value)
    return value


def scan(spark: SparkSession, options: dict) -> Scan:
    path = options["file_path"]
    types = footer_types(path)
    frame = spark.read.parquet(path)
    parts = [
        (item.name, types[item.name], _value(item.name, item.dataType, types[item.name]))
        for item in frame.schema.fields
    ]
    return Scan(table_name(path), project(frame, parts))
