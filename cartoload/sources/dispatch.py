"""One entry for every source kind: options in, table name and typed DataFrame out."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cartoload.sources import (
    avro, delimited, featureservice, geojson, ipc, parquet, shapefile, workbook)
from cartoload.sources.base import Scan
from cartoload.sources.manifest import parse_options

SCANS = {
    "avro": avro.scan, "delimited": delimited.scan, "excel": workbook.scan, "geojson": geojson.scan,
    "ipc": ipc.scan, "parquet": parquet.scan, "shape": shapefile.scan,
    "feature_service": featureservice.scan,
}


def scan(spark: SparkSession, options: str | dict) -> Scan:
    kind, parsed = parse_options(options)
    return SCANS[kind](spark, parsed)


def infer_schema(spark: SparkSession, options: str | dict) -> tuple[str, list[tuple[str, str]]]:
    """Table name and ``(column, logical type)`` list of a source, without loading it."""
    found = scan(spark, options)
    return found.table_name, found.columns
