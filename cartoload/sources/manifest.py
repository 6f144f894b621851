"""Which source kind a set of options names, for one source or a whole manifest table."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension to source kind; matched case-sensitively.
EXTENSIONS = {
    "avro": "avro", "txt": "delimited", "csv": "delimited", "xlsx": "excel", "xls": "excel",
    "geojson": "geojson", "ipc": "ipc", "feather": "ipc", "parquet": "parquet", "shp": "shape",
}


def file_extension(path: Column) -> Column:
    """Text after the last dot of the last path step; NULL for none or for a leading dot only."""
    name = F.regexp_extract(F.rtrim(path, F.lit("/")), r"([^/]*)$", 1)
    return F.nullif(F.regexp_extract(name, r"^.+\.([^.]*)$", 1), F.lit(""))


def source_kind(url: Column, file_path: Column) -> Column:
    """Kind by options columns; NULL where no kind fits (the load job reports those)."""
    by_extension = F.try_element_at(
        F.create_map(*[F.lit(x) for p in EXTENSIONS.items() for x in p]), file_extension(file_path))
    return F.when(url.isNotNull(), F.lit("feature_service")).otherwise(by_extension)


def classify(options: Column) -> Column:
    """Kind by an options JSON document."""
    has_url = F.array_contains(F.json_object_keys(options), "url")
    file_path = F.get_json_object(options, "$.file_path")
    return source_kind(F.when(has_url, F.lit("url")), file_path)


def parse_options(options: str | dict) -> tuple[str, dict]:
    """``(kind, options)`` of one source, with the reason when the options are unusable."""
    if isinstance(options, str):
        options = json.loads(options)
    if not isinstance(options, dict):
        raise ValueError("Source data options must be an object")
    if "url" in options:
        return "feature_service", options
    path = options.get("file_path")
    if not isinstance(path, str):
        raise ValueError('Source data options must contain a string "file_path" property')
    name = path.rstrip("/").rsplit("/", 1)[-1]
    stem, dot, extension = name.rpartition(".")
    if not dot or not stem:
        raise ValueError(f'Could not extract a valid file extension for "file_path" property of "{path}"')
    if extension not in EXTENSIONS:
        raise ValueError(f'Could not extract a data loader for the extension, "{extension}"')
    return EXTENSIONS[extension], options
