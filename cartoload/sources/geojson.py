"""GeoJSON features, matched by property position, geometry as WKT last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartoload.files import list_files
from cartoload.functions.geometry import geojson_to_wkt
from cartoload.functions.names import table_name
from cartoload.functions.types import from_json_text, type_or_text
from cartoload.functions.values import empty_to_null, json_values, typed
from cartoload.sources import jsonranges
from cartoload.sources.base import Scan, project, quoted, split_bytes

STRICT = {"mode": "FAILFAST"}
LARGEST_RANGE = 2 << 20  # a task takes several ranges, one after the other


def features(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """One row per feature: ``place`` (its file and offset), and ``geometry`` and ``properties`` as JSON text.

    Features are found by their depth (``jsonranges``), so the text layout and the way a file is cut
    don't matter; ``size`` is the number of bytes per range. Features without properties are left out,
    as the load has no row for them; an object that is no feature fails.
    """
    files = list_files(path, ".geojson", ".json", ".txt")
    text = jsonranges.features(spark, files, size or range_bytes(spark, sum(n for _, n in files)))
    parsed = F.from_json("feature", "type string, geometry string, properties string", STRICT)
    wrong = F.raise_error(F.concat(F.lit("no feature: "), F.substring("feature", 1, 80)))
    whole = text.select("place", "feature", parsed.alias("f"))
    checked = whole.select("place", F.when(F.coalesce(F.col("f.type"), F.lit("")) == "Feature", F.col("f")).otherwise(wrong).alias("f"))
    return checked.select("place", "f.geometry", "f.properties").filter("properties is not null")


def range_bytes(spark: SparkSession, total: int) -> int:
    """Bytes per range: those of a file split, and no more than a task holds well in memory."""
    return min(split_bytes(spark, total), LARGEST_RANGE)


def _cells(feature_rows: DataFrame) -> DataFrame:
    """One row per property: feature number, position, name and type (NULL for a null value)."""
    variants = F.from_json("properties", "map<string,variant>", STRICT)
    zipped = F.arrays_zip(
        F.json_object_keys("properties").alias("name"),
        F.transform(F.map_values(variants), lambda v: F.to_json(v)).alias("value"),
    )
    numbered = feature_rows.select(F.col("place").alias("feature_ix"), zipped.alias("c"))
    return numbered.select("feature_ix", F.posexplode("c").alias("position", "cell")).select(
        "feature_ix", "position", F.col("cell.name").alias("source_name"),
        from_json_text(F.col("cell.value")).alias("kind"))


def _first_kind() -> Column:
    known = F.when(F.col("kind").isNotNull(), F.col("feature_ix"))
    return F.min_by("kind", known)


def infer(feature_rows: DataFrame) -> DataFrame:
    """``(position, source_name, column_type)``, geometry last; empty without features.

    Names come from the first feature. A type is that of the first non-null value at the position;
    a position that is null in every feature is Text. One pass with partial aggregation: the
    shuffled state is one row per position and task, however many features there are.
    """
    found = _cells(feature_rows).groupBy("position").agg(
        F.min_by("source_name", "feature_ix").alias("source_name"),
        F.min("feature_ix").alias("first_seen"),
        _first_kind().alias("kind"),
    )
    whole = Window.partitionBy(F.lit(1))  # one row per column of the table
    extra = F.raise_error(F.format_string(
        'Found column with index %d named "%s" that was not found in the first feature',
        F.col("position"), F.col("source_name")))
    late = F.col("first_seen") > F.min("first_seen").over(whole)
    columns = found.select(
        "position", F.when(late, extra).otherwise(F.col("source_name")).alias("source_name"),
        type_or_text(F.col("kind")).alias("column_type"),
        (F.max("position").over(whole) + 1).alias("size"))
    geometry = columns.filter("position = 0").select(
        F.col("size").alias("position"), F.lit("geometry").alias("source_name"),
        F.lit("Geometry").alias("column_type"))
    return columns.drop("size").unionByName(geometry)


def header(feature_rows: DataFrame) -> list[tuple[str, str]]:
    """``(source name, type)`` per property; later features are read only for types still open."""
    first = _cells(feature_rows.orderBy("place").limit(1)).orderBy("position").collect()
    open_positions = [c.position for c in first if c.kind is None]
    later = {}
    if open_positions:
        cells = _cells(feature_rows).filter(F.col("position").isin(open_positions))
        found = cells.filter("kind is not null").groupBy("position").agg(_first_kind().alias("kind"))
        later = dict(found.collect())  # at most one row per column
    return [(c.source_name, c.kind or later.get(c.position, "Text")) for c in first]


def scan(spark: SparkSession, options: dict) -> Scan:
    path = options["file_path"]
    rows = features(spark, path, options.get("range_bytes"))
    columns = header(rows)
    mismatch = F.raise_error(F.format_string(
        f"a feature has %d properties but the first one has {len(columns)}", F.size("v")))
    values = rows.select(json_values(F.col("properties")).alias("v"), "geometry").select(
        F.when(F.size("v") == len(columns), F.col("v")).otherwise(mismatch).alias("v"), "geometry")
    values = geojson_to_wkt(values, "geometry", int(options.get("nesting", 0)))
    parts = [
        (name, column_type, typed(empty_to_null(F.col("v")[i]), column_type))
        for i, (name, column_type) in enumerate(columns)
    ]
    if columns:
        parts.append(("geometry", "Geometry", quoted("geometry")))
    return Scan(table_name(path), project(values, parts))
