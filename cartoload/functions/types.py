"""The logical column types and the maps from each source's own types onto them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Logical type, SQL name, Spark type.
COLUMN_TYPES = [
    ("Text", "text", T.StringType()),
    ("Boolean", "boolean", T.BooleanType()),
    ("SmallInt", "smallint", T.ShortType()),
    ("Integer", "integer", T.IntegerType()),
    ("BigInt", "bigint", T.LongType()),
    ("Number", "numeric", T.DecimalType(38, 18)),
    ("Real", "real", T.FloatType()),
    ("DoublePrecision", "double precision", T.DoubleType()),
    ("Money", "money", T.DecimalType(19, 2)),
    ("Timestamp", "timestamp without time zone", T.TimestampNTZType()),
    ("TimestampWithZone", "timestamp with time zone", T.TimestampType()),
    ("Date", "date", T.DateType()),
    ("Time", "time", T.StringType()),
    ("Interval", "interval", T.DayTimeIntervalType()),
    ("Geometry", "geometry", T.StringType()),
    ("Json", "jsonb", T.StringType()),
    ("UUID", "uuid", T.StringType()),
    ("SmallIntArray", "smallint[]", T.ArrayType(T.ShortType())),
]
TYPE_NAMES = [name for name, _, _ in COLUMN_TYPES]
SQL_TYPE = {name: sql for name, sql, _ in COLUMN_TYPES}
SPARK_TYPE = {name: spark for name, _, spark in COLUMN_TYPES}


def type_catalogue(spark: SparkSession) -> DataFrame:
    rows = [(name, sql, kind.simpleString()) for name, sql, kind in COLUMN_TYPES]
    return spark.createDataFrame(rows, "column_type string, sql_name string, spark_type string")


def _lookup(key: Column, pairs: dict[str, str]) -> Column:
    """The value for ``key``, NULL where there is none."""
    return F.try_element_at(F.create_map(*[F.lit(text) for pair in pairs.items() for text in pair]), key)


def sql_type_name(column_type: Column) -> Column:
    """SQL name of a logical type; an unknown type fails the job."""
    unknown = F.raise_error(F.format_string('unknown column type "%s"', column_type))
    return F.coalesce(_lookup(column_type, SQL_TYPE), unknown)


def type_or_text(column_type: Column) -> Column:
    """C14: a column whose type never showed is Text."""
    return F.coalesce(column_type, F.lit("Text"))


def field(name: str, column_type: str, source_name: str | None = None) -> T.StructField:
    """A staging column that carries its logical type and the name it had in the source."""
    details = {"column_type": column_type, "source_name": source_name or name}
    return T.StructField(name, SPARK_TYPE[column_type], True, details)


def column_type_of(item: T.StructField) -> str:
    """Logical type of a DataFrame field: the carried one, else by its Spark type."""
    carried = (item.metadata or {}).get("column_type")
    if carried:
        return carried
    kind = item.dataType
    if isinstance(kind, T.DecimalType):
        return "Number"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "Json"
    if isinstance(kind, T.ArrayType):
        return "SmallIntArray" if kind.elementType == T.ShortType() else "Json"
    if isinstance(kind, T.BinaryType):
        return "Geometry" if item.name == "geometry" else "Text"
    if isinstance(kind, T.DayTimeIntervalType):
        return "Interval"
    for name, _, spark in COLUMN_TYPES:
        if spark == kind:
            return name
    return "Text"


def from_parquet(name: str, logical: str, physical: str, adjusted_to_utc: bool = False) -> str:
    """``logical`` and ``physical`` as Arrow spells them for a Parquet column.

    UTC-adjusted timestamps carry the label Timestamp and the others TimestampWithZone; the golden
    tables pin that label. Values keep their real Spark type.
    """
    by_logical = {
        "STRING": "Text", "ENUM": "Text", "MAP": "Json", "LIST": "Json", "BSON": "Json",
        "JSON": "Json", "DECIMAL": "DoublePrecision", "DATE": "Date", "TIME": "Time", "UUID": "UUID",
    }
    by_physical = {
        "BOOLEAN": "Boolean", "INT32": "Integer", "INT64": "BigInt", "INT96": "Timestamp",
        "FLOAT": "Real", "DOUBLE": "DoublePrecision", "FIXED_LEN_BYTE_ARRAY": "Text", "GROUP": "Json",
    }
    if logical == "TIMESTAMP":
        return "Timestamp" if adjusted_to_utc else "TimestampWithZone"
    if logical in by_logical:
        return by_logical[logical]
    if physical == "BYTE_ARRAY":
        return "Geometry" if name == "geometry" else "Text"
    return by_physical[physical]


def from_arrow(kind: pa.DataType) -> str:
    """C4."""
    if pa.types.is_timestamp(kind):
        return "TimestampWithZone" if kind.tz is None else "Timestamp"
    checks = [
        (pa.types.is_boolean, "Boolean"),
        (lambda k: k in (pa.int8(), pa.uint8()), "SmallInt"),
        (lambda k: k in (pa.int16(), pa.uint16()), "Integer"),
        (pa.types.is_integer, "BigInt"),
        (pa.types.is_float32, "Real"),
        (pa.types.is_float64, "DoublePrecision"),
        (pa.types.is_date, "Date"),
        (pa.types.is_duration, "Interval"),
        (pa.types.is_time, "Time"),
    ]
    return next((name for check, name in checks if check(kind)), "Text")


# Avro primitive and logical types.
AVRO_TYPES = {
    "null": "Text", "boolean": "Boolean", "int": "Integer", "long": "BigInt", "float": "Real",
    "double": "DoublePrecision", "bytes": "SmallIntArray", "string": "Text", "array": "Json",
    "map": "Json", "record": "Json", "enum": "Text", "fixed": "SmallIntArray",
    "decimal": "SmallIntArray", "uuid": "UUID", "date": "Date", "time-millis": "Time",
    "time-micros": "Time", "timestamp-millis": "Timestamp", "timestamp-micros": "Timestamp",
    "duration": "Json",
}


def avro_kind(schema) -> str:
    """Logical type where it is one of the known ones, else the plain type name."""
    if isinstance(schema, list):
        return "union"
    if isinstance(schema, str):
        return schema
    logical = schema.get("logicalType")
    if logical in AVRO_TYPES:
        return logical
    inner = schema["type"]
    return avro_kind(inner) if isinstance(inner, (dict, list)) else inner


def avro_nullable(schema) -> bool:
    """A union of at most two members, one of them null."""
    return isinstance(schema, list) and len(schema) <= 2 and "null" in map(avro_kind, schema)


def from_avro(name: str, schema) -> str:
    """C5."""
    kind = avro_kind(schema)
    if kind == "null":
        raise ValueError(f'Found a null schema for field "{name}"')
    if kind == "union":
        others = [member for member in schema if avro_kind(member) != "null"]
        return AVRO_TYPES[avro_kind(others[0])] if avro_nullable(schema) and others else "Json"
    return AVRO_TYPES[kind]


# DBF field letters.
DBF_TYPES = {
    "C": "Text", "M": "Text", "N": "Number", "L": "Boolean", "D": "Date", "F": "Real",
    "I": "Integer", "Y": "Money", "T": "Timestamp", "B": "DoublePrecision",
}

# Feature-service field types (C9) and the ones that cannot be loaded.
SERVICE_TYPES = {
    "Date": "Timestamp", "Double": "DoublePrecision", "GlobalID": "UUID", "GUID": "UUID",
    "Integer": "Integer", "OID": "Integer", "Single": "Real", "SmallInteger": "SmallInt",
    "String": "Text", "XML": "Text",
}
UNSUPPORTED_SERVICE_TYPES = ["Blob", "Geometry", "Raster"]


def from_service(field_type: Column) -> Column:
    """``esriFieldType*`` to logical type; Blob, Geometry, Raster and unknown types fail."""
    short = F.regexp_replace(field_type, "^esriFieldType", "")
    failure = F.raise_error(F.format_string("%s type fields are not supported", short))
    return F.coalesce(_lookup(short, SERVICE_TYPES), failure)


def from_json_text(value: Column) -> Column:
    """Type of one JSON value by its text; NULL (unknown) for null."""
    first = F.substring(F.ltrim(value), 1, 1)
    return (
        F.when(value.isNull() | (first == "n"), F.lit(None).cast("string"))
        .when(first == '"', F.lit("Text"))
        .when(first.isin("{", "["), F.lit("Json"))
        .when(first.isin("t", "f"), F.lit("Boolean"))
        .otherwise(F.lit("Number"))
    )
