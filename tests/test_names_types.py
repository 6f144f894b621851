import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartoload.functions import names, types

CLEANED = [
    ("FACILITY_ID", "facility_id"), ("A__B", "a__b"), ("a__b", "a_b"), ("Facility Name", "facility_name"),
    ("1st", "_1st"), ("shape data.shp.zip", "shape_data"), ("a.b\nc", "a_b_c"), ("Ünï", "_n_"), ("a-_-b", "a_b"),
    ("x" * 80, "x" * 80), ("ſx", "ſx"), ("K", "k"), ("A", "a"), ("9", "_9"),
]


@pytest.mark.parametrize("raw,cleaned", CLEANED)
def test_clean_name(raw, cleaned):
    assert names.clean_name(raw) == cleaned


def test_clean_identifier_agrees_with_the_driver_side(spark):
    rows = spark.createDataFrame([(raw,) for raw, _ in CLEANED], "n string")
    found = rows.select("n", names.clean_identifier(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in found} == dict(CLEANED)


def test_empty_names_fail(spark):
    with pytest.raises(ValueError, match="empty after cleaning"):
        names.clean_name(".csv")
    with pytest.raises(Exception, match="empty after cleaning"):
        spark.createDataFrame([(".csv",)], "n string").select(names.clean_identifier(F.col("n"))).collect()
    with pytest.raises(ValueError, match="collide"):
        names.clean_names(["a b", "A_B"])


def test_type_catalogue(spark):
    assert types.type_catalogue(spark).count() == 18
    assert types.SQL_TYPE["TimestampWithZone"] == "timestamp with time zone"


def test_arrow_types():
    pairs = [
        (pa.bool_(), "Boolean"), (pa.uint8(), "SmallInt"), (pa.int8(), "SmallInt"), (pa.uint16(), "Integer"),
        (pa.int16(), "Integer"), (pa.int32(), "BigInt"), (pa.uint32(), "BigInt"), (pa.int64(), "BigInt"),
        (pa.float32(), "Real"), (pa.float64(), "DoublePrecision"), (pa.string(), "Text"), (pa.date32(), "Date"),
        (pa.timestamp("us"), "TimestampWithZone"), (pa.timestamp("us", "UTC"), "Timestamp"),
        (pa.duration("ms"), "Interval"), (pa.time64("us"), "Time"), (pa.list_(pa.int8()), "Text"), (pa.null(), "Text"),
    ]
    assert [types.from_arrow(kind) for kind, _ in pairs] == [name for _, name in pairs]


def test_parquet_types():
    assert types.from_parquet("t", "TIMESTAMP", "INT64", True) == "Timestamp"
    assert types.from_parquet("t", "TIMESTAMP", "INT64", False) == "TimestampWithZone"
    assert types.from_parquet("geometry", "NONE", "BYTE_ARRAY") == "Geometry"
    assert types.from_parquet("other", "NONE", "BYTE_ARRAY") == "Text"
    assert types.from_parquet("d", "DECIMAL", "INT64") == "DoublePrecision"
    assert types.from_parquet("t", "NONE", "INT96") == "Timestamp"


def test_avro_types():
    assert types.from_avro("a", ["null", "int"]) == "Integer"
    assert types.from_avro("a", ["int", "string"]) == "Json"
    assert types.from_avro("a", {"type": "bytes", "logicalType": "decimal"}) == "SmallIntArray"
    assert types.from_avro("a", {"type": "string", "logicalType": "uuid"}) == "UUID"
    assert types.from_avro("a", {"type": "array", "items": "int"}) == "Json"
    with pytest.raises(ValueError, match="null schema"):
        types.from_avro("a", "null")


def test_service_types(one):
    assert one(types.from_service(F.lit("esriFieldTypeOID"))) == "Integer"
    assert one(types.from_service(F.lit("esriFieldTypeGlobalID"))) == "UUID"
    for kind in ("Blob", "Geometry", "Raster"):
        with pytest.raises(Exception, match="not supported"):
            one(types.from_service(F.lit(f"esriFieldType{kind}")))


@pytest.mark.parametrize("text,kind", [
    ("null", None), ("true", "Boolean"), ("12.5", "Number"), ("-1", "Number"), ('"x"', "Text"), ("[1]", "Json"), ("{}", "Json")])
def test_json_types(one, text, kind):
    assert one(types.from_json_text(F.lit(text))) == kind
