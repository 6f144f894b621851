import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cartoload.functions import values as v

L = F.lit


@pytest.mark.parametrize("text,out", [
    ("plain", "plain"), ("a,b", '"a,b"'), ('say "x"', '"say ""x"""'), ("a\nb", '"a\nb"'), ("a\rb", '"a\rb"'), (None, ""), ("", "")])
def test_csv_value(one, text, out):
    assert one(v.csv_value(L(text).cast("string"))) == out


def test_csv_line_escapes_the_first_value(one):
    assert one(v.csv_line([L("a,b"), L("c"), L(None).cast("string")])) == '"a,b",c,'


@pytest.mark.parametrize("number,out", [
    (12.5, "12.5"), (29.526, "29.526"), (48.2356, "48.2356"), (25.0, "25"), (0.025698, "0.025698"), (3.5e-7, "0.00000035"),
    (1.2e22, "12000000000000000000000"), (1.2345678e7, "12345678"), (1.23456789e7, "12345678.9"), (-1.5e-5, "-0.000015"),
    (1e21, "1000000000000000000000"), (0.0, "0"), (-0.0, "-0"), (100.05, "100.05"), (1.0e8, "100000000"),
    (float("inf"), "inf"), (float("-inf"), "-inf"), (float("nan"), "NaN"), (-1.25e10, "-12500000000")])
def test_number_text(one, number, out):
    assert one(v.number_text(F.col("x")), "x double", (number,)) == out


def test_numbers_inside_text(one):
    assert one(v.plain_numbers(L("POINT(1.0E-5 2.0)"))) == "POINT(0.00001 2)"
    assert one(v.plain_numbers(L("LINESTRING(1.0 2.05,-3.0E10 4.5)"))) == "LINESTRING(1 2.05,-30000000000 4.5)"


def test_workbook_text(one):
    cell = lambda kind, raw: one(v.workbook_text(L(kind).cast("string"), L(raw)))
    assert cell("n", "25") == "25"
    assert cell("n", "0.025698") == "0.025698"
    assert cell("s", "This is a test") == "This is a test"
    assert cell("s", "a_x000d_b") == "a\nb"
    assert cell("s", "a_x000a_b") == "a\rb"
    assert cell("b", "1") == "true" and cell("b", "0") == "false"
    assert cell("d", str(25569 + 19287 + 0.83985)) == "2022-10-22 20:09:23"
    assert cell(None, None) == ""
    with pytest.raises(Exception, match="Cell error, #DIV/0!"):
        cell("e", "#DIV/0!")


def test_bytes(one):
    data = F.unhex(L("1A5560"))
    assert one(v.byte_array(data)) == [26, 85, 96]
    assert one(v.array_literal(v.byte_array(data))) == "{26,85,96}"
    assert one(v.array_literal(v.byte_array(F.unhex(L("FF"))))) == "{255}"
    assert one(v.array_literal(v.byte_array(F.unhex(L(""))))) == "{}"
    assert one(v.byte_array(L(None).cast("binary"))) is None


def test_json(one):
    texts = one(v.json_values(L('{"a":["This","is"],"b":true,"c":{"code":1, "test":true},"d":null,"e":12.5,"f":"x y"}')))
    assert texts == ['["This","is"]', "true", '{"code":1,"test":true}', None, "12.5", "x y"]
    assert one(v.tagged_json(L("string"), L("x"))) == '{"type":"string","value":"x"}'
    assert one(v.duration_json(F.unhex(L("0100000005000000E8030000")))) == '{"months":1,"days":5,"millis":1000}'


def test_epochs(one):
    assert one(v.epoch_date(L(10957))) == dt.date(2000, 1, 1)
    assert one(v.time_text(L(19805000), 1000)) == "05:30:05"
    assert one(v.time_text(L(19805000000), 1000000)) == "05:30:05"
    assert one(v.timestamp_text(v.epoch_timestamp(L(946704605000), 1000))) == "2000-01-01 05:30:05"
    assert one(v.timestamp_text(v.epoch_timestamp(L(-1500), 1000))) == "1969-12-31 23:59:59"
    with pytest.raises(Exception, match="to Time"):
        one(v.time_text(L(86400000), 1000))


def test_arrow_text(one):
    assert one(v.duration_text(L(20200), "ms")) == "20200 milisecond"
    assert one(v.duration_text(L(56), "us")) == "56 microsecond"
    assert one(v.duration_text(L(9865), "ns")) == "9.87 microsecond"
    assert one(v.duration_text(L(2675), "ns")) == "2.67 microsecond"
    moment = F.timestamp_millis(L(1666469363000)).cast("timestamp_ntz")
    assert one(v.zoned_text(moment, L("America/New_York"))) == "2022-10-22 20:09:23 EDT"


def test_service_values(one):
    assert one(v.service_value(L("1000"), L("esriFieldTypeDate"))) == "1970-01-01 00:00:01"
    assert one(v.service_value(L(None).cast("string"), L("esriFieldTypeDate"))) is None
    assert one(v.service_value(L("x"), L("esriFieldTypeString"))) == "x"
    with pytest.raises(Exception, match="only contain numbers"):
        one(v.service_value(L("text"), L("esriFieldTypeDate")))
    for kind in ("Blob", "Geometry", "Raster"):
        with pytest.raises(Exception, match="not supported"):
            one(v.service_value(L("x"), L(f"esriFieldType{kind}")))


def test_coded_names(one):
    domain = '{"type":"codedValue","name":"d","codedValues":[{"name":"One","code":1},{"name":"Two","code":"2"}]}'
    assert one(v.coded_names(L(domain))) == {"1": "One", "2": "Two"}
    assert one(v.coded_names(L('{"type":"range","name":"r","range":[1,2]}'))) is None


@pytest.mark.parametrize("text,kind,out", [
    ("5", "SmallInt", 5), ("", "Integer", None), ("12.5", "Number", Decimal("12.5")), ("$56.98", "Money", Decimal("56.98")),
    ("$1,234.50", "Money", Decimal("1234.50")), ("t", "Boolean", True), ("2000-01-01", "Date", dt.date(2000, 1, 1)),
    ("2000-01-01 13:06:57", "Timestamp", dt.datetime(2000, 1, 1, 13, 6, 57)), ("05:30:05", "Time", "05:30:05"),
    ("{1,2}", "SmallIntArray", [1, 2]), ("{}", "SmallIntArray", []), ('{"a":1}', "Json", '{"a":1}'),
    ("{A072B040-075F-4B4F-87BA-02E9E8A5622D}", "UUID", "{A072B040-075F-4B4F-87BA-02E9E8A5622D}"), ("", "Text", ""),
    ("20200 milisecond", "Interval", dt.timedelta(seconds=20.2)), ("56 microsecond", "Interval", dt.timedelta(microseconds=56))])
def test_typed(one, text, kind, out):
    assert one(v.typed(L(text), kind)) == out


@pytest.mark.parametrize("text,kind", [
    ("x", "Integer"), ("40000", "SmallInt"), ("1e40", "Number"), ("25:00:00", "Time"), ("zz", "UUID"), ("{", "Json"), ("x", "Date")])
def test_bad_text_fails(one, text, kind):
    with pytest.raises(Exception):
        one(v.typed(L(text), kind))


def test_text_of(one):
    assert one(v.text_of(L("2000-01-01").cast("date"), "Date")) == "2000-01-01"
    assert one(v.text_of(L("56.98").cast("decimal(19,2)"), "Money")) == "$56.98"
    assert one(v.text_of(L("12.500").cast("decimal(38,18)"), "Number")) == "12.5"
    assert one(v.text_of(L("100").cast("decimal(38,18)"), "Number")) == "100"
    assert one(v.text_of(F.make_dt_interval(secs=L(2.5)), "Interval")) == "2500000 microsecond"
    assert one(v.text_of(L(True), "Boolean")) == "true"
