"""Value mapping between source values, typed columns and their text forms."""

from __future__ import annotations

from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cartoload.functions.types import SPARK_TYPE, UNSUPPORTED_SERVICE_TYPES

TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss"
UUID_PATTERN = r"^\{?[0-9A-Fa-f]{8}-?([0-9A-Fa-f]{4}-?){3}[0-9A-Fa-f]{12}\}?\z"
TIME_PATTERN = r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?\z"


# --- null, CSV text ------------------------------------------------------------------------------

def empty_to_null(text: Column) -> Column:
    """V1: every source but delimited text loads an empty string as NULL."""
    return F.nullif(text, F.lit(""))


def csv_value(text: Column) -> Column:
    """V2: quoted only where the text holds a quote, comma or line end; NULL is empty."""
    text = F.coalesce(text, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n\r]'), quoted).otherwise(text)


def csv_line(texts: list[Column]) -> Column:
    """V3 without the line end, which the text sink adds."""
    return F.concat_ws(",", *[csv_value(text) for text in texts])


# --- numbers, dates, times -----------------------------------------------------------------------

def number_text(number: Column) -> Column:
    """Shortest digits, no trailing ``.0`` and no exponent."""
    text = number.cast("string")
    return (
        F.when(text.endswith(".0"), F.substring(text, F.lit(1), F.length(text) - 2))
        .when(text.contains("E"), _plain(text))
        .when(text.endswith("Infinity"), F.replace(text, F.lit("Infinity"), F.lit("inf")))
        .otherwise(text)
    )


def plain_numbers(text: Column) -> Column:
    """V15 for every number in a text of numbers, blanks, commas and brackets."""
    pieces = F.split(text, r"(?<=[ ,(])|(?=[ ,)])")
    shown = F.transform(pieces, lambda t: F.when(t.rlike(r"[0-9]E-?[0-9]+$"), _plain(t)).otherwise(_bare(t)))
    return F.when(text.rlike(r"[0-9]E-?[0-9]"), F.array_join(shown, "")).otherwise(_bare(text))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"\.0(?![0-9])", "")


def _fewest_digits(text: Column) -> Column:
    """Java before 19 may show a large double with more digits than it needs, so the fewest that name
    the same number are looked for. A short text has no digit to spare."""
    shorter = [F.format_string(f"%.{places}E", text.cast("double")) for places in (14, 15, 16)]
    fewest = F.coalesce(*[F.when(t.cast("double") == text.cast("double"), t) for t in shorter], text)
    return F.when(F.length(text) < 17, text).otherwise(F.replace(fewest, F.lit("E+"), F.lit("E")))


def _plain(text: Column) -> Column:
    """``1.5E-7`` written out; the inner text is named once by a one-element ``transform``."""
    return F.transform(F.array(_fewest_digits(text)), _spread)[0]


def _spread(text: Column) -> Column:
    """The digits of an exponent form around the dot at its place."""
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    exponent = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).cast("int")
    digits = F.regexp_replace(F.regexp_replace(text, r"^-|\.|E.*$", ""), "0+$", "")
    size = F.length(digits)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    whole = F.concat(digits, F.repeat(F.lit("0"), exponent + 1 - size))
    split = F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."),
                     F.substring(digits, exponent + 2, size))
    return F.concat(sign, F.when(exponent < 0, small).when(size <= exponent + 1, whole).otherwise(split))


def timestamp_text(moment: Column) -> Column:
    return F.date_format(moment, TIMESTAMP_TEXT)


def epoch_date(days: Column) -> Column:
    """Days since the epoch."""
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))


def epoch_timestamp(ticks: Column, per_second: int) -> Column:
    """Ticks since the epoch as a UTC timestamp; the rest below a second is cut toward zero."""
    seconds = F.call_function("div", ticks, F.lit(per_second).cast("bigint"))
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def time_text(ticks: Column, per_second: int) -> Column:
    """Ticks since midnight as ``HH:mm:ss``; a value outside the day fails."""
    seconds = F.call_function("div", ticks.cast("bigint"), F.lit(per_second).cast("bigint"))
    failure = F.raise_error(F.format_string("Could not convert %s to Time", ticks.cast("string")))
    shown = F.date_format(F.timestamp_seconds(seconds), "HH:mm:ss")
    return F.when(ticks.isNull() | ((ticks >= 0) & (seconds < 86400)), shown).otherwise(failure)


def serial_timestamp(serial: Column) -> Column:
    """V8: workbook day serial, to the nearest second."""
    seconds = F.round((serial.cast("double") - F.lit(25569)) * F.lit(86400)).cast("bigint")
    return F.timestamp_seconds(seconds)


# --- workbook cells ------------------------------------------------------------------------------

def workbook_text(kind: Column, raw: Column) -> Column:
    """V8: ``kind`` is s(tring), n(umber), d(ate serial), b(oolean), e(rror) or NULL for empty.

    The two escapes are exchanged the way the golden values have it.
    """
    text = F.replace(F.replace(raw, F.lit("_x000d_"), F.lit("\n")), F.lit("_x000a_"), F.lit("\r"))
    failure = F.raise_error(F.format_string("Cell error, %s", raw))
    return (
        F.when(kind.isNull(), F.lit(""))
        .when(kind == "s", text)
        .when(kind == "d", timestamp_text(serial_timestamp(raw)))
        .when(kind == "b", F.when(raw.isin("1", "true"), "true").otherwise("false"))
        .when(kind == "e", failure)
        .otherwise(number_text(raw.cast("double")))
    )


# --- bytes and nested values ---------------------------------------------------------------------

def byte_array(data: Column) -> Column:
    """Bytes as unsigned small integers."""
    numbers = F.transform(
        F.sequence(F.lit(1), F.length(data)),
        lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("smallint"),
    )
    empty = F.array().cast("array<smallint>")
    return F.when(F.length(data) == 0, empty).when(data.isNotNull(), numbers)


def array_literal(numbers: Column) -> Column:
    """V11 text form: ``{26,85,96}``."""
    return F.concat(F.lit("{"), F.array_join(numbers.cast("array<string>"), ","), F.lit("}"))


def nested_json(value: Column) -> Column:
    """Record, map or array as compact JSON, nulls kept."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def tagged_json(kind: Column, text: Column) -> Column:
    """A union value as its kind and its text."""
    return F.to_json(F.struct(kind.alias("type"), F.coalesce(text, F.lit("")).alias("value")))


def _little_endian(digits: Column, start: int) -> Column:
    """Number from four bytes given as hex digits, lowest byte first."""
    swapped = F.concat(*[F.substring(digits, start + i, 2) for i in (6, 4, 2, 0)])
    return F.conv(swapped, 16, 10).cast("bigint")


def duration_json(data: Column) -> Column:
    """Three little-endian 32-bit numbers."""
    digits = F.hex(data)
    parts = F.struct(
        _little_endian(digits, 1).alias("months"),
        _little_endian(digits, 9).alias("days"),
        _little_endian(digits, 17).alias("millis"),
    )
    return F.when(data.isNotNull(), F.to_json(parts))


def json_values(properties: Column) -> Column:
    """V4: values of a JSON object in document order: null, number text, raw string, compact JSON."""
    return F.map_values(F.from_json(properties, "map<string,string>", {"mode": "FAILFAST"}))


# --- Arrow values --------------------------------------------------------------------------------

@F.pandas_udf(StringType())
def two_decimals(number: pd.Series) -> pd.Series:
    """Rounded on the exact binary value; ``format_string`` rounds the shortest decimal text."""
    return number.map("{:.2f}".format, na_action="ignore")


def duration_text(ticks: Column, unit: str) -> Column:
    """``ticks`` in us, ms or ns. The spelling of the millisecond unit is a fixed value."""
    if unit == "ns":
        return F.concat(two_decimals(ticks.cast("double") / 1000), F.lit(" microsecond"))
    return F.concat(ticks.cast("string"), F.lit({"us": " microsecond", "ms": " milisecond"}[unit]))


@F.pandas_udf(StringType())
def zone_abbreviation(moment: pd.Series, zone: pd.Series) -> pd.Series:
    """Abbreviation of the zone at a UTC wall-clock time; a handful of zones per batch at most."""
    out = pd.Series([None] * len(moment), dtype=object)
    for name in zone.dropna().unique():
        rows = (zone == name) & moment.notna()
        stamps = moment[rows].dt.tz_localize("UTC").dt.tz_convert(ZoneInfo(name))
        out[rows] = stamps.dt.strftime("%Z")
    return out


def zoned_text(moment: Column, zone: Column) -> Column:
    """The UTC clock followed by the local abbreviation of ``zone``."""
    moment = moment.cast("timestamp_ntz")
    return F.concat(timestamp_text(moment), F.lit(" "), zone_abbreviation(moment, zone))


# --- feature services ----------------------------------------------------------------------------

def service_value(value: Column, field_type: Column) -> Column:
    """Text of one attribute given its service field type."""
    short = F.regexp_replace(field_type, "^esriFieldType", "")
    unsupported = F.raise_error(F.format_string("%s type fields are not supported", short))
    not_number = F.raise_error(F.lit("Date fields should only contain numbers or null"))
    moment = timestamp_text(F.timestamp_millis(F.floor(value.cast("bigint") / 1000) * 1000))
    date = (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(value.rlike(r"^-?\d+$"), moment)
        .otherwise(not_number)
    )
    return (
        F.when(short.isin(UNSUPPORTED_SERVICE_TYPES), unsupported)
        .when(short == "Date", date)
        .otherwise(value)
    )


def coded_names(domain: Column) -> Column:
    """Code to name map of a coded-value domain document; NULL for other domains."""
    parsed = F.from_json(domain, "type string, codedValues array<struct<name:string,code:string>>")
    entries = F.transform(parsed["codedValues"], lambda v: F.struct(v["code"], v["name"]))
    return F.when(parsed["type"] == "codedValue", F.map_from_entries(entries))


# --- text to typed column ------------------------------------------------------------------------

def typed(text: Column, column_type: str) -> Column:
    """What loading text into a column of the logical type stores; bad text fails the job."""
    if column_type == "Text":
        return text
    text = empty_to_null(text)
    if column_type == "Money":
        bare = F.regexp_replace(text, r"[$,]", "")
        return bare.cast(SPARK_TYPE["Money"])
    if column_type in ("Time", "UUID"):
        pattern = TIME_PATTERN if column_type == "Time" else UUID_PATTERN
        failure = F.raise_error(F.format_string(f'invalid {column_type} "%s"', text))
        return F.when(text.isNull() | text.rlike(pattern), text).otherwise(failure)
    if column_type == "Json":
        failure = F.raise_error(F.format_string('invalid Json "%s"', text))
        return F.when(text.isNull() | F.try_parse_json(text).isNotNull(), text).otherwise(failure)
    if column_type == "SmallIntArray":
        inner = F.regexp_extract(text, r"^\{(.*)\}$", 1)
        empty = F.array().cast("array<smallint>")
        return F.when(inner == "", empty).otherwise(F.split(inner, ",").cast("array<smallint>"))
    if column_type == "Interval":
        count = F.regexp_extract(text, r"^(-?[0-9.]+) ", 1).cast("double")
        unit = F.when(text.contains("mili"), 1e-3).otherwise(1e-6)
        return F.when(text.isNotNull(), F.make_dt_interval(secs=(count * unit).cast("decimal(18,6)")))
    return text.cast(SPARK_TYPE[column_type])


def text_of(value: Column, column_type: str) -> Column:
    """Text form of a typed staging value, as the record line shows it."""
    if column_type in ("Real", "DoublePrecision"):
        return number_text(value)
    if column_type == "Number":
        return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if column_type == "Money":
        return F.concat(F.lit("$"), number_text(value.cast("double")))
    if column_type in ("Timestamp", "TimestampWithZone"):
        return timestamp_text(value)
    if column_type == "SmallIntArray":
        return array_literal(value)
    if column_type == "Interval":
        days, hours = F.extract(F.lit("DAY"), value), F.extract(F.lit("HOUR"), value)
        minutes, seconds = F.extract(F.lit("MINUTE"), value), F.extract(F.lit("SECOND"), value)
        micros = (((days * 24 + hours) * 60 + minutes) * 60 + seconds) * 1000000
        return F.concat(micros.cast("bigint").cast("string"), F.lit(" microsecond"))
    return value.cast("string")
