"""The reject channel of a load (V21, K3): cells that don't fit their column leave with place and reason.

A cell is tried, not cast: the row carries its typed values and a list of what was wrong with it, so
that one scan feeds the staging tables and the table of rejects (``sources.stagingsink``).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartoload.files import open_input
from cartoload.functions.types import SPARK_TYPE, field
from cartoload.functions.values import TIME_PATTERN, UUID_PATTERN, empty_to_null

REJECT = "struct<column:string,text:string,reason:string>"
#: Columns of the table of rejects.
REJECTS = "target string, source bigint, file string, offset bigint, column string, text string, reason string"
NUMERIC = ("SmallInt", "Integer", "BigInt", "Number", "Real", "Money")
ARRAY = r"^\{\s*(-?\d+\s*(,\s*-?\d+\s*)*)?\}\z"
INTERVAL = r"^-?\d+(\.\d+)? (microsecond|milisecond)\z"


#: Bytes of a file behind an offset that are searched, and read at once.
BEHIND, READ_BYTES = 200, 1 << 20


def with_found(rejects: DataFrame) -> DataFrame:
    """The rejects with ``found``: whether their file has the text in the ``BEHIND`` bytes behind the offset.

    Rejects lie in the order of their places, as the tasks wrote them, so that a read serves those that follow.
    """
    def look(batches):
        path, handle, first, held = None, None, 0, b""
        for batch in batches:
            found = []
            for file, offset, text in zip(*(batch.column(name).to_pylist() for name in ("file", "offset", "text"))):
                if file is None or offset is None or text is None:
                    found.append(None)
                    continue
                if file != path:
                    if handle:
                        handle.close()
                    path, handle, first, held = file, open_input(file), 0, b""
                at = offset - first
                if at < 0 or at + BEHIND > len(held):
                    handle.seek(offset)
                    first, held, at = offset, handle.read(READ_BYTES), 0
                found.append(text.encode() in held[at:at + BEHIND])
            yield batch.append_column("found", pa.array(found, pa.bool_()))
        if handle:
            handle.close()

    return rejects.mapInArrow(look, T.StructType([*rejects.schema.fields, T.StructField("found", T.BooleanType())]))


def attempt(text: Column, column_type: str) -> tuple[Column, Column]:
    """``(value, reason)``: the typed value of a cell, or null and why it doesn't fit.

    The value is that of ``values.typed`` where that doesn't fail. Reasons tell text that is no value of
    the type from numbers beyond its range.
    """
    if column_type == "Text":
        return text, F.lit(None).cast("string")
    text = empty_to_null(text)
    kind = SPARK_TYPE[column_type]
    if column_type in ("Time", "UUID"):
        value = F.when(text.rlike(TIME_PATTERN if column_type == "Time" else UUID_PATTERN), text)
    elif column_type == "Json":
        value = F.when(F.try_parse_json(text).isNotNull(), text)
    elif column_type == "SmallIntArray":
        inner = F.trim(F.regexp_extract(text, r"^\{(.*)\}\z", 1))
        items = F.when(inner == "", F.array().cast(T.ArrayType(T.StringType()))).otherwise(F.split(inner, ","))
        numbers = F.transform(items, lambda item: F.trim(item).try_cast("smallint"))
        value = F.when(text.rlike(ARRAY) & F.forall(numbers, lambda n: n.isNotNull()), numbers)
    elif column_type == "Interval":
        count = F.regexp_extract(text, r"^(-?[0-9.]+) ", 1).try_cast("double")
        unit = F.when(text.contains("mili"), 1e-3).otherwise(1e-6)
        value = F.when(text.rlike(INTERVAL), F.make_dt_interval(secs=(count * unit).try_cast("decimal(18,6)")))
    elif column_type == "Money":
        value = F.regexp_replace(text, r"[$,]", "").try_cast(kind)
    else:
        value = text.try_cast(kind)
    shown = F.regexp_replace(text, r"[$,]", "") if column_type == "Money" else text
    wide = column_type == "SmallIntArray" and text.rlike(ARRAY)
    beyond = shown.try_cast("double").isNotNull() if column_type in NUMERIC else wide if column_type == "SmallIntArray" else F.lit(False)
    reason = F.when(beyond, f"out of range for {column_type}").otherwise(f"invalid {column_type}")
    return value, F.when(text.isNotNull() & value.isNull(), reason)


def judged(cells: DataFrame, columns: list[tuple[str, str, Column]], target: Column, source: Column, file: Column, offset: Column,
           record: Column | None = None, record_reason: Column | None = None) -> DataFrame:
    """``(row, place, rejects)`` of a frame of texts.

    ``columns`` are ``(name, logical type, text)``. ``row`` is the typed row, ``place`` its target, source, file and
    offset, ``rejects`` what doesn't fit: of a record that could not be cut into cells the record itself.
    """
    tried = [(name, kind, text, *attempt(text, kind)) for name, kind, text in columns]
    row = F.struct(*[value.alias(name, metadata=field(name, kind).metadata) for name, kind, _, value, _ in tried])
    entry = lambda name, text, reason: F.struct(F.lit(name).cast("string").alias("column"), text.alias("text"), reason.alias("reason"))
    wrong = [F.when(reason.isNotNull(), entry(name, text, reason)) for name, kind, text, _, reason in tried if kind != "Text"]
    if record is not None:
        wrong.append(F.when(record_reason.isNotNull(), entry(None, record, record_reason)))
    none = F.array().cast(f"array<{REJECT}>")
    found = F.filter(F.array(*wrong), lambda e: e.isNotNull()) if wrong else none
    place = F.struct(target.alias("target"), source.cast("bigint").alias("source"), file.alias("file"), offset.cast("bigint").alias("offset"))
    return cells.select(row.alias("row"), place.alias("place"), found.cast(f"array<{REJECT}>").alias("rejects"))
