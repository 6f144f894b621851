"""Shapefiles, one task per run of records.

The ``.shx`` index has one fixed-size entry per record and the ``.dbf`` table has fixed-width rows,
so a task reads exactly the bytes of its own records from all three files, and of a memo file the
blocks that they point to.
"""

from __future__ import annotations

from contextlib import nullcontext
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from cartoload.files import first_file, list_files, open_input, packed
from cartoload.functions import values
from cartoload.functions.names import table_name
from cartoload.functions.ragged import shape_texts
from cartoload.functions.types import DBF_TYPES
from cartoload.sources.base import Scan, project, quoted
from cartoload.sources.memo import MemoFile, pointers

RECORDS_PER_SPLIT = 100_000
BATCH_RECORDS = 10_000
SPLIT_BYTES = 64 << 20
DBF_HEADER = np.dtype([("version", "u1"), ("date", "u1", 3), ("rows", "<u4"), ("header", "<u2"),
                       ("width", "<u2"), ("rest", "u1", 20)])
DBF_FIELD = np.dtype([("name", "S11"), ("kind", "S1"), ("skip", "u1", 4), ("width", "u1"),
                      ("decimals", "u1"), ("rest", "u1", 14)])
JULIAN_EPOCH = 2440588  # Julian day number of 1970-01-01


def sibling(path: str, extension: str) -> str:
    return path[: -len(".shp")] + extension


def dbf_fields(path: str):
    """``(row count, header bytes, row dtype, [(name, kind letter)], version)`` of a ``.dbf``."""
    with open_input(path) as handle:
        head = np.frombuffer(handle.read(32), DBF_HEADER)[0]
        described = handle.read(int(head["header"]) - 32)
    count = described.index(b"\r") // 32
    fields = np.frombuffer(described, DBF_FIELD, count)
    columns = [(item["name"].decode("utf-8"), item["kind"].decode(), int(item["width"])) for item in fields]
    row = np.dtype([("deleted", "S1")] + [(f"f{i}", f"V{width}") for i, (_, _, width) in enumerate(columns)])
    kept = [(name, kind) for name, kind, _ in columns]
    return int(head["rows"]), int(head["header"]), row, kept, int(head["version"])


def _texts(cells: np.ndarray) -> list[str]:
    width = cells.dtype.itemsize
    return [bytes(cell).rstrip(b"\0 ").decode("utf-8") for cell in cells.view(f"V{width}").tolist()]


def attribute(cells: np.ndarray, kind: str) -> pa.Array:
    """One DBF column in its stored form: text for most, numbers for the binary kinds."""
    width = cells.dtype.itemsize
    packed = np.ascontiguousarray(cells)
    if kind == "I":
        return pa.array(packed.view("<i4"), pa.int32())
    if kind == "Y":
        return pa.array(packed.view("<i8"), pa.int64())
    if kind == "B" and width == 8:
        return pa.array(packed.view("<f8"), pa.float64())
    if kind == "T":
        days_millis = packed.view("<i4").reshape(-1, 2).astype("i8")
        millis = (days_millis[:, 0] - JULIAN_EPOCH) * 86_400_000 + days_millis[:, 1]
        return pa.array(millis, pa.int64(), mask=days_millis[:, 0] == 0)
    return pa.array([text.strip() if kind != "C" else text for text in _texts(packed)], pa.string())


STORED = {"I": pa.int32(), "Y": pa.int64(), "B": pa.float64(), "T": pa.int64()}


def attribute_column(name: str, kind: str):
    """Typed value of a stored DBF column."""
    value = quoted(name)
    if kind == "Y":
        return (value.cast("decimal(38,0)") / 10000).cast("decimal(19,2)")
    if kind == "T":
        return values.epoch_timestamp(value, 1000)
    if kind in ("I", "B"):
        return value
    text = values.empty_to_null(value)
    if kind == "D":
        return F.to_date(text, "yyyyMMdd")
    if kind == "L":
        return F.when(F.upper(text).isin("T", "Y"), True).when(F.upper(text).isin("F", "N"), False)
    # A numeric cell full of stars did not fit its column.
    return values.typed(F.when(text.rlike(r"^\*+$"), None).otherwise(text) if kind in "NF" else text,
                        DBF_TYPES[kind])


@dataclass
class RecordRange:
    path: str
    first: int
    last: int


@dataclass
class RecordRanges(InputPartition):
    ranges: list[RecordRange]


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, split_records: int):
        self.path, self.split_records = path, split_records

    def partitions(self):
        ranges = []
        sizes = dict(list_files(self.path, ".shp", ".shx"))
        for path in [p for p in sizes if p.endswith(".shp")]:
            index = sibling(path, ".shx")
            size = sizes[index] if index in sizes else list_files(index)[0][1]
            count = (size - 100) // 8
            step = self.split_records
            ranges.append([
                (sizes[path] * step // max(count, step), RecordRange(path, i, min(i + step, count)))
                for i in range(0, count, step)])
        return [RecordRanges(run) for run in packed(ranges, SPLIT_BYTES)]

    def read(self, part: RecordRanges):
        for piece in part.ranges:
            yield from self.read_range(piece)

    def read_range(self, part: RecordRange):
        rows, header, row_type, fields, version = dbf_fields(sibling(part.path, ".dbf"))
        memos = [i for i, (_, kind) in enumerate(fields) if kind == "M"]
        target = stored_schema(fields)
        if rows < part.last:
            raise ValueError(f"{part.path} has more shapes than table rows")
        with (open_input(part.path) as shapes, open_input(sibling(part.path, ".shx")) as index,
              open_input(sibling(part.path, ".dbf")) as table,
              MemoFile(sibling(part.path, ".dbf"), version) if memos else nullcontext() as blocks):
            for first in range(part.first, part.last, BATCH_RECORDS):
                count = min(BATCH_RECORDS, part.last - first)
                index.seek(100 + 8 * first)
                entries = np.frombuffer(index.read(8 * count), ">i4").reshape(-1, 2).astype("i8") * 2
                start = int(entries[0, 0])
                shapes.seek(start)
                body = shapes.read(int(entries[-1].sum()) + 8 - start)
                wkt = shape_texts(body, entries[:, 0] - start + 8)
                table.seek(header + first * row_type.itemsize)
                cells = np.frombuffer(table.read(count * row_type.itemsize), row_type)
                arrays = [None if i in memos else attribute(cells[f"f{i}"], kind) for i, (_, kind) in enumerate(fields)]
                yield from with_memos(arrays + [wkt], cells, memos, blocks, target)


def with_memos(arrays: list, cells: np.ndarray, memos: list[int], blocks: MemoFile | None, target: pa.Schema):
    """Batches of the records; of one memo column after the other, as many records as its memos leave room for."""
    if not memos:
        yield pa.RecordBatch.from_arrays(arrays, schema=target)
        return
    column, rest = memos[0], memos[1:]
    for first, last, texts in blocks.texts(pointers(cells[f"f{column}"])):
        run = [array if array is None else array.slice(first, last - first) for array in arrays]
        run[column] = texts
        yield from with_memos(run, cells[first:last], rest, blocks, target)


def stored_schema(fields) -> pa.Schema:
    names = [(name, STORED.get(kind, pa.string())) for name, kind in fields]
    return pa.schema(names + [("geometry", pa.string())])


class ShapefileSource(DataSource):
    """``spark.read.format("shapefile").load(path)``"""

    @classmethod
    def name(cls):
        return "shapefile"

    def schema(self):
        path = first_file(self.options["path"], ".shp")
        return from_arrow_schema(stored_schema(dbf_fields(sibling(path, ".dbf"))[3]))

    def reader(self, schema):
        return ShapefileReader(
            self.options["path"], int(self.options.get("splitRecords", RECORDS_PER_SPLIT)))


def scan(spark: SparkSession, options: dict) -> Scan:
    path = options["file_path"]
    rows, _, _, fields, _ = dbf_fields(sibling(first_file(path, ".shp"), ".dbf"))
    if rows == 0:
        raise ValueError(f"Could not get the first feature for {path}")
    reader = spark.read.format("shapefile")
    if "split_records" in options:
        reader = reader.option("splitRecords", options["split_records"])
    parts = [(name, DBF_TYPES[kind], attribute_column(name, kind)) for name, kind in fields]
    parts.append(("geometry", "Geometry", quoted("geometry")))
    return Scan(table_name(path), project(reader.load(path), parts))
