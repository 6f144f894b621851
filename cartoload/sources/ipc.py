"""Arrow IPC / Feather files, one task per run of record batches."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from cartoload.files import first_file, list_files, open_input, packed
from cartoload.functions.names import table_name
from cartoload.functions.types import from_arrow
from cartoload.functions.values import empty_to_null
from cartoload.sources.base import Scan, project, quoted, split_bytes

SPLIT_BYTES = 128 << 20


def stored_type(kind: pa.DataType) -> pa.DataType:
    """The Arrow type a column is handed to Spark in; nested types stay nested."""
    if pa.types.is_map(kind):
        return pa.map_(stored_type(kind.key_type), stored_type(kind.item_type))
    if pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_fixed_size_list(kind):
        return pa.list_(stored_type(kind.value_type))
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, stored_type(f.type)) for f in kind])
    if kind == pa.uint8():
        return pa.int16()
    if kind == pa.uint16():
        return pa.int32()
    if kind in (pa.uint32(), pa.uint64()) or kind == pa.int32():
        return pa.int64()
    if kind == pa.int8():
        return pa.int16()
    if kind == pa.int16():
        return pa.int32()
    if pa.types.is_timestamp(kind):
        return pa.timestamp("us", kind.tz)
    if pa.types.is_duration(kind):
        return pa.duration("us")
    if pa.types.is_date(kind):
        return pa.date32()
    if pa.types.is_float16(kind):
        return pa.float32()
    simple = (pa.types.is_boolean, pa.types.is_int64, pa.types.is_float32, pa.types.is_float64)
    return kind if any(check(kind) for check in simple) else pa.string()


def stored_schema(schema: pa.Schema) -> pa.Schema:
    return pa.schema([(item.name, stored_type(item.type)) for item in schema])


def _stored(column: pa.Array) -> pa.Array:
    """Cast to the stored type; values that do not fit it raise."""
    kind, target = column.type, stored_type(column.type)
    if kind == target:
        return column
    if pa.types.is_time(kind):
        return _time_text(column)
    if pa.types.is_timestamp(kind) or pa.types.is_duration(kind):
        return column.cast(target, safe=False)
    return column.cast(target)


def _time_text(column: pa.Array) -> pa.Array:
    micros = column.cast(pa.time64("ns")).cast(pa.time64("us"), safe=False).cast(pa.int64())
    stamps = micros.cast(pa.timestamp("us"))
    return pa.compute.utf8_slice_codeunits(pa.compute.strftime(stamps, format="%H:%M:%S"), 0, 8)


@dataclass
class BatchRange:
    path: str
    first: int
    last: int | None


@dataclass
class BatchRanges(InputPartition):
    ranges: list[BatchRange]


class ArrowFileReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self):
        ranges = []
        for path, size in list_files(self.path, ".ipc", ".feather", ".arrow"):
            if size <= self.split_bytes:
                ranges.append([(size, BatchRange(path, 0, None))])  # no need to look at the footer
                continue
            with open_input(path) as handle:
                batches = pa.ipc.open_file(handle).num_record_batches
            step = max(1, batches * self.split_bytes // size)
            ranges.append([(size * step // batches, BatchRange(path, i, min(i + step, batches)))
                           for i in range(0, batches, step)])
        return [BatchRanges(run) for run in packed(ranges, self.split_bytes)]

    def read(self, partition: BatchRanges):
        for piece in partition.ranges:
            yield from self.read_range(piece)

    def read_range(self, partition: BatchRange):
        with open_input(partition.path) as handle:
            reader = pa.ipc.open_file(handle)
            last = reader.num_record_batches if partition.last is None else partition.last
            target = stored_schema(reader.schema)
            for i in range(partition.first, last):
                batch = reader.get_batch(i)
                yield pa.RecordBatch.from_arrays([_stored(c) for c in batch.columns], schema=target)


class ArrowFileSource(DataSource):
    """``spark.read.format("arrow_file").load(path)``"""

    @classmethod
    def name(cls):
        return "arrow_file"

    def schema(self):
        return from_arrow_schema(stored_schema(file_schema(self.options["path"])), prefer_timestamp_ntz=True)

    def reader(self, schema):
        return ArrowFileReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def file_schema(path: str) -> pa.Schema:
    with open_input(first_file(path, ".ipc", ".feather", ".arrow")) as handle:
        return pa.ipc.open_file(handle).schema


def scan(spark: SparkSession, options: dict) -> Scan:
    path = options["file_path"]
    total = sum(size for _, size in list_files(path, ".ipc", ".feather", ".arrow"))
    frame = spark.read.format("arrow_file").option(
        "splitBytes", options.get("split_bytes") or split_bytes(spark, total)).load(path)
    parts = []
    for item in file_schema(path):
        column_type = from_arrow(item.type)
        value = quoted(item.name)
        if pa.types.is_nested(item.type):
            value = F.to_json(value, {"ignoreNullFields": "false"})
        parts.append((item.name, column_type, empty_to_null(value) if column_type == "Text" else value))
    return Scan(table_name(path), project(frame, parts))
