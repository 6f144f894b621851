"""Avro container files, split at block markers.

A task owns the blocks whose leading sync marker starts in its byte range, so a big file is read by
many tasks. Scalars come out as plain columns holding the stored number, so that dates and times are
converted by column expressions; nested values come out as JSON text.
"""

from __future__ import annotations

import json
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

from cartoload.files import first_file, list_files, open_input, packed
from cartoload.functions import values
from cartoload.functions.geometry import plain
from cartoload.functions.names import table_name
from cartoload.functions.types import avro_kind, avro_nullable, from_avro
from cartoload.sources.base import Scan, project, quoted, split_bytes

SPLIT_BYTES = 64 << 20
MAGIC = b"Obj\x01"

# Arrow type of a scalar by Avro kind.
SCALARS = {
    "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(),
    "double": pa.float64(), "string": pa.string(), "enum": pa.string(), "uuid": pa.string(),
    "bytes": pa.binary(), "fixed": pa.binary(), "decimal": pa.binary(), "duration": pa.binary(),
    "date": pa.int32(), "time-millis": pa.int32(), "time-micros": pa.int64(),
    "timestamp-millis": pa.int64(), "timestamp-micros": pa.int64(),
}


def read_long(data, at: int) -> tuple[int, int]:
    """Zigzag variable-length integer."""
    shift = result = 0
    while True:
        byte = data[at]
        at += 1
        result |= (byte & 0x7F) << shift
        if byte < 0x80:
            return (result >> 1) ^ -(result & 1), at
        shift += 7


def _read_bytes(data, at):
    size, at = read_long(data, at)
    return data[at:at + size], at + size


def _read_text(data, at):
    raw, at = _read_bytes(data, at)
    return raw.decode(), at


def _read_items(data, at, read):
    """Elements of an array or map, stored in counted blocks."""
    found = []
    count, at = read_long(data, at)
    while count:
        if count < 0:
            count = -count
            _, at = read_long(data, at)
        for _ in range(count):
            item, at = read(data, at)
            found.append(item)
        count, at = read_long(data, at)
    return found, at


def _fixed_reader(code: str):
    width = struct.calcsize(code)
    unpack = struct.Struct(code).unpack_from
    return lambda data, at: (unpack(data, at)[0], at + width)


def value_reader(schema, named: dict):
    """A function ``(block, offset) -> (value, next offset)`` for a schema."""
    if isinstance(schema, list):
        kinds = [avro_kind(resolve(member, named)) for member in schema]
        readers = [value_reader(member, named) for member in schema]

        def read_union(data, at):
            branch, at = read_long(data, at)
            value, at = readers[branch](data, at)
            return (kinds[branch], value), at

        return read_union
    kind = schema if isinstance(schema, str) else schema["type"]
    if isinstance(kind, (dict, list)):
        return value_reader(kind, named)
    if kind in named:
        # Looked up on use: a named type may refer to itself.
        return lambda data, at: named[kind][1](data, at)
    simple = {
        "null": lambda data, at: (None, at),
        "boolean": lambda data, at: (data[at] == 1, at + 1),
        "int": read_long, "long": read_long,
        "float": _fixed_reader("<f"), "double": _fixed_reader("<d"),
        "bytes": _read_bytes, "string": _read_text,
    }
    if kind in simple:
        return simple[kind]
    if kind == "array":
        item = value_reader(schema["items"], named)
        return lambda data, at: _read_items(data, at, item)
    if kind == "map":
        value = value_reader(schema["values"], named)

        def read_entry(data, at):
            key, at = _read_text(data, at)
            item, at = value(data, at)
            return (key, item), at

        def read_map(data, at):
            entries, at = _read_items(data, at, read_entry)
            return dict(entries), at

        return read_map
    if kind == "fixed":
        width = schema["size"]
        reader = lambda data, at: (data[at:at + width], at + width)
    elif kind == "enum":
        symbols = schema["symbols"]

        def reader(data, at):
            index, at = read_long(data, at)
            return symbols[index], at
    elif kind == "record":
        fields = []

        def reader(data, at):
            record = {}
            for name, read in fields:
                record[name], at = read(data, at)
            return record, at
    else:
        raise ValueError(f"unknown Avro type {kind}")
    _declare(schema, named, reader)
    if kind == "record":
        fields += [(f["name"], value_reader(f["type"], named)) for f in schema["fields"]]
    return reader


def _declare(schema: dict, named: dict, reader) -> None:
    for name in {schema["name"], f"{schema.get('namespace', '')}.{schema['name']}".lstrip(".")}:
        named[name] = (schema, reader)


def resolve(schema, named: dict):
    return named[schema][0] if isinstance(schema, str) and schema in named else schema


def _json_ready(value):
    """Nested values the way they are written to JSON: bytes as numbers, unions without a tag."""
    if isinstance(value, tuple):
        return _json_ready(value[1])
    if isinstance(value, (bytes, memoryview)):
        return list(value)
    if isinstance(value, list):
        return [_json_ready(item) for item in value]
    if isinstance(value, dict):
        return {key: _json_ready(item) for key, item in value.items()}
    return value


def compact(value) -> str:
    return json.dumps(_json_ready(value), separators=(",", ":"), ensure_ascii=False)


def _clock(seconds: int) -> str:
    return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"


def scalar_text(kind: str, value) -> str:
    """Text of a union member."""
    if value is None:
        return ""
    if kind == "boolean":
        return "true" if value else "false"
    if kind == "float":
        return plain(float(str(np.float32(value))))
    if kind == "double":
        return plain(value)
    if kind in ("bytes", "fixed", "decimal"):
        return "{" + ",".join(map(str, value)) + "}"
    if kind == "duration":
        months, days, millis = struct.unpack("<III", value)
        return compact({"months": months, "days": days, "millis": millis})
    if kind == "date":
        return str(np.datetime64(value, "D"))
    if kind.startswith("time-"):
        return _clock(value // (1000 if kind.endswith("millis") else 1000000))
    if kind.startswith("timestamp-"):
        unit = 1000 if kind.endswith("millis") else 1000000
        seconds = abs(value) // unit * (1 if value >= 0 else -1)
        return str(np.datetime64(seconds, "s")).replace("T", " ")
    if kind == "union":
        return tagged(value)
    if kind in ("array", "map", "record"):
        return compact(value)
    return str(value)


def tagged(union) -> str:
    """V13."""
    kind, value = union
    return json.dumps({"type": kind.replace("-", "_"), "value": scalar_text(kind, value)},
                      separators=(",", ":"), ensure_ascii=False)


def column_shape(schema) -> tuple[str, bool]:
    """``(kind, nullable union)`` of a field as a column."""
    if avro_nullable(schema):
        others = [avro_kind(m) for m in schema if avro_kind(m) != "null"]
        return (others[0] if others else "union"), True
    return avro_kind(schema), False


def file_header(path: str):
    """``(schema, codec, sync marker, offset of the first block)`` of one file."""
    with open_input(path) as handle:
        head = handle.read(1 << 16)
        while True:
            try:
                if head[:4] != MAGIC:
                    raise ValueError(f"{path} is not an Avro container file")
                entry = lambda data, at: (lambda k: (lambda v: ((k[0], v[0]), v[1]))(
                    _read_bytes(data, k[1])))(_read_text(data, at))
                entries, at = _read_items(head, 4, entry)
                meta = dict(entries)
                if len(head) < at + 16:
                    raise IndexError
                codec = meta.get("avro.codec", b"null").decode()
                return json.loads(meta["avro.schema"]), codec, head[at:at + 16], at + 16
            except (IndexError, UnicodeDecodeError, json.JSONDecodeError):
                more = handle.read(1 << 20)
                if not more:
                    raise
                head += more


def record_fields(path: str) -> list[dict]:
    schema = file_header(path)[0]
    if avro_kind(schema) != "record":
        raise ValueError(f'File schema for "{path}" is not a record. Found {schema}')
    return schema["fields"]


def _inflate(codec: str, block: bytes) -> bytes:
    if codec == "null":
        return block
    if codec == "deflate":
        return zlib.decompress(block, -15)
    if codec == "snappy":
        return _unsnappy(block[:-4])
    if codec == "zstandard":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(block)
    raise ValueError(f"unsupported Avro codec {codec}")


def _unsnappy(block: bytes) -> bytes:
    size = shift = at = 0
    while True:  # the uncompressed length leads the block
        byte = block[at]
        size |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return pa.Codec("snappy").decompress(block, size, asbytes=True)


@dataclass
class ByteRange:
    path: str
    start: int
    end: int


@dataclass
class ByteRanges(InputPartition):
    ranges: list[ByteRange]


class AvroBlockReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self):
        step = self.split_bytes
        return [ByteRanges(run) for run in packed([
            [(min(step, size - start), ByteRange(path, start, min(start + step, size))) for start in range(0, size, step)]
            for path, size in list_files(self.path, ".avro")
        ], step)]

    def blocks(self, part: ByteRange):
        """``(record count, raw block)`` of the blocks this range owns."""
        schema, codec, sync, body = file_header(part.path)
        with open_input(part.path) as handle:
            size = handle.size()
            marker = body - 16  # the header ends with a marker, too
            if part.start > marker:
                marker = self._find(handle, sync, part.start, part.end, size)
            while marker is not None and marker < part.end and marker + 16 < size:
                handle.seek(marker + 16)
                lead = handle.read(20)
                count, used = read_long(lead, 0)
                length, used = read_long(lead, used)
                handle.seek(marker + 16 + used)
                yield count, _inflate(codec, handle.read(length))
                marker += 16 + used + length

    @staticmethod
    def _find(handle, sync, start, end, size):
        step = 1 << 20
        at = start
        while at < end:
            handle.seek(at)
            piece = handle.read(min(step + 15, size - at))
            hit = piece.find(sync)
            if hit >= 0:
                return at + hit
            at += step
        return None

    def read(self, part: ByteRanges):
        for piece in part.ranges:
            yield from self.read_range(piece)

    def read_range(self, part: ByteRange):
        fields = record_fields(part.path)
        named: dict = {}
        target, kinds = arrow_layout(fields)
        readers = [value_reader(f["type"], named) for f in fields]
        for count, block in self.blocks(part):
            columns = [[] for _ in readers]
            steps = list(zip(readers, columns))
            at = 0
            for _ in range(count):
                for read, column in steps:
                    value, at = read(block, at)
                    column.append(value)
            arrays = [
                pa.array(_finish(column, *shape), item.type)
                for column, shape, item in zip(columns, kinds, target)
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)


def _finish(column: list, kind: str, nullable: bool) -> list:
    if nullable:
        column = [pair[1] if isinstance(pair, tuple) else pair for pair in column]
    if kind in SCALARS:
        return column
    show = tagged if kind == "union" else compact
    return [None if value is None else show(value) for value in column]


def arrow_layout(fields: list[dict]):
    named: dict = {}
    for f in fields:
        value_reader(f["type"], named)
    kinds = [column_shape([resolve(m, named) for m in f["type"]] if isinstance(f["type"], list)
                          else resolve(f["type"], named)) for f in fields]
    schema = pa.schema([
        (f["name"], SCALARS.get(kind, pa.string())) for f, (kind, _) in zip(fields, kinds)])
    return schema, kinds


class AvroBlockSource(DataSource):
    """``spark.read.format("avro_blocks").load(path)``"""

    @classmethod
    def name(cls):
        return "avro_blocks"

    def schema(self):
        fields = record_fields(first_file(self.options["path"], ".avro"))
        return from_arrow_schema(arrow_layout(fields)[0])

    def reader(self, schema):
        return AvroBlockReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def column_value(name: str, kind: str) -> Column:
    """Typed column from the stored number or bytes."""
    value = quoted(name)
    if kind in ("bytes", "fixed", "decimal"):
        return values.byte_array(value)
    if kind == "date":
        return values.epoch_date(value)
    if kind.startswith("time-"):
        return values.time_text(value, 1000 if kind.endswith("millis") else 1000000)
    if kind.startswith("timestamp-"):
        return values.epoch_timestamp(value, 1000 if kind.endswith("millis") else 1000000)
    if kind == "duration":
        return values.duration_json(value)
    if kind in ("boolean", "int", "long", "float", "double"):
        return value
    return values.empty_to_null(value)


def scan(spark: SparkSession, options: dict) -> Scan:
    path = options["file_path"]
    fields = record_fields(first_file(path, ".avro"))
    _, kinds = arrow_layout(fields)
    total = sum(size for _, size in list_files(path, ".avro"))
    reader = spark.read.format("avro_blocks").option(
        "splitBytes", options.get("split_bytes") or split_bytes(spark, total))
    named: dict = {}
    parts = []
    for f, (kind, _) in zip(fields, kinds):
        value_reader(f["type"], named)
        declared = [resolve(m, named) for m in f["type"]] if isinstance(f["type"], list) else resolve(f["type"], named)
        parts.append((f["name"], from_avro(f["name"], declared), column_value(f["name"], kind)))
    return Scan(table_name(path), project(reader.load(path), parts))
