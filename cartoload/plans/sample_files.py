"""Writes DataFrames out in the source formats, one file per partition, so that scans have input.

The given tables are Parquet; the queries and tests for the other scans first turn a table into files
of the format. Only what those files need is covered.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoload.files import put_file


FILE_BYTES = 4 << 20  # of Arrow data; as Python rows they take about ten times that


def chunks(batches, size: int):
    """Tables of about ``size`` bytes from batches of any size, none of them empty."""
    held, total = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for first in range(0, batch.num_rows, step):
            held.append(batch.slice(first, step))
            total += held[-1].nbytes
            if total >= size:
                yield pa.Table.from_batches(held)
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


def write_files(frame: DataFrame, path: str, suffix: str, save) -> str:
    """Run ``save(stem, Arrow table)`` on the executors, once per ``FILE_BYTES`` of a partition, so that a task holds no more."""
    def part(batches):
        for k, data in enumerate(chunks(batches, FILE_BYTES)):
            stem = f"{path}/part-{TaskContext.get().partitionId():05d}-{k:05d}"
            save(stem, data)
            yield pa.RecordBatch.from_pydict({"path": [stem + suffix]})

    tasks = frame.sparkSession.sparkContext.defaultParallelism
    if frame.rdd.getNumPartitions() < tasks:
        frame = frame.repartition(tasks)
    frame.mapInArrow(part, "path string").write.format("noop").mode("overwrite").save()
    return path


def write_csv(frame: DataFrame, path: str) -> str:
    frame.write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', nullValue="", emptyValue='""',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def write_lines(rows: DataFrame, path: str, header: str) -> str:
    """Files of one column ``value``, each with a header line."""
    def headed(batches):
        first = pa.array([header], pa.string())
        for batch in batches:
            if first is not None:
                yield pa.RecordBatch.from_arrays([first], names=["value"])
                first = None
            yield batch

    rows.select("value").mapInArrow(headed, "value string").write.mode("overwrite").text(path)
    return path


def write_geojson_lines(properties: F.Column, geometry: F.Column, frame: DataFrame, path: str) -> str:
    """One feature per line."""
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(geometry, F.lit("null")),
                       F.lit(',"properties":'), F.coalesce(properties, F.lit("null")), F.lit("}"))
    frame.select(feature.alias("value")).write.mode("overwrite").text(path)
    return path


def write_ipc(frame: DataFrame, path: str, batch_rows: int = 4096) -> str:
    def save(stem, data: pa.Table):
        def fill(sink):
            with pa.ipc.new_file(sink, data.schema) as writer:
                writer.write_table(data, max_chunksize=batch_rows)

        put_file(stem + ".ipc", fill)

    return write_files(frame, path, ".ipc", save)


# --- Avro ----------------------------------------------------------------------------------------

def _long(value: int) -> bytes:
    value = (value << 1) ^ (value >> 63)
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def encode(schema, value, named: dict) -> bytes:
    """One value in Avro binary; union branches are picked by null or not, else ``(index, value)``."""
    if isinstance(schema, list):
        if not isinstance(value, tuple):
            null = schema.index("null")
            value = (null, None) if value is None else (1 - null, value)
        return _long(value[0]) + encode(schema[value[0]], value[1], named)
    schema = named.get(schema, schema) if isinstance(schema, str) else schema
    kind = schema if isinstance(schema, str) else schema["type"]
    if isinstance(kind, (dict, list)):
        return encode(kind, value, named)
    if kind in ("record", "enum", "fixed"):
        named[schema["name"]] = schema
    if kind == "null":
        return b""
    if kind == "boolean":
        return b"\x01" if value else b"\x00"
    if kind in ("int", "long"):
        return _long(value)
    if kind == "float":
        return struct.pack("<f", value)
    if kind == "double":
        return struct.pack("<d", value)
    if kind == "bytes":
        return _long(len(value)) + bytes(value)
    if kind == "string":
        raw = value.encode()
        return _long(len(raw)) + raw
    if kind == "fixed":
        return bytes(value)
    if kind == "enum":
        return _long(schema["symbols"].index(value))
    if kind == "array":
        items = b"".join(encode(schema["items"], item, named) for item in value)
        return (_long(len(value)) + items if value else b"") + b"\x00"
    if kind == "map":
        items = b"".join(encode("string", k, named) + encode(schema["values"], v, named) for k, v in dict(value).items())
        return (_long(len(value)) + items if value else b"") + b"\x00"
    return b"".join(encode(f["type"], value[f["name"]], named) for f in schema["fields"])


def avro_bytes(schema: dict, rows, codec: str = "deflate", block_rows: int = 1000) -> bytes:
    sync = b"cartoload-sync-1"
    meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()}
    out = [b"Obj\x01", _long(len(meta)),
           *[encode("string", k, {}) + encode("bytes", v, {}) for k, v in meta.items()], b"\x00", sync]
    rows, named = list(rows), {}
    for start in range(0, len(rows), block_rows):
        chunk = rows[start:start + block_rows]
        body = b"".join(encode(schema, row, named) for row in chunk)
        if codec == "deflate":
            packer = zlib.compressobj(wbits=-15)
            body = packer.compress(body) + packer.flush()
        out += [_long(len(chunk)), _long(len(body)), body, sync]
    return b"".join(out)


def write_avro(frame: DataFrame, path: str, schema: dict, codec: str = "deflate") -> str:
    def save(stem, data: pa.Table):
        content = avro_bytes(schema, data.to_pylist(), codec)
        put_file(stem + ".avro", lambda sink: sink.write(content))

    return write_files(frame, path, ".avro", save)


# --- shapefiles ----------------------------------------------------------------------------------

def point_record(x: float, y: float) -> bytes:
    return struct.pack("<idd", 1, x, y)


def parts_record(code: int, parts: list) -> bytes:
    """A polyline (3) or polygon (5) from lists of points."""
    points = np.array([p for part in parts for p in part], "<f8").reshape(-1, 2)
    starts = np.cumsum([0] + [len(part) for part in parts[:-1]]).astype("<i4")
    box = np.concatenate([points.min(axis=0), points.max(axis=0)]).astype("<f8")
    return (struct.pack("<i", code) + box.tobytes() + struct.pack("<ii", len(parts), len(points))
            + starts.tobytes() + points.tobytes())


def shapefile_bytes(shapes: list[bytes | None], fields: list[tuple], rows: list[tuple]) -> dict[str, bytes]:
    """``.shp``, ``.shx`` and ``.dbf`` contents; ``fields`` holds name, letter, width, decimals."""
    bodies = [struct.pack("<i", 0) if shape is None else shape for shape in shapes]
    code = max([int.from_bytes(b[:4], "little") for b in bodies], default=1)
    records, index, at = [], [], 50
    for i, body in enumerate(bodies, 1):
        records.append(struct.pack(">ii", i, len(body) // 2) + body)
        index.append(struct.pack(">ii", at, len(body) // 2))
        at += 4 + len(body) // 2

    def head(words):
        return struct.pack(">i20xi", 9994, words) + struct.pack("<ii", 1000, code) + bytes(64)

    width = 1 + sum(f[2] for f in fields)
    dbf = [struct.pack("<B3BIHH20x", 3, 124, 1, 1, len(rows), 33 + 32 * len(fields), width)]
    dbf += [struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), size, decimals)
            for name, kind, size, decimals in fields]
    dbf.append(b"\r")
    for row in rows:
        dbf.append(b" " + b"".join(_dbf_cell(value, kind, size) for value, (_, kind, size, _) in zip(row, fields)))
    return {".shp": head(at) + b"".join(records), ".shx": head(50 + 4 * len(bodies)) + b"".join(index),
            ".dbf": b"".join(dbf) + b"\x1a"}


def _dbf_cell(value, kind: str, size: int) -> bytes:
    if kind == "I":
        return struct.pack("<i", value)
    if kind == "Y":
        return struct.pack("<q", value)
    if kind == "B":
        return struct.pack("<d", value)
    if kind == "T":
        return struct.pack("<ii", *(value or (0, 0)))
    text = "" if value is None else str(value)
    return text.encode().rjust(size) if kind in "NF" else text.encode().ljust(size)


def write_shapefile(frame: DataFrame, path: str, fields: list[tuple], shape) -> str:
    """``shape(row)`` gives the record body of a row, or None for no shape."""
    names = [f[0] for f in fields]

    def save(stem, data: pa.Table):
        rows = data.to_pylist()
        contents = shapefile_bytes([shape(row) for row in rows], fields,
                                   [tuple(row[n] for n in names) for row in rows])
        for suffix in (".dbf", ".shx", ".shp"):
            put_file(stem + suffix, lambda sink, s=suffix: sink.write(contents[s]))

    return write_files(frame, path, ".shp", save)


# --- workbooks -----------------------------------------------------------------------------------

SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
SHEET_ROWS = 1_000_000  # a sheet holds 1,048,576 rows
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def _letters(i: int) -> str:
    name = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        name = chr(65 + rest) + name
    return name


def _cell_xml(at: str, value) -> str:
    """A cell; ``("e", text)`` is an error and ``("d", serial)`` a date."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, tuple):
        kind, raw = value
        return f'<c r="{at}" t="e"><v>{raw}</v></c>' if kind == "e" else f'<c r="{at}" s="1"><v>{raw!r}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


def workbook_bytes(sheet: str, rows) -> bytes:
    lines = []
    for i, row in enumerate(rows, 1):
        cells = "".join(_cell_xml(f"{_letters(j)}{i}", value) for j, value in enumerate(row))
        lines.append(f'<row r="{i}">{cells}</row>')
    files = {
        "xl/workbook.xml": f'<workbook xmlns="{SHEET}" xmlns:r="{REL}"><sheets>'
                           f'<sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}"><Relationship Id="rId1" Type="{REL}/worksheet" '
                                      'Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{SHEET}"><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SHEET}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    target = io.BytesIO()
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in files.items():
            book.writestr(name, text)
    return target.getvalue()


def write_workbooks(frame: DataFrame, path: str, sheet: str) -> str:
    """Date columns go in as day serials with a date style."""
    def cell(value):
        if hasattr(value, "timestamp"):
            micros = (value - value.replace(year=1970, month=1, day=1, hour=0, minute=0, second=0, microsecond=0))
            return "d", 25569 + micros.total_seconds() / 86400
        return value

    def save(stem, data: pa.Table):
        for i, start in enumerate(range(0, data.num_rows, SHEET_ROWS)):
            chunk = data.slice(start, SHEET_ROWS).to_pylist()
            content = workbook_bytes(sheet, [data.column_names] + [[cell(v) for v in row.values()] for row in chunk])
            put_file(f"{stem}-{i}.xlsx", lambda sink, c=content: sink.write(c))

    return write_files(frame, path, ".xlsx", save)
