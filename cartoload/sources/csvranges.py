"""Records of delimited text in byte ranges, whatever the size of the files.

A quote turns the state of "inside a quoted value" over wherever it stands, so a line end closes a
record if an even number of quotes comes before it in its file. A first pass counts the quotes of each
range; their parities, one row per range, are chained per file. In the second pass the task that meets
a record's first byte reads on to its end, so no line is shuffled. Arrow's reader parses the records of a
range together; records that don't fit the header fail, or come back with their place and the reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartoload.files import open_input
from cartoload.sources.base import range_tasks

QUOTE, LINE_END, RETURN = 34, 10, 13
BATCH_BYTES, BATCH_ROWS = 4_000_000, 10_000
READ_ON = 1 << 20
PLACE = pa.schema([("path", pa.string()), ("part", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("size", pa.int64())])
COUNTED = pa.schema([*PLACE, ("odd", pa.int32())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with open_input(row["path"]) as handle:
                handle.seek(row["start"])
                quotes = handle.read(row["end"] - row["start"]).count(b'"')
            yield pa.RecordBatch.from_pylist([row | {"odd": quotes % 2}], schema=COUNTED)


def records_of(handle, row: dict) -> tuple[bytes, np.ndarray, np.ndarray, int]:
    """The records that begin in a range: bytes, starts and ends in them, and the place of the first byte in the file.

    A record ends with its line end. Records follow one another without a gap.
    """
    begin, end = row["start"], row["end"]
    base = max(0, begin - 1)  # the byte before tells whether a record begins right here
    handle.seek(base)
    raw, step = handle.read(end - base), min(READ_ON, max(1, end - begin))
    while True:
        data = np.frombuffer(raw, dtype=np.uint8)
        inside = np.cumsum(data[begin - base:] == QUOTE, dtype=np.uint8) + np.uint8(row["inside"])
        inside = np.concatenate([np.full(begin - base, row["inside"], dtype=np.uint8), inside]) & 1
        ends = np.flatnonzero((data == LINE_END) & (inside == 0)) + base
        starts = np.concatenate([np.zeros(1 if begin == 0 else 0, dtype=np.int64), ends + 1])
        starts = starts[(starts >= begin) & (starts < min(end, row["size"]))]
        if not len(starts) or base + len(raw) >= row["size"] or (len(ends) and ends[-1] >= starts[-1]):
            break
        raw, step = raw + handle.read(step), 2 * step  # the last record goes on behind the range
    stops = np.append(ends + 1, base + len(raw))
    stops = stops[np.searchsorted(stops, starts + 1)]
    lone = np.flatnonzero((data == RETURN) & (inside == 0) & (np.append(data[1:], LINE_END) != LINE_END))
    if len(lone):
        raise ValueError(f"{row['path']}: a carriage return without a line end at byte {base + lone[0]}")
    return raw, starts - base, stops - base, base


def parsed(raw: bytes, starts: np.ndarray, stops: np.ndarray, width: int, delimiter: str) -> tuple[pa.Table, np.ndarray, list[tuple[int, str]]]:
    """Cells of consecutive records: a text, or null where nothing stands between delimiters.

    Also the numbers of the records that were parsed, and ``(number, reason)`` of those that don't fit.
    """
    wrong: dict[int, str] = {}
    if width > 1:
        for number in np.flatnonzero(stops - starts <= 2).tolist():
            if not raw[starts[number]:stops[number]].strip(b"\r\n"):
                wrong[number] = f"a line is blank, but the header has {width} columns"

    def skipped(row) -> str:
        wrong[row.number - 1] = f"{row.actual_columns} columns, but the header has {row.expected_columns}"
        return "skip"

    names = [f"c{i}" for i in range(width)]
    part = raw[starts[0]:stops[-1]]
    whole = pacsv.read_csv(
        pa.BufferReader(part), read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=len(part) + 1),
        parse_options=pacsv.ParseOptions(delimiter=delimiter, newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=skipped),
        convert_options=pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=True, quoted_strings_can_be_null=False, null_values=[""]))
    blank = sum(reason.startswith("a line") for reason in wrong.values())
    if whole.num_rows + len(wrong) - blank != len(starts):
        if len(starts) == 1:  # Arrow ends the record at a line end that a stray quote had opened
            return whole.slice(0, 0), np.zeros(0, dtype=np.int64), [(0, "a quote inside a value reaches over a line end")]
        found = [parsed(raw, starts[k:k + 1], stops[k:k + 1], width, delimiter) for k in range(len(starts))]
        return (pa.concat_tables([t for t, _, _ in found]), np.flatnonzero([len(n) for _, n, _ in found]),
                [(k, reason) for k, (_, _, bad) in enumerate(found) for _, reason in bad])
    listed = np.setdiff1d(np.arange(len(starts)), [n for n, reason in wrong.items() if not reason.startswith("a line")])
    fine = np.setdiff1d(listed, list(wrong))
    return whole.filter(pa.array(np.isin(listed, fine))) if blank else whole, fine, sorted(wrong.items())


def _cells(width: int, delimiter: str, placed: bool):
    """Cells of the records of each range; ``placed`` also gives their places and those that don't fit."""
    names = [f"c{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            with open_input(row["path"]) as handle:
                raw, starts, stops, base = records_of(handle, row)
            if row["start"] == 0:
                starts, stops = starts[1:], stops[1:]  # the header of the file
            if not len(starts):
                continue
            part = np.cumsum(stops - starts) // BATCH_BYTES * (len(starts) // BATCH_ROWS + 1) + np.arange(len(starts)) // BATCH_ROWS
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(starts)]
            for first, last in zip(edges, edges[1:]):
                table, numbers, wrong = parsed(raw, starts[first:last], stops[first:last], width, delimiter)
                offsets = starts[first:last] + base
                if not placed:
                    if wrong:
                        raise ValueError(f"{row['path']}: the record at byte {offsets[wrong[0][0]]}: {wrong[0][1]}")
                    yield from table.to_batches()
                    continue
                bad = [k for k, _ in wrong]
                texts = [raw[starts[first + k]:stops[first + k]].rstrip(b"\r\n").decode("utf-8", "replace") for k in bad]
                n, m = table.num_rows, len(bad)
                columns = [pa.concat_arrays([*table.column(c).chunks, pa.nulls(m, pa.string())]) for c in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(row["path"], n + m), pa.array(np.concatenate([offsets[numbers], offsets[bad]]).astype(np.int64)),
                     pa.array([None] * n + texts, pa.string()), pa.array([None] * n + [r for _, r in wrong], pa.string()), *columns],
                    names=["path", "offset", "record", "reason", *names])

    return run


def records(spark: SparkSession, files: list[tuple[str, int]], size: int, width: int, delimiter: str, placed: bool = False) -> DataFrame:
    """``c0 … c<width-1>``: the cells of every record but the first one of each file.

    A file with an open quote fails, and so does a record of another width. With ``placed`` the latter
    comes back without cells but with ``record`` and ``reason``, and all rows have ``path`` and ``offset``.
    """
    known = spark.createDataFrame(files, "path string, size bigint").where("size > 0")
    parts = known.select("path", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / size).cast("int"))).alias("part"))
    start = F.col("part").cast("bigint") * size
    ranges = parts.select("path", "part", start.alias("start"), F.least(start + size, F.col("size")).alias("end"), "size")
    tasks = range_tasks(spark, files, size)
    place = "path string, part int, start bigint, end bigint, size bigint"
    counted = ranges.repartition(tasks, "path", "part").mapInArrow(_count, place + ", odd int")
    # One row per range of a file.
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    last_odd = F.max(F.when(F.col("odd") == 1, F.col("start"))).over(whole)
    unclosed = F.raise_error(F.format_string("%s: a quote behind byte %d is not closed", F.col("path"), last_odd))
    inside = (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int")
    stated = counted.withColumn("inside", F.when(F.sum("odd").over(whole) % 2 == 1, unclosed).otherwise(inside))
    cells = ", ".join(f"c{i} string" for i in range(width))
    schema = f"path string, offset bigint, record string, reason string, {cells}" if placed else cells
    return stated.drop("odd").repartition(tasks, "path", "part").mapInArrow(_cells(width, delimiter, placed), schema)
