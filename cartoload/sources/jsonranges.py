"""Features of GeoJSON files in byte ranges, whatever their text layout.

A file is cut into ranges at any byte. Whether a range begins inside a string, and how many braces and
brackets are open there, follows from the ranges before it, so a first pass takes from each range what
it changes (for either way it may begin), and these few numbers are chained per file. The second pass
cuts features at their depth; the task that meets a feature's first byte reads on to its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartoload.files import open_input
from cartoload.sources.base import range_tasks

QUOTE, SLASH = 34, 92
OPENING, CLOSING = (123, 91), (125, 93)
LOOK_BACK = 1 << 16  # bytes read at once to find what stands before a range
READ_ON = 1 << 20


def escaped_start(handle, start: int) -> bool:
    """Whether the byte at ``start`` follows an odd number of backslashes."""
    run, end = 0, start
    while end:
        begin = max(0, end - LOOK_BACK)
        handle.seek(begin)
        piece = handle.read(end - begin)
        kept = piece.rstrip(b"\\")
        run += len(piece) - len(kept)
        if kept:
            break
        end = begin
    return run % 2 == 1


def in_strings(data: np.ndarray, inside: bool, escaped: bool) -> np.ndarray:
    """For every byte, 1 if it belongs to a string (its opening quote counts, the closing one doesn't)."""
    quote = data == QUOTE
    places = np.flatnonzero(quote)
    for at in places[(places > 0) & (data[np.maximum(places - 1, 0)] == SLASH)]:
        back = at
        while back > 0 and data[back - 1] == SLASH:
            back -= 1
        if (at - back + (1 if back == 0 and escaped else 0)) % 2:
            quote[at] = False
    if escaped and len(data) and data[0] == QUOTE:
        quote[0] = False
    return (np.cumsum(quote, dtype=np.uint8) + np.uint8(inside)) & 1


def structure(data: np.ndarray, inside: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of braces and brackets outside strings, +1 or -1 for each, and whether a string is open at the end."""
    string = in_strings(data, inside, escaped)
    opening = (data == OPENING[0]) | (data == OPENING[1])
    places = np.flatnonzero((opening | (data == CLOSING[0]) | (data == CLOSING[1])) & (string == 0))
    return places, np.where(opening[places], 1, -1), bool(string[-1]) if len(string) else inside


def read_range(handle, start: int, end: int) -> np.ndarray:
    handle.seek(start)
    return np.frombuffer(handle.read(end - start), dtype=np.uint8)


def key_before(handle, at: int) -> bytes:
    """The bytes shortly before an opening bracket, enough to hold its key."""
    begin = max(0, at - 256)
    handle.seek(begin)
    return handle.read(at - begin).rstrip()


def is_features(before: bytes) -> bool:
    return before.endswith(b":") and before[:-1].rstrip().endswith(b'"features"')


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: whether the string state turns over, and the change of depth for either beginning."""
    for batch in batches:
        for row in batch.to_pylist():
            with open_input(row["path"]) as handle:
                escaped = escaped_start(handle, row["start"])
                data = read_range(handle, row["start"], row["end"])
            out = [structure(data, inside, escaped) for inside in (False, True)]
            yield pa.RecordBatch.from_pylist([row | {"turns": int(out[0][2]), "outside": int(out[0][1].sum()), "inside": int(out[1][1].sum())}], schema=CHANGES)


PLACE = pa.schema([("file", pa.int32()), ("path", pa.string()), ("part", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
CHANGES = pa.schema([*PLACE, ("turns", pa.int32()), ("outside", pa.int64()), ("inside", pa.int64())])
STATED = pa.schema([*PLACE, ("string", pa.int32()), ("depth", pa.int64())])
ARRAYS = pa.schema([*STATED, ("touched", pa.bool_()), ("last_open", pa.bool_()), ("arrays", pa.int64()), ("tops", pa.int64())])


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: the arrays named ``features`` of top-level objects that begin in it, and whether one is open at its end."""
    for batch in batches:
        for row in batch.to_pylist():
            with open_input(row["path"]) as handle:
                data = read_range(handle, row["start"], row["end"])
                places, steps, _ = structure(data, bool(row["string"]), escaped_start(handle, row["start"]))
                after = row["depth"] + np.cumsum(steps)
                opened = places[(after == 2) & (steps == 1) & (data[places] == OPENING[1])]
                named = [int(at) for at in opened if is_features(key_before(handle, row["start"] + int(at)))]
            low = places[after <= 1]
            touched = bool(len(low)) or bool(named)
            open_at_end = bool(named) and (not len(low) or named[-1] > low[-1])
            tops = int(((after == 1) & (steps == 1)).sum())
            yield pa.RecordBatch.from_pylist([row | {"touched": touched, "last_open": open_at_end, "arrays": len(named), "tops": tops}], schema=ARRAYS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            found: list[tuple[int, str]] = []
            with open_input(row["path"]) as handle:
                for at, text in features_of(handle, row):
                    found.append(((row["file"] << 44) + at, text))
                    if len(found) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.string()))], names=["place", "feature"])
                        found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.string()))], names=["place", "feature"])


def features_of(handle, row: dict) -> Iterator[tuple[int, str]]:
    """``(offset, text)`` of the features that begin in a range."""
    base = row["start"]
    data = read_range(handle, base, row["end"])
    size = len(data)
    step = min(READ_ON, max(size, 1))
    escaped = escaped_start(handle, base)
    level = 2 if row["collection"] else 0
    while True:
        places, steps, _ = structure(data, bool(row["string"]), escaped)
        after = row["depth"] + np.cumsum(steps)
        starts = np.flatnonzero((after == level + 1) & (steps == 1))
        ends = np.flatnonzero((after == level) & (steps == -1))
        if len(starts) and places[starts[-1]] >= size:
            starts = starts[places[starts] < size]
        first = places[starts[0]] if len(starts) else size
        if not len(starts) or (len(ends) and ends[-1] > starts[-1]):
            break
        more = read_range(handle, base + len(data), base + len(data) + step)  # the last one goes on behind the range
        step *= 2
        if not len(more):
            raise ValueError(f"{row['path']}: the file ends inside a feature")
        data = np.concatenate([data, more])
    ends = ends[ends > starts[0]] if len(starts) else ends[:0]
    # Where the features' array is open: at the start of the range or behind its bracket, up to its end.
    open_now = bool(row["open"])
    events: list[tuple[int, bool]] = []
    if level:
        low = (after <= 1) & (places < size)
        events = [(int(at), False) for at in places[low]]
        for at in places[(after == 2) & (steps == 1) & (data[places] == OPENING[1]) & (places < size)]:
            if is_features(key_before(handle, base + int(at))):
                events.append((int(at), True))
        events.sort()
    raw = data.tobytes()
    k, end = 0, 0
    for one, two in zip(starts, ends):
        begin, stop = int(places[one]), int(places[two]) + 1
        while k < len(events) and events[k][0] < begin:
            open_now, end = events[k][1], events[k][0] + 1
            k += 1
        if level and not open_now:
            continue  # an object in some other array of the collection
        if raw[begin:begin + 1] != b"{":
            raise ValueError(f"{row['path']}: no feature at byte {base + begin}")
        if end and raw[end:begin].strip(b" \t\r\n,\x1e\xef\xbb\xbf"):
            raise ValueError(f"{row['path']}: text between features before byte {base + begin}")
        yield base + begin, raw[begin:stop].decode("utf-8")
        end = stop


def features(spark: SparkSession, files: list[tuple[str, int]], size: int) -> DataFrame:
    """``(place, feature)``: the text of every feature, with a number that orders them by file and offset.

    A file that has arrays named ``features`` in its top-level objects gives their items; else its
    top-level objects are the features themselves. Anything between features but white space and commas
    fails, as do a top-level object without features beside others that have some, and a cut-off file.
    """
    counts = spark.createDataFrame([(k, path, n) for k, (path, n) in enumerate(files)], "file int, path string, size bigint")
    parts = counts.where("size > 0").select("file", "path", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / size).cast("int"))).alias("part"))
    ranges = parts.select("file", "path", "part", (F.col("part").cast("bigint") * size).alias("start"), F.least((F.col("part").cast("bigint") + 1) * size, F.col("size")).alias("end"))
    tasks = range_tasks(spark, files, size)
    place = "file int, path string, part int, start bigint, end bigint"
    # One row per range: the windows below see a file's ranges, not its features.
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    changes = ranges.repartition(tasks, "file", "part").mapInArrow(_changes, place + ", turns int, outside bigint, inside bigint")
    state = changes.withColumn("string", (F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2).cast("int"))
    change = F.when(F.col("string") == 1, F.col("inside")).otherwise(F.col("outside"))
    state = state.withColumn("depth", F.coalesce(F.sum(change).over(before), F.lit(0))).select(*PLACE.names, "string", "depth")
    arrays = state.repartition(tasks, "file", "part").mapInArrow(_arrays, place + ", string int, depth bigint, touched boolean, last_open boolean, arrays bigint, tops bigint")
    whole = Window.partitionBy("file")
    known = F.last(F.when(F.col("touched"), F.col("last_open")), ignorenulls=True).over(before)
    mixed = F.raise_error(F.concat(F.col("path"), F.lit(": an object without features beside collections")))
    n_arrays, n_tops = F.sum("arrays").over(whole), F.sum("tops").over(whole)
    # A collection opens an object and, in it, its arrays; top-level objects are those at depth one.
    marked = arrays.withColumn("open", F.coalesce(known, F.lit(False))).withColumn("collection", n_arrays > 0).withColumn(
        "collection", F.when(F.col("collection") & (n_tops > n_arrays), mixed).otherwise(F.col("collection")))
    return marked.select(*PLACE.names, "string", "depth", "open", "collection").repartition(tasks, "file", "part").mapInArrow(_cut, "place bigint, feature string")
