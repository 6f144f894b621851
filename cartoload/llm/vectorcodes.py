"""Vector code compression by parts, with entries found over fixed pivots (operator 13).

Vectors become integers and are cut into equal consecutive parts; each part position has a codebook of
entries, and a vector's code names the nearest entry of each part. Nearest entries are found the LAESA
way: a few pivots per position stay fixed, every part's distances to them are computed once and kept
with the part; in each round only the distances from pivots to the current entries are new. The
largest difference of the two bounds a part's distance to an entry from below. Entries are tried in the
order of their bounds, in integers, until the next bound is beyond the best distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoload.llm.common import map_arrow, truncate_lineage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
PIVOTS = 4  # per part position
SCALE = 256
ROWS = 4_000  # vectors that a task looks at together
FAN = 64  # sums of tasks added up together


class Codebooks:
    """Entries ``(part, entry, component)``, and the pivots ``(part, pivot, component)``, all integers."""

    def __init__(self, first: np.ndarray, parts: int = PARTS, pivots: int = PIVOTS):
        """From the integer vectors of the first entries, one per row."""
        self.entries = np.ascontiguousarray(first.reshape(len(first), parts, -1).transpose(1, 0, 2))
        self.pivots = np.stack([own[spread(own, pivots)] for own in self.entries])

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def replaced(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """With the rounded-down means as entries; entries without parts stay, and so do the pivots."""
        new = object.__new__(Codebooks)
        new.pivots = self.pivots
        new.entries = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], self.entries)
        return new


def spread(points: np.ndarray, n: int) -> list[int]:
    """Places of up to ``n`` points far from one another: each next one has the largest sum of distances to those before."""
    chosen, total = [0], np.zeros(len(points))
    while len(chosen) < min(n, len(points)):
        total += np.sqrt(squares(points, points[chosen[-1]]))
        total[chosen] = -1
        chosen.append(int(total.argmax()))
    return chosen


def squares(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    gap = points - one
    return (gap * gap).sum(-1)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """``(row, part, pivot)`` distances of integer parts ``(row, part, component)``."""
    return np.stack([np.sqrt(squares(x, pivots[:, j]).astype(np.float64)) for j in range(pivots.shape[1])], axis=-1).astype(np.float32)


def nearest(x: np.ndarray, known: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``(entry, squared distance)`` of each part of one position, and how many distances were evaluated.

    ``known`` holds the distances to the pivots. Bounds are lowered by more than their rounding
    errors, so that an entry is passed over only if it is farther; of equal ones the first counts.
    """
    across = np.sqrt(np.stack([squares(entries, p) for p in pivots]).astype(np.float64))
    bound = np.zeros((len(x), len(entries)))
    for j in range(len(pivots)):
        mine = known[:, j, None].astype(np.float64)
        np.maximum(bound, np.abs(mine - across[j]) - 1e-6 * (mine + across[j]), out=bound)
    order = bound.argsort(1, kind="stable")
    bound = np.take_along_axis(bound, order, 1)
    bound *= bound
    entry = order[:, 0].copy()
    best = squares(x, entries[entry])
    evaluated, active = len(x), np.arange(len(x))
    for step in range(1, len(entries)):
        active = active[bound[active, step] <= best[active]]
        if not len(active):
            break
        tried = order[active, step]
        far = squares(x[active], entries[tried])
        evaluated += len(active)
        better = (far < best[active]) | ((far == best[active]) & (tried < entry[active]))
        entry[active[better]], best[active[better]] = tried[better], far[better]
    return entry, best, evaluated


def whole_numbers(rows: DataFrame) -> tuple[DataFrame, int]:
    """``(vec_id, label, numbers)`` of the rows that are kept, and the longest of these lists.

    A number whose square summed over a vector might leave 64 bits counts as the largest that doesn't
    (2 ** 27 for 64 components).
    """
    vector = F.col("embedding").cast("array<double>")
    kept = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", vector.alias("vector")).where(
        F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    most = float(1 << (62 - int(max(longest, 1) - 1).bit_length()) // 2 - 1)
    number = F.transform("vector", lambda x: F.floor(F.greatest(F.least(x * F.lit(float(SCALE)), F.lit(most)), F.lit(-most))).cast("int"))
    return kept.select("vec_id", "label", number.alias("numbers")), longest


def block(lists: pa.Array, size: int, parts: int) -> np.ndarray:
    """``(row, part, component)`` of number lists, filled up with zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == size).all():
        whole = flat
    else:
        starts = np.cumsum(lengths) - lengths
        whole = np.zeros(len(lists) * size, dtype=np.int64)
        whole[np.repeat(np.arange(len(lists)) * size - starts, lengths) + np.arange(len(flat))] = flat
    return whole.reshape(len(lists), parts, size // parts)


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            yield whole.slice(start, ROWS)


def with_pivots(spark: SparkSession, numbers: DataFrame, books: Codebooks, size: int) -> DataFrame:
    """The rows with their distances to the pivots, written once."""
    pivots = books.pivots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            far = pivot_distances(block(batch.column("numbers"), size, len(pivots)), pivots)
            raw = pa.array([row.tobytes() for row in far], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw], names=[*batch.schema.names, "far"])

    kind = numbers.schema["label"].dataType.simpleString()
    return truncate_lineage(spark, map_arrow(numbers, f"vec_id bigint, label {kind}, numbers array<int>, far binary", run), "parts")


def assigner(books: Codebooks, size: int) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a batch: its parts, and their entries and squared distances ``(row, part)``."""
    parts, _, _ = books.entries.shape

    def run(batch: pa.RecordBatch):
        x = block(batch.column("numbers"), size, parts)
        far = np.frombuffer(b"".join(batch.column("far").to_pylist()), dtype=np.float32).reshape(len(x), parts, -1)
        found = [nearest(x[:, p], far[:, p], books.entries[p], books.pivots[p]) for p in range(parts)]
        return x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    return run


def moved(ready: DataFrame, books: Codebooks, size: int) -> Codebooks:
    """The codebooks after one round. Tasks sum up their own parts; sums meet ``FAN`` at a time."""
    parts, entries, width = books.entries.shape
    assign = assigner(books, size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), dtype=np.int64)
        for batch in batches_of(batches):
            x, entry, _ = assign(batch)
            for p in range(parts):
                order = entry[:, p].argsort(kind="stable")
                own = entry[order, p]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                total[p, own[first], :width] += np.add.reduceat(x[order, p], first, axis=0)
                total[p, own[first], width] += np.diff(np.r_[first, len(own)])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["task", "sums"])

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, dtype=np.int64) for b in group.column("sums").to_pylist())
        return pa.table({"task": pa.array([group.column("task")[0].as_py() // FAN], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    partial = map_arrow(ready, "task bigint, sums binary", sums)
    for _ in range(2):  # what is left for the driver is one row for FAN * FAN tasks
        partial = partial.withColumn("group", F.expr(f"task div {FAN}")).groupBy("group").applyInArrow(lambda group: added(group), "task bigint, sums binary")
    total = np.zeros((parts, entries, width + 1), dtype=np.int64)
    for row in partial.toLocalIterator():
        total += np.frombuffer(row.sums, dtype=np.int64).reshape(total.shape)
    return books.replaced(total[:, :, :width], total[:, :, width])


def compress(spark: SparkSession, rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame, Codebooks | None]:
    """``(vec_id, label, code, error)`` of the kept rows of ``rows`` (``vec_id embedding label``), and the codebooks.

    Rows whose vector is null or holds null or non-finite components are dropped; empty vectors stay.
    Vectors that are shorter than the longest, or no multiple of ``parts`` long, are filled up with zeros.
    The first entries are the vectors of the smallest ids, null ids last, of equal ids the smaller
    vector first; with fewer than ``entries`` vectors there are as many entries. Rows that repeat an id
    or a vector are rows of their own; labels may be null and of any type; other columns are ignored.
    An empty table gives no rows and no codebooks. Components beyond some 100,000 are limited, see
    ``whole_numbers``. ``code`` has two hexadecimal digits a part.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code names one of 1 to 256 entries")
    numbers, longest = whole_numbers(rows)
    size = max(-(-longest // parts), 1) * parts
    first = numbers.orderBy(F.asc_nulls_last("vec_id"), "numbers").limit(entries).select("numbers").toArrow()
    if not first.num_rows:
        return numbers.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), None
    books = Codebooks(block(first.column(0).combine_chunks(), size, parts).reshape(first.num_rows, -1), parts, pivots)
    ready = with_pivots(spark, numbers, books, size)
    for _ in range(rounds):
        books = moved(ready, books, size)
    assign = assigner(books, size)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            _, entry, far = assign(batch)
            codes = pa.array([row.tobytes().hex() for row in entry.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), codes, pa.array(far.sum(1))], names=["vec_id", "label", "code", "error"])

    kind = ready.schema["label"].dataType.simpleString()
    return map_arrow(ready, f"vec_id bigint, label {kind}, code string, error bigint", coded), books


def with_label_errors(spark: SparkSession, coded: DataFrame) -> DataFrame:
    """The rows with ``label_error``: the errors of all rows of their label, null being one too."""
    fixed = truncate_lineage(spark, coded, "codes")
    sums = fixed.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return fixed.join(sums, fixed["label"].eqNullSafe(sums["of"])).drop("of")
