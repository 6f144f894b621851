"""What several operators share: text scanning inside tasks, scratch tables, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cartoload.session import scratch, truncate_lineage  # noqa: F401  (used by the operators)

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


SLICE = 4_000_000  # bytes of text that a function gets at once
ITEMS = 500_000  # or list items
BATCH_BYTES = 4_000_000  # of rows that Spark sends a Python worker at once; else up to 64 MB lie in both


def slices(batch: pa.RecordBatch, place: int, text_bytes: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts or lists in one column are not much over ``text_bytes`` or ``ITEMS`` together."""
    column = batch.column(place)
    if pa.types.is_list(column.type):
        sizes, most = pc.list_value_length(column), ITEMS
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        sizes, most = pc.binary_length(column), text_bytes
    else:
        sizes = None
    if sizes is None or batch.num_rows == 0:
        yield batch
        return
    part = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for start, end in zip(edges, edges[1:]):
        yield batch.slice(start, end - start)


def release() -> None:
    """Give memory that a task has freed back to the system; workers live on for the next stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def annotate(df: DataFrame, uses: list[str], fields: str, function: Callable[..., list], text_bytes: int = SLICE) -> DataFrame:
    """``df`` with the columns ``fields`` that ``function`` makes of the columns ``uses``, batch by batch.

    ``function`` gets about ``text_bytes`` of the first used column at once; it takes one Arrow array per used column and returns one list or array per field. An
    input column named like a field (in any case) is replaced, as by ``withColumn``.
    """
    added = T._parse_datatype_string(fields)
    taken = {f.name.lower() for f in added}
    kept = [f for f in df.schema if f.name.lower() not in taken]
    places = {f.name.lower(): i for i, f in enumerate(df.schema)}
    use = [places[u.lower()] for u in uses]
    stay = [i for i, f in enumerate(df.schema) if f.name.lower() not in taken]
    schema = T.StructType(kept + list(added))
    types = [f.type for f in to_arrow_schema(added)]
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, use[0], text_bytes)):
            made = function(*[batch.column(i) for i in use])
            new = [m if isinstance(m, pa.Array) else pa.array(m, type=t) for m, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in stay] + new, names=names)
            made = new = None
        release()

    return in_batches(df).mapInArrow(run, schema)


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Python workers ``BATCH_BYTES`` at once from here on (Spark reads this setting as a job starts)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def map_arrow(df: DataFrame, schema: str, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` with the schema as DDL text."""
    return in_batches(df).mapInArrow(function, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(ddl))


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links ``(a, b)``: the smallest node reachable.

    Each round every label takes the smallest label over its links, then labels point to their own
    label's label; links inside one label are dropped, the rest go on between labels. Both steps
    aggregate before they shuffle, so a node with very many links is no single task. Rounds are
    written below ``spark.checkpoint.dir``; nothing but the count of open links reaches the driver.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    open_links = truncate_lineage(
        spark, both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = open_links.select(F.col("a").alias("node")).union(open_links.select("b")).distinct()
    steps: list[DataFrame] = []
    while not open_links.isEmpty():
        # Every node's smallest neighbour or itself: always pointing down, so the pointers form trees.
        pointer = open_links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        pointer = truncate_lineage(spark, pointer, "pointers")
        while True:  # follow the trees to their roots, twice as far each time
            upper = pointer.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = pointer.join(upper, "up", "left").select("node", "up", "top")
            jumped = truncate_lineage(spark, jumped, "pointers")
            pointer = jumped.select("node", F.coalesce("top", "up").alias("up"))
            if jumped.where("top is not null").isEmpty():
                break
        steps.append(pointer)
        left = pointer.select(F.col("node").alias("a"), F.col("up").alias("a_up"))
        right = pointer.select(F.col("node").alias("b"), F.col("up").alias("b_up"))
        moved = open_links.join(left, "a", "left").join(right, "b", "left").select(
            F.coalesce("a_up", "a").alias("x"), F.coalesce("b_up", "b").alias("y"))
        open_links = truncate_lineage(
            spark, moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    labels = nodes.withColumn("component", F.col("node"))
    for pointer in steps:
        labels = labels.join(pointer.withColumnsRenamed({"node": "component", "up": "root"}), "component", "left").select(
            "node", F.coalesce("root", "component").alias("component"))
    return labels
