"""Near-duplicate vectors by an inverted multi-index (operator 10).

Each half of the unit vectors has its own codebook, and the product of both codebooks is a grid of
cells; every vector is filed in the cell of its two nearest codewords. A query visits cells in the
order of the summed distances to their codewords, which is the multi-sequence order: the cell of the
i-th and the j-th nearest codeword comes after at least ``i * j - 1`` others, so that the first T cells
are among those with ``i * j <= T``. T is chosen on pairs that lie just at the threshold so that a
target share of them is met; what a query meets is verified in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoload.llm.common import components, map_arrow, truncate_lineage

COSINE = 0.9
RECALL = 0.97  # of pairs right at the threshold; closer pairs meet in earlier cells
SAMPLE = 20_000  # vectors that codebooks and T are fitted on; all vectors are indexed
PER_CELL = 32  # vectors aimed at per cell, where that takes no more than MOST_CODEWORDS
MOST_CODEWORDS = 1024
BLOCK, SLICE = 2_000, 4_000  # filed vectors and queries of a cell that a task compares at once


def prepared(rows: DataFrame) -> DataFrame:
    """``(vec_id, size, digest, vector)`` per row; ``digest`` is null for vectors that link with nothing.

    ``vector`` holds the doubles in bytes; equal vectors have equal digests (0.0 and -0.0 are equal).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, vectors = [], [], []
            for name, values in zip(batch.column(0), batch.column(1)):
                row = values.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0 if values.is_valid and values.values is not None else np.zeros(0)
                good = name.is_valid and len(row) > 0 and np.isfinite(row).all() and row.any()
                raw = row.astype("<f8").tobytes() if good else None
                sizes.append(len(row))
                vectors.append(raw)
                digests.append(hashlib.blake2b(raw, digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())],
                                             names=["vec_id", "size", "digest", "vector"])

    chosen = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return map_arrow(chosen, "vec_id bigint, size int, digest binary, vector binary", run)


def units(column) -> np.ndarray:
    """Unit vectors of a column of bytes."""
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(len(column), -1)
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def distances(x: np.ndarray, code: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ code.T + (code * code).sum(1)


def codebook(x: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means codewords; a codeword that loses all its points takes a point at random."""
    code = x[draw.choice(len(x), size=k, replace=len(x) < k)]
    for _ in range(rounds):
        near = distances(x, code).argmin(1)
        sums = np.zeros_like(code)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        empty = n == 0
        code = np.where(empty[:, None], x[draw.integers(len(x), size=k)], sums / np.maximum(n, 1)[:, None])
    return code


class Grid:
    """Two codebooks and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, total: int, cosine: float, recall: float, seed: int = 42):
        draw = np.random.default_rng(seed)
        self.half = max(sample.shape[1] // 2, 1)
        self.k = int(np.clip(np.sqrt(total / PER_CELL), 1, min(MOST_CODEWORDS, len(sample))))
        self.codes = [codebook(part, self.k, draw) for part in self.halves(sample)]
        self.visits = self.needed(sample, cosine, recall, draw)

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.half], x[:, self.half:]]

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = (distances(part, code).argmin(1) for part, code in zip(self.halves(x), self.codes))
        return one.astype(np.int64) * self.k + two

    def traverse(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The first ``visits`` cells of each row of ``x`` in multi-sequence order."""
        one, two = (distances(part, code) for part, code in zip(self.halves(x), self.codes))
        first, second = one.argsort(1)[:, :visits], two.argsort(1)[:, :visits]
        i, j = np.array([(i, j) for i in range(min(visits, self.k)) for j in range(min(visits // (i + 1), self.k))]).T
        sums = np.take_along_axis(one, first, 1)[:, i] + np.take_along_axis(two, second, 1)[:, j]
        order = sums.argsort(1, kind="stable")[:, :visits]
        return np.take_along_axis(first[:, i], order, 1) * self.k + np.take_along_axis(second[:, j], order, 1)

    def needed(self, sample: np.ndarray, cosine: float, recall: float, draw: np.random.Generator) -> int:
        """Cells to visit so that of pairs at the threshold the share ``recall`` meets from either side."""
        x = sample[draw.choice(len(sample), size=min(len(sample), 1000), replace=False)]
        noise = draw.normal(size=x.shape)
        noise -= (noise * x).sum(1)[:, None] * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
        y = cosine * x + np.sqrt(1 - cosine * cosine) * noise
        most = self.k * self.k  # all cells: then every pair meets
        visits = 1
        while visits < most:
            met = (self.traverse(x, visits) == self.cells(y)[:, None]).any(1) | (self.traverse(y, visits) == self.cells(x)[:, None]).any(1)
            if met.mean() >= recall:
                break
            visits = min(most, visits + max(1, visits // 4))
        return visits


def links(spark: SparkSession, classes: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """Pairs of distinct vectors of one length: ``(a, b, a_id, b_id, a_n, b_n)`` by digest, ``a < b``.

    ``classes`` holds ``digest class_id n vector``. A cell's vectors and queries are compared in blocks
    of bounded size; a crowded cell has many blocks, which go to different tasks.
    """
    total = classes.count()
    drawn = classes.orderBy(F.xxhash64("digest"), "digest").limit(SAMPLE).select("vector").toArrow()
    if not total:
        return classes.selectExpr("digest as a", "digest as b", "class_id as a_id", "class_id as b_id", "n as a_n", "n as b_n").where("false")
    grid = Grid(units(drawn.column(0)), total, cosine, recall)  # at most 2 x MOST_CODEWORDS half vectors
    visits = grid.visits

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(grid.cells(units(batch.column(3)))), *batch.columns], names=["cell", *batch.schema.names])

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                cells = grid.traverse(units(batch.column(3)), visits)
                rows = batch.take(pa.array(np.repeat(np.arange(len(cells)), cells.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), *rows.columns], names=["cell", *batch.schema.names])

    slim = classes.select("digest", "class_id", "n", "vector")
    schema = "cell bigint, digest binary, class_id bigint, n bigint, vector binary"
    index = truncate_lineage(spark, map_arrow(slim, schema, filed), "index")
    queries = map_arrow(slim, schema, visited)
    # How crowded the cells are, as filed and as visited: the grid's size bounds both tables.
    blocks = index.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    asked = queries.select("cell").groupBy("cell").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    crowd = truncate_lineage(spark, blocks.join(asked, "cell"), "crowd")
    spot = F.xxhash64("digest")
    filed_blocks = index.join(crowd, "cell").withColumn("block", F.pmod(spot, "blocks")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    asked_blocks = queries.join(crowd, "cell").withColumn("slice", F.pmod(spot, "slices")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros((0, 2), dtype=np.int64)]
        if left.num_rows and right.num_rows:
            x, y = units(left.column("vector")), units(right.column("vector"))
            mine, theirs = (np.array(t.column("digest").to_pylist(), dtype=object) for t in (left, right))
            for start in range(0, len(x), 500):
                near = np.argwhere(x[start:start + 500] @ y.T >= cosine) + [start, 0]
                found.append(near[mine[near[:, 0]] != theirs[near[:, 1]]])
        pairs = np.concatenate(found)
        one, two = left.take(pa.array(pairs[:, 0])), right.take(pa.array(pairs[:, 1]))
        return pa.table({"p": one.column("digest"), "q": two.column("digest"), "p_id": one.column("class_id"), "q_id": two.column("class_id"), "p_n": one.column("n"), "q_n": two.column("n")})

    keys = ["cell", "block", "slice"]
    met = (asked_blocks.select(*keys, "digest", "class_id", "n", "vector").groupBy(*keys)
           .cogroup(filed_blocks.select(*keys, "digest", "class_id", "n", "vector").groupBy(*keys))
           .applyInArrow(compare, "p binary, q binary, p_id bigint, q_id bigint, p_n bigint, q_n bigint"))
    up = F.col("p") < F.col("q")
    return met.select(*[F.when(up, F.col(x + e)).otherwise(F.col(y + e)).alias(name + e) for name, x, y in (("a", "p", "q"), ("b", "q", "p")) for e in ("", "_id", "_n")]).distinct()


def near_duplicates(spark: SparkSession, rows: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``rows`` (``vec_id embedding``).

    Equal vectors are one class; ``n_links`` counts every other row of it and of the classes linked.
    Vectors that are null, empty, zero, or hold null or non-finite numbers, and rows without an id,
    link with nothing and are components of their own; vectors of different length never link. Rows
    that repeat an id count as vectors of their own, in one component. An empty table gives none;
    extra columns are ignored.
    """
    ready = truncate_lineage(spark, prepared(rows), "vectors")
    valid = ready.where("digest is not null")
    classes = truncate_lineage(spark, valid.groupBy("size", "digest").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n"), F.first("vector").alias("vector")), "classes")
    lengths = [r[0] for r in classes.select("size").distinct().orderBy("size").collect()]
    pairs = None
    for size in lengths:
        of_size = links(spark, classes.where(F.col("size") == size), cosine, recall)
        pairs = of_size if pairs is None else pairs.union(of_size)
    if pairs is None:
        return ready.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    pairs = truncate_lineage(spark, pairs, "pairs")
    # A repeated id with different vectors gives classes of one name, which then are one node.
    labels = components(spark, pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    degrees = pairs.select(F.col("a").alias("digest"), F.col("b_n").alias("m")).union(pairs.select("b", "a_n")).groupBy("digest").agg(F.sum("m").alias("m"))
    known = classes.join(degrees, "digest", "left").join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "digest", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    known = truncate_lineage(spark, known, "known")
    out = ready.join(known, "digest", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
