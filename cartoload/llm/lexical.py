"""Ranked lexical search by presence masks (operator 12).

One pass over the documents keeps, of each, the number of its terms and those that some item asks
for. Then every task goes through its documents in blocks of bounded size. For an item, each
term that it asks for sets its bit in the masks of the documents that hold it; documents of one mask
form a group, and the mask says how high the group can score at most. Groups are evaluated from the
highest on, until the next one can't reach the item's best documents any more. A task's best
documents of earlier blocks count there, and what tasks find is merged at the end.

Items are taken in batches of bounded size; only a batch's terms are held in memory.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartoload.llm.common import arrow_schema, map_arrow, slices, truncate_lineage

TOP = 20
BATCH_BYTES = 8_000_000  # text of the items that are searched together
POSTINGS = 1_000_000  # terms of documents that form a block
MASK_BYTES = 32_000_000  # masks of one item held at once
FAR_BELOW = np.iinfo(np.int64).min

#: Bytes of terms stay, A-Z in lower case; all others become spaces.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def cut_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in a row, and how many each text has; a null text has none."""
    filled = pc.fill_null(texts, "").cast(pa.large_binary())
    first, last = filled.offset, filled.offset + len(filled)
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[first:last + 1]
    data = filled.buffers()[2]
    held = data[offsets[0]:offsets[-1]].to_pybytes().translate(TERM_BYTES) if data is not None and len(offsets) else b""
    moved = pa.Array.from_buffers(pa.large_string(), len(filled), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(held)])
    lists = pc.ascii_split_whitespace(moved)
    terms = lists.flatten()
    real = pc.greater(pc.binary_length(terms), 0)  # spaces at the ends of a text leave empty ones
    ends = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][lists.offsets.to_numpy()]
    return terms.filter(real), np.diff(ends)


@dataclass
class Item:
    """One item: numbers of its terms, and for each its weight times its repeats."""

    name: int
    terms: np.ndarray
    weights: np.ndarray


def postings(docs: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """``(doc_id, n, terms, tfs)``: all terms of each document counted, and those in ``numbers`` with their frequencies."""
    names = list(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {name: place for place, name in enumerate(names)}
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found_terms, n = cut_terms(batch.column(1))
            coded = found_terms.dictionary_encode()
            numbered = np.array([own.get(t, -1) for t in coded.dictionary.to_pylist()], dtype=np.int64)
            terms = numbered[coded.indices.to_numpy()] if len(coded) else np.zeros(0, dtype=np.int64)
            docs_of = np.repeat(np.arange(len(n)), n)
            held = terms >= 0
            keys, tfs = np.unique(docs_of[held] * max(len(names), 1) + terms[held], return_counts=True)
            ends = np.searchsorted(keys, np.arange(len(n) + 1) * max(len(names), 1)).astype(np.int32)
            list_of = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), list_of(keys % max(len(names), 1), pa.int32()), list_of(tfs, pa.int64())], names=["doc_id", "n", "terms", "tfs"])

    return map_arrow(docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text"), "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>", run)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Block:
    """Postings of some documents by term, with each posting's part of the score."""

    def __init__(self, names: np.ndarray, n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray, documents: int, total: int):
        self.names = names
        sizes = n.astype(object) if 25 * int(n.max(initial=0)) * documents >= 1 << 63 else n
        m = (75 + 25 * sizes * documents // total).astype(np.int64)
        docs = np.repeat(np.arange(len(n)), lengths)
        parts = 1_000_000_000 * tfs // (1000 * tfs + 12 * m[docs])
        order = terms.argsort(kind="stable")
        self.docs, self.parts = docs[order], parts[order]
        self.terms, first = np.unique(terms[order], return_index=True)
        self.first, self.last = first, np.r_[first[1:], len(order)]
        self.highest = np.maximum.reduceat(self.parts, first) if len(first) else np.zeros(0, dtype=np.int64)

    def columns(self, item: Item) -> tuple[np.ndarray, np.ndarray]:
        """The item's terms that occur here: their places in this block, and their weights."""
        at = np.minimum(np.searchsorted(self.terms, item.terms), max(len(self.terms) - 1, 0))
        there = self.terms[at] == item.terms if len(self.terms) else np.zeros(len(item.terms), dtype=bool)
        return at[there], item.weights[there]

    def masks(self, columns: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents ``start`` to ``end`` that hold a term, and their masks: a bit for each of ``columns``, in 64-bit words."""
        words = np.zeros((end - start, max(-(-len(columns) // 64), 1)), dtype=np.uint64)
        for bit, column in enumerate(columns):
            docs = self.docs[self.first[column]:self.last[column]]
            docs = docs[np.searchsorted(docs, start):np.searchsorted(docs, end)]
            words[docs - start, bit // 64] |= np.uint64(1 << bit % 64)
        some = np.flatnonzero(words.any(1))
        return some + start, words[some]

    def scores(self, columns: np.ndarray, weights: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Exact scores of the given documents, in ascending order."""
        total = np.zeros(len(docs), dtype=np.int64)
        for column, w in zip(columns, weights):
            own = self.docs[self.first[column]:self.last[column]]
            at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            total += np.where(own[at] == docs, w * self.parts[self.first[column] + at], 0)
        return total

    def search(self, item: Item, best: list[tuple[int, int]], top: int) -> list[tuple[int, int]]:
        """The ``top`` best of ``best`` and this block's documents: ``(-score, id)``, in order.

        An id that is null stands last, as the largest number.
        """
        columns, weights = self.columns(item)
        if not len(columns):
            return best
        step = max(MASK_BYTES // (8 * -(-len(columns) // 64)), 1)
        for start in range(0, len(self.names), step):
            docs, words = self.masks(columns, start, min(start + step, len(self.names)))
            if not len(docs):
                continue
            flat = words[:, 0] if words.shape[1] == 1 else np.ascontiguousarray(words).view(np.dtype((np.void, 8 * words.shape[1])))[:, 0]
            groups, first, group_of, sizes = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
            bits = np.unpackbits(words[first].astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :len(columns)]
            limits = bits.astype(np.int64) @ (weights * self.highest[columns])
            ranked = limits.argsort(kind="stable")[::-1]
            members = group_of.argsort(kind="stable")
            ends = np.cumsum(sizes)
            done, wanted = 0, 2 * top
            while done < len(ranked):
                least = -best[-1][0] if len(best) == top else 1
                reached = np.cumsum(sizes[ranked[done:]]).searchsorted(wanted) + 1
                chosen = ranked[done:done + reached]
                chosen = chosen[limits[chosen] >= least]
                if not len(chosen):
                    break  # the groups that are left score less than the best that are known
                rows = np.sort(np.concatenate([members[ends[g] - sizes[g]:ends[g]] for g in chosen]))
                score = self.scores(columns, weights, docs[rows])
                high = score >= least
                found = list(zip((-score[high]).tolist(), self.names[docs[rows[high]]].tolist()))
                best = sorted(best + found)[:top]
                done, wanted = done + reached, 2 * wanted
        return best


NO_ID = np.iinfo(np.int64).max


def found(held: DataFrame, items: list[Item], documents: int, total: int, top: int) -> DataFrame:
    """``(item, doc_id, score)``: the best documents of each task, ``top`` an item at most."""
    schema = arrow_schema("item int, doc_id bigint, score bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        waiting: list[pa.RecordBatch] = []

        def search() -> None:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            lists = [whole.column(c).combine_chunks() for c in ("terms", "tfs")]
            block = Block(pc.fill_null(whole.column("doc_id"), NO_ID).to_numpy(), whole.column("n").to_numpy(), lists[0].value_lengths().to_numpy().astype(np.int64),
                          lists[0].flatten().to_numpy().astype(np.int64), lists[1].flatten().to_numpy(), documents, total)
            for place, item in enumerate(items):
                best[place] = block.search(item, best[place], top)

        size = 0
        for batch in (part for whole in batches for part in slices(whole, 2)):
            waiting.append(batch)
            size += len(batch.column(2).flatten()) + batch.num_rows
            if size >= POSTINGS:
                search()
                size = 0
        if waiting:
            search()
        rows = [(place, name, -minus) for place, own in enumerate(best) for minus, name in own]
        for start in range(0, len(rows), 100_000):
            columns = list(zip(*rows[start:start + 100_000]))
            names = pa.array(columns[1], pa.int64())
            names = pc.if_else(pc.equal(names, NO_ID), None, names)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), names, pa.array(columns[2], pa.int64())], schema=schema)

    return map_arrow(held.where("size(terms) > 0"), "item int, doc_id bigint, score bigint", run)


def batches_of_items(spark: SparkSession, items: DataFrame, most: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in lists of not much more than ``most`` bytes of text; a longer text is a list of its own."""
    fixed = truncate_lineage(spark, items.selectExpr("cast(item_id as bigint) as item_id", "cast(text as string) as text"), "items")
    spread = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(fixed.agg(F.sum(F.octet_length("text"))).first()[0] or 0, 1) * 2 // most + 1))
    numbered = fixed.withColumn("bin", spread)
    for row in numbered.groupBy("bin").count().orderBy("bin").toLocalIterator():
        held, size = [], 0
        for item in numbered.where(F.col("bin") == row.bin).toLocalIterator():
            if held and size + len(item.text or "") > most:
                yield held
                held, size = [], 0
            held.append((item.item_id, item.text))
            size += len(item.text or "")
        yield held


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = TOP, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``top`` documents with a score above 0.

    ``docs`` has ``doc_id text``, ``items`` has ``item_id text``. Ranks count from 1, highest score first, equal
    scores by ascending id, a null id last; rows that repeat a ``doc_id`` are documents of their own, and rows that
    repeat an ``item_id`` are items of their own (with ranks of their own). A null or empty text has no term: such
    documents are found by none, such items find none. Very long texts are cut into terms as a whole. Without
    documents or items there is no row; other columns are ignored.
    """
    parts = []
    for batch in batches_of_items(spark, items, batch_bytes):
        counted = [(name, Counter(t.decode("utf-8", "surrogatepass") for t in terms_of(text))) for name, text in batch]
        numbers: dict[str, int] = {}
        for _, terms in counted:
            for term in terms:
                numbers.setdefault(term, len(numbers))
        held = truncate_lineage(spark, postings(docs, numbers), "postings")
        documents, total = held.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not documents:
            continue
        dfs = dict(held.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator())  # one row a term of the batch at most
        weights = np.array([weight(documents, dfs[k]) if k in dfs else 0 for k in range(len(numbers))], dtype=np.int64)
        asked = []
        for name, terms in counted:
            own = np.array(sorted(numbers[t] for t in terms), dtype=np.int64)
            times = dict((numbers[t], c) for t, c in terms.items())
            scaled = weights[own] * np.array([times[k] for k in own.tolist()], dtype=np.int64) if len(own) else own
            asked.append(Item(name, own[scaled > 0], scaled[scaled > 0]))
        names = spark.createDataFrame([(k, item.name) for k, item in enumerate(asked)], "item int, item_id bigint")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found(held, asked, documents, total, top).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        parts.append(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole
