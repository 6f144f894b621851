"""Cost-balanced packing of documents into token sequences (operator 9).

A piece of n tokens costs ``linear * n + quadratic * n * n``: attention stays within the piece. Whole
blocks of ``capacity`` tokens are sequences by themselves. The rests of documents go, the most costly
first, to the sequence of lowest cost that has room; a rest that fits nowhere is cut over the
sequences with most room. There are just as many sequences as the tokens need, so only the last tokens
of a task are left over, and these are cut into sequences whose lengths are powers of two.

Tokens are made and packed in one pass: each task packs its own documents, a bounded number of tokens
at a time, so nothing is shuffled, no task's memory grows with its input, and a task that runs again
on the same rows gives the same pieces. Sequence ids hold the task's number above a running number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from cartoload.llm.bpe import Vocabulary, cut_run, gather
from cartoload.llm.common import arrow_schema, map_arrow, release, slices

CAPACITY = 2048
END = 1  # the id after each document
BLOCK_TOKENS = 500_000  # packed together; bounds a task's memory
TEXT_BYTES = 2_000_000  # of texts encoded together
KNOWN_BYTES = 48_000_000  # of chunks that a task remembers with their ids; beyond it starts afresh
ENTRY_BYTES = 160  # what a chunk takes besides its letters
LEARN = 20_000  # chunks encoded together
ROW_TOKENS = 500_000  # of pieces in one batch of rows
PIECE = "doc_id bigint, start bigint, length bigint, ids array<int>, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Fixed value: the pattern of the word-end vocabulary's pre-tokenizer.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokens:
    """Ids of whole texts under a vocabulary that drops white space.

    No token reaches over ASCII white space, so texts are cut there and each distinct chunk is
    encoded once. Chunks of ASCII and Latin-1 letters, for which normalising is lower-casing, are
    merged many at a time; all others go through the tokenizers library.
    """

    def __init__(self, vocabulary_text: str):
        self.vocabulary = Vocabulary(vocabulary_text)
        self.library = Tokenizer.from_str(vocabulary_text)
        self.library.no_truncation()
        self.library.no_padding()
        self.plain = regex.compile(r"[!-;=-~À-ÿ]+")  # without <, which may begin a special token
        self.pattern = regex.compile(WORD_PATTERN)
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.held = 0
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.starts, self.lengths = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int32)
        self.used = 0

    def _add(self, chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, last = len(self.number), len(self.number) + len(chunks)
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.starts) < last:
            self.starts, self.lengths = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lengths))
        self.flat[self.used:self.used + len(ids)] = ids
        self.starts[first:last], self.lengths[first:last] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used += len(ids)
        self.held += sum(map(len, chunks)) + ENTRY_BYTES * len(chunks)
        self.number.update(zip(chunks, range(first, last)))

    def _learn(self, fresh: list[str]) -> None:
        plain, other, cut = [], [], []
        for chunk in fresh:
            if (chunk.isascii() and "<" not in chunk) or self.plain.fullmatch(chunk):
                plain.append(chunk)
                cut.append(cut_run(chunk.lower(), "", self.pattern) if chunk else [])
            else:
                other.append(chunk)
        words = list({w for ws in cut for w in ws})
        ids, lengths = self.vocabulary.merge([w.encode() for w in words])
        starts = np.cumsum(lengths) - lengths
        place = dict(zip(words, range(len(words))))
        at = np.array([place[w] for ws in cut for w in ws], dtype=np.int64)
        ends = np.r_[0, np.cumsum(lengths[at])][np.cumsum([0, *map(len, cut)])]
        self._add(plain, gather(ids, starts[at], lengths[at]), np.diff(ends))
        if other:
            made = [e.ids for k in range(0, len(other), 2_000) for e in self.library.encode_batch(other[k:k + 2_000], add_special_tokens=False)]
            self._add(other, np.array([i for ids in made for i in ids], dtype=np.int64), np.array(list(map(len, made)), dtype=np.int64))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        if self.held > KNOWN_BYTES:
            self.reset()
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        fresh = list(set(distinct).difference(self.number))
        for k in range(0, len(fresh), LEARN):
            self._learn(fresh[k:k + LEARN])
        numbers = np.fromiter(map(self.number.__getitem__, distinct), dtype=np.int64, count=len(distinct))[coded.indices.to_numpy()]
        lengths = self.lengths[numbers]
        ids = gather(self.flat, self.starts[numbers], lengths)
        ends = np.r_[0, np.cumsum(lengths)][offsets - (offsets[0] if len(offsets) else 0)].tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]


@dataclass
class Piece:
    document: int
    start: int
    length: int


@dataclass
class Packer:
    capacity: int = CAPACITY
    linear: float = 1.0
    quadratic: float = 1 / CAPACITY
    sequences: list[list[Piece]] = field(default_factory=list)

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n

    def pack(self, sizes: list[int], last: bool) -> list[Piece]:
        """Pack documents of these sizes; returns what is left over for the next block.

        Appends full sequences to ``sequences``. With ``last`` nothing is left: the rest is cut into
        sequences of powers of two.
        """
        rests = []
        for document, n in enumerate(sizes):
            whole = n - n % self.capacity
            self.sequences += [[Piece(document, s, self.capacity)] for s in range(0, whole, self.capacity)]
            if n > whole:
                rests.append(Piece(document, whole, n - whole))
        rests.sort(key=lambda p: (-p.length, p.document, p.start))
        count = sum(p.length for p in rests) // self.capacity
        room = np.full(count, self.capacity)
        costs = np.zeros(count)
        made: list[list[Piece]] = [[] for _ in range(count)]

        def put(piece: Piece, k: int) -> None:
            made[k].append(piece)
            room[k] -= piece.length
            costs[k] += self.cost(piece.length)

        over: list[Piece] = []
        for piece in rests:
            open_costs = np.where(room >= piece.length, costs, np.inf)
            k = int(open_costs.argmin()) if count else 0
            if count and open_costs[k] < np.inf:
                put(piece, k)
            else:
                over.append(piece)
        left: list[Piece] = []
        for piece in over:
            while piece.length and count and room.max():
                k = int(room.argmax())
                n = min(int(room[k]), piece.length)
                put(Piece(piece.document, piece.start, n), k)
                piece = Piece(piece.document, piece.start + n, piece.length - n)
            if piece.length:
                left.append(piece)
        self.sequences += made
        if last:
            self._powers(left)
            left = []
        return left

    def _powers(self, pieces: list[Piece]) -> None:
        total = sum(p.length for p in pieces)
        queue = list(reversed(pieces))
        while total:
            size = min(self.capacity, 1 << (total.bit_length() - 1))
            total -= size
            row: list[Piece] = []
            while size:
                piece = queue.pop()
                n = min(size, piece.length)
                row.append(Piece(piece.document, piece.start, n))
                size -= n
                if n < piece.length:
                    queue.append(Piece(piece.document, piece.start + n, piece.length - n))
            self.sequences.append(row)


def pack(spark: SparkSession, docs: DataFrame, vocabulary_text: str, capacity: int = CAPACITY, end: int = END, block_tokens: int = BLOCK_TOKENS, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document, with its ids and its place (``PIECE``); ``with_ids=False`` leaves ``ids`` out.

    Every token of every row of ``docs`` (its text's ids, then ``end``) is in exactly one piece. A
    null or empty text is the one token ``end``; a null ``doc_id`` stays null; rows that repeat an id
    are packed as documents of their own, with pieces of the same ``doc_id`` and ``start``; extra
    columns are ignored; an empty table gives no piece. A very long text is cut into many pieces and
    held by one task.
    """
    shared = spark.sparkContext.broadcast(vocabulary_text)
    columns = PIECE if with_ids else PIECE.replace("ids array<int>, ", "")
    schema = arrow_schema(columns)

    def batch_of(rows: list[tuple], parts: list[np.ndarray]) -> pa.RecordBatch:
        names = [f.name for f in schema if f.name != "ids"]
        arrays = {name: pa.array(values, type=schema.field(name).type) for name, values in zip(names, zip(*rows))}
        if with_ids:
            offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
            arrays["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int32, copy=False)))
        return pa.RecordBatch.from_arrays([arrays[name] for name in schema.names], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(shared.value)
        release()  # what parsing the vocabulary took
        first = TaskContext.get().partitionId() << 36
        done = 0
        owners: list[tuple[int | None, int, int, np.ndarray]] = []  # (doc_id, start, tokens of the document, ids)
        held = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal owners, held, done
            packer = Packer(capacity, 1.0, 1 / capacity)
            left = packer.pack([len(o[3]) for o in owners], last)
            rows: list[tuple] = []
            parts: list[np.ndarray] = []
            size = 0
            for row in packer.sequences:
                offset = 0
                for p in row:
                    name, start, total, own = owners[p.document]
                    part = own[p.start:p.start + p.length]
                    rows.append((name, start + p.start, p.length, zlib.crc32(part.astype("<u4").tobytes()), total, first + done, offset))
                    parts.append(part)
                    offset += p.length
                size += offset
                done += 1
                if size >= ROW_TOKENS:
                    yield batch_of(rows, parts)
                    rows, parts, size = [], [], 0
            if rows:
                yield batch_of(rows, parts)
            owners = [(owners[p.document][0], owners[p.document][1] + p.start, owners[p.document][2], owners[p.document][3][p.start:p.start + p.length].copy()) for p in left]
            held = 0

        for batch in (part for whole in batches for part in slices(whole, 1, TEXT_BYTES)):
            for name, ids in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1))):
                owners.append((name, 0, len(ids) + 1, np.append(ids, np.int32(end))))
                held += len(ids) + 1
            if held >= block_tokens:
                yield from flush(False)
        yield from flush(True)
        owners, tokens = [], None
        release()

    return map_arrow(docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text"), columns, run)
