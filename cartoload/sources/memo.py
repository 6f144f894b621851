"""Memo columns of shapefiles, kept in a file of blocks beside the table.

A cell of the table points to a block of the memo file. A task joins the pointers of its own records to
that file: they are taken once each and in order, near ones are read together, and no read is
longer than ``READ_BYTES`` unless one memo is. So a memo file is read about once in all, by ranges, whatever
the number of tasks, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs

from cartoload.files import open_input, resolve

#: The table's version byte tells how its memo file is laid out.
ENDED = (0x83,)  # blocks of 512 bytes, a memo goes up to the byte 0x1A
STATED = (0x8B, 0xCB)  # block size in the header; a mark, and the length with these 8 bytes, little-endian
TYPED = (0x30, 0x31, 0x32, 0xF5)  # block size in the header, big-endian; a kind, and the length without these 8 bytes
END = b"\x1a"
MARK = b"\xff\xff\x08\x00"

READ_BYTES = 4 << 20  # read at once
NEAR_BYTES = 64 << 10  # memos this near to each other are read together
HOLD_BYTES = 16 << 20  # of memo text in one batch of records


def pointers(cells: np.ndarray) -> np.ndarray:
    """Block of each cell, 0 where it has none: a binary number in cells of four bytes, digits in others."""
    cells = np.ascontiguousarray(cells)
    if cells.dtype.itemsize == 4:
        return cells.view("<u4").astype(np.int64)
    texts = pa.array([bytes(cell).strip(b" \0").decode("ascii") for cell in cells.tolist()], pa.string())
    return pc.if_else(pc.equal(texts, ""), "0", texts).cast(pa.int64()).to_numpy()


class MemoFile:
    """The memo file of one table, open for the time of a task."""

    def __init__(self, table_path: str, version: int):
        stem = table_path[: -len(".dbf")]
        suffix = ".fpt" if version in TYPED else ".dbt"
        if version not in (*ENDED, *STATED, *TYPED):
            raise ValueError(f"{table_path} has memo columns, but a version without memos: {version}")
        system, inner = resolve(stem + suffix)
        info = system.get_file_info(inner)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"memo columns need {stem + suffix}")
        self.path, self.version, self.size = stem + suffix, version, info.size
        self.handle = open_input(self.path)
        head = self.handle.read(24)
        self.block = 512
        if version in TYPED:
            self.block = int.from_bytes(head[6:8], "big") or 512
        elif version in STATED:
            self.block = int.from_bytes(head[20:22], "little") or 512
        self.first, self.held = 0, b""

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.handle.close()

    def _bytes(self, start: int, end: int, ahead: int) -> bytes:
        """Bytes of the file from ``start`` to ``end``; what a read up to ``ahead`` brings beyond is kept for the next call."""
        if start < self.first or end > self.first + len(self.held):
            self.handle.seek(start)
            self.first, self.held = start, self.handle.read(max(end, ahead) - start)
        return self.held[start - self.first:end - self.first]

    def _memo(self, block: int, ahead: int) -> bytes:
        start = block * self.block
        if not 0 < start < self.size:
            raise ValueError(f"{self.path} has no block {block}")
        if self.version in ENDED:
            step = 512
            while True:
                found = self._bytes(start, min(start + step, self.size), ahead)
                at = found.find(END)
                if at >= 0 or start + step >= self.size:
                    return found[:at] if at >= 0 else found
                step *= 2
        head = self._bytes(start, start + 8, ahead)
        if self.version in TYPED:
            length = int.from_bytes(head[4:8], "big")
        else:
            length = int.from_bytes(head[4:8], "little") - 8
            if head[:4] != MARK or length < 0:
                raise ValueError(f"{self.path} has no memo at block {block}")
        if start + 8 + length > self.size:
            raise ValueError(f"{self.path} ends within the memo at block {block}")
        return self._bytes(start + 8, start + 8 + length, ahead)

    def texts(self, blocks: np.ndarray) -> Iterator[tuple[int, int, pa.Array]]:
        """``(first, last, memos)`` of consecutive runs of the pointers, in order; a memo of no block is the empty text.

        A run ends where its memos take ``HOLD_BYTES``, counting one for every record that points to it.
        """
        wanted = np.unique(blocks[blocks > 0])
        starts = wanted * self.block
        # The last pointer of each group of near ones: reads go up to there, a part at a time.
        last = np.flatnonzero(np.r_[np.diff(starts) > NEAR_BYTES, True]) if len(starts) else starts
        until = starts[last[np.searchsorted(last, np.arange(len(starts)))]] + NEAR_BYTES if len(starts) else starts
        first, size = 0, 0
        known: dict[int, str] = {0: ""}
        made: list[str] = []
        begins = dict(zip(wanted.tolist(), until.tolist()))
        for place, block in enumerate(blocks.tolist()):
            if block not in known:
                start = block * self.block
                known[block] = self._memo(block, min(begins[block], start + READ_BYTES, self.size)).decode("utf-8")
            made.append(known[block])
            size += len(made[-1])
            if size > HOLD_BYTES:
                yield first, place + 1, pa.array(made, pa.string())
                first, size, known, made = place + 1, 0, {0: ""}, []
        if made or not len(blocks):
            yield first, len(blocks), pa.array(made, pa.string())
