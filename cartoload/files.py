"""File access for driver headers and for executor tasks, on any file system Arrow knows."""

from __future__ import annotations

import posixpath

from pyarrow import fs as pafs


def resolve(path: str):
    """``(filesystem, path)`` for a plain path or a URI."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def open_input(path: str):
    system, inner = resolve(path)
    return system.open_input_file(inner)


def is_file(path: str) -> bool:
    system, inner = resolve(path)
    return system.get_file_info(inner).type == pafs.FileType.File


def list_files(path: str, *suffixes: str) -> list[tuple[str, int]]:
    """``(path, size)`` of one file, or of all matching files below a folder, in name order."""
    system, inner = resolve(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else "file://"
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [
        (prefix + item.path, item.size)
        for item in system.get_file_info(pafs.FileSelector(inner, recursive=True))
        if item.type == pafs.FileType.File
        and item.path.endswith(suffixes)
        and not posixpath.basename(item.path).startswith(("_", "."))
    ]
    if not found:
        raise FileNotFoundError(f"no {'/'.join(suffixes)} file below {path}")
    return sorted(found)


OPEN_COST = 4 << 20  # what opening a file counts for, in bytes, when small files share a task


def packed(files: list[list[tuple[int, object]]], size: int) -> list[list]:
    """Work per task from the ``(bytes, piece)`` lists of files.

    The pieces of a divided file get a task each; files of one piece share tasks of about ``size``.
    """
    divided = [[piece] for pieces in files if len(pieces) > 1 for _, piece in pieces]
    shared: list[list] = []
    room = 0
    for weight, piece in (pieces[0] for pieces in files if len(pieces) == 1):
        cost = weight + OPEN_COST
        if not shared or cost > room:
            shared.append([])
            room = max(size, OPEN_COST)
        shared[-1].append(piece)
        room -= cost
    return divided + shared


def first_file(path: str, *suffixes: str) -> str:
    return list_files(path, *suffixes)[0][0]


def first_line(path: str, encoding: str = "utf-8-sig") -> str:
    """The first text line without its line end, reading no more than needed."""
    with open_input(path) as handle:
        head = b""
        while b"\n" not in head:
            piece = handle.read(1 << 16)
            if not piece:
                break
            head += piece
    if not head:
        raise ValueError(f"Could not get first line of {path}")
    return head.split(b"\n", 1)[0].rstrip(b"\r").decode(encoding)


def put_file(path: str, writer) -> None:
    """Write under a temporary name and move into place, so a retried task leaves one whole file."""
    import os
    import uuid

    system, inner = resolve(path)
    folder, name = posixpath.split(inner)
    hidden = posixpath.join(folder, f"_{os.getpid()}-{uuid.uuid4().hex}-{name}")
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(hidden) as sink:
        writer(sink)
    system.move(hidden, inner)
