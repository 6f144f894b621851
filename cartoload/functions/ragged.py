"""V5-V7 inside tasks: geometries of a batch as offset arrays, coordinates to rings to polygons to shapes.

Coordinates of all geometries lie in one array; offsets say which of them make a ring, which rings a
polygon and which polygons a geometry. Numbers become text and are put together level by level, by
Arrow's kernels, with no Python object for a coordinate, ring or geometry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cartoload.functions.geometry import plain

TEXT = pa.large_string()


def runs(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + length]``, one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def edges(lengths: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(lengths)].astype(np.int64)


def number_texts(numbers: np.ndarray) -> pa.Array:
    """V15 for an array of doubles: shortest digits, no exponent, no decimal point behind whole numbers."""
    texts = pc.replace_substring_regex(pa.array(numbers).cast(TEXT), pattern=r"\.0\z", replacement="")
    odd = np.flatnonzero(pc.match_substring_regex(texts, pattern="[en]").to_numpy(zero_copy_only=False))
    if not len(odd):
        return texts
    mask = np.zeros(len(numbers), dtype=bool)
    mask[odd] = True
    return pc.replace_with_mask(texts, pa.array(mask), pa.array([plain(n) for n in numbers[odd].tolist()], TEXT))


def pair_texts(points: np.ndarray) -> pa.Array:
    """``x y`` of each point of an ``(n, 2)`` array."""
    return pc.binary_join_element_wise(number_texts(points[:, 0].copy()), number_texts(points[:, 1].copy()), pa.scalar(" ", TEXT))


def grouped(texts: pa.Array, lengths: np.ndarray, before: str = "(", after: str = ")") -> pa.Array:
    """Runs of ``lengths`` texts, joined by commas, in brackets."""
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(edges(lengths)), texts), pa.scalar(",", TEXT))
    return pc.binary_join_element_wise(pa.scalar(before, TEXT), joined, pa.scalar(after, TEXT), pa.scalar("", TEXT))


def clockwise(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which rings, runs of ``lengths`` points, turn right or have no area. Rings are closed; they are seen from their own first point, which keeps small ones exact."""
    ring = np.repeat(np.arange(len(lengths)), lengths)
    offsets = edges(lengths)
    local = points - points[np.minimum(offsets[:-1], max(len(points) - 1, 0))][ring] if len(points) else points
    inside = ring[:-1] == ring[1:]
    cross = local[:-1, 0] * local[1:, 1] - local[1:, 0] * local[:-1, 1]
    return np.bincount(ring[:-1][inside], weights=cross[inside], minlength=len(lengths)) <= 0


def _read(body: np.ndarray, at: np.ndarray, dtype: str) -> np.ndarray:
    """One value of ``dtype`` at each place."""
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(body[at[:, None] + np.arange(width)]).view(dtype)[:, 0] if len(at) else np.zeros(0, dtype)


def _points(body: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return runs(body, at, counts * 16).view("<f8").reshape(-1, 2)


def shape_texts(content: bytes, starts: np.ndarray) -> pa.Array:
    """V7: WKT of the shape records that start at ``starts`` of ``content``; null for records without a shape. M and Z are not carried."""
    body = np.frombuffer(content, np.uint8)
    code = _read(body, starts, "<i4").astype(np.int64)
    base = code % 10
    known = (code == 0) | np.isin(base, (1, 3, 5, 8))
    if not known.all():
        raise ValueError(f"Could not obtain shape of type {code[~known][0]}")
    rows, made = [np.flatnonzero(code == 0)], [pa.nulls(int((code == 0).sum()), TEXT)]
    for kind in (1, 8, 3, 5):
        row = np.flatnonzero((base == kind) & (code != 0))
        if not len(row):
            continue
        at = starts[row]
        if kind == 1:
            texts = grouped(pair_texts(_points(body, at + 4, np.ones(len(row), np.int64))), np.ones(len(row), np.int64), "POINT(")
        elif kind == 8:
            counts = _read(body, at + 36, "<i4").astype(np.int64)
            pairs = pair_texts(_points(body, at + 40, counts))
            texts = grouped(grouped(pairs, np.ones(len(pairs), np.int64)), counts, "MULTIPOINT(")
        else:
            parts, counts = (_read(body, at + k, "<i4").astype(np.int64) for k in (36, 40))
            begins = runs(body, at + 44, parts * 4).view("<i4").astype(np.int64)
            points = _points(body, at + 44 + 4 * parts, counts)
            # A part ends where the next one begins, the last one of a record with the record's points.
            ends = np.r_[begins[1:], 0] if len(begins) else begins
            last = np.cumsum(parts)[parts > 0] - 1
            ends[last] = counts[parts > 0]
            lengths = ends - begins
            rings = grouped(pair_texts(points), lengths)
            if kind == 3:
                texts = grouped(rings, parts, "MULTILINESTRING(")
            else:
                outer = clockwise(points, lengths)
                outer[(np.cumsum(parts) - parts)[parts > 0]] = True
                owner = np.repeat(np.arange(len(row)), parts)
                polygons = grouped(rings, np.diff(np.r_[np.flatnonzero(outer), len(outer)]))
                texts = grouped(polygons, np.bincount(owner[outer], minlength=len(row)), "MULTIPOLYGON(")
        rows.append(row)
        made.append(texts)
    place = np.empty(len(starts), np.int64)
    place[np.concatenate(rows)] = np.arange(len(starts))
    return pa.concat_arrays(made).take(pa.array(place)).cast(pa.string())
