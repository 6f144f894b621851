"""Shape records of a batch as offset arrays, next to a version that takes record by record."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartoload.functions import ragged
from cartoload.functions.geometry import path_text, plain
from cartoload.plans import sample_files as files


def _rings(parts: np.ndarray, points: np.ndarray) -> list[np.ndarray]:
    return np.split(points, parts[1:])


def _clockwise(ring: np.ndarray) -> bool:
    x, y = ring[:, 0], ring[:, 1]
    return float(np.dot(x[:-1], y[1:]) - np.dot(x[1:], y[:-1])) <= 0


def shape_wkt(record: bytes) -> str | None:
    """WKT of one shape record body."""
    code = int.from_bytes(record[:4], "little")
    if code == 0:
        return None
    base = code % 10
    if base == 1:
        x, y = np.frombuffer(record, "<f8", 2, 4)
        return f"POINT({plain(x)} {plain(y)})"
    if base == 8:
        count = int.from_bytes(record[36:40], "little")
        points = np.frombuffer(record, "<f8", 2 * count, 40).reshape(-1, 2).tolist()
        return "MULTIPOINT(" + ",".join(f"({plain(x)} {plain(y)})" for x, y in points) + ")"
    if base not in (3, 5):
        raise ValueError(f"Could not obtain shape of type {code}")
    part_count, point_count = np.frombuffer(record, "<i4", 2, 36)
    parts = np.frombuffer(record, "<i4", part_count, 44)
    points = np.frombuffer(record, "<f8", 2 * point_count, 44 + 4 * part_count).reshape(-1, 2)
    pieces = _rings(parts, points)
    if base == 3:
        return "MULTILINESTRING(" + ",".join(path_text(piece.tolist()) for piece in pieces) + ")"
    polygons: list[list[str]] = []
    for ring in pieces:
        if _clockwise(ring) or not polygons:
            polygons.append([])
        polygons[-1].append(path_text(ring.tolist()))
    return "MULTIPOLYGON(" + ",".join(f"({','.join(rings)})" for rings in polygons) + ")"


NUMBERS = st.one_of(st.integers(-1000, 1000).map(float), st.floats(allow_nan=False, allow_infinity=False))
POINT = st.tuples(NUMBERS, NUMBERS)
GRID = st.tuples(st.integers(-9, 9), st.integers(-9, 9))


def multipoint(points):
    return np.array([8], "<i4").tobytes() + bytes(32) + np.array([len(points)], "<i4").tobytes() + np.array(points, "<f8").tobytes()


RECORD = st.one_of(
    st.just(np.array([0], "<i4").tobytes()),
    POINT.map(lambda p: files.point_record(*p)),
    st.lists(POINT, min_size=1, max_size=4).map(multipoint),
    st.lists(st.lists(POINT, min_size=2, max_size=5), min_size=1, max_size=4).map(lambda parts: files.parts_record(3, parts)),
    st.lists(st.lists(GRID, min_size=3, max_size=6).map(lambda ring: ring + ring[:1]), min_size=1, max_size=5).map(lambda parts: files.parts_record(5, parts)))


@settings(max_examples=150, deadline=None)
@given(st.lists(RECORD, max_size=12))
def test_batches_equal_single_records(records):
    starts = np.cumsum([3, *map(len, records)])[:-1]  # not at the start of the bytes, nor aligned
    found = ragged.shape_texts(b"abc" + b"".join(records), starts.astype(np.int64))
    assert found.to_pylist() == [shape_wkt(record) for record in records]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), max_size=30))
def test_number_texts(numbers):
    assert ragged.number_texts(np.array(numbers, dtype="f8")).to_pylist() == [plain(n) for n in numbers]


def test_far_rings_keep_their_turn():
    """The turn of a small ring far from the origin, where products of whole coordinates have lost it."""
    x, y = 1e8, 5e8
    ring = [(x, y), (x, y + 1e-3), (x + 1e-3, y + 1e-3), (x + 1e-3, y), (x, y)]
    points = np.array(ring + ring[::-1])
    assert ragged.clockwise(points, np.array([5, 5])).tolist() == [True, False]


def test_unknown_kinds_fail():
    with pytest.raises(ValueError, match="type 4"):
        ragged.shape_texts(np.array([4], "<i4").tobytes(), np.array([0]))


def test_no_records():
    assert ragged.shape_texts(b"", np.zeros(0, np.int64)) == pa.array([], pa.string())
