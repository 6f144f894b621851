"""S3: one named sheet of many ``.xlsx`` workbooks, one task per workbook, rows streamed."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cartoload.files import list_files, open_input
from cartoload.functions.names import table_name
from cartoload.functions.values import empty_to_null, workbook_text
from cartoload.sources.base import Scan, project

BATCH_ROWS = 5000
TASK_BYTES = 8 << 20  # of workbooks that share a task
CELL = pa.struct([("kind", pa.string()), ("raw", pa.string())])
ROWS = pa.schema([("path", pa.string()), ("row", pa.int32()), ("cells", pa.list_(CELL))])
ROWS_DDL = "path string, row int, cells array<struct<kind:string,raw:string>>"

# Built-in number formats that show a date or time.
DATE_FORMATS = set(range(14, 23)) | set(range(45, 48))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _children(book: zipfile.ZipFile, name: str, tag: str):
    if name not in book.namelist():
        return
    with book.open(name) as stream:
        for _, element in ElementTree.iterparse(stream):
            if _local(element.tag) == tag:
                yield element


def _text(element) -> str:
    """Plain and rich text of a string item, without phonetic runs."""
    parts = []
    for child in element:
        if _local(child.tag) == "t":
            parts.append(child.text or "")
        elif _local(child.tag) == "r":
            parts.append(_text(child))
    return "".join(parts)


def _sheet_file(book: zipfile.ZipFile, sheet: str) -> str:
    targets = {e.get("Id"): e.get("Target") for e in
               _children(book, "xl/_rels/workbook.xml.rels", "Relationship")}
    for element in _children(book, "xl/workbook.xml", "sheet"):
        if element.get("name") == sheet:
            key = next(v for k, v in element.attrib.items() if _local(k) == "id" and k != "sheetId")
            target = targets[key]
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError(f'Could not find sheet "{sheet}"')


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    custom = {}
    for element in _children(book, "xl/styles.xml", "numFmt"):
        bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", element.get("formatCode", "").lower())
        custom[int(element.get("numFmtId"))] = bool(re.search("[dmyhs]", bare))
    for element in _children(book, "xl/styles.xml", "cellXfs"):
        ids = [int(xf.get("numFmtId", "0")) for xf in element]
        return [i in DATE_FORMATS or custom.get(i, False) for i in ids]
    return []


def _column_number(reference: str) -> int:
    number = 0
    for letter in reference:
        if not letter.isalpha():
            break
        number = number * 26 + ord(letter.upper()) - 64
    return number - 1


def _cell(element, shared: list[str], dates: list[bool]):
    """``(kind, raw text)``, or None for an empty cell."""
    kind = element.get("t", "n")
    value = next((c for c in element if _local(c.tag) in ("v", "is")), None)
    if value is None:
        return None
    if kind == "inlineStr":
        return "s", _text(value)
    if not value.text:
        return None
    if kind == "s":
        return "s", shared[int(value.text)]
    if kind in ("str", "d"):
        return "s", value.text
    if kind in ("b", "e"):
        return kind, value.text
    style = int(element.get("s", "0"))
    return ("d" if style < len(dates) and dates[style] else "n"), value.text


def sheet_rows(stream, sheet: str):
    """Rows of the used range as lists of cells; the first one is the header."""
    with zipfile.ZipFile(stream) as book:
        shared = [_text(e) for e in _children(book, "xl/sharedStrings.xml", "si")]
        dates = _date_styles(book)
        first_column = width = expected = None
        number = -1
        with book.open(_sheet_file(book, sheet)) as xml:
            rows = None
            for event, element in ElementTree.iterparse(xml, ("start", "end")):
                if event == "start":
                    if rows is None and _local(element.tag) == "sheetData":
                        rows = element
                    continue
                if _local(element.tag) != "row":
                    continue
                number = int(element.get("r", number + 2)) - 1
                cells = {}
                for i, item in enumerate(element):
                    at = _column_number(item.get("r", "")) if item.get("r") else i
                    cell = _cell(item, shared, dates)
                    if cell:
                        cells[at] = cell
                element.clear()
                if rows is not None:
                    rows.clear()  # else every row read stays in the tree
                if not cells:
                    continue
                if first_column is None:
                    first_column, width = min(cells), max(cells) - min(cells) + 1
                    expected = number
                if min(cells) < first_column or max(cells) >= first_column + width:
                    raise ValueError(f"Excel row {number + 1} is wider than the {width} header cells")
                for _ in range(expected, number):
                    yield [None] * width
                expected = number + 1
                yield [cells.get(first_column + i) for i in range(width)]


def header(path: str, sheet: str) -> list:
    with open_input(path) as handle:
        found = next(sheet_rows(handle, sheet), None)
    if found is None:
        raise ValueError(f'Could not find header row in "{sheet}" of {path}')
    return found


def _parser(sheet: str, width: int):
    def parse(batches):
        for path in (path for batch in batches for path in batch["path"].to_pylist()):
            with open_input(path) as handle:
                yield from _batches(path, sheet_rows(handle, sheet), width)

    return parse


def _batches(path: str, rows, width: int):
    size = len(next(rows, []))
    if size != width:
        raise ValueError(f"{path} has {size} header cells but expected {width}")
    pending, number = [], 0
    for cells in rows:
        pending.append([{"kind": c[0], "raw": c[1]} if c else {} for c in cells])
        if len(pending) == BATCH_ROWS:
            yield _batch(path, number, pending)
            number, pending = number + len(pending), []
    if pending:
        yield _batch(path, number, pending)


def _batch(path, number, pending):
    size = len(pending)
    return pa.RecordBatch.from_arrays([
        pa.array([path] * size, pa.string()),
        pa.array(range(number, number + size), pa.int32()),
        pa.array(pending, pa.list_(CELL)),
    ], schema=ROWS)


def scan(spark: SparkSession, options: dict) -> Scan:
    path, sheet = options["file_path"], options["sheet_name"]
    files = list_files(path, ".xlsx")
    names = [_header_text(cell) for cell in header(files[0][0], sheet)]
    # Tasks take paths and read a workbook as a stream; its bytes go through no batch.
    tasks = min(len(files), max(spark.sparkContext.defaultParallelism, sum(size for _, size in files) // TASK_BYTES + 1))
    books = spark.createDataFrame(files, "path string, size bigint").select("path").repartitionByRange(tasks, "path")
    rows = books.mapInArrow(_parser(sheet, len(names)), ROWS_DDL)
    cell = F.col("cells")
    parts = [
        (name, "Text", empty_to_null(workbook_text(cell[i]["kind"], cell[i]["raw"])))
        for i, name in enumerate(names)
    ]
    return Scan(table_name(path), project(rows, parts))


def _header_text(cell) -> str:
    if cell is None:
        return ""
    kind, raw = cell
    if kind == "e":
        raise ValueError(f"Cell error, {raw}")
    return raw
