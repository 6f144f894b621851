"""Delimited text with a header row, every column Text."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoload.files import first_line, list_files
from cartoload.functions.names import table_name
from cartoload.sources import csvranges
from cartoload.sources.base import Scan, project, quoted, split_bytes

LARGEST_RANGE = 2 << 20  # a task takes several ranges, one after the other; its arrays are ten times a range


def header_of(options: dict) -> list[str]:
    """The header of the first file that holds anything; writers leave empty files for partitions without rows."""
    files, delimiter = list_files(options["file_path"], ".csv", ".txt"), options["delimiter"]
    filled = [path for path, size in files if size] or [files[0][0]]
    return next(csv.reader([first_line(filled[0])], delimiter=delimiter))


def ranges(spark: SparkSession, options: list[dict], width: int, placed: bool = False) -> DataFrame:
    """Cells of the files of one or more sources of the same width and delimiter, in one scan."""
    files = [entry for own in options for entry in list_files(own["file_path"], ".csv", ".txt")]
    size = options[0].get("range_bytes") or min(split_bytes(spark, sum(n for _, n in files)), LARGEST_RANGE)
    return csvranges.records(spark, files, size, width, options[0]["delimiter"], placed)


def cell(name: str):
    """A cell as it is loaded: line ends inside values are single characters."""
    return F.replace(quoted(name), F.lit("\r\n"), F.lit("\n"))


def scan(spark: SparkSession, options: dict) -> Scan:
    """One way for every file: records are cut and parsed in byte ranges (``range_bytes`` each).

    A blank line is a row of NULL if there is one column, and a row of the wrong width otherwise.
    """
    header = header_of(options)
    frame = ranges(spark, [options], len(header))
    return Scan(table_name(options["file_path"]), project(frame, [(name, "Text", cell(f"c{i}")) for i, name in enumerate(header)]))
