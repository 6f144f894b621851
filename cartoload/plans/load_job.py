"""Load every source of a manifest, go on past failures, and report.

``run_load`` gives every source a job of its own. ``run_load_by_format`` takes all sources of one kind and
schema in one job that fills all their tables, with a table of rejects beside them.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartoload.operators.catalog import sources_to_load
from cartoload.operators.changes import update_rows
from cartoload.files import list_files
from cartoload.functions.names import clean_names, table_name
from cartoload.functions.types import TYPE_NAMES, field
from cartoload.operators import rejects
from cartoload.operators.stage import remove, stage, swap_in
from cartoload.session import configure
from cartoload.sources import delimited, stagingsink
from cartoload.sources.base import Scan, quoted
from cartoload.sources.dispatch import scan
from cartoload.sources.manifest import parse_options

REPORT = "sd_id bigint, table_name string, rows bigint, error string, loaded_timestamp timestamp"


def failed(sd_id: int, error: Exception | str) -> tuple:
    reason = str(error).split("\n\nJVM stacktrace", 1)[0]
    return sd_id, None, None, f"Error attempting to bulk load data for sd_id = {sd_id}.\n{reason}", None


def found_source(spark: SparkSession, options: str) -> Scan | Exception:
    try:
        return scan(spark, options)
    except Exception as error:  # any failure of a source belongs in the report
        return error


def load_one(spark: SparkSession, sd_id: int, source: Scan, root: str) -> tuple:
    try:
        return sd_id, source.table_name, stage(spark, source, root), None, datetime.now(timezone.utc)
    except Exception as error:
        return failed(sd_id, error)


def run_load(spark: SparkSession, manifest: DataFrame, root: str, at_once: int = 4) -> DataFrame:
    """``manifest`` holds ``(sd_id, options)``; the report has one row per entry.

    Sources are opened first, so that entries of one run that would load the same table are refused,
    all of them, before anything is written. They load ``at_once`` at a time as separate Spark jobs, so
    small ones do not leave the cluster idle. Only manifest rows pass through the driver.
    """
    configure(spark)
    entries = [(row.sd_id, row.options) for row in manifest.select("sd_id", "options").toLocalIterator()]
    with ThreadPoolExecutor(at_once) as pool:
        sources = list(pool.map(lambda entry: found_source(spark, entry[1]), entries))
        wanted = Counter(source.table_name for source in sources if isinstance(source, Scan))

        def load(entry: tuple, source: Scan | Exception) -> tuple:
            if isinstance(source, Exception):
                return failed(entry[0], source)
            if wanted[source.table_name] > 1:
                return failed(entry[0], f'{wanted[source.table_name]} sources of this run load the table "{source.table_name}"')
            return load_one(spark, entry[0], source, root)

        report = list(pool.map(load, entries, sources))
    return spark.createDataFrame(report, REPORT)


def run_workflow(spark: SparkSession, source_data: DataFrame, load_instances: DataFrame, workflow_run_id: int,
                 root: str, at_once: int = 4) -> tuple[DataFrame, DataFrame]:
    """One workflow run: load its sources, and hand back the report and the updated source entries.

    An entry that loaded gets its time and loses its error; one that failed gets the error.
    """
    report = run_load(spark, sources_to_load(source_data, load_instances, workflow_run_id), root, at_once)
    outcome = report.select("sd_id", "loaded_timestamp", F.col("error").alias("error_message"))
    return report, update_rows(source_data, outcome, "sd_id", ["loaded_timestamp", "error_message"])


def succeeded(report: DataFrame) -> bool:
    """Whether the run as a whole counts as good."""
    return report.filter("error is not null").limit(1).isEmpty()


# --- all sources of one kind and schema in one job --------------------------------------------------

FORMAT_REPORT = "sd_id bigint, table_name string, rows bigint, rejected bigint, error string, loaded_timestamp timestamp"


@dataclass(frozen=True)
class Source:
    """One entry of a manifest, opened: ``columns`` are ``(name, logical type)`` as they will be staged."""

    sd_id: int
    kind: str
    options: dict
    table_name: str
    columns: tuple[tuple[str, str], ...]
    scan: Scan | None = None

    @property
    def row_schema(self) -> T.StructType:
        return self.scan.frame.schema if self.scan else T.StructType([field(name, kind) for name, kind in self.columns])

    @property
    def shape(self) -> tuple:
        """Sources of one shape are read in one scan."""
        return self.kind, self.columns, self.options.get("delimiter"), self.options.get("range_bytes")


def opened(spark: SparkSession, sd_id: int, options: str, columns: list | None) -> Source | Exception:
    """Reads a source's header. ``columns`` (name, type) of the entry decide the types of delimited text."""
    try:
        kind, parsed = parse_options(options)
        if kind != "delimited":
            found = scan(spark, parsed)
            return Source(sd_id, kind, parsed, found.table_name, tuple(found.columns), found)
        header = clean_names(delimited.header_of(parsed))
        declared = [(c["name"], c["column_type"] or "Text") for c in columns or [{"name": n, "column_type": "Text"} for n in header]]
        if [n for n, _ in declared] != header:
            raise ValueError(f"the columns of the entry are {[n for n, _ in declared]}, those of the file {header}")
        unknown = [k for _, k in declared if k not in TYPE_NAMES]
        if unknown:
            raise ValueError(f"unknown column types {unknown}")
        return Source(sd_id, kind, parsed, table_name(parsed["file_path"]), tuple(declared))
    except Exception as error:  # any failure of a source belongs in the report
        return error


def one_scan(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """All rows of sources of one shape, with their places and rejects."""
    if sources[0].kind != "delimited":
        none = F.array().cast(f"array<{rejects.REJECT}>").alias("rejects")
        whole = None
        for source in sources:
            place = F.struct(F.lit(source.table_name).alias("target"), F.lit(source.sd_id).cast("bigint").alias("source"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("offset"))
            own = source.scan.frame.select(F.struct(*[quoted(name) for name, _ in source.columns]).alias("row"), place.alias("place"), none)
            whole = own if whole is None else whole.union(own)
        return whole
    files = [(path, source.sd_id, source.table_name) for source in sources for path, _ in list_files(source.options["file_path"], ".csv", ".txt")]
    # One row per file. Spark takes the cells for as small as the list of ranges they are read from, and would send them instead.
    owners = F.broadcast(spark.createDataFrame(files, "path string, source bigint, target string"))
    cells = delimited.ranges(spark, [source.options for source in sources], len(sources[0].columns), placed=True).join(owners, "path")
    columns = [(name, kind, delimited.cell(f"c{i}")) for i, (name, kind) in enumerate(sources[0].columns)]
    return rejects.judged(cells, columns, F.col("target"), F.col("source"), F.col("path"), F.col("offset"), F.col("record"), F.col("reason"))


def load_group(spark: SparkSession, sources: list[Source], root: str, keep_good: bool, rejects_root: str) -> list[tuple]:
    """Loads sources of one shape in one job; where that fails, each by itself, so that a failure stays with its source."""
    attempt = f"{root}/_attempt-{uuid.uuid4().hex}"
    try:
        try:
            judged = one_scan(spark, sources)
            written = stagingsink.write(spark, judged, attempt, sources[0].row_schema)
        except Exception as error:
            if len(sources) > 1:
                return [row for source in sources for row in load_group(spark, [source], root, keep_good, rejects_root)]
            return [(*failed(sources[0].sd_id, error)[:3], None, *failed(sources[0].sd_id, error)[3:])]
        if written["files"].get(stagingsink.REJECTS):
            swap_in(spark, f"{attempt}/{stagingsink.REJECTS}", f"{rejects_root}/run-{uuid.uuid4().hex}")
        out = []
        for source in sources:
            rows, bad = written["rows"].get(source.table_name, 0), written["bad"].get(source.table_name, 0)
            if bad and not keep_good:
                out.append((source.sd_id, source.table_name, None, bad, f"{bad} rows do not fit their columns", None))
                continue
            try:
                if not rows:
                    spark.createDataFrame([], source.row_schema).write.parquet(f"{attempt}/{source.table_name}")
                swap_in(spark, f"{attempt}/{source.table_name}", f"{root}/{source.table_name}")
                out.append((source.sd_id, source.table_name, rows, bad, None, datetime.now(timezone.utc)))
            except Exception as error:
                out.append((source.sd_id, None, None, bad, failed(source.sd_id, error)[3], None))
        return out
    finally:
        remove(spark, attempt)


def run_load_by_format(spark: SparkSession, manifest: DataFrame, root: str, on_reject: str = "refuse", rejects_root: str | None = None, at_once: int = 4) -> DataFrame:
    """Like ``run_load``, with one job for all sources of one kind, schema and delimiter.

    ``manifest`` may hold ``columns`` (name and type), which type the cells of delimited text. Rows with a
    cell that doesn't fit go to the table of rejects, below ``rejects_root`` (``root/_rejects`` if not given),
    and are counted as ``rejected``; a source with such rows is refused and its old table stays
    (``on_reject="refuse"``), or its other rows are staged (``"keep"``). Everything is read once.
    """
    if on_reject not in ("refuse", "keep"):
        raise ValueError(f'on_reject is "refuse" or "keep", not "{on_reject}"')
    configure(spark)
    given = manifest if "columns" in manifest.columns else manifest.withColumn("columns", F.lit(None).cast("array<struct<name:string,column_type:string>>"))
    entries = [(row.sd_id, row.options, row["columns"]) for row in given.select("sd_id", "options", "columns").toLocalIterator()]
    with ThreadPoolExecutor(at_once) as pool:
        found = list(pool.map(lambda entry: opened(spark, *entry), entries))
        wanted = Counter(source.table_name for source in found if isinstance(source, Source))
        groups: dict[tuple, list[Source]] = defaultdict(list)
        report = []
        for (sd_id, _, _), source in zip(entries, found):
            if isinstance(source, Exception):
                report.append((*failed(sd_id, source)[:3], None, *failed(sd_id, source)[3:]))
            elif wanted[source.table_name] > 1:
                reason = failed(sd_id, f'{wanted[source.table_name]} sources of this run load the table "{source.table_name}"')
                report.append((*reason[:3], None, *reason[3:]))
            else:
                groups[source.shape].append(source)
        for rows in pool.map(lambda group: load_group(spark, group, root, on_reject == "keep", rejects_root or f"{root}/_rejects"), groups.values()):
            report += rows
    return spark.createDataFrame(report, FORMAT_REPORT)


def read_rejects(spark: SparkSession, rejects_root: str) -> DataFrame:
    """All rejects below a folder: ``(target, source, file, offset, column, text, reason)``."""
    schema = T._parse_datatype_string(rejects.REJECTS)
    path = spark._jvm.org.apache.hadoop.fs.Path(rejects_root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(rejects_root)
