"""A sink that fills many staging tables and a table of rejects from one scan (K1, K3, K4).

Rows are ``(row, place, rejects)``. A task writes the rows without rejects to files of their target, and
the others' rejects to files of their own. What counts is named in the commit message of a task that
ended well; the commit lists it in one file, and what failed or repeated tasks left is not in the list.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from cartoload.files import resolve

NAME = "cartoload_staging"
BUFFER = 64 << 20  # bytes of rows held for all targets of a task
REJECTS = "_rejects"
COMMITTED = "_committed.json"


class StagingSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> StagingWriter:
        return StagingWriter(self.options["path"], self.options["row_schema"])


class StagingWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, row_schema: str):
        self.folder, self.row_schema = folder, row_schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = resolve(self.folder)
        held: dict[str, list[pa.Table]] = defaultdict(list)
        sizes: dict[str, int] = defaultdict(int)
        files: list[tuple[str, str, int]] = []
        bad: dict[str, int] = defaultdict(int)

        def save(target: str) -> None:
            table = pa.concat_tables(held.pop(target))
            sizes.pop(target)
            path = f"{folder}/{target}/part-{uuid.uuid4().hex}.parquet"
            system.create_dir(f"{folder}/{target}", recursive=True)
            if target != REJECTS:  # the logical types of the columns, as Spark keeps them
                table = table.replace_schema_metadata({"org.apache.spark.sql.parquet.row.metadata": self.row_schema})
            pq.write_table(table, path, filesystem=system)
            files.append((target, path, table.num_rows))

        def keep(target: str, table: pa.Table) -> None:
            if not table.num_rows:
                return
            held[target].append(table)
            sizes[target] += table.nbytes
            while sum(sizes.values()) > BUFFER:
                save(max(sizes, key=sizes.get))

        for batch in iterator:
            row, place, rejects = batch.column("row"), batch.column("place"), batch.column("rejects")
            targets, wrong = place.field("target"), pc.fill_null(pc.list_value_length(rejects), 0)
            fine = pc.equal(wrong, 0)
            rows = pa.Table.from_arrays(row.flatten(), schema=pa.schema(list(row.type)))
            for target in pc.unique(targets).to_pylist():
                own = pc.equal(targets, target)
                keep(target, rows.filter(pc.and_(own, fine)))
                bad[target] += pc.sum(pc.and_(own, pc.invert(fine)).cast(pa.int64())).as_py() or 0
            if pc.any(pc.invert(fine)).as_py():
                at = pc.list_parent_indices(rejects)
                where, what = place.take(at), pc.list_flatten(rejects)
                keep(REJECTS, pa.table({**{n: where.field(n) for n in ("target", "source", "file", "offset")}, **{n: what.field(n) for n in ("column", "text", "reason")}}))
        for target in list(held):
            save(target)
        message = WriterCommitMessage()
        message.files, message.bad = files, dict(bad)
        return message

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files: dict[str, list[str]] = defaultdict(list)
        rows: dict[str, int] = defaultdict(int)
        bad: dict[str, int] = defaultdict(int)
        for message in messages:
            for target, path, n in message.files if message else []:
                files[target].append(path)
                rows[target] += n
            for target, n in message.bad.items() if message else []:
                bad[target] += n
        system, folder = resolve(self.folder)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{COMMITTED}") as out:
            out.write(json.dumps({"files": files, "rows": rows, "bad": bad}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files of an attempt that failed go with its folder."""


def committed(folder: str) -> dict:
    """``files``, ``rows`` and ``bad`` (rows with rejects) by target; files that are in no message are removed."""
    system, inner = resolve(folder)
    with system.open_input_stream(f"{inner}/{COMMITTED}") as handle:
        found = json.loads(handle.read())
    known = {path for paths in found["files"].values() for path in paths}
    from pyarrow import fs as pafs

    for item in system.get_file_info(pafs.FileSelector(inner, recursive=True)):
        if item.type == pafs.FileType.File and item.path.endswith(".parquet") and item.path not in known:
            system.delete_file(item.path)
    return found


def write(spark: SparkSession, judged: DataFrame, folder: str, row_schema: StructType) -> dict:
    """Run the scan into ``folder`` (in a configured session); the result as ``committed`` gives it. ``row_schema`` has the metadata of the columns."""
    # Spark looks the sink up in the thread's active session, which a new thread lacks.
    SparkSession._get_j_spark_session_class(spark._jvm).setActiveSession(spark._jsparkSession)
    judged.write.format(NAME).mode("append").option("row_schema", row_schema.json()).save(folder)
    return committed(folder)
