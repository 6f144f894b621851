"""K1, K3, K5: replace-load of a staging table, all or nothing, and the text export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cartoload.functions.types import column_type_of
from cartoload.functions.values import csv_line, text_of
from cartoload.sources.base import Scan, quoted


def swap_in(spark: SparkSession, source: str, target: str) -> None:
    """Put a finished folder in the place of the old one; if that fails, the old one is back in place.

    The old folder is renamed aside, not deleted, until the new one has its name. A target that is
    there again by then, put there by someone else, is left alone.
    """
    jvm = spark._jvm
    new, old, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target, f"{source}-replaced"))
    system = old.getFileSystem(spark._jsc.hadoopConfiguration())
    had_old = system.exists(old)
    if had_old and not system.rename(old, aside):
        raise OSError(f"could not move {target} aside")
    system.mkdirs(old.getParent())
    # A rename onto a folder would go inside it.
    if system.exists(old) or not _renamed(system, new, old):
        if had_old and not system.exists(old):
            system.rename(aside, old)
        raise OSError(f"could not move {source} to {target}")
    if had_old:
        system.delete(aside, True)


def _renamed(system, new, old) -> bool:
    return system.rename(new, old)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(spark: SparkSession, scan: Scan, root: str) -> int:
    """K1, K3: load into ``root/<table>``; the old table stays until every row is written.

    The row count is observed while writing, so the source is read once.
    """
    attempt = f"{root}/_attempt-{uuid.uuid4().hex}"
    seen = Observation("loaded")
    try:
        scan.frame.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(attempt)
        swap_in(spark, attempt, f"{root}/{scan.table_name}")
    finally:
        remove(spark, attempt)  # there is nothing left of an attempt that went well
    return seen.get["rows"]


def stage_table(scan: Scan, database: str = "bulk_loading") -> int:
    """K1 into the session catalog."""
    spark = scan.frame.sparkSession
    spark.sql(f"create database if not exists {database}")
    seen = Observation("loaded")
    rows = scan.frame.observe(seen, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("overwrite").saveAsTable(f"{database}.`{scan.table_name}`")
    return seen.get["rows"]


def text_lines(frame: DataFrame) -> DataFrame:
    """V3: every row as the line a text load would read."""
    texts = [text_of(quoted(item.name), column_type_of(item)) for item in frame.schema.fields]
    return frame.select(csv_line(texts).alias("value"))


def export_csv(frame: DataFrame, path: str) -> None:
    """K5."""
    text_lines(frame).write.mode("overwrite").text(path)
