"""Changes of a table in place that rewrite only the files they touch.

The table is a folder of Parquet files. A join of the touched keys with ``_metadata.file_path`` names the
files that hold them; these are read, changed and written anew, all others stay as they are. New
files are written in a hidden folder first. A journal then says which files come and go; from there on
the change is carried out, by this call or by the next one that finds the journal.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoload.operators import warehouse
from cartoload.operators.changes import apply_changes
from cartoload.session import truncate_lineage


@dataclass(frozen=True)
class Rewritten:
    removed: int
    added: int


def _system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _names(spark: SparkSession, path: str) -> list[str]:
    system, folder = _system(spark, path)
    return [entry.getPath().getName() for entry in system.listStatus(folder)] if system.exists(folder) else []


def _data_files(spark: SparkSession, path: str) -> list[str]:
    return [name for name in _names(spark, path) if name.endswith(".parquet") and not name.startswith(("_", "."))]


def recover(spark: SparkSession, path: str) -> None:
    """Carries out a change whose journal was written, and clears away one that didn't get so far."""
    system, folder = _system(spark, path)
    of = lambda name: spark._jvm.org.apache.hadoop.fs.Path(folder, name)
    names = _names(spark, path)
    for journal in (name for name in names if name.startswith("_swap-")):
        stream = system.open(of(journal))
        try:
            steps = json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            steps = {"new": {}, "old": []}  # cut off while it was written: nothing has moved
        finally:
            stream.close()
        for source, target in steps["new"].items():
            if system.exists(of(source)) and not system.rename(of(source), of(target)):
                raise OSError(f"could not move {source} to {target} in {path}")
        for name in steps["old"]:
            system.delete(of(name), False)
        system.delete(of(journal), False)
    for left in (name for name in names if name.startswith("_new-")):
        system.delete(of(left), True)


def _swap(spark: SparkSession, path: str, fresh: str, old: list[str]) -> int:
    system, folder = _system(spark, path)
    mark = uuid.uuid4().hex
    new = {f"{fresh}/{name}": f"part-{mark}-{k:05d}.parquet" for k, name in enumerate(_data_files(spark, f"{path}/{fresh}"))}
    journal = spark._jvm.org.apache.hadoop.fs.Path(folder, f"_swap-{mark}.json")
    draft = spark._jvm.org.apache.hadoop.fs.Path(folder, f".swap-{mark}.json")
    stream = system.create(draft)
    stream.write(bytearray(json.dumps({"new": new, "old": old}).encode()))
    stream.close()
    if not system.rename(draft, journal):
        raise OSError(f"could not write {journal}")
    recover(spark, path)
    return len(new)


def touched_files(spark: SparkSession, path: str, keys: DataFrame, columns: list[str]) -> list[str]:
    """Names of the files that hold one of the keys; only key columns are read, of row groups in their range."""
    wanted = keys.select(*columns).dropna().distinct()
    rows = spark.read.parquet(path)
    ends = wanted.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("least", F.min), ("most", F.max))]).first()
    for c in columns:
        if ends[f"least_{c}"] is None:
            return []
        rows = rows.where(F.col(c).between(F.lit(ends[f"least_{c}"]), F.lit(ends[f"most_{c}"])))
    held = rows.select(*columns, F.col("_metadata.file_name").alias("_file")).join(wanted, columns, "left_semi")
    return sorted(row[0] for row in held.select("_file").distinct().toLocalIterator())


def rewrite(spark: SparkSession, path: str, keys: DataFrame, columns: list[str], change: Callable[[DataFrame], DataFrame]) -> Rewritten:
    """Put ``change`` of the rows of the touched files in their place; ``change`` may add rows. One writer at a time."""
    recover(spark, path)
    schema = spark.read.parquet(path).schema
    old = touched_files(spark, path, keys, columns)
    rows = spark.read.schema(schema).parquet(*[f"{path}/{name}" for name in old]) if old else spark.createDataFrame([], schema)
    fresh = f"_new-{uuid.uuid4().hex}"
    change(rows).select(*schema.names).write.parquet(f"{path}/{fresh}")
    return Rewritten(len(old), _swap(spark, path, fresh, old))


def apply_to_files(spark: SparkSession, path: str, batch: DataFrame, key: str, actor: str, allowed: DataFrame, message: str,
                   optional_text: tuple[str, ...] = (), ignored: tuple[str, ...] = ()) -> tuple[Rewritten, DataFrame, DataFrame]:
    """``changes.apply_changes`` on a folder: what was rewritten, the rejected rows and the log.

    Results are written before the files change, as they are made of the old ones.
    """
    batch = truncate_lineage(spark, batch, "batch")
    kept: list[DataFrame] = []

    def change(rows: DataFrame) -> DataFrame:
        result = apply_changes(rows, batch, key, actor, allowed, message, optional_text, ignored)
        kept.extend([truncate_lineage(spark, result.rejected, "rejected"), truncate_lineage(spark, result.log, "log")])
        return result.table

    done = rewrite(spark, path, batch, [key], change)
    return done, kept[0], kept[1]


def merge_into_files(spark: SparkSession, path: str, staging: DataFrame, keys: list[str], mode: str) -> Rewritten:
    """M19 in place, for the two modes that keep unmatched rows: Historical and Full Historical."""
    if mode not in ("Historical", "Full Historical"):
        raise ValueError(f"{mode} replaces the whole table; stage it instead")
    staging = truncate_lineage(spark, staging, "staging")
    return rewrite(spark, path, staging, keys, lambda rows: warehouse.merge(rows, staging, keys, mode).production)


def delete_from_files(spark: SparkSession, path: str, keys: DataFrame, columns: list[str]) -> Rewritten:
    """M3 in place."""
    return rewrite(spark, path, keys, columns, lambda rows: rows.join(keys.select(*columns).distinct(), columns, "left_anti"))
