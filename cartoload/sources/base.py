"""What every scan returns: a table name and a DataFrame whose fields carry their logical types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoload.functions.names import clean_names
from cartoload.functions.types import column_type_of, field


@dataclass(frozen=True)
class Scan:
    table_name: str
    frame: DataFrame

    @property
    def columns(self) -> list[tuple[str, str]]:
        """``(name, logical type)`` in load order."""
        return [(item.name, column_type_of(item)) for item in self.frame.schema.fields]


def project(frame: DataFrame, parts: list[tuple[str, str, Column]]) -> DataFrame:
    """Select ``(source name, logical type, value)`` under cleaned names."""
    names = clean_names([source for source, _, _ in parts])
    picked = []
    for name, (source, column_type, value) in zip(names, parts):
        details = field(name, column_type, source).metadata
        picked.append(value.alias(name, metadata=details))
    return frame.select(*picked)


def quoted(name: str) -> Column:
    """A column by its exact name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def split_bytes(spark: SparkSession, total: int) -> int:
    """Bytes per task the way Spark sizes file splits: small inputs still use every core."""
    largest = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return max(1 << 20, min(largest, total // spark.sparkContext.defaultParallelism))


TASK_BYTES = 16 << 20  # of ranges that share a task


def range_tasks(spark: SparkSession, files: list[tuple[str, int]], size: int) -> int:
    """Tasks for the ranges of files: ranges may be far smaller than what a task is worth starting for."""
    ranges, total = sum(-(-n // size) for _, n in files), sum(n for _, n in files)
    return max(1, min(ranges, max(spark.sparkContext.defaultParallelism, total // TASK_BYTES + 1), 20_000))
