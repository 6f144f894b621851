"""Session set-up shared by the library entry points."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Register the file sources and the settings the jobs rely on.

    Only runtime settings are touched. Cluster sizing (executors, shuffle partitions) stays with
    whoever built the session; adaptive execution picks the partition count from it.
    """
    from cartoload.sources import avro, ipc, shapefile, stagingsink

    # Executors need not have the package installed: its functions travel inside the task closure.
    cloudpickle.register_pickle_by_value(sys.modules["cartoload"])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    # A hot join key is split even where that costs one more shuffle downstream.
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    for source in (ipc.ArrowFileSource, avro.AvroBlockSource, shapefile.ShapefileSource, stagingsink.StagingSink):
        spark.dataSource.register(source)
    return spark


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder path that every executor can reach, below ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", base)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(base, f"{label}-{uuid.uuid4().hex}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target)
    return system.makeQualified(target).toString()


def truncate_lineage(spark: SparkSession, df, label: str):
    """Write ``df`` to the shared folder and read it back.

    Used where two jobs must see the very same rows in the very same partitions, or where a plan
    would otherwise be computed twice. The files outlive any executor.
    """
    path = scratch(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
