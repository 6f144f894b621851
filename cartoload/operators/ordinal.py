"""Row numbers and bounded collections that hold up when one group is a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartoload.session import truncate_lineage

# Items per array in collected columns.
LARGEST_ARRAY = 10_000


def same(left: DataFrame, right: DataFrame, keys: list[str]):
    """Join condition on keys with NULL equal to NULL."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def numbered(spark: SparkSession, rows: DataFrame, order_by: list[str], name: str,
             partition_by: list[str] | None = None) -> DataFrame:
    """``row_number()`` by ranges: no task sees more than its range, whatever the group sizes.

    Rows are range-partitioned and sorted by group and order, with a tie-break so that equal rows
    spread, and written once so that the numbering below works on fixed positions. A range is
    numbered on its own; groups that run over several ranges, at most one per range border, get the
    count of their earlier ranges on top.
    """
    groups = partition_by or []
    tie = F.xxhash64(*rows.columns)
    marked = rows.withColumn("_tie", tie).withColumn("_at", F.monotonically_increasing_id())
    keys = [*groups, *order_by, "_tie", "_at"]
    placed = marked.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie", "_at").withColumn(
        "_at", F.monotonically_increasing_id())
    fixed = truncate_lineage(spark, placed, "ordinal").withColumn("_range", F.shiftright("_at", 33))
    sizes = fixed.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row per range within a group, so this window stays as small as the number of ranges.
    earlier = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.sum("_n").over(earlier)).filter("_before > 0").drop("_n")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    if groups:
        place = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy("_at"))
    local = fixed.withColumn("_local", place)
    joined = local.join(offsets, same(local, offsets, [*groups, "_range"]), "left")
    number = F.col("_local").cast("bigint") + F.coalesce("_before", F.lit(0))
    return joined.select(*[local[c] for c in rows.columns], number.alias(name))


def row_numbers(spark: SparkSession, rows: DataFrame, partition_by: list[str], order_by: list[str],
                name: str = "rn") -> DataFrame:
    """``row_number() over (partition by … order by …)``, by ranges whatever the group sizes.

    Rows equal in the order are numbered by a digest of the whole row.
    """
    return numbered(spark, rows, order_by, name, partition_by)


def collected(rows: DataFrame, key: str, item, spread_by: str, name: str,
              largest_array: int = LARGEST_ARRAY) -> DataFrame:
    """``array_agg`` by key in sorted order, with arrays of bounded size.

    A key with more items than fit one array continues on further rows, numbered by ``<name>_part``;
    no item is left out.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > largest_array)
    hot = sizes.select(F.col(key).alias("_key"), F.ceil(F.col("_n") / largest_array).alias("_parts"))
    part = F.pmod(F.xxhash64(spread_by), F.col("_parts"))
    spread = rows.join(hot, rows[key].eqNullSafe(hot["_key"]), "left").select(
        rows[key], item.alias("_item"), F.coalesce(part, F.lit(0)).cast("int").alias(f"{name}_part"))
    return spread.groupBy(key, f"{name}_part").agg(F.array_sort(F.collect_list("_item")).alias(name))
