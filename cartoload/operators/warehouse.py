"""Merging a staging table into its production table in the four warehouse modes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Merged:
    production: DataFrame
    archive: DataFrame | None = None


def _unmatched(production: DataFrame, staging: DataFrame, keys: list[str]) -> DataFrame:
    return production.join(staging.select(*keys), keys, "left_anti").select(*production.columns)


def _once(staging: DataFrame, keys: list[str]) -> DataFrame:
    """Staging rows, failing on a record that comes twice; by partial aggregation on the join keys."""
    others = [c for c in staging.columns if c not in keys]
    twice = F.raise_error(F.concat_ws(" ", F.lit("staging holds a record more than once:"), *[
        F.col(k).cast("string") for k in keys]))
    found = staging.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*others)).alias("_row"))
    row = F.when(F.col("_n") == 1, F.col("_row")).otherwise(twice.cast(found.schema["_row"].dataType))
    return found.select(*keys, row.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def merge(production: DataFrame, staging: DataFrame, keys: list[str], mode: str) -> Merged:
    """``keys`` identify a record on both sides.

    Current keeps the staging rows only. Archive does the same and hands back the rows that fell
    out. Historical replaces matched rows and keeps the others. Full Historical fills the gaps of a
    matched row from production. The first three need no row-by-row merge: only keys of the staging
    side are shuffled against production.
    """
    columns = production.columns
    if mode == "Current":
        return Merged(staging.select(*columns))
    if mode == "Archive":
        return Merged(staging.select(*columns), _unmatched(production, staging, keys))
    if mode == "Historical":
        return Merged(staging.select(*columns).unionByName(_unmatched(production, staging, keys)))
    if mode == "Full Historical":
        old, new = production.alias("old"), _once(staging, keys).alias("new")
        joined = old.join(new, keys, "full_outer")
        return Merged(joined.select(*[
            F.col(c) if c in keys else F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in columns]))
    raise ValueError(f"unknown warehouse type {mode}")


def counters(production: DataFrame, staging: DataFrame, keys: list[str]) -> DataFrame:
    """Production, staging, match and new counts of a load, from row counts per record."""
    counted = lambda rows, name: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = counted(production, "_old").join(counted(staging, "_new"), keys, "full_outer")
    old, new = F.col("_old"), F.col("_new")
    total = lambda count, name: F.coalesce(F.sum(count), F.lit(0)).alias(name)
    return both.agg(
        total(old, "production_count"), total(new, "staging_count"),
        total(F.when(old.isNotNull(), new), "match_count"), total(F.when(old.isNull(), new), "new_count"))
