"""Batch table changes: inserts with new ids, updates, deletes, stamps, gates and references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoload.operators.changelog import changes_between
from cartoload.operators.ordinal import numbered


def insert_rows(spark: SparkSession, table: DataFrame, rows: DataFrame, id_column: str,
                order_by: list[str]) -> DataFrame:
    """M1: ``rows`` with ids that continue the table's, dense and in the given order."""
    top = table.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("bigint"))
    placed = numbered(spark, rows, order_by, "_number")
    return placed.select((top.scalar() + F.col("_number")).alias(id_column),
                         *[c for c in rows.columns if c != id_column])


def single(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key, failing on a key that comes twice; by partial aggregation on the join key."""
    twice = F.raise_error(F.format_string("key %s is changed more than once", F.col(key).cast("string")))
    kept = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*columns)).alias("_row"))
    return kept.select(F.when(F.col("_n") > 1, twice).otherwise(F.col(key)).cast(rows.schema[key].dataType).alias(key),
                       *[F.col(f"_row.{c}").alias(c) for c in columns])


def update_rows(table: DataFrame, changes: DataFrame, key: str, columns: list[str],
                optional_text: tuple[str, ...] = ()) -> DataFrame:
    """M2: the table with the given columns replaced where a change has the key.

    A key changed twice fails, as there is no order to apply the changes in.
    """
    new = single(changes, key, columns).select(F.col(key).alias("_key"), F.lit(True).alias("_hit"), *[
        (F.nullif(F.col(c), F.lit("")) if c in optional_text else F.col(c)).alias(f"_new_{c}") for c in columns])
    joined = table.join(new, table[key] == new["_key"], "left")
    picked = [
        F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in table.columns
    ]
    return joined.select(*picked)


def delete_rows(table: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """M3: rows that stay and rows that were deleted."""
    wanted = keys.select(key).distinct()
    return table.join(wanted, key, "left_anti"), table.join(wanted, key, "left_semi")


def stamp_insert(rows: DataFrame, now: Column) -> DataFrame:
    """M4: on insert the creator is also the last updater."""
    return rows.withColumn("updated_by", F.col("created_by")).withColumn("last_updated", now)


def stamp_update(rows: DataFrame, now: Column) -> DataFrame:
    """M4."""
    return rows.withColumn("last_updated", now)


def gate(rows: DataFrame, actor: str, allowed: DataFrame, message: str) -> tuple[DataFrame, DataFrame]:
    """M5: accepted rows, and rejected ones with the reason. ``allowed`` has one ``uid`` column.

    ``message`` holds one ``%s`` for the user id.
    """
    grants = allowed.select(F.col("uid").alias("_uid")).distinct()
    accepted = rows.join(grants, rows[actor] == grants["_uid"], "left_semi")
    rejected = rows.join(grants, rows[actor] == grants["_uid"], "left_anti")
    return accepted, rejected.withColumn("reason", F.format_string(message, F.col(actor).cast("string")))


@dataclass(frozen=True)
class Applied:
    table: DataFrame
    rejected: DataFrame
    log: DataFrame


def apply_changes(table: DataFrame, changes: DataFrame, key: str, actor: str, allowed: DataFrame,
                  message: str, optional_text: tuple[str, ...] = (), ignored: tuple[str, ...] = ()) -> Applied:
    """One batch of inserts, updates and deletes as a whole.

    ``changes`` has ``action`` (I, U, D), the acting user, and the table's columns. Rows by users
    without the right, keys changed twice in the batch and inserts of known keys are rejected with a
    reason; updates and deletes of unknown keys do nothing, as in SQL.
    """
    grants = allowed.select(F.col("uid").alias("_uid"), F.lit(True).alias("_granted")).distinct()
    asked = changes.join(grants, F.col(actor) == F.col("_uid"), "left")
    twice = asked.filter("_granted").groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        F.col(key).alias("_key"), F.lit(True).alias("_twice"))
    reason = (
        F.when(F.col("_granted").isNull(), F.format_string(message, F.col(actor).cast("string")))
        .when(F.col("_twice"), F.format_string("key %s is changed more than once", F.col(key).cast("string")))
    )
    judged = asked.join(twice, F.col(key) == F.col("_key"), "left").select(*changes.columns, reason.alias("reason"))
    wanted = judged.filter("reason is null").select(F.col(key), "action", F.struct(*changes.columns).alias("change"), F.struct(*[
        (F.nullif(F.col(c), F.lit("")) if c in optional_text else F.col(c)).alias(c) for c in table.columns
    ]).alias("wanted"))
    joined = table.select(key, F.struct(*table.columns).alias("old")).join(wanted, key, "full_outer")
    exists, action = F.col("old").isNotNull(), F.col("action")
    new = (
        F.when(exists & (action == "U"), F.col("wanted"))
        .when(exists & (action == "D"), None)
        .when(exists, F.col("old"))
        .when(action == "I", F.col("wanted"))
    )
    pairs = joined.select(key, "old", new.alias("new"))
    after = pairs.filter("new is not null").select("new.*")
    clash = joined.filter(exists & (action == "I")).select("change.*", F.format_string(
        "key %s exists", F.col(f"old.{key}").cast("string")).alias("reason"))
    rejected = judged.filter("reason is not null").unionByName(clash)
    return Applied(after, rejected, changes_between(pairs, [key], table.columns, ignored))


# --- references ----------------------------------------------------------------------------------

def cascade(child: DataFrame, child_key: str, deleted: DataFrame, parent_key: str) -> DataFrame:
    """Child rows left after their parents are deleted."""
    gone = deleted.select(F.col(parent_key).alias("_gone")).distinct()
    return child.join(gone, child[child_key] == gone["_gone"], "left_anti")


def restricted(child: DataFrame, child_key: str, deleted: DataFrame, parent_key: str) -> DataFrame:
    """Child rows that forbid the delete; it may go ahead when there are none."""
    gone = deleted.select(F.col(parent_key).alias("_gone")).distinct()
    return child.join(gone, child[child_key] == gone["_gone"], "left_semi")


def set_null(child: DataFrame, child_key: str, deleted: DataFrame, parent_key: str) -> DataFrame:
    """Child rows with the reference to a deleted parent emptied."""
    gone = deleted.select(F.col(parent_key).alias("_gone")).distinct()
    joined = child.join(gone, child[child_key] == gone["_gone"], "left")
    kept = F.when(F.col("_gone").isNull(), F.col(child_key)).alias(child_key)
    return joined.select(*[kept if c == child_key else F.col(c) for c in child.columns])


def update_key(child: DataFrame, child_key: str, renamed: DataFrame) -> DataFrame:
    """``on update cascade``; ``renamed`` has ``old_key`` and ``new_key``."""
    renamed = single(renamed, "old_key", ["new_key"])
    joined = child.join(renamed, child[child_key] == renamed["old_key"], "left")
    moved = F.when(F.col("old_key").isNotNull(), F.col("new_key")).otherwise(F.col(child_key)).alias(child_key)
    return joined.select(*[moved if c == child_key else F.col(c) for c in child.columns])


# --- new load instances --------------------------------------------------------------------------

def latest(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """Values of the row with the largest ``order`` per key, by partial aggregation."""
    top = F.max_by(F.struct(*columns), order).alias("_top")
    return rows.groupBy(key).agg(top).select(key, *[F.col(f"_top.{c}").alias(c) for c in columns])


def new_instances(requests: DataFrame, data_sources: DataFrame, load_instances: DataFrame) -> DataFrame:
    """``(ds_id, version_date)`` requests to new load-instance rows with the last merge type."""
    last = latest(load_instances, "ds_id", "li_id", "merge_type").select(
        F.col("ds_id").alias("_ds"), F.col("merge_type").alias("_last"))
    known = requests.join(data_sources, "ds_id").join(last, F.col("ds_id") == F.col("_ds"), "left")
    return known.select(
        "ds_id", "version_date",
        F.col("collection_workflow").alias("collect_workflow_id"),
        F.col("load_workflow").alias("load_workflow_id"),
        F.col("check_workflow").alias("check_workflow_id"),
        F.coalesce("_last", F.lit("None")).alias("merge_type"),
    )
