"""Batches of source entries with a gate per load instance.

An entry gets two numbers: ``sd_id`` over all entries, and ``load_source_id`` within its load instance.
Both continue the largest number there is, without gaps, in the order of the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoload.operators.catalog import TABLES, may_update
from cartoload.operators.changelog import changes_between
from cartoload.operators.checks import table_name_ok, valid_columns
from cartoload.operators.ordinal import numbered
from cartoload.session import truncate_lineage

GIVEN = ("user_generated", "options", "table_name", "columns")
LAST_SOURCE = 32767  # load_source_id is a smallint


@dataclass(frozen=True)
class EntryBatch:
    """``table``: all entries afterwards; ``created``: numbers of the new ones by position; ``rejected``: with reasons; ``log``: of what changed."""

    table: DataFrame
    created: DataFrame
    rejected: DataFrame
    log: DataFrame


def judged(spark: SparkSession, source_data: DataFrame, batch: DataFrame, load_instances: DataFrame, admins: DataFrame) -> DataFrame:
    """The batch with ``instance``, ``old`` (the entry it names) and ``reason``, without requests that do nothing.

    Nothing is done for an update with a missing value and for entries that aren't there. Entries are
    compared by the names that they hold before the batch: a name can be given anew in the batch only
    if its entry is deleted in it.
    """
    entries = source_data.select(F.col("sd_id").alias("_sd"), F.struct(*source_data.columns).alias("old"))
    complete = F.lit(True)
    for name in GIVEN:
        complete = complete & F.col(name).isNotNull()
    # Requests for new entries name none: with no key to join by, all of them would meet in one task.
    asks_new = F.col("action").eqNullSafe("I")
    named = truncate_lineage(spark, batch.where(~asks_new).join(entries, F.col("sd_id") == F.col("_sd")).drop("_sd").where((F.col("action") == "D") | complete), "entries")
    twice = named.where("action is not null").groupBy("sd_id").count().where("count > 1").select(F.col("sd_id").alias("_twice"))
    again = named.join(twice, (F.col("sd_id") == F.col("_twice")) & F.col("action").isNotNull(), "left").select(*named.columns, F.col("old.li_id").alias("instance"), F.col("_twice").isNotNull().alias("again"))
    fresh = batch.where(asks_new).withColumns({"old": F.lit(None).cast(named.schema["old"].dataType), "instance": F.col("li_id"), "again": F.lit(False)})
    asked = truncate_lineage(spark, fresh.unionByName(again), "entries")

    # One row per user and instance, then per key: a user or an instance with many requests is reduced first.
    pairs = asked.select(F.col("actor").alias("uid"), F.col("instance").alias("li_id")).dropna().distinct()
    granted = may_update(pairs, load_instances, admins).where("allowed").select(F.col("uid").alias("_uid"), F.col("li_id").alias("_li"), F.lit(True).alias("_granted"))
    known = load_instances.select(F.col("li_id").alias("_known")).distinct()
    sent = asked.join(granted, (F.col("actor") == F.col("_uid")) & (F.col("instance") == F.col("_li")), "left").join(
        known, F.col("instance") == F.col("_known"), "left")
    change = F.col("action") != "D"
    reason = (
        F.when(F.col("_granted").isNull(), F.concat(F.lit("uid "), F.coalesce(F.col("actor").cast("string"), F.lit("NULL")), F.lit(" is neither part of load instance "),
                                                    F.coalesce(F.col("instance").cast("string"), F.lit("NULL")), F.lit(" nor an admin")))
        .when(F.col("_known").isNull(), F.format_string("load instance %d does not exist", "instance"))
        .when(F.col("again"), F.format_string("entry %d is changed more than once", "sd_id"))
        .when(change & ~F.coalesce(table_name_ok(F.col("table_name")), F.lit(False)), F.format_string('table name "%s" has the wrong form', "table_name"))
        .when(change & ~valid_columns(F.col("columns")), F.lit("the column list is not valid"))
        .when(change & F.col("options").isNull(), F.lit("options are missing"))
    )
    first = truncate_lineage(spark, sent.select(*asked.columns, reason.alias("reason")), "entries")

    # Names: held by entries that stay, else by the first request for them.
    leaving = first.where("reason is null and action = 'D'").select(F.col("sd_id").alias("_gone"))
    wanted = first.where("reason is null and action <> 'D'").select("position", F.col("instance").alias("_in"), F.col("table_name").alias("_name"), F.when(F.col("action") == "U", F.col("sd_id")).alias("_own"))
    names = wanted.select("_in", "_name").distinct()
    holders = source_data.join(names, (F.col("li_id") == F.col("_in")) & (F.col("table_name") == F.col("_name")), "left_semi").join(
        leaving, F.col("sd_id") == F.col("_gone"), "left_anti").groupBy("li_id", "table_name").agg(F.min("sd_id").alias("_holder"), F.max("sd_id").alias("_other"))
    firsts = wanted.groupBy("_in", "_name").agg(F.min("position").alias("_first"))
    held = firsts.join(holders, (F.col("_in") == F.col("li_id")) & (F.col("_name") == F.col("table_name")), "left").select("_in", "_name", "_first", "_holder", "_other")
    out = first.join(held, (F.col("instance") == F.col("_in")) & (F.col("table_name") == F.col("_name")) & F.col("reason").isNull() & change, "left")
    own = F.when(F.col("action") == "U", F.col("sd_id"))
    taken = F.when(F.col("_holder").isNotNull(), ~(F.col("_holder").eqNullSafe(own) & F.col("_other").eqNullSafe(own))).otherwise(F.col("_first") < F.col("position"))
    clash = F.when(F.col("reason").isNull() & change & F.coalesce(taken, F.lit(False)), F.format_string('load instance %d has a table "%s"', "instance", "table_name"))
    return truncate_lineage(spark, out.select(*asked.columns, F.coalesce("reason", clash).alias("reason")), "entries")


def apply_entries(spark: SparkSession, source_data: DataFrame, batch: DataFrame, load_instances: DataFrame, admins: DataFrame) -> EntryBatch:
    """Creates (I), updates (U) and deletes (D) source entries.

    ``batch`` has ``position`` (distinct), ``action``, ``actor``, ``sd_id`` (U, D), ``li_id`` (I) and the values of ``GIVEN``.
    A request counts only if its user takes part in the entry's load instance or is an admin. Other
    reasons to reject it: an unknown instance, an entry changed more than once, a table name of the
    wrong form or held already, a bad column list, no number left. Updates keep both numbers.
    """
    asked = judged(spark, source_data, batch, load_instances, admins)
    fine = asked.where("reason is null")
    fresh = fine.where("action = 'I'").select("position", F.col("instance").alias("li_id"), *GIVEN)
    instances = fresh.select("li_id").distinct()
    # Of the instances that get entries, the largest number so far.
    tops = source_data.join(instances, "li_id", "left_semi").groupBy("li_id").agg(F.max("load_source_id").alias("_top"))
    placed = numbered(spark, fresh, ["position"], "_place", ["li_id"]).join(tops, "li_id", "left").withColumn("_source", F.coalesce("_top", F.lit(0)) + F.col("_place"))
    placed = truncate_lineage(spark, placed.drop("_top", "_place"), "entries")
    full = placed.where(F.col("_source") > LAST_SOURCE).select("position", F.format_string("load instance %d has no number left", "li_id").alias("_full"))
    top = source_data.agg(F.coalesce(F.max("sd_id"), F.lit(0)).cast("bigint"))
    counted = numbered(spark, placed.where(F.col("_source") <= LAST_SOURCE), ["position"], "_number")
    shape = spark.createDataFrame([], TABLES["source_data"]).schema
    made = {"sd_id": top.scalar() + F.col("_number"), "load_source_id": F.col("_source"), "user_generated": F.coalesce("user_generated", F.lit(False)),
            "to_load": F.lit(True), "loaded_timestamp": F.lit(None), "error_message": F.lit(None)}
    new = truncate_lineage(spark, counted.select("position", *[made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in shape]), "entries")

    old_row = lambda f: F.col(f.name).alias(f.name) if f.name in GIVEN else F.col(f"old.{f.name}").alias(f.name)
    updated = fine.where("action = 'U'").select("old", F.struct(*[old_row(f).cast(f.dataType).alias(f.name) for f in shape]).alias("new"))
    touched = fine.where("action <> 'I'").select("sd_id")
    table = source_data.join(touched, "sd_id", "left_anti").select(*shape.names).unionByName(updated.select("new.*")).unionByName(new.select(*shape.names))
    empty = F.lit(None).cast(shape)
    image = lambda name: F.struct(*[F.col(f"{name}.{f.name}").cast(f.dataType).alias(f.name) for f in shape]).alias(name)
    pairs = updated.select(F.col("new.sd_id").alias("sd_id"), image("old"), "new").unionByName(
        fine.where("action = 'D'").select("sd_id", image("old"), empty.alias("new"))).unionByName(
        new.select("sd_id", empty.alias("old"), F.struct(*shape.names).alias("new")))
    refused = asked.join(full, "position", "left").withColumn("reason", F.coalesce("reason", "_full")).where("reason is not null").select(*batch.columns, "reason")
    return EntryBatch(table, new.select("position", "sd_id", "li_id", "load_source_id"), refused, changes_between(pairs, ["sd_id"], shape.names))
