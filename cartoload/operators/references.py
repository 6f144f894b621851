"""Foreign keys as a graph: what a delete or a new key does to all tables, as a whole.

Edges are rows ``(child, column, parent, parent column, action on delete)``, as in ``checks.FOREIGN_KEYS``.
A delete runs along the cascades level by level until no row is added. Only then is it judged: a row
that stays and refers to one that goes forbids it where the edge restricts, or where its column can't be
emptied. Then nothing changes at all; otherwise rows go and references are emptied in all tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoload.session import truncate_lineage

Edge = tuple[str, str, str, str, str]
BLOCKED = "child string, column string, parent string, value string, rule string, n bigint"


@dataclass(frozen=True)
class Deleted:
    """``tables`` afterwards, the rows ``deleted`` from each, the references that ``blocked`` it, and the levels it took."""

    tables: dict[str, DataFrame]
    deleted: dict[str, DataFrame]
    blocked: DataFrame
    levels: int


def _referring(child: DataFrame, column: str, parents: DataFrame, parent_column: str) -> DataFrame:
    """Child rows that refer to one of the parents, over distinct keys."""
    gone = parents.select(F.col(parent_column).alias("_gone")).dropna().distinct()
    return child.join(gone, child[column] == F.col("_gone"), "left_semi")


def _without(rows: DataFrame, others: DataFrame | None, key: list[str]) -> DataFrame:
    if others is None:
        return rows
    gone = others.select(*[F.col(c).alias(f"_gone_{c}") for c in key]).distinct()
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_gone_{c}"))
    return rows.join(gone, same, "left_anti")


def delete(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, list[str]], edges: list[Edge], wanted: dict[str, DataFrame],
           required: set[tuple[str, str]] = frozenset()) -> Deleted:
    """Deletes the rows of ``wanted`` (by ``keys``, whole rows where a table has none) and what follows from it.

    ``required`` are ``(table, column)`` pairs that can't be null. Levels are written below
    ``spark.checkpoint.dir``; only whether a level is empty comes to the driver.
    """
    key = {name: keys.get(name) or frame.columns for name, frame in tables.items()}
    level = {name: truncate_lineage(spark, tables[name].join(rows.select(*key[name]).distinct(), key[name], "left_semi"), "deleted") for name, rows in wanted.items()}
    deleted: dict[str, DataFrame] = {}
    levels = 0
    while level := {name: rows for name, rows in level.items() if not rows.isEmpty()}:
        levels += 1
        for name, rows in level.items():
            deleted[name] = deleted[name].unionByName(rows) if name in deleted else rows
        reached: dict[str, DataFrame] = {}
        for child, column, parent, parent_column, action in edges:
            if action == "cascade" and parent in level:
                rows = _referring(tables[child], column, level[parent], parent_column)
                reached[child] = reached[child].unionByName(rows) if child in reached else rows
        level = {name: truncate_lineage(spark, _without(rows, deleted.get(name), key[name]).dropDuplicates(key[name]), "deleted") for name, rows in reached.items()}

    blocked = spark.createDataFrame([], BLOCKED)
    for child, column, parent, parent_column, action in edges:
        rule = "restrict" if action == "restrict" else "not null" if action == "set null" and (child, column) in required else None
        if rule and parent in deleted:
            rows = _without(_referring(tables[child], column, deleted[parent], parent_column), deleted.get(child), key[child])
            blocked = blocked.unionByName(rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).select(
                F.lit(child).alias("child"), F.lit(column).alias("column"), F.lit(parent).alias("parent"), "value", F.lit(rule).alias("rule"), "n"))
    blocked = truncate_lineage(spark, blocked, "blocked")
    if not blocked.isEmpty():
        return Deleted(dict(tables), {}, blocked, levels)

    after = {name: _without(frame, deleted.get(name), key[name]) for name, frame in tables.items()}
    for child, column, parent, parent_column, action in edges:
        if action == "set null" and parent in deleted:
            gone = deleted[parent].select(F.col(parent_column).alias("_gone")).dropna().distinct()
            rows = after[child].join(gone, F.col(column) == F.col("_gone"), "left")
            after[child] = rows.select(*[F.when(F.col("_gone").isNull(), F.col(column)).alias(column) if c == column else F.col(c) for c in tables[child].columns])
    return Deleted(after, deleted, blocked, levels)


def rename(spark: SparkSession, tables: dict[str, DataFrame], edges: list[Edge], table: str, column: str, renamed: DataFrame) -> dict[str, DataFrame]:
    """``on update cascade`` over all levels: new keys (``old_key new_key``) of a column, and of all that refer to it.

    A column that refers to a changed one and is itself referred to carries the change on. A key that
    comes twice in ``renamed`` fails.
    """
    twice = F.raise_error(F.format_string("key %s is renamed more than once", F.col("old_key").cast("string")))
    single = renamed.groupBy("old_key").agg(F.count("*").alias("_n"), F.any_value("new_key").alias("new_key"))
    keys = truncate_lineage(spark, single.select(F.when(F.col("_n") > 1, twice.cast(renamed.schema["old_key"].dataType)).otherwise(F.col("old_key")).alias("_old"), F.col("new_key").alias("_new")), "renamed")
    reached, open_columns = set(), [(table, column)]
    while open_columns:
        place = open_columns.pop()
        if place not in reached:
            reached.add(place)
            open_columns += [(child, own) for child, own, parent, parent_column, _ in edges if (parent, parent_column) == place]
    after = dict(tables)
    for name, own in sorted(reached):
        rows = after[name].join(keys, F.col(own) == F.col("_old"), "left")
        after[name] = rows.select(*[F.when(F.col("_old").isNotNull(), F.col("_new")).otherwise(F.col(own)).alias(own) if c == own else F.col(c) for c in tables[name].columns])
    return after
