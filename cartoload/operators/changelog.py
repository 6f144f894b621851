"""Row-level and statement-level change log of a batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Context:
    """M9: who ran the batch, and when; one value each per run."""

    schema_name: str
    table_name: str
    session_user_name: str | None = None
    application_name: str | None = None
    acting_user_id: int | None = None
    run_timestamp: str | None = None
    client_query: str | None = None
    log_query: bool = True

    def literals(self) -> list[Column]:
        moment = F.lit(self.run_timestamp).cast("timestamp") if self.run_timestamp else F.current_timestamp()
        query = self.client_query if self.log_query else None
        return [
            F.lit(self.schema_name).alias("schema_name"),
            F.lit(self.table_name).alias("table_name"),
            F.lit(self.session_user_name).cast("string").alias("session_user_name"),
            moment.alias("action_tstamp_tx"), moment.alias("action_tstamp_stm"), moment.alias("action_tstamp_clk"),
            F.lit(self.application_name).cast("string").alias("application_name"),
            F.lit(query).cast("string").alias("client_query"),
            F.lit(self.acting_user_id).cast("bigint").alias("acting_user_id"),
        ]


def row_text(row: str, columns: list[T.StructField]) -> Column:
    """A row as a map of column name to text; of nested values their JSON."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    texts = [to_json(F.col(f"{row}.{c.name}")) if isinstance(c.dataType, nested) else F.col(f"{row}.{c.name}").cast("string") for c in columns]
    return F.map_from_arrays(F.array(*[F.lit(c.name) for c in columns]), F.array(*texts))


def changed_entries(old: Column, new: Column) -> Column:
    """New values that differ from the old ones under the same key; NULL when there are none."""
    kept = F.map_filter(new, lambda k, v: F.map_contains_key(old, k) & ~v.eqNullSafe(F.try_element_at(old, k)))
    return F.when(F.size(kept) > 0, kept)


def paired(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both states side by side: ``(keys, old, new)`` with NULL structs where a side is missing."""
    left = old.select(*keys, F.struct(*old.columns).alias("old"))
    right = new.select(*keys, F.struct(*old.columns).alias("new"))
    return left.join(right, keys, "full_outer")


def changes_between(pairs: DataFrame, keys: list[str], columns: list[str], ignored: tuple[str, ...] = ()) -> DataFrame:
    """M6, M7: ``(keys, action, row_data, changed_fields)`` as JSON text, from ``(keys, old, new)``.

    ``row_data`` is the typed image of the row, with numbers, booleans, nulls and nested values as such;
    ``changed_fields`` holds texts (of nested values their JSON). Rows are compared column by column, and text maps are built for changed rows only. Updates that
    touch nothing but ignored columns leave no entry.
    """
    tracked = [c for c in columns if c not in ignored]
    differs = F.lit(False)
    for c in tracked:
        differs = differs | ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    gone, fresh = F.col("new").isNull(), F.col("old").isNull()
    action = F.when(gone & fresh, None).when(fresh, "I").when(gone, "D").when(differs, "U")
    changed = pairs.withColumn("action", action).filter("action is not null")
    fields = [f for f in pairs.schema["old"].dataType if f.name in tracked]
    before, after = row_text("old", fields), row_text("new", fields)
    image = lambda row: F.struct(*[F.col(f"{row}.{c}").alias(c) for c in tracked])
    row_data = F.when(F.col("action") == "I", to_json(image("new"))).otherwise(to_json(image("old")))
    fields = F.when(F.col("action") == "U", changed_entries(before, after))
    return changed.select(*keys, "action", row_data.alias("row_data"), to_json(fields).alias("changed_fields"))


def change_rows(old: DataFrame, new: DataFrame, keys: list[str], ignored: tuple[str, ...] = ()) -> DataFrame:
    """M6: the row log between two states of a table."""
    return changes_between(paired(old, new, keys), keys, old.columns, ignored)


def to_json(entries: Column) -> Column:
    return F.to_json(entries, {"ignoreNullFields": "false"})


def row_log(changes: DataFrame, context: Context) -> DataFrame:
    """M6 with M9: log rows of ``change_rows``."""
    return changes.select(*context.literals(), "action", "row_data", "changed_fields",
                          F.lit(False).alias("statement_only"))


def statement_log(changes: DataFrame, context: Context, truncated: bool = False) -> DataFrame:
    """M8: one row per kind of statement that ran, plus the truncate."""
    actions = changes.select("action").distinct()
    if truncated:
        actions = actions.unionByName(actions.sparkSession.range(1).select(F.lit("T").alias("action")))
    nothing = F.lit(None).cast("string")
    return actions.select(*context.literals(), "action", nothing.alias("row_data"),
                          nothing.alias("changed_fields"), F.lit(True).alias("statement_only"))


def audited_tables(registry: DataFrame) -> DataFrame:
    """Distinct ``(schema, auditedtable)`` in order."""
    return registry.select("schema", "auditedtable").distinct().orderBy("schema", "auditedtable")
