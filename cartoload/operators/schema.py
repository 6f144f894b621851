"""Schemas as data: column lists, their checks, and the statements they turn into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoload.functions.names import clean_identifier
from cartoload.functions.types import sql_type_name, type_or_text
from cartoload.sources.base import Scan


def build_schemas(columns: DataFrame) -> DataFrame:
    """C11: ``(table_name, position, name, column_type)`` rows to one ordered column list per table.

    Names are cleaned and open types become Text. A list is as long as its table has columns.
    """
    entry = F.struct(
        F.col("position"),
        clean_identifier(F.col("name")).alias("name"),
        type_or_text(F.col("column_type")).alias("column_type"),
    )
    listed = columns.select(clean_identifier(F.col("table_name"), "Table name").alias("table_name"), entry.alias("c"))
    whole = listed.groupBy("table_name").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return whole.select("table_name", F.transform("c", lambda c: F.struct(
        c["name"].alias("name"), c["column_type"].alias("column_type"))).alias("columns"))


def create_statements(schemas: DataFrame, db_schema: str) -> DataFrame:
    """One ``create table`` text per schema."""
    listed = F.transform("columns", lambda c: F.concat(
        F.lit('"'), c["name"], F.lit('" '), sql_type_name(c["column_type"])))
    text = F.concat(F.lit(f'create table {db_schema}."'), F.col("table_name"), F.lit('"('),
                    F.array_join(listed, ","), F.lit(")"))
    return schemas.select("table_name", text.alias("statement"))


def load_options(scan: Scan, db_schema: str, delimiter: str = ",", header: bool = False,
                 qualified: bool = True) -> dict:
    """K2: how a text form of the scan is to be read back into its staging table."""
    options = {
        "table": f'{db_schema}."{scan.table_name}"'.lower(),
        "columns": [name for name, _ in scan.columns],
        "delimiter": delimiter, "header": header, "null": "",
    }
    if qualified:
        options.update(quote='"', escape='"')
    return options
