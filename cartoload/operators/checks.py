"""Predicates and set-based constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoload.functions.names import is_sql_name
from cartoload.operators.ordinal import row_numbers

# Closed value sets.
AUDIT_ACTIONS = ["I", "D", "U", "T"]
LOAD_STATES = ["Active", "Ready", "Hold"]
MERGE_TYPES = ["None", "Exclusive", "Intersect"]
# White space as the database's \s has it.
BLANK = r"^[\s\u000B]*\z"


def not_blank(text: Column) -> Column:
    """NULL passes."""
    return ~F.coalesce(text, F.lit("x")).rlike(BLANK)


def array_not_blank(texts: Column) -> Column:
    """NULL and NULL elements pass, an empty array does not."""
    return texts.isNull() | ((F.size(texts) > 0) & F.forall(texts, not_blank))


def later(to_check: Column, other: Column) -> Column:
    """No value passes; a value without one to compare with does not."""
    return F.when(to_check.isNull(), True).when(other.isNull(), False).otherwise(to_check > other)


def table_name_ok(name: Column) -> Column:
    """P4, on the upper-case form since staging names are lower case."""
    return is_sql_name(F.upper(name))


def province_ok(code: Column, name: Column) -> Column:
    """P5: both or neither."""
    return code.isNull() == name.isNull()


def county_ok(county: Column, province_code: Column) -> Column:
    """P5: a county needs a province."""
    return county.isNull() | province_code.isNotNull()


def positive(number: Column) -> Column:
    """P6; as in every check constraint, NULL passes."""
    return F.coalesce(number > 0, F.lit(True))


def not_negative(number: Column) -> Column:
    return F.coalesce(number >= 0, F.lit(True))


def member(value: Column, allowed: list[str]) -> Column:
    """P7."""
    return F.coalesce(value.isin(allowed), F.lit(True))


def valid_columns(columns: Column) -> Column:
    """A non-empty list of named and typed columns; NULL counts as missing."""
    fine = F.forall(columns, lambda c: (
        c["name"].isNotNull() & not_blank(c["name"]) & c["column_type"].isNotNull()))
    return F.coalesce((F.size(columns) > 0) & fine, F.lit(False))


def violations(rows: DataFrame, table: str, key: Column, rules: dict[str, Column]) -> DataFrame:
    """P10: one row per broken rule, ``(table_name, key, rule)``, in one pass without a shuffle."""
    broken = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in rules.items()]),
        lambda rule: rule.isNotNull())
    return rows.select(F.lit(table).alias("table_name"), key.cast("string").alias("key"),
                       F.explode(broken).alias("rule"))


def catalogue_rules() -> dict[str, dict[str, Column]]:
    """The declared column checks of every catalogue table, by table and rule name."""
    c = F.col

    def named(*columns):
        return {f"{x}_not_blank": not_blank(c(x)) for x in columns}

    def required(*columns):
        return {f"{x}_not_null": c(x).isNotNull() for x in columns}

    phases = ("collect", "load", "check")
    return {
        "roles": {**required("name", "description"), **named("name", "description")},
        "users": {**required("name", "username"), **named("name", "username")},
        "user_roles": required("uid", "role_id"),
        "regions": {
            **required("country_code", "country_name"),
            **named("country_code", "country_name", "prov_code", "prov_name", "county"),
            "regions_prov_check": province_ok(c("prov_code"), c("prov_name")),
            "regions_county_prov_check": county_ok(c("county"), c("prov_code")),
        },
        "warehouse_types": {**required("name", "description"), **named("name", "description")},
        "data_sources": {
            **required("name", "description", "search_radius", "region_id", "assigned_user", "created",
                       "created_by", "last_updated", "updated_by", "warehouse_type",
                       "collection_workflow", "load_workflow", "check_workflow"),
            **named("name", "description"),
            "search_radius_positive": positive(c("search_radius")),
            **{f"{x}_workflow_positive": positive(c(f"{x}_workflow")) for x in ("collection", "load", "check")},
        },
        "data_source_contacts": {
            **required("ds_id", "name", "created", "created_by"),
            **named("name", "email", "website", "type", "notes"),
        },
        "load_instances": {
            **required("ds_id", "version_date", "state", "merge_type", "created", "created_by",
                       *[f"{p}_workflow_id" for p in phases]),
            **{f"{p}_finish_later": later(c(f"{p}_finish"), c(f"{p}_start")) for p in phases},
            **{f"{x}_not_negative": not_negative(c(x)) for x in
               ("production_count", "staging_count", "match_count", "new_count")},
            "state_known": member(c("state"), LOAD_STATES),
            "merge_type_known": member(c("merge_type"), MERGE_TYPES),
        },
        "plotting_method_types": {**required("name", "description"), **named("name", "description")},
        "source_data": {
            **required("li_id", "load_source_id", "user_generated", "options", "table_name", "columns", "to_load"),
            "load_source_id_positive": positive(c("load_source_id")),
            "table_name_form": table_name_ok(c("table_name")),
            "columns_valid": valid_columns(c("columns")),
            **named("error_message"),
        },
        "plotting_methods": {
            **required("sd_id", "plotting_order", "method_type"),
            "plotting_order_positive": positive(c("plotting_order")),
        },
        "plotting_fields": {
            **required("sd_id"),
            **named("location_name", "address_line1", "address_line2", "city", "mail_code", "latitude",
                    "longitude", "prov", "clean_address", "clean_city"),
            "alternate_cities_not_blank": array_not_blank(c("alternate_cities")),
        },
    }


# Unique keys of the catalogue tables (M13); primary keys first.
UNIQUE_KEYS = {
    "roles": [["role_id"], ["name"]],
    "users": [["uid"], ["username"]],
    "regions": [["region_id"], ["country_code", "prov_code", "county"]],
    "warehouse_types": [["wt_id"]],
    "data_sources": [["ds_id"]],
    "data_source_contacts": [["contact_id"]],
    "load_instances": [["li_id"]],
    "plotting_method_types": [["pmt_id"], ["name"]],
    "source_data": [["sd_id"], ["li_id", "table_name"], ["li_id", "load_source_id"]],
    "plotting_methods": [["sd_id", "plotting_order"]],
    "plotting_fields": [["sd_id"]],
}

# Child table and columns, parent table and columns, action on delete.
FOREIGN_KEYS = [
    ("user_roles", "uid", "users", "uid", "cascade"),
    ("user_roles", "role_id", "roles", "role_id", "restrict"),
    ("data_sources", "region_id", "regions", "region_id", "restrict"),
    ("data_sources", "assigned_user", "users", "uid", "restrict"),
    ("data_sources", "created_by", "users", "uid", "set null"),
    ("data_sources", "updated_by", "users", "uid", "set null"),
    ("data_sources", "warehouse_type", "warehouse_types", "wt_id", "restrict"),
    ("data_source_contacts", "ds_id", "data_sources", "ds_id", "restrict"),
    ("data_source_contacts", "created_by", "users", "uid", "set null"),
    ("data_source_contacts", "updated_by", "users", "uid", "set null"),
    ("load_instances", "ds_id", "data_sources", "ds_id", "restrict"),
    ("load_instances", "collect_user_id", "users", "uid", "set null"),
    ("load_instances", "load_user_id", "users", "uid", "set null"),
    ("load_instances", "check_user_id", "users", "uid", "set null"),
    ("load_instances", "created_by", "users", "uid", "set null"),
    ("load_instances", "updated_by", "users", "uid", "set null"),
    ("source_data", "li_id", "load_instances", "li_id", "restrict"),
    ("plotting_methods", "sd_id", "source_data", "sd_id", "restrict"),
    ("plotting_methods", "method_type", "plotting_method_types", "pmt_id", "restrict"),
    ("plotting_fields", "sd_id", "source_data", "sd_id", "restrict"),
]


def duplicates(rows: DataFrame, keys: list[str], nulls_equal: bool = False) -> DataFrame:
    """Key values held by more than one row, with the count. NULL keys are exempt by default."""
    if not nulls_equal:
        rows = rows.dropna(subset=keys)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent.

    The missing keys are found on distinct keys, so that a key with many rows is shuffled once per
    task and not once per row.
    """
    wanted = child.select(F.col(child_key).alias("_key")).dropna().distinct()
    known = parent.select(F.col(parent_key).alias("_known"))
    missing = wanted.join(known, F.col("_key") == F.col("_known"), "left_anti")
    return child.join(missing, F.col(child_key) == F.col("_key"), "left_semi")


def region_conflicts(regions: DataFrame) -> DataFrame:
    """``(rule, country_code, prov_code, county, n)`` of names that disagree and repeated rows.

    Counting distinct names first groups by code and name, so a code with many rows is reduced
    within the tasks that read it.
    """
    none = F.lit(None).cast("string")
    countries = regions.groupBy("country_code").agg(F.count_distinct("country_name").alias("n"))
    provinces = regions.filter("prov_code is not null").groupBy("country_code", "prov_code").agg(
        F.count_distinct("prov_name").alias("n"))
    repeated = regions.groupBy("country_code", "prov_code", "county").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        countries.select(F.lit("country_name").alias("rule"), "country_code", none.alias("prov_code"),
                         none.alias("county"), "n"),
        provinces.select(F.lit("prov_name").alias("rule"), "country_code", "prov_code",
                         none.alias("county"), "n"),
        repeated.select(F.lit("repeated").alias("rule"), "country_code", "prov_code", "county", "n"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("n > 1")


def order_report(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Per group, whether the orders are exactly 1..n.

    That holds when the smallest is 1, the largest is n and no value repeats; two aggregations with
    partial results, so no group has to be sorted in one place.
    """
    values = rows.groupBy(key, order).agg(F.count(F.lit(1)).alias("_n"))
    groups = values.groupBy(key).agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("distinct_orders"),
        F.min(order).alias("first_order"), F.max(order).alias("last_order"))
    fine = (F.col("first_order") == 1) & (F.col("last_order") == F.col("n")) & (
        F.col("distinct_orders") == F.col("n"))
    return groups.withColumn("contiguous", fine)


def order_gaps(spark: SparkSession, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose order is not their place in the group, ``(key, order, rn)``."""
    ranked = row_numbers(spark, rows.select(key, order), [key], [order])
    return ranked.filter(F.col("rn") != F.col(order))


def single_group(rows: DataFrame, key: str) -> DataFrame:
    """The number of distinct keys in a statement and whether it is at most one."""
    return rows.agg(F.count_distinct(key).alias("groups")).withColumn("ok", F.col("groups") <= 1)
