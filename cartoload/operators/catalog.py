"""The load catalogue: table schemas, seed rows, views and lookups."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


STAMPS = "created timestamp_ntz, created_by bigint, last_updated timestamp_ntz, updated_by bigint"
COLUMN_LIST = "array<struct<name:string,column_type:string>>"

TABLES = {
    "roles": "role_id int, name string, description string",
    "users": "uid bigint, name string, username string",
    "user_roles": "uid bigint, role_id int",
    "regions": ("region_id bigint, country_code string, country_name string, prov_code string, "
                "prov_name string, county string"),
    "warehouse_types": "wt_id int, name string, description string",
    "data_sources": (
        "ds_id bigint, name string, description string, search_radius float, comments string, "
        f"region_id bigint, assigned_user bigint, {STAMPS}, warehouse_type int, "
        "collection_workflow bigint, load_workflow bigint, check_workflow bigint"),
    "data_source_contacts": (
        "contact_id bigint, ds_id bigint, name string, email string, website string, type string, "
        f"notes string, {STAMPS}"),
    "load_instances": (
        "li_id bigint, ds_id bigint, version_date date, collect_user_id bigint, load_user_id bigint, "
        "check_user_id bigint, state string, production_count int, staging_count int, match_count int, "
        "new_count int, plotting_stats string, "
        + ", ".join(f"{p}_start timestamp_ntz, {p}_finish timestamp_ntz, {p}_workflow_id bigint, "
                    f"{p}_workflow_run_id bigint" for p in ("collect", "load", "check"))
        + f", done timestamp_ntz, merge_type string, {STAMPS}"),
    "plotting_method_types": "pmt_id int, name string, description string",
    "source_data": (
        "sd_id bigint, li_id bigint, load_source_id smallint, user_generated boolean, options string, "
        f"table_name string, columns {COLUMN_LIST}, to_load boolean, loaded_timestamp timestamp, "
        "error_message string"),
    "plotting_methods": "sd_id bigint, plotting_order smallint, method_type int",
    "plotting_fields": (
        "sd_id bigint, location_name string, address_line1 string, address_line2 string, city string, "
        "alternate_cities array<string>, mail_code string, latitude string, longitude string, "
        "prov string, clean_address string, clean_city string"),
    "logged_actions": (
        "event_id bigint, schema_name string, table_name string, relid bigint, session_user_name string, "
        "action_tstamp_tx timestamp, action_tstamp_stm timestamp, action_tstamp_clk timestamp, "
        "transaction_id bigint, application_name string, client_addr string, client_port int, "
        "client_query string, action string, row_data string, changed_fields string, "
        "statement_only boolean, acting_user_id bigint"),
}

# Catalogue tables under row audit.
AUDITED = ["users", "user_roles", "regions", "warehouse_types", "data_sources", "data_source_contacts",
           "load_instances", "plotting_fields"]

# Roles.
ROLES = [
    ("admin", "All privileges granted"),
    ("collection", "Collect data for a load instance"),
    ("load", "Process a data load"),
    ("check", "Check a load instance"),
    ("create_ls", "create a new load instance"),
    ("create_ds", "create a new data source"),
]

# Capability and the roles that grant it.
CAPABILITIES = {
    "is_admin": ["admin"],
    "create_ds": ["admin", "create_ds"],
    "update_ds": ["admin", "collection"],
    "create_ls": ["admin", "create_ls"],
    "collect": ["admin", "collection"],
    "load": ["admin", "load"],
    "check": ["admin", "check"],
}

# Warehouse types.
WAREHOUSE_TYPES = [
    ("Current", "Only keep the current dataset. All non-matched records are deleted."),
    ("Archive", "Production contains current dataset only but non-matched records are moved to a separate archive."),
    ("Historical", "Keep all records. Current dataset updates production record details when matched and "
                   "non-matched records are retained."),
    ("Full Historical", "Keep all records. Current dataset merges with production record details when matched "
                        "and non-matched records are retained."),
]

# Fixed values: (country code, country name, province code, province name), in seed order.
REGIONS = [
    ("US", "United States", "AL", "Alabama"),
    ("US", "United States", "AK", "Alaska"),
    ("US", "United States", "AZ", "Arizona"),
    ("US", "United States", "AR", "Arkansas"),
    ("US", "United States", "CA", "California"),
    ("US", "United States", "CO", "Colorado"),
    ("US", "United States", "CT", "Connecticut"),
    ("US", "United States", "DE", "Delaware"),
    ("US", "United States", "DC", "District of Columbia"),
    ("US", "United States", "FL", "Florida"),
    ("US", "United States", "GA", "Georgia"),
    ("US", "United States", "HI", "Hawaii"),
    ("US", "United States", "ID", "Idaho"),
    ("US", "United States", "IL", "Illinois"),
    ("US", "United States", "IN", "Indiana"),
    ("US", "United States", "IA", "Iowa"),
    ("US", "United States", "KS", "Kansas"),
    ("US", "United States", "KY", "Kentucky"),
    ("US", "United States", "LA", "Louisiana"),
    ("US", "United States", "ME", "Maine"),
    ("US", "United States", "MD", "Maryland"),
    ("US", "United States", "MA", "Massachusetts"),
    ("US", "United States", "MI", "Michigan"),
    ("US", "United States", "MN", "Minnesota"),
    ("US", "United States", "MS", "Mississippi"),
    ("US", "United States", "MO", "Missouri"),
    ("US", "United States", "MT", "Montana"),
    ("US", "United States", "NE", "Nebraska"),
    ("US", "United States", "NV", "Nevada"),
    ("US", "United States", "NH", "New Hampshire"),
    ("US", "United States", "NJ", "New Jersey"),
    ("US", "United States", "NM", "New Mexico"),
    ("US", "United States", "NY", "New York"),
    ("US", "United States", "NC", "North Carolina"),
    ("US", "United States", "ND", "North Dakota"),
    ("US", "United States", "OH", "Ohio"),
    ("US", "United States", "OK", "Oklahoma"),
    ("US", "United States", "OR", "Oregon"),
    ("US", "United States", "PA", "Pennsylvania"),
    ("US", "United States", "RI", "Rhode Island"),
    ("US", "United States", "SC", "South Carolina"),
    ("US", "United States", "SD", "South Dakota"),
    ("US", "United States", "TN", "Tennessee"),
    ("US", "United States", "TX", "Texas"),
    ("US", "United States", "UT", "Utah"),
    ("US", "United States", "VT", "Vermont"),
    ("US", "United States", "VA", "Virginia"),
    ("US", "United States", "WA", "Washington"),
    ("US", "United States", "WV", "West Virginia"),
    ("US", "United States", "WI", "Wisconsin"),
    ("US", "United States", "WY", "Wyoming"),
    ("US", "United States", "AS", "American Samoa"),
    ("US", "United States", "GU", "Guam"),
    ("US", "United States", "MP", "Northern Mariana Islands"),
    ("US", "United States", "PR", "Puerto Rico"),
    ("US", "United States", "UM", "U.S. Minor Outlying Islands"),
    ("US", "United States", "VI", "U.S. Virgin Islands"),
    ("CA", "Canada", "AB", "Alberta"),
    ("CA", "Canada", "BC", "British Columbia"),
    ("CA", "Canada", "SK", "Saskatchewan"),
    ("CA", "Canada", "MB", "Manitoba"),
    ("CA", "Canada", "NB", "New Brunswick"),
    ("CA", "Canada", "NL", "Newfoundland and Labrador"),
    ("CA", "Canada", "NT", "Northwest Territories"),
    ("CA", "Canada", "NS", "Nova Scotia"),
    ("CA", "Canada", "NU", "Nunavut"),
    ("CA", "Canada", "ON", "Ontario"),
    ("CA", "Canada", "PE", "Prince Edward Island"),
    ("CA", "Canada", "QC", "Quebec"),
    ("CA", "Canada", "YT", "Yukon"),
    ("CA", "Canada", None, None),
    ("US", "United States", None, None),
]


def seed_rows() -> dict[str, list[tuple]]:
    """The rows a new catalogue starts with."""
    return {
        "roles": [(i, *row) for i, row in enumerate(ROLES, 1)],
        "regions": [(i, *row, None) for i, row in enumerate(REGIONS, 1)],
        "warehouse_types": [(i, *row) for i, row in enumerate(WAREHOUSE_TYPES, 1)],
    }


def seed(spark: SparkSession, table: str) -> DataFrame:
    """Seed rows as a local relation: its size is known, so the planner may broadcast it."""
    names = [entry.split(" ", 1)[0] for entry in TABLES[table].split(", ")]
    columns = zip(*seed_rows()[table])
    return spark.createDataFrame(pa.table(dict(zip(names, map(list, columns))))).select(*[
        F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], TABLES[table]).schema])


# --- views ---------------------------------------------------------------------------------------

def users_view(users: DataFrame, user_roles: DataFrame, roles: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """Users with their roles as one sorted array; users without roles only on request.

    A user's grants are made distinct first, so the array is no longer than the list of roles.
    """
    granted = user_roles.select("uid", "role_id").distinct().join(roles, "role_id").groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("role_id", "name", "description"))).alias("roles"))
    joined = users.join(granted, "uid", "left" if keep_unmatched else "inner")
    listed = F.coalesce("roles", F.array().cast("array<struct<role_id:int,name:string,description:string>>"))
    return joined.select("uid", "name", "username", (listed if keep_unmatched else F.col("roles")).alias("roles"))


def contacts_with_names(contacts: DataFrame, users: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """Contacts with creator and updater names; contacts never updated only on request."""
    names = lambda prefix: users.select(F.col("uid").alias(f"_{prefix}"), F.col("name").alias(f"_{prefix}_name"))
    how = "left" if keep_unmatched else "inner"
    joined = contacts.join(names("creator"), F.col("created_by") == F.col("_creator"), how).join(
        names("updater"), F.col("updated_by") == F.col("_updater"), how)
    return joined.select(
        "ds_id", "contact_id", "name", "email", "website", F.col("type").alias("contact_type"), "notes",
        "created", F.col("_creator_name").alias("created_by"), "last_updated",
        F.col("_updater_name").alias("updated_by"))


def data_sources_view(sources: DataFrame, regions: DataFrame, users: DataFrame, warehouse_types: DataFrame,
                      contacts: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """Data sources with region, user names, warehouse type and contacts, in long form.

    One row per source and contact, and one with a null ``contact`` for a source without any, however
    many contacts a source has: they are never brought together. The inner and the anti join let hot
    sources be split; the lookups carry no hints, so the planner broadcasts what it measures as small.
    """
    named = contacts_with_names(contacts, users, keep_unmatched)
    items = named.select("ds_id", F.struct(*[c for c in named.columns if c != "ds_id"]).alias("contact"))
    who = lambda prefix: users.select(F.col("uid").alias(f"_{prefix}"), F.col("name").alias(f"{prefix}_name"))
    types = warehouse_types.select(
        "wt_id", F.col("name").alias("warehouse_name"), F.col("description").alias("warehouse_description"))
    how = "left" if keep_unmatched else "inner"
    joined = (
        sources.join(regions, "region_id")
        .join(who("assigned"), F.col("assigned_user") == F.col("_assigned"), how)
        .join(who("creator"), F.col("created_by") == F.col("_creator"), how)
        .join(who("updater"), F.col("updated_by") == F.col("_updater"), how)
        .join(types, F.col("warehouse_type") == F.col("wt_id"))
    )
    known = joined.select(
        "ds_id", "name", "description", "search_radius", "comments",
        "region_id", "country_code", "country_name", "prov_code", "prov_name", "county",
        F.col("assigned_name").alias("assigned_user"), "created", F.col("creator_name").alias("created_by"),
        "last_updated", F.col("updater_name").alias("updated_by"),
        "wt_id", "warehouse_name", "warehouse_description",
        "collection_workflow", "load_workflow", "check_workflow",
    )
    without = known.join(items.select("ds_id").distinct(), "ds_id", "left_anti")
    return known.join(items, "ds_id").unionByName(
        without.withColumn("contact", F.lit(None).cast(items.schema["contact"].dataType)))


def sources_to_load(source_data: DataFrame, load_instances: DataFrame, workflow_run_id: int | None = None) -> DataFrame:
    """Entries marked to load of the instances in a workflow run (of any run if not given)."""
    run = F.col("load_workflow_run_id")
    instances = load_instances.filter(run.isNotNull() if workflow_run_id is None else run == workflow_run_id)
    return source_data.filter("to_load").join(instances.select("li_id"), "li_id", "left_semi")


def source_entries(source_data: DataFrame, li_id: int | None = None, sd_id: int | None = None) -> DataFrame:
    """Entries by load instance or by id."""
    wanted = F.col("sd_id") == sd_id if sd_id is not None else F.col("li_id") == li_id
    return source_data.filter(wanted)


def register_views(tables: dict[str, DataFrame]) -> None:
    """The catalogue tables and both views as temp views for SQL."""
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
    users_view(tables["users"], tables["user_roles"], tables["roles"]).createOrReplaceTempView("v_users")
    data_sources_view(
        tables["data_sources"], tables["regions"], tables["users"], tables["warehouse_types"],
        tables["data_source_contacts"]).createOrReplaceTempView("v_data_sources")


# --- rights --------------------------------------------------------------------------------------

def capabilities(user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """One row per user with a flag per capability, by partial aggregation over role names."""
    held = user_roles.join(roles.select("role_id", F.col("name").alias("role")), "role_id")
    flags = [F.bool_or(F.col("role").isin(granting)).alias(name) for name, granting in CAPABILITIES.items()]
    return held.groupBy("uid").agg(*flags)


def allowed_users(user_roles: DataFrame, roles: DataFrame, capability: str) -> DataFrame:
    """Distinct ids of the users with one capability."""
    granting = roles.filter(F.col("name").isin(CAPABILITIES[capability])).select("role_id")
    return user_roles.join(granting, "role_id", "left_semi").select("uid").distinct()


def may_update(requests: DataFrame, load_instances: DataFrame, admins: DataFrame) -> DataFrame:
    """``(uid, li_id)`` requests with ``allowed``: part of the load instance, or an admin."""
    people = load_instances.select("li_id", F.explode(F.array_distinct(F.array(
        "collect_user_id", "load_user_id", "check_user_id"))).alias("uid")).filter("uid is not null")
    taking_part = people.distinct().withColumn("_part", F.lit(True))
    admin = admins.select("uid").distinct().withColumn("_admin", F.lit(True))
    joined = requests.join(taking_part, ["uid", "li_id"], "left").join(admin, "uid", "left")
    flag: Column = F.coalesce("_part", F.lit(False)) | F.coalesce("_admin", F.lit(False))
    return joined.select(*[c for c in requests.columns], flag.alias("allowed"))
