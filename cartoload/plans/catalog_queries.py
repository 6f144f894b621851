"""Queries over the load catalogue, with the given tables standing in for catalogue tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartoload.operators import catalog, changelog, changes, checks, deltachecks, entries, filechanges, references, warehouse
from cartoload.operators.ordinal import collected, row_numbers
from cartoload.plans.registry import query, table
from cartoload.session import scratch

ROLE_NAMES = ["admin", "check", "collection", "create_ds", "load"]


def people(spark, folder):
    """Customers as users, order priorities as roles, orders as grants."""
    users = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"), F.lower("c_name").alias("username"))
    orders = table(spark, folder, "orders")
    grants = orders.select(F.col("o_custkey").alias("uid"), F.substring("o_orderpriority", 1, 1).cast("int").alias("role_id"))
    names = F.element_at(F.array(*map(F.lit, ROLE_NAMES)), F.col("role_id"))
    roles = grants.select("role_id").distinct().select("role_id", names.alias("name"), names.alias("description"))
    return users, grants, roles


ROLES_SQL = """
WITH grants AS (SELECT o_custkey AS uid, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS role_id FROM orders),
roles AS (SELECT DISTINCT role_id, CASE role_id WHEN 1 THEN 'admin' WHEN 2 THEN 'check' WHEN 3 THEN 'collection'
  WHEN 4 THEN 'create_ds' ELSE 'load' END AS name FROM grants)"""


@query("users_with_roles", ROLES_SQL + """,
g AS (SELECT DISTINCT uid, role_id, name FROM grants JOIN roles USING (role_id))
SELECT uid, c_name AS name, lower(c_name) AS username, string_agg(role_id || ':' || g.name, ',' ORDER BY role_id) AS roles
FROM g JOIN customer ON uid = c_custkey GROUP BY ALL""")
def users_with_roles(spark, folder):
    """J1, G1, M18."""
    shown = F.array_join(F.transform("roles", lambda r: F.concat(r["role_id"].cast("string"), F.lit(":"), r["name"])), ",")
    return catalog.users_view(*people(spark, folder)).select("uid", "name", "username", shown.alias("roles"))


@query("capabilities", ROLES_SQL + """
SELECT uid, bool_or(name = 'admin') AS is_admin, bool_or(name IN ('admin', 'create_ds')) AS create_ds,
  bool_or(name IN ('admin', 'collection')) AS update_ds, bool_or(name IN ('admin', 'create_ls')) AS create_ls,
  bool_or(name IN ('admin', 'collection')) AS collect, bool_or(name IN ('admin', 'load')) AS load,
  bool_or(name IN ('admin', 'check')) AS "check"
FROM grants JOIN roles USING (role_id) GROUP BY uid""")
def capabilities(spark, folder):
    """J6."""
    _, grants, roles = people(spark, folder)
    return catalog.capabilities(grants, roles)


@query("allowed_users", ROLES_SQL + """
SELECT c_custkey AS uid FROM customer WHERE EXISTS (SELECT 1 FROM grants JOIN roles USING (role_id)
  WHERE uid = c_custkey AND name IN ('admin', 'load'))""")
def allowed_users(spark, folder):
    """J6 as the user set of one capability."""
    _, grants, roles = people(spark, folder)
    return catalog.allowed_users(grants, roles, "load")


@query("may_update", """
WITH requests AS (SELECT l_suppkey AS uid, l_orderkey AS li_id, l_linenumber, l_partkey FROM lineitem)
SELECT r.uid, r.li_id, r.l_linenumber, r.l_partkey,
  EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = r.li_id AND (o.o_custkey = r.uid
    OR (o.o_orderstatus = 'F' AND r.uid = 7)))
  OR EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = r.uid AND s.s_acctbal > 5000) AS allowed
FROM requests r""")
def may_update(spark, folder):
    """Part of the load instance, or an admin."""
    requests = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("uid"), F.col("l_orderkey").alias("li_id"), "l_linenumber", "l_partkey")
    instances = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("li_id"), F.col("o_custkey").alias("collect_user_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit(7).cast("bigint")).alias("load_user_id"),
        F.lit(None).cast("bigint").alias("check_user_id"))
    admins = table(spark, folder, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("uid"))
    return catalog.may_update(requests, instances, admins)


def contact_rows(spark, folder):
    """Line items as contacts of suppliers; lines not returned were never updated."""
    return table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"),
                    F.date_format("l_shipdate", "yyyyMMdd")).alias("contact_id"),
        F.col("l_suppkey").alias("ds_id"), F.col("l_returnflag").alias("name"),
        F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("website"),
        F.col("l_linestatus").alias("type"), F.lit(None).cast("string").alias("notes"),
        F.col("l_shipdate").alias("created"), F.col("l_partkey").alias("created_by"),
        F.col("l_shipdate").alias("last_updated"),
        F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("updated_by"))


@query("contacts_with_names", """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER),
    strftime(l_shipdate, '%Y%m%d')) AS contact_id,
  l_suppkey AS ds_id, p_name AS created_by, p_name AS updated_by
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N'""")
def contacts_with_names(spark, folder):
    """Contacts never updated drop out."""
    users = table(spark, folder, "part").select(F.col("p_partkey").alias("uid"), F.col("p_name").alias("name"))
    return catalog.contacts_with_names(contact_rows(spark, folder), users).select(
        "contact_id", "ds_id", "created_by", "updated_by")


SOURCES_SQL = """
WITH contacts AS (SELECT l_suppkey, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER),
    strftime(l_shipdate, '%Y%m%d')) AS contact_id, l_linestatus AS contact_type, p_name AS contact_by
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N')
SELECT s_suppkey AS ds_id, s_name AS name, n_nationkey AS region_id, r_name AS country_name, n_name AS prov_name,
  s_acctbal > 0 AS in_credit, p.p_name AS assigned_user, CASE WHEN s_acctbal > 0 THEN 'Current' ELSE 'Archive' END AS warehouse_name,
  contact_id, contact_type, contact_by
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN part p ON p_partkey = s_suppkey LEFT JOIN contacts ON l_suppkey = s_suppkey"""


@query("source_catalog", SOURCES_SQL)
def source_catalog(spark, folder):
    """Suppliers as data sources, nations as regions, returned lines as contacts; a row for each contact."""
    tables = source_tables(spark, folder)
    view = catalog.data_sources_view(tables["data_sources"], tables["regions"], tables["users"], tables["warehouse_types"], tables["data_source_contacts"])
    return view.select("ds_id", "name", "region_id", "country_name", "prov_name", F.col("comments").isNotNull().alias("in_credit"), "assigned_user", "warehouse_name",
                       F.col("contact.contact_id").alias("contact_id"), F.col("contact.contact_type").alias("contact_type"), F.col("contact.created_by").alias("contact_by"))


def source_tables(spark, folder):
    supplier = table(spark, folder, "supplier")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    sources = supplier.select(
        F.col("s_suppkey").alias("ds_id"), F.col("s_name").alias("name"), F.lit("").alias("description"),
        F.lit(1.0).cast("float").alias("search_radius"),
        F.when(F.col("s_acctbal") > 0, "credit").alias("comments"), F.col("s_nationkey").alias("region_id"),
        F.col("s_suppkey").alias("assigned_user"), now.alias("created"), F.col("s_suppkey").alias("created_by"),
        now.alias("last_updated"), F.col("s_suppkey").alias("updated_by"),
        F.when(F.col("s_acctbal") > 0, 1).otherwise(2).alias("warehouse_type"),
        F.lit(1).alias("collection_workflow"), F.lit(2).alias("load_workflow"), F.lit(3).alias("check_workflow"))
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    regions = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("region_id"), F.col("r_regionkey").cast("string").alias("country_code"),
        F.col("r_name").alias("country_name"), F.col("n_nationkey").cast("string").alias("prov_code"),
        F.col("n_name").alias("prov_name"), F.lit(None).cast("string").alias("county"))
    users = table(spark, folder, "part").select(F.col("p_partkey").alias("uid"), F.col("p_name").alias("name"))
    return {"data_sources": sources, "regions": regions, "users": users, "warehouse_types": catalog.seed(spark, "warehouse_types"),
            "data_source_contacts": contact_rows(spark, folder)}


@query("bounded_arrays", "SELECT o_custkey, o_orderkey FROM orders")
def bounded_arrays(spark, folder):
    """G2 with arrays of a few items each: every item is in one of its key's parts."""
    parts = collected(table(spark, folder, "orders"), "o_custkey", F.col("o_orderkey"), "o_orderkey", "orders",
                      largest_array=8)
    return parts.select("o_custkey", F.explode("orders").alias("o_orderkey"))


@query("to_load_sources", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE l_linestatus = 'O' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def to_load_sources(spark, folder):
    """J5, M17, P9."""
    entries = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("li_id"), "l_linenumber", "l_partkey", "l_quantity",
        (F.col("l_linestatus") == "O").alias("to_load"))
    instances = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("li_id"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("load_workflow_run_id"))
    return catalog.sources_to_load(entries, instances, 1).select(
        F.col("li_id").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_quantity")


@query("fk_violations", """
SELECT 'labels' AS child, CAST(doc_id AS VARCHAR) AS key FROM labels l
  WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang <> 'de')
UNION ALL SELECT 'lineitem', CAST(l_orderkey AS VARCHAR) FROM lineitem
  WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier
  WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND n_regionkey <> 2)""")
def fk_violations(spark, folder):
    """Children of parents that were taken out."""
    edges = [
        ("labels", "doc_id", table(spark, folder, "documents").filter("lang <> 'de'"), "doc_id", "doc_id"),
        ("lineitem", "l_orderkey", table(spark, folder, "orders").filter("o_orderstatus <> 'P'"), "o_orderkey", "l_orderkey"),
        ("supplier", "s_nationkey", table(spark, folder, "nation").filter("n_regionkey <> 2"), "n_nationkey", "s_suppkey"),
    ]
    found = None
    for child, child_key, parent, parent_key, shown in edges:
        rows = checks.orphans(table(spark, folder, child), child_key, parent, parent_key).select(
            F.lit(child).alias("child"), F.col(shown).cast("string").alias("key"))
        found = rows if found is None else found.unionByName(rows)
    return found


@query("distinct_count", """
SELECT count(DISTINCT l_orderkey) AS groups, count(DISTINCT l_orderkey) <= 1 AS ok FROM lineitem""")
def distinct_count(spark, folder):
    """G4, M12."""
    return checks.single_group(table(spark, folder, "lineitem"), "l_orderkey")


@query("dup_keys", """
SELECT 'lineitem' AS table_name, l_orderkey || '/' || l_linenumber AS key, count(*) AS n FROM lineitem
  GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'documents', lang || '/' || text, count(*) FROM documents WHERE lang <> 'de' GROUP BY lang, text HAVING count(*) > 1""")
def dup_keys(spark, folder):
    """Rows with a NULL in the key are exempt."""
    lines = checks.duplicates(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"]).select(
        F.lit("lineitem").alias("table_name"),
        F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"), "n")
    documents = table(spark, folder, "documents").select(
        F.when(F.col("lang") != "de", F.col("lang")).alias("lang"), "text")
    texts = checks.duplicates(documents, ["lang", "text"]).select(
        F.lit("documents").alias("table_name"), F.concat_ws("/", "lang", "text").alias("key"), "n")
    return lines.unionByName(texts)


@query("order_report", """
SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS distinct_orders, min(l_linenumber) AS first_order,
  max(l_linenumber) AS last_order,
  min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous
FROM lineitem GROUP BY l_orderkey""")
def order_report(spark, folder):
    """W1, M12 by group."""
    return checks.order_report(table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")


@query("order_gaps", """
SELECT * FROM (SELECT l_orderkey, l_linenumber,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM lineitem) WHERE rn <> l_linenumber""")
def order_gaps(spark, folder):
    """W1 by row."""
    return checks.order_gaps(spark, table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")


@query("status_numbers", """
SELECT l_linestatus, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_orderkey, l_linenumber,
  l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem""")
def status_numbers(spark, folder):
    """W1 where two groups hold the whole table."""
    rows = table(spark, folder, "lineitem").select("l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    ranked = row_numbers(spark, rows, ["l_linestatus"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    return ranked.select("l_linestatus", "l_orderkey", "l_linenumber", "rn")


@query("latest_per_key", """
SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id""")
def latest_per_key(spark, folder):
    """T1."""
    return changes.latest(table(spark, folder, "events"), "user_id", "event_id", "event_type", "value")


@query("new_instances", """
WITH last AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS merge_type FROM orders GROUP BY o_custkey)
SELECT c_custkey AS ds_id, DATE '2024-06-01' AS version_date, c_nationkey + 1 AS collect_workflow_id,
  c_nationkey + 2 AS load_workflow_id, c_nationkey + 3 AS check_workflow_id, coalesce(merge_type, 'None') AS merge_type
FROM customer LEFT JOIN last ON o_custkey = c_custkey""")
def new_instances(spark, folder):
    """A new load instance for every customer."""
    customer = table(spark, folder, "customer")
    requests = customer.select(F.col("c_custkey").alias("ds_id"), F.lit("2024-06-01").cast("date").alias("version_date"))
    sources = customer.select(
        F.col("c_custkey").alias("ds_id"), (F.col("c_nationkey") + 1).alias("collection_workflow"),
        (F.col("c_nationkey") + 2).alias("load_workflow"), (F.col("c_nationkey") + 3).alias("check_workflow"))
    instances = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("li_id"), F.col("o_custkey").alias("ds_id"), F.col("o_orderpriority").alias("merge_type"))
    return changes.new_instances(requests, sources, instances)


@query("region_consistency", """
WITH r AS (SELECT o_orderstatus AS country_code, CASE WHEN o_orderpriority = '1-URGENT' THEN 'U' ELSE o_orderstatus END AS country_name,
  CASE WHEN o_orderstatus <> 'F' THEN CAST(o_custkey AS VARCHAR) END AS prov_code,
  CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS prov_name,
  CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(o_orderkey AS VARCHAR) END AS county FROM orders)
SELECT 'country_name' AS rule, country_code, NULL AS prov_code, NULL AS county, count(DISTINCT country_name) AS n
  FROM r GROUP BY country_code HAVING count(DISTINCT country_name) > 1
UNION ALL SELECT 'prov_name', country_code, prov_code, NULL, count(DISTINCT prov_name) FROM r WHERE prov_code IS NOT NULL
  GROUP BY country_code, prov_code HAVING count(DISTINCT prov_name) > 1
UNION ALL SELECT 'repeated', country_code, prov_code, county, count(*) FROM r
  GROUP BY country_code, prov_code, county HAVING count(*) > 1""")
def region_consistency(spark, folder):
    """A few country codes hold all rows, and one name out of five disagrees."""
    c = F.col
    regions = table(spark, folder, "orders").select(
        c("o_orderstatus").alias("country_code"),
        F.when(c("o_orderpriority") == "1-URGENT", "U").otherwise(c("o_orderstatus")).alias("country_name"),
        F.when(c("o_orderstatus") != "F", c("o_custkey").cast("string")).alias("prov_code"),
        F.when(c("o_orderstatus") != "F", c("o_orderpriority")).alias("prov_name"),
        F.when(c("o_orderpriority") == "2-HIGH", c("o_orderkey").cast("string")).alias("county"))
    return checks.region_conflicts(regions)


@query("audited_tables", """
SELECT DISTINCT lang AS schema, source AS auditedtable FROM documents""")
def audited_tables(spark, folder):
    """M10, T2, G6."""
    return changelog.audited_tables(table(spark, folder, "documents").select(
        F.col("lang").alias("schema"), F.col("source").alias("auditedtable")))


# --- changes -------------------------------------------------------------------------------------

def orders_before(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(15,2)").alias("o_totalprice"),
        "o_orderpriority")


def orders_after(spark, folder):
    """Open orders cost one more, finished low-priority ones are gone, urgent ones come again under a
    negative key, pending high-priority ones change owner only."""
    old = orders_before(spark, folder)
    c = F.col
    kept = old.filter("NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')").select(
        "o_orderkey",
        F.when((c("o_orderstatus") == "P") & (c("o_orderpriority") == "2-HIGH"), c("o_custkey") + 1)
        .otherwise(c("o_custkey")).alias("o_custkey"), "o_orderstatus",
        F.when(c("o_orderstatus") == "O", c("o_totalprice") + 1).otherwise(c("o_totalprice"))
        .cast("decimal(15,2)").alias("o_totalprice"), "o_orderpriority")
    fresh = old.filter("o_orderpriority = '1-URGENT'").withColumn("o_orderkey", -c("o_orderkey") - 1)
    return kept.unionByName(fresh)


ROW = """'{{"o_orderkey":' || {k} || ',{owner}"o_orderstatus":"' || o_orderstatus || '","o_totalprice":' ||
  CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS VARCHAR) || ',"o_orderpriority":"' || o_orderpriority || '"}}'"""
OWNER = """"o_custkey":' || o_custkey || ',"""


def _log_sql(owner: str, owner_changes: str) -> str:
    old, new = ROW.format(k="o_orderkey", owner=owner), ROW.format(k="(-o_orderkey - 1)", owner=owner)
    return f"""
SELECT o_orderkey, 'U' AS action, {old} AS row_data,
  '{{"o_totalprice":"' || CAST(CAST(o_totalprice AS DECIMAL(15, 2)) + 1 AS VARCHAR) || '"}}' AS changed_fields
  FROM orders WHERE o_orderstatus = 'O'
{owner_changes}
UNION ALL SELECT o_orderkey, 'D', {old}, NULL FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'
UNION ALL SELECT -o_orderkey - 1, 'I', {new}, NULL FROM orders WHERE o_orderpriority = '1-URGENT'"""


@query("change_log", _log_sql(OWNER, f"""UNION ALL SELECT o_orderkey, 'U', {ROW.format(k='o_orderkey', owner=OWNER)},
  '{{"o_custkey":"' || (o_custkey + 1) || '"}}' FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '2-HIGH'"""))
def change_log(spark, folder):
    """M6, J9, G3."""
    return changelog.change_rows(orders_before(spark, folder), orders_after(spark, folder), ["o_orderkey"])


@query("change_log_ignored", _log_sql("", ""))
def change_log_ignored(spark, folder):
    """M7: changes of the owner are not looked at."""
    return changelog.change_rows(
        orders_before(spark, folder), orders_after(spark, folder), ["o_orderkey"], ignored=("o_custkey",))


@query("statement_log", """
SELECT 'sales' AS schema_name, 'orders' AS table_name, 'loader' AS session_user_name, 'cartoload' AS application_name,
  7 AS acting_user_id, action, statement_only FROM (
  SELECT DISTINCT 'U' AS action, true AS statement_only FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT DISTINCT 'D', true FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'
  UNION ALL SELECT DISTINCT 'I', true FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'T', true)""")
def statement_log(spark, folder):
    """M8, M9."""
    rows = changelog.change_rows(orders_before(spark, folder), orders_after(spark, folder), ["o_orderkey"])
    context = changelog.Context("sales", "orders", "loader", "cartoload", 7, "2024-01-01 00:00:00")
    return changelog.statement_log(rows, context, truncated=True).select(
        "schema_name", "table_name", "session_user_name", "application_name",
        F.col("acting_user_id").cast("int").alias("acting_user_id"), "action", "statement_only")


@query("insert_batch", """
SELECT 99 + row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS id,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem""")
def insert_batch(spark, folder):
    """M1: every line gets the next id after the largest one in a table of ids."""
    known = table(spark, folder, "region").select((F.col("r_regionkey") + 95).alias("id"))
    rows = table(spark, folder, "lineitem").select(
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return changes.insert_rows(spark, known, rows, "id", [
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    ]).drop("l_shipdate", "l_extendedprice")


@query("update_batch", """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderpriority <> '5-LOW' THEN lower(o_orderpriority) END
    ELSE o_orderpriority END AS o_orderpriority
FROM orders""")
def update_batch(spark, folder):
    """M2: an empty optional text becomes NULL."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    open_orders = table(spark, folder, "orders").filter("o_orderstatus = 'O'").select(
        "o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.lower("o_orderpriority")).alias("o_orderpriority"))
    return changes.update_rows(orders, open_orders, "o_orderkey", ["o_totalprice", "o_orderpriority"], ("o_orderpriority",))


@query("delete_batch", """
SELECT o_orderkey, o_orderstatus = 'F' AS deleted FROM orders""")
def delete_batch(spark, folder):
    """M3: what stays and what goes."""
    orders = table(spark, folder, "orders")
    gone = table(spark, folder, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    kept, deleted = changes.delete_rows(orders, gone, "o_orderkey")
    mark = lambda rows, flag: rows.select("o_orderkey", F.lit(flag).alias("deleted"))
    return mark(kept, False).unionByName(mark(deleted, True))


@query("change_stamps", """
SELECT event_id, user_id AS created_by, user_id AS updated_by, TIMESTAMP '2024-06-01 12:00:00' AS last_updated FROM events
UNION ALL SELECT -event_id - 1, user_id, NULL, TIMESTAMP '2024-06-01 12:00:00' FROM events""")
def change_stamps(spark, folder):
    """M4: inserts carry the creator over, updates only move the time."""
    now = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz")
    rows = table(spark, folder, "events").select("event_id", F.col("user_id").alias("created_by"))
    updated = rows.withColumn("event_id", -F.col("event_id") - 1).withColumn("updated_by", F.lit(None).cast("bigint"))
    return changes.stamp_insert(rows, now).unionByName(changes.stamp_update(updated, now))


@query("role_gate", ROLES_SQL + """
SELECT event_id, CASE WHEN user_id NOT IN (SELECT uid FROM grants JOIN roles USING (role_id) WHERE name IN ('admin', 'load'))
  THEN 'uid ' || user_id || ' cannot load' END AS reason FROM events""")
def role_gate(spark, folder):
    """M5: events as changes by their users."""
    _, grants, roles = people(spark, folder)
    events = table(spark, folder, "events").select("event_id", "user_id")
    accepted, rejected = changes.gate(
        events, "user_id", catalog.allowed_users(grants, roles, "load"), "uid %s cannot load")
    nothing = F.lit(None).cast("string").alias("reason")
    return accepted.select("event_id", nothing).unionByName(rejected.select("event_id", "reason"))


def order_batch(spark, folder):
    """Updates of open orders, deletes of finished ones, inserts under negative keys; owners act."""
    orders = orders_before(spark, folder)
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    updates = orders.filter(status == "O").withColumn("o_totalprice", (F.col("o_totalprice") + 1).cast("decimal(15,2)"))
    deletes = orders.filter(status == "F")
    inserts = orders.filter(status == "P").withColumn("o_orderkey", -key - 1)
    tagged = [frame.select(F.lit(action).alias("action"), F.col("o_custkey").alias("actor"), "*")
              for action, frame in (("U", updates), ("D", deletes), ("I", inserts))]
    return orders, tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def applied(spark, folder):
    orders, batch = order_batch(spark, folder)
    allowed = table(spark, folder, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("uid"))
    return changes.apply_changes(orders, batch, "o_orderkey", "actor", allowed, "uid %s cannot change orders")


@query("apply_changes", """
WITH a AS (SELECT orders.*, c_acctbal > 0 AS ok FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(15, 2))::VARCHAR AS price FROM a WHERE NOT ok OR o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, (CAST(o_totalprice AS DECIMAL(15, 2)) + 1)::VARCHAR FROM a WHERE ok AND o_orderstatus = 'O'
UNION ALL SELECT -o_orderkey - 1, CAST(o_totalprice AS DECIMAL(15, 2))::VARCHAR FROM a WHERE ok AND o_orderstatus = 'P'""")
def apply_changes(spark, folder):
    """M1 to M5 in one batch: the new table."""
    return applied(spark, folder).table.select("o_orderkey", F.col("o_totalprice").cast("string").alias("price"))


@query("applied_log", """
WITH a AS (SELECT orders.*, c_acctbal > 0 AS ok FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT CASE WHEN o_orderstatus = 'P' THEN -o_orderkey - 1 ELSE o_orderkey END AS o_orderkey,
  CASE WHEN NOT ok THEN 'rejected' ELSE CASE o_orderstatus WHEN 'O' THEN 'U' WHEN 'F' THEN 'D' ELSE 'I' END END AS outcome,
  CASE WHEN NOT ok THEN 'uid ' || o_custkey || ' cannot change orders' END AS reason
FROM a""")
def applied_log(spark, folder):
    """M5, M6: the log and the rejected rows of the batch."""
    result = applied(spark, folder)
    logged = result.log.select("o_orderkey", F.col("action").alias("outcome"), F.lit(None).cast("string").alias("reason"))
    return logged.unionByName(result.rejected.select("o_orderkey", F.lit("rejected").alias("outcome"), "reason"))


@query("fk_cascade", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def fk_cascade(spark, folder):
    """Lines go with their orders."""
    gone = table(spark, folder, "orders").filter("o_orderstatus = 'P'")
    return changes.cascade(table(spark, folder, "lineitem"), "l_orderkey", gone, "o_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey")


@query("fk_restrict", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')""")
def fk_restrict(spark, folder):
    """Lines that forbid a delete."""
    gone = table(spark, folder, "orders").filter("o_orderpriority = '5-LOW'")
    return changes.restricted(table(spark, folder, "lineitem"), "l_orderkey", gone, "o_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey")


@query("fk_set_null", """
SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN o_custkey END AS o_custkey FROM orders JOIN customer ON o_custkey = c_custkey""")
def fk_set_null(spark, folder):
    """Orders of deleted customers keep no owner."""
    gone = table(spark, folder, "customer").filter("c_acctbal <= 0")
    return changes.set_null(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_custkey", gone, "c_custkey")


@query("fk_update_key", """
SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN -o_custkey - 1 ELSE o_custkey END AS o_custkey
FROM orders JOIN customer ON o_custkey = c_custkey""")
def fk_update_key(spark, folder):
    """A changed key is carried to the children."""
    renamed = table(spark, folder, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("old_key"), (-F.col("c_custkey") - 1).alias("new_key"))
    return changes.update_key(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_custkey", renamed)


# --- warehouse -----------------------------------------------------------------------------------

def warehouse_sides(spark, folder):
    """Production without pending urgent orders; staging without finished ones and with gaps."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    production = orders.filter("NOT (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')").drop("o_orderstatus")
    staging = orders.filter("o_orderstatus <> 'F'").select(
        "o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).alias("o_totalprice"),
        F.lower("o_orderpriority").alias("o_orderpriority"))
    return production, staging


WAREHOUSE_SQL = """
WITH production AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
  WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')),
staging AS (SELECT o_orderkey, o_custkey + 1 AS o_custkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS o_totalprice,
  lower(o_orderpriority) AS o_orderpriority FROM orders WHERE o_orderstatus <> 'F')"""


@query("warehouse_current", WAREHOUSE_SQL + " SELECT * FROM staging")
def warehouse_current(spark, folder):
    """M19."""
    return warehouse.merge(*warehouse_sides(spark, folder), ["o_orderkey"], "Current").production


@query("warehouse_archive", WAREHOUSE_SQL + """
SELECT 'production' AS side, * FROM staging
UNION ALL SELECT 'archive', * FROM production WHERE o_orderkey NOT IN (SELECT o_orderkey FROM staging)""")
def warehouse_archive(spark, folder):
    """M19."""
    merged = warehouse.merge(*warehouse_sides(spark, folder), ["o_orderkey"], "Archive")
    mark = lambda side, rows: rows.select(F.lit(side).alias("side"), "*")
    return mark("production", merged.production).unionByName(mark("archive", merged.archive))


@query("warehouse_historical", WAREHOUSE_SQL + """
SELECT * FROM staging UNION ALL SELECT * FROM production WHERE o_orderkey NOT IN (SELECT o_orderkey FROM staging)""")
def warehouse_historical(spark, folder):
    """M19."""
    return warehouse.merge(*warehouse_sides(spark, folder), ["o_orderkey"], "Historical").production


@query("warehouse_full", WAREHOUSE_SQL + """
SELECT coalesce(s.o_orderkey, p.o_orderkey) AS o_orderkey, coalesce(s.o_custkey, p.o_custkey) AS o_custkey,
  coalesce(s.o_totalprice, p.o_totalprice) AS o_totalprice, coalesce(s.o_orderpriority, p.o_orderpriority) AS o_orderpriority
FROM staging s FULL JOIN production p ON s.o_orderkey = p.o_orderkey""")
def warehouse_full(spark, folder):
    """M19."""
    return warehouse.merge(*warehouse_sides(spark, folder), ["o_orderkey"], "Full Historical").production


@query("warehouse_counters", WAREHOUSE_SQL + """
SELECT (SELECT count(*) FROM production) AS production_count, (SELECT count(*) FROM staging) AS staging_count,
  (SELECT count(*) FROM staging WHERE o_orderkey IN (SELECT o_orderkey FROM production)) AS match_count,
  (SELECT count(*) FROM staging WHERE o_orderkey NOT IN (SELECT o_orderkey FROM production)) AS new_count""")
def warehouse_counters(spark, folder):
    """The counters of a load instance."""
    return warehouse.counters(*warehouse_sides(spark, folder), ["o_orderkey"])


# --- rules, seeds and views over whole tables ----------------------------------------------------

REGION_RULES = {
    "country_name_not_null": "country_name IS NOT NULL", "country_code_not_blank": "trim(country_code) <> ''",
    "regions_prov_check": "(prov_code IS NULL) = (prov_name IS NULL)",
    "regions_county_prov_check": "county IS NULL OR prov_code IS NOT NULL",
}


@query("region_rules", """
WITH r AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_mktsegment END AS country_code,
  CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS country_name, CASE WHEN c_custkey % 2 = 0 THEN 'p' || c_nationkey END AS prov_code,
  CASE WHEN c_custkey % 3 = 0 THEN 'n' END AS prov_name, CASE WHEN c_custkey % 5 = 0 THEN 'c' END AS county FROM customer)
""" + " UNION ALL ".join(
    f"SELECT 'regions' AS table_name, CAST(key AS VARCHAR) AS key, '{rule}' AS rule FROM r WHERE NOT ({test})"
    for rule, test in REGION_RULES.items()))
def region_rules(spark, folder):
    """P10 with the declared rules of the regions, P1 and P5."""
    c = F.col
    rows = table(spark, folder, "customer").select(
        c("c_custkey").alias("region_id"), F.when(c("c_custkey") % 7 == 0, " ").otherwise(c("c_mktsegment")).alias("country_code"),
        F.when(c("c_custkey") % 11 != 0, c("c_name")).alias("country_name"),
        F.when(c("c_custkey") % 2 == 0, F.concat(F.lit("p"), c("c_nationkey"))).alias("prov_code"),
        F.when(c("c_custkey") % 3 == 0, "n").alias("prov_name"), F.when(c("c_custkey") % 5 == 0, "c").alias("county"))
    return checks.violations(rows, "regions", F.col("region_id"), checks.catalogue_rules()["regions"])


@query("plotting_rules", """
WITH r AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS key, CASE WHEN l_linestatus = 'O' THEN l_orderkey END AS sd_id,
  l_linenumber - 2 AS plotting_order, CASE WHEN l_returnflag <> 'R' THEN l_suppkey END AS method_type FROM lineitem)
SELECT 'plotting_methods' AS table_name, key, 'sd_id_not_null' AS rule FROM r WHERE sd_id IS NULL
UNION ALL SELECT 'plotting_methods', key, 'method_type_not_null' FROM r WHERE method_type IS NULL
UNION ALL SELECT 'plotting_methods', key, 'plotting_order_positive' FROM r WHERE plotting_order <= 0""")
def plotting_rules(spark, folder):
    """P10 with the declared rules of the plotting methods, P6."""
    rows = table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("key"),
        F.when(F.col("l_linestatus") == "O", F.col("l_orderkey")).alias("sd_id"),
        (F.col("l_linenumber") - 2).alias("plotting_order"), F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")).alias("method_type"))
    return checks.violations(rows, "plotting_methods", F.col("key"), checks.catalogue_rules()["plotting_methods"])


@query("seeded_grants", """
SELECT r.name, count(*) AS grants FROM orders JOIN (VALUES (1, 'admin'), (2, 'collection'), (3, 'load'), (4, 'check'), (5, 'create_ls'), (6, 'create_ds')) r(role_id, name)
ON CAST(substring(o_orderpriority, 1, 1) AS INTEGER) = r.role_id GROUP BY r.name""")
def seeded_grants(spark, folder):
    """Grants under the seeded roles."""
    _, grants, _ = people(spark, folder)
    return grants.join(catalog.seed(spark, "roles"), "role_id").groupBy("name").agg(F.count("*").alias("grants"))


def _region_values() -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'"
    return ", ".join(f"({k}, {text(country)}, {text(province)})" for k, (_, country, _, province) in enumerate(catalog.REGIONS))


@query("seeded_regions", f"""
SELECT c_custkey, country_name, prov_name FROM customer JOIN (VALUES {_region_values()}) r(place, country_name, prov_name) ON c_custkey % 72 = place""")
def seeded_regions(spark, folder):
    """Every customer placed in one of the seeded regions by number."""
    regions = catalog.seed(spark, "regions").select((F.col("region_id") - 1).alias("place"), "prov_name", "country_name")
    customer = table(spark, folder, "customer").select("c_custkey", (F.col("c_custkey") % 72).alias("place"))
    return customer.join(regions, "place").select("c_custkey", "country_name", "prov_name")


@query("catalog_views", f"""
WITH v AS ({SOURCES_SQL})
SELECT country_name, warehouse_name, count(DISTINCT ds_id) AS sources, count(contact_id) AS contacts, count(DISTINCT assigned_user) AS assigned, min(contact_id) AS first_contact,
  max(contact_by) AS last_by, (SELECT count(*) FROM part JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = p_partkey) AS users_with_roles,
  (SELECT count(*) FROM (SELECT DISTINCT o_custkey, substring(o_orderpriority, 1, 1) FROM orders JOIN part ON o_custkey = p_partkey)) AS grants
FROM v GROUP BY country_name, warehouse_name""")
def catalog_views(spark, folder):
    """The catalogue tables as views, asked in SQL: both views with rows of the given tables."""
    _, grants, roles = people(spark, folder)
    tables = {name: spark.createDataFrame([], catalog.TABLES[name]) for name in catalog.TABLES} | source_tables(spark, folder) | {"user_roles": grants, "roles": roles}
    catalog.register_views(tables | {"users": tables["users"].withColumn("username", F.lower("name"))})
    return spark.sql("""
        select country_name, warehouse_name, count(distinct ds_id) as sources, count(contact.contact_id) as contacts, count(distinct assigned_user) as assigned,
          min(contact.contact_id) as first_contact, max(contact.created_by) as last_by, (select count(*) from v_users) as users_with_roles,
          (select sum(size(roles)) from v_users) as grants
        from v_data_sources group by country_name, warehouse_name""")


# --- source entries ------------------------------------------------------------------------------

def entry_batch(spark, folder):
    """Customers as load instances, orders as their entries; open orders ask for a new entry, finished ones for a
    new name, pending ones for their deletion."""
    c = F.col
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    columns = F.array(F.struct(F.lit("id").alias("name"), F.lit("Text").alias("column_type")))
    existing = orders.select(
        c("o_orderkey").alias("sd_id"), c("o_custkey").alias("li_id"), (c("o_orderkey") % 50 + 1).cast("smallint").alias("load_source_id"),
        F.lit(False).alias("user_generated"), F.lit("{}").alias("options"), F.concat(F.lit("T_"), c("o_orderkey")).alias("table_name"), columns.alias("columns"),
        F.lit(True).alias("to_load"), F.lit(None).cast("timestamp").alias("loaded_timestamp"), F.lit(None).cast("string").alias("error_message"))
    instances = customer.select(c("c_custkey").alias("li_id"), c("c_custkey").alias("collect_user_id"), (c("c_custkey") + 1).alias("load_user_id"), F.lit(None).cast("bigint").alias("check_user_id"))
    admins = table(spark, folder, "supplier").where("s_acctbal > 5000").select(c("s_suppkey").alias("uid"))
    priority = c("o_orderpriority")
    actor = F.when(priority == "1-URGENT", c("o_custkey") + 1).when(priority == "2-HIGH", c("o_custkey") + 2).when(priority == "3-MEDIUM", c("o_custkey")).otherwise(c("o_orderkey") % 10)
    action = F.when(c("o_orderstatus") == "O", "I").when(c("o_orderstatus") == "F", "U").otherwise("D")
    name = F.when(c("o_orderkey") % 11 == 0, F.lit("no-name")).when(action == "I", F.concat(F.lit("NEW_"), c("o_orderkey") % 2)).otherwise(F.concat(F.lit("U_"), c("o_orderkey") % 3))
    batch = orders.select(
        c("o_orderkey").alias("position"), action.alias("action"), actor.alias("actor"), F.when(action != "I", c("o_orderkey")).alias("sd_id"),
        F.when(action == "I", c("o_custkey")).alias("li_id"), F.lit(True).alias("user_generated"),
        F.when((action != "U") | (c("o_orderkey") % 13 > 0), "{}").alias("options"), name.alias("table_name"), columns.alias("columns"))
    return entries.apply_entries(spark, existing, batch, instances, admins)


ENTRIES_SQL = """
WITH asked AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'O' THEN 'I' WHEN 'F' THEN 'U' ELSE 'D' END AS action,
  CASE o_orderpriority WHEN '1-URGENT' THEN o_custkey + 1 WHEN '2-HIGH' THEN o_custkey + 2 WHEN '3-MEDIUM' THEN o_custkey ELSE o_orderkey % 10 END AS actor,
  CASE WHEN o_orderkey % 11 = 0 THEN 'no-name' WHEN o_orderstatus = 'O' THEN 'NEW_' || o_orderkey % 2 ELSE 'U_' || o_orderkey % 3 END AS name
  FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 13 > 0),
gated AS (SELECT *, actor IN (o_custkey, o_custkey + 1) OR actor IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) AS may FROM asked),
checked AS (SELECT *, CASE WHEN NOT may THEN 'uid ' || actor || ' is neither part of load instance ' || o_custkey || ' nor an admin'
  WHEN action <> 'D' AND name = 'no-name' THEN 'table name "no-name" has the wrong form' END AS early FROM gated),
judged AS (SELECT *, coalesce(early, CASE WHEN action <> 'D' AND row_number() OVER (PARTITION BY o_custkey, name, early IS NULL AND action <> 'D' ORDER BY o_orderkey) > 1
  THEN 'load instance ' || o_custkey || ' has a table "' || name || '"' END) AS reason FROM checked),
tops AS (SELECT o_custkey, max(o_orderkey % 50 + 1) AS top FROM orders GROUP BY o_custkey),
created AS (SELECT o_orderkey AS position, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY o_orderkey) AS sd_id, o_custkey AS li_id,
  top + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS load_source_id, name FROM judged JOIN tops USING (o_custkey) WHERE action = 'I' AND reason IS NULL)"""


@query("source_entry_batch", ENTRIES_SQL + """
SELECT sd_id, li_id, load_source_id, name AS table_name, true AS user_generated FROM created
UNION ALL SELECT o.o_orderkey, o.o_custkey, o.o_orderkey % 50 + 1, coalesce(CASE j.action WHEN 'U' THEN name END, 'T_' || o.o_orderkey), j.action IS NOT NULL
FROM orders o LEFT JOIN (SELECT * FROM judged WHERE reason IS NULL AND action <> 'I') j USING (o_orderkey) WHERE j.action IS DISTINCT FROM 'D'""")
def source_entry_batch(spark, folder):
    """All entries after the batch; new ones continue their instance's numbers."""
    return entry_batch(spark, folder).table.select("sd_id", "li_id", F.col("load_source_id").cast("bigint").alias("load_source_id"), "table_name", "user_generated")


@query("source_entry_outcome", ENTRIES_SQL + """
SELECT o_orderkey AS id, 'rejected' AS outcome, reason AS detail FROM judged WHERE reason IS NOT NULL
UNION ALL SELECT CASE action WHEN 'I' THEN c.sd_id ELSE o_orderkey END, action,
  CASE action WHEN 'U' THEN '{"user_generated":"true","table_name":"' || j.name || '"}' END FROM judged j LEFT JOIN created c ON c.position = o_orderkey WHERE reason IS NULL""")
def source_entry_outcome(spark, folder):
    """M5, M6: what was rejected and why, and the log of the rest."""
    result = entry_batch(spark, folder)
    return result.rejected.select(F.col("position").alias("id"), F.lit("rejected").alias("outcome"), F.col("reason").alias("detail")).unionByName(
        result.log.select(F.col("sd_id").alias("id"), F.col("action").alias("outcome"), F.col("changed_fields").alias("detail")))


# --- changes of files ----------------------------------------------------------------------------

@query("file_changes", """
WITH a AS (SELECT orders.*, c_acctbal > 0 AS ok FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'row' AS kind, o_orderkey, CAST(o_totalprice AS DECIMAL(15, 2))::VARCHAR AS detail FROM a WHERE NOT ok OR o_orderstatus = 'P'
UNION ALL SELECT 'row', o_orderkey, (CAST(o_totalprice AS DECIMAL(15, 2)) + 1)::VARCHAR FROM a WHERE ok AND o_orderstatus = 'O'
UNION ALL SELECT 'row', -o_orderkey - 1, CAST(o_totalprice AS DECIMAL(15, 2))::VARCHAR FROM a WHERE ok AND o_orderstatus = 'P'
UNION ALL SELECT 'log', CASE WHEN o_orderstatus = 'P' THEN -o_orderkey - 1 ELSE o_orderkey END, CASE o_orderstatus WHEN 'O' THEN 'U' WHEN 'F' THEN 'D' ELSE 'I' END FROM a WHERE ok
UNION ALL SELECT 'rejected', CASE WHEN o_orderstatus = 'P' THEN -o_orderkey - 1 ELSE o_orderkey END, 'uid ' || o_custkey || ' cannot change orders' FROM a WHERE NOT ok""")
def file_changes(spark, folder):
    """M1 to M6 on a folder of files: its rows afterwards, the log and the rejected rows."""
    orders, batch = order_batch(spark, folder)
    path = scratch(spark, "orders") + "/table"
    orders.repartition(8, "o_orderstatus").write.parquet(path)
    allowed = table(spark, folder, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("uid"))
    _, rejected, log = filechanges.apply_to_files(spark, path, batch, "o_orderkey", "actor", allowed, "uid %s cannot change orders")
    return spark.read.parquet(path).select(F.lit("row").alias("kind"), "o_orderkey", F.col("o_totalprice").cast("string").alias("detail")).unionByName(
        log.select(F.lit("log").alias("kind"), "o_orderkey", F.col("action").alias("detail"))).unionByName(
        rejected.select(F.lit("rejected").alias("kind"), "o_orderkey", F.col("reason").alias("detail")))


@query("file_merge", WAREHOUSE_SQL + """
SELECT coalesce(s.o_orderkey, p.o_orderkey) AS o_orderkey, coalesce(s.o_custkey, p.o_custkey) AS o_custkey,
  coalesce(s.o_totalprice, p.o_totalprice) AS o_totalprice, coalesce(s.o_orderpriority, p.o_orderpriority) AS o_orderpriority
FROM staging s FULL JOIN production p ON s.o_orderkey = p.o_orderkey""")
def file_merge(spark, folder):
    """A full historical merge into a folder of files; files without a staged record stay."""
    production, staging = warehouse_sides(spark, folder)
    path = scratch(spark, "production") + "/table"
    production.repartitionByRange(8, "o_orderkey").write.parquet(path)
    filechanges.merge_into_files(spark, path, staging, ["o_orderkey"], "Full Historical")
    return spark.read.parquet(path)


# --- references over all tables ------------------------------------------------------------------

#: Child, column, parent, its column, action on delete.
SALES_EDGES = [
    ("nation", "n_regionkey", "region", "r_regionkey", "cascade"), ("customer", "c_nationkey", "nation", "n_nationkey", "cascade"),
    ("supplier", "s_nationkey", "nation", "n_nationkey", "set null"), ("orders", "o_custkey", "customer", "c_custkey", "cascade"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey", "cascade"), ("lineitem", "l_suppkey", "supplier", "s_suppkey", "restrict")]
SALES_KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "orders": ["o_orderkey"]}


def sales(spark, folder):
    found = {name: table(spark, folder, name) for name in ("region", "nation", "customer", "supplier", "orders")}
    return found | {"lineitem": table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")}


KEPT_SQL = """
WITH n AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'), c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)),
o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))"""


@query("fk_graph_delete", KEPT_SQL + """
SELECT 'nation' AS kept, n_nationkey AS key, n_regionkey AS refers_to FROM n UNION ALL SELECT 'customer', c_custkey, c_nationkey FROM c UNION ALL SELECT 'orders', o_orderkey, o_custkey FROM o
UNION ALL SELECT 'lineitem', l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)
UNION ALL SELECT 'supplier', s_suppkey, CASE WHEN s_nationkey IN (SELECT n_nationkey FROM n) THEN s_nationkey END FROM supplier""")
def fk_graph_delete(spark, folder):
    """A region goes, with all that hangs on it over four levels; suppliers stay without a nation."""
    tables = sales(spark, folder)
    found = references.delete(spark, tables, SALES_KEYS, SALES_EDGES, {"region": tables["region"].where("r_name = 'ASIA'")})
    shown = {"nation": ("n_nationkey", "n_regionkey"), "customer": ("c_custkey", "c_nationkey"), "orders": ("o_orderkey", "o_custkey"), "lineitem": ("l_orderkey", "l_suppkey"), "supplier": ("s_suppkey", "s_nationkey")}
    out = None
    for name, (key, other) in shown.items():
        rows = found.tables[name].select(F.lit(name).alias("kept"), F.col(key).cast("bigint").alias("key"), F.col(other).cast("bigint").alias("refers_to"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("fk_graph_blocked", """
WITH gone AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')),
c AS (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'),
o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
SELECT 'lineitem' AS child, CAST(l_suppkey AS VARCHAR) AS value, 'restrict' AS rule, count(*) AS n, (SELECT count(*) FROM orders) AS orders_left
FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM gone) AND l_orderkey NOT IN (SELECT o_orderkey FROM o) GROUP BY l_suppkey""")
def fk_graph_blocked(spark, folder):
    """Lines of orders that stay hold suppliers that the cascade reaches, so nothing goes."""
    tables = sales(spark, folder)
    edges = [(*edge[:4], "cascade") if edge[0] == "supplier" else edge for edge in SALES_EDGES]
    found = references.delete(spark, tables, SALES_KEYS, edges, {"region": tables["region"].where("r_name = 'ASIA'")})
    left = found.tables["orders"].agg(F.count("*").alias("orders_left"))
    return found.blocked.select("child", "value", "rule", "n", left.scalar().alias("orders_left"))


# --- checks of what a batch touched --------------------------------------------------------------

def region_batch(spark, folder):
    """Customers as regions without conflicts, and a batch that renames some and adds copies of others."""
    c = F.col
    before = table(spark, folder, "customer").select(
        F.concat(F.lit("N"), c("c_nationkey")).alias("country_code"), F.concat(F.lit("nation "), c("c_nationkey")).alias("country_name"),
        F.concat(F.lit("P"), c("c_custkey") % 100).alias("prov_code"), F.concat(F.lit("prov "), c("c_custkey") % 100).alias("prov_name"), c("c_name").alias("county"))
    chosen = before.where("country_code in ('N3', 'N5', 'N11')")
    renamed = chosen.where("prov_code = 'P7'").withColumn("prov_name", F.lit("renamed"))
    other = chosen.where("country_code = 'N5' and prov_code = 'P9'").withColumn("country_name", F.lit("other")).withColumn("prov_code", F.lit("PX"))
    again = chosen.where("prov_code = 'P12'")
    return before, renamed.unionByName(other).unionByName(again)


@query("delta_regions", """
WITH b AS (SELECT 'N' || c_nationkey AS country_code, 'nation ' || c_nationkey AS country_name, 'P' || c_custkey % 100 AS prov_code, 'prov ' || c_custkey % 100 AS prov_name, c_name AS county FROM customer),
g AS (SELECT * FROM b WHERE country_code IN ('N3', 'N5', 'N11')),
a AS (SELECT * FROM b UNION ALL SELECT country_code, country_name, prov_code, 'renamed', county FROM g WHERE prov_code = 'P7'
  UNION ALL SELECT country_code, 'other', 'PX', prov_name, county FROM g WHERE country_code = 'N5' AND prov_code = 'P9' UNION ALL SELECT * FROM g WHERE prov_code = 'P12')
SELECT 'country_name' AS rule, country_code, NULL AS prov_code, NULL AS county, count(DISTINCT country_name) AS n FROM a GROUP BY country_code HAVING count(DISTINCT country_name) > 1
UNION ALL SELECT 'prov_name', country_code, prov_code, NULL, count(DISTINCT prov_name) FROM a GROUP BY country_code, prov_code HAVING count(DISTINCT prov_name) > 1
UNION ALL SELECT 'repeated', country_code, prov_code, county, count(*) FROM a GROUP BY country_code, prov_code, county HAVING count(*) > 1""")
def delta_regions(spark, folder):
    """The conflicts of the whole table, found in the countries of the batch."""
    before, batch = region_batch(spark, folder)
    return deltachecks.region_conflicts(before.unionByName(batch), batch)


@query("delta_references", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT -o_orderkey - 1, 1, 1, 1 FROM orders WHERE o_orderpriority = '5-LOW'""")
def delta_references(spark, folder):
    """Lines without an order, after orders went and lines came; only those keys are looked at."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    lines = table(spark, folder, "lineitem").select(*[F.col(c).cast("bigint").alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    one = F.lit(1).cast("bigint")
    batch = orders.where("o_orderpriority = '5-LOW'").select((-F.col("o_orderkey") - 1).alias("l_orderkey"), one.alias("l_linenumber"), one.alias("l_partkey"), one.alias("l_suppkey"))
    gone, kept = orders.where("o_orderstatus = 'P'"), orders.where("o_orderstatus <> 'P'")
    return deltachecks.orphans(lines.unionByName(batch), batch, "l_orderkey", kept, "o_orderkey", gone)
