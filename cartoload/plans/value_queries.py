"""Queries over names, schemas, value mapping and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartoload.functions import names, types, values
from cartoload.operators import checks, schema
from cartoload.operators.changelog import changed_entries, to_json
from cartoload.operators.ordinal import row_numbers
from cartoload.plans.registry import query, table


@query("clean_names", """
WITH n AS (SELECT url AS name FROM pages UNION ALL SELECT p_name FROM part UNION ALL SELECT upper(p_brand) FROM part
  UNION ALL SELECT p_size || p_type || '.' || p_name FROM part UNION ALL SELECT upper(replace(p_name, ' ', '__')) FROM part
  UNION ALL SELECT c_name FROM customer),
d AS (SELECT DISTINCT name FROM n)
SELECT name, CASE WHEN regexp_full_match(name, '[A-Z_][A-Z_0-9]{1,64}') THEN lower(name)
  ELSE lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '\\.[^\\n]+$', ''),
    '[^A-Za-z_0-9]', '_', 'g'), '^([0-9])', '_\\1'), '_{2,}', '_', 'g')) END AS cleaned
FROM d""")
def clean_names(spark, folder):
    """C1."""
    part = table(spark, folder, "part")
    found = table(spark, folder, "pages").select(F.col("url").alias("name"))
    for name in (F.col("p_name"), F.upper("p_brand"),
                 F.concat(F.col("p_size").cast("string"), F.col("p_type"), F.lit("."), F.col("p_name")),
                 F.upper(F.replace("p_name", F.lit(" "), F.lit("__")))):
        found = found.unionByName(part.select(name.alias("name")))
    found = found.unionByName(table(spark, folder, "customer").select(F.col("c_name").alias("name"))).distinct()
    return found.select("name", names.clean_identifier(F.col("name")).alias("cleaned"))


# A logical type per part type, to give the columns below different types.
PART_TYPES = {"ECONOMY": "Number", "LARGE": "BigInt", "MEDIUM": "Timestamp", "PROMO": "Json", "SMALL": "SmallInt"}


def brand_columns(spark, folder):
    """Part brands as tables and their part names as columns; standard parts leave the type open."""
    part = table(spark, folder, "part").groupBy("p_brand", "p_name").agg(F.min("p_type").alias("p_type"))
    kind = F.lit(None).cast("string")
    for name, column_type in PART_TYPES.items():
        kind = F.when(F.col("p_type") == name, column_type).otherwise(kind)
    numbered = part.select(
        F.concat(F.lit("PART_"), F.regexp_replace("p_brand", "#", "_")).alias("table_name"),
        F.col("p_name").alias("name"), kind.alias("column_type"))
    ranked = row_numbers(spark, numbered, ["table_name"], ["name"])
    return ranked.select("table_name", (F.col("rn") - 1).cast("int").alias("position"), "name", "column_type")


BRANDS_SQL = """
WITH p AS (SELECT p_brand, p_name, min(p_type) AS p_type FROM part GROUP BY p_brand, p_name),
c AS (SELECT lower('PART_' || replace(p_brand, '#', '_')) AS table_name, p_name, replace(p_name, ' ', '_') AS name,
  CASE p_type WHEN 'ECONOMY' THEN 'Number' WHEN 'LARGE' THEN 'BigInt' WHEN 'MEDIUM' THEN 'Timestamp'
    WHEN 'PROMO' THEN 'Json' WHEN 'SMALL' THEN 'SmallInt' ELSE 'Text' END AS column_type FROM p)"""


@query("ddl_text", BRANDS_SQL + """
SELECT table_name, 'create table bulk_loading."' || table_name || '"(' || string_agg('"' || name || '" ' ||
  CASE column_type WHEN 'Number' THEN 'numeric' WHEN 'BigInt' THEN 'bigint' WHEN 'Json' THEN 'jsonb'
    WHEN 'Timestamp' THEN 'timestamp without time zone' WHEN 'SmallInt' THEN 'smallint' ELSE 'text' END,
  ',' ORDER BY p_name) || ')' AS statement
FROM c GROUP BY table_name""")
def ddl_text(spark, folder):
    """C2, C11, C12, C14."""
    return schema.create_statements(schema.build_schemas(brand_columns(spark, folder)), "bulk_loading")


@query("column_list_check", """
SELECT conv_id, bool_and(NOT regexp_full_match(text, '\\s*') AND role <> 'system') AS ok
FROM conversations GROUP BY conv_id""")
def column_list_check(spark, folder):
    """Every turn a column of its conversation; a system turn has no type."""
    turns = table(spark, folder, "conversations").select("conv_id", F.struct(
        F.col("text").alias("name"), F.when(F.col("role") != "system", "Text").alias("column_type")).alias("c"))
    # The check is an "every": per-turn lists are combined by partial aggregation, not collected.
    return turns.groupBy("conv_id").agg(F.bool_and(checks.valid_columns(F.array("c"))).alias("ok"))


@query("json_values", """
SELECT event_id, json_extract_string(props, '$.k') AS k, 'Number' AS kind FROM events""")
def json_values(spark, folder):
    """V4, C7."""
    shown = table(spark, folder, "events").select(
        "event_id", values.json_values(F.col("props"))[0].alias("k"),
        types.from_json_text(F.get_json_object("props", "$.k")).alias("kind"))
    return shown


@query("bytes_array", """
SELECT page_id, '{' || array_to_string(list_transform(range(1, len(hex(encode(url))) + 1, 2),
  lambda i: CAST(('0x' || substring(hex(encode(url)), i, 2))::INTEGER AS VARCHAR)), ',') || '}' AS bytes
FROM pages""")
def bytes_array(spark, folder):
    """V11."""
    return table(spark, folder, "pages").select(
        "page_id", values.array_literal(values.byte_array(F.encode("url", "UTF-8"))).alias("bytes"))


@query("nested_json", """
SELECT o_orderkey, '{"key":' || o_custkey || ',"status":' ||
  CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}' AS record,
  '["' || o_orderpriority || '",null]' AS list, '{"' || o_orderstatus || '":' || o_custkey || '}' AS map,
  '{"type":"' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE 'string' END || '","value":"' ||
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END || '"}' AS tagged
FROM orders""")
def nested_json(spark, folder):
    """V12, V13."""
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    record = F.struct(F.col("o_custkey").alias("key"), status.alias("status"))
    return table(spark, folder, "orders").select(
        "o_orderkey", values.nested_json(record).alias("record"),
        values.nested_json(F.array("o_orderpriority", F.lit(None).cast("string"))).alias("list"),
        values.nested_json(F.create_map("o_orderstatus", "o_custkey")).alias("map"),
        values.tagged_json(F.when(status.isNull(), "null").otherwise("string"), status).alias("tagged"))


@query("duration_json", """
SELECT l_orderkey, l_linenumber, l_partkey,
       '{"months":' || l_linenumber || ',"days":' || l_suppkey || ',"millis":' || l_partkey || '}' AS duration
FROM lineitem""")
def duration_json(spark, folder):
    """Twelve bytes put together from three numbers."""
    def word(column):
        digits = F.lpad(F.hex(column), 8, "0")
        return F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)])

    packed = F.unhex(F.concat(word("l_linenumber"), word("l_suppkey"), word("l_partkey")))
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", packed.alias("packed"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", values.duration_json(F.col("packed")).alias("duration"))


@query("epoch_render", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, strftime(ts, '%H:%M:%S') AS clock,
       strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS service
FROM events""")
def epoch_render(spark, folder):
    """V14, V19."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    of_day = micros % F.lit(86_400_000_000)
    return table(spark, folder, "events").select(
        "event_id", values.timestamp_text(values.epoch_timestamp(micros, 1_000_000)).alias("stamp"),
        values.time_text(of_day, 1_000_000).alias("clock"),
        values.epoch_date(F.call_function("div", micros, F.lit(86_400_000_000))).cast("string").alias("day"),
        values.service_value(F.unix_millis(F.col("ts").cast("timestamp")).cast("string"),
                             F.lit("esriFieldTypeDate")).alias("service"))


@query("number_text", """
SELECT l_orderkey, l_linenumber, l_partkey, regexp_replace(CAST(l_quantity AS VARCHAR), '\\.0$', '') AS quantity,
       regexp_replace(CAST(l_extendedprice AS VARCHAR), '\\.0$', '') AS price,
       CASE l_linenumber WHEN 1 THEN '0.00001' WHEN 2 THEN '0.00002' WHEN 3 THEN '0.00003' WHEN 4 THEN '0.00004'
         WHEN 5 THEN '0.00005' WHEN 6 THEN '0.00006' ELSE '0.00007' END AS small,
       l_linenumber || '0000000000' AS large
FROM lineitem""")
def number_text(spark, folder):
    """Plain, small and large numbers."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", values.number_text(F.col("l_quantity")).alias("quantity"),
        values.number_text(F.col("l_extendedprice")).alias("price"),
        values.number_text(F.col("l_linenumber") / F.lit(1e5)).alias("small"),
        values.number_text(F.col("l_linenumber") * F.lit(1e10)).alias("large"))


@query("workbook_text", """
SELECT o_orderkey, strftime(o_orderdate + to_seconds(o_custkey), '%Y-%m-%d %H:%M:%S') AS placed,
       o_orderpriority || chr(10) || o_orderstatus || chr(13) AS note,
       CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS done
FROM orders""")
def workbook_text(spark, folder):
    """V8: date serials, escapes and booleans."""
    moment = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_custkey")
    serial = (moment / F.lit(86400.0) + 25569).cast("string")
    note = F.concat("o_orderpriority", F.lit("_x000d_"), "o_orderstatus", F.lit("_x000a_"))
    flag = F.when(F.col("o_orderstatus") == "F", "1").otherwise("0")
    return table(spark, folder, "orders").select(
        "o_orderkey", values.workbook_text(F.lit("d"), serial).alias("placed"),
        values.workbook_text(F.lit("s"), note).alias("note"), values.workbook_text(F.lit("b"), flag).alias("done"))


@query("arrow_text", """
SELECT event_id, epoch_us(ts) % 1000000 || ' microsecond' AS us, user_id || ' milisecond' AS ms,
       printf('%.2f', user_id / 1000.0) || ' microsecond' AS ns,
       strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN event_type = 'click' THEN ' EST' ELSE ' CET' END AS zoned
FROM events""")
def arrow_text(spark, folder):
    """V17."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    zone = F.when(F.col("event_type") == "click", "America/New_York").otherwise("Europe/Berlin")
    return table(spark, folder, "events").select(
        "event_id", values.duration_text(micros % 1_000_000, "us").alias("us"),
        values.duration_text(F.col("user_id"), "ms").alias("ms"),
        values.duration_text(F.col("user_id"), "ns").alias("ns"),
        values.zoned_text(F.col("ts"), zone).alias("zoned"))


@query("typed_columns", """
SELECT o_orderkey, o_totalprice AS number, CAST(o_totalprice AS DOUBLE) AS money, o_orderdate AS stamp,
       CAST(o_orderdate AS DATE) AS day, o_orderstatus = 'F' AS flag, '{"a":' || o_custkey || '}' AS doc,
       CAST(o_custkey AS INTEGER) AS small, NULL::INTEGER AS nothing
FROM orders""")
def typed_columns(spark, folder):
    """Text into every kind of column."""
    price = values.number_text(F.col("o_totalprice"))
    shown = table(spark, folder, "orders").select(
        "o_orderkey", price.alias("price"), F.concat(F.lit("$"), price).alias("money"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("stamp"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        (F.col("o_orderstatus") == "F").cast("string").alias("flag"),
        F.concat(F.lit('{"a":'), F.col("o_custkey").cast("string"), F.lit("}")).alias("doc"),
        F.col("o_custkey").cast("string").alias("key"), F.lit("").alias("nothing"))
    t = lambda name, kind: values.typed(F.col(name), kind)
    return shown.select(
        "o_orderkey", t("price", "Number").cast("double").alias("number"), t("money", "Money").cast("double").alias("money"),
        t("stamp", "Timestamp").alias("stamp"), t("day", "Date").alias("day"),
        t("flag", "Boolean").alias("flag"), t("doc", "Json").alias("doc"), t("key", "Integer").alias("small"),
        t("nothing", "Integer").alias("nothing"))


@query("coded_values", """
SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def coded_values(spark, folder):
    """Nation names through the coded values of a field domain."""
    nation = table(spark, folder, "nation")
    domain = nation.agg(F.to_json(F.struct(
        F.lit("codedValue").alias("type"),
        # A domain is part of one field's description; nations are a fixed dimension of 25 rows.
        F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("code"))).alias("codedValues"),
    )).alias("domain")).select(values.coded_names(F.col("domain")).alias("names"))
    return table(spark, folder, "customer").select(
        "c_custkey", F.try_element_at(domain.scalar(), F.col("c_nationkey").cast("string")).alias("nation"))


# --- predicates ----------------------------------------------------------------------------------

@query("not_blank", """
SELECT doc_id, CASE WHEN lang = 'de' THEN true ELSE NOT regexp_full_match(text, '\\s*') END AS text_ok,
       lang = 'de' OR lang <> 'fr' AS lang_ok
FROM documents""")
def not_blank(spark, folder):
    """NULL passes, blanks do not."""
    text = F.when(F.col("lang") != "de", F.col("text"))
    lang = F.when(F.col("lang") == "fr", " \t\n").when(F.col("lang") != "de", F.col("lang"))
    return table(spark, folder, "documents").select(
        "doc_id", checks.not_blank(text).alias("text_ok"), checks.not_blank(lang).alias("lang_ok"))


@query("array_not_blank", """
SELECT p_partkey, p_type NOT IN ('SMALL', 'PROMO') AS ok FROM part""")
def array_not_blank(spark, folder):
    """NULL array and NULL element pass, an empty array and a blank element do not."""
    words = F.split("p_name", " ")
    none = F.array().cast("array<string>")
    case = (
        F.when(F.col("p_type") == "SMALL", none)
        .when(F.col("p_type") == "PROMO", F.array_append(words, F.lit(" ")))
        .when(F.col("p_type") == "LARGE", F.array_append(words, F.lit(None).cast("string")))
        .when(F.col("p_type") == "MEDIUM", F.lit(None).cast("array<string>"))
        .otherwise(words)
    )
    return table(spark, folder, "part").select("p_partkey", checks.array_not_blank(case).alias("ok"))


@query("later_timestamp", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_returnflag = 'N' THEN true
  WHEN o_orderstatus = 'P' THEN false ELSE l_shipdate > o_orderdate END AS ok
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def later_timestamp(spark, folder):
    """P3."""
    joined = table(spark, folder, "lineitem").join(
        table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    shipped = F.when(F.col("l_returnflag") != "N", F.col("l_shipdate"))
    placed = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", checks.later(shipped, placed).alias("ok"))


@query("row_predicates", """
SELECT c_custkey, regexp_full_match(upper(replace(c_name, '#', '_')), '[A-Z_][A-Z_0-9]{1,64}') AS name_ok,
       regexp_full_match(upper(c_name), '[A-Z_][A-Z_0-9]{1,64}') AS raw_name_ok,
       (c_mktsegment = 'BUILDING') = (c_nationkey = 3) AS province_ok,
       NOT (c_mktsegment = 'FURNITURE' AND c_nationkey = 3) AS county_ok,
       c_acctbal > 0 AS positive, c_nationkey >= 0 AS not_negative,
       c_mktsegment IN ('BUILDING', 'MACHINERY') AS known
FROM customer""")
def row_predicates(spark, folder):
    """P4, P5, P6, P7."""
    c = F.col
    code = F.when(c("c_mktsegment") != "BUILDING", c("c_mktsegment"))
    name = F.when(c("c_nationkey") != 3, c("c_name"))
    county = F.when(c("c_mktsegment") == "FURNITURE", c("c_name"))
    return table(spark, folder, "customer").select(
        "c_custkey", checks.table_name_ok(F.replace("c_name", F.lit("#"), F.lit("_"))).alias("name_ok"),
        checks.table_name_ok(c("c_name")).alias("raw_name_ok"),
        checks.province_ok(code, name).alias("province_ok"), checks.county_ok(county, name).alias("county_ok"),
        checks.positive(c("c_acctbal")).alias("positive"), checks.not_negative(c("c_nationkey")).alias("not_negative"),
        checks.member(c("c_mktsegment"), ["BUILDING", "MACHINERY"]).alias("known"))


@query("constraint_report", """
SELECT 'orders' AS table_name, CAST(o_orderkey AS VARCHAR) AS key, 'price_positive' AS rule FROM orders WHERE o_totalprice <= 100000
UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'status_known' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'priority_not_null' FROM orders WHERE o_orderpriority = '5-LOW'
UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), 'text_not_blank' FROM documents WHERE regexp_full_match(text, '\\s*')
UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), 'source_form' FROM documents
  WHERE NOT regexp_full_match(upper(source), '[A-Z_][A-Z_0-9]{1,64}') OR lang = 'en'""")
def constraint_report(spark, folder):
    """P1, P4, P6, P7, P8, P10 over whole tables."""
    c = F.col
    orders = table(spark, folder, "orders").withColumn(
        "o_orderpriority", F.when(c("o_orderpriority") != "5-LOW", c("o_orderpriority")))
    documents = table(spark, folder, "documents")
    first = checks.violations(orders, "orders", c("o_orderkey"), {
        "price_positive": checks.positive(c("o_totalprice") - 100000),
        "status_known": checks.member(c("o_orderstatus"), ["F", "O"]),
        "priority_not_null": c("o_orderpriority").isNotNull()})
    second = checks.violations(documents, "documents", c("doc_id"), {
        "text_not_blank": checks.not_blank(c("text")),
        "source_form": checks.table_name_ok(c("source")) & (c("lang") != "en")})
    return first.unionByName(second)


@query("map_difference", """
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_quantity,
  CASE WHEN a.l_returnflag = a.l_linestatus THEN NULL ELSE '{"flag":"' || a.l_linestatus || '"}' END AS changed
FROM lineitem a""")
def map_difference(spark, folder):
    """New values under keys of the old map; a key only in the new map does not count."""
    old = F.create_map(F.lit("flag"), "l_returnflag", F.lit("line"), F.col("l_linenumber").cast("string"))
    new = F.create_map(F.lit("flag"), "l_linestatus", F.lit("line"), F.col("l_linenumber").cast("string"),
                       F.lit("extra"), F.lit("x"))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        to_json(changed_entries(old, new)).alias("changed"))
