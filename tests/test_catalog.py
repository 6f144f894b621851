import datetime as dt
import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cartoload.operators import catalog, changelog, changes, checks, ordinal, schema, warehouse

STAMP = dt.datetime(2024, 1, 1)


def frame(spark, table, rows):
    names = [f.name for f in spark.createDataFrame([], catalog.TABLES[table]).schema]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], catalog.TABLES[table])


# --- checks --------------------------------------------------------------------------------------

@pytest.mark.parametrize("text,ok", [(None, True), ("x", True), ("", False), (" \t\n", False), ("\u000b", False), (" x", True)])
def test_not_blank(one, text, ok):
    assert one(checks.not_blank(F.lit(text).cast("string"))) is ok


@pytest.mark.parametrize("texts,ok", [(None, True), ([], False), (["a", " "], False), (["a", None], True), (["a"], True)])
def test_array_not_blank(one, texts, ok):
    assert one(checks.array_not_blank(F.col("a")), "a array<string>", (texts,)) is ok


def test_later(one):
    early, late, none = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-02").cast("timestamp"), F.lit(None).cast("timestamp")
    assert [one(checks.later(*pair)) for pair in [(none, none), (none, late), (late, none), (late, early), (early, early)]] == [
        True, True, False, True, False]


@pytest.mark.parametrize("name,ok", [("stage_1", True), ("A", False), ("1A", False), ("x" * 65, True), ("x" * 66, False), ("a-b", False)])
def test_table_name(one, name, ok):
    assert one(checks.table_name_ok(F.lit(name))) is ok


def test_seed_passes_its_own_rules(spark):
    rules = catalog_rules = checks.catalogue_rules()
    for table in ("roles", "regions", "warehouse_types"):
        rows = catalog.seed(spark, table)
        assert checks.violations(rows, table, F.lit(1), rules[table]).count() == 0
        for keys in checks.UNIQUE_KEYS[table]:
            assert checks.duplicates(rows, keys).count() == 0
    assert [catalog.seed(spark, t).count() for t in ("roles", "regions", "warehouse_types")] == [6, 72, 4]
    assert set(catalog_rules) | {"logged_actions"} == set(catalog.TABLES)
    assert checks.region_conflicts(catalog.seed(spark, "regions")).count() == 0


def test_every_rule_runs_and_fires(spark):
    good = {
        "li_id": 1, "sd_id": 1, "load_source_id": 1, "user_generated": False, "options": "{}", "table_name": "tab", "to_load": True,
        "columns": [("a", "Text")]}
    bad = {**good, "load_source_id": 0, "table_name": "1", "columns": [("", "Text")], "error_message": " ", "to_load": None}
    rows = frame(spark, "source_data", [good, bad])
    found = checks.violations(rows, "source_data", F.col("sd_id"), checks.catalogue_rules()["source_data"])
    assert sorted(r.rule for r in found.collect()) == [
        "columns_valid", "error_message_not_blank", "load_source_id_positive", "table_name_form", "to_load_not_null"]
    for table, rules in checks.catalogue_rules().items():
        checks.violations(frame(spark, table, [{}]), table, F.lit(1), rules).collect()


def test_duplicates_and_nulls(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), ("b", "x"), ("b", "x")], "k string, l string")
    assert [tuple(r) for r in checks.duplicates(rows, ["k", "l"]).collect()] == [("b", "x", 2)]
    assert checks.duplicates(rows, ["k", "l"], nulls_equal=True).count() == 2


def test_orphans(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,)], "p int")
    assert [r.k for r in checks.orphans(child, "k", parent, "p").collect()] == [2, 2]


def test_order_checks(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3), (3, 2), (4, 1), (4, 1), (4, 2)], "k int, o int")
    report = {r.k: r.contiguous for r in checks.order_report(rows, "k", "o").collect()}
    assert report == {1: True, 2: False, 3: False, 4: False}
    gaps = sorted(tuple(r) for r in checks.order_gaps(spark, rows, "k", "o").collect())
    assert gaps == [(2, 3, 2), (3, 2, 1), (4, 1, 2), (4, 2, 3)]
    assert checks.single_group(rows, "k").first() == (4, False)


# --- row numbers and collections -----------------------------------------------------------------

def test_numbering_with_hot_groups_matches_a_plain_count(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 1000, "hot").when(F.col("id") < 2000, None).otherwise((F.col("id") % 7).cast("string")).alias("k"),
        (F.col("id") % 50).alias("o"), F.col("id").alias("v")).repartition(6)
    plain = ordinal.row_numbers(spark, rows, ["k"], ["o", "v"])
    window = Window.partitionBy("k").orderBy("o", "v")
    assert sorted(map(str, plain.collect())) == sorted(map(str, rows.withColumn("rn", F.row_number().over(window)).collect()))
    whole = ordinal.numbered(spark, rows, ["v"], "n").orderBy("v").collect()
    assert [r.n for r in whole] == list(range(1, 3001))


def test_equal_rows_get_their_own_numbers(spark):
    rows = spark.range(500).select(F.lit(1).alias("a"))
    assert sorted(r.n for r in ordinal.numbered(spark, rows, ["a"], "n").collect()) == list(range(1, 501))


def test_collected_keeps_every_item(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(2).alias("k"), F.col("id").alias("v"))
    parts = ordinal.collected(rows, "k", F.col("v"), "v", "items", largest_array=100).collect()
    assert sorted(v for p in parts for v in p["items"]) == list(range(1000))
    assert len([p for p in parts if p.k == 1]) == 9 and len([p for p in parts if p.k == 2]) == 1
    assert all(p["items"] == sorted(p["items"]) for p in parts) and max(len(p["items"]) for p in parts) < 200


# --- schemas -------------------------------------------------------------------------------------

def test_schemas_and_statements(spark):
    rows = spark.createDataFrame(
        [("My Table.csv", 1, "Name", None), ("My Table.csv", 0, "ID", "BigInt")], "table_name string, position int, name string, column_type string")
    built = schema.build_schemas(rows)
    assert schema.create_statements(built, "bulk_loading").first().statement == 'create table bulk_loading."my_table"("id" bigint,"name" text)'
    wide = spark.range(1700).selectExpr("'t' as table_name", "cast(id as int) as position", "concat('n', id) as name", "'Text' as column_type")
    assert [c.name for c in schema.build_schemas(wide).first().columns] == [f"n{i}" for i in range(1700)]


@pytest.mark.parametrize("columns,ok", [
    ([("a", "Text")], True), ([], False), (None, False), ([(None, "Text")], False), ([(" ", "Text")], False), ([("a", None)], False)])
def test_column_lists(one, columns, ok):
    assert one(checks.valid_columns(F.col("c")), "c array<struct<name:string,column_type:string>>", (columns,)) is ok


# --- views ---------------------------------------------------------------------------------------

@pytest.fixture
def tables(spark):
    users = frame(spark, "users", [{"uid": i, "name": n, "username": n.lower()} for i, n in enumerate(["Ann", "Bob", "Cy"], 1)])
    source = {"search_radius": 1.0, "description": "d", "region_id": 1, "created": STAMP, "last_updated": STAMP, "created_by": 1,
              "updated_by": 2, "warehouse_type": 1, "collection_workflow": 1, "load_workflow": 2, "check_workflow": 3, "assigned_user": 3}
    contact = {"created": STAMP, "created_by": 1, "name": "c"}
    return {
        "users": users, "roles": catalog.seed(spark, "roles"), "regions": catalog.seed(spark, "regions"),
        "warehouse_types": catalog.seed(spark, "warehouse_types"),
        "user_roles": spark.createDataFrame([(1, 3), (1, 1), (1, 1), (2, 2)], catalog.TABLES["user_roles"]),
        "data_sources": frame(spark, "data_sources", [{**source, "ds_id": 1, "name": "one"}, {**source, "ds_id": 2, "name": "two"}]),
        "data_source_contacts": frame(spark, "data_source_contacts", [
            {**contact, "contact_id": 1, "ds_id": 1, "updated_by": 2, "last_updated": STAMP}, {**contact, "contact_id": 2, "ds_id": 1}]),
    }


def test_views(spark, tables):
    catalog.register_views(tables)
    users = spark.sql("select * from v_users order by uid").collect()
    assert [(u.uid, [r["name"] for r in u.roles]) for u in users] == [(1, ["admin", "load"]), (2, ["collection"])]
    kept = catalog.users_view(tables["users"], tables["user_roles"], tables["roles"], keep_unmatched=True)
    assert kept.filter("uid = 3").first().roles == []
    sources = spark.sql("select * from v_data_sources order by ds_id").collect()
    assert len(sources[0]) == 23
    one, two = sources
    assert (one.assigned_user, one.created_by, one.updated_by, one.warehouse_name, one.prov_name) == ("Cy", "Ann", "Bob", "Current", "Alabama")
    assert (one.contact.contact_id, one.contact.created_by, one.contact.updated_by) == (1, "Ann", "Bob") and two.contact is None


def test_rights(spark, tables):
    found = {r.uid: r for r in catalog.capabilities(tables["user_roles"], tables["roles"]).collect()}
    assert found[1].is_admin and all(found[1][c] for c in catalog.CAPABILITIES)
    assert [c for c in catalog.CAPABILITIES if found[2][c]] == ["update_ds", "collect"]
    assert [r.uid for r in catalog.allowed_users(tables["user_roles"], tables["roles"], "collect").orderBy("uid").collect()] == [1, 2]
    instances = frame(spark, "load_instances", [{"li_id": 7, "collect_user_id": 2, "check_user_id": 2}])
    requests = spark.createDataFrame([(2, 7), (2, 8), (1, 8), (3, 7)], "uid bigint, li_id bigint")
    admins = catalog.allowed_users(tables["user_roles"], tables["roles"], "is_admin")
    allowed = {(r.uid, r.li_id): r.allowed for r in catalog.may_update(requests, instances, admins).collect()}
    assert allowed == {(2, 7): True, (2, 8): False, (1, 8): True, (3, 7): False}


def test_sources_to_load(spark):
    entries = frame(spark, "source_data", [{"sd_id": i, "li_id": li, "to_load": t} for i, li, t in [(1, 1, True), (2, 1, False), (3, 2, True)]])
    instances = frame(spark, "load_instances", [{"li_id": 1, "load_workflow_run_id": 50}, {"li_id": 2, "load_workflow_run_id": 51}])
    assert [r.sd_id for r in catalog.sources_to_load(entries, instances, 50).collect()] == [1]
    assert catalog.sources_to_load(entries, instances).count() == 2
    assert catalog.source_entries(entries, li_id=1).count() == 2 and catalog.source_entries(entries, sd_id=3).count() == 1


# --- changes -------------------------------------------------------------------------------------

def test_change_log(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3), (4, "d", 4)], "k int, t string, n int")
    new = spark.createDataFrame([(1, "a", 1), (2, "c", 2), (3, None, 9), (5, "e", None)], "k int, t string, n int")
    log = {r.k: (r.action, r.row_data, r.changed_fields) for r in changelog.change_rows(old, new, ["k"]).collect()}
    assert log == {
        2: ("U", '{"k":2,"t":"b","n":2}', '{"t":"c"}'), 3: ("U", '{"k":3,"t":null,"n":3}', '{"n":"9"}'),
        4: ("D", '{"k":4,"t":"d","n":4}', None), 5: ("I", '{"k":5,"t":"e","n":null}', None)}
    quiet = changelog.change_rows(old, new, ["k"], ignored=("n", "unknown"))
    assert {r.k: r.row_data for r in quiet.collect()} == {
        2: '{"k":2,"t":"b"}', 4: '{"k":4,"t":"d"}', 5: '{"k":5,"t":"e"}'}
    context = changelog.Context("s", "t", "me", "app", 5, "2024-01-01 00:00:00", "update t", log_query=False)
    rows = changelog.row_log(quiet, context).collect()
    assert {(r.schema_name, r.client_query, r.acting_user_id, r.statement_only) for r in rows} == {("s", None, 5, False)}
    statements = changelog.statement_log(quiet, context, truncated=True)
    assert sorted((r.action, r.statement_only) for r in statements.collect()) == [("D", True), ("I", True), ("T", True), ("U", True)]


def test_change_log_of_nested_values(spark):
    kind = "k int, b boolean, d double, s struct<x:int,y:string>, a array<int>"
    old = spark.createDataFrame([(1, True, 0.5, (1, None), [1])], kind)
    new = spark.createDataFrame([(1, False, 0.5, (2, "z"), [1, 2])], kind)
    row = changelog.change_rows(old, new, ["k"]).first()
    assert json.loads(row.row_data) == {"k": 1, "b": True, "d": 0.5, "s": {"x": 1, "y": None}, "a": [1]}
    assert json.loads(row.changed_fields) == {"b": "false", "s": '{"x":2,"y":"z"}', "a": "[1,2]"}


def test_apply_changes(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, t string")
    batch = spark.createDataFrame([
        ("U", 7, 1, "x"), ("D", 7, 2, None), ("I", 7, 4, ""), ("U", 8, 3, "no"), ("I", 7, 3, "clash"), ("U", 7, 9, "nothing"),
        ("U", 7, 10, "p"), ("D", 7, 10, "p")], "action string, actor bigint, k int, t string")
    allowed = spark.createDataFrame([(7,), (7,)], "uid bigint")
    done = changes.apply_changes(table, batch, "k", "actor", allowed, "uid %s may not", optional_text=("t",))
    assert sorted(map(tuple, done.table.collect())) == [(1, "x"), (3, "c"), (4, None)]
    assert sorted((r.k, r.action, r.reason) for r in done.rejected.collect()) == [
        (3, "I", "key 3 exists"), (3, "U", "uid 8 may not"), (10, "D", "key 10 is changed more than once"),
        (10, "U", "key 10 is changed more than once")]
    assert sorted((r.k, r.action) for r in done.log.collect()) == [(1, "U"), (2, "D"), (4, "I")]


def test_batches(spark):
    table = spark.createDataFrame([(5, "a", "n")], "id bigint, t string, o string")
    rows = spark.createDataFrame([("c", "z"), ("b", "y")], "t string, o string")
    assert [tuple(r) for r in changes.insert_rows(spark, table, rows, "id", ["t"]).orderBy("id").collect()] == [(6, "b", "y"), (7, "c", "z")]
    new = spark.createDataFrame([(5, None, "")], "id bigint, t string, o string")
    assert changes.update_rows(table, new, "id", ["t", "o"], ("o",)).first() == (5, None, None)
    with pytest.raises(Exception, match="changed more than once"):
        changes.update_rows(table, new.unionByName(new), "id", ["t"]).collect()
    kept, gone = changes.delete_rows(table, spark.createDataFrame([(5,), (6,)], "id bigint"), "id")
    assert kept.count() == 0 and gone.first().t == "a"
    ok, refused = changes.gate(table.withColumn("actor", F.lit(3)), "actor", spark.createDataFrame([(4,)], "uid int"), "uid %s cannot")
    assert ok.count() == 0 and refused.first().reason == "uid 3 cannot"


def test_references(spark):
    child = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id int, p int")
    gone = spark.createDataFrame([(10,)], "k int")
    assert sorted(r.id for r in changes.cascade(child, "p", gone, "k").collect()) == [2, 3]
    assert [r.id for r in changes.restricted(child, "p", gone, "k").collect()] == [1]
    assert sorted((r.id, r.p) for r in changes.set_null(child, "p", gone, "k").fillna(0).collect()) == [(1, 0), (2, 11), (3, 0)]
    renamed = spark.createDataFrame([(10, 99)], "old_key int, new_key int")
    assert sorted((r.id, r.p) for r in changes.update_key(child, "p", renamed).fillna(0).collect()) == [(1, 99), (2, 11), (3, 0)]


def test_new_instances(spark):
    source = {"collection_workflow": 1, "load_workflow": 2, "check_workflow": 3}
    sources = frame(spark, "data_sources", [{**source, "ds_id": 1}, {**source, "ds_id": 2}])
    instances = frame(spark, "load_instances", [{"li_id": 1, "ds_id": 1, "merge_type": "Exclusive"}, {"li_id": 9, "ds_id": 1, "merge_type": "Intersect"}])
    requests = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 1)), (3, dt.date(2024, 1, 1))], "ds_id bigint, version_date date")
    found = {r.ds_id: r.merge_type for r in changes.new_instances(requests, sources, instances).collect()}
    assert found == {1: "Intersect", 2: "None"}


def test_warehouse_modes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, t string, n int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 3)], "k int, t string, n int")
    rows = lambda f: sorted(map(tuple, f.fillna("-").collect()))
    run = lambda mode: warehouse.merge(old, new, ["k"], mode)
    assert rows(run("Current").production) == rows(run("Archive").production) == [(2, "-", 5), (3, "c", 3)]
    assert rows(run("Archive").archive) == [(1, "a", 1)]
    assert rows(run("Historical").production) == [(1, "a", 1), (2, "-", 5), (3, "c", 3)]
    assert rows(run("Full Historical").production) == [(1, "a", 1), (2, "b", 5), (3, "c", 3)]
    assert warehouse.counters(old, new, ["k"]).first() == (2, 2, 1, 1)
    double = new.unionByName(new)
    assert warehouse.counters(old, double, ["k"]).first() == (2, 4, 2, 2)
    assert warehouse.counters(old.limit(0), new.limit(0), ["k"]).first() == (0, 0, 0, 0)
    with pytest.raises(Exception, match="more than once"):
        warehouse.merge(old, double, ["k"], "Full Historical").production.collect()
    with pytest.raises(ValueError, match="unknown warehouse type"):
        run("Other")
