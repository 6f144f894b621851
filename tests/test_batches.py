"""Source-entry batches, changes of files, the reference graph and checks of what a batch touched."""

import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cartoload.operators import catalog, checks, deltachecks, entries, filechanges, references
from cartoload.session import scratch

COLUMNS = [("id", "Text")]


# ----------------------------------------------------------------------------------- source entries


def entry(sd_id, li_id, number, name):
    return sd_id, li_id, number, False, "{}", name, COLUMNS, True, None, None


def ask(position, action, actor, sd_id=None, li_id=None, name="NAME", options="{}", columns=COLUMNS, generated=True):
    return position, action, actor, sd_id, li_id, generated, options, name, columns


BATCH = "position bigint, action string, actor bigint, sd_id bigint, li_id bigint, user_generated boolean, options string, table_name string, columns array<struct<name:string,column_type:string>>"


def run_batch(spark, existing, batch):
    source = spark.createDataFrame(existing, catalog.TABLES["source_data"])
    instances = spark.createDataFrame([(1, 10, 11, None), (2, 20, None, 10), (3, None, None, None), (4, 40, 40, 40)], "li_id bigint, collect_user_id bigint, load_user_id bigint, check_user_id bigint")
    return entries.apply_entries(spark, source, spark.createDataFrame(batch, BATCH), instances, spark.createDataFrame([(99,)], "uid bigint"))


def test_numbers_continue_each_instance(spark):
    existing = [entry(5, 1, 7, "AA"), entry(6, 1, 3, "BB"), entry(9, 2, 1, "AA")]
    batch = [ask(1, "I", 10, li_id=1, name="CC"), ask(2, "I", 10, li_id=2, name="CC"), ask(3, "I", 99, li_id=3, name="AA"), ask(4, "I", 11, li_id=1, name="DD"), ask(5, "I", 20, li_id=1, name="EE"), ask(6, "I", 20, li_id=2, name="FF")]
    found = run_batch(spark, existing, batch)
    assert sorted(map(tuple, found.created.collect())) == [(1, 10, 1, 8), (2, 11, 2, 2), (3, 12, 3, 1), (4, 13, 1, 9), (6, 14, 2, 3)]
    assert [(r.position, r.reason) for r in found.rejected.collect()] == [(5, "uid 20 is neither part of load instance 1 nor an admin")]
    assert found.table.count() == 8 and {(r.sd_id, r.action) for r in found.log.collect()} == {(n, "I") for n in range(10, 15)}


def test_reasons_and_silent_requests(spark):
    existing = [entry(1, 1, 1, "AA"), entry(2, 1, 2, "BB"), entry(3, 2, 1, "CC"), entry(4, 4, 32766, "DD"), entry(5, 2, 5, "XX"), entry(6, 2, 6, "YY")]
    batch = [
        ask(1, "D", 10, sd_id=1), ask(2, "I", 10, li_id=1, name="AA"),  # the name of an entry that goes
        ask(3, "I", 10, li_id=1, name="BB"),  # held
        ask(4, "U", 10, sd_id=2, name="NEW"), ask(5, "I", 99, li_id=1, name="NEW"),  # the first request has it
        ask(6, "U", 10, sd_id=77), ask(7, "D", 10, sd_id=77),  # not there
        ask(8, "U", 10, sd_id=3, options=None),  # a missing value
        ask(9, "I", None, li_id=1), ask(10, "I", 10, li_id=None), ask(11, "I", 99, li_id=8), ask(12, "I", 10, li_id=2, name="lower ok?"), ask(13, "I", 10, li_id=2, name="QQ", columns=[]),
        ask(14, "I", 10, li_id=2, name="QQ", columns=[("a", None)]), ask(15, "I", 10, li_id=2, name="QQ", options=None), ask(16, "I", 40, li_id=4, name="E1"), ask(17, "I", 40, li_id=4, name="E2"),
        ask(18, "U", 20, sd_id=5, name="PP"), ask(19, "D", 20, sd_id=5), ask(20, "U", 20, sd_id=6, name="YY")]
    found = run_batch(spark, existing, batch)
    reasons = {r.position: r.reason for r in found.rejected.collect()}
    part = "is neither part of load instance"
    assert reasons == {
        3: 'load instance 1 has a table "BB"', 5: 'load instance 1 has a table "NEW"', 9: f"uid NULL {part} 1 nor an admin", 10: f"uid 10 {part} NULL nor an admin", 11: "load instance 8 does not exist",
        12: 'table name "lower ok?" has the wrong form', 13: "the column list is not valid", 14: "the column list is not valid", 15: "options are missing", 17: "load instance 4 has no number left",
        18: "entry 5 is changed more than once", 19: "entry 5 is changed more than once"}
    after = {r.sd_id: (r.li_id, r.load_source_id, r.table_name) for r in found.table.collect()}
    assert after == {2: (1, 2, "NEW"), 3: (2, 1, "CC"), 4: (4, 32766, "DD"), 5: (2, 5, "XX"), 6: (2, 6, "YY"), 7: (1, 3, "AA"), 8: (4, 32767, "E1")}
    log = {r.sd_id: (r.action, r.changed_fields) for r in found.log.collect()}
    assert log == {1: ("D", None), 2: ("U", '{"user_generated":"true","table_name":"NEW"}'), 6: ("U", '{"user_generated":"true"}'), 7: ("I", None), 8: ("I", None)}


def test_an_empty_batch_and_an_empty_table(spark):
    assert run_batch(spark, [entry(1, 1, 1, "A")], []).table.count() == 1
    found = run_batch(spark, [], [ask(k, "I", 10, li_id=1, name=f"N{k}") for k in range(300)])
    assert sorted((r.sd_id, r.load_source_id) for r in found.created.collect()) == [(k, k) for k in range(1, 301)]

def test_requests_for_new_entries_do_not_meet_in_one_task(spark, monkeypatch):
    largest, write = [], entries.truncate_lineage

    def counted(session, df, label):
        largest.append(max([r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()], default=0))
        return write(session, df, label)

    monkeypatch.setattr(entries, "truncate_lineage", counted)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:  # joins as of large tables: shuffled, in as many tasks as there are partitions
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        source = spark.createDataFrame([entry(k, k, 1, f"T{k}") for k in range(1, 41)], catalog.TABLES["source_data"])
        instances = spark.range(1, 401).selectExpr("id as li_id", "10 as collect_user_id", "11 as load_user_id", "null as check_user_id")
        batch = [ask(k, "I", 10, li_id=k, name=f"N{k}") for k in range(1, 401)] + [ask(1000 + k, "D", 10, sd_id=k) for k in range(1, 41)]
        asked = entries.judged(spark, source, spark.createDataFrame(batch, BATCH), instances, spark.createDataFrame([(99,)], "uid bigint"))
        assert asked.where("reason is null").count() == 440
    finally:
        for k, value in kept.items():
            spark.conf.set(k, value)
    assert max(largest) <= 220, largest


# ------------------------------------------------------------------------------------------- files


def folder_of(spark, rows=100, files=5):
    path = scratch(spark, "table") + "/t"
    spark.range(rows).select("id", F.lit(1).cast("bigint").alias("owner"), F.concat(F.lit("v"), F.col("id")).alias("v")).repartitionByRange(files, "id").write.parquet(path)
    return path


def states(path):
    place = path.removeprefix("file:")
    return {n: os.stat(f"{place}/{n}").st_mtime_ns for n in os.listdir(place) if n.endswith(".parquet")}


CHANGES = "action string, actor bigint, id bigint, owner bigint, v string"


def test_one_key_leaves_the_other_files(spark):
    path = folder_of(spark)
    before = states(path)
    users = spark.createDataFrame([(1,)], "uid bigint")
    for batch, value in (([("U", 1, 42, 1, "new")], "new"), ([("D", 1, 42, 1, None)], None), ([("I", 1, 42, 1, "again")], "again")):
        done, rejected, log = filechanges.apply_to_files(spark, path, spark.createDataFrame(batch, CHANGES), "id", "actor", users, "uid %s may not")
        assert done.removed == (0 if value == "again" else 1) and rejected.count() == 0 and log.count() == 1
        now = states(path)
        assert len(before.keys() - now.keys()) == done.removed and all(now[n] == before[n] for n in before.keys() & now.keys())
        rows = {r.id: r.v for r in spark.read.parquet(path).collect()}
        assert rows.get(42) == value and len(rows) == (99 if value is None else 100)
        before = now
    done, rejected, log = filechanges.apply_to_files(spark, path, spark.createDataFrame([("U", 7, 1, 1, "x"), ("I", 1, 2, 1, "x")], CHANGES), "id", "actor", users, "uid %s may not")
    assert sorted(r.reason for r in rejected.collect()) == ["key 2 exists", "uid 7 may not"] and log.count() == 0 and spark.read.parquet(path).count() == 100


def test_a_swap_is_finished_or_undone(spark, monkeypatch):
    path = folder_of(spark)
    place = path.removeprefix("file:")
    keys = spark.createDataFrame([(3,), (98,)], "id bigint")
    real = filechanges.recover
    calls = []

    def broken(session, where):  # the call after the journal was written never comes
        calls.append(where)
        if len(calls) == 1:
            return real(session, where)
        raise KeyboardInterrupt

    monkeypatch.setattr(filechanges, "recover", broken)
    with pytest.raises(KeyboardInterrupt):
        filechanges.delete_from_files(spark, path, keys, ["id"])
    monkeypatch.undo()
    assert spark.read.parquet(path).count() == 100  # hidden files are not read
    filechanges.recover(spark, path)
    assert spark.read.parquet(path).count() == 98 and not [n for n in os.listdir(place) if n.startswith("_swap")]
    os.makedirs(f"{place}/_new-left")
    filechanges.recover(spark, path)
    assert spark.read.parquet(path).count() == 98 and not os.path.exists(f"{place}/_new-left")
    nothing = filechanges.delete_from_files(spark, path, keys.where("false"), ["id"])
    assert nothing.removed == 0 and spark.read.parquet(path).count() == 98


def test_merge_into_files(spark):
    path = folder_of(spark)
    staging = spark.createDataFrame([(5, None, "five"), (6, 2, None), (200, 3, "new")], "id bigint, owner bigint, v string")
    done = filechanges.merge_into_files(spark, path, staging, ["id"], "Full Historical")
    assert done.removed == 1
    rows = {r.id: (r.owner, r.v) for r in spark.read.parquet(path).collect()}
    assert (rows[5], rows[6], rows[200], len(rows)) == ((1, "five"), (2, "v6"), (3, "new"), 101)
    with pytest.raises(ValueError):
        filechanges.merge_into_files(spark, path, staging, ["id"], "Current")


# ------------------------------------------------------------------------------------- references


def plain_delete(tables, edges, wanted, required):
    """By following every reference one at a time; rows are (key, {column: value})."""
    gone = {name: set(keys) for name, keys in wanted.items()}
    grown = True
    while grown:
        grown = False
        for child, column, parent, _, action in edges:
            for key, row in tables[child].items():
                if action == "cascade" and row[column] in gone.get(parent, ()) and key not in gone.setdefault(child, set()):
                    gone[child].add(key)
                    grown = True
    for child, column, parent, _, action in edges:
        for key, row in tables[child].items():
            held = row[column] in gone.get(parent, ()) and key not in gone.get(child, ())
            if held and (action == "restrict" or action == "set null" and (child, column) in required):
                return None
    return {name: {key: {c: None if any(e[0] == name and e[1] == c and e[4] == "set null" and v in gone.get(e[2], ()) for e in edges) else v for c, v in row.items()}
                   for key, row in rows.items() if key not in gone.get(name, ())} for name, rows in tables.items()}


def frames(spark, tables):
    return {name: spark.createDataFrame([(k, *[row[c] for c in ("p", "q")]) for k, row in rows.items()], "id bigint, p bigint, q bigint") for name, rows in tables.items()}


@pytest.mark.parametrize("seed", range(6))
def test_random_graphs(spark, seed):
    draw = random.Random(seed)
    names = ["a", "b", "c", "d"]
    tables = {n: {k: {c: draw.choice([None, *range(12)]) for c in "pq"} for k in range(12)} for n in names}
    edges = [(c, column, draw.choice(names), "id", draw.choice(["cascade", "cascade", "set null", "restrict" if seed % 2 else "set null"])) for c in names for column in "pq"]
    wanted = {draw.choice(names): draw.sample(range(12), 2)}
    required = {("b", "p")} if seed > 3 else set()
    want = plain_delete(tables, edges, wanted, required)
    asked = {n: spark.createDataFrame([(k,) for k in keys], "id bigint") for n, keys in wanted.items()}
    got = references.delete(spark, frames(spark, tables), {n: ["id"] for n in names}, edges, asked, required)
    assert (want is None) == (got.blocked.count() > 0)
    after = {n: {r.id: {"p": r.p, "q": r.q} for r in f.collect()} for n, f in got.tables.items()}
    assert after == (want or tables)


def test_a_chain_within_a_table(spark):
    rows = {"a": {k: {"p": k - 1 if k else None, "q": None} for k in range(15)}}
    got = references.delete(spark, frames(spark, rows), {"a": ["id"]}, [("a", "p", "a", "id", "cascade")], {"a": spark.createDataFrame([(4,)], "id bigint")})
    assert sorted(r.id for r in got.tables["a"].collect()) == [0, 1, 2, 3] and got.levels == 11


def test_catalogue_references(spark):
    """Deleting a user takes the grants along, but the user's sources can't do without a creator."""
    tables = {name: spark.createDataFrame([], catalog.TABLES[name]) for name in catalog.TABLES}
    tables["users"] = spark.createDataFrame([(1, "a", "a"), (2, "b", "b")], catalog.TABLES["users"])
    tables["user_roles"] = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], catalog.TABLES["user_roles"])
    keys = {name: unique[0] for name, unique in checks.UNIQUE_KEYS.items()}
    one = tables["users"].where("uid = 1")
    got = references.delete(spark, tables, keys, checks.FOREIGN_KEYS, {"users": one})
    assert [tuple(r) for r in got.tables["user_roles"].collect()] == [(2, 1)] and got.levels == 2
    shape = spark.createDataFrame([], catalog.TABLES["data_sources"]).schema
    source = {"ds_id": 1, "name": "s", "region_id": 1, "assigned_user": 2, "created_by": 1, "updated_by": 2}
    tables["data_sources"] = spark.createDataFrame([tuple(source.get(n) for n in shape.names)], shape)
    got = references.delete(spark, tables, keys, checks.FOREIGN_KEYS, {"users": one}, {("data_sources", "created_by"), ("data_sources", "updated_by")})
    assert [tuple(r) for r in got.blocked.collect()] == [("data_sources", "created_by", "users", "1", "not null", 1)]
    assert got.tables["user_roles"].count() == 3
    got = references.delete(spark, tables, keys, checks.FOREIGN_KEYS, {"users": one})
    assert got.tables["data_sources"].first().created_by is None and got.tables["data_sources"].first().updated_by == 2


def test_new_keys_are_carried_on(spark):
    tables = {"a": {1: {"p": None, "q": 1}, 2: {"p": None, "q": 2}}, "b": {1: {"p": 1, "q": 5}, 3: {"p": 2, "q": 6}}, "c": {9: {"p": 3, "q": 1}}}
    edges = [("b", "id", "a", "id", "cascade"), ("c", "q", "b", "id", "cascade"), ("b", "p", "a", "id", "restrict")]
    renamed = spark.createDataFrame([(1, 100)], "old_key bigint, new_key bigint")
    got = references.rename(spark, frames(spark, tables), edges, "a", "id", renamed)
    rows = {n: sorted(tuple(r) for r in f.collect()) for n, f in got.items()}
    assert rows == {"a": [(2, None, 2), (100, None, 1)], "b": [(3, 2, 6), (100, 100, 5)], "c": [(9, 3, 100)]}
    with pytest.raises(Exception, match="more than once"):
        references.rename(spark, frames(spark, tables), edges, "a", "id", renamed.union(renamed))["a"].collect()


# ------------------------------------------------------------------------------ checks of a batch


def test_delta_checks_equal_full_checks(spark):
    draw = random.Random(3)
    schema = "id bigint, country_code string, country_name string, prov_code string, prov_name string, county string, plotting_order int"
    base = [(k, f"c{k % 9}", f"n{k % 9}", None if k % 4 == 0 else f"p{k % 5}", None if k % 4 == 0 else f"pn{k % 5}", f"x{k}", k // 9 + 1) for k in range(180)]
    batch = [(1000 + k, draw.choice(["c1", "c2", "new"]), draw.choice(["n1", "n2"]), draw.choice([None, "p1"]), draw.choice(["pn1", "q"]), draw.choice(["x1", "x2", None]), draw.choice([21, 22, 30])) for k in range(12)]
    after, added = spark.createDataFrame(base + batch, schema), spark.createDataFrame(batch, schema)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(deltachecks.region_conflicts(after, added), checks.region_conflicts(after))
    for keys, nulls in ((["county"], False), (["country_code", "prov_code", "county"], True)):
        assert same(deltachecks.duplicates(after, added, keys, nulls), checks.duplicates(after, keys, nulls))
    bad = lambda report: report.where("not contiguous")
    assert same(bad(deltachecks.order_report(after, added, "country_code", "plotting_order")), bad(checks.order_report(after, "country_code", "plotting_order")))
    parents = spark.createDataFrame([(f"c{k}",) for k in range(9)], "code string")
    gone = parents.where("code = 'c7'")
    assert same(deltachecks.orphans(after, added, "country_code", parents.where("code <> 'c7'"), "code", gone), checks.orphans(after, "country_code", parents.where("code <> 'c7'"), "code"))
    assert Counter(r.country_code for r in deltachecks.orphans(after, added, "country_code", parents, "code").collect()).keys() <= {"new"}
