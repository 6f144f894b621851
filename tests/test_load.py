import json
import os

import pytest
from pyspark.sql import functions as F

import cartoload
from cartoload.operators.schema import load_options
from cartoload.operators import stage as stage_module
from cartoload.operators.stage import export_csv, stage, stage_table
from cartoload.plans import load_job as load_module
from cartoload.plans.load_job import read_rejects, run_load, run_load_by_format, run_workflow, succeeded
from cartoload.session import scratch
from cartoload.sources import delimited
from cartoload.sources.dispatch import scan


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def csv_options(path):
    return {"file_path": path, "delimiter": ",", "qualified": True}


def test_stage_replaces_and_counts(spark, tmp_path):
    root = scratch(spark, "staging")
    path = put(tmp_path, "t.csv", "a\n1\n2\n")
    assert stage(spark, scan(spark, csv_options(path)), root) == 2
    put(tmp_path, "t.csv", "a,b\n1,x\n")
    assert stage(spark, scan(spark, csv_options(path)), root) == 1
    table = spark.read.parquet(f"{root}/t")
    assert table.columns == ["a", "b"] and table.schema["b"].metadata["column_type"] == "Text"


def test_a_failed_load_leaves_the_old_table(spark, tmp_path):
    root = scratch(spark, "staging")
    path = put(tmp_path, "t.csv", "a,b\n1,x\n")
    stage(spark, scan(spark, csv_options(path)), root)
    put(tmp_path, "t.csv", "a,b\n1,x\n1\n")
    with pytest.raises(Exception):
        stage(spark, scan(spark, csv_options(path)), root)
    assert spark.read.parquet(f"{root}/t").count() == 1


def test_a_refused_rename_leaves_the_old_table(spark, tmp_path, monkeypatch):
    root = scratch(spark, "staging")
    path = put(tmp_path, "t.csv", "a\n1\n")
    stage(spark, scan(spark, csv_options(path)), root)
    put(tmp_path, "t.csv", "a\n2\n3\n")
    monkeypatch.setattr(stage_module, "_renamed", lambda *_: False)
    with pytest.raises(OSError):
        stage(spark, scan(spark, csv_options(path)), root)
    assert [r.a for r in spark.read.parquet(f"{root}/t").collect()] == ["1"]
    monkeypatch.undo()
    assert stage(spark, scan(spark, csv_options(path)), root) == 2
    assert os.listdir(root.removeprefix("file:")) == ["t"]


def test_two_sources_of_one_table_are_refused(spark, tmp_path):
    (tmp_path / "other").mkdir()
    one, two, three = put(tmp_path, "t.csv", "a\n1\n"), put(tmp_path / "other", "t.csv", "a\n2\n3\n"), put(tmp_path, "u.csv", "a\n1\n")
    manifest = spark.createDataFrame([(k, json.dumps(csv_options(p))) for k, p in enumerate((one, two, three))], "sd_id bigint, options string")
    root = scratch(spark, "staging")
    found = {r.sd_id: r for r in run_load(spark, manifest, root).collect()}
    assert all('2 sources of this run load the table "t"' in found[k].error for k in (0, 1)) and found[2].rows == 1
    assert os.listdir(root.removeprefix("file:")) == ["u"]


def test_load_job_goes_on_past_failures(spark, tmp_path):
    good, bad = put(tmp_path, "good.csv", "a\n1\n"), put(tmp_path, "bad.csv", "a,b\n1\n")
    manifest = spark.createDataFrame(
        [(1, json.dumps(csv_options(good))), (2, json.dumps(csv_options(bad))), (3, "[]"), (4, '{"file_path":"x.doc"}')],
        "sd_id bigint, options string")
    report = run_load(spark, manifest, scratch(spark, "staging"))
    found = {r.sd_id: r for r in report.collect()}
    assert (found[1].table_name, found[1].rows, found[1].error) == ("good", 1, None) and found[1].loaded_timestamp
    assert all(found[i].error.startswith(f"Error attempting to bulk load data for sd_id = {i}.\n") for i in (2, 3, 4))
    assert not succeeded(report) and succeeded(report.filter("sd_id = 1"))


def test_workflow_run_updates_its_entries(spark, tmp_path):
    good, bad = json.dumps(csv_options(put(tmp_path, "g.csv", "a\n1\n"))), '{"file_path":"none.parquet"}'
    entries = spark.createDataFrame(
        [(1, 1, good, True, None, "old"), (2, 1, bad, True, None, None), (3, 1, good, False, None, None), (4, 2, good, True, None, None)],
        "sd_id bigint, li_id bigint, options string, to_load boolean, loaded_timestamp timestamp, error_message string")
    instances = spark.createDataFrame([(1, 50), (2, 51)], "li_id bigint, load_workflow_run_id bigint")
    report, after = run_workflow(spark, entries, instances, 50, scratch(spark, "staging"))
    assert sorted((r.sd_id, r.rows) for r in report.collect()) == [(1, 1), (2, None)]
    found = {r.sd_id: (r.loaded_timestamp is not None, r.error_message is not None) for r in after.collect()}
    assert found == {1: (True, False), 2: (False, True), 3: (False, False), 4: (False, False)}


def test_schema_only(spark, tmp_path):
    path = put(tmp_path, "S.csv", "a,B c\n1,2\n")
    assert cartoload.infer_schema(spark, csv_options(path)) == ("s", [("a", "Text"), ("b_c", "Text")])


def test_stage_into_the_catalog(spark, tmp_path):
    source = scan(spark, csv_options(put(tmp_path, "cat.csv", "a\n1\n")))
    spark.sql(f"create database if not exists bulk_test location '{tmp_path}/db'")
    assert stage_table(source, "bulk_test") == 1
    assert spark.table("bulk_test.cat").first().a == "1"
    spark.sql("drop database bulk_test cascade")


def test_export_reads_back(spark, tmp_path):
    path = put(tmp_path, "e.csv", 'a,b\n"x,1","say ""q"""\n2,z\n')
    source = delimited.scan(spark, csv_options(path))
    out = str(tmp_path / "lines")
    export_csv(source.frame, out)
    lines = sorted(r.value for r in spark.read.text(out).collect())
    assert lines == ['"x,1","say ""q"""', "2,z"]
    assert load_options(source, "Bulk")["table"] == 'bulk."e"'
    assert "quote" not in load_options(source, "bulk", qualified=False)


def test_tasks_need_no_installed_package(spark, tmp_path):
    """Functions shipped to the tasks carry their code along."""
    seen = spark.range(1).select(F.pandas_udf(lambda s: s.map(lambda _: os.getcwd()), "string")("id").alias("d")).first().d
    assert seen


# --- all sources of one kind and schema in one job --------------------------------------------------

COLUMNS = [("id", "Integer"), ("name", "Text"), ("paid", "Money"), ("seen", "Date"), ("parts", "SmallIntArray")]
GOOD_LINE = '7,"a ""b""","$1,250.50",2020-02-29,"{1,2}"\n'


def declared(entries, columns=COLUMNS):
    return [(k, json.dumps(o), [{"name": n, "column_type": c} for n, c in columns] if c is None else c) for k, o, c in entries]


MANIFEST = "sd_id bigint, options string, columns array<struct<name:string,column_type:string>>"


def bad_and_good(folder):
    head = "id,name,paid,seen,parts\n"
    put(folder, "fine.csv", head + GOOD_LINE * 40)
    bad = head + GOOD_LINE + "x7,,,,\n" + "99999999999,n,$x,2021-02-29,{99999}\n" + "1,2\n" + "\n" + "8,\x01,,,{}\n" + '9,"",,,\n' + GOOD_LINE
    put(folder, "mixed.csv", bad)
    return head, bad


@pytest.mark.parametrize("size", [16, None])
def test_rejects_keep_place_and_reason(spark, tmp_path, size):
    _, text = bad_and_good(tmp_path)
    extra = {"range_bytes": size} if size else {}
    entries = declared([(k, {**csv_options(str(tmp_path / f"{n}.csv")), **extra}, None) for k, n in ((1, "fine"), (2, "mixed"))])
    root = scratch(spark, "staging")
    report = {r.sd_id: r for r in run_load_by_format(spark, spark.createDataFrame(entries, MANIFEST), root, "keep").collect()}
    assert (report[1].rows, report[1].rejected, report[2].rows, report[2].rejected) == (40, 0, 4, 4) and not report[2].error
    staged = spark.read.parquet(f"{root}/mixed")
    assert [f.metadata["column_type"] for f in staged.schema] == [k for _, k in COLUMNS]
    assert sorted((r.id, r.name, str(r.paid), str(r.seen), r.parts) for r in staged.collect()) == [
        (7, 'a "b"', "1250.50", "2020-02-29", [1, 2]), (7, 'a "b"', "1250.50", "2020-02-29", [1, 2]), (8, "\x01", "None", "None", []), (9, "", "None", "None", None)]
    found = [r for r in read_rejects(spark, f"{root}/_rejects").collect()]
    raw = text.encode()
    assert {(r.target, r.source) for r in found} == {("mixed", 2)}
    assert sorted((raw[r.offset:].split(b"\n")[0].decode(), str(r.column), r.text, r.reason) for r in found) == sorted([
        ("x7,,,,", "id", "x7", "invalid Integer"), ("99999999999,n,$x,2021-02-29,{99999}", "id", "99999999999", "out of range for Integer"),
        ("99999999999,n,$x,2021-02-29,{99999}", "paid", "$x", "invalid Money"), ("99999999999,n,$x,2021-02-29,{99999}", "seen", "2021-02-29", "invalid Date"),
        ("99999999999,n,$x,2021-02-29,{99999}", "parts", "{99999}", "out of range for SmallIntArray"),
        ("1,2", "None", "1,2", "2 columns, but the header has 5"), ("", "None", "", "a line is blank, but the header has 5 columns")])


def test_a_refused_source_keeps_its_old_table(spark, tmp_path):
    head, _ = bad_and_good(tmp_path)
    root = scratch(spark, "staging")
    entries = declared([(k, csv_options(str(tmp_path / f"{n}.csv")), None) for k, n in ((1, "fine"), (2, "mixed"))])
    manifest = spark.createDataFrame(entries, MANIFEST)
    put(tmp_path, "mixed.csv", head + GOOD_LINE)
    assert succeeded(run_load_by_format(spark, manifest, root))
    bad_and_good(tmp_path)
    report = {r.sd_id: r for r in run_load_by_format(spark, manifest, root).collect()}
    assert report[1].rows == 40 and report[2].rows is None and report[2].error == "4 rows do not fit their columns"
    assert spark.read.parquet(f"{root}/mixed").count() == 1 and read_rejects(spark, f"{root}/_rejects").count() == 7
    assert sorted(os.listdir(root.removeprefix("file:"))) == ["_rejects", "fine", "mixed"]


def test_one_job_for_each_shape(spark, tmp_path, monkeypatch):
    for k in range(6):
        put(tmp_path, f"t{k}.csv", "a,b\n" + f"{k},x\n" * k)
    put(tmp_path, "open.csv", 'a,b\n1,"x\n')
    put(tmp_path, "pipe.txt", "a|b\n1|x\n")
    spark.range(5).write.parquet(str(tmp_path / "p.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "q.parquet"))
    entries = [(k, {**csv_options(str(tmp_path / f"t{k}.csv"))}, []) for k in range(6)]
    entries += [(6, csv_options(str(tmp_path / "open.csv")), []), (7, {"file_path": str(tmp_path / "pipe.txt"), "delimiter": "|"}, []),
                (8, {"file_path": str(tmp_path / "p.parquet")}, []), (9, {"file_path": str(tmp_path / "q.parquet")}, []), (10, {"file_path": str(tmp_path / "none.parquet")}, [])]
    jobs = []
    inner = load_module.stagingsink.write
    monkeypatch.setattr(load_module.stagingsink, "write", lambda *given: jobs.append(1) or inner(*given))
    root = scratch(spark, "staging")
    manifest = spark.createDataFrame([(k, json.dumps(o), None) for k, o, _ in entries], MANIFEST)
    report = {r.sd_id: r for r in run_load_by_format(spark, manifest, root).collect()}
    assert not [report[k].error for k in (7, 8, 9) if report[k].error]
    assert {k: report[k].rows for k in report} == {**{k: k for k in range(6)}, 6: None, 7: 1, 8: 5, 9: 3, 10: None}
    assert "not closed" in report[6].error and report[10].error
    # Seven csv sources in one job, then each by itself as one of them failed; one job for the text and one for both Parquet sources.
    assert len(jobs) == 1 + 7 + 1 + 1
    assert all(spark.read.parquet(f"{root}/t{k}").count() == k for k in range(6)) and spark.read.parquet(f"{root}/q").count() == 3


def test_what_a_failed_task_left_does_not_count(spark, tmp_path):
    from cartoload.sources import stagingsink

    put(tmp_path, "t.csv", "a\n1\n")
    root = scratch(spark, "attempt")
    source = load_module.opened(spark, 1, json.dumps(csv_options(str(tmp_path / "t.csv"))), None)
    judged = load_module.one_scan(spark, [source])
    os.makedirs(root.removeprefix("file:") + "/t")
    put(tmp_path.__class__(root.removeprefix("file:")), "t/part-left-behind.parquet", "not a whole file")
    assert stagingsink.write(spark, judged, root, source.row_schema)["rows"] == {"t": 1}
    assert spark.read.parquet(f"{root}/t").count() == 1


@pytest.mark.parametrize("kind,good,bad", [
    ("Boolean", "true", "maybe"), ("SmallInt", "12", "40000"), ("BigInt", "-5", "1.x"), ("Number", "1.5", "a"), ("Real", "1e3", "e"), ("DoublePrecision", "2.5", "--"),
    ("Timestamp", "2020-01-01 10:00:00", "2020-13-01 00:00:00"), ("TimestampWithZone", "2020-01-01 10:00:00+02", "soon"), ("Time", "23:59:59", "24:00:00"),
    ("UUID", "{123e4567-e89b-12d3-a456-426614174000}", "123"), ("Json", '{"a":[1]}', "{a"), ("Interval", "5 microsecond", "5 weeks"), ("SmallIntArray", "{1, -2}", "1,2"), ("Money", "$5.10", "5 dollars")])
def test_cells_are_tried(spark, kind, good, bad):
    from cartoload.functions.values import typed
    from cartoload.operators.rejects import attempt

    value, reason = attempt(F.col("t"), kind)
    rows = spark.createDataFrame([(good,), (bad,), (None,), ("",)], "t string").select("t", value.alias("v"), reason.alias("r"), F.when(F.col("t") == good, typed(F.col("t"), kind)).alias("same")).collect()
    found = {r.t: (r.v, r.r, r.same) for r in rows}
    assert found[good][0] == found[good][2] is not None and found[good][1] is None
    assert found[bad][0] is None and found[bad][1] in (f"invalid {kind}", f"out of range for {kind}")
    assert found[None][:2] == found[""][:2] == (None, None)


def test_cells_are_not_sent_to_all_tasks(spark, tmp_path):
    """The files' owners are joined to the cells; the cells, far larger than Spark takes them for, stay where they are."""
    paths = [put(tmp_path, f"{name}.csv", "a,b\n" + "1,x\n" * 50) for name in ("one", "two")]
    sources = [load_module.opened(spark, k, json.dumps({"file_path": path, "delimiter": ","}), None) for k, path in enumerate(paths)]
    rows = load_module.one_scan(spark, sources).select("place")
    assert len(rows.collect()) == 100
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_rejects_are_found_in_their_files(spark, tmp_path):
    from cartoload.operators import rejects

    text = "x" * (rejects.READ_BYTES - 3) + "día 1" + "y" * 500 + "end"
    path = put(tmp_path, "t.csv", text)
    raw = text.encode()
    at = raw.index("día".encode())
    rows = [(path, at, "día 1"), (path, at - 100, "día 1"), (path, 0, "día 1"), (path, len(raw) - 3, "end"), (path, at - 300, "día"), (path, 5, "xxx"), (None, None, "x")]
    found = rejects.with_found(spark.createDataFrame(rows, "file string, offset bigint, text string").coalesce(1))
    assert [r.found for r in found.collect()] == [True, True, False, True, False, True, None]


def test_rejects_of_text_are_found(spark, tmp_path):
    """The table of rejects is searched by reading behind its offsets, not by joining whole files to it."""
    from cartoload.plans import registry, scan_queries  # noqa: F401  (registers its queries)

    found = registry.QUERIES["reject_channel"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and found.where("not found").isEmpty()
