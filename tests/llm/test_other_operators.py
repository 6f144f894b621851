"""Operators on pages, vectors and conversations, their SQL, and their edge cases."""

import hashlib
import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cartoload.llm import chat, urlrules, vectors, warc
from test_queries import ordered

FOLDER = "/root/testdata/sf0.001"
BIG = "x" * 200


def test_archive_round_trip(spark, tmp_path):
    rows = [(3, "http://a/", BIG), (1, "http://b/\r\nX-Evil: 1", BIG), (2, None, BIG), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"),
            (8, "u", "é" * 50), (9, "u", "é" * 50), (None, "u", BIG), (10, "u", "z" * 500_000), (11, "u", "a\r\n\r\nb" * 30)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, payload string")
    warc.write_archive(spark, pages, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/payloads").count() == len({r[2] or "" for r in rows})
    back = warc.read_archive(spark, str(tmp_path)).withColumns({"page": warc.field("X-Page-ID"), "kind": warc.field("WARC-Type"), "to": warc.field("X-Refers-To-Page-ID"), "url": warc.field("WARC-Target-URI")})
    found = {None if r.page is None else int(r.page): r for r in back.collect()}
    assert len(found) == len(rows)
    for page_id, url, html in rows:
        got = found[page_id]
        assert bytes(got.payload).decode() == (html or "") and got.payload_digest == hashlib.sha256((html or "").encode()).hexdigest()
    assert {p: (r.kind, r.to) for p, r in found.items() if p in (1, 2, 3, None)} == {1: ("response", None), 2: ("revisit", "1"), 3: ("revisit", "1"), None: ("revisit", "1")}
    assert found[6].kind == found[7].kind == "response" and (found[9].kind, found[9].to) == ("revisit", "8")
    assert found[1].url == "http://b/ X-Evil: 1" and found[2].url is None
    parsed = warc.parse_records(warc.records(warc.read_archive(spark, str(tmp_path)))).withColumns({"page": warc.field("X-Page-ID"), "kind": warc.field("WARC-Type")}).collect()
    blocks = {r.page: bytes(r.block).decode() for r in parsed}
    assert blocks["11"] == "a\r\n\r\nb" * 30 and blocks["1"] == BIG and blocks["2"] == "" and all(bytes(r.header) in [bytes(x.header) for x in found.values()] for r in parsed)


def test_archive_damage_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", BIG)], "page_id bigint, url string, html string")
    warc.write_archive(spark, pages, f"{tmp_path}/a")
    spark.read.parquet(f"{tmp_path}/a/payloads").withColumn("payload", F.lit(b"other")).write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/headers").write.parquet(f"{tmp_path}/b/headers")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, f"{tmp_path}/b").collect()
    warc.write_archive(spark, pages.limit(0), f"{tmp_path}/c")
    assert warc.read_archive(spark, f"{tmp_path}/c").count() == 0


def test_url_rules(spark):
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("a.example.net/en/x", "block"), ("com", "block"), ("com", "allow"), (None, "block"), ("/x", "block"), ("org/a/b", "block")]
    cases = [("http://EXAMPLE.net/en/x", "example.net/en/", "allow"), ("http://b.a.example.net/en/xyz?q", "a.example.net/en/x", "block"), ("http://example.net", None, "allow"),
             ("http://example.net/", "net/", "block"), ("http://ample.net/en/", "net/", "block"), ("HTTP://x.com", "com", "block"), ("http://xcom/", None, "allow"),
             ("http://o.org/a/bc/d", "org/a/b", "block"), ("http://o.org/a", None, "allow"), ("no scheme", None, "allow"), (None, None, "allow"), ("", None, "allow"),
             ("http://" + "a." * 5000 + "net/" + "b/" * 5000, "net/", "block"), ("x://net/en/?http://example.net/en/", "net/", "block"), ("http://net/\nen", "net/", "block")]
    pages = spark.createDataFrame([(i, c[0], "old") for i, c in enumerate(cases + cases[:2])], "page_id int, url string, VERDICT string")
    frame = spark.createDataFrame(rules, "rule string, action string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlrules.verdicts(pages, frame).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases + cases[:2])}
    assert {r.verdict for r in urlrules.verdicts(pages, frame.limit(0)).collect()} == {"allow"}
    assert urlrules.verdicts(pages.limit(0), frame).count() == 0


def plain_links(rows, cosine=0.9):
    units = {}
    for k, (name, v) in enumerate(rows):
        if name is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            scaled = np.array(v) / max(map(abs, v))
            units[k] = scaled / np.linalg.norm(scaled)
    near = {k: [j for j in units if j != k and len(units[j]) == len(units[k]) and units[k] @ units[j] >= cosine] for k in units}
    top = {}

    def root(k):
        while top.get(k, k) != k:
            k = top[k]
        return k

    for k, js in near.items():
        for j in js:
            a, b = sorted((root(rows[k][0]), root(rows[j][0])))
            top[b] = a
    return [(name, len(near.get(k, [])), root(name) if name is not None else None) for k, (name, _) in enumerate(rows)]


def test_vectors_brute_force(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(300, 16))
    near = base[:120] + draw.normal(size=(120, 16)) * 0.25
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.vstack([base, near, base[:40], 2 * base[:5]]))]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] + [1.0] * 15), (905, [float("inf")] + [1.0] * 15), (906, [1.0, 0.0]), (907, [2.0, 0.1]), (None, [1.0, 0.0]), (908, [1e300] * 16), (909, [1e-300] * 16)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, kept int")
    got = {r.vec_id: (r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(spark, frame, recall=0.999).collect()}
    want = {r[0]: r for r in plain_links(rows)}
    found, total = sum(r[1] for r in got.values()), sum(r[1] for r in want.values())
    assert found >= 0.97 * total and all(got[k][1] <= want[k][1] for k in want)
    assert [got[k] for k in (900, 901, 902, 903, 904, 905, 906, 907, None, 908, 909)] == [want[k] for k in (900, 901, 902, 903, 904, 905, 906, 907, None, 908, 909)]
    assert vectors.near_duplicates(spark, frame.limit(0)).count() == 0
    assert vectors.near_duplicates(spark, frame.where("vec_id = 902")).first().kept


def test_crowded_cells_are_whole(spark, monkeypatch):
    """Blocks of three rows: a cell with many near vectors still gives every pair."""
    monkeypatch.setattr(vectors, "BLOCK", 3)
    monkeypatch.setattr(vectors, "SLICE", 4)
    draw = np.random.default_rng(3)
    rows = [(k, [float(x) for x in np.ones(8) + draw.normal(size=8) * 0.01]) for k in range(40)]
    out = vectors.near_duplicates(spark, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert all(r.n_links == 39 and r.component_id == 0 and r.kept == (r.vec_id == 0) for r in out)


def test_traversal_is_the_multi_sequence_order():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(200, 12))
    grid = vectors.Grid(x / np.linalg.norm(x, axis=1, keepdims=True), 32 * 64, 0.9, 0.9)
    one, two = (vectors.distances(part, code) for part, code in zip(grid.halves(x[:20]), grid.codes))
    sums = (one[:, :, None] + two[:, None, :]).reshape(20, -1)
    seen = np.take_along_axis(sums, grid.traverse(x[:20], 15), 1)
    assert np.allclose(seen, np.sort(sums, axis=1)[:, :15])


TOOL = [("t", json.dumps({"properties": {"b": {"type": "integer"}, "a": {"type": "string", "maxLength": 3}}, "required": ["a"]})), ("t", None), (None, "{}")]


def test_tool_links(spark):
    messages = spark.createDataFrame([(1, 0, "user", "hi\n\"é\"", 9), (1, 1, "robot", None, 9), (1, 1, None, "", 9), (None, None, "user", "x" * 200_000, 9)], "conv_id bigint, turn bigint, role string, text string, status int")
    calls = [(1, 2, "a", "t", '{"b": 1, "a": "x"}', []), (1, 2, "b", "t", '{"a":"long one"}', ["a"]), (1, 2, "c", "t", "{", ["b", "gone"]), (1, 3, "a", "t", '{"a":"y"}', []), (1, 3, "d", "u", "{}", None),
             (1, 3, "e", "t", '{"a":"z"}', ["f"]), (1, 3, "f", "t", '{"a":"z"}', ["e"]), (1, 3, None, "t", None, []), (2, 0, "a", "t", '{"a":"q","b":true}', []), (2, 0, "g", "t", '{"a":"q","b":NaN}', [])]
    results = [(1, "a", "done"), (1, "a", "again"), (1, "zz", "lost"), (1, None, "lost"), (3, "a", None)]
    out = chat.lines(spark, messages, spark.createDataFrame(calls, "conv_id bigint, turn bigint, call_id string, tool string, arguments string, depends_on array<string>"),
                     spark.createDataFrame(results, "conv_id bigint, call_id string, content string"), spark.createDataFrame(TOOL, "tool string, schema string")).collect()
    assert len(out) == 4 + len(calls) + len(results)
    assert all(json.loads(r.line) and json.dumps(json.loads(r.line), ensure_ascii=False, sort_keys=True, separators=(",", ":")) == r.line for r in out)
    called = {(r.conv_id, r.turn, r.call_id): (r.level, r.status, r.fault) for r in out if r.slot == 1}
    assert called == {(1, 2, "a"): (0, "linked", None), (1, 2, "b"): (1, "invalid", "too long: a"), (1, 2, "c"): (2, "invalid", "arguments are no JSON"), (1, 3, "a"): (0, "repeated", None),
                      (1, 3, "d"): (0, "invalid", "unknown tool"), (1, 3, "e"): (None, "circular", None), (1, 3, "f"): (None, "circular", None), (1, 3, None): (0, "invalid", "arguments are no JSON"),
                      (2, 0, "a"): (0, "invalid", "no integer: b"), (2, 0, "g"): (0, "invalid", "arguments are no JSON")}
    told = sorted((r.conv_id, r.call_id or "", json.loads(r.line)["content"], r.status, r.turn if r.turn is not None else -1) for r in out if r.slot == 2)
    assert told == [(1, "", "lost", "orphan", -1), (1, "a", "again", "linked", 2), (1, "a", "done", "repeated", 2), (1, "zz", "lost", "orphan", -1), (3, "a", "", "orphan", -1)]
    assert sorted(r.status for r in out if r.slot == 0) == ["invalid", "invalid", "ok", "ok"]


def test_deep_chain_and_empty(spark):
    chain = [(1, 0, f"c{k}", "t", '{"a":""}', [f"c{k - 1}"] if k else []) for k in range(7)]
    schema = "conv_id bigint, turn bigint, call_id string, tool string, arguments string, depends_on array<string>"
    depth = chat.levels(spark, spark.createDataFrame(chain, schema)).collect()
    assert {r.call_id: r.level for r in depth} == {f"c{k}": k for k in range(7)}
    none = lambda text: spark.createDataFrame([], text)
    assert chat.lines(spark, none("conv_id bigint, turn bigint, role string, text string"), none(schema), none("conv_id bigint, call_id string, content string"), none("tool string, schema string")).count() == 0


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op") and "_" in n and n in entry.oracle_sql() and n[2].isdigit()])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "conversations", "benchmark", "embeddings"):
        db.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    frame = entry.queries()[name](spark, FOLDER)
    answer = db.execute(entry.oracle_sql()[name])
    assert ordered(frame.columns, frame.collect()) == ordered([d[0] for d in answer.description], answer.fetchall())
