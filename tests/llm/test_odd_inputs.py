"""Arguments, schemas and records of any make: each has its fault or fails with a reason."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartoload.llm import chat, common, vectors, warc


@pytest.mark.parametrize("arguments,schema,fault", [
    ('{"a":"\\ud800"}', '{"properties":{"a":{"type":"string"}}}', None),
    ('{"a":1}', '{"properties":{"a":{"type":["string","null"]}}}', "no string or null: a"),
    ('{"a":null}', '{"properties":{"a":{"type":"null"}}}', None),
    ('{"a":"x"}', '{"properties":{"a":{"minimum":3}}}', None),
    ('{"a":5}', '{"properties":{"a":{"maxLength":3}}}', None),
    ('{"a":1}', "{no json", "schema is no JSON"), ('{"a":1}', "[1]", "schema is no object"), ('{"a":1}', '{"properties":{"a":{"type":"uuid"}}}', "schema has an unknown type: a"),
    ('{"a":1}', '{"properties":{"a":{"type":7}}}', "schema has a bad type: a"), ('{"a":1}', '{"properties":{"a":{"minimum":"1"}}}', "schema has a bad limit: a"),
    ('{"a":1}', '{"properties":[1]}', "schema has bad properties"), ('{"a":1}', '{"required":[1]}', "schema has a bad list of required names"), ('{"a":1}', '{"properties":{"a":{"enum":3}}}', "schema has a bad enum: a"),
    ('{"a":1.0}', '{"properties":{"a":{"type":"integer"}}}', None), ('{"a":1.5}', '{"properties":{"a":{"type":"integer"}}}', "no integer: a"), ('{"a":true}', '{"properties":{"a":{"type":"integer"}}}', "no integer: a"),
    ('{"a":1e999}', '{"properties":{"a":{"type":"number"}}}', "arguments are no JSON"), ("[" * 100_000, '{"properties":{}}', "arguments are no JSON"), ('{"a":true}', '{"properties":{"a":{"enum":[1]}}}', "not allowed: a"),
    (None, '{"properties":{}}', "arguments are no JSON"), ('{"a":9}', '{"properties":{"a":{"type":"integer","maximum":8}}}', "out of range: a")])
def test_faults(arguments, schema, fault):
    assert chat.fault_of(arguments, chat.schema_of(schema)) == fault


def test_odd_calls_are_lines(spark):
    arguments = ['{"a":"\\ud800"}', '{"\\udfff":1}', '{"a":1e999}', "{", None, '{"a":"' + "x" * 300_000 + '"}']
    calls = spark.createDataFrame([(1, k, f"c{k}", "t" if k % 2 else "bad", a, None) for k, a in enumerate(arguments)], "conv_id bigint, turn int, call_id string, tool string, arguments string, depends_on array<string>")
    none = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    results = spark.createDataFrame([], "conv_id bigint, call_id string, content string")
    schemas = spark.createDataFrame([("t", '{"additionalProperties":true}'), ("bad", "nothing")], "tool string, schema string")
    rows = {r.turn: r for r in chat.lines(spark, none, calls, results, schemas).collect()}
    assert [rows[k].fault for k in range(6)] == ["schema is no JSON", None, "schema is no JSON", "arguments are no JSON", "schema is no JSON", None]
    assert json.loads(rows[0].line)["tool_call"]["arguments"] == {"a": "\ud800"} and json.loads(rows[1].line)["tool_call"]["arguments"] == {"\udfff": 1}
    assert json.loads(rows[2].line)["tool_call"]["arguments"] == '{"a":1e999}' and len(rows[5].line) > 300_000


def test_long_headers_and_broken_records(spark):
    folder = warc.__name__ and spark.conf.get("spark.checkpoint.dir") + "/odd-archive"
    url = "http://example.org/" + "u" * 70_000
    pages = spark.createDataFrame([(1, url, "body of a page " * 20), (2, None, None)], "page_id bigint, url string, html string")
    warc.write_archive(spark, pages, folder)
    back = {r.header.count(b"u") > 60_000: r for r in warc.parse_records(warc.records(warc.read_archive(spark, folder))).collect()}
    assert url.encode() in back[True].header and bytes(back[True].block) == b"body of a page " * 20 and bytes(back[False].block) == b""
    for raw, reason in ((b"WARC/1.1\r\nContent-Length: 0\r\n", "no empty line"), (b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort", "shorter than it states")):
        with pytest.raises(Exception, match=reason):
            warc.parse_records(spark.createDataFrame([(bytearray(raw),)], "record binary")).collect()


def test_cells_are_visited_until_the_target_is_met():
    import numpy as np

    draw = np.random.default_rng(2)
    x = draw.normal(size=(3000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    grid = vectors.Grid(x, 40_000_000, 0.9, 0.97)
    assert grid.k == vectors.MOST_CODEWORDS and grid.visits > 256
    small = vectors.Grid(x[:400], 100, 0.9, 1.0)
    assert small.visits <= small.k ** 2


def test_workers_get_texts_in_small_batches(spark):
    docs = spark.range(0, 3_000, 1, 1).select("id", F.repeat(F.lit("word "), 1_000).alias("text"))
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"rows": pa.array([b.num_rows], pa.int64()), "size": pa.array([b.nbytes], pa.int64())}) for b in batches)
    found = common.map_arrow(docs, "rows bigint, size bigint", sizes).collect()
    assert sum(r.rows for r in found) == 3_000 and max(r.size for r in found) <= common.BATCH_BYTES + 100_000
    lengths = common.annotate(docs, ["text"], "n bigint", lambda texts: [[len(texts)] * len(texts)])
    assert lengths.count() == 3_000 and lengths.agg(F.max("n")).first()[0] <= 1_000
