"""Chat formatting with linked tool calls (operator 8).

Messages of a conversation become one line of canonical JSON each. Tool calls and their results are
linked by a hash join on the call's identifier, never by looking through a conversation. A call may
name the calls that its arguments depend on; its level is one more than the highest of theirs, found
level by level with joins, so that sorting by (turn, level, identifier) is a topological order. A
call's arguments are checked against the schema of its tool.

A conversation is the run of its lines in the order of ``turn, level, slot, call_id``. The lines stay
rows: a conversation of any length is never brought together in one task.
"""

from __future__ import annotations

import json
import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoload.llm.common import annotate, scratch, truncate_lineage

ROLES = ("system", "user", "assistant", "tool")
KINDS = {"string": str, "integer": int, "number": float, "boolean": bool, "array": list, "object": dict, "null": type(None)}
LONE = re.compile("[\ud800-\udfff]")


def parsed(text: str | None):
    """The value of a JSON text; fails on NaN, infinities and numbers too large for a double."""
    def refuse(name: str):
        raise ValueError(name)

    def real(digits: str) -> float:
        value = float(digits)
        return value if math.isfinite(value) else refuse(digits)

    return json.loads(text or "", parse_constant=refuse, parse_float=real)


def schema_of(text: str | None) -> dict | str | None:
    """A tool's schema from its JSON text: null without a text, a fault where it can't be used."""
    if text is None:
        return None
    try:
        schema = parsed(text)
    except (ValueError, RecursionError):
        return "schema is no JSON"
    if not isinstance(schema, dict):
        return "schema is no object"
    rules = schema.get("properties", {})
    if not isinstance(rules, dict) or not all(isinstance(r, dict) for r in rules.values()):
        return "schema has bad properties"
    required = schema.get("required", [])
    if not isinstance(required, list) or not all(isinstance(n, str) for n in required):
        return "schema has a bad list of required names"
    for name in sorted(rules):
        rule = rules[name]
        kinds = rule.get("type")
        if kinds is not None and not (isinstance(kinds, str) or isinstance(kinds, list) and all(isinstance(k, str) for k in kinds)):
            return f"schema has a bad type: {name}"
        unknown = [k for k in ([kinds] if isinstance(kinds, str) else kinds or []) if k not in KINDS]
        if unknown:
            return f"schema has an unknown type: {name}"
        if "enum" in rule and not isinstance(rule["enum"], list):
            return f"schema has a bad enum: {name}"
        if any(not is_number(rule[k]) for k in ("minimum", "maximum", "maxLength") if k in rule):
            return f"schema has a bad limit: {name}"
    return schema


def is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def is_kind(value, kind: str) -> bool:
    """Whether a value is of a JSON type; a number without a fraction is an integer, however it is written."""
    if kind == "integer":
        return is_number(value) and float(value).is_integer() if not isinstance(value, int) else not isinstance(value, bool)
    if kind == "number":
        return is_number(value)
    return isinstance(value, KINDS[kind])


def fault_of(text: str | None, schema: dict | str | None) -> str | None:
    """What is wrong with a call's arguments under the schema of its tool (see ``schema_of``); null if nothing.

    The schema has ``properties`` (with ``type``, one or a list, ``enum``, ``minimum``, ``maximum``, ``maxLength``),
    ``required`` and ``additionalProperties``. Limits of numbers hold for numbers, ``maxLength`` for texts; other
    values pass them, as in JSON Schema.
    """
    if schema is None:
        return "unknown tool"
    if isinstance(schema, str):
        return schema
    try:
        value = parsed(text)
    except (ValueError, RecursionError):
        return "arguments are no JSON"
    if not isinstance(value, dict):
        return "arguments are no object"
    properties = schema.get("properties", {})
    for name in sorted(schema.get("required", [])):
        if name not in value:
            return f"missing: {name}"
    for name in sorted(value):
        rule = properties.get(name)
        if rule is None:
            if schema.get("additionalProperties", False):
                continue
            return f"unexpected: {name}"
        item, kinds = value[name], rule.get("type")
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if kinds and not any(is_kind(item, kind) for kind in kinds):
            return f"no {' or '.join(kinds)}: {name}"
        if "enum" in rule and not any(type(item) is type(e) and item == e or is_number(item) and is_number(e) and item == e for e in rule["enum"]):
            return f"not allowed: {name}"
        if is_number(item) and ("minimum" in rule and item < rule["minimum"] or "maximum" in rule and item > rule["maximum"]):
            return f"out of range: {name}"
        if isinstance(item, str) and "maxLength" in rule and len(item) > rule["maxLength"]:
            return f"too long: {name}"
    return None


def writable(text: str | None) -> str | None:
    """A text in which surrogates without their partner, which UTF-8 can't hold, are escaped as in JSON."""
    return None if text is None else LONE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys, no spare space and the shortest numbers; other letters as they are, but for lone surrogates."""
    return writable(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False))


def levels(spark: SparkSession, calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)`` of each distinct call; null where calls wait for each other in a circle.

    ``calls`` has ``conv_id call_id depends_on``. Dependencies on calls that aren't there don't count.
    Every round joins the open links with the levels settled in the round before.
    """
    nodes = truncate_lineage(spark, calls.select("conv_id", "call_id").distinct(), "calls")
    links = calls.select("conv_id", "call_id", F.explode("depends_on").alias("needs")).distinct()
    links = truncate_lineage(spark, links.join(nodes.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"]), "needs")
    settled = scratch(spark, "levels")
    waiting = links.select("conv_id", "call_id").distinct()
    nodes.join(waiting, ["conv_id", "call_id"], "left_anti").write.parquet(f"{settled}/level=0")
    level = 0
    while not links.isEmpty():
        last = spark.read.parquet(f"{settled}/level={level}").withColumnRenamed("call_id", "needs")
        rest = truncate_lineage(spark, links.join(last, ["conv_id", "needs"], "left_anti"), "needs")
        free = links.select("conv_id", "call_id").distinct().join(rest.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
        level += 1
        free.write.parquet(f"{settled}/level={level}")
        if spark.read.parquet(f"{settled}/level={level}").isEmpty():
            break  # what is left goes round in circles
        links = rest
    found = [spark.read.schema(nodes.schema).parquet(f"{settled}/level={k}").withColumn("level", F.lit(k)) for k in range(level + 1)]
    return nodes.join(reduce(DataFrame.union, found), ["conv_id", "call_id"], "left")


def lines(spark: SparkSession, messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """``(conv_id, turn, level, slot, call_id, status, fault, line)``: one canonical JSON line per row of the inputs.

    * ``messages``: ``conv_id turn role text``. Slot 0. An unknown or null role gives ``status`` invalid;
      a null text is an empty one.
    * ``calls``: ``conv_id turn call_id tool arguments depends_on``. Slot 1. ``status`` is linked, or
      unanswered without a result, invalid where the arguments break the tool's schema (``fault`` says
      how), repeated for a further call of one identifier, or circular. The line shows the arguments as
      parsed, or as their text if they are no JSON.
    * ``results``: ``conv_id call_id content``. Slot 2, at the turn and level of its call. ``status`` is
      linked, repeated for a result of other content than the smallest, or orphan without a call (turn
      and level null). Rows that are alike in everything have one status.
    * ``schemas``: ``tool schema`` (JSON text); of a tool given twice the smaller text counts.

    Identifiers are compared within a conversation; null ones link with nothing. Of calls with one
    identifier the first by turn, tool and arguments is the call. Arguments and schemas may be any text: what is
    wrong with them is the call's ``fault``. Very long texts are held one batch at a time. Empty tables give no lines; extra
    columns are ignored.
    """
    tools = schemas.where("tool is not null").groupBy("tool").agg(F.min("schema").alias("schema"))
    calls = calls.select("conv_id", "turn", "call_id", "tool", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    # Checked before any shuffle but that of the schemas, which the planner sends along where it finds them small.
    def faults(texts, rules) -> list:
        known: dict[str | None, dict | str | None] = {}
        return [[writable(fault_of(t, known[r] if r in known else known.setdefault(r, schema_of(r)))) for t, r in zip(texts.to_pylist(), rules.to_pylist())]]

    checked = annotate(calls.join(tools, "tool", "left"), ["arguments", "schema"], "fault string", faults)
    checked = truncate_lineage(spark, checked.select("conv_id", "turn", "call_id", "tool", "arguments", "depends_on", "fault"), "checked")
    rank = F.struct(F.col("turn"), F.col("tool"), F.col("arguments"))
    # The first call of an identifier and the number of its results, by partial aggregation.
    first = checked.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(rank).alias("first"), F.count("*").alias("n_calls"))
    answers = results.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min("content").alias("answer"), F.count("*").alias("n_results"))
    depth = levels(spark, checked.where("call_id is not null"))
    linked = truncate_lineage(spark, first.join(depth, ["conv_id", "call_id"], "left").join(answers, ["conv_id", "call_id"], "left"), "linked")

    def rows(df: DataFrame, slot: int, **columns: Column) -> DataFrame:
        made = {"conv_id": F.col("conv_id"), "turn": F.col("turn"), "level": F.lit(0), "slot": F.lit(slot), "call_id": F.lit(None).cast("string"), "fault": F.lit(None).cast("string")} | columns
        return df.select(*[made[c].alias(c) for c in ("conv_id", "turn", "level", "slot", "call_id", "status", "fault", "role", "name", "body")])

    nothing = F.lit(None).cast("string")
    said = rows(messages, 0, status=F.when(F.col("role").isin(*ROLES), "ok").otherwise("invalid"), role=F.col("role"), name=nothing, body=F.coalesce("text", F.lit("")))
    joined = checked.join(linked.select("conv_id", "call_id", "first", "n_calls", "n_results", "level"), ["conv_id", "call_id"], "left")
    is_first = F.col("call_id").isNull() | F.col("first").eqNullSafe(rank)
    status = (F.when(~is_first, "repeated").when(F.col("fault").isNotNull(), "invalid").when(F.col("level").isNull() & F.col("call_id").isNotNull(), "circular")
              .when(F.col("n_results").isNull(), "unanswered").otherwise("linked"))
    called = rows(joined, 1, level=F.when(F.col("call_id").isNull(), 0).otherwise(F.col("level")), call_id=F.col("call_id"), fault=F.col("fault"), status=status, role=F.lit("assistant"), name=F.col("tool"), body=F.col("arguments"))
    told = results.select("conv_id", "call_id", "content").join(linked.select("conv_id", "call_id", F.col("first.turn").alias("turn"), F.col("first.tool").alias("tool"), "level", "answer", "n_results"), ["conv_id", "call_id"], "left")
    status = F.when(F.col("n_results").isNull(), "orphan").when(~F.col("content").eqNullSafe(F.col("answer")), "repeated").otherwise("linked")
    told = rows(told, 2, level=F.col("level"), call_id=F.col("call_id"), status=status, role=F.lit("tool"), name=F.col("tool"), body=F.coalesce("content", F.lit("")))

    def write(slots, ids, roles, names, bodies) -> list:
        out = []
        for slot, call, role, name, body in zip(*(c.to_pylist() for c in (slots, ids, roles, names, bodies))):
            if slot == 1:
                try:
                    shown = canonical(parsed(body))
                except (ValueError, RecursionError):
                    shown = canonical(body)
                out.append('{"role":"assistant","tool_call":{"arguments":' + shown + ',"id":' + canonical(call) + ',"name":' + canonical(name) + "}}")
            elif slot == 2:
                out.append(canonical({"content": body, "role": role, "tool": name, "tool_call_id": call}))
            else:
                out.append(canonical({"content": body, "role": role}))
        return [out]

    every = said.unionByName(called).unionByName(told)
    return annotate(every.select("body", *[c for c in every.columns if c != "body"]), ["slot", "call_id", "role", "name", "body"], "line string", write).select(
        "conv_id", "turn", "level", "slot", "call_id", "status", "fault", "line")
