"""Chat formatting: tool-call linking.

Calls and results meet by (conversation, call id) in one hash join with pre-aggregated peers, so that repeated ids
never multiply rows. Calls name the calls they depend on; where all of those are earlier turns the turn order is a
topological order already, and only conversations in which one is not are ordered by what they wait for. Arguments are held
against the tool's schema, and every turn becomes one canonical JSON object (sorted keys, no blanks).
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from drawlake.llm.common import materialize, table

#: Depth of arrays and objects that arguments may have.
DEEPEST = 64
#: Calls of a conversation that one task orders; larger conversations are ordered wave by wave.
CONVERSATION = 100_000
_TYPES = {"string": str, "integer": (int, float), "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
_ANNOTATIONS = {"$schema", "$id", "title", "description", "default", "examples"}
_KEYWORDS = {"type", "enum", "const", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "anyOf", "oneOf", "allOf", "not"}


def check_schema(schema: dict | bool) -> None:
    """ValueError for a schema that ``valid`` does not understand in full: an unknown keyword or type, or a pattern that is none."""
    if isinstance(schema, bool):
        return
    if unknown := set(schema) - _KEYWORDS - _ANNOTATIONS:
        raise ValueError(f"unknown keywords in a tool's schema: {sorted(unknown)}")
    kinds = schema.get("type", [])
    if unknown := set([kinds] if isinstance(kinds, str) else kinds) - set(_TYPES):
        raise ValueError(f"unknown types in a tool's schema: {sorted(unknown)}")
    try:
        re.compile(schema.get("pattern", ""))
    except re.error as e:
        raise ValueError(f"not a pattern: {schema['pattern']!r}") from e
    parts = [*schema.get("properties", {}).values(), *schema.get("anyOf", ()), *schema.get("oneOf", ()), *schema.get("allOf", ())]
    for part in [*parts, *(schema[k] for k in ("items", "additionalProperties", "not") if k in schema)]:
        check_schema(part)


def _same(a, b) -> bool:
    """Equality of JSON values: numbers by value, and true is no number."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    return a == b


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number") and isinstance(value, bool):
        return False
    return isinstance(value, _TYPES[kind]) and (kind != "integer" or value == int(value))


def valid(value, schema: dict | bool) -> bool:
    """A value under the part of JSON Schema that ``check_schema`` accepts."""
    if isinstance(schema, bool):
        return schema
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return False
    if "enum" in schema and not any(_same(value, v) for v in schema["enum"]) or "const" in schema and not _same(value, schema["const"]):
        return False
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)) or "pattern" in schema and not re.search(schema["pattern"], value):
            return False
    elif _is(value, "number"):
        if not schema.get("minimum", value) <= value <= schema.get("maximum", value) or "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"] or "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]:
            return False
    elif isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)) or not all(valid(v, schema.get("items", True)) for v in value):
            return False
    elif isinstance(value, dict):
        own, rest = schema.get("properties", {}), schema.get("additionalProperties", True)
        if any(k not in value for k in schema.get("required", ())) or not all(valid(v, own.get(k, rest)) for k, v in value.items()):
            return False
    if not all(valid(value, s) for s in schema.get("allOf", ())) or "anyOf" in schema and not any(valid(value, s) for s in schema["anyOf"]):
        return False
    return ("oneOf" not in schema or sum(valid(value, s) for s in schema["oneOf"]) == 1) and ("not" not in schema or not valid(value, schema["not"]))


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


_MARK = re.compile(r'"(?:[^"\\]|\\.)*+"|[\[{\]}]', re.S)


def _no_number(text: str):
    raise ValueError(text)


def _finite(text: str) -> float:
    number = float(text)
    return number if math.isfinite(number) else _no_number(text)


def _parsed(text: str | None):
    """``(value, True)``, or ``(None, False)`` for what is no JSON text, goes too deep, or holds what no JSON text in UTF-8 can: NaN, infinities, lone surrogates."""
    depth = 0
    for m in _MARK.finditer(text or ""):
        depth += (m[0] in "[{") - (m[0] in "]}")
        if depth > DEEPEST:
            return None, False
    try:
        value = json.loads(text, parse_constant=_no_number, parse_float=_finite)
        canonical(value).encode()
    except (TypeError, ValueError):  # UnicodeEncodeError is a ValueError
        return None, False
    return value, True


def _serialise(schemas: dict[str, dict]):
    def f(kind: pd.Series, role: pd.Series, call_id: pd.Series, name: pd.Series, arguments: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for k, r, c, n, a, t in zip(kind, role, call_id, name, arguments, content, strict=True):
            if k == "call":
                args, there = _parsed(a)
                ok = there and n in schemas and valid(args, schemas[n])
                rows.append((ok, canonical({"role": r, "tool_call": {"arguments": args if there else a, "id": c, "name": n}})))
            else:
                body = {"content": t, "role": r}
                rows.append((None, canonical(body | ({"tool_call_id": c} if k == "result" else {}))))
        return pd.DataFrame(rows, columns=["args_valid", "json"])

    return f


def _ordered(links: list[tuple]) -> list[tuple]:
    """``(call, parent it waits for or None)`` of one conversation -> ``(call, wave)``; calls on a cycle or behind one are missing."""
    waits: dict = {}
    for call, parent in links:
        waits.setdefault(call, set())
        if parent is not None:
            waits[call].add(parent)
    behind: dict = {}
    for call, parents in waits.items():
        for p in parents:
            behind.setdefault(p, []).append(call)
    left = {call: len(parents) for call, parents in waits.items()}
    done, ready, wave = [], [call for call, n in left.items() if n == 0], 0
    while ready:
        done += [(call, wave) for call in ready]
        after = []
        for call in ready:
            for b in behind.get(call, ()):
                left[b] -= 1
                if left[b] == 0:
                    after.append(b)
        ready, wave = after, wave + 1
    return done


def _ordered_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links sorted by conversation -> ``conv_id, call_id, wave``; one conversation's links are held at a time."""
    conv, links, schema = None, [], None

    def rows(found):
        columns = [list(c) for c in zip(*found, strict=True)] or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        schema = pa.schema([batch.schema.field("conv_id"), batch.schema.field("call_id"), pa.field("wave", pa.int32())])
        found = []
        for c, call, parent in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "call_id", "parent")], strict=True):
            if c != conv:
                found += [(conv, x, w) for x, w in _ordered(links)]
                conv, links = c, []
            links.append((call, parent))
        yield rows(found)
    if links:
        yield rows([(conv, x, w) for x, w in _ordered(links)])


def _waves(nodes: DataFrame, edges: DataFrame, most: int = CONVERSATION) -> DataFrame:
    """``conv_id, call_id, wave``: 0 for calls that wait for none, else one more than the last they wait for; those on a cycle, or behind one, are missing.

    Links are a stream sorted by conversation; one of up to ``most`` calls and links is held and ordered in its task. Larger ones go wave by wave, in joins whose
    rounds are as many as the longest chain of the largest conversations; the result is the same.
    """
    links = nodes.distinct().withColumn("parent", F.lit(None).cast(nodes.schema["call_id"].dataType)).unionByName(edges.select("conv_id", "call_id", "parent"))
    links = materialize(links, "tool-links")
    large = links.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("conv_id")
    large = materialize(large, "large-conversations")
    schema = f"conv_id {dict(nodes.dtypes)['conv_id']}, call_id {dict(nodes.dtypes)['call_id']}, wave int"
    small = links.join(large, "conv_id", "left_anti").select("conv_id", "call_id", "parent")
    done = small.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(_ordered_stream, schema)
    if large.isEmpty():
        return done
    links = links.join(large, "conv_id", "left_semi")
    edges = materialize(links.where("parent IS NOT NULL"), "tool-links")
    left, wave = materialize(links.select("conv_id", "call_id").distinct(), "calls"), 0
    while True:
        waiting = edges.join(left.select("conv_id", F.col("call_id").alias("parent")), ["conv_id", "parent"], "left_semi").select("conv_id", "call_id").distinct()
        ready = materialize(left.join(waiting, ["conv_id", "call_id"], "left_anti").withColumn("wave", F.lit(wave)), "ready")
        if ready.isEmpty():
            return done
        done = done.unionByName(ready)
        left = materialize(left.join(ready, ["conv_id", "call_id"], "left_anti"), "calls")
        wave += 1


def link_tool_calls(turns: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Turns ``conv_id, turn, role, kind, call_id, name, arguments, parents, content`` -> one row for each turn.

    kind is ``call`` (arguments: JSON text; parents: call ids of the conversation it waits for), ``result`` or
    ``message``. Out come ``conv_id, turn, role, kind, call_id, status, result_turn, wave, args_valid, json``:
    status is answered or unanswered for calls, linked or orphan for results, message else; result_turn is the
    first result's turn; wave orders a conversation's calls before their turn does (0 where turns already do, null on
    a cycle). A null or repeated id: rows stay as they are, a null id links with nothing, and repeated ids share
    their first result. Not valid, and kept as the raw text, are arguments that are no JSON, nest deeper than DEEPEST, or
    hold NaN, an infinity or a lone surrogate; unknown tools are not valid either. Of a repeated key the last value
    counts. A schema with a keyword or type that is not understood is refused (ValueError). Long texts and repeated rows
    stay as they are; an empty table gives an empty result. Other columns are ignored.
    """
    for schema in schemas.values():
        check_schema(schema)
    t = turns.select("conv_id", "turn", "role", "kind", "call_id", "name", "arguments", "parents", "content")
    peers = (
        t.where("call_id IS NOT NULL AND kind IN ('call', 'result')")
        .groupBy("conv_id", "call_id")
        .agg(F.min(F.when(F.col("kind") == "call", F.col("turn"))).alias("call_turn"), F.min(F.when(F.col("kind") == "result", F.col("turn"))).alias("result_turn"), F.max(F.col("kind") == "call").alias("has_call"), F.max(F.col("kind") == "result").alias("has_result"))
    )
    peers = materialize(peers, "peers")  # so that the join can split the turns of a frequent id
    edges = t.where("kind = 'call' AND call_id IS NOT NULL").select("conv_id", "call_id", "turn", F.explode("parents").alias("parent"))
    known = peers.where("has_call").select("conv_id", F.col("call_id").alias("parent"), F.col("call_turn").alias("parent_turn"))
    edges = edges.join(known, ["conv_id", "parent"])
    against = edges.where("parent_turn >= turn OR turn IS NULL OR parent_turn IS NULL").select("conv_id").distinct()
    linked = t.join(peers, ["conv_id", "call_id"], "left")
    if against.isEmpty():
        linked = linked.withColumn("wave", F.when(F.col("kind") == "call", F.lit(0)))
    else:
        against = materialize(against, "convs")
        nodes = peers.where("has_call").select("conv_id", "call_id").join(against, "conv_id", "left_semi")
        waves = _waves(nodes, edges.join(against, "conv_id", "left_semi").select("conv_id", "call_id", "parent"))
        linked = linked.join(waves, ["conv_id", "call_id"], "left").join(against.withColumn("loose", F.lit(True)), "conv_id", "left")
        linked = linked.withColumn("wave", F.when((F.col("kind") == "call") & (F.col("loose").isNull() | F.col("call_id").isNull()), F.lit(0)).when(F.col("kind") == "call", F.col("wave")))
    status = (
        F.when(F.col("kind") == "call", F.when(F.col("has_result"), F.lit("answered")).otherwise(F.lit("unanswered")))
        .when(F.col("kind") == "result", F.when(F.col("has_call"), F.lit("linked")).otherwise(F.lit("orphan")))
        .otherwise(F.lit("message"))
    )
    made = pandas_udf(_serialise(schemas), "struct<args_valid:boolean,json:string>")(*map(F.col, ("kind", "role", "call_id", "name", "arguments", "content")))
    return linked.select("conv_id", "turn", "role", "kind", "call_id", status.alias("status"), F.when(F.col("kind") == "call", F.col("result_turn")).alias("result_turn"), F.col("wave").cast("int").alias("wave"), made.alias("made")).select("conv_id", "turn", "role", "kind", "call_id", "status", "result_turn", "wave", "made.*")


def tool_turns(conversations: DataFrame) -> DataFrame:
    """Turns of a chat log as ``link_tool_calls`` takes them.

    A user's turn is a call of the tool ``respond``; the assistant's next turn is its result. A call of an odd number of
    characters waits for the user's next turn, one of a multiple of seven for the last, so that calls come out of order
    and on cycles. Everything else is a message.
    """
    call_of = lambda turn: F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string")))
    turn = F.col("turn")
    kind = F.when(F.col("conv_id").isNull() | turn.isNull(), F.lit("message")).when(F.col("role") == "user", F.lit("call")).when(F.col("role") == "assistant", F.lit("result")).otherwise(F.lit("message"))
    text = F.coalesce(F.col("text"), F.lit(""))
    waits = F.array_compact(F.array(F.when(F.length(text) % 2 == 1, call_of(turn + 2)), F.when(F.length(text) % 7 == 0, call_of(turn - 2))))
    return conversations.select("conv_id", "turn", "role", "text").withColumn("kind", kind).select(
        "conv_id", "turn", "role", "kind",
        F.when(F.col("kind") == "call", call_of(turn)).when(F.col("kind") == "result", call_of(turn - 1)).alias("call_id"),
        F.when(F.col("kind") == "call", F.lit("respond")).alias("name"),
        F.when(F.col("kind") == "call", F.to_json(F.struct(text.alias("prompt"), turn.alias("turn")))).alias("arguments"),
        F.when(F.col("kind") == "call", waits).alias("parents"),
        text.alias("content"),
    )


#: The schema of the tool above.
SCHEMAS = {"respond": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 1000}, "turn": {"type": "integer", "minimum": 0}}}}


def op5_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(tool_turns(table(spark, sf_dir, "conversations")), SCHEMAS)


SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text,
  CASE WHEN conv_id IS NULL OR turn IS NULL THEN 'message' WHEN role = 'user' THEN 'call' WHEN role = 'assistant' THEN 'result' ELSE 'message' END AS kind FROM conversations),
c AS (SELECT *, CASE kind WHEN 'call' THEN md5(conv_id || ':' || turn) WHEN 'result' THEN md5(conv_id || ':' || (turn - 1)) END AS call_id FROM t),
p AS (SELECT call_id, bool_or(kind = 'call') AS has_call, bool_or(kind = 'result') AS has_result, min(CASE WHEN kind = 'result' THEN turn END) AS result_turn
      FROM c WHERE call_id IS NOT NULL GROUP BY call_id),
k AS (SELECT DISTINCT conv_id, call_id, turn, length(text) AS n FROM c WHERE kind = 'call'),
e AS (SELECT a.conv_id, a.call_id, b.call_id AS parent, b.turn >= a.turn AS late FROM k a JOIN k b ON a.conv_id = b.conv_id AND (a.n % 2 = 1 AND b.turn = a.turn + 2 OR a.n % 7 = 0 AND b.turn = a.turn - 2)),
m AS (SELECT conv_id, count(DISTINCT call_id) AS calls FROM k GROUP BY conv_id),
r AS (SELECT conv_id, call_id, 0 AS d FROM k UNION SELECT e.conv_id, e.call_id, r.d + 1 FROM r JOIN e ON r.conv_id = e.conv_id AND r.call_id = e.parent JOIN m ON m.conv_id = e.conv_id WHERE r.d < m.calls),
w AS (SELECT r.conv_id, r.call_id, CASE WHEN max(d) < max(m.calls) THEN max(d) END AS wave FROM r JOIN m USING (conv_id) GROUP BY ALL),
o AS (SELECT DISTINCT conv_id FROM e WHERE late)
SELECT c.conv_id, turn, role, kind, c.call_id,
  CASE kind WHEN 'call' THEN CASE WHEN has_result THEN 'answered' ELSE 'unanswered' END WHEN 'result' THEN CASE WHEN has_call THEN 'linked' ELSE 'orphan' END ELSE 'message' END AS status,
  CASE WHEN kind = 'call' THEN p.result_turn END AS result_turn,
  CASE WHEN kind = 'call' THEN CASE WHEN o.conv_id IS NULL THEN 0 ELSE w.wave END END AS wave,
  CASE WHEN kind = 'call' THEN length(text) BETWEEN 1 AND 1000 AND turn >= 0 END AS args_valid,
  CASE WHEN kind = 'call' THEN '{"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"tool_call":{"arguments":{"prompt":' || to_json(text)::VARCHAR || ',"turn":' || turn || '},"id":"' || c.call_id || '","name":"respond"}}'
       ELSE '{"content":' || to_json(text)::VARCHAR || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || CASE WHEN kind = 'result' THEN ',"tool_call_id":"' || c.call_id || '"' ELSE '' END || '}' END AS json
FROM c LEFT JOIN p USING (call_id) LEFT JOIN w ON w.conv_id = c.conv_id AND w.call_id = c.call_id LEFT JOIN o ON o.conv_id = c.conv_id
"""
