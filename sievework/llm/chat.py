"""Chat formatting by tool-call linking.

Calls and results are hash-joined by (conversation, identifier). Calls are ordered topologically: a call's step is one more
than the largest step of the calls it comes after, found by joins over all conversations, so no conversation is gathered
in a task. Arguments are checked against the tool's schema, and each call becomes a line of
canonical JSON: keys sorted, no spaces, characters not escaped unless JSON must.

``status`` says what holds, the first that applies: ``cycle`` (no step), ``unknown_tool``, ``bad_json``, ``bad_arguments``,
``no_result``, ``ok``. A result without its call is a row with status ``no_call``. JSON that can't be written again, since a
number is beyond a double or a string holds half a surrogate pair, is ``bad_json``, too.

Defined results: null text is an absent content (JSON null); of calls that share an identifier the earliest by (turn, name,
arguments) counts, of results the earliest by (turn, content); names of calls to come after that don't exist
are ignored; a null conversation id is a conversation of its own; rows without an identifier are left out of linking
and can't be referred to; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import durable, table

TYPES = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}


def of_type(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, int | float) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, TYPES[kind])


def complies(value, schema: dict) -> bool:
    """Whether a value fits a schema (type, enum, required, properties, additionalProperties, items, minimum, maxLength)."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(of_type(value, k) for k in kinds) or "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", ())) or schema.get("additionalProperties") is False and value.keys() - known.keys():
            return False
        return all(complies(v, known[k]) for k, v in value.items() if k in known)
    if isinstance(value, list):
        return all(complies(v, schema.get("items", {})) for v in value)
    if isinstance(value, str):
        return len(value) <= schema.get("maxLength", len(value))
    return not of_type(value, "number") or value >= schema.get("minimum", value)


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def refuse(name: str):
    raise ValueError(name)


def written(schemas: dict[str, str]):
    """Check the arguments and serialise, row by row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {name: json.loads(s) for name, s in schemas.items()}
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                arguments, status = None, "ok"
                try:
                    arguments = json.loads(r.arguments, parse_constant=refuse) if isinstance(r.arguments, str) else refuse("null")
                    canonical(arguments).encode()
                except (ValueError, RecursionError):
                    arguments, status = None, "bad_json"
                step = None if pd.isna(r.step) else int(r.step)
                if step is None:
                    status = "cycle"
                elif r.name not in known:
                    status = "unknown_tool"
                elif status == "ok" and not complies(arguments, known[r.name]):
                    status = "bad_arguments"
                elif status == "ok" and not r.has_result:
                    status = "no_result"
                line = {"arguments": arguments, "call_id": r.call_id, "name": r.name, "result": r.content, "status": status, "step": step, "turn": None if r.turn is None else int(r.turn)}
                out.append((status, canonical(line)))
            yield batch[["conv_id", "call_id", "turn", "step"]].reset_index(drop=True).join(pd.DataFrame(out, columns=["status", "json"]))

    return run


def steps(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, step) of calls with ``after``, the identifiers of calls that come first; calls on cycles are absent.

    Calls that wait for one other call jump along their chain, twice as far each round, to the first call that waits for
    none or for several; so a chain of any length takes few rounds. Calls that wait for several are then resolved in
    rounds of their own.
    """
    ck = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("ck")
    names = calls.select(ck, "conv_id", "call_id")
    there = names.select("ck", F.col("call_id").alias("before"))
    edges = calls.select(ck, "call_id", F.explode(F.array_distinct("after")).alias("before")).join(there, ["ck", "before"], "left_semi")
    edges = durable(edges.select("ck", "call_id", "before"))
    waits = durable(edges.groupBy("ck", "call_id").agg(F.count("*").alias("n"), F.min("before").alias("to")))
    one = waits.filter("n = 1").select("ck", "call_id", "to")
    jump = one.join(one.select("ck", F.col("call_id").alias("to"), F.lit(False).alias("end")), ["ck", "to"], "left")
    jump = durable(jump.select("ck", "call_id", "to", F.lit(1).alias("far"), F.coalesce("end", F.lit(True)).alias("end")))
    left = jump.filter("NOT end").count()
    while left:
        next_ = jump.select("ck", F.col("call_id").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"), F.col("end").alias("end2"))
        jump = jump.join(next_, ["ck", "to"], "left")
        jump = durable(jump.select("ck", "call_id", F.coalesce("to2", "to").alias("to"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.coalesce("end2", "end").alias("end")))
        before, left = left, jump.filter("NOT end").count()
        if left == before:  # what is left lies on cycles or leads to one
            break
    front = durable(names.join(waits, ["ck", "call_id"], "left_anti").select("ck", "call_id", F.lit(0).alias("step")))
    several = edges.join(waits.filter("n > 1").select("ck", "call_id"), ["ck", "call_id"], "left_semi")
    along = jump.select("ck", F.col("call_id").alias("before"), "to", "far")
    pending = several.join(along, ["ck", "before"], "left").select("ck", "call_id", F.coalesce("to", "before").alias("before"), (F.coalesce("far", F.lit(0)) + 1).alias("far"), F.lit(None).cast("int").alias("got"))
    pending, found = durable(pending), front
    while not front.isEmpty() and not pending.isEmpty():
        pending = pending.join(front.select("ck", F.col("call_id").alias("before"), "step"), ["ck", "before"], "left")
        pending = durable(pending.select("ck", "call_id", "before", "far", F.coalesce("got", F.col("step") + F.col("far")).alias("got")))
        front = durable(pending.groupBy("ck", "call_id").agg(F.max("got").alias("step"), F.count("got").alias("n"), F.count("*").alias("all")).filter("n = all").select("ck", "call_id", "step"))
        pending, found = pending.join(front, ["ck", "call_id"], "left_anti"), found.unionByName(front)
    chained = jump.filter("end").join(found.select("ck", F.col("call_id").alias("to"), "step"), ["ck", "to"]).select("ck", "call_id", (F.col("step") + F.col("far")).alias("step"))
    return found.unionByName(chained).join(names, ["ck", "call_id"]).select("conv_id", "call_id", "step")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """One line per call, and one per result without a call.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON), after (array); ``results``: conv_id, call_id, turn, content.
    ``schemas``: tool name to JSON schema; a bounded catalogue, not data.
    """
    first = lambda *c: F.min_by(F.struct(*c), F.struct(*c))
    calls = calls.filter("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(first("turn", "name", "arguments", "after").alias("r")).select("conv_id", "call_id", "r.*")
    results = results.filter("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(first("turn", "content").alias("r")).select(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"), F.col("r.turn").alias("rt"), F.col("r.content").alias("content"), F.lit(True).alias("has_result"))
    calls = durable(calls)
    level = steps(calls).select(F.col("conv_id").alias("sc"), F.col("call_id").alias("si"), "step")
    linked = calls.join(level, F.col("conv_id").eqNullSafe(F.col("sc")) & (F.col("call_id") == F.col("si")), "left")
    linked = linked.join(results, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("ri")), "left")
    shown = linked.select("conv_id", "call_id", "turn", "step", "name", "arguments", "content", F.coalesce("has_result", F.lit(False)).alias("has_result"))
    # Numbers that may be null travel as text, which pandas doesn't round.
    shown = shown.withColumns({c: F.col(c).cast("string") for c in ("conv_id", "turn")})
    lines = shown.mapInPandas(written(schemas), "conv_id string, call_id string, turn string, step int, status string, json string")
    lines = lines.withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")})
    lone = results.join(calls, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("ri")), "left_anti")
    lone = lone.select(F.col("rc").alias("conv_id"), F.col("ri").alias("call_id"), F.col("rt").alias("turn"), F.lit(None).cast("int").alias("step"), F.lit("no_call").alias("status"), F.lit(None).cast("string").alias("json"))
    return lines.unionByName(lone)


SCHEMAS = {
    "search": '{"type":"object","required":["query","turn"],"properties":{"query":{"type":"string"},"turn":{"type":"integer","minimum":0}},"additionalProperties":false}',
    "lookup": '{"type":"object","required":["query"],"properties":{"query":{"type":"string","maxLength":400}}}',
}


def as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations read as tool use: a user's turn calls a tool, the assistant's next turn is its result.

    Every call comes after the one two turns before it; a user's turn without a number waits for none and has no result. Conversations whose id leaves 3 modulo 7 send the turn as text.
    """
    name = lambda turn: F.substring(F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))), 1, 16)
    turn = F.when(F.col("conv_id") % 7 == 3, F.to_json(F.struct(F.col("text").alias("query"), F.col("turn").cast("string").alias("turn")))).otherwise(F.to_json(F.struct(F.col("text").alias("query"), "turn")))
    calls = conversations.filter("role = 'user'").select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn", F.when(F.col("turn") % 2 == 0, "search").otherwise("lookup").alias("name"), turn.alias("arguments"), F.when(F.col("turn").isNotNull(), F.array(name(F.col("turn") - 2))).alias("after")
    )
    results = conversations.filter("role = 'assistant' AND turn IS NOT NULL").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op9_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call of the conversations with its result, step and canonical JSON."""
    calls, results = as_calls(table(spark, sf_dir, "conversations"))
    return link_calls(calls, results, SCHEMAS)


CHAT_SQL = """
WITH RECURSIVE c AS (SELECT conv_id, turn, text, substr(md5(conv_id || ':' || turn), 1, 16) AS call_id,
              CASE WHEN turn % 2 = 0 THEN 'search' ELSE 'lookup' END AS name FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn, text AS content, substr(md5(conv_id || ':' || (turn - 1)), 1, 16) AS call_id FROM conversations WHERE role = 'assistant'),
s AS (SELECT conv_id, turn, 0 AS step FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
      UNION ALL SELECT c.conv_id, c.turn, s.step + 1 FROM c JOIN s ON c.conv_id = s.conv_id AND c.turn = s.turn + 2),
l AS (SELECT c.*, s.step, r.content, r.call_id IS NOT NULL AS has_result,
             CASE WHEN name = 'search' AND c.conv_id % 7 = 3 OR name = 'lookup' AND length(c.text) > 400 THEN 'bad_arguments'
                  WHEN r.call_id IS NULL THEN 'no_result' ELSE 'ok' END AS status
      FROM c JOIN s USING (conv_id, turn) LEFT JOIN r ON r.conv_id = c.conv_id AND r.call_id = c.call_id)
SELECT conv_id, call_id, turn, step, status,
       CAST(json_object('arguments', CASE WHEN conv_id % 7 = 3 THEN json_object('query', text, 'turn', CAST(turn AS VARCHAR)) ELSE json_object('query', text, 'turn', turn) END,
                        'call_id', call_id, 'name', name, 'result', content, 'status', status, 'step', step, 'turn', turn) AS VARCHAR) AS json
FROM l
UNION ALL
SELECT r.conv_id, r.call_id, r.turn, CAST(NULL AS INTEGER), 'no_call', CAST(NULL AS VARCHAR) FROM r
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
"""
