"""Linking of tool calls to their results in conversations.

Calls and results are hash-joined by conversation and identifier. Calls are
ordered topologically by the calls that they depend on, their arguments are
validated against the tools' schemas, and each is serialised as canonical JSON:
sorted keys, no spaces, no escapes but those JSON needs.

An identifier that several calls (or results) have is one row; its first call
and first result by position, then text, count, and n_calls and n_results tell
how many there were. All groups are aggregated before they are moved, so a
conversation or identifier of a third of all rows does no harm. Results without
a call are rows of status "orphan", calls without one "no_result". Null
identifiers or conversations link with nothing and are left out of the calls
that others may depend on; they are rows of status "no_id", one for each
different position and text.

Calls are ordered topologically: by level, 0 without dependencies and else one
more than the highest of these, then by position. Those on a cycle, or after
one, come last with level -1. Dependencies that name no call of the conversation
are dropped from the order and reported. Conversations of up to `AT_ONCE`
dependencies are levelled in one go, longer ones level by level over all tasks.

Arguments that are no JSON (NaN and infinite numbers, or nested too deep, are
none), and types that no schema can have, are errors of their call. Halves of
surrogate pairs are written as U+FFFD.
"""

from __future__ import annotations

import json
import math
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jambwork.llm.common import arrow_map, stored, table
from jambwork.llm.mixing import _running

AT_ONCE = 100_000
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value by a JSON schema's type, enum, required, properties, additionalProperties, items, minLength and minimum."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    fits = lambda k: isinstance(value, TYPES.get(k, ())) and not (isinstance(value, bool) and k in ("integer", "number"))
    if kinds and not any(map(fits, kinds)):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = [f"{at}: not one of the enum"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        out += [f"{at}.{k}: unknown" for k in sorted(value) if k not in own] if schema.get("additionalProperties") is False else []
        for k in sorted(value):
            out += problems(value[k], own[k], f"{at}.{k}") if k in own else []
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += problems(x, schema["items"], f"{at}[{i}]")
    out += [f"{at}: too short"] if isinstance(value, str) and len(value) < schema.get("minLength", 0) else []
    if isinstance(value, (int, float)) and not isinstance(value, bool) and "minimum" in schema and value < schema["minimum"]:
        out.append(f"{at}: too small")
    return out


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _number(text: str) -> float:
    if not math.isfinite(x := float(text)):
        raise ValueError(text)
    return x


def _no_constant(text: str):
    raise ValueError(text)


#: Lists and objects within one another that arguments may have; far below what can be written again within a call.
MOST_DEEP = 200


def _deep(value) -> bool:
    """Whether a value is nested deeper than allowed."""
    level = [value]
    for _ in range(MOST_DEEP):
        level = [y for x in level if isinstance(x, (list, dict)) for y in (x.values() if isinstance(x, dict) else x)]
        if not level:
            return False
    return any(isinstance(x, (list, dict)) for x in level)


def parsed(text: str):
    """The value of a JSON text that can be written again, nested at most MOST_DEEP deep; else a ValueError."""
    try:
        value = json.loads(text, parse_float=_number, parse_constant=_no_constant)
    except RecursionError as e:
        raise ValueError("nested too deep") from e
    if _deep(value):
        raise ValueError("nested too deep")
    canonical(value)
    return value


def ordered(on: dict[str, list[str]]) -> dict[str, int]:
    """The level of each call that depends on others (those that only others depend on have 0), -1 on or after cycles."""
    wait, after = {}, {}
    for call, needs in on.items():
        wait[call] = len(needs)
        for x in needs:
            after.setdefault(x, []).append(call)
    level = {x: 0 for x in after if x not in wait}
    ready = deque(level)
    while ready:
        x = ready.popleft()
        for call in after.get(x, ()):
            wait[call] -= 1
            level[call] = max(level.get(call, 0), level[x] + 1)
            if not wait[call]:
                ready.append(call)
    return {call: -1 if wait[call] else level[call] for call in on}


def levels(edges: DataFrame) -> DataFrame:
    """conv_id, call_id, level of the calls that depend on others, by edges (conv_id, call_id, on)."""
    size = edges.groupBy("conv_id").count()
    long = stored(size.where(F.col("count") > AT_ONCE).select("conv_id"))
    each = edges.join(long, "conv_id", "left_anti").groupBy("conv_id", "call_id").agg(F.collect_list("on").alias("on"))

    def run(batches):
        now, held = None, {}
        for batch in batches:
            out = []
            for conv, call, on in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "call_id", "on")), strict=True):
                if conv != now:
                    out += [(now, *x) for x in ordered(held).items()]
                    now, held = conv, {}
                held[call] = on
            yield rows(out)
        yield rows([(now, *x) for x in ordered(held).items()])

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.string(), pa.int32()), strict=True)], names=["conv_id", "call_id", "level"])

    short = each.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(run, "conv_id long, call_id string, level int")
    if long.isEmpty():
        return short
    left = stored(edges.join(long, "conv_id", "left_semi"))
    nodes = left.select("conv_id", "call_id").union(left.select("conv_id", "on")).distinct()
    return short.unionByName(by_rounds(left, nodes))


def by_rounds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id, call_id, level of the nodes: a round for each level, in which all conversations take part."""
    key = ["conv_id", "call_id"]
    left, done, level = stored(edges), None, 0
    rest = stored(nodes.select(*key))
    while True:
        ready = stored(rest.join(left.select(*key).distinct(), key, "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            last = rest.withColumn("level", F.lit(-1))
            return last if done is None else done.unionByName(last)
        done = stored(ready if done is None else done.unionByName(ready))
        rest = stored(rest.join(ready.select(*key), key, "left_anti"))
        met = ready.select("conv_id", F.col("call_id").alias("on"))
        left, level = stored(left.join(met, ["conv_id", "on"], "left_anti")), level + 1


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each identifier of calls (conv_id, call_id, position, name, arguments, depends_on) and results (conv_id, call_id, position, content)."""
    key = ["conv_id", "call_id"]
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    body = F.struct("position", "name", "arguments", "depends_on")
    one = calls.where(known).groupBy(key).agg(F.min(body).alias("call"), F.count("*").alias("n_calls"))
    two = results.where(known).groupBy(key).agg(F.min(F.struct("position", "content")).alias("result"), F.count("*").alias("n_results"))
    rows = one.join(two, key, "full_outer")
    lost = calls.where(~known).groupBy(*key, body.alias("call")).agg(F.count("*").alias("n_calls")).withColumn("result", F.lit(None).cast(rows.schema["result"].dataType)).withColumn("n_results", F.lit(None).cast("long"))
    lost2 = results.where(~known).groupBy(*key, F.struct("position", "content").alias("result")).agg(F.count("*").alias("n_results")).withColumn("call", F.lit(None).cast(rows.schema["call"].dataType)).withColumn("n_calls", F.lit(None).cast("long"))
    rows = stored(rows.unionByName(lost).unionByName(lost2))

    there = rows.where(known & F.col("call").isNotNull())
    edges = there.select(*key, F.explode(F.array_distinct("call.depends_on")).alias("on"))
    edges = stored(edges.join(there.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"]))
    found = edges.groupBy(key).agg(F.array_sort(F.collect_set("on")).alias("on"))
    rows = rows.join(found, key, "left").join(levels(edges), key, "left").withColumn("level", F.coalesce("level", F.lit(0)))
    rows = rows.withColumn("position", F.coalesce("call.position", "result.position")).withColumn("last", (F.col("level") == -1).cast("int"))
    rows = rows.withColumn("one", F.lit(1)).withColumn("tie", F.xxhash64("call_id", "call", "result"))
    ranked = _running(rows.withColumn("group", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), "one", ["group"], ["last", "level", "position", "call_id", "tie"], F.struct("last", "level", F.floor(F.col("position") / 4096)))

    def serialise(batch):
        t = batch.to_pylist()
        valid, errors, text = [], [], []
        for x in t:
            wrong, call, args = [], x["call"], None
            if call:
                try:
                    args = parsed(call["arguments"]) if call["arguments"] is not None else {}
                except ValueError:
                    wrong.append("$: not JSON")
                schema = schemas.get(call["name"])
                wrong += ["unknown tool"] if schema is None else problems(args, schema) if not wrong else []
                wrong += [f"depends on unknown {d}" for d in sorted({d for d in call["depends_on"] or [] if d is not None} - {*(x["on"] or [])})]
            valid.append(bool(call) and not wrong)
            errors.append(wrong)
            text.append(canonical({"arguments": args if not call or args is not None else call["arguments"], "depends_on": x["on"] or [], "id": x["call_id"], "name": call and call["name"], "result": x["result"] and x["result"]["content"]}))
        yield *(batch.column(c) for c in same), pa.array(valid), pa.array(errors, pa.list_(pa.string())), pa.array(text)

    no_id = F.col("conv_id").isNull() | F.col("call_id").isNull()
    status = F.when(no_id, "no_id").when(F.col("call").isNull(), "orphan").when(F.col("result").isNull(), "no_result").otherwise("linked")
    same = ["conv_id", "call_id", "rank", "level", "status", "n_calls", "n_results"]
    out = ranked.withColumn("status", status).withColumn("rank", F.col("before")).withColumn("n_calls", F.coalesce("n_calls", F.lit(0))).withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    return arrow_map(out.select(*same, "call", "result", "on"), serialise, "conv_id long, call_id string, rank long, level int, status string, n_calls long, n_results long, valid boolean, errors array<string>, json string")


SCHEMAS = {
    "ask": {"type": "object", "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "required": ["text", "turn"], "additionalProperties": False},
    "instruct": {"type": "object", "properties": {"text": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["text"], "additionalProperties": False},
}


def of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as calls and results: user and system turns are calls, named by their place, an assistant's turn is the result of the turn before.

    A call depends on the call that its turn's predecessor answers, or on the turn before if that is a system's.
    """
    at = lambda n: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - n).cast("string"))
    name = F.when(F.col("role") == "system", "instruct").otherwise("ask")
    asked = turns.where(F.col("role").isin("user", "system")).withColumn("name", name).withColumn("call_id", F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), at(0)))
    role = turns.where(F.col("turn").isNotNull()).groupBy("conv_id", "turn").agg(F.min("role").alias("before"))
    asked = asked.join(role.select("conv_id", (F.col("turn") + 1).alias("turn"), "before"), ["conv_id", "turn"], "left")
    on = F.when(F.col("before") == "assistant", F.array(at(2))).when(F.col("before").isNotNull(), F.array(at(1))).otherwise(F.array().cast("array<string>"))
    args = F.to_json(F.struct("text", "turn"))
    calls = asked.select("conv_id", "call_id", F.col("turn").alias("position"), "name", args.alias("arguments"), on.alias("depends_on"))
    answered = turns.where("role = 'assistant'")
    return calls, answered.select("conv_id", F.when(F.col("turn").isNotNull(), at(1)).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = of_turns(table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"))
    return link(calls, results, SCHEMAS).drop("errors")


ORACLE = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text FROM conversations),
r AS (SELECT conv_id, turn, min(role) AS role FROM t GROUP BY ALL),
c AS (SELECT t.conv_id, t.conv_id || ':' || t.turn AS call_id, min({'turn': t.turn, 'name': CASE WHEN t.role = 'system' THEN 'instruct' ELSE 'ask' END, 'text': t.text}) AS x, count(*) AS n_calls FROM t WHERE t.role IN ('user', 'system') GROUP BY t.conv_id, t.turn),
a AS (SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, min({'turn': turn, 'text': text}) AS y, count(*) AS n_results FROM t WHERE role = 'assistant' GROUP BY conv_id, turn),
j AS (SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.call_id, a.call_id) AS call_id, x, y, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results, coalesce(x.turn, y.turn) AS position, CASE WHEN x IS NULL THEN 'orphan' WHEN y IS NULL THEN 'no_result' ELSE 'linked' END AS status FROM c FULL JOIN a ON c.conv_id = a.conv_id AND c.call_id = a.call_id),
d AS (SELECT j.*, CASE WHEN x IS NULL THEN NULL WHEN r.role = 'assistant' THEN j.conv_id || ':' || (x.turn - 2) WHEN r.role IS NOT NULL THEN j.conv_id || ':' || (x.turn - 1) END AS dep FROM j LEFT JOIN r ON r.conv_id = j.conv_id AND r.turn = x.turn - 1),
e AS (SELECT d.*, c.call_id AS met FROM d LEFT JOIN c ON c.conv_id = d.conv_id AND c.call_id = d.dep),
v AS (SELECT conv_id, call_id, 0::INTEGER AS level FROM e WHERE met IS NULL UNION ALL SELECT e.conv_id, e.call_id, v.level + 1 FROM v JOIN e ON e.conv_id = v.conv_id AND e.met = v.call_id)
SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id ORDER BY level, position, call_id) - 1 AS rank, level, status, n_calls, n_results,
  (x IS NOT NULL AND (dep IS NULL OR met IS NOT NULL) AND x.text IS NOT NULL AND (x.name = 'instruct' OR (length(x.text) > 0 AND x.turn >= 0))) AS valid,
  '{"arguments":' || CASE WHEN x IS NULL THEN 'null' ELSE '{' || CASE WHEN x.text IS NULL THEN '' ELSE '"text":' || to_json(x.text)::VARCHAR || ',' END || '"turn":' || x.turn || '}' END || ',"depends_on":[' || CASE WHEN met IS NULL THEN '' ELSE '"' || met || '"' END || '],"id":"' || call_id || '","name":' || CASE WHEN x IS NULL THEN 'null' ELSE '"' || x.name || '"' END || ',"result":' || coalesce(to_json(y.text)::VARCHAR, 'null') || '}' AS json
FROM e JOIN v USING (conv_id, call_id)
"""
