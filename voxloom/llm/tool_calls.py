"""Chat formatting: tool-call linking, in DataFrame operations only.

Calls and results are hash-joined by identifier, put in topological order, their
arguments validated against schemas, and everything serialised as canonical JSON."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.scratch import stash

#: Names of JSON types as ``schema_of_variant`` gives them.
_TYPES = {
    "string": r"^STRING$",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": r"^BOOLEAN$",
    "array": r"^ARRAY<.*>$",
    "object": r"^OBJECT<.*>$",
    "null": r"^VOID$",
}


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no white space; null where the text isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def _one_of(value: Column, options: Sequence[Any]) -> Column:
    """Whether a variant equals one of some JSON values, numbers by value, texts and truth values by type."""
    kind, fits = F.schema_of_variant(value), F.lit(False)
    for x in options:
        if x is None:
            same = kind.rlike(_TYPES["null"])
        elif isinstance(x, bool):
            same = kind.rlike(_TYPES["boolean"]) & (F.try_variant_get(value, "$", "boolean") == x)
        elif isinstance(x, (int, float)):
            same = kind.rlike(_TYPES["number"]) & (F.try_variant_get(value, "$", "double") == float(x))
        elif isinstance(x, str):
            same = kind.rlike(_TYPES["string"]) & (F.try_variant_get(value, "$", "string") == x)
        else:
            same = F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(x))))
        fits = fits | F.coalesce(same, F.lit(False))
    return fits


def _member(name: str) -> str:
    quote = '"' if "'" in name else "'"
    return f"$[{quote}{name}{quote}]"


def _problems(value: Column, schema: Mapping[str, Any], at: str = "") -> Column:
    """What is wrong with a variant under a schema: an array of texts.

    Keywords: type, enum, properties, required, additionalProperties (false), items,
    minLength, maxLength, pattern (texts only), minimum and maximum (numbers only). Inner
    properties are named a.b, elements of arrays a[]. An absent value (null) has no problems."""
    label, kind = f"{at}: " if at else "", F.schema_of_variant(value)
    is_string, is_number, is_object, is_array = (kind.rlike(_TYPES[k]) for k in ("string", "number", "object", "array"))
    found: list[Column] = []
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        fits = F.lit(False)
        for k in kinds:
            fits = fits | kind.rlike(_TYPES[k])
        found.append(F.when(~fits, F.lit(f"{label}not {' or '.join(kinds)}" if at else "not an object" if kinds == ["object"] else f"not {' or '.join(kinds)}")))
    if "enum" in schema:
        found.append(F.when(~_one_of(value, schema["enum"]), F.lit(f"{label}not in enum")))
    string, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    rules = {
        "minLength": lambda x: is_string & (F.char_length(string) < x), "maxLength": lambda x: is_string & (F.char_length(string) > x), "pattern": lambda x: is_string & ~F.regexp_like(string, x),
        "minimum": lambda x: is_number & (number < x), "maximum": lambda x: is_number & (number > x),
    }
    for keyword, bad in rules.items():
        if keyword in schema:
            found.append(F.when(bad(F.lit(schema[keyword])), F.lit(f"{label}{keyword}")))
    properties = schema.get("properties", {})
    for name in schema.get("required", []):
        inner = F.try_variant_get(value, _member(name), "variant")
        found.append(F.when(is_object & inner.isNull(), F.lit(f"{at}.{name}: missing" if at else f"{name}: missing")))
    if schema.get("additionalProperties") is False:
        keys = F.json_object_keys(F.to_json(value))
        extra = F.exists(keys, lambda k: ~k.isin(list(properties))) if properties else F.size(keys) > 0
        found.append(F.when(is_object & extra, F.lit(f"{label}unknown property")))
    parts = [F.array_compact(F.array(*found).cast("array<string>"))]
    for name, rule in properties.items():
        inner = F.try_variant_get(value, _member(name), "variant")
        parts.append(F.when(is_object & inner.isNotNull(), _problems(inner, rule, f"{at}.{name}" if at else name)))
    if "items" in schema:
        elements = F.try_variant_get(value, "$", "array<variant>")
        parts.append(F.when(is_array, F.flatten(F.transform(elements, lambda e: _problems(e, schema["items"], f"{at}[]")))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(p, none) for p in parts]))


def _levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """conv, call_id, level, cyclic for the calls of ``nodes`` (conv, call_id, position) under the
    order ``edges`` (conv, call_id, before).

    Calls are peeled: one whose predecessors all have their levels gets its own and raises
    those that wait for it. A call that waits for a single one, which itself waits for a single
    one, waits for the latter instead, with the sum of the distances, so that a chain of n
    calls takes about log n rounds. What never becomes ready is on a cycle or waits for one."""
    key = ["conv", "call_id"]
    nodes = stash(nodes.select(*key, "position"), "order-calls")
    start, edges = nodes.select(*key, F.col("position").alias("least")), stash(edges.select(*key, "before", F.lit(1).cast("long").alias("distance")), "order-edges")
    waiting, placed = start, None
    far = F.lit(1 << 40)  # only on a cycle do distances grow beyond the number of calls
    while True:
        ready = stash(waiting.join(edges.select(*key), key, "left_anti"), "order-ready")
        if ready.isEmpty():
            break
        placed = ready if placed is None else placed.union(ready)
        done = ready.select("conv", F.col("call_id").alias("before"), F.col("least").alias("low"))
        raised = edges.join(done, ["conv", "before"]).groupBy(*key).agg(F.max(F.col("low") + F.col("distance")).alias("low"))
        waiting = waiting.join(ready.select(*key), key, "left_anti").join(raised, key, "left").select(*key, F.greatest("least", F.coalesce("low", "least")).alias("least"))
        left = edges.join(done.select("conv", "before"), ["conv", "before"], "left_anti")
        alone = left.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("before").alias("before"), F.min("distance").alias("distance")).where("n = 1")
        alone = stash(alone.join(waiting, key).select(*key, "before", "distance", "least"), "order-chains")
        beyond = alone.select("conv", F.col("call_id").alias("before"), F.col("before").alias("next"), F.col("distance").alias("more"), F.col("least").alias("base"))
        jumps = stash(alone.join(beyond, ["conv", "before"]).select(*key, "next", F.least(F.col("distance") + F.col("more"), far).alias("sum"), (F.col("base") + F.col("distance")).alias("base")), "order-jumps")
        edges = left.join(jumps.select(*key, "next", "sum"), key, "left").select(*key, F.coalesce("next", "before").alias("before"), F.coalesce("sum", "distance").alias("distance"))
        edges = stash(edges, "order-edges")
        waiting = waiting.join(jumps.select(*key, "base"), key, "left").select(*key, F.greatest("least", F.coalesce("base", "least")).alias("least"))
        waiting = stash(waiting, "order-waiting")
    stuck = waiting.join(nodes, key).select(*key, F.col("position").alias("level"), F.lit(True).alias("cyclic"))
    return stuck if placed is None else placed.select(*key, F.col("least").alias("level"), F.lit(False).alias("cyclic")).union(stuck)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Links calls with their results.

    ``calls``: conv, call_id, position, name, arguments (JSON text), after (array of call
    ids that must come before). ``results``: conv, call_id, position, content. ``schemas``:
    a JSON schema for each tool name. Identifiers are compared within a conversation.

    Returns one row per call, and one per result without a call: conv, call_id, position,
    result_position, level, status, errors, and json. ``level`` is a topological order:
    a call's level is its position, raised above the levels of all calls it comes after.
    ``status`` is linked, unanswered, orphan (a result without a call), duplicate (a call
    whose id an earlier one has, or a result after the first for its id), or cyclic (calls
    that wait for themselves, for each other, or for such calls; their level is their
    position). ``errors`` has what validation found, sorted. ``json`` is canonical.

    A null id never links; null positions come first and count as -1; null arguments
    are invalid JSON. Of the rows of an id the first by position, then by content, counts;
    the others return as duplicates, one for each, rows that repeat in all columns too.
    Ids in ``after`` that no call has are ignored. Empty tables give an empty result.
    Columns other than those named are not read."""
    key, none = ["conv", "call_id"], F.array().cast("array<string>")
    calls = calls.select(*key, F.coalesce("position", F.lit(-1)).cast("long").alias("position"), "name", "arguments", F.coalesce("after", none).alias("after"))
    results = results.select(*key, F.coalesce("position", F.lit(-1)).cast("long").alias("result_position"), "content")
    # equal rows are one row with its number; the first call of an id and its first result are picked by map-side aggregation
    calls = calls.groupBy(*calls.columns).agg(F.count(F.lit(1)).alias("copies"))
    results = results.groupBy(*results.columns).agg(F.count(F.lit(1)).alias("copies"))
    call, result = F.struct("position", "name", "arguments", "after"), F.struct("result_position", "content")
    first_call = stash(calls.where("call_id is not null").groupBy(*key).agg(F.min(call).alias("c")), "calls")
    first_result = results.where("call_id is not null").groupBy(*key).agg(F.min(result).alias("r"))
    nodes = first_call.select(*key, "c.position", "c.name", "c.arguments")
    wanted = first_call.select(*key, F.col("c.position").alias("position"), F.explode(F.array_distinct("c.after")).alias("before")).where("before is not null")
    edges = wanted.join(nodes.select("conv", F.col("call_id").alias("before"), F.col("position").alias("low")), ["conv", "before"])
    edges = stash(edges.select(*key, "before", (F.col("low") >= F.col("position")).alias("back")), "call-order")
    # where all calls come after what they wait for, their positions are the order already
    unordered = stash(edges.where("back").select("conv").distinct(), "unordered")
    levels = None if unordered.isEmpty() else _levels(nodes.join(unordered, "conv", "left_semi"), edges.join(unordered, "conv", "left_semi"))
    if levels is None:
        linked = nodes.withColumns({"level": F.col("position"), "cyclic": F.lit(False)})
    else:
        linked = nodes.join(levels, key, "left").withColumns({"level": F.coalesce("level", "position"), "cyclic": F.coalesce("cyclic", F.lit(False))})
    linked = linked.join(first_result, key, "left")
    status = F.when(F.col("cyclic"), "cyclic").when(F.col("r").isNotNull(), "linked").otherwise("unanswered")
    main = linked.select(*key, "position", "name", "arguments", "level", "r", status.alias("status"))
    # rows that have no identifier of their own: later calls and results of an id, and null ids
    again = lambda first: F.explode(F.sequence(F.lit(1).cast("long"), F.when(first, F.col("copies") - 1).otherwise(F.col("copies")))).alias("copy")
    later = calls.join(first_call.select(*key, F.col("c").alias("first")), key, "left")
    spare = later.withColumn("is_first", call.eqNullSafe(F.col("first"))).where(~F.col("is_first") | (F.col("copies") > 1)).withColumn("copy", again(F.col("is_first")))
    spare = spare.select(*key, "position", "name", "arguments", F.col("position").alias("level"), F.lit(None).cast("struct<result_position: bigint, content: string>").alias("r"), F.when(F.col("first").isNull(), "unanswered").otherwise("duplicate").alias("status"))
    met = results.join(first_call.select(*key, F.lit(True).alias("has_call")), key, "left").join(first_result.select(*key, F.col("r").alias("first")), key, "left")
    met = met.withColumn("is_first", F.col("has_call").isNotNull() & result.eqNullSafe(F.col("first")))
    lone = met.where(~F.col("is_first") | (F.col("copies") > 1)).withColumn("copy", again(F.col("is_first")))
    lone = lone.select(*key, F.lit(None).cast("long").alias("position"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.col("result_position").alias("level"), result.alias("r"), F.when(F.col("has_call").isNull(), "orphan").otherwise("duplicate").alias("status"))
    rows = main.unionByName(spare).unionByName(lone)
    args = F.try_parse_json("arguments")
    problems = none
    for name, schema in schemas.items():
        problems = F.when(F.col("name") == name, _problems(args, {"type": "object"} | dict(schema))).otherwise(problems)
    unknown = ~F.coalesce(F.col("name").isin(list(schemas)), F.lit(False))
    errors = F.when(F.col("position").isNull(), none).when(args.isNull(), F.array(F.lit("arguments: not JSON"))).when(unknown, F.array(F.lit("unknown tool"))).otherwise(F.array_sort(problems))
    rows = rows.withColumn("errors", errors)
    quoted = F.to_json(F.struct(F.coalesce("arguments", F.lit("")).alias("a")))
    plain = F.substring(quoted, 6, 1 << 30)  # an invalid argument string as a JSON string and a closing brace
    shown = F.when(F.col("position").isNull(), "null").when(args.isNotNull(), F.to_json(args)).otherwise(F.expr("substring(q, 1, length(q) - 1)"))
    parts = F.to_json(F.struct(F.col("call_id"), F.col("errors"), F.col("level"), F.col("name"), F.col("r.content").alias("result"), F.col("status")), {"ignoreNullFields": "false"})
    rows = rows.withColumn("q", plain).withColumn("json", F.concat(F.lit('{"arguments":'), shown, F.lit(","), F.substring(parts, 2, 1 << 30)))
    return rows.select("conv", "call_id", "position", F.col("r.result_position").alias("result_position"), "level", "status", "errors", "json")


#: The tool that a user's turn calls when a plain conversation is read as tool use.
REPLY_SCHEMA = {
    "reply": {
        "type": "object",
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["prompt", "turn"],
        "additionalProperties": False,
    }
}


def conversation_calls(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table conv_id, turn, role, text: every user turn calls the tool
    ``reply`` after the user turn before it, and an assistant turn is the result of the user
    turn right before it. Turns of other roles (system) are neither and take no part. Identifiers
    are made of conversation and turn; a null turn has none."""
    own = F.concat_ws("-", F.lit("call"), "conv_id", "turn")
    call_id = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), own)
    users = df.where("role = 'user'").select(F.col("conv_id").alias("conv"), call_id.alias("call_id"), F.col("turn").cast("long").alias("position"), F.lit("reply").alias("name"), F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), "turn")).alias("arguments"))
    before = F.concat_ws("-", F.lit("call"), "conv", F.expr("cast(position - 2 as string)"))
    calls = users.withColumn("after", F.when(F.col("position") >= 2, F.array(before)))
    of = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.concat_ws("-", F.lit("call"), "conv_id", (F.col("turn") - 1).cast("string")))
    results = df.where("role = 'assistant'").select(F.col("conv_id").alias("conv"), of.alias("call_id"), F.col("turn").cast("long").alias("position"), F.col("text").alias("content"))
    return calls, results
