"""Chat formatting with linked tool calls, in DataFrame operations only.

An assistant turn may be a JSON object with ``tool_calls`` (id, name and arguments, or those in ``function``); a tool turn is one
with ``tool_call_id``. Other turns are plain content. Schemas and arguments are unfolded level by level to rows of one place
each, which meet in a join.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, small

#: Places in schemas up to which their table is broadcast; more of them join by a shuffle.
TOOLS_BROADCAST = 10_000

#: name and schema of each tool: type, properties, required, enum, items and additionalProperties are read.
TOOLS = [
    ("search", {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]}),
    ("fetch", {"type": "object", "properties": {"url": {"type": "string"}}, "required": ["url"]}),
    ("calculate", {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]}),
    ("run_code", {"type": "object", "properties": {"code": {"type": "string"}, "language": {"type": "string"}}, "required": ["code"]}),
]

_NO_CALLS = "cast(array() as array<struct<place:int,call_id:string,name:string,arguments:string,valid:boolean>>)"
_FIELDS = "try_variant_get({0}, '$', 'map<string,variant>')"
#: One step further down: the key of a property, with the signs of a path in it written otherwise, or any item.
_PROPERTY = "concat(path, '/', replace(replace(replace(key, '~', '~0'), '/', '~1'), '[', '~2'))"
_ITEM = "concat(path, '[]')"


def default_tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, json.dumps(schema)) for name, schema in TOOLS], "name string, schema string")


def _schemas(tools: DataFrame) -> DataFrame:
    """A row for each place of each tool's schema: what a value there must be. Of schemas of one name the first in order counts."""
    level, found = cut(tools.groupBy("name").agg(F.min("schema").alias("s")).selectExpr("name", "'' as path", "s")), []
    while not level.isEmpty():
        parsed = level.selectExpr("name", "path", "try_parse_json(s) as s")
        found.append(
            parsed.selectExpr(
                "name", "path",
                "filter(coalesce(try_variant_get(s, '$.type', 'array<string>'), array(try_variant_get(s, '$.type', 'string'))), x -> x is not null) as types",
                "transform(try_variant_get(s, '$.enum', 'array<variant>'), x -> to_json(x)) as allowed",
                "coalesce(try_variant_get(s, '$.required', 'array<string>'), cast(array() as array<string>)) as required",
                "coalesce(try_variant_get(s, '$.additionalProperties', 'boolean'), false) as open",
                "try_variant_get(s, '$.properties', 'map<string,variant>') is not null as has_properties",
                "try_variant_get(s, '$.items', 'variant') is not null as has_items",
            )
        )
        below = parsed.selectExpr("name", "path", "explode(try_variant_get(s, '$.properties', 'map<string,variant>')) as (key, s)").selectExpr("name", f"{_PROPERTY} as path", "to_json(s) as s")
        items = parsed.selectExpr("name", f"{_ITEM} as path", "to_json(try_variant_get(s, '$.items', 'variant')) as s").where("s is not null")
        level = cut(below.union(items))
    return cut(reduce(DataFrame.union, found)) if found else cut(tools.sparkSession.createDataFrame([], "name string, path string, types array<string>, allowed array<string>, required array<string>, open boolean, has_properties boolean, has_items boolean"))


def _misfits(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """call of every row of ``calls`` (call, name, arguments) whose arguments do not fit the tool's schema."""
    schemas = _schemas(tools)
    schemas = small(schemas, schemas.count(), TOOLS_BROADCAST)
    level, bad = cut(calls.selectExpr("call", "name", "'' as path", "arguments as v", "false as free")), []
    while not level.isEmpty():
        met = level.join(schemas.withColumn("known", F.lit(True)), ["name", "path"], "left").withColumn("v", F.expr("try_parse_json(v)")).withColumn("kind", F.expr("schema_of_variant(v)"))
        kinds = [("OBJECT", "object"), ("ARRAY", "array"), ("STRING", "string"), ("BOOLEAN", "boolean"), ("VOID", "null")]
        met = met.withColumn("kind", F.expr(f"case {' '.join(f'''when startswith(kind, '{k}') then '{t}' ''' for k, t in kinds)} when try_variant_get(v, '$', 'double') = floor(try_variant_get(v, '$', 'double')) then 'integer' when v is not null then 'number' end"))
        typed = "size(types) = 0 or array_contains(types, kind) or (kind = 'integer' and array_contains(types, 'number'))"
        whole = f"kind <> 'object' or size(array_except(required, map_keys({_FIELDS.format('v')}))) = 0"
        fits = f"kind is not null and if(known is null, free, ({typed}) and ({whole}) and (allowed is null or array_contains(allowed, to_json(v))))"
        bad.append(met.where(f"not coalesce({fits}, false)").select("call"))
        below = met.where("has_properties and kind = 'object'").selectExpr("call", "name", "path", "open", f"explode({_FIELDS.format('v')}) as (key, v)").selectExpr("call", "name", f"{_PROPERTY} as path", "to_json(v) as v", "open as free")
        items = met.where("has_items and kind = 'array'").selectExpr("call", "name", f"{_ITEM} as path", "explode(try_variant_get(v, '$', 'array<variant>')) as v").selectExpr("call", "name", "path", "to_json(v) as v", "false as free")
        level = cut(below.union(items))
    return reduce(DataFrame.union, bad).distinct() if bad else level.select("call")


def _levels(calls: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(call, level) of the calls that follow another one of their turn, and the calls whose references go in a circle.

    Calls without a dependency that waits go first, a layer a round.
    """
    message = ["conv_id", "turn", "said"]
    refers = calls.select("call", *message, F.explode(F.expr(r"""array_distinct(regexp_extract_all(arguments, r'"\$([^"\\]+)"(?!:)', 1))""")).alias("call_id"))
    of = calls.select(*(F.col(c).alias(f"its_{c}") for c in message), F.col("call_id").alias("its_id"), F.col("call").alias("after"))
    same = reduce(lambda a, b: a & b, (refers[c].eqNullSafe(of[f"its_{c}"]) for c in message)) & (refers["call_id"] == of["its_id"])
    left, levels, k = cut(refers.join(of, same).select("call", "after").distinct()), [], 0
    while n := left.count():
        k += 1
        waiting = left.select("call").distinct()
        still = cut(left.join(waiting.withColumnRenamed("call", "after"), "after", "left_semi").select("call", "after"))
        if still.count() == n:
            return reduce(DataFrame.union, levels) if levels else None, waiting
        levels.append(waiting.join(still.select("call"), "call", "left_anti").select("call", F.lit(k).alias("level")))
        left = still
    return reduce(DataFrame.union, levels) if levels else None, None


def tool_calls(turns: DataFrame, tools: DataFrame) -> DataFrame:
    """Each call of the assistant turns: its message, its place in it from 1, its canonical arguments and whether they are valid.

    They are valid if they fit the tool's schema: the tool is known, and every value in them, at any depth, has a type that
    is allowed there (a whole number is an integer, 2.0 too), is of the ``enum`` and has all ``required`` keys and, unless
    ``additionalProperties`` is true, no others. Arguments may be an object or its JSON text. A string ``$id`` in
    them refers to the call ``id`` of the same turn, which comes first; calls that refer to each other in a circle are invalid, come
    last and keep their order. Any other such string is a plain one.
    """
    spoken = turns.where("role = 'assistant' and startswith(text, '{')").select("conv_id", "turn", "text").distinct()
    found = spoken.selectExpr("conv_id", "turn", "xxhash64(text) as said", "try_variant_get(try_parse_json(text), '$.tool_calls', 'array<variant>') as calls")
    each = found.selectExpr("conv_id", "turn", "said", "posexplode(calls) as (k, call)")
    named = lambda key, kind: f"coalesce(try_variant_get(call, '$.{key}', '{kind}'), try_variant_get(call, '$.function.{key}', '{kind}'))"
    each = each.selectExpr("conv_id", "turn", "said", "k", "try_variant_get(call, '$.id', 'string') as call_id", f"{named('name', 'string')} as name", f"{named('arguments', 'variant')} as given")
    each = each.withColumn("given", F.expr("if(schema_of_variant(given) = 'STRING', coalesce(try_parse_json(cast(given as string)), given), given)"))
    calls = cut(each.select(F.monotonically_increasing_id().alias("call"), "conv_id", "turn", "said", "k", "call_id", "name", F.expr("to_json(given)").alias("arguments")))
    if calls.isEmpty():
        return calls.withColumns({"place": F.col("k") + 1, "valid": F.lit(False)})
    bad = _misfits(calls, tools)
    levels, circles = _levels(calls)
    out = calls.join((bad if circles is None else bad.union(circles)).distinct().withColumn("bad", F.lit(True)), "call", "left")
    out = out.join(levels, "call", "left") if levels is not None else out.withColumn("level", F.lit(0))
    circle = F.lit(False)
    if circles is not None:
        out = out.join(circles.withColumn("circle", F.lit(True)), "call", "left")
        circle = F.coalesce("circle", F.lit(False))
    order = Window.partitionBy("conv_id", "turn", "said").orderBy(circle, F.coalesce("level", F.lit(0)), "k")
    return cut(out.select(*calls.columns, F.row_number().over(order).alias("place"), F.col("bad").isNull().alias("valid")))


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, turn, told, at) of the ``results`` (conv_id, turn, told, call_id) that answer one of the ``calls``; at is its turn and place.

    A result answers the nearest call of its identifier before it that has no answer yet; if there is none, the first one after
    it that no other result answers. Every call is answered once. Rows of a null conversation or turn are not linked.
    """
    known = "conv_id is not null and turn is not null and call_id is not null"
    events = calls.where(known).selectExpr("conv_id", "call_id", "turn", "said as text_hash", "place", "1 as step")
    events = events.union(results.where(known).selectExpr("conv_id", "call_id", "turn", "told", "0", "-1").distinct())
    own = Window.partitionBy("conv_id", "call_id").orderBy("turn", F.desc("step"), "text_hash", "place")
    # calls are pushed on a stack that answers pop; results that find it empty do not count
    events = events.withColumn("sum", F.sum("step").over(own))
    events = events.withColumn("low", F.least(F.lit(0), F.coalesce(F.min("sum").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    events = events.withColumn("depth", F.expr("case when step = 1 then sum - low when sum >= low then sum + 1 - low else 0 end"))
    layer = Window.partitionBy("conv_id", "call_id", "depth").orderBy("turn", F.desc("step"), "text_hash", "place")
    events = events.withColumns({"nth": F.sum(F.expr("if(step = 1, 1, 0)")).over(layer), "then": F.lead("step").over(layer)})
    events = events.withColumn("alone", F.expr("if(step = 1, coalesce(then, 1) = 1, depth = 0)"))
    later = Window.partitionBy("conv_id", "call_id", "alone", "step").orderBy("turn", "text_hash", "place")
    key = ["conv_id", "call_id", "alone", "depth", "nth"]
    events = events.withColumn("rank", F.row_number().over(later)).withColumns({"depth": F.expr("if(alone, 0, depth)"), "nth": F.expr("if(alone, rank, nth)")})
    asked = events.where("step = 1").select(*key, F.struct("turn", "place").alias("at"))
    return events.where("step = -1").join(asked, key).select("conv_id", "turn", F.col("text_hash").alias("told"), "at")


def _quoted(text: str) -> str:
    return f"coalesce(substr(to_json(array({text})), 2, length(to_json(array({text}))) - 2), 'null')"


def _object(fields: str, own: dict[str, str]) -> str:
    """Canonical JSON of the entries of ``fields`` (a map of variants) with ``own`` values (JSON text) in place of theirs."""
    names = ", ".join(f"'{k}'" for k in own)
    given = f"transform(map_entries(map_filter({fields}, (k, v) -> k not in ({names}))), e -> struct(e.key as key, to_json(e.value) as value))"
    set_ = ", ".join(f"struct('{k}' as key, {v} as value)" for k, v in own.items())
    return f"concat('{{', array_join(transform(array_sort(concat({given}, array({set_}))), e -> concat({_quoted('e.key')}, ':', e.value)), ','), '}}')"


def formatted(turns: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """A row for each turn of ``turns`` (conv_id, turn, role, text; other columns are ignored), as canonical JSON.

    Columns: conv_id, turn, role, at_turn, at_call, message, n_calls, n_invalid, linked. Ordered by (at_turn, at_call,
    turn), a conversation's calls come before what depends on them: a result takes the turn of the call that it answers and the
    call's place in it, from 1 (see ``linked`` and ``tool_calls``); all else has its own turn and 0. An unlinked
    result stays in its place; ``linked`` is null for other roles. ``tools`` has name and schema (JSON text).

    message has its keys in order and no blanks; keys of an object that have no meaning here stay in it. A null text is
    null content. Text that is no JSON object of the forms above is plain content. Repeated rows give repeated messages and
    count once as calls and results. A null conv_id is no conversation: its rows are formatted and not linked.
    Very long texts are rows like others. An empty table gives an empty table.
    """
    tools = tools if tools is not None else default_tools(turns.sparkSession)
    turns = turns.select("conv_id", "turn", "role", "text")
    calls = tool_calls(turns, tools)
    by_turn = calls.groupBy(*(F.col(c).alias(f"its_{c}") for c in ("conv_id", "turn", "said"))).agg(F.sort_array(F.collect_list(F.struct("place", "call_id", "name", "arguments", "valid"))).alias("calls"))
    parsed = turns.withColumn("json", F.expr("if(role in ('assistant', 'tool') and startswith(text, '{'), try_parse_json(text), null)")).withColumn("json", F.expr(f"if({_FIELDS.format('json')} is null, null, json)"))
    rest = parsed.where("not (role <=> 'assistant' and json is not null) and not (role <=> 'tool')")
    said = parsed.where("role = 'assistant' and json is not null").withColumn("said", F.xxhash64("text"))
    said = said.join(by_turn, said["conv_id"].eqNullSafe(by_turn["its_conv_id"]) & said["turn"].eqNullSafe(by_turn["its_turn"]) & (said["said"] == by_turn["its_said"]), "left")
    said = said.withColumn("calls", F.coalesce("calls", F.expr(_NO_CALLS)))
    told = parsed.where("role = 'tool'").withColumns({"call_id": F.expr("try_variant_get(json, '$.tool_call_id', 'string')"), "told": F.xxhash64("text")})
    told = told.join(linked(calls, told.select("conv_id", "turn", "told", "call_id")), ["conv_id", "turn", "told"], "left")

    plain = "to_json(named_struct('content', text, 'role', role), map('ignoreNullFields', 'false'))"
    fields, content = _FIELDS.format("json"), "coalesce(to_json(try_variant_get(json, '$.content', 'variant')), 'null')"
    one = f"""concat('{{"arguments":', coalesce(c.arguments, 'null'), ',"id":', {_quoted('c.call_id')}, ',"name":', {_quoted('c.name')}, ',"valid":', cast(c.valid as string), '}}')"""
    with_calls = _object(fields, {"content": content, "role": "'\"assistant\"'", "tool_calls": f"concat('[', array_join(transform(calls, c -> {one}), ','), ']')"})
    answer = _object(fields, {"content": content, "linked": "cast(at is not null as string)", "role": "'\"tool\"'", "tool_call_id": _quoted("call_id")})
    own = ["conv_id", "turn", "role", "turn as at_turn", "0 as at_call"]
    no = ["0 as n_calls", "0 as n_invalid", "cast(null as boolean) as linked"]
    return (
        rest.selectExpr(*own, f"{plain} as message", *no)
        .union(said.selectExpr(*own, f"if(size(calls) = 0, {plain}, {with_calls}) as message", "size(calls) as n_calls", "size(filter(calls, c -> not c.valid)) as n_invalid", "cast(null as boolean) as linked"))
        .union(told.selectExpr("conv_id", "turn", "role", "coalesce(at.turn, turn) as at_turn", "coalesce(at.place, 0) as at_call", f"if(call_id is null, {plain}, {answer}) as message", *no[:2], "at is not null as linked"))
    )
