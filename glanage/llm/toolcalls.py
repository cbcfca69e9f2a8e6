"""Chat formatting: tool calls linked to their results, in DataFrame operations only.

Calls and results are hash-joined by conversation and identifier. Arguments are
parsed, checked against the tool's schema and written as canonical JSON: keys
sorted, no blanks, and numbers in the shortest form of their value (``1e2``,
``100.0`` and ``100`` are all ``100``). Calls are put in topological order: a
call comes after those it depends on, otherwise by turn.

The order is by (ready, hop, turn, call_id). A call's ready turn is the latest
turn among itself and all that it depends on, directly or through others; hop is
the length of the longest chain of dependencies to a call of that turn. Both are
found by doubling: links of one step, of two, of four and so on are joined with
themselves, so a chain of n calls takes log2(n) rounds. Only conversations in
which a call names a later one take part; mostly there are none. Links that are
still there when they are longer than the conversation has calls lead into a
cycle: exactly those calls are reported as cyclic, and keep their own turn. What
the rounds hold is the pairs of calls a power of two steps apart: as many as
calls where each depends on few others, more where many do.

Positions in a conversation are counted in two steps, within blocks of turns
and over the sizes of the blocks, so that no task gets a whole long
conversation.

Cases: calls without conversation or identifier can't be linked and are left
out; a call without result and a result without call each give a row that says
so; of calls or results that share an identifier the least (by turn, dependencies
and content) counts and the row says there were more; arguments that are null or no JSON
object, keys that an object repeats, tools without schema, missing, unknown and
mistyped arguments are errors, in that order; a call without turn counts as of turn 0; a dependency that doesn't exist is an error and else
ignored; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glanage.llm.common import saved

#: Turns of a conversation that are numbered together.
BLOCK = 256
#: Schemas are broadcast up to this many tools.
BROADCAST_TOOLS = 10_000

#: The tools of the example query: (tool, parameter, type, required).
TOOLS = (
    ("search", "query", "string", True),
    ("search", "turn", "integer", True),
    ("search", "chars", "number", True),
    ("lookup", "query", "string", True),
    ("lookup", "limit", "integer", True),
    ("lookup", "turn", "integer", False),
    ("lookup", "chars", "integer", False),
    ("summarise", "query", "string", True),
    ("summarise", "turn", "string", True),
)


def quoted(x: Column) -> Column:
    """A string as JSON."""
    a = F.to_json(F.array(x))
    return F.when(x.isNotNull(), F.substring(a, F.lit(2), F.length(a) - 2)).otherwise("null")


def _kind(type_name: Column) -> Column:
    return (
        F.when(type_name == "STRING", "string")
        .when(type_name == "BIGINT", "integer")
        .when(type_name.startswith("DECIMAL") | type_name.isin("DOUBLE", "FLOAT"), "number")
        .when(type_name == "BOOLEAN", "boolean")
        .when(type_name.startswith("ARRAY"), "array")
        .when(type_name.startswith("OBJECT"), "object")
        .otherwise("null")
    )


def shortest(x: Column) -> Column:
    """A JSON number in the shortest form of its value."""
    body = F.regexp_replace(x, "^-", "")
    power = F.coalesce(F.regexp_extract(body, "[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    mantissa = F.regexp_replace(body, "[eE].*$", "")
    fraction = F.regexp_extract(mantissa, r"\.([0-9]*)$", 1)
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.", ""), "^0+", "")
    given = F.regexp_replace(digits, "0+$", "")
    zeros = power - F.length(fraction) + F.length(digits) - F.length(given)
    point = F.length(given) + zeros
    number = (
        F.when(given == "", "0")
        .when((zeros >= 0) & (point <= 21), F.concat(given, F.repeat(F.lit("0"), F.greatest(zeros, F.lit(0)))))
        .when((point > 0) & (point <= 21), F.concat(F.substring(given, F.lit(1), point), F.lit("."), F.substring(given, point + 1, F.length(given))))
        .when((point > -6) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-point, F.lit(0))), given))
        .otherwise(
            F.concat(
                F.substring(given, 1, 1), F.when(F.length(given) > 1, F.concat(F.lit("."), F.substring(given, F.lit(2), F.length(given)))).otherwise(""),
                F.when(point > 0, "e+").otherwise("e"), (point - 1).cast("string"),
            )
        )
    )
    return F.when(x.startswith("-") & (given != ""), F.concat(F.lit("-"), number)).otherwise(number)


def canonical_numbers(json: Column) -> Column:
    """JSON with its numbers in their shortest form; what stands in strings stays."""
    # Control characters are escaped in JSON, so two of them can stand for the escapes that matter here.
    bare = F.replace(F.replace(json, F.lit("\\\\"), F.lit("\1")), F.lit('\\"'), F.lit("\2"))
    numbers = lambda part: F.array_join(F.transform(F.regexp_extract_all(part, F.lit("-?[0-9][0-9.eE+-]*|[^0-9-]+"), F.lit(0)), lambda t: F.when(t.rlike("^-?[0-9]"), shortest(t)).otherwise(t)), "")
    parts = F.transform(F.split(bare, '"', -1), lambda part, i: F.when(i % 2 == 0, numbers(part)).otherwise(part))
    whole = F.replace(F.replace(F.array_join(parts, '"'), F.lit("\2"), F.lit('\\"')), F.lit("\1"), F.lit("\\\\"))
    return F.when(json.rlike("[0-9][.eE]"), whole).otherwise(json)


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds canonical (arguments as canonical JSON) and errors to calls (name, arguments).

    ``schemas`` has tool, parameter, type and required.
    """
    by_tool = schemas.groupBy("tool").agg(F.sort_array(F.collect_set(F.struct("parameter", "type", "required"))).alias("params"))
    by_tool = saved(by_tool, "schemas")
    side = F.broadcast(by_tool) if by_tool.count() <= BROADCAST_TOOLS else by_tool
    parsed = calls.withColumn("v", F.try_parse_json("arguments"))
    parsed = parsed.withColumn("is_object", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    entries = F.expr("map_entries(try_cast(case when is_object then v end as map<string, variant>))")
    parsed = parsed.withColumn("given", F.transform(entries, lambda e: F.struct(e["key"].alias("k"), _kind(F.schema_of_variant(e["value"])).alias("t"))))
    # Parsing refuses objects that repeat a key; the keys can still be listed.
    parsed = parsed.withColumn("keys", F.when(F.col("v").isNull(), F.json_object_keys("arguments")))
    joined = parsed.join(side, parsed["name"] == side["tool"], "left")
    p, g = F.col("params"), F.col("given")
    missing = F.transform(F.filter(p, lambda x: x["required"] & ~F.exists(g, lambda y: y["k"] == x["parameter"])), lambda x: F.concat(F.lit("missing "), x["parameter"]))
    unknown = F.transform(F.filter(g, lambda y: ~F.exists(p, lambda x: y["k"] == x["parameter"])), lambda y: F.concat(F.lit("unknown "), y["k"]))
    fits = lambda x, y: (x["type"] == y["t"]) | ((x["type"] == "number") & (y["t"] == "integer"))
    mistyped = F.transform(F.filter(g, lambda y: F.exists(p, lambda x: (y["k"] == x["parameter"]) & ~fits(x, y))), lambda y: F.concat(F.lit("type of "), y["k"]))
    repeated = F.transform(F.array_sort(F.array_distinct(F.filter("keys", lambda k: F.size(F.filter("keys", lambda x: x == k)) > 1))), lambda k: F.concat(F.lit("repeated "), k))
    errors = (
        F.when(F.size(repeated) > 0, repeated)
        .when(F.size("keys") > 0, F.array(F.lit("repeated keys within")))
        .when(~F.col("is_object"), F.array(F.lit("arguments are no object")))
        .when(p.isNull(), F.array(F.lit("unknown tool")))
        .otherwise(F.concat(F.array_sort(missing), F.array_sort(unknown), F.array_sort(mistyped)))
    )
    canonical = F.when(F.col("is_object"), canonical_numbers(F.to_json("v"))).otherwise("null")
    return joined.withColumn("errors", errors).withColumn("canonical", canonical).drop("v", "is_object", "given", "tool", "params", "keys")


def ordered(calls: DataFrame) -> DataFrame:
    """Adds ready, hop, cyclic and absent (dependencies that don't exist) to calls (conv_id, call_id, turn, depends_on)."""
    key = ["conv_id", "call_id"]
    own = calls.select(*key, F.coalesce("turn", F.lit(0)).alias("r"))
    named = calls.select(*key, F.explode("depends_on").alias("dep")).where("dep is not null").distinct()
    links = saved(named.join(own.select("conv_id", F.col("call_id").alias("dep"), F.col("r").alias("there")), ["conv_id", "dep"], "left"), "dependencies")
    absent = links.where("there is null").groupBy(*key).agg(F.sort_array(F.collect_set("dep")).alias("absent"))
    links = links.where("there is not null")
    late = saved(links.join(own, key).where("there >= r").select("conv_id").distinct(), "late")
    if late.isEmpty():
        place = own.select(*key, F.col("r").alias("ready"), F.lit(0).alias("hop"), F.lit(False).alias("cyclic"))
    else:
        taking = saved(own.join(late, "conv_id", "left_semi").select(*key, "r", F.lit(0).alias("h")), "order")
        most = taking.groupBy("conv_id").count().agg(F.max("count")).first()[0]
        best, steps, length = taking, saved(links.join(late, "conv_id", "left_semi").select(*key, "dep"), "steps"), 1
        while length <= most and not steps.isEmpty():
            ends = best.select("conv_id", F.col("call_id").alias("dep"), F.struct("r", (F.col("h") + length).alias("h")).alias("m"))
            more = steps.join(ends, ["conv_id", "dep"]).groupBy(*key).agg(F.max("m").alias("m"))
            top = F.greatest(F.struct("r", "h"), F.coalesce("m", F.struct("r", "h")))
            best = saved(best.join(more, key, "left").select(*key, top.alias("t")).select(*key, "t.*"), "order")
            onward = steps.select("conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("end"))
            steps = saved(steps.join(onward, ["conv_id", "dep"]).select(*key, F.col("end").alias("dep")).distinct(), "steps")
            length *= 2
        cyclic = steps.select(*key, F.lit(True).alias("c")).distinct()
        best = best.select(*key, F.struct("r", "h").alias("b")).join(cyclic, key, "left")
        place = own.join(best, key, "left").select(
            *key,
            F.when(F.col("c").isNull(), F.coalesce("b.r", "r")).otherwise(F.col("r")).alias("ready"),
            F.when(F.col("c").isNull(), F.coalesce("b.h", F.lit(0))).otherwise(0).alias("hop"),
            F.col("c").isNotNull().alias("cyclic"),
        )
    return calls.join(place, key).join(absent, key, "left")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and per result without call: conv_id, seq (from 1), call_id, name, valid, errors and canonical json.

    ``calls`` has conv_id, call_id, turn, name, arguments (JSON text) and
    depends_on (array of call ids); ``results`` has conv_id, call_id, turn and content.
    """
    key = ["conv_id", "call_id"]
    there = "conv_id is not null and call_id is not null"
    # One shuffle brings a call and its result together; the order is worked out on slim rows.
    c = calls.where(there).select(*key, F.struct("turn", F.sort_array("depends_on").alias("depends_on"), "name", "arguments").alias("c"))
    r = results.where(there).select(*key, F.struct("turn", "content").alias("r"))
    met = c.unionByName(r, allowMissingColumns=True).groupBy(key)
    met = met.agg(F.min("c").alias("c"), F.count("c").alias("n_calls"), F.min("r").alias("r"), F.count("r").alias("n_results"))
    slim = calls.where(there).groupBy(key).agg(F.min(F.struct("turn", F.sort_array("depends_on").alias("depends_on"))).alias("c")).select(*key, "c.*")
    place = saved(ordered(slim).select(*key, "ready", "hop", "cyclic", "absent"), "calls")
    both = validated(met.select(*key, "c.*", "n_calls", "r", "n_results").join(place, key, "left"), schemas)
    none = F.array().cast("array<string>")
    flag = lambda condition, text: F.when(condition, F.array(F.lit(text))).otherwise(none)
    errors = F.concat(
        F.when(F.col("n_calls") > 0, F.col("errors")).otherwise(none),
        F.coalesce(F.transform("absent", lambda d: F.concat(F.lit("no dependency "), d)), none),
        flag(F.col("cyclic"), "cyclic dependency"),
        flag(F.col("n_calls") > 1, "more calls of this id"),
        flag(F.col("n_calls") == 0, "result without call"),
        flag(F.col("n_results") == 0, "call without result"),
        flag(F.col("n_results") > 1, "more results of this id"),
    )
    rows = both.select(
        *key,
        "name",
        errors.alias("errors"),
        F.coalesce("canonical", F.lit("null")).alias("canonical"),
        F.col("r.turn").alias("result_turn"),
        F.col("r.content").alias("content"),
        (F.col("n_results") > 0).alias("answered"),
        F.coalesce("ready", "r.turn", F.lit(0)).alias("ready"),
        F.coalesce("hop", F.lit(0)).alias("hop"),
        F.coalesce("turn", "r.turn", F.lit(0)).alias("turn"),
    )
    # Positions are counted on keys alone, so texts stay where the links were made.
    places = saved(rows.select(*key, "ready", "hop", "turn").withColumn("block", F.floor(F.col("ready") / BLOCK)), "places")
    blocks = places.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("conv_id", "block").orderBy("ready", "hop", "turn", "call_id")
    places = places.join(blocks, ["conv_id", "block"]).select(*key, (F.col("offset") + F.row_number().over(within)).alias("seq"))
    rows = rows.join(places, key)
    result = F.when(F.col("answered"), F.concat(F.lit('{"content":'), quoted(F.col("content")), F.lit(',"turn":'), F.coalesce(F.col("result_turn").cast("string"), F.lit("null")), F.lit("}"))).otherwise("null")
    json = F.concat(
        F.lit('{"arguments":'),
        F.col("canonical"),
        F.lit(',"call_id":'),
        quoted(F.col("call_id")),
        F.lit(',"errors":'),
        F.to_json("errors"),
        F.lit(',"name":'),
        quoted(F.col("name")),
        F.lit(',"result":'),
        result,
        F.lit("}"),
    )
    return rows.select("conv_id", F.col("seq").cast("long").alias("seq"), "call_id", "name", (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), json.alias("json"))


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain chats: each user turn calls a tool, the assistant's next turn is the result.

    The tool goes by the turn. Of three calls in a row, the first depends on the second, which comes later, and on the one
    before it, the second on none, and the third on the second; calls that don't exist are named as well.
    """
    c = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null")
    name = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    tool = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("summarise")), (F.col("turn") % 3 + 1).cast("int"))
    arguments = F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit(', "query": '), quoted(F.col("text")), F.lit(', "chars": '), F.coalesce(F.length("text"), F.lit(0)).cast("string"), F.lit("}"))
    place = F.floor(F.col("turn") / 2) % 3
    before, after = name(F.col("turn") - 2), name(F.col("turn") + 2)
    depends = F.when(place == 0, F.when(F.col("turn") >= 2, F.array(before, after)).otherwise(F.array(after))).when(place == 2, F.array(before)).otherwise(F.array().cast("array<string>"))
    calls = c.where("role = 'user'").select("conv_id", name(F.col("turn")).alias("call_id"), "turn", tool.alias("name"), arguments.alias("arguments"), depends.alias("depends_on"))
    results = c.where("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = from_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    schemas = spark.createDataFrame(list(TOOLS), "tool string, parameter string, type string, required boolean")
    return link(calls, results, schemas)


_SQL_TOOLS = ", ".join(f"('{t}', '{p}', '{k}', {str(r).lower()})" for t, p, k, r in TOOLS)

ORACLE = f"""
with recursive tools(tool, parameter, type, required) as (values {_SQL_TOOLS}),
c as (select * from conversations where conv_id is not null and turn is not null),
call_rows as (
  select conv_id, 'call_' || conv_id || '_' || turn as call_id, turn, ['search', 'lookup', 'summarise'][turn % 3 + 1] as name,
    to_json({{'chars': coalesce(length(text), 0), 'query': text, 'turn': turn}}) as args,
    list_sort(list_transform(case when turn // 2 % 3 = 0 then case when turn >= 2 then [turn - 2, turn + 2] else [turn + 2] end when turn // 2 % 3 = 2 then [turn - 2] else [] end,
      lambda x: 'call_' || conv_id || '_' || x)) as deps
  from c where role = 'user'),
calls as (select conv_id, call_id, min(struct_pack(turn, deps, name, args)) as v, count(*) as n_calls from call_rows group by all),
links as (
  select x.conv_id, x.call_id, x.dep, y.v.turn as there from (select conv_id, call_id, unnest(v.deps) as dep from calls) x
  left join calls y on y.conv_id = x.conv_id and y.call_id = x.dep),
reach as (
  select conv_id, call_id, call_id as at, v.turn as turn, 0 as hops from calls
  union all
  select r.conv_id, r.call_id, l.dep, l.there, hops + 1 from reach r join links l on l.conv_id = r.conv_id and l.call_id = r.at where l.there is not null),
place as (select conv_id, call_id, max(struct_pack(turn, hops)) as p from reach group by all),
absent as (select conv_id, call_id, list('no dependency ' || dep order by dep) as e from links where there is null group by all),
results as (
  select conv_id, 'call_' || conv_id || '_' || (turn - 1) as call_id, min(struct_pack(turn, text)) as r, count(*) as n_results
  from c where role = 'assistant' group by all),
kinds as (
  select conv_id, call_id, v.name as name, k,
    case when json_type(v.args, '$.' || k) = 'VARCHAR' then 'string' when json_type(v.args, '$.' || k) in ('UBIGINT', 'BIGINT') then 'integer' else 'null' end as t
  from (select *, unnest(json_keys(v.args)) as k from calls)),
missing as (
  select conv_id, call_id, list(distinct 'missing ' || parameter order by 'missing ' || parameter) as e from calls join tools on tool = v.name
  where required and parameter not in ('chars', 'query', 'turn') group by all),
unknown as (
  select conv_id, call_id, list('unknown ' || k order by k) as e from kinds
  where not exists (select 1 from tools where tool = name and parameter = k) group by all),
mistyped as (
  select conv_id, call_id, list('type of ' || k order by k) as e from kinds join tools on tool = name and parameter = k
  where not (type = t or (type = 'number' and t = 'integer')) group by all),
j as (
  select coalesce(calls.conv_id, results.conv_id) as conv_id, coalesce(calls.call_id, results.call_id) as call_id, v, r, n_calls, n_results,
    coalesce(missing.e, []) || coalesce(unknown.e, []) || coalesce(mistyped.e, [])
    || coalesce(absent.e, [])
    || case when n_calls > 1 then ['more calls of this id'] else [] end
    || case when n_calls is null then ['result without call'] else [] end
    || case when n_results is null then ['call without result'] else [] end
    || case when n_results > 1 then ['more results of this id'] else [] end as e
  from calls full outer join results using (conv_id, call_id)
  left join missing on missing.conv_id = calls.conv_id and missing.call_id = calls.call_id
  left join unknown on unknown.conv_id = calls.conv_id and unknown.call_id = calls.call_id
  left join mistyped on mistyped.conv_id = calls.conv_id and mistyped.call_id = calls.call_id
  left join absent on absent.conv_id = calls.conv_id and absent.call_id = calls.call_id)
select conv_id, row_number() over (partition by conv_id order by coalesce(p.turn, r.turn), coalesce(p.hops, 0), coalesce(v.turn, r.turn), call_id) as seq, call_id, v.name as name, len(e) = 0 as valid,
  array_to_string(e, '; ') as errors,
  '{{"arguments":' || coalesce(cast(v.args as varchar), 'null') || ',"call_id":' || to_json(call_id) || ',"errors":' || to_json(e) || ',"name":' || coalesce(cast(to_json(v.name) as varchar), 'null')
  || ',"result":' || case when n_results is null then 'null' else '{{"content":' || to_json(r.text) || ',"turn":' || r.turn || '}}' end || '}}' as json
from j left join place using (conv_id, call_id)
"""
