"""Chat formatting by tool-call linking, with DataFrame functions only.

Calls and results are joined by conversation and identifier; arguments are validated against the
functions' schemas; calls whose arguments refer to other calls ("$id") are put in topological order;
and each call is serialised as canonical JSON (sorted keys, no spaces, numbers in their shortest form).

Scale: a row a call, never a row a conversation, so a conversation of any length is dealt out like
any other rows. Identifiers make the join keys, which are even. Chains of calls with one reference each are
shortened by doubling pointers, in log2 of their length rounds; then come as many rounds as the longest
succession of calls with several references. Each round's calls are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize

#: {function: {parameter: (type, required)}}; types: string, integer, number, boolean, array, object.
Schemas = dict[str, dict[str, tuple[str, bool]]]
TYPES = {"string": "STRING", "integer": "BIGINT|DECIMAL\\(\\d+,0\\)", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}
#: A whole string value "$id" in canonical JSON; not a key, nor quoted within another string.
REFERENCE = r'(?<!\\)"\$([^"\\]+)"(?!:)'


def valid_arguments(name: Column, parsed: Column, schemas: Schemas) -> Column:
    """Whether parsed (a variant) is an object that has the required parameters of the function, with values of the
    given types, and no others. False for unknown functions and malformed arguments."""
    fields = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed.cast("map<string,variant>"))
    out = F.lit(False)
    for function, parameters in schemas.items():
        ok = F.size(F.array_except(F.map_keys(fields), F.array(*[F.lit(p) for p in parameters]).cast("array<string>"))) == 0
        for parameter, (kind, required) in parameters.items():
            value = F.try_element_at(fields, F.lit(parameter))
            fits = F.schema_of_variant(value).rlike(f"^(?:{TYPES[kind]})$")
            ok = ok & F.when(value.isNull(), F.lit(not required)).otherwise(F.coalesce(fits, F.lit(False)))
        out = F.when(name == function, ok).otherwise(out)
    return F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT") & out, F.lit(False))


def _single_chains(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, to, far) of the calls with one reference: the first call up the chain that has none or
    several, and how far up. Calls on or behind a cycle of such calls have no row. Pointers double each round."""
    keys = ["conv_id", "call_id"]
    single = edges.groupBy(*keys).agg(F.count("*").alias("n"), F.min("parent").alias("to")).where("n = 1").select(*keys, "to", F.lit(1).cast("long").alias("far"))
    pointers, left = materialize(single, "pointers"), None
    while True:
        ahead = pointers.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("far").alias("step"))
        moved = pointers.join(ahead, ["conv_id", "to"], "left").select(
            *keys, F.coalesce("next", "to").alias("to"), (F.col("far") + F.coalesce("step", F.lit(0))).alias("far"), F.col("next").isNotNull().alias("open")
        )
        pointers, before = materialize(moved, "pointers"), left
        left = pointers.where("open").count()
        if left == 0 or left == before:  # while a chain has an end, each round brings some of its calls to it
            return pointers.where("not open").drop("open")
        pointers = pointers.drop("open")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls (conv_id, call_id, refs): 0 without references to calls of the conversation,
    else one more than the highest of those referred to. Calls in or behind a cycle have no row."""
    keys = ["conv_id", "call_id"]
    ids = materialize(calls.select(*keys).distinct(), "calls")
    edges = calls.select(*keys, F.explode("refs").alias("parent")).distinct()
    edges = materialize(edges.join(ids.withColumnRenamed("call_id", "parent"), ["conv_id", "parent"], "left_semi"), "references")
    chains = materialize(_single_chains(edges), "chains")
    # Calls with several references, by the ends of the chains that these lead into.
    several = edges.groupBy(*keys).count().where(F.col("count") > 1).select(*keys)
    single = edges.groupBy(*keys).count().where(F.col("count") == 1).select(*keys)
    ends = chains.select("conv_id", F.col("call_id").alias("parent"), "to", "far")
    wide = edges.join(several, keys, "left_semi").join(ends, ["conv_id", "parent"], "left")
    wide = materialize(wide.select(*keys, F.coalesce("to", "parent").alias("to"), F.coalesce("far", F.lit(0)).alias("far")), "several")
    known = ids.join(edges.select(*keys).distinct(), keys, "left_anti").withColumn("level", F.lit(0).cast("long"))
    waiting = materialize(several, "waiting")
    while not waiting.isEmpty():
        above = known.select("conv_id", F.col("call_id").alias("to"), "level")
        told = wide.join(waiting, keys, "left_semi").join(above, ["conv_id", "to"], "left").groupBy(*keys)
        told = told.agg((F.max(F.col("level") + F.col("far")) + 1).alias("level"), F.max(F.col("level").isNull()).alias("open"))
        ready = materialize(told.where("not open").select(*keys, "level"), "ready")
        if ready.isEmpty():
            break
        known = known.unionByName(ready)
        waiting = materialize(waiting.join(ready, keys, "left_anti"), "waiting")
    above = known.select("conv_id", F.col("call_id").alias("to"), "level")
    behind = chains.join(single, keys, "left_semi").join(above, ["conv_id", "to"]).select(*keys, (F.col("level") + F.col("far")).alias("level"))
    return known.unionByName(behind).withColumn("level", F.col("level").cast("int"))


def _references(parsed: Column, names: list[str] | None) -> Column:
    if names is not None:
        parsed = F.map_filter(F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed.cast("map<string,variant>")), lambda k, _: k.isin(names))
    return F.coalesce(F.regexp_extract_all(F.to_json(parsed), F.lit(REFERENCE), F.lit(1)), F.array().cast("array<string>"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas, references: list[str] | None = None) -> DataFrame:
    """One row per call, and per result without a call: kind (call or orphan), conv_id, turn, call_id, name, level,
    linked, valid, n_results, record (canonical JSON).

    calls: (conv_id, turn, call_id, name, arguments as JSON text); results: (conv_id, turn, call_id, content). Of several
    results of a call the earliest (then least) is linked, n_results counts all. Where calls of a conversation repeat
    an identifier, each is linked with the same result. A null conv_id or call_id links with nothing. Null or
    malformed arguments are invalid and serialised as null. A string value "$id" anywhere in the arguments refers to the
    call id, or only in the parameters named by `references`. References to calls that don't exist are ignored. level is
    null for calls in or behind a cycle. Other columns are not read. Empty tables give an empty result.
    """
    parsed = F.try_parse_json(F.col("arguments"))
    rows = calls.select(
        "conv_id", "turn", "call_id", "name", parsed.alias("parsed"),
    ).withColumn("refs", _references(F.col("parsed"), references)).withColumn("valid", valid_arguments(F.col("name"), F.col("parsed"), schemas))
    order = levels(rows.where("conv_id is not null and call_id is not null").select("conv_id", "call_id", "refs"))
    answers = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("answer"), F.count("*").alias("n_results"))
    keys = ["conv_id", "call_id"]
    linked = rows.join(answers, keys, "left").join(order, keys, "left")
    record = F.to_json(
        F.struct(F.col("parsed").alias("arguments"), "call_id", "level", "name", F.col("answer.content").alias("result")), {"ignoreNullFields": "false"}
    )
    done = linked.select(
        F.lit("call").alias("kind"), "conv_id", "turn", "call_id", "name", "level", F.col("answer").isNotNull().alias("linked"), "valid",
        F.coalesce("n_results", F.lit(0)).alias("n_results"), record.alias("record"),
    )
    orphans = results.join(calls.select(*keys).distinct(), keys, "left_anti").select(
        F.lit("orphan").alias("kind"), "conv_id", "turn", "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("level"),
        F.lit(False).alias("linked"), F.lit(False).alias("valid"), F.lit(1).cast("long").alias("n_results"),
        F.to_json(F.struct("call_id", F.col("content").alias("result")), {"ignoreNullFields": "false"}).alias("record"),
    )
    return done.unionByName(orphans)


TURN_SCHEMAS: Schemas = {role: {"text": ("string", True), "after": ("string", False)} for role in ("system", "user")}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations in the terms of tool calls: each turn that isn't the assistant's calls for an answer and refers to
    the call two turns before it, so that a conversation is one chain; each of the assistant's turns is the result for
    the turn before it."""
    said = F.coalesce(F.col("role"), F.lit(""))
    arguments = F.to_json(F.struct(F.when(F.col("turn") > 1, F.concat(F.lit("$t"), F.col("turn") - 2)).alias("after"), "text"))
    calls = conversations.where(said != "assistant").select(
        "conv_id", "turn", F.concat(F.lit("t"), "turn").alias("call_id"), F.col("role").alias("name"), arguments.alias("arguments")
    )
    results = conversations.where(said == "assistant").select(
        "conv_id", "turn", F.concat(F.lit("t"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content")
    )
    return calls, results


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(*turns_as_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet")), TURN_SCHEMAS, ["after"])


OP6_SQL = """
WITH calls AS (
  SELECT conv_id, turn, 't' || turn AS call_id, role AS name, text FROM conversations WHERE coalesce(role, '') <> 'assistant'
), results AS (
  SELECT conv_id, turn, 't' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'
), answers AS (
  SELECT conv_id, call_id, count(*) AS n, arg_min(content, (turn, content)) AS content FROM results GROUP BY 1, 2
), once AS (SELECT DISTINCT conv_id, turn FROM calls
), islands AS (
  SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM once
), chained AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level FROM islands
), leveled AS (
  SELECT c.*, o.level::INT AS level FROM calls c LEFT JOIN chained o ON c.conv_id = o.conv_id AND c.turn = o.turn
)
SELECT 'call' AS kind, c.conv_id, c.turn, c.call_id, c.name, c.level, a.n IS NOT NULL AS linked,
  coalesce(c.name IN ('system', 'user') AND c.text IS NOT NULL, false) AS valid, coalesce(a.n, 0) AS n_results,
  '{"arguments":{' || CASE WHEN c.turn > 1 THEN '"after":"$t' || (c.turn - 2) || '"' || CASE WHEN c.text IS NULL THEN '' ELSE ',' END ELSE '' END
  || CASE WHEN c.text IS NULL THEN '' ELSE '"text":' || to_json(c.text) END
  || '},"call_id":"' || c.call_id || '","level":' || c.level || ',"name":' || to_json(c.name) || ',"result":' || coalesce(to_json(a.content)::VARCHAR, 'null') || '}' AS record
FROM leveled c LEFT JOIN answers a ON c.conv_id = a.conv_id AND c.call_id = a.call_id
UNION ALL
SELECT 'orphan', r.conv_id, r.turn, r.call_id, NULL, NULL, false, false, 1, '{"call_id":"' || r.call_id || '","result":' || to_json(r.content) || '}'
FROM results r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
"""
