"""Chat formatting: links tool calls and results, orders them, validates and serialises them.

DataFrame operations alone.  Calls and results meet in hash joins on (conversation,
identifier); only identifiers travel through the ordering rounds, and the messages'
texts are shuffled once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

#: tool -> parameter -> (type, required)
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]

_TYPES = {
    "string": "^STRING$",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*)$",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT<",
    "array": "^ARRAY<",
}

#: The turns of plain conversations as calls of two tools.
TURN_SCHEMAS: Schemas = {
    "reply": {"text": ("string", True), "turn": ("integer", True)},
    "configure": {"text": ("string", True), "turn": ("integer", True)},
}


def argument_status(name: str, arguments: str, schemas: Schemas) -> Column:
    """Null where the arguments (JSON text) suit the tool's schema, else what is wrong with them."""
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    wrong: Column = F.lit("unknown_tool")
    for tool, params in schemas.items():
        bad: Column = F.size(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, params)) if params else F.array().cast("array<string>"))) > 0
        for p, (t, required) in params.items():
            if "'" in p or "\\" in p:
                raise ValueError(f"a parameter's name cannot hold quotes: {p}")
            found = F.schema_of_variant(F.try_variant_get(value, f"$['{p}']", "variant"))
            present = F.array_contains(F.json_object_keys(arguments), p)
            suits = F.coalesce(found.rlike(_TYPES[t]), F.lit(False))
            bad = bad | F.when(present, ~suits).otherwise(F.lit(required))
        wrong = F.when(F.col(name) == tool, F.when(bad, F.lit("bad_arguments"))).otherwise(wrong)
    return F.when(F.coalesce(~kind.startswith("OBJECT<"), F.lit(True)), F.lit("bad_json")).otherwise(wrong)


def depths(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, depth of calls(conv_id, call_id, after): how many calls come before on the way to the first.

    Identifiers are unique within a conversation.  A call after none, or after one
    that does not exist, has depth 0; calls on or behind a cycle have a null depth.
    Pointer doubling: rounds grow with the logarithm of the longest chain.
    """
    ids = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known"))
    start = calls.join(ids, ["conv_id", "after"], "left").select("conv_id", "call_id", F.when(F.col("known"), F.col("after")).alias("far"))
    now = cut(start.withColumn("depth", F.when(F.col("far").isNull(), 0).otherwise(1).cast("long")), "depth")
    longest = now.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(1, int(longest)).bit_length() + 1):
        if now.where("far IS NOT NULL").isEmpty():
            break
        step = now.select("conv_id", F.col("call_id").alias("far"), F.col("far").alias("further"), F.col("depth").alias("more"))
        moved = now.join(step, ["conv_id", "far"], "left").select("conv_id", "call_id", F.col("further").alias("far"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        moved = cut(moved, "depth")
        drop_cut(now)
        now = moved
    return now.select("conv_id", "call_id", F.when(F.col("far").isNull(), F.col("depth")).alias("depth"))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each call and result: conv_id, turn, kind, call_id, name, status, depth, topo, json.

    calls: conv_id, turn, call_id, name, arguments (JSON text), after (a call_id or null);
    results: conv_id, turn, call_id, content.  topo orders a conversation: every call
    comes after the call and the result it follows.  Status of a call: ok, no_id,
    duplicate_id (all calls that share it), unknown_tool, bad_json, bad_arguments, cycle,
    unanswered; of a result: ok, orphan, ambiguous (its id is shared).  json has sorted
    keys and no white space, null fields left out; arguments that are no JSON stay text.
    Null conversation ids link nothing.  Repeated calls share an id; repeated results
    each get a row; other columns are dropped.
    """
    named = calls.where(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull())
    counted = named.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.max("after").alias("after"))
    counted = cut(counted, "calls")
    depth = depths(counted.where("n = 1").select("conv_id", "call_id", "after"))
    answers = results.groupBy("conv_id", "call_id").agg(F.count("*").alias("answers"))
    known = counted.drop("after").join(depth, ["conv_id", "call_id"], "left").join(answers, ["conv_id", "call_id"], "left")
    known = cut(known, "known")
    c = calls.select("conv_id", "turn", "call_id", "name", "arguments", "after").join(known, ["conv_id", "call_id"], "left")
    status = (
        F.when(F.col("n").isNull(), "no_id")
        .when(F.col("n") > 1, "duplicate_id")
        .when(F.col("wrong").isNotNull(), F.col("wrong"))
        .when(F.col("depth").isNull(), "cycle")
        .when(F.col("answers").isNull(), "unanswered")
        .otherwise("ok")
    )
    value = F.try_parse_json("arguments")
    with_value = F.to_json(F.struct("after", value.alias("arguments"), F.col("call_id").alias("id"), "name"))
    with_text = F.to_json(F.struct("after", "arguments", F.col("call_id").alias("id"), "name"))
    c = c.withColumn("wrong", argument_status("name", "arguments", schemas))
    c = c.select("conv_id", "turn", F.lit("call").alias("kind"), "call_id", "name", status.alias("status"), "depth", (2 * F.col("depth")).alias("topo"), F.when(value.isNull(), with_text).otherwise(with_value).alias("json"))
    r = results.select("conv_id", "turn", "call_id", "content").join(known, ["conv_id", "call_id"], "left")
    found = F.when(F.col("n").isNull(), "orphan").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    text = F.to_json(F.struct("content", F.col("call_id").alias("id")))
    r = r.select("conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.lit(None).cast("string").alias("name"), found.alias("status"), "depth", (2 * F.col("depth") + 1).alias("topo"), text.alias("json"))
    return c.unionByName(r)


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text).

    A user or system turn calls reply or configure with its text; an assistant turn is
    the result of the turn before it.  A call follows the latest call before it, which a
    hash join on (conversation, turn - 1) finds.  Roles other than these call a tool of
    their name; null roles, turns or conversations give calls without id or tool.
    """
    name_of = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    own = turns.select("conv_id", "turn", "role", "text")
    before = own.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.max("role").alias("before"))
    tool = F.when(F.col("role") == "user", "reply").when(F.col("role") == "system", "configure").otherwise(F.col("role"))
    asked = own.where(F.coalesce(F.col("role"), F.lit("")) != "assistant").join(before, ["conv_id", "turn"], "left")
    after = F.when(F.col("before") == "assistant", name_of(F.col("turn") - 2)).when(F.col("before").isNotNull(), name_of(F.col("turn") - 1))
    calls = asked.select("conv_id", "turn", name_of(F.col("turn")).alias("call_id"), tool.alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"), after.alias("after"))
    results = own.where("role = 'assistant'").select("conv_id", "turn", name_of(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def from_json(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of messages (conv_id, turn, role, text) whose texts are JSON:
    {"tool_calls": [{"id", "name", "arguments", "after"}]} or {"tool_call_id", "content"}; other texts give none."""
    value = F.from_json("text", "tool_calls array<struct<id:string,name:string,arguments:string,after:string>>, tool_call_id string, content string")
    m = messages.select("conv_id", "turn", value.alias("m"))
    calls = m.select("conv_id", "turn", F.explode("m.tool_calls").alias("c")).select("conv_id", "turn", F.col("c.id").alias("call_id"), "c.name", "c.arguments", "c.after")
    results = m.where("m.tool_call_id IS NOT NULL").select("conv_id", "turn", F.col("m.tool_call_id").alias("call_id"), F.col("m.content").alias("content"))
    return calls, results
