"""Chat formatting: tool calls linked to their results, in topological order, as canonical JSON.

DataFrame functions only. Calls and results meet by a hash aggregation on (conversation, identifier),
so copies of an identifier are combined before the shuffle. Arguments are parsed to variants, whose
keys are sorted, which makes their JSON canonical. Levels of the dependency graph are found in
rounds over identifiers; the texts take no part in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: JSON type names and how the schema of a variant reads.
KINDS = {
    "string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*",
    "array": "ARRAY.*", "null": "VOID"
}


def _errors(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """Messages on what the arguments lack against the schema of their tool, in the schema's order; null arguments and unknown tools are errors."""
    value = F.try_parse_json(arguments)
    out = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        fields = schema.get("properties", {})
        checks = []
        for field, kind in fields.items():
            part = F.try_variant_get(value, f"$['{field}']", "variant")
            if field in schema.get("required", ()):
                checks.append(F.when(part.isNull(), F.lit(f"missing {field}")))
            wrong = part.isNotNull() & ~F.schema_of_variant(part).rlike(f"^({KINDS[kind]})$")
            checks.append(F.when(wrong, F.lit(f"not {kind}: {field}")))
        if not schema.get("additional", False):
            keys = F.array_sort(
                F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, fields)) if fields else F.array().cast("array<string>"))
            )
            checks.append(F.when(F.size(keys) > 0, F.concat(F.lit("unexpected "), F.array_join(keys, ","))))
        mine = F.when(
            value.isNull() | ~F.schema_of_variant(value).startswith("OBJECT"), F.array(F.lit("arguments are no JSON object"))
        ).otherwise(F.array_compact(F.array(*checks)))
        out = F.when(name == tool, mine).otherwise(out)
    return out


def levels(calls: DataFrame) -> DataFrame:
    """(conv, call_id, level) of calls (conv, call_id, depends_on), identifiers being unique in a conversation.

    Level 0 depends on nothing that exists; others come one level after the last they depend on.
    Calls on a cycle, or after one, have level -1. A null conversation or identifier is a value like
    others, but a null among the dependencies is none. A round for each level, over
    the edges that are still open and what was ready in the round before.
    """
    nodes = calls.select("conv", "call_id")
    edges = calls.select("conv", "call_id", F.explode("depends_on").alias("dep")).where("dep is not null").distinct().alias("e")
    here = nodes.select(F.col("conv").alias("_c"), F.col("call_id").alias("_d"))
    edges = cut(
        edges.join(here, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("dep") == F.col("_d")), "left_semi").withColumn("at", F.lit(None).cast("int"))
    )
    target = edges.select(F.col("conv").alias("_c"), F.col("call_id").alias("_d"))
    same = F.col("conv").eqNullSafe(F.col("_c")) & F.col("call_id").eqNullSafe(F.col("_d"))
    ready = cut(nodes.join(target, same, "left_anti").withColumn("level", F.lit(0)))
    done = [ready]
    while not edges.isEmpty():
        new = ready.select(F.col("conv").alias("_c"), F.col("call_id").alias("_d"), "level")
        edges = edges.join(
            new, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("dep") == F.col("_d")), "left"
        ).select("conv", "call_id", "dep", F.coalesce("at", F.col("level") + 1).alias("at"))
        edges = cut(edges)
        ready = cut(
            edges.groupBy("conv", "call_id").agg(
                F.count("*").alias("n"), F.count("at").alias("k"), F.max("at").alias("level")
            ).where("n = k").select("conv", "call_id", "level")
        )
        if ready.isEmpty():
            break
        done.append(ready)
        edges = cut(edges.join(ready.select(F.col("conv").alias("_c"), F.col("call_id").alias("_d")), same, "left_anti"))
    done.append(edges.select("conv", "call_id", F.lit(-1).alias("level")).distinct())
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


#: A string, or a number written with needless zeros: 100.0 and 1.50 (strings stay as they are).
_NUMBERS = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|(-?\d++)\.0++(?![\dEe])|(-?\d++\.\d*?[1-9])0++(?![\dEe])'


def canonical(value: Column) -> Column:
    """A variant as JSON: keys sorted, no white space, numbers without needless zeros (1e2, 100 and 100.00 are 100).

    Numbers that are printed with an exponent (from 1e7 if written so) keep it.
    """
    return F.regexp_replace(F.to_json(value), _NUMBERS, "$1$2$3")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each identifier of a conversation, with its canonical JSON.

    calls: conv, call_id, turn, name, arguments (JSON text), depends_on (array of call_id).
    results: conv, call_id, turn, content. Where an identifier occurs again the earliest call and result
    count (then the smaller text); ``n_calls`` and ``n_results`` tell. status: linked, no_result or
    orphan (a result without a call). Rows whose conversation or identifier is null are kept as one
    row for each such pair. ``level`` is null for orphans. (level, turn, call_id) is a topological
    order of a conversation. ``errors`` has what the schemas object to; valid is true if nothing.
    Arguments that repeat a key are no JSON object. Other columns take no part, whatever their names.
    Empty tables give an empty result.
    """
    none = F.lit(None)
    head = F.struct("turn", "name", "arguments", F.col("depends_on").alias("depends_on"))
    answer = F.struct("turn", "content")
    one = calls.select("conv", "call_id", head.alias("call"), none.cast("struct<turn:bigint,content:string>").alias("result"))
    two = results.select("conv", "call_id", none.cast(one.schema["call"].dataType).alias("call"), answer.alias("result"))
    both = one.unionByName(two).groupBy("conv", "call_id").agg(
        F.min("call").alias("call"), F.min("result").alias("result"), F.count("call").alias("n_calls"), F.count("result").alias("n_results")
    )
    ids = both.where("call is not null").select("conv", "call_id", F.col("call.depends_on").alias("depends_on"))
    found = levels(ids).select(F.col("conv").alias("_c"), F.col("call_id").alias("_d"), "level")
    both = both.join(found, F.col("conv").eqNullSafe(F.col("_c")) & F.col("call_id").eqNullSafe(F.col("_d")), "left").drop("_c", "_d")
    arguments = F.col("call.arguments")
    out = both.select(
        "conv", "call_id", F.coalesce("call.turn", "result.turn").alias("turn"), F.col("call.name").alias("name"), "level", "n_calls", "n_results",
        F.when(F.col("call").isNull(), "orphan").when(F.col("result").isNull(), "no_result").otherwise("linked").alias("status"),
        F.when(F.col("call").isNull(), F.array().cast("array<string>")).otherwise(_errors(F.coalesce(F.col("call.name"), F.lit("")), arguments, schemas)).alias("errors"),
        F.try_parse_json(arguments).alias("a"), F.col("call.depends_on").alias("d"), F.col("result.content").alias("c"),
    )
    text = lambda c: F.regexp_extract(
        F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1
    )  # noqa: E731  a value as JSON
    record = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.col("a")), F.lit("null")), F.lit(',"call_id":'), text(F.col("call_id")),
        F.lit(',"depends_on":'), text(F.array_sort(F.coalesce("d", F.array().cast("array<string>")))), F.lit(',"level":'), F.coalesce(F.col("level").cast("string"), F.lit("null")),
        F.lit(',"name":'), text(F.col("name")), F.lit(',"result":'), text(F.col("c")), F.lit("}"),
    )
    return out.select(
        "conv", "call_id", "turn", "name", "level", "n_calls", "n_results", "status", (F.size("errors") == 0).alias("valid"),
        F.array_join("errors", "; ").alias("errors"), record.alias("record")
    )


def from_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results out of chat messages in the common JSON form.

    messages: conv, turn, role, text. An assistant's text ``{"tool_calls": [{"id", "name", "arguments",
    "depends_on"}]}`` makes calls (arguments may be an object or its JSON text); a tool's text
    ``{"tool_call_id", "content"}`` a result. Other texts, and those that don't parse, make none.
    """
    shape = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>>"
    one = messages.where("role = 'assistant'").select("conv", "turn", F.explode(F.from_json("text", shape)["tool_calls"]).alias("c"))
    calls = one.select("conv", F.col("c.id").alias("call_id"), F.col("turn").cast("long").alias("turn"), "c.name", "c.arguments", "c.depends_on")
    got = messages.where("role = 'tool'").select("conv", "turn", F.from_json("text", "struct<tool_call_id:string,content:string>").alias("r"))
    return calls, got.where("r.tool_call_id is not null").select(
        "conv", F.col("r.tool_call_id").alias("call_id"), F.col("turn").cast("long").alias("turn"), "r.content"
    )


#: What the turns of a conversation are as calls: a system turn configures, a user turn asks.
SCHEMAS = {
    "configure": {"properties": {"n_chars": "integer", "text": "string"}, "required": ["text"]},
    "ask": {"properties": {"n_chars": "integer", "text": "string"}, "required": ["text"]},
}


def conversation_calls(conversations: DataFrame) -> DataFrame:
    """Every system or user turn of a conversation as a call that depends on its turn 0, the assistant's next turn as its result.

    Real tool calls in assistants' texts and the tools' results (see ``from_messages``) are linked
    beside them, under their own identifiers; a tool without a schema here is an error, ``unknown tool``.
    A tool call whose identifier reads like that of a turn (turn0) is taken for the same call.
    Other roles, null ones too, are no calls. A null text gives arguments without text, which is
    an error by the schema.
    """
    rows = conversations.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text")
    )
    ident = lambda turn: F.concat(F.lit("turn"), turn.cast("string"))
    calls = rows.where("role in ('system', 'user')").select(
        "conv", ident(F.col("turn")).alias("call_id"), "turn", F.when(F.col("role") == "system", "configure").otherwise("ask").alias("name"),
        F.to_json(F.struct(F.length("text").alias("n_chars"), "text")).alias("arguments"),
        F.when(F.col("turn") > 0, F.array(ident(F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = rows.where("role = 'assistant'").select("conv", ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    more, answers = from_messages(rows)
    return link(calls.unionByName(more), results.unionByName(answers), SCHEMAS)
