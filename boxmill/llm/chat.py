"""Operator 8, chat formatting: tool calls and their results linked, ordered, validated and serialised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Tool -> field -> (JSON type, required[, allowed values]). A field is a path (`place.city`); a type may be
#: array<type>. `ask` is what a plain user turn calls.
SCHEMAS = {"ask": {"text": ("string", True), "turn": ("integer", True)}}
#: Fixed names: JSON type -> pattern of the type's name as Spark prints a variant's schema.
TYPES = {"string": "STRING", "integer": "(BIGINT|TINYINT|SMALLINT|INT|DECIMAL\\(\\d+,0\\))", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL\\(\\d+,\\d+\\))", "boolean": "BOOLEAN", "array": "ARRAY<.*>", "object": "OBJECT<.*>"}
#: Fixed form of an assistant turn that calls tools, and of a tool turn that answers.
CALLS = "struct<content: variant, tool_calls: array<struct<id: string, name: string, after: variant, arguments: variant>>>"
RESULT = "struct<id: string, content: string>"
TEXTS = "array<string>"


def _strings(value: Column) -> Column:
    """The distinct strings of a JSON array, or of one string, sorted; none of anything else."""
    many = F.schema_of_variant(value).startswith("ARRAY<")
    one = F.when(F.schema_of_variant(value) == "STRING", F.array(F.try_variant_get(value, "$", "string")))
    return F.sort_array(F.array_distinct(F.array_compact(F.coalesce(F.when(many, F.try_variant_get(value, "$", TEXTS)), one, F.array().cast(TEXTS)))))


def messages(conversations: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, kind, name, call_id, after, arguments (JSON), content.

    An assistant turn whose text is a JSON object with an array tool_calls gives a call for each
    of its objects, whose `after` is an id or a list of ids, and a message for a text beside them;
    a tool turn {"id": ..., "content": ...} gives a result. Every turn gives a row. Any other
    user turn is a call of `ask` with the id conv_id:turn that comes after the
    user turn two before; an assistant turn answers the turn before it. Other
    turns are messages. Without conversation or turn there is no id.
    """
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    json = F.try_parse_json("text")
    calls = F.schema_of_variant(F.try_variant_get(json, "$.tool_calls", "variant")).startswith("ARRAY<")
    made = F.when((F.col("role") == "assistant") & calls, F.from_json("text", CALLS))
    listed = F.array_compact(made["tool_calls"])
    answer = F.when((F.col("role") == "tool") & F.schema_of_variant(json).startswith("OBJECT"), F.from_json("text", RESULT))
    beside = F.when(F.schema_of_variant(made["content"]) == "STRING", F.try_variant_get(made["content"], "$", "string"))
    c = c.withColumns({"_made": F.when(F.size(listed) > 0, listed), "_beside": F.when(F.size(listed) > 0, beside), "_answer": answer})

    def turn_id(back: int) -> Column:
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))

    none = F.lit(None).cast("string")
    tools = c.where("_made is not null").select("conv_id", "turn", "role", F.explode("_made").alias("m"))
    tools = tools.select("conv_id", "turn", "role", F.lit("call").alias("kind"), "m.name", F.col("m.id").alias("call_id"), _strings(F.col("m.after")).alias("after"), F.to_json("m.arguments").alias("arguments"), none.alias("content"))
    answers = c.where("_answer is not null").select("conv_id", "turn", "role", F.lit("result").alias("kind"), none.alias("name"), F.col("_answer.id").alias("call_id"), F.lit(None).cast(TEXTS).alias("after"), none.alias("arguments"), F.col("_answer.content").alias("content"))
    asks, replies = F.col("role") == "user", F.col("role") == "assistant"
    plain = c.where("_made is null and _answer is null").select(
        "conv_id", "turn", "role", F.when(asks, "call").when(replies, "result").otherwise("message").alias("kind"), F.when(asks, "ask").alias("name"),
        F.when(asks, turn_id(0)).when(replies, turn_id(1)).alias("call_id"), F.when(asks, F.array_compact(F.array(turn_id(2)))).alias("after"),
        F.when(asks, F.to_json(F.struct("text", "turn"))).alias("arguments"), F.when(~asks | F.col("role").isNull(), F.col("text")).alias("content"),
    )
    texts = c.where("_beside <> ''").select("conv_id", "turn", "role", F.lit("message").alias("kind"), none.alias("name"), none.alias("call_id"), F.lit(None).cast(TEXTS).alias("after"), none.alias("arguments"), F.col("_beside").alias("content"))
    return plain.unionByName(tools).unionByName(answers).unionByName(texts)


def _chains(nodes: DataFrame) -> DataFrame:
    """(_conv, call_id, head, off) of nodes (_conv, call_id, pred): the head of its chain and the steps to it. Pointers double each round.

    A node without `pred` is a head; the chains of a cycle have no head and are left out.
    """
    at = cut(nodes.select("_conv", "call_id", F.coalesce("pred", "call_id").alias("head"), F.when(F.col("pred").isNull(), 0).otherwise(1).cast("long").alias("off"), F.col("pred").isNull().alias("done")), "chains")
    most = at.groupBy("_conv").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach <= 2 * most and not at.where("not done").isEmpty():
        to = at.select("_conv", F.col("call_id").alias("head"), F.col("head").alias("next"), F.col("off").alias("more"), F.col("done").alias("met"))
        far = at.where("not done").join(to, ["_conv", "head"]).select("_conv", "call_id", F.col("next").alias("head"), (F.col("off") + F.col("more")).alias("off"), F.col("met").alias("done"))
        at = cut(at.where("done").unionByName(far), "chains")
        reach *= 2
    return at.where("done").drop("done")


def _depths(calls: DataFrame) -> DataFrame:
    """(_conv, call_id, preds, depth): the calls of the conversation that must come right before, and how many come before on the longest way; null in or behind a cycle.

    Chains of calls with one predecessor are compressed; the others, where ways
    meet, are then settled in layers, each from settled ones only.
    """
    ids = cut(calls.select("_conv", "call_id").distinct(), "call-ids")
    edges = calls.select("_conv", "call_id", F.explode("after").alias("pred")).distinct().join(ids.withColumnRenamed("call_id", "pred"), ["_conv", "pred"])
    preds = edges.groupBy("_conv", "call_id").agg(F.sort_array(F.collect_set("pred")).alias("preds"))
    nodes = cut(ids.join(preds, ["_conv", "call_id"], "left"), "calls")
    chains = cut(_chains(nodes.select("_conv", "call_id", F.when(F.size("preds") == 1, F.col("preds")[0]).alias("pred"))), "chained")
    settled = cut(nodes.where("preds is null").select("_conv", F.col("call_id").alias("head"), F.lit(0).cast("long").alias("depth")), "settled")
    joins = nodes.where("size(preds) > 1").select("_conv", F.col("call_id").alias("to"), F.size("preds").alias("n"), F.explode("preds").alias("call_id"))
    joins = cut(joins.join(chains, ["_conv", "call_id"]).select("_conv", "to", "n", "head", (F.col("off") + 1).alias("more")), "joins")
    new = settled
    while not joins.isEmpty():
        ready = joins.join(settled, ["_conv", "head"]).groupBy("_conv", "to", "n").agg(F.count("*").alias("k"), F.max(F.col("depth") + F.col("more")).alias("depth")).where("k = n")
        new = cut(ready.select("_conv", F.col("to").alias("head"), "depth").join(settled.select("_conv", "head"), ["_conv", "head"], "left_anti"), "layer")
        if new.isEmpty():
            break
        settled = cut(settled.unionByName(new), "settled")
    depths = chains.join(settled, ["_conv", "head"]).select("_conv", "call_id", (F.col("depth") + F.col("off")).alias("depth"))
    return nodes.join(depths, ["_conv", "call_id"], "left")


def _pattern(kind: str) -> str:
    """The pattern of a type's name; array<type> has items of that type, or none."""
    inner = kind.removeprefix("array<").removesuffix(">")
    return TYPES[kind] if inner == kind else f"ARRAY<({_pattern(inner)}|VOID)>"


def _errors(name: Column, arguments: Column, schemas: dict) -> Column:
    """What is wrong with the arguments of a call, sorted; empty if nothing is."""
    value = F.try_parse_json(arguments)
    found: Column | None = None
    for tool, fields in sorted(schemas.items()):
        checks = []
        for field, (kind, required, *allowed) in sorted(fields.items()):
            got = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
            wrong = F.when(~got.rlike(f"^{_pattern(kind)}$"), F.lit(f"{field}: not {kind}"))
            if allowed and allowed[0]:
                wrong = wrong.when(~F.try_variant_get(value, f"$.{field}", "string").isin(list(allowed[0])), F.lit(f"{field}: not allowed"))
            checks.append(F.when(got.isNull() | (got == "VOID"), F.lit(f"{field}: missing") if required else F.lit(None)).otherwise(wrong))
        names = sorted({f.split(".")[0] for f in fields})
        extra = F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast(TEXTS)), F.lit(names))
        here = F.concat(F.array_compact(F.array(*checks)), F.transform(F.sort_array(extra), lambda x: F.concat(x, F.lit(": unknown"))))
        here = F.when(value.isNull() | ~F.schema_of_variant(value).startswith("OBJECT"), F.array(F.lit("arguments: not an object"))).otherwise(here)
        found = F.when(name == tool, here) if found is None else found.when(name == tool, here)
    other = F.array(F.lit("unknown tool"))
    return other if found is None else found.otherwise(other)


def schemas_of(table: DataFrame) -> dict:
    """Schemas from a table of tool, field, type, required and, if wanted, allowed (a list), added to SCHEMAS.

    A row is a field, and a null field a tool without any. The table describes
    tools, so it is small and read whole.
    """
    found: dict[str, dict] = {}
    more = ["allowed"] if "allowed" in table.columns else []
    for r in table.select("tool", "field", "type", "required", *more).collect():
        fields = found.setdefault(r["tool"], {})
        if r["field"] is not None:
            fields[r["field"]] = (r["type"], bool(r["required"]), *(tuple(r[c] or ()) for c in more))
    return SCHEMAS | found


def link_tool_calls(rows: DataFrame, schemas: dict | DataFrame = SCHEMAS) -> DataFrame:
    """Per message of `rows` (as messages() gives them): its links, depth, verdict and canonical JSON.

    Calls and results meet in a hash join by conversation and call_id, as ids are
    unique inside a conversation only; the null conversation is one. A call's depth is the
    number of calls on the longest way to it, by `after`, so (depth, turn) is a
    topological order; a call in or behind a cycle has none and is an error, and
    ids in `after` that no call has count as none. Arguments are held against the
    tool's schema, given as a dict or as a table for schemas_of(). JSON has sorted keys and no blanks.

    linked: the call has a result, or the result a call. Of repeated results
    the least text stands for the call, and n_results tells how many there were;
    repeated calls each keep their row, and share links and predecessors. Null
    ids link nothing. Texts of any length are parsed whole. Empty tables give an
    empty result.
    """
    schemas = schemas_of(schemas) if isinstance(schemas, DataFrame) else schemas
    # a text that tells a null conversation from all others
    rows = rows.withColumn("_conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    named = rows.where("call_id is not null")
    results = named.groupBy("_conv", "call_id").agg(F.count_if(F.col("kind") == "call").alias("n_calls"), F.count_if(F.col("kind") == "result").alias("n_results"), F.min(F.when(F.col("kind") == "result", F.col("content"))).alias("result"))
    depths = _depths(named.where("kind = 'call'").select("_conv", "call_id", "after"))
    about = results.join(depths, ["_conv", "call_id"], "left")
    out = rows.drop("after").join(about, ["_conv", "call_id"], "left")
    call, known = F.col("kind") == "call", F.col("call_id").isNotNull()
    preds = F.coalesce("preds", F.array().cast(TEXTS))
    cyclic = call & known & F.col("depth").isNull()
    errors = F.when(call, F.concat(_errors(F.col("name"), F.col("arguments"), schemas), F.when(cyclic, F.array(F.lit("cycle"))).otherwise(F.array().cast(TEXTS))))
    out = out.withColumns({
        "linked": F.when(call, F.coalesce(F.col("n_results") > 0, F.lit(False))).when(F.col("kind") == "result", F.coalesce(F.col("n_calls") > 0, F.lit(False))).otherwise(F.lit(False)),
        "depth": F.when(call & ~known, F.lit(0).cast("long")).when(F.col("kind") != "message", F.col("depth")),
        "n_results": F.when(call, F.coalesce("n_results", F.lit(0))),
        "errors": errors,
    })
    keep_nulls = {"ignoreNullFields": "false"}
    as_call = F.to_json(F.struct(preds.alias("after"), F.coalesce(F.try_parse_json("arguments"), F.to_variant_object(F.array("arguments"))).alias("arguments"), "call_id", "depth", "name", "result", (F.size("errors") == 0).alias("valid")), keep_nulls)
    as_other = F.to_json(F.struct("call_id", "content", "role"), keep_nulls)
    return out.select("conv_id", "turn", "role", "kind", "call_id", F.when(call, F.array_join(preds, ",")).alias("after"), "depth", "linked", "n_results", (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), F.when(call, as_call).otherwise(as_other).alias("json"))
