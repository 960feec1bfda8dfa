"""Tool-call linking in conversations, with DataFrame functions only.

Calls and results are read from the turns, hash-joined by conversation and identifier, put in
topological order, validated against the schemas of their tools, and serialised as canonical JSON
(keys sorted at every depth, no white space, numbers in one form).

Turns: a text that is a JSON object with `tool_calls` (array of id, name, arguments, after) holds
calls, and a turn of role `tool` with `tool_call_id` and `content` is a result. In plain turns the
conversation itself is linked: a user turn t is a call of the tool `reply` with identifier t, which
follows the call of turn t - 2, a system turn is a call of `instruct`, and an assistant turn t is the
result of call t - 1.

Order: (place, level, turn, nth). A call's place is its own turn unless it has to wait for a call
of a later place; calls that wait for others of the same place have higher levels. Where each call
comes after those it names, which is checked first, no iteration is needed. Calls in or behind a
cycle have a null place and level.

Repeated calls of one identifier count as one (the first by turn; n_calls tells how many), repeated
results likewise. A result without a call is an `orphan` row. Rows with a null conv_id, turn or role
name nothing and are left out; a null text is an argument `text` that is missing. References to unknown
identifiers or to the call itself are errors and no edges.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import checkpointed

#: Tools of plain conversations: field, type, whether it is required.
PLAIN_SCHEMAS: Mapping[str, tuple[tuple[str, str, bool], ...]] = {
    "reply": (("text", "string", True), ("turn", "integer", True)),
    "instruct": (("text", "string", True), ("turn", "integer", True)),
}
CALLS = "tool_calls array<struct<id string, name string, arguments string, after array<string>>>"
RESULT = "tool_call_id string, content string"


def read_calls(messages: DataFrame) -> DataFrame:
    """conv_id, turn, nth, call_id, name, arguments (JSON text), after: calls of all turns."""
    turns = _turns(messages)
    parsed = turns.withColumn("held", F.from_json(F.when(F.col("text").startswith("{"), F.col("text")), CALLS)["tool_calls"])
    stated = parsed.where(F.col("held").isNotNull()).select("conv_id", "turn", F.posexplode("held").alias("nth", "call")).select(
        "conv_id", "turn", "nth", F.col("call.id").alias("call_id"), "call.name", "call.arguments", "call.after"
    )
    turn = F.col("turn").cast("string")
    plain = parsed.where(F.col("held").isNull() & F.col("role").isin("user", "system")).select(
        "conv_id",
        "turn",
        F.lit(0).alias("nth"),
        turn.alias("call_id"),
        F.when(F.col("role") == "user", "reply").otherwise("instruct").alias("name"),
        F.to_json(F.struct("text", "turn")).alias("arguments"),
        F.when((F.col("role") == "user") & (F.col("turn") >= 2), F.array((F.col("turn") - 2).cast("string"))).alias("after"),
    )
    return stated.where(F.col("call_id").isNotNull()).unionByName(plain)


def read_results(messages: DataFrame) -> DataFrame:
    """conv_id, turn, call_id, content: results of all turns."""
    turns = _turns(messages)
    told = F.from_json(F.when(F.col("role") == "tool", F.col("text")), RESULT)
    stated = turns.where(F.col("role") == "tool").select(
        "conv_id", "turn", told["tool_call_id"].alias("call_id"), told["content"].alias("content")
    )
    has_calls = F.from_json(F.when(F.col("text").startswith("{"), F.col("text")), CALLS)["tool_calls"].isNotNull()
    plain = turns.where((F.col("role") == "assistant") & ~F.coalesce(has_calls, F.lit(False))).select(
        "conv_id", "turn", (F.col("turn") - 1).cast("string").alias("call_id"), F.col("text").alias("content")
    )
    return stated.where(F.col("call_id").isNotNull()).unionByName(plain)


def _turns(messages: DataFrame) -> DataFrame:
    return messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    ).where("conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL")


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with the results of their identifiers, and results without a call, one row for each identifier."""
    keys = ["conv_id", "call_id"]
    first = F.struct("turn", "nth", "name", "arguments", "after")
    one_call = calls.groupBy(*keys).agg(F.min(first).alias("call"), F.count(F.lit(1)).alias("n_calls"))
    one_result = results.groupBy(*keys).agg(
        F.min(F.struct("turn", "content")).alias("result"), F.count(F.lit(1)).alias("n_results")
    )
    columns = [
        *keys,
        F.col("call.name").alias("name"),
        F.col("call.turn").alias("call_turn"),
        F.col("call.nth").alias("nth"),
        F.col("call.arguments").alias("arguments"),
        F.col("call.after").alias("after"),
        F.col("result.turn").alias("result_turn"),
        F.col("result.content").alias("content"),
        F.coalesce("n_calls", F.lit(0).cast("long")).alias("n_calls"),
        F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"),
    ]
    answered = one_call.join(one_result.hint("shuffle_hash"), keys, "left").select(*columns)
    none = F.lit(None).cast(one_call.schema["call"].dataType)
    orphans = (
        one_result.join(one_call.select(*keys), keys, "left_anti")
        .withColumn("call", none)
        .withColumn("n_calls", F.lit(0).cast("long"))
        .select(*columns)
    )
    return answered.unionByName(orphans)


def edges_of(linked: DataFrame) -> DataFrame:
    """conv_id, call_id, needs: references to other calls of the conversation that exist."""
    calls = linked.where("n_calls > 0").select("conv_id", "call_id", "after")
    stated = calls.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("needs")).where("needs <> call_id")
    return stated.join(calls.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_semi")


def topological(linked: DataFrame) -> DataFrame:
    """The same rows with place and level (see above)."""
    where = linked.where("n_calls > 0").select("conv_id", F.col("call_id").alias("needs"), F.struct("call_turn", "nth").alias("theirs"))
    edges = edges_of(linked)
    late = (
        edges.join(where, ["conv_id", "needs"])
        .join(linked.select("conv_id", "call_id", F.struct("call_turn", "nth").alias("mine")), ["conv_id", "call_id"])
        .where("theirs >= mine")
        .select("conv_id")
        .distinct()
    )
    start = linked.withColumn("place", F.coalesce("call_turn", "result_turn")).withColumn("level", F.lit(0))
    if late.isEmpty():
        return start
    # only conversations with a call before one that it needs are ordered step by step
    late = checkpointed(late)
    mine = checkpointed(linked.join(late, "conv_id", "left_semi").where("n_calls > 0").select("conv_id", "call_id", "call_turn"))
    open_edges = checkpointed(edges.join(late, "conv_id", "left_semi"))
    free = mine.join(open_edges.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
    done = checkpointed(free.select("conv_id", "call_id", F.col("call_turn").alias("place"), F.lit(0).alias("level")))
    settled = done.count()
    while True:
        ready = (
            open_edges.join(
                done.select("conv_id", F.col("call_id").alias("needs"), F.col("place").alias("p"), F.col("level").alias("l")),
                ["conv_id", "needs"],
                "left",
            )
            .groupBy("conv_id", "call_id")
            .agg(F.count_if(F.col("p").isNull()).alias("waits"), F.max(F.struct("p", "l")).alias("after"))
            .where("waits = 0")
            .join(mine, ["conv_id", "call_id"])
            .select(
                "conv_id",
                "call_id",
                F.greatest("call_turn", "after.p").alias("place"),
                F.when(F.col("call_turn") > F.col("after.p"), 0).otherwise(F.col("after.l") + 1).alias("level"),
            )
        )
        done = checkpointed(
            done.join(ready.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").unionByName(ready)
        )
        now = done.count()
        if now == settled:
            break
        settled = now
    # a call without a step is in or behind a cycle
    stepped = done.withColumnRenamed("place", "p").withColumnRenamed("level", "l").withColumn("known", F.lit(True))
    in_late = late.withColumn("stepwise", F.lit(True))
    return (
        start.join(in_late, "conv_id", "left")
        .join(stepped, ["conv_id", "call_id"], "left")
        .withColumn("place", F.when(F.col("stepwise") & (F.col("n_calls") > 0), F.col("p")).otherwise(F.col("place")))
        .withColumn("level", F.when(F.col("stepwise") & (F.col("n_calls") > 0), F.col("l")).otherwise(F.col("level")))
        .drop("p", "l", "known", "stepwise")
    )


def validate(linked: DataFrame, schemas: Mapping[str, tuple[tuple[str, str, bool], ...]]) -> DataFrame:
    """The same rows with parsed (VARIANT of the arguments) and errors (sorted array of text)."""
    spark = linked.sparkSession
    rows = [(name, [tuple(f) for f in fields]) for name, fields in sorted(schemas.items())]
    tools = spark.createDataFrame(rows, "name string, fields array<struct<field string, type string, required boolean>>")
    parsed = linked.withColumn("parsed", F.try_parse_json("arguments"))
    given = F.expr("try_cast(parsed AS map<string, variant>)")
    known = parsed.withColumn("given", given).join(tools, "name", "left")

    def error(f):
        value = F.element_at("given", f["field"])
        shape = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
        named = (
            F.when(shape == "BIGINT", "integer")
            .when(shape.isin("DECIMAL", "DOUBLE", "FLOAT"), "number")
            .when(shape == "STRING", "string")
            .when(shape == "BOOLEAN", "boolean")
            .when(shape == "ARRAY", "array")
            .when(shape == "OBJECT", "object")
            .otherwise("null")
        )
        fits = (named == f["type"]) | ((f["type"] == "number") & (named == "integer"))
        return (
            F.when(value.isNull() & f["required"], F.concat(F.lit("missing "), f["field"]))
            .when(value.isNotNull() & ~fits, F.concat(F.lit("type "), f["field"]))
            .otherwise(F.lit(None).cast("string"))
        )

    extra = F.transform(
        F.array_except(F.map_keys("given"), F.col("fields.field")), lambda k: F.concat(F.lit("unexpected "), k)
    )
    errors = (
        F.when(F.col("n_calls") == 0, F.array().cast("array<string>"))
        .when(F.col("fields").isNull(), F.array(F.lit("unknown tool")))
        .when(F.col("given").isNull(), F.array(F.lit("arguments are no object")))
        .otherwise(F.sort_array(F.concat(F.filter(F.transform("fields", error), lambda e: e.isNotNull()), extra)))
    )
    return known.withColumn("errors", errors).drop("given", "fields")


def format_tool_calls(
    messages: DataFrame, schemas: Mapping[str, tuple[tuple[str, str, bool], ...]] = PLAIN_SCHEMAS
) -> DataFrame:
    """One row for each identifier of a conversation.

    conv_id, call_id, name, call_turn, result_turn, place, level, status (linked, unanswered, orphan),
    n_calls, n_results, errors, canonical_json.
    """
    linked = topological(link(read_calls(messages), read_results(messages)))
    status = (
        F.when(F.col("n_calls") == 0, "orphan").when(F.col("n_results") == 0, "unanswered").otherwise("linked")
    )
    checked = validate(linked, schemas).withColumn("status", status)
    # fields in the order of their names
    body = F.struct(
        F.col("parsed").alias("arguments"),
        F.col("call_id").alias("id"),
        F.col("name"),
        F.col("content").alias("result"),
        F.col("status"),
    )
    return checked.select(
        "conv_id",
        "call_id",
        "name",
        "call_turn",
        "result_turn",
        "place",
        "level",
        "status",
        "n_calls",
        "n_results",
        F.array_join("errors", "; ").alias("errors"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("canonical_json"),
    )
