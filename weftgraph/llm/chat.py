"""Chat formatting by linking tool calls to their results. DataFrame functions only.

A message is plain text, or a JSON object: an assistant's ``{"content": ..., "tool_calls": [{"id", "name", "arguments"},
...]}`` or a tool's ``{"tool_call_id": ..., "content": ...}``. Messages become events: one for the message, one for
each call, one for each result. Calls and results are hash-joined by (conversation, identifier). The order is
topological: an event keeps the place of its turn, unless it is a result that comes before its call; then it moves
behind the call. Arguments are checked against schemas. Every event is serialised as canonical JSON: keys sorted,
no blanks, null members left out.

Positions are counted over one global range partitioning by (conversation, place), so a conversation that holds a large
share of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from weftgraph.llm.skew import look_up
from weftgraph.session import cut

MESSAGE = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>,tool_call_id:string>"
#: Schema rows of the tools that the query knows: (tool, field, kind, required). Kinds are those of JSON, and ``any``.
TOOLS = [
    ("search", "query", "string", True),
    ("search", "limit", "integer", False),
    ("calculate", "expression", "string", True),
    ("fetch", "url", "string", True),
    ("fetch", "headers", "object", False),
]
TOOLS_DDL = "tool string, field string, kind string, required boolean"
EVENT_COLUMNS = ["conv_id", "position", "turn", "kind", "role", "call_id", "tool", "status", "errors", "json"]


def canonical(json: Column) -> Column:
    """Canonical form of JSON text: a variant keeps its keys sorted. Null where the text is no JSON."""
    return F.to_json(F.try_parse_json(json))


def json_kind(value: Column) -> Column:
    """JSON kind of a variant."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
        .when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").when(kind == "VOID", "null").otherwise("number")
    )


def _errors(arguments: Column, parsed: Column, fields: Column) -> Column:
    """What the arguments violate, sorted; ``fields`` is null for an unknown tool."""
    keys = F.json_object_keys(arguments)
    whole = F.when(parsed.isNull() | (json_kind(parsed) != "object"), F.array(F.lit("arguments: not an object"))).when(fields.isNull(), F.array(F.lit("tool: unknown")))

    def fault(f: Column) -> Column:
        value = F.try_variant_get(parsed, F.concat(F.lit('$["'), f["field"], F.lit('"]')), "variant")
        kind = json_kind(value)
        wrong = (f["kind"] != "any") & (kind != f["kind"]) & ~((f["kind"] == "number") & (kind == "integer"))
        return F.when(value.isNull() & f["required"], F.concat(f["field"], F.lit(": missing"))).when(value.isNotNull() & wrong, F.concat(f["field"], F.lit(": not "), f["kind"]))

    named = F.filter(F.transform(fields, fault), lambda e: e.isNotNull())
    known = F.transform(fields, lambda f: f["field"])
    extra = F.transform(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), known), lambda k: F.concat(k, F.lit(": unexpected")))
    return F.array_sort(F.coalesce(whole, F.concat(named, extra)))


def _with_positions(events: DataFrame, order: list[str]) -> DataFrame:
    """``position`` (0, 1, ... within conv_id in the given order), without a task for each conversation."""
    spread = cut(events.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).withColumn("at__", F.monotonically_increasing_id()))
    part, place = F.shiftright("at__", 33), F.col("at__").bitwiseAND((1 << 33) - 1)
    parts = spread.groupBy(part.alias("part__")).agg(F.count("*").alias("n__"))
    starts = parts.select("part__", (F.sum("n__").over(Window.orderBy("part__")) - F.col("n__")).alias("start__"))  # a row a partition
    spread = spread.withColumn("part__", part).join(F.broadcast(starts), "part__").withColumn("global__", F.col("start__") + place)
    spread = spread.withColumn("conv__", F.unhex(F.md5(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))))
    index = spread.groupBy("conv__").agg(F.count("*").alias("size__"), F.min("global__").alias("first__"))
    total = parts.agg(F.coalesce(F.sum("n__"), F.lit(0))).first()[0]
    return look_up(spread, index, "conv__", "size__", total).withColumn("position", (F.col("global__") - F.col("first__")).cast("long"))


def _with_owners(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """``rows`` hash-joined to the call that owns their identifier. Rows without a full key meet nothing and stay where they are."""
    full = "conv_id is not null and call_id is not null"
    joined = rows.where(full).join(owners, ["conv_id", "call_id"], "left")
    kinds = dict(owners.dtypes)
    return joined.unionByName(rows.where(f"not ({full})").select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("owner", "replies")]))


def format_chats(chats: DataFrame, tools: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per event: EVENT_COLUMNS.

    ``status``: ``plain`` for messages; ``answered``, ``unanswered`` or ``repeated`` (an earlier call has the id, which
    then owns all results) for calls; ``linked`` or ``orphan`` for results. ``errors``: violations of a call's
    arguments, else null.
    Nulls: a null text is an event without content; a null role is ``unknown``; a null turn comes first; rows without a
    conv_id are a conversation of their own whose calls link with nothing. A call without an id is unanswered. Text
    that is no JSON object of the two shapes is plain. Ties in a turn are ordered by role and text; repeated rows are
    events of their own. An empty table gives no rows. Other columns are not read.
    """
    tools = tool_schemas(chats.sparkSession, TOOLS) if tools is None else tools
    fields = tools.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("field", "kind", "required"))).alias("fields"))  # a row a tool
    said = chats.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.col(text).alias("text"))
    shaped = F.col("role").isin("assistant", "tool") & F.ltrim("text").startswith("{")
    said = said.withColumn("m", F.when(shaped, F.from_json("text", MESSAGE))).withColumn("row", F.xxhash64("conv_id", "turn", "role", "text"))
    is_result = (F.col("role") == "tool") & F.col("m.tool_call_id").isNotNull()
    has_calls = (F.col("role") == "assistant") & (F.size("m.tool_calls") > 0)

    calls = said.where(has_calls).select("conv_id", "turn", "role", "text", "row", F.posexplode("m.tool_calls").alias("seq", "call"))
    calls = calls.select("conv_id", "turn", "role", "text", "row", (F.col("seq") + 1).alias("seq"), F.col("call.id").alias("call_id"), F.col("call.name").alias("tool"), F.col("call.arguments").alias("arguments"))
    results = said.where(is_result).select("conv_id", "turn", "role", "text", "row", F.col("m.tool_call_id").alias("call_id"), F.col("m.content").alias("content"))
    place = F.struct("turn", "row", "seq")
    owners = calls.where("call_id is not null and conv_id is not null").groupBy("conv_id", "call_id").agg(F.min(place).alias("owner"))
    replies = results.where("conv_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("replies"))
    owners = owners.join(replies, ["conv_id", "call_id"], "left")

    calls = _with_owners(calls, owners).join(fields, "tool", "left")
    status = F.when(F.col("owner").isNotNull() & (F.col("owner") != place), "repeated").when(F.col("replies") > 0, "answered").otherwise("unanswered")
    parsed = F.try_parse_json("arguments")
    arguments = F.coalesce(parsed, F.try_parse_json(F.to_json(F.array("arguments"))))
    as_call = F.to_json(F.struct(arguments.alias("arguments"), F.col("call_id").alias("id"), F.col("tool").alias("name"), F.lit("call").alias("type")))
    call_events = calls.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "role", "call_id", "tool", status.alias("status"), _errors(F.col("arguments"), parsed, F.col("fields")).alias("errors"), as_call.alias("json"),
        F.col("turn").alias("at_turn"), F.lit(0).alias("phase"), "text", "row", "seq",
    )
    results = _with_owners(results, owners)
    late = F.col("owner").isNotNull() & (F.coalesce(F.col("turn"), F.lit(-1)) <= F.col("owner.turn"))
    as_result = F.to_json(F.struct(F.col("content").alias("content"), F.col("call_id").alias("id"), F.lit("result").alias("type")))
    result_events = results.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "role", "call_id", F.lit(None).cast("string").alias("tool"), F.when(F.col("owner").isNotNull(), "linked").otherwise("orphan").alias("status"),
        F.lit(None).cast("array<string>").alias("errors"), as_result.alias("json"), F.when(late, F.col("owner.turn")).otherwise(F.col("turn")).alias("at_turn"), F.when(late, 1).otherwise(0).alias("phase"), "text", "row", F.lit(0).alias("seq"),
    )
    content = F.when(has_calls, F.col("m.content")).otherwise(F.col("text"))
    as_message = F.to_json(F.struct(content.alias("content"), F.col("role").alias("role"), F.lit("message").alias("type")))
    none = F.lit(None).cast("string")
    messages = said.where(~F.coalesce(is_result, F.lit(False))).select(
        "conv_id", "turn", F.lit("message").alias("kind"), "role", none.alias("call_id"), none.alias("tool"), F.lit("plain").alias("status"), F.lit(None).cast("array<string>").alias("errors"), as_message.alias("json"),
        F.col("turn").alias("at_turn"), F.lit(0).alias("phase"), "text", "row", F.lit(0).alias("seq"),
    )
    events = messages.unionByName(call_events).unionByName(result_events)
    return _with_positions(events, ["at_turn", "phase", "turn", "role", "text", "row", "seq"]).select(*EVENT_COLUMNS)


def tool_schemas(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A schema table from (tool, field, kind, required) rows; from literals, for rows of Python would start Python workers."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("tool", "field", "kind", "required"), row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def with_tools(chats: DataFrame) -> DataFrame:
    """Conversations as agents have them: an assistant's turns call tools, the next turns answer some of them.

    Of an assistant's turn the remainder by 5 decides: 0 to 2 calls one of three tools, rightly or not; 3 calls two; 4 none.
    The turn after it answers the first call, if its own remainder by 7 isn't 0; an answer to a turn that called nothing
    is an orphan.
    """
    turn, said = F.col("turn"), F.col("text")
    call = lambda suffix, name, arguments: F.struct(F.concat(F.lit("c"), turn.cast("string"), F.lit(suffix)).alias("id"), F.lit(name).alias("name"), arguments.alias("arguments"))
    number = turn.cast("string")
    search = call("", "search", F.concat(F.lit('{"query":"q'), number, F.lit('","limit":'), number, F.lit("}")))
    wrong = call("", "search", F.concat(F.lit('{"limit":"'), number, F.lit('","page":1}')))
    unknown = call("", "erase", F.lit('{"all":true}'))
    second = call("b", "calculate", F.concat(F.lit('{"expression":"'), number, F.lit('+1"}')))
    kind = turn % 5
    calls = F.when(kind == 0, F.array(search)).when(kind == 1, F.array(wrong)).when(kind == 2, F.array(unknown)).when(kind == 3, F.array(search, second))
    asks = (F.col("role") == "assistant") & (kind != 4)
    answers = (F.col("role") != "assistant") & (turn > 0) & (turn % 7 != 0)
    texts = F.when(asks, F.to_json(F.struct(said.alias("content"), calls.alias("tool_calls")))).when(answers, F.to_json(F.struct(F.concat(F.lit("c"), (turn - 1).cast("string")).alias("tool_call_id"), said.alias("content")))).otherwise(said)
    return chats.select("conv_id", "turn", F.when(answers, "tool").otherwise(F.col("role")).alias("role"), texts.alias("text"))


#: For tables without tool calls, which the test tables are: every row is a plain message.
ORACLE_SQL = """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), text) - 1 AS position, turn,
    'message' AS kind, coalesce(role, 'unknown') AS role, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS VARCHAR) AS tool, 'plain' AS status,
    CAST(NULL AS VARCHAR) AS errors, CAST(json_object('content', text, 'role', coalesce(role, 'unknown'), 'type', 'message') AS VARCHAR) AS json
FROM conversations
"""

#: For ``with_tools``: what each event is follows from its turn's number.
TOOLS_SQL = """
WITH c AS (SELECT conv_id, turn, role, text, role = 'assistant' AND turn % 5 <> 4 AS asks, role <> 'assistant' AND turn > 0 AND turn % 7 <> 0 AS answers FROM conversations),
calls AS (
    SELECT conv_id, turn, 1 AS seq, concat('c', turn) AS call_id, CASE WHEN turn % 5 = 2 THEN 'erase' ELSE 'search' END AS tool,
        CASE turn % 5 WHEN 1 THEN 'limit: not integer; page: unexpected; query: missing' WHEN 2 THEN 'tool: unknown' ELSE '' END AS errors,
        CASE turn % 5 WHEN 1 THEN concat('{"limit":"', turn, '","page":1}') WHEN 2 THEN '{"all":true}' ELSE concat('{"limit":', turn, ',"query":"q', turn, '"}') END AS arguments
    FROM c WHERE asks
    UNION ALL SELECT conv_id, turn, 2, concat('c', turn, 'b'), 'calculate', '', concat('{"expression":"', turn, '+1"}') FROM c WHERE asks AND turn % 5 = 3
), events AS (
    SELECT conv_id, turn, 0 AS seq, 'message' AS kind, role, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS VARCHAR) AS tool, 'plain' AS status, CAST(NULL AS VARCHAR) AS errors,
        CAST(json_object('content', text, 'role', role, 'type', 'message') AS VARCHAR) AS json FROM c WHERE NOT answers
    UNION ALL SELECT conv_id, turn, seq, 'call', 'assistant', call_id, tool, CASE WHEN EXISTS (SELECT 1 FROM c WHERE answers AND c.conv_id = calls.conv_id AND concat('c', c.turn - 1) = calls.call_id) THEN 'answered' ELSE 'unanswered' END, errors,
        concat('{"arguments":', arguments, ',"id":"', call_id, '","name":"', tool, '","type":"call"}') FROM calls
    UNION ALL SELECT conv_id, turn, 0, 'result', 'tool', concat('c', turn - 1), NULL, CASE WHEN EXISTS (SELECT 1 FROM calls WHERE calls.conv_id = c.conv_id AND calls.call_id = concat('c', c.turn - 1)) THEN 'linked' ELSE 'orphan' END, NULL,
        CAST(json_object('content', text, 'id', concat('c', turn - 1), 'type', 'result') AS VARCHAR) FROM c WHERE answers
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, seq) - 1 AS position, turn, kind, role, call_id, tool, status, errors, json FROM events
"""
