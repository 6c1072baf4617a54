"""Chat formatting with tool-call linking, in DataFrame operations only.

Assistant turns may hold calls, ``<tool_call>{"id": .., "name": .., "arguments":
{..}}</tool_call>``; a turn with role ``tool`` holds a result, ``{"tool_call_id":
.., "content": ..}``.  An argument ``"${id}"`` stands for the result of call id.

Calls and results are hash-joined by (conversation, id).  A result must follow
its call, and a call the results that it names; turns that break this are moved
behind the last turn that they need (longest path of any length, by pointer
jumping along chosen predecessors, only over the conversations where something is
out of order).  Arguments are validated against
schemas (tool, param, type, required).  Every message becomes canonical JSON:
keys sorted at every level, no white space, numbers in one spelling
(``plain_numbers``).

One row per message comes out, with its position in the conversation.  Positions
are ranks inside spans of 256 turns plus the sizes of the spans before, so that a
conversation of any length needs no task to itself.

Defined results: rows of a null conversation are one conversation; a null text
has no content; a null turn comes last; a null role
is ``unknown``; messages with equal conversation and turn are ordered by role and
text and move together; a call that isn't valid JSON stays content; of calls with
one id in a conversation the first is linked, of results with one id the first
answers it, and others count as unlinked; an argument that refers to its own
message or round a circle leaves the turns where they are and is counted in
``n_invalid``; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._blocks import forget, stored

SPAN = 256
_CALL = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"
_LAST = 2**62


def tool_schemas(spark: SparkSession) -> DataFrame:
    """The schemas that the query validates against: tool, param, type (a JSON type), required."""
    return spark.sql("""
        SELECT * FROM VALUES
          ('search', 'query', 'string', true), ('search', 'limit', 'integer', false),
          ('fetch', 'url', 'string', true), ('fetch', 'timeout', 'number', false),
          ('calculate', 'expression', 'string', true), ('calculate', 'exact', 'boolean', false),
          ('lookup', 'key', 'string', true), ('lookup', 'fields', 'array', false), ('lookup', 'options', 'object', false)
        AS schemas(tool, param, type, required)""")


def _json_type(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
        .when(kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\\(\\d+,0\\))$"), "integer").when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number").otherwise("null")
    )


def plain_numbers(raw: Column) -> Column:
    """JSON text with each number that has a fraction or an exponent in one spelling: digits alone if it is whole, else no zeros at the end.

    Numbers of more than 38 digits are spelled as the double next to them.
    """

    def spelled(t: Column) -> Column:
        double, whole, exact = t.try_cast("double"), t.try_cast("decimal(38,0)"), t.try_cast("decimal(38,19)")
        tidy = F.regexp_replace(F.regexp_replace(F.format_string("%s", exact.cast("string")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        large = F.abs(double) >= F.lit(1e15)  # such doubles are whole, and most have more digits than a fraction leaves room for
        text = F.when(large, F.coalesce(whole.cast("string"), double.cast("string"))).when(exact.cast("double") == double, tidy).otherwise(double.cast("string"))
        return F.when(text.isin("-0", "0"), "0").when(F.abs(double) == F.lit(float("inf")), t).otherwise(F.coalesce(text, t))

    number = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
    tokens = F.regexp_extract_all(raw, F.lit(rf'(?s)"(?:[^"\\]|\\.)*"|{number}|[^"0-9-]+|.'), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^-?[0-9].*[.eE]|^-0$|[0-9]{39}"), spelled(t)).otherwise(t)), "")


def _calls(messages: DataFrame) -> DataFrame:
    """conv, turn, ord, id, tool, arguments (variant), refs."""
    found = messages.where("role = 'assistant' and text like '%<tool_call>%'").select("conv", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(_CALL), F.lit(1))).alias("ord", "raw"))
    found = found.withColumn("raw", plain_numbers(F.col("raw")))
    parsed = found.select("conv", "turn", "ord", "raw", F.try_parse_json("raw").alias("v")).where("v is not null")
    parsed = parsed.select("conv", "turn", "ord", F.try_variant_get("v", "$.id", "string").alias("id"), F.try_variant_get("v", "$.name", "string").alias("tool"), F.coalesce(F.try_variant_get("v", "$.arguments", "variant"), F.parse_json(F.lit("{}"))).alias("arguments"))
    return parsed.withColumn("refs", F.array_distinct(F.regexp_extract_all(F.to_json("arguments"), F.lit(r'"\$\{([^}"]+)\}"'), F.lit(1))))


def _results(messages: DataFrame) -> DataFrame:
    """conv, turn, id, first: whether it is the first result of its id."""
    found = messages.where("role = 'tool'").select("conv", "turn", F.try_variant_get(F.try_parse_json("text"), "$.tool_call_id", "string").alias("id")).where("id is not null")
    return found


def _errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv, turn, ord, errors: unknown tool, unknown or ill-typed argument, missing required argument."""
    keys = ["conv", "turn", "ord"]
    tools = schemas.groupBy("tool").agg(F.collect_list(F.when(F.col("required"), F.col("param"))).alias("needs"))
    given = calls.select(*keys, "tool", F.from_json(F.to_json("arguments"), "map<string,variant>").alias("args"))
    flat = given.select(*keys, "tool", F.explode("args").alias("param", "value")).withColumn("given", _json_type(F.col("value")))
    # a reference stands for any type
    flat = flat.withColumn("given", F.when(F.col("given").eqNullSafe("string") & F.coalesce(F.try_variant_get("value", "$", "string"), F.lit("")).rlike(r"^\$\{[^}]+\}$"), F.lit("any")).otherwise(F.col("given")))
    typed = flat.join(schemas, ["tool", "param"], "left")
    right = (F.col("given") == "any") | (F.col("given") == F.col("type")) | ((F.col("given") == "integer") & (F.col("type") == "number"))
    wrong = typed.where(~F.coalesce(right, F.lit(False))).groupBy(*keys).agg(F.count(F.lit(1)).alias("wrong"))
    known = given.join(tools, "tool", "left")
    missing = F.size(F.array_except(F.coalesce("needs", F.array().cast("array<string>")), F.coalesce(F.map_keys("args"), F.array().cast("array<string>"))))
    known = known.select(*keys, (F.col("needs").isNull().cast("int") + missing).alias("lacking"))
    return known.join(wrong, keys, "left").select(*keys, (F.col("lacking") + F.coalesce("wrong", F.lit(0))).alias("errors"))


def _followed(state: DataFrame, most: int) -> DataFrame:
    """state (conv, turn, pred, circle) with key, the largest along the chosen predecessors, and via, null unless they run in a circle: pointer jumping."""
    state = state.withColumns({"via": F.col("pred"), "hops": F.col("pred").isNotNull().cast("int"), "key": F.struct(F.col("turn").alias("at"), F.lit(0).alias("depth"))})
    # after k rounds via lies 2^k hops back, and no path is as long as a conversation has turns
    for _ in range(most.bit_length()):
        if state.where("via is not null").limit(1).count() == 0:
            break
        there = state.select("conv", F.col("turn").alias("via"), F.col("via").alias("next"), F.col("hops").alias("far"), F.col("key").alias("from"))
        pushed = F.when(F.col("from").isNotNull(), F.struct(F.col("from.at").alias("at"), (F.col("from.depth") + F.col("hops")).alias("depth")))
        before, state = state, stored(state.join(there, ["conv", "via"], "left").select("conv", "turn", "pred", "circle", F.col("next").alias("via"), (F.col("hops") + F.coalesce("far", F.lit(0))).alias("hops"), F.when(pushed > F.col("key"), pushed).otherwise(F.col("key")).alias("key")))
        forget(before)
    return state


def _order(edges: DataFrame) -> DataFrame:
    """edges (conv, before, after) of turns: (conv, turn, key (turn to stand at, depth), circle) for conversations out of order.

    Each turn chooses one predecessor, the keys along the choices are found at once, and turns that another predecessor
    would move further choose that one, until none does.  Keys grow along every edge, so this ends unless the choices
    run in a circle, and only a circle of edges makes them.
    """
    loose = edges.where("before >= after").select("conv").distinct()
    edges = stored(edges.join(loose, "conv", "left_semi").where("before <> after").distinct())
    nodes = edges.select("conv", F.explode(F.array("before", "after")).alias("turn")).distinct()
    chosen = edges.groupBy("conv", F.col("after").alias("turn")).agg(F.max("before").alias("pred"))
    state = stored(nodes.join(chosen, ["conv", "turn"], "left").select("conv", "turn", "pred", F.lit(False).alias("circle")))
    most = state.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    while True:
        state = _followed(state, most)
        circles = state.where("via is not null").select("conv").distinct()
        if most and circles.limit(1).count():
            circles = stored(circles.withColumn("found", F.lit(True)))
            edges = stored(edges.join(circles, "conv", "left_anti"))
            still = F.struct(F.col("turn").alias("at"), F.lit(0).alias("depth"))
            state = state.join(circles, "conv", "left").select("conv", "turn", F.when(F.col("found").isNull(), F.col("pred")).alias("pred"), (F.col("circle") | F.col("found").isNotNull()).alias("circle"), F.when(F.col("found"), still).otherwise(F.col("key")).alias("key"))
        before = state.select("conv", F.col("turn").alias("before"), F.col("key").alias("from"))
        offers = edges.join(before, ["conv", "before"]).groupBy("conv", F.col("after").alias("turn")).agg(F.max(F.struct(F.col("from.at").alias("at"), (F.col("from.depth") + 1).alias("depth"), F.col("before").alias("pred"))).alias("offer"))
        moved = F.coalesce(F.struct(F.col("offer.at").alias("at"), F.col("offer.depth").alias("depth")) > F.col("key"), F.lit(False)) & F.col("offer").isNotNull()
        state = stored(state.join(offers, ["conv", "turn"], "left").select("conv", "turn", F.when(moved, F.col("offer.pred")).otherwise(F.col("pred")).alias("pred"), "circle", "key", moved.alias("moved")))
        if not most or state.where("moved").limit(1).count() == 0:
            return state.select("conv", "turn", "key", "circle")
        state = state.select("conv", "turn", "pred", "circle")


def format_chats(conversations: DataFrame, schemas: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv, turn, position, role, n_calls, n_linked, n_invalid, message (canonical JSON)."""
    # inside a struct a null conversation equals itself
    messages = conversations.select(F.struct(F.col(conv_col).alias("id")).alias("conv"), F.coalesce(F.col(turn_col).cast("bigint"), F.lit(_LAST)).alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.col(text_col).alias("text"))
    calls, results = stored(_calls(messages)), stored(_results(messages))
    first_call = calls.where("id is not null").groupBy("conv", "id").agg(F.min(F.struct("turn", "ord")).alias("call"))
    first_result = results.groupBy("conv", "id").agg(F.min("turn").alias("answered"))
    linked = stored(first_call.join(first_result, ["conv", "id"]).select("conv", "id", "call", "answered"))
    needs = calls.select("conv", "turn", F.explode("refs").alias("id")).join(linked.select("conv", "id", "answered"), ["conv", "id"])
    edges = linked.select("conv", F.col("call.turn").alias("before"), F.col("answered").alias("after")).unionByName(needs.select("conv", F.col("answered").alias("before"), F.col("turn").alias("after")))
    order = _order(edges)

    dangling = calls.select("conv", "turn", "ord", F.explode("refs").alias("id")).join(linked.select("conv", "id"), ["conv", "id"], "left_anti").groupBy("conv", "turn", "ord").agg(F.count(F.lit(1)).alias("dangling"))
    judged = calls.join(_errors(calls, schemas), ["conv", "turn", "ord"], "left").join(dangling, ["conv", "turn", "ord"], "left")
    answered = linked.select("conv", F.col("call.turn").alias("turn"), F.col("call.ord").alias("ord"), F.lit(1).alias("answered"))
    judged = judged.join(answered, ["conv", "turn", "ord"], "left")
    bad = (F.coalesce("errors", F.lit(0)) + F.coalesce("dangling", F.lit(0)) > 0) | F.col("id").isNull()
    by_turn = judged.groupBy("conv", "turn").agg(
        F.count(F.lit(1)).alias("n_calls"), F.coalesce(F.sum("answered"), F.lit(0)).alias("n_linked"), F.sum(bad.cast("int")).alias("n_invalid"),
        F.array_sort(F.collect_list(F.struct("ord", F.to_json(F.struct(F.to_json("arguments").alias("arguments"), "id", F.col("tool").alias("name"))).alias("json")))).alias("calls"),
    )
    result_turn = results.join(linked.select("conv", "id", F.col("answered").alias("turn")), ["conv", "id", "turn"]).groupBy("conv", "turn").agg(F.min("id").alias("tool_call_id"))

    rows = messages.join(by_turn, ["conv", "turn"], "left").join(result_turn, ["conv", "turn"], "left").join(order, ["conv", "turn"], "left")
    is_call = (F.col("role") == "assistant") & F.col("n_calls").isNotNull()
    is_result = (F.col("role") == "tool") & F.col("tool_call_id").isNotNull()
    content = F.when(is_call, F.trim(F.regexp_replace("text", _CALL, ""))).when(is_result, F.coalesce(F.try_variant_get(F.try_parse_json("text"), "$.content", "string"), F.lit(""))).otherwise(F.col("text"))
    # the arguments are JSON already: written as a value, not as a string
    calls_json = F.when(is_call, F.concat(F.lit('"tool_calls":['), F.array_join(F.transform("calls", lambda c: _call_json(c["json"])), ","), F.lit("]")))
    members = [F.concat(F.lit('"content":'), _quoted(content)), F.concat(F.lit('"role":'), _quoted(F.col("role"))), F.when(is_result, F.concat(F.lit('"tool_call_id":'), _quoted(F.col("tool_call_id")))), calls_json]
    message = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    key = F.coalesce("key", F.struct(F.col("turn").alias("at"), F.lit(0).alias("depth")))
    rows = rows.select("conv", "turn", "role", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), (F.coalesce("n_invalid", F.lit(0)) + F.when(is_call & F.coalesce("circle", F.lit(False)), 1).otherwise(0)).alias("n_invalid"), message.alias("message"), key.alias("key"))
    rows = rows.withColumn("span", F.floor(F.col("key.at") / SPAN))
    spans = rows.groupBy("conv", "span").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("conv", "span", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("conv", "span").orderBy("key", "turn", "role", "message"))
    out = rows.withColumn("rank", rank).join(spans, ["conv", "span"])
    counts = [F.col(c).cast("bigint").alias(c) for c in ("n_calls", "n_linked", "n_invalid")]
    return out.select(F.col("conv.id").alias(conv_col), F.when(F.col("turn") < _LAST, F.col("turn")).alias(turn_col), (F.col("before") + F.col("rank") - 1).cast("bigint").alias("position"), "role", *counts, "message")


def _quoted(value: Column) -> Column:
    """A JSON string, or null."""
    text = F.to_json(F.array(value))
    return F.substr(text, F.lit(2), F.length(text) - 2)


def _call_json(json: Column) -> Column:
    """{"arguments": "<JSON>", ..} with the arguments as a value."""
    arguments = F.get_json_object(json, "$.arguments")
    members = [F.concat(F.lit('"arguments":'), F.coalesce(arguments, F.lit("{}"))), *(F.concat(F.lit(f'"{k}":'), _quoted(F.get_json_object(json, f"$.{k}"))) for k in ("id", "name"))]
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"), tool_schemas(spark))


ORACLE_SQL = """
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS position, role,
       CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_invalid,
       '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' AS message
FROM conversations
"""


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator over conversations made of calls: each turn of the table becomes two calls, a result for four in five, and a note.

    In every other conversation results are stored before their calls; some calls
    name the result before theirs, some lack an argument, have one of the wrong
    type, or name no tool.
    """
    k, c = F.col("k"), F.col("conv_id")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg((F.count(F.lit(1)) * 2).alias("n"))
    steps = turns.select("conv_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k"))
    text = k.cast("string")
    arguments = (
        F.when(k % 4 == 0, F.concat(F.lit('{"query": "q'), text, F.lit('", "limit": '), text, F.lit("}")))
        .when(k % 4 == 1, F.concat(F.lit('{"url": "${c'), (k - 1).cast("string"), F.lit('}"}')))
        .when(k % 4 == 2, F.lit('{"limit": "many"}')).otherwise(F.lit("{}"))
    )
    name = F.when(k % 2 == 0, "search").when(k % 4 == 1, "fetch").otherwise("nope")
    call = F.concat(F.lit("do "), text, F.lit('<tool_call>{"name": "'), name, F.lit('", "id": "c'), text, F.lit('", "arguments": '), arguments, F.lit("}</tool_call>"))
    result = F.concat(F.lit('{"tool_call_id": "c'), text, F.lit('", "content": "r'), text, F.lit('"}'))
    row = lambda turn, role, body: F.struct(turn.alias("turn"), F.lit(role).alias("role"), body.alias("text"))
    rows = F.array(row(k * 3 + c % 2, "assistant", call), row(k * 3 + 1 - c % 2, "tool", F.when(k % 5 < 4, result)), row(k * 3 + 2, "user", F.concat(F.lit("note "), text)))
    made = steps.select("conv_id", F.explode(rows).alias("x")).select("conv_id", "x.*").where("text is not null")
    return format_chats(made, tool_schemas(spark))


CALLS_SQL = """
WITH t AS (SELECT conv_id, count(*) * 2 AS n FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, unnest(range(n)) AS k FROM t),
x AS (
  SELECT conv_id, 3 * k + conv_id % 2 AS turn, k, 0 AS o, 'assistant' AS role, 1 AS n_calls, CASE WHEN k % 5 < 4 THEN 1 ELSE 0 END AS n_linked, CASE WHEN k % 4 >= 2 OR k % 4 = 1 AND (k - 1) % 5 = 4 THEN 1 ELSE 0 END AS n_invalid,
    '{"content":"do ' || k || '","role":"assistant","tool_calls":[{"arguments":' || CASE k % 4 WHEN 0 THEN '{"limit":' || k || ',"query":"q' || k || '"}' WHEN 1 THEN '{"url":"${c' || (k - 1) || '}"}' WHEN 2 THEN '{"limit":"many"}' ELSE '{}' END
      || ',"id":"c' || k || '","name":"' || CASE k % 4 WHEN 1 THEN 'fetch' WHEN 3 THEN 'nope' ELSE 'search' END || '"}]}' AS message FROM s
  UNION ALL SELECT conv_id, 3 * k + 1 - conv_id % 2, k, 1, 'tool', 0, 0, 0, '{"content":"r' || k || '","role":"tool","tool_call_id":"c' || k || '"}' FROM s WHERE k % 5 < 4
  UNION ALL SELECT conv_id, 3 * k + 2, k, 2, 'user', 0, 0, 0, '{"content":"note ' || k || '","role":"user"}' FROM s)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY k, o) - 1 AS position, role, CAST(n_calls AS BIGINT) AS n_calls, CAST(n_linked AS BIGINT) AS n_linked, CAST(n_invalid AS BIGINT) AS n_invalid, message FROM x
"""
