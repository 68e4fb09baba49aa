"""Chat formatting: tool calls and results linked, ordered, validated and serialised. Built-in functions only.

A message's text may be a JSON object with `tool_calls` (id, name, arguments) or
with `tool_call_id` and `content`; any other text is a plain message. Calls and
results meet in a hash join on conversation and identifier. The dependency order
needs no walk: a message stands at its turn, a call right after its message, a
result right after its call or at its own turn, whichever is later. The order is
given as sort keys of each row, so that no conversation is gathered. Objects are
kept as variants, whose keys are sorted, and written without white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import table

#: tool -> argument -> (type, whether it is required)
Schemas = dict[str, dict[str, tuple[str, bool]]]

_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<.*", "object": "^OBJECT<.*"}


def _problems(name: Column, args: Column, schemas: Schemas) -> Column:
    """Sorted array of what is wrong with a call's arguments; empty if nothing is."""
    given = F.coalesce(F.try_variant_get(args, "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    found = F.when(F.lit(False), F.array().cast("array<string>"))
    for tool, fields in schemas.items():
        keys = F.map_keys(given)
        known = F.array(*map(F.lit, fields)) if fields else F.array().cast("array<string>")
        checks = [F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit("unknown:"), k))]
        for field, (kind, required) in fields.items():
            value = F.try_element_at(given, F.lit(field))
            wrong = F.when(~F.schema_of_variant(value).rlike(_TYPES[kind]), F.array(F.lit(f"type:{field}")))
            missing = F.array(F.lit(f"missing:{field}")) if required else F.array().cast("array<string>")
            checks.append(F.coalesce(F.when(~F.array_contains(keys, field), missing).otherwise(wrong), F.array().cast("array<string>")))
        found = found.when(name == tool, F.array_sort(F.concat(*checks)))
    return found.otherwise(F.array(F.lit("unknown tool")))


def chat_format(messages: DataFrame, schemas: Schemas, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message, call and result: conv, turn, seq, kind, call_id, name, linked, problems, place, step, json.

    conv, place, step, turn, seq sort a conversation so that every result follows
    its call: a message or call stands at its turn, a result at its own or its call's, whichever is later. A call that
    uses an earlier result follows it if its turn does, as each link of a chain then stands at or after the turn of the one before. A message that has both content and calls gives a message row before its calls. linked: a call has a result, a result has a call; of calls or
    results that share an identifier the first counts for the other side. Null text
    is an empty plain message; text that isn't valid JSON is plain. A call
    without an identifier is never linked; null conversations don't link. Rows that repeat are
    formatted each. Other columns are ignored, and an empty table gives no rows.
    """
    rows = messages.select(messages[conv].alias("conv"), messages[turn].alias("turn"), messages[role].alias("role"), F.coalesce(messages[text], F.lit("")).alias("text"))
    v = F.when(F.rlike("text", F.lit(r"^[ \t\r\n]*\{")), F.try_parse_json("text"))  # the white space of JSON
    rows = rows.withColumn("v", v).withColumn("calls", F.try_variant_get("v", "$.tool_calls", "array<variant>")).withColumn("answers", F.try_variant_get("v", "$.tool_call_id", "string"))
    rows = rows.withColumn("kind", F.when(F.size(F.coalesce("calls", F.array().cast("array<variant>"))) > 0, "call").when(F.col("answers").isNotNull(), "result").otherwise("message"))

    calls = rows.where("kind = 'call'").select("conv", "turn", F.posexplode("calls").alias("seq", "call"))
    argument = F.try_variant_get("call", "$.arguments", "variant")
    inner = F.when(F.schema_of_variant(argument) == "STRING", F.try_parse_json(F.try_variant_get(argument, "$", "string")))
    calls = calls.select("conv", "turn", "seq", F.try_variant_get("call", "$.id", "string").alias("call_id"), F.try_variant_get("call", "$.name", "string").alias("name"), F.coalesce(inner, argument).alias("args"))
    results = rows.where("kind = 'result'").select("conv", "turn", F.col("answers").alias("call_id"), F.coalesce(F.try_variant_get("v", "$.content", "string"), F.lit("")).alias("content"))

    whole = {"ignoreNullFields": "false"}
    by_call = results.groupBy(F.col("conv").alias("c"), F.col("call_id").alias("i")).agg(F.min("turn").alias("result_turn"))
    by_result = calls.groupBy(F.col("conv").alias("c"), F.col("call_id").alias("i")).agg(F.min(F.struct("turn", "name")).alias("first"))
    same = (F.col("conv") == F.col("c")) & (F.col("call_id") == F.col("i"))
    calls = calls.join(by_call.hint("shuffle_hash"), same, "left").select(
        "conv", "turn", "seq", F.lit("call").alias("kind"), "call_id", "name", F.col("i").isNotNull().alias("linked"),
        _problems(F.col("name"), F.col("args"), schemas).alias("problems"), F.col("turn").alias("place"), F.lit(1).alias("step"),
        F.to_json(F.struct(F.col("args").alias("arguments"), F.col("call_id").alias("id"), "name"), whole).alias("json"),
    )
    results = results.join(by_result.hint("shuffle_hash"), same, "left").select(
        "conv", "turn", F.lit(0).alias("seq"), F.lit("result").alias("kind"), "call_id", F.col("first.name").alias("name"), F.col("i").isNotNull().alias("linked"),
        F.when(F.col("i").isNull(), F.array(F.lit("unknown call"))).otherwise(F.array().cast("array<string>")).alias("problems"),
        F.greatest("turn", "first.turn").alias("place"), F.lit(2).alias("step"),
        F.to_json(F.struct("content", F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id")), whole).alias("json"),
    )
    said = F.try_variant_get("v", "$.content", "string")
    content = F.when(F.col("kind") == "message", F.col("text")).when(F.col("kind") == "call", said)
    plain = rows.withColumn("content", content).where("content is not null and (kind = 'message' or content <> '')").select(
        "conv", "turn", F.lit(0).alias("seq"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("linked"),
        F.array().cast("array<string>").alias("problems"), F.col("turn").alias("place"), F.lit(0).alias("step"),
        F.to_json(F.struct("content", "role"), whole).alias("json"),
    )
    return plain.unionByName(calls).unionByName(results).withColumnRenamed("conv", conv).withColumnRenamed("turn", turn)


#: The protocol that the query reads into plain conversations.
REPLY: Schemas = {"reply": {"text": ("string", True), "words": ("integer", True)}}


def as_tool_messages(messages: DataFrame) -> DataFrame:
    """conversations with every assistant turn as a call of `reply`, and every later user turn as the result of the turn before.

    A text of several lines has no word count, so that its call is not valid.
    """
    text = F.coalesce("text", F.lit(""))
    name = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    words = F.when(~text.contains("\n"), F.regexp_count(text, F.lit(r"[^ ]+")))
    call = F.to_json(F.struct(F.array(F.struct(F.lit("reply").alias("name"), name(F.col("turn")).alias("id"), F.struct(words.alias("words"), text.alias("text")).alias("arguments"))).alias("tool_calls")))
    result = F.to_json(F.struct(name(F.col("turn") - 1).alias("tool_call_id"), text.alias("content")))
    shown = F.when(F.col("role") == "assistant", call).when((F.col("role") == "user") & (F.col("turn") > 0), result).otherwise(text)
    return messages.select("conv_id", "turn", "role", shown.alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    found = chat_format(as_tool_messages(table(spark, sf_dir, "conversations")), REPLY)
    return found.withColumn("problems", F.array_join("problems", ",")).withColumn("place", F.col("place").cast("bigint"))


ORACLE = r"""
WITH m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, 'call-' || conv_id || '-' || turn AS own, 'call-' || conv_id || '-' || (turn - 1) AS previous,
    CASE WHEN role = 'assistant' THEN 'call' WHEN role = 'user' AND turn > 0 THEN 'result' ELSE 'message' END AS kind
  FROM conversations
), calls AS (SELECT conv_id, own AS id, min(turn) AS turn FROM m WHERE kind = 'call' GROUP BY ALL),
results AS (SELECT conv_id, previous AS id FROM m WHERE kind = 'result' GROUP BY ALL)
SELECT m.conv_id, m.turn, 0 AS seq, kind,
  CASE kind WHEN 'call' THEN own WHEN 'result' THEN previous END AS call_id,
  CASE WHEN kind = 'call' OR kind = 'result' AND c.id IS NOT NULL THEN 'reply' END AS name,
  CASE kind WHEN 'call' THEN r.id IS NOT NULL WHEN 'result' THEN c.id IS NOT NULL ELSE false END AS linked,
  CASE WHEN kind = 'call' AND contains(text, chr(10)) THEN 'missing:words' WHEN kind = 'result' AND c.id IS NULL THEN 'unknown call' ELSE '' END AS problems,
  CASE WHEN kind = 'result' THEN greatest(m.turn, c.turn) ELSE m.turn END AS place,
  CASE kind WHEN 'message' THEN 0 WHEN 'call' THEN 1 ELSE 2 END AS step,
  CASE kind
    WHEN 'message' THEN '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}'
    WHEN 'call' THEN '{"arguments":{"text":' || to_json(text) || CASE WHEN contains(text, chr(10)) THEN '' ELSE ',"words":' || len(regexp_extract_all(text, '[^ ]+')) END || '},"id":"' || own || '","name":"reply"}'
    ELSE '{"content":' || to_json(text) || ',"role":"tool","tool_call_id":"' || previous || '"}' END AS json
FROM m LEFT JOIN calls c ON kind = 'result' AND c.conv_id = m.conv_id AND c.id = m.previous
LEFT JOIN results r ON kind = 'call' AND r.conv_id = m.conv_id AND r.id = m.own
"""
