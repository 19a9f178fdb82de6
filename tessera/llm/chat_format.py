"""Chat formatting: link tool calls to results, order them, check arguments, write canonical JSON.

DataFrame functions only.  A message's text may be a JSON object with
``tool_calls`` (an array of ``{"id", "name", "arguments"}``), ``tool_call_id``
(a result) or both, and ``content``; without calls (an empty array) and result
its content is plain content, and so is any other text.

* Linking: calls and results are joined by conversation and identifier with
  an equi-join.  Where an identifier is called more than once in a
  conversation, the first call by turn and position is the one that is
  answered; each result is linked to at most one call.
* Order: a topological order of the messages and the edges call -> result.
  Its keys are computed row by row: a result stands directly after its call
  even if it was logged before it; results of one call go by turn.  No
  conversation is ever gathered in one task.
* Arguments are checked against schemas given as data: (tool, argument, type,
  required) rows; calls of tools without a schema are "unknown_tool".  Without
  such a table a conversation's own declarations are its schemas: the ``tools``
  (an array of ``{"name", "parameters"}``, also within ``function`` or with
  ``inputSchema``) in JSON objects of its system or developer messages, each
  tool as last declared.  Where a conversation declares none, arguments have to
  be a JSON object and a call has to have a name.  Other arguments than those
  declared are invalid unless ``additionalProperties`` allows them; types are
  checked at the top level.  A declaring message stays plain content.
* Canonical JSON: keys sorted, no white space, one object for each message.

Defined results: a null text is empty content, a null role "unknown"; rows
with null conv_id or turn are kept, unlinked, those with null turn behind all
others of their conversation.  Turns are whole numbers, negative ones too; of
equal turns the order is not defined.  Repeated rows each get theirs.
Only conv_id, turn, role and text are read, so extra columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: JSON types of arguments and the patterns of their JSON text.
_TYPES = {"string": r'^"', "number": r"^-?[0-9]", "integer": r"^-?[0-9]+$", "boolean": r"^(true|false)$", "object": r"^\{", "array": r"^\[", "null": r"^null$"}
#: Roles whose messages declare tools.
DECLARING = ("system", "developer")
#: Calls of one conversation that meet its declarations in one task.
BLOCK = 4096
SCHEMA = "tool string, argument string, type string, required boolean"


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each evaluated once for a row: as a generator's output no filter or later column repeats it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def message_rows(messages: DataFrame) -> DataFrame:
    """The four columns as conv_id, turn, role, text, without nulls in the last two."""
    return messages.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def parse_messages(rows: DataFrame) -> DataFrame:
    """``message_rows`` with calls_ (array of struct), answer_ (struct), content_ and tools_ (array of variant) where the text holds them."""
    rows = _once(rows, json_=F.when(F.ltrim("text").startswith("{"), F.try_parse_json("text")))
    as_json = lambda path: F.to_json(F.try_variant_get("json_", path, "variant"))
    rows = _once(
        rows,
        given_=F.from_json(as_json("$.tool_calls"), "array<struct<id:string,name:string,arguments:string>>"),
        answer_id_=F.try_variant_get("json_", "$.tool_call_id", "string"),
        content_=F.coalesce(F.try_variant_get("json_", "$.content", "string"), as_json("$.content")),
        tools_=F.when(F.col("role").isin(*DECLARING), F.from_json(as_json("$.tools"), "array<variant>")),
    ).drop("json_")
    calls = F.transform("given_", lambda c, i: F.struct(i.alias("position"), c["id"].alias("id"), c["name"].alias("name"), F.coalesce(c["arguments"], F.lit("{}")).alias("arguments")))
    answer = F.when(F.col("answer_id_").isNotNull(), F.struct(F.col("answer_id_").alias("id"), F.col("content_").alias("content")))
    # No calls: a result, or plain content.
    none = F.coalesce(F.size("given_") == 0, F.lit(False))
    text = F.when(none & F.col("answer_id_").isNull(), F.coalesce("content_", "text")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", "role", text.alias("text"), F.when(~none, calls).alias("calls_"), answer.alias("answer_"), "content_", "tools_")


def declared_tools(rows: DataFrame) -> DataFrame:
    """conv_id, tools_ (map from a tool's name to its rules and whether other arguments are open): what each conversation declares."""
    tool = rows.filter("tools_ is not null and conv_id is not null").select("conv_id", "turn", F.posexplode_outer("tools_").alias("position", "tool_"))
    held = lambda path, kind: F.try_variant_get("tool_", path, kind)
    name = F.coalesce(held("$.function.name", "string"), held("$.name", "string"))
    rules = F.coalesce(*[F.to_json(held(path, "variant")) for path in ("$.function.parameters", "$.parameters", "$.inputSchema", "$.input_schema")], F.lit("{}"))
    last = tool.groupBy("conv_id", name.alias("tool")).agg(F.max(F.struct("turn", "position", rules.alias("rules"))).alias("last_"))
    part = lambda v, path: F.to_json(F.try_variant_get(v, path, "variant"))
    last = _once(last, given_=F.try_parse_json("last_.rules"))
    last = _once(last, types_=F.from_json(part("given_", "$.properties"), "map<string,variant>"), required_=F.from_json(part("given_", "$.required"), "array<string>"), others_=part("given_", "$.additionalProperties"))

    def rule(argument: Column) -> Column:
        kind = part(F.element_at("types_", argument), "$.type")
        kinds = F.from_json(F.when(kind.startswith("["), kind).otherwise(F.concat(F.lit("["), kind, F.lit("]"))), "array<string>")
        return F.struct(argument.alias("argument"), F.coalesce(kinds, F.array().cast("array<string>")).alias("types"), F.coalesce(F.array_contains("required_", argument), F.lit(False)).alias("required"))

    none = F.array().cast("array<string>")
    names = F.filter(F.array_union(F.coalesce(F.map_keys("types_"), none), F.coalesce("required_", none)), lambda n: n.isNotNull())
    value = F.struct(F.transform(names, rule).alias("rules"), F.coalesce(F.col("others_") != "false", F.lit(False)).alias("open"))
    return last.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("tool").isNotNull(), F.struct("tool", value)))).alias("tools_"))


def _with_declared(calls: DataFrame, declared: DataFrame) -> DataFrame:
    """``calls`` with the ``tools_`` of their conversations; long conversations meet theirs in blocks."""
    long = calls.groupBy("conv_id").agg(F.ceil(F.count("*") / BLOCK).alias("blocks_")).filter("blocks_ > 1")
    long = F.broadcast(long.withColumnRenamed("conv_id", "conv_"))
    dealt = lambda df: df.join(long, df["conv_id"] == F.col("conv_"), "left").withColumn("blocks_", F.coalesce("blocks_", F.lit(1))).drop("conv_")
    left = dealt(calls).withColumn("block_", F.pmod(F.xxhash64("turn", "position"), "blocks_"))
    right = dealt(declared).select("conv_id", "tools_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks_") - 1)).alias("block_"))
    return left.join(right, ["conv_id", "block_"], "left").drop("block_", "blocks_")


def checked_calls(calls: DataFrame, schemas: DataFrame | None, declared: DataFrame | None = None) -> DataFrame:
    """``calls`` (conv_id, turn, position, id, name, arguments) with status: ok, invalid_arguments or unknown_tool.

    The schemas are grouped to a row for each tool and joined by name; without
    them calls are checked against what ``declared`` holds of their conversation.
    """
    if schemas is not None:
        rule = F.struct("argument", F.array("type").alias("types"), F.coalesce("required", F.lit(False)).alias("required"))
        tools = schemas.filter("tool is not null and argument is not null").groupBy("tool").agg(F.sort_array(F.collect_set(rule)).alias("rules_"))
        rows = calls.join(tools, calls["name"] == tools["tool"], "left").drop("tool").withColumn("open_", F.lit(False))
        unknown = F.col("rules_").isNull()
    else:
        rows = _with_declared(calls, declared)
        tool = F.element_at("tools_", F.col("name"))
        rows = rows.withColumn("rules_", tool["rules"]).withColumn("open_", F.coalesce(tool["open"], F.lit(False)))
        unknown = F.col("name").isNull() | (F.col("tools_").isNotNull() & F.col("rules_").isNull())
    # Arguments as a map from name to value.
    rows = _once(rows, typed_=F.from_json("arguments", "map<string,variant>"))

    def broken(rule: Column) -> Column:
        text = F.to_json(F.element_at(F.col("typed_"), rule["argument"]))

        def fits(kind: Column) -> Column:
            every = F.lit(True)
            for name, pattern in _TYPES.items():
                every = every & ((kind != name) | text.rlike(pattern))
            return every

        missing = ~F.map_contains_key(F.col("typed_"), rule["argument"])
        fit = (F.size(rule["types"]) == 0) | F.exists(rule["types"], fits)
        return F.when(missing, rule["required"]).otherwise(~F.coalesce(fit, F.lit(False)))

    known = F.transform("rules_", lambda r: r["argument"])
    others = ~F.col("open_") & (F.size(F.array_except(F.map_keys("typed_"), known)) > 0)
    status = F.when(unknown, "unknown_tool").when(F.col("typed_").isNull() | F.exists("rules_", broken) | others, "invalid_arguments").otherwise("ok")
    return rows.withColumn("status", status).drop("tools_", "rules_", "open_", "typed_")


def chat_format(messages: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """conv_id, turn, role, order_key (sorts a conversation's messages topologically), status, json.

    ``status``: ok; for messages with calls the worst of theirs
    (invalid_arguments, unknown_tool, unanswered); for results unlinked where
    no call has their identifier.
    """
    every = message_rows(messages)
    is_json = F.ltrim("text").startswith("{")
    rows = parse_messages(every.filter(is_json))
    calls = rows.filter("calls_ is not null").select("conv_id", "turn", F.explode("calls_").alias("c")).select("conv_id", "turn", "c.*")
    answers = rows.filter("answer_ is not null").select("conv_id", "turn", F.col("answer_.id").alias("id"), F.col("answer_.content").alias("content"))
    first = calls.filter("conv_id is not null and turn is not null and id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "position")).alias("at_"))
    answered = answers.filter("conv_id is not null").groupBy("conv_id", "id").agg(F.count("*").alias("answers_"))
    checked = checked_calls(calls, schemas, declared_tools(rows)).join(first, ["conv_id", "id"], "left").join(answered, ["conv_id", "id"], "left")
    is_first = F.coalesce((F.col("at_.turn") == F.col("turn")) & (F.col("at_.position") == F.col("position")), F.lit(False))
    checked = checked.withColumn("status", F.when((F.col("status") == "ok") & ~(is_first & F.col("answers_").isNotNull()), "unanswered").otherwise(F.col("status")))
    worst = {"invalid_arguments": 3, "unknown_tool": 2, "unanswered": 1, "ok": 0}
    rank = F.create_map(*[F.lit(x) for kv in worst.items() for x in kv])
    by_message = checked.groupBy("conv_id", "turn").agg(F.max_by("status", rank[F.col("status")]).alias("calls_status_")).withColumnsRenamed({"conv_id": "conv_", "turn": "turn_"})

    def place(n: Column) -> Column:
        """Twelve digits; of longer numbers all, after a letter for their length, so that they sort behind; negative ones as what is left to 10**20, after a sign that sorts before digits."""
        whole = n.cast("decimal(20,0)")
        digits = whole.cast("string")
        below = F.concat(F.lit("-"), F.lpad((whole + F.lit("9" * 20).cast("decimal(21,0)")).cast("string"), 20, "0"))
        long = F.concat(F.char(F.length(digits) + (ord("a") - 13)), digits)
        return F.when(whole < 0, below).when(F.length(digits) > 12, long).when(whole.isNotNull(), F.lpad(digits, 12, "0")).otherwise("~")

    quoted = lambda c: F.to_json(c.cast("variant"))

    def out(df: DataFrame, order: Column, status: Column, json: Column) -> DataFrame:
        return df.select("conv_id", "turn", "role", F.concat_ws("/", *order).alias("order_key"), status.alias("status"), json.alias("json"))

    own_place = [place(F.col("turn")), F.lit("0"), place(F.col("turn"))]
    # Plain messages need no join at all, and most of them no parsing.
    plain = rows.filter("calls_ is null and answer_ is null").select(*every.columns).unionByName(every.filter(~is_json))
    plain = out(plain, own_place, F.lit("ok"), F.to_json(F.struct(F.col("text").alias("content"), "role")))
    call_json = F.transform("calls_", lambda c: F.struct(F.coalesce(F.to_json(F.try_parse_json(c["arguments"])), quoted(c["arguments"])).alias("a"), c["id"].alias("i"), c["name"].alias("n")))
    call_text = F.transform(call_json, lambda c: F.concat(F.lit('{"arguments":'), c["a"], F.lit(',"id":'), F.coalesce(quoted(c["i"]), F.lit("null")), F.lit(',"name":'), F.coalesce(quoted(c["n"]), F.lit("null")), F.lit("}")))
    calling = rows.filter("calls_ is not null")
    calling = calling.join(by_message, calling["conv_id"].eqNullSafe(F.col("conv_")) & calling["turn"].eqNullSafe(F.col("turn_")), "left")
    # A result goes after its call; one that calls in turn stays at its own turn unless that is before its call.
    target = first.withColumnsRenamed({"conv_id": "conv_", "id": "id_"})
    after = [place(F.coalesce(F.col("at_.turn"), F.col("turn"))), F.when(F.col("at_").isNotNull(), F.concat(F.lit("1"), place(F.col("at_.position")))).otherwise("0"), place(F.col("turn"))]
    calling = calling.drop("conv_", "turn_").withColumn("answer_id_", F.col("answer_.id"))
    calling = calling.join(target, (calling["conv_id"] == F.col("conv_")) & (calling["answer_id_"] == F.col("id_")), "left")
    early = F.coalesce(F.col("at_.turn") > F.col("turn"), F.lit(False))
    status = F.coalesce("calls_status_", F.lit("ok"))
    status = F.when((status == "ok") & F.col("answer_id_").isNotNull() & F.col("at_").isNull(), "unlinked").otherwise(status)
    given = lambda name, c: F.coalesce(F.concat(F.lit(f'"{name}":'), quoted(c), F.lit(",")), F.lit(""))
    calling_json = F.concat(F.lit("{"), given("content", F.col("content_")), F.lit('"role":'), quoted(F.col("role")), F.lit(","), given("tool_call_id", F.col("answer_id_")), F.lit('"tool_calls":['), F.array_join(call_text, ","), F.lit("]}"))
    calling = out(calling, [F.when(early, x).otherwise(y) for x, y in zip(after, own_place, strict=True)], status, calling_json)
    results = rows.filter("calls_ is null and answer_ is not null").withColumn("answer_id_", F.col("answer_.id"))
    results = results.join(target, (results["conv_id"] == F.col("conv_")) & (results["answer_id_"] == F.col("id_")), "left")
    results = out(results, after, F.when(F.col("at_").isNull(), "unlinked").otherwise("ok"), F.to_json(F.struct(F.coalesce("answer_.content", F.lit("")).alias("content"), "role", F.col("answer_.id").alias("tool_call_id"))))
    return plain.unionByName(calling).unionByName(results)
