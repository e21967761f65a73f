"""Chat formatting with linked tool calls, in DataFrame operations only.

``format_messages`` takes messages (conv_id, turn, role, content, calls, result_for), links each result
to its call by a hash join on (conv_id, identifier), puts messages in an order in which no result stands before its
call and no call before the results it names in ``after``, validates arguments against schemas and
serialises each message as canonical JSON (keys sorted, no spaces, nulls left out).  The order is
(conv_id, order_turn, order_step, turn): a message keeps its turn unless what it depends on comes later;
then it goes right behind it.  Nothing gathers a conversation in one row or task.

``parse_messages`` reads calls from texts: an object with ``content``, ``tool_calls`` (id, name, arguments, after) or
``tool_call_id``.  ``turns_as_calls`` makes such texts of plain turns, under the identifiers "conv_id:turn".

Defined results: a null or empty text is empty content; a result whose call is missing is kept with linked =
false, a call without a result too; of several calls with one identifier in a conversation the first counts; arguments that are no JSON object,
an unknown tool, a missing or mistyped required argument, or an extra one make valid false; messages in a
cycle of dependencies, or between two, keep their turn and have ordered = false, and what else depends on them stands behind them;
repeated rows return repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .textkit import Workspace, table

CALLS = "array<struct<id:string,name:string,arguments:string,after:array<string>>>"
#: For each tool its arguments: (type, required).
REPLY = {"reply": {"text": ("string", True), "turn": ("integer", True)}}
_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


def parse_messages(df: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kind = f"content string, tool_calls {CALLS}, tool_call_id string"
    got = F.when(text.rlike(r"^\s*\{"), F.from_json(text, kind))
    known = F.coalesce(got["tool_calls"].isNotNull() | got["tool_call_id"].isNotNull(), F.lit(False))
    return df.select("conv_id", "turn", "role", F.when(known, F.coalesce(got["content"], F.lit(""))).otherwise(text).alias("content"), got["tool_calls"].alias("calls"), got["tool_call_id"].alias("result_for"))


def turns_as_calls(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, where plain turns have become messages that ``parse_messages`` reads.

    A user turn calls ``reply``, an assistant turn is the result of the turn before.  By conv_id + turn some calls differ, so that all that a
    log of tool calls may hold occurs: one in seven waits for the result of the next user turn, which comes later, and in conversations with an
    even id that one waits for this; others have a mistyped argument, an argument too many, arguments cut short, or an unknown tool.
    Texts that hold calls of their own stay.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn, kind = F.col("turn"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7))
    name = lambda step: F.concat_ws(":", F.col("conv_id").cast("string"), (turn + step).cast("string"))
    fields = lambda *more: F.to_json(F.struct(text.alias("text"), *more))
    args = F.when(kind == 2, fields(turn.cast("string").alias("turn"))).when(kind == 4, F.concat(F.lit('{"text":'), quoted(text)))
    args = args.when(kind == 6, fields(F.lit("plain").alias("tone"), turn)).otherwise(fields(turn))
    after = F.when(kind == 1, F.array(name(2))).when((kind == 3) & (F.pmod(F.col("conv_id"), F.lit(2)) == 0), F.array(name(-2)))
    tool = F.when(kind == 5, F.lit("answer")).otherwise(F.lit("reply"))
    call = F.array(F.struct(name(0).alias("id"), tool.alias("name"), args.alias("arguments"), after.alias("after")))
    message = F.when(F.col("role") == "user", F.to_json(F.struct(call.alias("tool_calls"))))
    message = message.when(F.col("role") == "assistant", F.to_json(F.struct(text.alias("content"), name(-1).alias("tool_call_id")))).otherwise(text)
    return df.select("conv_id", "turn", "role", F.when(text.rlike(r'(?s)^\s*\{.*"tool_call'), text).otherwise(message).alias("text"))


def argument_test(name: Column, arguments: Column, schemas: dict) -> Column:
    """Whether arguments (JSON text) fit the schema of the tool."""
    v = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    out = F.lit(False)
    for tool, fields in sorted(schemas.items()):
        ok = F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, fields)) if fields else F.array().cast("array<string>"))) == 0, F.lit(False))
        for field, (kind, required) in sorted(fields.items()):
            there = F.array_contains(keys, field)
            of = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
            fits = F.lit(False)
            for prefix in _TYPES[kind]:
                fits = fits | of.startswith(prefix)
            ok = ok & F.when(there, F.coalesce(fits, F.lit(False))).otherwise(F.lit(not required))
        out = F.when(name == tool, F.coalesce(ok, F.lit(False))).otherwise(out)
    return out


def call_json(c: Column) -> Column:
    """A call as canonical JSON; arguments that are no JSON stay text."""
    parsed = F.to_json(F.try_parse_json(c["arguments"]))
    args = F.coalesce(parsed, F.to_json(F.struct(c["arguments"].alias("a"))).substr(F.lit(6), F.length(F.to_json(F.struct(c["arguments"].alias("a")))) - 6))
    return F.concat(F.lit('{"arguments":'), F.coalesce(args, F.lit("{}")), F.lit(',"id":'), quoted(c["id"]), F.lit(',"name":'), quoted(c["name"]), F.lit("}"))


def quoted(text: Column) -> Column:
    whole = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("a")))
    return whole.substr(F.lit(6), F.length(whole) - 6)  # {"a":...}


def settled(edges: DataFrame, work: Workspace) -> tuple[DataFrame, bool]:
    """(conv_id, turn, k, open) of the nodes of the edges (conv_id, turn, parent), and whether none is open.

    k is the greatest of the node's own (turn, 0) and its parents' k a step further.  In each round an edge to a node
    without parents is done, and one to a node with a single parent goes on to that parent, so that a chain of n takes
    log n rounds.  A round in which no node is done leaves those that are in a cycle or depend on one.
    """

    def own(turn: str) -> Column:
        return F.struct(F.col(turn).alias("t"), F.lit(0).cast("long").alias("s")).alias("c")

    # a row for each edge, with the steps it stands for, and one without parent that carries the key as far as known
    now = edges.select("conv_id", "turn", "parent", F.lit(1).cast("long").alias("w"), own("turn"))
    roots = edges.select("conv_id", F.col("parent").alias("turn")).union(edges.select("conv_id", "turn")).distinct()
    now = work.cut(now.union(roots.select("conv_id", "turn", F.lit(None).cast("long"), F.lit(0).cast("long"), own("turn"))))
    before = None
    while True:
        left = now.where("parent is not null").select("conv_id", "turn").distinct().count()
        if not left or left == before:
            break
        of = now.groupBy("conv_id", F.col("turn").alias("parent")).agg(F.count("parent").alias("n"), F.max("parent").alias("q"), F.max("w").alias("more"), F.max("c").alias("m"))
        on = now.where("parent is not null").join(of, ["conv_id", "parent"])
        # no chain is as long as the bound; without it the steps of a cycle would double past any number
        steps = F.least(F.col("w") + F.when(F.col("n") == 1, F.col("more")).otherwise(0), F.lit(1 << 40))
        key = F.greatest("c", F.struct(F.col("m.t").alias("t"), (F.col("m.s") + F.col("w")).alias("s")))
        on = on.select("conv_id", "turn", F.when(F.col("n") == 1, F.col("q")).when(F.col("n") > 1, F.col("parent")).alias("parent"), steps.alias("w"), key.alias("c"))
        known = on.select("conv_id", "turn", F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("w"), "c")
        new = work.cut(now.where("parent is null").union(known).union(on.where("parent is not null")).groupBy("conv_id", "turn", "parent").agg(F.max("w").alias("w"), F.max("c").alias("c")))
        work.drop(now)
        now, before = new, left
    k = F.max("c")
    return now.groupBy("conv_id", "turn").agg(F.struct(k["t"].alias("t"), k["s"].alias("s")).alias("k"), (F.count("parent") > 0).alias("open")), not left


def places(messages: DataFrame, work: Workspace) -> DataFrame:
    """(conv_id, turn, k, _stuck) of the messages that do not simply keep their turn."""
    calls = messages.where("calls is not null").select("conv_id", "turn", F.explode("calls").alias("c"))
    owner = calls.groupBy("conv_id", F.col("c.id").alias("id")).agg(F.min("turn").alias("parent"))
    results = messages.where("result_for is not null").select("conv_id", F.col("result_for").alias("id"), "turn")
    first = results.groupBy("conv_id", "id").agg(F.min("turn").alias("parent"))
    wants = calls.select("conv_id", "turn", F.explode("c.after").alias("id"))
    edges = results.join(owner, ["conv_id", "id"]).select("conv_id", "turn", "parent").union(wants.join(first, ["conv_id", "id"]).select("conv_id", "turn", "parent")).where("turn <> parent").distinct()
    edges = work.cut(edges)
    # without a turn behind a later one every message keeps its turn, and there is no cycle
    late = edges.select("conv_id", "turn", F.struct(F.col("turn").alias("t"), F.lit(0).alias("s")).alias("k"), F.lit(True).alias("_stuck")).where("false")
    if not edges.where("parent > turn").isEmpty():
        keys, whole = settled(edges, work)
        late = keys.select("conv_id", "turn", "k", F.lit(None).cast("boolean").alias("_stuck"))
        if not whole:
            # what is open is in a cycle or depends on one; seen from behind, what is open too is in a cycle or between two
            end = keys.where("open").select("conv_id", "turn")
            inner = edges.join(end, ["conv_id", "turn"], "left_semi").join(end.withColumnRenamed("turn", "parent"), ["conv_id", "parent"], "left_semi")
            back, _ = settled(inner.select("conv_id", F.col("parent").alias("turn"), F.col("turn").alias("parent")), work)
            stuck = back.where("open").select("conv_id", "turn")
            keys, _ = settled(edges.join(stuck, ["conv_id", "turn"], "left_anti"), work)
            late = keys.join(stuck.withColumn("_stuck", F.lit(True)), ["conv_id", "turn"], "full").select("conv_id", "turn", "k", "_stuck")
    return late


def format_messages(messages: DataFrame, schemas: dict) -> DataFrame:
    """conv_id, turn, role, order_turn, order_step, ordered, n_calls, linked, valid, json of every message."""
    work = Workspace(messages.sparkSession)
    messages = work.cut(messages)  # texts are parsed once; what follows reads the columns it needs
    calls = messages.where("calls is not null").select("conv_id", F.explode("calls").alias("c"))
    made = calls.groupBy("conv_id", F.col("c.id").alias("result_for")).agg(F.lit(True).alias("_made"))
    late = places(messages, work)
    # answered calls of each turn
    answered = messages.where("result_for is not null").select("conv_id", F.col("result_for").alias("id")).distinct().withColumn("_answered", F.lit(True))
    asked = messages.where("calls is not null").select("conv_id", "turn", F.explode("calls.id").alias("id")).distinct()
    asked = asked.join(answered, ["conv_id", "id"], "left").groupBy("conv_id", "turn").agg(F.min(F.col("_answered").isNotNull()).alias("_all"))
    # what is known of a message comes together without its texts, which are shuffled once
    known = messages.select("conv_id", "turn", "result_for").distinct().join(late, ["conv_id", "turn"], "left")
    known = known.join(made, ["conv_id", "result_for"], "left").join(asked, ["conv_id", "turn"], "left")
    known = known.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("result_for").alias("_for"), "k", "_stuck", "_made", "_all")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")) & F.col("result_for").eqNullSafe(F.col("_for"))
    rows = messages.join(known, same)
    order = [F.coalesce("k.t", "turn").alias("order_turn"), F.coalesce(F.col("k.s").cast("int"), F.lit(0)).alias("order_step"), F.col("_stuck").isNull().alias("ordered")]
    has = F.coalesce(F.size("calls"), F.lit(0)) > 0
    n = F.when(has, F.size("calls")).otherwise(0)
    linked = F.when(F.col("result_for").isNotNull(), F.col("_made").isNotNull()).when(has, F.coalesce("_all", F.lit(False)))
    valid = F.when(has, F.forall("calls", lambda c: argument_test(c["name"], c["arguments"], schemas)))
    parts = [F.concat(F.lit('"content":'), quoted(F.col("content"))), F.concat(F.lit('"role":'), quoted(F.col("role")))]
    parts += [F.when(F.col("result_for").isNotNull(), F.concat(F.lit('"tool_call_id":'), quoted(F.col("result_for"))))]
    parts += [F.when(has, F.concat(F.lit('"tool_calls":['), F.concat_ws(",", F.transform("calls", call_json)), F.lit("]")))]
    json = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return rows.select("conv_id", "turn", "role", *order, n.alias("n_calls"), linked.alias("linked"), valid.alias("valid"), json.alias("json"))


def op5_chat(spark, sf_dir: str) -> DataFrame:
    return format_messages(parse_messages(turns_as_calls(table(spark, sf_dir, "conversations"))), REPLY)


QUERIES = {"op5_chat": op5_chat}
SQL = {
    "op5_chat": """
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, (conv_id + turn) % 7 AS kind FROM conversations),
u AS (SELECT DISTINCT conv_id, turn FROM c WHERE role = 'user'), a AS (SELECT DISTINCT conv_id, turn FROM c WHERE role = 'assistant'),
w AS (SELECT conv_id, turn, (conv_id, turn + 1) IN (SELECT (conv_id, turn) FROM a) AS answered, (conv_id, turn + 2) IN (SELECT (conv_id, turn) FROM u) AS asked
  FROM u WHERE (conv_id + turn) % 7 = 1 AND (conv_id, turn + 3) IN (SELECT (conv_id, turn) FROM a)),
late AS (SELECT conv_id, turn, conv_id % 2 = 0 AND answered AND asked AS ring FROM w),
ring AS (SELECT conv_id, turn + unnest([0, 1, 2, 3]) AS turn FROM late WHERE ring),
moved AS (SELECT conv_id, turn, turn + 3 AS order_turn, 1 AS order_step FROM late WHERE NOT ring
  UNION ALL SELECT conv_id, turn + 1, turn + 3, 2 FROM late WHERE NOT ring AND (conv_id, turn + 1) IN (SELECT (conv_id, turn) FROM a)),
j AS (SELECT c.*, CASE kind WHEN 2 THEN concat('{"text":', to_json(text), ',"turn":"', turn, '"}') WHEN 4 THEN CAST(to_json(concat('{"text":', to_json(text))) AS VARCHAR)
  WHEN 6 THEN concat('{"text":', to_json(text), ',"tone":"plain","turn":', turn, '}') ELSE concat('{"text":', to_json(text), ',"turn":', turn, '}') END AS args FROM c)
SELECT j.conv_id, j.turn, role, coalesce(m.order_turn, j.turn) AS order_turn, coalesce(m.order_step, 0) AS order_step, (j.conv_id, j.turn) NOT IN (SELECT (conv_id, turn) FROM ring) AS ordered,
  CASE WHEN role = 'user' THEN 1 ELSE 0 END AS n_calls,
  CASE WHEN role = 'user' THEN (j.conv_id, j.turn + 1) IN (SELECT (conv_id, turn) FROM a) WHEN role = 'assistant' THEN (j.conv_id, j.turn - 1) IN (SELECT (conv_id, turn) FROM u) END AS linked,
  CASE WHEN role = 'user' THEN kind IN (0, 1, 3) END AS valid,
  CASE WHEN role = 'user' THEN concat('{"content":"","role":"user","tool_calls":[{"arguments":', args, ',"id":"', j.conv_id, ':', j.turn, '","name":"', CASE kind WHEN 5 THEN 'answer' ELSE 'reply' END, '"}]}')
       ELSE concat('{"content":', to_json(text), ',"role":', to_json(role), CASE WHEN role = 'assistant' THEN concat(',"tool_call_id":"', j.conv_id, ':', j.turn - 1, '"') ELSE '' END, '}') END AS json
FROM j LEFT JOIN moved m ON m.conv_id = j.conv_id AND m.turn = j.turn
"""
}
