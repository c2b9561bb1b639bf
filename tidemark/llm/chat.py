"""Chat formatting: tool calls linked to their results, ordered, validated, and written as canonical JSON.

DataFrame functions only.  Messages carry calls and results as events:

* a call has an identifier, a tool name, JSON arguments and, optionally, the
  identifiers of calls whose results it needs;
* a result has the identifier of its call.

Calls and results meet in a hash join on (conversation, identifier), each side
reduced to one row per identifier first, so repeated identifiers never multiply.
Topological order is by sort key, not by a rank over a conversation: a result
comes no earlier than its call, a call no earlier than the calls it needs.  Keys
are (anchor turn, level, turn); the anchor is the largest turn met on the way to
a message and the level its distance there, found by rounds of joins that double
the length of ways: about log2 n rounds for n calls in a row, each of which may
need several.  So a conversation may hold any share of all rows.  A message on a
cycle, or behind one, keeps its own turn and is marked.

Canonical JSON: keys sorted at every depth, no white space, strings with the
escapes that JSON requires only, and one form for numbers of equal value (100,
100.0 and 1e2 are ``100``), whatever their size and digits.  For that, numbers
are read as strings of their digits, so none goes through a binary fraction.

Schemas are compared by JSON type and value, at any depth: ``type`` (a whole number
is an integer in any form), ``enum``, bounds of lengths and values, ``required``,
``properties``, ``items`` and ``additionalProperties: False``.

Defined results: null conversation, turn, role or text are kept and written as
null; messages without events are written alone; a repeated identifier counts
once (smallest turn, then text) and is marked on the others; repeated rows are
rows each; results without calls and calls without results are marked; arguments
that are no JSON object are invalid, and so are those with a key that is there
twice; very long texts are written whole; columns other than conv_id, turn, role
and text (and the event columns for ``link_calls``) are left behind, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import Scratch

#: Strings, numbers and what lies between them; possessive, so that long strings need no stack.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TOKENS = rf'({_STRING}|-?[0-9][0-9.eE+-]*+|[^"0-9-]++|-)'
_NUMBER = r"^-?([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$"
_MARKED = r'(")s([^"\\]*+(?:\\.[^"\\]*+)*+)(")|"n([^"]*+)"'
#: Numbers are written without an exponent where their first digit stands within these powers of ten.
_LEAST_PLAIN, _MOST_PLAIN = -6, 21


def quoted(text: Column) -> Column:
    """A string as a JSON string (null as null)."""
    # to_json of a one-element array quotes its string; brackets are cut off.
    whole = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(whole.substr(F.lit(2), F.length(whole) - 2))


def canonical(fields: dict[str, Column]) -> Column:
    """An object of already serialised values: keys sorted, no white space."""
    parts: list[Column] = []
    for k, name in enumerate(sorted(fields)):
        parts += [F.lit(("," if k else "{") + f'"{name}":'), F.coalesce(fields[name], F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def canonical_number(token: Column) -> Column:
    """The one form of a JSON number's value."""
    part = lambda k: F.regexp_extract(token, _NUMBER, k)
    digits = F.concat(part(1), part(2))
    bare = F.regexp_replace(digits, "^0+", "")
    # The value is 0.d1d2d3... times ten to the power ``point``.
    point = F.length(part(1)) + F.coalesce(F.when(part(3) == "", F.lit(0)).otherwise(part(3).try_cast("int")), F.lit(0)) - (F.length(digits) - F.length(bare))
    d = F.regexp_replace(bare, "0+$", "")
    n = F.length(d)
    plain = (
        F.when(point >= n, F.concat(d, F.repeat(F.lit("0"), point - n)))
        .when(point > 0, F.concat(d.substr(F.lit(1), point), F.lit("."), d.substr(point + 1, n)))
        .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), d))
    )
    far = F.concat(d.substr(F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), d.substr(F.lit(2), n))).otherwise(F.lit("")), F.lit("e"), (point - 1).cast("string"))
    sign = F.when(token.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return F.when(d == "", F.lit("0")).otherwise(F.concat(sign, F.when(point.between(_LEAST_PLAIN + 1, _MOST_PLAIN), plain).otherwise(far)))


def _marked(text: Column) -> Column:
    """JSON with each string begun by ``s`` and each number as a string begun by ``n``, in its canonical form."""

    def one(t: Column) -> Column:
        return F.when(t.startswith('"'), F.concat(F.lit('"s'), t.substr(F.lit(2), F.length(t)))).when(t.rlike("^-?[0-9]"), F.concat(F.lit('"n'), canonical_number(t), F.lit('"'))).otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(1)), one), "")


def _unmarked(text: Column) -> Column:
    return F.regexp_replace(text, _MARKED, "$1$2$3$4")


def canonical_json(text: Column) -> Column:
    """Valid JSON in its canonical form; null of anything else, and of objects with a key that is there twice."""
    valid = F.try_parse_json(text).isNotNull()
    return F.when(valid, _unmarked(F.to_json(F.try_parse_json(_marked(text)))))


def _python_number(x: int | float) -> str:
    from decimal import Decimal

    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    d = "".join(map(str, digits)).lstrip("0")
    point = len(d) + int(exponent)
    d = d.rstrip("0")
    if not d:
        return "0"
    n = len(d)
    if not _LEAST_PLAIN < point <= _MOST_PLAIN:
        out = d[0] + (f".{d[1:]}" if n > 1 else "") + f"e{point - 1}"
    else:
        out = d + "0" * (point - n) if point >= n else f"{d[:point]}.{d[point:]}" if point > 0 else "0." + "0" * -point + d
    return "-" * sign + out


def _python_canonical(x) -> str:
    """A Python value in canonical JSON, marked as ``_marked`` marks it."""
    import json

    if isinstance(x, bool) or x is None:
        return json.dumps(x)
    if isinstance(x, int | float):
        return f'"n{_python_number(x)}"'
    if isinstance(x, str):
        return json.dumps("s" + x, ensure_ascii=False)
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps('s' + k, ensure_ascii=False)}:{_python_canonical(x[k])}" for k in sorted(x)) + "}"
    return "[" + ",".join(map(_python_canonical, x)) + "]"


#: What may stand in the text of a marked value of each schema type.
_TYPES = {"string": '^"s', "number": '^"n', "integer": r'^"n-?[0-9]+(?:e[0-9]+)?"$', "boolean": "^(?:true|false)$", "object": r"^\{", "array": r"^\[", "null": "^null$"}


def _rules(value: Column, schema: dict, name: str) -> list[tuple[Column, str]]:
    """What can be wrong with a marked variant, in order: (whether it is, in words).  A missing value has nothing wrong."""
    text = F.to_json(value)
    bare = F.try_variant_get(value, "$", "string").substr(F.lit(2), F.length(text))
    is_string, is_number = text.startswith('"s'), text.startswith('"n')
    out: list[tuple[Column, str]] = []
    if "type" in schema:
        out.append((~text.rlike(_TYPES[schema["type"]]), f"{name} is no {schema['type']}"))
    if "enum" in schema:
        out.append((~text.isin([_python_canonical(x) for x in schema["enum"]]), f"{name} is not allowed"))
    for key, wrong, words in (("minLength", lambda n: F.length(bare) < n, "too short"), ("maxLength", lambda n: F.length(bare) > n, "too long")):
        if key in schema:
            out.append((is_string & wrong(schema[key]), f"{name} is {words}"))
    for key, wrong, words in (("minimum", lambda n: bare.try_cast("double") < float(n), "too small"), ("maximum", lambda n: bare.try_cast("double") > float(n), "too large")):
        if key in schema:
            out.append((is_number & wrong(schema[key]), f"{name} is {words}"))
    # An object's fields are read from it; what is no object has none.
    at = lambda field: F.try_variant_get(value, f"$['s{field}']", "variant")
    inside = f"{name}." if name else ""
    for field in schema.get("required", []):
        out.append((text.startswith("{") & (at(field).isNull() | F.is_variant_null(at(field))), f"missing {inside}{field}"))
    for field, rule in sorted(schema.get("properties", {}).items()):
        given = at(field) if rule.get("type") == "null" else F.when(~F.is_variant_null(at(field)), at(field))
        out += _rules(given, rule, f"{inside}{field}")
    if schema.get("additionalProperties") is False:
        allowed = F.array(*(F.lit("s" + x) for x in sorted(schema.get("properties", {})))) if schema.get("properties") else F.array().cast("array<string>")
        out.append((F.size(F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), allowed)) > 0, f"an unknown field in {name}" if name else "an unknown field"))
    if "items" in schema:
        items = F.try_variant_get(value, "$", "array<variant>")
        for k, (_, words) in enumerate(_rules(F.try_parse_json(F.lit("null")), schema["items"], f"an item of {name}")):
            out.append((F.exists(items, _rule_of_item(schema["items"], k)), words))
    return out


def _rule_of_item(schema: dict, k: int):
    return lambda x: F.coalesce(_rules(x, schema, "")[k][0], F.lit(False))


def marked_value(arguments: Column) -> Column:
    """What ``invalid_reason`` reads fields from; null of what is no JSON."""
    return F.try_parse_json(_marked(arguments))


def invalid_reason(name: Column, arguments: Column, schemas: dict[str, dict], value: Column | None = None) -> Column:
    """Null if the arguments fit the schema of the named tool, else what is wrong first.

    A schema has ``type``, ``enum``, ``minLength``, ``maxLength``, ``minimum``, ``maximum``, ``required``,
    ``properties``, ``items`` and, if other fields are refused, ``additionalProperties: False``.
    """
    known = F.lit(False)
    reason = F.lit(None).cast("string")
    is_object = F.coalesce(F.ltrim(arguments).startswith("{") & F.get_json_object(arguments, "$").isNotNull(), F.lit(False))
    value = marked_value(arguments) if value is None else value
    for tool, schema in sorted(schemas.items()):
        known = known | (name == tool)
        own = F.lit(None).cast("string")
        for bad, text in reversed(_rules(value, schema, "")):
            own = F.when(F.coalesce(bad, F.lit(False)), F.lit(text)).otherwise(own)
        reason = F.when(name == tool, own).otherwise(reason)
    return (
        F.when(~is_object, F.lit("arguments are no object"))
        .when(F.try_parse_json(arguments).isNull(), F.lit("a repeated key"))
        .when(~F.coalesce(known, F.lit(False)), F.lit("unknown tool"))
        .otherwise(reason)
    )


_MESSAGE = ["conv_id", "turn", "role", "text"]


def embedded_events(messages: DataFrame) -> DataFrame:
    """Events written as JSON in the text: {"tool_call": {"id", "name", "arguments", "needs"}} or {"tool_result": {"id"}}.

    Arguments may be an object or, as some services write them, a string that holds one.
    """
    text = _marked(F.when(F.ltrim("text").startswith('{"tool_'), F.col("text")))
    call, result = F.get_json_object(text, "$.stool_call"), F.get_json_object(text, "$.stool_result")
    bare = lambda x: x.substr(F.lit(2), F.length(x))
    arguments = F.get_json_object(call, "$.sarguments")
    return messages.select(
        *_MESSAGE,
        bare(F.get_json_object(call, "$.sid")).alias("call_id"),
        bare(F.get_json_object(call, "$.sname")).alias("tool"),
        F.when(arguments.rlike("^[sn]"), bare(arguments)).otherwise(_unmarked(arguments)).alias("arguments"),
        F.coalesce(F.transform(F.from_json(F.get_json_object(call, "$.sneeds"), "array<string>"), bare), F.array().cast("array<string>")).alias("needs"),
        bare(F.get_json_object(result, "$.sid")).alias("result_id"),
    )


def reply_events(messages: DataFrame) -> DataFrame:
    """Plain dialogues as calls: a user turn calls ``reply``, awaited at the next turn; an assistant turn is the result awaited there.

    Calls also need calls, so that messages are not yet in order: of a conversation's exchanges every other one needs the
    one that follows it, and those need the one three before, where there are such.  A conversation is thus one chain.
    """
    at = F.col("turn").cast("string")
    need = F.when(F.floor(F.col("turn") / 2) % 2 == 0, F.col("turn") + 3).otherwise(F.col("turn") - 5)
    is_user, is_reply = F.col("role") == "user", F.col("role") == "assistant"
    text = F.coalesce("text", F.lit(""))
    tone = F.when((F.length(text) + 3) % 7 == 0, "loud").when(F.length(text) % 2 == 0, "asking").otherwise("plain")
    # Written as services do: keys in any order, white space, numbers in any form.
    arguments = F.concat(
        F.lit('{ "text" : '), quoted(F.col("text")), F.lit(', "turn": '), F.coalesce(at, F.lit("null")), F.lit('.0, "style": {"tone": "'), tone, F.lit('", "length": '),
        F.length(text).cast("string"), F.lit('e0, "marks": ['), F.length(F.regexp_replace(text, "[^.]", "")).cast("string"), F.lit(", "), F.length(F.regexp_replace(text, "[^,]", "")).cast("string"), F.lit('.50 ]}, "first" : '),
        (F.col("turn") == 0).cast("string"), F.lit("}"),
    )
    return messages.select(
        *_MESSAGE,
        F.when(is_user, (F.col("turn") + 1).cast("string")).alias("call_id"),
        F.when(is_user, F.lit("reply")).alias("tool"),
        F.when(is_user, arguments).alias("arguments"),
        F.when(is_user & F.col("turn").isNotNull(), F.array(need.cast("string"))).otherwise(F.array().cast("array<string>")).alias("needs"),
        F.when(is_reply, at).alias("result_id"),
    )


def link_calls(events: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Messages (conv_id, turn, role, text and the event columns) linked, ordered and validated.

    Returns conv_id, turn, role, text, kind (call, result, message), event_id,
    link (linked, unanswered, orphan, repeated; null for plain messages),
    invalid (reason), order_turn, order_level, cyclic and json.
    """
    conv = F.col("conv_id")
    kind = F.when(F.col("call_id").isNotNull(), "call").when(F.col("result_id").isNotNull(), "result").otherwise("message")
    rows = events.select("conv_id", "turn", "role", "text", "call_id", "tool", "arguments", "needs", "result_id", kind.alias("kind"), F.coalesce("call_id", "result_id").alias("event_id"))
    least = F.struct("turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    sides = rows.filter(F.col("kind") != "message").groupBy("conv_id", "event_id").agg(
        F.min(F.when(F.col("kind") == "call", least)).alias("call"),
        F.min(F.when(F.col("kind") == "result", least)).alias("result"),
        F.min_by(F.when(F.col("kind") == "call", F.col("needs")), F.when(F.col("kind") == "call", least)).alias("call_needs"),
    )
    order = sides.select("conv_id", "event_id", "call", "result", F.coalesce("call_needs", F.array().cast("array<string>")).alias("call_needs"), F.col("call.turn").alias("anchor"), F.lit(0).alias("level"), F.lit(False).alias("cyclic"))
    order = _order_calls(order)
    order = order.select(F.col("conv_id").alias("of_conv"), F.col("event_id").alias("of_event"), "call", "result", "anchor", "level", "cyclic")
    out = rows.join(order, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("event_id") == F.col("of_event")), "left").drop("of_conv", "of_event")
    own = F.struct("turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    link = (
        F.when(is_call & ~own.eqNullSafe(F.col("call")) | is_result & ~own.eqNullSafe(F.col("result")), "repeated")
        .when(is_call, F.when(F.col("result").isNotNull(), "linked").otherwise("unanswered"))
        .when(is_result, F.when(F.col("call").isNotNull(), "linked").otherwise("orphan"))
    )
    bound = F.coalesce("cyclic", F.lit(False))
    linked_result = is_result & F.col("call").isNotNull() & ~bound
    out = out.withColumn("link", link).withColumn("value", marked_value(F.when(is_call, F.col("arguments"))))
    out = out.withColumn("invalid", F.when(is_call, invalid_reason(F.col("tool"), F.col("arguments"), schemas, F.col("value")))).drop("value")
    turn = F.col("turn")
    anchor = F.when(is_call & ~bound, F.greatest(turn, F.col("anchor"))).when(linked_result, F.greatest(turn, F.col("anchor"))).otherwise(turn)
    level = F.when(is_call & ~bound & (F.col("anchor") >= turn), F.col("level")).when(linked_result & (F.col("anchor") >= turn), F.col("level") + 1).otherwise(F.lit(0))
    out = out.withColumn("order_turn", anchor).withColumn("order_level", level.cast("int")).withColumn("cyclic", bound)
    number = lambda c: F.col(c).cast("string")
    json = canonical({
        "content": F.when(is_call, F.lit("null")).otherwise(quoted(F.col("text"))),
        "conv": number("conv_id"),
        "id": quoted(F.col("event_id")),
        "kind": quoted(F.col("kind")),
        "link": quoted(F.col("link")),
        "role": quoted(F.col("role")),
        "tool": quoted(F.col("tool")),
        "arguments": F.when(F.col("invalid").isin("arguments are no object", "a repeated key"), quoted(F.col("arguments"))).otherwise(canonical_json(F.col("arguments"))),
        "turn": number("turn"),
        "valid": F.when(is_call, F.col("invalid").isNull().cast("string")),
    })
    return out.select(conv, "turn", "role", "text", "kind", "event_id", "link", "invalid", "order_turn", "order_level", "cyclic", json.alias("json"))


#: Above any level, and small enough to add two of them; only calls on or behind a cycle get there.
_TOP = 1 << 40
#: A needed call with up to ``FEW`` open needs is replaced by them in calls that have ``SEVERAL`` at most.
FEW, SEVERAL = 4, 16
_FIRST = -(1 << 63)


def _order_calls(order: DataFrame) -> DataFrame:
    """Anchors and levels of calls that need others; those that never settle are on or behind a cycle.

    The place of a call is the largest of its own (turn, 0), (turn, 1) of the results it awaits, and the places of the
    calls it needs with the level raised, so places are longest paths.  Each round puts in, for every needed call, what
    is known of it: a settled one is replaced by its place, one with few needs of its own by these.  Ways thus double in
    each round; a call has some dozens of needs at most beyond those it was given (``FEW``, ``SEVERAL``), and a round
    settles a call as long as any is left that is not behind a cycle.
    """
    waiting = order.filter(F.size("call_needs") > 0)
    if not waiting.limit(1).count():
        return order
    scratch = Scratch(order.sparkSession, "chat")
    order = scratch.save(order)
    is_of = lambda event: F.col("conv_id").eqNullSafe(F.col("c")) & (F.col(event) == F.col("e"))
    raised = lambda at, by: F.struct(at["turn"].alias("turn"), F.least(at["level"] + by, F.lit(_TOP)).alias("level"))
    calls = order.filter(F.col("call").isNotNull())
    known = calls.select(F.col("conv_id").alias("c"), F.col("event_id").alias("e"), F.col("result.turn").alias("answered"), F.struct(F.coalesce("call.turn", F.lit(_FIRST)).alias("turn"), "event_id").alias("rank"))
    edges = order.select("conv_id", "event_id", F.explode(F.array_distinct("call_needs")).alias("need")).join(known, is_of("need"))
    # A need is a way to a call and its length; ``least`` is what the way is worth at least.
    is_answered = F.col("answered").isNotNull()
    edges = scratch.save(edges.select("conv_id", "event_id", "need", "rank", F.when(is_answered, 2).otherwise(1).cast("long").alias("far"), F.when(is_answered, F.struct(F.col("answered").alias("turn"), F.lit(1).cast("long").alias("level"))).alias("least")))
    start = calls.select("conv_id", "event_id", F.struct(F.col("call.turn").alias("turn"), F.lit(0).cast("long").alias("level")).alias("place"))

    def gathered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        own = edges.groupBy(F.col("conv_id").alias("c"), F.col("event_id").alias("e")).agg(F.max("least").alias("least"), F.count("need").alias("n"))
        return scratch.save(nodes.join(own, is_of("event_id"), "left").select("conv_id", "event_id", F.greatest("place", "least").alias("place"), F.coalesce("n", F.lit(0)).alias("open")))

    def lean(edges: DataFrame) -> DataFrame:
        """Needs without those that another need reaches by a way that is no shorter.

        A need gives way to a later call only (by turn, then name), so in a cycle, too, the last one stays.
        """
        per = Window.partitionBy("conv_id", "event_id")
        counted = edges.filter(F.col("need").isNotNull()).withColumn("n", F.count("*").over(per))
        first = counted.filter(F.col("n").between(2, SEVERAL)).select("conv_id", "event_id", "need", "rank", F.col("far").alias("to_via"))
        second = counted.filter(F.col("n") <= FEW).select(F.col("conv_id").alias("c"), F.col("event_id").alias("e"), F.col("need").alias("end"), F.col("rank").alias("end_rank"), F.col("far").alias("on"))
        ways = first.join(second, is_of("need")).filter(F.col("rank") > F.col("end_rank")).groupBy(F.col("conv_id").alias("c"), F.col("event_id").alias("e"), "end").agg(F.max(F.col("to_via") + F.col("on")).alias("longer"))
        joined = counted.drop("n").join(ways, is_of("event_id") & (F.col("need") == F.col("end")), "left")
        return scratch.save(joined.filter(F.col("longer").isNull() | (F.col("longer") < F.col("far"))).drop("c", "e", "end", "longer"))

    state = gathered(start, edges)
    done: list[DataFrame] = []
    left = state.filter("open > 0").count()
    while left:
        fewer = lean(edges)
        scratch.drop(edges)
        counts = fewer.groupBy(F.col("conv_id").alias("c"), F.col("event_id").alias("e")).agg(F.count("*").alias("open"))
        needed = state.select(F.col("conv_id").alias("c"), F.col("event_id").alias("e"), "place", (F.col("open") > 0).alias("waits"))
        met = fewer.join(needed, is_of("need")).drop("c", "e").join(counts.withColumnRenamed("open", "own_open"), is_of("event_id")).drop("c", "e")
        met = met.join(counts, is_of("need"), "left").drop("c", "e")
        through = F.col("waits") & ((F.col("open") == 1) | (F.col("open") <= FEW) & (F.col("own_open") <= SEVERAL))
        # A settled need leaves its place, so what is read in a round is what waits and what has just settled.
        behind = met.select(
            F.col("conv_id").alias("c"), F.col("event_id").alias("e"), F.when(F.col("waits"), F.col("need")).alias("via"), F.when(F.col("waits"), F.col("rank")).alias("via_rank"), F.col("far").alias("via_far"),
            F.when(~F.col("waits"), raised(F.col("place"), F.col("far"))).alias("via_least"),
        )
        step = met.withColumn("through", F.coalesce(through, F.lit(False))).join(behind, is_of("need") & F.col("through"), "left").select(
            "conv_id",
            "event_id",
            F.when(F.col("through"), F.col("via")).when(F.col("waits"), F.col("need")).alias("need"),
            F.when(F.col("through"), F.col("via_rank")).when(F.col("waits"), F.col("rank")).alias("rank"),
            F.when(F.col("through"), F.least(F.col("far") + F.col("via_far"), F.lit(_TOP))).otherwise(F.col("far")).alias("far"),
            F.when(~F.col("waits"), raised(F.col("place"), F.col("far"))).when(F.col("through"), F.greatest(raised(F.col("place"), F.col("far")), F.when(F.col("via_least").isNotNull(), raised(F.col("via_least"), F.col("far"))))).alias("least"),
        )
        edges = scratch.save(step.groupBy("conv_id", "event_id", "need").agg(F.max("rank").alias("rank"), F.max("far").alias("far"), F.max("least").alias("least")))
        done.append(state.filter("open = 0"))
        after = gathered(state.filter("open > 0").select("conv_id", "event_id", "place"), edges)
        scratch.drop(fewer)
        before, left, state = left, after.filter("open > 0").count(), after
        if left == before:
            break
    scratch.drop(edges)
    found = reduce(DataFrame.unionByName, done, state).select(F.col("conv_id").alias("c"), F.col("event_id").alias("e"), "place", "open")
    is_cyclic = F.coalesce(F.col("open") > 0, F.lit(False))
    is_placed = F.col("place").isNotNull() & ~is_cyclic
    return order.join(found, is_of("event_id"), "left").select(
        "conv_id", "event_id", "call", "result", "call_needs", F.when(is_placed, F.col("place.turn")).otherwise(F.col("anchor")).alias("anchor"), F.when(is_placed, F.col("place.level")).otherwise(F.col("level").cast("long")).alias("level"), is_cyclic.alias("cyclic")
    )
