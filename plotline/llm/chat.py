"""Chat formatting: tool calls linked to results, ordered, validated, and written as canonical JSON.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, discard

_NO = "\u0001"


def _key(conv: Column, call: Column) -> Column:
    return F.when(call.isNotNull(), F.concat(F.coalesce(conv.cast("string"), F.lit(_NO)), F.lit(_NO), call))


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Why arguments break their tool's schema, or null.

    A schema maps each argument to its JSON type (``string``, ``integer``,
    ``number``, ``boolean``, ``object``, ``array``) and whether it must be there;
    other arguments are not allowed.
    """
    value = F.try_parse_json(arguments)
    kinds = {"string": "^STRING$", "integer": "^BIGINT$", "number": r"^(BIGINT|DOUBLE|DECIMAL\(.*)$",
             "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY"}
    out = F.when(name.isNull() | ~name.isin(*schemas), F.lit("unknown tool"))
    out = out.when(value.isNull() | ~F.schema_of_variant(value).startswith("OBJECT"), "not an object")
    for tool, fields in schemas.items():
        mine = name == tool
        keys = F.json_object_keys(arguments)
        extra = F.size(F.array_except(keys, F.array(*[F.lit(f) for f in fields]).cast("array<string>"))) > 0
        out = out.when(mine & extra, "unexpected argument")
        for field, (kind, required) in fields.items():
            # bracketed path: a name with dots is one name
            got = F.try_variant_get(value, f"$['{field}']", "variant")
            there = F.array_contains(keys, field)
            fits = F.coalesce(F.schema_of_variant(got).rlike(kinds[kind]), F.lit(False))
            if required:
                out = out.when(mine & ~there, f"missing {field}")
            out = out.when(mine & there & ~fits, f"bad {field}")
    return out


def call_levels(calls: DataFrame) -> DataFrame:
    """``(key, level)``: the number of calls a call waits for in turn, null inside or behind a cycle.

    ``calls`` has ``key`` (distinct) and ``after`` (the key of the call whose
    result it uses, or null; an unknown key counts as null).  Pointers double:
    each round a call takes over the pointer of the call it points at, so a chain of
    n calls takes about log2 n rounds.
    """
    known = calls.select(F.col("key").alias("k"))
    p = cut(calls.join(known, F.col("after") == F.col("k"), "left")
            .select("key", F.col("k").alias("ptr"), F.when(F.col("k").isNull(), 0).otherwise(1).cast("long").alias("level")))
    total = p.count()
    waiting, reach = p.where("ptr is not null").count(), 1
    while waiting and reach <= total:
        q = p.select(F.col("key").alias("k"), F.col("ptr").alias("next"), F.col("level").alias("more"))
        new = cut(p.join(q, F.col("ptr") == F.col("k"), "left").select(
            "key", F.col("next").alias("ptr"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
        discard(p)
        p, reach = new, reach * 2
        waiting = p.where("ptr is not null").count()
    return p.select("key", F.when(F.col("ptr").isNull(), F.col("level")).alias("level"))


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row per message: ``conv_id, turn, kind, call_id, step, status, json``.

    ``messages`` has ``conv_id, turn, kind`` ("call", "result", anything else is a
    plain message), ``role, content, call_id, name, arguments`` (JSON text) and
    ``after`` (the call_id whose result a call uses); other columns are not read.
    Calls and results are hash-joined by conversation and identifier.

    ``step`` puts a conversation in topological order: 0 for plain messages, then
    1 + 2 * level for a call and one more for its result, where ``level`` is the length
    of the chain of calls it waits for; null where that is circular or there is no
    call.  Equal steps are ordered by turn.  No conversation is ever
    gathered in one task: the order is in the rows.

    ``status`` of a call: ok, no id, duplicate (another row with the identifier
    comes first by turn, then text), cycle, invalid: <why>, no result.  Of a
    result: ok, no id, duplicate, orphan.  ``json`` is canonical: members sorted
    by name, no white space, nulls left out; arguments that are no JSON object stay a string.  Null
    conversations are one conversation.  An empty table gives an empty result.
    """
    m = messages.select("conv_id", "turn", "kind", "role", "content", "call_id", "name", "arguments",
                        _key(F.col("conv_id"), F.col("call_id")).alias("key"),
                        _key(F.col("conv_id"), F.col("after")).alias("after"))
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    # one row per identifier: the first by turn, then text
    order = F.struct("turn", F.coalesce("name", F.lit("")).alias("n"), F.coalesce("arguments", "content", F.lit("")).alias("x"))
    firsts = cut(m.where((is_call | is_result) & F.col("key").isNotNull()).groupBy("key", "kind").agg(
        F.min(order).alias("first"), F.min_by("after", order).alias("after"), F.count("*").alias("n")))
    calls = firsts.where(is_call).select("key", "after")
    levels = call_levels(calls)
    answered = firsts.where(is_result).select(F.col("key").alias("rkey"))
    facts = cut(levels.join(answered, F.col("key") == F.col("rkey"), "left").select(
        F.col("key").alias("ckey"), "level", F.col("rkey").isNotNull().alias("answered")))
    names = firsts.select(F.col("key").alias("fkey"), F.col("kind").alias("fkind"), "first")

    rows = m.join(facts, F.col("key") == F.col("ckey"), "left")
    rows = rows.join(names, (F.col("key") == F.col("fkey")) & (F.col("kind") == F.col("fkind")), "left")
    later = order != F.col("first")
    why = argument_errors(F.col("name"), F.col("arguments"), schemas)
    status = (F.when(~F.coalesce(is_call | is_result, F.lit(False)), "ok")
              .when(F.col("key").isNull(), "no id")
              .when(later, "duplicate")
              .when(is_result & F.col("ckey").isNull(), "orphan")
              .when(is_result, "ok")
              .when(F.col("level").isNull(), "cycle")
              .when(why.isNotNull(), F.concat(F.lit("invalid: "), why))
              .when(~F.col("answered"), "no result")
              .otherwise("ok"))
    step = (F.when(~F.coalesce(is_call | is_result, F.lit(False)), F.lit(0))
            .when(is_call, 1 + 2 * F.col("level")).otherwise(2 + 2 * F.col("level"))).cast("long")
    value = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    # a variant object keeps its members sorted by name, at every depth
    call = F.concat(F.lit('{"arguments":'),
                    F.when(is_object, F.to_json(value)).otherwise(_quoted(F.coalesce("arguments", F.lit("")))),
                    _member("call_id"), _member("name"), F.lit(',"role":"call"}'))
    result = F.to_json(F.struct("call_id", "content", F.lit("result").alias("role")))
    plain = F.to_json(F.struct("content", "role"))
    return rows.select("conv_id", "turn", "kind", "call_id", step.alias("step"), status.alias("status"),
                       F.when(is_call, call).when(is_result, result).otherwise(plain).alias("json"))


def _quoted(text: Column) -> Column:
    # the JSON string inside {"v":...}
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _member(col: str) -> Column:
    return F.when(F.col(col).isNotNull(), F.concat(F.lit(f',"{col}":'), _quoted(F.col(col)))).otherwise("")
