"""Functions of a whole row: turns, roles, texts and calls of a conversation, full text and search."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import ORDINAL, as_text

TURN = "struct<role:string,content:string,reasoning:string,calls:array<struct<name:string,arguments:string>>,call_id:string>"
_SHORT = {"system": "sys", "user": "u", "human": "u", "assistant": "a", "gpt": "a", "tool": "t", "observation": "t", "function_call": "a"}


def _field(c: Column, t: T.DataType, *names: str) -> tuple[Column, T.DataType] | None:
    for n in names:
        if isinstance(t, T.StructType) and n in t.names:
            return c.getField(n), t[n].dataType
    return None


def _content(c: Column, t: T.DataType) -> Column:
    """Text of a message: null is empty; the parts of a list are joined by spaces, images as a placeholder."""
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
        kinds = t.elementType.names

        def part(p: Column) -> Column:
            text = p.getField("text") if "text" in kinds else F.lit("")
            return F.when(p.getField("type").contains("image"), "<image>").otherwise(F.coalesce(text, F.lit(""))) if "type" in kinds else F.coalesce(text, F.lit(""))

        return F.coalesce(F.array_join(F.filter(F.transform(c, part), lambda x: x != ""), " "), F.lit(""))
    return F.coalesce(as_text(c, t), F.lit(""))


def _calls(e: Column, t: T.StructType) -> Column:
    none = F.array().cast("array<struct<name:string,arguments:string>>")
    if got := _field(e, t, "tool_calls"):
        c, ct = got
        if isinstance(ct, T.ArrayType) and (fn := _field(F.lit(None), ct.elementType, "function")):
            names = fn[1].names

            def call(k: Column) -> Column:
                f = k.getField("function")
                args = as_text(f.getField("arguments"), fn[1]["arguments"].dataType) if "arguments" in names else F.lit("")
                return F.struct(F.coalesce(f.getField("name"), F.lit("?")).alias("name"), F.coalesce(args, F.lit("")).alias("arguments"))

            return F.coalesce(F.transform(c, call), none)
    if got := _field(e, t, "function_call"):
        c, ct = got
        if isinstance(ct, T.StructType) and "name" in ct.names:
            args = F.coalesce(as_text(c.getField("arguments"), ct["arguments"].dataType), F.lit("")) if "arguments" in ct.names else F.lit("")
            one = F.array(F.struct(c.getField("name").alias("name"), args.alias("arguments")))
            return F.when(c.isNotNull(), one).otherwise(none)
    return none


def _turns_of(schema: T.StructType, name: str, role: str, text: str) -> Column | None:
    """The turns in the list ``name`` whose items hold ``role`` and ``text``; None if there is no such list."""
    if name not in schema.names or not isinstance(schema[name].dataType, T.ArrayType):
        return None
    t = schema[name].dataType.elementType
    if not isinstance(t, T.StructType) or role not in t.names:
        return None

    def turn(e: Column) -> Column:
        body = _content(*_field(e, t, text)) if text in t.names else F.lit("")
        why = _field(e, t, "reasoning_content", "reasoning")
        who = F.coalesce(e.getField(role), F.lit(""))
        calls = _calls(e, t)
        if role == "from":
            called = F.coalesce(F.get_json_object(body, "$.name"), F.lit("?"))
            args = F.coalesce(F.get_json_object(body, "$.arguments"), F.lit(""))
            calls = F.when(who == "function_call", F.array(F.struct(called.alias("name"), args.alias("arguments")))).otherwise(calls)
            body = F.when(who == "function_call", "").otherwise(body)
        call_id = _field(e, t, "tool_call_id")
        return F.struct(who.alias("role"), body.alias("content"), F.coalesce(why[0].cast("string") if why else F.lit(""), F.lit("")).alias("reasoning"), calls.alias("calls"), (call_id[0] if call_id else F.lit(None).cast("string")).alias("call_id"))

    return F.when(F.col(name).isNotNull(), F.transform(F.col(name), turn))


def turns_array(schema: T.StructType) -> Column | None:
    """The row's turns as an array of ``TURN``; None if rows of this schema hold no conversation."""
    options = [_turns_of(schema, *names) for names in (("messages", "role", "content"), ("conversations", "from", "value"))]
    options = [c for c in options if c is not None]
    return F.coalesce(*options) if options else None


def _or(schema: T.StructType, f, default) -> Column:
    said = turns_array(schema)
    return F.lit(default) if said is None else F.coalesce(f(said), F.lit(default))


def turns(schema: T.StructType) -> Column:
    return _or(schema, F.size, 0).cast("int")


def roles(schema: T.StructType) -> Column:
    """``sys→u→a``: short names, unknown ones cut to 3 letters; of more than 5 turns the first 4 and an ellipsis."""
    table = F.create_map(*(F.lit(x) for kv in _SHORT.items() for x in kv))

    def text(said: Column) -> Column:
        short = F.transform(said, lambda m: F.coalesce(F.try_element_at(table, m.role), F.substring(m.role, 1, 3)))
        return F.when(F.size(said) > 5, F.concat(F.array_join(F.slice(short, 1, 4), "→"), F.lit("→…"))).otherwise(F.array_join(short, "→"))

    return _or(schema, text, "")


def first_user(schema: T.StructType) -> Column:
    return _or(schema, lambda m: F.try_element_at(F.filter(m, lambda t: t.role.isin("user", "human")), F.lit(1)).content, "")


def chars(schema: T.StructType) -> Column:
    """Characters of contents, reasoning, and names and arguments of calls."""

    def one(t: Column) -> Column:
        calls = F.aggregate(t.calls, F.lit(0), lambda n, k: n + F.length(k["name"]) + F.length(k.arguments))
        return F.length(t.content) + F.length(t.reasoning) + calls

    return _or(schema, lambda m: F.aggregate(m, F.lit(0), lambda n, t: n + one(t)), 0)


def calls(schema: T.StructType) -> Column:
    """Distinct names of called functions in order of first use."""
    return _or(schema, lambda m: F.array_join(F.array_distinct(F.flatten(F.transform(m, lambda t: F.transform(t.calls, lambda k: k["name"])))), ","), "")


def imgs(schema: T.StructType) -> Column:
    """Images of a row: placeholders in its texts, or its list of images where that is longer."""
    inline = _or(schema, lambda m: F.aggregate(m, F.lit(0), lambda n, t: n + F.size(F.split(t.content, "<image>")) - 1), 0)
    if "images" in schema.names and isinstance(schema["images"].dataType, T.ArrayType):
        return F.greatest(inline, F.coalesce(F.size("images"), F.lit(0)))
    return inline


def image_mismatch(schema: T.StructType) -> Column:
    """Whether the row lists images, but not as many as its texts have placeholders."""
    inline = _or(schema, lambda m: F.aggregate(m, F.lit(0), lambda n, t: n + F.size(F.split(t.content, "<image>")) - 1), 0)
    listed = F.coalesce(F.size("images"), F.lit(0)) if "images" in schema.names else F.lit(0)
    return (listed > 0) & (inline != listed)


def _texts(c: Column, t: T.DataType) -> Column:
    """All scalars below ``c`` as an array of texts."""
    if isinstance(t, T.StructType):
        parts = [_texts(c.getField(f.name), f.dataType) for f in t.fields]
        return F.coalesce(F.concat(*parts), F.array().cast("array<string>")) if parts else F.array().cast("array<string>")
    if isinstance(t, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(c, lambda e: _texts(e, t.elementType))), F.array().cast("array<string>"))
    if isinstance(t, T.MapType):
        return _texts(F.map_values(c), T.ArrayType(t.valueType))
    return F.when(c.isNotNull(), F.array(as_text(c, t))).otherwise(F.array().cast("array<string>"))


def fulltext(schema: T.StructType) -> Column:
    """All values of the row without their names, a line each."""
    return F.array_join(F.concat(*(_texts(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields if f.name != ORDINAL)), "\n")


def search(schema: T.StructType, pattern: str) -> Column:
    """Whether the row's text holds ``pattern``, whatever the case; ``re:`` begins a regular expression."""
    if pattern.startswith("re:"):
        re.compile(pattern[3:])
        return fulltext(schema).rlike("(?iuU)" + pattern[3:])
    return F.contains(F.lower(fulltext(schema)), F.lit(pattern.lower()))


def derived(schema: T.StructType) -> dict[str, Column]:
    """Columns that a browser shows beside the layout's own."""
    names = set(schema.names)
    if {"prompt", "chosen", "rejected"} <= names:
        return {"chosen_chars": F.length("chosen"), "rejected_chars": F.length("rejected")}
    if {"instruction", "output"} <= names:
        return {"has_input": truthy_text("input") if "input" in names else F.lit(False), "out_chars": F.length("output")}
    if turns_array(schema) is not None:
        return {"turns": turns(schema), "roles": roles(schema), "chars": chars(schema)}
    return {}


def truthy_text(name: str) -> Column:
    return F.coalesce(F.length(F.col(name)) > 0, F.lit(False))
