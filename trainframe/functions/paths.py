"""Field paths: ``a.b``, ``a[0]``, ``a[-1]``, ``a.#`` (size), ``a[*].b`` with ``:first``, ``:join`` or ``:unique``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import Value, as_text

_STEP = re.compile(r"\.?(?:(?P<name>[^\W\d][\w-]*)|(?P<size>#)|\[(?P<index>-?\d+|\*)\])")


class PathError(ValueError):
    pass


def parse_path(path: str) -> tuple[list[str | int], str]:
    """Steps (names, positions, ``#`` and ``*``) and how several values become one."""
    body, _, how = path.partition(":")
    if how not in ("", "first", "join", "unique"):
        raise PathError(f"{path!r}: after a colon comes first, join or unique")
    if body.startswith("x.") or body.startswith("x["):
        raise PathError(f"{path!r} is an expression; as a field path write {body[2:]!r}")
    steps: list[str | int] = []
    at = 0
    while at < len(body):
        m = _STEP.match(body, at)
        if not m or (body[at] != "." and m["name"] and at):
            raise PathError(f"{path!r}: nothing that can follow at {body[at:]!r}")
        steps.append(m["name"] or m["size"] or (m["index"] if m["index"] == "*" else int(m["index"])))
        at = m.end()
    if not steps:
        raise PathError("an empty field path")
    return steps, how


def _step(v: Value, step: str | int) -> Value | None:
    if step == "#":
        if isinstance(v.t, T.ArrayType | T.MapType):
            return Value(F.when(v.c.isNotNull(), F.size(v.c)), T.IntegerType())
        return Value(F.length(v.c), T.IntegerType()) if isinstance(v.t, T.StringType) else None
    if isinstance(step, int):
        at = step + 1 if step >= 0 else step
        return Value(F.try_element_at(v.c, F.lit(at)), v.t.elementType) if isinstance(v.t, T.ArrayType) else None
    if isinstance(v.t, T.StructType):
        return Value(v.c.getField(step), v.t[step].dataType) if step in v.t.names else None
    return Value(F.try_element_at(v.c, F.lit(step)), v.t.valueType) if isinstance(v.t, T.MapType) else None


def _walk(v: Value | None, steps: list[str | int]) -> Value | None:
    for k, step in enumerate(steps):
        if v is None:
            return None
        if step == "*":
            if not isinstance(v.t, T.ArrayType):
                return None
            inner, rest = v.t.elementType, steps[k + 1 :]
            if "*" in rest:  # within a list only the first of inner values counts
                rest = [0 if s == "*" else s for s in rest]
            probe = _walk(Value(F.lit(None), inner), rest)
            if probe is None:
                return None
            found = F.filter(F.transform(v.c, lambda e: _walk(Value(e, inner), rest).c), lambda e: e.isNotNull())
            return Value(found, T.ArrayType(probe.t))
        v = _step(v, step)
    return v


def path_value(schema: T.StructType, path: str, root: Column | None = None) -> Value:
    """The value of ``path`` in rows of ``schema``; null where anything on the way is missing."""
    steps, how = parse_path(path)
    name = steps[0]
    if not isinstance(name, str) or name not in schema.names:
        return Value(F.lit(None).cast("string"), T.StringType())
    start = Value(F.col(f"`{name}`") if root is None else root.getField(name), schema[name].dataType)
    v = _walk(start, steps[1:])
    if v is None:
        return Value(F.lit(None).cast("string"), T.StringType())
    if "*" in steps:
        item = v.t.elementType
        if how in ("", "first"):
            return Value(F.try_element_at(v.c, F.lit(1)), item) if how else v
        texts = F.transform(v.c, lambda e: as_text(e, item))
        if how == "unique":
            texts = F.array_sort(F.array_distinct(texts))
        return Value(F.array_join(texts, "|"), T.StringType())
    return v


def path_column(df: DataFrame, path: str) -> Column:
    return path_value(df.schema, path).c
