"""Columns with a static type and the condition under which Python would raise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What Python's str.strip takes off; Spark's trim takes spaces only unless it is told.
_WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

#: The hidden column of a row's place in its input, a text that sorts in that order.
ORDINAL = "_rid"


@dataclass
class Value:
    """``c`` of type ``t``; where ``err`` holds the value is undefined."""

    c: Column
    t: T.DataType
    err: Column | None = None


def any_of(*conditions: Column | None) -> Column | None:
    out = None
    for x in conditions:
        if x is not None:
            out = x if out is None else out | x
    return out


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType | T.BooleanType)


def number(v: Value) -> Column:
    return v.c.cast("int") if isinstance(v.t, T.BooleanType) else v.c


def truthy(c: Column, t: T.DataType) -> Column:
    """Python's bool(): null, zero, and empty texts and lists are false."""
    if isinstance(t, T.NullType):
        return F.lit(False)
    if isinstance(t, T.BooleanType):
        yes = c
    elif isinstance(t, T.NumericType):
        yes = c != 0
    elif isinstance(t, T.StringType | T.BinaryType):
        yes = F.length(c) > 0
    elif isinstance(t, T.ArrayType | T.MapType):
        yes = F.size(c) > 0
    else:
        yes = c.isNotNull()
    return F.coalesce(yes, F.lit(False))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_WHITE))


def is_empty(c: Column, t: T.DataType) -> Column:
    """Null, blank text, list or map without items; zero and false are values."""
    if isinstance(t, T.StringType):
        return F.coalesce(strip(c) == "", F.lit(True))
    if isinstance(t, T.ArrayType | T.MapType):
        return F.coalesce(F.size(c) == 0, F.lit(True))
    return c.isNull()


def length_of(c: Column, t: T.DataType) -> Column:
    """Characters of a text, items of a list, the value of a number; null counts 0."""
    if isinstance(t, T.StringType):
        n = F.length(c)
    elif isinstance(t, T.ArrayType | T.MapType):
        n = F.size(c)
    elif is_number(t):
        n = c.cast("long")
    else:
        n = F.length(F.to_json(c))
    return F.coalesce(n, F.lit(0))


def as_text(c: Column, t: T.DataType) -> Column:
    """Python's str() of a scalar, JSON of anything nested."""
    if isinstance(t, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(t, T.ArrayType | T.MapType | T.StructType):
        return F.to_json(c)
    return c.cast("string")
