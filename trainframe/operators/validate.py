"""Schemas of samples: declared fields become an array of errors of each row, without Python on the executors."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"str": T.StringType, "int": T.IntegralType | T.BooleanType, "float": T.NumericType, "bool": T.BooleanType, "list": T.ArrayType, "dict": T.StructType | T.MapType, "any": T.DataType}
ERROR = "struct<path:string,message:string>"


@dataclass(frozen=True)
class Field:
    """What a value must be. Null is fine unless ``required``; ``nullable`` makes it fine even then."""

    type: str = "any"
    required: bool = True
    nullable: bool = False
    min: float | None = None
    max: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    choices: tuple | None = None
    pattern: str | None = None
    custom: Callable[[Column], Column] | None = None

    def errors(self, c: Column, t: T.DataType | None, path: Column) -> list[Column]:
        """Error structs, null where the value passes."""

        def error(test: Column, message: str) -> Column:
            return F.when(F.coalesce(test, F.lit(False)), F.struct(path.alias("path"), F.lit(message).alias("message")))

        out = []
        if self.required and not self.nullable:
            out.append(error(c.isNull(), "a value is required"))
        if t is None:
            return out
        if not isinstance(t, KINDS[self.type]):
            return [*out, error(c.isNotNull(), f"is not of type {self.type}")]
        if isinstance(t, T.NumericType):
            if self.min is not None:
                out.append(error(c < self.min, f"is under {self.min}"))
            if self.max is not None:
                out.append(error(c > self.max, f"is over {self.max}"))
        if isinstance(t, T.StringType | T.ArrayType):
            size = F.length(c) if isinstance(t, T.StringType) else F.size(c)
            if self.min_length is not None:
                out.append(error(c.isNotNull() & (size < self.min_length), f"is shorter than {self.min_length}"))
            if self.max_length is not None:
                out.append(error(c.isNotNull() & (size > self.max_length), f"is longer than {self.max_length}"))
        if self.choices is not None:
            out.append(error(~c.isin(*self.choices), f"is none of {', '.join(map(str, self.choices))}"))
        if self.pattern is not None and isinstance(t, T.StringType):
            out.append(error(~c.rlike(f"(?U)^(?:{self.pattern})"), f"does not match {self.pattern}"))
        if self.custom is not None:
            out.append(error(c.isNotNull() & ~self.custom(c), "fails its own test"))
        return out


class Schema:
    """Fields by path; ``a[*].b`` is checked in each item, errors name the item: ``a[3].b``."""

    def __init__(self, fields: dict[str, Field], extra: Callable[[T.StructType], Column] | None = None):
        self.fields, self.extra = fields, extra

    def errors(self, schema: T.StructType) -> Column:
        """An array of ``ERROR`` for rows of ``schema``."""
        none = F.array().cast(f"array<{ERROR}>")
        out = [none]
        for path, field in self.fields.items():
            head, star, rest = path.partition("[*]")
            c, t = _get(schema, head)
            if not star:
                out += [F.array(e) for e in field.errors(c, t, F.lit(path))]
            elif isinstance(t, T.ArrayType):
                found = F.transform(c, _item_errors(head, rest, field, t.elementType))
                out.append(F.coalesce(F.flatten(found), none))
            elif t is not None:
                out.append(F.array(F.when(c.isNotNull(), F.struct(F.lit(head).alias("path"), F.lit("is not a list").alias("message")))))
        if self.extra:
            out.append(self.extra(schema))
        return F.array_compact(F.concat(*(a.cast(f"array<{ERROR}>") for a in out)))


def _item_errors(head: str, rest: str, field: Field, item: T.DataType) -> Callable[[Column, Column], Column]:
    """A function of a list's item and its position: the errors of what is at ``rest`` in it."""

    def errors(e: Column, i: Column) -> Column:
        v, vt = _below(e, item, rest.lstrip("."))
        where = F.concat(F.lit(head + "["), i.cast("string"), F.lit("]" + rest))
        found = field.errors(v, vt, where)
        return F.array(*found) if found else F.array().cast(f"array<{ERROR}>")

    return errors


def _below(c: Column, t: T.DataType, path: str) -> tuple[Column, T.DataType | None]:
    for name in path.split(".") if path else []:
        if not isinstance(t, T.StructType) or name not in t.names:
            return F.lit(None).cast("string"), None
        c, t = c.getField(name), t[name].dataType
    return c, t


def _get(schema: T.StructType, path: str) -> tuple[Column, T.DataType | None]:
    name, _, rest = path.partition(".")
    if name not in schema.names:
        return F.lit(None).cast("string"), None
    return _below(F.col(f"`{name}`"), schema[name].dataType, rest)


def with_errors(df: DataFrame, schema: Schema, name: str = "_errors") -> DataFrame:
    return df.withColumn(name, schema.errors(df.schema))


def valid_rows(df: DataFrame, schema: Schema) -> DataFrame:
    return df.where(F.size(schema.errors(df.schema)) == 0)


def invalid_rows(df: DataFrame, schema: Schema, max_errors: int | None = None) -> DataFrame:
    bad = with_errors(df, schema).where(F.size("_errors") > 0)
    return bad.limit(max_errors) if max_errors else bad


def report(df: DataFrame, schema: Schema) -> DataFrame:
    """(total, valid, invalid, valid_ratio)."""
    ok = (F.size(schema.errors(df.schema)) == 0).cast("long")
    one = df.select(ok.alias("ok")).agg(F.count("*").alias("total"), F.coalesce(F.sum("ok"), F.lit(0)).alias("valid"))
    return one.select("total", "valid", (F.col("total") - F.col("valid")).alias("invalid"), (F.col("valid") / F.when(F.col("total") > 0, F.col("total"))).alias("valid_ratio"))


def error_counts(df: DataFrame, schema: Schema) -> DataFrame:
    """(path, message, n) with positions in lists taken out of the paths."""
    each = df.select(F.explode(schema.errors(df.schema)).alias("e"))
    return each.groupBy(F.regexp_replace("e.path", r"\[\d+\]", "[*]").alias("path"), F.col("e.message").alias("message")).agg(F.count("*").alias("n"))


def openai_chat_schema() -> Schema:
    roles = ("system", "user", "assistant", "tool")

    def extra(schema: T.StructType) -> Column:
        c, t = _get(schema, "messages")
        none = F.array().cast(f"array<{ERROR}>")
        if not isinstance(t, T.ArrayType) or not isinstance(t.elementType, T.StructType):
            return none
        names = t.elementType.names
        calls = (lambda m: F.coalesce(F.size(m.tool_calls), F.lit(0)) > 0) if "tool_calls" in names else (lambda m: F.lit(False))

        def check(m: Column, i: Column) -> Column:
            where = F.concat(F.lit("messages["), i.cast("string"), F.lit("]"))
            empty = m.content.isNull() if "content" in names else F.lit(True)
            out = [F.when(empty & ~calls(m), F.struct(where.alias("path"), F.lit("has neither content nor calls").alias("message")))]
            if "tool_call_id" in names:
                out.append(F.when((m.role == "tool") & m.tool_call_id.isNull(), F.struct(where.alias("path"), F.lit("a tool's message names its call").alias("message"))))
            return F.array(*out)

        return F.coalesce(F.flatten(F.transform(c, check)), none)

    return Schema({"messages": Field("list", min_length=1), "messages[*].role": Field("str", choices=roles)}, extra)


def alpaca_schema() -> Schema:
    return Schema({"instruction": Field("str", min_length=1), "input": Field("str", required=False), "output": Field("str", min_length=1)})


def dpo_schema() -> Schema:
    return Schema({k: Field("str", min_length=1) for k in ("prompt", "chosen", "rejected")})


def sharegpt_schema() -> Schema:
    return Schema({"conversations": Field("list", min_length=1), "conversations[*].from": Field("str", choices=("human", "gpt", "system", "tool", "function_call", "observation")), "conversations[*].value": Field("str")})
