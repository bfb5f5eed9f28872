"""Concatenation and difference of datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import path_value
from ..functions.values import ORDINAL


class FieldMismatch(ValueError):
    pass


def field_report(*frames: DataFrame) -> dict[str, list[str]]:
    names = [set(df.columns) for df in frames]
    return {"common": sorted(set.intersection(*names)), "partial": sorted(set.union(*names) - set.intersection(*names))}


def concat(*frames: DataFrame, strict: bool = False) -> DataFrame:
    """All rows of all frames; missing columns are null, columns of two types become text (JSON where nested).

    ``strict`` is an error where columns differ.
    """
    if strict and (odd := field_report(*frames)["partial"]):
        raise FieldMismatch(f"not in all inputs: {', '.join(odd)}")
    types: dict[str, set[str]] = {}
    for df in frames:
        for n, t in df.dtypes:
            types.setdefault(n, set()).add(t)

    def widened(df: DataFrame) -> DataFrame:
        cols = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            if len(types[f.name]) > 1:
                plain = types[f.name] <= {"int", "bigint", "smallint", "tinyint", "double", "float"}
                if not plain:
                    c = F.to_json(c) if isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType) else c.cast("string")
            cols.append(c.alias(f.name))
        return df.select(*cols)

    out = widened(frames[0])
    for df in frames[1:]:
        out = out.unionByName(widened(df), allowMissingColumns=True)
    return out


def _row(df: DataFrame) -> Column:
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns) if c != ORDINAL)), {"ignoreNullFields": "false"})


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(added, removed, unchanged): numbers of distinct rows of one side or both."""
    rows = old.select(_row(old).alias("r"), F.lit(1).alias("o"), F.lit(0).alias("n")).union(new.select(_row(new).alias("r"), F.lit(0).alias("o"), F.lit(1).alias("n")))
    each = rows.groupBy("r").agg(F.max("o").alias("o"), F.max("n").alias("n"))

    def count(test: Column, name: str) -> Column:
        return F.count(F.when(test, 1)).alias(name)

    o, n = F.col("o") == 1, F.col("n") == 1
    return each.agg(count(n & ~o, "added"), count(o & ~n, "removed"), count(o & n, "unchanged"))


def diff_rows(old: DataFrame, new: DataFrame, key: str, old_order: list[str], new_order: list[str]) -> DataFrame:
    """(key, status) by the last row of each key: added, removed, modified or unchanged; null keys do not count."""

    def last(df: DataFrame, order: list[str], name: str) -> DataFrame:
        v = path_value(df.schema, key)
        rows = df.select(v.c.alias("key"), _row(df).alias("r"), F.struct(*(F.col(f"`{c}`") for c in order)).alias("at")).where("key is not null")
        return rows.groupBy("key").agg(F.max_by("r", "at").alias(name))

    both = last(old, old_order, "o").join(last(new, new_order, "n"), "key", "full")
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") == F.col("n"), "unchanged").otherwise("modified")
    return both.select("key", status.alias("status"))


def field_changes(old: DataFrame, new: DataFrame) -> dict[str, list[str]]:
    a, b = set(old.columns), set(new.columns)
    return {"added": sorted(b - a), "removed": sorted(a - b), "common": sorted(a & b)}
