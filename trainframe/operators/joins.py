"""Joins on computed keys: of rows on the right that share a key the first counts; null matches null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import value_of


def _key(df: DataFrame, expr: str) -> tuple[Column, Column]:
    """The key as something that can be compared, and whether it fails."""
    v = value_of(expr, df.schema)
    c = F.to_json(v.c) if isinstance(v.t, T.ArrayType | T.StructType | T.MapType) else v.c
    return c, F.lit(False) if v.err is None else F.coalesce(v.err, F.lit(False))


def first_rows(df: DataFrame, key: Column | list[Column], order: list[str]) -> DataFrame:
    """The first row of each key, by an aggregate that combines before the shuffle: no key's rows meet in one task."""
    keys = key if isinstance(key, list) else [key]
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select("*", *(k.alias(n) for k, n in zip(keys, names, strict=True)))
    if any(isinstance(df.schema[c].dataType, T.MapType) for c in df.columns):
        window = Window.partitionBy(*names).orderBy(*(F.col(f"`{c}`") for c in order))
        return keyed.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    at = F.struct(*(F.col(f"`{c}`") for c in order))
    return keyed.groupBy(*names).agg(F.min_by(row, at).alias("_row")).select(*names, "_row.*")


def duplicates(right: DataFrame, on: str) -> DataFrame:
    """(ignored): rows on the right that share an earlier row's key."""
    key, _ = _key(right, on)
    keyed = right.groupBy(key.alias("k")).count()
    return keyed.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("ignored"))


def join_rows(left: DataFrame, right: DataFrame, on: str | None = None, left_on: str | None = None, right_on: str | None = None, how: str = "left", prefix: str = "", order: list[str] | None = None) -> DataFrame:
    """``left`` with the columns of the first row of ``right`` that has the same key.

    how: left, inner or anti (the rows without a match). A key that fails on the left matches nothing. Columns that
    left has stay its own; ``prefix`` goes before all columns of right. ``order`` says which right row is first.
    """
    if bool(on) == bool(left_on or right_on) or bool(left_on) != bool(right_on):
        raise ValueError("a join is on one key, or on one of each side")
    if how not in ("left", "inner", "anti"):
        raise ValueError(f"how is left, inner or anti, not {how!r}")
    lk, lerr = _key(left, left_on or on)
    rk, rerr = _key(right, right_on or on)
    rk = F.when(rerr, F.raise_error(F.lit("the key fails on a row on the right"))).otherwise(rk)
    if how == "anti":
        keys = right.select(rk.alias("_k0")).distinct()
        return left.select("*", lk.alias("_lk"), lerr.alias("_lerr")).join(keys, F.col("_lk").eqNullSafe(F.col("_k0")) & ~F.col("_lerr"), "left_anti").drop("_lk", "_lerr")
    once = first_rows(right, rk, order or right.columns)
    new = [c for c in right.columns if prefix or c not in left.columns]
    once = once.select("_k0", *(F.col(f"`{c}`").alias(prefix + c) for c in new))
    keyed = left.select("*", lk.alias("_lk"), lerr.alias("_lerr"))
    joined = keyed.join(once, F.col("_lk").eqNullSafe(F.col("_k0")) & ~F.col("_lerr"), how)
    return joined.drop("_lk", "_lerr", "_k0")


def merge_positions(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Row k of ``left`` with the columns it lacks of row k of ``right``; both have as many rows, or it is an error."""
    from .order import ranked_rows

    if (a := left.count()) != (b := right.count()):
        raise ValueError(f"{a} rows on the left and {b} on the right")
    x = ranked_rows(left, [F.col(f"`{c}`") for c in left_order], "_at")
    y = ranked_rows(right, [F.col(f"`{c}`") for c in right_order], "_at")
    return x.join(y.select("_at", *(F.col(f"`{c}`") for c in right.columns if c not in left.columns)), "_at").drop("_at")
