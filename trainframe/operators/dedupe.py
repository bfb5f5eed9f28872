"""Exact and near duplicates: of rows that are alike the first stays."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import path_value
from ..sources.shared import written
from .joins import first_rows
from .similar import similar

#: Up to so many open pairs of near-duplicates are settled in order on the driver; more are settled in rounds.
AT_ONCE = 200_000


def _comparable(c: Column, t: T.DataType) -> Column:
    return F.to_json(c) if isinstance(t, T.ArrayType | T.StructType | T.MapType) else c


def dedupe(df: DataFrame, key: str | list[str] | None, order: list[str]) -> DataFrame:
    """The first row by ``order`` of each key: paths, or all columns but the order's without one. Null is a value."""
    if key is None:
        keys = [_comparable(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if f.name not in order] or [F.col(f"`{c}`") for c in order]
    else:
        vs = [path_value(df.schema, p) for p in ([key] if isinstance(key, str) else key)]
        keys = [_comparable(v.c, v.t) for v in vs]
    return first_rows(df, keys, order).select(*(F.col(f"`{c}`") for c in df.columns))


def duplicate_groups(df: DataFrame, key: str) -> DataFrame:
    """(value, n): keys that occur more than once."""
    v = path_value(df.schema, key)
    return df.groupBy(_comparable(v.c, v.t).alias("value")).agg(F.count("*").alias("n")).where("n > 1")


def _linked(df: DataFrame, key: str, id_col: str, threshold: float, ngram: int) -> tuple[DataFrame, DataFrame]:
    """(id) of the first rows of distinct texts, and (a, b, similarity), a < b, of those that are similar."""
    v = path_value(df.schema, key)
    return similar(df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(v.c.cast("string"), F.lit("")).alias("text")), threshold, ngram)


def similar_pairs(df: DataFrame, key: str, id_col: str, threshold: float = 0.8, num_perm: int = 128, ngram: int = 3) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of rows whose texts' n-gram sets have a Jaccard similarity of the threshold or more.

    Equal texts are one text: pairs are between the first rows of distinct texts. No pair depends on min-hashes any more;
    ``num_perm`` is still taken, for callers that name it, and changes nothing.
    """
    return _linked(df, key, id_col, threshold, ngram)[1]


def _cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that its lineage ends there."""
    return written(df, "similar")


def _dropped(pairs: DataFrame) -> DataFrame:
    """(id): of few ``pairs`` (a, b), a < b, each b with an a that does not drop out itself."""
    found, out = pairs.orderBy("b").toArrow(), set()
    for a, b in zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True):
        if a not in out:  # all pairs that could drop a came before
            out.add(b)
    return pairs.sparkSession.createDataFrame(pa.table({"id": pa.array(list(out), found["b"].type)}), pairs.select(F.col("b").alias("id")).schema)


def dedupe_similar(df: DataFrame, key: str, id_col: str, threshold: float = 0.8, num_perm: int = 128, ngram: int = 3, at_once: int = AT_ONCE) -> DataFrame:
    """Rows that stay when each row in order of ``id_col`` drops out if an earlier row that stays is similar.

    Equal texts keep their first row. Then rounds until no pair is open: a row all of whose earlier neighbours are out
    stays, and its later neighbours drop out; every round settles at least the first open row of each chain. Once at most
    ``at_once`` pairs are open they are settled together, so that a long chain is not a round for two of its rows.
    """
    threshold = min(threshold, 0.99)
    firsts, pairs = _linked(df, key, id_col, threshold, ngram)
    open_ = _cut(pairs.select("a", "b"))
    gone = None
    while not open_.isEmpty():
        last = open_.limit(at_once + 1).count() <= at_once
        if last:
            out = _dropped(open_)
        else:
            kept = open_.select(F.col("a").alias("id")).distinct().join(open_.select(F.col("b").alias("id")), "id", "left_anti")
            out = _cut(open_.join(kept, open_.a == kept.id, "left_semi").select(F.col("b").alias("id")).distinct())
        gone = out if gone is None else gone.union(out)
        if last:
            break
        open_ = open_.join(out, open_.a == out.id, "left_anti").join(out, F.col("b") == out.id, "left_anti")
        open_ = _cut(open_.join(kept, open_.a == kept.id, "left_anti"))
    stay = firsts if gone is None else firsts.join(gone, "id", "left_anti")
    return df.join(stay.select(F.col("id").alias("_stay")), F.col(f"`{id_col}`") == F.col("_stay"), "left_semi")
