"""Sorting, limits, samples and splits. Input order is that of the ``order`` columns, which identify a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import value_of
from ..functions.paths import path_value
from ..functions.values import ORDINAL
from ..sources.shared import written


def _cols(order: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in order]


def _sort_keys(df: DataFrame, by: str) -> tuple[Column, list[Column]]:
    """Whether a row's keys fail, which puts it last, and the keys."""
    import ast

    tree = ast.parse(by.strip(), mode="eval").body
    keys = [ast.unparse(e) for e in tree.elts] if isinstance(tree, ast.Tuple) else [by]
    bad, cols = F.lit(False), []
    for k in keys:
        v = value_of(k, df.schema)
        bad = bad | v.c.isNull() | (F.lit(False) if v.err is None else F.coalesce(v.err, F.lit(False)))
        cols.append(v.c)
    return bad, cols


def sort_rows(df: DataFrame, by: str, order: list[str], desc: bool = False) -> DataFrame:
    """Stable sort by an expression, several by a tuple ``(a, b)``; rows for which it fails come last either way."""
    bad, keys = _sort_keys(df, by)
    return df.orderBy(bad.asc(), *(c.desc() if desc else c.asc() for c in keys), *_cols(order))


def sort_ranks(df: DataFrame, by: str, order: list[str], desc: bool = False, name: str = ORDINAL) -> DataFrame:
    """``df`` with each row's place in that order as a text that sorts so."""
    bad, keys = _sort_keys(df, by)
    ranked = ranked_rows(df, [bad, *keys, *_cols(order)], "_rank", [False, *[desc] * len(keys), *[False] * len(order)])
    return ranked.withColumn(name, F.lpad(F.col("_rank").cast("string"), 20, "0")).drop("_rank")


def browse_sort(df: DataFrame, column: str, order: list[str], desc: bool = False) -> DataFrame:
    """Numbers before texts: by the value as a number where it is one, then by the text."""
    text = F.col(f"`{column}`").cast("string")
    number = text.try_cast("double")
    return df.orderBy(number.isNull(), *((c.desc() if desc else c.asc()) for c in (number, text)), *_cols(order))


def _keys(df: DataFrame, order: list[str]) -> list[Column]:
    """The order columns, structs as their fields, so that each can be compared with a literal."""

    def fields(c: Column, t: T.DataType) -> list[Column]:
        return [x for f in t.fields for x in fields(c.getField(f.name), f.dataType)] if isinstance(t, T.StructType) else [c]

    return [x for o in order for x in fields(F.col(f"`{o}`"), df.schema[o].dataType)]


def _before(keys: list[Column], at: tuple) -> Column:
    """Whether a row's keys come before those of row ``at``, nulls first."""
    out = F.lit(False)
    for c, v in reversed(list(zip(keys, at, strict=True))):
        less = F.lit(False) if v is None else (c < F.lit(v)) | c.isNull()
        out = less | (c.eqNullSafe(F.lit(v)) & out)
    return out


def _narrow(df: DataFrame, keys: list[Column]) -> tuple[DataFrame, list[Column]]:
    names = [f"_k{i}" for i in range(len(keys))]
    return df.select(*(k.alias(n) for k, n in zip(keys, names, strict=True))), [F.col(n) for n in names]


#: Up to so many rows of the same high hash bits are sorted to find one among them.
FEW = 100_000


def _hashed_row(df: DataFrame, place: int) -> tuple:
    """The keys of row ``place`` by keys of which the first is a hash: counts by ever more of its bits, then a small sort."""
    first, *more = (F.col(c) for c in df.columns)
    shift, prefix = 48, None
    while True:
        high = F.shiftright(first, shift)
        some = df if prefix is None else df.where(F.shiftright(first, shift + 16) == prefix)
        counts = sorted((r.b, r["count"]) for r in some.groupBy(high.alias("b")).count().collect())
        for b, n in counts:
            if place < n:
                break
            place -= n
        prefix = b
        if n <= FEW or shift == 0:
            break
        shift -= 16
    ranked = df.where(F.shiftright(first, shift) == prefix).orderBy(first, *more)
    return tuple(ranked.limit(place + 1).orderBy(*(c.desc() for c in (first, *more))).first())


def rows_at(df: DataFrame, keys: list[Column], places: list[int], hashed: bool = False) -> dict[int, tuple] | None:
    """The keys of the rows at ``places`` in the order of ``keys``; None if one shares its keys with another row.

    Only keys are ranked, so whatever is cut at such a row is a filter that needs no shuffle of whole rows. ``hashed``: the
    first key is an evenly spread hash.
    """
    narrow, cols = _narrow(df, keys)
    if hashed:
        found = {p: _hashed_row(narrow, p) for p in places}
    else:
        ranked = ranked_rows(narrow, cols, "_rank").where(F.col("_rank").isin(places))
        found = {r["_rank"]: tuple(r[c] for c in narrow.columns) for r in ranked.collect()}

    def same(at: tuple) -> Column:
        out = F.lit(True)
        for c, v in zip(cols, at, strict=True):
            out = out & c.eqNullSafe(F.lit(v))
        return out

    if not found:
        return found
    copies = narrow.agg(*(F.count_if(same(at)).alias(str(p)) for p, at in found.items())).first()
    return found if all(copies[str(p)] == 1 for p in found) else None


def _between(df: DataFrame, start: int, end: int | None, order: list[str]) -> DataFrame:
    """Rows [start, end) in order, by filters on their keys."""
    keys, n = _keys(df, order), df.count()
    start, end = min(max(0, start), n), n if end is None else min(end, n)
    if start >= end:
        return df.limit(0)
    places = [p for p in (start, end) if 0 < p < n]
    found = rows_at(df, keys, places) if places else {}
    if found is None:
        ranked = ranked_rows(df, _cols(order), "_rank")
        return ranked.where((F.col("_rank") >= start) & (F.col("_rank") < end)).orderBy("_rank").drop("_rank")
    if start in found:
        df = df.where(~_before(keys, found[start]))
    if end in found:
        df = df.where(_before(keys, found[end]))
    return df.orderBy(*_cols(order))


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*_cols(order)).limit(n)


def tail(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*(c.desc() for c in _cols(order))).limit(n).orderBy(*_cols(order))


def skip(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return _between(df, n, None, order) if n > 0 else df.orderBy(*_cols(order))


def slice_rows(df: DataFrame, start: int | None, end: int | None, order: list[str]) -> DataFrame:
    """Rows [start, end) as Python slices do; negative bounds count from the end."""
    n = df.count() if (start or 0) < 0 or (end or 0) < 0 else None
    a = max(0, n + start) if (start or 0) < 0 else start or 0
    b = max(0, n + end) if end is not None and end < 0 else end
    return _between(df, a, b, order)


def _mix(seed: int, order: list[str]) -> Column:
    return F.xxhash64(F.lit(seed), *_cols(order))


def shuffle(df: DataFrame, order: list[str], seed: int = 42) -> DataFrame:
    return df.orderBy(_mix(seed, order), *_cols(order))


def sample(df: DataFrame, n: int, order: list[str], seed: int = 42, how: str = "random") -> DataFrame:
    """Exactly ``n`` rows (0: all; a negative number: so many), random by seed, or the first or last.

    Few rows are a top-k by a seeded hash; more are those before the row at place ``n`` by it, which is a filter.
    """
    n = abs(n)
    if not n:
        return df
    if how in ("head", "tail"):
        return (head if how == "head" else tail)(df, n, order)
    keys = [_mix(seed, order), *_keys(df, order)]
    if n > FEW:
        if n >= df.count():
            return df
        if (found := rows_at(df, keys, [n], hashed=True)) is not None:
            return df.where(_before(keys, found[n]))
    return df.orderBy(_mix(seed, order), *_cols(order)).limit(n)


def quotas(counts: dict, n: int, uniform: bool = False, shares: dict | None = None) -> dict:
    """Rows to take of each group. counts is in first-seen order.

    Proportional: by size, the largest first, each at least 1, the last gets what remains. Uniform: equal, what remains
    to the largest. shares: as given, the last listed gets what remains, others none. No group gives more than it has.
    """
    if shares:
        listed = [g for g in shares if g in counts]
        want, left = {}, n
        for k, g in enumerate(listed):
            want[g] = left if k == len(listed) - 1 else int(n * shares[g])
            left -= want[g]
    elif uniform:
        want = dict.fromkeys(counts, n // len(counts))
        for g in sorted(counts, key=lambda g: -counts[g])[: n % len(counts)]:
            want[g] += 1
    else:
        ranked, total, want, left = sorted(counts, key=lambda g: -counts[g]), sum(counts.values()), {}, n
        for k, g in enumerate(ranked):
            want[g] = left if k == len(ranked) - 1 else max(1, int(n * counts[g] / total))
            left -= want[g]
    return {g: min(k, counts[g]) for g, k in want.items() if k > 0}


#: Shares in which each group is ranked at first.
SALTS = 64


def stratified_sample(df: DataFrame, by: str, n: int, order: list[str], uniform: bool = False, shares: dict | None = None, how: str = "random", seed: int = 42) -> DataFrame:
    """``n`` rows spread over the groups of path ``by`` (missing is a group ``__null__``): see ``quotas``.

    Groups are ranked by size, then by name. A group's rows are ranked in ``SALTS`` shares first, of which each keeps no
    more than the group's quota, so no group meets in one task before it is cut to that.
    """
    v = path_value(df.schema, by)
    key = F.coalesce(v.c.cast("string") if not isinstance(v.t, T.ArrayType | T.StructType | T.MapType) else F.to_json(v.c), F.lit("__null__"))
    keyed = df.withColumn("_group", key)
    counts = {r["_group"]: r["count"] for r in keyed.groupBy("_group").count().orderBy("_group").limit(100_001).collect()}
    if len(counts) > 100_000:
        raise ValueError(f"{by!r} has over 100,000 values; a sample by group wants fewer")
    want = quotas(counts, n, uniform, shares) if counts else {}
    if not want:
        return df.limit(0)
    spark = df.sparkSession
    plan = spark.createDataFrame(list(want.items()), "_group string, _quota int")
    by_rank = {"random": [_mix(seed, order), *_cols(order)], "head": _cols(order), "tail": [c.desc() for c in _cols(order)]}[how]
    salted = keyed.join(F.broadcast(plan), "_group").withColumn("_salt", F.pmod(F.xxhash64(*_cols(order)), F.lit(SALTS)))
    for part in (["_group", "_salt"], ["_group"]):
        rank = F.row_number().over(Window.partitionBy(*part).orderBy(*by_rank))
        salted = salted.withColumn("_n", rank).where("_n <= _quota")
    return salted.select(*(F.col(f"`{c}`") for c in df.columns))


def ratios(text: str) -> list[float]:
    got = [float(x) for x in text.split(",")]
    got = [*got, 1 - got[0]] if len(got) == 1 else got
    if any(r <= 0 for r in got) or abs(sum(got) - 1) > 1e-6:
        raise ValueError(f"{text!r}: ratios are over 0 and sum to 1")
    return got


def split_names(n: int) -> list[str]:
    return {2: ["train", "test"], 3: ["train", "val", "test"]}.get(n) or [f"part{k + 1}" for k in range(n)]


def split(df: DataFrame, parts: list[float], order: list[str], seed: int | None = 42) -> DataFrame:
    """``df`` with a column ``split``: exact sizes int(total * ratio), the last part takes the rest.

    Rows are dealt in the order of a seeded hash, or in input order without a seed. The rows at the cuts are found once;
    a row's part is then a comparison of its own keys with theirs, the same however and whenever it is read.
    """
    total, names = df.count(), split_names(len(parts))
    cuts, at = [], 0
    for r in parts[:-1]:
        at += int(total * r)
        cuts.append(at)
    keys = [*([_mix(seed, order)] if seed is not None else []), *_keys(df, order)]
    places = sorted({c for c in cuts if 0 < c < total})
    found = rows_at(df, keys, places, hashed=seed is not None) if places else {}
    label = F.lit(names[-1])
    if found is None:  # rows that share all order columns are dealt one by one
        ranked = ranked_rows(df, [*([_mix(seed, order)] if seed is not None else []), *_cols(order)], "_rank")
        for cut, name in reversed(list(zip(cuts, names, strict=False))):
            label = F.when(F.col("_rank") < cut, name).otherwise(label)
        return ranked.withColumn("split", label).drop("_rank")
    for cut, name in reversed(list(zip(cuts, names, strict=False))):
        label = F.when(_before(keys, found[cut]) if cut in found else F.lit(cut > 0), name).otherwise(label)
    return df.withColumn("split", label)


def ranked_rows(df: DataFrame, key: list[Column], name: str, desc: list[bool] | None = None) -> DataFrame:
    """``df`` with each row's place from 0 in the order of ``key``.

    Rows are dealt by ranges of the key, sorted there and written with their number in their range; the ranges' sizes are
    counted from what was written (ranges drawn twice from samples need not agree), and a running sum over them, a row a
    range, gives the offsets.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select("*", *(k.alias(f"_key{i}") for i, k in enumerate(key)))
    names = [f"_key{i}" for i in range(len(key))]
    by = [F.col(c).desc() if d else F.col(c).asc() for c, d in zip(names, desc or [False] * len(names), strict=True)]
    dealt = keyed.repartitionByRange(n, *by).sortWithinPartitions(*by)
    local = written(dealt.drop(*names).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_id", 33)
    sizes = local.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    joined = local.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # a row a partition
    return joined.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_before")
