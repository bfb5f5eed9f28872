"""Filtering, projecting and reshaping rows."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import ExprError, Unsupported, passing, value_of, where_of
from ..functions.paths import path_value
from ..functions.values import as_text, is_empty, length_of, strip


class RowError(ValueError):
    """A row for which an expression fails, in strict mode."""


def _checked(c: Column, err: Column | None, strict: bool, what: str, otherwise: Column) -> Column:
    """``c`` where it is defined; else ``otherwise``, or an error that ends the query in strict mode."""
    if err is None:
        return c
    bad = F.raise_error(F.lit(f"{what} fails on a row")) if strict else otherwise
    return F.when(F.coalesce(err, F.lit(False)), bad).otherwise(c)


def filter_rows(df: DataFrame, *wheres: str, strict: bool = False) -> DataFrame:
    """Rows for which every expression is true; rows for which one fails are dropped, or end a strict query."""
    for w in wheres:
        if not strict:
            try:
                df = df.where(passing(w, df.schema))
                continue
            except Unsupported:
                pass  # evaluated by Python below
        v = where_of(w, df.schema)
        df = df.where(_checked(v.c, v.err, strict, w, F.lit(False)))
    return df


def count_failures(df: DataFrame, where: str) -> DataFrame:
    """(failed, total): for how many rows the expression fails."""
    v = where_of(where, df.schema)
    err = F.lit(False) if v.err is None else F.coalesce(v.err, F.lit(False))
    return df.agg(F.coalesce(F.sum(err.cast("long")), F.lit(0)).alias("failed"), F.count("*").alias("total"))


def split_top(text: str, sep: str = ",") -> list[str]:
    """Split at ``sep`` outside brackets and quotes."""
    out, depth, quote, begin = [], 0, "", 0
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote and text[i - 1] != "\\" else quote
        elif ch in "'\"":
            quote = ch
        elif ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
        elif ch == sep and not depth:
            out.append(text[begin:i])
            begin = i + 1
    return [*out, text[begin:]]


def parse_spec(spec: str) -> list[tuple[str, str | None]]:
    """``a,n=len(x.m)`` as (name, expression); a bare name is a column."""
    out: list[tuple[str, str | None]] = []
    for part in split_top(spec):
        part = part.strip()
        if not part:
            continue
        name, eq, expr = part.partition("=")
        if eq and name.strip().isidentifier() and not expr.startswith("="):
            out.append((name.strip(), expr.strip()))
        else:
            out.append((part, None))
    if len({n for n, _ in out}) < len(out):
        raise ExprError(f"a name twice in {spec!r}")
    return out


def select_rows(df: DataFrame, spec: str, strict: bool = False) -> DataFrame:
    """Columns of the spec in its order; names that rows lack are left out, failing expressions are null."""
    cols = []
    for name, expr in parse_spec(spec):
        if expr is None:
            if name in df.columns:
                cols.append(F.col(f"`{name}`"))
        else:
            v = value_of(expr, df.schema)
            cols.append(_checked(v.c, v.err, strict, expr, F.lit(None)).alias(name))
    return df.select(*cols)


def map_rows(df: DataFrame, code: str, strict: bool = False) -> DataFrame:
    """Statements ``x.a = ...`` and ``del x.b`` in order; where one fails the row keeps its value, or null if it is new."""
    for s in ast.parse(code).body:
        if isinstance(s, ast.Delete):
            for t in s.targets:
                df = df.drop(_target(t))
        elif isinstance(s, ast.Assign) and len(s.targets) == 1 or isinstance(s, ast.AugAssign):
            target = s.target if isinstance(s, ast.AugAssign) else s.targets[0]
            name = _target(target)
            expr = ast.unparse(ast.BinOp(target, s.op, s.value)) if isinstance(s, ast.AugAssign) else ast.unparse(s.value)
            v = value_of(expr, df.schema)
            old = F.col(f"`{name}`").cast(v.t) if name in df.columns else F.lit(None).cast(v.t)
            df = df.withColumn(name, _checked(v.c, v.err, strict, expr, old))
        else:
            raise ExprError(f"{ast.unparse(s)}: a statement assigns x.name or deletes it")
    return df


def _target(t: ast.expr) -> str:
    if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "x":
        return t.attr
    if isinstance(t, ast.Subscript) and isinstance(t.value, ast.Name) and t.value.id == "x" and isinstance(t.slice, ast.Constant):
        return t.slice.value
    raise ExprError(f"{ast.unparse(t)}: only fields of x itself can be set")


def explode_rows(df: DataFrame, field: str, as_: str | None = None, index_as: str | None = None) -> DataFrame:
    """A row for each item of a list column; a null list keeps its row, an empty one has none; no list, no change."""
    name = as_ or field
    if field not in df.columns:
        return df
    t = df.schema[field].dataType
    if not isinstance(t, T.ArrayType):
        return df if name == field else df.withColumnRenamed(field, name)
    some = df.where(F.col(f"`{field}`").isNull() | (F.size(f"`{field}`") > 0))
    out = some.select("*", F.posexplode_outer(f"`{field}`").alias("_pos", "_item"))
    cols = [F.col("_item").alias(name) if c == field else F.col(f"`{c}`") for c in df.columns if c == field or c not in (name, index_as)]
    return out.select(*cols, *([F.col("_pos").alias(index_as)] if index_as else []))


def map_python(df: DataFrame, f: Callable[[dict], dict | Iterable[dict] | None], schema: T.StructType | str, on_error: str = "raise", flat: bool = False) -> DataFrame:
    """Any Python function of a row as a dict, fed by Arrow batches: its result, its results (``flat``), None for no row.

    on_error: raise, skip (no row), null (a row of nulls) or keep (the row itself, if ``schema`` fits). Values are those
    of the columns' types: whole numbers stay whole beside nulls.
    """
    if on_error not in ("raise", "skip", "null", "keep"):
        raise ValueError(f"on_error is raise, skip, null or keep, not {on_error!r}")
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    made = to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                try:
                    got = f(row)
                    out += [] if got is None else list(got) if flat else [got]
                except Exception:
                    if on_error == "raise":
                        raise
                    out += {"skip": [], "null": [{}], "keep": [row]}[on_error]
            for k in range(0, len(out), 10_000):
                some = out[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(x.name) for r in some], x.type) for x in made], schema=made)

    return df.mapInArrow(run, schema)


def filter_python(df: DataFrame, f: Callable[[dict], bool], on_error: str = "raise") -> DataFrame:
    return map_python(df, lambda row: row if f(row) else None, df.schema, on_error)


# cleaning

def parse_options(text: str | dict | list, need_value: bool = True) -> dict[str, str | None]:
    """``a:b,c:d`` as a dict; a key twice, or one without a value where it is needed, is an error."""
    if isinstance(text, dict):
        return dict(text)
    out: dict[str, str | None] = {}
    for part in text if isinstance(text, list) else text.split(","):
        part = part.strip()
        if not part:
            continue
        key, colon, value = part.rpartition(":") if ":" in part else (part, "", None)
        if (not colon and need_value) or not key:
            raise ValueError(f"{part!r}: write name:value")
        if key in out:
            raise ValueError(f"{key!r} twice")
        out[key] = value
    return out


def _tokens_of(c: Column, t: T.DataType) -> Column:
    from ..functions.tokens import count_tokens

    return count_tokens(as_text(c, t))


def clean(
    df: DataFrame,
    strip_text: bool = False,
    drop_empty: bool | list[str] = False,
    min_len: dict[str, int] | None = None,
    max_len: dict[str, int] | None = None,
    min_tokens: dict[str, int] | None = None,
    max_tokens: dict[str, int] | None = None,
    promote: dict[str, str] | None = None,
    keep: list[str] | None = None,
    drop: list[str] | None = None,
    rename: dict[str, str] | None = None,
    add: dict[str, str] | None = None,
    fill: dict[str, str] | None = None,
    reorder: list[str] | None = None,
) -> DataFrame:
    """Declarative cleaning in a fixed order: strip, filters, promote, keep or drop, rename, add, fill, reorder.

    promote maps a path to a new column; keep wins over drop; a rename that collides is an error.
    """
    if strip_text:
        df = df.select(*(strip(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields))
    test = None
    paths = df.columns if drop_empty is True else drop_empty or []
    for p in paths:
        v = path_value(df.schema, p)
        test = ~is_empty(v.c, v.t) if test is None else test & ~is_empty(v.c, v.t)
    for limits, under, by in ((min_len, True, length_of), (max_len, False, length_of), (min_tokens, True, _tokens_of), (max_tokens, False, _tokens_of)):
        for p, n in (limits or {}).items():
            v = path_value(df.schema, p)
            size = by(v.c, v.t)
            ok = size >= int(n) if under else size <= int(n)
            test = ok if test is None else test & ok
    if test is not None:
        df = df.where(test)
    for p, name in (promote or {}).items():
        df = df.withColumn(name, path_value(df.schema, p).c)
    if keep:
        df = df.select(*(F.col(f"`{c}`") for c in keep if c in df.columns))
    elif drop:
        df = df.drop(*drop)
    if rename:
        after = [rename.get(c, c) for c in df.columns]
        if len(set(after)) < len(after):
            raise ValueError(f"two columns would be called {next(c for c in after if after.count(c) > 1)!r}")
        df = df.select(*(F.col(f"`{c}`").alias(rename.get(c, c)) for c in df.columns))
    for name, value in (add or {}).items():
        df = df.withColumn(name, F.lit(str(value)))
    for name, value in (fill or {}).items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(str(value)))
        else:
            t = df.schema[name].dataType
            c = F.col(f"`{name}`")
            df = df.withColumn(name, F.when(is_empty(c, t), F.lit(str(value)).try_cast(t)).otherwise(c) if not isinstance(t, T.ArrayType | T.MapType | T.StructType) else c)
    if reorder:
        first = [c for c in reorder if c in df.columns]
        df = df.select(*(F.col(f"`{c}`") for c in [*first, *(c for c in df.columns if c not in first)]))
    return df
