"""A dataset with a fluent interface: lazy, each method returns a new one. Rows keep the order of their files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.tokens import token_counter, token_filter
from .functions.values import ORDINAL
from .operators import aggregate, dedupe, joins, order, presets, rows, sets, validate
from .plans.lineage import Lineage
from .sources import files
from .streaming.operators import check


class Dataset:
    """Rows in the order of the ``order`` columns, by default in that of their files (or of the DataFrame at hand).

    The place in the files is a hidden column, which operators carry along; ``df`` is without it. A DataFrame whose rows
    come from a shuffle has no order to keep, so it wants ``order_by``.
    """

    def __init__(self, df: DataFrame, order_by: list[str] | None = None, lineage: Lineage | None = None):
        if not order_by and ORDINAL not in df.columns and not df.isStreaming:
            df = files.with_ordinal(df, "")
        self._df, self.order, self.lineage = df, order_by or (df.columns[:1] if df.isStreaming else [ORDINAL]), lineage
        self._sorted: tuple[str, bool] | None = None

    @classmethod
    def load(cls, spark: SparkSession, path: str, order_by: list[str] | None = None, track: bool = False, **options) -> Dataset:
        read = files.load if order_by else files.load_ordered
        return cls(read(spark, path, **options), order_by, Lineage(path) if track else None)

    @property
    def df(self) -> DataFrame:
        """The rows as a user sees them."""
        if self._sorted:
            return order.sort_rows(self._df, self._sorted[0], self.order, self._sorted[1]).drop(ORDINAL)
        return self._df.drop(ORDINAL)

    @property
    def _rows(self) -> DataFrame:
        """The rows with their hidden place; after a sort that is their rank, which is found when it is first needed."""
        if self._sorted:
            self._df, self.order, self._sorted = order.sort_ranks(self._df, self._sorted[0], self.order, self._sorted[1]), [ORDINAL], None
        return self._df

    def _with(self, df: DataFrame, operation: str, **params) -> Dataset:
        if self.lineage:
            df = self.lineage.track(df, operation, **params)
        kept = [c for c in self.order if c in df.columns]
        return Dataset(df, kept or ([ORDINAL] if ORDINAL in df.columns else df.columns[:1]), self.lineage)

    def _and_place(self, names: list[str]) -> list[str]:
        return [*names, *([ORDINAL] if ORDINAL in self._df.columns else [])]

    def _whole(self, op: str) -> None:
        check(self.df, op)

    def save(self, path: str, **options) -> None:
        files.save(self.df, path, **options)
        if self.lineage:
            self.lineage.finish()

    def filter(self, test: str | Callable[[dict], bool], on_error: str = "skip") -> Dataset:
        if callable(test):
            return self._with(rows.filter_python(self._rows, test, on_error), "filter")
        return self._with(rows.filter_rows(self._rows, test, strict=on_error == "raise"), "filter", where=test)

    def select(self, spec: str) -> Dataset:
        return self._with(rows.select_rows(self._rows, ",".join(self._and_place([spec]))), "select", spec=spec)

    def map(self, code: str | Callable[[dict], dict], schema=None, on_error: str = "raise") -> Dataset:
        if callable(code):
            return self._with(self._python(code, schema, on_error, False), "map")
        return self._with(rows.map_rows(self._rows, code), "map", code=code)

    def flat_map(self, f: Callable[[dict], list[dict]], schema, on_error: str = "skip") -> Dataset:
        return self._with(self._python(f, schema, on_error, True), "flat_map")

    def _python(self, f: Callable, schema, on_error: str, flat: bool) -> DataFrame:
        """A Python function of rows without their hidden place, which goes to what it returns."""
        x = self._rows
        if ORDINAL not in x.columns:
            return rows.map_python(x, f, schema or x.schema, on_error, flat)
        fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema or self.df.schema).fields

        def placed(row: dict):
            place = row.pop(ORDINAL)
            got = f(row)
            row[ORDINAL] = place
            if got is None or not flat:
                return got and {**got, ORDINAL: place}
            return [{**r, ORDINAL: f"{place}{k:010d}"} for k, r in enumerate(got)]

        return rows.map_python(x, placed, T.StructType([*fields, T.StructField(ORDINAL, T.StringType())]), on_error, flat)

    def explode(self, field: str, as_: str | None = None, index_as: str | None = None) -> Dataset:
        x = self._rows
        if ORDINAL not in x.columns or not isinstance(x.schema[field].dataType if field in x.columns else None, T.ArrayType):
            return self._with(rows.explode_rows(x, field, as_, index_as), "explode", field=field)
        out = rows.explode_rows(x, field, as_, index_as or "_item_at")
        place = F.concat(ORDINAL, F.lpad(F.coalesce(F.col(index_as or "_item_at"), F.lit(0)).cast("string"), 10, "0"))
        return self._with(out.withColumn(ORDINAL, place).drop("_item_at"), "explode", field=field)

    def clean(self, **options) -> Dataset:
        own = {**options, "keep": self._and_place(options["keep"])} if options.get("keep") else options
        return self._with(rows.clean(self._rows, **own), "clean", **options)

    def transform(self, preset: str, **options) -> Dataset:
        return self._with(presets.get_preset(preset)(self._rows, **options), "transform", preset=preset)

    def convert(self, target: str) -> Dataset:
        return self._with(presets.CONVERTERS[target](self._rows), "convert", target=target)

    def join(self, right: Dataset, on: str | None = None, **options) -> Dataset:
        return self._with(self._joined(right, on, options), "join")

    def _joined(self, right: Dataset, on: str | None, options: dict) -> DataFrame:
        x, y = self._rows, right._rows
        out = joins.join_rows(x, y, on, order=right.order, **options)
        hidden = options.get("prefix", "") + ORDINAL
        return out.drop(hidden) if hidden not in x.columns else out

    def dedupe(self, key: str | list[str] | None = None) -> Dataset:
        return self._with(dedupe.dedupe(self._rows, key, self.order), "dedupe", key=key)

    def dedupe_similar(self, key: str, threshold: float = 0.8, **options) -> Dataset:
        return self._with(dedupe.dedupe_similar(self._rows, key, self.order[0], threshold, **options), "dedupe_similar", key=key)

    def sort(self, by: str, desc: bool = False) -> Dataset:
        self._whole("sort")
        out = self._with(self._rows, "sort", by=by)
        out._sorted = (by, desc)
        return out

    def head(self, n: int = 10) -> Dataset:
        if self._sorted:  # a top-k by the sort's keys: nothing needs to be ranked
            by, desc = self._sorted
            out = self._with(order.sort_rows(self._df, by, self.order, desc).limit(n), "head", n=n)
            out._sorted = self._sorted
            return out
        return self._with(order.head(self._rows, n, self.order), "head", n=n)

    def tail(self, n: int = 10) -> Dataset:
        self._whole("tail")
        return self._with(order.tail(self._rows, n, self.order), "tail", n=n)

    def skip(self, n: int) -> Dataset:
        return self._with(order.skip(self._rows, n, self.order), "skip", n=n)

    def slice(self, start: int | None, end: int | None = None) -> Dataset:
        return self._with(order.slice_rows(self._rows, start, end, self.order), "slice", start=start, end=end)

    def shuffle(self, seed: int = 42) -> Dataset:
        self._whole("shuffle")
        x = self._rows
        mixed = F.lpad(F.hex(order._mix(seed, self.order).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
        own = F.concat(mixed, F.col(ORDINAL)) if ORDINAL in x.columns else mixed
        out = self._with(x.withColumn(ORDINAL, own), "shuffle", seed=seed)
        out.order = [ORDINAL, *(c for c in self.order if c != ORDINAL)]
        out._df = out._df.orderBy(*out.order)
        return out

    def sample(self, n: int, seed: int = 42, by: str | None = None, **options) -> Dataset:
        self._whole("sample")
        got = order.stratified_sample(self._rows, by, n, self.order, seed=seed, **options) if by else order.sample(self._rows, n, self.order, seed)
        return self._with(got, "sample", n=n)

    def split(self, ratio: float | list[float] = 0.8, seed: int | None = 42) -> list[Dataset]:
        parts = [ratio, 1 - ratio] if isinstance(ratio, float) else list(ratio)
        whole = order.split(self._rows, parts, self.order, seed)
        return [Dataset(whole.where(whole.split == n).drop("split"), self.order) for n in order.split_names(len(parts))]

    def concat(self, *others: Dataset, strict: bool = False) -> Dataset:
        frames = [d._rows for d in (self, *others)]
        if all(ORDINAL in x.columns for x in frames):  # one input after another
            frames = [x.withColumn(ORDINAL, F.concat(F.lit(f"{k:06d} "), F.col(ORDINAL))) for k, x in enumerate(frames)]
        else:
            frames = [x.drop(ORDINAL) for x in frames]
        return self._with(sets.concat(*frames, strict=strict), "concat")

    __add__ = concat

    def group(self, by: str, agg: str | None = None, top: int | None = None) -> DataFrame:
        return aggregate.group_agg(self._rows, by, agg, self.order, top) if agg else aggregate.group_count(self._rows, by, self.order, top)

    def stats(self) -> DataFrame:
        return aggregate.quick_stats(self.df)

    def profile(self, fields: list[str] | None = None) -> DataFrame:
        return aggregate.profile(self.df, fields)

    def describe(self, *exprs: str) -> DataFrame:
        return aggregate.describe(self._rows, list(exprs))

    def fields(self) -> list[str]:
        return aggregate.field_names(self.df.schema)

    def count_tokens(self, fields: list[str], name: str = "token_count") -> Dataset:
        return self._with(token_counter(self._rows, fields, name), "count_tokens", fields=fields)

    def token_filter(self, fields: list[str], least: int | None = None, most: int | None = None) -> Dataset:
        return self._with(token_filter(self._rows, fields, least, most), "token_filter", fields=fields)

    def validate(self, schema: validate.Schema, on_error: str = "skip") -> Dataset:
        """skip: the invalid rows with their errors; filter: the valid rows; raise: an error if any is invalid."""
        if on_error == "filter":
            return self._with(validate.valid_rows(self._rows, schema), "validate")
        bad = validate.invalid_rows(self._rows, schema)
        if on_error == "raise" and (first := bad.first()):
            raise ValueError(f"invalid: {first['_errors']}")
        return self._with(bad, "invalid")

    def count(self) -> int:
        return self._rows.count()

    def collect(self, limit: int | None = None) -> list[dict]:
        untracked = Dataset(self._df, self.order)
        untracked._sorted = self._sorted
        got = untracked.head(limit).df if limit else self.df
        return [r.asDict(recursive=True) for r in got.collect()]

    def __iter__(self):
        return (r for b in files.batches(self.df, 1000) for r in b)
