"""Quality by an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

Grams are bytes packed into a long, so all languages share one closed alphabet. Counts are summed within a task, then in
shards by gram; contexts' totals and lower orders join them by context and by suffix. A document's perplexity is the
geometric mean of 1 / P over its bytes. Documents over a quantile of their language's trusted documents are rejected; the
quantile is of trusted documents that the model has not seen, as those it has seen look far better than any other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ORDER = 5
#: Up to so many trusted ids are sent to all executors; more are joined by a shuffle.
MOST_IDS = 1_000_000
#: Up to so many model entries (16 bytes each) are sent to all executors; larger models are joined in shards.
MOST_ENTRIES = 4_000_000
#: Rejected: log-perplexity over this quantile of the language's held-out trusted documents.
QUANTILE = 0.99
#: A text's score differs in its last digits by what is scored with it; the text at the quantile itself is kept.
ROUNDING = 1e-8
#: One in so many trusted texts, by hash, is held out of the model. A language with fewer than ``FEW`` of them has the
#: threshold of all languages where that is higher.
HELD_OUT, FEW = 5, 20
#: Bytes of text that are worked on at a time: arrays of 8 bytes for each, about ten at once.
PART = 1 << 20


def gram_codes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The packed gram of ``ORDER`` bytes that ends at each byte; before a text's start are zero bytes."""
    n, pad = len(raw), ORDER - 1
    wide = np.concatenate([np.zeros(pad, np.uint8), raw]).astype(np.uint64)
    code = wide[pad:].copy()
    for k in range(1, ORDER):
        code |= wide[pad - k : pad - k + n] << np.uint64(8 * k)
    # bytes before the text belong to another row
    for k in range(pad):
        rows = np.flatnonzero(np.diff(at) > k)
        code[at[:-1][rows] + k] &= np.uint64((1 << 8 * (k + 1)) - 1)
    return code


def _suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 8 * order) - 1))


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, c) of the highest order over all of ``texts`` (text): counted within a task, then in shards by gram."""

    def run(batches):
        for batch in batches:
            raw, at = common.text_bytes(batch.column(0))
            for i, j in common.parts(at, PART):
                grams, c = np.unique(gram_codes(raw[at[i] : at[j]], at[i : j + 1] - at[i]), return_counts=True)
                for k in range(0, len(grams), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(grams[k : k + 100_000].view(np.int64)), pa.array(c[k : k + 100_000])], ["gram", "c"])

    return common.columns(texts, "text").mapInArrow(common.trimmed(run), "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of an order from its numbers of grams that occur 1, 2, 3 and 4 times."""
    n = {r.c: r.n for r in counts.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    if not all(n.get(k) for k in (1, 2, 3, 4)):
        return 0.5, 1.0, 1.5
    y = n[1] / (n[1] + 2 * n[2])
    return tuple(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3))


def train(texts: DataFrame, group: str = "") -> DataFrame:
    """The model of ``texts`` (text): rows (key, value), empty without text.

    Key ``order << 48 | gram`` has a seen gram's log probability, ``order + 8 << 48 | context`` a context's log weight for
    the next lower order. Lower orders count the distinct bytes before a gram.
    """
    counts = common.materialize(count_grams(texts), "grams", group)
    by_order = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        longer = by_order[k + 1]
        by_order[k] = common.materialize(longer.groupBy(_suffix(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("c")), "grams", group)
    out, lower = None, None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(by_order[k])
        grams = by_order[k].withColumn("context", F.shiftright("gram", 8))
        less = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        contexts = grams.groupBy("context").agg(F.sum("c").alias("total"), F.sum(less).alias("held")).withColumn("weight", F.col("held") / F.col("total"))
        p = grams.join(contexts, "context")
        if lower is None:
            below = F.lit(1 / 256)
        else:
            p = p.withColumn("suffix", _suffix(F.col("gram"), k - 1)).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
            below = F.col("below")
        p = p.select("gram", ((F.col("c") - less) / F.col("total") + F.col("weight") * below).alias("p"))
        lower = common.materialize(p, "order", group)
        rows = lower.select((F.col("gram") + F.lit(k << 48)).alias("key"), F.log("p").alias("value"))
        rows = rows.union(contexts.select((F.col("context") + F.lit((k + 8) << 48)).alias("key"), F.log("weight").alias("value")))
        out = rows if out is None else out.union(rows)
    return common.materialize(out, "model", group)


class Lookup:
    """A hash table of numpy arrays from long keys to doubles."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - (size.bit_length() - 1)), np.int64(size - 1)
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.float64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            slot = at[left]
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]  # the last of those that share a slot stays
            mine = self.keys[slot] == keys[left]
            self.values[slot[mine]] = values[left[mine]]
            left = left[~mine]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where a key is missing) and whether each key is there."""
        at = self._slot(keys)
        got, seen = self.keys[at], self.values[at]
        found = got == keys
        open_ = np.flatnonzero(~found & (got != -1))
        seen[~found] = 0
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            got = self.keys[at[open_]]
            hit = got == keys[open_]
            found[open_[hit]] = True
            seen[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return seen, found


def log_probabilities(codes: np.ndarray, table: Lookup) -> np.ndarray:
    """The log probability of each byte after the bytes before it."""
    out = np.zeros(len(codes), np.float64)
    left, code = np.arange(len(codes)), codes.view(np.int64)
    for k in range(ORDER, 0, -1):
        code = code & np.int64((1 << 8 * k) - 1)
        value, found = table.get(code + np.int64(k << 48))
        out[left[found]] += value[found]
        left, code = left[~found], code[~found]
        if not len(left):
            return out
        weight, _ = table.get((code >> np.int64(8)) + np.int64((k + 8) << 48))
        out[left] += weight
    out[left] += math.log(1 / 256)
    return out


def _mean_scores(raw: np.ndarray, at: np.ndarray, table: Lookup) -> np.ndarray:
    """Mean negative log probability of each row; not a number for empty rows."""
    out = np.empty(len(at) - 1)
    for i, j in common.parts(at, PART):
        total, n = np.zeros(j - i), np.diff(at[i : j + 1])
        for a in range(int(at[i]), int(at[j]), 2 * PART):  # a very long row in pieces, with what comes before
            b, before = min(int(at[j]), a + 2 * PART), min(ORDER - 1, a - int(at[i]))
            inner = np.clip(at[i : j + 1], a - before, b) - (a - before)
            p = log_probabilities(gram_codes(raw[a - before : b], inner)[before:], table)
            sums = np.concatenate([[0.0], np.cumsum(p)])
            ends = np.clip(at[i : j + 1], a, b) - a
            total += sums[ends[1:]] - sums[ends[:-1]]
        out[i:j] = -total / np.where(n, n, np.nan)
    return out


def score(docs: DataFrame, model: DataFrame, most_entries: int = MOST_ENTRIES, group: str = "") -> DataFrame:
    """``docs`` with ``_score``, the mean negative log probability per byte of its text; null for null or empty texts.

    A model of up to ``most_entries`` entries is sent to all executors. A larger one stays in its shards: the distinct
    grams of all documents are resolved by joins order by order, and each document's counts join them.
    """
    if model.count() <= most_entries:
        got = model.toArrow()
        table = docs.sparkSession.sparkContext.broadcast((got["key"].to_numpy(), got["value"].to_numpy()))
        names = docs.columns

        def run(batches):
            lookup = Lookup(*table.value)
            for batch in batches:
                raw, at = common.text_bytes(batch.column(names.index("text")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_mean_scores(raw, at, lookup), pa.float64(), from_pandas=True)], [*names, "_score"])

        return docs.mapInArrow(common.trimmed(run), T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())]))
    return _score_in_shards(docs, model, group)


def _score_in_shards(docs: DataFrame, model: DataFrame, group: str) -> DataFrame:
    rows = common.materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered", group)

    def run(batches):
        for batch in batches:
            raw, at = common.text_bytes(batch.column(1))
            codes = gram_codes(raw, at)
            for row, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                grams, c = np.unique(codes[a:b], return_counts=True)
                if len(grams):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), row)), pa.array(grams.view(np.int64)), pa.array(c)], ["_row", "gram", "c"])

    grams = common.materialize(rows.select("_row", "text").mapInArrow(common.trimmed(run), "_row long, gram long, c long"), "doc-grams", group)
    p = grams.select("gram").distinct().select("gram", F.lit(0.0).alias("p"), F.lit(True).alias("open"))
    for k in range(ORDER, 0, -1):
        suffix = _suffix(F.col("gram"), k)
        seen = model.where(F.shiftright("key", 48) == k).select(F.col("key").alias("k1"), F.col("value").alias("v1"))
        weight = model.where(F.shiftright("key", 48) == k + 8).select(F.col("key").alias("k2"), F.col("value").alias("v2"))
        p = p.join(seen, F.col("open") & (suffix + F.lit(k << 48) == F.col("k1")), "left")
        p = p.join(weight, F.col("open") & (F.shiftright(suffix, 8) + F.lit((k + 8) << 48) == F.col("k2")), "left")
        add = F.when(~F.col("open"), 0.0).when(F.col("v1").isNotNull(), F.col("v1")).otherwise(F.coalesce("v2", F.lit(0.0)))
        p = p.select("gram", (F.col("p") + add).alias("p"), (F.col("open") & F.col("v1").isNull()).alias("open"))
    p = p.select("gram", (F.col("p") + F.when(F.col("open"), math.log(1 / 256)).otherwise(0.0)).alias("p"))
    scores = grams.join(p, "gram").groupBy("_row").agg((-F.sum(F.col("c") * F.col("p")) / F.sum("c")).alias("_score"))
    return rows.join(scores, "_row", "left").drop("_row")


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that some row of ``labels`` (doc_id, quality, toxic) calls good (1) and none toxic (1)."""
    seen = labels.groupBy("doc_id").agg(F.max("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    good = seen.where("q = 1 and t = 0 and doc_id is not null").select(F.col("doc_id").alias("_trusted"))
    good = F.broadcast(good) if good.count() <= MOST_IDS else good
    return docs.join(good, F.col("doc_id") == F.col("_trusted"), "left_semi")


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, most_entries: int = MOST_ENTRIES, group: str = "") -> DataFrame:
    """``docs`` with perplexity, threshold (of its language) and kept; needs doc_id, text and lang.

    The threshold of a language (null is one) is the ``quantile`` of its held-out trusted documents' log-perplexity; a
    language without such documents has that of all. Rows without text have no perplexity and are
    not kept. Without trusted text on either side everything with text is kept. Columns of those names are replaced.
    """
    docs = docs.drop("perplexity", "threshold", "kept", "_score")
    trusted = trusted_documents(docs, labels)
    held_out = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    model = train(trusted.where(~held_out), group)
    known = score(common.columns(trusted.where(held_out), "text", "lang"), model, most_entries, group).where("_score is not null").select("lang", "_score")
    cut = F.percentile_approx("_score", F.lit(quantile), F.lit(10_000))
    known = common.materialize(known, "scores", group)
    whole = known.agg(cut.alias("_cut")).first()[0]
    if whole is None or model.isEmpty():
        null = F.lit(None).cast("double")
        return docs.select("*", null.alias("perplexity"), null.alias("threshold"), (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("kept"))
    own = F.when(F.count("*") < FEW, F.greatest(cut, F.lit(whole))).otherwise(cut)
    by_lang = known.groupBy("lang").agg(own.alias("_cut")).select(F.col("lang").alias("_lang"), "_cut")
    by_lang = common.materialize(by_lang, "cuts", group)
    by_lang = F.broadcast(by_lang) if by_lang.count() <= 10_000 else by_lang
    out = score(docs, model, most_entries, group).join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    limit = F.coalesce("_cut", F.lit(whole))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.exp("_score").alias("perplexity"), F.exp(limit).alias("threshold"), F.coalesce(F.col("_score") <= limit * (1 + ROUNDING), F.lit(False)).alias("kept"))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document, by a model of the documents that labels call good."""
    docs = common.columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang")
    return judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "lang", "perplexity", "threshold", "kept")
