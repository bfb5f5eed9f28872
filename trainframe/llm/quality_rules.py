"""Quality rules as a short-circuit cascade.

On a sample each rule is timed and its rejections are counted, on documents that pass the base and with the base's
statistics at hand, as when the rules run; they run in order of rejections per second, and a document meets no rule after
the first that rejects it. The order changes the cost, never the verdict.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Bytes of a text beyond which its words are numbers, not Python objects.
LONG = 1 << 20
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")


def word_lists(text: bytes):
    """The words of ``text``, in lists of about ``LONG`` bytes of it."""
    at = 0
    while at < len(text):
        end = at + LONG
        if end < len(text):
            end = m.start() if (m := _SPACE.search(text, end)) else len(text)
        yield text[at:end].split()
        at = end


def _repeat_words(text: bytes) -> int:
    """``Features.n_repeat_words`` by numbered words and a sort of the windows; 50 bytes or so for each word."""
    known: dict[bytes, int] = {}
    w = np.concatenate([np.fromiter((known.setdefault(x, len(known)) for x in words), np.int32, len(words)) for words in word_lists(text)])
    if len(w) < 3:
        return 0
    o = np.lexsort((w[2:], w[1:-1], w[:-2])).astype(np.int32)
    same = np.ones(len(o) - 1, bool)
    for k in range(3):
        same &= w[o[1:] + k] == w[o[:-1] + k]
    twice = np.zeros(len(o), bool)
    twice[o[1:][same]] = twice[o[:-1][same]] = True
    covered = np.zeros(len(w), bool)
    for k in range(3):
        covered[k : len(w) - 2 + k] |= twice
    return int(covered.sum())


class Features:
    """What rules ask of a text, each computed when it is first asked for. Words are runs of bytes but ASCII white space."""

    def __init__(self, text: bytes | None):
        self.text = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return sum(map(len, word_lists(self.text))) if len(self.text) > LONG else len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, common.SPACES + bytes(range(0x80, 0xC0))))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, b"#*$%&|<>"))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in 3-word windows that occur twice or more."""
        if len(self.text) > LONG:
            return _repeat_words(self.text)
        w = self.words
        first: dict[tuple, int] = {}
        covered = set()
        for i, window in enumerate(zip(w, w[1:], w[2:], strict=False)):
            j = first.setdefault(window, i)
            if j != i:
                covered.update((i, i + 1, i + 2, j, j + 1, j + 2))
        return len(covered)

    @cached_property
    def n_upper(self) -> int:
        return len(self.text) - len(self.text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))

    @cached_property
    def n_bangs(self) -> int:
        return self.text.count(b"!")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


RULES = (
    Rule("short words", lambda x: x.word_chars < 2 * x.n_words),
    Rule("long words", lambda x: x.word_chars > 20 * x.n_words),
    Rule("symbols", lambda x: 10 * x.n_symbols > x.n_words),
    Rule("duplicate lines", lambda x: 10 * x.n_dup_lines > 3 * len(x.lines)),
    Rule("repeated words", lambda x: 10 * x.n_repeat_words > 3 * x.n_words),
    Rule("capitals", lambda x: 2 * x.n_upper > x.word_chars),
    Rule("exclamations", lambda x: 2 * x.n_bangs > x.n_words),
)


#: The statistics that every document has whatever its verdict.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed(x: Features) -> bool:
    return x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> list[tuple[int, int, float]]:
    """(rule's index, rejections, seconds) in the order to run, from about ``sample_rows`` rows spread over ``docs``.

    The sample is what has the least hashes of doc_id and text, so it is the same in each run and comes from everywhere.
    A rule's seconds are what it adds to the base's statistics, on rows that pass the base. An empty sample keeps the
    given order.
    """
    rows = common.columns(docs, "doc_id", "text")
    n = rows.count()
    few = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) < sample_rows
    sample = (rows.where(few) if n > sample_rows else rows).select("text")

    def measure(batches):
        cost, out = [0.0] * len(rules), [0] * len(rules)
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                x = Features(text.as_py())
                if base_failed(x):
                    continue
                for name in BASE:
                    getattr(x, name)
                for k, rule in enumerate(rules):
                    begin = time.perf_counter()
                    out[k] += bool(rule.rejects(x))
                    cost[k] += time.perf_counter() - begin
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(out, pa.int64()), pa.array(cost, pa.float64())], ["rule", "rejected", "seconds"])

    got = sample.mapInArrow(common.trimmed(measure), "rule int, rejected long, seconds double").groupBy("rule").agg(F.sum("rejected"), F.sum("seconds")).collect()
    return sorted((tuple(r) for r in got), key=lambda r: (-r[1] / max(r[2], 1e-9), r[2], r[0])) or [(k, 0, 0.0) for k in range(len(rules))]


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[int] | None = None) -> DataFrame:
    """Base statistics and verdict of each row of ``docs`` (doc_id, text); a null text has no words and fails the base.

    Rows: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept. Every row gives one.
    """
    order = [r[0] for r in order_rules(docs, rules)] if order is None else order
    ordered = [rules[k] for k in order]

    def run(batches):
        names = list(BASE)
        for batch in batches:
            _, at = common.text_bytes(batch.column(1))
            for i, j in common.parts(at, 8 << 20):
                out: list[list] = [[] for _ in range(7)]
                for text in batch.column(1)[i:j].cast(pa.large_binary()).to_pylist():
                    x = Features(text)
                    failed = base_failed(x)
                    for k, n in enumerate(names):
                        out[k].append(getattr(x, n))
                    out[5].append(failed)
                    out[6].append(not failed and not any(rule.rejects(x) for rule in ordered))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *(pa.array(c, pa.int64()) for c in out[:5]), *(pa.array(c, pa.bool_()) for c in out[5:])], ["doc_id", *names, "base_failed", "kept"])

    rows = common.columns(docs, "doc_id", "text")
    return rows.withColumn("doc_id", rows.doc_id.cast("long")).mapInArrow(common.trimmed(run), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return cascade(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), v AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM v
), p AS (
  SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM c WHERE n > 1) GROUP BY r
), s AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs
  FROM d LEFT JOIN p USING (r)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > n_words
    OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_repeat_words > 3 * n_words OR 2 * n_upper > word_chars
    OR 2 * n_bangs > n_words) AS kept
FROM f
"""
