"""Token counts: a built-in word and mark tokenizer as columns, or a tokenizer file in an Arrow-fed function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import path_value
from .rows import turns_array
from .values import as_text

#: Runs of letters or digits, and single other marks.
PATTERN = r"(?U)\w+|[^\w\s]"
DEFAULT_MODEL = "regex"
ALIASES = {"default": "regex", "words": "regex", "plain": "regex"}
_loaded: dict = {}


def resolve_model(model: str) -> str:
    return ALIASES.get(model, model)


def count_tokens(text: Column, model: str = DEFAULT_MODEL) -> Column:
    """Tokens of each text, null and empty 0. ``model`` is "regex" or the path of a tokenizers file on every node."""
    model = resolve_model(model)
    if model == DEFAULT_MODEL:
        return F.coalesce(F.regexp_count(text, F.lit(PATTERN)), F.lit(0))
    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        if model not in _loaded:
            _loaded[model] = Tokenizer.from_file(model)
        got = _loaded[model].encode_batch([t or "" for t in texts], add_special_tokens=False)
        return pd.Series([len(e.ids) for e in got])

    return count(text)


def token_counter(df: DataFrame, fields: list[str], name: str = "token_count", model: str = DEFAULT_MODEL) -> DataFrame:
    """``df`` with the tokens of all named paths together."""
    total = F.lit(0)
    for p in fields:
        v = path_value(df.schema, p)
        total = total + count_tokens(as_text(v.c, v.t), model)
    return df.withColumn(name, total)


def token_filter(df: DataFrame, fields: list[str], least: int | None = None, most: int | None = None, model: str = DEFAULT_MODEL) -> DataFrame:
    """Rows with token counts within bounds, both included."""
    out = token_counter(df, fields, "_tokens", model)
    if least is not None:
        out = out.where(F.col("_tokens") >= least)
    if most is not None:
        out = out.where(F.col("_tokens") <= most)
    return out.drop("_tokens")


ROLES = ("user", "assistant", "system", "tool", "other")


def messages_token_counter(df: DataFrame, name: str = "token_stats") -> DataFrame:
    """``df`` with a struct of a conversation's tokens: total, each role's, turns with text, and their mean (floor)."""
    said = turns_array(df.schema)
    if said is None:
        raise ValueError("rows hold no conversation")
    n = F.transform(F.filter(said, lambda m: m.content != ""), lambda m: F.struct(F.when(m.role.isin(*ROLES[:4]), m.role).when(m.role == "human", "user").when(m.role == "gpt", "assistant").otherwise("other").alias("role"), count_tokens(m.content).alias("n")))

    def total(role: str | None) -> Column:
        return F.aggregate(n, F.lit(0), lambda s, m: s + (m["n"] if role is None else F.when(m.role == role, m["n"]).otherwise(0)))

    turns = F.size(n)
    stats = F.struct(total(None).alias("total"), *(total(r).alias(r) for r in ROLES), turns.alias("turns"), F.when(turns > 0, F.floor(total(None) / turns)).otherwise(0).cast("int").alias("avg_turn"))
    return df.withColumn(name, F.when(said.isNotNull(), stats))


def messages_token_filter(df: DataFrame, least: int | None = None, most: int | None = None, min_turns: int | None = None, max_turns: int | None = None) -> DataFrame:
    out = messages_token_counter(df, "_t").where("_t is not null")
    for c, lo, hi in (("_t.total", least, most), ("_t.turns", min_turns, max_turns)):
        out = out if lo is None else out.where(F.col(c) >= lo)
        out = out if hi is None else out.where(F.col(c) <= hi)
    return out.drop("_t")


def messages_token_stats(df: DataFrame) -> DataFrame:
    """One row of sums per role, of totals, and the mean number of turns (floor), over rows with a conversation."""
    t = messages_token_counter(df, "_t").where("_t is not null").select("_t.*")
    return t.agg(F.count("*").alias("count"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", *ROLES)), F.floor(F.avg("turns")).alias("avg_turns"), F.floor(F.percentile("total", F.lit(0.5))).alias("median"))
