"""Functions of texts: tags, code blocks, extraction steps of an evaluation, message templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import strip

_FENCE = r"(?s)```([A-Za-z0-9_+#.-]*)[^\S\n]*\n(.*?)```"


def strip_think(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def code_snippets(c: Column) -> Column:
    """Fenced blocks as an array of (language, code); a block without a language is "unknown"."""
    langs = F.regexp_extract_all(c, F.lit(_FENCE), F.lit(1))
    codes = F.regexp_extract_all(c, F.lit(_FENCE), F.lit(2))
    return F.zip_with(langs, codes, lambda a, b: F.struct(F.when(a == "", "unknown").otherwise(a).alias("language"), strip(b).alias("code")))


def tag(c: Column, name: str) -> Column:
    """What stands between ``<name>`` and ``</name>``, first such; null if there is none."""
    n = re.escape(name)
    got = F.regexp_extract_all(c, F.lit(rf"(?s)<{n}>(.*?)</{n}>"), F.lit(1))
    return strip(F.try_element_at(got, F.lit(1)))


def extract(c: Column, steps: str) -> Column:
    """An evaluation's extraction ``step|step``; a step that finds nothing returns what it was given.

    Steps: direct, tag:NAME, json_key:KEY, index:N(sep), line:N, regex:PATTERN. Thinking is taken off first, then the
    last code block is used if there is one.
    """
    c = strip_think(c)
    c = F.coalesce(F.try_element_at(code_snippets(c), F.lit(-1)).code, c)
    for step in steps.split("|") if steps else ["direct"]:
        kind, _, arg = step.strip().partition(":")
        if kind == "direct":
            got = c
        elif kind == "tag":
            got = tag(c, arg)
        elif kind == "json_key":
            got = F.get_json_object(c, f"$.{arg}")
        elif kind == "index":
            m = re.fullmatch(r"(-?\d+)(?:\((.*)\))?", arg)
            if not m:
                raise ValueError(f"{step!r}: index takes N or N(separator)")
            n = int(m[1])
            got = strip(F.try_element_at(F.split(c, re.escape(m[2] or ",")), F.lit(n + 1 if n >= 0 else n)))
        elif kind == "line":
            n = int(arg)
            got = strip(F.try_element_at(F.split(strip(c), "\n"), F.lit(n + 1 if n >= 0 else n)))
        elif kind == "regex":
            group = 1 if re.compile(arg).groups else 0
            got = F.nullif(F.regexp_extract(c, arg, group), F.lit(""))
        else:
            raise ValueError(f"no extraction step {kind!r}")
        c = F.coalesce(got, c)
    return c


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def map_with_priority(values: Column, mapping: dict[str, str]) -> Column:
    """Of an array of predictions the mapped value that comes last in ``mapping``; null if none is mapped."""
    rank = F.create_map(*(F.lit(x) for k, (a, _) in enumerate(mapping.items()) for x in (a, k)))
    best = F.array_max(F.transform(values, lambda v: F.try_element_at(rank, v)))
    out = F.array(*(F.lit(v) for v in mapping.values()))
    return F.try_element_at(out, (best + 1).cast("int"))


TEMPLATES = ("chatml", "llama2", "simple")


def messages_text(messages: Column, template: str = "chatml") -> Column:
    """An array of (role, content) as one text."""
    if template == "chatml":
        return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m.role, F.lit("\n"), m.content, F.lit("<|im_end|>"))), "\n")
    if template == "llama2":

        def one(m: Column) -> Column:
            return F.when(m.role == "system", F.concat(F.lit("<<SYS>>\n"), m.content, F.lit("\n<</SYS>>"))).when(m.role == "user", F.concat(F.lit("[INST] "), m.content, F.lit(" [/INST]"))).otherwise(m.content)

        return F.array_join(F.transform(messages, one), "\n")
    if template == "simple":
        return F.array_join(F.transform(messages, lambda m: F.concat(F.initcap(m.role), F.lit(": "), m.content)), "\n\n")
    raise ValueError(f"no template {template!r}; there are {', '.join(TEMPLATES)}")
