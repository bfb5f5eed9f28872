"""Pipelines declared in YAML: one plan for all steps."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import ExprError, parse
from ..functions.tokens import token_filter
from ..functions.values import ORDINAL
from ..operators import aggregate, dedupe, joins, order, presets, rows
from ..sources import files
from ..streaming.operators import check


class PipelineError(ValueError):
    pass


#: Of each step its options, those it must have marked by a star.
STEPS: dict[str, tuple[str, ...]] = {
    "filter": ("where*", "strict"),
    "select": ("spec*", "strict"),
    "map": ("code*", "strict"),
    "explode": ("field*", "as", "index_as"),
    "sort": ("by*", "desc"),
    "head": ("num*",),
    "tail": ("num*",),
    "skip": ("num*",),
    "sample": ("num*", "seed", "by", "uniform", "how"),
    "shuffle": ("seed",),
    "group": ("by*", "agg", "top"),
    "join": ("with*", "on", "left_on", "right_on", "how", "prefix"),
    "dedupe": ("key", "similar"),
    "clean": ("strip", "drop_empty", "min_len", "max_len", "promote", "keep", "drop", "rename", "add", "fill", "reorder"),
    "tokens": ("fields*", "min", "max"),
    "transform": ("preset*",),
    "split": ("ratio*", "seed"),
}


def normalized(step: dict) -> dict:
    """YAML reads a bare ``on`` as true; it is meant as the word."""
    return {("on" if k is True else k): v for k, v in step.items()}


def validate(spec: dict) -> list[str]:
    """What is wrong with a pipeline, before any data is read."""
    out = []
    steps = [normalized(s) for s in spec.get("steps") or []]
    if not steps:
        out.append("there are no steps")
    for k, s in enumerate(steps, 1):
        kind = s.get("type")
        if kind not in STEPS:
            out.append(f"step {k}: no step {kind!r}")
            continue
        known = {o.rstrip("*") for o in STEPS[kind]}
        out += [f"step {k} ({kind}): no option {o!r}" for o in s if o != "type" and o not in known]
        out += [f"step {k} ({kind}): {o[:-1]} is required" for o in STEPS[kind] if o.endswith("*") and o[:-1] not in s]
        if kind == "join" and ("on" in s) == ("left_on" in s or "right_on" in s):
            out.append(f"step {k} (join): on, or left_on and right_on")
        if kind == "split" and k < len(steps):
            out.append(f"step {k}: split is the last step")
        for o in ("where", "by", "on", "left_on"):
            if kind in ("filter", "sort", "group", "join") and isinstance(s.get(o), str):
                try:
                    parse(s[o])
                except ExprError as e:
                    out.append(f"step {k} ({kind}): {e}")
    return out


def build(df: DataFrame, spec: dict) -> DataFrame:
    """The plan of all steps over ``df``; ``order`` names the columns that order and identify its rows.

    Without it rows have the order of their files, if ``df`` was loaded with their hidden place.
    """
    if errors := validate(spec):
        raise PipelineError("; ".join(errors))
    by: list[str] = spec.get("order") or [ORDINAL]
    for s in map(normalized, spec["steps"]):
        kind, o = s["type"], {k: v for k, v in s.items() if k != "type"}
        check(df, kind)
        have = [c for c in by if c in df.columns]
        if kind in ("sort", "head", "tail", "skip", "sample", "shuffle", "group", "dedupe", "split") and not have:
            raise PipelineError(f"{kind} needs rows in an order: name its columns in order")
        df = _step(df, kind, o, have, spec)
    return df


def _step(df: DataFrame, kind: str, o: dict[str, Any], by: list[str], spec: dict) -> DataFrame:
    match kind:
        case "filter":
            wheres = o["where"] if isinstance(o["where"], list) else [o["where"]]
            return rows.filter_rows(df, *wheres, strict=o.get("strict", False))
        case "select":
            spec_ = o["spec"] + f", {ORDINAL}" if ORDINAL in df.columns else o["spec"]
            return rows.select_rows(df, spec_, o.get("strict", False))
        case "map":
            return rows.map_rows(df, o["code"], o.get("strict", False))
        case "explode":
            return rows.explode_rows(df, o["field"], o.get("as"), o.get("index_as"))
        case "sort":
            return order.sort_rows(df, o["by"], by, o.get("desc", False))
        case "head" | "tail" | "skip":
            return getattr(order, kind)(df, int(o["num"]), by)
        case "sample" if o.get("by"):
            return order.stratified_sample(df, o["by"], int(o["num"]), by, o.get("uniform", False), how=o.get("how", "random"), seed=o.get("seed", 42))
        case "sample":
            return order.sample(df, int(o["num"]), by, o.get("seed", 42), o.get("how", "random"))
        case "shuffle":
            return order.shuffle(df, by, o.get("seed", 42))
        case "group" if o.get("agg"):
            return aggregate.group_agg(df, o["by"], o["agg"], by, o.get("top"))
        case "group":
            return aggregate.group_count(df, o["by"], by, o.get("top"))
        case "join":
            right = files.load(df.sparkSession, o["with"])
            return joins.join_rows(df, right, o.get("on"), o.get("left_on"), o.get("right_on"), o.get("how", "left"), o.get("prefix", ""))
        case "dedupe" if o.get("similar"):
            return dedupe.dedupe_similar(df, o["key"], by[0], float(o["similar"]))
        case "dedupe":
            return dedupe.dedupe(df, o.get("key"), by)
        case "clean":
            o = dict(o)
            o["strip_text"] = o.pop("strip", False)
            for k in ("min_len", "max_len", "min_tokens", "max_tokens", "promote", "rename", "add", "fill"):
                if isinstance(o.get(k), str):
                    o[k] = rows.parse_options(o[k])
            for k in ("keep", "drop", "reorder", "drop_empty"):
                if isinstance(o.get(k), str):
                    o[k] = [x.strip() for x in o[k].split(",")]
            if o.get("keep") and ORDINAL in df.columns:
                o["keep"] = [*o["keep"], ORDINAL]
            return rows.clean(df, **o)
        case "tokens":
            return token_filter(df, o["fields"], o.get("min"), o.get("max"))
        case "transform":
            return presets.get_preset(o["preset"])(df)
        case "split":
            parts = order.ratios(o["ratio"]) if isinstance(o["ratio"], str) else list(o["ratio"])
            return order.split(df, parts, by, o.get("seed", spec.get("seed", 42)))
    raise PipelineError(f"no step {kind!r}")


def run(spark: SparkSession, path: str, source: str | None = None, target: str | None = None) -> DataFrame:
    """Read a pipeline's YAML, build it over its input and write its output; a split writes a folder for each part."""
    import yaml

    with open(path, encoding="utf-8") as f:
        spec = yaml.safe_load(f)
    read = files.load if spec.get("order") else files.load_ordered
    df = build(read(spark, source or spec["input"]), spec).drop(ORDINAL)
    if out := target or spec.get("output"):
        if "split" in df.columns and normalized(spec["steps"][-1])["type"] == "split":
            for name in order.split_names(len(order.ratios(str(spec["steps"][-1]["ratio"])))):
                files.save(df.where(F.col("split") == name).drop("split"), f"{out}/{name}", "jsonl")
        else:
            files.save(df, out)
    return df


def template(columns: list[str]) -> str:
    """A pipeline to start from."""
    import yaml

    steps = [{"type": "filter", "where": f"x.{columns[0]} is not None"}, {"type": "dedupe", "key": columns[:1]}, {"type": "head", "num": 100}]
    return yaml.safe_dump({"version": 1, "input": "input.jsonl", "output": "output.jsonl", "order": columns[:1], "seed": 42, "steps": steps}, sort_keys=False)
