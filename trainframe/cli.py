"""Command line: ``python -m trainframe.cli filter data.jsonl "x.score > 1" -o out.jsonl``."""

from __future__ import annotations

import argparse
import json
import sys

from .dataset import Dataset
from .functions.expr import ExprError
from .functions.paths import PathError
from .functions.values import ORDINAL
from .operators import sets, validate
from .sources.files import read_stream

#: Exit codes: fine, failed, wrong use, no such input, data not valid.
OK, FAILED, USAGE, MISSING, INVALID = 0, 1, 2, 3, 4
SCHEMAS = {"openai_chat": validate.openai_chat_schema, "alpaca": validate.alpaca_schema, "dpo": validate.dpo_schema, "sharegpt": validate.sharegpt_schema}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trainframe")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple, **options):
        c = sub.add_parser(name, **options)
        c.add_argument("input")
        for a in args:
            c.add_argument(a[0], **a[1])
        c.add_argument("-o", "--output")
        c.add_argument("--order", default="")

    n = ("-n", {"type": int, "default": 10})
    add("filter", ("where", {"nargs": "+"}))
    add("select", ("spec", {}))
    add("map", ("code", {}))
    add("explode", ("field", {}), ("--as", {"dest": "as_"}), ("--index-as", {}))
    add("sort", ("by", {}), ("--desc", {"action": "store_true"}))
    add("head", n)
    add("tail", n)
    add("skip", n)
    add("slice", ("bounds", {}))
    pairs = {"action": "append", "default": [], "metavar": "NAME:VALUE"}
    add("clean", ("--strip", {"action": "store_true"}), ("--drop-empty", {"nargs": "?", "const": True}), *((f"--{o}", pairs) for o in ("min-len", "max-len", "min-tokens", "max-tokens", "promote", "rename", "add", "fill")), *((f"--{o}", {}) for o in ("keep", "drop", "reorder")))
    add("eval", ("--label", {}), ("--pred", {"required": True}), ("--report", {}))
    add("sample", n, ("--by", {}), ("--seed", {"type": int, "default": 42}))
    add("shuffle", ("--seed", {"type": int, "default": 42}))
    add("group", ("by", {}), ("--agg", {}), ("--top", {"type": int}))
    add("join", ("right", {}), ("--on", {}), ("--left-on", {}), ("--right-on", {}), ("--how", {"default": "left"}), ("--prefix", {"default": ""}))
    add("dedupe", ("--key", {}), ("--similar", {"type": float}))
    add("concat", ("others", {"nargs": "+"}), ("--strict", {"action": "store_true"}))
    add("diff", ("other", {}), ("--key", {}))
    add("transform", ("preset", {}))
    add("export", ("target", {}))
    add("split", ("--ratio", {"default": "0.8"}), ("--seed", {"type": int, "default": 42}))
    add("stats")
    add("profile")
    add("describe", ("exprs", {"nargs": "+"}))
    add("token-stats", ("fields", {"nargs": "+"}))
    add("validate", ("schema", {"choices": sorted(SCHEMAS)}))
    run = sub.add_parser("run")
    run.add_argument("pipeline")
    run.add_argument("--input")
    run.add_argument("-o", "--output")
    return p


def execute(spark, args: argparse.Namespace):
    """The DataFrame (or list of them) that a command stands for."""
    from .operators import aggregate

    by = [c for c in args.order.split(",") if c]
    d = Dataset(read_stream(spark, sys.stdin.buffer), by) if args.input == "-" else Dataset.load(spark, args.input, by)
    load = lambda path: Dataset.load(spark, path)
    match args.command:
        case "filter":
            for w in args.where:
                d = d.filter(w)
            return d.df
        case "select":
            return d.select(args.spec).df
        case "map":
            return d.map(args.code).df
        case "explode":
            return d.explode(args.field, args.as_, args.index_as).df
        case "sort":
            return d.sort(args.by, args.desc).df
        case "clean":
            from .operators.rows import parse_options

            maps = {o: parse_options(got) for o in ("min_len", "max_len", "min_tokens", "max_tokens", "promote", "rename", "add", "fill") if (got := getattr(args, o))}
            lists = {o: [x.strip() for x in got.split(",")] for o in ("keep", "drop", "reorder") if (got := getattr(args, o))}
            empty = args.drop_empty if args.drop_empty in (True, None) else args.drop_empty.split(",")
            return d.clean(strip_text=args.strip, drop_empty=empty or False, **maps, **lists).df
        case "eval":
            from .plans.export import export_eval, label_column

            label = args.label or label_column(d.df.schema)
            if label is None:
                raise ExprError("no column of a usual name holds the labels: name it by --label")
            rows = d.df.selectExpr("*", f"{label} AS _label")
            if args.report:
                export_eval(rows, "_label", args.pred, args.report)
            return aggregate.class_metrics(rows, "_label", args.pred)
        case "head" | "tail" | "skip":
            return getattr(d, args.command)(args.n).df
        case "slice":
            a, _, b = args.bounds.partition(":")
            return d.slice(int(a) if a else None, int(b) if b else None).df
        case "sample":
            return d.sample(args.n, args.seed, args.by).df
        case "shuffle":
            return d.shuffle(args.seed).df
        case "group":
            return d.group(args.by, args.agg, args.top)
        case "join":
            return d.join(load(args.right), args.on, left_on=args.left_on, right_on=args.right_on, how=args.how, prefix=args.prefix).df
        case "dedupe":
            return (d.dedupe_similar(args.key, args.similar) if args.similar else d.dedupe(args.key.split(",") if args.key else None)).df
        case "concat":
            return d.concat(*map(load, args.others), strict=args.strict).df
        case "diff":
            other = load(args.other)
            return sets.diff_rows(d._rows, other._rows, args.key, d.order, other.order) if args.key else sets.diff(d.df, other.df)
        case "transform":
            return d.transform(args.preset).df
        case "export":
            return d.convert(args.target).df
        case "split":
            from .operators.order import ratios, split

            return split(d._rows, ratios(args.ratio), d.order, args.seed).drop(ORDINAL)
        case "stats":
            return d.stats()
        case "profile":
            return d.profile()
        case "describe":
            return d.describe(*args.exprs)
        case "token-stats":
            return aggregate.distribution(d.count_tokens(args.fields, "_n").df, "_n")
        case "validate":
            return validate.report(d.df, SCHEMAS[args.schema]())
    raise ValueError(args.command)


def main(argv: list[str] | None = None, spark=None, out=sys.stdout) -> int:
    from .sources.files import emit, save

    args = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("trainframe").getOrCreate()
    try:
        if args.command == "run":
            from .plans.pipeline import run

            run(spark, args.pipeline, args.input, args.output)
            return OK
        df = execute(spark, args)
        if args.output:
            save(df, args.output)
        else:
            emit(df, out)
        if args.command == "validate" and df.first()["invalid"]:
            return INVALID
        return OK
    except (ExprError, PathError) as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return USAGE
    except Exception as e:
        missing = "PATH_NOT_FOUND" in str(e)
        print(json.dumps({"error": str(e).splitlines()[0]}), file=sys.stderr)
        return MISSING if missing else FAILED


if __name__ == "__main__":
    sys.exit(main())
