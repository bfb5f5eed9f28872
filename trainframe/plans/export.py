"""Data and configuration files for training frameworks, and reports of evaluations."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import aggregate, presets
from ..sources.files import save


def export_for(df: DataFrame, framework: str, folder: str, name: str = "dataset", model: str = "base-model") -> list[str]:
    """Convert, write ``data`` and the framework's configuration in ``folder``; returns the files' names."""
    ok = presets.check_compatibility(df, framework)
    if not ok.valid:
        raise ValueError("; ".join(ok.errors))
    convert = {"llama-factory": presets.to_llama_factory, "swift": presets.to_swift_messages, "axolotl": presets.to_axolotl}[framework]
    save(convert(df), f"{folder}/data", "jsonl")
    if framework == "llama-factory":
        configs = {
            "dataset_info.json": json.dumps({name: {"file_name": "data", "columns": {"prompt": "instruction", "query": "input", "response": "output", "system": "system", "history": "history"}}}, indent=1),
            "train_args.yaml": f"model_name_or_path: {model}\nstage: sft\nfinetuning_type: lora\ndataset: {name}\ntemplate: default\noutput_dir: out\n",
        }
    elif framework == "swift":
        configs = {"train.sh": f"#!/bin/sh\nswift sft --model {model} --dataset data --train_type lora --output_dir out\n"}
    else:
        configs = {"config.yaml": f"base_model: {model}\ndatasets:\n  - path: data\n    type: chat_template\n    field_messages: conversations\nadapter: lora\noutput_dir: out\n"}
    for file, text in configs.items():
        Path(folder, file).write_text(text, encoding="utf-8")
    return ["data", *configs]


#: Names of columns that hold the true class, the likeliest first.
LABELS = ("label", "labels", "content_label", "target", "ground_truth", "answer")


def label_column(schema: T.StructType) -> str | None:
    """The first column of a usual name, at the top or else within a struct, as a path."""
    for name in LABELS:
        if name in schema.names:
            return name
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType) and (found := [n for n in LABELS if n in f.dataType.names]):
            return f"{f.name}.{found[0]}"
    return None


def export_eval(df: DataFrame, label: str, pred: str, folder: str) -> str:
    """results, bad cases and metrics.md below ``folder``; returns the report."""
    m = aggregate.overall_metrics(df, label, pred).first()
    lines = ["# Evaluation", "", f"{m['n'] or 0} rows", "", "| metric | value |", "| --- | --- |"]
    lines += [f"| {k} | {m[k] or 0:.4f} |" for k in ("accuracy", "precision", "recall", "f1")]
    lines += ["", "| label | precision | recall | f1 | support |", "| --- | --- | --- | --- | --- |"]
    for r in aggregate.class_metrics(df, label, pred).orderBy("label").toLocalIterator():
        lines.append(f"| {r.label} | {r.precision:.4f} | {r.recall:.4f} | {r.f1:.4f} | {r.support} |")
    save(df, f"{folder}/result", "jsonl")
    save(df.where(~F.col(label).eqNullSafe(F.col(pred))), f"{folder}/bad_case", "jsonl")
    text = "\n".join(lines) + "\n"
    Path(folder, "metrics.md").write_text(text, encoding="utf-8")
    return text
