"""Commands that clean, skip and evaluate, rows from a stream, and output over its own input."""

import gzip
import io
import json

from trainframe import cli
from trainframe.sources import files


def run(spark, *args):
    out = io.StringIO()
    code = cli.main(list(args), spark, out)
    return code, [json.loads(x) for x in out.getvalue().splitlines()]


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_clean_and_skip(spark, tmp_path):
    x = write(tmp_path / "x.jsonl", [{"t": " one two three ", "k": "a"}, {"t": "one", "k": None}, {"t": "  ", "k": "b"}, {"t": "a b c d e f", "k": "c"}])
    code, got = run(spark, "clean", x, "--strip", "--drop-empty", "t", "--min-tokens", "t:2", "--max-tokens", "t:4", "--rename", "k:kind", "--fill", "kind:none")
    assert code == 0 and got == [{"kind": "a", "t": "one two three"}]
    assert [r["k"] for r in run(spark, "skip", x, "-n", "2")[1]] == ["b", "c"]
    assert run(spark, "clean", x, "--drop-empty", "k", "--keep", "k")[1] == [{"k": "a"}, {"k": "b"}, {"k": "c"}]


def test_eval_finds_the_label(spark, tmp_path):
    rows = [{"meta": {"target": str(k)}, "pred": str(k // 2)} for k in range(1200)]
    code, got = run(spark, "eval", write(tmp_path / "e.jsonl", rows), "--pred", "pred", "--report", str(tmp_path))
    assert code == 0 and len(got) == 1200
    assert (tmp_path / "metrics.md").read_text().count("\n| ") > 1200  # every label has a line
    assert run(spark, "eval", write(tmp_path / "n.jsonl", [{"pred": "1"}]), "--pred", "pred")[0] == cli.USAGE


def test_streams(spark):
    data = b'{"a": 1}\n\n{"a": 2}\n'
    for raw in (data, gzip.compress(data)):
        assert sorted(r.a for r in files.read_stream(spark, io.BufferedReader(io.BytesIO(raw))).collect()) == [1, 2]


def test_output_over_its_own_input(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    files.save(spark.range(10), path)
    files.save(files.load(spark, path).where("id > 3"), path)
    assert sorted(r.id for r in files.load(spark, path).collect()) == [4, 5, 6, 7, 8, 9]
    assert [p.name for p in tmp_path.iterdir() if "new-" in p.name] == []
