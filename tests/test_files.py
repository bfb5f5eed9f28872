"""Files, pipelines, lineage, streams and the command line."""

import gzip
import io
import json

import pytest

from trainframe import cli
from trainframe.dataset import Dataset
from trainframe.operators import validate
from trainframe.plans import lineage, pipeline
from trainframe.sources import files
from trainframe.streaming import follow, operators

RECORDS = [{"id": k, "text": f"row {k} é", "tags": ["a"] * (k % 3), "meta": {"n": k, "s": None}} for k in range(12)]


@pytest.fixture
def jsonl(tmp_path):
    path = tmp_path / "data.jsonl"
    path.write_text("\n\n".join(json.dumps(r) for r in RECORDS) + "\n")
    return str(path)


def test_formats_by_name():
    got = {p: files.detect_file_format(p) for p in ("a.jsonl.gz", "a.TSV", "b/c.parquet", "x.unknown", "folder", "a.feather", "a.json")}
    assert got == {"a.jsonl.gz": "jsonl", "a.TSV": "tsv", "b/c.parquet": "parquet", "x.unknown": "jsonl", "folder": "parquet", "a.feather": "arrow", "a.json": "json"}


@pytest.mark.parametrize("name", ["x.jsonl", "x.jsonl.gz", "x.json", "x.parquet", "x.arrow", "x.orc"])
def test_round_trip(spark, jsonl, tmp_path, name):
    df = files.load(spark, jsonl, schema="id long, text string, tags array<string>, meta struct<n:long,s:string>")
    path = str(tmp_path / name)
    files.save(df, path)
    files.save(df, path)  # a second time replaces
    fmt = files.detect_file_format(path)
    back = spark.read.schema(df.schema).json(path) if fmt in ("jsonl", "json") else files.load(spark, path)
    key = lambda r: r["id"]
    assert sorted((r.asDict(True) for r in back.collect()), key=key) == RECORDS
    if fmt == "jsonl":
        assert files.count_rows(spark, path) == 12


@pytest.mark.parametrize("name", ["x.csv", "x.tsv"])
def test_tables_hold_json_in_cells(spark, jsonl, tmp_path, name):
    df = files.load(spark, jsonl).select("id", "text", "tags")
    path = str(tmp_path / name)
    files.save(df, path)
    back = files.load(spark, path)
    assert dict(back.dtypes)["tags"] == "variant" and back.count() == 12
    assert {r.text for r in back.collect()} == {r["text"] for r in RECORDS}
    assert dict(files.load(spark, path, decode=False).dtypes)["tags"] == "string"


def test_bad_lines(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    path.write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        files.read_jsonl(spark, str(path), schema="a long").collect()
    assert [r.a for r in files.read_jsonl(spark, str(path), "skip", "a long").collect() if r.a] == [1, 2]
    kept = files.read_jsonl(spark, str(path), "keep", "a long")
    assert sorted(r._raw_line for r in kept.collect() if r._raw_line) == ["not json"]
    exact = files.read_exact(spark, str(path))
    assert [r._raw for r in exact.collect()] == ['{"a": 1}', "not json", '{"a": 2}']
    assert files.count_rows(spark, str(path)) == 3
    with pytest.raises(files.BadRecord, match="line 2"):
        files.from_lines(spark, ['{"a": 1}', "{"])
    assert [r.a for r in files.from_lines(spark, ['{"a": 1}', ""]).collect()] == [1]


def test_compressed_and_exact_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl.gz"
    lines = ['{"a": 1,   "b": null}', '{"c": [1, {"d": "é"}]}']
    path.write_bytes(gzip.compress("\n".join(lines).encode()))
    files.save(files.read_exact(spark, str(path)), str(tmp_path / "out.jsonl"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out.jsonl")).collect()] == lines


def test_shards_and_appends(spark, tmp_path):
    df = spark.range(25).withColumnRenamed("id", "n")
    files.save_sharded(df, str(tmp_path / "s"), 10, ["n"])
    got = {p.name: sorted(json.loads(x)["n"] for f in p.glob("part*") for x in f.read_text().split()) for p in (tmp_path / "s").glob("shard=*")}
    assert got == {"shard=00000": list(range(10)), "shard=00001": list(range(10, 20)), "shard=00002": list(range(20, 25))}
    for _ in range(2):
        files.append(df, str(tmp_path / "a.jsonl"))
    assert files.count_rows(spark, str(tmp_path / "a.jsonl")) == 50
    assert [len(b) for b in files.batches(df, 10)] == [10, 10, 5]
    files.save(df, str(tmp_path / "p.parquet"))
    assert len({r._rid for r in files.with_ordinal(files.load(spark, str(tmp_path / "p.parquet"))).collect()}) == 25


SPEC = """
version: 1
order: [id]
steps:
  - {type: filter, where: "x.id > 1"}
  - {type: map, code: "x.size = len(x.text)"}
  - {type: dedupe, key: [size]}
  - {type: select, spec: "id, size, n=x.meta.n"}
"""


def test_pipelines(spark, jsonl, tmp_path):
    import yaml

    spec = yaml.safe_load(SPEC)
    got = pipeline.build(files.load(spark, jsonl), spec)
    assert sorted((r.id, r.n) for r in got.collect()) == [(2, 2), (10, 10)]
    steps = [{"type": "nope"}, {"type": "filter"}, {"type": "head", "num": 1, "odd": 2}, {"type": "split", "ratio": 0.5}, {"type": "filter", "where": "x.a >"}, {"type": "join", "with": "f", True: "x.a", "left_on": "x.b"}]
    errors = pipeline.validate({"steps": steps})
    assert len(errors) == 6 and pipeline.validate({}) == ["there are no steps"]
    with pytest.raises(pipeline.PipelineError):
        pipeline.build(files.load(spark, jsonl), {"steps": steps})
    with pytest.raises(pipeline.PipelineError, match="order"):
        pipeline.build(files.load(spark, jsonl), {"steps": [{"type": "head", "num": 1}]})
    path = tmp_path / "p.yaml"
    path.write_text(SPEC + "  - {type: split, ratio: '0.5,0.5'}\n")
    pipeline.run(spark, str(path), jsonl, str(tmp_path / "out"))
    assert [files.count_rows(spark, str(tmp_path / "out" / n), "jsonl") for n in ("train", "test")] == [1, 1]
    assert not pipeline.validate(yaml.safe_load(pipeline.template(["a", "b"])))


def test_dataset_and_lineage(spark, jsonl, tmp_path):
    d = Dataset.load(spark, jsonl, track=True).filter("x.id % 2 == 0").select("id, text")
    out = str(tmp_path / "o.parquet")
    d.save(out)
    assert [(s.operation, s.rows_out) for s in d.lineage.steps] == [("filter", 6), ("select", 6)]
    again = lineage.Lineage.from_json(d.lineage.to_json())
    assert again.steps == d.lineage.steps and "1. filter" in again.report()
    d = Dataset.load(spark, jsonl)
    assert [r["id"] for r in d.filter(lambda r: r["id"] < 3).sort("x.id", desc=True).collect()] == [2, 1, 0]
    assert [p.count() for p in d.split([0.5, 0.25, 0.25])] == [6, 3, 3]
    assert (d + d).count() == 24 and (d + d).dedupe("text").count() == 12 and len(d.collect(5)) == 5
    assert d.flat_map(lambda r: [{"t": t} for t in r["tags"]], "t string").count() == 12
    assert d.join(d.select("id, twice=x.id * 2"), "x.id").collect(1)[0]["twice"] == 0
    assert d.validate(validate.Schema({"tags": validate.Field("list", min_length=1)}), "filter").count() == 8
    with pytest.raises(ValueError, match="invalid"):
        d.validate(validate.Schema({"nope": validate.Field()}), "raise")


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    df = spark.createDataFrame([(k % 3, f"2024-01-01 00:0{k}:00") for k in range(6)], "k long, t string").selectExpr("k", "cast(t as timestamp) as ts")
    df.write.parquet(str(folder))
    stream = spark.readStream.schema(df.schema).parquet(str(folder))
    assert sorted(r.k for r in operators.drain(operators.dedupe_stream(stream, ["k"], "ts"), f"file://{tmp_path}/a").collect()) == [0, 1, 2]
    counts = operators.drain(operators.windowed_counts(stream, "ts", ["k"], "2 minutes", late="0 seconds"), f"file://{tmp_path}/b")
    assert sum(r.n for r in counts.collect()) >= 2
    for op in ("sort", "tail", "split", "sample"):
        with pytest.raises(operators.NotOnStreams):
            operators.check(stream, op)
    with pytest.raises(operators.NotOnStreams):
        Dataset(stream).sort("x.k")
    q = operators.keep_last(stream, 2, str(tmp_path / "last"), ["ts"]).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "last" / "0")).collect()) == [1, 2]


def test_follow(tmp_path):
    path = tmp_path / "log.jsonl"
    r = follow.FollowReader({"path": str(path)})
    at = r.initialOffset()
    rows, at = r.read(at)
    assert list(rows) == []
    path.write_text('{"a": 1}\nbroken\n{"half": ')
    rows, at = r.read(at)
    rows = list(rows)
    assert [x[0] for x in rows] == ['{"a": 1}', "broken"] and rows[0][1] is None and rows[1][1]
    begin = dict(at)
    with path.open("a") as f:
        f.write("2}\n")
    rows, at = r.read(at)
    assert [x[0] for x in rows] == ['{"half": 2}'] and [x[0] for x in r.readBetweenOffsets(begin, at)] == ['{"half": 2}']
    path.write_text('{"n": 0}\n')  # cut back: a new generation, read from the start
    rows, at = r.read(at)
    assert [x[0] for x in rows] == ['{"n": 0}'] and at["generation"] == 1


def test_command_line(spark, jsonl, tmp_path, capsys):
    def run(*args):
        out = io.StringIO()
        code = cli.main([str(a) for a in args], spark, out)
        return code, [json.loads(x) for x in out.getvalue().splitlines()]

    assert run("filter", jsonl, "x.id > 9") == (0, [r for r in RECORDS if r["id"] > 9])
    assert [r["id"] for r in run("slice", "--order", "id", "--", jsonl, "-3:-1")[1]] == [9, 10]
    assert run("stats", jsonl)[1][0]["count"] == 12
    assert len(run("explode", jsonl, "tags", "--as", "tag")[1]) == 12
    assert run("group", jsonl, "len(x.tags)")[1][0] == {"key": 0, "count": 4, "pct": 0.3333}
    assert run("dedupe", jsonl, "--key", "tags", "--order", "id")[0] == 0
    assert run("diff", jsonl, jsonl, "--order", "id")[1] == [{"added": 0, "removed": 0, "unchanged": 12}]
    assert run("filter", jsonl, "x.id >")[0] == cli.USAGE
    assert run("head", str(tmp_path / "none.jsonl"))[0] == cli.MISSING
    assert run("validate", jsonl, "alpaca")[0] == cli.INVALID
    assert run("select", jsonl, "id", "-o", tmp_path / "o.jsonl")[0] == 0 and files.count_rows(spark, str(tmp_path / "o.jsonl")) == 12
    capsys.readouterr()
