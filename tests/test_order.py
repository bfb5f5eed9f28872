"""Ranks, cuts and splits on rows in random order with payload columns, and the order of files as the default."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from trainframe import cli
from trainframe.dataset import Dataset
from trainframe.operators import order


@pytest.fixture(scope="module")
def many(spark):
    """400,000 rows in random order of their key, over many partitions, with columns besides."""
    x = spark.range(0, 400_000, 1, 23).withColumn("key", F.xxhash64("id")).withColumn("text", F.repeat(F.lit("x"), 50))
    return x.repartition(11, F.xxhash64(F.col("id") * 7))


def test_ranks_are_each_place_once(many):
    ranked = order.ranked_rows(many, [F.col("key")], "_rank")
    n, least, most, distinct = ranked.agg(F.count("*"), F.min("_rank"), F.max("_rank"), F.count_distinct("_rank")).first()
    assert (n, least, most, distinct) == (400_000, 0, 399_999, 400_000)
    # a rank is the number of lesser keys: neighbours by rank are neighbours by key
    some = {r["_rank"]: r.key for r in ranked.where("_rank between 199990 and 200010").select("_rank", "key").collect()}
    keys = sorted(r.key for r in many.select("key").collect())
    assert all(keys[k] == v for k, v in some.items()) and len(some) == 21


@pytest.mark.parametrize("seed", [42, None])
def test_parts_are_exact_and_disjoint_however_they_are_read(many, seed):
    whole = order.split(many, [0.5, 0.3, 0.2], ["key"], seed)
    seen: set[int] = set()
    for name, size, columns in (("train", 200_000, ["id"]), ("val", 120_000, ["id", "text"]), ("test", 80_000, ["id", "key"])):
        ids = {r.id for r in whole.where(F.col("split") == name).select(*columns).collect()}
        assert len(ids) == size and not ids & seen
        seen |= ids
    assert len(seen) == 400_000


def test_rows_that_share_all_order_columns_are_dealt_one_by_one(spark):
    x = spark.createDataFrame([(k % 3, k) for k in range(100)], "key long, id long").repartition(4)
    got = {r.split: r["count"] for r in order.split(x, [0.5, 0.5], ["key"]).groupBy("split").count().collect()}
    assert got == {"train": 50, "test": 50}
    assert order.skip(x, 10, ["key"]).count() == 90 and order.slice_rows(x, 5, 50, ["key"]).count() == 45


def test_slices_and_samples(many, spark):
    keys = sorted(r.key for r in many.select("key").collect())
    assert [r.key for r in order.slice_rows(many, 1000, 1010, ["key"]).collect()] == keys[1000:1010]
    assert [r.key for r in order.slice_rows(many, -3, None, ["key"]).collect()] == keys[-3:]
    assert [r.key for r in order.skip(many, 399_995, ["key"]).collect()] == keys[399_995:]
    assert order.skip(many, 400_000, ["key"]).count() == 0 == order.slice_rows(many, 7, 7, ["key"]).count()
    a, b = ({r.id for r in order.sample(many, 150_000, ["key"], seed=s).collect()} for s in (1, 2))
    assert len(a) == len(b) == 150_000 and a != b and a == {r.id for r in order.sample(many, 150_000, ["key"], seed=1).collect()}
    nulls = spark.createDataFrame([(None, 0), (5, 1), (3, 2), (9, 3)], "key long, id long")
    assert [r.id for r in order.skip(nulls, 1, ["key"]).collect()] == [2, 1, 3]


def test_stratified_sample_of_a_hot_group(many):
    x = many.withColumn("g", F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 5).cast("string")))
    got = order.stratified_sample(x, "g", 600, ["key"], uniform=True)
    assert got.columns == x.columns and {r.g: r["count"] for r in got.groupBy("g").count().collect()} == dict.fromkeys("01234", 100) | {"hot": 100}
    first = {r.key for r in order.stratified_sample(x, "g", 600, ["key"], uniform=True, how="head").where("g = 'hot'").collect()}
    assert first == set(sorted(r.key for r in x.where("g = 'hot'").collect())[:100])


@pytest.fixture
def lines(tmp_path):
    """JSON lines whose first column is in no order, some of them twice."""
    r = random.Random(1)
    rows = [{"a": r.randint(0, 99), "text": f"t{k % 70}", "n": k} for k in range(100)]
    (tmp_path / "x.jsonl").write_text("".join(json.dumps(x) + "\n" for x in rows))
    return str(tmp_path / "x.jsonl"), rows


def test_file_order_is_the_default(spark, lines):
    path, rows = lines
    d = Dataset.load(spark, path)
    n = lambda x: [r["n"] for r in x.collect()]
    assert n(d.head(3)) == [0, 1, 2] and n(d.tail(2)) == [98, 99] and n(d.skip(97)) == [97, 98, 99]
    assert n(d.slice(10, 13)) == [10, 11, 12] and n(d.slice(-2)) == [98, 99]
    assert sorted(n(d.dedupe("text"))) == list(range(70))
    assert n(d.filter("x.n >= 50").head(2)) == [50, 51]
    assert "_rid" not in d.df.columns and "_rid" not in d.select("n").df.columns and d.select("n, text").dedupe("text").head(1).collect() == [{"n": 0, "text": "t0"}]
    assert n(d.map(lambda row: {"n": row["n"] + 1}, "n long").head(2)) == [1, 2]
    assert n(d.flat_map(lambda row: [{"n": row["n"]}, {"n": -1}], "n long").head(3)) == [0, -1, 1]
    assert n(d.concat(Dataset.load(spark, path)).tail(1)) == [99] and d.concat(Dataset.load(spark, path)).dedupe("n").count() == 100
    best = sorted(rows, key=lambda x: (-x["a"], x["n"]))
    assert n(d.sort("x.a", desc=True).head(4)) == [x["n"] for x in best[:4]] and n(d.sort("x.a", desc=True)) == [x["n"] for x in best]
    mixed = n(d.shuffle(3))
    assert sorted(mixed) == list(range(100)) != mixed and n(d.shuffle(3).head(5)) == mixed[:5]
    train, test = d.split(0.8, seed=None)
    assert sorted(n(train)) == list(range(80)) and sorted(n(test)) == list(range(80, 100)) and "_rid" not in train.df.columns
    assert n(d.transform("simple_qa")) == [] and d.filter("search(x, 'x.jsonl')").count() == 0


def test_command_line_keeps_line_order(spark, lines):
    path, rows = lines
    for args, want in ((["head", "-n", "2"], [0, 1]), (["tail", "-n", "1"], [99]), (["dedupe", "--key", "text"], list(range(70))), (["slice", "4:6"], [4, 5])):
        out = io.StringIO()
        assert cli.main([args[0], path, *args[1:]], spark, out) == 0
        got = [json.loads(x) for x in out.getvalue().splitlines()]
        assert sorted(x["n"] for x in got) == want and all(set(x) == {"a", "text", "n"} for x in got)
