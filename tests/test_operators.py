"""Operators on small rows: cleaning, joins, groups, order, samples, duplicates, sets and validation."""

import random

import pytest
from pyspark.sql import functions as F

from trainframe.operators import aggregate, dedupe, joins, order, rows, sets, validate


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_explode(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id long, tags array<string>")
    assert table(rows.explode_rows(df, "tags", "tag", "k")) == [(1, "a", 0), (1, "b", 1), (3, None, None)]
    assert rows.explode_rows(df, "nope").columns == ["id", "tags"]
    assert table(rows.explode_rows(df, "id", "n").select("n")) == [(1,), (2,), (3,)]


def test_clean(spark):
    df = spark.createDataFrame([(" a ", 1.0, "x"), ("", None, None), ("abcdef", 0.0, ""), ("\t", 2.0, "y")], "text string, score double, cat string")
    assert [r.text for r in rows.clean(df, strip_text=True).collect()] == ["a", "", "abcdef", ""]
    assert table(rows.clean(df, drop_empty=True)) == [(" a ", 1.0, "x")]
    assert rows.clean(df, drop_empty=["score"]).count() == 3  # zero is a value
    assert table(rows.clean(df, min_len={"text": 1}, max_len={"text": 3}, keep=["text"])) == [("\t",), (" a ",)]
    assert rows.clean(df, rename={"text": "score", "score": "text"}).columns == ["score", "text", "cat"]
    with pytest.raises(ValueError, match="would be called"):
        rows.clean(df, rename={"text": "score"})
    assert {r.cat for r in rows.clean(df, fill={"cat": "none"}).collect()} == {"x", "none", "y"}
    assert rows.clean(df, add={"v": "1"}, reorder=["v", "cat"]).columns == ["v", "cat", "text", "score"]
    assert rows.parse_options("a:1,b:2") == {"a": "1", "b": "2"}
    for bad in ("a:1,a:2", "a", ":x"):
        with pytest.raises(ValueError):
            rows.parse_options(bad)


def test_python_rows(spark):
    df = spark.createDataFrame([(1,), (0,), (5,)], "n long").coalesce(1)
    f = lambda r: {"n": 10 // int(r["n"])}
    assert table(rows.map_python(df, f, "n long", "skip")) == [(10,), (2,)]
    assert table(rows.map_python(df, f, "n long", "null")) == [(10,), (2,), (None,)]
    assert table(rows.map_python(df, f, "n long", "keep")) == [(0,), (10,), (2,)]
    with pytest.raises(Exception, match="ZeroDivisionError"):
        rows.map_python(df, f, "n long").collect()
    assert table(rows.filter_python(df, lambda r: r["n"] > 0)) == [(1,), (5,)]


def test_joins(spark):
    left = spark.createDataFrame([(1, "a", None), (2, None, "keep"), (3, "zz", "l"), (4, "b", "l")], "id long, k string, v string")
    right = spark.createDataFrame([("b", "r2", 2), ("a", "r1", 1), ("b", "r0", 0), (None, "rn", 9)], "k string, v string, n int")
    assert table(joins.join_rows(left, right, "x.k", order=["n"])) == [(1, "a", None, 1), (2, None, "keep", 9), (3, "zz", "l", None), (4, "b", "l", 0)]
    assert table(joins.join_rows(left, right, "x.k", how="inner", prefix="r_", order=["n"]).select("id", "r_v")) == [(1, "r1"), (2, "rn"), (4, "r0")]
    assert table(joins.join_rows(left, right, "x.k", how="anti").select("id")) == [(3,)]
    assert joins.duplicates(right, "x.k").first().ignored == 1
    # a key that fails on the left matches nothing, on the right it ends the query
    assert table(joins.join_rows(left, right, left_on="x.k[1]", right_on="x.k", how="anti").select("id")) == [(1,), (2,), (3,), (4,)]
    with pytest.raises(Exception, match="key fails"):
        joins.join_rows(left, right, left_on="x.k", right_on="x.k[1]", how="inner").collect()
    for bad in ({}, {"on": "x.k", "left_on": "x.k"}, {"left_on": "x.k"}, {"on": "x.k", "how": "outer"}):
        with pytest.raises(ValueError):
            joins.join_rows(left, right, **bad)
    with pytest.raises(ValueError, match="rows on the left"):
        joins.merge_positions(left, right.limit(2), ["id"], ["n"])


def test_join_of_a_hot_key(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    right = left.select("k", F.col("id").alias("n"))
    got = joins.join_rows(left, right, "x.k", order=["n"])
    assert got.count() == 5000 and {r.n for r in got.where("k = 'hot'").select("n").distinct().collect()} == {1}


def test_groups(spark):
    df = spark.createDataFrame([(1, "b", 1.0, 3), (2, "a", None, 4), (3, "b", 5.0, 5), (4, None, 2.0, 1)], "id long, k string, v double, n long")
    assert [tuple(r) for r in aggregate.group_count(df, "x.k", ["id"]).collect()] == [("b", 2, 0.5), ("a", 1, 0.25), (None, 1, 0.25)]
    got = aggregate.group_agg(df, "x.k", "total=sum(r.n for r in g), mean=sum(r.v for r in g) / n, most=max(r.n for r in g), big=len([r.n for r in g if r.n > 3]), list=[r.n for r in g][:1]", ["id"]).collect()
    assert [(r.key, r.n, r.total, r["mean"], r.most, r.big, r.list) for r in got] == [("b", 2, 8, 3.0, 5, 1, [3]), ("a", 1, 4, None, 4, 1, [4]), (None, 1, 1, 2.0, 1, 0, [1])]
    assert [r.key for r in aggregate.group_agg(df, "x.k", "t=sum(r.n for r in g)", ["id"], top=1).collect()] == ["b"]
    hist = aggregate.histogram(df, "x.n", 10).orderBy("bin").collect()
    assert [(r.lo, r["count"]) for r in hist] == [(1.0, 1), (2.0, 0), (3.0, 1), (4.0, 1), (5.0, 1)]
    assert aggregate.histogram(df.where("id < 0"), "x.n").count() == 0
    d = aggregate.describe(df, ["x.v", "1 / (x.n - 1)"]).collect()
    assert (d[0].n, d[0].nulls, d[0].p50) == (3, 1, 2.0) and (d[1].n, d[1].nulls) == (3, 1)
    c = {r.label: r for r in aggregate.class_metrics(df.select(F.col("k"), F.lit("b").alias("p")), "k", "p").collect()}
    assert (c["b"].precision, c["b"].recall, c["a"].recall, c["null"].support) == (0.5, 1.0, 0.0, 1)


def test_order_and_limits(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(["b", None, "a", "b", "c"])], "id long, s string")
    ids = lambda d: [r.id for r in d.collect()]
    assert ids(order.sort_rows(df, "x.s", ["id"])) == [2, 0, 3, 4, 1]
    assert ids(order.sort_rows(df, "x.s", ["id"], desc=True)) == [4, 0, 3, 2, 1]
    assert ids(order.sort_rows(df, "(len(x.s), -x.id)", ["id"])) == [4, 3, 2, 0, 1]
    assert ids(order.head(df, 2, ["id"])) == [0, 1] and ids(order.tail(df, 2, ["id"])) == [3, 4] and ids(order.skip(df, 3, ["id"])) == [3, 4]
    for a, b in ((1, 3), (-2, None), (None, -1), (-3, -1), (3, 1), (0, 99), (None, None)):
        assert ids(order.slice_rows(df, a, b, ["id"])) == list(range(5))[a:b]
    mixed = spark.createDataFrame([(1, "10"), (2, "9"), (3, "x"), (4, None)], "id long, s string")
    assert ids(order.browse_sort(mixed, "s", ["id"]))[:2] == [2, 1]
    assert sorted(ids(order.shuffle(df, ["id"]))) == list(range(5)) and ids(order.shuffle(df, ["id"], 1)) == ids(order.shuffle(df.repartition(3), ["id"], 1))


def test_samples_and_splits(spark):
    df = spark.createDataFrame([(k, "abc"[k % 7 % 3]) for k in range(100)], "id long, g string").repartition(3)
    s = order.sample(df, 10, ["id"], 5)
    assert s.count() == 10 and table(s) == table(order.sample(df.repartition(1), 10, ["id"], 5)) != table(order.sample(df, 10, ["id"], 6))
    by = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    for kw in ({}, {"uniform": True}, {"shares": {"a": 0.5, "b": 0.5}}):
        got = {r.g: r["count"] for r in order.stratified_sample(df, "g", 20, ["id"], **kw).groupBy("g").count().collect()}
        assert got == order.quotas(dict(sorted(by.items())), 20, **kw) and sum(got.values()) == 20
    parts = order.split(df, [0.8, 0.1, 0.1], ["id"])
    assert {r.split: r["count"] for r in parts.groupBy("split").count().collect()} == {"train": 80, "val": 10, "test": 10}
    assert table(parts) == table(order.split(df.repartition(5), [0.8, 0.1, 0.1], ["id"]))
    assert order.ratios("0.7") == pytest.approx([0.7, 0.3])
    for bad in ("0.5,0.2", "0,1", "-1,2"):
        with pytest.raises(ValueError):
            order.ratios(bad)
    ranked = order.ranked_rows(df, [F.col("g"), -F.col("id")], "at").collect()
    assert [r["at"] for r in sorted(ranked, key=lambda r: (r.g, -r.id))] == list(range(100))


def test_exact_duplicates(spark):
    df = spark.createDataFrame([(3, "a", [1]), (1, "a", [1]), (2, None, None), (4, None, None), (5, "b", [1, 2])], "id long, t string, l array<int>")
    assert table(dedupe.dedupe(df, "t", ["id"]).select("id")) == [(1,), (2,), (5,)]
    assert table(dedupe.dedupe(df, None, ["id"]).select("id")) == [(1,), (2,), (5,)]
    assert table(dedupe.dedupe(df, ["l"], ["id"]).select("id")) == [(1,), (2,), (5,)]
    assert table(dedupe.duplicate_groups(df, "t")) == [("a", 2), (None, 2)]


def test_near_duplicates(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    r = random.Random(2)
    base = ["".join(r.choice("abcdefgh ") for _ in range(200)) for _ in range(6)]
    texts = base + [b[:-3] + "xyz" for b in base] + [base[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")

    def grams(t):
        return {t[i : i + 3] for i in range(max(len(t) - 2, 1))}

    def similar(a, b):
        return len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.8

    kept = []
    for k, t in enumerate(texts):
        if not any(similar(t, texts[j]) for j in kept):
            kept.append(k)
    assert [x[0] for x in table(dedupe.dedupe_similar(df, "t", "id", 0.8).select("id"))] == kept == list(range(6))
    pairs = {(x.a, x.b) for x in dedupe.similar_pairs(df, "t", "id").collect()}
    assert pairs == {(k, k + 6) for k in range(6)}


def test_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(2, 5.0), (3, None)], "id long, w double")
    both = sets.concat(a, b)
    assert table(both) == [(1, "x", None), (2, "y", None), (2, None, 5.0), (3, None, None)]
    with pytest.raises(sets.FieldMismatch):
        sets.concat(a, b, strict=True)
    c = spark.createDataFrame([(1, "x"), (2, "z"), (2, "z"), (4, None)], "id int, v string")
    assert tuple(sets.diff(a, c).first()) == (2, 1, 1)
    assert table(sets.diff_rows(a, c, "id", ["id"], ["id"])) == [(1, "unchanged"), (2, "modified"), (4, "added")]
    assert table(sets.diff_rows(c, a, "id", ["id"], ["id"]))[-1] == (4, "removed")
    assert sets.field_changes(a, b) == {"added": ["w"], "removed": ["v"], "common": ["id"]}


def test_validation(spark):
    rows_ = [([("user", "q"), ("assistant", "a")],), ([],), (None,), ([("boss", "q"), ("user", None)],)]
    df = spark.createDataFrame(rows_, "messages array<struct<role:string,content:string>>")
    schema = validate.openai_chat_schema()
    got = [[(e.path, e.message) for e in r._errors] for r in validate.with_errors(df.coalesce(1), schema).collect()]
    assert got[0] == [] and got[1] == [("messages", "is shorter than 1")] and got[2] == [("messages", "a value is required")]
    assert [p for p, _ in got[3]] == ["messages[0].role", "messages[1]"]
    assert tuple(validate.report(df, schema).first()) == (4, 1, 3, 0.25)
    assert validate.valid_rows(df, schema).count() == 1 and validate.invalid_rows(df, schema, 2).count() == 2
    own = validate.Schema({"messages": validate.Field("str"), "n": validate.Field("int", min=1), "m": validate.Field("int", required=False)})
    kinds = {e.message for r in validate.with_errors(df, own).collect() for e in r._errors}
    assert kinds == {"is not of type str", "a value is required"}
    custom = validate.Schema({"messages": validate.Field("list", custom=lambda c: F.size(c) != 2)})
    assert validate.invalid_rows(df.where("messages is not null"), custom).count() == 2


def test_schema_of_nested_rows(spark):
    """Rates are shares of the parents that are there; texts are listed where they are few."""
    schema = "a struct<b: string, c: array<struct<d: long, e: string>>>, t string"
    rows = [((("x"), [(1, "p"), (None, "q")]), f"t{k}") for k in range(3)] + [((None, []), "t3"), (None, None)]
    rows += [(None, f"u{k}") for k in range(15)]
    got = {r.path: (r.type, r.rate, r["values"]) for r in aggregate.infer_schema(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        "a": ("struct", 4 / 20, None), "t": ("string", 19 / 20, None), "a.b": ("string", 3 / 4, ["x"]), "a.c": ("array", 1.0, None),
        "a.c[]": ("struct", 1.0, None), "a.c[].d": ("long", 0.5, None), "a.c[].e": ("string", 1.0, ["p", "q"]),
    }
    assert aggregate.infer_schema(spark.createDataFrame([], schema)).count() == 7
