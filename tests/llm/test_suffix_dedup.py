"""Suffix dedup against a scan of all windows."""

import hashlib
import random

import numpy as np
import pytest

from trainframe.llm import suffix_dedup


def brute(docs, length=100):
    seen, out = set(), []
    for doc, text in docs:
        data = (text or "").encode()
        hit = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            x = data[i : i + length]
            hit[i : i + length] |= x in seen
            seen.add(x)
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8)]))
        kept = np.frombuffer(data, np.uint8)[~hit].tobytes()
        out.append((doc, len(data), int(hit.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé\n") for _ in range(r.randint(1, 7)))
    passage = " ".join(word() for _ in range(60))
    docs = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(r.randint(0, 60)))]
        for _ in range(r.randint(0, 3)):
            a = r.randint(0, len(passage) - 1)
            parts += [passage[a : a + r.randint(40, 200)], " ".join(word() for _ in range(r.randint(0, 9)))]
        docs.append((3 * k, "".join(parts)))
    docs += [(500, None), (501, ""), (502, "x" * 99), (503, "x" * 350), (504, "xy" * 300), (505, "x" * 120), (506, docs[3][1]), (507, docs[3][1] + "!"), (508, "é" * 80), (509, "é" * 80), (510, passage * 3)]
    return docs


@pytest.mark.parametrize("segment", [1 << 20, 512])
def test_equals_brute_force(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    docs = texts()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(x) for x in suffix_dedup.op9_suffix_dedup(spark, str(tmp_path)).collect())
    assert got == brute(docs)


def removed(spans, docs):
    out = {}
    for row, first, end in spans:
        out.setdefault(row, set()).update(range(first, end))
    return out


@pytest.mark.parametrize("length", [32, 40, 100, 130])
def test_plain_and_sampled_doubling(spark, length):
    """Both cover the same bytes: those that brute force removes."""
    docs = [(k, t) for k, t in texts() if t]
    df = spark.createDataFrame(docs, "row long, text string").repartition(3)
    want, seen = {}, set()
    for row, text in docs:
        data = text.encode()
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                want.setdefault(row, set()).update(range(i, i + length))
            seen.add(data[i : i + length])
    for find in (suffix_dedup.repeated_spans, suffix_dedup.plain_spans):
        assert removed([tuple(r) for r in find(df, length).collect()], docs) == want


@pytest.mark.parametrize("parts", [1, 7])
def test_sorted_ranks(spark, parts):
    """A class over several ranges has one rank and one first row."""
    r = random.Random(4)
    rows = [(r.choice([0, 0, 0, 0, 5, k]), r.randint(0, 1), k) for k in range(500)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "x long, y long, id long").repartition(4)
        got = suffix_dedup.sorted_ranks(df, ["x", "y"], ["id"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    classes = {}
    for x, y, k in rows:
        classes.setdefault((x, y), []).append(k)
    ranks = {}
    for g in got:
        same = classes[g.x, g.y]
        assert g.begins == (g.id == min(same)) and g.alone == (len(same) == 1)
        assert ranks.setdefault((g.x, g.y), g["rank"]) == g["rank"]
    assert len(got) == len(rows) and [ranks[k] for k in sorted(ranks)] == sorted(set(ranks.values()))


def test_segments_give_each_window_once():
    raw = np.frombuffer(bytes(random.Random(1).choices(range(97, 103), k=5000)), np.uint8)
    whole = suffix_dedup._runs_of(raw, np.array([0, 5000]), 100)
    assert whole[2].sum() == 4901
    at = np.array([0, 50, 50, 151, 2000, 2099, 5000])
    row, first, count = suffix_dedup._runs_of(raw, at, 100)[:3]
    windows = sorted((int(r), int(f) + k) for r, f, c in zip(row, first, count) for k in range(int(c)))
    assert windows == [(i, k) for i in range(6) for k in range(max(0, at[i + 1] - at[i] - 99))]


def test_ties_nulls_and_clashing_columns(spark):
    """Rows that share an id, or have none, are ordered by a hash; each is judged against those before it."""
    long = "abcdefghij" * 30
    rows = [(1, long, 9), (1, long, 8), (None, long, 7), (None, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long")
    got = suffix_dedup.with_spans(df).collect()
    assert len(got) == 4
    left = sorted(300 - sum(b - a for a, b in suffix_dedup.merged([(s.first, s.end) for s in r._spans or []])) for r in got if r.text)
    # one row is first; within it the text repeats itself every 10 bytes, so its first 109 bytes at most stay
    assert left[:2] == [0, 0] and 0 < left[2] <= 109


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.with_spans(df).count() == 0
