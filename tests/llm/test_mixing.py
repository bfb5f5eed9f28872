"""Mixing against brute force over sorted hashes, its promises, and its edge cases."""

import hashlib
import random

import duckdb
import pytest

from trainframe.llm import mixing


def size(text):
    return len((text or "").encode().split())


def brute(docs, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """(doc_id, size, source_size, target, taken) by water filling step by step and a sort of hashes."""
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, (s or "").encode()))
    words = {s: sum(size(t) for _, t, x in docs if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    budget, target, open_ = share * sum(words.values()), {}, set(sources)
    while open_:
        left = budget - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * words[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: most * words[s] for s in full}
        open_ -= full
    out = []
    for s in sources:
        rows = []
        for k, t, x in docs:
            if x == s:
                inner = hashlib.md5(t.encode()).hexdigest() if t is not None else "null"
                rows.append((int(hashlib.md5(f"{'null' if k is None else k}:{inner}".encode()).hexdigest()[:15], 16), k, size(t)))
        base = int(target[s] // words[s]) if words[s] else 0
        left = target[s] - base * words[s]
        by_hash = {}
        for h, _, n in rows:
            by_hash[h] = by_hash.get(h, 0) + n
        extra, upto = set(), 0
        for h in sorted(by_hash) if left > 0 else ():
            if upto + by_hash[h] <= left or upto + by_hash[h] - left < left - upto:
                extra.add(h)
            upto += by_hash[h]
            if upto > left:
                break
        out += [(k, n, words[s], round(target[s], 6), (base + (h in extra)) * n) for h, k, n in rows]
    return sorted(out, key=lambda r: (r[0] is None, r))


def documents(seed=3, n=400):
    r = random.Random(seed)
    docs = [(k, " ".join("w" for _ in range(r.randint(0, 60))), r.choice(["hot", "hot", "hot", "b", "é", "Z", None])) for k in range(n)]
    docs += [(n, None, "b"), (n + 1, "", "silent"), (n + 2, "one two", "tiny"), (n + 3, "w " * 20_000, "b"), (5, docs[5][1], "hot"), (None, "x y z", "b")]
    return docs


def result(df):
    rows = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r))


def frame(spark, docs):
    return spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, source string, taken string")


@pytest.mark.parametrize("seed", [3, 4])
def test_equals_brute_force_and_reruns_agree(spark, seed):
    docs = documents(seed)
    got = result(mixing.mix(frame(spark, docs).repartition(5)))
    assert got == brute(docs)
    assert got == result(mixing.mix(frame(spark, docs[::-1]).repartition(2)))


def test_promises(spark):
    docs = documents()
    got = result(mixing.mix(frame(spark, docs)))
    assert all(taken <= 2 * n for _, n, _, _, taken in got)
    by_source = {}
    for (k, text, s), row in zip(sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, size(d[1]))), got, strict=True):
        by_source.setdefault(s, []).append(row)
    for rows in by_source.values():
        assert abs(sum(r[4] for r in rows) - rows[0][3]) <= max(r[1] for r in rows)


def test_thresholds_are_nested(spark):
    """A larger share takes every document at least as often."""
    docs = [(k, "w " * (k % 37 + 1), "a") for k in range(300)]
    taken = [{r.doc_id: r.copies for r in mixing.mix(frame(spark, docs), share=s).collect()} for s in (0.3, 0.6, 1.2, 1.9)]
    for less, more in zip(taken, taken[1:], strict=False):
        assert all(less[k] <= more[k] for k in less)


def test_no_rows_and_no_words(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    got = result(mixing.mix(frame(spark, [(1, None, None), (2, " ", "a")])))
    assert [r[4] for r in got] == [0, 0]


def test_plan_has_no_python(spark):
    plan = mixing.mix(frame(spark, documents(n=30)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_sql(spark, tmp_path):
    docs = documents()
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = [(a, b, int(c), round(d, 6), e) for a, b, c, d, e in con.execute(mixing.OP7_SQL).fetchall()]
    assert result(mixing.op7_mixing(spark, str(tmp_path))) == sorted(want, key=lambda r: (r[0] is None, r))
