"""Near-duplicates over documents against the exact Jaccard similarity of all pairs."""

import random

import pytest

from trainframe import queries
from trainframe.operators import dedupe


def grams(t):
    return {t[i : i + 3] for i in range(max(len(t) - 2, 1))}


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def brute_force(texts):
    """Pairs of first rows of distinct texts with their similarity, and the ids that stay."""
    firsts = {}
    for k in sorted(texts):
        firsts.setdefault(texts[k], k)
    ids = sorted(firsts.values())
    pairs = {(a, b): jaccard(texts[a], texts[b]) for a in ids for b in ids if a < b}
    pairs = {k: s for k, s in pairs.items() if s >= 0.8}
    kept = []
    for k in ids:
        if not any((j, k) in pairs for j in kept):
            kept.append(k)
    return pairs, kept


def documents(spark, folder, texts):
    rows = [(k, t, "en", "a", len(t)) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """Texts of several lengths with near copies of them, exact copies, and short and empty texts."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéß漢") for _ in range(r.randint(3, 9))) for _ in range(3000)]
    base = [" ".join(r.choice(words) for _ in range(n)) for n in (40, 60, 90, 150, 400, 1500) for _ in range(3)]
    near = [f"{t} {r.choice(words)}" for t in base] + [t[: len(t) // 2] + r.choice(words) + t[len(t) // 2 :] for t in base[::2]]
    texts = [*base, *near, base[0], base[4], near[1], "", "", "a", "ab", "abc"]
    texts = dict(zip(r.sample(range(1000), len(texts)), texts, strict=True))
    folder = tmp_path_factory.mktemp("similar")
    documents(spark, folder, texts)
    return str(folder), *brute_force(texts)


def test_similar_documents(spark, fixture):
    folder, pairs, _ = fixture
    got = {(r.a, r.b): r.similarity for r in queries.NO_SQL["similar_documents"](spark, folder).collect()}
    assert len(pairs) >= 30 and got == pytest.approx(pairs)


def test_dedupe_similar(spark, fixture):
    folder, pairs, kept = fixture
    assert sorted(r.doc_id for r in queries.NO_SQL["dedupe_similar"](spark, folder).collect()) == kept
    assert len(kept) < len({k for p in pairs for k in p})


def test_registered():
    import __spark_entry__ as e

    assert set(queries.NO_SQL) == {"similar_documents", "dedupe_similar"} <= set(e.queries()) and not set(queries.NO_SQL) & set(e.oracle_sql())


def chain(n):
    """Versions that drift: each is similar to the next, not to the one after that."""
    r = random.Random(5)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8 * n + 100))
    return {k: text[8 * k : 8 * k + 100] for k in range(n)}


@pytest.mark.parametrize(("n", "options"), [(210, {}), (9, {"at_once": 0})])
def test_chain_of_versions(spark, n, options):
    """All of a chain is settled, also where there are more pairs than are settled together."""
    texts = chain(n)
    pairs, kept = brute_force(texts)
    assert len(pairs) == n - 1 and kept == list(range(0, n, 2))
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    assert sorted(r.id for r in dedupe.dedupe_similar(df, "t", "id", **options).select("id").collect()) == kept


def test_no_pair_is_lost_by_chance(spark, monkeypatch):
    """Pairs at the threshold itself, in several blocks: min-hashes miss some of so many."""
    from trainframe.operators import similar

    r, texts = random.Random(3), {}
    for k in range(3000):
        x = "".join(chr(a) for a in r.sample(range(0x4E00, 0x9FA5), 11))
        texts[2 * k], texts[2 * k + 1] = x, x[:-1]
        if k % 2:  # 8 of 10 grams
            texts[2 * k + 1] = x[:-1] + "a"
    monkeypatch.setattr(similar, "BLOCK", 1500)
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    got = {(x.a, x.b): x.similarity for x in dedupe.similar_pairs(df, "t", "id").collect()}
    assert got == {(2 * k, 2 * k + 1): jaccard(texts[2 * k], texts[2 * k + 1]) for k in range(3000)}


@pytest.mark.parametrize(("threshold", "ngram"), [(0.8, 3), (0.5, 3), (0.95, 2), (0.7, 5)])
def test_blocks_against_sets(threshold, ngram):
    """Blocks of sets of many sizes give the pairs of the sets themselves, in one block and between two."""
    import numpy as np

    from trainframe.operators import similar

    r = random.Random(ngram)
    words = ["".join(r.choice("abcdeé漢") for _ in range(5)) for _ in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in (0, 1, 5, 30, 31, 100, 110, 400, 900) for _ in range(6)]
    texts += [t + t[: len(t) // 6] for t in texts] + [t[: len(t) - 9] + "xyz" for t in texts]
    sets = {x: np.array(similar.codes(x.encode(), ngram)) for x in dict.fromkeys(texts)}
    whole = {x: {x[i : i + ngram] for i in range(max(len(x) - ngram + 1, 1))} for x in sets}
    assert all(len(sets[x]) == len(whole[x]) for x in sets)
    order = sorted(sets, key=lambda x: len(sets[x]))
    cut = len(order) // 2
    a, b = (similar.Block.of(list(range(i, j)), [sets[x] for x in order[i:j]]) for i, j in ((0, cut), (cut, len(order))))
    got = {(int(p.r[i]), int(q.r[j])): float(v) for p, q in ((a, a), (b, b), (a, b)) for x, y, s in similar.links(p, q, p is q, threshold) for i, j, v in zip(x, y, s, strict=True)}
    want = {(i, j): len(whole[x] & whole[y]) / len(whole[x] | whole[y]) for i, x in enumerate(order) for j, y in enumerate(order) if i < j}
    assert got == {k: v for k, v in want.items() if v >= threshold} and got


def test_ids_of_other_types(spark):
    """Ids that are no whole numbers, in the order of their type; copies go by their least."""
    texts = {k: "abcdefghij klmnopqrst uvwxyz" + "!" * (k % 3) for k in range(7)}
    pairs, _ = brute_force(texts)
    df = spark.createDataFrame([((k // 2, f"x{k}"), t) for k, t in texts.items()], "id struct<a: int, b: string>, t string")
    got = sorted((int(r.a.b[1:]), int(r.b.b[1:])) for r in dedupe.similar_pairs(df, "t", "id").collect())
    assert got == sorted(pairs) == [(0, 1), (0, 2), (1, 2)]
