"""SimHash: fingerprints by hand, every link of random and adversarial fingerprints, components, edge cases."""

import random

import numpy as np
import pytest
import xxhash

from trainframe.llm import simhash


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = lower.encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g, seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def components(nodes, linked):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abCDé ÀZ") for _ in range(r.randint(1, 5)))
    texts = [None, "", " \n\t", "A", "a b", "A b C", "a a a a a", "tab\tx\x0by\x0cz\r\nq"]
    texts += [" ".join(word() for _ in range(n)) for n in (3, 4, 10, 255, 256, 257, 258, 259, 600, 5000)]
    for t in texts:
        assert simhash.fingerprint(t.encode() if t else b"") == brute_fingerprint(t), t


def test_long_texts_in_strips(monkeypatch):
    """However a text is cut, every shingle counts once."""
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abC") for _ in range(r.randint(1, 9))) for _ in range(n)) + " " * n for n in (1, 2, 3, 7, 400, 3000)]
    texts += ["x" * 500, "x" * 500 + " y", " " * 90 + "z"]
    for strip in (1, 10, 37, 1000):
        monkeypatch.setattr(simhash, "STRIP", strip)
        for t in texts:
            assert simhash.fingerprint(t.encode()) == brute_fingerprint(t)


def flipped(r, x, n):
    for b in r.sample(range(64), n):
        x ^= 1 << b
    return x


@pytest.mark.parametrize("chunk", [4096, 40])
def test_all_links_within_three_bits(spark, monkeypatch, chunk):
    """Small chunks send large buckets through the deferred pairs of chunks."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    r = random.Random(7)
    fps = [r.getrandbits(64) for _ in range(200)]
    fps += [flipped(r, x, k) for x in fps[:120] for k in (1, 2, 3, 4)]
    fps += [0, (1 << 64) - 1, 1 << 63, 0b111, 0b1111]
    fps += [1 << k for k in range(64)]  # a hot bucket: all are one bit from 0
    fps = sorted(set(fps))
    linked = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df).collect()]
    # edges go to the least node of what a bucket links, so they connect, no more
    assert components(fps, got) == components(fps, linked)


def test_pairs_at_each_split_of_three_bits():
    """Whatever blocks three differing bits fall in, some view keeps at most two of them."""
    views = simhash._views()
    for spread in ((0, 1, 2), (0, 1, 40), (0, 30, 63), (21, 42, 63), (62, 63, 61)):
        assert min(sum(b in bits for b in spread) for _, bits in views) <= 2


def test_query(spark, tmp_path):
    r = random.Random(2)
    base = [[f"w{r.randint(0, 500)}" for _ in range(300)] for _ in range(25)]
    docs = []
    for k, words in enumerate(base):
        docs.append((10 * k + 3, " ".join(words)))
        near = list(words)
        near[r.randrange(300)] = "changed"
        docs.append((10 * k + 1, " ".join(near)))
    docs += [(900, None), (901, ""), (902, " \n"), (903, docs[0][1]), (903, docs[2][1]), (904, docs[0][1].upper())]
    docs += [(1000 + k, "the very same text of many copies") for k in range(500)]
    spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, fp string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = [(x.doc_id, x.fingerprint, x.component_id) for x in simhash.op6_simhash(spark, str(tmp_path)).collect()]
    fp = [brute_fingerprint(t) for _, t in docs]
    uniq = sorted(set(fp))
    near = np.bitwise_count(np.array(uniq, np.uint64)[:, None] ^ np.array(uniq, np.uint64)) <= 3
    root = components(uniq, [(uniq[i], uniq[j]) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    least = {}
    for (k, _), f in zip(docs, fp, strict=True):
        least[root[f]] = min(k, least.get(root[f], k))
    assert sorted(got) == sorted((k, f"{f:016x}", least[root[f]]) for (k, _), f in zip(docs, fp, strict=True))
    assert len({c for *_, c in got}) < len(docs) - 500


def test_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, None), (4, "a b c d")], "doc_id long, text string")
    got = sorted((r.component_id is None, r.doc_id is None, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(False, False, 4), (False, True, 4), (True, True, None)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
