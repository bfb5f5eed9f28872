"""Spherical caps: list decoding, recall against brute force, exact counts of what is found, edge cases."""

import math

import numpy as np
import pytest

from trainframe.llm import caps


def planted(n=900, dim=64, seed=5):
    """Random vectors, groups of near ones, exact copies and pairs around the bound."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    rows = list(base)
    for k in range(120):
        u = base[k] / np.linalg.norm(base[k])
        for c in (0.89, 0.905, 0.93, 0.97, 0.999):
            w = rng.standard_normal(dim)
            w -= w @ u * u
            rows.append((c * u + (1 - c * c) ** 0.5 * w / np.linalg.norm(w)) * rng.uniform(0.1, 9))
    rows += [base[3]] * 40 + [base[4] * 2]
    return np.array(rows, np.float32)


def brute(v, least=0.9):
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    return near


def components(near):
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        if np.array_equal(new, label):
            return label
        label = new


def test_decoding_finds_every_filter_over_the_level():
    rng = np.random.default_rng(0)
    for dim in (1, 3, 4, 17, 64):
        u = rng.standard_normal((40, dim))
        u /= np.linalg.norm(u, axis=1)[:, None]
        by = caps.plan(300_000 if dim == 17 else 40, dim)
        row, found = caps.decode(u, by)
        got = set(zip(row.tolist(), found.tolist(), strict=True))
        want, least = set(), by.level
        for k in range(caps.CODES):
            rotation, words = caps.code(dim, k, by.words)
            turned = u @ rotation
            if len(words) == 1:
                score = turned @ words[0].T
                want |= {(int(r), int(k * by.words + f)) for r, f in zip(*np.nonzero(score >= least), strict=True)}
                continue
            half = words[0].shape[1]
            score = (turned[:, :half] @ words[0].T)[:, :, None] + (turned[:, half:] @ words[1].T)[:, None, :]
            want |= {(int(r), int((k * by.words + i) * by.words + j)) for r, i, j in zip(*np.nonzero(score >= least), strict=True)}
        assert got == want


@pytest.mark.parametrize("chunk", [4096, 30])
def test_recall_counts_and_components(spark, tmp_path, monkeypatch, chunk):
    """Small chunks split the filters."""
    monkeypatch.setattr(caps, "CHUNK", chunk)
    v = planted()
    near = brute(v)
    rows = [(3 * k + 1, x.tolist(), k % 3) for k, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r for r in caps.op2_spherical_caps(spark, str(tmp_path)).collect()}
    assert len(got) == len(v)
    n = np.array([got[3 * k + 1].n_links for k in range(len(v))])
    assert (n <= near.sum(axis=1)).all() and n.sum() >= 0.97 * near.sum()
    root = np.array([got[3 * k + 1].component_id for k in range(len(v))])
    want = 3 * components(near) + 1
    assert (root >= want).all() and (root == want).mean() > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    # copies link with each other and with all that one of them links with
    copies = [3, *range(len(v) - 41, len(v) - 1)]
    assert len(set(n[copies])) == 1 and n[3] >= 40


def test_plans_follow_the_number_of_vectors():
    """Filters stay small and a pair at the bound shares as many of them, whatever the number of vectors."""
    for n in (10**4, 10**6, 10**8, 10**9):
        by = caps.plan(n, 64)
        one, both = caps.chances(64, by.level, 0.9)
        assert n * one <= 2 * caps.HELD and caps.CODES * by.words**2 * both >= 0.9 * caps.SHARED
        assert caps.CODES * by.words**2 * one < 500 and by.words <= caps.MOST_WORDS


@pytest.mark.parametrize("n", [10**6, 10**8])
def test_recall_of_codes_for_many_vectors(n):
    """The codes for large tables, on pairs at the bound: at least 0.97 share a filter."""
    rng, by = np.random.default_rng(8), caps.plan(n, 64)
    u = rng.standard_normal((300, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = rng.standard_normal((300, 64))
    w -= (w * u).sum(axis=1)[:, None] * u
    v = 0.9 * u + math.sqrt(0.19) * w / np.linalg.norm(w, axis=1)[:, None]
    shared = 0
    for i in range(0, 300, 50):
        (ra, fa), (rb, fb) = caps.decode(u[i : i + 50], by), caps.decode(v[i : i + 50], by)
        shared += len({r for r, f in set(zip(ra.tolist(), fa.tolist())) & set(zip(rb.tolist(), fb.tolist()))})
    assert shared >= 0.97 * 300


def test_bad_vectors_link_with_nothing(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 2.0, 3.0]
    rows = [(1, one), (2, one), (3, [2.0, 4.0, 6.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 2.0]), (8, [nan, 1.0, 2.0]), (9, [inf, 1.0, 2.0]), (10, [1.0, 2.0]), (11, [-0.0, 0.0, 0.0]), (12, [1e-38, 2e-38, 3e-38]), (None, one), (13, [3e38, 3e38, -3e38])]
    spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, n_links string").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in caps.op2_spherical_caps(spark, str(tmp_path)).collect()}
    linked = {1, 2, 3, 12, None}
    assert {k for k, r in got.items() if r[0]} == linked and all(got[k][:2] == (4, 1) for k in linked)
    assert got[1][2] and not got[None][2]
    assert all(got[k] == (0, k, True) for k in got if k not in linked)


def test_doubles_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 1e-9]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links) for r in caps.near_duplicates(df).collect()) == [(1, 1), (2, 1), (3, 0)]
    assert caps.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
