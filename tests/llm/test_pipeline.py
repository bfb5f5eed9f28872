"""The corpus pipeline: each stage against brute force on its own input, the whole run, and odd tables."""

import os
import random

import numpy as np
import pytest

import corpus_pipeline as p
from trainframe.llm import kneser_ney as kn
from trainframe.llm import mixing, simhash
from trainframe.llm.tokens import default_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows_of(df):
    assert df.columns == p.COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def documents(seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    docs = [text(r.randint(60, 200)) for _ in range(40)]
    docs += [docs[3], docs[3], docs[5].replace(" ", "  ", 1), docs[8] + " " + vocabulary[0]]
    passage = text(60)
    docs += [f"{text(80)} {passage} {text(80)}" for _ in range(6)]
    rows = [(k, t, ("en", "de")[k % 2], ("a", "b", None)[k % 3], len(t)) for k, t in enumerate(docs)]
    return rows + [(100, None, "en", "a", None), (101, "", "en", "a", 0), (102, "one", "xx", "c", 3)]


def labels(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_quality_stage_takes_the_verdict(spark, tmp_path):
    docs = documents() + [(110, "\x01\x02\x03" * 400, "en", "a", 1200)]
    labels(spark, tmp_path, [(k, 1, 0) for k in range(30)])
    got = rows_of(p.quality_classifier(spark, frame(spark, docs), str(tmp_path)))
    judged = kn.judge(frame(spark, docs), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert got == rows_of(judged.where("kept").select(p.COLUMNS))
    ids = {x[0] for x in got}
    assert not ids & {100, 101, 110} and set(range(30)) <= ids


def test_near_duplicates_keep_one_of_each_group(spark):
    docs = documents() + [(3, "a second row of this id that is nothing like it at all, not in a word of it", "en", "z", 1), (None, "no id here", "en", "a", 1), (None, "no id here", "en", "b", 1)]
    got = rows_of(p.simhash_near_dedup(spark, frame(spark, docs), ""))
    fps = [simhash.fingerprint((t or "").encode()) for _, t, *_ in docs]
    near = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)) <= 3
    label = np.arange(len(fps))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(fps)).min(axis=1))
        if (new == label).all():
            break
        label = new
    groups = {}
    for row, g in zip(docs, label, strict=True):
        groups.setdefault(g, []).append(row)
    assert sorted(groups_id(r) for r in got) == sorted(groups_id(min(g, key=lambda r: (r[0] is None, r[0] or 0))) for g in groups.values())
    # the second row of id 3 is a document of its own; of the two without an id, which are alike, one stays
    assert sum(r[0] == 3 for r in got) == 2 and sum(r[0] is None for r in got) == 1
    assert not {40, 41, 42} & {r[0] for r in got}


def groups_id(row):
    """What tells the rows of the test apart but for their source, which does not say which of two stays."""
    return (row[0] is None, row[0] or 0, row[1] or "")


def test_repeats_are_removed_from_texts(spark):
    docs = documents()
    got = {r[0]: r for r in rows_of(p.suffix_array_dedup(spark, frame(spark, docs), ""))}
    seen = set()
    for k, text, lang, source, _ in docs:
        data = (text or "").encode()
        hit = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            hit[i : i + 100] |= data[i : i + 100] in seen
            seen.add(data[i : i + 100])
        left = np.frombuffer(data, np.uint8)[~hit].tobytes().decode()
        if left.strip():
            assert got.pop(k) == (k, left, lang, source, len(left))
    assert not got


def test_cut_characters_go(spark):
    """A span that begins within a character takes all of it: the text stays valid."""
    text = "é" * 120
    got = rows_of(p.suffix_array_dedup(spark, frame(spark, [(1, "x" + text, "en", "a", 1), (2, "yy" + text + "z", "en", "a", 1)]), ""))
    assert all("�" not in r[1] and r[4] == len(r[1]) for r in got) and got[-1][1].startswith("yy")


def test_mixing_repeats_rows(spark):
    docs = documents()
    got = rows_of(p.mix_sources(spark, frame(spark, docs), ""))
    times = {r.doc_id: r.copies for r in mixing.mix(frame(spark, docs)).collect()}
    assert got == sorted((r for r in docs for _ in range(times[r[0]])), key=lambda r: tuple((x is None, x) for x in r))
    assert max(times.values()) == 2


def test_whole_run(spark, tmp_path):
    docs = documents()
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, tmp_path, [(k, 1, 0) for k in range(40)])
    stages = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in p.STAGES[:-1]:
        stages = spark.createDataFrame(f(spark, stages, str(tmp_path)).collect(), SCHEMA)
    got = p.run(spark, str(tmp_path)).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    want = sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stages.collect())
    assert sum(r.length for r in got) == want and {r.doc_id for r in got} == {r.doc_id for r in stages.collect()}


def test_no_rows(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, tmp_path, [])
    assert p.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the sample tables are not here")
def test_sample_tables(spark):
    got = p.run(spark, DATA)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    assert got.count() > 0
