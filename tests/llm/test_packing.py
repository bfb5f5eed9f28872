"""Packing: each id once, full windows, and equality with one long list cut in windows."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from trainframe.llm import packing
from trainframe.llm.tokens import default_tokenizer


def documents():
    r = random.Random(6)
    docs = [(k, " ".join(r.choice(["alpha", "Beta", "gamma,", "x1", "é!"]) for _ in range(r.randint(0, 80)))) for k in range(120)]
    return docs + [(500, None), (501, ""), (502, "word " * 3000), (3, docs[3][1]), (None, "no id")]


def ids_of(text):
    ids_of.t = getattr(ids_of, "t", None) or Tokenizer.from_file(default_tokenizer())
    return [*ids_of.t.encode(text or "", add_special_tokens=False).ids, 2]


def test_each_id_lies_in_one_piece(spark):
    docs, window = documents(), 64
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, length int").repartition(5)
    got = packing.pack(df, default_tokenizer(), 2, window).collect()
    line = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and r.ids_crc32 == zlib.crc32(r.ids) and r.offset + r.length <= window
        assert r.start + r.length <= r.doc_tokens
        for k, x in enumerate(ids.tolist()):
            place = r.sequence_id * window + r.offset + k
            assert place not in line  # two pieces never overlap
            line[place] = (r.doc_id, r.start + k, r.doc_tokens, x)
    assert sorted(line) == list(range(len(line)))  # gapless, so all windows but the last are full
    # read along the line, documents come whole, one after another, each once
    seen, at = [], 0
    while at < len(line):
        doc, first, n, _ = line[at]
        part = [line[at + k] for k in range(n)]
        assert first == 0 and [(p[0], p[1], p[2]) for p in part] == [(doc, k, n) for k in range(n)]
        seen.append((doc, [p[3] for p in part]))
        at += n
    key = lambda x: (x[0] is None, x)
    assert sorted(seen, key=key) == sorted(((k, ids_of(t)) for k, t in docs), key=key)


def test_query(spark, tmp_path):
    docs = documents()
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = packing.op10_packing(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = got.collect()
    total = sum(len(ids_of(t)) for _, t in docs)
    assert sum(r.length for r in rows) == total
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by_sequence) == list(range(-(-total // 4096)))
    for k, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 4096 or k == max(by_sequence)


def test_very_long_text_and_no_rows(spark):
    """A document of over a million ids is written in several rows and still is one document."""
    df = spark.createDataFrame([(1, "ab " * 1_000_100), (2, "c")], "doc_id long, text string").coalesce(1)
    got = packing.pack(df, default_tokenizer(), 2, with_ids=False).collect()
    long = sorted((r.start, r.length) for r in got if r.doc_id == 1)
    assert all(a + n == b for (a, n), (b, _) in zip(long, long[1:], strict=False)) and sum(n for _, n in long) == 1_000_101
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), default_tokenizer(), 2).count() == 0
