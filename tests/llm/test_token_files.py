"""Token files: planes, the file format's round trip, and the query against the tokenizer itself."""

import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trainframe.llm import token_files, tokens

TEXTS = [None, "", " ", "\n\n", "Hello, World!", "don't 'quote' it's we'll", "ÀÉÎ õ ñ ß İ ı", "é combining é", "tab\tand\x0bfeed\x0c", "12345 3.14 1,000", "<|startoftext|> <|endoftext|>", "a<|endoftext|>b", "漢字 かな 한국어", "😀👍🏽 emoji", "no break space　x", "x" * 5000, "CamelCase-words_with.marks...!!", "[]{}()^~`|\\/", "​zero‍width", "ﬁ ligature Ⅷ ½"]


def reference(texts):
    t = Tokenizer.from_file(tokens.default_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("kind", ["bit", "byte"])
@settings(max_examples=60, deadline=None)
@given(ids=st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=70))
def test_planes(kind, ids):
    a = np.array(ids, "<u4")
    got = token_files.planes(a, kind)
    assert len(got) == (4 if kind == "byte" else 32)
    assert np.array_equal(token_files.unplanes([p if any(p) else b"" for p in got], len(a), kind), a)
    byte_or_bit = 8 if kind == "byte" else 1
    assert got[0][0] & (255 if kind == "byte" else 1) == ids[0] & ((1 << byte_or_bit) - 1)


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 18])
def test_file_round_trip_and_random_access(kind, chunk):
    r = random.Random(4)
    docs = [(k if k else None, np.array([r.choice([1, 70_000, r.getrandbits(32)]) for _ in range(r.randint(0, 40))], "<u4")) for k in range(30)]
    out = io.BytesIO()
    w = token_files.Writer(out, kind, chunk)
    for k, ids in docs:
        w.add(k, ids)
    w.close()
    f = token_files.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    for k in r.sample(range(30), 30):
        doc, start, n = f.index["docs"][k]
        assert doc == docs[k][0] and n == len(docs[k][1])
        assert np.array_equal(np.concatenate([np.empty(0, "<u4"), *f.ids(start, n)]), docs[k][1])


def test_damage_is_noticed():
    out = io.BytesIO()
    w = token_files.Writer(out)
    w.add(1, np.arange(1000, dtype="<u4"))
    w.close()
    data = bytearray(out.getvalue())
    with pytest.raises(ValueError, match="not a token file"):
        token_files.Reader(io.BytesIO(bytes(data[:-1]) + b"x"), len(data))
    data[20] ^= 255
    with pytest.raises(Exception):  # noqa: B017  zstandard's own error, or the checksum's
        list(token_files.Reader(io.BytesIO(bytes(data)), len(data)).ids(0, 10))


def test_encoder_equals_tokenizer():
    r = random.Random(9)
    pieces = ["word", "Ünï", "don't", "!", "...", "x1", "́", "İ", "漢", "😀", "'s", "<|endoftext|>", " ", "\t", "-", "AB", "é", "²", "_", "\x00", "�"]
    texts = TEXTS + ["".join(r.choice([*pieces, " ", " ", "\n"]) for _ in range(r.randint(1, 60))) for _ in range(400)]
    texts += [f"a{chr(c)}b {chr(c)}" for c in range(1, 0x3000)] + ["x" * 47, "y" * 500, "!<|endoftext|>", "<|ENDOFTEXT|>", "it's the dog's 'tis can't they'd've x's's ''s"]
    enc = tokens.Encoder(tokens.default_tokenizer())
    assert enc.apart
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_batch(texts)] == reference(texts)


def test_long_texts_in_strips(monkeypatch):
    monkeypatch.setattr(tokens, "PART", 50)
    texts = ["é word, " * 100, "x" * 300 + " tail\n" * 30, "", "a b", " " * 400]
    enc = tokens.Encoder(tokens.default_tokenizer())
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_batch(texts)] == reference(texts)


def test_other_tokenizers_get_whole_texts():
    """One that keeps spaces joins what they separate, so its texts are not split."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, texts = tokens.Encoder(path), ["hello world", "", "a\n\nb  c é"]
    want = [g.ids for g in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert not enc.apart and [np.frombuffer(x, "<u4").tolist() for x in enc.encode_batch(texts)] == want


def test_query(spark, tmp_path):
    docs = [(5 * k + 2, t) for k, t in enumerate(TEXTS)] + [(1, TEXTS[4])]
    random.Random(1).shuffle(docs)
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, ids int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want, start = [], 0
    for k, t in sorted(docs):
        ids = [*reference([t])[0], 1]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.op8_token_files(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_repeated_and_null_ids_and_no_rows(spark, kind):
    rows = [(None, "a"), (None, None), (3, "b c"), (3, "b c"), (3, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_files.read_token_files(token_files.write_token_files(df, tokens.default_tokenizer(), 1, kind, 2)).collect()
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert len(got) == 5 and [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, 3, 3, 3]
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read_token_files(token_files.write_token_files(none, tokens.default_tokenizer(), 1)).count() == 0
