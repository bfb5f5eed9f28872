"""Packing by concatenate and cut: fixed windows over all tokens, one document after another.

The first pass encodes each text once and writes its ids with their place in their partition. A prefix sum over the
partitions' totals (a row a partition) gives every document its global offset. The second pass cuts at multiples of
the window; a document over a boundary gives a piece on each side. Only the last sequence is short.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import default_tokenizer, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Most ids of a row of pass one.
ROW = 1_000_000


def _rows(part: int, before: int, docs: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows of pass one: documents with offsets ``at`` in ``ids``, cut to rows of at most ``ROW`` ids."""
    total = np.diff(at)
    pieces = np.maximum(1, -(-total // ROW))
    of = np.repeat(np.arange(len(docs)), pieces)
    first = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * ROW
    n = np.minimum(total[of] - first, ROW)
    start = at[of] + first
    held = pa.py_buffer(np.ascontiguousarray(ids[start[0] : start[-1] + n[-1]]))
    offsets = (np.concatenate([start - start[0], [start[-1] - start[0] + n[-1]]]) * ids.itemsize).astype(np.int64)
    data = pa.Array.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(offsets), held]).cast(pa.binary())
    cols = [pa.array(np.full(len(of), part, np.int32)), docs.take(pa.array(of)), pa.array(before + start), pa.array(first), pa.array(total[of]), pa.array(n), data]
    return pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "at", "first", "doc_tokens", "n", "ids"])


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, group: str = "") -> DataFrame:
    """Pass one, written to the shared folder: part, doc_id, at (ids before it in its partition), n, ids.

    A null text is empty and so holds only ``end_id``. Ids take 2 bytes where the vocabulary allows, else 4. Long
    documents are cut into rows of at most ``ROW`` ids (``first`` is the position of a row's first id in its document).
    """

    def encode(batches):
        from pyspark import TaskContext

        enc, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        wide = max(enc.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        for batch in batches:
            for i, j, ids, at in enc.encode(batch.column(1)):
                # every document's end id goes behind its ids
                ids = np.insert(ids, at[1:], end_id).astype("<u4" if wide else "<u2")
                at = at + np.arange(j - i + 1)
                for k in range(i, j, 10_000):
                    k2 = min(j, k + 10_000)
                    yield _rows(part, before, batch.column(0)[k:k2], ids, at[k - i : k2 - i + 1])
                before += len(ids)

    rows = common.columns(docs, "doc_id", "text").mapInArrow(common.trimmed(encode), "part int, doc_id long, at long, first long, doc_tokens long, n long, ids binary")
    return common.materialize(rows, "encoded", group)


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 4096, with_ids: bool = True, group: str = "") -> DataFrame:
    """Pieces of all documents (doc_id, text) in windows of ``window`` ids: the columns of ``PIECES``.

    ``with_ids`` adds ``ids``, a piece's ids as little-endian unsigned integers of 4 bytes. Empty tables give no pieces. Documents
    that share an id are packed one by one.
    """
    encoded = encode_documents(docs, tokenizer, end_id, group)
    # one row for each partition of the input: the totals are small however long the texts are
    totals = sorted((r.part, r.total) for r in encoded.groupBy("part").agg(F.sum("n").alias("total")).collect())
    base, so_far = {}, 0
    for part, total in totals:
        base[part] = so_far
        so_far += total
    bases = encoded.sparkSession.sparkContext.broadcast(base)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    types = [*[pa.int64()] * 7, *[pa.binary()] * with_ids]

    def cut(batches):
        for batch in batches:
            out: list[tuple] = []
            for part, doc, at, first, total, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                begin, k = bases.value[part] + at, 0
                while k < n:
                    place = (begin + k) % window
                    piece = ids[k : k + window - place].tobytes()
                    out.append((doc, first + k, len(piece) // 4, zlib.crc32(piece), total, (begin + k) // window, place, piece)[: 8 if with_ids else 7])
                    k += window - place
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return encoded.select("part", "doc_id", "at", "first", "doc_tokens", "n", "ids").mapInArrow(common.trimmed(cut), PIECES + ", ids binary" * with_ids)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 ids, a row for each piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, default_tokenizer(), 2, with_ids=False)
