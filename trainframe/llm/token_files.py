"""Token-id files: ids in bit or byte planes, each compressed with zstandard, and an index of chunks.

A file holds documents in ascending order of their id:

    magic | chunk 0: plane 0, plane 1, ... | chunk 1: ... | index (zstandard) | index length (8 bytes) | magic

A chunk has a fixed count of ids (the last has fewer). Its ids are transposed, so that plane p holds byte (or bit) p of
every id; planes that are all zero take no bytes. The index holds each plane's offset and length, and each document's
id, flag for a null id, first position in the file and count of ids, so any document is read from its chunks alone.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import default_tokenizer, encoder

MAGIC = b"TFPLANE1"


def planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of unsigned 32-bit ids: 4 of bytes or 32 of bits, least significant first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, p].tobytes() for p in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, p], bitorder="little").tobytes() for p in range(32)]


def unplanes(got: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) if p else np.zeros(n, np.uint8) for p in got], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") if p else np.zeros(n, np.uint8) for p in got], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class Writer:
    """Writes one file to a binary stream; documents come one by one, memory is that of a chunk and the index."""

    def __init__(self, out, kind: str = "byte", chunk: int = 1 << 18, level: int = 3):
        self.out, self.kind, self.chunk, self.pack = out, kind, chunk, zstandard.ZstdCompressor(level=level)
        self.at, self.have, self.total, self.held = len(MAGIC), 0, 0, []
        self.chunks: list[list] = []
        self.docs: list[list] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, *runs: np.ndarray) -> None:
        """A document of the ids of all ``runs``."""
        n = sum(map(len, runs))
        self.docs.append([doc_id, self.total, n])
        self.total += n
        for ids in runs:
            while len(ids):
                part, ids = ids[: self.chunk - self.have], ids[self.chunk - self.have :]
                self.held.append(part)
                self.have += len(part)
                if self.have == self.chunk:
                    self._flush()

    def _flush(self) -> None:
        ids, entry = np.concatenate(self.held), []
        for p in planes(ids, self.kind):
            data = self.pack.compress(p) if any(p) else b""
            self.out.write(data)
            entry.append([self.at, len(data)])
            self.at += len(data)
        self.chunks.append([len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), entry])
        self.held, self.have = [], 0

    def close(self) -> None:
        if self.have:
            self._flush()
        index = self.pack.compress(json.dumps({"kind": self.kind, "chunk": self.chunk, "chunks": self.chunks, "docs": self.docs}).encode())
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)


class Reader:
    """Reads documents of a file by its index; holds one decoded chunk."""

    def __init__(self, source, size: int):
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        tail = self._read(size - 16, 16)
        if tail[8:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        n = struct.unpack("<Q", tail[:8])[0]
        self.index = json.loads(self.unpack.decompress(self._read(size - 16 - n, n)))
        self.held = (-1, np.empty(0, "<u4"))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunk(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            n, crc, entry = self.index["chunks"][k]
            data = self._read(entry[0][0], entry[-1][0] + entry[-1][1] - entry[0][0])
            got = [self.unpack.decompress(data[a - entry[0][0] : a - entry[0][0] + m]) if m else b"" for a, m in entry]
            ids = unplanes(got, n, self.index["kind"])
            if zlib.crc32(ids.tobytes()) != crc:
                raise ValueError(f"chunk {k} is damaged")
            self.held = (k, ids)
        return self.held[1]

    def ids(self, start: int, n: int):
        """The ids of [start, start + n), in runs that each lie in one chunk."""
        size = self.index["chunk"]
        while n > 0:
            part = self.chunk(start // size)[start % size : start % size + n]
            yield part
            start, n = start + len(part), n - len(part)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, kind: str = "byte", chunk: int = 1 << 18, group: str = "") -> DataFrame:
    """Encode the texts of ``docs`` (doc_id, text) and write them in ascending order of doc_id, a file a partition.

    Returns a row for each file: shard, path, n_ids, n_docs; shards are in the order of their documents. A null text is
    empty, so it holds only ``end_id``. Null ids come first; rows that share an id are ordered by a hash of their text,
    which also splits one id's rows over partitions. A file is moved into place when it is whole, under a name of its own,
    so a repeated task does no harm: the table of files names those of the tasks that counted.
    """
    spark = docs.sparkSession
    folder = common.new_path(spark, "tokens", group)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = common.columns(docs, "doc_id", "text").withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")

    def write(batches):
        from pyspark import TaskContext

        encode, end = encoder(tokenizer).encode, np.array([end_id], "<u4")
        task = TaskContext.get()
        path = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}.tok"
        total = [0, 0]

        def fill(out):
            w = Writer(out, kind, chunk)
            for batch in batches:
                for i, j, ids, at in encode(batch.column(1)):
                    for doc, a, b in zip(batch.column(0)[i:j].to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                        w.add(doc, ids[a:b], end)
            w.close()
            total[:] = [w.total, len(w.docs)]

        common.put_file(path, fill)
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [path], "n_ids": [total[0]], "n_docs": [total[1]]}, pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))

    return common.materialize(rows.select("doc_id", "text").mapInArrow(common.trimmed(write), "shard int, path string, n_ids long, n_docs long"), "token-files", group)


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The starts come from a running sum over the files, of which there is one a partition.
    """
    from pyspark.sql import Window

    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    listed = files.withColumn("base", F.coalesce(before, F.lit(0).cast("long"))).where("n_docs > 0")
    listed = listed.select("path", "base").repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, where = common.filesystem(path)
                with fs.open_input_file(where) as source:
                    r = Reader(source, source.size())
                    docs = r.index["docs"]
                    for k in range(0, len(docs), 20_000):
                        some = docs[k : k + 20_000]
                        crcs = []
                        for _, start, n in some:
                            crc = 0
                            for part in r.ids(start, n):
                                crc = zlib.crc32(np.ascontiguousarray(part, "<u4").tobytes(), crc)
                            crcs.append(crc)
                        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in some], pa.int64()), pa.array([base + d[1] for d in some], pa.int64()), pa.array([d[2] for d in some], pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(common.trimmed(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document's ids with end id 1, written to token files and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, default_tokenizer(), 1))
