"""SimHash fingerprints and near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance 3 or less agree, in at least one of ``BLOCKS`` views that each leave out one block of bits,
up to 2 bits (a pair that differs has a differing bit in some block; that view leaves it out). So in each view every
fingerprint emits all variants within radius 1, half the rest, and two that are that close meet in a variant: their
midpoint. Pairs that meet are verified over all 64 bits. No near pair is lost, and a fingerprint emits about 131 rows
where balls of radius 2 over the whole fingerprint would need 2081.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCKS = 3
#: A bucket of more fingerprints is cut to chunks of this size, and each pair of chunks is a task row of its own.
CHUNK = 4096


#: Bytes of a text that are worked on at a time.
STRIP = 4 << 20
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")


def _strips(text: bytes):
    """The words of ``text`` in lower case, in lists of about ``STRIP`` bytes of it."""
    at = 0
    while at < len(text):
        end = at + STRIP
        if end < len(text):
            end = m.start() if (m := _SPACE.search(text, end)) else len(text)
        yield text[at:end].translate(_LOWER).split()
        at = end


def _counts(w: list[bytes], width: int) -> tuple[np.ndarray, int]:
    """Of the hashes of all ``width``-word shingles how many have each bit, and how many there are."""
    n = len(w) - width + 1
    one = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1).tolist()
    hash64 = xxhash.xxh64_intdigest
    h = np.fromiter([hash64(one[a:b], 42) for a, b in zip([0, *ends], [e - 1 for e in ends[width - 1 :]], strict=False)], np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 255 * 256):  # sums of 255 bits fit a byte
        bits = np.unpackbits(h[i : i + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rest = len(bits) % 255
        counts += bits[len(bits) - rest :].sum(axis=0, dtype=np.int64)
        counts += bits[: len(bits) - rest].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return counts, n


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash over ``width``-word shingles, repeats counted: a bit is set if it is in over half the hashes.

    Fewer words are one shingle, none is 0. A long text is read in strips, of which each keeps its last words for the next.
    """
    counts, n, w = np.zeros(64, np.int64), 0, []
    for words in _strips(text):
        w += words
        if len(w) >= width:
            more, k = _counts(w, width)
            counts, n, w = counts + more, n + k, w[len(w) - width + 1 :]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(w), 42) if w else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row of ``docs`` (doc_id, text), fp as a signed long; a null or blank text has 0."""

    def run(batches):
        for batch in batches:
            _, at = common.text_bytes(batch.column(1))
            for i, j in common.parts(at, 8 << 20):
                texts = batch.column(1)[i:j].cast(pa.large_binary()).to_pylist()
                got = np.fromiter((fingerprint(t or b"") for t in texts), np.uint64, len(texts)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(got)], ["doc_id", "fp"])

    rows = common.columns(docs, "doc_id", "text")
    return rows.withColumn("doc_id", rows.doc_id.cast("long")).mapInArrow(common.trimmed(run), "doc_id long, fp long")


def _views() -> list[tuple[int, list[int]]]:
    """Of each view its number and the bits that it keeps."""
    cuts = [64 * b // BLOCKS for b in range(BLOCKS + 1)]
    return [(b, [k for k in range(64) if not cuts[b] <= k < cuts[b + 1]]) for b in range(BLOCKS)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << k for k in bits)
    return m - (1 << 64) if m >> 63 else m


def variants(fps: DataFrame) -> DataFrame:
    """(view, variant, fp): in each view the masked fingerprint and all that differ from it in one kept bit."""
    out = None
    for view, bits in _views():
        masked = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        flips = F.array(F.lit(0).cast("long"), *(F.lit(_mask([k])).cast("long") for k in bits))
        rows = fps.select("fp", masked.alias("m"), F.explode(flips).alias("x")).select(F.lit(view).cast("byte").alias("view"), F.col("m").bitwiseXOR(F.col("x")).alias("variant"), "fp")
        out = rows if out is None else out.union(rows)
    return out


def near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of a and b at most ``radius`` bits apart, in strips of bounded memory."""
    xs, ys = [], []
    for i in range(0, len(a), 512):
        x, y = np.nonzero(np.bitwise_count(a[i : i + 512, None] ^ b[None, :]) <= radius)
        xs.append(x + i)
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


def links(fps: DataFrame, radius: int = 3, group: str = "") -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints of ``fps`` (fp) at most ``radius`` (3 or less) apart.

    Pairs within a bucket of variants are verified together and give the bucket's forest, not its pairs. Large buckets
    are cut to chunks, and pairs of chunks are dealt to tasks anew.
    """
    if radius > 3:
        raise ValueError("variants of radius 1 in views without one block find distances up to 3")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # hash partitioning deals the variants out; a sort within each partition puts a bucket's rows side by side
    rows = variants(fps).repartition(n, "view", "variant").sortWithinPartitions("view", "variant").select("view", "variant", "fp")
    schema = "a long, b long, left binary, right binary"
    names = [("a", pa.int64()), ("b", pa.int64()), ("left", pa.binary()), ("right", pa.binary())]

    def edges(a, b):
        a, b = common.forest(a.view(np.int64), b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.binary()), pa.nulls(len(a), pa.binary())], schema=pa.schema(names))

    def bucket(fp: np.ndarray):
        """One bucket's rows: edges, or the pairs of its chunks."""
        fp = np.unique(fp)
        if len(fp) <= CHUNK:
            x, y = near(fp, fp, radius)
            yield edges(fp[x[x < y]], fp[y[x < y]])
            return
        chunks = [fp[i : i + CHUNK].tobytes() for i in range(0, len(fp), CHUNK)]
        for i, left in enumerate(chunks):
            for right in chunks[i:]:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([left]), pa.array([right])], schema=pa.schema(names))

    def meet(batches):
        held: list[np.ndarray] = []
        last = None
        for batch in batches:
            view, var, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            fp = fp.view(np.uint64)
            if not len(fp):
                continue
            new = np.flatnonzero((var[1:] != var[:-1]) | (view[1:] != view[:-1])) + 1
            begin, end = np.concatenate([[0], new]), np.concatenate([new, [len(fp)]])
            if (view[0], var[0]) == last:
                held.append(fp[: end[0]])
                begin, end = begin[1:], end[1:]
                if not len(begin):
                    continue
            if sum(map(len, held)) > 1:
                yield from bucket(np.concatenate(held))
            last, held = (view[-1], var[-1]), [fp[begin[-1] :]]
            begin, end = begin[:-1], end[:-1]
            size = end - begin
            # pairs in small buckets: each row with those 1, 2, ... places on in its bucket
            small = np.zeros(len(fp), np.int64)
            keep = (size > 1) & (size <= 32)
            left = end[keep] - begin[keep]
            if len(left):
                at = np.repeat(begin[keep], left) + np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left)
                small[at] = np.repeat(end[keep], left) - at - 1
                a, b = [], []
                for k in range(1, int(left.max())):
                    x = at[small[at] >= k]
                    x = x[np.bitwise_count(fp[x] ^ fp[x + k]) <= radius]
                    a.append(fp[x])
                    b.append(fp[x + k])
                if a and sum(map(len, a)):
                    yield edges(np.concatenate(a), np.concatenate(b))
            for i, j in zip(begin[size > 32].tolist(), end[size > 32].tolist(), strict=True):
                yield from bucket(fp[i:j])
        if sum(map(len, held)) > 1:
            yield from bucket(np.concatenate(held))

    def verify(batches):
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (left, right))
                x, y = near(a, b, radius)
                yield edges(a[x], b[y]).select(["a", "b"])

    met = common.materialize(rows.mapInArrow(common.trimmed(meet), schema), "met", group)
    deferred = met.where("left is not null").select("left", "right").repartition(n).mapInArrow(common.trimmed(verify), "a long, b long")
    return met.where("a is not null").select("a", "b").union(deferred).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, group: str = "") -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id among the documents whose fingerprints this one's reaches in steps of at most
    ``radius`` bits; documents without words have fingerprint 0 and link like others. Null ids count only where a
    component has no other id, and then component_id is null. Rows that repeat an id each give a row.
    """
    fps = common.materialize(fingerprints(docs), "fp", group)
    nodes = common.materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-nodes", group)
    found = common.connected_components(links(nodes.select("fp"), radius, group), group)
    of = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    of = common.materialize(of, "fp-of", group)
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(least, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
