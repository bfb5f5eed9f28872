"""Pairs of texts whose sets of character n-grams are similar: all pairs of a threshold or more, none by chance.

Two sets of sizes p and q and Jaccard similarity t or more differ in at most (p + q)(1 - t)/(1 + t) members, and the
smaller has t times the members of the larger. So sets are put in order of size and cut to blocks, and each pair of blocks
whose sizes allow links is compared in one place. There every pair of sets is compared by bitmaps first: a bit is the
parity of the members that hash to it, so bitmaps differ in no more bits than the sets have members that differ, and what
is left out is no link. What remains is verified on the sets themselves. Pairs exist only within a task; blocks are files
in the shared folder, which tasks read as they need them, so no set is sent for each of its pairs.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import delete, filesystem, new_path, written

#: Sets that a block has about, and the most sets and members that one has.
BLOCK, MOST, MEMBERS = 4096, 8192, 8 << 20
#: Pairs of sets that a row of work has about.
WORK = 1 << 26
#: Bits of a bitmap; the first comparison folds them to fewer where sets are small.
BITS = 4096
#: Characters of a text that are worked on at a time, and sets of a block against another.
STRIP, ROWS = 1 << 20, 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def codes(text: bytes, n: int) -> np.ndarray:
    """The distinct n-grams of a text, sorted: up to 3 characters as they are, more by a 64-bit hash. A shorter text is its own."""
    t, found = text.decode("utf-8", "surrogateescape"), []
    for at in range(0, max(len(t) - n + 1, 1), STRIP):
        c = np.frombuffer(t[at : at + STRIP + n - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        if len(c) < n:
            c = np.concatenate([c, np.zeros(n - len(c), np.uint64)])
        m = len(c) - n + 1
        x = c[:m].copy()
        for k in range(1, n):
            x = (x << np.uint64(21) if n <= 3 else _mix(x) * np.uint64(0x9E3779B97F4A7C15)) + c[k : k + m]
        found.append(_distinct(x))
    return found[0] if len(found) == 1 else _distinct(np.concatenate(found))


def pack(x: np.ndarray) -> bytes:
    """Differences of neighbours, first all their lowest bytes, then all the next."""
    d = np.diff(x, prepend=x.dtype.type(0))
    return pa.compress(d.view(np.uint8).reshape(len(d), -1).T.tobytes(), "zstd", asbytes=True)


def unpack(packed: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def _sets(rows: DataFrame, n: int) -> DataFrame:
    """(r, id, digest, size, grams) of each row of ``rows`` (id, text); r is a number of the row's own."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or b"" for t in part.column(2).cast(pa.large_binary()).to_pylist()]
                size, grams = [], []
                for t in texts:
                    c = codes(t, n)
                    size.append(len(c))
                    grams.append(pack(c))
                digest = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), digest, pa.array(size, pa.int32()), pa.array(grams, pa.binary())], ["r", "id", "digest", "size", "grams"])

    rows = rows.select(F.monotonically_increasing_id().alias("r"), "id", "text")
    more = [T.StructField("digest", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("grams", T.BinaryType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], *more]))


class Block:
    """Sets in order of size: their rows' numbers, sizes, bitmaps, and members as places in the block's sorted members."""

    def __init__(self, r: np.ndarray, sizes: np.ndarray, bits: np.ndarray, members: np.ndarray, places: np.ndarray):
        self.r, self.sizes, self.bits, self.members, self.places = r, sizes, bits, members, places
        self.at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    @classmethod
    def of(cls, r: list[int], sets: list[np.ndarray]) -> Block:
        members, places = np.unique(np.concatenate(sets), return_inverse=True)
        bits = np.empty((len(sets), BITS // 8), np.uint8)
        for k, x in enumerate(sets):
            bits[k] = np.packbits(np.bincount((_mix(x) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1)
        return cls(np.array(r, np.int64), np.array([len(x) for x in sets], np.int32), bits.view(np.uint64), members, places.astype(np.int32))

    def write(self, path: str) -> None:
        values = [pack(self.r), pack(self.sizes), pa.compress(self.bits.tobytes(), "zstd", asbytes=True), pack(self.members), pack(self.places)]
        batch = pa.record_batch([pa.array([v], pa.large_binary()) for v in values] + [pa.array([len(x)]) for x in (self.r, self.members, self.places)], list("abcdefgh"))
        files, where = filesystem(path)
        files.create_dir(where.rpartition("/")[0], recursive=True)
        with files.open_output_stream(where) as out, pa.ipc.new_stream(out, batch.schema) as w:
            w.write_batch(batch)

    @classmethod
    def read(cls, path: str) -> Block:
        files, where = filesystem(path)
        with files.open_input_stream(where) as f, pa.ipc.open_stream(f) as r:
            a, b, c, d, e, n, m, k = r.read_all().to_pylist()[0].values()
        bits = np.frombuffer(pa.decompress(c, n * BITS // 8, "zstd", asbytes=True), np.uint64).reshape(n, -1)
        return cls(unpack(a, n, np.int64), unpack(b, n, np.int32), bits, unpack(d, m, np.uint64), unpack(e, k, np.int32))

    def folded(self, words: int) -> np.ndarray:
        """Bitmaps of so many words, by word: a parity of parities is one of the same members."""
        return np.ascontiguousarray(np.bitwise_xor.reduce(self.bits.reshape(len(self.bits), -1, words), axis=1).T)


def _build(folder: str):
    """Rows (r, size, named, grams) in order of size to block files: (path, n, low, high), the number of sets and their sizes.

    A row without grams comes before that of its text's first row and has the number that the block is to name it by.
    """

    def flush(r, sets):
        path = f"{folder}/{uuid.uuid4().hex}"
        Block.of(r, sets).write(path)
        return pa.RecordBatch.from_pydict({"path": [path], "n": pa.array([len(r)], pa.int64()), "low": pa.array([len(sets[0])], pa.int64()), "high": pa.array([len(sets[-1])], pa.int64())})

    def run(batches):
        r, sets, held, name = [], [], 0, (None, None)
        for batch in batches:
            for row, size, named, grams in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if grams is None:
                    name = row, named
                    continue
                if row != name[0]:  # a copy of another row's text
                    continue
                if r and (len(r) == MOST or held + size > MEMBERS):
                    yield flush(r, sets)
                    r, sets, held = [], [], 0
                r.append(name[1])
                sets.append(unpack(grams, size, np.uint64))
                held += size
        if r:
            yield flush(r, sets)

    return run


def candidates(a: Block, b: Block, same: bool, threshold: float):
    """Index arrays (x, y) of sets of a and b: all similar pairs, and those that sizes and bitmaps do not tell apart from them."""
    apart = (1 - threshold) / (1 + threshold)
    words, left, right = 0, a.bits, b.bits
    for i in range(0, len(a.sizes), ROWS):
        p = a.sizes[i : i + ROWS]
        lo = int(np.searchsorted(b.sizes, np.ceil(p[0] * threshold - 1e-6)))
        hi = int(np.searchsorted(b.sizes, np.floor(p[-1] / threshold + 1e-6), "right"))
        lo = max(lo, i + 1) if same else lo
        if lo >= hi:
            continue
        most = np.floor(apart * (p[:, None] + b.sizes[None, lo:hi].astype(np.float64)) + 1e-6)
        # bitmaps of few bits are all alike: at most three tenths of the bits may differ
        need = 2
        while need < BITS // 64 and most[-1, -1] > 0.3 * 64 * need:
            need *= 2
        if need != words:
            words, left, right = need, a.folded(need), b.folded(need)
        most = np.minimum(most, BITS).astype(np.uint16)
        differ, x, count = np.zeros(most.shape, np.uint16), np.empty(most.shape, np.uint64), np.empty(most.shape, np.uint8)
        for w in range(words):
            np.bitwise_xor(left[w, i : i + ROWS, None], right[w, None, lo:hi], out=x)
            np.add(differ, np.bitwise_count(x, out=count), out=differ)
        x, y = np.nonzero(differ <= most)
        most, x, y = most[x, y], x + i, y + lo
        if same:
            most, x, y = (v[x < y] for v in (most, x, y))
        for k in range(0, len(x), 8192):
            u, v = x[k : k + 8192], y[k : k + 8192]
            kept = np.bitwise_count(a.bits[u] ^ b.bits[v]).sum(axis=1, dtype=np.uint16) <= most[k : k + 8192]
            if kept.any():
                yield u[kept], v[kept]


def links(a: Block, b: Block, same: bool, threshold: float):
    """(x, y, similarity): arrays of the similar pairs of sets of a and b."""
    place = np.searchsorted(b.members, a.members)
    place[place == len(b.members)] = 0
    place[b.members[place] != a.members] = len(b.members)
    mark = np.zeros(len(b.members) + 1, bool)  # the last is for members that b has not
    for xs, ys in candidates(a, b, same, threshold):
        common, k = np.empty(len(xs), np.int64), 0
        for x, n in zip(*np.unique(xs, return_counts=True), strict=True):
            own = place[a.places[a.at[x] : a.at[x + 1]]]
            mark[own] = True
            for y in ys[k : k + n].tolist():
                common[k] = np.count_nonzero(mark[b.places[b.at[y] : b.at[y + 1]]])
                k += 1
            mark[own] = False
        similarity = common / (a.sizes[xs].astype(np.int64) + b.sizes[ys] - common)
        kept = similarity >= threshold
        if kept.any():
            yield xs[kept], ys[kept], similarity[kept]


def _compare(threshold: float):
    """Rows of (left, rights), paths of blocks, to (a, b, similarity) of the numbers of similar rows."""

    def run(batches):
        for batch in batches:
            for left, rights in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                a = Block.read(left)
                for right in rights:
                    b = a if right == left else Block.read(right)
                    for x, y, s in links(a, b, right == left, threshold):
                        yield pa.RecordBatch.from_arrays([pa.array(a.r[x]), pa.array(b.r[y]), pa.array(s)], ["a", "b", "similarity"])

    return run


def _work(blocks: list, threshold: float) -> list[tuple[str, list[str]]]:
    """Every pair of blocks that can have a link, a block with itself too, as rows of a block and some after it."""
    blocks, rows = sorted(blocks, key=lambda b: (b.low, b.high, b.path)), []
    for i, a in enumerate(blocks):
        rights, pairs = [], 0
        for b in blocks[i:]:
            if b.low * threshold > a.high + 1e-6:
                break  # those after it are larger still
            rights.append(b.path)
            pairs += a.n * b.n
            if pairs >= WORK:
                rows.append((a.path, rights))
                rights, pairs = [], 0
        if rights:
            rows.append((a.path, rights))
    return rows


def similar(rows: DataFrame, threshold: float, ngram: int) -> tuple[DataFrame, DataFrame]:
    """Of ``rows`` (id, text): (id) of each distinct text, its least, and (a, b, similarity), a < b, of similar ones."""
    spark = rows.sparkSession
    threshold = max(threshold, 1e-9)
    whole = isinstance(rows.schema["id"].dataType, T.IntegralType)
    folder = new_path(spark, "similar-blocks")
    sets = written(_sets(rows, ngram), "similar", f"{folder}/sets")
    # an id of null is the least of no text
    firsts = sets.groupBy("digest").agg(F.min("id").alias("id"), F.min_by("r", "id").alias("r"), F.max("size").alias("size"))
    firsts = written(firsts.where("r is not null").select("r", "id", "size"), "similar")
    n, members = firsts.agg(F.count("*"), F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0))).first()
    parts = max(1, -(-n // BLOCK), -(-members // MEMBERS))
    # first rows meet their sets where both are sorted, so sets are sent once
    names = firsts.select("r", "size", (F.col("id").cast("long") if whole else F.col("r")).alias("named"), F.lit(None).cast("binary").alias("grams"))
    dealt = names.union(sets.select("r", "size", F.lit(None).cast("long"), "grams"))
    dealt = dealt.repartitionByRange(parts, "size", "r").sortWithinPartitions("size", "r", F.col("grams").isNotNull())
    blocks = written(dealt.mapInArrow(_build(f"{folder}/blocks"), "path string, n long, low long, high long"), "similar", f"{folder}/list").collect()
    delete(spark, f"{folder}/sets")
    work = _work(blocks, threshold)
    todo = spark.createDataFrame(work, "`left` string, rights array<string>")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    todo = todo.repartition(max(1, min(len(work), tasks)))
    pairs = written(todo.mapInArrow(_compare(threshold), "a long, b long, similarity double"), "similar")
    delete(spark, folder)
    if whole:
        kind = rows.schema["id"].dataType
        pairs = pairs.select(*(F.col(c).cast(kind).alias(c) for c in "ab"), "similarity")
    else:
        x, y = (firsts.select(F.col("r").alias(c), F.col("id").alias(f"i{c}")) for c in "ab")
        pairs = pairs.join(x, "a").join(y, "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"), "similarity")
    swap = F.col("a") > F.col("b")
    ends = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    # texts that share an id are no pair of rows
    return firsts.select("id"), pairs.where("a <> b").select(ends[0].alias("a"), ends[1].alias("b"), "similarity")
