"""Exact substring deduplication by distributed prefix doubling, over sampled positions.

The doubling: a position's rank for ``s`` bytes, paired with the rank of what follows them, sorts positions by more
bytes; ranks are places in Spark's sort of the pairs (``sorted_ranks``), and positions alone in their class drop out before
the next, wider round, until ``length`` bytes are ranked. ``plain_spans`` does that for every byte, from 8 to 16, 32, 64
and 100 bytes. It sorts a row for each byte and is many times the input, so ``repeated_spans`` lets only those positions
in that can repeat. Content chooses them (the least hash of K bytes in each window of ``length`` bytes), so equal windows
have the same sampled position inside. A sampled position stands for the run of windows that chose it. Its rounds:

  1. K bytes, and the whole run: pairs (name of the K bytes at the position, name of all bytes that the run's windows
     cover) are sorted. A run alone in its class of K bytes is unique and ends. Of equal runs only the first goes on; all
     windows of the others start earlier too. A run whose class has no other name is unique but for its copies and ends.
  2. 66 bytes: a window reaches half of ``length - K`` bytes beyond the K bytes to the left or to the right. Windows that
     reach left end if no other run of their class has the same bytes there, and so do those that reach right.
  3. ``length``: what is left are windows at the edges of repeated passages, a row each. Pairs (name of the first 64 bytes,
     name of the last 64), each of names of K bytes, are sorted; all but the first of each class start earlier too.

Names are 64-bit hashes, which a task has at hand without a sort. Rows of one name need not meet in one task: a task first
drops all but the first of equal runs, and of equal windows, among its own rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K = 32
#: Bytes of text that are worked on at a time; longer texts are cut to overlapping segments.
SEGMENT = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def rank_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the K = 32 bytes at each position."""
    n = len(raw) - K + 1
    w = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view("<u8").ravel()
    h = _mix(w[: n])
    for k in (8, 16, 24):
        h = _mix(h + w[k : k + n])
    return h


def halves(h: np.ndarray, first: np.ndarray, count: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """32 bits each of the hashes of the bytes left and right of the K bytes at ``at``, half way to ``length``.

    A run whose windows do not reach that far on a side gets bits of its own there: it can share no window on that side.
    """
    left = (length - K) // 2
    right = length - K - left
    out = []
    for offsets, there in (
        (range(-left, 0, K), at - left >= first),
        (range(right, 0, -K), at + K + right <= first + count + length - 1),
    ):
        own = _mix((at.astype(np.uint64) << np.uint64(20)) ^ first.astype(np.uint64) ^ h[at])
        got = np.zeros(len(at), np.uint64)
        for k in offsets:
            got = _mix(got + h[np.clip(at + k, 0, len(h) - 1)])
        out.append(np.where(there, got, own) >> np.uint64(32))
    return (out[0] << np.uint64(32)) | out[1]


def runs(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, place chosen, hashes) of each run of windows that chose the same position.

    The key that windows are compared by is 40 bits of the hash, then the place, the later first; a choice depends on
    nothing but the window's bytes.
    """
    n = len(raw) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    h = rank_hashes(raw)
    place = np.arange(len(h), dtype=np.uint64)
    low = (h & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - place)
    span, have = length - K + 1, 1
    while 2 * have <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    chosen = np.uint64(0xFFFFFF) - (low & np.uint64(0xFFFFFF))
    begin = np.concatenate([[0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1])
    return begin, np.diff(np.concatenate([begin, [n]])), chosen[begin].astype(np.int64), h


def segments(raw: np.ndarray, at: np.ndarray, length: int):
    """(row, offset in the row, bytes) of all segments of all rows; each window lies in exactly one."""
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        for s in range(a, max(b - length + 1, a), SEGMENT):
            yield i, s - a, raw[s : min(b, s + SEGMENT + length - 1)]


def _runs_of(raw: np.ndarray, at: np.ndarray, length: int):
    """Runs of many rows: (row, first window in its row, number of windows, rank at K, next rank, halves, middle).

    The windows up to the middle one of a run reach far enough to the left to hold its left half, others its right half.
    """
    rows, firsts, counts, ranks, nexts, sides, middles = [], [], [], [], [], [], []
    left = (length - K) // 2
    digest = xxhash.xxh3_64_intdigest

    def add(piece, begin, count, place, h, row, offset):
        data = memoryview(np.ascontiguousarray(piece))
        nexts.append(np.fromiter((digest(data[a:b]) for a, b in zip(begin.tolist(), (begin + count + length - 1).tolist(), strict=True)), np.uint64, len(begin)))
        rows.append(row)
        firsts.append(offset)
        counts.append(count)
        ranks.append(h[place])
        sides.append(halves(h, begin, count, place, length))
        middles.append(np.clip(place - left - begin, -1, count - 1))

    for i, j in common.parts(at, SEGMENT):
        a, b = int(at[i]), int(at[j])
        if b - a > 2 * SEGMENT:
            for _, offset, piece in segments(raw[a:b], np.array([0, b - a]), length):
                begin, count, place, h = runs(piece, length)
                if len(begin):
                    add(piece, begin, count, place, h, np.full(len(begin), i), begin + offset)
            continue
        # all rows of the part as one text: windows over the end of a row are cut off their runs
        piece = raw[a:b]
        begin, count, place, h = runs(piece, length)
        if not len(begin):
            continue
        ends = at[i + 1 : j + 1] - a
        row = np.searchsorted(ends, begin, side="right")
        # a run may go on into the next rows: cut it at each row's last window and at each row's start
        last = ends[row] - length
        stop = begin + count
        over = np.flatnonzero(stop > last + 1)
        extra = []
        for x in over.tolist():
            r, s = int(row[x]) + 1, int(stop[x])
            while r < len(ends) and (start := int(ends[r - 1])) < s:
                end = min(s, int(ends[r]) - length + 1)
                if end > start:
                    extra.append((start, end - start, int(place[x]), r))
                r += 1
        count = np.minimum(stop, last + 1) - begin
        good = count > 0
        begin, count, place, row = begin[good], count[good], place[good], row[good]
        if extra:
            e = list(zip(*extra, strict=True))
            begin, count, row = np.append(begin, e[0]), np.append(count, e[1]), np.append(row, e[3])
            place = np.append(place, e[2])
        starts = np.concatenate([[0], ends[:-1]])
        add(piece, begin, count, place, h, row + i, begin - starts[row])
    if not rows:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 3 + (np.empty(0, np.int64),)
    return tuple(np.concatenate(x) for x in (rows, firsts, counts, ranks, nexts, sides, middles))


SPAN = "row long, first long, end long"
RUN = "rank long, next long, sides long, row long, first long, count int, middle int"
HEADS = pa.schema([("row", pa.int64()), ("first", pa.int64()), ("end", pa.int64()), ("rank", pa.int64()), ("sides", pa.int64()), ("middle", pa.int64())])


def _spans(row, first, end, rank=None, sides=None, middle=None) -> pa.RecordBatch:
    none = pa.nulls(len(row), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(first, pa.int64()), pa.array(end, pa.int64()), none if rank is None else pa.array(rank, pa.int64()), none if sides is None else pa.array(sides, pa.int64()), none if middle is None else pa.array(middle, pa.int64())], schema=HEADS)


def _again(*keys: np.ndarray) -> np.ndarray:
    """Of sorted rows, whether a row's keys are those of the row before."""
    same = np.ones(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        same &= k[1:] == k[:-1]
    return np.concatenate([[False], same]) if len(keys[0]) else np.empty(0, bool)


def repeated_spans(texts: DataFrame, length: int, group: str = "") -> DataFrame:
    """(row, first, end): spans that together cover what starts earlier too, of ``texts`` (row, text).

    ``row`` is a long without nulls or ties that orders the texts.
    """
    if length < K:
        raise ValueError(f"length is at least {K}")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sample(batches):
        for batch in batches:
            raw, at = common.text_bytes(batch.column(1))
            row, first, count, rank, nxt, sides, middle = _runs_of(raw, at, length)
            if not len(row):
                continue
            row = batch.column(0).to_numpy(zero_copy_only=False)[row]
            # equal runs among these rows: all but the first are known to be repeats (count is negative)
            o = np.lexsort((first, row, nxt, rank))
            row, first, count, rank, nxt, sides, middle = row[o], first[o], count[o], rank[o], nxt[o], sides[o], middle[o]
            count = np.where(_again(rank, nxt, count), -count, count)
            for i in range(0, len(row), 100_000):
                s = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(rank[s].view(np.int64)), pa.array(nxt[s].view(np.int64)), pa.array(sides[s].view(np.int64)), pa.array(row[s]), pa.array(first[s]), pa.array(count[s].astype(np.int32)), pa.array(middle[s].astype(np.int32))], ["rank", "next", "sides", "row", "first", "count", "middle"])

    found = texts.mapInArrow(common.trimmed(sample), RUN)
    # repeats are dealt out by a key of their own, so a hot rank brings its task only a row per batch of texts
    key = F.when(F.col("count") < 0, F.xxhash64("row", "first")).otherwise(F.col("rank"))
    dealt = found.repartition(n, key).sortWithinPartitions("rank", "next", "row", "first")

    def rerank(batches):
        """Rows in order of rank, next rank and place: spans of all but the first, and of firsts that have neighbours."""
        last_rank = last_next = last_count = None
        pending: list | None = None  # the first row of a rank that has had no other next rank
        for batch in batches:
            rank, nxt, sides, row, first, count, middle = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            known = count < 0
            if known.any():
                yield _spans(row[known], first[known], first[known] - count[known] + length - 1)
                rank, nxt, sides, row, first, count, middle = (x[~known] for x in (rank, nxt, sides, row, first, count, middle))
            if not len(rank):
                continue
            same_rank = np.concatenate([[last_rank is not None and rank[0] == last_rank], rank[1:] == rank[:-1]])
            same = same_rank & np.concatenate([[nxt[0] == last_next and count[0] == last_count], (nxt[1:] == nxt[:-1]) & (count[1:] == count[:-1])])
            if same.any():
                yield _spans(row[same], first[same], first[same] + count[same] + length - 1)
            # heads: first rows of a next rank; those that share their rank with another head go on
            head = np.flatnonzero(~same)
            if len(head):
                joined = same_rank[head].copy()
                if joined[0] and pending is not None:
                    yield _spans(*([x] for x in pending))
                shared = joined.copy()
                shared[:-1] |= joined[1:]
                end = head[-1]
                pending = None if shared[-1] else [int(x) for x in (row[end], first[end], first[end] + count[end], rank[end], sides[end], first[end] + middle[end])]
                go = head[shared]
                if len(go):
                    yield _spans(row[go], first[go], first[go] + count[go], rank[go], sides[go], first[go] + middle[go])
            last_rank, last_next, last_count = rank[-1], nxt[-1], count[-1]

    got = common.materialize(dealt.mapInArrow(common.trimmed(rerank), "row long, first long, end long, rank long, sides long, middle long"), "runs", group)
    # half way: the windows of a run on the side of each of its halves; those of a half that no other run has end there
    half = F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.shiftright("sides", 32).alias("half"), F.col("first").alias("lo"), (F.col("middle") + 1).alias("hi")),
        F.struct(F.lit(1).alias("side"), F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF)).alias("half"), (F.col("middle") + 1).alias("lo"), F.col("end").alias("hi")),
    )).alias("h")
    sided = got.where("rank is not null").select("row", "rank", half).select("row", "rank", "h.*")
    shared = sided.groupBy("rank", "side", "half").count().where("count > 1").drop("count")
    left = sided.where("lo < hi").join(shared, ["rank", "side", "half"], "left_semi")
    left = left.groupBy("row").agg(F.collect_list(F.struct(F.col("lo").alias("first"), F.col("hi").alias("end"))).alias("windows"))
    left = common.materialize(left, "edges", group)

    offsets, size = names_of(length)

    def windows(batches):
        """Each window of the edges with the names of its first and last bytes; known repeats have their place negative."""
        for batch in batches:
            held: list[tuple] = []
            have = 0
            for row, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                for s in spans:
                    for lo in range(s["first"], s["end"], SEGMENT):
                        hi = min(s["end"], lo + SEGMENT)
                        held.append((raw[lo : hi + length - 1], row, lo, hi - lo))
                        have += hi - lo
                        if have > 200_000:
                            yield from ordered_windows(held)
                            held, have = [], 0
            if held:
                yield from ordered_windows(held)

    def ordered_windows(held: list[tuple]):
        """The windows of spans (bytes, row, first window, number of windows), sorted by their names."""
        pieces, rows, los, counts = zip(*held, strict=True)
        count, size_ = np.array(counts), np.fromiter(map(len, pieces), np.int64, len(pieces))
        h = rank_hashes(np.concatenate(pieces))
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(np.cumsum(size_) - size_, count) + within
        row, first = np.repeat(np.array(rows), count), np.repeat(np.array(los), count) + within
        k1, k2 = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for o in offsets:
            k1 = _mix(k1 + h[at + o])
            k2 = _mix(k2 + h[at + length - size + o])
        k1, k2 = k1.view(np.int64), k2.view(np.int64)
        o = np.lexsort((first, row, k2, k1))
        k1, k2, row, first = k1[o], k2[o], row[o], first[o]
        first = np.where(_again(k1, k2), -1 - first, first)
        for i in range(0, len(o), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (k1, k2, row, first)], ["k1", "k2", "row", "first"])

    def last_rank(batches):
        """Windows in order of their bytes' digest and place: spans of all but the first."""
        before = None
        for batch in batches:
            k1, k2, row, first = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            known = first < 0
            if known.any():
                yield _spans(row[known], -1 - first[known], -1 - first[known] + length).select(["row", "first", "end"])
                k1, k2, row, first = (x[~known] for x in (k1, k2, row, first))
            if not len(k1):
                continue
            same = _again(k1, k2)
            same[0] = before == (k1[0], k2[0])
            before = (k1[-1], k2[-1])
            yield _spans(row[same], first[same], first[same] + length).select(["row", "first", "end"])

    bytes_of = texts.withColumn("text", F.col("text").cast("binary")).join(left, "row").select("row", "text", "windows")
    ranked = bytes_of.mapInArrow(common.trimmed(windows), "k1 long, k2 long, row long, first long")
    key = F.when(F.col("first") < 0, F.xxhash64("row", "first")).otherwise(F.xxhash64("k1", "k2"))
    again = ranked.repartition(n, key).sortWithinPartitions("k1", "k2", "row", "first").mapInArrow(common.trimmed(lambda batches: _merge(last_rank(batches))), SPAN)
    return got.where("rank is null").select("row", "first", "end").mapInArrow(common.trimmed(_merge), SPAN).union(again)


def names_of(length: int) -> tuple[list[int], int]:
    """Offsets of the K-byte names of the largest power of two times K bytes up to ``length``, and that size."""
    size = K
    while 2 * size <= length:
        size *= 2
    return list(range(0, size, K)), size


def sorted_ranks(df: DataFrame, key: list[str], tie: list[str], group: str = "") -> DataFrame:
    """``df`` with rank (long, the same for equal ``key``, in its order), begins (first of its class by ``tie``) and alone.

    Rows are sorted by key and tie over ranges, so a class of any size may lie in several of them. Ranges number their
    own classes; where a range begins with the class that one before it ends with, it takes over that one's rank. What
    the driver sees is one row for each range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *key, *tie).sortWithinPartitions(*key, *tie)
    names = df.columns
    at = [names.index(k) for k in key]

    def number(batches):
        from pyspark import TaskContext

        part, count, last, held = TaskContext.get().partitionId(), -1, None, None

        def out(batch, local, begins, alone):
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(local), part)), pa.array(local), pa.array(begins), pa.array(alone)], [*names, "part", "local", "begins", "alone"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in at]
            begins = np.ones(batch.num_rows, bool)
            begins[1:] = ~_again(*cols)[1:]
            begins[0] = last != tuple(c[0] for c in cols)
            if held is not None:  # the last row of the batch before now knows whether its class goes on
                yield out(held[0], held[1], held[2], held[2] & begins[:1])
            local = count + np.cumsum(begins)
            alone = begins.copy()
            alone[:-1] &= begins[1:]
            if batch.num_rows > 1:
                yield out(batch[:-1], local[:-1], begins[:-1], alone[:-1])
            held = batch[-1:], local[-1:], begins[-1:]
            count, last = int(local[-1]), tuple(c[-1] for c in cols)
        if held is not None:
            yield out(held[0], held[1], held[2], held[2])

    fields = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    found = common.materialize(rows.mapInArrow(common.trimmed(number), f"{fields}, part long, local long, begins boolean, alone boolean"), "sorted", group)
    values = F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(key)))
    ranges = found.groupBy("part").agg(F.min(values).alias("low"), F.max(values).alias("high"), F.max("local").alias("last")).orderBy("part").collect()
    into, goes_on, before = {}, {}, None
    for r in ranges:
        if before is not None and before.high == r.low:
            into[r.part] = into[before.part] if before.part in into and not before.last else before.part << 40 | before.last
            goes_on[before.part] = before.last
        before = r

    def looked_up(table: dict, c: str):
        return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)).cast("map<long,long>"), F.col(c)) if table else F.lit(None).cast("long")

    carried = F.when(F.col("local") == 0, looked_up(into, "part"))
    rank = F.coalesce(carried, F.shiftleft("part", 40).bitwiseOR(F.col("local")))
    continues = F.coalesce(looked_up(goes_on, "part") == F.col("local"), F.lit(False))
    return found.select(*names, rank.alias("rank"), (F.col("begins") & carried.isNull()).alias("begins"), (F.col("alone") & carried.isNull() & ~continues).alias("alone"))


def plain_spans(texts: DataFrame, length: int, group: str = "") -> DataFrame:
    """What ``repeated_spans`` returns, by prefix doubling over every byte of ``texts`` (row, text).

    A row for each position goes through a sort and a join in each round; kept as the method in its plain form, for
    comparison.
    """
    if length < 16:
        raise ValueError("length is at least 16")

    def positions(batches):
        for batch in batches:
            raw, at = common.text_bytes(batch.column(1))
            for row, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for lo in range(a, b - 7, SEGMENT):
                    piece = np.ascontiguousarray(raw[lo : min(b, lo + SEGMENT + 7)])
                    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(piece, 8)).view(">i8").ravel().astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(eight), row)), pa.array(np.arange(lo - a, lo - a + len(eight))), pa.array(eight)], ["row", "at", "rank_"])

    ranked, size = texts.mapInArrow(common.trimmed(positions), "row long, at long, rank_ long"), 8
    while size < length:
        step = min(size, length - size)  # the last step overlaps
        after = ranked.select("row", (F.col("at") - step).alias("at"), F.col("rank_").alias("next"))
        pairs = common.materialize(ranked.join(after, ["row", "at"]), "pairs", group)
        size += step
        ranked = sorted_ranks(pairs, ["rank_", "next"], ["row", "at"], group)
        if size < length:  # a position that is unique here is unique in every wider round
            ranked = ranked.where("not alone").select("row", "at", F.col("rank").alias("rank_"))
    return ranked.where("not begins").select("row", F.col("at").alias("first"), (F.col("at") + length).alias("end"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of [first, end) spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    parts.append(data[at:])
    return b"".join(parts)


def _merge(batches):
    """Spans of each row, touching ones merged, sorted within a batch."""
    for batch in batches:
        row, first, end = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(row):
            continue
        o = np.lexsort((first, row))
        row, first, end = row[o], first[o], end[o]
        # rows side by side on one line, with a gap between any two: a new run starts after each gap
        base = np.concatenate([[0], np.cumsum(row[1:] != row[:-1])]) * (int(end.max()) + 1)
        upto, place = np.maximum.accumulate(end + base), first + base
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] > upto[:-1])])
        begin = np.flatnonzero(new)
        stop = np.maximum.reduceat(end, begin)
        yield pa.RecordBatch.from_arrays([pa.array(row[begin]), pa.array(first[begin]), pa.array(stop)], ["row", "first", "end"])


def _compact(spans: DataFrame) -> DataFrame:
    """(row, spans): all spans of each row."""
    return spans.groupBy("row").agg(F.collect_list(F.struct("first", "end")).alias("spans"))


def ordered(docs: DataFrame, group: str = "") -> DataFrame:
    """``docs`` with ``_row``, a long without nulls or ties in the order of doc_id, nulls first.

    That is doc_id itself where it has neither; else rows are ordered (those that share an id by a hash of their text)
    and written with a number each.
    """
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("id")).count()
    if ids.where("count > 1 or id is null").isEmpty():
        return docs.withColumn("_row", F.col("doc_id").cast("long"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.withColumn("_tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text")
    return common.materialize(rows.drop("_tie").withColumn("_row", F.monotonically_increasing_id()), "ordered", group)


def with_spans(docs: DataFrame, length: int = 100, group: str = "") -> DataFrame:
    """``docs`` with ``_spans``, the spans of its UTF-8 bytes to remove; needs doc_id and text.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a row before (by doc_id, nulls
    first, rows that share an id by a hash of their text) or in the same row. A null text is empty. Judged on the input.
    """
    rows = ordered(docs, group)
    spans = _compact(repeated_spans(rows.select(F.col("_row").alias("row"), "text"), length, group))
    spans = common.materialize(spans.select(F.col("row").alias("_row"), F.col("spans").alias("_spans")), "spans", group)
    return rows.join(spans, "_row", "left").drop("_row")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = common.columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")

    def judge(batches):
        for batch in batches:
            out = []
            for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text or b""
                runs_ = merged([(s["first"], s["end"]) for s in spans or ()])
                out.append((doc, len(data), sum(b - a for a, b in runs_), len(runs_), hashlib.sha256(cut(data, runs_)).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs).select("doc_id", "text", "_spans").mapInArrow(common.trimmed(judge), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
