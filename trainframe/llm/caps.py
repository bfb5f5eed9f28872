"""Near-duplicate vectors by spherical-cap filters of structured random product codes.

A filter is a direction; it holds the vectors whose inner product with it exceeds a level, a cap of the sphere. The
directions of one code are all concatenations of one codeword for each block of coordinates (after a random rotation), so
a vector's filters are decoded block by block without visiting the rest. Vectors meet in a filter, where all pairs are
verified in double precision by matrix products, and each pair counts in the first filter that holds both. The number of
filters and their level follow from the number of vectors (``plan``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Codes; least codewords of a block, and least level in standard deviations of a random vector's inner product.
CODES, WORDS, LEVEL = 5, 128, 3.2
#: Filters that a pair at the least cosine shares on average, and random vectors that a filter holds at most on average.
SHARED, HELD = 15.0, 32.0
#: Most codewords of a block; beyond that filters hold more.
MOST_WORDS = 32_768
#: Filters of more vectors are cut to chunks of this size, of which each pair is verified on its own.
CHUNK = 4096


@dataclass(frozen=True)
class Plan:
    """Codewords of a block, and the level of inner products that a filter's vectors exceed."""

    words: int
    level: float


def blocks_of(dim: int) -> int:
    return 2 if dim >= 4 else 1


@lru_cache(maxsize=64)
def tails(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of [-1, 1], and the share of the unit sphere whose first coordinate is at least that."""
    angle = np.linspace(np.pi, 0, 20_001)
    weight = np.sin(angle) ** (dim - 2) if dim >= 2 else np.zeros_like(angle)
    if dim < 2:
        return np.cos(angle), np.where(np.cos(angle) <= -1, 1.0, 0.5)
    part = np.concatenate([[0.0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
    return np.cos(angle), 1 - part / part[-1]


def chances(dim: int, level: float, cosine: float) -> tuple[float, float]:
    """The chance that a random vector is in a filter, and that both of a pair with this cosine are."""
    x, over = tails(dim)
    y, rest = tails(max(dim - 1, 1))
    one = float(np.interp(level, x, over))
    at = np.linspace(level, 1, 2001)
    share = -np.diff(np.interp(at, x, over))
    mid = (at[1:] + at[:-1]) / 2
    with np.errstate(divide="ignore"):
        need = (level - cosine * mid) / (math.sqrt(max(1 - cosine**2, 1e-12)) * np.sqrt(1 - mid**2))
    return one, float((share * np.interp(np.clip(need, -1, 1), y, rest, right=0) * (need <= 1)).sum())


def plan(n: int, dim: int, cosine: float = 0.9) -> Plan:
    """The code for ``n`` vectors: more of them get a higher level, so that filters stay small, and as many more codewords.

    The number of filters grows so that a pair at ``cosine`` still shares ``SHARED`` of them; what a vector is compared with
    is its filters times what they hold, which grows far slower than ``n``.
    """
    level, words = min(LEVEL / math.sqrt(dim), 0.85), WORDS
    while level < 0.95:
        one, both = chances(dim, level, cosine)
        if n * one <= HELD:
            break
        higher = level + 0.01
        cells = SHARED / CODES / max(chances(dim, higher, cosine)[1], 1e-300)
        want = math.ceil(cells ** (1 / blocks_of(dim)))
        if want > MOST_WORDS:
            break
        level, words = higher, max(words, want)
    return Plan(words, level)


@lru_cache(maxsize=64)
def code(dim: int, k: int, n: int = WORDS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rotation and the ``n`` codewords of each block of code ``k``."""
    rng = np.random.default_rng([20_21, dim, k])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    blocks, cuts = blocks_of(dim), []
    for b in range(blocks):
        words = rng.standard_normal((n, dim * (b + 1) // blocks - dim * b // blocks))
        cuts.append(words / np.linalg.norm(words, axis=1)[:, None] / math.sqrt(blocks))
    return rotation, cuts


def decode(unit: np.ndarray, by: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters of each row of ``unit`` (unit vectors of one dimension), ordered by row."""
    dim, least = unit.shape[1], by.level
    rows, filters = [], []
    for k in range(CODES):
        rotation, words = code(dim, k, by.words)
        turned, half = unit @ rotation, words[0].shape[1]
        first = turned[:, :half] @ words[0].T
        if len(words) == 1:
            r, i = np.nonzero(first >= least)
            f = i
        else:
            second = turned[:, half:] @ words[1].T
            # only codewords that the other block's best one can lift over the level
            r0, i0 = np.nonzero(first + second.max(axis=1)[:, None] >= least)
            r1, i1 = np.nonzero(second + first.max(axis=1)[:, None] >= least)
            begin, end = np.searchsorted(r1, r0), np.searchsorted(r1, r0, side="right")
            size = end - begin
            x = np.repeat(np.arange(len(r0)), size)
            y = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size) + begin[x]
            over = first[r0[x], i0[x]] + second[r0[x], i1[y]] >= least
            x, y = x[over], y[over]
            r, f = r0[x], i0[x].astype(np.int64) * by.words + i1[y]
        rows.append(r)
        filters.append(k * by.words ** len(words) + f)
    row, found = np.concatenate(rows), np.concatenate(filters).astype(np.int64)
    o = np.lexsort((found, row))
    return row[o], found[o]


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision from a column of bytes, each the floats or doubles of a vector of ``dim``."""
    raw, at = common.text_bytes(column)
    v = raw.view("<f4" if len(raw) == 4 * dim * len(column) else "<f8").reshape(len(column), dim).astype(np.float64)
    v /= np.abs(v).max(axis=1)[:, None]
    return v / np.linalg.norm(v, axis=1)[:, None]


def vectors(table: DataFrame, key: str, column: str) -> DataFrame:
    """(vec_id, dim, hash, vec): vec is null where the vector is null, empty, zero or not finite throughout."""
    single = dict(table.dtypes)[column] == "array<float>"
    rows = table.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            out = []
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.empty(0)
                if len(x) and not (v.values.null_count or not np.isfinite(x).all() or not x.any()):
                    data = (np.where(x == 0, 0.0, x)).astype("<f4" if single else "<f8").tobytes()
                    out.append((vec_id, len(x), xxhash.xxh3_128_digest(data), data))
                else:
                    out.append((vec_id, 0, None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["vec_id", "dim", "hash", "vec"])

    return rows.mapInArrow(common.trimmed(run), "vec_id long, dim int, hash binary, vec binary")


MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
MET_SQL = "a long, b long, links long"


def _met(a, b=None, links=None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), none if b is None else pa.array(b, pa.int64()), none if links is None else pa.array(links, pa.int64())], schema=MET)


def verify(which: int, left: tuple, right: tuple | None, least: float, by: Plan):
    """Links between (node, count, unit vectors) of filter ``which`` that no earlier filter holds both ends of."""
    a, na, ua = left
    b, nb, ub = right or left

    def before(unit):
        row, found = decode(unit, by)
        keep = found < which
        return row[keep], found[keep]

    for at in range(0, len(a), 512):  # strips, so that memory is that of 512 rows of products
        near = ua[at : at + 512] @ ub.T >= least
        if right is None:
            near &= np.arange(len(b))[None, :] > np.arange(at, at + len(near))[:, None]
        x, y = near.any(axis=1).nonzero()[0], near.any(axis=0).nonzero()[0]
        if not len(x):
            continue
        near = near[np.ix_(x, y)]
        x = x + at
        (rx, fx), (ry, fy) = before(ua[x]), before(ub[y])
        both = np.intersect1d(fx, fy)
        for c in range(0, len(both), 4096):
            some = both[c : c + 4096]
            mx, my = np.zeros((len(x), len(some)), np.float32), np.zeros((len(y), len(some)), np.float32)
            for m, r, f in ((mx, rx, fx), (my, ry, fy)):
                k = np.minimum(np.searchsorted(some, f), len(some) - 1)
                good = some[k] == f
                m[r[good], k[good]] = 1
            near &= mx @ my.T == 0
        i, j = near.nonzero()
        if not len(i):
            continue
        yield _met(*common.forest(a[x][i], b[y][j]))
        for node, count in ((a[x], near @ nb[y]), (b[y], near.T @ na[x])):
            some = count > 0
            yield _met(node[some], links=count[some])


def links(classes: DataFrame, least: float, group: str = "") -> tuple[DataFrame, DataFrame]:
    """Of distinct vectors (node, n, dim, vec): edges (a, b), a forest of the links, and (node, links), counts of vectors.

    Filters of more than ``CHUNK`` vectors are found by a count first. Their vectors are dealt to chunks by hash, and go to
    each pair of chunks that has theirs, so no task gathers more than two chunks of a filter.
    """
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one row for each length of vectors
    plans = {r.dim: plan(r["count"], r.dim, least) for r in classes.groupBy("dim").count().collect()}

    def spread(whole: bool):
        def run(batches):
            for batch in batches:
                dim = batch.column(0).to_numpy(zero_copy_only=False)
                for d in np.unique(dim).tolist():
                    mine = np.flatnonzero(dim == d)
                    step = max(16, min(512, (1 << 23) // plans[d].words))
                    for i in range(0, len(mine), step):
                        at = mine[i : i + step]
                        vec = batch.column(1).take(pa.array(at))
                        row, found = decode(unit_rows(vec, d), plans[d])
                        cols = [pa.array(found), pa.array(np.full(len(row), d, np.int32))]
                        if whole:
                            cols += [batch.column(k).take(pa.array(at[row])) for k in (2, 3)] + [vec.take(pa.array(row))]
                        yield pa.RecordBatch.from_arrays(cols, ["filter", "dim", "node", "n", "vec"][: len(cols)])

        return common.trimmed(run)

    counted = classes.select("dim", "vec").mapInArrow(spread(False), "filter long, dim int").groupBy("filter", "dim").count()
    hot = common.materialize(counted.where(F.col("count") > CHUNK), "hot-filters", group)
    rows = classes.select("dim", "vec", "node", "n").mapInArrow(spread(True), "filter long, dim int, node long, n long, vec binary")
    whole = F.lit(0).cast("int")
    if hot.isEmpty():
        rows = rows.withColumns({"i": whole, "j": whole, "chunk": whole})
    else:
        rows = rows.join(hot, ["filter", "dim"], "left")
        chunks = F.coalesce(F.ceil(F.col("count") / CHUNK), F.lit(1)).cast("int")
        rows = rows.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        rows = rows.select("filter", "dim", "node", "n", "vec", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk")
    rows = rows.repartition(parts, "filter", "dim", "i", "j").sortWithinPartitions("filter", "dim", "i", "j", "chunk")
    rows = rows.select("filter", "dim", "i", "j", "chunk", "node", "n", "vec")

    def bucket(key: tuple, held: list[tuple]):
        """All rows of a filter, or of two of its chunks, of which the lesser comes first."""
        which, dim, i, j = (int(k) for k in key)
        if len(held) == 1 and len(held[0][0]) < 2:
            return
        chunk, node, n, unit = (np.concatenate(x) for x in zip(*held, strict=True)) if len(held) > 1 else held[0]
        if i == j:
            yield from verify(which, (node, n, unit), None, least, plans[dim])
            return
        cut = int(np.searchsorted(chunk, j))
        if 0 < cut < len(node):
            yield from verify(which, (node[:cut], n[:cut], unit[:cut]), (node[cut:], n[cut:], unit[cut:]), least, plans[dim])

    def meet(batches):
        held, last = [], None
        step = max(16, (1 << 22) // max(plans, default=1))  # rows whose unit vectors are at hand together
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            *key, chunk, node, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            place, units = np.empty(len(node), np.int64), {}
            for d in np.unique(key[1]).tolist():
                mine = np.flatnonzero(key[1] == d)
                place[mine], units[d] = np.arange(len(mine)), unit_rows(batch.column(7).take(pa.array(mine)), d)
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            for i, j in zip([0, *new.tolist()], [*new.tolist(), len(node)], strict=True):
                if (now := tuple(k[i] for k in key)) != last:
                    if held:
                        yield from bucket(last, held)
                    held, last = [], now
                held.append((chunk[i:j], node[i:j], n[i:j], units[int(now[1])][place[i] : place[i] + j - i]))
        if held:
            yield from bucket(last, held)

    met = common.materialize(rows.mapInArrow(common.trimmed(meet), MET_SQL), "met", group)
    return met.where("b is not null").select("a", "b"), met.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))


def near_duplicates(table: DataFrame, key: str = "vec_id", column: str = "embedding", least: float = 0.9, group: str = "") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``table``; links are pairs with cosine ``least`` or more.

    Vectors that are null, empty, zero or not finite throughout link with nothing; vectors of different lengths do not
    link. Equal vectors are one class, so copies cost no pairs: n_links counts them by the sizes of classes. Rows that
    repeat an id are vectors of their own; null ids count only where a component has no other. kept is vec_id =
    component_id, false for null ids.
    """
    rows = common.materialize(vectors(table, key, column), "vectors", group)
    good = rows.where("vec is not null")
    classes = good.groupBy("hash").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    classes = common.materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes", group)
    edges, counts = links(classes, least, group)
    found = common.connected_components(edges, group)
    of = classes.select("hash", "node", "n", "least").join(found, "node", "left").join(counts, "node", "left")
    of = of.select("hash", "least", F.coalesce("component", "node").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    of = common.materialize(of, "class-of", group)
    roots = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(roots, "root").select("hash", "n_links", "component_id")
    linked = good.select("vec_id", "hash").join(of, "hash").select("vec_id", "n_links", "component_id")
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_spherical_caps(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
