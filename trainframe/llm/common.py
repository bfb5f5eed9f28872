"""What the operators share: the cluster's shared folder, written tables, connected components, words."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words; ``bytes.split()`` splits on exactly these.
SPACES = b" \t\n\x0b\x0c\r"
#: Makes Spark delete the shuffle files of a query when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where a local session names none (as in tests) a temporary folder is made and named there; a cluster must name it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="trainframe-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        path = "file://" + path
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, what: str, group: str = "") -> str:
    """A new place in the shared folder; ``release(spark, group)`` deletes what was put there, or else the driver's exit."""
    if not _written:
        atexit.register(_forget)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _written.setdefault(group, []).append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _forget() -> None:
    """When the driver ends: delete what no ``release`` has."""
    spark = SparkSession.getActiveSession()
    for paths in _written.values():
        for path in paths:
            try:
                if path.startswith("file:"):
                    shutil.rmtree(filesystem(path)[1], ignore_errors=True)
                elif spark is not None:
                    delete(spark, path)
            except Exception:  # noqa: BLE001  the session may have ended before
                return


def release(spark: SparkSession, group: str) -> None:
    """Delete the tables that ``group`` has written, once nothing reads them any more."""
    for path in _written.pop(group, []):
        delete(spark, path)


def materialize(df: DataFrame, what: str, group: str = "") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what, group)
    schema = df.schema
    # nothing reads this query's shuffle files once its rows are written
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(schema).parquet(path)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the input can clash with nothing."""
    return df.select(*(F.col(f"`{n}`").alias(n) for n in names))


def trimmed(run):
    """``run``, a function of batches, after which its worker returns the memory that it has freed.

    Workers outlive their task for the next one, and what their allocators keep would add up with other stages' needs.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # only glibc has it
                pass

    return whole


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after another, and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def parts(at: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cut rows with offsets ``at`` to runs of rows of about ``most`` bytes, at least a row each."""
    out, i, n = [], 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        out.append((i, j))
        i = j
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges (a, b) connect: each node's edge to the least node of its component."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def connected_components(edges: DataFrame, group: str = "", most_rounds: int = 60) -> DataFrame:
    """(node, component): for each node with an edge the least node that it reaches.

    ``edges`` has the columns a and b, both long; the direction does not count. Alternates the large-star and
    small-star steps (Kiveris et al., Connected Components in MapReduce and Beyond) until the edges are stars;
    raises where they are not after ``most_rounds``.
    Each round is written to the shared folder. Minima are aggregates, so hubs are combined before the shuffle, and
    the joins back to the edges are plain equi-joins that adaptive execution can split.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = materialize(e, "edges", group), None
    for k in range(most_rounds + 1):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        if k == most_rounds:
            raise RuntimeError(f"connected components: the edges still change after {most_rounds} rounds")
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "edges", group)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("s"))
        e = materialize(small.select(F.col("s.v").alias("u"), F.col("s.m").alias("v")).where("u <> v").distinct(), "edges", group)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def filesystem(path: str):
    """pyarrow's file system and path for ``path``; used by executors for files that no Spark writer makes."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def put_file(path: str, write) -> None:
    """Write a file by ``write(stream)`` under another name and move it into place, so that a task can be repeated."""
    files, where = filesystem(path)
    files.create_dir(os.path.dirname(where), recursive=True)
    part = f"{where}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(part) as out:
        write(out)
    files.move(part, where)
