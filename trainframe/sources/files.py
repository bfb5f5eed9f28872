"""Reading and writing datasets by extension, with a physical row order where the format has one."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import ORDINAL

FORMATS = {".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json", ".csv": "csv", ".tsv": "tsv", ".parquet": "parquet", ".arrow": "arrow", ".feather": "arrow", ".orc": "orc", ".txt": "text", ".xlsx": "excel", ".xls": "excel"}


class BadRecord(ValueError):
    pass


def detect_file_format(path: str) -> str:
    """By extension without .gz; unknown ones are JSON lines, none is a Parquet directory."""
    base = path.rstrip("/").removesuffix(".gz")
    ext = os.path.splitext(base)[1].lower()
    return FORMATS.get(ext, "jsonl") if ext else "parquet"


def _nested(df: DataFrame) -> DataFrame:
    """Texts that all are JSON objects or lists become what they hold, as VARIANT."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df

    def odd(c: str) -> Column:
        x = F.col(f"`{c}`")
        return F.count(F.when(x.isNotNull() & ~(x.rlike(r"^\s*[\[{]") & F.try_parse_json(x).isNotNull()), 1)).alias(c)

    counts = df.agg(*(odd(c) for c in texts), *(F.count(F.col(f"`{c}`")).alias(f"n_{c}") for c in texts)).first()
    for c in texts:
        if counts[c] == 0 and counts[f"n_{c}"]:
            df = df.withColumn(c, F.parse_json(F.col(f"`{c}`")))
    return df


def read_jsonl(spark: SparkSession, path: str | list[str], bad: str = "raise", schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines, blank ones skipped. A bad line raises with its text, is skipped, or is kept in ``_raw_line``.

    bad: raise, skip or keep.
    """
    reader = spark.read.option("mode", {"raise": "FAILFAST", "skip": "DROPMALFORMED", "keep": "PERMISSIVE"}[bad])
    if bad != "keep":
        return (reader.schema(schema) if schema else reader).json(path)
    found = schema or spark.read.option("mode", "DROPMALFORMED").json(path).schema
    found = T._parse_datatype_string(found) if isinstance(found, str) else found
    whole = T.StructType([*found.fields, T.StructField("_raw_line", T.StringType())])
    return reader.option("columnNameOfCorruptRecord", "_raw_line").schema(whole).json(path)


def read_exact(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(_raw, v): each line as it stands and as VARIANT, for ragged data that must be written back unchanged."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.col("value").alias("_raw"), F.try_parse_json("value").alias("v"))


def read_arrow(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Arrow IPC files and streams, a task a file. Files are read whole, by Spark, so any of its stores will do."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                buf = content.as_buffer()
                try:
                    yield from pa.ipc.open_file(buf).read_all().to_batches()
                except pa.ArrowInvalid:
                    yield from pa.ipc.open_stream(buf).read_all().to_batches()

    if schema is None:
        from pyspark.sql.pandas.types import from_arrow_schema

        def described(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for content in batch.column(0):
                    buf = content.as_buffer()
                    try:
                        found = pa.ipc.open_file(buf).schema
                    except pa.ArrowInvalid:
                        found = pa.ipc.open_stream(buf).schema
                    yield pa.RecordBatch.from_pydict({"schema": [found.serialize().to_pybytes()]})

        import pyarrow as pa

        first = files.limit(1).mapInArrow(described, "schema binary").first()["schema"]  # only that comes to the driver
        schema = from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(first)))
    return files.mapInArrow(run, schema)


def load_ordered(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """``load`` with the hidden column ``ORDINAL``."""
    fmt = options.get("fmt") or detect_file_format(path if isinstance(path, str) else path[0])
    return with_ordinal(load(spark, path, **options), fmt)


def load(spark: SparkSession, path: str | list[str], fmt: str | None = None, decode: bool = True, **options) -> DataFrame:
    """Read by extension; a directory or pattern is all its files. ``decode`` turns JSON texts of CSV to VARIANT."""
    first = path if isinstance(path, str) else path[0]
    fmt = fmt or detect_file_format(first)
    if fmt == "jsonl":
        return read_jsonl(spark, path, **options)
    if fmt == "json":
        return spark.read.option("multiLine", True).json(path)
    if fmt in ("csv", "tsv"):
        df = spark.read.csv(path, header=True, inferSchema=True, sep="\t" if fmt == "tsv" else ",", multiLine=True, escape='"')
        return _nested(df) if decode else df
    if fmt == "arrow":
        return read_arrow(spark, path)
    if fmt == "excel":
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path))
    return spark.read.format(fmt).load(path)


def with_ordinal(df: DataFrame, fmt: str = "parquet", name: str = ORDINAL) -> DataFrame:
    """``df``, as read by ``load``, with each row's place as a text: its file, then the row in it.

    Parquet knows the row; of other files it is the block's place and the row's number in the block, which is that of
    its line. Files come in the order of their paths.
    """

    def padded(c: Column) -> Column:
        return F.lpad(c.cast("string"), 20, "0")

    if fmt in ("arrow", "excel", ""):  # rows that no reader of Spark's has made
        return df.withColumn(name, padded(F.monotonically_increasing_id()))
    file = F.col("_metadata.file_path")
    if fmt == "parquet":
        return df.select("*", F.concat(file, F.lit(" "), padded(F.col("_metadata.row_index"))).alias(name))
    return df.select("*", F.concat(file, F.lit(" "), padded(F.col("_metadata.file_block_start")), padded(F.monotonically_increasing_id())).alias(name))


def count_rows(spark: SparkSession, path: str, fmt: str | None = None) -> int:
    """Parquet counts come from footers; of JSON lines those that are not blank count, parsed or not."""
    fmt = fmt or detect_file_format(path)
    if fmt == "jsonl":
        return spark.read.text(path).where(F.trim("value") != "").count()
    return load(spark, path, fmt, decode=False).count() if fmt in ("csv", "tsv") else load(spark, path, fmt).count()


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON texts, for formats without nesting."""
    return df.select(*(F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType | T.VariantType) else F.col(f"`{f.name}`") for f in df.schema.fields))


def save(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite", rows_per_file: int | None = None) -> None:
    """Write by extension to a directory, committed as a whole. Nulls are written, nested CSV cells are JSON texts.

    What replaces something is written beside it and then takes its place, so a failure leaves the old data, and rows may
    come from the very files that they replace.
    """
    fmt = fmt or detect_file_format(path)
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if mode == "overwrite" and fmt != "excel" and store.exists(target):
        fresh = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
        beside = spark._jvm.org.apache.hadoop.fs.Path(fresh)
        try:
            _write(df, fresh, fmt, "errorifexists", rows_per_file, path.endswith(".gz"))
            store.delete(target, True)
            store.rename(beside, target)
        finally:
            store.delete(beside, True)
        return
    _write(df, path, fmt, mode, rows_per_file, path.endswith(".gz"))


def _write(df: DataFrame, path: str, fmt: str, mode: str, rows_per_file: int | None, packed: bool) -> None:
    if fmt == "excel":
        flat(df).toPandas().to_excel(path, index=False)
        return
    writer = (flat(df) if fmt in ("csv", "tsv") else df).write.mode(mode)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if packed:
        writer = writer.option("compression", "gzip")
    if fmt in ("jsonl", "json"):
        if df.columns in (["_raw"], ["_raw", "v"]):
            (df.select("_raw").write.mode(mode)).text(path)
        else:
            writer.option("ignoreNullFields", "false").json(path)
    elif fmt in ("csv", "tsv"):
        writer.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").option("escape", '"').csv(path)
    elif fmt == "arrow":
        _save_arrow(df, path, mode)
    else:
        writer.format(fmt).save(path)


def _save_arrow(df: DataFrame, path: str, mode: str) -> None:
    """An Arrow file for each partition, written by pyarrow's file systems next to each other."""
    if mode == "overwrite":
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        store.create_dir(base, recursive=True)
        out, n, name = None, 0, f"{base}/part-{TaskContext.get().partitionId():05d}.arrow"
        part = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
        for batch in batches:
            if out is None:
                sink = store.open_output_stream(part)
                out = pa.ipc.new_file(sink, batch.schema)
            out.write_batch(batch)
            n += batch.num_rows
        if out is not None:
            out.close()
            sink.close()
            store.move(part, name)
        yield pa.RecordBatch.from_pydict({"n": [n]}, pa.schema([("n", pa.int64())]))

    df.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def save_sharded(df: DataFrame, path: str, shard_rows: int, order: list[str]) -> None:
    """``shard=00000`` ... with exactly ``shard_rows`` rows each but the last, in order, as JSON lines."""
    from ..operators.order import ranked_rows

    ranked = ranked_rows(df, [F.col(f"`{c}`") for c in order], "_at")
    shard = F.lpad(F.floor(F.col("_at") / shard_rows).cast("string"), 5, "0")
    out = ranked.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", "_at").drop("_at")
    out.write.mode("overwrite").partitionBy("shard").option("ignoreNullFields", "false").json(path)


def append(df: DataFrame, path: str) -> None:
    save(df, path, "jsonl", mode="append")


def batches(df: DataFrame, size: int) -> Iterator[list[dict]]:
    """Rows as lists of dicts of at most ``size``, a partition at a time on the driver."""
    held: list[dict] = []
    for row in df.toLocalIterator():
        held.append(row.asDict(recursive=True))
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def emit(df: DataFrame, out, fmt: str = "jsonl") -> int:
    """Write rows to a stream as JSON lines or CSV; returns their number."""
    n = 0
    if fmt == "csv":
        import csv

        w = csv.writer(out)
        w.writerow(df.columns)
        for row in flat(df).toLocalIterator():
            w.writerow(row)
            n += 1
        return n
    for row in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
        out.write(row.j + "\n")
        n += 1
    return n


def read_stream(spark: SparkSession, stream) -> DataFrame:
    """JSON lines from a binary stream such as standard input, unpacked if it begins as gzip does."""
    import gzip
    import io

    buf = stream if hasattr(stream, "peek") else io.BufferedReader(stream)
    data = gzip.GzipFile(fileobj=buf) if buf.peek(2)[:2] == b"\x1f\x8b" else buf
    return from_lines(spark, io.TextIOWrapper(data, encoding="utf-8").read().splitlines())


def from_lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    """JSON lines that the driver has at hand, as from standard input."""
    for k, line in enumerate(lines, 1):
        if line.strip():
            try:
                json.loads(line)
            except ValueError as e:
                raise BadRecord(f"line {k}: {e}") from None
    df = spark.createDataFrame([(line,) for line in lines if line.strip()], "value string")
    return spark.read.json(df.select("value").rdd.map(lambda r: r[0]))
