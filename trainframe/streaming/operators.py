"""Operators on streams, and which of the library's are none."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Operators that need all rows at once.
WHOLE = ("sort", "tail", "shuffle", "split", "sample", "head", "skip", "slice", "group", "diff", "describe")


class NotOnStreams(ValueError):
    pass


def check(df: DataFrame, op: str) -> None:
    if df.isStreaming and op in WHOLE:
        raise NotOnStreams(f"{op} needs all rows; a stream has no end. Write the stream out and read that.")


def dedupe_stream(df: DataFrame, keys: list[str], event_time: str, within: str = "10 minutes") -> DataFrame:
    """The first row of each key within a watermark; state older than that is dropped."""
    return df.withWatermark(event_time, within).dropDuplicatesWithinWatermark(keys)


def windowed_counts(df: DataFrame, event_time: str, by: list[str], window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window(event_time, window, slide) if slide else F.window(event_time, window)
    return df.withWatermark(event_time, late).groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def drain(df: DataFrame, path: str | None = None, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote: Parquet, exactly once by its checkpoint.

    Without a path it goes to the shared folder.
    """
    spark = df.sparkSession
    base = path or shared_dir(spark)
    out = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-state").option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def keep_last(df: DataFrame, n: int, path: str, order: list[str]):
    """A sink that holds the last ``n`` rows: each batch is joined with what is there and cut."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = f"{path}/{epoch - 1}"
        try:
            batch = spark.read.schema(batch.schema).parquet(old).unionByName(batch) if epoch else batch
        except Exception as e:  # the first epoch after a restart may have no file
            if "PATH_NOT_FOUND" not in str(e):
                raise
        batch.orderBy(*(F.col(c).desc() for c in order)).limit(n).write.mode("overwrite").parquet(f"{path}/{epoch}")

    return df.writeStream.foreachBatch(write)
