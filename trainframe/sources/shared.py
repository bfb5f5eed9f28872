"""Tables that an operator writes once and reads again, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset a local session gets a temporary folder; a cluster has none to guess."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="trainframe-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        path = "file://" + path
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def filesystem(path: str):
    """pyarrow's file system and path for ``path``; for files of the shared folder that executors write and read themselves."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def written(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again, so that all that is derived from it sees the same rows."""
    spark = df.sparkSession
    path = path or new_path(spark, what)
    schema = df.schema
    void = [f.name for f in schema.fields if isinstance(f.dataType, T.NullType)]  # Parquet has no such type
    df.drop(*void).write.option("compression", "zstd").parquet(path)
    got = spark.read.schema(T.StructType([f for f in schema.fields if f.name not in void])).parquet(path)
    return got.select(*(F.lit(None).alias(f.name) if f.name in void else F.col(f"`{f.name}`") for f in schema.fields))
