"""Shared storage of intermediate results: tables and files that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new path under the cluster's spark.checkpoint.dir. Where that is unset a local master (tests) gets one here; on a cluster
    it is an error, as executors don't see each other's disks."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="barline-"))
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def arrow_opens(uri: str) -> bool:
    """Whether tasks open a path through pyarrow: file, hdfs and s3 where it has a file system for them. Spark opens more (s3a, abfss,
    wasbs, viewfs, hdfs without native libraries), with the session's credentials."""
    if urlsplit(uri).scheme not in ("", "file", "hdfs", "s3"):
        return False
    try:
        pafs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError):
        return False
    return True


def save_bytes(spark: SparkSession, uri: str, data: bytes) -> None:
    """Write a small file from the driver to any path that Spark can write."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def spark_write_files(rows: DataFrame, base: str, tail: bytes) -> None:
    """Flat files of rows(name, data), each data's bytes one behind another in the order of the rows, written by Spark to any path that
    it knows: base/name=<name>/. Every data ends with the bytes of tail, which Spark's text writer puts in as its line separator."""
    head = F.expr(f"substring(data, 1, octet_length(data) - {len(tail)})").cast("string")
    rows.select("name", head.alias("value")).write.option("lineSep", tail.decode("latin-1")).option("encoding", "ISO-8859-1").partitionBy("name").text(base)


def spark_read_files(spark: SparkSession, base: str) -> DataFrame:
    """Files of spark_write_files as Spark reads them: name, size, content. A file is a row, hence of less than 2 GB."""
    schema = "path string, modificationTime timestamp, length long, content binary, name string"
    rows = spark.read.format("binaryFile").schema(schema).load(base)
    return rows.where("length > 0").select("name", F.col("length").alias("size"), "content")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return a reader of it.

    This cuts the lineage: a lost executor costs a read, not a recomputation, and Spark knows the
    table's size, so a later join broadcasts it only below the session's threshold. The shuffle files of
    the job are released when the table stands.
    """
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    before = spark.conf.get(_CLEAN, None)
    try:
        spark.conf.set(_CLEAN, "true")
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(df_or_path: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete a table made by materialize, or a path, once nothing reads it any more."""
    if isinstance(df_or_path, str):
        paths = [df_or_path]
    else:
        spark = df_or_path.sparkSession
        paths = sorted({p.rsplit("/", 1)[0] for p in df_or_path.inputFiles()})
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
