"""Stored tables that a second run updates in place: keyed rows in partitions, and bars laid out for windows by ticker."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 16  # partitions of a keyed table that has no date
BUCKET_ROWS = 500_000  # rows of the source for a bucket of bars
LEAST_BUCKETS, MOST_BUCKETS = 8, 8192
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder that all executors share, under spark.checkpoint.dir. Where that is unset a local master (tests) gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="barline-stored-"))
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def cut(rows: DataFrame, tag: str) -> DataFrame:
    """rows written as Parquet to a shared folder and read from there: what uses them several times plans and computes them once, and a
    lost executor costs a read."""
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession, tag)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def one_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with NaN as null, one for each key."""
    return rows.select(*(F.nanvl(c, F.lit(None)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes)).dropDuplicates(keys)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """stored with incoming's rows replacing those of equal keys; only stored's columns, NaN as null.

    Stored rows are only checked against the incoming keys, so nothing stored is sorted or ranked. Of incoming rows with equal keys one stays.
    """
    clean = one_each(incoming.select(*(c for c in stored.columns if c in incoming.columns)), keys)
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    kept = stored.alias("s").join(clean.select(*keys).alias("n"), same, "left_anti")
    return kept.unionByName(clean, allowMissingColumns=True)


class StoredTable:
    """Rows with unique keys, in Parquet folders by one column: a date, a year, or a hash of the keys.

    A write replaces the partitions that it touches and no other file. Spark writes the new files beside the table and swaps
    whole folders when all tasks are done, so a write that fails leaves the old rows, and one that is run again has the same result.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], by: str, value: Column | None = None):
        self.spark, self.path, self.keys, self.by = spark, path, keys, by
        self.value = value  # of by, where rows don't bring it
        self.schema = None

    @classmethod
    def keyed(cls, spark: SparkSession, path: str, keys: list[str], parts: int = PARTS) -> StoredTable:
        return cls(spark, path, keys, "part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows if self.value is None else rows.withColumn(self.by, self.value)

    def create(self, rows: DataFrame) -> StoredTable:
        placed = self._placed(rows)
        self.schema = placed.schema
        placed.repartition(self.by).write.mode("overwrite").partitionBy(self.by).parquet(self.path)
        return self

    def read(self) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        return rows if self.value is None else rows.drop(self.by)

    def _touched(self, rows: DataFrame) -> list:
        return [r[0] for r in rows.select(self.by).distinct().collect()]  # a value a partition

    def _write(self, rows: DataFrame) -> None:
        rows.repartition(self.by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.by).parquet(self.path)

    def upsert(self, incoming: DataFrame) -> StoredTable:
        """Replace or add rows by keys; reads and writes only the partitions of incoming's rows."""
        placed = self._placed(incoming)
        stored = self.spark.read.schema(self.schema).parquet(self.path)
        self._write(upsert(stored.where(F.col(self.by).isin(self._touched(placed))), placed, self.keys).select(*self.schema.names))
        return self

    def replace(self, rows: DataFrame, within: list[str] | None = None) -> StoredTable:
        """Put rows in the place of all stored rows of the same partitions, or with within of those that share its columns' values."""
        placed = one_each(self._placed(rows), self.keys).select(*self.schema.names)
        if within:
            stored = self.spark.read.schema(self.schema).parquet(self.path).where(F.col(self.by).isin(self._touched(placed)))
            placed = stored.join(placed.select(*within).distinct(), within, "left_anti").select(*self.schema.names).unionByName(placed)
        self._write(placed)
        return self

    def rewrite(self, rows: DataFrame) -> StoredTable:
        """Replace all rows by rows, which may be derived from the table: partitions that rows lacks are emptied, others swapped."""
        placed = self._placed(rows).select(*self.schema.names)
        gone = sorted(set(map(str, self._touched(self.spark.read.schema(self.schema).parquet(self.path)))) - set(map(str, self._touched(placed))))
        self._write(placed)
        jvm = self.spark.sparkContext._jvm
        for value in gone:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.by}={value}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return self


class BarStore:
    """Bars in a table by year, bucketed by ticker and sorted by date: windows and joins by ticker read it without an exchange,
    date ranges read their years only, and an upsert rewrites the years it touches."""

    def __init__(self, spark: SparkSession, name: str, columns: list[str]):
        self.spark, self.name, self.columns = spark, name, columns

    @classmethod
    def create(cls, rows: DataFrame, buckets: int, name: str | None = None) -> BarStore:
        spark, name = rows.sparkSession, name or f"bars_{uuid.uuid4().hex}"
        laid = rows.withColumn("year", F.year("date")).repartition(buckets, "ticker")  # a file a year and bucket
        writer = laid.write.format("parquet").mode("overwrite").partitionBy("year").bucketBy(buckets, "ticker").sortBy("ticker", "date")
        writer.option("path", shared_folder(spark, name)).saveAsTable(name)
        return cls(spark, name, rows.columns)

    def read(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Bars in an inclusive date range; only its years are read."""
        rows = self.spark.table(self.name)
        if start:
            rows = rows.where((F.col("date") >= F.to_date(F.lit(start))) & (F.col("year") >= F.year(F.to_date(F.lit(start)))))
        if end:
            rows = rows.where((F.col("date") <= F.to_date(F.lit(end))) & (F.col("year") <= F.year(F.to_date(F.lit(end)))))
        return rows.select(*self.columns)

    def upsert(self, incoming: DataFrame) -> BarStore:
        placed = incoming.withColumn("year", F.year("date"))
        years = [r[0] for r in placed.select("year").distinct().collect()]  # a few
        stored = self.spark.table(self.name)
        merged = upsert(stored.where(F.col("year").isin(years)), placed, ["ticker", "date"]).select(*stored.columns)
        with setting(self.spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
            merged.write.insertInto(self.name, overwrite=True)
        return self


def buckets_for(source_rows: int) -> int:
    return max(LEAST_BUCKETS, min(MOST_BUCKETS, source_rows // BUCKET_ROWS))
