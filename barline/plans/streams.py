"""Queries of the streaming twins, each run to the end of its input with an available-now trigger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stored import setting, shared_folder
from ..sources.tables import bars, table
from ..streaming import twins
from .studies import SQL as STUDIES
from .sql import ALL_BARS


SLICES = 4  # batches that a source comes in


def _source(rows: DataFrame, time: str, key: str, arrival: Column | None = None, end: DataFrame | None = None) -> DataFrame:
    """A stream of the rows in SLICES batches of equal time spans, landed one after another as two files each.

    A key's rows of a slice are in one file. arrival, a slice's number, overrides the slice of the rows where it isn't null; it may use due, the
    slice of a row's time, and left, the days left in it. end, if given, is one more batch.
    """
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession, "stream")
    day = F.unix_date(F.to_date(time))
    low, high = rows.agg(F.min(day), F.max(day)).first()
    span = high - low + 1
    sliced = rows.withColumn("due", F.least(F.floor((day - low) * SLICES / span), F.lit(SLICES - 1)).cast("int"))
    sliced = sliced.withColumn("left", F.ceil((F.col("due") + 1) * span / SLICES) + low - day)
    sliced = sliced.withColumn("slice", F.coalesce(arrival, "due") if arrival is not None else F.col("due"))
    for k in range(SLICES):
        sliced.where(F.col("slice") == k).drop("slice", "due", "left").repartition(2, key).write.mode("append").parquet(path)
    if end is not None:
        end.select(rows.columns).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """What the stream gives until its input ends, with the batch that gave it. A batch that is tried again replaces its own rows."""
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession, "stream")
    write = lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/rows/batch={i}")
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch int").parquet(f"{path}/rows")


def stream_bars(spark, d):
    """Some events of the first days arrive with the last slice, behind the watermark, and some later ones late but within it."""
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key"), "event_id", F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    day, k = F.dayofmonth("ts"), F.col("event_id") % 10
    late = F.when(((k == 3) & (day <= 3)) | ((k == 4) & day.between(17, 21)), SLICES - 1)
    out = drain(twins.stream_bars(_source(e, "ts", "key", late)), "update")
    newest = F.row_number().over(Window.partitionBy("ticker", "date").orderBy(F.desc("batch")))
    return out.withColumn("k", newest).where("k = 1").drop("k", "batch")


def stream_countdown(spark, d):
    """A third of the rows of a slice's last week come with the next slice. A row of a later date closes the stream, which gives no row itself."""
    series = bars(spark, d).select("ticker", "date", F.col("adj_close").alias("c"))
    late = F.when((F.col("left") <= 7) & (F.col("due") < SLICES - 1) & (F.pmod(F.xxhash64("ticker", "date"), F.lit(3)) == 0), F.col("due") + 1)
    end = series.agg(F.date_add(F.max("date"), 40).alias("date")).select(F.lit("").alias("ticker"), "date", F.lit(None).cast("double").alias("c"))
    return drain(twins.stream_countdown(_source(series, "date", "ticker", late, end)), "append").drop("batch")


def stream_hedge(spark, d):
    b = bars(spark, d).where("ticker in ('MKT', 'R0')").groupBy("date").pivot("ticker", ["MKT", "R0"]).agg(F.first("close"))
    rows = b.where("MKT is not null and R0 is not null").select(F.lit("MKT/R0").alias("key"), "date", (F.col("MKT") / F.col("R0")).alias("ratio"))
    return drain(twins.stream_hedge(_source(rows, "date", "key")), "append").drop("batch")


def stream_notices(spark, d):
    """Notices of a week and holder are one, whichever batches they come in; what the stream gives is not deduplicated again."""
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"), F.concat_ws("-", F.to_date(F.date_trunc("week", "o_orderdate")), F.col("o_custkey") % 40).alias("ann_id"))
    return drain(twins.stream_notices(_source(o, "ts", "ann_id")), "append").select("ann_id")


QUERIES = {"stream_bars": stream_bars, "stream_countdown": stream_countdown, "stream_hedge": stream_hedge, "stream_notices": stream_notices}

SQL = {
    "stream_bars": """SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM events WHERE NOT (event_id % 10 = 3 AND dayofmonth(ts) <= 3) GROUP BY 1, 2""",
    "stream_countdown": STUDIES["td_countdown"],
    "stream_hedge": f"""WITH {ALL_BARS}, r AS (SELECT a.date, a.close / b.close AS ratio FROM bars a JOIN bars b USING (date) WHERE a.ticker = 'MKT' AND b.ticker = 'R0')
SELECT 'MKT/R0' AS key, date, coalesce(last_value(CASE WHEN ratio >= 1.0 THEN 1 WHEN ratio <= 0.95 THEN 0 END IGNORE NULLS) OVER (ORDER BY date), 0) AS hedged FROM r""",
    "stream_notices": "SELECT DISTINCT CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) || '-' || (o_custkey % 40) AS ann_id FROM orders",
}
