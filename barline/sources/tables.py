"""Logical tables (bars, securities, groups, ...) derived from the stored star-schema tables.

Each reads only the columns it needs. Bars are one shuffle by (ticker, date) with map-side partial aggregates, and are then stored by
year in buckets by ticker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import BarStore, buckets_for

RUN_DATE, PREVIOUS_DATE = "2001-06-30", "2001-05-31"
BAR_COLUMNS = ["ticker", "date", "open", "high", "low", "close", "adj_close", "volume", "dividend", "split"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _instrument(c: str):
    return F.floor(F.col(c) / 5).cast("long")


def derived_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of instruments I*, the market MKT and its five parts R0..R4, from the line items."""
    i = _instrument("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select(
        i.alias("i"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 20 == 0), F.round(F.col("l_tax") * 100).cast("long")).alias("cents"),
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("place"),
    )
    rows = rows.withColumn("ticker", F.explode(F.array(F.concat(F.lit("I"), F.col("i")), F.lit("MKT"), F.concat(F.lit("R"), F.col("i") % 5))))
    out = rows.groupBy("ticker", "date").agg(
        F.min_by("price", "place").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "place").alias("close"),
        F.sum("quantity").alias("volume"), F.coalesce(F.sum("cents") / 100.0, F.lit(0.0)).alias("dividend"),
    )
    return out.select("ticker", "date", "open", "high", "low", "close", F.col("close").alias("adj_close"), "volume", "dividend", F.lit(0.0).alias("split"))


_stores: dict[tuple[str, str], BarStore] = {}


def bar_store(spark: SparkSession, sf_dir: str) -> BarStore:
    """The bars of sf_dir, laid out once in an application, when they are first asked for."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _stores:
        _stores[at] = BarStore.create(derived_bars(spark, sf_dir), buckets_for(table(spark, sf_dir, "lineitem").count()))
    return _stores[at]


def bars(spark: SparkSession, sf_dir: str, references: bool = True, start: str | None = None, end: str | None = None) -> DataFrame:
    """Stored daily bars of instruments I*, and with references the market and its parts, in an inclusive date range."""
    rows = bar_store(spark, sf_dir).read(start, end)
    return rows if references else rows.where(F.col("ticker").startswith("I"))


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per instrument, and the index tickers MKT and R0..R4."""
    s = table(spark, sf_dir, "supplier").groupBy(_instrument("s_suppkey").alias("i")).agg(F.min("s_name").alias("name"), F.sum(F.round(F.col("s_acctbal") * 100).cast("long")).alias("cents"))
    i = F.col("i")
    equity = s.select(
        F.concat(F.lit("I"), i).alias("ticker"), "name", F.when(i % 2 == 0, "US").otherwise("AU").alias("region"), F.when(i % 2 == 0, "NYQ").otherwise("ASX").alias("exchange"),
        F.lit("EQUITY").alias("quote_type"), F.concat(F.lit("S"), i % 5).alias("sector"), F.concat(F.lit("N"), i % 25).alias("industry"),
        (F.greatest(F.col("cents") / 100.0 - 15000, F.lit(0.0)) * 1e6).alias("market_cap"), F.when(i % 13 == 12, 0).otherwise(1).alias("active"), F.lit("MKT").alias("benchmark"),
    )
    index = s.sparkSession.range(6).select(F.when(F.col("id") == 5, "MKT").otherwise(F.concat(F.lit("R"), F.col("id"))).alias("ticker"))
    index = index.select(
        "ticker", F.col("ticker").alias("name"), F.lit("US").alias("region"), F.lit("NYQ").alias("exchange"), F.lit("INDEX").alias("quote_type"), F.lit(None).cast("string").alias("sector"),
        F.lit(None).cast("string").alias("industry"), F.lit(None).cast("double").alias("market_cap"), F.lit(1).alias("active"), F.lit("MKT").alias("benchmark"),
    )
    return equity.unionByName(index)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags (ticker, group_type, group_key, attr, priority) of instruments, and the theme rot of the R* that they form, most of them with a side."""
    i = table(spark, sf_dir, "supplier").select(_instrument("s_suppkey").alias("i")).distinct()
    kinds = [(3, "index", "BIG", None, 9), (4, "index", "TECH", None, 9), (2, "commodity", "gold", "producer", 9), (6, "commodity", "silver", "explorer", 0)]
    out = None
    for step, kind, key, attr, priority in kinds:
        part = i.where(F.col("i") % step == 0).select(
            F.concat(F.lit("I"), F.col("i")).alias("ticker"), F.lit(kind).alias("group_type"), F.lit(key).alias("group_key"), F.lit(attr).cast("string").alias("attr"), F.lit(priority).alias("priority")
        )
        out = part if out is None else out.unionByName(part)
    part = F.col("i") % 5
    flag = lambda key: F.struct(F.concat(F.lit("R"), part).alias("ticker"), F.lit("theme").alias("group_type"), key.alias("group_key"), F.lit(None).cast("string").alias("attr"), F.lit(9).alias("priority"))
    side = F.when(part < 2, "rot:cyclical").when(part < 4, "rot:defensive")
    theme = i.select(F.explode(F.array(flag(F.lit("rot")), flag(side))).alias("x")).select("x.*").where("group_key is not null").distinct()
    return out.unionByName(theme)


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions from orders: portfolio, ticker, entry_date, entry_price, quote_currency."""
    n = table(spark, sf_dir, "supplier").agg(F.countDistinct(_instrument("s_suppkey")).alias("n"))
    o = table(spark, sf_dir, "orders").crossJoin(F.broadcast(n))  # one row of n
    return o.select(
        (F.col("o_custkey") % 10).alias("portfolio"), F.concat(F.lit("I"), F.col("o_orderkey") % F.col("n")).alias("ticker"), F.to_date("o_orderdate").alias("entry_date"),
        (F.col("o_totalprice") / 100).alias("entry_price"), F.lit("USD").alias("quote_currency"), F.col("o_orderkey").alias("holding_id"),
    )


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each priority by month as indicator series: key, period, value."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("key"), F.to_date(F.trunc("o_orderdate", "month")).alias("period")).agg(F.count("*").cast("double").alias("value"))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored span of each instrument's bars, with consecutive failures."""
    b = bars(spark, sf_dir, references=False)
    return b.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_rows")).withColumn(
        "failures", F.substring("ticker", 2, 20).try_cast("long") % 12
    )


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten dates' bars pulled again, with drifted prices for every seventh instrument."""
    b = bars(spark, sf_dir, references=False)
    last = b.select("date").distinct().orderBy(F.desc("date")).limit(10)
    drift = F.when(F.substring("ticker", 2, 20).try_cast("long") % 7 == 0, F.col("adj_close") * 1.002).otherwise(F.col("adj_close"))
    return b.join(F.broadcast(last), "date", "left_semi").withColumn("adj_close", drift).select(*BAR_COLUMNS)
