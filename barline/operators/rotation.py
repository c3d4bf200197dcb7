"""Relative rotation and DeMark signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import rnd

MIN_CAP = 1e9
DAILY_DAYS, WEEKLY_DAYS, MIN_CLOSES = 200, 500, 50
SIGNALS = ["setup9_buy", "setup9_sell", "cd13_buy", "cd13_sell"]


def rrg(bars: DataFrame, members: DataFrame, benchmark: str, end: str, lookback: int = 500) -> DataFrame:
    """Ratio and momentum of members(ticker, name, grp) against a benchmark on the days they share."""
    b = bars.where((F.col("date") >= F.date_sub(F.to_date(F.lit(end)), lookback)) & (F.col("date") <= F.lit(end)) & F.col("adj_close").isNotNull())
    bench = b.where(F.col("ticker") == benchmark).select("date", F.col("adj_close").alias("b"))  # a row a day
    own = b.join(members, "ticker").withColumn("n", F.count("*").over(Window.partitionBy("ticker"))).where("n >= 21")
    w = Window.partitionBy("ticker").orderBy("date")
    rows = own.join(F.broadcast(bench), "date").withColumn("ratio", (F.col("adj_close") / F.lag("adj_close", 62).over(w)) / (F.col("b") / F.lag("b", 62).over(w)) * 100)
    rows = rows.withColumn("momentum", F.col("ratio") / F.lag("ratio", 21).over(w) * 100)
    return rows.where("momentum is not null").select("date", "ticker", "name", "grp", rnd("ratio", 4).alias("rs_ratio"), rnd("momentum", 4).alias("rs_momentum"), rnd("adj_close", 4).alias("close"))


def _side(before: Column, now: Column) -> Column:
    """1 if now is below before, -1 if above, 0 if equal or if either is null or NaN."""
    known = ~(F.isnan(before) | F.isnan(now))
    return F.when(known & (now < before), 1).when(known & (now > before), -1).otherwise(0)


def td_setup(series: DataFrame) -> DataFrame:
    """Run length of close below (positive) or above (negative) the close four rows before; equal resets. series: ticker, date, c."""
    w = Window.partitionBy("ticker").orderBy("date")
    rows = series.withColumn("s", _side(F.lag("c", 4).over(w), F.col("c")))
    rows = rows.withColumn("run", F.sum(F.when(F.col("s") != F.coalesce(F.lag("s").over(w), F.lit(9)), 1).otherwise(0)).over(w))
    k = F.row_number().over(Window.partitionBy("ticker", "run").orderBy("date"))
    return rows.withColumn("setup", F.when(F.col("s") == 0, 0).otherwise(F.col("s") * k)).drop("s", "run")


def td_countdown(series: DataFrame) -> DataFrame:
    """Setup and 13-count at every row of series(ticker, date, c), one row a ticker and date.

    Each setup of 9 arms its side from zero and disarms the other, so the last such setup says which side counts: its rows up to the
    thirteenth whose close lies beyond that of two rows before. A null or NaN close is neither below nor above another.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    rows = td_setup(series).withColumn("move", _side(F.lag("c", 2).over(w), F.col("c"))).withColumn("armed", F.when(F.abs("setup") == 9, F.signum("setup").cast("int")))
    rows = rows.withColumn("epoch", F.count("armed").over(w)).withColumn("armed", F.last("armed", True).over(w))
    since = Window.partitionBy("ticker", "epoch").orderBy("date")
    hit = F.col("move") == F.col("armed")  # null before the first setup of 9
    k = F.sum(F.when(hit, 1).otherwise(0)).over(since)
    return rows.withColumn("k", k).select("ticker", "date", "c", "setup", F.when(hit & (F.col("k") <= 13), F.col("armed") * F.col("k")).otherwise(0).cast("int").alias("countdown"))


def weekly_close(series: DataFrame) -> DataFrame:
    """Last close of every week that ends on Friday."""
    week = F.next_day(F.date_sub("date", 1), "FR")
    return series.where("c is not null").groupBy("ticker", week.alias("week")).agg(F.max_by("c", "date").alias("c")).select("ticker", F.col("week").alias("date"), "c")


def demark_scan(bars: DataFrame, members: DataFrame, end: str, cap_min: float = 0, cap_max: float | None = None) -> DataFrame:
    """Last daily and weekly counts and flags of members(ticker, name, sector, cap_band, market_cap)."""
    cap = F.coalesce("market_cap", F.lit(0.0))
    chosen = members.where(cap >= max(MIN_CAP, cap_min))
    if cap_max:
        chosen = chosen.where(cap <= cap_max)
    b = bars.where((F.col("date") <= F.lit(end)) & F.col("adj_close").isNotNull()).join(chosen.select("ticker"), "ticker", "left_semi").select("ticker", "date", F.col("adj_close").alias("c"))
    since = lambda days: b.where(F.col("date") >= F.date_sub(F.to_date(F.lit(end)), days))
    daily, weekly = since(DAILY_DAYS), weekly_close(since(WEEKLY_DAYS))

    def last(series: DataFrame, prefix: str) -> DataFrame:
        rows = td_countdown(series).groupBy("ticker").agg(F.count("*").alias("n"), F.max_by("setup", "date").alias("s"), F.max_by("countdown", "date").alias("k")).where(F.col("n") >= MIN_CLOSES)
        flags = {"setup9_buy": F.col("s") == 9, "setup9_sell": F.col("s") == -9, "cd13_buy": F.col("k") == 13, "cd13_sell": F.col("k") == -13}
        return rows.select("ticker", F.col("s").alias(f"{prefix}_setup"), F.col("k").alias(f"{prefix}_countdown"), *(F.when(v, 1).otherwise(0).alias(f"{prefix}_{f}") for f, v in flags.items()))

    both = last(daily, "d").join(last(weekly, "w"), "ticker", "full")
    both = both.na.fill(0)
    close = daily.groupBy("ticker").agg(rnd(F.max_by("c", "date"), 4).alias("close"))
    info = chosen.select("ticker", "name", "sector", "cap_band", "market_cap", rnd(F.col("market_cap") / 1e9, 2).alias("market_cap_b"))
    return info.join(both, "ticker").join(close, "ticker", "left")


def demark_report_lists(scan: DataFrame) -> DataFrame:
    """For each signal the sorted tickers that show it."""
    names = [f"{p}_{s}" for p in "dw" for s in SIGNALS]
    cells = scan.unpivot(["ticker"], names, "signal", "on")
    return cells.groupBy("signal").agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("on") == 1, F.col("ticker")))), ",").alias("tickers"))


def read_signals(scans: DataFrame, run_date: str | None = None, ticker: str | None = None, completed: bool = True) -> DataFrame:
    """Rows of one run of scans(run_date, ticker, signals), the newest unless named, with a completed signal or all, by ticker."""
    if run_date is None:
        newest = scans.agg(F.max("run_date").alias("run_date"))
        rows = scans.join(F.broadcast(newest), "run_date", "left_semi")  # one row
    else:
        rows = scans.where(F.col("run_date") == F.lit(run_date))
    if ticker is not None:
        rows = rows.where(F.col("ticker") == ticker.upper())
    any_on = F.greatest(*(F.col(f"{p}_{s}") for p in "dw" for s in SIGNALS)) == 1
    return (rows.where(any_on) if completed else rows).orderBy("ticker")


def read_rrg(points: DataFrame, ticker: str | None = None, start: str | None = None, end: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of stored rotation points, newest first, then by ticker."""
    for wanted, keep in ((ticker, F.col("ticker") == F.lit(ticker and ticker.upper())), (start, F.col("date") >= F.lit(start)), (end, F.col("date") <= F.lit(end))):
        points = points.where(keep) if wanted else points
    return points.orderBy(F.desc("date"), "ticker").offset(offset).limit(limit)
