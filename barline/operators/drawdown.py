"""Comparison of members with a benchmark over stated periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import chain, rnd
from ..sources.stored import cut
from .metrics import acc_watch_of, vol_label
from .ranking import rs_trend
from .universe import COMMODITY_BENCHMARKS

WEIGHTS = {"rs_vs_bench": 1.0, "peer_rs_score": 0.5, "dd_vs_bench": 0.5}


def _period_stats(rows: DataFrame) -> DataFrame:
    """Per period and ticker: first, last, 5th and 21st last price, maximum, drawdown, number of bars."""
    w, whole = Window.partitionBy("period_label", "ticker").orderBy("date"), Window.partitionBy("period_label", "ticker")
    rows = rows.withColumn("back", F.count("*").over(whole) - F.row_number().over(w) + 1).withColumn("top", F.max("p").over(w))
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("p")))
    return rows.groupBy("period_label", "period_start", "ticker").agg(
        F.count("*").alias("n"), F.min_by("p", "date").alias("first"), at(1).alias("last"), at(5).alias("b5"), at(21).alias("b21"), F.max("p").alias("most"),
        rnd(F.min((F.col("p") - F.col("top")) / F.col("top")) * 100, 2).alias("dd"),
    )


def multi_period_study(bars: DataFrame, members: DataFrame, periods: DataFrame, benchmark: str, weights: dict | None = None) -> DataFrame:
    """Ranked rows of every period of periods(period_label, period_start date); members as in a universe.

    Peers share a commodity if any member has one, else a sector. Bars of others leave first; every bar joins the periods that it
    lies in (a broadcast of one to three rows); all else is windows by period and ticker.
    """
    k = WEIGHTS | (weights or {})
    wanted = members.select("ticker").unionByName(members.sparkSession.createDataFrame([(benchmark,)], "ticker string")).distinct()
    p = bars.where(F.col("adj_close").isNotNull()).select("ticker", "date", F.col("adj_close").alias("p"), "volume").join(wanted, "ticker", "left_semi")
    in_period = p.join(F.broadcast(periods), F.col("date") >= F.col("period_start"))
    days = in_period.groupBy("period_label").agg(F.countDistinct("date").alias("trading_days"))
    stats = cut(_period_stats(in_period).where("n >= 2"), "period-stats")  # a row a period and ticker; benchmark and members both read it
    bench = stats.where(F.col("ticker") == benchmark).select(
        "period_label", rnd((F.col("last") / F.col("first") - 1) * 100, 2).alias("bench_ret"), F.col("dd").alias("bench_dd"),
        F.coalesce((F.col("last") / F.col("b5") - 1) * 100, F.lit(0.0)).alias("m5"), F.coalesce((F.col("last") / F.col("b21") - 1) * 100, F.lit(0.0)).alias("m21"),
    )
    kind = members.agg(F.coalesce(F.max(F.col("commodity").isNotNull()), F.lit(False)).alias("by_commodity"))
    peer = F.coalesce(F.when(F.col("by_commodity"), F.col("commodity")).otherwise(F.col("sector")), F.lit("Unknown"))
    info = members.crossJoin(F.broadcast(kind)).select("ticker", "name", F.coalesce("sector", F.lit("Unknown")).alias("sector"), peer.alias("peer"), "cap_band")  # one row of kind
    rows = stats.where((F.col("ticker") != benchmark) & (F.col("first") != 0)).join(info, "ticker").join(F.broadcast(bench), "period_label")
    rows = rows.join(F.broadcast(days), "period_label").where("trading_days >= 5")
    rows = rows.withColumn("raw", (F.col("last") / F.col("first") - 1) * 100).withColumn("ret_period", rnd("raw", 2))
    # own rounded return against the peers' unrounded: each row stands twice in one order, and counts the unrounded before its rounded one
    g = ["period_label", "peer"]
    twice = rows.withColumn("x", F.explode(F.array(F.struct(F.col("raw").alias("v"), F.lit(1).alias("is_raw")), F.struct(F.col("ret_period").alias("v"), F.lit(0).alias("is_raw")))))
    before = F.sum("x.is_raw").over(Window.partitionBy(*g).orderBy("x.v").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    equal = F.sum("x.is_raw").over(Window.partitionBy(*g, "x.v"))
    rows = twice.withColumn("below", before - equal).where("x.is_raw = 0").drop("x").withColumn("peers", F.count("*").over(Window.partitionBy(*g)) - 1)
    below = F.col("below") - F.when(F.col("raw") < F.col("ret_period"), 1).otherwise(0)
    rows = rows.withColumn("peer_rs_score", F.when(F.col("peers") > 0, rnd(below / F.col("peers") * 100, 2)).otherwise(50.0))
    own = Window.partitionBy("period_label", "ticker").orderBy(F.desc("date"))
    v = in_period.where("volume is not null").withColumn("k", F.row_number().over(own)).groupBy("period_label", "ticker").agg(F.max(F.when(F.col("k") == 1, F.col("volume"))).alias("v"), F.avg(F.when(F.col("k") <= 63, F.col("volume"))).alias("m"))
    rows = rows.join(v.select("period_label", "ticker", F.when(F.col("m") > 0, rnd(F.col("v") / F.col("m"), 4)).alias("rel_vol")), ["period_label", "ticker"], "left")
    every = p.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))))
    sma = every.where("k <= 200").groupBy("ticker").agg(*(F.when(F.count("*") >= n, rnd(F.avg(F.when(F.col("k") <= n, F.col("p"))), 4)).alias(f"sma{n}") for n in (20, 50, 200)))
    rows = rows.join(sma, "ticker", "left").withColumn("rs_vs_bench", rnd(F.col("ret_period") - F.col("bench_ret"), 2)).withColumn("dd_vs_bench", rnd(F.col("dd") - F.col("bench_dd"), 2))
    rows = rows.withColumn("rs_5d", rnd((F.col("last") / F.col("b5") - 1) * 100 - F.col("m5"), 2)).withColumn("rs_21d", rnd((F.col("last") / F.col("b21") - 1) * 100 - F.col("m21"), 2))
    score = rnd(F.col("rs_vs_bench") * k["rs_vs_bench"] + F.col("peer_rs_score") * k["peer_rs_score"] + F.col("dd_vs_bench") * -k["dd_vs_bench"], 4)
    rows = rows.withColumn("score", score)
    return rows.select(
        "period_label", "period_start", F.row_number().over(Window.partitionBy("period_label").orderBy(F.desc_nulls_last("score"), "ticker")).alias("rank"), "ticker", "name", "sector", "cap_band",
        rnd("last", 4).alias("close"), "ret_period", "bench_ret", "rs_vs_bench", "rs_5d", "rs_21d", rs_trend(F.array("rs_vs_bench", "rs_21d", "rs_5d")).alias("rs_trend"), F.col("dd").alias("max_dd_period"),
        "bench_dd", "dd_vs_bench", rnd((F.col("last") / F.col("most") - 1) * 100, 2).alias("current_dd"), "peer_rs_score", vol_label().alias("vol_label"), "rel_vol", acc_watch_of("last").alias("acc_watch"),
        F.when(F.col("last") > F.col("sma200"), 1).otherwise(0).alias("pass_trend"), "score", "trading_days",
    )


def period_performance(bars: DataFrame, members: DataFrame, start: str, label: str, benchmark: str) -> DataFrame:
    period = members.sparkSession.createDataFrame([(label, start)], "period_label string, period_start string").withColumn("period_start", F.to_date("period_start"))
    return multi_period_study(bars, members, period, benchmark)


def cross_period_ranks(study: DataFrame, labels: list[str]) -> DataFrame:
    """Ranks side by side in the periods' order, with the trend of the rank."""
    wide = study.groupBy("ticker").pivot("period_label", labels).agg(F.first("rank"))
    falls, rises = F.lit(True), F.lit(True)
    for a, b in zip(labels[:-1], labels[1:], strict=True):
        falls, rises = falls & F.coalesce(F.col(a) > F.col(b), F.lit(False)), rises & F.coalesce(F.col(a) < F.col(b), F.lit(False))
    trend = chain([(falls, "IMPROVING"), (rises, "DECLINING")], "MIXED")
    return wide.select("ticker", *(F.col(c).alias(f"rank_{c}") for c in labels), trend.alias("rank_trend"))


def study_benchmark(members: DataFrame) -> DataFrame:
    """The most common benchmark of the members, the least on a tie."""
    n = members.where("benchmark is not null").groupBy("benchmark").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "benchmark").limit(1).select("benchmark")


def top_bottom(study: DataFrame, best: int = 20, worst: int = 10) -> DataFrame:
    """Best and worst rows of every period."""
    down = Window.partitionBy("period_label").orderBy(F.desc("rank"))
    return study.withColumn("from_end", F.row_number().over(down)).where((F.col("rank") <= best) | (F.col("from_end") <= worst)).drop("from_end")


# Benchmark of a sector by region.
AU_SECTOR_BENCHMARK = {
    "Energy minerals": "^AXEJ", "Energy": "^AXEJ", "Finance": "^AXFJ", "Financial Services": "^AXFJ", "Financials": "^AXFJ", "Technology services": "^AXIJ", "Electronic technology": "^AXIJ", "Technology": "^AXIJ",
    "Communications": "^AXTJ", "Communication Services": "^AXTJ", "Utilities": "^AXUJ", "Non-energy minerals": "^AXMJ", "Process industries": "^AXMJ", "Basic Materials": "^AXMJ", "Consumer services": "^AXDJ",
    "Consumer non-durables": "^AXDJ", "Consumer durables": "^AXDJ", "Retail trade": "^AXDJ", "Consumer Cyclical": "^AXDJ", "Consumer Defensive": "^AXSJ", "Health technology": "^AXHJ", "Health services": "^AXHJ",
    "Healthcare": "^AXHJ", "Industrial services": "^AXNJ", "Producer manufacturing": "^AXNJ", "Commercial services": "^AXNJ", "Distribution services": "^AXNJ", "Transportation": "^AXNJ", "Industrials": "^AXNJ",
    "Real Estate": "^AXPJ", "Miscellaneous": "^AXJO",
}
US_SECTOR_BENCHMARK = {
    "Energy": "XLE", "Information Technology": "XLK", "Technology": "XLK", "Consumer Discretionary": "XLY", "Consumer Cyclical": "XLY", "Financials": "XLF", "Financial Services": "XLF", "Industrials": "XLI",
    "Materials": "XLB", "Basic Materials": "XLB", "Utilities": "XLU", "Consumer Staples": "XLP", "Consumer Defensive": "XLP", "Health Care": "XLV", "Healthcare": "XLV", "Communication Services": "XLC",
    "Communication": "XLC", "Real Estate": "XLRE",
}


def commodity_benchmark(commodity: Column) -> Column:
    """Benchmark of a commodity in any case."""
    return chain([(F.lower(commodity) == k, v) for k, v in COMMODITY_BENCHMARKS.items()], F.lit(None).cast("string"))


def sector_benchmark(sector: Column, region: Column) -> Column:
    """Benchmark of a sector in its region; without a region the first map that has it."""
    au, us = (chain([(sector == k, v) for k, v in table.items()], F.lit(None).cast("string")) for table in (AU_SECTOR_BENCHMARK, US_SECTOR_BENCHMARK))
    return F.when(region == "AU", au).when(region == "US", us).otherwise(F.coalesce(au, us))
