"""Backtest ledgers by segments.

Between two rebalances a ledger is linear in the cash it starts with: payouts, interest, stops and hedge switches depend on prices and
dates alone. So every (configuration, segment) is folded by itself over its days from a cash of one, all of them in parallel and
inside Spark's expressions, and gives the factor by which the segment multiplies its cash. Draws make the only step that is
not linear, c -> min(level, factor * c), and are folded over the segments of a configuration, a number a segment. What a
segment starts with then scales its unit days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..sources.stored import cut

CONFIG = "config_id string, top_n int, capital double, hedge_pct double, draw_level double, stop_loss double"
MONEY = ("value", "positions", "cash", "hedge")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def segment_days(days: DataFrame, hedger: DataFrame) -> DataFrame:
    """days(date, rate, signal, rebalance) by segment, with the last close of hedger(date, close) so far.

    A segment begins on its rebalance day (opens), number 0 before the first. The next rebalance day is also its last row
    (closes): there it earns interest once more and is sold. One row a trading day, so one task orders them.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("date", F.col("is_day"))
    marks = days.withColumn("is_day", F.lit(1)).withColumn("close", F.lit(None).cast("double"))
    closes = hedger.where("close is not null").select("date", "close", F.lit(0).alias("is_day"))
    rows = marks.unionByName(closes, allowMissingColumns=True).withColumn("hedger", F.last("close", ignorenulls=True).over(order)).where("is_day = 1")
    rows = rows.withColumn("segment", F.sum(F.col("rebalance").cast("int")).over(order).cast("int"))
    common = ["date", "rate", "signal", "hedger"]
    starts = rows.select("segment", *common, F.col("rebalance").alias("opens"), F.lit(False).alias("closes"))
    return starts.unionByName(rows.where("rebalance").select((F.col("segment") - 1).alias("segment"), *common, F.lit(False).alias("opens"), F.lit(True).alias("closes")))


def price_paths(picks: DataFrame, bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Of each picked (segment, ticker), once whatever configurations pick it: last close and payout by day, first price, total return.

    The last close so far comes from one window by ticker over its bars and marks. A ticker without any price when its segment
    opens has no rows.
    """
    marks = picks.select("segment", "ticker").distinct().join(calendar.select("segment", "date", "closes"), "segment")
    kind = "struct<date:date,close:double,dividend:double>"
    seen = bars.where("close is not null").join(picks.select("ticker").distinct(), "ticker", "left_semi")
    seen = seen.select("ticker", "date", F.struct("date", "close", F.coalesce("dividend", F.lit(0.0)).alias("dividend")).cast(kind).alias("bar"))
    so_far = Window.partitionBy("ticker").orderBy("date", F.col("segment").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = seen.unionByName(marks.withColumn("bar", F.lit(None).cast(kind)), allowMissingColumns=True)
    rows = both.withColumn("last", F.last("bar", ignorenulls=True).over(so_far)).where("segment is not null")
    rows = rows.select("segment", "ticker", "date", "closes", F.col("last.close").alias("price"), F.when((F.col("last.date") == F.col("date")) & ~F.col("closes"), F.col("last.dividend")).otherwise(0.0).alias("paid"))
    inside = Window.partitionBy("segment", "ticker").orderBy("date")
    rows = rows.withColumn("entry", F.first("price").over(inside)).where("entry is not null")
    got = F.sum("paid").over(inside)
    return rows.withColumn("total_return", (F.col("price") + got) / F.col("entry") - 1)


def positions(configs: DataFrame, picks: DataFrame, paths: DataFrame) -> DataFrame:
    """Each configuration's picks by day, with the day on which its stop sells it."""
    size = F.count("*").over(Window.partitionBy("config_id", "segment"))
    rows = picks.withColumn("n_picks", size).join(configs.select("config_id", "stop_loss"), "config_id").join(paths, ["segment", "ticker"])
    hit = F.when((F.col("stop_loss") > 0) & ~F.col("closes") & (F.col("total_return") < -F.col("stop_loss")), F.col("date"))
    return rows.withColumn("stopped", F.min(hit).over(Window.partitionBy("config_id", "segment", "ticker")))


def daily_positions(held: DataFrame) -> DataFrame:
    """Sums over the picks still held, in units of the money put into all picks."""
    now, share = F.col("price") / F.col("entry") / F.col("n_picks"), F.col("paid") / F.col("entry") / F.col("n_picks")
    before = F.col("stopped").isNull() | (F.col("stopped") >= F.col("date"))
    after = F.col("stopped").isNull() | (F.col("stopped") > F.col("date"))
    over = lambda flag, value: F.coalesce(F.sum(F.when(flag, value)), F.lit(0.0))
    return held.groupBy("config_id", "segment", "date", "closes").agg(
        over(before, now).alias("sale"), over(before, share).alias("pay"), over(F.col("stopped") == F.col("date"), now).alias("sold"), over(after, now).alias("worth"),
        F.sum(before.cast("int")).alias("n_before"), F.sum(after.cast("int")).alias("n_held"), F.sum((F.col("stopped") == F.col("date")).cast("int")).alias("stops"), (F.count("*") / F.max("n_picks")).alias("priced"),
    )


STATE = (
    "struct<cash:double,shares:double,units:double,basis:double,pnl:double,income:double,interest:double,hedge_days:int,stops:int,"
    "days:array<struct<date:date,value:double,positions:double,cash:double,hedge:double,income:double,interest:double,hedged:int,n_held:int,stops:int>>>"
)


def _open(s: Column, x: Column, pct: Column) -> Column:
    """The rebalance day's purchase: first the hedge, then the picks, each by its share; what has no price stays cash."""
    wanted = x["opens"] & x["signal"] & (pct > 0) & x["hedger"].isNotNull()
    basis = F.when(wanted, s["cash"] * pct).otherwise(s["basis"])
    left = F.when(wanted, s["cash"] * (1 - pct)).otherwise(s["cash"])
    units = F.when(wanted, s["cash"] * pct / x["hedger"]).otherwise(s["units"])
    opened = s.withField("basis", basis).withField("units", units)
    return F.when(x["opens"], opened.withField("shares", left).withField("cash", left * (1 - F.coalesce(x["priced"], F.lit(0.0))))).otherwise(s)


def _switch(s: Column, x: Column, pct: Column) -> Column:
    """The hedge's daily switch: bought from cash and all positions in proportion, or sold to cash."""
    known = (pct > 0) & x["hedger"].isNotNull()
    on, off = known & x["signal"] & (s["units"] == 0) & (x["n_before"] > 0), known & ~x["signal"] & (s["units"] > 0)
    raised = s["shares"] * pct * x["sale"] + s["cash"] * pct
    bought = s.withField("cash", s["cash"] - s["cash"] * pct).withField("shares", s["shares"] * (1 - pct)).withField("basis", raised).withField("units", raised / x["hedger"])
    proceeds = s["units"] * x["hedger"]
    sold = s.withField("cash", s["cash"] + proceeds).withField("pnl", s["pnl"] + proceeds - s["basis"]).withField("units", F.lit(0.0)).withField("basis", F.lit(0.0))
    return F.when(on, bought).when(off, sold).otherwise(s)


def _day(s: Column, x: Column) -> Column:
    """Payouts and stops to cash, and the day's marks."""
    income = s["shares"] * x["pay"]
    cash, worth, side = s["cash"] + income + s["shares"] * x["sold"], s["shares"] * x["worth"], F.when(s["units"] > 0, s["units"] * x["hedger"]).otherwise(0.0)
    hedged, stops = (s["units"] > 0).cast("int"), s["stops"] + x["stops"]
    day = F.struct(
        x["date"].alias("date"), (worth + cash + side).alias("value"), worth.alias("positions"), cash.alias("cash"), side.alias("hedge"), (s["income"] + income).alias("income"), s["interest"].alias("interest"),
        hedged.alias("hedged"), x["n_held"].alias("n_held"), stops.alias("stops"),
    )
    return (
        s.withField("cash", cash).withField("income", s["income"] + income).withField("hedge_days", s["hedge_days"] + hedged).withField("stops", stops)
        .withField("days", F.concat(s["days"], F.array(day)))
    )


def _close(s: Column, x: Column) -> Column:
    """The next rebalance day's sale of everything."""
    proceeds = F.when(s["units"] > 0, s["units"] * F.coalesce(x["hedger"], F.lit(0.0))).otherwise(0.0)
    pnl = s["pnl"] + F.when(s["units"] > 0, proceeds - s["basis"]).otherwise(0.0)
    return s.withField("cash", s["cash"] + s["shares"] * x["sale"] + proceeds).withField("pnl", pnl).withField("units", F.lit(0.0)).withField("basis", F.lit(0.0))


def unit_segments(configs: DataFrame, calendar: DataFrame, daily: DataFrame) -> DataFrame:
    """Each (config_id, segment) folded over its days from a cash of one: unit, its last state with all days."""
    sums = {c: F.coalesce(c, F.lit(0.0)).alias(c) for c in ("sale", "pay", "sold", "worth")} | {c: F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("n_before", "n_held", "stops")}
    rows = calendar.crossJoin(F.broadcast(configs.select("config_id", "hedge_pct")))  # a row a configuration
    rows = rows.join(daily, ["config_id", "segment", "date", "closes"], "left")
    x = F.struct("date", "closes", "rate", "signal", "hedger", "opens", *sums.values(), "priced")
    days = rows.groupBy("config_id", "segment", "hedge_pct").agg(F.array_sort(F.collect_list(x)).alias("days"))  # a day a row, by date
    zero = F.expr(f"named_struct('cash', 1D, 'shares', 0D, 'units', 0D, 'basis', 0D, 'pnl', 0D, 'income', 0D, 'interest', 0D, 'hedge_days', 0, 'stops', 0, 'days', array())").cast(STATE)
    pct = F.col("hedge_pct")

    def step(s: Column, x: Column) -> Column:
        earned = F.when(x["opens"], F.lit(0.0)).otherwise(s["cash"] * x["rate"])  # a rebalance day's interest is earned before its sale
        with_interest = s.withField("cash", s["cash"] + earned).withField("interest", s["interest"] + earned)
        trade = lambda a: let(_open(a, x, pct), lambda b: let(_switch(b, x, pct), lambda c: _day(c, x)))
        return let(with_interest, lambda a: F.when(x["closes"], _close(a, x)).otherwise(trade(a))).cast(STATE)

    return days.select("config_id", "segment", F.aggregate("days", zero, step).alias("unit"))


def segment_starts(configs: DataFrame, units: DataFrame, drawable: DataFrame | None = None) -> DataFrame:
    """What each segment starts with and what is drawn then; only segments of drawable(config_id, segment), if given, are drawn from."""
    rows = units.select("config_id", "segment", F.col("unit.cash").alias("factor"))
    if drawable is None:
        rows = rows.withColumn("drawn", F.lit(True))
    else:
        rows = rows.join(drawable.select("config_id", "segment", F.lit(True).alias("drawn")), ["config_id", "segment"], "left")
    x = F.struct("segment", "factor", F.coalesce("drawn", F.lit(False)).alias("drawn"))
    every = rows.groupBy("config_id").agg(F.array_sort(F.collect_list(x)).alias("segments")).join(configs.select("config_id", "capital", "draw_level"), "config_id")
    zero = F.struct(F.col("capital").alias("next"), F.expr("cast(array() as array<struct<segment:int,start:double,drawn:double>>)").alias("out"))
    level = F.col("draw_level")

    def step(s: Column, x: Column) -> Column:
        over = F.when((x["segment"] > 0) & x["drawn"] & (level > 0) & (s["next"] > level), s["next"] - level).otherwise(0.0)
        return let(over, lambda o: F.struct(
            ((s["next"] - o) * x["factor"]).alias("next"), F.concat(s["out"], F.array(F.struct(x["segment"].alias("segment"), (s["next"] - o).alias("start"), o.alias("drawn")))).alias("out")
        ))

    return every.select("config_id", F.explode(F.aggregate("segments", zero, step)["out"]).alias("x")).select("config_id", "x.*")


def scaled_segments(configs: DataFrame, units: DataFrame, drawable: DataFrame | None = None) -> DataFrame:
    """units with each segment's start and draw, and the sums of all earlier segments."""
    rows = units.join(segment_starts(configs, units, drawable), ["config_id", "segment"])
    earlier, so_far = (Window.partitionBy("config_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, end) for end in (-1, 0))
    past = lambda c: F.coalesce(F.sum(F.col("start") * F.col(f"unit.{c}")).over(earlier), F.lit(0.0)).alias(f"past_{c}")
    stops = F.coalesce(F.sum("unit.stops").over(earlier), F.lit(0)).alias("past_stops")
    return rows.select("*", past("income"), past("interest"), stops, F.sum("drawn").over(so_far).alias("withdrawn"))


def ledger_days(segments: DataFrame) -> DataFrame:
    """Daily ledger rows of scaled segments."""
    rows = segments.select("config_id", "start", "past_income", "past_interest", "past_stops", "withdrawn", F.explode("unit.days").alias("d"))
    return rows.select(
        "config_id", "d.date", *(rnd(F.col("start") * F.col(f"d.{c}"), 2).alias(c) for c in MONEY), rnd(F.col("past_income") + F.col("start") * F.col("d.income"), 2).alias("income_cum"),
        rnd("withdrawn", 2).alias("withdrawn_cum"), rnd(F.col("past_interest") + F.col("start") * F.col("d.interest"), 2).alias("interest_cum"), "d.hedged", "d.n_held", (F.col("past_stops") + F.col("d.stops")).cast("int").alias("stops"),
    )


class Backtest:
    """Ledgers of configurations: their days, quarters and stop events.

    picks has config_id, date (of the rebalance), ticker and place; days has date, rate, signal and rebalance. bars gives closes and payouts;
    hedger is the hedge's ticker. Calendar, picks and unit segments are stored once, as all results read them. With draw_unpriced False a rebalance at which no pick has a price draws nothing.
    """

    def __init__(self, configs: DataFrame, picks: DataFrame, bars: DataFrame, days: DataFrame, hedger: str, draw_unpriced: bool = True):
        self.configs = configs
        self.calendar = cut(segment_days(days, bars.where(F.col("ticker") == hedger).select("date", "close")), "calendar")
        opens = self.calendar.where("opens").select("segment", "date")
        self.picks = cut(picks.join(F.broadcast(opens), "date").select("config_id", "segment", "ticker", "place"), "picks")  # a row a rebalance
        self.held = positions(configs, self.picks, price_paths(self.picks, bars, self.calendar))
        self.units = cut(unit_segments(configs, self.calendar, daily_positions(self.held)), "units")
        self.segments = scaled_segments(configs, self.units, None if draw_unpriced else self.held.select("config_id", "segment").distinct())

    def days(self) -> DataFrame:
        return ledger_days(self.segments)

    def quarters(self) -> DataFrame:
        """Each rebalance: what is held from it on, the income until the next, what was drawn, and whether it hedged."""
        names = self.picks.groupBy("config_id", "segment").agg(F.array_sort(F.collect_list(F.struct("place", "ticker"))).alias("x"))
        rows = self.segments.where("segment > 0").join(names, ["config_id", "segment"], "left").join(F.broadcast(self.calendar.where("opens").select("segment", "date")), "segment")
        return rows.select(
            "config_id", "date", F.coalesce(F.array_join("x.ticker", ", "), F.lit("CASH")).alias("holdings"), F.coalesce(F.size("x"), F.lit(0)).alias("n_picks"),
            rnd(F.col("start") * F.col("unit.income"), 2).alias("income"), rnd("drawn", 2).alias("withdrawn"), F.coalesce(F.element_at("unit.days", 1)["hedged"], F.lit(0)).alias("hedged"),
        )

    def stops(self) -> DataFrame:
        """Stops hit: date, ticker and the total return in percent."""
        return self.held.where((F.col("stopped") == F.col("date")) & ~F.col("closes")).select("config_id", "date", "ticker", rnd(F.col("total_return") * 100, 1).alias("total_return"))

    def totals(self) -> DataFrame:
        """Per configuration the sums over its segments; the hedge's result includes an open position at its last mark."""
        last = F.element_at("unit.days", -1)
        open_pnl = F.when(F.col("unit.units") > 0, last["hedge"] - F.col("unit.basis")).otherwise(0.0)
        scaled = lambda c: F.sum(F.col("start") * c)
        return self.segments.groupBy("config_id").agg(
            scaled(F.col("unit.income")).alias("income"), scaled(F.col("unit.interest")).alias("interest"), scaled(F.col("unit.pnl") + open_pnl).alias("hedge_pnl"), F.sum("drawn").alias("withdrawn"),
            F.sum("unit.stops").alias("stops"), F.sum("unit.hedge_days").alias("hedge_days"), F.sum((F.col("segment") > 0).cast("int")).alias("n_quarters"),
        )


def top_picks(scores: DataFrame, configs: DataFrame) -> DataFrame:
    """Each configuration's top qualified funds at every rebalance date of point_in_time_scores."""
    place = F.row_number().over(Window.partitionBy("rebalance").orderBy("rank"))
    ranked = scores.where("qualified = 1").withColumn("place", place)
    return ranked.join(F.broadcast(configs.select("config_id", "top_n")), F.col("place") <= F.col("top_n")).select("config_id", F.col("rebalance").alias("date"), "ticker", "place")


def passive(configs: DataFrame, bars: DataFrame, days: DataFrame, hedger: str) -> Backtest:
    """The one ticker of each of configs held alone: no hedge, no stop; until it has a price the cash is kept and nothing is drawn."""
    alone = configs.withColumn("hedge_pct", F.lit(0.0)).withColumn("stop_loss", F.lit(0.0))
    rebalances = days.where("rebalance").select("date")
    picks = configs.select("config_id", "ticker").crossJoin(F.broadcast(rebalances)).select("config_id", "date", "ticker", F.lit(1).alias("place"))  # a row a rebalance
    return Backtest(alone.drop("ticker"), picks, bars, days, hedger, draw_unpriced=False)


def market_ledger(days: DataFrame, market: DataFrame) -> DataFrame:
    """The market of market(date, close, dividend) bought with 1 on the first day, payouts in cash that earns interest: date, value.

    Cash is an affine recurrence; with the product of the daily growths so far, A, it is A * sum(payout / A). One row a day.
    """
    by_date = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = days.select("date", "rate").join(market, "date")
    rows = rows.withColumn("growth", F.product(1 + F.col("rate")).over(by_date)).withColumn("first", F.first("close").over(by_date))
    cash = F.col("growth") * F.sum(F.coalesce("dividend", F.lit(0.0)) / F.col("first") / F.col("growth")).over(by_date)
    return rows.select("date", (F.col("close") / F.col("first") + cash).alias("value"))


def all_in(days: DataFrame) -> DataFrame:
    """Value and withdrawals at the end, worst drawdown of their sum, and the first and last day, of each configuration's ledger."""
    top = F.max("total").over(Window.partitionBy("config_id").orderBy("date"))
    rows = days.withColumn("total", F.col("value") + F.col("withdrawn_cum")).withColumn("top", top)
    return rows.groupBy("config_id").agg(
        F.max_by("total", "date").alias("last"), F.max_by("value", "date").alias("final"), F.min("date").alias("a"), F.max("date").alias("z"), F.count("*").alias("n_days"),
        F.min((F.col("total") - F.col("top")) / F.col("top")).alias("drawdown"),
    )


def backtest_summary(ledger: Backtest, benchmark: Backtest, days: DataFrame, market: DataFrame) -> DataFrame:
    """Per configuration: returns with withdrawals, yearly growth (over a tenth of a year at least), worst drawdown, excess over the market's
    ledger and over the benchmark's, income and withdrawals in all and a quarter, interest, stops, hedge days and the hedge's result."""
    curve, totals = all_in(ledger.days()), ledger.totals()
    alone = benchmark.days().groupBy("config_id").agg(F.max_by("value", "date").alias("bench_final")).join(benchmark.totals().select("config_id", F.col("withdrawn").alias("bench_withdrawn"), F.col("income").alias("bench_income")), "config_id")
    last = F.broadcast(market_ledger(days, market).agg(F.max_by("value", "date").alias("market")))  # one row
    rows = curve.join(totals, "config_id").join(alone, "config_id").join(ledger.configs.select("config_id", "capital"), "config_id").crossJoin(last)
    rows = rows.withColumn("growth", F.col("last") / F.col("capital")).withColumn("market_growth", rnd(F.col("market") * F.col("capital"), 2) / F.col("capital"))
    rows = rows.withColumn("bench_growth", (F.col("bench_final") + F.col("bench_withdrawn")) / F.col("capital"))
    years = F.greatest(F.datediff("z", "a") / 365.25, F.lit(0.1))
    percent = lambda growth: (growth - 1) * 100
    quarter = F.greatest("n_quarters", F.lit(1))
    return rows.select(
        "config_id", rnd("final", 2).alias("final_value"), rnd(percent(F.col("growth")), 2).alias("total_return"), rnd(percent(F.pow("growth", 1 / years)), 2).alias("cagr"), rnd(F.col("drawdown") * 100, 2).alias("max_drawdown"),
        rnd("income", 2).alias("income_total"), rnd(F.col("income") / quarter, 2).alias("income_avg_quarter"), rnd(percent(F.col("market_growth")), 2).alias("market_return"),
        rnd(percent(F.col("growth")) - percent(F.col("market_growth")), 2).alias("excess_return"), rnd(percent(F.col("bench_growth")), 2).alias("bench_return"), rnd("bench_income", 2).alias("bench_income"),
        rnd(percent(F.col("growth")) - percent(F.col("bench_growth")), 2).alias("excess_bench"), F.col("n_quarters").cast("long").alias("n_quarters"), F.col("stops").cast("long").alias("stops"),
        F.col("hedge_days").cast("long").alias("hedge_days"), rnd(F.col("hedge_days") / F.col("n_days") * 100, 1).alias("hedge_days_pct"), rnd("hedge_pnl", 2).alias("hedge_pnl"), rnd("interest", 2).alias("interest_total"),
        rnd("withdrawn", 2).alias("withdrawn_total"), rnd(F.col("withdrawn") / quarter, 2).alias("withdrawn_avg_quarter"),
    )
