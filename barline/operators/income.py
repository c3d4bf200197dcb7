"""Income funds: metrics, scores, rules and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import chain, rnd

# Weights of the seven ranked components.
WEIGHTS = {"chg_3m": 0.20, "chg_12m": 0.10, "sharpe": 0.15, "yield_ttm": 0.10, "dist_slope": 0.15, "dist_consist": 0.10, "underlying_rs": 0.20}
STOP = 0.20


def fund_metrics(bars: DataFrame, end: str, keys: tuple[str, ...] = ("ticker",), days: int = 365) -> DataFrame:
    """Metrics of each key's trailing year (63 bars at least): changes, Sharpe, yield, payout slope and consistency, total return."""
    rows = bars.where((F.col("date") > F.date_sub(F.to_date(F.lit(end)), days)) & (F.col("date") <= F.lit(end)) & F.col("close").isNotNull())
    return _fund_metrics(rows.select(*keys, "date", "close", "dividend"), keys)


def payout_moments(pays: Column) -> Column:
    """Sum, mean, slope over the places from 1, and population deviation of an array of payouts in order, null if there are none.

    Payouts are in cents, so slope over mean often lies just on a rounding border, and the last bit of the running sums decides. They are
    added up in the payouts' order, the covariance by fused multiply-add as in the SQL, so that equal payouts give equal digits.
    """
    zero = F.lit(0.0)
    start = F.struct(F.lit(0).alias("k"), *(zero.alias(c) for c in ("sum", "mean", "co", "sq")))

    def step(s: Column, pay: Column) -> Column:
        k = s["k"] + 1
        mean = s["mean"] + (pay - s["mean"]) / k
        co = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), k / 2, pay - mean, s["co"]).cast("double")  # k / 2: a place less the mean of those before
        return F.struct(k.alias("k"), (s["sum"] + pay).alias("sum"), mean.alias("mean"), co.alias("co"), (s["sq"] + (pay - mean) * (pay - s["mean"])).alias("sq"))

    def end(s: Column) -> Column:
        n = s["k"].cast("double")
        places = n * (n * n - 1) / 12  # squares of the places' distances from their mean
        slope = F.when(n > 1, (s["co"] / n) / (places / n))
        return F.when(n > 0, F.struct(s["sum"].alias("paid"), (s["sum"] / n).alias("mean"), slope.alias("slope"), F.sqrt(s["sq"] / n).alias("sp")))

    return F.aggregate(pays, start, step, end)


def _fund_metrics(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    w, whole = Window.partitionBy(*keys).orderBy("date"), Window.partitionBy(*keys)
    rows = rows.withColumn("n", F.count("*").over(whole)).where("n >= 63").withColumn("i", F.row_number().over(w)).withColumn("back", F.col("n") - F.col("i") + 1)
    rows = rows.withColumn("r", F.when(F.col("back") <= 62, F.col("close") / F.lag("close").over(w) - 1))
    rows = rows.withColumn("pay", F.when(F.col("dividend") > 0, F.struct("i", F.col("dividend").alias("value"))))
    out = rows.groupBy(*keys).agg(
        F.max_by("close", "i").alias("last"), F.min_by("close", "i").alias("first"), F.max(F.when(F.col("back") == 63, F.col("close"))).alias("b63"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"),
        F.count("pay").alias("n_dists"), payout_moments(F.transform(F.sort_array(F.collect_list("pay")), lambda x: x["value"])).alias("pays"),
        F.greatest(F.datediff(F.max("date"), F.min("date")), F.lit(1)).alias("span"),
    )
    out = out.select("*", "pays.*")
    enough = F.col("n_dists") >= 4
    zero = F.lit(0.0)
    return out.select(
        *keys, rnd("last", 2).alias("price"), rnd((F.col("last") / F.col("b63") - 1) * 100, 2).alias("chg_3m"), rnd((F.col("last") / F.col("first") - 1) * 100, 2).alias("chg_12m"),
        rnd(F.when(F.col("s") > 0, F.col("m") / F.col("s") * F.sqrt(F.lit(252.0))).otherwise(0.0), 2).alias("sharpe"),
        F.when(enough, rnd(F.col("paid") / F.col("last") * 100 * (365.0 / F.col("span")), 2)).otherwise(zero).alias("yield_ttm"),
        F.when(enough & (F.col("mean") > 0), rnd(F.col("slope") / F.col("mean") * 100, 2)).otherwise(zero).alias("dist_slope"),
        F.when(enough, rnd(F.greatest(zero, F.least(F.lit(1.0), 1.0 - F.col("sp") / F.col("mean"))), 2)).otherwise(zero).alias("dist_consist"),
        "n_dists", rnd((F.col("last") - F.col("first") + F.coalesce("paid", zero)) / F.col("first") * 100, 2).alias("total_ret_12m"),
    )


# Series that stand for an underlying's label; a null one has no series.
UNDERLYING_PROXY = {"SPX": "^GSPC", "NDX": "^NDX", "RUT": "^RUT", "mag7": "QQQ", "diversified": None, "VIX-short": None}


def proxy_of(label: Column) -> Column:
    """Ticker of an underlying's label: its proxy, or the label itself; null for a theme."""
    return chain([(label == k, F.lit(v).cast("string")) for k, v in UNDERLYING_PROXY.items()], label)


def underlying_rs(bars: DataFrame, market: str, end: str) -> DataFrame:
    """Half the 3-month and half the 12-month return above the market's, in points.

    The look-backs are the 63rd and 252nd last bar of the trailing year, or the first of a shorter series; the market is looked
    back the same number of its own bars.
    """
    rows = bars.where((F.col("date") > F.date_sub(F.to_date(F.lit(end)), 365)) & (F.col("date") <= F.lit(end)) & F.col("close").isNotNull())
    w, whole = Window.partitionBy("ticker").orderBy("date"), Window.partitionBy("ticker")
    rows = rows.withColumn("n", F.count("*").over(whole)).where("n >= 63").withColumn("back", F.col("n") - F.row_number().over(w) + 1).withColumn("far", F.least(F.lit(252), "n"))
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("close")))
    r = rows.groupBy("ticker", "far").agg(at(1).alias("z"), at(63).alias("b"), at(F.col("far")).alias("a"))
    own = rows.where(F.col("ticker") == market)
    last = own.agg(at(1).alias("mz"), at(63).alias("mb"), F.max("n").alias("mn"))
    far = own.where("back <= 252").select(F.col("back").alias("k"), F.col("close").alias("ma"))  # 252 rows at most
    both = r.where(F.col("ticker") != market).crossJoin(F.broadcast(last)).withColumn("k", F.least("far", "mn")).join(F.broadcast(far), "k")  # one row of last
    rise = lambda x, y: (F.col(x) / F.col(y) - 1) * 100
    return both.select("ticker", rnd(0.5 * (rise("z", "b") - rise("mz", "mb")) + 0.5 * (rise("z", "a") - rise("mz", "ma")), 2).alias("underlying_rs"))


def average_rank_pct(c: str, *keys: str) -> Column:
    """Average rank of ties over the number of values."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ties = F.count(c).over(Window.partitionBy(*keys, c))
    return (F.rank().over(part.orderBy(c)) + (ties - 1) / 2) / F.count(c).over(part)


def fund_score(metrics: DataFrame, strength: DataFrame | None = None, keys: tuple[str, ...] = (), weights: dict | None = None) -> DataFrame:
    """Weighted percentile score of the funds in each group of keys, qualified if the 3-month change is positive, ranked."""
    weights = weights or WEIGHTS
    rows = metrics if strength is None else metrics.join(strength, "ticker", "left")
    if "underlying_rs" not in rows.columns:
        rows = rows.withColumn("underlying_rs", F.lit(0.0))
    rows = rows.withColumn("underlying_rs", F.coalesce("underlying_rs", F.lit(0.0)))
    score = None
    for c, weight in weights.items():
        rows = rows.withColumn(f"r_{c}", average_rank_pct(c, *keys))
        part = F.col(f"r_{c}") * weight
        score = part if score is None else score + part
    rows = rows.withColumn("score", rnd(score * 100, 6)).withColumn("qualified", F.when(F.col("chg_3m") > 0, 1).otherwise(0))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return rows.withColumn("rank", F.row_number().over(part.orderBy(F.desc("score"), "ticker")))


def score_contributions(scored: DataFrame, weights: dict | None = None) -> DataFrame:
    weights = weights or WEIGHTS
    cells = scored.select("ticker", *((F.col(f"r_{c}") * w * 100).alias(c) for c, w in weights.items()))
    return cells.unpivot(["ticker"], list(weights), "component", "points").withColumn("points", rnd("points", 6))


def qualified_ranks(scored: DataFrame) -> DataFrame:
    return scored.where("qualified = 1").select("ticker", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rank")).alias("qualified_rank"))


def ranking_decision(holdings: DataFrame, scored: DataFrame, buy_zone: int) -> DataFrame:
    """Signal for each ticker of holdings."""
    rows = holdings.select("ticker").distinct().join(scored.select("ticker", "qualified", F.lit(1).alias("known")), "ticker", "left").join(qualified_ranks(scored), "ticker", "left")
    signal = chain(
        [(F.col("known").isNull(), "NOT IN UNIVERSE"), (F.col("qualified").isNull(), "not_assessed"), (F.col("qualified") == 0, "SELL"), (F.col("qualified_rank") <= buy_zone, "HOLD")], "REVIEW"
    )
    return rows.select("ticker", signal.alias("signal"), "qualified_rank")


def stop_status(total_return: Column, stop: float = STOP) -> Column:
    return chain([(total_return.isNull(), "not_assessed"), (total_return <= -stop, "HIT"), (total_return <= -stop * 0.75, "NEAR")], "OK")


def holding_return(holdings: DataFrame, bars: DataFrame, end: str) -> DataFrame:
    """(Last close + payouts strictly after entry) / entry price - 1, and its stop status, for each holding.

    Payouts are summed once per ticker and date; a running total lets each holding subtract what came up to its entry,
    so no holding meets every bar.
    """
    b = bars.where((F.col("date") <= F.lit(end)) & F.col("close").isNotNull()).join(holdings.select("ticker").distinct(), "ticker", "left_semi")
    paid = F.sum(F.coalesce("dividend", F.lit(0.0)).cast("decimal(18,4)")).over(Window.partitionBy("ticker").orderBy("date"))
    days = b.select("ticker", "date", "close", paid.alias("paid"))
    total = days.groupBy("ticker").agg(F.max_by("close", "date").alias("close"), F.max("paid").alias("all_paid"))
    marks = holdings.select("ticker", F.col("entry_date").alias("date"), F.lit(None).cast("decimal(28,4)").alias("paid"), F.struct("holding_id", "entry_price").alias("h"))
    both = days.select("ticker", "date", "paid", F.lit(None).cast(marks.schema["h"].dataType).alias("h")).unionByName(marks)
    order = Window.partitionBy("ticker").orderBy("date", F.col("h").isNotNull())
    rows = both.withColumn("before", F.coalesce(F.last("paid", ignorenulls=True).over(order), F.lit(0).cast("decimal(28,4)"))).where("h is not null")
    rows = rows.join(total, "ticker", "left").where(F.col("h.entry_price") > 0)
    value = (F.col("close") + (F.col("all_paid") - F.col("before")).cast("double")) / F.col("h.entry_price") - 1
    return rows.select(F.col("h.holding_id").alias("holding_id"), "ticker", rnd(value, 6).alias("total_return"), stop_status(value).alias("status"))


REVIEW_AGE = 5  # days after which stored prices are stale


def holding_review(holdings: DataFrame, scored: DataFrame, bars: DataFrame, securities: DataFrame, today: str, buy_zone: int, stop: float = STOP) -> DataFrame:
    """Evidence for each of holdings(holding_id, ticker, shares, entry_price, entry_date, quote_currency): ranking signal, return and
    stop status, prices' span, payouts since entry, and what keeps the stop from being assessed.

    Payouts are running totals by ticker, so no holding meets every bar; a split after entry shows in the last split's date. scored
    has ticker, qualified and rank, securities ticker and currency. A holding with any warning has the stop status not_assessed.
    """
    day = F.to_date(F.lit(today))
    b = bars.where(F.col("date") <= day).join(holdings.select("ticker").distinct(), "ticker", "left_semi")
    closed, divided = F.col("close").isNotNull(), ~F.col("split").isin(0, 1)
    spans = b.groupBy("ticker").agg(
        F.min(F.when(closed, F.col("date"))).alias("first_price_date"), F.max(F.when(closed, F.col("date"))).alias("last_price_date"), F.max_by("close", F.when(closed, F.col("date"))).alias("last_close"),
        F.max(F.when(divided, F.col("date"))).alias("last_split_date"),
    )
    cents = F.coalesce("dividend", F.lit(0.0)).cast("decimal(18,4)")
    none = F.lit(None).cast("decimal(18,4)")
    marks = holdings.select("ticker", F.col("entry_date").alias("date"), none.alias("pay"), F.struct(*holdings.columns).alias("h"))
    both = b.select("ticker", "date", cents.alias("pay"), F.lit(None).cast(marks.schema["h"].dataType).alias("h")).unionByName(marks)
    order = Window.partitionBy("ticker").orderBy("date", F.col("h").isNotNull())
    before, total = F.sum("pay").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum("pay").over(Window.partitionBy("ticker"))
    zero = F.lit(0).cast("decimal(28,4)")
    after = F.when(F.col("date").isNotNull(), F.coalesce(total, zero) - F.coalesce(before, zero))
    rows = both.withColumn("paid", after.cast("double")).where("h is not null").select("h.*", "paid")
    rows = rows.join(spans, "ticker", "left").join(securities.select("ticker", "currency"), "ticker", "left")
    value = (F.col("last_close") + F.coalesce("paid", F.lit(0.0))) / F.when(F.col("entry_price") > 0, F.col("entry_price")) - 1
    entry, first, last = F.col("entry_date"), F.col("first_price_date"), F.col("last_price_date")
    warnings = F.array_compact(F.array(
        F.when(entry.isNull(), "entry date missing").when(entry > day, "entry after review").when(entry < first, "prices begin after entry"),
        F.when(~F.coalesce(F.col("entry_price") > 0, F.lit(False)), "entry price missing"),
        F.when(last.isNull(), "no prices").when(F.datediff(day, last) > REVIEW_AGE, "prices stale"),
        F.when(F.col("last_split_date") > entry, "split after entry"),
        F.when(~F.coalesce(F.col("currency") == F.col("quote_currency"), F.lit(False)), "currency mismatch"),
        F.when(value.isNull(), "no return"),
    ))
    signals = ranking_decision(holdings, scored, buy_zone)
    rows = rows.withColumn("value", value).withColumn("warnings", warnings).join(signals, "ticker", "left")
    status = F.when(F.size("warnings") == 0, stop_status(F.col("value"), stop)).otherwise("not_assessed")
    return rows.select(
        "holding_id", "ticker", "signal", "qualified_rank", rnd("value", 6).alias("total_return"), status.alias("stop_status"), "first_price_date", "last_price_date", F.col("paid").alias("payouts_after_entry"),
        F.when(F.col("shares") > 0, "provided").otherwise("missing").alias("quantity_status"), F.array_join("warnings", "; ").alias("warnings"),
    )


def buy_candidates(holdings: DataFrame, scored: DataFrame, buy_zone: int) -> DataFrame:
    """Funds of the buy zone that are not held, by qualified rank."""
    return qualified_ranks(scored).where(F.col("qualified_rank") <= buy_zone).join(holdings.select("ticker").distinct(), "ticker", "left_anti")


def payout_schedule(bars: DataFrame, today: str) -> DataFrame:
    """Next estimated payout from the median gap of the last eight dates of six months."""
    day = F.to_date(F.lit(today))
    pays = bars.where((F.col("date") >= F.add_months(day, -6)) & (F.col("date") <= day) & (F.col("dividend") > 0))
    down = Window.partitionBy("ticker").orderBy(F.desc("date"))
    pays = pays.withColumn("k", F.row_number().over(down)).where("k <= 8").withColumn("gap", F.datediff("date", F.lag("date").over(Window.partitionBy("ticker").orderBy("date"))))
    out = pays.groupBy("ticker").agg(F.max("date").alias("last"), F.floor(F.median("gap")).cast("int").alias("gap"), F.count("*").alias("n")).where("n >= 2 and gap > 0")
    steps = F.greatest(F.lit(1), F.ceil(F.datediff(day, "last") / F.col("gap"))).cast("int")
    return out.select(
        "ticker", F.date_add("last", steps * F.col("gap")).alias("estimated_ex_date"), chain([(F.col("gap") <= 10, "weekly"), (F.col("gap") <= 45, "monthly")], "quarterly").alias("frequency"), F.col("gap").alias("median_gap_days")
    )


def hedge_signal(first: DataFrame, second: DataFrame, on: float = 1.0, off: float = 0.95) -> DataFrame:
    """State by date of the ratio of two series(date, close), the second filled forward: on at on, off at off, else held."""
    both = first.select("date", F.col("close").alias("a")).join(second.select("date", F.col("close").alias("b")), "date", "left")
    w = Window.partitionBy(F.lit(0)).orderBy("date")  # one series
    rows = both.withColumn("ratio", F.col("a") / F.last("b", ignorenulls=True).over(w)).where("ratio is not null")
    flip = F.when(F.col("ratio") >= on, 1).when(F.col("ratio") <= off, 0)
    return rows.select("date", F.coalesce(F.last(flip, ignorenulls=True).over(w), F.lit(0)).alias("hedged"))


def allocation(scored: DataFrame, buy: list[str], budget: float, rate: float) -> DataFrame:
    """Whole shares of an equal-weight buy list, their cost, and the cash left."""
    each = budget * rate / len(buy)
    rows = scored.where(F.col("ticker").isin(buy)).select("ticker", "price", F.when(F.col("price") > 0, F.floor(F.lit(each) / F.col("price"))).cast("long").alias("shares"))
    rows = rows.withColumn("cost", rnd(F.col("shares") * F.col("price"), 6))
    return rows.withColumn("cash_left", rnd(F.lit(budget * rate) - F.sum("cost").over(Window.partitionBy(F.lit(0))), 6))


def rebalance_dates(calendar: DataFrame, start: str, end: str, months: int) -> DataFrame:
    """First calendar day at or after each period's start."""
    starts = calendar.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.make_interval(months=F.lit(months)))).alias("period_start"))
    days = calendar.select("date").distinct().join(F.broadcast(starts), F.col("date") >= F.col("period_start"))
    return days.groupBy("period_start").agg(F.min("date").alias("date"))


def underlying_strength(bars: DataFrame, market: str, dates: DataFrame, labels: DataFrame, days: int = 365) -> DataFrame:
    """underlying_rs of each of labels(underlying) at each rebalance date, seen from the year up to it: rebalance, underlying, underlying_rs.

    A label's series is its proxy's, or the one of its own name; labels without a proxy, and series with fewer than 63 closes in
    the year (or under a market with fewer), have no row. Closes are numbered by series. Two marks for each date and series (its own day and
    the day before its year) take the number of the last close so far, and the look-backs are looked up by number, so no bar is
    spread over dates.
    """
    series = labels.select("underlying", proxy_of(F.col("underlying")).alias("ticker")).where("ticker is not null").distinct()
    wanted = series.select("ticker").unionByName(series.sparkSession.createDataFrame([(market,)], "ticker string")).distinct()
    by_date = Window.partitionBy("ticker").orderBy("date")
    prices = bars.where("close is not null").join(wanted, "ticker", "left_semi").select("ticker", "date", "close", F.row_number().over(by_date).alias("i"))
    ends = F.array(F.struct(F.col("date").alias("rebalance"), "date", F.lit(True).alias("at_end")), F.struct(F.col("date").alias("rebalance"), F.date_sub("date", days).alias("date"), F.lit(False).alias("at_end")))
    ends = dates.select("date").distinct().select(F.explode(ends).alias("m")).agg(F.collect_list("m").alias("every"))  # one row; two marks a rebalance
    marks = wanted.crossJoin(F.broadcast(ends)).select("ticker", F.explode("every").alias("m"))
    marks = marks.select("ticker", "m.date", F.lit(None).cast("int").alias("i"), F.struct("m.rebalance", "m.at_end").alias("m"))
    both = prices.select("ticker", "date", "i", F.lit(None).cast(marks.schema["m"].dataType).alias("m")).unionByName(marks)
    seen = Window.partitionBy("ticker").orderBy("date", F.col("m").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    spans = both.withColumn("last", F.coalesce(F.max("i").over(seen), F.lit(0))).where("m is not null").groupBy("ticker", F.col("m.rebalance").alias("rebalance"))
    spans = spans.agg(F.max(F.when(F.col("m.at_end"), F.col("last"))).alias("z"), F.max(F.when(~F.col("m.at_end"), F.col("last"))).alias("before")).withColumn("n", F.col("z") - F.col("before")).where("n >= 63")
    mine, theirs = spans.where(F.col("ticker") != market), spans.where(F.col("ticker") == market).select("rebalance", F.col("z").alias("mz"), F.col("n").alias("mn"))
    pairs = mine.join(theirs, "rebalance").withColumn("far", F.least(F.lit(252), "n"))  # the market has a row a date
    own, other = F.col("ticker"), F.lit(market)
    places = {"z": (own, F.col("z")), "b": (own, F.col("z") - 62), "a": (own, F.col("z") - F.col("far") + 1), "mz": (other, F.col("mz")), "mb": (other, F.col("mz") - 62), "ma": (other, F.col("mz") - F.least("far", "mn") + 1)}
    asked = pairs.select(own.alias("series"), "rebalance", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), t.alias("ticker"), i.alias("i")) for k, (t, i) in places.items()))).alias("x")).select("series", "rebalance", "x.*")
    found = asked.join(prices.select("ticker", "i", "close"), ["ticker", "i"]).groupBy("series", "rebalance").agg(*(F.max(F.when(F.col("k") == k, F.col("close"))).alias(k) for k in places))
    rise = lambda x, y: (F.col(x) / F.col(y) - 1) * 100
    strength = rnd(0.5 * (rise("z", "b") - rise("mz", "mb")) + 0.5 * (rise("z", "a") - rise("mz", "ma")), 2)
    same = found.select(F.col("series").alias("ticker"), "rebalance", strength.alias("underlying_rs"))
    if_market = series.where(F.col("ticker") == market).join(theirs.select("rebalance", F.lit(market).alias("ticker")), "ticker").select("rebalance", "underlying", F.lit(0.0).alias("underlying_rs"))  # labels of the market itself
    return series.join(same, "ticker").select("rebalance", "underlying", "underlying_rs").unionByName(if_market)


def point_in_time_scores(bars: DataFrame, dates: DataFrame, funds: DataFrame, series: DataFrame, market: str, frequency: str = "all", weights: dict | None = None) -> DataFrame:
    """Scores of funds(ticker, underlying, frequency) at every rebalance date from the year before it only, of one payout frequency or all.

    Each of the funds' bars is spread to the dates whose year holds it; the underlyings' closes, in series, are looked up instead.
    """
    r = dates.select(F.col("date").alias("rebalance"))
    chosen = funds if frequency == "all" else funds.where(F.col("frequency") == frequency)
    every = r.agg(F.array_sort(F.collect_set("rebalance")).alias("every"))  # one row; a date a rebalance
    serves = F.filter("every", lambda x: (x >= F.col("date")) & (F.date_sub(x, 365) < F.col("date")))
    rows = bars.where("close is not null").join(chosen.select("ticker", "underlying"), "ticker").crossJoin(F.broadcast(every)).withColumn("rebalance", F.explode(serves))
    metrics = _fund_metrics(rows.select("rebalance", "ticker", "underlying", "date", "close", "dividend"), ("rebalance", "ticker", "underlying"))
    strength = underlying_strength(series, market, dates, chosen.select("underlying"))
    scored = fund_score(metrics.join(strength, ["rebalance", "underlying"], "left"), None, ("rebalance",), weights)
    return scored.select("rebalance", "ticker", "price", "chg_3m", "underlying_rs", "score", "qualified", "rank")


def cash_rate(bills: DataFrame, calendar: DataFrame) -> DataFrame:
    """Daily rate from bills(date, value in percent), filled forward to the calendar; none before the first."""
    w = Window.partitionBy(F.lit(0)).orderBy("date", F.col("value").isNull())
    days = calendar.select("date", F.lit(None).cast("double").alias("value"), F.lit(1).alias("day")).unionByName(bills.select("date", "value", F.lit(0).alias("day")))
    filled = days.withColumn("value", F.last("value", ignorenulls=True).over(w)).where("day = 1")
    return filled.select("date", F.coalesce(F.greatest("value", F.lit(0.0)) / 100 / 252, F.lit(0.0)).alias("rate"))
