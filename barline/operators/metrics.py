"""Per-ticker metrics. One shuffle by ticker; all windows share its partitioning and order.

A look-back of k bars means the k-th last bar, so the five-bar return spans four steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import chain, change, rnd

# Look-backs in bars, settings of the divergence labels.
LOOKBACKS = {"ret_6m": 126, "ret_5": 5, "ret_21": 21, "ret_63": 63}
DIVERGENCE = {
    "rsi_period": 14, "pivot_left": 5, "pivot_right": 5, "pivot_min_gap": 5, "pivot_max_gap": 60, "max_age_bars": 20, "obv_window": 21,
    "obv_price_flat_pct": 2.0, "obv_flat_avg_days": 3.0,
}


def history(bars: DataFrame, end: str, days: int) -> DataFrame:
    """Bars with a price in [end - days, end]: p, volume, i (from 0), back (1 is the last bar), n."""
    rows = bars.where((F.col("date") >= F.date_sub(F.to_date(F.lit(end)), days)) & (F.col("date") <= F.lit(end)) & F.col("adj_close").isNotNull())
    w, whole = Window.partitionBy("ticker").orderBy("date"), Window.partitionBy("ticker")
    rows = rows.select("ticker", "date", F.col("adj_close").alias("p"), "volume")
    rows = rows.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(whole)).withColumn("p0", F.first("p").over(w))
    return rows.where((F.col("n") >= 2) & (F.col("p0") != 0)).withColumn("back", F.col("n") - F.col("i")).drop("p0")


def _at(back: int) -> Column:
    """The price of the back-th last bar, in an aggregation."""
    return F.max(F.when(F.col("back") == back, F.col("p")))


def returns_block(bars: DataFrame, end: str) -> DataFrame:
    """ret_12m and the returns of LOOKBACKS, null for a ticker with fewer bars."""
    h = history(bars, end, 365)
    out = h.groupBy("ticker").agg(F.max("n").alias("n_bars"), F.min_by("p", "i").alias("first"), _at(1).alias("last"), *(_at(k).alias(c) for c, k in LOOKBACKS.items()))
    return out.select("ticker", "n_bars", change("last", "first").alias("ret_12m"), *(change("last", c).alias(c) for c in LOOKBACKS))


def ret_24m(bars: DataFrame, end: str) -> DataFrame:
    h = history(bars, end, 730)
    out = h.groupBy("ticker").agg(F.min_by("p", "i").alias("first"), F.max_by("p", "i").alias("last"))
    return out.select("ticker", change("last", "first").alias("ret_24m"))


def with_steps(h: DataFrame) -> DataFrame:
    """Add the running maximum and the one-bar return."""
    w = Window.partitionBy("ticker").orderBy("date")
    return h.withColumn("top", F.max("p").over(w)).withColumn("r", F.col("p") / F.lag("p").over(w) - 1)


def max_drawdown(bars: DataFrame, end: str) -> DataFrame:
    h = with_steps(history(bars, end, 365))
    return h.groupBy("ticker").agg(rnd(F.min((F.col("p") - F.col("top")) / F.col("top")) * 100, 2).alias("max_dd"))


def persistence(bars: DataFrame, end: str) -> DataFrame:
    h = with_steps(history(bars, end, 365))
    return h.groupBy("ticker").agg(_persistence().alias("persist_frac"))


def _persistence() -> Column:
    return rnd(F.sum(F.when(F.col("r") > 0, 1).otherwise(0)) / F.count("r") * 100, 2)


def volatility_63(bars: DataFrame, end: str) -> DataFrame:
    h = with_steps(history(bars, end, 365))
    return h.groupBy("ticker").agg(_volatility().alias("vol_63"))


def _volatility() -> Column:
    return rnd(F.stddev_samp(F.when((F.col("n") < 63) | (F.col("back") <= 63), F.col("r"))) * F.sqrt(F.lit(252.0)) * 100, 2)


def _sma(k: int) -> Column:
    return F.when(F.max("n") >= k, rnd(F.avg(F.when(F.col("back") <= k, F.col("p"))), 4))


def moving_averages(bars: DataFrame, end: str) -> DataFrame:
    """Means of the last 20, 50 and 200 bars, and whether the unrounded last price is above the rounded longest."""
    h = history(bars, end, 365)
    out = h.groupBy("ticker").agg(rnd(_at(1), 4).alias("close"), _at(1).alias("last"), *(_sma(k).alias(f"sma{k}") for k in (20, 50, 200)))
    return out.withColumn("pass_trend", F.when(F.col("last") > F.col("sma200"), 1).otherwise(0)).drop("last")


def mqs_of(ret_12m: str = "ret_12m", persist: str = "persist_frac", vol: str = "vol_63") -> Column:
    """Momentum quality: from the rounded persistence and volatility."""
    return F.when((F.col(vol) > 0) & F.col(persist).isNotNull(), rnd(F.col(ret_12m) * 100 * F.col(persist) / F.col(vol), 4))


def mqs(bars: DataFrame, end: str) -> DataFrame:
    h = with_steps(history(bars, end, 365))
    out = h.groupBy("ticker").agg(change(F.max_by("p", "i"), F.min_by("p", "i")).alias("ret_12m"), _persistence().alias("persist_frac"), _volatility().alias("vol_63"))
    return out.select("ticker", mqs_of().alias("mqs"))


def vol_label(rel_vol: str = "rel_vol") -> Column:
    return chain([(F.col(rel_vol) >= 1.5, "HIGH"), (F.col(rel_vol) >= 1.0, "MED")], "LOW")


def _volumes(h: DataFrame) -> DataFrame:
    """Last volume over the mean of the last 63, on each ticker's own rows that have a volume."""
    down = Window.partitionBy("ticker").orderBy(F.desc("date"))
    v = h.where(F.col("volume").isNotNull()).withColumn("vb", F.row_number().over(down))
    v = v.groupBy("ticker").agg(F.max(F.when(F.col("vb") == 1, F.col("volume"))).alias("v"), F.avg(F.when(F.col("vb") <= 63, F.col("volume"))).alias("m"))
    return v.select("ticker", F.when(F.col("m") > 0, rnd(F.col("v") / F.col("m"), 4)).alias("rel_vol"))


def relative_volume(bars: DataFrame, end: str) -> DataFrame:
    return _volumes(history(bars, end, 365)).withColumn("vol_label", vol_label())


def acc_watch_of(price: str = "close", cap: str = "cap_band") -> Column:
    """Accumulation watch of large and mid caps, from rounded price and averages."""
    p, a, b, c = F.col(price), F.col("sma20"), F.col("sma50"), F.col("sma200")
    ok = F.coalesce(F.col(cap).isin("large", "mid"), F.lit(False)) & a.isNotNull() & b.isNotNull() & c.isNotNull()
    return chain([(ok & (p < a) & (p < b) & (p < c), "EARLY"), (ok & (p < b) & (p < c) & (p >= a), "PROGRESS"), (ok & (p < c) & (p >= b) & (p >= a), "SHIFT")], "-")


def acc_watch(bars: DataFrame, caps: DataFrame, end: str) -> DataFrame:
    """Label of each ticker of caps(ticker, cap_band)."""
    return moving_averages(bars, end).join(caps.select("ticker", "cap_band"), "ticker").select("ticker", acc_watch_of().alias("acc_watch"))


RSI_BLOCK = 1024  # bars whose weights share a base


def with_rsi(h: DataFrame, period: int = 14, whole: bool = False) -> DataFrame:
    """Wilder's RSI at every bar.

    The recursion y = q * y + (1 - q) * x from the first step has the closed form q^i * (x_1 q^-1 + sum of (1 - q) x_k q^-k),
    a running sum of terms that are never negative; it holds for slices of some thousand bars. With whole a series of any length is
    cut into blocks of RSI_BLOCK bars: in each the powers begin anew, and the block before carries its end over. What older blocks
    would add to that is q^1024, less than the last bit.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    q = (period - 1) / period
    h = h.withColumn("d", F.col("p") - F.lag("p").over(w))
    own, base = (w, F.lit(0)) if not whole else (Window.partitionBy("ticker", "block").orderBy("date"), F.col("block") * RSI_BLOCK)
    if whole:
        h = h.withColumn("block", F.floor(F.col("i") / RSI_BLOCK))
    weight = F.when(F.col("i") == 1, F.lit(1.0)).otherwise(F.lit(1 - q)) * F.pow(F.lit(q), base - F.col("i"))
    for name, part in (("up", F.greatest(F.col("d"), F.lit(0.0))), ("dn", F.greatest(-F.col("d"), F.lit(0.0)))):
        h = h.withColumn(name, F.coalesce(F.sum(F.when(F.col("i") >= 1, part * weight)).over(own), F.lit(0.0)) * F.pow(F.lit(q), F.col("i") - base))
        if whole:
            h = h.withColumn("before", F.lag(name).over(w)).withColumn("before", F.coalesce(F.first("before").over(own), F.lit(0.0)))
            h = h.withColumn(name, F.col(name) + F.col("before") * F.pow(F.lit(q), F.col("i") - base + 1)).drop("before")
        h = h.withColumn(name, F.when(F.col("i") >= period, F.col(name)))
    line = F.when(F.col("dn") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.col("up") / F.when(F.col("dn") != 0, F.col("dn"))))
    return h.withColumn("rsi", F.when(F.col("up").isNotNull() & F.col("dn").isNotNull(), line)).drop("d", "up", "dn", "block")


def rsi_history(bars: DataFrame, end: str, period: int = 14) -> DataFrame:
    """The RSI of every bar up to a day, over all of each ticker's history."""
    w = Window.partitionBy("ticker").orderBy("date")
    rows = bars.where((F.col("date") <= F.lit(end)) & F.col("adj_close").isNotNull()).select("ticker", "date", F.col("adj_close").alias("p"), (F.row_number().over(w) - 1).alias("i"))
    return with_rsi(rows, period, whole=True).where("rsi is not null").select("ticker", "date", "rsi")


def rsi_wilder(bars: DataFrame, end: str, period: int = 14) -> DataFrame:
    h = with_rsi(history(bars, end, 365), period)
    return h.groupBy("ticker").agg(rnd(F.max_by("rsi", "i"), 2).alias("rsi_14"))


def with_pivots(h: DataFrame, settings: dict) -> DataFrame:
    """Add to rows with rsi, per kind of pivot: whether the bar is one, the pivot before it, and the furthest later price."""
    left, right = settings["pivot_left"], settings["pivot_right"]
    w = Window.partitionBy("ticker").orderBy("date")
    before, after, both = w.rowsBetween(-left, -1), w.rowsBetween(1, right), w.rowsBetween(-left, right)
    later = Window.partitionBy("ticker").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)  # a running extreme from the end
    h = h.withColumn("whole", F.count("rsi").over(both) == left + right + 1)
    for kind, best in (("high", F.max), ("low", F.min)):
        outer, inner = best("rsi").over(before), best("rsi").over(after)
        beyond, not_beaten = (F.col("rsi") > outer, F.col("rsi") >= inner) if kind == "high" else (F.col("rsi") < outer, F.col("rsi") <= inner)
        h = h.withColumn(kind, F.col("whole") & beyond & not_beaten)
        h = h.withColumn(f"{kind}_1", F.last(F.when(F.col(kind), F.struct("i", "p", "rsi")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        h = h.withColumn(f"{kind}_far", best("p").over(later))
    return h


def _newest_pivots() -> list[Column]:
    """In an aggregation: the newest pivot of each kind with the one before and the furthest later price."""
    point = lambda kind: F.struct("i", "p", "rsi", F.col(f"{kind}_1").alias("old"), F.col(f"{kind}_far").alias("far"))
    return [F.max_by(point(kind), F.when(F.col(kind), F.col("i"))).alias(kind) for kind in ("high", "low")]


def _rsi_label(s: dict) -> Column:
    """Label of a ticker's row with n, high and low."""
    left, right, found = s["pivot_left"], s["pivot_right"], []
    for kind, names in (("high", ("BEAR", "HID_BEAR")), ("low", ("BULL", "HID_BULL"))):
        new, old = F.col(kind), F.col(f"{kind}.old")
        gap = new["i"] - old["i"]
        fresh = (F.col("n") - 1 - (new["i"] + right) <= s["max_age_bars"]) & (gap >= s["pivot_min_gap"]) & (gap <= s["pivot_max_gap"])
        up, down = (new["p"] > old["p"]) & (new["rsi"] < old["rsi"]), (new["p"] < old["p"]) & (new["rsi"] > old["rsi"])
        first, second = (up, down) if kind == "high" else (down, up)
        void = new["far"] > new["p"] if kind == "high" else new["far"] < new["p"]
        enough = F.col("n") >= left + right + s["pivot_min_gap"] + 2
        label = chain([(enough & fresh & ~void & first, names[0]), (enough & fresh & ~void & second, names[1])], None)
        found.append(F.when(label.isNotNull(), F.struct(new["i"].alias("i"), label.alias("label"))))
    high, low = found
    newest = F.when(high.isNotNull() & (low.isNull() | (high["i"] >= low["i"])), high["label"]).otherwise(low["label"])
    return F.coalesce(newest, F.lit("-"))


def rsi_divergence(bars: DataFrame, end: str, settings: dict | None = None) -> DataFrame:
    """Newest divergence label between price and the RSI's last two pivots of each kind, '-' if none."""
    s = DIVERGENCE | (settings or {})
    h = with_pivots(with_rsi(history(bars, end, 365), s["rsi_period"]), s)
    return h.groupBy("ticker").agg(F.max("n").alias("n"), *_newest_pivots()).select("ticker", _rsi_label(s).alias("rsi_div"))


def with_obv(h: DataFrame) -> DataFrame:
    """Add on-balance volume over the rows that have a volume (null on the others), their own index j and count m."""
    w, whole = Window.partitionBy("ticker").orderBy("date"), Window.partitionBy("ticker")
    has = F.col("volume").isNotNull()
    before = F.last(F.when(has, F.col("p")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    h = h.withColumn("s", F.when(has, F.coalesce(F.signum(F.col("p") - before), F.lit(0.0)))).withColumn("j", F.count("volume").over(w)).withColumn("m", F.count("volume").over(whole))
    return h.withColumn("obv", F.when(has, F.sum(F.col("s") * F.col("volume")).over(w)))


def obv(bars: DataFrame, end: str) -> DataFrame:
    return with_obv(history(bars, end, 365)).where("volume is not null").select("ticker", "date", "obv")


def _obv_fit(k: int) -> list[Column]:
    """In an aggregation: count, mean price and volume, and fitted moves over the last k rows with a volume."""
    last = lambda c: F.when(F.col("volume").isNotNull() & (F.col("j") > F.col("m") - k), F.col(c))
    return [
        F.max("m").alias("m"), F.avg(last("p")).alias("mean"), F.avg(last("volume")).alias("v"), (F.regr_slope(last("p"), last("j")) * (k - 1)).alias("pm"),
        (F.regr_slope(last("obv"), last("j")) * (k - 1)).alias("om"),
    ]


def _obv_label(s: dict) -> Column:
    price, flow = F.col("pm") / F.when(F.col("mean") != 0, F.col("mean")) * 100, F.when(F.col("v") > 0, F.col("om") / F.when(F.col("v") != 0, F.col("v"))).otherwise(0.0)
    direction = lambda x, flat: chain([(F.abs(x) < flat, 0), (x > 0, 1)], -1)
    p, o = direction(price, s["obv_price_flat_pct"]), direction(flow, s["obv_flat_avg_days"])
    table = {(1, 1): "CONV_UP", (-1, -1): "CONV_DOWN", (1, -1): "BEAR_DIV", (-1, 1): "BULL_DIV", (0, 1): "ACCUM", (0, -1): "DISTRIB"}
    label = chain([((p == a) & (o == b), name) for (a, b), name in table.items()], "-")
    return F.when((F.col("m") >= s["obv_window"] + 1) & (F.col("mean") > 0), label).otherwise("-")


def obv_divergence(bars: DataFrame, end: str, settings: dict | None = None) -> DataFrame:
    """Fitted direction of price against that of OBV over the last obv_window bars."""
    s = DIVERGENCE | (settings or {})
    rows = with_obv(history(bars, end, 365)).where("volume is not null")
    return rows.groupBy("ticker").agg(*_obv_fit(s["obv_window"])).select("ticker", _obv_label(s).alias("obv_div"))


def metric_block(bars: DataFrame, end: str, settings: dict | None = None) -> DataFrame:
    """All metrics of every ticker in one row, from one scan of 24 months of bars.

    All windows are columns of one history by ticker, and one aggregation by ticker takes them together: one shuffle, and none
    on bars that are stored in buckets by ticker.
    """
    s = DIVERGENCE | (settings or {})
    rows = bars.where((F.col("date") >= F.date_sub(F.to_date(F.lit(end)), 730)) & (F.col("date") <= F.lit(end))).select("ticker", "date", "adj_close", "volume")
    h = with_obv(with_pivots(with_rsi(with_steps(history(rows, end, 365)), s["rsi_period"]), s))
    h = h.withColumn("vb", F.when(F.col("volume").isNotNull(), F.col("m") - F.col("j") + 1))
    out = h.groupBy("ticker").agg(
        F.max("n").alias("n"), rnd(_at(1), 4).alias("close"), _at(1).alias("last"), F.min_by("p", "i").alias("first"), *(_at(k).alias(c) for c, k in LOOKBACKS.items()),
        rnd(F.min((F.col("p") - F.col("top")) / F.col("top")) * 100, 2).alias("max_dd"), _persistence().alias("persist_frac"), _volatility().alias("vol_63"),
        *(_sma(k).alias(f"sma{k}") for k in (20, 50, 200)), rnd(F.max_by("rsi", "i"), 2).alias("rsi_14"), *_newest_pivots(), *_obv_fit(s["obv_window"]),
        F.max(F.when(F.col("vb") == 1, F.col("volume"))).alias("v_last"), F.avg(F.when(F.col("vb") <= 63, F.col("volume"))).alias("v_mean"),
    )
    out = out.select(
        "ticker", F.col("n").alias("n_bars"), "close", change("last", "first").alias("ret_12m"), *(change("last", c).alias(c) for c in LOOKBACKS), "max_dd", "persist_frac", "vol_63", "sma20", "sma50", "sma200",
        F.when(F.col("last") > F.col("sma200"), 1).otherwise(0).alias("pass_trend"), "rsi_14", _rsi_label(s).alias("rsi_div"), _obv_label(s).alias("obv_div"),
        F.when(F.col("v_mean") > 0, rnd(F.col("v_last") / F.when(F.col("v_mean") != 0, F.col("v_mean")), 4)).alias("rel_vol"),
    ).withColumn("mqs", mqs_of()).withColumn("vol_label", vol_label())
    longer = rows.where("adj_close is not null").groupBy("ticker").agg(F.count("*").alias("k"), F.min_by("adj_close", "date").alias("a"), F.max_by("adj_close", "date").alias("z"))
    return out.join(longer.where("k >= 2").select("ticker", change("z", "a").alias("ret_24m")), "ticker", "left")
