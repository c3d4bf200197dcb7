"""Macro, credit and sentiment readings as dated tables: the whole history in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import chain, rnd

# Warn and alert levels, and those of the one-period change.
LEVELS = {
    "cc_delinquency": (2.5, 3.5), "cc_chargeoff": (3.0, 4.5), "auto_delinquency": (1.5, 2.5), "mortgage_delinquency": (1.5, 2.5), "hy_spread": (4.0, 6.0), "ig_spread": (1.5, 2.5), "debt_gdp": (110.0, 130.0),
    "breakeven_5y": (2.8, 3.5), "breakeven_10y": (2.6, 3.2), "flow90_cc": (7.0, 9.5), "flow90_auto": (2.5, 4.0), "flow90_mortgage": (2.0, 4.0), "flow90_student": (8.0, 12.0), "flow30_cc": (9.0, 12.0),
    "flow30_auto": (8.5, 10.5), "flow30_mortgage": (5.0, 8.0), "mortgage_subprime_share": (8.0, 12.0), "auto_subprime_share": (22.0, 28.0),
}
CHANGES = {"cc_delinquency": (0.15, 0.3), "auto_delinquency": (0.1, 0.2), "mortgage_delinquency": (0.1, 0.2), "hy_spread": (0.5, 1.0), "flow90_cc": (0.4, 0.8), "flow90_auto": (0.2, 0.4), "flow90_mortgage": (0.15, 0.3)}
# Notable and alerting change of a snapshot reading, in points or percent.
SNAPSHOT_CHANGES = {
    "us10y": (0.10, 0.25, "pts"), "us02y": (0.10, 0.25, "pts"), "yield_curve": (0.10, 0.25, "pts"), "hy_spread": (0.20, 0.50, "pts"), "ig_spread": (0.20, 0.50, "pts"), "vix": (3.0, 5.0, "pts"), "dxy": (0.5, 1.5, "pts"),
    "gold": (1.0, 3.0, "%"), "copper": (1.0, 3.0, "%"), "oil": (1.0, 3.0, "%"), "spx": (0.5, 2.0, "%"), "cu_gold_ratio": (3.0, 6.0, "%"), "yc_roc_5d": (0.15, 0.30, "pts"),
}
PHASES = ["EARLY EXPANSION", "MID EXPANSION", "LATE EXPANSION", "LATE CYCLE", "EARLY CONTRACTION", "RECESSION", "EARLY RECOVERY"]


def _one(order: str = "date") -> Window:
    """Order of one short series."""
    return Window.partitionBy(F.lit(0)).orderBy(order)


def indicator_changes(indicators: DataFrame) -> DataFrame:
    """At every period of each key: value, the one before, and the change over one and three periods."""
    w = Window.partitionBy("key").orderBy("period")
    rows = indicators.where("value is not null")
    prior = F.lag("value").over(w)
    return rows.select("key", "period", "value", prior.alias("prior"), rnd(F.col("value") - prior, 4).alias("change_1"), rnd(F.col("value") - F.lag("value", 3).over(w), 4).alias("change_3"))


def alert_level(key: Column, value: Column, change: Column, unknown: str = "UNKNOWN") -> Column:
    """Level first, then its change, against the fixed thresholds of the key."""
    rules = [(value.isNull(), unknown)]
    for i, name in ((1, "ALERT"), (0, "WARN")):
        rules += [((key == k) & (value >= v[i]), name) for k, v in LEVELS.items()]
    for i, name in ((1, "ALERT"), (0, "WARN")):
        rules += [((key == k) & (change >= v[i]), name) for k, v in CHANGES.items()]
    return chain(rules, "OK")


def return_windows(bars: DataFrame, end: str, windows: tuple[int, ...] = (5, 21, 63, 252)) -> DataFrame:
    """Return of each ticker's last price over its k-th last one, in percent."""
    rows = bars.where((F.col("date") <= F.lit(end)) & F.col("adj_close").isNotNull()).withColumn("back", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where(F.col("back") <= max(windows))
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("adj_close")))
    out = rows.groupBy("ticker").agg(at(1).alias("last"), *(at(k).alias(f"b{k}") for k in windows))
    return out.select("ticker", *(rnd((F.col("last") / F.col(f"b{k}") - 1) * 100, 2).alias(f"ret_{k}") for k in windows))


def pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two series(date, v) on the dates that both have: date, a, b."""
    return a.select("date", F.col("v").alias("a")).join(b.select("date", F.col("v").alias("b")), "date")


def ratio_changes(pairs: DataFrame, steps: dict[str, int], least: int = 0) -> DataFrame:
    """The ratio a / b at every date with its change in percent over the given rows; nothing before least rows."""
    w = _one()
    rows = pairs.withColumn("ratio", F.col("a") / F.col("b")).withColumn("n", F.row_number().over(w))
    out = rows.select("date", "n", rnd("ratio", 4).alias("ratio"), *(rnd((F.col("ratio") / F.lag("ratio", k).over(w) - 1) * 100, 2).alias(c) for c, k in steps.items()))
    return out.where(F.col("n") >= least).drop("n")


def ratio_trend(pairs: DataFrame) -> DataFrame:
    return ratio_changes(pairs, {"chg_5d": 4, "chg_20d": 19, "chg_63d": 62}, 63)


def ratio_roc(pairs: DataFrame) -> DataFrame:
    """As ratio_trend but over 5, 21 and 63 whole steps."""
    return ratio_changes(pairs, {"roc_5d": 5, "roc_21d": 21, "roc_63d": 63})


def basket_ratio(prices: DataFrame, up: list[str], down: list[str]) -> DataFrame:
    """Sum of one basket's prices over another's on the dates when all have one; prices: ticker, date, v."""
    both = prices.where(F.col("ticker").isin(*up, *down))
    side = lambda names: F.sum(F.when(F.col("ticker").isin(names), F.col("v")))
    rows = both.groupBy("date").agg(side(up).alias("a"), side(down).alias("b"), F.countDistinct("ticker").alias("k")).where(F.col("k") == len({*up, *down}))
    return ratio_changes(rows, {"chg_5d": 4, "chg_10d": 9})


def leverage_stats(series: DataFrame) -> DataFrame:
    """Changes of a monthly series(date, v), its distance from the peak so far, and the acceleration of its growth."""
    w = _one()
    rows = series.withColumn("n", F.row_number().over(w)).withColumn("m1", F.when(F.col("n") >= 3, rnd((F.col("v") / F.lag("v").over(w) - 1) * 100, 2)))
    rows = rows.withColumn("m3", F.when(F.col("n") >= 4, rnd((F.col("v") / F.lag("v", 2).over(w) - 1) * 100, 2)))
    return rows.select("date", "v", F.col("m1").alias("chg_1m"), F.col("m3").alias("chg_3m"), rnd((F.col("v") / F.max("v").over(w) - 1) * 100, 2).alias("from_peak"), rnd(F.col("m1") - F.col("m3") / 3, 4).alias("acceleration"))


def leverage_ratios(margin: DataFrame, money: DataFrame, market_value: DataFrame, output: DataFrame) -> DataFrame:
    """Monthly series(date, v) set against others on shared dates: margin debt over money supply, market value (in thousandths) over output in percent."""
    named = lambda s, name: s.where("v is not null").select("date", F.col("v").alias(name))
    debt = named(margin, "margin").join(named(money, "money"), "date").select("date", rnd("margin", 0).alias("margin_debt"), rnd(F.col("margin") / F.when(F.col("money") != 0, F.col("money")), 4).alias("margin_to_money"))
    worth = named(market_value, "worth").join(named(output, "output"), "date").select("date", rnd(F.col("worth") / 1000 / F.when(F.col("output") != 0, F.col("output")) * 100, 2).alias("worth_to_output"))
    return debt.join(worth, "date", "full")


def cycle_to_date(series: DataFrame, start: str) -> DataFrame:
    """At every date from start on: return, worst drawdown, high, drawdown now, days and year of the cycle."""
    w = _one()
    rows = series.where(F.col("date") >= F.lit(start)).withColumn("top", F.max("v").over(w)).withColumn("dd", (F.col("v") - F.col("top")) / F.col("top"))
    days = F.datediff("date", F.to_date(F.lit(start)))
    return rows.select(
        "date", rnd((F.col("v") / F.first("v").over(w) - 1) * 100, 2).alias("ret"), rnd(F.min("dd").over(w) * 100, 2).alias("max_dd"), rnd("top", 2).alias("high"), rnd((F.col("v") / F.col("top") - 1) * 100, 2).alias("dd_now"),
        days.alias("days"), F.least(F.lit(4), F.floor(days / 365) + 1).cast("int").alias("year"),
    )


def change_alerts(snapshots: DataFrame) -> DataFrame:
    """Readings of snapshots(date, <key>...) that moved notably since the one before."""
    keys = [k for k in SNAPSHOT_CHANGES if k in snapshots.columns]
    cells = snapshots.unpivot(["date"], keys, "key", "value")
    rows = cells.withColumn("prev", F.lag("value").over(Window.partitionBy("key").orderBy("date"))).where("value is not null and prev is not null")
    of = lambda i: chain([(F.col("key") == k, v[i]) for k, v in SNAPSHOT_CHANGES.items()])
    change = F.when(of(2) == "%", (F.col("value") - F.col("prev")) / F.when(F.col("prev") != 0, F.col("prev")) * 100).otherwise(F.col("value") - F.col("prev"))
    level = chain([(F.abs(change) >= of(1), "ALERT"), (F.abs(change) >= of(0), "WATCH")])
    return rows.select("date", "key", rnd(change, 2).alias("change"), level.alias("level")).where("level is not null")


def volatility_snapshot(first: DataFrame, second: DataFrame, third: DataFrame, order: str = "date") -> DataFrame:
    """Three series(date, v, order) on the first one's sessions only: vix, vvix, vix3m and their ratios; nothing is filled.

    Of a day's positive finite readings the last one by the column order counts.
    """
    clean = lambda s, name: s.where((F.col("v") > 0) & ~F.isnan("v") & (F.col("v") != float("inf"))).groupBy("date").agg(F.max_by("v", order).alias(name))
    rows = clean(first, "vix").join(clean(second, "vvix"), "date", "left").join(clean(third, "vix3m"), "date", "left")
    rows = rows.select("date", *(rnd(c, 4).alias(c) for c in ("vix", "vvix", "vix3m")))
    return rows.withColumn("vix_vvix", rnd(F.col("vix") / F.col("vvix"), 4)).withColumn("vix_vix3m", rnd(F.col("vix") / F.col("vix3m"), 4))


def vix_regime(vix: str = "vix", vvix: str = "vvix", ratio: str = "vix_vvix") -> Column:
    v, r = F.col(vix), F.coalesce(F.col(ratio), F.when(F.col(vvix) > 0, F.col(vix) / F.col(vvix)))
    r = F.when(r > 0, r)
    return chain(
        [(v.isNull() | (v <= 0), "UNKNOWN"), (v > 25, "VOLATILITY STRESS"), (v >= 20, "ELEVATED VOLATILITY"), (r < 0.17, "COMPLACENCY WARNING"), (r < 0.18, "VOLATILITY — MONITOR"), (v < 15, "LOW VOLATILITY")], "NORMAL VOLATILITY"
    )


def risk_monitor(snapshots: DataFrame) -> DataFrame:
    """Nine signals, five group votes and the regime of every snapshot row. Missing inputs never vote."""
    off, caution, good, none = "RISK OFF", "CAUTION", "SUPPORTIVE", "UNAVAILABLE"
    v, hy = F.col("vix"), F.when(F.col("hy_spread") >= 0, F.col("hy_spread"))
    r = F.coalesce("vix_vvix", F.when(F.col("vvix") > 0, v / F.col("vvix")))
    term, breadth = F.col("vix_vix3m"), F.coalesce("ad_divergence", F.lit(""))

    def trend(c: str, band: float, consumer: bool = False) -> Column:
        x = F.col(c)
        return chain([(x.isNull(), none), (x < -band, off), (x < 0, caution), (x > (0 if consumer else band), good)], "NEUTRAL")

    signals = {
        "Volatility": [
            chain([(v.isNull() | (v <= 0), none), (v > 25, off), (v >= 20, caution)], good), chain([(r.isNull() | (r <= 0), none), ((v > 0) & (v < 20) & (r < 0.18), caution)], "NEUTRAL"),
            chain([(term.isNull() | (term <= 0), none), (term >= 1, off)], "NEUTRAL"),
        ],
        "Consumer leadership": [trend("xly_xlp_chg_63d", 5, True), trend("rspd_rsps_chg_63d", 5, True)],
        "Sector rotation": [trend("risk_ratio_chg_10d", 3)],
        "Participation": [
            trend("cyc_iwm_spx_chg_63d", 5),
            chain([(breadth.contains("BEARISH") | breadth.contains("both FALLING"), off), (breadth.contains("BULLISH") | breadth.contains("both RISING"), good), (breadth.startswith("CONFIRMING"), "NEUTRAL")], none),
        ],
        "Credit": [chain([(hy.isNull(), none), (hy >= 6, off), (hy >= 4, caution)], good)],
    }
    votes = []
    for marks in signals.values():
        has = lambda s, a=tuple(marks): F.array_contains(F.array(*a), s)
        votes.append(chain([(has(off) & has(good), caution), (has(off), off), (has(caution), caution), (has(good), good), (has("NEUTRAL"), "NEUTRAL")], none))
    names = [f"g{i}" for i in range(5)]
    rows = snapshots.select("date", v.alias("v"), hy.alias("hy"), *(x.alias(n) for x, n in zip(votes, names, strict=True)))
    count = lambda s: sum((F.when(F.col(n) == s, 1).otherwise(0) for n in names), F.lit(0))
    rows = rows.withColumn("risk_off", count(off)).withColumn("caution", count(caution)).withColumn("supportive", count(good)).withColumn("available", F.lit(5) - count(none))
    stress = F.coalesce(F.col("v") > 25, F.lit(False)) | F.coalesce(F.col("hy") >= 6, F.lit(False))
    regime = chain(
        [(stress | (F.col("risk_off") >= 2), "RISK OFF"), (F.col("available") < 3, "INSUFFICIENT DATA"), (F.col("risk_off") + F.col("caution") > 0, "CAUTIOUS"),
         ((F.col("supportive") >= 3) & (F.col("g0") == good) & (F.col("g1") == good), "RISK ON")], "MIXED"
    )
    return rows.select("date", regime.alias("regime"), *(F.col(n).alias(g.lower().replace(" ", "_")) for n, g in zip(names, signals, strict=True)), "risk_off", "caution", "supportive", "available")


def business_cycle(rows: DataFrame) -> DataFrame:
    """Best-scored phase of each row of 63-step ratio changes (null counts as 0); the first one on a tie."""
    c = lambda k: F.coalesce(f"cyc_{k}_chg_63d", F.lit(0.0))
    energy, tech, disc = c("xle_spx") > 10, c("xlk_spx") > 5, c("xly_xlp") > 5
    fin, industrial, material = (c("xlf_xlu") > 5) & (c("xlf_spx") > 0), c("xli_spx") > 5, c("xlb_spx") > 5
    defensive, health, small = ((c("xlp_spx") > 3) | (c("xlu_spx") > 3)) & (c("xly_xlp") < 0), c("xlv_spx") > 5, c("iwm_spx") > 5
    present = (c("xlu_spx") > 0) | (c("xlp_spx") > 0)
    points = [
        [(disc, 2), (fin, 2), (small, 1), (tech, 1)], [(tech, 2), (industrial, 2), (material, 1), (fin, 1)], [(energy, 2), (material, 1), (~tech, 1)], [(energy, 2), (defensive, 2), (~disc, 1), (~fin, 1)],
        [(defensive, 2), (~energy, 1), (health, 1), (c("xly_xlp") < -5, 2)], [(present & health, 2), (present & (c("xlu_spx") > 5), 2), (present & (c("xlp_spx") > 5), 2)], [(fin & ~energy, 2), (disc & ~tech, 1), (small, 1)],
    ]
    scores = [sum((F.when(x, k).otherwise(0) for x, k in rules), F.lit(0)) for rules in points]
    best = F.array_max(F.array(*(F.struct(s.alias("score"), F.lit(-i).alias("place"), F.lit(p).alias("phase")) for i, (s, p) in enumerate(zip(scores, PHASES, strict=True)))))
    return rows.select("date", best["phase"].alias("phase"), best["score"].alias("score"))


def credit_spread(corporate: DataFrame, daily: DataFrame, last: int = 24) -> DataFrame:
    """Monthly corporate yield less the month's last daily yield, the last months; both are (date, v)."""
    month = daily.groupBy(F.last_day("date").alias("month")).agg(F.max_by("v", "date").alias("d"))
    rows = corporate.select(F.last_day("date").alias("month"), F.col("v").alias("c")).join(month, "month")
    return rows.select("month", rnd(F.col("c") - F.col("d"), 3).alias("spread")).orderBy(F.desc("month")).limit(last)


def shares_of(cells: DataFrame, total: str, parts: dict[str, list[str]]) -> DataFrame:
    """cells(period, label, value) to one row a period: each named sum of labels as percent of the total label."""
    at = lambda names: F.sum(F.when(F.col("label").isin(names), F.col("value")))
    rows = cells.groupBy("period").agg(at([total]).alias("total"), *(at(labels).alias(name) for name, labels in parts.items()))
    return rows.select("period", *(rnd(F.col(n) / F.when(F.col("total") != 0, F.col("total")) * 100, 3).alias(n) for n in parts))


def survey_spread(survey: DataFrame) -> DataFrame:
    return survey.select("date", rnd(F.col("bullish") - F.col("bearish"), 4).alias("spread"))


def exposure_merge(new: DataFrame, cached: DataFrame) -> DataFrame:
    """Rows by date, new ones before cached ones; new has text dates MM/dd/yyyy and values, invalid dates drop."""
    fresh = new.select(F.try_to_date("date", "MM/dd/yyyy").alias("date"), F.col("value").try_cast("double").alias("value"), "place").where("date is not null")
    both = fresh.withColumn("src", F.lit(0)).unionByName(cached.select("date", "value", F.lit(0).cast("long").alias("place"), F.lit(1).alias("src")))
    k = F.row_number().over(Window.partitionBy("date").orderBy("src", F.desc("place")))
    return both.withColumn("k", k).where("k = 1").select("date", "value")


def flow_number(text: Column) -> Column:
    """'1,234.5', '(93.5)', '9199.3*' and '-' as numbers; parentheses are negative."""
    bare = F.regexp_replace(F.trim(text), r"[,*()\s]", "")
    return F.when(bare.isin("", "-"), F.lit(None)).otherwise(bare.try_cast("double") * F.when(F.trim(text).startswith("("), -1).otherwise(1))


def positioning(rows: DataFrame) -> DataFrame:
    """Net positions of two trader classes and as percent of open interest, the last row of each date by place."""
    k = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("place")))
    net = lambda c: F.col(f"{c}_long") - F.col(f"{c}_short")
    of = lambda c: rnd(net(c) / F.when(F.col("open_interest") != 0, F.col("open_interest")) * 100, 2)
    return rows.withColumn("k", k).where("k = 1").select("date", net("asset").alias("asset_net"), net("lev").alias("lev_net"), of("asset").alias("asset_pct"), of("lev").alias("lev_pct"))


def breadth_ad_line(counts: DataFrame, index: DataFrame, rows: int = 63, back: int = 21) -> DataFrame:
    """Leaders less laggards and weak summed over the last rows of counts(date, leader, laggard, weak), its trend against the index's."""
    last = counts.orderBy(F.desc("date")).limit(rows)
    line = last.withColumn("ad", F.sum(F.col("leader") - F.col("laggard") - F.col("weak")).over(_one()))
    line = line.withColumn("before", F.lag("ad", back).over(_one())).orderBy(F.desc("date")).limit(1)
    price = index.withColumn("p_before", F.lag("v", back).over(_one())).orderBy(F.desc("date")).limit(1).select(F.col("v").alias("p"), "p_before")
    both = line.crossJoin(F.broadcast(price)).where("before is not null and p_before is not null")
    up, p_up = F.col("ad") > F.col("before"), F.col("p") > F.col("p_before")
    label = chain([(up & ~p_up, "BULLISH — breadth improving while price falls"), (~up & p_up, "BEARISH — breadth deteriorating while price rises"), (p_up, "CONFIRMING — breadth and price both RISING")], "CONFIRMING — breadth and price both FALLING")
    return both.select("date", "ad", F.when(up, "RISING").otherwise("FALLING").alias("ad_trend"), label.alias("ad_divergence"))


# Phases of long cycles as [start, end) years since their turn, and the phase outside.
CYCLES = {
    "land_cycle": (2006.5, [(0, 5, "RECOVERY"), (5, 10, "EXPANSION"), (10, 15, "MID CYCLE"), (15, 18, "WINNERS CURSE"), (18, 21, "DOWNTURN")], "DOWNTURN"),
    "rate_cycle": (2020.5, [(0, 10, "EARLY UP"), (10, 20, "MID UP"), (20, 30, "LATE UP"), (30, 40, "PEAK/TURN")], "EARLY UP"),
}
# Status of a reading by ordered lower or upper thresholds.
BANDS = {
    "unemployment": ("above", [(5.0, "ELEVATED"), (4.5, "RISING"), (4.0, "TICKING UP")], "LOW"),
    "pmi": ("below", [(45.0, "CONTRACTION"), (50.0, "SLOWING"), (55.0, "EXPANSION")], "STRONG EXPANSION"),
    "consumer_sentiment": ("below", [(60.0, "VERY LOW"), (75.0, "WEAK"), (90.0, "MODERATE")], "STRONG"),
}


def cycle_phase(dates: DataFrame) -> DataFrame:
    """Phase of every cycle at each date, by its decimal year; a range join with the short table of phases."""
    spark = dates.sparkSession
    table = spark.createDataFrame([(k, float(turn), float(a), float(b), p) for k, (turn, phases, _) in CYCLES.items() for a, b, p in phases], "cycle string, turn double, a double, b double, phase string")
    other = spark.createDataFrame([(k, float(turn), p) for k, (turn, _, p) in CYCLES.items()], "cycle string, turn double, fallback string")
    year = F.year("date") + (F.month("date") - 1) / 12
    rows = dates.select("date").distinct().crossJoin(F.broadcast(other)).withColumn("years", year - F.col("turn"))
    hit = rows.join(F.broadcast(table.drop("turn")), (rows["cycle"] == table["cycle"]) & (F.col("years") >= F.col("a")) & (F.col("years") < F.col("b")), "left").drop(table["cycle"])
    return hit.select("date", "cycle", rnd("years", 4).alias("years"), F.coalesce("phase", "fallback").alias("phase"))


def status_bands(readings: DataFrame) -> DataFrame:
    """Status of readings(date, key, value) by the key's ordered thresholds; null values and unknown keys have none."""
    rules = []
    for key, (side, bands, last) in BANDS.items():
        mine = (F.col("key") == key) & F.col("value").isNotNull()
        rules += [(mine & ((F.col("value") > x) if side == "above" else (F.col("value") < x)), name) for x, name in bands] + [(mine, last)]
    return readings.select("date", "key", "value", chain(rules, F.lit(None).cast("string")).alias("status"))


REPORT_LABELS = {"vix": "VIX", "vvix": "VVIX", "vix_vvix": "VIX/VVIX", "hy_spread": "HY Spread"}
REPORT_RATIOS = {"xly_xlp": ("XLY/XLP ratio", (5, 63)), "rspd_rsps": ("RSPD/RSPS ratio", (5, 63)), "risk_ratio": ("Sector Groups Risk On/Off ratio", (5, 10))}


def report_parse(reports: DataFrame) -> DataFrame:
    """Readings from report texts; arrows and minus signs give the sign of changes.

    reports has date, text and snapshot (a map of readings as strings, or null): a key of the snapshot overrides the text, an explicit
    null there clears it.
    """
    number = lambda x: F.when(x != "", x.try_cast("double"))
    found = {k: number(F.regexp_extract("text", rf"(?<![\w/]){label}:\s*([\d.]+)", 1)) for k, label in REPORT_LABELS.items()}
    for key, (label, windows) in REPORT_RATIOS.items():
        line = rf"{label}:\s*([\d.]+)([^\n]*)"
        found[key] = number(F.regexp_extract("text", line, 1))
        rest = F.regexp_extract("text", line, 2)
        for w in windows:
            change = rf"([▲▼+\-]?)\s*(\d+(?:\.\d+)?)%\s*{w}d\b"
            found[f"{key}_chg_{w}d"] = number(F.regexp_extract(rest, change, 2)) * F.when(F.regexp_extract(rest, change, 1).isin("▼", "-"), -1).otherwise(1)
    known = lambda k: F.coalesce(F.map_contains_key("snapshot", k), F.lit(False))
    out = [F.when(known(k), F.try_element_at("snapshot", F.lit(k)).try_cast("double")).otherwise(v).alias(k) for k, v in found.items()]
    divergence = F.trim(F.regexp_extract("text", r"A/D Line:\s*(?:⚠|✓|→)\s*([^\n]+)", 1))
    out.append(F.when(known("ad_divergence"), F.try_element_at("snapshot", F.lit("ad_divergence"))).otherwise(F.when(divergence != "", divergence)).alias("ad_divergence"))
    return reports.select("date", *out)


def table_csv_series(lines: DataFrame, title: str, last: int = 20) -> DataFrame:
    """Last values of the first column whose title contains a text, from lines(n, line) of a table with rows of metadata.

    The row that begins with Title names the columns, the data follow the one that begins with Series ID. Dates are day first;
    cells that are no numbers drop.
    """
    cells = lines.select("n", F.split("line", ",").alias("c")).withColumn("head", F.lower(F.trim(F.col("c")[0])))
    titles = cells.where("head = 'title'").orderBy("n").limit(1).select(F.posexplode("c").alias("i", "t")).where((F.col("i") > 0) & F.lower("t").contains(title.lower()))
    place = titles.agg(F.min("i").alias("i"))
    begin = cells.where("head = 'series id'").agg(F.min("n").alias("begin"))
    rows = cells.crossJoin(F.broadcast(place)).crossJoin(F.broadcast(begin)).where((F.col("n") > F.col("begin")) & F.col("i").isNotNull())
    day = F.coalesce(F.try_to_date(F.trim(F.col("c")[0]), "d/M/yyyy"), F.try_to_date(F.trim(F.col("c")[0]), "d-MMM-yyyy"), F.try_to_date(F.trim(F.col("c")[0]), "yyyy-MM-dd"))
    value = F.trim(F.try_element_at("c", (F.col("i") + 1).cast("int"))).try_cast("double")
    return rows.select(day.alias("date"), value.alias("value")).where("date is not null and value is not null").orderBy(F.desc("date")).limit(last)
