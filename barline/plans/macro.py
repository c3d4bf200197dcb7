"""Queries of macro, credit and sentiment tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import macro
from ..sources.tables import RUN_DATE, bars, indicators, table
from .sql import ALL_BARS, INDICATORS, RUN
from .studies import _LONG as BREADTH
from .studies import counts


def one(spark, d, ticker):
    return bars(spark, d).where(F.col("ticker") == ticker).select("date", F.col("adj_close").alias("v"))


def pair(spark, d):
    return macro.pair(one(spark, d, "MKT"), one(spark, d, "R0"))


def prices(spark, d):
    return bars(spark, d).where("ticker like 'R%'").select("ticker", "date", F.col("adj_close").alias("v"))


def snapshots(spark, d):
    """One row a date of the pair series, scaled into the range of the readings; some are missing."""
    a = pair(spark, d)
    i = F.dayofyear("date")
    return a.select(
        "date", (F.col("a") / 400).alias("vix"), F.when(i % 7 != 0, F.col("b") / 40).alias("vvix"), F.lit(None).cast("double").alias("vix_vvix"), F.when(i % 5 != 0, F.col("a") / F.col("b")).alias("vix_vix3m"),
        (F.col("a") / 500 - 6).alias("xly_xlp_chg_63d"), F.when(i % 3 != 0, F.col("b") / 500 - 7).alias("rspd_rsps_chg_63d"), (F.col("a") / 700 - 5).alias("risk_ratio_chg_10d"), (F.col("b") / 400 - 8).alias("cyc_iwm_spx_chg_63d"),
        F.when(i % 4 == 0, "BULLISH x").when(i % 4 == 1, "BEARISH x").when(i % 4 == 2, "CONFIRMING — breadth and price both RISING").alias("ad_divergence"), F.when(i % 6 != 0, F.col("b") / 1200).alias("hy_spread"),
        (F.col("a") / 10).alias("gold"), (F.col("b") / 3).alias("spx"), F.when(i % 9 != 0, F.col("a") / 2000).alias("us10y"),
    )


CYC = ["xle_spx", "xlk_spx", "xlf_xlu", "xly_xlp", "xli_spx", "xlb_spx", "xlp_spx", "xlu_spx", "xlv_spx", "iwm_spx", "xlf_spx"]


def cycle_rows(spark, d):
    return pair(spark, d).select("date", *((F.col("a" if i % 2 else "b") / (300 + 40 * i) - 7 + i / 2).alias(f"cyc_{c}_chg_63d") for i, c in enumerate(CYC)))


def flows(spark, d):
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    size = F.format_number(F.abs(cents) / 10, 1)
    text = F.when(F.col("c_custkey") % 50 == 0, "-").when(cents < 0, F.concat(F.lit("("), size, F.lit(")"))).when(F.col("c_custkey") % 7 == 0, F.concat(size, F.lit("*"))).otherwise(size)
    return table(spark, d, "customer").select("c_custkey", text.alias("text"))


def survey(spark, d):
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("date"))
    share = lambda k: (F.count_if(F.col("event_type") == k) / F.count("*"))
    return e.agg(share("signup").alias("bullish"), share("error").alias("bearish"))


def order_cells(spark, d):
    o = table(spark, d, "orders")
    by = o.groupBy(F.to_date(F.trunc("o_orderdate", "quarter")).alias("period"), F.col("o_orderstatus").alias("label")).agg(F.count("*").cast("double").alias("value"))
    total = o.groupBy(F.to_date(F.trunc("o_orderdate", "quarter")).alias("period")).agg(F.count("*").cast("double").alias("value"))
    return by.unionByName(total.select("period", F.lit("Total").alias("label"), "value"))


def exposures(spark, d):
    o = table(spark, d, "orders")
    new = o.select(F.when(F.col("o_orderkey") % 40 == 0, "n/a").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("date"), F.col("o_totalprice").cast("string").alias("value"), F.col("o_orderkey").alias("place")).where(F.col("place") % 3 == 0)
    cached = o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.min("o_totalprice").alias("value"))
    return macro.exposure_merge(new, cached)


def positions(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.to_date("l_shipdate").alias("date"), (F.col("l_quantity") * 3).alias("asset_long"), F.col("l_quantity").alias("asset_short"), F.col("l_linenumber").cast("double").alias("lev_long"), (F.col("l_quantity") / 2).alias("lev_short"), (F.col("l_quantity") * 10).alias("open_interest"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("place"))


def keyed():
    """A threshold key for each indicator."""
    return F.element_at(F.array(*map(F.lit, ["cc_delinquency", "hy_spread", "debt_gdp", "flow90_auto"])), (F.substring("key", 1, 1).cast("int") % 4 + 1).cast("int"))


def readings(spark, d, kind):
    """Several readings a day of one kind of event, at their times."""
    e = table(spark, d, "events").where((F.col("event_type") == kind) & (F.col("event_id") % 4 != 0))
    return e.select(F.to_date("ts").alias("date"), F.col("value").alias("v"), F.struct("ts", "event_id").alias("at"))


QUERIES = {
    "indicator_changes": lambda s, d: macro.indicator_changes(indicators(s, d)),
    "alert_level": lambda s, d: macro.indicator_changes(indicators(s, d)).select("key", "period", macro.alert_level(keyed(), F.col("value") / 10, F.col("change_1") / 10).alias("level")),
    "return_windows": lambda s, d: macro.return_windows(bars(s, d), RUN_DATE),
    "ratio_trend": lambda s, d: macro.ratio_trend(pair(s, d)),
    "ratio_roc": lambda s, d: macro.ratio_roc(pair(s, d)),
    "basket_ratio": lambda s, d: macro.basket_ratio(prices(s, d), ["R0", "R1", "R2"], ["R2", "R3", "R4"]),
    "leverage_stats": lambda s, d: macro.leverage_stats(one(s, d, "MKT").where("dayofmonth(date) = 1")),
    "cycle_to_date": lambda s, d: macro.cycle_to_date(one(s, d, "MKT"), "1998-11-01"),
    "change_alerts": lambda s, d: macro.change_alerts(snapshots(s, d)),
    "volatility_snapshot": lambda s, d: macro.volatility_snapshot(*(readings(s, d, kind) for kind in ("click", "error", "purchase")), "at"),
    "leverage_ratios": lambda s, d: macro.leverage_ratios(one(s, d, "MKT").where("dayofmonth(date) = 1"), one(s, d, "R0").where("dayofmonth(date) = 1 and month(date) % 5 <> 0"), one(s, d, "R1"), one(s, d, "R2").where("dayofmonth(date) = 1 and month(date) % 3 = 0")),
    "vix_regime": lambda s, d: snapshots(s, d).select("date", macro.vix_regime().alias("regime")),
    "risk_monitor": lambda s, d: macro.risk_monitor(snapshots(s, d)),
    "business_cycle": lambda s, d: macro.business_cycle(cycle_rows(s, d)),
    "credit_spread": lambda s, d: macro.credit_spread(one(s, d, "R1").where("dayofmonth(date) = 3"), one(s, d, "R2")),
    "arrears_rates": lambda s, d: macro.shares_of(order_cells(s, d), "Total", {"past_due": ["P"], "non_performing": ["F"], "combined": ["P", "F"]}),
    "subprime_share": lambda s, d: macro.shares_of(order_cells(s, d), "Total", {"share": ["O"]}),
    "survey_spread": lambda s, d: macro.survey_spread(survey(s, d)),
    "exposure_merge": exposures,
    "flow_numbers": lambda s, d: flows(s, d).select("c_custkey", macro.flow_number(F.col("text")).alias("value")),
    "positioning": lambda s, d: macro.positioning(positions(s, d)),
    "breadth_ad_line": lambda s, d: macro.breadth_ad_line(
        counts(s, d).where("layer = 'all' and group_type = 'all'").groupBy("date").pivot("metric", ["leader", "laggard", "weak"]).agg(F.first("value")), one(s, d, "MKT")
    ),
}

_V = "WITH " + ALL_BARS
_P = f"{_V}, pr AS (SELECT a.date, a.adj_close AS a, b.adj_close AS b, a.adj_close / b.adj_close AS ratio FROM bars a JOIN bars b USING (date) WHERE a.ticker = 'MKT' AND b.ticker = 'R0')"
_SNAP = f"""{_P}, sn AS (SELECT date, a / 400 AS vix, CASE WHEN dayofyear(date) % 7 <> 0 THEN b / 40 END AS vvix, CASE WHEN dayofyear(date) % 5 <> 0 THEN a / b END AS vix_vix3m, a / 500 - 6 AS x1, CASE WHEN dayofyear(date) % 3 <> 0 THEN b / 500 - 7 END AS x2,
  a / 700 - 5 AS x3, b / 400 - 8 AS x4, dayofyear(date) % 4 AS br, CASE WHEN dayofyear(date) % 6 <> 0 THEN b / 1200 END AS hy_spread, a / 10 AS gold, b / 3 AS spx, CASE WHEN dayofyear(date) % 9 <> 0 THEN a / 2000 END AS us10y FROM pr)"""


def _lags(cols: dict[str, int]) -> str:
    return ", ".join(f"round((ratio / lag(ratio, {k}) OVER w - 1) * 100, 2) AS {c}" for c, k in cols.items())


def _trend(x: str, band: int, up: int) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'UNAVAILABLE' WHEN {x} < -{band} THEN 'RISK OFF' WHEN {x} < 0 THEN 'CAUTION' WHEN {x} > {up} THEN 'SUPPORTIVE' ELSE 'NEUTRAL' END"


def _vote(items: list[str]) -> str:
    s = f"[{', '.join(items)}]"
    has = lambda x: f"list_contains({s}, '{x}')"
    return f"CASE WHEN {has('RISK OFF')} AND {has('SUPPORTIVE')} THEN 'CAUTION' WHEN {has('RISK OFF')} THEN 'RISK OFF' WHEN {has('CAUTION')} THEN 'CAUTION' WHEN {has('SUPPORTIVE')} THEN 'SUPPORTIVE' WHEN {has('NEUTRAL')} THEN 'NEUTRAL' ELSE 'UNAVAILABLE' END"


_GROUPS = {
    "volatility": _vote([
        "CASE WHEN vix IS NULL OR vix <= 0 THEN 'UNAVAILABLE' WHEN vix > 25 THEN 'RISK OFF' WHEN vix >= 20 THEN 'CAUTION' ELSE 'SUPPORTIVE' END",
        "CASE WHEN vix / vvix IS NULL OR vix / vvix <= 0 THEN 'UNAVAILABLE' WHEN vix > 0 AND vix < 20 AND vix / vvix < 0.18 THEN 'CAUTION' ELSE 'NEUTRAL' END",
        "CASE WHEN vix_vix3m IS NULL OR vix_vix3m <= 0 THEN 'UNAVAILABLE' WHEN vix_vix3m >= 1 THEN 'RISK OFF' ELSE 'NEUTRAL' END",
    ]),
    "consumer_leadership": _vote([_trend("x1", 5, 0), _trend("x2", 5, 0)]), "sector_rotation": _vote([_trend("x3", 3, 3)]),
    "participation": _vote([_trend("x4", 5, 5), "CASE br WHEN 0 THEN 'SUPPORTIVE' WHEN 1 THEN 'RISK OFF' WHEN 2 THEN 'SUPPORTIVE' ELSE 'UNAVAILABLE' END"]),
    "credit": _vote(["CASE WHEN hy_spread IS NULL OR hy_spread < 0 THEN 'UNAVAILABLE' WHEN hy_spread >= 6 THEN 'RISK OFF' WHEN hy_spread >= 4 THEN 'CAUTION' ELSE 'SUPPORTIVE' END"]),
}


def _count(s: str) -> str:
    return " + ".join(f"CAST({g} = '{s}' AS INTEGER)" for g in _GROUPS)


def _cyc() -> str:
    c = {k: f"({'a' if i % 2 else 'b'} / {300 + 40 * i} - 7 + {i / 2})" for i, k in enumerate(CYC)}
    return ", ".join(f"{v} AS {k}" for k, v in c.items())


_SCORE = [
    "2 * disc + 2 * fin + small + tech", "2 * tech + 2 * ind + mat + fin", "2 * en + mat + 1 - tech", "2 * en + 2 * def + 1 - disc + 1 - fin", "2 * def + 1 - en + hea + 2 * CAST(xly_xlp < -5 AS INTEGER)",
    "pre * (2 * hea + 2 * CAST(xlu_spx > 5 AS INTEGER) + 2 * CAST(xlp_spx > 5 AS INTEGER))", "2 * fin * (1 - en) + disc * (1 - tech) + small",
]
_LEVEL = " ".join(f"WHEN k = '{k}' AND value / 10 >= {v[i]} THEN '{n}'" for i, n in ((1, "ALERT"), (0, "WARN")) for k, v in macro.LEVELS.items()) + " " + " ".join(
    f"WHEN k = '{k}' AND change_1 / 10 >= {v[i]} THEN '{n}'" for i, n in ((1, "ALERT"), (0, "WARN")) for k, v in macro.CHANGES.items()
)
_CHANGES = f"{INDICATORS}, ch AS (SELECT key, period, value, lag(value) OVER w AS prior, round(value - lag(value) OVER w, 4) AS change_1, round(value - lag(value, 3) OVER w, 4) AS change_3 FROM indicators WINDOW w AS (PARTITION BY key ORDER BY period))"
_MOVES = {k: v for k, v in macro.SNAPSHOT_CHANGES.items() if k in ("vix", "hy_spread", "gold", "spx", "us10y")}
_QUARTER = "CAST(date_trunc('quarter', o_orderdate) AS DATE)"

SQL = {
    "indicator_changes": f"WITH {_CHANGES} SELECT * FROM ch",
    "alert_level": f"WITH {_CHANGES}, k AS (SELECT *, ['cc_delinquency', 'hy_spread', 'debt_gdp', 'flow90_auto'][CAST(key[1] AS INTEGER) % 4 + 1] AS k FROM ch) SELECT key, period, CASE WHEN value IS NULL THEN 'UNKNOWN' {_LEVEL} ELSE 'OK' END AS level FROM k",
    "return_windows": f"""{_V}, r AS (SELECT ticker, adj_close AS p, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars WHERE date <= {RUN})
SELECT ticker, {', '.join(f"round((max(p) FILTER (k = 1) / max(p) FILTER (k = {n}) - 1) * 100, 2) AS ret_{n}" for n in (5, 21, 63, 252))} FROM r GROUP BY ticker""",
    "ratio_trend": f"{_P}, x AS (SELECT date, row_number() OVER w AS n, round(ratio, 4) AS r, {_lags({'chg_5d': 4, 'chg_20d': 19, 'chg_63d': 62})} FROM pr WINDOW w AS (ORDER BY date)) SELECT date, r AS ratio, chg_5d, chg_20d, chg_63d FROM x WHERE n >= 63",
    "ratio_roc": f"{_P}, x AS (SELECT date, round(ratio, 4) AS r, {_lags({'roc_5d': 5, 'roc_21d': 21, 'roc_63d': 63})} FROM pr WINDOW w AS (ORDER BY date)) SELECT date, r AS ratio, roc_5d, roc_21d, roc_63d FROM x",
    "basket_ratio": f"""{_V}, b AS (SELECT date, sum(adj_close) FILTER (ticker IN ('R0', 'R1', 'R2')) / sum(adj_close) FILTER (ticker IN ('R2', 'R3', 'R4')) AS ratio FROM bars WHERE ticker LIKE 'R%' GROUP BY date HAVING count(DISTINCT ticker) = 5),
x AS (SELECT date, round(ratio, 4) AS r, {_lags({'chg_5d': 4, 'chg_10d': 9})} FROM b WINDOW w AS (ORDER BY date)) SELECT date, r AS ratio, chg_5d, chg_10d FROM x""",
    "leverage_stats": f"""{_V}, m AS (SELECT date, adj_close AS v, row_number() OVER w AS n, lag(adj_close) OVER w AS p1, lag(adj_close, 2) OVER w AS p2, max(adj_close) OVER w AS top FROM bars WHERE ticker = 'MKT' AND dayofmonth(date) = 1 WINDOW w AS (ORDER BY date)),
x AS (SELECT *, CASE WHEN n >= 3 THEN round((v / p1 - 1) * 100, 2) END AS chg_1m, CASE WHEN n >= 4 THEN round((v / p2 - 1) * 100, 2) END AS chg_3m FROM m) SELECT date, v, chg_1m, chg_3m, round((v / top - 1) * 100, 2) AS from_peak, round(chg_1m - chg_3m / 3, 4) AS acceleration FROM x""",
    "cycle_to_date": f"""{_V}, s AS (SELECT date, adj_close AS v, first(adj_close) OVER w AS f, max(adj_close) OVER w AS top FROM bars WHERE ticker = 'MKT' AND date >= DATE '1998-11-01' WINDOW w AS (ORDER BY date))
SELECT date, round((v / f - 1) * 100, 2) AS ret, round(min((v - top) / top) OVER (ORDER BY date) * 100, 2) AS max_dd, round(top, 2) AS high, round((v / top - 1) * 100, 2) AS dd_now, datediff('day', DATE '1998-11-01', date) AS days,
  CAST(least(4, datediff('day', DATE '1998-11-01', date) // 365 + 1) AS INTEGER) AS year FROM s""",
    "change_alerts": f"{_SNAP}, c AS ("
    + " UNION ALL ".join(f"SELECT date, '{k}' AS key, {k} AS v, lag({k}) OVER (ORDER BY date) AS p, {a} AS a, {b} AS b, '{u}' AS u FROM sn" for k, (a, b, u) in _MOVES.items())
    + "), x AS (SELECT *, CASE u WHEN '%' THEN (v - p) / p * 100 ELSE v - p END AS ch FROM c WHERE v IS NOT NULL AND p IS NOT NULL) SELECT date, key, round(ch, 2) AS change, CASE WHEN abs(ch) >= b THEN 'ALERT' ELSE 'WATCH' END AS level FROM x WHERE abs(ch) >= a",
    "volatility_snapshot": """WITH l AS (SELECT event_type AS k, CAST(ts AS DATE) AS date, round(arg_max(value, (ts, event_id)), 4) AS v FROM events WHERE value > 0 AND event_id % 4 <> 0 GROUP BY ALL),
x AS (SELECT a.date, a.v AS vix, b.v AS vvix, c.v AS vix3m FROM l a LEFT JOIN l b ON b.date = a.date AND b.k = 'error' LEFT JOIN l c ON c.date = a.date AND c.k = 'purchase' WHERE a.k = 'click')
SELECT *, round(vix / vvix, 4) AS vix_vvix, round(vix / vix3m, 4) AS vix_vix3m FROM x""",
    "leverage_ratios": f"""{_V}, s AS (SELECT date, ticker, adj_close AS v FROM bars WHERE dayofmonth(date) = 1),
p AS (SELECT a.date, round(a.v, 0) AS margin_debt, round(a.v / b.v, 4) AS margin_to_money FROM s a JOIN s b ON b.date = a.date AND a.ticker = 'MKT' AND b.ticker = 'R0' WHERE month(b.date) % 5 <> 0),
q AS (SELECT a.date, round(a.v / 1000 / b.v * 100, 2) AS worth_to_output FROM bars0 a JOIN s b ON b.date = a.date AND b.ticker = 'R2' WHERE month(b.date) % 3 = 0)
SELECT coalesce(p.date, q.date) AS date, margin_debt, margin_to_money, worth_to_output FROM p FULL JOIN q ON p.date = q.date""".replace("bars0 a", "(SELECT date, adj_close AS v FROM bars WHERE ticker = 'R1') a"),
    "vix_regime": f"""{_SNAP} SELECT date, CASE WHEN vix IS NULL OR vix <= 0 THEN 'UNKNOWN' WHEN vix > 25 THEN 'VOLATILITY STRESS' WHEN vix >= 20 THEN 'ELEVATED VOLATILITY' WHEN vix / vvix < 0.17 THEN 'COMPLACENCY WARNING' WHEN vix / vvix < 0.18 THEN 'VOLATILITY — MONITOR'
  WHEN vix < 15 THEN 'LOW VOLATILITY' ELSE 'NORMAL VOLATILITY' END AS regime FROM sn""",
    "risk_monitor": f"""{_SNAP}, g AS (SELECT date, vix, hy_spread, {', '.join(f'{v} AS {k}' for k, v in _GROUPS.items())} FROM sn), c AS (SELECT *, {_count('RISK OFF')} AS risk_off, {_count('CAUTION')} AS caution, {_count('SUPPORTIVE')} AS supportive, 5 - ({_count('UNAVAILABLE')}) AS available FROM g)
SELECT date, CASE WHEN coalesce(vix > 25, false) OR coalesce(hy_spread >= 6, false) OR risk_off >= 2 THEN 'RISK OFF' WHEN available < 3 THEN 'INSUFFICIENT DATA' WHEN risk_off + caution > 0 THEN 'CAUTIOUS'
  WHEN supportive >= 3 AND volatility = 'SUPPORTIVE' AND consumer_leadership = 'SUPPORTIVE' THEN 'RISK ON' ELSE 'MIXED' END AS regime, {', '.join(_GROUPS)}, risk_off, caution, supportive, available FROM c""",
    "business_cycle": f"""{_P}, c AS (SELECT date, {_cyc()} FROM pr), f AS (SELECT *, CAST(xle_spx > 10 AS INTEGER) AS en, CAST(xlk_spx > 5 AS INTEGER) AS tech, CAST(xly_xlp > 5 AS INTEGER) AS disc, CAST(xlf_xlu > 5 AND xlf_spx > 0 AS INTEGER) AS fin, CAST(xli_spx > 5 AS INTEGER) AS ind,
  CAST(xlb_spx > 5 AS INTEGER) AS mat, CAST((xlp_spx > 3 OR xlu_spx > 3) AND xly_xlp < 0 AS INTEGER) AS def, CAST(xlv_spx > 5 AS INTEGER) AS hea, CAST(iwm_spx > 5 AS INTEGER) AS small, CAST(xlu_spx > 0 OR xlp_spx > 0 AS INTEGER) AS pre FROM c),
s AS (SELECT date, [{', '.join(_SCORE)}] AS x FROM f) SELECT date, [{', '.join(f"'{p}'" for p in macro.PHASES)}][list_position(x, list_max(x))] AS phase, list_max(x) AS score FROM s""",
    "credit_spread": f"""{_V}, m AS (SELECT last_day(date) AS month, arg_max(adj_close, date) AS d FROM bars WHERE ticker = 'R2' GROUP BY 1) SELECT month, round(c.adj_close - d, 3) AS spread FROM bars c JOIN m ON last_day(c.date) = month
WHERE ticker = 'R1' AND dayofmonth(c.date) = 3 ORDER BY month DESC LIMIT 24""",
    "arrears_rates": f"SELECT {_QUARTER} AS period, round(nullif(count(*) FILTER (o_orderstatus = 'P'), 0) / count(*) * 100, 3) AS past_due, round(nullif(count(*) FILTER (o_orderstatus = 'F'), 0) / count(*) * 100, 3) AS non_performing, round(nullif(count(*) FILTER (o_orderstatus IN ('P', 'F')), 0) / count(*) * 100, 3) AS combined FROM orders GROUP BY 1",
    "subprime_share": f"SELECT {_QUARTER} AS period, round(nullif(count(*) FILTER (o_orderstatus = 'O'), 0) / count(*) * 100, 3) AS share FROM orders GROUP BY 1",
    "survey_spread": "SELECT CAST(ts AS DATE) AS date, round(count(*) FILTER (event_type = 'signup') / count(*) - count(*) FILTER (event_type = 'error') / count(*), 4) AS spread FROM events GROUP BY 1",
    "exposure_merge": """WITH c AS (SELECT CAST(o_orderdate AS DATE) AS date, min(o_totalprice) AS v FROM orders GROUP BY 1), n AS (SELECT CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS v FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 40 <> 0 GROUP BY 1)
SELECT c.date, coalesce(n.v, c.v) AS value FROM c LEFT JOIN n USING (date)""",
    "flow_numbers": "SELECT c_custkey, CASE WHEN c_custkey % 50 <> 0 THEN CAST(printf('%.1f', round(abs(CAST(round(c_acctbal * 100) AS BIGINT)) / 10, 1)) AS DOUBLE) * CASE WHEN c_acctbal < 0 AND round(c_acctbal * 100) < 0 THEN -1 ELSE 1 END END AS value FROM customer",
    "positioning": """WITH l AS (SELECT CAST(l_shipdate AS DATE) AS date, last(l_quantity ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS q, last(l_linenumber ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS n FROM lineitem GROUP BY 1)
SELECT date, q * 2 AS asset_net, n - q / 2 AS lev_net, round((q * 3 - q) / (q * 10) * 100, 2) AS asset_pct, round((n - q / 2) / (q * 10) * 100, 2) AS lev_pct FROM l""",
    "breadth_ad_line": f"""WITH {BREADTH}, t AS (SELECT date, sum(CASE metric WHEN 'leader' THEN value WHEN 'laggard' THEN -value WHEN 'weak' THEN -value END) AS net FROM lo WHERE group_type = 'all' GROUP BY date ORDER BY date DESC LIMIT 63),
l AS (SELECT date, sum(net) OVER (ORDER BY date) AS ad FROM t), b AS (SELECT date, ad, lag(ad, 21) OVER (ORDER BY date) AS ab FROM l), i AS (SELECT adj_close AS p, lag(adj_close, 21) OVER (ORDER BY date) AS pb, date AS d FROM bars WHERE ticker = 'MKT'),
z AS (SELECT * FROM (SELECT * FROM b ORDER BY date DESC LIMIT 1), (SELECT * FROM i ORDER BY d DESC LIMIT 1)) SELECT date, ad, CASE WHEN ad > ab THEN 'RISING' ELSE 'FALLING' END AS ad_trend, CASE WHEN ad > ab AND p <= pb THEN 'BULLISH — breadth improving while price falls'
  WHEN ad <= ab AND p > pb THEN 'BEARISH — breadth deteriorating while price rises' WHEN p > pb THEN 'CONFIRMING — breadth and price both RISING' ELSE 'CONFIRMING — breadth and price both FALLING' END AS ad_divergence FROM z""",
}
