"""Queries of income-fund scores and rules; the funds are the instruments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import income
from ..sources.tables import RUN_DATE, bars, holdings, securities
from .sql import ALL_BARS, HOLDINGS, RUN, SECURITIES

BUY = [f"I{i}" for i in range(5)]


def funds(spark, d):
    return bars(spark, d, references=False)


def scored(spark, d):
    return income.fund_score(income.fund_metrics(funds(spark, d), RUN_DATE), strength(spark, d))


def strength(spark, d):
    return income.underlying_rs(bars(spark, d).where("ticker = 'MKT' or ticker like 'I%'"), "MKT", RUN_DATE)


def _series(spark, d, ticker):
    return bars(spark, d).where(F.col("ticker") == ticker).select("date", "close")


def calendar(spark, d):
    return bars(spark, d).where("ticker = 'MKT'").select("date")


def dates(spark, d):
    return income.rebalance_dates(calendar(spark, d), "2000-01-01", "2001-06-30", 3)


def details(spark, d):
    """Underlying label and payout frequency of each fund: two labels with a proxy, one that is a ticker itself, one without any."""
    i = F.substring("ticker", 2, 20).cast("long")
    label = F.element_at(F.array(*map(F.lit, ["SPX", "RUT", "diversified", "R4"])), (i % 4 + 1).cast("int"))
    return securities(spark, d).where("quote_type = 'EQUITY'").select("ticker", label.alias("underlying"), F.when(i % 3 == 0, "weekly").otherwise("monthly").alias("frequency"))


def underlyings(spark, d):
    """Closes of the market and of the underlyings' series; R2 and R3 stand for the proxies of SPX and RUT."""
    name = F.when(F.col("ticker") == "R2", "^GSPC").when(F.col("ticker") == "R3", "^RUT").otherwise(F.col("ticker"))
    return bars(spark, d).where("ticker in ('MKT', 'R2', 'R3', 'R4')").select(name.alias("ticker"), "date", "close")


def point_in_time(spark, d, frequency="all"):
    return income.point_in_time_scores(funds(spark, d), dates(spark, d), details(spark, d), underlyings(spark, d), "MKT", frequency)


TODAY = "2001-07-02"


def positions(spark, d):
    """Holdings with shares; some lack a price, a date, or a currency."""
    k = F.col("holding_id")
    h = holdings(spark, d).withColumn("shares", F.when(k % 13 != 0, (k % 40 + 1).cast("double")))
    h = h.withColumn("entry_price", F.when(k % 17 != 0, F.col("entry_price"))).withColumn("entry_date", F.when(k % 19 != 0, F.col("entry_date")))
    h = h.withColumn("quote_currency", F.when(k % 23 != 0, F.col("quote_currency")))
    return h.select("holding_id", F.when(k % 29 == 0, "NONE").otherwise(F.col("ticker")).alias("ticker"), "shares", "entry_price", "entry_date", "quote_currency")


def still_held(spark, d):
    """Funds whose newest holding has an odd id; the others count as sold."""
    return positions(spark, d).groupBy("ticker").agg(F.max("holding_id").alias("newest")).where("newest % 2 = 1").select("ticker")


def reviewed_bars(spark, d):
    """The funds' bars, every fifth fund with a split on file, every eleventh without recent bars."""
    i = F.substring("ticker", 2, 20).cast("int")
    b = funds(spark, d).where((i % 11 != 7) | (F.col("date") < F.lit("2001-06-01")))
    return b.withColumn("split", F.when((i % 5 == 0) & (F.month("date") == 3) & (F.year("date") == 1998), 2.0).otherwise(F.col("split")))


def priced_in(spark, d):
    return securities(spark, d).select("ticker", F.when(F.col("region") == "US", "USD").otherwise("AUD").alias("currency"))


QUERIES = {
    "holding_review": lambda s, d: income.holding_review(positions(s, d), scored(s, d), reviewed_bars(s, d), priced_in(s, d), TODAY, 5),
    "buy_candidates": lambda s, d: income.buy_candidates(still_held(s, d), scored(s, d), 5),
    "fund_metrics": lambda s, d: income.fund_metrics(funds(s, d), RUN_DATE),
    "underlying_rs": strength,
    "fund_score": lambda s, d: scored(s, d).select("ticker", "score", "qualified", "rank"),
    "score_contributions": lambda s, d: income.score_contributions(scored(s, d)),
    "qualified_ranks": lambda s, d: income.qualified_ranks(scored(s, d)),
    "ranking_decision": lambda s, d: income.ranking_decision(holdings(s, d).select("ticker").unionByName(s.createDataFrame([("ZZ",)], "ticker string")), scored(s, d), 5),
    "holding_return": lambda s, d: income.holding_return(holdings(s, d), funds(s, d), RUN_DATE).select("holding_id", "ticker", "total_return"),
    "stop_status": lambda s, d: income.holding_return(holdings(s, d), funds(s, d), RUN_DATE).groupBy("status").agg(F.count("*").alias("n")),
    "payout_schedule": lambda s, d: income.payout_schedule(funds(s, d), RUN_DATE),
    "hedge_signal": lambda s, d: income.hedge_signal(_series(s, d, "MKT"), _series(s, d, "R0")),
    "allocation": lambda s, d: income.allocation(income.fund_metrics(funds(s, d), RUN_DATE), BUY, 100000.0, 0.65),
    "rebalance_dates": dates,
    "point_in_time_scores": point_in_time,
    "point_in_time_weekly": lambda s, d: point_in_time(s, d, "weekly"),
    "cash_rate": lambda s, d: income.cash_rate(_series(s, d, "R1").where(F.dayofmonth("date") == 15).select("date", (F.col("close") / 1000 - 1).alias("value")), calendar(s, d)),
}


def _metrics(name: str, source: str, key: str) -> str:
    """Fund metrics of source(key columns, date, close, dividend) as the table name."""
    return f"""{name}0 AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS n, row_number() OVER (PARTITION BY {key} ORDER BY date) AS i, lag(close) OVER (PARTITION BY {key} ORDER BY date) AS pc,
  count(*) FILTER (dividend > 0) OVER (PARTITION BY {key} ORDER BY date) AS k FROM {source}),
{name}1 AS (SELECT {key}, arg_max(close, i) AS last, arg_min(close, i) AS first, max(close) FILTER (n - i + 1 = 63) AS b63, avg(close / pc - 1) FILTER (n - i + 1 <= 62) AS m, stddev_samp(close / pc - 1) FILTER (n - i + 1 <= 62) AS s,
  count(*) FILTER (dividend > 0) AS n_dists, sum(dividend) FILTER (dividend > 0) AS paid, avg(dividend) FILTER (dividend > 0) AS mean, regr_slope(dividend, k) FILTER (dividend > 0) AS slope, stddev_pop(dividend) FILTER (dividend > 0) AS sp,
  greatest(datediff('day', min(date), max(date)), 1) AS span FROM {name}0 WHERE n >= 63 GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {key}, round(last, 2) AS price, round((last / b63 - 1) * 100, 2) AS chg_3m, round((last / first - 1) * 100, 2) AS chg_12m, round(CASE WHEN s > 0 THEN m / s * sqrt(252.0) ELSE 0.0 END, 2) AS sharpe,
  CASE WHEN n_dists >= 4 THEN round(paid / last * 100 * (365.0 / span), 2) ELSE 0.0 END AS yield_ttm, CASE WHEN n_dists >= 4 AND mean > 0 THEN round(slope / mean * 100, 2) ELSE 0.0 END AS dist_slope,
  CASE WHEN n_dists >= 4 THEN round(greatest(0.0, least(1.0, 1.0 - sp / mean)), 2) ELSE 0.0 END AS dist_consist, n_dists, round((last - first + coalesce(paid, 0.0)) / first * 100, 2) AS total_ret_12m FROM {name}1)"""


def _score(name: str, source: str, part: str) -> str:
    p = f"PARTITION BY {part}" if part else ""
    pct = lambda c: f"(rank() OVER ({p} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part + ', ' if part else ''}{c}) - 1) / 2) / count({c}) OVER ({p})"
    parts = ", ".join(f"{pct(c)} AS r_{c}" for c in income.WEIGHTS)
    total = " + ".join(f"r_{c} * {w}" for c, w in income.WEIGHTS.items())
    return f"""{name}0 AS (SELECT *, {parts} FROM {source}), {name} AS MATERIALIZED (SELECT *, row_number() OVER ({p} ORDER BY score DESC, ticker) AS rank FROM (
  SELECT *, round(({total}) * 100, 6) AS score, CASE WHEN chg_3m > 0 THEN 1 ELSE 0 END AS qualified FROM {name}0))"""


_YEAR = f"yr AS (SELECT ticker, date, close, dividend FROM bars WHERE ticker LIKE 'I%' AND date > {RUN} - INTERVAL 365 DAY AND date <= {RUN})"
_STRENGTH = f"""yx AS (SELECT ticker, date, close, count(*) OVER (PARTITION BY ticker) - row_number() OVER (PARTITION BY ticker ORDER BY date) + 1 AS back, count(*) OVER (PARTITION BY ticker) AS n FROM bars
  WHERE (ticker LIKE 'I%' OR ticker = 'MKT') AND date > {RUN} - INTERVAL 365 DAY AND date <= {RUN}),
r0 AS (SELECT ticker, least(252, max(n)) AS far, max(n) AS n, max(close) FILTER (back = 1) AS z, max(close) FILTER (back = 63) AS b FROM yx WHERE n >= 63 GROUP BY ticker),
und AS (SELECT a.ticker, round(0.5 * ((a.z / a.b - 1) * 100 - (m.z / m.b - 1) * 100) + 0.5 * ((a.z / x.close - 1) * 100 - (m.z / y.close - 1) * 100), 2) AS underlying_rs
  FROM r0 a JOIN r0 m ON m.ticker = 'MKT' AND a.ticker <> 'MKT' JOIN yx x ON x.ticker = a.ticker AND x.back = a.far JOIN yx y ON y.ticker = 'MKT' AND y.back = least(a.far, m.n))"""
_F = f"{ALL_BARS}, {_YEAR}, {_metrics('fm', 'yr', 'ticker')}"
_SC = f"{_F}, {_STRENGTH}, fx AS (SELECT fm.*, coalesce(underlying_rs, 0.0) AS underlying_rs FROM fm LEFT JOIN und USING (ticker)), {_score('sc', 'fx', '')}"
_Q = "qr AS (SELECT ticker, row_number() OVER (ORDER BY rank) AS qualified_rank FROM sc WHERE qualified = 1)"
_HOLD = f"""{ALL_BARS}, {HOLDINGS}, lp AS (SELECT ticker, arg_max(close, date) AS close FROM bars WHERE date <= {RUN} GROUP BY ticker),
hr AS (SELECT *, round(raw, 6) AS total_return FROM (SELECT holding_id, h.ticker, (lp.close + coalesce((SELECT CAST(sum(CAST(dividend AS DECIMAL(18,4))) AS DOUBLE) FROM bars b WHERE b.ticker = h.ticker AND b.date > h.entry_date AND b.date <= {RUN}), 0)) / entry_price - 1 AS raw
  FROM holdings h LEFT JOIN lp USING (ticker) WHERE entry_price > 0))"""
_DATES = f"rd AS (SELECT CAST(p AS DATE) AS period_start, (SELECT min(date) FROM bars WHERE ticker = 'MKT' AND date >= p) AS date FROM generate_series(DATE '2000-01-01', DATE '2001-06-30', INTERVAL 3 MONTH) x(p))"

# Strength from lists: each series' closes of the year before a rebalance, in order, indexed from the end.
POINT_IN_TIME = f"""{ALL_BARS}, {_DATES}, fd AS (SELECT 'I' || i AS ticker, ['SPX', 'RUT', 'diversified', 'R4'][i % 4 + 1] AS underlying FROM (SELECT DISTINCT s_suppkey // 5 AS i FROM supplier) WHERE {{keep}}),
px0 AS (SELECT u.underlying, rd.date AS rebalance, list(close ORDER BY bars.date) AS c FROM (VALUES ('SPX', 'R2'), ('RUT', 'R3'), ('R4', 'R4'), ('market', 'MKT')) u(underlying, series)
  JOIN bars ON bars.ticker = u.series JOIN rd ON bars.date > rd.date - INTERVAL 365 DAY AND bars.date <= rd.date GROUP BY ALL),
us AS (SELECT u.rebalance, u.underlying, round(0.5 * ((u.c[-1] / u.c[-63] - 1) * 100 - (m.c[-1] / m.c[-63] - 1) * 100) + 0.5 * ((u.c[-1] / u.c[-least(252, len(u.c))] - 1) * 100 - (m.c[-1] / m.c[-least(252, len(u.c), len(m.c))] - 1) * 100), 2) AS underlying_rs
  FROM px0 u JOIN px0 m ON m.underlying = 'market' AND u.underlying <> 'market' AND m.rebalance = u.rebalance WHERE len(u.c) >= 63 AND len(m.c) >= 63),
sp AS (SELECT rd.date AS rebalance, ticker, bars.date, close, dividend FROM bars JOIN rd ON bars.date > rd.date - INTERVAL 365 DAY AND bars.date <= rd.date WHERE ticker IN (SELECT ticker FROM fd)),
{_metrics('pm', 'sp', 'rebalance, ticker')}, px AS (SELECT pm.*, coalesce(us.underlying_rs, 0.0) AS underlying_rs FROM pm JOIN fd USING (ticker) LEFT JOIN us ON us.rebalance = pm.rebalance AND us.underlying = fd.underlying),
{_score('ps', 'px', 'rebalance')}"""

_POS = f"""{HOLDINGS}, pos AS MATERIALIZED (SELECT holding_id, CASE WHEN holding_id % 29 = 0 THEN 'NONE' ELSE ticker END AS ticker, CASE WHEN holding_id % 13 <> 0 THEN holding_id % 40 + 1 END AS shares, CASE WHEN holding_id % 17 <> 0 THEN entry_price END AS entry_price,
  CASE WHEN holding_id % 19 <> 0 THEN entry_date END AS entry_date, CASE WHEN holding_id % 23 <> 0 THEN quote_currency END AS quote_currency FROM holdings)"""
_REVIEW = f"""{_SC}, {_Q}, {_POS}, {SECURITIES}, rb AS MATERIALIZED (SELECT ticker, date, close, dividend, CAST(substr(ticker, 2) AS INTEGER) % 5 = 0 AND month(date) = 3 AND year(date) = 1998 AS divided FROM bars
  WHERE ticker LIKE 'I%' AND date <= DATE '2001-07-02' AND (CAST(substr(ticker, 2) AS INTEGER) % 11 <> 7 OR date < DATE '2001-06-01')),
sp AS (SELECT ticker, min(date) AS a, max(date) AS z, arg_max(close, date) AS c, max(date) FILTER (divided) AS cut FROM rb GROUP BY ticker),
h AS (SELECT pos.*, sp.*, CASE WHEN region = 'US' THEN 'USD' WHEN region = 'AU' THEN 'AUD' END AS currency, CASE WHEN entry_date IS NOT NULL THEN CAST(coalesce((SELECT sum(CAST(dividend AS DECIMAL(18,4))) FROM rb WHERE rb.ticker = pos.ticker AND rb.date > entry_date), 0) AS DOUBLE) END AS paid
  FROM pos LEFT JOIN sp ON sp.ticker = pos.ticker LEFT JOIN (SELECT ticker AS t, region FROM securities) s ON s.t = pos.ticker),
v AS (SELECT *, (c + coalesce(paid, 0.0)) / CASE WHEN entry_price > 0 THEN entry_price END - 1 AS value FROM h),
w AS (SELECT *, concat_ws('; ', CASE WHEN entry_date IS NULL THEN 'entry date missing' WHEN entry_date > DATE '2001-07-02' THEN 'entry after review' WHEN entry_date < a THEN 'prices begin after entry' END, CASE WHEN entry_price > 0 THEN NULL ELSE 'entry price missing' END,
  CASE WHEN z IS NULL THEN 'no prices' WHEN DATE '2001-07-02' - z > 5 THEN 'prices stale' END, CASE WHEN cut > entry_date THEN 'split after entry' END, CASE WHEN currency = quote_currency THEN NULL ELSE 'currency mismatch' END, CASE WHEN value IS NULL THEN 'no return' END) AS warnings FROM v)"""

SQL = {
    "holding_review": f"""WITH {_REVIEW} SELECT holding_id, w.ticker, CASE WHEN sc.score IS NULL THEN 'NOT IN UNIVERSE' WHEN qualified = 0 THEN 'SELL' WHEN qualified_rank <= 5 THEN 'HOLD' ELSE 'REVIEW' END AS signal, qualified_rank, round(value, 6) AS total_return,
  CASE WHEN warnings <> '' THEN 'not_assessed' WHEN value <= -2e-1 THEN 'HIT' WHEN value <= -2e-1 * 75e-2 THEN 'NEAR' ELSE 'OK' END AS stop_status, a AS first_price_date, z AS last_price_date, paid AS payouts_after_entry, CASE WHEN shares > 0 THEN 'provided' ELSE 'missing' END AS quantity_status, warnings
FROM w LEFT JOIN sc ON sc.ticker = w.ticker LEFT JOIN qr ON qr.ticker = w.ticker""",
    "buy_candidates": f"WITH {_SC}, {_Q}, {_POS} SELECT * FROM qr WHERE qualified_rank <= 5 AND ticker NOT IN (SELECT ticker FROM pos GROUP BY ticker HAVING max(holding_id) % 2 = 1)",
    "fund_metrics": f"WITH {_F} SELECT * FROM fm",
    "underlying_rs": f"WITH {ALL_BARS}, {_STRENGTH} SELECT * FROM und",
    "fund_score": f"WITH {_SC} SELECT ticker, score, qualified, rank FROM sc",
    "score_contributions": f"WITH {_SC} " + " UNION ALL ".join(f"SELECT ticker, '{c}' AS component, round(r_{c} * {w} * 100, 6) AS points FROM sc" for c, w in income.WEIGHTS.items()),
    "qualified_ranks": f"WITH {_SC}, {_Q} SELECT * FROM qr",
    "ranking_decision": f"""WITH {_SC}, {_Q}, {HOLDINGS}, t AS (SELECT DISTINCT ticker FROM holdings UNION SELECT 'ZZ') SELECT ticker, CASE WHEN score IS NULL THEN 'NOT IN UNIVERSE' WHEN qualified = 0 THEN 'SELL' WHEN qualified_rank <= 5 THEN 'HOLD' ELSE 'REVIEW' END AS signal,
  qualified_rank FROM t LEFT JOIN sc USING (ticker) LEFT JOIN qr USING (ticker)""",
    "holding_return": f"WITH {_HOLD} SELECT holding_id, ticker, total_return FROM hr",
    "stop_status": f"WITH {_HOLD} SELECT CASE WHEN raw IS NULL THEN 'not_assessed' WHEN raw <= -2e-1 THEN 'HIT' WHEN raw <= -2e-1 * 75e-2 THEN 'NEAR' ELSE 'OK' END AS status, count(*) AS n FROM hr GROUP BY 1",
    "payout_schedule": f"""WITH {ALL_BARS}, p AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars WHERE ticker LIKE 'I%' AND dividend > 0 AND date BETWEEN {RUN} - INTERVAL 6 MONTH AND {RUN}),
g AS (SELECT ticker, date, datediff('day', lag(date) OVER (PARTITION BY ticker ORDER BY date), date) AS gap FROM p WHERE k <= 8), m AS (SELECT ticker, max(date) AS last, CAST(floor(median(gap)) AS INTEGER) AS gap FROM g GROUP BY ticker HAVING count(*) >= 2)
SELECT ticker, CAST(last + gap * greatest(1, CAST(ceil(datediff('day', last, {RUN}) / gap) AS INTEGER)) AS DATE) AS estimated_ex_date, CASE WHEN gap <= 10 THEN 'weekly' WHEN gap <= 45 THEN 'monthly' ELSE 'quarterly' END AS frequency, gap AS median_gap_days FROM m WHERE gap > 0""",
    "hedge_signal": f"""WITH {ALL_BARS}, r AS (SELECT date, a.close / last_value(b.close IGNORE NULLS) OVER (ORDER BY date) AS ratio FROM (SELECT date, close FROM bars WHERE ticker = 'MKT') a LEFT JOIN (SELECT date, close FROM bars WHERE ticker = 'R0') b USING (date))
SELECT date, coalesce(last_value(CASE WHEN ratio >= 1.0 THEN 1 WHEN ratio <= 0.95 THEN 0 END IGNORE NULLS) OVER (ORDER BY date), 0) AS hedged FROM r WHERE ratio IS NOT NULL""",
    "allocation": f"""WITH {_F}, a AS (SELECT ticker, price, CASE WHEN price > 0 THEN CAST(floor(100000.0 * 0.65 / 5 / price) AS BIGINT) END AS shares FROM fm WHERE ticker IN ({', '.join(f"'{b}'" for b in BUY)}))
SELECT ticker, price, shares, round(shares * price, 6) AS cost, round(100000.0 * 0.65 - sum(round(shares * price, 6)) OVER (), 6) AS cash_left FROM a""",
    "rebalance_dates": f"WITH {ALL_BARS}, {_DATES} SELECT * FROM rd",
    "point_in_time_scores": f"WITH {POINT_IN_TIME.format(keep='true')} SELECT rebalance, ticker, price, chg_3m, underlying_rs, score, qualified, rank FROM ps",
    "point_in_time_weekly": f"WITH {POINT_IN_TIME.format(keep='i % 3 = 0')} SELECT rebalance, ticker, price, chg_3m, underlying_rs, score, qualified, rank FROM ps",
    "cash_rate": f"""WITH {ALL_BARS}, b AS (SELECT date, close / 1000 - 1 AS value FROM bars WHERE ticker = 'R1' AND dayofmonth(date) = 15), c AS (SELECT date FROM bars WHERE ticker = 'MKT')
SELECT date, coalesce(greatest((SELECT arg_max(value, b.date) FROM b WHERE b.date <= c.date), 0.0) / 100 / 252, 0.0) AS rate FROM c""",
}
