"""Backtest ledgers; their SQL walks day by day through recursive queries with lists of lots, as the rules are stated."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest
from ..sources.stored import cut
from ..sources.tables import bars, securities
from . import income
from .income import POINT_IN_TIME

START, HEDGER, BENCHMARK = "2000-01-01", "R0", "I3"
GRID = {"plain": (0.0, 0.0, 0.0), "all": (0.1, 110000.0, 0.2)}  # hedge share, level to draw to, stop
SIZES = (1, 3, 5)


def configs(spark, d):
    """A grid of six configurations."""
    return spark.createDataFrame([(f"top{n}-{k}", n, 100000.0, *rest) for n in SIZES for k, rest in GRID.items()], backtest.CONFIG)


def days(spark, d):
    marks = income.dates(spark, d).select("date", F.lit(True).alias("rebalance")).distinct()
    rate = income.QUERIES["cash_rate"](spark, d)
    rows = rate.where(F.col("date") >= F.lit(START)).join(income.QUERIES["hedge_signal"](spark, d), "date", "left").join(F.broadcast(marks), "date", "left")
    return rows.select("date", "rate", F.coalesce(F.col("hedged") == 1, F.lit(False)).alias("signal"), F.coalesce("rebalance", F.lit(False)).alias("rebalance"))


def ledger(spark, d):
    c = configs(spark, d)
    return backtest.Backtest(c, backtest.top_picks(income.point_in_time(spark, d), c), bars(spark, d), days(spark, d), HEDGER)


def passive(spark, d):
    """Every fund, and the market as reference, held alone under both rules for cash."""
    settings = configs(spark, d).where(F.col("top_n") == SIZES[0]).withColumn("config_id", F.element_at(F.split("config_id", "-"), 2))
    held = securities(spark, d).where("quote_type = 'EQUITY' or ticker = 'MKT'").select("ticker")
    c = held.crossJoin(F.broadcast(settings)).withColumn("config_id", F.concat_ws("/", "config_id", "ticker"))  # two rows of settings
    return backtest.passive(c, bars(spark, d), days(spark, d), HEDGER)


def summary(spark, d):
    calendar, c = cut(days(spark, d), "days"), configs(spark, d)
    alone = backtest.passive(c.withColumn("ticker", F.lit(BENCHMARK)), bars(spark, d), calendar, HEDGER)
    book = backtest.Backtest(c, backtest.top_picks(income.point_in_time(spark, d), c), bars(spark, d), calendar, HEDGER)
    market = bars(spark, d).where("ticker = 'MKT'").select("date", "close", "dividend")
    return backtest.backtest_summary(book, alone, calendar, market)


QUERIES = {
    "backtest": lambda s, d: ledger(s, d).days(),
    "backtest_quarters": lambda s, d: ledger(s, d).quarters(),
    "backtest_stops": lambda s, d: ledger(s, d).stops(),
    "passive_ledger": lambda s, d: passive(s, d).days().select("config_id", "date", "value", "income_cum", "withdrawn_cum"),
    "backtest_summary": summary,
}

_CFG = ", ".join(f"('{k}', CAST({h} AS DOUBLE), CAST({level} AS DOUBLE), CAST({stop} AS DOUBLE))" for k, (h, level, stop) in GRID.items())
_DAYS = f"""bills AS (SELECT date, close / 1000 - 1 AS value FROM bars WHERE ticker = 'R1' AND dayofmonth(date) = 15), mkt AS (SELECT date, close, dividend FROM bars WHERE ticker = 'MKT'),
r0 AS (SELECT date, close FROM bars WHERE ticker = '{HEDGER}'),
sg AS (SELECT date, coalesce(last_value(CASE WHEN ratio >= 1.0 THEN 1 WHEN ratio <= 0.95 THEN 0 END IGNORE NULLS) OVER (ORDER BY date), 0) = 1 AS signal
  FROM (SELECT m.date, m.close / last_value(r0.close IGNORE NULLS) OVER (ORDER BY m.date) AS ratio FROM mkt m LEFT JOIN r0 USING (date)) WHERE ratio IS NOT NULL),
dy AS MATERIALIZED (SELECT row_number() OVER (ORDER BY m.date) AS i, m.date, coalesce(greatest(b.value, 0.0) / 100 / 252, 0.0) AS rate, coalesce(signal, false) AS signal, m.date IN (SELECT date FROM rd) AS rebalance, v.close AS vp
  FROM mkt m ASOF LEFT JOIN bills b ON m.date >= b.date LEFT JOIN sg ON sg.date = m.date ASOF LEFT JOIN r0 v ON m.date >= v.date WHERE m.date >= DATE '{START}'),
cfg AS (SELECT 'top' || n || '-' || k AS config_id, n AS top_n, CAST(100000 AS DOUBLE) AS capital, h, lvl, stop FROM (VALUES {", ".join(f"({n})" for n in SIZES)}) a(n), (VALUES {_CFG}) b(k, h, lvl, stop))"""

_TOTAL = "coalesce(list_sum([{0} for x in {1}]), 0.0)"


def _walk() -> str:
    """One day of every configuration, stage by stage."""
    gone = "stop > 0 AND (p[x.t] + x.g) / x.e - 1 < -stop"
    lot = lambda n, g: f"{{'t': x.t, 'n': {n}, 'e': x.e, 'g': {g}}}"
    stages = [
        "* REPLACE (cash + acc AS cash, intr + acc AS intr)",
        f"*, CASE WHEN rebalance THEN cash + {_TOTAL.format('x.n * p[x.t]', 'sh')} + CASE WHEN hs > 0 THEN hs * vp ELSE 0.0 END END AS liq",
        "* REPLACE (CASE WHEN rebalance AND lvl > 0 AND liq > lvl THEN liq - lvl ELSE 0.0 END AS drawn)",
        "*, liq - drawn AS kept",
        "* REPLACE (CASE WHEN rebalance AND h > 0 AND signal AND kept > 0 AND vp IS NOT NULL THEN kept * h ELSE 0.0 END AS hb)",
        """* REPLACE (CASE WHEN rebalance THEN CASE WHEN len(picks) > 0 THEN 0.0 ELSE kept - hb END ELSE cash END AS cash, CASE WHEN rebalance AND hs > 0 THEN pnl + hs * vp - basis ELSE pnl END AS pnl,
  CASE WHEN rebalance THEN [{'t': x, 'n': (kept - hb) / len(picks) / p[x], 'e': p[x], 'g': 0.0::DOUBLE} for x in picks] ELSE sh END AS sh, CASE WHEN rebalance THEN CASE WHEN hb > 0 THEN hb / vp ELSE 0.0 END ELSE hs END AS hs,
  CASE WHEN rebalance THEN hb ELSE basis END AS basis, wd + drawn AS wd, inc AS inc0)""",
        "*, h > 0 AND signal AND hs = 0 AND len(sh) > 0 AND vp IS NOT NULL AS turn_on, h > 0 AND NOT signal AND hs > 0 AND vp IS NOT NULL AS turn_off",
        f"*, CASE WHEN turn_on THEN cash * h + {_TOTAL.format('x.n * h * p[x.t]', 'sh')} ELSE 0.0 END AS raised",
        f"""* REPLACE (CASE WHEN turn_on THEN cash - cash * h WHEN turn_off THEN cash + hs * vp ELSE cash END AS cash, CASE WHEN turn_off THEN pnl + hs * vp - basis ELSE pnl END AS pnl, CASE WHEN turn_on THEN [{lot('x.n - x.n * h', 'x.g')} for x in sh] ELSE sh END AS sh,
  CASE WHEN turn_on THEN raised / vp WHEN turn_off THEN 0.0 ELSE hs END AS hs, CASE WHEN turn_on THEN raised WHEN turn_off THEN 0.0 ELSE basis END AS basis)""",
        f"*, {_TOTAL.format('x.n * q[x.t]', 'sh')} AS pay",
        f"* REPLACE (cash + pay AS cash, inc + pay AS inc, [{lot('x.n', 'x.g + q[x.t]')} for x in sh] AS sh)",
        f"* REPLACE ([x for x in sh if {gone}] AS hit)",
        f"* REPLACE (cash + {_TOTAL.format('x.n * p[x.t]', 'hit')} AS cash, [x for x in sh if NOT ({gone})] AS sh, stops + len(hit) AS stops, hdays + (hs > 0)::INT AS hdays)",
        f"* REPLACE ({_TOTAL.format('x.n * p[x.t]', 'sh')} AS pos, CASE WHEN hs > 0 THEN hs * vp ELSE 0.0 END AS hv)",
    ]
    out = """SELECT led.* EXCLUDE (i, date, rebalance, picks), d.i, d.date, d.rebalance, d.rate, d.signal, d.vp, d.p, d.q, coalesce(pk.t, []) AS picks, led.cash * d.rate AS acc
    FROM led JOIN dd d ON d.i = led.i + 1 LEFT JOIN pk ON pk.config_id = led.config_id AND pk.date = d.date"""
    for stage in stages:
        out = f"SELECT {stage} FROM ({out})"
    return out


_LOTS = "[]::STRUCT(t VARCHAR, n DOUBLE, e DOUBLE, g DOUBLE)[]"
_COLUMNS = "config_id, capital, h, lvl, stop, cash, hs, basis, pnl, sh, hit, inc, inc0, wd, drawn, hb, intr, stops, hdays, pos, hv, i, date, rebalance, picks"
_LEDGER = f"""RECURSIVE {POINT_IN_TIME.format(keep='true')}, {_DAYS},
pk AS MATERIALIZED (SELECT config_id, rebalance AS date, list(ticker ORDER BY place) AS t FROM (SELECT *, row_number() OVER (PARTITION BY rebalance ORDER BY rank) AS place FROM ps WHERE qualified = 1) JOIN cfg ON place <= top_n GROUP BY ALL),
tk AS (SELECT DISTINCT ticker FROM ps WHERE qualified = 1),
pv AS (SELECT x.i, x.ticker, b.close AS price, CASE WHEN b.date = x.date THEN b.dividend ELSE 0.0 END AS paid FROM (SELECT dy.i, dy.date, tk.ticker FROM dy CROSS JOIN tk) x ASOF JOIN bars b ON x.ticker = b.ticker AND x.date >= b.date),
dd AS MATERIALIZED (SELECT dy.*, p, q FROM dy JOIN (SELECT i, map_from_entries(list((ticker, price))) AS p, map_from_entries(list((ticker, paid))) AS q FROM pv GROUP BY i) USING (i)),
led AS (SELECT config_id, capital, h, lvl, stop, capital AS cash, 0.0::DOUBLE AS hs, 0.0::DOUBLE AS basis, 0.0::DOUBLE AS pnl, {_LOTS} AS sh, {_LOTS} AS hit, 0.0::DOUBLE AS inc, 0.0::DOUBLE AS inc0, 0.0::DOUBLE AS wd, 0.0::DOUBLE AS drawn, 0.0::DOUBLE AS hb,
  0.0::DOUBLE AS intr, 0::BIGINT AS stops, 0::BIGINT AS hdays, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS hv, 0::BIGINT AS i, NULL::DATE AS date, false AS rebalance, []::VARCHAR[] AS picks FROM cfg
  UNION ALL SELECT {_COLUMNS} FROM ({_walk()}))"""

_PASSIVE = f"""sv AS (SELECT {{ids}} AS config_id, lvl, b.ticker, dy.i, dy.date, rate, rebalance, x.close AS price, CASE WHEN x.date = dy.date THEN x.dividend ELSE 0.0 END AS paid
  FROM (SELECT DISTINCT split_part(config_id, '-', 2) AS k, lvl FROM cfg) c, ({{tickers}}) b, dy ASOF LEFT JOIN bars x ON x.ticker = b.ticker AND dy.date >= x.date),
svm AS MATERIALIZED (SELECT * FROM sv),
pas AS (SELECT config_id, lvl, 0::BIGINT AS i, NULL::DATE AS date, CAST(100000 AS DOUBLE) AS cash, 0.0::DOUBLE AS n, 0.0::DOUBLE AS wd, 0.0::DOUBLE AS inc, 0.0::DOUBLE AS value FROM (SELECT DISTINCT config_id, lvl FROM svm)
  UNION ALL SELECT config_id, lvl, i, date, cash, n, wd, inc, coalesce(n * price, 0.0) + cash AS value FROM (
    SELECT * REPLACE (cash + n * paid AS cash, inc + n * paid AS inc) FROM (
      SELECT * REPLACE (CASE WHEN buys THEN (total - over) / price ELSE n END AS n, CASE WHEN buys THEN 0.0 ELSE cash END AS cash, wd + over AS wd) FROM (
        SELECT *, CASE WHEN buys AND lvl > 0 AND total > lvl THEN total - lvl ELSE 0.0 END AS over FROM (
          SELECT *, rebalance AND price IS NOT NULL AS buys, coalesce(n * price, 0.0) + cash AS total FROM (
            SELECT pas.config_id, pas.lvl, s.i, s.date, pas.cash + pas.cash * s.rate AS cash, pas.n, pas.wd, pas.inc, s.rebalance, s.price, s.paid FROM pas JOIN svm s ON s.config_id = pas.config_id AND s.i = pas.i + 1))))))"""
_ALL_FUNDS = _PASSIVE.format(ids="k || '/' || b.ticker", tickers="SELECT DISTINCT 'I' || (s_suppkey // 5) AS ticker FROM supplier UNION SELECT 'MKT'")
_BENCH = _PASSIVE.format(ids="k", tickers=f"SELECT '{BENCHMARK}' AS ticker")

SQL = {
    "backtest": f"""WITH {_LEDGER} SELECT config_id, date, round(pos + cash + hv, 2) AS value, round(pos, 2) AS positions, round(cash, 2) AS cash, round(hv, 2) AS hedge, round(inc, 2) AS income_cum, round(wd, 2) AS withdrawn_cum, round(intr, 2) AS interest_cum,
  (hs > 0)::INT AS hedged, len(sh)::INT AS n_held, stops::INT AS stops FROM led WHERE i > 0""",
    "backtest_quarters": f"""WITH {_LEDGER}, fin AS (SELECT config_id, max(inc) AS inc FROM led GROUP BY 1) SELECT config_id, date, CASE WHEN len(picks) > 0 THEN array_to_string(picks, ', ') ELSE 'CASH' END AS holdings, len(picks)::INT AS n_picks,
  round(coalesce(lead(inc0) OVER (PARTITION BY config_id ORDER BY i), fin.inc) - inc0, 2) AS income, round(drawn, 2) AS withdrawn, (hb > 0)::INT AS hedged FROM led JOIN fin USING (config_id) WHERE rebalance""",
    "backtest_stops": f"""WITH {_LEDGER} SELECT config_id, date, x.t AS ticker, round(((SELECT price FROM pv WHERE pv.i = y.i AND pv.ticker = x.t) + x.g) / x.e * 100 - 100, 1) AS total_return FROM (SELECT config_id, i, date, unnest(hit) AS x FROM led) y""",
    "passive_ledger": f"""WITH RECURSIVE {POINT_IN_TIME.format(keep='true')}, {_DAYS}, {_ALL_FUNDS} SELECT config_id, date, round(value, 2) AS value, round(inc, 2) AS income_cum, round(wd, 2) AS withdrawn_cum FROM pas WHERE i > 0""",
    "backtest_summary": f"""WITH {_LEDGER}, {_BENCH}, mk0 AS (SELECT dy.i, dy.rate, close, dividend, first(close) OVER (ORDER BY dy.i) AS c0 FROM dy JOIN mkt USING (date)),
mw AS (SELECT 0::BIGINT AS i, 0.0::DOUBLE AS cash, 0.0::DOUBLE AS value UNION ALL SELECT m.i, mw.cash * (1 + m.rate) + m.dividend * 100000 / c0, 100000 / c0 * m.close + mw.cash * (1 + m.rate) + m.dividend * 100000 / c0 FROM mw JOIN mk0 m ON m.i = mw.i + 1),
mv AS (SELECT round(arg_max(value, i), 2) / 100000 AS g FROM mw), bv AS (SELECT lvl, (round(arg_max(value, i), 2) + max(wd)) / 100000 AS g, max(inc) AS inc FROM pas GROUP BY 1),
eq AS (SELECT *, round(pos + cash + hv, 2) AS v, round(pos + cash + hv, 2) + round(wd, 2) AS t FROM led WHERE i > 0), ew AS (SELECT *, max(t) OVER (PARTITION BY config_id ORDER BY i) AS top FROM eq),
s AS (SELECT config_id, any_value(lvl) AS lvl, arg_max(v, i) AS final, arg_max(t, i) / any_value(capital) AS g, min((t - top) / top) AS dd, greatest(datediff('day', min(date), max(date)) / 365.25, 0.1) AS years, count(*) AS n, arg_max(inc, i) AS inc, arg_max(wd, i) AS wd,
  arg_max(intr, i) AS intr, arg_max(stops, i) AS stops, arg_max(hdays, i) AS hd, arg_max(pnl + CASE WHEN hs > 0 THEN hv - basis ELSE 0.0 END, i) AS pnl, count(*) FILTER (rebalance) AS nq FROM ew GROUP BY 1)
SELECT config_id, round(final, 2) AS final_value, round((s.g - 1) * 100, 2) AS total_return, round((pow(s.g, 1 / years) - 1) * 100, 2) AS cagr, round(dd * 100, 2) AS max_drawdown, round(s.inc, 2) AS income_total, round(s.inc / greatest(nq, 1), 2) AS income_avg_quarter,
  round((mv.g - 1) * 100, 2) AS market_return, round((s.g - 1) * 100 - (mv.g - 1) * 100, 2) AS excess_return, round((bv.g - 1) * 100, 2) AS bench_return, round(bv.inc, 2) AS bench_income, round((s.g - 1) * 100 - (bv.g - 1) * 100, 2) AS excess_bench, nq AS n_quarters, stops,
  hd AS hedge_days, round(hd / n * 100, 1) AS hedge_days_pct, round(pnl, 2) AS hedge_pnl, round(intr, 2) AS interest_total, round(wd, 2) AS withdrawn_total, round(wd / greatest(nq, 1), 2) AS withdrawn_avg_quarter FROM s JOIN bv USING (lvl), mv""",
}
