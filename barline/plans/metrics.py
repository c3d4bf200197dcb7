"""Queries of the per-ticker metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, universe
from ..sources.tables import RUN_DATE, bars, securities
from .sql import ALL_BARS, CAP, METRICS, RUN, SECURITIES, history

_COLUMNS = {
    "returns_block": ["ticker", "n_bars", "ret_12m", "ret_6m", "ret_5", "ret_21", "ret_63"],
    "ret_24m": ["ticker", "ret_24m"],
    "max_drawdown": ["ticker", "max_dd"],
    "persistence": ["ticker", "persist_frac"],
    "volatility_63": ["ticker", "vol_63"],
    "moving_averages": ["ticker", "close", "sma20", "sma50", "sma200", "pass_trend"],
    "mqs": ["ticker", "mqs"],
    "relative_volume": ["ticker", "rel_vol", "vol_label"],
    "rsi_wilder": ["ticker", "rsi_14"],
    "rsi_divergence": ["ticker", "rsi_div"],
    "obv_divergence": ["ticker", "obv_div"],
}


SINCE = "1999-07-01"  # two years before the run


def _query(name):
    return lambda spark, sf_dir: getattr(metrics, name)(bars(spark, sf_dir, start=SINCE, end=RUN_DATE), RUN_DATE).select(*_COLUMNS[name])


def _acc_watch(spark, sf_dir):
    caps = securities(spark, sf_dir).select("ticker", universe.cap_band("market_cap").alias("cap_band"))
    return metrics.acc_watch(bars(spark, sf_dir), caps, RUN_DATE)


QUERIES = {name: _query(name) for name in _COLUMNS} | {
    "acc_watch": _acc_watch,
    "obv": lambda spark, sf_dir: metrics.obv(bars(spark, sf_dir), RUN_DATE),
    "metric_block": lambda spark, sf_dir: metrics.metric_block(bars(spark, sf_dir, start=SINCE, end=RUN_DATE), RUN_DATE),
    "rsi_history": lambda spark, sf_dir: metrics.rsi_history(bars(spark, sf_dir), RUN_DATE).select("ticker", "date", F.round("rsi", 6).alias("rsi")),
}

SQL = {name: f"WITH {METRICS} SELECT {', '.join(columns)} FROM m" for name, columns in _COLUMNS.items()} | {
    "acc_watch": f"""WITH {METRICS}, {SECURITIES}, c AS (SELECT m.*, {CAP} AS cap FROM m JOIN securities USING (ticker))
SELECT ticker, CASE WHEN cap = 'small' OR sma20 IS NULL OR sma50 IS NULL OR sma200 IS NULL THEN '-' WHEN close < sma20 AND close < sma50 AND close < sma200 THEN 'EARLY'
  WHEN close < sma50 AND close < sma200 AND close >= sma20 THEN 'PROGRESS' WHEN close < sma200 AND close >= sma50 AND close >= sma20 THEN 'SHIFT' ELSE '-' END AS acc_watch FROM c""",
    "obv": f"""WITH {ALL_BARS}, {history("h", RUN, 365)}
SELECT ticker, date, sum(sg * volume) OVER (PARTITION BY ticker ORDER BY date) AS obv FROM (
  SELECT *, coalesce(sign(p - lag(p) OVER (PARTITION BY ticker ORDER BY date)), 0) AS sg FROM h WHERE volume IS NOT NULL)""",
    "rsi_history": f"""WITH RECURSIVE {ALL_BARS}, b AS MATERIALIZED (SELECT ticker, date, adj_close - lag(adj_close) OVER w AS d, row_number() OVER w - 1 AS i FROM bars WHERE date <= {RUN} WINDOW w AS (PARTITION BY ticker ORDER BY date)),
y AS (SELECT ticker, i, date, greatest(d, 0) AS u, greatest(-d, 0) AS n FROM b WHERE i = 1
  UNION ALL SELECT b.ticker, b.i, b.date, y.u * 13 / 14 + greatest(b.d, 0) / 14, y.n * 13 / 14 + greatest(-b.d, 0) / 14 FROM y JOIN b ON b.ticker = y.ticker AND b.i = y.i + 1)
SELECT ticker, date, round(CASE WHEN n = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + u / n) END, 6) AS rsi FROM y WHERE i >= 14""",
    "metric_block": f"WITH {METRICS} SELECT ticker, n_bars, close, ret_12m, ret_6m, ret_5, ret_21, ret_63, max_dd, persist_frac, vol_63, sma20, sma50, sma200, pass_trend, mqs, ret_24m, rel_vol, vol_label, rsi_14, rsi_div, obv_div FROM m",
}
