"""DuckDB statements of the logical tables, shared by the queries' equivalents."""

RUN, PREV = "DATE '2001-06-30'", "DATE '2001-05-31'"

LI = """li AS MATERIALIZED (SELECT l_suppkey // 5 AS i, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity AS quantity,
  CASE WHEN l_returnflag = 'R' AND l_orderkey % 20 = 0 THEN CAST(round(l_tax * 100) AS BIGINT) END AS cents, l_orderkey, l_linenumber, l_extendedprice FROM lineitem)"""


def _bars(name: str, tickers: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT ticker, date, first(price ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS close, last(price ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS adj_close, sum(quantity) AS volume,
  coalesce(sum(cents) / 100.0, 0.0) AS dividend, CAST(0 AS DOUBLE) AS split FROM (SELECT unnest([{tickers}]) AS ticker, * FROM li) GROUP BY ticker, date)"""


BARS = f"{LI}, {_bars('bars', chr(39) + 'I' + chr(39) + ' || i')}"
ALL_BARS = f"{LI}, {_bars('bars', chr(39) + 'I' + chr(39) + ' || i, ' + chr(39) + 'MKT' + chr(39) + ', ' + chr(39) + 'R' + chr(39) + ' || (i % 5)')}"

SECURITIES = """sec0 AS (SELECT s_suppkey // 5 AS i, min(s_name) AS name, sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS cents FROM supplier GROUP BY 1),
securities AS MATERIALIZED (SELECT 'I' || i AS ticker, name, CASE WHEN i % 2 = 0 THEN 'US' ELSE 'AU' END AS region, CASE WHEN i % 2 = 0 THEN 'NYQ' ELSE 'ASX' END AS exchange, 'EQUITY' AS quote_type,
  'S' || (i % 5) AS sector, 'N' || (i % 25) AS industry, greatest(cents / 100.0 - 15000, 0.0) * 1e6 AS market_cap, CASE WHEN i % 13 = 12 THEN 0 ELSE 1 END AS active, 'MKT' AS benchmark FROM sec0
  UNION ALL SELECT t, t, 'US', 'NYQ', 'INDEX', NULL, NULL, NULL, 1, 'MKT' FROM (VALUES ('MKT'), ('R0'), ('R1'), ('R2'), ('R3'), ('R4')) x(t))"""

GROUPS = """grp0 AS (SELECT DISTINCT s_suppkey // 5 AS i FROM supplier),
groups AS MATERIALIZED (SELECT 'I' || i AS ticker, 'index' AS group_type, 'BIG' AS group_key, CAST(NULL AS VARCHAR) AS attr, 9 AS priority FROM grp0 WHERE i % 3 = 0
  UNION ALL SELECT 'I' || i, 'index', 'TECH', NULL, 9 FROM grp0 WHERE i % 4 = 0 UNION ALL SELECT 'I' || i, 'commodity', 'gold', 'producer', 9 FROM grp0 WHERE i % 2 = 0
  UNION ALL SELECT 'I' || i, 'commodity', 'silver', 'explorer', 0 FROM grp0 WHERE i % 6 = 0
  UNION ALL SELECT DISTINCT 'R' || (i % 5), 'theme', 'rot', NULL, 9 FROM grp0
  UNION ALL SELECT DISTINCT 'R' || (i % 5), 'theme', CASE WHEN i % 5 < 2 THEN 'rot:cyclical' ELSE 'rot:defensive' END, NULL, 9 FROM grp0 WHERE i % 5 < 4)"""

HOLDINGS = """holdings AS MATERIALIZED (SELECT o_custkey % 10 AS portfolio, 'I' || (o_orderkey % (SELECT count(DISTINCT s_suppkey // 5) FROM supplier)) AS ticker, CAST(o_orderdate AS DATE) AS entry_date,
  o_totalprice / 100 AS entry_price, 'USD' AS quote_currency, o_orderkey AS holding_id FROM orders)"""

INDICATORS = """indicators AS MATERIALIZED (SELECT o_orderpriority AS key, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2)"""


def rnd(x: str, digits: int) -> str:
    return f"CASE WHEN isfinite({x}) THEN round({x}, {digits}) END"


def history(name: str, end: str, days: int, source: str = "bars") -> str:
    """Bars with a price in the window: p, volume, i from 0, back from 1 at the last bar, n."""
    return f"""{name} AS MATERIALIZED (SELECT *, n - i AS back FROM (
  SELECT ticker, date, adj_close AS p, volume, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n, first(adj_close) OVER w AS p0
  FROM {source} WHERE date BETWEEN {end} - INTERVAL {days} DAY AND {end} AND adj_close IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE n >= 2 AND p0 <> 0)"""


def block(end: str = RUN, s: str = "") -> str:
    """The metric block as the table m{s}; RSI by its recursion, pivots by comparing each bar with its neighbours."""
    return f"""{history("h" + s, end, 365)}, {history("g" + s, end, 730)},
st{s} AS (SELECT *, max(p) OVER w AS top, p / lag(p) OVER w - 1 AS r, p - lag(p) OVER w AS d FROM h{s} WINDOW w AS (PARTITION BY ticker ORDER BY date)),
a{s} AS (SELECT ticker, max(n) AS n_bars, max(p) FILTER (back = 1) AS last, arg_min(p, i) AS first, max(p) FILTER (back = 126) AS b126, max(p) FILTER (back = 5) AS b5,
  max(p) FILTER (back = 21) AS b21, max(p) FILTER (back = 63) AS b63, round(min((p - top) / top) * 100, 2) AS max_dd, round(count(*) FILTER (r > 0) / count(r) * 100, 2) AS persist_frac,
  {rnd("stddev_samp(r) FILTER (n < 63 OR back <= 63) * sqrt(252.0) * 100", 2)} AS vol_63, CASE WHEN max(n) >= 20 THEN round(avg(p) FILTER (back <= 20), 4) END AS sma20,
  CASE WHEN max(n) >= 50 THEN round(avg(p) FILTER (back <= 50), 4) END AS sma50, CASE WHEN max(n) >= 200 THEN round(avg(p) FILTER (back <= 200), 4) END AS sma200 FROM st{s} GROUP BY ticker),
v{s} AS (SELECT ticker, round(max(volume) FILTER (vb = 1) / avg(volume) FILTER (vb <= 63), 4) AS rel_vol
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS vb FROM h{s} WHERE volume IS NOT NULL) GROUP BY ticker),
up{s} AS (SELECT ticker, i, p, list(greatest(d, 0)) OVER w AS us, list(greatest(-d, 0)) OVER w AS ds FROM st{s} WHERE i >= 1 WINDOW w AS (PARTITION BY ticker ORDER BY i)),
rs{s} AS MATERIALIZED (SELECT ticker, i, p, CASE WHEN i >= 14 THEN CASE WHEN dn = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + u / dn) END END AS rsi FROM (
  SELECT ticker, i, p, list_reduce(us, lambda y, x: y * (13 / 14) + x * (1 / 14)) AS u, list_reduce(ds, lambda y, x: y * (13 / 14) + x * (1 / 14)) AS dn FROM up{s})),
pv{s} AS (SELECT *, c = 11 AND rsi > lmax AND rsi >= rmax AS hi, c = 11 AND rsi < lmin AND rsi <= rmin AS lo FROM (
  SELECT *, count(rsi) OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS c, max(rsi) OVER l AS lmax, min(rsi) OVER l AS lmin, max(rsi) OVER r AS rmax, min(rsi) OVER r AS rmin
  FROM rs{s} WINDOW l AS (PARTITION BY ticker ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY ticker ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))),
pr{s} AS (SELECT ticker, 'high' AS kind, i, p, rsi, row_number() OVER (PARTITION BY ticker ORDER BY i DESC) AS k FROM pv{s} WHERE hi
  UNION ALL SELECT ticker, 'low', i, p, rsi, row_number() OVER (PARTITION BY ticker ORDER BY i DESC) FROM pv{s} WHERE lo),
dv{s} AS (SELECT x.ticker, x.i, x.kind, CASE WHEN x.kind = 'high' AND x.p > y.p AND x.rsi < y.rsi THEN 'BEAR' WHEN x.kind = 'high' AND x.p < y.p AND x.rsi > y.rsi THEN 'HID_BEAR'
    WHEN x.kind = 'low' AND x.p < y.p AND x.rsi > y.rsi THEN 'BULL' WHEN x.kind = 'low' AND x.p > y.p AND x.rsi < y.rsi THEN 'HID_BULL' END AS label
  FROM pr{s} x JOIN pr{s} y ON x.ticker = y.ticker AND x.kind = y.kind AND x.k = 1 AND y.k = 2 JOIN a{s} ON a{s}.ticker = x.ticker
  WHERE a{s}.n_bars >= 17 AND a{s}.n_bars - 1 - (x.i + 5) <= 20 AND x.i - y.i BETWEEN 5 AND 60 AND NOT EXISTS (
    SELECT 1 FROM h{s} z WHERE z.ticker = x.ticker AND z.i > x.i AND ((x.kind = 'high' AND z.p > x.p) OR (x.kind = 'low' AND z.p < x.p)))),
dl{s} AS (SELECT ticker, first(label ORDER BY i DESC, kind) AS rsi_div FROM dv{s} WHERE label IS NOT NULL GROUP BY ticker),
ob{s} AS MATERIALIZED (SELECT ticker, date, p, volume, row_number() OVER w AS j, count(*) OVER (PARTITION BY ticker) AS m, sum(sg * volume) OVER w AS obv
  FROM (SELECT *, coalesce(sign(p - lag(p) OVER (PARTITION BY ticker ORDER BY date)), 0) AS sg FROM h{s} WHERE volume IS NOT NULL) WINDOW w AS (PARTITION BY ticker ORDER BY date)),
oe{s} AS (SELECT ticker, max(m) AS m, avg(p) AS mean, regr_slope(p, j) * 20 / avg(p) * 100 AS pm, CASE WHEN avg(volume) > 0 THEN regr_slope(obv, j) * 20 / avg(volume) ELSE 0 END AS om FROM ob{s} WHERE j > m - 21 GROUP BY ticker),
od{s} AS (SELECT ticker, CASE WHEN m < 22 OR mean <= 0 THEN '-' ELSE coalesce(map {{'1,1': 'CONV_UP', '-1,-1': 'CONV_DOWN', '1,-1': 'BEAR_DIV', '-1,1': 'BULL_DIV', '0,1': 'ACCUM', '0,-1': 'DISTRIB'}}[
  (CASE WHEN abs(pm) < 2 THEN 0 WHEN pm > 0 THEN 1 ELSE -1 END) || ',' || (CASE WHEN abs(om) < 3 THEN 0 WHEN om > 0 THEN 1 ELSE -1 END)], '-') END AS obv_div FROM oe{s}),
r24{s} AS (SELECT ticker, arg_max(p, i) / arg_min(p, i) - 1 AS ret_24m FROM g{s} GROUP BY ticker),
rl{s} AS (SELECT ticker, {rnd("arg_max(rsi, i)", 2)} AS rsi_14 FROM rs{s} GROUP BY ticker),
m{s} AS MATERIALIZED (SELECT a{s}.ticker, n_bars, round(last, 4) AS close, last / first - 1 AS ret_12m, last / b126 - 1 AS ret_6m, last / b5 - 1 AS ret_5, last / b21 - 1 AS ret_21, last / b63 - 1 AS ret_63,
  ret_24m, max_dd, persist_frac, vol_63, sma20, sma50, sma200, CASE WHEN last > sma200 THEN 1 ELSE 0 END AS pass_trend,
  CASE WHEN vol_63 > 0 AND persist_frac IS NOT NULL THEN {rnd("(last / first - 1) * 100 * persist_frac / vol_63", 4)} END AS mqs, rel_vol,
  CASE WHEN rel_vol >= 1.5 THEN 'HIGH' WHEN rel_vol >= 1.0 THEN 'MED' ELSE 'LOW' END AS vol_label, rsi_14, coalesce(rsi_div, '-') AS rsi_div, coalesce(obv_div, '-') AS obv_div
  FROM a{s} LEFT JOIN r24{s} USING (ticker) LEFT JOIN v{s} USING (ticker) LEFT JOIN rl{s} USING (ticker) LEFT JOIN dl{s} USING (ticker) LEFT JOIN od{s} USING (ticker))"""


METRICS = f"{ALL_BARS}, {block()}"
CAP = """CASE WHEN market_cap > 10000000000 THEN 'large' WHEN market_cap >= 2000000000 THEN 'mid' ELSE 'small' END"""
