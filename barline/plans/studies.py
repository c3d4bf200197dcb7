"""Queries of breadth, rotation, DeMark and drawdown studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import breadth, drawdown, rotation, universe
from ..sources.stored import StoredTable, shared_folder
from ..sources.tables import RUN_DATE, bars, groups, securities
from .sql import ALL_BARS, CAP, GROUPS, RUN, SECURITIES

NAME = "total_market"
PERIODS = [("p1998", "1998-01-01"), ("p2000", "2000-01-01"), ("p2001", "2001-01-01")]


def all_members(spark, d):
    spec = {"filter": {"quote_type": "EQUITY"}, "benchmark": "MKT"}
    return universe.members(spec, securities(spark, d), groups(spark, d), include_inactive=True)


def panel(spark, d):
    return breadth.breadth_panel(bars(spark, d, references=False), all_members(spark, d))


def counts(spark, d):
    return breadth.breadth_counts(panel(spark, d), NAME)


def layer_sets(spark, d):
    return breadth.breadth_layer_sets(all_members(spark, d), groups(spark, d), ["BIG", "TECH"])


WIDE = ["total", "leader", "large_total", "mid_leaders", "sec_s0_total", "sec_s1_above200", "ind_n3_leaders", "comm_gold_above20", "comm_gold_producer_total", "comm_silver_small_total", "type_explorer_total"]


def series(spark, d):
    return bars(spark, d).select("ticker", "date", F.col("adj_close").alias("c"))


def themes(spark, d):
    return universe.theme_groups(groups(spark, d), securities(spark, d), "rot")


def scan(spark, d, end=RUN_DATE):
    members = universe.members({"filter": {"quote_type": "EQUITY"}, "benchmark": "MKT"}, securities(spark, d), groups(spark, d))
    return rotation.demark_scan(bars(spark, d, references=False), members, end)


def stored_days(spark, d):
    """Days of the members' bars up to twenty days before the run."""
    return bars(spark, d, references=False).where(F.col("date") <= F.date_sub(F.to_date(F.lit(RUN_DATE)), 20)).select("date")


SIGNAL_DATE = "2001-07-01"  # a run with completed signals


def dated_scans(spark, d, newest=RUN_DATE):
    """Scans of two run dates, as they would be stored."""
    first, last = (scan(spark, d, day).withColumn("run_date", F.to_date(F.lit(day))) for day in ("2001-05-31", newest))
    return last.unionByName(first)


def study(spark, d):
    members = universe.members({"filter": {"quote_type": "EQUITY"}, "benchmark": "MKT"}, securities(spark, d), groups(spark, d))
    periods = spark.createDataFrame(PERIODS, "period_label string, period_start string").withColumn("period_start", F.to_date("period_start"))
    return drawdown.multi_period_study(bars(spark, d), members, periods, "MKT")


def thinned(long):
    """A batch in which the totals of some days fall short."""
    poor = (F.dayofyear("date") % 97 == 0) & (F.col("metric") == "total") & (F.col("group_type") == "all")
    return long.withColumn("value", F.when(poor, F.floor(F.col("value") / 2).cast("double")).otherwise(F.col("value")))


def guarded(spark, d):
    """Stored counts after a write of days at doubled values, of which some were thinned and are not written."""
    key = ["universe", "date", "layer", "group_type", "group_key", "metric"]
    rows = counts(spark, d).where("group_type = 'all'")
    table = StoredTable(spark, shared_folder(spark, "breadth"), key, "year", F.year("date")).create(rows)
    return breadth.store_breadth(table, thinned(table.read().where(F.month("date") % 2 == 0)).where("metric <> 'laggard'")).read()


QUERIES = {
    "breadth_panel": panel,
    "breadth_counts": counts,
    "breadth_layer_sets": layer_sets,
    "breadth_layers": lambda spark, d: breadth.breadth_layers(panel(spark, d), NAME, layer_sets(spark, d)),
    "breadth_guard": guarded,
    "breadth_incremental": lambda spark, d: breadth.breadth_incremental(bars(spark, d, references=False), all_members(spark, d), NAME, stored_days(spark, d), RUN_DATE).where("group_type = 'all'"),
    "breadth_rebuild": lambda spark, d: breadth.breadth_rebuild(bars(spark, d, references=False), all_members(spark, d), NAME).where("group_type = 'sector'"),
    "read_breadth": lambda spark, d: breadth.read_breadth(counts(spark, d), NAME, group_type="sector", group_key="s0", start="2001-01-01", end=RUN_DATE, offset=7, limit=60),
    "read_rrg": lambda spark, d: rotation.read_rrg(rotation.rrg(bars(spark, d), themes(spark, d), "MKT", RUN_DATE), start="2001-05-01", offset=3, limit=40),
    "read_signals_all": lambda spark, d: rotation.read_signals(dated_scans(spark, d), run_date=None, completed=False),
    "breadth_wide": lambda spark, d: breadth.breadth_wide(counts(spark, d), WIDE),
    "breadth_long": lambda spark, d: breadth.breadth_long(breadth.breadth_wide(counts(spark, d), WIDE)),
    "breadth_summary": lambda spark, d: breadth.breadth_today(bars(spark, d, references=False), all_members(spark, d), NAME),
    "rrg": lambda spark, d: rotation.rrg(bars(spark, d), themes(spark, d), "MKT", RUN_DATE),
    "td_setup": lambda spark, d: rotation.td_setup(series(spark, d)),
    "td_countdown": lambda spark, d: rotation.td_countdown(series(spark, d)),
    "weekly_close": lambda spark, d: rotation.weekly_close(series(spark, d)),
    "demark_scan": scan,
    "demark_report_lists": lambda spark, d: rotation.demark_report_lists(scan(spark, d)),
    "read_signals": lambda spark, d: rotation.read_signals(dated_scans(spark, d, SIGNAL_DATE)).drop("run_date"),
    "multi_period_study": study,
    "period_performance": lambda spark, d: drawdown.period_performance(
        bars(spark, d), universe.members({"filter": {"quote_type": "EQUITY"}, "benchmark": "MKT"}, securities(spark, d), groups(spark, d)).withColumn("commodity", F.lit(None).cast("string")), "2000-01-01", "p2000", "MKT"
    ),
    "cross_period_ranks": lambda spark, d: drawdown.cross_period_ranks(study(spark, d), [p for p, _ in PERIODS]),
    "top_bottom": lambda spark, d: drawdown.top_bottom(study(spark, d), 5, 3).select("period_label", "rank", "ticker", "score"),
    "study_benchmark": lambda spark, d: drawdown.study_benchmark(universe.members({"filter": {}, "benchmark": "per_commodity"}, securities(spark, d), groups(spark, d))),
}

_MEM = f"""{SECURITIES}, {GROUPS}, mem AS MATERIALIZED (SELECT ticker, name, region, sector, coalesce(industry, '') AS industry, market_cap, active, commodity, type, {CAP} AS cap_band FROM securities
  LEFT JOIN (SELECT ticker, first(group_key ORDER BY priority, CASE group_key WHEN 'gold' THEN 0 ELSE 1 END) AS commodity, first(attr ORDER BY priority, CASE group_key WHEN 'gold' THEN 0 ELSE 1 END) AS type
    FROM groups WHERE group_type = 'commodity' GROUP BY ticker) USING (ticker) WHERE quote_type = 'EQUITY')"""

_PANEL = f"""{ALL_BARS}, {_MEM}, mb AS (SELECT ticker, date, adj_close AS p, volume FROM bars JOIN mem USING (ticker)),
cal AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM mb)),
lv AS (SELECT ticker, min(pos) AS a, max(pos) AS z FROM mb JOIN cal USING (date) GROUP BY ticker),
dn AS MATERIALIZED (SELECT lv.ticker, cal.date, cal.pos, p, volume, last_value(p IGNORE NULLS) OVER w AS close, last_value(CASE WHEN p IS NOT NULL THEN cal.pos END IGNORE NULLS) OVER w AS live_pos
  FROM lv JOIN cal ON cal.pos BETWEEN a AND z + 10 LEFT JOIN mb ON mb.ticker = lv.ticker AND mb.date = cal.date WINDOW w AS (PARTITION BY lv.ticker ORDER BY cal.pos)),
ft AS (SELECT *, CASE WHEN count(*) OVER a >= 20 THEN avg(close) OVER a END AS sma20, CASE WHEN count(*) OVER b >= 50 THEN avg(close) OVER b END AS sma50, CASE WHEN count(*) OVER c >= 200 THEN avg(close) OVER c END AS sma200,
    close / coalesce(lag(close, 252) OVER w, first(close) OVER w) - 1 AS ret_12m, volume / avg(volume) OVER v AS rel_vol
  FROM dn WINDOW w AS (PARTITION BY ticker ORDER BY pos), a AS (PARTITION BY ticker ORDER BY pos ROWS 19 PRECEDING), b AS (PARTITION BY ticker ORDER BY pos ROWS 49 PRECEDING),
    c AS (PARTITION BY ticker ORDER BY pos ROWS 199 PRECEDING), v AS (PARTITION BY ticker ORDER BY pos ROWS 62 PRECEDING)),
fl AS (SELECT date, ticker, close, ret_12m, coalesce(sector, 'Unknown') AS sector, industry, cap_band, commodity, type, CASE WHEN close > sma20 THEN 1 ELSE 0 END AS above_20, CASE WHEN close > sma50 THEN 1 ELSE 0 END AS above_50,
    CASE WHEN close > sma200 THEN 1 ELSE 0 END AS pass_trend, CASE WHEN rel_vol >= 1.5 THEN 'HIGH' WHEN rel_vol >= 1.0 THEN 'MED' ELSE 'LOW' END AS vol_label,
    CASE WHEN cap_band = 'small' OR sma20 IS NULL OR sma50 IS NULL OR sma200 IS NULL THEN '-' WHEN close < sma20 AND close < sma50 AND close < sma200 THEN 'EARLY'
      WHEN close < sma50 AND close < sma200 AND close >= sma20 THEN 'PROGRESS' WHEN close < sma200 AND close >= sma50 AND close >= sma20 THEN 'SHIFT' ELSE '-' END AS acc_watch
  FROM ft JOIN mem USING (ticker) WHERE pos - live_pos <= 10),
sc AS (SELECT *, CASE WHEN count(*) OVER g > 1 THEN (rank() OVER (PARTITION BY date, sector ORDER BY ret_12m) - 1) / (count(*) OVER g - 1) * 100 ELSE 50.0 END AS peer_rs_score FROM fl WINDOW g AS (PARTITION BY date, sector)),
panel AS MATERIALIZED (SELECT *, CASE WHEN peer_rs_score >= 75 AND pass_trend = 1 THEN 'LEADER' WHEN peer_rs_score >= 50 AND pass_trend = 1 THEN 'CONTENDER' WHEN peer_rs_score < 50 AND pass_trend = 0 THEN 'WEAK' ELSE 'LAGGARD' END AS regime_label FROM sc)"""

_SUM = {
    "total": "count(*)", "leader": "count(*) FILTER (regime_label = 'LEADER')", "contender": "count(*) FILTER (regime_label = 'CONTENDER')", "laggard": "count(*) FILTER (regime_label = 'LAGGARD')",
    "weak": "count(*) FILTER (regime_label = 'WEAK')", "above_20": "sum(above_20)", "above_50": "sum(above_50)", "above_200": "sum(pass_trend)", "high_vol": "count(*) FILTER (vol_label = 'HIGH')",
    "acc_early": "count(*) FILTER (acc_watch = 'EARLY')", "acc_progress": "count(*) FILTER (acc_watch = 'PROGRESS')", "acc_shift": "count(*) FILTER (acc_watch = 'SHIFT')",
    "leaders": "count(*) FILTER (regime_label = 'LEADER')", "above20": "sum(above_20)", "above50": "sum(above_50)", "above200": "sum(pass_trend)",
}


def _cells(source: str, layer: str, kind: str, key: str, metrics: list[str], where: str = "true") -> str:
    pairs = ", ".join(f"{{'metric': '{m}', 'value': CAST({_SUM[m]} AS DOUBLE)}}" for m in metrics)
    return f"""SELECT date, '{NAME}' AS universe, layer, group_type, group_key, x.metric AS metric, x.value AS value FROM (SELECT date, layer, group_type, group_key, unnest(xs) AS x FROM (
  SELECT date, {layer} AS layer, '{kind}' AS group_type, {key} AS group_key, [{pairs}] AS xs FROM {source} WHERE {where} GROUP BY ALL))"""


def _slug(x: str) -> str:
    return f"replace(replace(replace(lower({x}), ' ', '_'), '/', '_'), '&', 'and')"


_B = breadth
_COUNTS = " UNION ALL ".join([
    _cells("panel", "'all'", "all", "''", _B.ALL_METRICS), _cells("panel", "'all'", "cap", "cap_band", _B.CAP_METRICS), _cells("panel", "'all'", "sector", _slug("sector"), _B.SECTOR_METRICS),
    _cells("panel", "'all'", "industry", _slug("industry"), _B.CAP_METRICS, "industry <> ''"), _cells("panel", "'all'", "commodity", _slug("commodity"), [*_B.SECTOR_METRICS, "acc_early"], "commodity IS NOT NULL"),
    _cells("panel", "'all'", "commodity", f"commodity || '_' || {_slug('type')}", _B.CAP_METRICS, "commodity IS NOT NULL"), _cells("panel", "'all'", "commodity", "commodity || '_' || cap_band", _B.CAP_METRICS, "commodity IS NOT NULL"),
    _cells("panel", "'all'", "type", "coalesce(type, '')", _B.CAP_METRICS),
])
_SETS = "ls AS (SELECT DISTINCT 'sp' AS layer, ticker FROM mem JOIN groups USING (ticker) WHERE group_type = 'index' UNION ALL SELECT 'rus', ticker FROM mem WHERE ticker NOT IN (SELECT ticker FROM groups WHERE group_type = 'index'))"
_LAYERS = " UNION ALL ".join([
    _cells("lp", "layer", "all", "''", _B.LAYER_METRICS), _cells("lp", "layer", "cap", "cap_band", _B.CAP_METRICS), _cells("lp", "layer", "sector", _slug("sector"), _B.SECTOR_METRICS),
    _cells("lp", "layer", "industry", _slug("industry"), _B.CAP_METRICS, "industry <> '' AND layer = 'sp'"),
])
_LONG = f"{_PANEL}, lo AS MATERIALIZED ({_COUNTS})"
_C = "date, universe, layer, group_type, group_key, metric, value"
_NAME = "CASE group_type WHEN 'sector' THEN 'sec_' WHEN 'industry' THEN 'ind_' WHEN 'commodity' THEN 'comm_' WHEN 'type' THEN 'type_' ELSE '' END || CASE WHEN group_key <> '' THEN group_key || '_' ELSE '' END || metric"
_IN = ", ".join(f"'{w}'" for w in WIDE)


def _td(name: str, source: str) -> str:
    """Setup and countdown of source(ticker, date, c): tables {name}_s and {name}_c."""
    return f"""{name}_1 AS (SELECT ticker, date, c, row_number() OVER w AS i, coalesce(sign(lag(c, 4) OVER w - c), 0) AS s, lag(c, 2) OVER w AS c2 FROM {source} WINDOW w AS (PARTITION BY ticker ORDER BY date)),
{name}_2 AS (SELECT *, i - row_number() OVER (PARTITION BY ticker, s ORDER BY date) AS run FROM {name}_1),
{name}_s AS MATERIALIZED (SELECT ticker, date, c, c2, i, CAST(s * row_number() OVER (PARTITION BY ticker, s, run ORDER BY date) AS INTEGER) AS setup FROM {name}_2),
{name}_r AS (SELECT ticker, date, c, setup, i, false AS ib, false AS isl, 0 AS nb, 0 AS ns, 0 AS cd FROM {name}_s WHERE i = 1
  UNION ALL SELECT ticker, date, c, setup, i, b AND nb2 < 13, l AND ns2 < 13, CASE WHEN b AND nb2 < 13 THEN nb2 ELSE 0 END, CASE WHEN l AND ns2 < 13 THEN ns2 ELSE 0 END,
    CASE WHEN l AND c > c2 THEN -ns2 WHEN b AND c < c2 THEN nb2 ELSE 0 END
  FROM (SELECT *, CASE WHEN b THEN nb1 + CASE WHEN c < c2 THEN 1 ELSE 0 END ELSE 0 END AS nb2, CASE WHEN l THEN ns1 + CASE WHEN c > c2 THEN 1 ELSE 0 END ELSE 0 END AS ns2 FROM (
    SELECT x.ticker, x.date, x.c, x.c2, x.setup, x.i, CASE WHEN x.setup = 9 THEN true WHEN x.setup = -9 THEN false ELSE ib END AS b, CASE WHEN x.setup = -9 THEN true WHEN x.setup = 9 THEN false ELSE isl END AS l,
      CASE WHEN abs(x.setup) = 9 THEN 0 ELSE nb END AS nb1, CASE WHEN abs(x.setup) = 9 THEN 0 ELSE ns END AS ns1 FROM {name}_r y JOIN {name}_s x ON x.ticker = y.ticker AND x.i = y.i + 1)))"""


_SERIES = f"{ALL_BARS}, se AS (SELECT ticker, date, adj_close AS c FROM bars)"
_WEEK = "CAST(date + (CAST((12 - dayofweek(date)) % 7 AS INTEGER)) AS DATE)"


def _flags(p: str) -> str:
    return f"""coalesce({p}.setup, 0) AS {p}_setup, coalesce({p}.cd, 0) AS {p}_countdown, CASE WHEN {p}.setup = 9 THEN 1 ELSE 0 END AS {p}_setup9_buy, CASE WHEN {p}.setup = -9 THEN 1 ELSE 0 END AS {p}_setup9_sell,
  CASE WHEN {p}.cd = 13 THEN 1 ELSE 0 END AS {p}_cd13_buy, CASE WHEN {p}.cd = -13 THEN 1 ELSE 0 END AS {p}_cd13_sell"""


def _scan(run: str) -> str:
    """The scan of a run date, table scan."""
    return f"""{ALL_BARS}, {_MEM}, big AS (SELECT * FROM mem WHERE active = 1 AND market_cap >= 1e9),
sd AS (SELECT ticker, date, adj_close AS c FROM bars JOIN big USING (ticker) WHERE date BETWEEN {run} - INTERVAL 200 DAY AND {run}),
sw AS (SELECT ticker, {_WEEK} AS date, arg_max(adj_close, date) AS c FROM bars JOIN big USING (ticker) WHERE date BETWEEN {run} - INTERVAL 500 DAY AND {run} GROUP BY ALL),
{_td('td', 'sd')}, {_td('tw', 'sw')},
d AS (SELECT ticker, arg_max(setup, i) AS setup, arg_max(cd, i) AS cd FROM td_r GROUP BY ticker HAVING count(*) >= 50), w AS (SELECT ticker, arg_max(setup, i) AS setup, arg_max(cd, i) AS cd FROM tw_r GROUP BY ticker HAVING count(*) >= 50),
scan AS MATERIALIZED (SELECT big.ticker, name, sector, cap_band, market_cap, round(market_cap / 1e9, 2) AS market_cap_b, {_flags('d')}, {_flags('w')}, round(cl.c, 4) AS close
  FROM big LEFT JOIN d USING (ticker) LEFT JOIN w USING (ticker) LEFT JOIN (SELECT ticker, arg_max(c, date) AS c FROM sd GROUP BY ticker) cl USING (ticker) WHERE d.ticker IS NOT NULL OR w.ticker IS NOT NULL)"""


_SCAN = _scan(RUN)
_SIG = [f"{p}_{s}" for p in "dw" for s in rotation.SIGNALS]

def _study(peer: str) -> str:
    """The study with peer as the peer group of a member."""
    return f"""{ALL_BARS}, {_MEM}, per AS (SELECT * FROM (VALUES {', '.join(f"('{a}', DATE '{b}')" for a, b in PERIODS)}) x(period_label, period_start)), act AS (SELECT * FROM mem WHERE active = 1),
pp AS MATERIALIZED (SELECT period_label, period_start, ticker, date, adj_close AS p, volume, row_number() OVER (PARTITION BY period_label, ticker ORDER BY date DESC) AS back, max(adj_close) OVER (PARTITION BY period_label, ticker ORDER BY date) AS top
  FROM bars JOIN per ON date >= period_start WHERE ticker = 'MKT' OR ticker IN (SELECT ticker FROM act)),
ps AS MATERIALIZED (SELECT period_label, period_start, ticker, count(*) AS n, arg_min(p, date) AS first, max(p) FILTER (back = 1) AS last, max(p) FILTER (back = 5) AS b5, max(p) FILTER (back = 21) AS b21, max(p) AS most,
  round(min((p - top) / top) * 100, 2) AS dd, round(max(volume) FILTER (back = 1) / avg(volume) FILTER (back <= 63), 4) AS rel_vol FROM pp GROUP BY ALL HAVING count(*) >= 2),
td AS (SELECT period_label, count(DISTINCT date) AS trading_days FROM pp GROUP BY 1),
bn AS (SELECT period_label, round((last / first - 1) * 100, 2) AS bench_ret, dd AS bench_dd, (last / b5 - 1) * 100 AS m5, (last / b21 - 1) * 100 AS m21 FROM ps WHERE ticker = 'MKT'),
r1 AS MATERIALIZED (SELECT ps.*, bn.* EXCLUDE (period_label), (last / first - 1) * 100 AS raw, round((last / first - 1) * 100, 2) AS ret_period, name, coalesce(sector, 'Unknown') AS sector, coalesce({peer}, 'Unknown') AS peer, cap_band FROM ps JOIN bn USING (period_label) JOIN act USING (ticker)),
r2 AS (SELECT *, coalesce((SELECT round(count(*) FILTER (b.raw < a.ret_period) / nullif(count(*), 0) * 100, 2) FROM r1 b WHERE b.period_label = a.period_label AND b.peer = a.peer AND b.ticker <> a.ticker), 50.0) AS peer_rs_score,
  round(ret_period - bench_ret, 2) AS rs_vs_bench, round(dd - bench_dd, 2) AS dd_vs_bench, round((last / b5 - 1) * 100 - m5, 2) AS rs_5d, round((last / b21 - 1) * 100 - m21, 2) AS rs_21d FROM r1 a),
sm AS (SELECT ticker, CASE WHEN count(*) >= 20 THEN round(avg(p) FILTER (k <= 20), 4) END AS sma20, CASE WHEN count(*) >= 50 THEN round(avg(p) FILTER (k <= 50), 4) END AS sma50, CASE WHEN count(*) >= 200 THEN round(avg(p) FILTER (k <= 200), 4) END AS sma200
  FROM (SELECT ticker, adj_close AS p, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars) GROUP BY ticker),
r3 AS (SELECT *, round(rs_vs_bench * 1.0 + peer_rs_score * 0.5 + dd_vs_bench * -0.5, 4) AS score, list_filter([rs_vs_bench, rs_21d, rs_5d], lambda v: v IS NOT NULL) AS x FROM r2 JOIN td USING (period_label) LEFT JOIN sm USING (ticker) WHERE trading_days >= 5),
r4 AS (SELECT *, len(list_filter(range(1, len(x)), lambda i: x[i + 1] > x[i])) AS u, len(list_filter(range(1, len(x)), lambda i: x[i + 1] < x[i])) AS w FROM r3),
study AS MATERIALIZED (SELECT period_label, period_start, row_number() OVER (PARTITION BY period_label ORDER BY score DESC NULLS LAST, ticker) AS rank, ticker, name, sector, cap_band, round(last, 4) AS close, ret_period, bench_ret, rs_vs_bench, rs_5d, rs_21d,
  CASE WHEN len(x) < 2 THEN 'FLAT' WHEN u = len(x) - 1 THEN 'STRONG_UP' WHEN w = len(x) - 1 THEN 'STRONG_DOWN' WHEN u > w THEN 'UP' WHEN w > u THEN 'DOWN' ELSE 'FLAT' END AS rs_trend, dd AS max_dd_period, bench_dd, dd_vs_bench,
  round((last / most - 1) * 100, 2) AS current_dd, peer_rs_score, CASE WHEN rel_vol >= 1.5 THEN 'HIGH' WHEN rel_vol >= 1.0 THEN 'MED' ELSE 'LOW' END AS vol_label, rel_vol,
  CASE WHEN cap_band = 'small' OR sma20 IS NULL OR sma50 IS NULL OR sma200 IS NULL THEN '-' WHEN last < sma20 AND last < sma50 AND last < sma200 THEN 'EARLY' WHEN last < sma50 AND last < sma200 AND last >= sma20 THEN 'PROGRESS'
    WHEN last < sma200 AND last >= sma50 AND last >= sma20 THEN 'SHIFT' ELSE '-' END AS acc_watch, CASE WHEN last > sma200 THEN 1 ELSE 0 END AS pass_trend, score, trading_days FROM r4)"""


_STUDY, _BY_SECTOR = _study("commodity"), _study("sector")  # the members have commodities

_RRG = f"""WITH {ALL_BARS}, w AS (SELECT * FROM bars WHERE date BETWEEN {RUN} - INTERVAL 500 DAY AND {RUN}),
j AS (SELECT a.ticker, a.date, a.adj_close AS p, b.adj_close AS b FROM w a JOIN w b ON b.date = a.date AND b.ticker = 'MKT' WHERE a.ticker LIKE 'R%'),
r AS (SELECT *, (p / lag(p, 62) OVER x) / (b / lag(b, 62) OVER x) * 100 AS ratio FROM j WINDOW x AS (PARTITION BY ticker ORDER BY date)),
m AS (SELECT *, ratio / lag(ratio, 21) OVER (PARTITION BY ticker ORDER BY date) * 100 AS mom FROM r)
SELECT date, ticker, ticker AS name, CASE WHEN ticker IN ('R0', 'R1') THEN 'cyclical' WHEN ticker IN ('R2', 'R3') THEN 'defensive' ELSE '' END AS grp, round(ratio, 4) AS rs_ratio, round(mom, 4) AS rs_momentum, round(p, 4) AS close FROM m WHERE mom IS NOT NULL"""

SQL = {
    "breadth_panel": f"WITH {_PANEL} SELECT date, ticker, close, ret_12m, sector, industry, cap_band, commodity, type, above_20, above_50, pass_trend, vol_label, acc_watch, peer_rs_score, regime_label FROM panel",
    "breadth_counts": f"WITH {_LONG} SELECT {_C} FROM lo",
    "breadth_layer_sets": f"WITH {_MEM}, {_SETS} SELECT layer, ticker FROM ls",
    "breadth_layers": f"WITH {_PANEL}, {_SETS}, lp AS (SELECT * FROM panel JOIN ls USING (ticker)) {_LAYERS}",
    "breadth_guard": f"""WITH {_LONG}, tot AS (SELECT date, value, median(value) OVER () AS unused FROM lo WHERE group_type = 'all' AND metric = 'total'), base AS (SELECT median(value) AS b FROM (SELECT value FROM tot ORDER BY date DESC LIMIT 60)),
inc AS (SELECT date, universe, layer, group_type, group_key, metric, CASE WHEN dayofyear(date) % 97 = 0 AND metric = 'total' THEN floor(value / 2) ELSE value END AS value FROM lo WHERE group_type = 'all' AND month(date) % 2 = 0 AND metric <> 'laggard'),
good AS (SELECT * FROM inc WHERE date NOT IN (SELECT date FROM inc, base WHERE metric = 'total' AND b > 0 AND value < b * 0.9))
SELECT {_C} FROM good UNION ALL SELECT {_C} FROM lo WHERE group_type = 'all' AND date NOT IN (SELECT date FROM good)""",
    "breadth_incremental": f"""WITH {_LONG}, st AS (SELECT DISTINCT date FROM lo WHERE date <= {RUN} - INTERVAL 20 DAY), done AS (SELECT date FROM st ORDER BY date DESC OFFSET 2)
SELECT {_C} FROM lo WHERE group_type = 'all' AND date >= {RUN} - INTERVAL 400 DAY AND date NOT IN (SELECT date FROM done)""",
    "breadth_rebuild": f"WITH {_LONG}, sk AS (SELECT date FROM cal WHERE pos > 200) SELECT {_C} FROM lo WHERE group_type = 'sector' AND date IN (SELECT date FROM sk)",
    "read_breadth": f"WITH {_LONG} SELECT {_C} FROM lo WHERE group_type = 'sector' AND group_key = 's0' AND date BETWEEN DATE '2001-01-01' AND {RUN} ORDER BY date DESC, metric LIMIT 60 OFFSET 7",
    "read_signals_all": f"WITH RECURSIVE {_SCAN} SELECT *, {RUN} AS run_date FROM scan",
    "breadth_wide": f"WITH {_LONG}, nm AS (SELECT universe, date, {_NAME} AS name, value FROM lo) SELECT universe, date, " + ", ".join(f"first(value) FILTER (name = '{w}') AS {w}" for w in WIDE) + " FROM nm GROUP BY ALL",
    "breadth_long": f"WITH {_LONG} SELECT {_C} FROM lo WHERE {_NAME} IN ({_IN})",
    "breadth_summary": f"""WITH {_LONG}, mx AS (SELECT max(date) AS t FROM lo), dd AS (SELECT k, max(date) AS d FROM lo, mx, (VALUES (7), (28), (91)) x(k) WHERE date <= t - CAST(k AS INTEGER) GROUP BY k),
nw AS (SELECT * FROM lo, mx WHERE date = t), ol AS (SELECT k, lo.* FROM lo JOIN dd ON date = d)
SELECT universe, layer, group_type, group_key, metric, nw.value, {', '.join(f"nw.value - (SELECT value FROM ol WHERE k = {k} AND ol.layer = nw.layer AND ol.group_type = nw.group_type AND ol.group_key = nw.group_key AND ol.metric = nw.metric) AS change_{k}" for k in (7, 28, 91))} FROM nw""",
    "rrg": _RRG,
    "read_rrg": "SELECT * FROM (" + _RRG + ") WHERE date >= DATE '2001-05-01' ORDER BY date DESC, ticker LIMIT 40 OFFSET 3",
    "td_setup": f"WITH {_SERIES}, {_td('t', 'se').split(', t_r AS')[0].split(',' + chr(10) + 't_r AS')[0]} SELECT ticker, date, c, setup FROM t_s",
    "td_countdown": f"WITH RECURSIVE {_SERIES}, {_td('t', 'se')} SELECT ticker, date, c, setup, cd AS countdown FROM t_r",
    "weekly_close": f"WITH {_SERIES} SELECT ticker, {_WEEK} AS date, arg_max(c, date) AS c FROM se GROUP BY ticker, {_WEEK}",
    "demark_scan": f"WITH RECURSIVE {_SCAN} SELECT * FROM scan",
    "demark_report_lists": f"WITH RECURSIVE {_SCAN} " + " UNION ALL ".join(f"SELECT '{s}' AS signal, coalesce(string_agg(ticker, ',' ORDER BY ticker) FILTER ({s} = 1), '') AS tickers FROM scan" for s in _SIG),
    "read_signals": f"WITH RECURSIVE {_scan(f"DATE '{SIGNAL_DATE}'")} SELECT * FROM scan WHERE {' OR '.join(f'{s} = 1' for s in _SIG)}",
    "multi_period_study": f"WITH {_STUDY} SELECT * FROM study",
    "period_performance": f"WITH {_BY_SECTOR} SELECT * FROM study WHERE period_label = 'p2000'",
    "cross_period_ranks": f"""WITH {_STUDY}, x AS (SELECT ticker, {', '.join(f"max(rank) FILTER (period_label = '{p}') AS rank_{p}" for p, _ in PERIODS)} FROM study GROUP BY ticker)
SELECT *, CASE WHEN rank_p1998 > rank_p2000 AND rank_p2000 > rank_p2001 THEN 'IMPROVING' WHEN rank_p1998 < rank_p2000 AND rank_p2000 < rank_p2001 THEN 'DECLINING' ELSE 'MIXED' END AS rank_trend FROM x""",
    "top_bottom": f"WITH {_STUDY} SELECT period_label, rank, ticker, score FROM (SELECT *, max(rank) OVER (PARTITION BY period_label) AS mx FROM study) WHERE rank <= 5 OR rank > mx - 3",
    "study_benchmark": f"""WITH {SECURITIES}, {GROUPS}, c AS (SELECT ticker, first(group_key ORDER BY priority, CASE group_key WHEN 'gold' THEN 0 ELSE 1 END) AS commodity FROM groups JOIN securities USING (ticker) WHERE group_type = 'commodity' AND active = 1 GROUP BY ticker)
SELECT CASE commodity WHEN 'gold' THEN 'GDX' ELSE 'SIL' END AS benchmark FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1""",
}
