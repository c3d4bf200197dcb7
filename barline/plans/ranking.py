"""Queries of relative strength, scores and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, ranking, universe
from ..sources.tables import PREVIOUS_DATE, RUN_DATE, bars, groups, securities
from .sql import ALL_BARS, CAP, GROUPS, METRICS, PREV, RUN, SECURITIES, block

_DIV = {"rsi_div": {"BULL": 1.0, "HID_BULL": 0.5, "BEAR": -1.0, "HID_BEAR": -0.5}, "obv_div": {"CONV_UP": 0.5, "BULL_DIV": 1.0, "ACCUM": 0.5, "CONV_DOWN": -0.5, "BEAR_DIV": -1.0, "DISTRIB": -0.5}}
SPECS = {
    "au_total_market": {"filter": {"region": "AU", "quote_type": "EQUITY"}, "benchmark": "MKT", "cap_scheme": "AU"},
    "us_total_market": {"filter": {"region": "US", "quote_type": "EQUITY"}, "benchmark": "MKT", "cap_scheme": "US"},
}


def universes(spark, sf_dir):
    s, g = securities(spark, sf_dir), groups(spark, sf_dir)
    out = None
    for name, spec in SPECS.items():
        part = universe.members(spec, s, g).withColumn("universe", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def peers_of(spark, sf_dir):
    return securities(spark, sf_dir).where("quote_type = 'EQUITY'")


def results(spark, sf_dir, dates=(PREVIOUS_DATE, RUN_DATE)):
    """Both studies at the given run dates."""
    b, u, out = bars(spark, sf_dir), universes(spark, sf_dir), None
    for day in dates:
        block_ = metrics.metric_block(b, day)
        for study, run in (("screener", ranking.screener(block_, u)), ("benchmark", ranking.benchmark(block_, u, ranking.BENCHMARK_SETTINGS))):
            part = run.withColumn("study", F.lit(study)).withColumn("run_date", F.to_date(F.lit(day)))
            out = part if out is None else out.unionByName(part)
    return out


def _returns(spark, sf_dir):
    return metrics.returns_block(bars(spark, sf_dir), RUN_DATE)


_SLIM = ["study", "universe", "run_date", "rank", "ticker", "score_final", "regime_label", "actionable", "high_conv"]

QUERIES = {
    "peer_rs_score": lambda spark, d: ranking.peer_rs_score(_returns(spark, d), peers_of(spark, d)),
    "peer_rs_median": lambda spark, d: ranking.peer_rs_median(_returns(spark, d), peers_of(spark, d)),
    "benchmark_rs": lambda spark, d: ranking.benchmark_rs(_returns(spark, d), securities(spark, d)),
    "rs_trend": lambda spark, d: ranking.benchmark_rs(_returns(spark, d), securities(spark, d)).select("ticker", ranking.rs_trend(F.array("rs_63", "rs_21", "rs_5")).alias("rs_trend")),
    "divergence_bonus": lambda spark, d: metrics.metric_block(bars(spark, d), RUN_DATE).select("ticker", ranking.divergence_bonus().alias("bonus")),
    "screener": lambda spark, d: ranking.screener(metrics.metric_block(bars(spark, d), RUN_DATE), universes(spark, d)),
    "benchmark": lambda spark, d: ranking.benchmark(metrics.metric_block(bars(spark, d), RUN_DATE), universes(spark, d), ranking.BENCHMARK_SETTINGS),
    "score_screener": lambda spark, d: QUERIES["screener"](spark, d).select("universe", "ticker", "score_final"),
    "score_benchmark": lambda spark, d: QUERIES["benchmark"](spark, d).select("universe", "ticker", "score_final"),
    "actionable_flags": lambda spark, d: QUERIES["screener"](spark, d).select("universe", "ticker", "actionable", "high_conv"),
    "delta_rank": lambda spark, d: ranking.delta_rank(results(spark, d), RUN_DATE).select("study", "universe", "ticker", "rank", "delta_rank"),
    "latest_run": lambda spark, d: ranking.latest_run(results(spark, d)).select(*_SLIM),
    "run_dates": lambda spark, d: ranking.run_dates(results(spark, d)),
    "actionable_list": lambda spark, d: ranking.actionable_list(results(spark, d)).select(*_SLIM),
    "export_list": lambda spark, d: ranking.export_list(results(spark, d), securities(spark, d)),
    "read_ranked": lambda spark, d: ranking.read_ranked(results(spark, d), "benchmark", "us_total_market", {"regime_label": "WEAK"}, limit=5).select(*_SLIM),
}


def _case(label: str, values: dict[str, float], default: str = "0.0") -> str:
    return f"CASE {label} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


_TREND = """CASE WHEN len(x) < 2 THEN 'FLAT' WHEN u = len(x) - 1 THEN 'STRONG_UP' WHEN w = len(x) - 1 THEN 'STRONG_DOWN' WHEN u > w THEN 'UP' WHEN w > u THEN 'DOWN' ELSE 'FLAT' END"""


def _trend(source: str) -> str:
    return f"""(SELECT *, {_TREND} AS rs_trend FROM (SELECT *, len(list_filter(range(1, len(x)), lambda i: x[i + 1] > x[i])) AS u, len(list_filter(range(1, len(x)), lambda i: x[i + 1] < x[i])) AS w
  FROM (SELECT *, list_filter([rs_63, rs_21, rs_5], lambda v: v IS NOT NULL) AS x FROM {source})))"""


def _median(c: str, source: str) -> str:
    return f"round(a.ret_{c} - coalesce((SELECT median(b.ret_{c}) FROM {source} b WHERE b.g = a.g AND b.ticker <> a.ticker), 0), 4)"


_UNI = f"""{SECURITIES}, {GROUPS},
uni AS MATERIALIZED (SELECT lower(region) || '_total_market' AS universe, ticker, name, region, sector, industry, commodity, type, {CAP} AS cap_band, benchmark
  FROM securities LEFT JOIN (SELECT ticker, first(group_key ORDER BY priority, CASE group_key WHEN 'gold' THEN 0 ELSE 1 END) AS commodity, first(attr ORDER BY priority, CASE group_key WHEN 'gold' THEN 0 ELSE 1 END) AS type
    FROM groups WHERE group_type = 'commodity' GROUP BY ticker) USING (ticker) WHERE active = 1 AND quote_type = 'EQUITY')"""


def _benchmark_rs(s: str) -> str:
    return f"""br{s} AS (SELECT m{s}.ticker, round((1 + m{s}.ret_12m) / (1 + b.ret_12m), 4) AS rs_ratio, round((1 + m{s}.ret_63) / (1 + b.ret_63), 4) AS rs_63, round((1 + m{s}.ret_21) / (1 + b.ret_21), 4) AS rs_21,
  round((1 + m{s}.ret_5) / (1 + b.ret_5), 4) AS rs_5 FROM m{s} JOIN securities USING (ticker) LEFT JOIN m{s} b ON b.ticker = benchmark)"""


_BASE = f"""ret_12m * 0.4 + coalesce(persist_frac, 0) * 0.01 + coalesce(max_dd, 0) * -(CASE cap_band WHEN 'large' THEN 0.4 WHEN 'mid' THEN 0.3 ELSE 0.2 END) + coalesce(mqs * 0.2, 0)
  + {_case("rs_trend", {"STRONG_UP": 1.0, "UP": 0.5, "DOWN": -0.5, "STRONG_DOWN": -1.0})}"""
_BONUS = f"({_case('rsi_div', _DIV['rsi_div'])} + {_case('obv_div', _DIV['obv_div'])})"
_ACC = """CASE WHEN cap_band = 'small' OR sma20 IS NULL OR sma50 IS NULL OR sma200 IS NULL THEN '-' WHEN close < sma20 AND close < sma50 AND close < sma200 THEN 'EARLY'
  WHEN close < sma50 AND close < sma200 AND close >= sma20 THEN 'PROGRESS' WHEN close < sma200 AND close >= sma50 AND close >= sma20 THEN 'SHIFT' ELSE '-' END"""


def _study(name: str, source: str, extra: str, regime: str) -> str:
    """A study's rows from source, as the table name."""
    return f"""{name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY universe ORDER BY score_final DESC NULLS LAST, ticker) AS rank,
  CASE WHEN (acc_watch <> '-' AND cap_band IN ('large', 'mid') AND vol_label IN ('HIGH', 'MED') AND regime_label IN ('LEADER', 'CONTENDER', 'TREND+LEAD', 'TREND_ONLY'))
    OR (vol_label = 'HIGH' AND regime_label IN ('LEADER', 'TREND+LEAD')) THEN 1 ELSE 0 END AS actionable,
  CASE WHEN vol_label = 'HIGH' AND acc_watch <> '-' AND coalesce(score_final, -1) > 0 THEN 1 ELSE 0 END AS high_conv
  FROM (SELECT *, {_ACC} AS acc_watch, round(({_BASE} + {extra} + {_BONUS}) * {_case("vol_label", {"HIGH": 1.1, "MED": 1.0}, "0.9")}, 4) AS score_final
    FROM (SELECT *, {regime} AS regime_label FROM {_trend(source)})))"""


def _studies(s: str = "") -> str:
    score = "CASE WHEN count(*) OVER g > 1 THEN round((rank() OVER (PARTITION BY universe, sector ORDER BY ret_12m) - 1) / (count(*) OVER g - 1) * 100, 2) ELSE 50.0 END"
    medians = ", ".join(f"{_median(c, f'u{s}')} AS rs_{c}" for c in ("5", "21", "63"))
    regime = "CASE WHEN peer_rs_score >= 75 AND pass_trend = 1 THEN 'LEADER' WHEN peer_rs_score >= 50 AND pass_trend = 1 THEN 'CONTENDER' WHEN peer_rs_score < 50 AND pass_trend = 0 THEN 'WEAK' ELSE 'LAGGARD' END"
    region = _case("regime_label", {"LEADER": 1.0, "CONTENDER": 0.5, "WEAK": -0.5})
    own = "CASE WHEN pass_trend = 1 AND rs_ratio > 1.0 THEN 'TREND+LEAD' WHEN pass_trend = 1 THEN 'TREND_ONLY' ELSE 'WEAK' END"
    bonus = "CASE WHEN region = 'AU' THEN 0.5 ELSE 1.0 END"
    return f"""u{s} AS MATERIALIZED (SELECT m{s}.*, uni.* EXCLUDE (ticker), universe || sector AS g, {score} AS peer_rs_score FROM m{s} JOIN uni USING (ticker) WINDOW g AS (PARTITION BY universe, sector)),
us{s} AS (SELECT a.*, CAST(NULL AS DOUBLE) AS rs_ratio, {medians} FROM u{s} a),
{_study("scr" + s, "us" + s, f"peer_rs_score * 0.02 + {region}", regime)},
{_benchmark_rs(s)}, ub{s} AS (SELECT u{s}.* EXCLUDE (peer_rs_score), CAST(NULL AS DOUBLE) AS peer_rs_score, br{s}.* EXCLUDE (ticker) FROM u{s} JOIN br{s} USING (ticker) WHERE rs_ratio IS NOT NULL),
{_study("ben" + s, "ub" + s, f"CASE WHEN pass_trend = 1 THEN {bonus} ELSE 0.0 END + CASE WHEN rs_ratio > 1.0 THEN {bonus} ELSE 0.0 END", own)}"""


_OUT = """universe, rank, ticker, name, sector, industry, commodity, type, cap_band, close, peer_rs_score, rs_ratio, rs_5, rs_21, rs_63, rs_trend, round(ret_6m * 100, 2) AS ret_6m, round(ret_12m * 100, 2) AS ret_12m,
  round(ret_24m * 100, 2) AS ret_24m, max_dd, persist_frac, vol_63, rel_vol, vol_label, acc_watch, sma20, sma50, sma200, pass_trend, mqs, rsi_14, rsi_div, obv_div, regime_label, score_final, actionable, high_conv"""
ONE = f"{METRICS}, {_UNI}, {_studies()}"
_FOUR = " UNION ALL ".join(
    f"SELECT '{study}' AS study, universe, {day} AS run_date, rank, ticker, score_final, regime_label, actionable, high_conv FROM {name}{s}"
    for day, s in ((RUN, ""), (PREV, "2")) for study, name in (("screener", "scr"), ("benchmark", "ben"))
)
RESULTS = f"{ALL_BARS}, {block()}, {block(PREV, '2')}, {_UNI}, {_studies()}, {_studies('2')}, res AS MATERIALIZED ({_FOUR})"
_S = ", ".join(_SLIM)
_PEERS = f"{METRICS}, {SECURITIES}, u AS (SELECT m.*, sector AS g FROM m JOIN securities USING (ticker) WHERE quote_type = 'EQUITY')"

SQL = {
    "peer_rs_score": f"WITH {_PEERS} SELECT ticker, CASE WHEN count(*) OVER g > 1 THEN round((rank() OVER (PARTITION BY g ORDER BY ret_12m) - 1) / (count(*) OVER g - 1) * 100, 2) ELSE 50.0 END AS peer_rs_score FROM u WINDOW g AS (PARTITION BY g)",
    "peer_rs_median": f"WITH {_PEERS} SELECT ticker, {', '.join(_median(c, 'u') + f' AS rs_{c}' for c in ('5', '21', '63'))} FROM u a",
    "benchmark_rs": f"WITH {METRICS}, {SECURITIES}, {_benchmark_rs('')} SELECT * FROM br",
    "rs_trend": f"WITH {METRICS}, {SECURITIES}, {_benchmark_rs('')} SELECT ticker, rs_trend FROM {_trend('br')}",
    "divergence_bonus": f"WITH {METRICS} SELECT ticker, CAST({_BONUS} AS DOUBLE) AS bonus FROM m",
    "screener": f"WITH {ONE} SELECT {_OUT} FROM scr",
    "benchmark": f"WITH {ONE} SELECT {_OUT} FROM ben",
    "score_screener": f"WITH {ONE} SELECT universe, ticker, score_final FROM scr",
    "score_benchmark": f"WITH {ONE} SELECT universe, ticker, score_final FROM ben",
    "actionable_flags": f"WITH {ONE} SELECT universe, ticker, actionable, high_conv FROM scr",
    "delta_rank": f"""WITH {RESULTS} SELECT a.study, a.universe, a.ticker, a.rank, coalesce(b.rank - a.rank, 0) AS delta_rank FROM res a
  LEFT JOIN (SELECT * FROM res WHERE run_date = {PREV}) b ON a.study = b.study AND a.universe = b.universe AND a.ticker = b.ticker WHERE a.run_date = {RUN}""",
    "latest_run": f"WITH {RESULTS} SELECT {_S} FROM res WHERE run_date = {RUN}",
    "run_dates": f"WITH {RESULTS} SELECT study, universe, max(run_date) AS last_date, count(DISTINCT run_date) AS n_runs FROM res GROUP BY ALL",
    "actionable_list": f"WITH {RESULTS} SELECT {_S} FROM res WHERE run_date = {RUN} AND actionable = 1",
    "export_list": f"""WITH {RESULTS} SELECT study, res.universe, string_agg(CASE exchange WHEN 'ASX' THEN 'ASX:' ELSE 'NYSE:' END || ticker, ',' ORDER BY rank) AS symbols
  FROM res JOIN securities USING (ticker) WHERE run_date = {RUN} GROUP BY ALL""",
    "read_ranked": f"WITH {RESULTS} SELECT {_S} FROM res WHERE run_date = {RUN} AND study = 'benchmark' AND universe = 'us_total_market' AND regime_label = 'WEAK' ORDER BY rank, ticker LIMIT 5",
}
