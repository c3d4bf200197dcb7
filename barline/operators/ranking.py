"""Relative strength, scores and ranks over the metric block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import chain, lookup, pct, rnd
from .metrics import acc_watch_of
from .universe import export_symbol

# Default weights of the score.
DEFAULTS = {
    "ret_12m_weight": 0.4, "persist_weight": 0.01, "mqs_weight": 0.2, "dd_weight_large": 0.4, "dd_weight_mid": 0.3, "dd_weight_small": 0.2, "dd_weight_etf": 0.3,
    "vol_high": 1.1, "vol_med": 1.0, "vol_low": 0.9, "rs_trend_strong_up": 1.0, "rs_trend_up": 0.5, "rs_trend_flat": 0.0, "rs_trend_down": -0.5, "rs_trend_strong_down": -1.0,
    "peer_rs_weight": 0.02, "regime_bonus_leader": 1.0, "regime_bonus_contender": 0.5, "regime_bonus_laggard": 0.0, "regime_bonus_weak": -0.5, "trend_bonus": 1.0, "lead_bonus": 1.0,
    "rsi_div_bull": 1.0, "rsi_div_hid_bull": 0.5, "rsi_div_bear": -1.0, "rsi_div_hid_bear": -0.5,
    "obv_conv_up": 0.5, "obv_bull_div": 1.0, "obv_accum": 0.5, "obv_conv_down": -0.5, "obv_bear_div": -1.0, "obv_distrib": -0.5,
}
BENCHMARK_SETTINGS = {"AU": {"trend_bonus": 0.5, "lead_bonus": 0.5}}


RS_COLUMNS = ("ret_5", "ret_21", "ret_63")


def with_peer_score(rows: DataFrame, group: list[str]) -> DataFrame:
    """rows(ticker, ret_12m, group...) with peer_rs_score, null without a return. A rank in the group gives the number beaten, so no pairs are formed."""
    peers = Window.partitionBy(*group)
    n, beaten = F.count("ret_12m").over(peers), F.rank().over(peers.orderBy(F.col("ret_12m").asc_nulls_last())) - 1
    return rows.withColumn("peer_rs_score", F.when(F.col("ret_12m").isNotNull(), F.when(n > 1, rnd(beaten / (n - 1) * 100, 2)).otherwise(50.0)))


def with_peer_medians(rows: DataFrame, group: list[str], columns: tuple[str, ...] = RS_COLUMNS) -> DataFrame:
    """rows(ticker, columns, group...) with rs_<bars> of each column: its value less the median of the others' in the group.

    Without a value at sorted place k the median of the n - 1 others needs at most four middle values of the whole group. All
    of it is windows by group, so there is one shuffle and no join, whatever the columns.
    """
    peers = Window.partitionBy(*group)
    for c in columns:
        rows = rows.withColumn("_k", F.row_number().over(peers.orderBy(F.col(c).asc_nulls_last(), "ticker"))).withColumn("_n", F.count(c).over(peers))
        low, high = F.floor(F.col("_n") / 2), F.floor((F.col("_n") + 1) / 2)  # of n - 1 values these places are in the middle, before and after the own place
        value = lambda place: F.max(F.when(F.col("_k") == place, F.col(c))).over(peers)
        middle = {"_a": value(low), "_b": value(low + 1), "_c": value(high), "_d": value(high + 1)}
        rows = rows.withColumns(middle)
        at = lambda place, own, after: F.when(place >= F.col("_k"), F.col(after)).otherwise(F.col(own))
        median = F.when(F.col("_n") == 1, 0.0).otherwise((at(low, "_a", "_b") + at(high, "_c", "_d")) / 2)
        rows = rows.withColumn("rs_" + c.split("_")[1], rnd(F.col(c) - median, 4)).drop("_k", "_n", *middle)
    return rows


def peer_rs_score(metrics: DataFrame, peers: DataFrame, key: str = "sector") -> DataFrame:
    """Share of other tickers of the group that a ticker's 12-month return strictly beats, 50 if there are none.

    metrics has ticker and ret_12m, peers ticker and the group key; a null group counts as Unknown.
    """
    rows = metrics.join(peers.select("ticker", F.coalesce(key, F.lit("Unknown")).alias("peer_group")), "ticker")
    return with_peer_score(rows, ["peer_group"]).where("ret_12m is not null").select("ticker", "peer_rs_score")


def peer_rs_median(metrics: DataFrame, peers: DataFrame, key: str = "sector", columns: tuple[str, ...] = RS_COLUMNS) -> DataFrame:
    """Own return less the median of the other peers', one column rs_<bars> each."""
    rows = metrics.join(peers.select("ticker", F.coalesce(key, F.lit("Unknown")).alias("peer_group")), "ticker")
    return with_peer_medians(rows, ["peer_group"], columns).select("ticker", *("rs_" + c.split("_")[1] for c in columns))


def benchmark_rs(metrics: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """(1 + return) / (1 + benchmark's return) at 12 months and 63, 21 and 5 bars; benchmarks has ticker and benchmark."""
    spans = {"rs_ratio": "ret_12m", "rs_63": "ret_63", "rs_21": "ret_21", "rs_5": "ret_5"}
    own = metrics.join(benchmarks.select("ticker", "benchmark"), "ticker")
    their = metrics.select(F.col("ticker").alias("benchmark"), *(F.col(c).alias(f"b_{c}") for c in spans.values()))
    both = own.join(their, "benchmark", "left")  # one row a benchmark, broadcast by size
    return both.select("ticker", *(rnd((1 + F.col(c)) / (1 + F.col(f"b_{c}")), 4).alias(name) for name, c in spans.items()))


def rs_trend(values: Column) -> Column:
    """Label of an ordered array: nulls drop out, then steps up and down are counted."""
    v = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x))
    n = F.size(v) - 1
    steps = F.zip_with(F.slice(v, F.lit(2), F.greatest(n, F.lit(0))), F.slice(v, F.lit(1), F.greatest(n, F.lit(0))), lambda b, a: F.signum(b - a))
    up, down = F.size(F.filter(steps, lambda x: x > 0)), F.size(F.filter(steps, lambda x: x < 0))
    return chain([(n < 1, "FLAT"), (up == n, "STRONG_UP"), (down == n, "STRONG_DOWN"), (up > down, "UP"), (down > up, "DOWN")], "FLAT")


def setting(name: str, overrides: dict[str, dict] | None = None, key: str = "region") -> Column:
    """A weight of the score, by the row's region where that overrides it."""
    special = {k: v[name] for k, v in (overrides or {}).items() if name in v}
    return lookup(special, key, DEFAULTS[name]) if special else F.lit(DEFAULTS[name])


def _labelled(label: str, names: dict[str, str], overrides: dict | None, default: float = 0.0) -> Column:
    return chain([(F.col(label) == k, setting(v, overrides)) for k, v in names.items()], default)


def divergence_bonus(overrides: dict | None = None) -> Column:
    rsi = {k: f"rsi_div_{k.lower()}" for k in ("BULL", "HID_BULL", "BEAR", "HID_BEAR")}
    flow = {k: f"obv_{k.lower()}" for k in ("CONV_UP", "BULL_DIV", "ACCUM", "CONV_DOWN", "BEAR_DIV", "DISTRIB")}
    return _labelled("rsi_div", rsi, overrides) + _labelled("obv_div", flow, overrides)


def score(mode: str, overrides: dict | None = None) -> Column:
    """Weighted score times the volume multiplier; ret_12m is a fraction, persistence and drawdown are percents."""
    s = lambda name: setting(name, overrides)
    zero = F.lit(0.0)
    drawdown_weight = chain([(F.col("cap_band") == k, s(f"dd_weight_{k}")) for k in ("large", "mid", "small")], 0.2)
    trend = {k: f"rs_trend_{k.lower()}" for k in ("STRONG_UP", "UP", "FLAT", "DOWN", "STRONG_DOWN")}
    base = (
        F.col("ret_12m") * s("ret_12m_weight") + F.coalesce("persist_frac", zero) * s("persist_weight") + F.coalesce("max_dd", zero) * -drawdown_weight
        + F.coalesce(F.col("mqs") * s("mqs_weight"), zero) + _labelled("rs_trend", trend, overrides)
    )
    if mode == "screener":
        regime = {k: f"regime_bonus_{k.lower()}" for k in ("LEADER", "CONTENDER", "LAGGARD", "WEAK")}
        base = base + F.col("peer_rs_score") * s("peer_rs_weight") + _labelled("regime_label", regime, overrides)
    else:
        base = base + F.when(F.col("pass_trend") == 1, s("trend_bonus")).otherwise(0.0) + F.when(F.col("rs_ratio") > 1.0, s("lead_bonus")).otherwise(0.0)
    volume = chain([(F.col("vol_label") == k, s(f"vol_{k.lower()}")) for k in ("HIGH", "MED")], s("vol_low"))
    return rnd((base + divergence_bonus(overrides)) * volume, 4)


def actionable() -> Column:
    lead, top = F.col("regime_label").isin("LEADER", "CONTENDER", "TREND+LEAD", "TREND_ONLY"), F.col("regime_label").isin("LEADER", "TREND+LEAD")
    watched = (F.col("acc_watch") != "-") & F.col("cap_band").isin("large", "mid") & F.col("vol_label").isin("HIGH", "MED") & lead
    return F.when(watched | ((F.col("vol_label") == "HIGH") & top), 1).otherwise(0)


def high_conviction() -> Column:
    return F.when((F.col("vol_label") == "HIGH") & (F.col("acc_watch") != "-") & (F.coalesce("score_final", F.lit(-1.0)) > 0), 1).otherwise(0)


def _finish(rows: DataFrame, mode: str, overrides: dict | None) -> DataFrame:
    rows = rows.withColumn("rs_trend", rs_trend(F.array("rs_63", "rs_21", "rs_5"))).withColumn("acc_watch", acc_watch_of())
    rows = rows.withColumn("score_final", score(mode, overrides))
    rank = F.row_number().over(Window.partitionBy("universe").orderBy(F.desc_nulls_last("score_final"), "ticker"))
    return rows.select(
        "universe", rank.alias("rank"), "ticker", "name", "sector", "industry", "commodity", "type", "cap_band", "close", "peer_rs_score", "rs_ratio", "rs_5", "rs_21", "rs_63", "rs_trend",
        pct("ret_6m").alias("ret_6m"), pct("ret_12m").alias("ret_12m"), pct("ret_24m").alias("ret_24m"), "max_dd", "persist_frac", "vol_63", "rel_vol", "vol_label", "acc_watch", "sma20", "sma50",
        "sma200", "pass_trend", "mqs", "rsi_14", "rsi_div", "obv_div", "regime_label", "score_final", actionable().alias("actionable"), high_conviction().alias("high_conv"),
    )


def _of_universe(metrics: DataFrame, universe: DataFrame) -> DataFrame:
    """Metrics once per ticker, spread to the universes that hold it; peers form inside a universe."""
    info = universe.select("universe", "ticker", "name", "region", "sector", "industry", "commodity", "type", "cap_band", "benchmark")
    return metrics.join(info, "ticker")


def screener(metrics: DataFrame, universe: DataFrame, overrides: dict | None = None, peer_key: str = "sector") -> DataFrame:
    """Ranked rows of each universe: metrics, peer strength, regime, score, flags. universe has a row per universe and member."""
    rows = _of_universe(metrics, universe)
    if peer_key == "commodity":
        rows = rows.where(F.col("commodity").isNotNull() & F.col("ret_12m").isNotNull())
    group = ["universe", "_peers"]
    rows = rows.withColumn("_peers", F.coalesce(peer_key, F.lit("Unknown")))
    rows = with_peer_medians(with_peer_score(rows, group), group).where("ret_12m is not null").withColumn("rs_ratio", F.lit(None).cast("double"))
    p, t = F.col("peer_rs_score"), F.col("pass_trend")
    rows = rows.withColumn("regime_label", chain([((p >= 75) & (t == 1), "LEADER"), ((p >= 50) & (t == 1), "CONTENDER"), ((p < 50) & (t == 0), "WEAK")], "LAGGARD"))
    return _finish(rows, "screener", overrides)


def benchmark(metrics: DataFrame, universe: DataFrame, overrides: dict | None = None) -> DataFrame:
    """As screener, against each member's benchmark; members without one drop out."""
    rows = _of_universe(metrics, universe)
    strength = benchmark_rs(metrics, universe.select("ticker", "benchmark").distinct())
    rows = rows.join(strength, "ticker").where("rs_ratio is not null").withColumn("peer_rs_score", F.lit(None).cast("double"))
    t, r = F.col("pass_trend"), F.col("rs_ratio")
    rows = rows.withColumn("regime_label", chain([((t == 1) & (r > 1.0), "TREND+LEAD"), (t == 1, "TREND_ONLY")], "WEAK"))
    return _finish(rows, "benchmark", overrides)


def delta_rank(results: DataFrame, run_date: str) -> DataFrame:
    """Previous rank less the rank of this run, 0 for new tickers; previous is the newest earlier run of the study and universe."""
    keys = ["study", "universe"]
    now, earlier = results.where(F.col("run_date") == F.lit(run_date)), results.where(F.col("run_date") < F.lit(run_date))
    newest = earlier.groupBy(*keys).agg(F.max("run_date").alias("run_date"))
    before = earlier.join(newest, [*keys, "run_date"], "left_semi").select(*keys, "ticker", F.col("rank").alias("before"))
    return now.join(before, [*keys, "ticker"], "left").withColumn("delta_rank", F.coalesce(F.col("before") - F.col("rank"), F.lit(0))).drop("before")


def latest_run(results: DataFrame) -> DataFrame:
    """Rows of the newest run of every study and universe."""
    newest = results.groupBy("study", "universe").agg(F.max("run_date").alias("run_date"))
    return results.join(newest, ["study", "universe", "run_date"], "left_semi")


def run_dates(results: DataFrame) -> DataFrame:
    return results.groupBy("study", "universe").agg(F.max("run_date").alias("last_date"), F.countDistinct("run_date").alias("n_runs"))


def actionable_list(results: DataFrame, flag: str = "actionable") -> DataFrame:
    return latest_run(results).where(F.col(flag) == 1)


def export_list(results: DataFrame, securities: DataFrame) -> DataFrame:
    """Chart symbols of the newest runs, comma-joined in rank order; one row per study and universe."""
    rows = latest_run(results).join(securities.select("ticker", "exchange"), "ticker", "left")
    items = F.sort_array(F.collect_list(F.struct("rank", export_symbol("ticker", "exchange").alias("symbol"))))
    return rows.groupBy("study", "universe").agg(F.array_join(F.transform(items, lambda x: x["symbol"]), ",").alias("symbols"))


def read_ranked(results: DataFrame, study: str, universe: str, filters: dict, run_date: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of one run: the run date is chosen first, then exact filters on allowed columns apply."""
    allowed = {"sector", "industry", "commodity", "type", "cap_band", "vol_label", "acc_watch", "regime_label", "rsi_div", "obv_div", "actionable", "high_conv"}
    if bad := set(filters) - allowed:
        raise ValueError(f"cannot filter on {sorted(bad)}")
    rows = results.where((F.col("study") == study) & (F.col("universe") == universe))
    day = rows.agg(F.max("run_date").alias("run_date")) if run_date is None else rows.where(F.col("run_date") == F.lit(run_date)).select("run_date").distinct()
    rows = rows.join(F.broadcast(day), "run_date", "left_semi")
    for k, v in filters.items():
        rows = rows.where(F.col(k) == v)
    return rows.orderBy("rank", "ticker").offset(offset).limit(limit)


def catalog(results: DataFrame, documents: DataFrame, bars: DataFrame) -> DataFrame:
    """What is stored: newest date of every study and universe, versions of every document kind, and the newest bar."""
    studies = results.groupBy("study", "universe").agg(F.max("run_date").alias("date")).select(F.lit("study").alias("what"), F.concat_ws("/", "study", "universe").alias("name"), "date", F.lit(None).cast("long").alias("n"))
    kinds = documents.groupBy("kind").agg(F.max("date").alias("date"), F.count("*").alias("n")).select(F.lit("document").alias("what"), F.col("kind").alias("name"), "date", "n")
    newest = bars.agg(F.max("date").alias("date")).select(F.lit("bars").alias("what"), F.lit("").alias("name"), "date", F.lit(None).cast("long").alias("n"))
    return studies.unionByName(kinds).unionByName(newest)


def store_period_rows(study: DataFrame) -> DataFrame:
    """Rows of a period study as stored: keys, and the other columns as a JSON payload."""
    keys = ["period_label", "period_start", "ticker", "rank"]
    return study.select(*keys, F.to_json(F.struct(*(c for c in study.columns if c not in keys))).alias("payload"))


def read_period_rows(stored: DataFrame, schema: str) -> DataFrame:
    """Stored period rows with the payload's fields of schema as columns."""
    return stored.withColumn("p", F.from_json("payload", schema)).select("period_label", "period_start", "ticker", "rank", "p.*")
