"""Literal cases of rules: labels, boundaries, missing values."""

from __future__ import annotations

import datetime as dt
import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from barline.operators import breadth, income, macro, ranking, repair, rotation, text, universe
from barline.plans import streams
from barline.streaming import twins


def one(df):
    return [tuple(r) for r in df.collect()]


def test_region_and_symbols(spark):
    rows = spark.createDataFrame([("bhp.ax",), ("^AXJO",), ("^GSPC",), ("GC=F",), ("ABC.L",), (" aapl ",), ("DX-Y.NYB",), (None,)], "t string")
    assert [r[0] for r in rows.select(universe.region_of("t")).collect()] == ["AU", "AU", "US", "GLOBAL", None, "US", "GLOBAL", "US"]
    odd = spark.createDataFrame([("BAC-PL",), ("X-WT",), ("HGODB.AX",), ("BHP.AX",), ("BRK-B",)], "t string")
    assert [r[0] for r in odd.select(universe.odd_line("t")).collect()] == [True, True, True, False, False]


def test_rs_trend_labels(spark):
    cases = [([1.0, 2.0, 3.0], "STRONG_UP"), ([3.0, 2.0, 1.0], "STRONG_DOWN"), ([1.0, None, 2.0], "STRONG_UP"), ([2.0], "FLAT"), ([1.0, 3.0, 2.0], "FLAT"), ([1.0, 1.0, 2.0], "UP"), ([2.0, 2.0, 1.0], "DOWN"), ([None, None, None], "FLAT")]
    rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v array<double>")
    assert [r[1] for r in rows.select("i", ranking.rs_trend(F.col("v"))).orderBy("i").collect()] == [w for _, w in cases]


def test_peer_median_leaves_oneself_out(spark):
    random.seed(5)
    rows = [(f"T{i}", f"G{i % 4}" if i else "alone", random.choice([None, *np.round(np.random.default_rng(i).normal(size=3), 3).tolist()])) for i in range(40)]
    m = spark.createDataFrame([(t, v) for t, _, v in rows], "ticker string, ret_5 double")
    p = spark.createDataFrame([(t, g) for t, g, _ in rows], "ticker string, sector string")
    got = {r[0]: r[1] for r in ranking.peer_rs_median(m, p, columns=("ret_5",)).collect()}
    for t, g, v in rows:
        others = [w for u, h, w in rows if h == g and u != t and w is not None]
        want = None if v is None else round(v - (float(np.median(others)) if others else 0.0), 4)
        assert got[t] == want or abs(got[t] - want) < 1e-3


def _plain_countdown(c: list[float]) -> list[tuple[int, int]]:
    """Setup and countdown with both sides' switches written out."""
    setup, run, armed, count, out = [], 0, {1: False, -1: False}, {1: 0, -1: 0}, []
    for i in range(len(c)):
        s = 0 if i < 4 else (1 if c[i] < c[i - 4] else -1 if c[i] > c[i - 4] else 0)
        run = 0 if s == 0 else (run + s if run * s > 0 else s)
        setup.append(run)
        if abs(run) == 9:
            side = run // 9
            armed[side], count[side], armed[-side] = True, 0, False
        found = 0
        for side in (1, -1):
            if armed[side] and i >= 2 and ((c[i] < c[i - 2]) if side == 1 else (c[i] > c[i - 2])):
                count[side] += 1
                found, armed[side] = side * count[side], count[side] < 13
        out.append(found)
    return list(zip(setup, out, strict=True))


def _series(nan_at: int | None = None) -> dict[str, list[float]]:
    rng = np.random.default_rng(3)
    made = {f"S{n}": np.round(np.cumsum(rng.normal(0.1, 1, n)) + 50, 1).tolist() for n in (1, 3, 60, 400)}
    made |= {"UP": [float(i) for i in range(60)], "FLAT": [7.0] * 40, "TURN": [*map(float, range(30, 8, -1)), *map(float, range(9, 60))]}
    if nan_at is not None:
        made["GAP"] = [math.nan if i == nan_at else x for i, x in enumerate(made["S60"])]
    return made


def _frame(spark, series):
    return spark.createDataFrame([(t, dt.date(2000, 1, 1) + dt.timedelta(i), x) for t, c in series.items() for i, x in enumerate(c)], "ticker string, date date, c double")


def test_countdown_and_stream_step_agree_with_a_plain_loop(spark):
    series = _series(nan_at=20)
    got = {}
    for r in rotation.td_countdown(_frame(spark, series)).orderBy("ticker", "date").collect():
        got.setdefault(r["ticker"], []).append((r["setup"], r["countdown"]))
    for ticker, c in series.items():
        state = {"last": [], "run": 0, "buy": -1, "sell": -1}
        want = _plain_countdown(c)
        assert got[ticker] == want and [twins.countdown_step(state, x) for x in c] == want
    assert {13, -13} & {k for rows in got.values() for _, k in rows}
    plan = rotation.td_countdown(_frame(spark, series))._jdf.queryExecution().toString()
    assert "InPandas" not in plan
    nulls = spark.createDataFrame([("A", dt.date(2000, 1, d), None) for d in range(1, 7)], "ticker string, date date, c double")
    assert {(r["setup"], r["countdown"]) for r in rotation.td_countdown(nulls).collect()} == {(0, 0)}


def test_stream_countdown_takes_rows_out_of_order_and_drops_those_behind_the_watermark(spark, tmp_path):
    series = _series()
    day = lambda i: dt.date(2000, 1, 1) + dt.timedelta(i)
    rows = [(t, day(i), x) for t, c in series.items() for i, x in enumerate(c)]
    slot = lambda r: min(3, (r[1] - day(0)).days // 100)
    # a row in three of a slice's last week comes a slice later
    batches = [[] for _ in range(4)]
    for k, r in enumerate(rows):
        left = 100 - (r[1] - day(0)).days % 100
        batches[min(3, slot(r) + (left <= 7 and k % 3 == 0))].append(r)
    behind = [("S400", day(2), -1.0), ("NEW", day(3), 5.0)]  # behind the watermark when it comes
    batches[3] += behind
    batches.append([("", day(460), None)])
    np.random.default_rng(5).shuffle(batches[1])
    schema = "ticker string, date date, c double"
    for b in batches:
        spark.createDataFrame([tuple(r) for r in map(tuple, b)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = twins.stream_countdown(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    got = streams.drain(stream, "append")
    assert got.select("batch").distinct().count() >= 4
    want = rotation.td_countdown(_frame(spark, series))
    key = lambda df: sorted(tuple(r) for r in df.select("ticker", "date", "c", "setup", "countdown").collect())
    assert key(got) == key(want)


def test_islands_need_a_clean_quiet_round_trip(spark):
    rng = np.random.default_rng(1)
    calm = (50 * np.exp(np.cumsum(rng.normal(0, 0.005, 80)))).tolist()
    block = lambda by, n: calm[:30] + [by * x for x in calm[30 : 30 + n]] + calm[30 + n :]
    series = {"island": block(2, 3), "calm": calm, "too long": block(1.9, 15), "no clean ratio": block(2.3, 3), "low": [0.001 * x for x in block(2, 3)]}
    rows = [(t, dt.date(2000, 1, 1) + dt.timedelta(i), float(c)) for t, closes in series.items() for i, c in enumerate(closes)]
    found = repair.price_islands(spark.createDataFrame(rows, "ticker string, date date, close double")).collect()
    assert [(r["ticker"], str(r["start"]), str(r["end"]), r["n"], round(r["mult"], 1)) for r in found] == [("island", "2000-01-31", "2000-02-02", 3, 0.5)]


def test_risk_monitor_boundaries(spark):
    base = dict(vix=18.0, vvix=90.0, vix_vvix=0.2, vix_vix3m=0.9, xly_xlp_chg_63d=1.0, rspd_rsps_chg_63d=1.0, risk_ratio_chg_10d=4.0, cyc_iwm_spx_chg_63d=6.0, ad_divergence="BULLISH", hy_spread=3.0)
    edits = [({}, "RISK ON"), ({"vix": 19.99}, "RISK ON"), ({"vix": 20.0}, "CAUTIOUS"), ({"vix": 25.0}, "CAUTIOUS"), ({"vix": 25.01}, "RISK OFF"), ({"hy_spread": 4.0}, "CAUTIOUS"), ({"hy_spread": 6.0}, "RISK OFF")]
    none = {k: None for k in base}
    rows = [(i, *(base | e).values()) for i, (e, _) in enumerate(edits)] + [(99, *none.values())]
    schema = "date int, " + ", ".join(f"{k} {'string' if k == 'ad_divergence' else 'double'}" for k in base)
    got = {r["date"]: r["regime"] for r in macro.risk_monitor(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i] for i in range(len(edits))] == [w for _, w in edits] and got[99] == "INSUFFICIENT DATA"


def test_stop_and_allocation(spark):
    r = spark.createDataFrame([((80 + 5) / 100 - 1,), (-0.2,), (-0.1,), (None,)], "r double")
    assert [x[0] for x in r.select(income.stop_status(F.col("r"))).collect()] == ["NEAR", "HIT", "OK", "not_assessed"]
    prices = spark.createDataFrame([("A", 100.0), ("B", 80.0)], "ticker string, price double")
    assert {x["ticker"]: x["shares"] for x in income.allocation(prices, ["A", "B"], 1000.0, 0.65).collect()} == {"A": 3, "B": 4}


def test_flow_numbers_and_caps(spark):
    rows = spark.createDataFrame([("1,234.5",), ("(93.5)",), ("9199.3*",), ("-",), (None,), ("x",)], "t string")
    assert [r[0] for r in rows.select(macro.flow_number(F.col("t"))).collect()] == [1234.5, -93.5, 9199.3, None, None, None]
    rows = spark.createDataFrame([("$8.14B",), ("2T",), ("N/A",)], "t string")
    assert [r[0] and round(r[0]) for r in rows.select(text.cap_parse(F.col("t"))).collect()] == [8_140_000_000, 2 * 10**12, None]


def test_chunks_carry_whole_words():
    parts = text.pack_paragraphs("\n\n".join(["word " * 100] * 8), 1500, 200)
    assert len(parts) == 4 and all(p.startswith("word") for p in parts)
    assert text.pack_paragraphs("") == [] and text.pack_paragraphs("x" * 5000) == ["x" * 5000]


def test_notices_are_read_from_rows_of_html(spark):
    html = '<table><tr><td>ABC</td><td>01/02/2026 <br>9:30 am</td><td><a href="/x?idsId=0123">\n Change in substantial holding <br></a></td></tr><tr><td>DEF</td><td>02/02/2026</td><td><a href="/y?idsId=9">Other</a></td></tr></table>'
    rows = one(text.notice_parse(spark.createDataFrame([(html,), (None,)], "html string")).select("ann_id", "date", "time", "ticker", "form", "action"))
    assert rows == [("0123", "2026-02-01", "9:30 am", "ABC", "604", "change")]


def test_wide_and_long_breadth_round_trip(spark):
    day = dt.date(2001, 1, 2)
    cells = [("all", "all", "", "total", 5.0), ("all", "cap", "large", "leaders", 2.0), ("all", "sector", "basic_materials", "above200", 1.0), ("sp", "industry", "gold", "total", 1.0), ("sp", "all", "", "above_200", 3.0)]
    long = spark.createDataFrame([(day, "u", *c) for c in cells], "date date, universe string, layer string, group_type string, group_key string, metric string, value double")
    names = [r[0] for r in long.select(breadth.wide_name()).collect()]
    back = breadth.breadth_long(breadth.breadth_wide(long, names)).select(*long.columns)
    assert sorted(one(back)) == sorted(one(long))


def ledger_of(spark, closes, paid, rebalances, **settings):
    """A ledger of the one fund A over days from 2020-01-01, with 1 % interest a day and 100 to begin with."""
    from barline.operators import backtest

    first = dt.date(2020, 1, 1)
    dates = [first + dt.timedelta(i) for i in range(len(closes))]
    bars = spark.createDataFrame([("A", d, c, p) for d, c, p in zip(dates, closes, paid, strict=True) if c is not None] + [("H", d, 2.0 + i, 0.0) for i, d in enumerate(dates)], "ticker string, date date, close double, dividend double")
    signal = settings.pop("signal", [])
    days = spark.createDataFrame([(d, 0.01, i in signal, i in rebalances) for i, d in enumerate(dates)], "date date, rate double, signal boolean, rebalance boolean")
    base = {"config_id": "c", "top_n": 1, "capital": 100.0, "hedge_pct": 0.0, "draw_level": 0.0, "stop_loss": 0.0} | settings
    configs = spark.createDataFrame([tuple(base[f.split()[0]] for f in backtest.CONFIG.split(", "))], backtest.CONFIG)
    if "alone" in settings:
        return backtest.passive(configs.withColumn("ticker", F.lit("A")), bars, days, "H")
    return backtest.Backtest(configs, spark.createDataFrame([("c", dates[i], "A", 1) for i in rebalances], "config_id string, date date, ticker string, place int"), bars, days, "H")


def test_ledger_by_hand(spark):
    book = ledger_of(spark, [10.0, 11.0, 8.0, 7.0, 7.0], [0.0, 1.0, 0.0, 0.0, 0.0], [0], stop_loss=0.15)
    got = book.days().orderBy("date").collect()
    # interest, all in at 10; a payout of 10.1; 8 + 1 is 10 % down, 7 + 1 is 20 % down: stopped, then cash earns interest
    assert [r["value"] for r in got] == [101.0, 121.2, 91.0, 81.0, 81.81]
    assert [r["n_held"] for r in got] == [1, 1, 1, 0, 0] and got[-1]["stops"] == 1 and got[-1]["income_cum"] == 10.1
    assert [(str(r["date"]), r["ticker"], r["total_return"]) for r in book.stops().collect()] == [("2020-01-04", "A", -20.0)]


def test_ledger_draws_and_hedges(spark):
    book = ledger_of(spark, [10.0, 20.0, 20.0, 20.0], [0.0] * 4, [0, 1], draw_level=120.0)
    assert [r["withdrawn_cum"] for r in book.days().orderBy("date").collect()] == [0.0, 82.0, 82.0, 82.0]
    assert [(r["holdings"], r["withdrawn"]) for r in book.quarters().orderBy("date").collect()] == [("A", 0.0), ("A", 82.0)]
    hedged = ledger_of(spark, [10.0] * 4, [0.0] * 4, [0], hedge_pct=0.5, signal=[1, 2])
    # half of 101 into H at 3, worth 4 the next day and sold at 5: 50.5 / 3 * 2 gained
    assert [r["value"] for r in hedged.days().orderBy("date").collect()] == [101.0, 101.0, 117.83, 134.67]
    total = hedged.totals().collect()[0]
    assert total["hedge_days"] == 2 and abs(total["hedge_pnl"] - 50.5 / 3 * 2) < 1e-9


def test_passive_ledger_keeps_its_cash_until_there_is_a_price(spark):
    book = ledger_of(spark, [None, None, 10.0, 20.0], [0.0] * 4, [0, 3], alone=True, draw_level=50.0)
    got = book.days().orderBy("date").collect()
    # interest until the second rebalance; only there, with a price, is it drawn down
    assert [r["value"] for r in got] == [101.0, 102.01, 103.03, 50.0] and [r["withdrawn_cum"] for r in got] == [0.0, 0.0, 0.0, 54.06]


def test_rsi_of_a_long_history_equals_the_recursion(spark):
    from barline.operators import metrics

    rng = np.random.default_rng(12)
    price = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 20_000)))
    price[5000:7500] = price[5000] * 1.0001 ** np.arange(2500)  # rises alone for more than two blocks
    frame = spark.range(20_000).select(F.lit("A").alias("ticker"), F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.element_at(F.lit(price.tolist()), (F.col("id") + 1).cast("int")).alias("adj_close"))
    got = {r["date"]: r["rsi"] for r in metrics.rsi_history(frame, "2010-01-01").collect()}
    move, up, down = np.diff(price), 0.0, 0.0
    for i, d in enumerate(move, 1):
        gain, loss = max(d, 0.0), max(-d, 0.0)
        up, down = (gain, loss) if i == 1 else (up * 13 / 14 + gain / 14, down * 13 / 14 + loss / 14)
        if i >= 14:
            want = 100.0 if down == 0 else 100 - 100 / (1 + up / down)
            assert abs(got[dt.date(1950, 1, 1) + dt.timedelta(i)] - want) < 1e-9


def test_notices_keep_odd_dates_and_tell_ceasing_from_change(spark):
    row = '<tr><td>ABC</td><td>{d}<br><span class="dates-time">7:30 pm</span></td><td></td><td><a href="/asx/v2/statistics/displayAnnouncement.do?display=pdf&amp;idsId={n}">\n{t}<br></a></td></tr>'
    pages = [row.format(d="31/02/2001", n=1, t="Ceasing to be a substantial holder - change in substantial holding") + row.format(d="01/03/2001", n=2, t="Change in substantial holding"), row.format(d="01/03/2001", n=3, t="Appendix"), None]
    got = sorted(one(text.notice_parse(spark.createDataFrame([(p,) for p in pages], "html string")).select("ann_id", "date", "form", "action", "pdf_url")))
    url = "https://www.asx.com.au/asx/v2/statistics/displayAnnouncement.do?display=pdf&idsId="
    assert got == [("1", "31/02/2001", "605", "cease", url + "1"), ("2", "2001-03-01", "604", "change", url + "2")]


def test_payout_slope_on_a_rounding_border_has_the_digits_of_sql(spark):
    series = {
        "A": [3, 4, 1, 6, 2, 2, 7, 7, 8], "B": [3, 4, 6, 6, 1, 1, 8, 4, 7], "C": [3, 2, 4, 3, 6, 5, 4, 7, 6], "D": [5, 4, 2, 2, 5, 6, 5, 7, 4], "E": [8, 6, 8, 7, 4, 2, 2, 2, 1], "F": [6, 6, 8, 6, 6], "G": [5], "H": [],
    }
    start = dt.date(2001, 1, 1)
    rows = [(t, start + dt.timedelta(days=i), 10.0 + i % 7, p[i // 5] / 100.0 if i % 5 == 0 and i // 5 < len(p) else 0.0) for t, p in series.items() for i in range(63)]
    got = income.fund_metrics(spark.createDataFrame(rows, "ticker string, date date, close double, dividend double").repartition(3), "2001-06-30")
    got = {r.ticker: (r.dist_slope, r.dist_consist, r.n_dists) for r in got.collect()}
    con = duckdb.connect()
    for t, p in series.items():
        con.execute("CREATE OR REPLACE TABLE pays AS SELECT unnest(?::DOUBLE[]) AS pay, unnest(range(1, ?)) AS k", [[x / 100.0 for x in p], len(p) + 1])
        want = con.execute("SELECT round(regr_slope(pay, k) / avg(pay) * 100, 2), round(greatest(0.0, least(1.0, 1.0 - stddev_pop(pay) / avg(pay))), 2) FROM pays").fetchone()
        assert got[t] == ((*want, len(p)) if len(p) >= 4 else (0.0, 0.0, len(p)))
