"""Stored tables: two upserts and a guarded write read back, untouched files stay, a failed write leaves the old rows; plans on the bar store."""

from __future__ import annotations

import datetime as dt
import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from barline.operators import breadth, metrics, store
from barline.plans import store as store_plans
from barline.sources.stored import BarStore, StoredTable, shared_folder
from barline.sources.tables import BAR_COLUMNS

BAR = "ticker string, date date, open double, high double, low double, close double, adj_close double, volume double, dividend double, split double"


def some_bars(spark, tickers=12, days=900, first=dt.date(1998, 11, 1)):
    rows = spark.range(tickers).select(F.concat(F.lit("T"), "id").alias("ticker")).crossJoin(spark.range(days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("date")))
    price = 50 + F.pmod(F.xxhash64("ticker", "date"), F.lit(1000)) / 100
    return rows.select("ticker", "date", *(price.alias(c) for c in ("open", "high", "low", "close", "adj_close")), F.lit(10.0).alias("volume"), F.lit(0.0).alias("dividend"), F.lit(0.0).alias("split"))


def files_of(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(path.removeprefix("file://") + "/**/*.parquet", recursive=True)}


def local(path):
    return path.removeprefix("file://")


def plan_of(frame):
    """The plan as it ran, with its partition filters."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_bars_survive_two_upserts_and_untouched_years_keep_their_files(spark):
    bars = BarStore.create(some_bars(spark), 4)
    where = spark.sql(f"DESCRIBE FORMATTED {bars.name}").where("col_name = 'Location'").first()["data_type"].replace("file:/", "/").replace("///", "/")
    before = files_of(where)
    row = lambda t, day, price: (t, dt.date.fromisoformat(day), *[price] * 5, 1.0, 0.0, float("nan"))
    first = spark.createDataFrame([row("T1", "1999-03-04", 7.0), row("NEW", "2000-01-03", 8.0), row("NEW", "2000-01-03", 8.0)], BAR)
    second = spark.createDataFrame([row("T1", "1999-03-04", 9.0), row("T2", "1999-03-05", 6.0)], BAR)
    bars.upsert(first).upsert(second)
    got = {(r["ticker"], str(r["date"])): r for r in bars.read().where("close < 40").collect()}
    assert {k: r["close"] for k, r in got.items()} == {("T1", "1999-03-04"): 9.0, ("NEW", "2000-01-03"): 8.0, ("T2", "1999-03-05"): 6.0}
    assert all(r["split"] is None for r in got.values())
    assert bars.read().count() == 12 * 900 + 1 and bars.read().select("ticker", "date").distinct().count() == 12 * 900 + 1
    after = files_of(where)
    same = lambda year: {f: t for f, t in before.items() if f"year={year}" in f} == {f: t for f, t in after.items() if f"year={year}" in f}
    assert same(1998) and same(2001) and not same(1999) and not same(2000)
    # the rewritten years are bucketed as before: one file holds one bucket
    assert all(re.search(r"_0000[0-3]\.", f) for f in after)


def test_windows_by_ticker_read_the_store_without_an_exchange(spark):
    bars = BarStore.create(some_bars(spark), 4)
    plan = plan_of(metrics.metric_block(bars.read("1999-04-01", "2001-03-31"), "2001-03-31"))
    assert "Window" in plan and "Exchange hashpartitioning(ticker" not in plan
    plan = plan_of(store.bars_long(bars.read("2000-02-01", "2000-05-31"), spark.createDataFrame([("T1",)], "ticker string")))
    assert re.search(r"PartitionFilters: \[[^\]]*year#\d+ >= 2000\)[^\]]*year#\d+ <= 2000\)", plan) and "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date" in plan
    assert bars.read("2000-02-01", "2000-02-03").count() == 36 and bars.read("2000-02-01").columns == BAR_COLUMNS


def test_keyed_table_rewrites_touched_parts_only(spark):
    path = shared_folder(spark, "keyed")
    log = spark.range(200).select(F.concat(F.lit("T"), "id").alias("ticker"), F.lit(0).alias("failures"))
    kept = StoredTable.keyed(spark, path, ["ticker"]).create(log)
    before = files_of(path)
    kept.upsert(spark.createDataFrame([("T7", 1), ("X", 2)], "ticker string, failures int")).upsert(spark.createDataFrame([("T7", 3)], "ticker string, failures int"))
    assert sorted(map(tuple, kept.read().where("failures > 0").collect())) == [("T7", 3), ("X", 2)] and kept.read().count() == 201
    after = files_of(path)
    touched = {os.path.dirname(f) for f in after if before.get(f) != after[f]}
    assert 1 <= len(touched) <= 2 and len({os.path.dirname(f) for f in before}) == 16
    kept.rewrite(kept.read().where("ticker <> 'X'"))
    assert kept.read().count() == 200
    kept.rewrite(kept.read().where("ticker = 'T7'"))
    assert [tuple(r) for r in kept.read().collect()] == [("T7", 3)]


def test_failed_write_leaves_the_old_rows(spark):
    path = shared_folder(spark, "failing")
    kept = StoredTable(spark, path, ["date", "metric"], "date").create(spark.createDataFrame([(dt.date(2001, 1, 2), "total", 1.0)], "date date, metric string, value double"))
    bad = spark.createDataFrame([(dt.date(2001, 1, 2), "total", "x")], "date date, metric string, value string").withColumn("value", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        kept.replace(bad)
    assert [tuple(r) for r in kept.read().select("date", "metric", "value").collect()] == [(dt.date(2001, 1, 2), "total", 1.0)]


def test_guarded_breadth_write_reads_back(spark):
    day = lambda k: dt.date(2001, 1, 1) + dt.timedelta(k)
    rows = lambda values: spark.createDataFrame([(day(k), "u", "all", "all", "", m, v) for k, v in values for m in ("total", "up")], "date date, universe string, layer string, group_type string, group_key string, metric string, value double")
    kept = StoredTable(spark, shared_folder(spark, "breadth"), ["universe", "date", "layer", "group_type", "group_key", "metric"], "year", F.year("date")).create(rows([(k, 100.0) for k in range(10)]))
    breadth.store_breadth(kept, rows([(9, 95.0), (10, 50.0), (11, 99.0)]))
    got = {(r["date"] - day(0)).days: r["value"] for r in kept.read().where("metric = 'total'").collect()}
    assert got == {k: 100.0 for k in range(9)} | {9: 95.0, 11: 99.0}  # the day of half the tickers is not written


def test_wide_frames_open_without_an_exchange_and_are_planned_one_at_a_time(spark, sf, monkeypatch):
    day, nan = dt.date(2001, 1, 2), float("nan")
    wide = spark.createDataFrame(
        [(day, 1.0, 2.0, 5, None, 3.0, 9.0), (dt.date(2001, 1, 3), None, nan, 6, 4.0, nan, 9.0)], "date date, `open|A.X` double, `close|A.X` double, `volume|A.X` long, `close|B` double, `open|B` double, `open|C` double"
    )
    long = store.bars_from_wide(wide)
    assert sorted(map(tuple, long.collect())) == [("A.X", day, 1.0, None, None, 2.0, None, 5.0, None, None), ("B", dt.date(2001, 1, 3), None, None, None, 4.0, None, None, None, None)]
    plan = long._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Expand" not in plan
    monkeypatch.setattr(store_plans, "VENDOR_BLOCK", 1)
    rows = store_plans.from_vendor(spark, sf)
    assert "Union" not in rows._jdf.queryExecution().toString()
    assert rows.select("ticker").distinct().count() > 1
