"""Queries of bar access, universes and ingest bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store, universe
from ..sources.stored import LEAST_BUCKETS, BarStore, StoredTable, shared_folder
from ..sources.tables import PREVIOUS_DATE, RUN_DATE, bars, fetch_log, groups, incoming, securities, table
from .ranking import universes
from .sql import ALL_BARS, BARS, CAP, GROUPS, PREV, RUN, SECURITIES

COMMODITY_SPEC = {"filter": {"region": ["AU", "US"], "quote_type": ["EQUITY"], "commodity_any": ["gold", "silver"], "min_market_cap": 1e9}, "benchmark": "per_commodity", "cap_scheme": "commodity"}


def _all(spark, d):
    return bars(spark, d, references=False)


def symbols(spark, d):
    """Symbols of many shapes made from part names and numbers."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    tail = F.element_at(F.array(*map(F.lit, ["", ".AX", "-PA", "-WT", ".L", "=X", "-UN", "-B"])), (k % 8 + 1).cast("int"))
    head = F.when(k % 11 == 0, F.lit("^")).otherwise("")
    return p.select(F.concat(head, F.substring(F.upper("p_brand"), 1, 3), k % 100, tail).alias("ticker"), F.element_at(F.array(*map(F.lit, ["NMS", "NYQ", "ASE", "XXX"])), (k % 4 + 1).cast("int")).alias("exchange"), k.alias("place"), F.col("p_name").alias("name"))


VENDOR_BLOCK = 2000  # tickers of one wide vendor frame


def vendor_frames(spark, d):
    """Wide frames of all instruments, in blocks of columns, as a vendor sends them."""
    tickers = sorted(r[0] for r in securities(spark, d).where("quote_type = 'EQUITY'").select("ticker").collect())  # names only
    cells = _all(spark, d).unpivot(["ticker", "date"], ["open", "close", "adj_close", "volume"], "field", "value").withColumn("name", F.concat_ws("|", "field", "ticker"))
    for at in range(0, len(tickers), VENDOR_BLOCK):
        names = [f"{f}|{t}" for f in ("open", "close", "adj_close", "volume") for t in tickers[at : at + VENDOR_BLOCK]]
        yield cells.where(F.col("ticker").isin(tickers[at : at + VENDOR_BLOCK])).groupBy("date").pivot("name", names).agg(F.first("value"))


EXPORT = ["MKT", "R0", "R1", "R2", "R3", "R4", "I0", "I1", "NONE"]  # columns of an exported matrix; a matrix is an export of named columns


def from_vendor(spark, d):
    """Each frame is written as it comes, so that the driver plans one at a time whatever their number."""
    path, schema = shared_folder(spark, "vendor"), _all(spark, d).schema
    for frame in vendor_frames(spark, d):
        store.bars_from_wide(frame).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def documents(spark, d):
    """Dated texts: the longest comment-like name of each day's orders by priority."""
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("kind"), F.to_date("o_orderdate").alias("date")).agg(F.max(F.concat(F.lit("order "), "o_orderkey")).alias("text"))


def listings(spark, d):
    s = symbols(spark, d)
    k = F.col("place")
    return s.withColumn("quote_type", F.when(k % 9 == 0, F.lit(None)).when(k % 10 == 1, "ETF").otherwise("EQUITY")).withColumn("currency", F.when(k % 13 == 0, "EUR").when(k % 17 == 0, F.lit(None)).otherwise("USD"))


def found(spark, d):
    """What a provider lists: instruments but every fifth, and two unknown ones, with region and currency."""
    s = securities(spark, d).where("quote_type = 'EQUITY'")
    i = F.substring("ticker", 2, 20).cast("long")
    old = s.where(i % 5 != 3).select("ticker", F.concat("name", F.lit(" Ltd")).alias("name"), "exchange", (F.col("market_cap") + 1).alias("market_cap"), "sector", "industry", "region", F.when(i % 4 != 1, "USD").alias("currency"))
    new = spark.createDataFrame([("NEW1", "New One", "NYQ", 5e9, "S1", "N1", "US", "USD"), ("NEW2", None, "ASX", None, None, None, "AU", None)], old.schema)
    return old.unionByName(new)


def diff(spark, d):
    return universe.universe_refresh_diff(found(spark, d), securities(spark, d), fetch_log(spark, d), "2001-11-20")


def _tickers(spark, d):
    """All instruments, and one name that has no bars."""
    return securities(spark, d).where("quote_type = 'EQUITY'").select("ticker").unionByName(spark.createDataFrame([("NONE",)], "ticker string"))


def known(spark, d):
    """Securities as stored before a refresh, with currency and cap band."""
    return securities(spark, d).withColumn("currency", F.when(F.col("region") == "AU", "AUD")).withColumn("cap_band", universe.cap_band("market_cap")).withColumn("benchmark", F.when(F.col("quote_type") == "INDEX", F.col("benchmark")))


def refreshed(spark, d, outage_rows):
    stored = kept(spark, known(spark, d).drop("quote_type").withColumn("delisted_on", F.lit(None).cast("date")), ["ticker"])
    return stored.rewrite(universe.universe_refresh_apply(stored.read().drop("delisted_on"), found(spark, d), diff(spark, d), "2001-11-20", outage_rows)).read().select(*REFRESHED)


REFRESHED = ["ticker", "region", "name", "exchange", "market_cap", "currency", "sector", "industry", "cap_band", "benchmark", "active", "delisted_on"]
STAMP = "2001-07-01 09:00:00"


def stored_documents(spark, d):
    return documents(spark, d).select("kind", "date", "text", F.lit(None).cast("string").alias("payload"), F.to_timestamp(F.lit("2001-01-01 00:00:00")).alias("created"))


def saved_documents(spark, d):
    """Every seventh day's document is written again, and one of a new kind a month is added."""
    old = documents(spark, d)
    again = old.where(F.dayofyear("date") % 7 == 0).select("kind", "date", F.concat("text", F.lit(" again")).alias("text"), F.to_json(F.struct("kind")).alias("payload"))
    new = old.where(F.dayofmonth("date") == 1).select("date").distinct().select(F.lit("monthly").alias("kind"), "date", F.lit("new").alias("text"), F.lit(None).cast("string").alias("payload"))
    return store.save_documents(stored_documents(spark, d), again.unionByName(new), STAMP)


def reviews(spark, d):
    """Contents of reviews, some equal, of which a third is stored already."""
    c = table(spark, d, "orders").select(F.concat_ws("/", "o_orderstatus", F.col("o_custkey") % 50).alias("content"), "o_orderkey")
    old = c.where("o_orderkey % 3 = 0").select("content").distinct().select(F.sha2("content", 256).alias("review_id"), "content", F.to_timestamp(F.lit("2001-01-01 00:00:00")).alias("created"))
    return store.save_reviews(old, c, STAMP)


def record(spark, d):
    settings = spark.createDataFrame([(5, 0.2)], "buy_zone long, stop double")
    return store.run_record({"bars": _all(spark, d), "orders": table(spark, d, "orders")}, settings, "income", "run-1", STAMP)


def upserted(spark, d):
    """Bars after two writes: the last dates pulled again, then another correction of the very last ones, with two new tickers' bars."""
    bars_now = BarStore.create(_all(spark, d), LEAST_BUCKETS).upsert(incoming(spark, d))
    last = incoming(spark, d).where(F.dayofmonth("date") % 2 == 1).withColumn("adj_close", F.col("adj_close") * 1.01)
    new = last.where("ticker in ('I0', 'I1')").withColumn("ticker", F.concat(F.lit("NEW"), "ticker")).withColumn("volume", F.lit(float("nan")))
    return bars_now.upsert(last.unionByName(new)).read().select("ticker", "date", "adj_close", "volume")


def kept(spark, rows, keys):
    """A stored table of rows by a hash of their keys."""
    return StoredTable.keyed(spark, shared_folder(spark, "kept"), keys).create(rows)


def logged(spark, d):
    log = kept(spark, fetch_log(spark, d), ["ticker"])
    return log.rewrite(store.fetch_log_update(log.read(), incoming(spark, d), _tickers(spark, d))).read()


def asked_log(spark, d):
    """The log with two tickers that were never pulled."""
    log = fetch_log(spark, d)
    return log.unionByName(log.where("ticker in ('I0', 'I1')").select(F.concat(F.lit("NEW"), "ticker").alias("ticker"), F.lit(0).cast("long").alias("failures")), allowMissingColumns=True)


def deep_history(spark, d):
    """Every third ticker's long start: some before its stored bars, some in their first year; and one of a ticker without bars."""
    i = F.substring("ticker", 2, 20).try_cast("long")
    start = F.when(i % 2 == 0, "1985-01-01").otherwise("1992-01-01")
    old = securities(spark, d).where((F.col("quote_type") == "EQUITY") & (i % 3 == 0)).select("ticker", F.to_date(start).alias("deep_start"))
    return old.unionByName(spark.createDataFrame([("NEWI0",)], "ticker string").select("ticker", F.to_date(F.lit("1980-06-01")).alias("deep_start")))


def indexed(spark, d):
    flags = kept(spark, groups(spark, d), ["ticker", "group_type", "group_key"])
    provider = spark.createDataFrame([("I1",), ("I2",), ("ZZ",)], "ticker string")
    return flags.rewrite(universe.index_membership(flags.read(), provider, securities(spark, d), "BIG")).read()


def snapshots(spark, d):
    """Members by date: those of two dates, of which the first is written again with fewer."""
    members = universes(spark, d)
    fewer = members.where(F.col("ticker").endswith("1"))
    table = StoredTable(spark, shared_folder(spark, "snapshots"), ["snapshot_date", "universe", "ticker"], "snapshot_date").create(universe.universe_snapshot(members, PREVIOUS_DATE))
    return table.replace(universe.universe_snapshot(members, RUN_DATE)).replace(universe.universe_snapshot(fewer, PREVIOUS_DATE)).read()


QUERIES = {
    "universe_snapshot": snapshots,
    "bars_from_wide": from_vendor,
    "bars_long": lambda s, d: store.bars_long(bars(s, d, False, "2000-01-01", "2000-12-31"), _tickers(s, d), fields=["close", "volume"]),
    "price_matrix": lambda s, d: store.price_matrix(bars(s, d), EXPORT),
    "last_bar_date": lambda s, d: store.last_bar_date(_all(s, d), _tickers(s, d)),
    "coverage": lambda s, d: store.coverage(_all(s, d), _tickers(s, d), "2001-06-20", RUN_DATE),
    "upsert_bars": upserted,
    "dated_document_store": lambda s, d: store.latest_document(documents(s, d)),
    "document_save": saved_documents,
    "document_load": lambda s, d: store.load_document(saved_documents(s, d), "monthly"),
    "document_by_date": lambda s, d: store.load_document(saved_documents(s, d), "monthly", "2000-01-01"),
    "document_dates": lambda s, d: store.document_dates(saved_documents(s, d), "monthly"),
    "run_record": record,
    "review_store": reviews,
    "immutable_runs": lambda s, d: store.immutable_runs(
        table(s, d, "orders").select("o_custkey", "o_orderstatus").distinct(), s.createDataFrame([("none",)], "run_id string")
    ).select("o_custkey", "o_orderstatus", "run_id"),
    "adjustment_drift": lambda s, d: store.adjustment_drift(_all(s, d), incoming(s, d)),
    "refresh_plan": lambda s, d: store.refresh_plan(asked_log(s, d), "2001-11-05", deep_history(s, d)),
    "fetch_log_update": logged,
    "stale_report": lambda s, d: store.stale_report(fetch_log(s, d), securities(s, d)),
    "read_series": lambda s, d: store.read_series(bars(s, d, False, "2001-01-01").select("ticker", "date", "close"), "I1", offset=5, limit=10),
    "region_of": lambda s, d: symbols(s, d).select("place", "ticker", universe.region_of("ticker").alias("region")),
    "odd_line": lambda s, d: symbols(s, d).select("place", "ticker", F.when(universe.odd_line("ticker"), 1).otherwise(0).alias("odd")),
    "export_symbol": lambda s, d: symbols(s, d).select("place", universe.export_symbol("ticker", "exchange").alias("symbol")),
    "cap_band": lambda s, d: securities(s, d).select("ticker", universe.cap_band("market_cap").alias("us"), universe.cap_band("market_cap", "commodity").alias("commodity")),
    "sector_normalise": lambda s, d: table(s, d, "customer").select(
        "c_custkey", universe.sector_normalise(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), F.when(F.col("c_custkey") % 3 == 1, F.lit(" Finance ")).when(F.col("c_custkey") % 6 == 2, "odd")).alias("sector")
    ),
    "universe_members": lambda s, d: universe.members(COMMODITY_SPEC, securities(s, d), groups(s, d)),
    "primary_exposure": lambda s, d: universe.primary_exposure(groups(s, d)),
    "benchmark_map": lambda s, d: universe.primary_exposure(groups(s, d)).select("ticker", universe.benchmark_map("commodity", "per_commodity").alias("benchmark")),
    "theme_members": lambda s, d: universe.theme_members(groups(s, d), securities(s, d), "rot"),
    "fetch_ticker_set": lambda s, d: universe.fetch_ticker_set(universes(s, d), groups(s, d), s.createDataFrame([("X1",)], "ticker string")),
    "universe_summary": lambda s, d: universe.universe_summary(universes(s, d)),
    "security_search": lambda s, d: universe.security_search(securities(s, d), "i1").select("ticker", "name", "active", "market_cap"),
    "security_page": lambda s, d: universe.security_page(securities(s, d), "#0", 5, 40).select("ticker", "name", "quote_type"),
    "listing_clean": lambda s, d: universe.listing_clean(listings(s, d), "US", True).select("ticker", "place"),
    "universe_refresh_diff": diff,
    "universe_refresh_apply": lambda s, d: refreshed(s, d, 1),
    "universe_refresh_outage": lambda s, d: refreshed(s, d, universe.OUTAGE_ROWS),
    "apply_overrides": lambda s, d: universe.apply_overrides(
        groups(s, d), s.createDataFrame([("I0", "index", "BIG")], "ticker string, group_type string, group_key string"),
        s.createDataFrame([("I2", "commodity", "gold", "midstream", 1), ("I5", "role", "macro", None, 3)], groups(s, d).schema),
    ),
    "index_membership": indexed,
}

_SYM = """sym AS (SELECT p_partkey AS k, p_name AS name, (CASE WHEN p_partkey % 11 = 0 THEN '^' ELSE '' END) || substr(upper(p_brand), 1, 3) || (p_partkey % 100) || ['', '.AX', '-PA', '-WT', '.L', '=X', '-UN', '-B'][p_partkey % 8 + 1] AS ticker,
  ['NMS', 'NYQ', 'ASE', 'XXX'][p_partkey % 4 + 1] AS exchange FROM part)"""
_REGION = "CASE WHEN ticker LIKE '%.AX' OR ticker LIKE '^AX%' THEN 'AU' WHEN ticker LIKE '^%' OR ticker LIKE '%=%' THEN 'GLOBAL' WHEN ticker LIKE '%.%' THEN NULL ELSE 'US' END"
_ODD = "CASE WHEN ticker LIKE '%.AX' THEN length(ticker) - 3 > 4 ELSE regexp_matches(ticker, '-(P[A-Z]?|W[ST]?|UN?|RT?)$') END"
_LOG = "lg AS (SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows, CAST(substr(ticker, 2) AS BIGINT) % 12 AS failures FROM bars GROUP BY ticker)"
_INC = "inc AS (SELECT * REPLACE (CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 7 = 0 THEN adj_close * 1.002 ELSE adj_close END AS adj_close) FROM bars WHERE date IN (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 10))"
_PRI = "pri AS (SELECT ticker, first(group_key ORDER BY priority, CASE group_key WHEN 'gold' THEN 0 ELSE 1 END) AS commodity, first(attr ORDER BY priority, CASE group_key WHEN 'gold' THEN 0 ELSE 1 END) AS type FROM groups WHERE group_type = 'commodity' GROUP BY ticker)"
_UNI = f"uni AS (SELECT lower(region) || '_total_market' AS universe, ticker, benchmark, {CAP} AS cap_band FROM securities WHERE active = 1 AND quote_type = 'EQUITY')"
_FOUND = """fnd AS (SELECT ticker, name || ' Ltd' AS name, exchange, market_cap + 1 AS market_cap, sector, industry, region, CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 4 <> 1 THEN 'USD' END AS currency FROM securities
    WHERE quote_type = 'EQUITY' AND CAST(substr(ticker, 2) AS BIGINT) % 5 <> 3
  UNION ALL VALUES ('NEW1', 'New One', 'NYQ', 5e9, 'S1', 'N1', 'US', 'USD'), ('NEW2', NULL, 'ASX', NULL, NULL, NULL, 'AU', NULL))"""
_DIFF = f"""{BARS}, {SECURITIES}, {_LOG}, {_FOUND}, st AS (SELECT ticker FROM securities WHERE active = 1 AND quote_type = 'EQUITY'),
df AS (SELECT coalesce(f.ticker, st.ticker) AS ticker, CASE WHEN st.ticker IS NULL THEN 'new' WHEN f.ticker IS NOT NULL THEN 'updated'
  WHEN EXISTS (SELECT 1 FROM lg WHERE lg.ticker = st.ticker AND failures = 0 AND last_date >= DATE '2001-11-20' - 30) THEN 'kept' ELSE 'deactivate' END AS action FROM fnd f FULL JOIN st ON f.ticker = st.ticker)"""

_BAND = "CASE WHEN {0} > 10000000000 THEN 'large' WHEN {0} >= 2000000000 THEN 'mid' ELSE 'small' END"


def _applied(outage_rows: int) -> str:
    pick = lambda c: f"CASE WHEN hit THEN coalesce(f_{c}, {c}) ELSE {c} END AS {c}"
    return f"""WITH {_DIFF}, up AS (SELECT region AS r FROM fnd GROUP BY region HAVING count(*) >= {outage_rows}),
s0 AS (SELECT *, CASE WHEN region = 'AU' THEN 'AUD' END AS currency, {_BAND.format('market_cap')} AS cap_band FROM securities),
j AS (SELECT coalesce(s.ticker, f.ticker) AS ticker, coalesce(s.region, f.region) AS region, s.region IS NOT NULL AS old, s.name, s.exchange, s.market_cap, s.currency, s.sector, s.industry, s.cap_band, CASE WHEN quote_type = 'INDEX' THEN s.benchmark END AS benchmark, s.active,
  f.name AS f_name, f.exchange AS f_exchange, f.market_cap AS f_market_cap, f.currency AS f_currency, f.sector AS f_sector, f.industry AS f_industry FROM s0 s FULL JOIN fnd f ON s.ticker = f.ticker),
k AS (SELECT j.*, action, r IS NOT NULL AS up, coalesce(r IS NOT NULL AND action IN ('new', 'updated'), false) AS hit FROM j LEFT JOIN df USING (ticker) LEFT JOIN up ON up.r = j.region)
SELECT ticker, region, {pick('name')}, {pick('exchange')}, {pick('market_cap')}, {pick('currency')}, CASE WHEN hit THEN f_sector ELSE sector END AS sector, CASE WHEN hit THEN f_industry ELSE industry END AS industry,
  CASE WHEN hit THEN {_BAND.format('f_market_cap')} ELSE cap_band END AS cap_band, CASE WHEN hit THEN coalesce(benchmark, CASE region WHEN 'AU' THEN '^AXJO' ELSE 'SPY' END) ELSE benchmark END AS benchmark,
  CASE WHEN up AND action = 'deactivate' THEN 0 WHEN hit THEN 1 ELSE active END AS active, CASE WHEN up AND action = 'deactivate' THEN DATE '2001-11-20' END AS delisted_on FROM k WHERE up OR old"""


_DOCS = """d AS (SELECT o_orderpriority AS kind, CAST(o_orderdate AS DATE) AS date, max('order ' || o_orderkey) AS text FROM orders GROUP BY ALL),
sv AS (SELECT kind, date, CASE WHEN dayofyear(date) % 7 = 0 THEN text || ' again' ELSE text END AS text, CASE WHEN dayofyear(date) % 7 = 0 THEN '{"kind":"' || kind || '"}' END AS payload,
  CASE WHEN dayofyear(date) % 7 = 0 THEN TIMESTAMP '2001-07-01 09:00:00' ELSE TIMESTAMP '2001-01-01 00:00:00' END AS created FROM d
  UNION ALL SELECT DISTINCT 'monthly', date, 'new', NULL, TIMESTAMP '2001-07-01 09:00:00' FROM d WHERE dayofmonth(date) = 1)"""

SQL = {
    "document_save": f"WITH {_DOCS} SELECT * FROM sv",
    "document_load": f"WITH {_DOCS} SELECT * FROM sv WHERE kind = 'monthly' ORDER BY date DESC LIMIT 1",
    "document_by_date": f"WITH {_DOCS} SELECT * FROM sv WHERE kind = 'monthly' AND date = DATE '2000-01-01'",
    "document_dates": f"WITH {_DOCS} SELECT date, created FROM sv WHERE kind = 'monthly'",
    "run_record": f"""WITH {BARS} SELECT 'run-1' AS run_id, 'income' AS kind, TIMESTAMP '2001-07-01 09:00:00' AS created, '{{"buy_zone":5,"stop":0.2}}' AS configuration, sha256('{{"buy_zone":5,"stop":0.2}}') AS configuration_version,
  '{{"bars":' || (SELECT count(*) FROM bars) || ',"orders":' || (SELECT count(*) FROM orders) || '}}' AS row_counts""",
    "review_store": """WITH c AS (SELECT o_orderstatus || '/' || (o_custkey % 50) AS content, bool_or(o_orderkey % 3 = 0) AS old FROM orders GROUP BY 1)
SELECT sha256(content) AS review_id, content, CASE WHEN old THEN TIMESTAMP '2001-01-01 00:00:00' ELSE TIMESTAMP '2001-07-01 09:00:00' END AS created FROM c""",
    "security_page": f"WITH {SECURITIES} SELECT ticker, name, quote_type FROM securities WHERE contains(lower(ticker), '#0') OR contains(lower(name), '#0') ORDER BY ticker LIMIT 40 OFFSET 5",
    "bars_from_wide": f"WITH {BARS} SELECT ticker, date, open, CAST(NULL AS DOUBLE) AS high, CAST(NULL AS DOUBLE) AS low, close, adj_close, volume, CAST(NULL AS DOUBLE) AS dividend, CAST(NULL AS DOUBLE) AS split FROM bars",
    "bars_long": f"WITH {BARS} SELECT ticker, date, close, volume FROM bars WHERE date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'",
    "price_matrix": f"WITH {ALL_BARS} SELECT date, {', '.join(f"CAST(first(adj_close) FILTER (ticker = '{t}') AS DOUBLE) AS {t}" for t in EXPORT)} FROM bars GROUP BY date",
    "last_bar_date": f"WITH {BARS} SELECT max(date) AS last_date FROM bars",
    "coverage": f"WITH {BARS}, r AS (SELECT count(DISTINCT s_suppkey // 5) + 1 AS k FROM supplier) SELECT any_value(k) AS requested, count(DISTINCT ticker) AS covered, count(DISTINCT ticker) / any_value(k) >= 0.8 AS passes FROM bars, r WHERE date BETWEEN DATE '2001-06-20' AND {RUN}",
    "upsert_bars": f"""WITH {BARS}, {_INC}, ag AS (SELECT ticker, date, adj_close * 1.01 AS adj_close, volume FROM inc WHERE dayofmonth(date) % 2 = 1)
SELECT b.ticker, b.date, coalesce(ag.adj_close, inc.adj_close, b.adj_close) AS adj_close, b.volume FROM bars b LEFT JOIN inc USING (ticker, date) LEFT JOIN ag ON ag.ticker = b.ticker AND ag.date = b.date
UNION ALL SELECT 'NEW' || ticker, date, adj_close, NULL FROM ag WHERE ticker IN ('I0', 'I1')""",
    "universe_snapshot": f"""WITH {SECURITIES}, m AS (SELECT lower(region) || '_total_market' AS universe, ticker FROM securities WHERE active = 1 AND quote_type = 'EQUITY')
SELECT {RUN} AS snapshot_date, * FROM m UNION ALL SELECT {PREV}, * FROM m WHERE ticker LIKE '%1'""",
    "dated_document_store": "WITH d AS (SELECT o_orderpriority AS kind, CAST(o_orderdate AS DATE) AS date, max('order ' || o_orderkey) AS text FROM orders GROUP BY ALL) SELECT kind, max(date) AS date, arg_max(text, date) AS text, count(*) AS versions FROM d GROUP BY kind",
    "immutable_runs": """SELECT DISTINCT o_custkey, o_orderstatus, sha256('{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS run_id FROM orders""",
    "adjustment_drift": f"WITH {BARS}, {_INC} SELECT DISTINCT ticker FROM bars JOIN inc USING (ticker, date) WHERE abs(inc.adj_close - bars.adj_close) / abs(bars.adj_close) > 0.001",
    "refresh_plan": f"""WITH {BARS}, {_LOG}, al AS (SELECT ticker, first_date, last_date, failures FROM lg UNION ALL SELECT 'NEW' || ticker, NULL, NULL, 0 FROM lg WHERE ticker IN ('I0', 'I1')),
dp AS (SELECT DISTINCT 'I' || (s_suppkey // 5) AS ticker, CASE WHEN s_suppkey // 5 % 2 = 0 THEN DATE '1985-01-01' ELSE DATE '1992-01-01' END AS deep FROM supplier WHERE s_suppkey // 5 % 3 = 0 UNION ALL SELECT 'NEWI0', DATE '1980-06-01'),
a AS (SELECT *, CASE WHEN failures >= 10 THEN 'skip_stale' WHEN deep IS NOT NULL AND (last_date IS NULL OR first_date > make_date(year(deep), 12, 31)) THEN 'reload' WHEN last_date IS NULL THEN 'backfill' WHEN last_date >= DATE '2001-11-02' THEN 'current' ELSE 'incremental' END AS action
  FROM al LEFT JOIN dp USING (ticker))
SELECT ticker, action, CASE action WHEN 'reload' THEN deep WHEN 'backfill' THEN DATE '2001-11-05' - 1100 WHEN 'incremental' THEN CAST(date_trunc('week', last_date - 10) AS DATE) END AS start FROM a""",
    "fetch_log_update": f"""WITH {BARS}, {_LOG}, {_INC}, ask AS (SELECT DISTINCT 'I' || (s_suppkey // 5) AS ticker FROM supplier UNION SELECT 'NONE'), nw AS (SELECT ticker, min(date) AS a, max(date) AS z, count(*) AS k FROM inc GROUP BY ticker)
SELECT coalesce(lg.ticker, ask.ticker) AS ticker, least(first_date, a) AS first_date, greatest(last_date, z) AS last_date, CASE WHEN coalesce(n_rows, k) IS NOT NULL THEN coalesce(n_rows, 0) + coalesce(k, 0) END AS n_rows,
  CASE WHEN ask.ticker IS NULL THEN failures WHEN k > 0 THEN 0 ELSE coalesce(failures, 0) + 1 END AS failures FROM lg FULL JOIN ask ON lg.ticker = ask.ticker LEFT JOIN nw ON nw.ticker = ask.ticker""",
    "stale_report": f"WITH {BARS}, {SECURITIES}, {_LOG} SELECT ticker, name, failures, last_date FROM lg LEFT JOIN securities USING (ticker) WHERE failures >= 3",
    "read_series": f"WITH {BARS} SELECT ticker, date, close FROM bars WHERE ticker = 'I1' AND date >= DATE '2001-01-01' ORDER BY date DESC LIMIT 10 OFFSET 5",
    "region_of": f"WITH {_SYM} SELECT k AS place, ticker, {_REGION} AS region FROM sym",
    "odd_line": f"WITH {_SYM} SELECT k AS place, ticker, CASE WHEN {_ODD} THEN 1 ELSE 0 END AS odd FROM sym",
    "export_symbol": f"WITH {_SYM} SELECT k AS place, CASE WHEN ticker LIKE '%.AX' THEN 'ASX:' || left(ticker, -3) ELSE (CASE exchange WHEN 'NMS' THEN 'NASDAQ' WHEN 'ASE' THEN 'AMEX' ELSE 'NYSE' END) || ':' || replace(ticker, '-', '.') END AS symbol FROM sym",
    "cap_band": f"WITH {SECURITIES} SELECT ticker, {CAP} AS us, CASE WHEN market_cap > 5e9 THEN 'large' WHEN market_cap >= 5e8 THEN 'mid' ELSE 'small' END AS commodity FROM securities",
    "sector_normalise": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN 'Financial Services' ELSE 'Unknown' END AS sector FROM customer",
    "universe_members": f"""WITH {SECURITIES}, {GROUPS}, {_PRI} SELECT ticker, name, region, exchange, quote_type, sector, industry, market_cap, commodity, type, CASE WHEN market_cap > 5e9 THEN 'large' WHEN market_cap >= 5e8 THEN 'mid' ELSE 'small' END AS cap_band,
  CASE commodity WHEN 'gold' THEN 'GDX' ELSE 'SIL' END AS benchmark FROM securities JOIN pri USING (ticker) WHERE active = 1 AND quote_type = 'EQUITY' AND market_cap >= 1e9""",
    "primary_exposure": f"WITH {GROUPS}, {_PRI} SELECT * FROM pri",
    "benchmark_map": f"WITH {GROUPS}, {_PRI} SELECT ticker, CASE commodity WHEN 'gold' THEN 'GDX' ELSE 'SIL' END AS benchmark FROM pri",
    "theme_members": "SELECT DISTINCT 'R' || (s_suppkey // 5 % 5) AS ticker, 'R' || (s_suppkey // 5 % 5) AS name FROM supplier",
    "fetch_ticker_set": f"WITH {SECURITIES}, {GROUPS}, {_UNI} SELECT ticker FROM uni UNION SELECT benchmark FROM uni UNION SELECT ticker FROM groups WHERE group_type = 'theme' UNION SELECT 'X1'",
    "universe_summary": f"WITH {SECURITIES}, {_UNI} SELECT universe, count(*) AS members, count(*) FILTER (cap_band = 'large') AS large, count(*) FILTER (cap_band = 'mid') AS mid, count(*) FILTER (cap_band = 'small') AS small FROM uni GROUP BY universe",
    "security_search": f"WITH {SECURITIES} SELECT ticker, name, active, market_cap FROM securities WHERE quote_type = 'EQUITY' AND (contains(lower(ticker), 'i1') OR contains(lower(name), 'i1')) ORDER BY active DESC, market_cap DESC NULLS LAST, ticker LIMIT 25",
    "listing_clean": f"""WITH {_SYM}, l AS (SELECT *, CASE WHEN k % 9 = 0 THEN NULL WHEN k % 10 = 1 THEN 'ETF' ELSE 'EQUITY' END AS qt, CASE WHEN k % 13 = 0 THEN 'EUR' WHEN k % 17 = 0 THEN NULL ELSE 'USD' END AS cur FROM sym)
SELECT ticker, min(k) AS place FROM l WHERE coalesce(qt, 'EQUITY') = 'EQUITY' AND ({_REGION}) = 'US' AND NOT ({_ODD}) AND coalesce(cur, 'USD') = 'USD' GROUP BY ticker""",
    "universe_refresh_diff": f"WITH {_DIFF} SELECT ticker, action FROM df",
    "universe_refresh_apply": _applied(1),
    "universe_refresh_outage": _applied(universe.OUTAGE_ROWS),
    "apply_overrides": f"""WITH {GROUPS} SELECT * FROM groups WHERE NOT (ticker = 'I0' AND group_key = 'BIG') AND NOT (ticker = 'I2' AND group_key = 'gold') UNION ALL VALUES ('I2', 'commodity', 'gold', 'midstream', 1), ('I5', 'role', 'macro', NULL, 3)""",
    "index_membership": f"WITH {SECURITIES}, {GROUPS} SELECT * FROM groups WHERE group_key <> 'BIG' UNION ALL SELECT ticker, 'index', 'BIG', NULL, 9 FROM securities WHERE ticker IN ('I1', 'I2', 'ZZ')",
}
