"""Queries of reads, flags and label tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import drawdown, macro, ranking, universe
from ..sources.tables import bars, groups, securities, table
from . import macro as macro_plans
from .ranking import RESULTS, results, universes
from .sql import GROUPS, SECURITIES
from .store import documents
from .studies import _STUDY, study

_NAMES = ["Goldman Iron ore", "Big Copper Co", "Silver Nickel", "plain", None]
_INDUSTRIES = ["Gold", "Other Industrial Metals & Mining", "Oil & Gas Midstream", "Banks", None]


def named(spark, d):
    """Securities with telling names and industries."""
    i = F.substring("ticker", 2, 20).try_cast("long")
    pick = lambda values, k: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (k % len(values) + 1).cast("int"))
    return securities(spark, d).where("quote_type = 'EQUITY'").withColumn("name", pick(_NAMES, i)).withColumn("industry", pick(_INDUSTRIES, F.floor(i / 2)))


def sectors(spark, d):
    c = table(spark, d, "customer")
    names = list(drawdown.AU_SECTOR_BENCHMARK) + ["Health Care", "nothing"]
    region = F.element_at(F.array(F.lit("AU"), F.lit("US"), F.lit(None).cast("string")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return c.select("c_custkey", F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % len(names) + 1).cast("int")).alias("sector"), region.alias("region"))


def readings(spark, d):
    p = macro_plans.pair(spark, d)
    cells = p.select("date", (F.col("a") / 1000 + 2).alias("unemployment"), F.when(F.dayofyear("date") % 5 != 0, F.col("a") / 250 + 35).alias("pmi"), (F.col("b") / 100 + 40).alias("consumer_sentiment"))
    return cells.unpivot(["date"], ["unemployment", "pmi", "consumer_sentiment"], "key", "value")


def reports(spark, d):
    p = macro_plans.pair(spark, d).select("date", rnd("a", 2).alias("a"), rnd("b", 2).alias("b"), F.dayofyear("date").alias("n"))
    text = F.concat(F.lit("VIX: "), "a", F.lit("\nVIX/VVIX: 0.2\nXLY/XLP ratio: "), "b", F.lit(" | "), F.when(F.col("n") % 2 == 0, "▼").otherwise("▲"), F.lit(" 1.5% 5d, -2.25% 63d\nA/D Line: → CONFIRMING x \n"))
    snapshot = F.when(F.col("n") % 3 == 0, F.create_map(F.lit("vix"), F.lit("7.5"), F.lit("xly_xlp"), F.lit(None).cast("string")))
    return p.select("date", text.alias("text"), snapshot.alias("snapshot"))


def candidates(spark, d):
    g = groups(spark, d).select("ticker").distinct().where("ticker like 'I%'")
    return g.select("ticker", F.lit("copper").alias("commodity"), F.lit(None).cast("string").alias("primary_type")).unionByName(g.select("ticker", F.lit("gold").alias("commodity"), F.lit("royalty").alias("primary_type")))


def watchlists(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    ticker = F.concat(F.lit(" T"), k % 50, F.when(k % 7 == 0, ".L").when(k % 3 == 0, ".AX ").otherwise(""))
    first = p.where(k % 2 == 0).groupBy(ticker.alias("ticker ")).agg(F.min("p_name").alias("name"), F.lit("Gold").alias("commodity"), F.lit("Miners & Producers").alias("type"), F.lit("10").alias("market_cap"))
    later = p.where(k % 5 != 0).groupBy(ticker.alias("ticker")).agg(F.max("p_brand").alias("name"), F.lit("").alias("market_cap"), F.max("p_type").alias("industry"))
    return universe.import_watchlists([first, later])


def csv_lines(spark, d):
    o = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("c"))
    rows = o.select((F.datediff("date", F.lit("1990-01-01").cast("date")) + 10).alias("n"), F.concat_ws(",", F.date_format("date", "d/M/yyyy"), F.col("c").cast("string"), F.when(F.col("n") % 4 == 0, "").otherwise(F.col("n").cast("string"))).alias("line"))
    head = spark.createDataFrame([(1, "F1 Table"), (2, "Title,Customers,Orders of the day,Orders again"), (3, "Units,a,b,c"), (4, "Series ID,X,Y,Z")], "n int, line string")
    return head.unionByName(rows)


QUERIES = {
    "summary_apply": lambda s, d: universe.summary_apply(groups(s, d), candidates(s, d)),
    "import_watchlists": lambda s, d: watchlists(s, d)[0],
    "import_watchlist_flags": lambda s, d: watchlists(s, d)[1],
    "commodity_benchmark": lambda s, d: groups(s, d).where("group_type = 'commodity'").select("ticker", "group_key", drawdown.commodity_benchmark(F.initcap("group_key")).alias("benchmark")),
    "table_csv_series": lambda s, d: macro.table_csv_series(csv_lines(s, d), "orders of"),
    "commodity_flags": lambda s, d: universe.commodity_flags(named(s, d), groups(s, d)),
    "sector_benchmark": lambda s, d: sectors(s, d).select("c_custkey", drawdown.sector_benchmark(F.col("sector"), F.col("region")).alias("benchmark")),
    "catalog": lambda s, d: ranking.catalog(results(s, d), documents(s, d), bars(s, d)),
    "read_period_rows": lambda s, d: ranking.read_period_rows(ranking.store_period_rows(study(s, d)), "ret_period double, score double, rs_trend string"),
    "cycle_phase": lambda s, d: macro.cycle_phase(bars(s, d).where("ticker = 'MKT'").withColumn("date", F.add_months("date", 180))),
    "status_bands": lambda s, d: macro.status_bands(readings(s, d)),
    "report_parse": lambda s, d: macro.report_parse(reports(s, d)),
}

_PICK = lambda values, k: f"[{', '.join('NULL' if v is None else chr(39) + v + chr(39) for v in values)}][{k} % {len(values)} + 1]"
_MAP = lambda table, x: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"
_MINE = "(industry LIKE '%Mining%' OR industry LIKE '%Metals%' OR industry IN ('Gold', 'Silver', 'Copper', 'Uranium'))"
_FLAGS = " UNION ALL ".join(
    [f"SELECT ticker, '{k}' AS group_key, '{t}' AS attr, 0 AS src FROM nm WHERE industry = '{i}'" for i, (k, t) in universe.INDUSTRY_COMMODITY.items()]
    + [f"SELECT ticker, '{k}', 'producer', 1 FROM nm WHERE contains(lower(name), '{w}') AND {_MINE}" for w, k in universe.NAME_COMMODITY.items()]
)
_AU, _US = _MAP(drawdown.AU_SECTOR_BENCHMARK, "sector"), _MAP(drawdown.US_SECTOR_BENCHMARK, "sector")
_PHASES = " UNION ALL ".join(
    f"SELECT date, '{k}' AS cycle, round(y - {turn}, 4) AS years, CASE {' '.join(f'WHEN y - {turn} >= {a} AND y - {turn} < {b} THEN {chr(39)}{p}{chr(39)}' for a, b, p in phases)} ELSE '{last}' END AS phase FROM dy"
    for k, (turn, phases, last) in macro.CYCLES.items()
)
_PAIR = macro_plans._P

SQL = {
    "summary_apply": f"""WITH {GROUPS}, tk AS (SELECT DISTINCT ticker FROM groups WHERE ticker LIKE 'I%'), pr AS (SELECT ticker, first(group_key ORDER BY priority, CASE group_key WHEN 'gold' THEN 0 ELSE 1 END) AS k FROM groups WHERE group_type = 'commodity' GROUP BY ticker)
SELECT g.ticker, group_type, group_key, attr, CASE WHEN group_type = 'commodity' AND group_key = pr.k THEN 0 ELSE priority END AS priority FROM groups g LEFT JOIN pr ON pr.ticker = g.ticker
UNION ALL SELECT ticker, 'commodity', 'copper', 'producer', 9 FROM tk
UNION ALL SELECT ticker, 'commodity', 'gold', 'royalty', 9 FROM tk WHERE ticker NOT IN (SELECT ticker FROM groups WHERE group_type = 'commodity' AND group_key = 'gold')""",
    "import_watchlists": """WITH p AS (SELECT *, p_partkey AS k, 'T' || (p_partkey % 50) || CASE WHEN p_partkey % 7 = 0 THEN '.L' WHEN p_partkey % 3 = 0 THEN '.AX' ELSE '' END AS ticker FROM part),
a AS (SELECT ticker, min(p_name) AS name FROM p WHERE k % 2 = 0 GROUP BY ticker), b AS (SELECT ticker, max(p_brand) AS name, max(p_type) AS industry FROM p WHERE k % 5 <> 0 GROUP BY ticker)
SELECT coalesce(a.ticker, b.ticker) AS ticker, CASE WHEN coalesce(a.ticker, b.ticker) LIKE '%.AX' THEN 'AU' ELSE 'US' END AS region, coalesce(a.name, b.name) AS name, CASE WHEN a.ticker IS NOT NULL THEN '10' END AS market_cap, industry, 1 AS active
FROM a FULL JOIN b ON a.ticker = b.ticker WHERE coalesce(a.ticker, b.ticker) NOT LIKE '%.L'""",
    "import_watchlist_flags": """SELECT DISTINCT ticker, 'commodity' AS group_type, 'gold' AS group_key, 'producer' AS attr FROM (
  SELECT p_partkey AS k, 'T' || (p_partkey % 50) || CASE WHEN p_partkey % 7 = 0 THEN '.L' WHEN p_partkey % 3 = 0 THEN '.AX' ELSE '' END AS ticker FROM part) WHERE k % 2 = 0 AND ticker NOT LIKE '%.L'""",
    "commodity_benchmark": f"WITH {GROUPS} SELECT ticker, group_key, CASE group_key WHEN 'gold' THEN 'GDX' ELSE 'SIL' END AS benchmark FROM groups WHERE group_type = 'commodity'",
    "table_csv_series": "SELECT CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1 HAVING count(*) % 4 <> 0 ORDER BY 1 DESC LIMIT 20",
    "commodity_flags": f"""WITH {SECURITIES}, {GROUPS}, nm AS (SELECT ticker, {_PICK(_NAMES, "CAST(substr(ticker, 2) AS BIGINT)")} AS name, {_PICK(_INDUSTRIES, "(CAST(substr(ticker, 2) AS BIGINT) // 2)")} AS industry FROM securities
  WHERE quote_type = 'EQUITY' AND active = 1), fl AS ({_FLAGS}) SELECT ticker, 'commodity' AS group_type, group_key, arg_min(attr, src) AS attr FROM fl
WHERE NOT EXISTS (SELECT 1 FROM groups g WHERE g.ticker = fl.ticker AND g.group_type = 'commodity' AND g.group_key = fl.group_key) GROUP BY ticker, group_key""",
    "sector_benchmark": f"""WITH s AS (SELECT c_custkey, {_PICK([*drawdown.AU_SECTOR_BENCHMARK, 'Health Care', 'nothing'], 'c_custkey')} AS sector, ['AU', 'US', NULL][c_custkey % 3 + 1] AS region FROM customer)
SELECT c_custkey, CASE region WHEN 'AU' THEN {_AU} WHEN 'US' THEN {_US} ELSE coalesce({_AU}, {_US}) END AS benchmark FROM s""",
    "catalog": f"""WITH {RESULTS}, dc AS (SELECT o_orderpriority AS kind, CAST(o_orderdate AS DATE) AS date FROM orders GROUP BY ALL) SELECT 'study' AS what, study || '/' || universe AS name, max(run_date) AS date, CAST(NULL AS BIGINT) AS n FROM res GROUP BY study, universe
UNION ALL SELECT 'document', kind, max(date), count(*) FROM dc GROUP BY kind UNION ALL SELECT 'bars', '', max(date), NULL FROM bars""",
    "read_period_rows": f"WITH {_STUDY} SELECT period_label, period_start, ticker, rank, ret_period, score, rs_trend FROM study",
    "cycle_phase": f"WITH {macro_plans.ALL_BARS}, dy AS (SELECT DISTINCT date, year(date) + (month(date) - 1) / 12 AS y FROM (SELECT CAST(date + INTERVAL 180 MONTH AS DATE) AS date FROM bars WHERE ticker = 'MKT')) {_PHASES}",
    "status_bands": f"""{_PAIR}, x AS (SELECT date, 'unemployment' AS key, a / 1000 + 2 AS value FROM pr UNION ALL SELECT date, 'pmi', CASE WHEN dayofyear(date) % 5 <> 0 THEN a / 250 + 35 END FROM pr UNION ALL SELECT date, 'consumer_sentiment', b / 100 + 40 FROM pr)
SELECT date, key, value, CASE WHEN value IS NULL THEN NULL WHEN key = 'unemployment' THEN CASE WHEN value > 5 THEN 'ELEVATED' WHEN value > 4.5 THEN 'RISING' WHEN value > 4 THEN 'TICKING UP' ELSE 'LOW' END
  WHEN key = 'pmi' THEN CASE WHEN value < 45 THEN 'CONTRACTION' WHEN value < 50 THEN 'SLOWING' WHEN value < 55 THEN 'EXPANSION' ELSE 'STRONG EXPANSION' END
  ELSE CASE WHEN value < 60 THEN 'VERY LOW' WHEN value < 75 THEN 'WEAK' WHEN value < 90 THEN 'MODERATE' ELSE 'STRONG' END END AS status FROM x""",
    "report_parse": f"""{_PAIR} SELECT date, CASE WHEN dayofyear(date) % 3 = 0 THEN CAST(7.5 AS DOUBLE) ELSE round(a, 2) END AS vix, CAST(NULL AS DOUBLE) AS vvix, CAST(0.2 AS DOUBLE) AS vix_vvix, CAST(NULL AS DOUBLE) AS hy_spread, CASE WHEN dayofyear(date) % 3 <> 0 THEN round(b, 2) END AS xly_xlp,
  CASE WHEN dayofyear(date) % 2 = 0 THEN CAST(-1.5 AS DOUBLE) ELSE 1.5 END AS xly_xlp_chg_5d, CAST(-2.25 AS DOUBLE) AS xly_xlp_chg_63d, CAST(NULL AS DOUBLE) AS rspd_rsps, CAST(NULL AS DOUBLE) AS rspd_rsps_chg_5d, CAST(NULL AS DOUBLE) AS rspd_rsps_chg_63d, CAST(NULL AS DOUBLE) AS risk_ratio,
  CAST(NULL AS DOUBLE) AS risk_ratio_chg_5d, CAST(NULL AS DOUBLE) AS risk_ratio_chg_10d, 'CONFIRMING x' AS ad_divergence FROM pr""",
}
