"""Queries of repairs and text jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import chain
from ..operators import repair, text
from ..sources.tables import bars, securities, table
from .sql import BARS, SECURITIES


BLOCKS = [2.0, 3.0, 4.0, 5.0, 8.0, 10.0, 2.5, 1.7]  # the last two are no island: not a clean ratio, too small a jump
SPLITS = [2.0, 0.5, 3.0, 1.2, 10.0, 0.1]  # 1.2 is too small to be looked for


def _calm(spark, d):
    """Stored bars with each ticker's number t and its bars' ordinals i: of every five tickers one at its stored prices, one on a calm
    scale at the least price that islands have, and three on a calm scale around 50."""
    b = bars(spark, d, references=False)
    i = F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1
    t, calm = F.substring("ticker", 2, 20).cast("int"), 50 + (F.col("close") - 1500) / 49999
    price = F.when(t % 5 == 1, F.col("close")).when(t % 5 == 2, calm / 500).otherwise(calm)
    return b.select("ticker", "date", price.alias("price"), "volume", t.alias("t"), i.alias("i"))


def _pick(values, k):
    return F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))


def glitched(spark, d):
    """Two blocks a ticker at another scale: their place, length (1 to 12 bars), ratio and direction vary by ticker."""
    t, i = F.col("t"), F.col("i")
    first = 100 + (t * 37) % 300
    one, two = i.between(first, first + t % 12), i.between(first + 400, first + 400 + (t * 5) % 10)
    lift = F.when(one, _pick(BLOCKS, t % 8)).when(two, _pick(BLOCKS, (t + 3) % 8)).otherwise(1.0)
    b = _calm(spark, d).withColumn("lift", F.when(t % 3 == 0, 1 / lift).otherwise(lift))
    price = F.col("price") * F.col("lift")
    return b.select("ticker", "date", *(price.alias(c) for c in repair.SCALED), (F.col("volume") / F.col("lift")).alias("volume"), F.lit(0.0).alias("dividend"), F.lit(0.0).alias("split"))


def split_bars(spark, d):
    """A split filed for every ticker, some bars away from its day and for some twice: never applied, applied, applied but for one
    bar, or never applied and with bars of both scales around it."""
    t, i = F.col("t"), F.col("i")
    day, ratio, state = 200 + (t * 53) % 600, _pick(SPLITS, t % 6), t % 4
    old = chain([(state == 0, i < day), (state == 1, F.lit(False)), (state == 2, i == day + 3)], ((i < day) & (i != day - 3)) | (i == day + 2) | (i == day + 4))
    filed = (i == day + t % 5 - 2) | ((t % 7 == 3) & (i == day + t % 5 + 1))
    b = _calm(spark, d).select("ticker", "date", (F.col("price") * F.when(old, ratio).otherwise(1.0)).alias("price"), "volume", F.when(filed, ratio).otherwise(0.0).alias("split"))
    return b.select("ticker", "date", *(F.col("price").alias(c) for c in repair.SCALED), "volume", F.lit(0.0).alias("dividend"), "split")


def islands_summary(spark, d):
    return repair.price_islands(glitched(spark, d)).select("ticker", "start", "end", "n", F.round("mult", 2).alias("mult"))


def paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def vectors(spark, d):
    e = table(spark, d, "embeddings")
    v = [c for c, t in e.dtypes if t.startswith("array")][0]
    return e.select("vec_id", F.concat(F.lit("s"), "label").alias("source"), F.col(v).alias("v"))


def notices(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        (F.col("o_orderkey") % 5000).cast("string").alias("ann_id"), F.to_date("o_orderdate").alias("date"), F.concat(F.lit("I"), F.col("o_custkey") % 40).alias("ticker"),
        F.element_at(F.array(*map(F.lit, ["initial", "change", "cease"])), (F.col("o_custkey") % 3 + 1).cast("int")).alias("action"), F.col("o_orderpriority").alias("holder"), F.col("o_orderkey").alias("place"),
    )


CORE = ["ann_id", "date", "ticker", "action"]


def merged(spark, d):
    return text.notice_merge(notices(spark, d), CORE)


def caps(spark, d):
    c = table(spark, d, "customer")
    tail = F.element_at(F.array(*map(F.lit, ["", "B", "M", "T", "%"])), (F.col("c_custkey") % 5 + 1).cast("int"))
    return c.select("c_custkey", F.when(F.col("c_custkey") % 11 == 0, "N/A").otherwise(F.concat(F.lit("$"), F.col("c_custkey") % 900, F.lit(".5"), tail)).alias("text"))


PLANTED = ["", " Mines copper and Nickel; copper, cobalt.", " A refiner of platinum group metals (PGMs).", "\nOil and gas, petroleum; CRUDE OIL only.", " Goldfields and un-gold gold.", " Iron ore\nand iron ores.", " Uranium/lithium (spodumene)."]


def descriptions(spark, d):
    """Texts with a name that some hold and with planted phrases, flags of some commodities, and rejected ones."""
    k, named = F.col("doc_id"), F.coalesce(F.regexp_extract("text", "([A-Za-z]{4,}) ", 1), F.lit(""))
    t = table(spark, d, "documents").select(k.cast("string").alias("ticker"), F.when(k % 10 == 4, "Iron Ore Ltd").otherwise(named).alias("name"), F.when(k % 4 == 0, "large").otherwise("small").alias("cap_band"), F.concat("text", _pick(PLANTED, k % 7)).alias("text"), k)
    flag = lambda key, attr, priority: F.struct(F.lit(key).alias("group_key"), F.lit(attr).cast("string").alias("attr"), F.lit(priority).alias("priority"))
    kinds = F.array_compact(F.array(F.when(k % 3 == 1, flag("gold", None, 9)), F.when(k % 3 == 2, flag("silver", "explorer", 9)), F.when(k % 4 == 0, flag("copper", "royalty", 0)), F.when(k % 6 == 0, flag("nickel", None, 9))))
    flags = t.select("ticker", F.lit("commodity").alias("group_type"), F.inline(kinds))
    return t.drop("doc_id"), flags, t.where("doc_id % 5 = 0").select("ticker", F.lit("oil_gas").alias("group_key"))


def metric_cells(spark, d):
    """A metric of each customer as text, in one of four profiles."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    whole = F.floor(F.col("c_acctbal") / 60).cast("long")
    return c.select(
        "c_custkey", _pick([*text.GUIDES, "beta"], k % (len(text.GUIDES) + 1)).alias("metric"), _pick(["generic", "small_cap_explorers", "aus_small_cap_explorers", "other"], k % 4).alias("profile"),
        F.when(k % 11 == 0, "N/A").when(k % 3 == 0, F.concat(whole % 9, F.lit(".5%"))).otherwise(F.concat(F.lit("$"), whole - 30)).alias("text"),
    )


TITLES = ["Becoming a substantial holder", "Change in substantial holding from X", "Ceasing to be a substantial holder - change in substantial holding", "Quarterly report", "CHANGE IN SUBSTANTIAL HOLDING"]


def noticed(spark, d):
    """Pages with an announcement table before their text: two rows a page, some with a date that is none, some of other kinds."""
    p, k = table(spark, d, "pages"), F.col("page_id")
    day = lambda n: F.when(n % 9 == 0, "31/02/2001").otherwise(F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), (n % 300).cast("int")), "dd/MM/yyyy"))
    row = lambda n: F.concat(
        F.lit('<tr class="x">\n <td>T'), n % 97, F.lit("</td>\n <td> "), day(n), F.lit('<br>\n <span class="dates-time"> 9:05 am </span></td><td></td><td>\n<a href="/asx/v2/statistics/displayAnnouncement.do?display=pdf&amp;idsId='),
        n, F.lit('">\n '), _pick(TITLES, n % 5), F.lit("<br>\n<span>2 pages</span></a></td></tr>\n"),
    )
    return p.select(F.concat(F.lit("<table>"), row(k * 2), row(k * 2 + 1), F.lit("</table>"), F.coalesce("html", F.lit(""))).alias("html"))


QUERIES = {
    "price_islands": islands_summary,
    "repair_islands": lambda s, d: repair.repair_islands(glitched(s, d), repair.price_islands(glitched(s, d))).select("ticker", "date", F.round("close", 8).alias("close"), F.round("volume", 4).alias("volume")),
    "unadjusted_splits": lambda s, d: repair.unadjusted_splits(split_bars(s, d)).select("ticker", "split_date", "factor", "jump_date"),
    "dedupe_splits": lambda s, d: repair.dedupe_splits(repair.unadjusted_splits(split_bars(s, d))).select("ticker", "split_date", "jump_date"),
    "repair_splits": lambda s, d: repair.repair_splits(split_bars(s, d), repair.dedupe_splits(repair.unadjusted_splits(split_bars(s, d)))).select("ticker", "date", F.round("close", 8).alias("close"), F.round("volume", 4).alias("volume")),
    "metric_parse": lambda s, d: caps(s, d).select("c_custkey", text.metric_parse(F.col("text")).alias("value"), text.cap_parse(F.col("text")).alias("cap")),
    "explorer_profile": lambda s, d: securities(s, d).where("quote_type = 'EQUITY'").select(
        "ticker", text.explorer_profile(F.when(F.col("sector") == "S1", "Basic Materials").otherwise(F.col("sector")), F.when(F.col("industry") == "N2", "Gold Explorers").otherwise(F.col("industry")), F.col("market_cap"), F.concat("ticker", F.when(F.col("region") == "AU", ".AX").otherwise(""))).alias("profile")
    ),
    "chunk_text": lambda s, d: text.chunk_text(paragraphs(s, d)),
    "chunk_topk": lambda s, d: text.chunk_topk(vectors(s, d), vectors(s, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), 5).select("query_id", "vec_id", "source", "place"),
    "summary_scan": lambda s, d: text.summary_scan(*descriptions(s, d), text.keyword_table(s)),
    "metric_verdict": lambda s, d: text.metric_verdict(metric_cells(s, d)),
    "notice_merge": merged,
    "notice_read": lambda s, d: text.notice_read(merged(s, d), ["holder"], "2000-06-30", 90),
    "notice_groups": lambda s, d: text.notice_groups(merged(s, d)),
    "notice_parse": lambda s, d: text.notice_parse(noticed(s, d)),
}

_L8, _L6 = (str(list(x)) for x in (BLOCKS, SPLITS))
_CALM = "cb AS (SELECT ticker, date, CASE t % 5 WHEN 1 THEN close WHEN 2 THEN (50 + (close - 1500) / 49999) / 500 ELSE 50 + (close - 1500) / 49999 END AS price, volume, t, i FROM (SELECT *, CAST(substr(ticker, 2) AS INTEGER) AS t, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i FROM bars))"
_MOVES = "mv AS MATERIALIZED (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY i) AS mv, count(*) OVER (PARTITION BY ticker) AS n FROM {})"
# islands: the opening jump at bar s, the closing one at e; behind one that is taken the next is sought
_ISLANDS = f"""{BARS}, {_CALM},
gb AS MATERIALIZED (SELECT ticker, date, i, price * l AS close, volume / l AS volume FROM (SELECT *, CASE WHEN t % 3 = 0 THEN 1 / f ELSE f END AS l FROM (
  SELECT *, CASE WHEN i BETWEEN 100 + t * 37 % 300 AND 100 + t * 37 % 300 + t % 12 THEN {_L8}[t % 8 + 1] WHEN i BETWEEN 500 + t * 37 % 300 AND 500 + t * 37 % 300 + t * 5 % 10 THEN {_L8}[(t + 3) % 8 + 1] ELSE 1.0 END AS f FROM cb))),
{_MOVES.format("gb")},
big AS (SELECT * FROM mv WHERE abs(mv) >= ln(1.8)),
cand AS (SELECT a.ticker, a.i AS s, a.mv AS m, min(b.i) AS e FROM big a JOIN mv b ON b.ticker = a.ticker AND b.i > a.i AND b.i <= a.i + 10 AND abs(b.mv + a.mv) < ln(1.05) GROUP BY ALL),
quiet AS (SELECT c.*, median(abs(x.mv)) AS md, count(*) AS k FROM cand c JOIN mv x ON x.ticker = c.ticker AND (x.i BETWEEN s - 30 AND s - 1 OR x.i BETWEEN e + 1 AND e + 30) WHERE abs(x.mv) > 0 GROUP BY ALL),
okay AS (SELECT * FROM quiet q WHERE k >= 5 AND abs(m) >= 8 * md AND EXISTS (SELECT 1 FROM (VALUES (2), (3), (4), (5), (8), (10), (20), (25), (40), (50), (100)) r(x) WHERE abs(abs(m) - ln(x)) < ln(1.05))
  AND NOT EXISTS (SELECT 1 FROM big z WHERE z.ticker = q.ticker AND z.i > s AND z.i < e) AND (SELECT min(close) FROM mv z WHERE z.ticker = q.ticker AND z.i BETWEEN s - 2 AND e) >= 0.1),
pick AS (SELECT ticker, min(s) AS s FROM okay GROUP BY ticker UNION ALL SELECT p.ticker, (SELECT min(s) FROM okay x WHERE x.ticker = p.ticker AND x.s > o.e) FROM pick p JOIN okay o ON o.ticker = p.ticker AND o.s = p.s),
isl AS MATERIALIZED (SELECT okay.* FROM okay JOIN pick USING (ticker, s))"""
_SPLITS = f"""{BARS}, {_CALM},
sb AS MATERIALIZED (SELECT ticker, date, i, volume, price * CASE WHEN CASE t % 4 WHEN 0 THEN i < d WHEN 1 THEN false WHEN 2 THEN i = d + 3 ELSE (i < d AND i <> d - 3) OR i = d + 2 OR i = d + 4 END THEN r ELSE 1.0 END AS close,
  CASE WHEN i = d + t % 5 - 2 OR (t % 7 = 3 AND i = d + t % 5 + 1) THEN r ELSE 0.0 END AS split FROM (SELECT *, 200 + t * 53 % 600 AS d, {_L6}[t % 6 + 1] AS r FROM cb)),
{_MOVES.format("sb")}, mq AS (SELECT ticker, i, date, close, mv, n FROM mv),
fs AS (SELECT ticker, date AS split_date, split, ln(1 / split) AS sz, i AS pl FROM sb WHERE split NOT IN (0, 1) AND abs(ln(1 / split)) >= ln(1.5)),
ky AS (SELECT fs.*, first(i ORDER BY abs(mv - sz), i) AS k, min(abs(mv - sz)) AS miss, median(close) AS level FROM fs JOIN mq USING (ticker) WHERE i BETWEEN greatest(1, pl - 7) AND pl + 7 AND n >= 6 GROUP BY ALL HAVING count(*) >= 2),
lv AS (SELECT ky.*, median(close) FILTER (i BETWEEN k - 10 AND k - 1) AS o, median(close) FILTER (i BETWEEN k AND k + 9) AS w FROM ky JOIN mq USING (ticker) GROUP BY ALL),
raw AS (SELECT *, miss <= ln(1.1) AND abs(ln(w / o) - sz) <= ln(1.5) AS raw FROM lv),
cls AS (SELECT ticker, split_date, split, k, date, i, abs(ln(close / o)) < abs(ln(close / w)) AS old FROM raw JOIN mq USING (ticker) WHERE raw AND i BETWEEN k - 7 AND k + 7),
jd AS (SELECT ticker, split_date, split, min(date) AS cut, coalesce(max(i) FILTER (old) + 1, min(i)) AS j, max(i) AS z FROM cls GROUP BY ALL),
st AS (SELECT ticker, split_date, r.split, mq.date, CASE WHEN abs(ln(close / level) + sz) < ln(1.1) THEN 1 / r.split ELSE r.split END AS mult, count(*) OVER (PARTITION BY ticker, split_date) AS k
  FROM raw r JOIN mq USING (ticker) WHERE NOT raw AND i BETWEEN greatest(1, pl - 7) AND pl + 7 AND least(abs(ln(close / level) + sz), abs(ln(close / level) - sz)) < ln(1.1)),
us AS MATERIALIZED (SELECT jd.ticker, split_date, split, cut, mv.date AS jump_date FROM jd JOIN (SELECT ticker, i, date FROM mv) mv ON mv.ticker = jd.ticker AND mv.i = least(j, z)
  UNION ALL SELECT ticker, split_date, split, NULL, min(date) FROM st WHERE k <= 2 GROUP BY ticker, split_date, split)"""
_ONCE = "du AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, jump_date ORDER BY split_date) AS r FROM us) WHERE r = 1)"
_FORMS = text.NAME_FORMS.replace("(?i)", "")
_WORDS = ", ".join(f"('{c}', {k}, '{w}')" for c, words in text.KEYWORDS.items() for k, w in enumerate(words))
_GUIDES = ", ".join(
    f"('{p}', '{m}', {'NULL' if g is None else g}, {'NULL' if b is None else b}, {'NULL' if w is None else chr(39) + w + chr(39)})"
    for p in ("generic", *text.PROFILE_GUIDES) for m, guide in text.GUIDES.items() for g, b, w in [text.PROFILE_GUIDES.get(p, {}).get(m, guide)]
)
_MERGED = """n0 AS (SELECT CAST(o_orderkey % 5000 AS VARCHAR) AS ann_id, CAST(o_orderdate AS DATE) AS date, 'I' || (o_custkey % 40) AS ticker, ['initial', 'change', 'cease'][o_custkey % 3 + 1] AS action, o_orderpriority AS holder, row_number() OVER (PARTITION BY o_orderkey % 5000 ORDER BY o_orderkey) AS k FROM orders),
mg AS (SELECT ann_id, date, ticker, action, holder FROM n0 WHERE k = 1)"""

_TITLES = ", ".join(f"'{t}'" for t in TITLES)

SQL = {
    "notice_parse": f"""WITH n AS (SELECT unnest([page_id * 2, page_id * 2 + 1]) AS n FROM pages), t AS (SELECT *, [{_TITLES}][n % 5 + 1] AS title FROM n)
SELECT CAST(n AS VARCHAR) AS ann_id, CASE WHEN n % 9 = 0 THEN '31/02/2001' ELSE strftime(DATE '2001-01-01' + CAST(n % 300 AS INTEGER), '%Y-%m-%d') END AS date, '9:05 am' AS time, 'T' || (n % 97) AS ticker, title,
  'https://www.asx.com.au/asx/v2/statistics/displayAnnouncement.do?display=pdf&idsId=' || n AS pdf_url, ['603', '604', '605', NULL, '604'][n % 5 + 1] AS form, ['initial', 'change', 'cease', NULL, 'change'][n % 5 + 1] AS action FROM t WHERE n % 5 <> 3""",
    "price_islands": f"""WITH RECURSIVE {_ISLANDS} SELECT isl.ticker, a.date AS start, z.date AS "end", CAST(e - s AS BIGINT) AS n, round(exp(-m), 2) AS mult
FROM isl JOIN gb a ON a.ticker = isl.ticker AND a.i = s JOIN gb z ON z.ticker = isl.ticker AND z.i = e - 1""",
    "repair_islands": f"""WITH RECURSIVE {_ISLANDS} SELECT gb.ticker, gb.date, round(gb.close * coalesce(exp(-m), 1.0), 8) AS close, round(gb.volume / coalesce(exp(-m), 1.0), 4) AS volume
FROM gb LEFT JOIN isl ON isl.ticker = gb.ticker AND gb.i >= s AND gb.i < e""",
    "unadjusted_splits": f"WITH {_SPLITS} SELECT ticker, split_date, 1 / split AS factor, jump_date FROM us",
    "dedupe_splits": f"WITH {_SPLITS}, {_ONCE} SELECT ticker, split_date, jump_date FROM du",
    "repair_splits": f"""WITH {_SPLITS}, {_ONCE},
fx AS (SELECT du.ticker, sb.date, 1 / du.split AS f FROM du JOIN sb ON sb.ticker = du.ticker AND sb.date < cut
  UNION ALL SELECT du.ticker, cls.date, 1 / du.split FROM du JOIN cls ON cls.ticker = du.ticker AND cls.split_date = du.split_date WHERE old
  UNION ALL SELECT du.ticker, st.date, mult FROM du JOIN st ON st.ticker = du.ticker AND st.split_date = du.split_date WHERE du.cut IS NULL),
pf AS (SELECT ticker, date, product(f) AS f FROM fx GROUP BY ALL)
SELECT ticker, date, round(close * coalesce(f, 1.0), 8) AS close, round(volume / coalesce(f, 1.0), 4) AS volume FROM sb LEFT JOIN pf USING (ticker, date)""",
    "chunk_topk": """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, 's' || e.label AS source, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)) AS d
  FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS place FROM p) SELECT query_id, vec_id, source, place FROM r WHERE place <= 5""",
    "metric_verdict": f"""WITH g AS (SELECT * FROM (VALUES {_GUIDES}) x(p, metric, good, bad, way)),
c AS (SELECT c_custkey, {[*text.GUIDES, 'beta']}[c_custkey % {len(text.GUIDES) + 1} + 1] AS metric, ['generic', 'small_cap_explorers', 'aus_small_cap_explorers', 'other'][c_custkey % 4 + 1] AS profile, CAST(floor(c_acctbal / 60) AS BIGINT) AS w FROM customer),
v AS (SELECT *, CASE WHEN c_custkey % 11 = 0 THEN 'N/A' WHEN c_custkey % 3 = 0 THEN (w % 9) || '.5%' ELSE '$' || (w - 30) END AS text FROM c), n AS (SELECT *, TRY_CAST(replace(replace(text, '$', ''), '%', '') AS DOUBLE) AS value FROM v)
SELECT n.c_custkey, n.metric, n.profile, n.text, n.value, CASE WHEN value IS NULL THEN NULL WHEN way = 'low' THEN CASE WHEN value <= good THEN 'good' WHEN value >= bad THEN 'bad' ELSE 'neutral' END
  WHEN way = 'high' THEN CASE WHEN value >= good THEN 'good' WHEN value <= bad THEN 'bad' ELSE 'neutral' END END AS verdict
FROM n LEFT JOIN g ON g.metric = n.metric AND g.p = CASE WHEN profile = 'other' THEN 'generic' ELSE profile END""",
    "metric_parse": """WITH t AS (SELECT c_custkey, (c_custkey % 900) || '.5' AS x, c_custkey % 5 AS s, c_custkey % 11 = 0 AS na FROM customer) SELECT c_custkey, CASE WHEN NOT na AND s IN (0, 4) THEN CAST(x AS DOUBLE) END AS value,
  CASE WHEN NOT na AND s <> 4 THEN CAST(x AS DOUBLE) * [1, 1e9, 1e6, 1e12][s + 1] END AS cap FROM t""",
    "explorer_profile": f"WITH {SECURITIES} SELECT ticker, CASE WHEN market_cap < 3e9 AND (sector = 'S1' OR industry = 'N2') THEN CASE region WHEN 'AU' THEN 'aus_small_cap_explorers' ELSE 'small_cap_explorers' END ELSE 'generic' END AS profile FROM securities WHERE quote_type = 'EQUITY'",
    "notice_merge": f"WITH {_MERGED} SELECT ann_id, date, ticker, action, '{{\"holder\":\"' || holder || '\"}}' AS payload FROM mg",
    "notice_read": f"WITH {_MERGED} SELECT * FROM mg WHERE date > DATE '2000-06-30' - 90 AND date <= DATE '2000-06-30'",
    "notice_groups": f"WITH {_MERGED} SELECT action, string_agg(DISTINCT ticker, ',' ORDER BY ticker) AS tickers FROM mg GROUP BY action",
    "summary_scan": f"""WITH t AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS ticker, text || replace({[p.replace(chr(10), '~') for p in PLANTED]}[doc_id % 7 + 1], '~', chr(10)) AS text, CASE WHEN doc_id % 10 = 4 THEN 'Iron Ore Ltd' ELSE coalesce(regexp_extract(text, '([A-Za-z]{{4,}}) ', 1), '') END AS name,
  CASE WHEN doc_id % 4 = 0 THEN 'large' ELSE 'small' END AS cap_band FROM documents WHERE text || 'x' <> 'x' AND doc_id % 3 <> 0),
n AS (SELECT *, trim(regexp_replace(trim(regexp_replace(name, '{_FORMS}', ' ', 'gi')), '\\s+', ' ', 'g')) AS stem FROM t),
c AS (SELECT *, CASE WHEN name = '' THEN text ELSE regexp_replace(text, regexp_escape(name), ' ', 'gi') END AS x FROM n),
d AS MATERIALIZED (SELECT *, CASE WHEN length(stem) < 4 THEN x ELSE regexp_replace(x, regexp_escape(stem) || '(?:''s)?', ' ', 'gi') END AS clean FROM c),
d2 AS MATERIALIZED (SELECT doc_id, ticker, name, cap_band, clean, translate(clean, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM d),
w AS (SELECT * FROM (VALUES {_WORDS}) x(commodity, k, word)),
g AS (SELECT d2.*, commodity, k, word, length(word) AS m, string_split(low, word) AS parts FROM d2, w WHERE contains(low, word)),
h AS (SELECT *, list_filter(range(1, len(parts)), lambda j: ((j = 1 AND parts[j] = '') OR regexp_matches(right(parts[j], 1), '[^a-z]')) AND ((j + 1 = len(parts) AND parts[j + 1] = '') OR regexp_matches(left(parts[j + 1], 1), '[^a-z]'))) AS hits FROM g),
f AS (SELECT ticker, doc_id, name, cap_band, commodity, sum(len(hits)) AS hits, first(clean ORDER BY k) AS clean, first(CAST(list_sum(list_transform(parts[1:hits[1]], lambda y: length(y))) AS BIGINT) + (hits[1] - 1) * m ORDER BY k) AS a, first(m ORDER BY k) AS m FROM h WHERE len(hits) > 0 GROUP BY ALL)
SELECT ticker, name, cap_band, CASE WHEN doc_id % 4 = 0 THEN 'copper' WHEN doc_id % 3 = 1 THEN 'gold' ELSE 'silver' END AS primary, CASE WHEN doc_id % 4 = 0 THEN 'royalty' WHEN doc_id % 3 = 1 THEN 'producer' ELSE 'explorer' END AS primary_type,
  (CASE WHEN doc_id % 4 = 0 THEN 'copper, ' ELSE '' END) || (CASE WHEN doc_id % 3 = 1 THEN 'gold' ELSE 'silver' END) AS existing, commodity, CAST(hits AS BIGINT) AS hits,
  (CASE WHEN a > 70 THEN '…' ELSE '' END) || replace(substr(clean, greatest(0, a - 70) + 1, least(length(clean), a + m + 70) - greatest(0, a - 70)), chr(10), ' ') || (CASE WHEN a + m + 70 < length(clean) THEN '…' ELSE '' END) AS snippet
FROM f WHERE NOT (commodity = 'gold' AND doc_id % 3 = 1) AND NOT (commodity = 'silver' AND doc_id % 3 = 2) AND NOT (commodity = 'copper' AND doc_id % 4 = 0) AND NOT (commodity = 'oil_gas' AND doc_id % 5 = 0)""",
}
