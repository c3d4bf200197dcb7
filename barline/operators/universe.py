"""Universes: membership, labels and maintenance of securities and their group flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import chain, col, lookup

# Index symbols of the two regions, exchange prefixes, cap thresholds, legacy sector names.
US_INDEX = ["^GSPC", "^NDX", "^DJI", "^IXIC", "^RUT", "^VIX", "^VVIX", "^VIX3M", "^TNX", "^IRX", "^FVX", "^TYX", "^MOVE", "^HGX", "^SPGSIK"]
AU_INDEX = ["^AXJO", "^AORD", "^AXVI", "^AXKO", "^AXMD", "^AXSO"]
EXCHANGE_PREFIX = {"NMS": "NASDAQ", "NGM": "NASDAQ", "NCM": "NASDAQ", "NYQ": "NYSE", "ASE": "AMEX", "PCX": "AMEX", "BTS": "AMEX", "ASX": "ASX"}
CAP_SCHEMES = {"AU": (10e9, 2e9), "US": (10e9, 2e9), "commodity": (5e9, 0.5e9)}
COMMODITY_BENCHMARKS = {
    "gold": "GDX", "silver": "SIL", "copper": "COPX", "uranium": "URA", "lithium": "LIT", "platinum": "ETPMPT.AX", "palladium": "ETPMPD.AX", "oil_gas": "XLE",
}
COMMODITY_GROUP_BENCHMARKS = {**dict.fromkeys(["gold", "silver", "copper", "platinum", "palladium", "iron_ore", "nickel"], "XME"), **dict.fromkeys(["uranium", "lithium", "oil_gas"], "XLE")}
SECTOR_MAP = {
    "Non-energy minerals": "Basic Materials", "Process industries": "Basic Materials", "Energy minerals": "Energy", "Finance": "Financial Services", "Miscellaneous": "Financial Services",
    "Technology services": "Technology", "Electronic technology": "Technology", "Health technology": "Healthcare", "Health services": "Healthcare", "Commercial services": "Industrials",
    "Industrial services": "Industrials", "Producer manufacturing": "Industrials", "Transportation": "Industrials", "Distribution services": "Industrials", "Consumer services": "Consumer Cyclical",
    "Consumer durables": "Consumer Cyclical", "Retail trade": "Consumer Cyclical", "Consumer non-durables": "Consumer Defensive", "Communications": "Communication Services", "Utilities": "Utilities",
    "Financials": "Financial Services", "Health Care": "Healthcare", "Information Technology": "Technology", "Technology": "Technology", "Consumer Discretionary": "Consumer Cyclical",
    "Consumer Staples": "Consumer Defensive", "Materials": "Basic Materials", "Basic Materials": "Basic Materials", "Communication": "Communication Services",
    "Communication Services": "Communication Services", "Telecommunications": "Communication Services", "Energy": "Energy", "Industrials": "Industrials", "Real Estate": "Real Estate",
}


def region_of(ticker: Column | str) -> Column:
    """AU, US, GLOBAL for reference symbols, null for other listings."""
    t = F.upper(F.trim(col(ticker)))
    return chain(
        [
            (t.endswith(".AX") | t.isin(AU_INDEX) | t.startswith("^AX"), "AU"),
            (t.isin(US_INDEX), "US"),
            (t.startswith("^") | t.contains("=") | (t == "DX-Y.NYB"), "GLOBAL"),
            (t.contains("."), F.lit(None).cast("string")),
        ],
        "US",
    )


def export_symbol(ticker: Column | str, exchange: Column | str) -> Column:
    t = F.upper(col(ticker))
    prefix = lookup(EXCHANGE_PREFIX, F.upper(F.coalesce(col(exchange), F.lit(""))), "NYSE")
    return F.when(t.endswith(".AX"), F.concat(F.lit("ASX:"), F.regexp_replace(t, r"\.AX$", ""))).otherwise(F.concat(prefix, F.lit(":"), F.replace(t, F.lit("-"), F.lit("."))))


def cap_band(market_cap: Column | str, scheme: str = "US") -> Column:
    large, mid = CAP_SCHEMES.get(scheme, CAP_SCHEMES["US"])
    m = col(market_cap)
    return chain([(m > large, "large"), (m >= mid, "mid")], "small")


def sector_normalise(sector: Column | str, legacy: Column | str) -> Column:
    mapped = lookup(SECTOR_MAP, F.trim(col(legacy)), "Unknown")
    known = lambda c: F.when(c != "", c)
    return F.coalesce(known(col(sector)), F.when(known(col(legacy)).isNotNull(), mapped), F.lit("Unknown"))


def primary_exposure(groups: DataFrame, commodities: list[str] | None = None) -> DataFrame:
    """One commodity and type per ticker: least priority, then the fixed order of commodities, unknown ones last."""
    rows = groups.where(F.col("group_type") == "commodity")
    if commodities:
        rows = rows.where(F.col("group_key").isin(commodities))
    order = lookup({k: i for i, k in enumerate(COMMODITY_BENCHMARKS)}, "group_key", 99)
    place = F.row_number().over(Window.partitionBy("ticker").orderBy("priority", order, "group_key"))
    return rows.withColumn("place", place).where("place = 1").select("ticker", F.col("group_key").alias("commodity"), F.col("attr").alias("type"))


def benchmark_map(commodity: Column | str, fixed: str) -> Column:
    """The fixed benchmark, or with 'per_commodity' the commodity's own, else that of its group."""
    if fixed != "per_commodity":
        return F.lit(fixed)
    return F.coalesce(lookup(COMMODITY_BENCHMARKS, commodity), lookup(COMMODITY_GROUP_BENCHMARKS, commodity))


def members(spec: dict, securities: DataFrame, groups: DataFrame, include_inactive: bool = False) -> DataFrame:
    """Members of a universe: its filters over securities and flags, with primary exposure, cap band, benchmark and sector."""
    df = securities if include_inactive else securities.where(F.col("active") == 1)
    f = spec.get("filter", {})
    for key in ("region", "quote_type", "exchange"):
        if key in f:
            df = df.where(F.col(key).isin(f[key] if isinstance(f[key], list) else [f[key]]))
    if "min_market_cap" in f:
        df = df.where(F.coalesce("market_cap", F.lit(0.0)) >= float(f["min_market_cap"]))
    for kind in ("index", "theme", "commodity"):
        if f"{kind}_any" in f:
            keep = groups.where((F.col("group_type") == kind) & F.col("group_key").isin(f[f"{kind}_any"])).select("ticker")
            df = df.join(keep, "ticker", "left_semi")
    df = df.join(primary_exposure(groups, f.get("commodity_any")), "ticker", "left")
    legacy = F.col("legacy_sector") if "legacy_sector" in df.columns else F.lit(None).cast("string")
    return df.select(
        "ticker", "name", "region", "exchange", "quote_type", sector_normalise("sector", legacy).alias("sector"), F.coalesce("industry", F.lit("")).alias("industry"), "market_cap", "commodity", "type",
        cap_band("market_cap", spec.get("cap_scheme", "US")).alias("cap_band"), benchmark_map("commodity", spec.get("benchmark")).alias("benchmark"),
    )


def odd_line(ticker: Column | str) -> Column:
    """Preferreds, warrants, units and rights; .AX codes of more than four characters."""
    t = F.upper(col(ticker))
    return F.when(t.endswith(".AX"), F.length(t) - 3 > 4).otherwise(t.rlike(r"-(P[A-Z]?|W[ST]?|UN?|RT?)$"))


def theme_members(groups: DataFrame, securities: DataFrame, theme: str) -> DataFrame:
    """Tickers of a theme with the flag's attribute, else the security's name, as display name."""
    g = groups.where((F.col("group_type") == "theme") & (F.col("group_key") == theme)).select("ticker", "attr")
    return g.join(securities.select("ticker", "name"), "ticker", "left").select("ticker", F.coalesce("attr", "name").alias("name"))


def theme_groups(groups: DataFrame, securities: DataFrame, theme: str) -> DataFrame:
    """theme_members with grp, what follows the colon in a flag <theme>:<grp>; '' without one."""
    of = groups.where((F.col("group_type") == "theme") & F.col("group_key").startswith(theme + ":")).groupBy("ticker").agg(F.max(F.split_part("group_key", F.lit(":"), F.lit(2))).alias("grp"))
    return theme_members(groups, securities, theme).join(of, "ticker", "left").withColumn("grp", F.coalesce("grp", F.lit("")))


def fetch_ticker_set(universes: DataFrame, groups: DataFrame, extra: DataFrame) -> DataFrame:
    """Every ticker to keep current: members, benchmarks, roles and themes, and extra."""
    roles = groups.where(F.col("group_type").isin("role", "theme")).select("ticker")
    return universes.select("ticker").union(universes.select("benchmark")).union(roles).union(extra.select("ticker")).where("ticker <> ''").distinct()


def universe_summary(universes: DataFrame) -> DataFrame:
    return universes.groupBy("universe").agg(F.count("*").alias("members"), *(F.count_if(F.col("cap_band") == c).alias(c) for c in ("large", "mid", "small")))


def security_search(securities: DataFrame, text: str, limit: int = 25) -> DataFrame:
    """Equities whose ticker or name contains the text; active ones and large caps first."""
    needle = F.lit(text.lower())
    hit = F.lower("ticker").contains(needle) | F.lower("name").contains(needle)
    return securities.where(hit & (F.col("quote_type") == "EQUITY")).orderBy(F.desc("active"), F.desc_nulls_last("market_cap"), "ticker").limit(limit)


def security_page(securities: DataFrame, text: str = "", offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of the securities whose ticker or name contains the text as it stands, signs of patterns included, by ticker."""
    needle = F.lit(text.lower())
    hit = F.lower("ticker").contains(needle) | F.coalesce(F.lower("name").contains(needle), F.lit(False))
    return securities.where(hit).orderBy("ticker").offset(offset).limit(limit)


def listing_clean(listings: DataFrame, region: str, require_usd: bool = False) -> DataFrame:
    """Screener rows worth keeping, the first for each ticker. listings has ticker, name, quote_type, currency, place."""
    t = F.upper(F.trim("ticker"))
    rows = listings.where(F.col("ticker").isNotNull() & (F.coalesce("quote_type", F.lit("EQUITY")) == "EQUITY")).withColumn("ticker", t)
    rows = rows.where((region_of("ticker") == region) & ~odd_line("ticker"))
    if require_usd:
        rows = rows.where(F.coalesce("currency", F.lit("USD")) == "USD")
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("ticker").orderBy("place"))).where("_k = 1").drop("_k")


def universe_refresh_diff(found: DataFrame, stored: DataFrame, log: DataFrame, run_date: str, keep_days: int = 30) -> DataFrame:
    """Action for each ticker found or stored: new, updated, kept (missing but traded lately) or deactivate."""
    f = found.select("ticker", F.lit(1).alias("found")).distinct()
    s = stored.where((F.col("active") == 1) & (F.col("quote_type") == "EQUITY")).select("ticker", F.lit(1).alias("stored"))
    fresh = log.where((F.col("failures") == 0) & (F.col("last_date") >= F.date_sub(F.to_date(F.lit(run_date)), keep_days))).select("ticker", F.lit(1).alias("fresh"))
    both = f.join(s, "ticker", "full").join(fresh, "ticker", "left")
    action = F.when(F.col("stored").isNull(), "new").when(F.col("found").isNotNull(), "updated").when(F.col("fresh").isNotNull(), "kept").otherwise("deactivate")
    return both.select("ticker", action.alias("action"))


# Benchmark of a region's new securities.
REGION_BENCHMARK = {"AU": "^AXJO", "US": "SPY"}
OUTAGE_ROWS = 200


def universe_refresh_apply(stored: DataFrame, found: DataFrame, diff: DataFrame, run_date: str, outage_rows: int = OUTAGE_ROWS) -> DataFrame:
    """stored after the diff: found rows fill name, exchange, cap, currency and a missing benchmark, replace sector, industry and cap
    band; deactivated rows get a date. A region with fewer than outage_rows found rows is taken for an outage and left as it was."""
    f = found.select("ticker", F.col("region").alias("f_region"), *(F.col(c).alias(f"f_{c}") for c in ("name", "exchange", "market_cap", "currency", "sector", "industry")))
    sizes = found.groupBy("region").agg(F.count("*").alias("_n")).where(F.col("_n") >= outage_rows).select(F.col("region").alias("_r"))  # a row a region
    rows = stored.join(f, "ticker", "full").join(diff, "ticker", "left").withColumn("_r", F.coalesce("region", "f_region")).join(F.broadcast(sizes.withColumn("_up", F.lit(True))), "_r", "left")
    rows = rows.where(F.col("_up") | F.col("region").isNotNull())
    up = F.coalesce("_up", F.lit(False))
    hit, gone = F.coalesce(up & F.col("action").isin("new", "updated"), F.lit(False)), up & (F.col("action") == "deactivate")
    pick = lambda c: F.when(hit, F.coalesce(f"f_{c}", c)).otherwise(F.col(c)).alias(c)
    replace = lambda c: F.when(hit, F.col(f"f_{c}")).otherwise(F.col(c)).alias(c)
    band = cap_band("f_market_cap")
    return rows.select(
        "ticker", F.col("_r").alias("region"), pick("name"), pick("exchange"), pick("market_cap"), pick("currency"), replace("sector"), replace("industry"), F.when(hit, band).otherwise(F.col("cap_band")).alias("cap_band"),
        F.when(hit, F.coalesce("benchmark", lookup(REGION_BENCHMARK, "_r"))).otherwise(F.col("benchmark")).alias("benchmark"),
        F.when(gone, 0).when(hit, 1).otherwise(F.col("active")).alias("active"), F.when(gone, F.to_date(F.lit(run_date))).alias("delisted_on"),
    )


def apply_overrides(groups: DataFrame, remove: DataFrame, add: DataFrame) -> DataFrame:
    """Flags without the removed ones, added ones replacing those of the same ticker, type and key."""
    keys = ["ticker", "group_type", "group_key"]
    rest = groups.join(remove.select(*keys), keys, "left_anti").join(add.select(*keys), keys, "left_anti")
    return rest.unionByName(add)


def index_membership(groups: DataFrame, provider: DataFrame, securities: DataFrame, index: str) -> DataFrame:
    """Flags with the index's members replaced by the provider's known tickers; an empty provider keeps the old ones."""
    known = provider.select("ticker").intersect(securities.select("ticker"))
    new = known.select("ticker", F.lit("index").alias("group_type"), F.lit(index).alias("group_key"), F.lit(None).cast("string").alias("attr"), F.lit(9).alias("priority"))
    any_new = new.select(F.lit(1).alias("one")).limit(1)
    mine = (F.col("group_type") == "index") & (F.col("group_key") == index)
    old = groups.where(mine).join(any_new, F.lit(True), "left_anti")
    return groups.where(~mine).unionByName(old).unionByName(new)


# Commodity and type of an industry, commodity of a keyword in a name.
INDUSTRY_COMMODITY = {
    "Gold": ("gold", "producer"), "Silver": ("silver", "producer"), "Copper": ("copper", "producer"), "Uranium": ("uranium", "producer"), "Oil & Gas E&P": ("oil_gas", "producer"),
    "Oil & Gas Integrated": ("oil_gas", "producer"), "Oil & Gas Drilling": ("oil_gas", "services"), "Oil & Gas Equipment & Services": ("oil_gas", "services"), "Oil & Gas Midstream": ("oil_gas", "midstream"),
    "Oil & Gas Refining & Marketing": ("oil_gas", "refining"),
}
NAME_COMMODITY = {
    "lithium": "lithium", "platinum": "platinum", "palladium": "palladium", "uranium": "uranium", "copper": "copper", "silver": "silver", "gold": "gold", "iron ore": "iron_ore", "nickel": "nickel",
}


def commodity_flags(securities: DataFrame, groups: DataFrame) -> DataFrame:
    """New commodity flags from industries, and from name keywords in mining-type industries; stored ones are left alone."""
    sec = securities.where("active = 1 and quote_type = 'EQUITY' and region in ('AU', 'US')").select("ticker", F.lower(F.coalesce("name", F.lit(""))).alias("low"), F.coalesce("industry", F.lit("")).alias("industry"))
    mining = F.col("industry").contains("Mining") | F.col("industry").contains("Metals") | F.col("industry").isin("Gold", "Silver", "Copper", "Uranium")
    kind = "array<struct<group_key:string,attr:string,src:int>>"
    pair = lambda k, t, src: F.struct(F.lit(k).alias("group_key"), F.lit(t).alias("attr"), F.lit(src).alias("src"))
    by_industry = [F.when(F.col("industry") == i, pair(k, t, 0)) for i, (k, t) in INDUSTRY_COMMODITY.items()]
    by_name = [F.when(mining & F.col("low").contains(w), pair(k, "producer", 1)) for w, k in NAME_COMMODITY.items()]
    rows = sec.select("ticker", F.inline(F.array_compact(F.array(*by_industry, *by_name)).cast(kind)))
    rows = rows.groupBy("ticker", "group_key").agg(F.min_by("attr", "src").alias("attr")).withColumn("group_type", F.lit("commodity"))
    return rows.join(groups.select("ticker", "group_type", "group_key"), ["ticker", "group_type", "group_key"], "left_anti").select("ticker", "group_type", "group_key", "attr")


def universe_snapshot(universes: DataFrame, run_date: str) -> DataFrame:
    """Members of every universe as of a refresh date, to be written as that date's partition."""
    return universes.select(F.to_date(F.lit(run_date)).alias("snapshot_date"), "universe", "ticker").distinct()


def summary_apply(groups: DataFrame, candidates: DataFrame) -> DataFrame:
    """Flags after a scan's candidates(ticker, commodity, primary_type): each such ticker's present primary is pinned at priority 0, then
    candidates that it lacks are added at 9."""
    mine = groups.join(candidates.select("ticker").distinct(), "ticker", "left_semi")
    pinned = primary_exposure(mine).select("ticker", F.col("commodity").alias("group_key"), F.lit("commodity").alias("group_type"), F.lit(1).alias("pin"))
    kept = groups.join(pinned, ["ticker", "group_type", "group_key"], "left").withColumn("priority", F.when(F.col("pin") == 1, 0).otherwise(F.col("priority"))).select(*groups.columns)
    new = candidates.select("ticker", F.lit("commodity").alias("group_type"), F.col("commodity").alias("group_key"), F.coalesce("primary_type", F.lit("producer")).alias("attr"), F.lit(9).alias("priority"))
    new = new.dropDuplicates(["ticker", "group_key"]).join(groups.select("ticker", "group_type", "group_key"), ["ticker", "group_type", "group_key"], "left_anti")
    return kept.unionByName(new.select(*groups.columns))


# Type vocabulary of watchlists.
WATCHLIST_TYPES = {
    "producer": "producer", "explorer": "explorer", "royalties_financial_services": "royalty", "ETF": "ETF", "Miners & Producers": "producer", "etf": "ETF", "futures": "futures", "index": "index",
}
FIRST_WINS = ("name", "benchmark", "legacy_sector", "legacy_industry")


def import_watchlists(lists: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Securities and flags from watchlists in their order, read with headers as strings.

    Headers and tickers are trimmed, blank tickers and foreign listings drop. A later list's non-empty value replaces an earlier
    one, but for the columns FIRST_WINS. A list with a commodity column gives commodity flags with mapped types.
    """
    every, flags = None, None
    for i, rows in enumerate(lists):
        rows = rows.toDF(*(c.strip() for c in rows.columns))
        rows = rows.select(*(F.when(F.trim(c) != "", F.trim(c)).alias(c) for c in rows.columns)).where("ticker is not null").withColumn("_list", F.lit(i))
        every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
        if "commodity" in rows.columns:
            kind = lookup(WATCHLIST_TYPES, "type", F.lit(None).cast("string")) if "type" in rows.columns else F.lit(None).cast("string")
            part = rows.select("ticker", F.lit("commodity").alias("group_type"), F.lower("commodity").alias("group_key"), kind.alias("attr"), "_list").where("group_key is not null")
            flags = part if flags is None else flags.unionByName(part)
    every = every.withColumn("region", region_of("ticker")).where("region is not null")
    columns = [c for c in every.columns if c not in ("ticker", "region", "_list", "commodity", "type")]
    pick = lambda c: (F.min_by if c in FIRST_WINS else F.max_by)(c, F.when(F.col(c).isNotNull(), F.col("_list"))).alias(c)
    securities = every.groupBy("ticker", "region").agg(*(pick(c) for c in columns)).withColumn("active", F.lit(1))
    if flags is None:
        flags = securities.select("ticker", F.lit("").alias("group_type"), F.lit("").alias("group_key"), F.lit("").alias("attr"), F.lit(0).alias("_list")).limit(0)
    known = flags.join(securities.select("ticker"), "ticker", "left_semi")
    return securities, known.groupBy("ticker", "group_type", "group_key").agg(F.max_by("attr", "_list").alias("attr"))
