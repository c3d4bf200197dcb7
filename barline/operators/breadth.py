"""Market breadth: a forward-filled panel of live tickers, and counts of it by date and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import chain, col
from ..sources.stored import StoredTable

# Metric names, the guard's days and ratio.
LIVE_ROWS = 10  # a ticker leaves the counts this many calendar rows after its last bar
ALL_METRICS = ["total", "leader", "contender", "laggard", "weak", "above_20", "above_50", "above_200", "high_vol", "acc_early", "acc_progress", "acc_shift"]
LAYER_METRICS = ALL_METRICS[:-2]
CAP_METRICS = ["total", "leaders", "above200"]
SECTOR_METRICS = ["total", "leaders", "above20", "above50", "above200", "high_vol"]
GUARD_DAYS, GUARD_RATIO = 60, 0.90


def slug(c: Column | str) -> Column:
    x = F.replace(F.replace(F.lower(col(c)), F.lit(" "), F.lit("_")), F.lit("/"), F.lit("_"))
    return F.replace(x, F.lit("&"), F.lit("and"))


def breadth_panel(bars: DataFrame, info: DataFrame, peer_key: str = "sector", only: DataFrame | None = None) -> DataFrame:
    """One row per date and live ticker. The calendar is every date on which a member has a bar; with only(date) just these
    dates are ranked and returned, after the rolling features.

    A ticker is spread only from its first bar to LIVE_ROWS calendar rows after its last, never over the whole calendar. One
    shuffle by ticker serves the rolling features, one by (date, group) the peer rank.
    """
    b = bars.where(F.col("adj_close").isNotNull()).join(info.select("ticker"), "ticker", "left_semi").select("ticker", "date", F.col("adj_close").alias("p"), "volume")
    days = b.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")))  # one row a trading day
    b = b.join(F.broadcast(days), "date")
    last_day = days.agg(F.max("pos").alias("last_pos"))
    spans = b.groupBy("ticker").agg(F.min("pos").alias("a"), F.max("pos").alias("z")).crossJoin(F.broadcast(last_day))  # one row of last_pos
    dense = spans.select("ticker", "z", F.explode(F.sequence("a", F.least(F.col("z") + LIVE_ROWS, "last_pos"))).alias("pos"))
    dense = dense.join(b.drop("date"), ["ticker", "pos"], "left").join(F.broadcast(days), "pos")
    w = Window.partitionBy("ticker").orderBy("pos")
    dense = dense.withColumn("close", F.last("p", ignorenulls=True).over(w)).withColumn("real", F.last(F.when(F.col("p").isNotNull(), F.col("pos")), ignorenulls=True).over(w))
    # averages of k rows from running sums, which cost the same for any k
    dense = dense.withColumn("n", F.row_number().over(w)).withColumn("s", F.sum("close").over(w)).withColumn("vs", F.coalesce(F.sum("volume").over(w), F.lit(0.0))).withColumn("vn", F.count("volume").over(w))
    before = lambda c, k: F.coalesce(F.lag(c, k).over(w), F.lit(0.0))
    volumes = F.col("vn") - before("vn", 63)
    dense = dense.select(
        "*", *(F.when(F.col("n") >= k, (F.col("s") - before("s", k)) / k).alias(f"sma{k}") for k in (20, 50, 200)),
        (F.col("close") / F.coalesce(F.lag("close", 252).over(w), F.first("close").over(w)) - 1).alias("ret_12m"),
        F.when(volumes > 0, F.col("volume") / ((F.col("vs") - before("vs", 63)) / volumes)).alias("rel_vol"),
    )
    if only is not None:
        dense = dense.join(F.broadcast(only.select("date").distinct()), "date", "left_semi")  # dates of one calendar
    rows = dense.where(F.col("pos") - F.col("real") <= LIVE_ROWS).join(info.select("ticker", "sector", "industry", "cap_band", "commodity", "type"), "ticker")
    c, a, m, z = F.col("close"), F.col("sma20"), F.col("sma50"), F.col("sma200")
    have = a.isNotNull() & m.isNotNull() & z.isNotNull() & F.col("cap_band").isin("large", "mid")
    flag = lambda x: F.when(x, 1).otherwise(0)
    rows = rows.select(
        "date", "ticker", "close", "ret_12m", F.coalesce("sector", F.lit("Unknown")).alias("sector"), "industry", "cap_band", "commodity", "type",
        flag(c > a).alias("above_20"), flag(c > m).alias("above_50"), flag(c > z).alias("pass_trend"),
        chain([(F.col("rel_vol") >= 1.5, "HIGH"), (F.col("rel_vol") >= 1.0, "MED")], "LOW").alias("vol_label"),
        chain([(have & (c < a) & (c < m) & (c < z), "EARLY"), (have & (c < m) & (c < z) & (c >= a), "PROGRESS"), (have & (c < z) & (c >= m) & (c >= a), "SHIFT")], "-").alias("acc_watch"),
    )
    g = Window.partitionBy("date", "peer_group")
    rows = rows.withColumn("peer_group", F.coalesce(F.col(peer_key), F.lit("Unknown"))).withColumn("ok", F.col("ret_12m").isNotNull())
    n, place = F.count("ret_12m").over(g), F.rank().over(g.orderBy(F.asc_nulls_last("ret_12m")))
    rows = rows.withColumn("peer_rs_score", F.when(F.col("ok") & (n > 1), (place - 1) / (n - 1) * 100).otherwise(50.0))
    s, t = F.col("peer_rs_score"), F.col("pass_trend")
    regime = chain([((s >= 75) & (t == 1), "LEADER"), ((s >= 50) & (t == 1), "CONTENDER"), ((s < 50) & (t == 0), "WEAK")], "LAGGARD")
    return rows.withColumn("regime_label", regime).drop("peer_group", "ok")


def _counts(panel: DataFrame, universe: str, keys: list[str], types: dict[str, tuple[str, str, list[str]]]) -> DataFrame:
    """One grouping-sets aggregation, unpivoted. keys are grouped in every set; types: set column -> group_type, metrics."""
    is_ = lambda c, v: F.when(F.col(c) == v, 1).otherwise(0)
    flags = panel.select(
        *keys, *types, F.lit(1).alias("total"), is_("regime_label", "LEADER").alias("leader"), is_("regime_label", "CONTENDER").alias("contender"), is_("regime_label", "LAGGARD").alias("laggard"),
        is_("regime_label", "WEAK").alias("weak"), "above_20", "above_50", F.col("pass_trend").alias("above_200"), is_("vol_label", "HIGH").alias("high_vol"),
        is_("acc_watch", "EARLY").alias("acc_early"), is_("acc_watch", "PROGRESS").alias("acc_progress"), is_("acc_watch", "SHIFT").alias("acc_shift"),
    )
    sets = [[F.col(k) for k in keys]] + [[F.col(k) for k in (*keys, c)] for c in types]
    sums = flags.groupingSets(sets, *(F.col(c) for c in (*keys, *types))).agg(F.grouping_id().alias("gid"), *(F.sum(m).alias(m) for m in ALL_METRICS))
    again = {"leaders": "leader", "above20": "above_20", "above50": "above_50", "above200": "above_200"}
    pair = lambda names: F.array(*(F.struct(F.lit(m).alias("metric"), F.col(again.get(m, m)).cast("double").alias("value")) for m in names))
    full = (1 << len(types)) - 1
    layer = F.col("layer") if "layer" in keys else F.lit("all")
    top = F.when(layer == "all", pair(ALL_METRICS)).otherwise(pair(LAYER_METRICS))
    group, key, cells = chain([(F.col("gid") == full, "all")]), chain([(F.col("gid") == full, "")]), F.when(F.col("gid") == full, top)
    for i, (c, (kind, how, metrics)) in enumerate(types.items()):
        here = F.col("gid") == full - (1 << (len(types) - 1 - i))
        group, cells = F.coalesce(group, F.when(here, F.lit(kind))), F.coalesce(cells, F.when(here & F.col(c).isNotNull(), pair(metrics)))
        key = F.coalesce(key, F.when(here, slug(c) if how == "slug" else F.col(c)))
    out = sums.select("date", layer.alias("layer"), group.alias("group_type"), key.alias("group_key"), F.inline(cells))
    return out.select("date", F.lit(universe).alias("universe"), "layer", "group_type", "group_key", "metric", "value")


def _types(panel: DataFrame, groups: list[str]) -> tuple[DataFrame, dict]:
    comm = F.when(F.col("commodity") != "", F.col("commodity"))
    columns = {
        "cap": {"g_cap": (F.col("cap_band"), "cap", "as is", CAP_METRICS)},
        "sector": {"g_sector": (F.col("sector"), "sector", "slug", SECTOR_METRICS)},
        "industry": {"g_industry": (F.when(F.trim("industry") != "", F.trim("industry")), "industry", "slug", CAP_METRICS)},
        "commodity": {
            "g_commodity": (comm, "commodity", "slug", [*SECTOR_METRICS, "acc_early"]),
            "g_commodity_type": (F.concat(comm, F.lit("_"), slug(F.coalesce("type", F.lit("")))), "commodity", "as is", CAP_METRICS),
            "g_commodity_cap": (F.concat(comm, F.lit("_"), F.coalesce("cap_band", F.lit(""))), "commodity", "as is", CAP_METRICS),
        },
        "type": {"g_type": (F.coalesce("type", F.lit("")), "type", "slug", CAP_METRICS)},
    }
    chosen = {c: spec for g in groups for c, spec in columns[g].items()}
    return panel.select("*", *(spec[0].alias(c) for c, spec in chosen.items())), {c: spec[1:] for c, spec in chosen.items()}


def breadth_counts(panel: DataFrame, universe: str, groups: list[str] | None = None) -> DataFrame:
    """Counts of the panel by date and group, long: date, universe, layer, group_type, group_key, metric, value."""
    rows, types = _types(panel, groups or ["cap", "sector", "industry", "commodity", "type"])
    return _counts(rows, universe, ["date"], types)


def breadth_layers(panel: DataFrame, universe: str, layers: DataFrame) -> DataFrame:
    """The same counts for each layer of layers(layer, ticker); industries only in the layer sp."""
    rows, types = _types(panel.join(layers, "ticker"), ["cap", "sector", "industry"])
    rows = rows.withColumn("g_industry", F.when(F.col("layer") == "sp", F.col("g_industry")))
    return _counts(rows, universe, ["date", "layer"], types)


def breadth_layer_sets(members: DataFrame, groups: DataFrame, inside: list[str]) -> DataFrame:
    """Layer sp: members in any of the indices; layer rus: members in none of them."""
    index = groups.where((F.col("group_type") == "index") & F.col("group_key").isin(inside)).select("ticker")
    tickers = members.select("ticker").distinct()
    inner, outer = tickers.intersect(index), tickers.exceptAll(index.distinct())
    return inner.select(F.lit("sp").alias("layer"), "ticker").unionByName(outer.select(F.lit("rus").alias("layer"), "ticker"))


def breadth_guard(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming without the days whose total is under GUARD_RATIO of the median of the newest stored totals of its universe."""
    total = (F.col("layer") == "all") & (F.col("group_type") == "all") & (F.col("metric") == "total")
    newest = stored.where(total).withColumn("k", F.row_number().over(Window.partitionBy("universe").orderBy(F.desc("date")))).where(F.col("k") <= GUARD_DAYS)
    base = newest.groupBy("universe").agg(F.median("value").alias("base"))
    bad = incoming.where(total).join(base, "universe").where((F.col("base") > 0) & (F.col("value") < F.col("base") * GUARD_RATIO)).select("universe", "date")
    return incoming.join(bad, ["universe", "date"], "left_anti")


def store_breadth(table: StoredTable, incoming: DataFrame) -> StoredTable:
    """Write the days that pass the guard, each replacing what its universe has stored for it; others stay as they are stored."""
    return table.replace(breadth_guard(incoming, table.read()), ["universe", "date"])


def breadth_missing_days(calendar: DataFrame, stored_days: DataFrame, end: str, backfill_days: int = 400, redo: int = 2) -> DataFrame:
    """Days to write: those of calendar(date) in the backfill span that are not stored, and always the last stored ones again."""
    newest = stored_days.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy(F.desc("date"))))  # one row a day
    done = newest.where(F.col("k") > redo).select("date")
    span = calendar.select("date").distinct().where(F.col("date") >= F.date_sub(F.to_date(F.lit(end)), backfill_days))
    return span.join(F.broadcast(done), "date", "left_anti")


def breadth_incremental(bars: DataFrame, info: DataFrame, universe: str, stored_days: DataFrame, end: str, backfill_days: int = 400, warmup_days: int = 400) -> DataFrame:
    """Counts of the days to write. Only the backfill span and warmup_days before it are read, enough for the longest look-back."""
    recent = bars.where(F.col("date") >= F.date_sub(F.to_date(F.lit(end)), backfill_days + warmup_days))
    members = recent.where(F.col("adj_close").isNotNull()).join(info.select("ticker"), "ticker", "left_semi")
    return breadth_counts(breadth_panel(recent, info, only=breadth_missing_days(members, stored_days, end, backfill_days)), universe)


def breadth_rebuild(bars: DataFrame, info: DataFrame, universe: str, skip_rows: int = 200) -> DataFrame:
    """Counts of all days but the calendar's first skip_rows, which have no full look-back."""
    days = bars.where(F.col("adj_close").isNotNull()).join(info.select("ticker"), "ticker", "left_semi").select("date").distinct()
    kept = days.withColumn("k", F.row_number().over(Window.orderBy("date"))).where(F.col("k") > skip_rows)  # one row a day
    return breadth_counts(breadth_panel(bars, info, only=kept), universe)


PREFIX = {"all": "", "cap": "", "sector": "sec_", "industry": "ind_", "commodity": "comm_", "type": "type_"}


def wide_name() -> Column:
    """Column name of a cell in wide form: layer, group prefix, key and metric."""
    prefix = chain([(F.col("group_type") == k, v) for k, v in PREFIX.items()], "")
    return F.concat(F.when(F.col("layer") != "all", F.concat("layer", F.lit("_"))).otherwise(""), prefix, F.when(F.col("group_key") != "", F.concat("group_key", F.lit("_"))).otherwise(""), F.col("metric"))


def breadth_wide(long: DataFrame, names: list[str]) -> DataFrame:
    """One row per universe and date with the named columns (for export only)."""
    return long.withColumn("name", wide_name()).groupBy("universe", "date").pivot("name", names).agg(F.first("value"))


def breadth_long(wide: DataFrame, caps: tuple[str, ...] = ("large", "mid", "small"), layers: tuple[str, ...] = ("sp", "rus")) -> DataFrame:
    """Back to long form: names are parsed for layer, group prefix, the longest metric at the end, and the key between; nulls drop."""
    cells = wide.unpivot(["universe", "date"], [c for c in wide.columns if c not in ("universe", "date")], "name", "value").where("value is not null")
    metrics = sorted({*ALL_METRICS, *SECTOR_METRICS, *CAP_METRICS}, key=lambda m: (-len(m), m))
    pattern = rf"^(?:({'|'.join(layers)})_)?(?:(sec|ind|comm|type)_(.+)_|({'|'.join(caps)})_)?({'|'.join(metrics)})$"
    part = lambda i: F.regexp_extract("name", pattern, i)
    kind = lookup_prefix(part(2), part(4))
    return cells.select("date", "universe", F.when(part(1) == "", "all").otherwise(part(1)).alias("layer"), kind.alias("group_type"), F.concat(part(3), part(4)).alias("group_key"), part(5).alias("metric"), "value")


def lookup_prefix(prefix: Column, cap: Column) -> Column:
    return chain([(prefix == "sec", "sector"), (prefix == "ind", "industry"), (prefix == "comm", "commodity"), (prefix == "type", "type"), (cap != "", "cap")], "all")


SPANS = (7, 28, 91)


def summary_days(days: DataFrame, spans: tuple[int, ...] = SPANS) -> DataFrame:
    """Of days(date): the newest, and the newest at or before each span of calendar days ago, as one row today, d<span>."""
    today = days.agg(F.max("date").alias("today"))
    return days.crossJoin(F.broadcast(today)).groupBy("today").agg(*(F.max(F.when(F.col("date") <= F.date_sub("today", k), F.col("date"))).alias(f"d{k}") for k in spans))  # one row of today


def breadth_summary(long: DataFrame, days: DataFrame | None = None, spans: tuple[int, ...] = SPANS) -> DataFrame:
    """Newest value of each cell of stored counts, and its change since the newest day at or before each span of calendar days ago.

    days(date) is the calendar of the counts; without it the stored days are looked up first. Only four days' cells are read.
    """
    keys = ["universe", "layer", "group_type", "group_key", "metric"]
    cut = summary_days(days.select("date").distinct() if days is not None else long.select("date").distinct(), spans)
    marks = cut.select(F.explode(F.array(F.struct(F.lit(0).alias("back"), F.col("today").alias("date")), *(F.struct(F.lit(k).alias("back"), F.col(f"d{k}").alias("date")) for k in spans))).alias("x")).select("x.*")
    rows = long.join(F.broadcast(marks), "date")  # a row a span
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("value")))
    out = rows.groupBy(*keys).agg(at(0).alias("value"), *(at(k).alias(f"v{k}") for k in spans)).where("value is not null")
    return out.select(*keys, "value", *((F.col("value") - F.col(f"v{k}")).alias(f"change_{k}") for k in spans))


def breadth_today(bars: DataFrame, info: DataFrame, universe: str) -> DataFrame:
    """The summary straight from bars: its four days are chosen from the calendar first, and only they are ranked and counted."""
    days = bars.where(F.col("adj_close").isNotNull()).join(info.select("ticker"), "ticker", "left_semi").select("date").distinct()
    cut = summary_days(days)
    only = cut.select(F.explode(F.array(*cut.columns)).alias("date"))
    return breadth_summary(breadth_counts(breadth_panel(bars, info, only=only), universe), days)


def read_breadth(
    long: DataFrame, universe: str, layer: str = "all", group_type: str = "all", group_key: str = "", metric: str | None = None, start: str | None = None, end: str | None = None, offset: int = 0, limit: int = 100
) -> DataFrame:
    """A page of one group's stored cells, newest first, then by metric."""
    rows = long.where((F.col("universe") == universe) & (F.col("layer") == layer) & (F.col("group_type") == group_type) & (F.col("group_key") == group_key))
    for c, wanted, keep in (("metric", metric, F.col("metric") == F.lit(metric)), ("date", start, F.col("date") >= F.lit(start)), ("date", end, F.col("date") <= F.lit(end))):
        rows = rows.where(keep) if wanted else rows
    return rows.orderBy(F.desc("date"), "metric").offset(offset).limit(limit)
