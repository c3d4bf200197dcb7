"""Bar access, keyed upserts, dated documents and append-only runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import upsert
from ..sources.tables import BAR_COLUMNS

FIELDS = ["open", "high", "low", "close", "adj_close", "volume", "dividend", "split"]


CELLS = 1_000_000  # long rows made at a time of a block of wide ones


def bars_from_wide(wide: DataFrame, separator: str = "|") -> DataFrame:
    """A vendor's frame (date, then one column <field><separator><ticker>) as long rows; rows without a close drop, absent fields are null.

    Columns of a block are laid end to end in Arrow, so the plan has no expression a column and nothing is shuffled.
    """
    places: dict[str, dict[str, int]] = {}
    for i, c in enumerate(wide.columns):
        if c != "date":
            field, ticker = (c.split(separator) + [""])[:2]
            places.setdefault(ticker, {})[field] = i
    places = {t: of for t, of in places.items() if "close" in of}
    day = wide.columns.index("date")

    def lay(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            n, names = block.num_rows, list(places)
            step = max(1, CELLS // max(n, 1))
            for part in (names[at : at + step] for at in range(0, len(names), step)):
                columns = [pa.array(np.repeat(part, n), pa.string()), pa.concat_arrays([block.column(day)] * len(part))]
                for field in BAR_COLUMNS[2:]:
                    cells = [block.column(places[t][field]).cast(pa.float64()) if field in places[t] else pa.nulls(n, pa.float64()) for t in part]
                    cells = pa.concat_arrays(cells)
                    columns.append(pc.if_else(pc.is_nan(cells), pa.scalar(None, pa.float64()), cells))
                rows = pa.RecordBatch.from_arrays(columns, BAR_COLUMNS)
                yield rows.filter(pc.is_valid(rows.column("close")))

    numbers = ", ".join(f"{c} double" for c in BAR_COLUMNS[2:])
    placed = wide.toDF(*("date" if i == day else f"c{i}" for i in range(len(wide.columns))))  # tickers have dots
    return placed.mapInArrow(lay, f"ticker string, date {wide.schema['date'].dataType.simpleString()}, {numbers}")


def bars_long(bars: DataFrame, tickers: DataFrame, start: str | None = None, end: str | None = None, fields: list[str] | None = None) -> DataFrame:
    """Bars of a ticker set in an inclusive date range."""
    rows = bars.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    if start:
        rows = rows.where(F.col("date") >= F.lit(start))
    if end:
        rows = rows.where(F.col("date") <= F.lit(end))
    return rows.select("ticker", "date", *(fields or FIELDS))


def price_matrix(bars: DataFrame, tickers: list[str], start: str | None = None, end: str | None = None, field: str = "adj_close") -> DataFrame:
    """One field as a date by ticker matrix (export only), on all dates or from start to end; tickers without bars are null columns."""
    rows = bars.where(F.col("ticker").isin(tickers))
    for bound, keep in ((start, F.col("date") >= F.lit(start)), (end, F.col("date") <= F.lit(end))):
        rows = rows.where(keep) if bound else rows
    return rows.groupBy("date").pivot("ticker", tickers).agg(F.first(field))


def last_bar_date(bars: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    rows = bars if tickers is None else bars.join(tickers.select("ticker"), "ticker", "left_semi")
    return rows.agg(F.max("date").alias("last_date"))


def coverage(bars: DataFrame, tickers: DataFrame, start: str, end: str, least: float = 0.80) -> DataFrame:
    """Requested tickers, those with a bar in the window, and whether their share passes."""
    have = bars.where(F.col("date").between(F.lit(start), F.lit(end))).select("ticker").distinct().withColumn("have", F.lit(1))
    out = tickers.select("ticker").distinct().join(have, "ticker", "left").agg(F.count("*").alias("requested"), F.count("have").alias("covered"))
    return out.withColumn("passes", F.when(F.col("requested") > 0, F.col("covered") / F.col("requested") >= least).otherwise(F.lit(False)))


def upsert_bars(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(stored, incoming, ["ticker", "date"])


def latest_document(documents: DataFrame) -> DataFrame:
    """Newest document of every kind, with the number of its versions."""
    return documents.groupBy("kind").agg(F.max("date").alias("date"), F.max_by("text", "date").alias("text"), F.count("*").alias("versions"))


def save_documents(stored: DataFrame, incoming: DataFrame, created: str) -> DataFrame:
    """stored(kind, date, text, payload, created) with incoming documents, stamped as created, replacing those of the same kind and date."""
    return upsert(stored, incoming.withColumn("created", F.to_timestamp(F.lit(created))), ["kind", "date"])


def load_document(documents: DataFrame, kind: str, date: str | None = None) -> DataFrame:
    """The document of a kind and date, or the kind's newest one."""
    rows = documents.where(F.col("kind") == kind)
    return rows.where(F.col("date") == F.lit(date)) if date else rows.orderBy(F.desc("date")).limit(1)


def document_dates(documents: DataFrame, kind: str) -> DataFrame:
    """Dates of a kind's documents with when each was written, newest first."""
    return documents.where(F.col("kind") == kind).select("date", "created").orderBy(F.desc("date"))


def immutable_runs(runs: DataFrame, known: DataFrame) -> DataFrame:
    """Runs whose fingerprint (SHA-256 of the row's JSON with sorted names) isn't known yet, once each."""
    names = sorted(runs.columns)
    marked = runs.withColumn("run_id", F.sha2(F.to_json(F.struct(*names)), 256))
    return marked.dropDuplicates(["run_id"]).join(known.select("run_id"), "run_id", "left_anti")


def run_record(frames: dict[str, DataFrame], configuration: DataFrame, kind: str, run_id: str, created: str) -> DataFrame:
    """One append-only record of a run: run_id, kind, created, configuration (JSON of its one row with sorted names), its fingerprint, and the
    frames' row counts as JSON. The counts are taken by Spark; no frame reaches the driver."""
    counts = None
    for label in sorted(frames):
        n = frames[label].agg(F.count("*").alias(label))
        counts = n if counts is None else counts.crossJoin(n)  # rows of one count
    settings = F.to_json(F.struct(*sorted(configuration.columns)))
    return counts.select(F.to_json(F.struct(*sorted(frames))).alias("row_counts")).crossJoin(configuration.select(settings.alias("configuration"))).select(
        F.lit(run_id).alias("run_id"), F.lit(kind).alias("kind"), F.to_timestamp(F.lit(created)).alias("created"), "configuration", F.sha2("configuration", 256).alias("configuration_version"), "row_counts"
    )


def save_reviews(stored: DataFrame, reviews: DataFrame, created: str) -> DataFrame:
    """stored(review_id, content, created) with each new content of reviews(content) once; the id is its SHA-256, and what is stored never changes."""
    new = reviews.where("content is not null").select(F.sha2("content", 256).alias("review_id"), "content").dropDuplicates(["review_id"])
    return stored.unionByName(new.join(stored.select("review_id"), "review_id", "left_anti").withColumn("created", F.to_timestamp(F.lit(created))))


def adjustment_drift(stored: DataFrame, incoming: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Tickers whose adjusted close moved on a date that both have."""
    old = stored.select("ticker", "date", F.col("adj_close").alias("old"))
    both = incoming.select("ticker", "date", F.col("adj_close").alias("new")).join(old, ["ticker", "date"])
    return both.where((F.abs("old") > 0) & (F.abs(F.col("new") - F.col("old")) / F.abs("old") > tolerance)).select("ticker").distinct()


def refresh_plan(log: DataFrame, end: str, deep: DataFrame | None = None, overlap: int = 10, stale_after: int = 10, backfill_days: int = 1100) -> DataFrame:
    """Action for each ticker of log(ticker, first_date, last_date, failures): skip_stale, reload, backfill, current or incremental, with the start date.

    A ticker of deep(ticker, deep_start) without bars, or whose first bar lies behind its deep start's year, is reloaded from
    that start: what is stored of it is to be dropped.
    """
    day = F.date_sub(F.to_date(F.lit(end)), 0)
    back = F.when(F.dayofweek(day) == 2, 3).when(F.dayofweek(day) == 1, 2).otherwise(1)
    previous = F.date_sub(day, back.cast("int"))
    rows = log.withColumn("deep_start", F.lit(None).cast("date")) if deep is None else log.join(deep.select("ticker", "deep_start"), "ticker", "left")
    late = F.col("deep_start").isNotNull() & (F.col("last_date").isNull() | F.coalesce(F.year("first_date") > F.year("deep_start"), F.lit(False)))
    action = F.when(F.coalesce("failures", F.lit(0)) >= stale_after, "skip_stale").when(late, "reload").when(F.col("last_date").isNull(), "backfill").when(F.col("last_date") >= previous, "current").otherwise("incremental")
    start = F.when(action == "reload", F.col("deep_start")).when(action == "backfill", F.date_sub(day, backfill_days)).when(action == "incremental", F.to_date(F.date_trunc("week", F.date_sub("last_date", overlap))))
    return rows.select("ticker", action.alias("action"), start.alias("start"))


def fetch_log_update(log: DataFrame, batch: DataFrame, asked: DataFrame) -> DataFrame:
    """log after a batch of bars for the tickers asked: spans widen, rows add, failures reset on rows or grow by one."""
    new = batch.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("z"), F.count("*").alias("k"))
    asked = asked.select("ticker", F.lit(1).alias("asked")).distinct().join(new, "ticker", "left")
    both = log.join(asked, "ticker", "full")
    failures = F.when(F.col("asked").isNull(), F.col("failures")).when(F.col("k") > 0, 0).otherwise(F.coalesce("failures", F.lit(0)) + 1)
    return both.select(
        "ticker", F.least("first_date", "a").alias("first_date"), F.greatest("last_date", "z").alias("last_date"),
        F.when(F.coalesce("n_rows", "k").isNotNull(), F.coalesce("n_rows", F.lit(0)) + F.coalesce("k", F.lit(0))).alias("n_rows"), failures.cast("long").alias("failures"),
    )


def stale_report(log: DataFrame, securities: DataFrame, least: int = 3) -> DataFrame:
    return log.where(F.col("failures") >= least).join(securities.select("ticker", "name"), "ticker", "left").select("ticker", "name", "failures", "last_date").orderBy(F.desc("failures"), "ticker")


def read_series(rows: DataFrame, ticker: str, start: str | None = None, end: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of one key's dated rows, newest first."""
    rows = rows.where(F.col("ticker") == ticker)
    if start:
        rows = rows.where(F.col("date") >= F.lit(start))
    if end:
        rows = rows.where(F.col("date") <= F.lit(end))
    return rows.orderBy(F.desc("date")).offset(offset).limit(limit)
