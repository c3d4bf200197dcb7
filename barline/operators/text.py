"""Text jobs: number parsing, chunking, nearest chunks, keyword scans and notices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import chain
from ..sources.stored import cut
from .universe import primary_exposure

CHUNK_CHARS, OVERLAP_CHARS = 1500, 200
NOTICE_KINDS = {"603": "initial", "604": "change", "605": "cease"}


def metric_parse(text: Column) -> Column:
    """'45.1%', '$8.14B' without its suffix, 'N/A' as null."""
    return F.trim(F.regexp_replace(text, r"[%$,]", "")).try_cast("double")


def cap_parse(text: Column) -> Column:
    """Market cap with a T, B or M suffix."""
    bare = F.regexp_replace(F.trim(text), r"[$,]", "")
    scale = chain([(bare.endswith("T"), 1e12), (bare.endswith("B"), 1e9), (bare.endswith("M"), 1e6)], 1.0)
    return F.regexp_replace(bare, r"[TBM]$", "").try_cast("double") * scale


def explorer_profile(sector: Column, industry: Column, market_cap: Column, ticker: Column) -> Column:
    both = F.lower(F.concat_ws(" ", sector, industry))
    hit = both.rlike("basic materials|materials|mining|resources|energy|commodities|explor|miner")
    small = F.coalesce(market_cap < 3e9, F.lit(False)) & hit
    return chain([(small & F.lower(ticker).endswith(".ax"), "aus_small_cap_explorers"), (small, "small_cap_explorers")], "generic")


def carried_from(end: int, lengths: np.ndarray, overlap: int) -> int:
    """First of the words before end that a next chunk repeats: as many whole last words as fit, each with one space."""
    back = np.cumsum(lengths[:end][::-1] + 1)
    return end - int(np.searchsorted(back, overlap, side="right"))


def pack_paragraphs(text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """Paragraphs packed up to size characters; a new chunk begins with the last words of the one before, overlap characters at most.

    Running sums of the paragraphs' lengths give each cut by a search; a paragraph longer than size is a chunk's only one.
    """
    parts = [p for p in map(str.strip, text.split("\n\n")) if p]
    total = np.concatenate([[0], np.cumsum([len(p) + 2 for p in parts])])
    chunks, at, lead = [], 0, ""
    while at < len(parts):
        begin = len(lead) + 2 if chunks else 0  # the carried words and their gap, even if there are none
        # the next paragraph comes in while all of them, with gaps, stay within size; the first one always does
        end = max(at + 1, int(np.searchsorted(total, total[at] + size + 2 - begin, side="right")) - 1)
        chunk = "\n\n".join([lead, *parts[at:end]] if chunks else parts[at:end])
        chunks.append(chunk.strip())
        words = chunk.split()
        lead = " ".join(words[carried_from(len(words), np.array([len(w) for w in words]), overlap) :])
        at = end
    return chunks


def chunk_text(docs: DataFrame, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Chunks of docs(doc_id, text): doc_id, chunk_idx, chunk. A document's paragraphs are packed within its own row."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, i, c) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for i, c in enumerate(pack_paragraphs(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_idx", "chunk"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, chunk_idx long, chunk string")


TILE_BYTES = 4 << 20  # vectors of a tile
MARGIN = 1e-6  # relative error that distances by matrix products may have


def _tiles(rows: DataFrame, tag: str, by: str) -> tuple[DataFrame, int]:
    """rows(id, v, ...) as tiles of about TILE_BYTES: tile, ids, vectors (one binary), low and high norm. Rows of similar norms share a tile."""
    rows = rows.where("v is not null").withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))))
    size, width = rows.agg(F.sum(F.size("v") * 8), F.max(F.size("v"))).first()
    n = max(1, -(-int(size or 0) // TILE_BYTES))
    dealt = rows.repartitionByRange(n, "norm", by) if n > 1 else rows.repartition(1)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, 2 * TILE_BYTES // max(1, 8 * int(width or 1)))  # equal norms may crowd a range, so a partition may be several tiles
        got = list(batches)  # a tile's rows, or a few tiles'
        table = pa.Table.from_batches(got) if got else pa.table({})
        for at in range(0, table.num_rows, most):
            part = table.slice(at, most)
            v = np.stack([np.asarray(x, dtype=np.float64) for x in part["v"].to_pylist()])
            norms = part["norm"].to_numpy()
            lists = [pa.array([part[c].to_pylist()], pa.list_(part.schema.field(c).type)) for c in names]
            yield pa.RecordBatch.from_arrays([pa.array([f"{TaskContext.get().partitionId()}-{at}"]), *lists, pa.array([v.tobytes()], pa.binary()), pa.array([float(norms.min())]), pa.array([float(norms.max())])], names=["tile", *names, "vectors", "low", "high"])

    names = [c for c in rows.columns if c not in ("v", "norm")]
    kinds = ", ".join(f"`{c}` array<{rows.schema[c].dataType.simpleString()}>" for c in names)
    return cut(dealt.select(*names, "v", "norm").mapInArrow(pack, f"tile string, {kinds}, vectors binary, low double, high double"), tag), n


def chunk_topk(corpus: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """The n nearest of corpus(vec_id, v, source) to each of queries(query_id, q) by squared distance, ties by id; a row is not its own
    neighbour: query_id, vec_id, source, distance, place. Rows without a vector are left out.

    Exact, as a join of blocks: vectors of similar norms form tiles, each pair of a query tile and a corpus tile meets in one task, which
    takes one matrix product and keeps the n best of each query. Two norms differ by no more than the distance of their vectors: a first
    round over the corpus tiles whose norms are a query tile's own gives bounds, and tiles further off than the widest of these are
    never joined. Products only choose candidates; distances that decide are summed term by term.
    """
    corpus_tiles, n_corpus = _tiles(corpus.select("vec_id", "source", "v"), "corpus-tiles", "vec_id")
    query_tiles, _ = _tiles(queries.select("query_id", F.col("q").alias("v")), "query-tiles", "query_id")

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qid, qv, vid, source, cv, tile in zip(*(batch.column(c).to_pylist() for c in ("query_id", "q_vectors", "vec_id", "source", "vectors", "q_tile")), strict=True):
                q, c = np.frombuffer(qv).reshape(len(qid), -1), np.frombuffer(cv).reshape(len(vid), -1)
                ids, own = np.array(vid), np.array(qid)
                square, squares = (c * c).sum(axis=1), (q * q).sum(axis=1)
                rows = []
                step = max(1, (32 << 20) // (8 * len(ids)))  # rows of the product at a time
                for at in range(0, len(own), step):
                    block = squares[at : at + step, None] + square - 2 * (q[at : at + step] @ c.T)
                    block[own[at : at + step, None] == ids] = np.inf
                    some = min(n, len(ids))
                    worst = np.partition(block, some - 1, axis=1)[:, some - 1]
                    for k in range(len(block)):
                        # all that may be among the n best whatever the product's error
                        near = np.flatnonzero(block[k] <= worst[k] + MARGIN * (squares[at + k] + square.max()) + 1e-12) if np.isfinite(worst[k]) else np.flatnonzero(np.isfinite(block[k]))
                        d = np.square(c[near] - q[at + k]).cumsum(axis=1)[:, -1]  # summed in order, as the rows of two engines must agree
                        best = np.lexsort((ids[near], d))[:n]
                        rows += [(tile, int(own[at + k]), int(ids[i]), source[i], float(x)) for i, x in zip(near[best].tolist(), d[best], strict=True)]
                columns = zip(*rows, strict=True) if rows else [()] * 5
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], names=["q_tile", "query_id", "vec_id", "source", "distance"])

    found = "q_tile string, query_id long, vec_id long, source string, distance double"
    bounds = query_tiles.select(F.col("tile").alias("q_tile"), F.col("low").alias("q_low"), F.col("high").alias("q_high"))
    ranges = corpus_tiles.select("tile", "low", "high")
    gap = F.greatest(F.lit(0.0), F.col("low") - F.col("q_high"), F.col("q_low") - F.col("high"))
    pairs = bounds.crossJoin(ranges).withColumn("gap", gap)  # names and norms of tiles only
    meet = lambda chosen: (
        chosen.select("q_tile", "tile").join(query_tiles.select(F.col("tile").alias("q_tile"), "query_id", F.col("vectors").alias("q_vectors")), "q_tile")
        .join(corpus_tiles.select("tile", "vec_id", "source", "vectors"), "tile").repartition(max(1, n_corpus), "q_tile", "tile").mapInArrow(nearest, found)
    )
    closest = F.row_number().over(Window.partitionBy("q_tile").orderBy("gap", F.abs(F.col("low") + F.col("high") - F.col("q_low") - F.col("q_high")), "tile"))
    ranked = cut(pairs.withColumn("k", closest), "tile-pairs")
    first = cut(meet(ranked.where("k <= 2")), "nearest")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    held = first.withColumn("place", place).where(F.col("place") <= n).groupBy("q_tile", "query_id").agg(F.max("distance").alias("worst"), F.count("*").alias("have"))
    # a tile with a query that has fewer than n neighbours yet has no bound
    widest = held.groupBy("q_tile").agg(F.when(F.min("have") >= n, F.sqrt(F.max("worst"))).alias("reach"), F.count("*").alias("known"))
    sizes = query_tiles.select(F.col("tile").alias("q_tile"), F.size("query_id").alias("size"))
    reach = sizes.join(widest, "q_tile", "left").select("q_tile", F.when(F.col("known") == F.col("size"), F.col("reach")).alias("reach"))
    rest = ranked.where("k > 2").join(reach, "q_tile").where(F.col("reach").isNull() | (F.col("gap") <= F.col("reach") * (1 + MARGIN)))
    every = first.unionByName(meet(rest))
    return every.withColumn("place", place).where(F.col("place") <= n).drop("q_tile")


# Company-form words that a name's stem leaves out.
NAME_FORMS = r"(?i)\b(?:limited|ltd\.?|corporation|corp\.?|incorporated|inc\.?|plc|nl|group|holdings?|resources|mining|metals|minerals)\b"


def _quoted(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def strip_name(text: Column, name: Column) -> Column:
    """A text without its company's name, in any case, and without the name's stem if that has four characters or more."""
    name = F.coalesce(name, F.lit(""))
    stem = F.trim(F.regexp_replace(F.trim(F.regexp_replace(name, NAME_FORMS, " ")), r"\s+", " "))
    out = F.when(name == "", text).otherwise(F.regexp_replace(text, F.concat(F.lit("(?i)"), _quoted(name)), F.lit(" ")))
    return F.when(F.length(stem) < 4, out).otherwise(F.regexp_replace(out, F.concat(F.lit("(?i)"), _quoted(stem), F.lit("(?:'s)?")), F.lit(" ")))


# Commodities whose stocks are scanned, and the keywords of each commodity, in the order in which a snippet is sought.
SOURCE_COMMODITIES = ["gold", "silver", "platinum", "palladium"]
KEYWORDS = {
    "gold": ["gold"], "silver": ["silver"], "copper": ["copper"], "nickel": ["nickel"], "platinum": ["platinum", "pgm", "pgms", "platinum group"], "palladium": ["palladium"],
    "lithium": ["lithium", "spodumene"], "uranium": ["uranium"], "iron_ore": ["iron ore"], "oil_gas": ["oil and gas", "petroleum", "natural gas", "crude oil"],
}
AROUND_HIT = 70  # characters of a snippet on each side of a hit
MOST_KEYWORDS = 1 << 20
_LOWER = {c: c + 32 for c in range(65, 91)}


def keyword_table(spark: SparkSession, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(c, i, w) for c, words in (keywords or KEYWORDS).items() for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "commodity string, place int, keyword string")


def keyword_hits(text: str, automaton, around: int = AROUND_HIT) -> list[tuple[str, int, str]]:
    """Commodity, hits and snippet of all whole-word keywords of a text, in any ASCII case, from one pass of the automaton.

    Its values are lists of (commodity, place, length); the snippet surrounds the first hit of the first keyword that has one.
    """
    plain = text.translate(_LOWER)  # as long as the text
    count: dict[str, int] = {}
    shown: dict[str, tuple[int, int, int]] = {}  # place, begin and end of the hit to show
    free: dict[tuple[str, int], int] = {}
    letter = lambda i: 0 <= i < len(plain) and "a" <= plain[i] <= "z"
    for last, found in automaton.iter(plain):
        for commodity, place, size in found:
            begin = last + 1 - size
            if letter(begin - 1) or letter(last + 1) or begin < free.get((commodity, place), 0):
                continue
            free[commodity, place] = last + 1
            count[commodity] = count.get(commodity, 0) + 1
            shown[commodity] = min(shown.get(commodity, (place, begin, last + 1)), (place, begin, last + 1))
    out = []
    for commodity, (_, begin, end) in shown.items():
        a, b = max(0, begin - around), min(len(text), end + around)
        out.append((commodity, count[commodity], ("…" if a else "") + text[a:b].replace("\n", " ") + ("…" if b < len(text) else "")))
    return out


def summary_scan(texts: DataFrame, groups: DataFrame, rejected: DataFrame, keywords: DataFrame, source: list[str] | None = None) -> DataFrame:
    """Commodities that a flagged ticker's description names beside those it has: ticker, name, cap_band, primary, primary_type, existing,
    commodity, hits, snippet.

    texts has ticker, name, cap_band, text; groups the flags (ticker, group_type, group_key, attr, priority), of which one of source makes
    a ticker a target; rejected(ticker, group_key) are never proposed; keywords has commodity, place, keyword. The company's own name is
    removed first. All keywords form one automaton, so a text is passed once however many there are.
    """
    import ahocorasick

    table = keywords.limit(MOST_KEYWORDS + 1).collect()
    if len(table) > MOST_KEYWORDS:
        raise ValueError(f"more than {MOST_KEYWORDS} keywords")
    words: dict[str, list[tuple[str, int, int]]] = {}
    for commodity, place, keyword in table:
        words.setdefault(keyword.translate(_LOWER), []).append((commodity, place, len(keyword)))
    flags = groups.where("group_type = 'commodity'")
    listed = F.transform(F.array_sort(F.collect_set(F.struct("priority", "group_key"))), lambda x: x["group_key"])
    targets = flags.where(F.col("group_key").isin(SOURCE_COMMODITIES if source is None else source)).select("ticker").distinct()
    about = flags.groupBy("ticker").agg(F.array_join(listed, ", ").alias("existing")).join(targets, "ticker", "left_semi").join(primary_exposure(groups), "ticker")
    about = about.select("ticker", "existing", F.col("commodity").alias("primary"), F.coalesce("type", F.lit("producer")).alias("primary_type"))
    rows = texts.where("text <> ''").join(about, "ticker").select("ticker", strip_name(F.col("text"), F.col("name")).alias("clean"), F.struct("name", "cap_band", "primary", "primary_type", "existing").alias("about"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for word, values in words.items():
            automaton.add_word(word, values)
        automaton.make_automaton()
        for batch in batches:
            found = [keyword_hits(t, automaton) if words else [] for t in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            flat = list(zip(*(hit for x in found for hit in x), strict=True)) or [()] * 3
            picked = pa.array(at, pa.int64())
            columns = [pa.array(list(flat[0]), pa.string()), pa.array(list(flat[1]), pa.int64()), pa.array(list(flat[2]), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(2).take(picked), *columns], names=["ticker", "about", "commodity", "hits", "snippet"])

    kind = rows.schema["about"].dataType.simpleString()
    out = rows.mapInArrow(scan, f"ticker string, about {kind}, commodity string, hits long, snippet string")
    known = flags.select("ticker", F.col("group_key").alias("commodity")).unionByName(rejected.select("ticker", F.col("group_key").alias("commodity"))).distinct()
    return out.join(known, ["ticker", "commodity"], "left_anti").select("ticker", "about.*", "commodity", "hits", "snippet")


# Good and bad thresholds of a metric and which way is better; None: no verdict. Profiles override some.
GUIDES = {
    "pe_ratio": (18.0, 30.0, "low"), "forward_pe": (18.0, 30.0, "low"), "pb_ratio": (1.5, 4.0, "low"), "ps_ratio": (2.5, 6.0, "low"), "gross_margin": (40.0, 20.0, "high"),
    "operating_margin": (12.0, 7.0, "high"), "profit_margin": (10.0, 4.0, "high"), "roe": (12.0, 8.0, "high"), "roa": (6.0, 2.0, "high"), "debt_to_equity": (1.0, 2.0, "low"),
    "current_ratio": (1.3, 1.0, "high"), "revenue_growth": (7.0, 0.0, "high"), "dividend_yield": (None, None, None),
}
PROFILE_GUIDES = {
    "small_cap_explorers": {"debt_to_equity": (2.5, 8.0, "low"), "current_ratio": (1.0, 0.75, "high"), "revenue_growth": (5.0, -10.0, "high"), "profit_margin": (0.0, -20.0, "high")},
    "aus_small_cap_explorers": {"debt_to_equity": (2.8, 8.5, "low"), "current_ratio": (1.0, 0.75, "high"), "revenue_growth": (5.0, -10.0, "high"), "profit_margin": (0.0, -20.0, "high")},
}


def metric_verdict(cells: DataFrame) -> DataFrame:
    """All columns of cells(metric, text, profile, ...) with value and verdict: good, neutral, bad; null for an unknown metric, one without
    a direction, or text that is no number. Profiles without a threshold of their own take the generic one."""
    rows = [(p, m, *PROFILE_GUIDES.get(p, {}).get(m, guide)) for p in ("generic", *PROFILE_GUIDES) for m, guide in GUIDES.items()]
    guides = cells.sparkSession.createDataFrame(rows, "_p string, metric string, _good double, _bad double, _way string")
    profile = F.when(F.col("profile").isin(*PROFILE_GUIDES), F.col("profile")).otherwise("generic")
    v = F.col("value")
    low = chain([(v <= F.col("_good"), "good"), (v >= F.col("_bad"), "bad")], "neutral")
    high = chain([(v >= F.col("_good"), "good"), (v <= F.col("_bad"), "bad")], "neutral")
    joined = cells.withColumn("_p", profile).join(F.broadcast(guides), ["_p", "metric"], "left").withColumn("value", metric_parse(F.col("text")))  # a fixed table
    verdict = F.when(v.isNull(), None).when(F.col("_way") == "low", low).when(F.col("_way") == "high", high)
    return joined.withColumn("verdict", verdict).drop("_p", "_good", "_bad", "_way")


# Phrases of a title by form, the first that it holds counts, so a ceasing one is no change; the site's address.
NOTICE_PHRASES = {"603": "becoming a substantial holder", "605": "ceasing to be a substantial holder", "604": "change in substantial holding"}
NOTICE_SITE = "https://www.asx.com.au"


def notice_parse(pages: DataFrame) -> DataFrame:
    """Announcement rows of pages(html): ann_id, date, time, ticker, title, pdf_url, form, action; titles of other kinds drop.

    date is ISO text, or the text as it stands if it is no date; pdf_url is absolute. A row that lacks a cell drops.
    """
    cells = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("r"))
    get = lambda pattern: F.regexp_extract("r", "(?s)" + pattern, 1)
    href, shown = get(r'href="([^"]*idsId=\d+)"'), get(r"(\d{2}/\d{2}/\d{4})")
    rows = cells.select(
        get(r"idsId=(\d+)").alias("ann_id"), F.coalesce(F.date_format(F.try_to_date(shown, "dd/MM/yyyy"), "yyyy-MM-dd"), shown).alias("date"), get(r"(\d{1,2}:\d{2} [ap]m)").alias("time"),
        get(r"<td[^>]*>\s*([A-Z0-9]{2,6})\s*</td>").alias("ticker"), F.trim(get(r"<a[^>]*>\s*([^<]*?)\s*<")).alias("title"), F.concat(F.lit(NOTICE_SITE), F.replace(href, F.lit("&amp;"), F.lit("&"))).alias("pdf_url"),
    )
    form = chain([(F.lower("title").contains(phrase), form) for form, phrase in NOTICE_PHRASES.items()])
    rows = rows.withColumn("form", form).withColumn("action", chain([(F.col("form") == k, v) for k, v in NOTICE_KINDS.items()]))
    return rows.where("ann_id <> '' and date <> '' and ticker <> '' and form is not null")


def notice_merge(notices: DataFrame, core: list[str]) -> DataFrame:
    """One row an announcement, the first by place; columns that are not core go to a JSON payload."""
    k = F.row_number().over(Window.partitionBy("ann_id").orderBy("place"))
    rest = [c for c in notices.columns if c not in (*core, "place")]
    return notices.withColumn("k", k).where("k = 1").select(*core, F.to_json(F.struct(*rest)).alias("payload"))


def notice_read(stored: DataFrame, keys: list[str], end: str, days: int) -> DataFrame:
    """Stored notices of the last days, newest first, with the payload's keys as columns."""
    open_ = F.from_json("payload", "map<string,string>")
    rows = stored.where((F.col("date") > F.date_sub(F.to_date(F.lit(end)), days)) & (F.col("date") <= F.lit(end))).withColumn("m", open_)
    return rows.select(*(c for c in stored.columns if c != "payload"), *(F.try_element_at("m", F.lit(k)).alias(k) for k in keys)).orderBy(F.desc("date"), "ann_id")


def notice_groups(notices: DataFrame) -> DataFrame:
    return notices.groupBy("action").agg(F.array_join(F.sort_array(F.collect_set("ticker")), ",").alias("tickers"))
