"""Near-duplicates by improved consistent weighted sampling over TF-IDF word shingles.

1. Equal texts become one node. A small sketch of every node (the least shingle hash of each of BINS ranges, in bands) tells
   which nodes have an earlier near copy; only those that have none count for document frequencies, so a group of copies, exact
   or near, counts as about one text and doesn't lower the weight of its own shingles.
2. Every node's distinct shingles are counted over the corpus (exchange.py). A shingle weighs tf * (1 + ln((1 + N) / (1 + df))),
   rounded to a grid in the logarithm; N is the number of nodes that count.
3. Improved consistent weighted sampling draws SAMPLES (shingle, level) pairs a text; two texts agree in a draw
   with a probability that is their weighted Jaccard similarity. Bands of ROWS draws are hashed.
4. In each bucket of equal bands every node is paired with a few leaders, the least node of each of LEADERS hash classes, so
   pairs grow with nodes, not with squares of groups. Buckets that still hold several classes after each node's most
   frequent leader is verified get new leaders, SEEDS times in all. Leaders only join large groups cheaply: in buckets that are
   mixed even then, all pairs of different classes are compared (Cross), in units of about UNIT x UNIT nodes, each pair in
   the first band that it shares.
5. Pairs whose draws agree too seldom are left out (five standard deviations below the threshold); the others are
   verified by their weighted Jaccard similarity. Links join into classes by alternating star contractions.

Rows of a frequent bucket, sketch or hub are dealt over several tasks by a salt in every join.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BASE, Words, blocks, hash_words, mix, ragged, text_bytes, window_hashes
from .exchange import _planes, _unplanes, corpus_counts
from .store import materialize, remove

SHINGLE = 5
THRESHOLD = 0.8
SAMPLES, ROWS = 64, 4
LEADERS, SEEDS = 4, 2
UNIT = 512  # nodes on each side of a unit of pairs, about
FEW_PAIRS = 2000  # more pairs of a unit are verified by matrix products
BINS, SKETCH_ROWS = 16, 4  # sketch that tells which texts have an earlier near copy
GRID = 16  # weights are exp(level / GRID)
POOL_BITS = 16
TABLES = 192  # weights whose draws are tabled by rank, 64 KB each
RANKS, LEAST = 16, -15  # ranks a unit of ln a, from LEAST on
CHUNK = 1 << 16  # shingles drawn at a time, so that the arrays stay in a core's cache
SALTS = 16  # tasks that the rows of one frequent key are dealt over
HOT = 1024  # rows of a bucket for each task that it is dealt over
AGREE = THRESHOLD - 5 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / SAMPLES)


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within it, their counts there, and how many each text has.

    A text shorter than a shingle has one: all its words. A text without words has none.
    """
    every = window_hashes(words.hashes, size)
    values, counts, per = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], np.zeros(len(words.counts), dtype=np.int64)
    for d, (a, b) in enumerate(zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)):
        if b > a:
            own = every[a : b - size + 1] if b - a >= size else window_hashes(words.hashes[a:b], b - a) ^ np.uint64(b - a)
            v, c = np.unique(own, return_counts=True)
            values.append(v)
            counts.append(c)
            per[d] = len(v)
    return np.concatenate(values), np.concatenate(counts), per


def sketch_keys(values: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Band keys of every text that has shingles: texts of unweighted similarity J share a key with probability 1 - (1 - J**SKETCH_ROWS)**bands.

    The least hash of each of BINS ranges is the first one at or after the range's begin; an empty range takes the next one.
    """
    bounds = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - (BINS - 1).bit_length())
    begin = (np.cumsum(per) - per)[per > 0]
    least = np.empty((len(begin), BINS), dtype=np.uint64)
    for d, (a, n) in enumerate(zip(begin.tolist(), per[per > 0].tolist(), strict=True)):
        least[d] = values[a + np.searchsorted(values[a : a + n], bounds) % n]
    rows = least.reshape(len(begin), BINS // SKETCH_ROWS, SKETCH_ROWS)
    key = np.repeat(np.arange(BINS // SKETCH_ROWS, dtype=np.uint64)[None, :], len(begin), axis=0)
    for i in range(SKETCH_ROWS):
        key = mix(key * np.uint64(BASE) + rows[:, :, i])
    return key.view(np.int64)


def levels(tf: np.ndarray, df: np.ndarray, n_docs: int) -> np.ndarray:
    """Rounded logarithms of the TF-IDF weights."""
    idf = 1 + np.log((1 + n_docs) / (1 + np.clip(df, 1, max(1, n_docs))))
    return np.rint(GRID * np.log(tf * idf)).astype(np.int64)


@lru_cache(maxsize=1)
def _pool() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed random numbers: r and ln c for Gamma(2, 1) variables r and c, and uniform beta."""
    n = 1 << POOL_BITS

    def uniform(k: int) -> np.ndarray:
        return (mix(np.arange(n, dtype=np.uint64) + np.uint64(k * n + 1)).astype(np.float64) + 1) / 2.0**64

    return -np.log(uniform(1) * uniform(2)), np.log(-np.log(uniform(3) * uniform(4))), uniform(5)


def _draw(level: np.ndarray | int, r: np.ndarray, log_c: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Rank of ln a in the high half, a hash of t in the low half."""
    t = np.floor(level / GRID / r + beta)
    bits = (log_c - r * (t - beta + 1)).astype(np.float32).view(np.uint32)
    ordered = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
    return (ordered << np.uint64(32)) | (mix(t.astype(np.int64).astype(np.uint64)) & np.uint64(0xFFFFFFFF))


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Draws by ln a in steps of 1 / RANKS, one byte each: ascending with the draws, ends clipped."""
    ordered = (keys >> np.uint64(32)).astype(np.uint32)
    log_a = np.where(ordered >> 31, ordered ^ np.uint32(1 << 31), ~ordered).view(np.float32).astype(np.float64)
    return np.clip(np.floor((log_a - LEAST) * RANKS), 0, 255).astype(np.uint8)


@lru_cache(maxsize=TABLES)
def _rank_table(level: int) -> np.ndarray:
    """Ranks of the draws of all numbers of the pool at one weight."""
    return _ranks(_draw(level, *_pool()))


def signatures(values: np.ndarray, level: np.ndarray, per: np.ndarray) -> np.ndarray:
    """SAMPLES draws of every text that has shingles, as 32-bit hashes of (shingle, t).

    The least draw of a text is among those of its least rank, about one shingle a text, so whole draws are made of these alone.
    """
    size = per[per > 0]
    begin = np.cumsum(size) - size
    out = np.empty((len(begin), SAMPLES), dtype=np.uint32)
    if not len(begin):
        return out
    # ranks are looked up in tables, those of weights beyond TABLES (the rarest here) computed
    least = level.min()
    counts = np.bincount(level - least)
    common = np.argsort(-counts, kind="stable")[: min(TABLES, np.count_nonzero(counts))]
    row = np.full(len(counts), -1)
    row[common] = np.arange(len(common))
    table = np.concatenate([_rank_table(int(x)) for x in common + least])
    row = row[level - least]
    pool, odd = _pool(), mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    cuts = np.unique([*np.searchsorted(begin, np.arange(0, len(values), CHUNK)), len(begin)]).tolist()
    for first, last in zip(cuts[:-1], cuts[1:], strict=True):
        a, n = begin[first], size[first:last]
        b = a + n.sum()
        own, at, rows = values[a:b], begin[first:last] - a, row[a:b]
        rest, offset = np.flatnonzero(rows < 0), np.maximum(rows, 0).astype(np.uint64) << np.uint64(POOL_BITS)
        place, rank = np.empty_like(own), np.empty(len(own), np.uint8)
        some, drawn_at, cut = [], [], []
        for k in range(SAMPLES):
            np.multiply(own, odd[k], out=place)
            np.right_shift(place, np.uint64(64 - POOL_BITS), out=place)
            np.bitwise_or(place, offset, out=place)
            np.take(table, place.view(np.int64), out=rank, mode="clip")
            if len(rest):
                rank[rest] = _ranks(_draw(level[a:b][rest], *(x[place[rest]] for x in pool)))
            some.append(np.flatnonzero(rank == np.repeat(np.minimum.reduceat(rank, at), n)))
            drawn_at.append(place[some[-1]])
            cut.append(np.searchsorted(some[-1], at))
        before = np.cumsum([0, *map(len, some[:-1])])
        some, drawn_at = np.concatenate(some), np.concatenate(drawn_at) & np.uint64((1 << POOL_BITS) - 1)
        draws = _draw(level[a:b][some], *(x[drawn_at] for x in pool)) ^ (own[some] & np.uint64(0xFFFFFFFF))
        out[first:last] = np.minimum.reduceat(draws, np.concatenate(cut) + np.repeat(before, len(n))).reshape(SAMPLES, -1).T & np.uint64(0xFFFFFFFF)
    return out


def bands(drawn: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature; equal draws in different bands give different keys."""
    rows = drawn.reshape(len(drawn), SAMPLES // ROWS, ROWS).astype(np.uint64)
    key = np.repeat(np.arange(SAMPLES // ROWS, dtype=np.uint64)[None, :], len(drawn), axis=0)
    for i in range(ROWS):
        key = mix(key * np.uint64(BASE) + rows[:, :, i] + np.uint64(1))
    return key.view(np.int64)


def weighted_jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two packed vectors (see pack)."""
    (x, u), (y, v) = unpack(a), unpack(b)
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = x[at] == y
    least = np.minimum(u[at[both]], v[both]).sum()
    return float(least / (u.sum() + v.sum() - least))


def pack(values: np.ndarray, level: np.ndarray) -> bytes:
    """The leading 32 bits of the sorted shingle hashes, and their levels."""
    return (values >> np.uint64(32)).astype("<u4").tobytes() + level.astype("<i2").tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 6
    return np.frombuffer(data, "<u4", n), np.exp(np.frombuffer(data, "<i2", n, 4 * n) / GRID)


def similarities(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """weighted_jaccard of each packed vector of left with each of right, by products of matrices over their common shingles.

    The weights that a shingle has are steps: a text has those up to its own weight, so common steps add up to the least.
    """
    size = np.array([len(x) // 6 for x in (*left, *right)])
    text, n = np.repeat(np.arange(len(size)), size), len(left)
    value = np.concatenate([np.frombuffer(x, "<u4", len(x) // 6) for x in (*left, *right)]).astype(np.int64)
    level = np.concatenate([np.frombuffer(x, "<i2", len(x) // 6, len(x) // 6 * 4) for x in (*left, *right)]).astype(np.int64)
    total = np.bincount(text, np.exp(level / GRID), len(size))
    both = np.isin(value, np.intersect1d(value[text < n], value[text >= n]))
    text, value, level = text[both], value[both], level[both]
    steps, at = np.unique((value << 16) | (level + (1 << 15)), return_inverse=True)
    weight = np.exp(((steps & 0xFFFF) - (1 << 15)) / GRID)
    first = np.searchsorted(steps, steps >> 16 << 16)  # the least step of the same shingle
    gain = weight - np.where(first < np.arange(len(steps)), np.roll(weight, 1), 0.0)
    count = at - first[at] + 1
    row, column = np.repeat(text, count), ragged(first[at], count)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    least = np.zeros((n, len(right)))
    for begin in range(0, len(steps), 2048):
        a, b = np.searchsorted(column, [begin, begin + 2048])
        has = np.zeros((len(size), min(2048, len(steps) - begin)))
        has[row[a:b], column[a:b] - begin] = 1.0
        least += (has[:n] * gain[begin : begin + 2048]) @ has[n:].T
    return least / (total[:n, None] + total[None, n:] - least)


class Cross:
    """The pairs of one unit: rows of side 0 with rows of side 1 that are in other classes, share this bucket first and agree.

    Side 0 has the nodes outside the bucket's main class, side 1 all; a pair of two nodes outside counts once.
    """

    def __init__(self, unit: pa.RecordBatch):
        self.unit = unit
        key, side, main, node, class_id = (unit.column(unit.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("key", "side", "main", "node", "class_id"))
        self.left, self.right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        self.class_id = class_id
        x, y = self.left, self.right
        pairs = (class_id[x][:, None] != class_id[y]) & (main[y] | (node[x][:, None] < node[y]))
        if pairs.any():
            drawn = np.frombuffer(b"".join(unit.column(unit.schema.get_field_index("drawn")).to_pylist()), np.uint32).reshape(-1, SAMPLES)
            keys = bands(drawn)
            for band in range(int(np.flatnonzero((keys == key[0]).all(axis=0))[0])):
                pairs &= keys[x, band][:, None] != keys[y, band]
            same = np.zeros(pairs.shape, np.uint8)
            for k in range(SAMPLES):
                same += drawn[x, k][:, None] == drawn[y, k]
            pairs &= same >= AGREE * SAMPLES
        self.pairs = pairs

    def rows(self) -> np.ndarray:
        """Rows that are in a pair."""
        return np.concatenate([self.left[self.pairs.any(axis=1)], self.right[self.pairs.any(axis=0)]])

    def links(self) -> set[tuple[int, int]]:
        """Pairs of classes that join the classes of all similar pairs."""
        vector = self.unit.column(self.unit.schema.get_field_index("vector")).to_pylist()
        a, b = np.nonzero(self.pairs)
        if len(a) > FEW_PAIRS:
            near = similarities([vector[i] for i in self.left], [vector[i] for i in self.right])[a, b]
            kept = near >= THRESHOLD - 1e-6  # those near the threshold are verified like any other pair
            a, b, sure = a[kept], b[kept], near[kept] > THRESHOLD + 1e-6
        else:
            sure = np.zeros(len(a), dtype=bool)
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        out = set()
        for i, j, known in zip(self.left[a].tolist(), self.right[b].tolist(), sure.tolist(), strict=True):
            x, y = find(int(self.class_id[i])), find(int(self.class_id[j]))
            if x != y and (known or weighted_jaccard(vector[i], vector[j]) >= THRESHOLD):
                root[max(x, y)] = min(x, y)
                out.add((max(x, y), min(x, y)))
        return out


def units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal (key, i, j), the first three columns, of a sorted stream; a run may span batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest and any(rest[-1].column(c)[rest[-1].num_rows - 1] != batch.column(c)[0] for c in range(3)):
            yield pa.concat_batches(rest)
            rest = []
        names = [batch.column(c).to_numpy() for c in range(3)]
        ends = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in names])) + 1
        at = 0
        for to in ends.tolist():
            yield pa.concat_batches([*rest, batch.slice(at, to - at)])
            rest, at = [], to
        rest.append(batch.slice(at))
    if rest:
        yield pa.concat_batches(rest)


def spread_join(many: DataFrame, one: DataFrame, on: str, by: str) -> DataFrame:
    """many joined with one, which has a row a value of on. The rows of a frequent value are dealt over SALTS tasks by the column by;
    a part that is still large is split by Spark's adaptive skew join, as both sides are shuffled for this join alone."""
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    every = F.explode(F.array(*map(F.lit, range(SALTS))))
    return many.withColumn("salt", salt).join(one.withColumn("salt", every), [on, "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """node and least node of its class for all nodes of links(a, b), by large-star and small-star steps.

    Minima are pre-aggregated and joined back by salted keys, so a node with very many links is no single task's. The
    loop ends when every node but the least of its class has that one as its only neighbour.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        heads = edges.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("x"))
        inner = heads.join(heads.select(F.col("m").alias("a")).distinct(), "a", "left_semi")
        if inner.unionByName(heads.where("m <> x")).isEmpty():
            return heads.select(F.col("a").alias("node"), F.col("m").alias("class_id"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = spread_join(both.where("b > a"), least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, least, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        remove(edges)
        edges = after


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("text_key"), text.alias("text")).where("id is not null")


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        values, _, per = shingles(hash_words(text_bytes(block.column(2))))
        kept = block.take(pa.array(np.flatnonzero(per > 0)))
        keys = pa.array(list(sketch_keys(values, per)), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), keys], names=["id", "text_key", "keys"])


def distinct_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From rows(id, text_key, text): the id and key of every row with words; each key with its node, the least id, and whether
    the node counts for document frequencies; and one row (id, text_key, counts, text) for each node."""
    sketched = materialize(rows.mapInArrow(_sketch, "id long, text_key binary, keys array<long>"), "sketches")
    texts = materialize(sketched.groupBy("text_key").agg(F.min("id").alias("node"), F.first("keys").alias("keys")), "texts")
    keys = texts.select("node", F.explode("keys").alias("key"))
    first = keys.groupBy("key").agg(F.min("node").alias("first"))
    late = spread_join(keys, first, "key", "node").where("node > first").select("node").distinct().withColumn("late", F.lit(True))
    # a small table: Spark broadcasts it below its threshold, else the texts are shuffled for it
    nodes = materialize(texts.join(late, "node", "left").select("text_key", "node", F.col("late").isNull().alias("counts")), "nodes")
    own = rows.join(nodes.select(F.col("node").alias("id"), "text_key", "counts"), ["id", "text_key"]).select("id", "text_key", "counts", "text")
    if not sketched.groupBy("id", "text_key").count().where("count > 1").isEmpty():
        own = own.dropDuplicates(["id", "text_key"])
    return sketched.select("id", "text_key"), nodes, own


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: int = SEEDS) -> DataFrame:
    """One row per row of docs: id_col (long) and class_id, the least id of its class of near-duplicates.

    Two texts are linked if their weighted Jaccard similarity is THRESHOLD or more; classes are what links connect.
    Equal texts share a class. A text without words (null, empty, white space) is in a class of its own. Rows with equal ids
    count as one document that has all their texts, and a row without id has no class. An empty table gives no rows. Only id_col
    and text_col are read, so no other column can clash. Very long texts are taken whole, as blocks of their own.
    """
    rows = _documents(docs, id_col, text_col)
    ids, texts, own = distinct_texts(rows)
    n_docs = texts.where("counts").count()

    def elements(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        values, _, per = shingles(hash_words(texts))
        return values, per

    def emit(keys: pa.RecordBatch, per: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
        begin = np.concatenate([[0], np.cumsum(per)])
        some = [d for d in range(len(per)) if (totals[begin[d] : begin[d + 1]] > 1).any()]
        packed = [zlib.compress(_planes(totals[begin[d] : begin[d + 1]], 4), 1) for d in some]
        kept = keys.take(pa.array(some, pa.int64()))
        return pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(packed, pa.binary())], names=["id", "text_key", "df"])

    counted = corpus_counts(own, ["id", "text_key"], elements, emit, "id long, text_key binary, df binary", 4, weight="counts")
    df = materialize(counted, "frequencies")

    def vectors(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles, levels and shingles of each text; the columns text and df are the last two."""
        values, tf, per = shingles(hash_words(text_bytes(block.column(block.num_columns - 2))))
        df = np.ones(len(values), dtype=np.int64)
        begin = np.cumsum(per) - per
        for d, packed in enumerate(block.column(block.num_columns - 1).to_pylist()):
            if packed is not None:
                df[begin[d] : begin[d] + per[d]] = _unplanes(zlib.decompress(packed), 4)
        return values, levels(tf, df, n_docs), per

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            values, level, per = vectors(block)
            drawn = signatures(values, level, per)
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(1), pa.array([x.tobytes() for x in drawn], pa.binary()), pa.array(list(bands(drawn)), pa.list_(pa.int64()))],
                names=["node", "text_key", "drawn", "bands"],
            )

    joined = own.join(df, ["id", "text_key"], "left")
    nodes = materialize(joined.select("id", "text_key", "text", "df").mapInArrow(draw, "node long, text_key binary, drawn binary, bands array<long>"), "draws")
    # rows of each bucket that several nodes share, with their number; counted by salted keys, as a bucket may hold a third of all
    salted = nodes.select("node", F.explode("bands").alias("key")).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    part = salted.groupBy("key", "salt").agg(F.count("*").alias("n"))
    shared = part.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    buckets = materialize(salted.join(part.drop("n").join(shared, "key"), ["key", "salt"]).drop("salt"), "buckets")

    def on_key(rows: DataFrame, one: DataFrame) -> DataFrame:
        """rows(key, node, n, ...) joined with one(key, n, ...), the rows of a bucket dealt over a task for each HOT of them."""
        tasks = F.ceil(F.col("n") / HOT).cast("int")
        left = rows.withColumn("salt", F.pmod(F.xxhash64("node"), tasks))
        right = one.withColumn("salt", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("n")
        return left.join(right, ["key", "salt"]).drop("salt")

    def wrap(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            values, level, per = vectors(block)
            begin = np.cumsum(per) - per
            packed = [pack(values[a : a + n], level[a : a + n]) for a, n in zip(begin, per, strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(packed, pa.binary())], names=["node", "vector"])

    # first the few texts that share a bucket, then their frequencies, so that other texts aren't shuffled again
    wanted = materialize(buckets.select("node").distinct().join(nodes.select("node", "text_key"), "node").select(F.col("node").alias("id"), "text_key"), "wanted")
    candidates = rows.join(wanted, ["id", "text_key"], "left_semi").dropDuplicates(["id", "text_key"]).join(df, ["id", "text_key"], "left")
    vector = materialize(candidates.select(F.col("id").alias("node"), "text", "df").mapInArrow(wrap, "node long, vector binary"), "vectors")

    def agree(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, SAMPLES) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= AGREE))

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                near = [weighted_jaccard(x, y) >= THRESHOLD for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose similarity reaches the threshold."""
        for column, check in (("drawn", agree), ("vector", verify)):
            of = nodes.select("node", "drawn") if column == "drawn" else vector
            left, right = (of.select(F.col("node").alias(x), F.col(column).alias(f"{column}_{x}")) for x in "ab")
            both = pairs.join(left, "a").join(right, "b").select("a", "b", f"{column}_a", f"{column}_b")
            pairs = both.mapInArrow(check, "a long, b long")
        return pairs

    def suspects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            kept = Cross(unit).rows()
            if len(kept):
                yield unit.take(pa.array(kept))

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches):
            if found := Cross(unit).links():
                a, b = zip(*sorted(found), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def all_links(classes: DataFrame) -> DataFrame:
        """Links (a, b) of classes for all pairs of nodes that share a bucket, are in different classes and reach the threshold.

        A bucket's nodes outside its largest class meet all its nodes, so rows grow with the bucket's nodes times the
        blocks of UNIT nodes outside that class; the pairs are never rows.
        """
        named = materialize(buckets.join(classes, "node"), "named")
        count = named.groupBy("key", "class_id").agg(F.count("*").alias("n"))
        mixed = count.groupBy("key").agg(F.max_by("class_id", F.struct("n", "class_id")).alias("main_id"), F.max("n").alias("top"), F.sum("n").alias("n")).where("top < n")
        mixed = mixed.select("key", "main_id", "n", F.ceil((F.col("n") - F.col("top")) / UNIT).cast("int").alias("p"), F.ceil(F.col("n") / UNIT).cast("int").alias("q"))
        rows = on_key(named, mixed).withColumn("main", F.col("class_id") == F.col("main_id"))
        block = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = rows.where("not main").select("key", block("p", 1).alias("i"), every("q").alias("j"), F.lit(0).alias("side"), "main", "node", "class_id")
        right = rows.select("key", every("p").alias("i"), block("q", 2).alias("j"), F.lit(1).alias("side"), "main", "node", "class_id")
        dealt = lambda frame: frame.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        order = ["key", "i", "j", "side", "main", "node", "class_id"]
        told = dealt(left.unionByName(right).join(nodes.select("node", "drawn"), "node").select(*order, "drawn"))
        schema = "key long, i int, j int, side int, main boolean, node long, class_id long, drawn binary"
        told = materialize(told.mapInArrow(suspects, schema), "suspects")
        return dealt(told.join(vector, "node").select(*order, "drawn", "vector")).mapInArrow(link, "a long, b long").distinct()

    def joined_by(classes: DataFrame, found: DataFrame) -> DataFrame:
        merged = components(found).select(F.col("node").alias("class_id"), F.col("class_id").alias("last_id"))
        classes = classes.join(merged, "class_id", "left").select("node", F.coalesce("last_id", "class_id").alias("class_id"))
        return materialize(classes, "classes")

    def pair(buckets: DataFrame, seed: int) -> DataFrame:
        """Each row of buckets(key, node, class_id) with the bucket's leaders of other classes: a, b, class_a, class_b.

        Rows whose node and leader are in one class already are never made.
        """
        dealt = buckets.withColumn("leader", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(LEADERS)))
        order = F.col("node") if seed == 0 else F.xxhash64("node", F.lit(-seed))
        leaders = dealt.groupBy("key", "leader").agg(F.min_by(F.struct("node", "class_id"), order).alias("x"), F.first("n").alias("n"))
        leaders = leaders.select("key", "n", F.col("x.node").alias("b"), F.col("x.class_id").alias("class_b"))
        mine = buckets.select("key", "n", "node", F.col("node").alias("a"), F.col("class_id").alias("class_a"))
        return on_key(mine, leaders).where("class_a <> class_b").select("a", "b", "class_a", "class_b")

    # a node's most frequent leader first: what that joins needs no other pair
    single = buckets.withColumn("class_id", F.col("node"))
    counted = pair(single, 0).groupBy("a", "b").agg(F.count("*").alias("n"))
    best = counted.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    first = materialize(components(materialize(linked(best), "links")), "classes")
    classes = nodes.select("node").join(first, "node", "left").select("node", F.coalesce("class_id", "node").alias("class_id"))
    # then all other pairs of a node and a leader that are still apart, in the buckets that hold several classes
    for seed in range(seeds):
        named = materialize(buckets.join(classes, "node"), "named")
        mixed = named.groupBy("key").agg(F.min("class_id").alias("x"), F.max("class_id").alias("y"), F.first("n").alias("n")).where("x <> y").select("key", "n")
        apart = materialize(pair(on_key(named, mixed), seed).distinct(), "apart")
        found = linked(apart.select("a", "b")).join(apart, ["a", "b"]).select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()
        found = materialize(found, "links")
        if found.isEmpty():
            continue
        classes = joined_by(classes, found)
    # leaders may miss a pair: compare all that are still apart
    found = materialize(all_links(classes), "links")
    if not found.isEmpty():
        classes = joined_by(classes, found)
    named = ids.join(texts.select("text_key", "node"), "text_key").join(classes, "node", "left")
    named = named.groupBy("id").agg(F.min(F.coalesce("class_id", "node")).alias("class_id"))
    every = docs.select(F.col(id_col).cast("long").alias(id_col))
    return every.join(named.withColumnRenamed("id", id_col), id_col, "left").select(id_col, F.coalesce("class_id", id_col).alias("class_id"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the least id of its class."""
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
