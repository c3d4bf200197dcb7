"""Benchmark decontamination by spaced-seed hashing.

Each fixed mask hashes the words at its ones and ignores those at its zeros, so a substituted word under a zero doesn't
hide a passage. Hashes of benchmark items are joined with those of every document position; each hit names a
diagonal, on which the overlap is then verified word by word. Items of fewer words than the longest mask get masks of their own
length, one for each place that may differ; the shortest ones are matched exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import BASE, blocks, hash_words, mix, ragged
from .store import materialize

MASKS = ("11101101", "11011011", "1010111011", "1100111011")
SHORT_ITEM = 10  # items of fewer words must occur whole,
EXACT_ITEM = 5  # with one word substituted, or without if they have fewer than these
MISMATCH = -2  # score of a substituted word; a matched one scores 1
NEED, NEED_SHARE = 13, 0.6  # a verified stretch scores this, or this share of a short item
ITEM_BLOCK_HASHES = 1 << 21  # seed hashes broadcast at a time; more items go through in blocks, all of them
_FILTER_BITS = 20
_SIGNS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def normal(text: str | None) -> bytes:
    """Lower case, ASCII signs other than letters and digits as spaces."""
    return (text or "").lower().encode().translate(_SIGNS)


def needed(item_words: int) -> int:
    """Least score of a stretch that counts as an overlap with an item; for a short item that of its whole length."""
    if item_words < SHORT_ITEM:
        return item_words if item_words < EXACT_ITEM else item_words - 1 + MISMATCH
    return min(NEED, math.ceil(NEED_SHARE * item_words))


def masks_of(item_words: int) -> list[str]:
    """Masks of an item with so many words."""
    if item_words >= SHORT_ITEM:
        return list(MASKS)
    if item_words < EXACT_ITEM:
        return ["1" * item_words] if item_words else []
    return ["1" * i + "0" + "1" * (item_words - 1 - i) for i in range(item_words)]


def seed_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash under the mask of each run of len(mask) words, whatever text they are in."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in (i for i, c in enumerate(mask) if c == "1"):
        total *= np.uint64(BASE)
        total += hashes[i : i + n]
    return mix(total ^ np.uint64(int("1" + mask, 2)))


def best_stretch(match: np.ndarray) -> tuple[int, int, int]:
    """Greatest score of a stretch of one diagonal, its begin and its end."""
    sums = np.concatenate([[0], np.cumsum(np.where(match, 1, MISMATCH))])
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    return int(sums[end] - low[end]), int(np.argmin(sums[: end + 1])), end


class Seeds:
    """Sorted seed hashes of some items with item number and position, and every item's word hashes."""

    def __init__(self, item_ids: list, texts: list[str | None], min_words: int = 1):
        words = hash_words([normal(t) for t in texts])
        self.ids = item_ids
        self.words = [words.hashes[a:b] for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
        hashes, items, places, masks = [], [], [], set()
        for i, w in enumerate(self.words):
            for m in masks_of(len(w)) if len(w) >= min_words else []:
                h = seed_hashes(w, m)
                hashes.append(h)
                items.append(np.full(len(h), i))
                places.append(np.arange(len(h)))
                masks.add(m)
        none = [np.empty(0, np.int64)]
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(flat)
        self.hashes, self.items, self.places = flat[order], np.concatenate(items or none)[order], np.concatenate(places or none)[order]
        self.masks = sorted(masks)
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word index, item and item position of every seed hit."""
        at, item, place = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for mask in self.masks:
            seeds = seed_hashes(hashes, mask)
            some = np.flatnonzero(self.filter[seeds >> np.uint64(64 - _FILTER_BITS)])
            low, high = np.searchsorted(self.hashes, seeds[some], "left"), np.searchsorted(self.hashes, seeds[some], "right")
            entry = ragged(low, high - low)
            at.append(np.repeat(some, high - low))
            item.append(self.items[entry])
            place.append(self.places[entry])
        return np.concatenate(at), np.concatenate(item), np.concatenate(place)


def overlaps(texts: list[str | None], seeds: Seeds) -> list[tuple[int, int, int, int, int, int]]:
    """Verified overlaps: text, item, matched words, score, first and last-but-one word of the stretch; the best one for a text and item."""
    words = hash_words([normal(t) for t in texts])
    at, item, place = seeds.hits(words.hashes)
    if not len(at):
        return []
    doc = np.searchsorted(words.offsets, at, side="right") - 1
    begin = at - words.offsets[doc] - place
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for d, i, diagonal in np.unique(np.stack([doc, item, begin], axis=1), axis=0).tolist():
        mine, theirs = words.hashes[words.offsets[d] : words.offsets[d + 1]], seeds.words[i]
        a, b = max(0, -diagonal), min(len(theirs), len(mine) - diagonal)
        match = theirs[a:b] == mine[a + diagonal : b + diagonal]
        if len(theirs) < SHORT_ITEM:  # whole, or not at all
            if b - a < len(theirs):
                continue
            score, low, high = int(match.sum()) + MISMATCH * int((~match).sum()), 0, len(theirs)
        else:
            score, low, high = best_stretch(match)
        found = (score, int(match[low:high].sum()), a + low + diagonal, a + high + diagonal)
        if score >= needed(len(theirs)) and found > best.get((d, i), (-len(theirs) * 3, 0, 0, 0)):
            best[d, i] = found
    return [(d, i, n, score, low, high) for (d, i), (score, n, low, high) in best.items()]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1) -> DataFrame:
    """Overlaps of docs(id_col, text_col) with items(item_id, text): id_col, item_id, n_matched, score, item_words, start, end.

    One row for a document row and item whose best verified stretch scores enough; clean documents give no row. start and end
    count the document's normalised words. Null and empty texts never match; an item of fewer than min_words words isn't looked
    for (an item of one common word matches every text that has it). Repeated rows of docs come back repeated; a repeated
    item row counts once more. An empty table on either side gives no rows, and no column but those named is read. Very long texts
    are blocks of their own, scanned whole. Items beyond one broadcast's bound are taken in further blocks, one at a time, each
    against all documents.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id {item_kind}, n_matched long, score long, item_words long, start long, end long"
    rows, out, item_type = docs.select(F.col(id_col), F.col(text_col)), None, to_arrow_type(items.schema["item_id"].dataType)
    parts = item_blocks(items, min_words)
    for shared in parts:

        def scan(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seeds = shared.value
            for block in blocks(batches, text_col):
                found = overlaps(block.column(1).to_pylist(), seeds)
                if found:
                    d, i, *numbers, low, high = map(list, zip(*found, strict=True))
                    columns = [*numbers, [len(seeds.words[x]) for x in i], low, high]
                    yield pa.RecordBatch.from_arrays(
                        [block.column(0).take(pa.array(d)), pa.array([seeds.ids[x] for x in i], item_type), *(pa.array(c, pa.int64()) for c in columns)],
                        names=[id_col, "item_id", "n_matched", "score", "item_words", "start", "end"],
                    )

        one = rows.mapInArrow(scan, schema)
        if parts.more:  # so that the block's broadcast can go before the next one is made
            one = materialize(one, "overlaps")
        out = one if out is None else out.unionByName(one)
    return out


class item_blocks:
    """Broadcasts of all items' seeds, each of about ITEM_BLOCK_HASHES hashes at most, or of one longer item, made one after another.

    The driver holds one block at a time if there are more; the one before is destroyed then.
    """

    def __init__(self, items: DataFrame, min_words: int = 1):
        self.min_words = min_words
        items = items.select("item_id", "text").where(F.col("text").isNotNull())
        words = F.size(F.split("text", r"[^\p{L}\p{N}]+"))
        # running sums of seeds in the order of a hash, taken over ranges of it, name each item's block
        part = F.shiftrightunsigned(F.xxhash64("item_id", "text"), 48).cast("int")
        sizes = items.groupBy(part.alias("part")).agg(F.sum(words * len(MASKS)).alias("n")).collect()  # 65536 rows at most
        self.ends, room = [-1], ITEM_BLOCK_HASHES
        for p, n in sorted((r[0], r[1]) for r in sizes):
            if n > room and room < ITEM_BLOCK_HASHES:
                self.ends.append(p - 1)
                room = ITEM_BLOCK_HASHES
            room -= n
        self.ends.append(1 << 16)
        self.items, self.part, self.more = items, part, len(self.ends) > 2

    def __iter__(self):
        before = None
        for low, high in zip(self.ends[:-1], self.ends[1:], strict=True):
            if before is not None:
                before.destroy()
            rows = self.items.where((self.part > low) & (self.part <= high)).collect()
            before = self.items.sparkSession.sparkContext.broadcast(Seeds([r[0] for r in rows], [r[1] for r in rows], self.min_words))
            yield before


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", min_words: int = 1) -> DataFrame:
    """The rows of docs that overlap no item, with all their columns, in one pass for each block of items."""
    parts = item_blocks(items, min_words)
    for shared in parts:

        def scan(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, text_col):
                hit = {d for d, *_ in overlaps(block.column(block.schema.get_field_index(text_col)).to_pylist(), shared.value)}
                yield block.filter(pa.array([d not in hit for d in range(block.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(scan, docs.schema)
        if parts.more:
            docs = materialize(docs, "clean")
    return docs


def brute_force(text: str | None, item: str | None) -> int | None:
    """Greatest score over all diagonals that hold a seed under some mask; None if none does."""
    mine, theirs = normal(text).split(), normal(item).split()
    best = None
    for diagonal in range(-len(theirs) + 1, len(mine)):
        inside = [0 <= j + diagonal < len(mine) for j in range(len(theirs))]
        match = [ok and mine[j + diagonal] == w for j, (ok, w) in enumerate(zip(inside, theirs, strict=True))]
        seeded = any(
            all(match[p + k] for k, c in enumerate(m) if c == "1") and all(inside[p : p + len(m)])
            for m in masks_of(len(theirs)) for p in range(len(theirs) - len(m) + 1)
        )
        if seeded:
            scores, run = [], 0
            for hit, ok in zip(match, inside, strict=True):
                if ok:
                    run = run + (1 if hit else MISMATCH) if len(theirs) < SHORT_ITEM else max(0, run + (1 if hit else MISMATCH))
                    scores.append(run)
            score = scores[-1] if len(theirs) < SHORT_ITEM else max(scores)
            best = score if best is None else max(best, score)
    return best


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that overlaps a benchmark item, with that item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items)
