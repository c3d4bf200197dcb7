"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted over the corpus.

Windows whose hash occurs more than once merge into maximal intervals of words, which are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import CHECK_BASE, hash_words, inside, mix, window_hashes
from .exchange import corpus_counts
from .store import materialize

WINDOW = 35
HASH_BYTES = 7  # beside the bucket's bits: 63 bits or more, and 32 of an independent check


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal word intervals covered by windows that also start elsewhere, one row per text that has any.

    Returns id, text_hash (xxhash64 of the text), starts and ends (arrays of word positions, ends exclusive). Every
    row of docs is a text of its own, so a repeated row repeats all its windows. Null, empty and shorter texts
    have no windows, and an empty table gives no rows. A very long text is a block of its own. Two different windows count as
    equal only if 63 bits of one hash and 32 of an independent one agree: among 10**13 windows (100 TB) that is expected for 0.003.
    """

    def elements(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = hash_words(texts)
        at, per = inside(words, window), np.maximum(words.counts - window + 1, 0)
        if not len(at):
            return np.empty(0, np.uint64), per, np.empty(0, np.uint64)
        check = window_hashes(mix(words.hashes ^ np.uint64(CHECK_BASE)), window, CHECK_BASE)[at] >> np.uint64(32)
        return window_hashes(words.hashes, window)[at], per, check

    def emit(keys: pa.RecordBatch, per: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
        begin = np.concatenate([[0], np.cumsum(per)])
        hit = totals > 1
        some = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(hit)])[begin]))
        starts, ends = [], []
        for d in some:
            place = np.flatnonzero(hit[begin[d] : begin[d + 1]])
            cut = np.flatnonzero(np.diff(place) > window)  # windows that touch share an interval
            starts.append(place[np.concatenate([[0], cut + 1])])
            ends.append(place[np.concatenate([cut, [len(place) - 1]])] + window)
        kept = keys.take(pa.array(some, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [kept.column(0), kept.column(1), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))],
            names=["id", "text_hash", "starts", "ends"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return corpus_counts(rows, ["id", "text_hash"], elements, emit, f"id {kind}, text_hash long, starts array<int>, ends array<int>", HASH_BYTES, checked=True)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of docs with the words of its repeated windows removed.

    Returns id_col, n_words, n_removed, starts, ends, kept_text: the kept words joined by one space, and row, a struct of the
    columns named by keep. A null or empty text has no words and an empty kept_text. Other columns of docs are not
    read, so their names cannot clash.
    """
    spans = materialize(repeated_spans(docs, window, id_col, text_col), "repeats").dropDuplicates(["id", "text_hash"])
    row = F.struct(*(F.col(c) for c in keep)) if keep else F.lit(None).cast("struct<none:int>")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"), row.alias("row")).alias("d")
    row_type = rows.schema["row"].dataType.simpleString()
    joined = rows.join(spans.alias("s"), F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.text_hash") == F.col("s.text_hash")), "left")
    joined = joined.select("d.id", "d.text", "starts", "ends", "d.row")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            columns = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for text, starts, ends in zip(*columns, strict=True):
                words = text.encode().split() if text else []
                left, at = [], 0
                for a, b in zip(starts or (), ends or (), strict=True):
                    left += words[at:a]
                    at = b
                left += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), batch.column(2), batch.column(3), pa.array(kept, pa.string()), batch.column(4)],
                names=[id_col, "n_words", "n_removed", "starts", "ends", "kept_text", "row"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(cut, f"`{id_col}` {kind}, n_words long, n_removed long, starts array<int>, ends array<int>, kept_text string, row {row_type}")


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """n_words, n_removed and the kept words' sha256 of each text, by comparing word tuples."""
    words = [(t or "").encode().split() for t in texts]
    seen: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, removed words and the digest of the kept words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
