"""Quality rules: count rules over words, then compression bands.

The bands are zstandard ratios (raw bytes / compressed bytes) of the whole document and of fixed chunks of its
bytes. A ratio above its length's upper limit means repetitive text, one below the lower limit
incompressible text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import blocks, hash_words, text_bytes, window_hashes

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
LEVEL = 3
CHUNK_BYTES = 4096
# Longest length in bytes, least and greatest ratio of a text of at most that length. The least ones lie between random base64 words
# (1.06 or less at 192 bytes, 1.09 at 256, 1.22 at 512, 1.29 at 1024, 1.35 at 4096) and real prose (licences, manuals: 1.09, 1.17, 1.28,
# 1.48, 1.80 or more). Up to 96 bytes prose compresses no better than random words, so only repetition is judged there.
DOCUMENT_BANDS = [
    (32, 0.0, 1.2), (64, 0.0, 1.9), (96, 0.0, 2.3), (128, 0.97, 2.5), (192, 1.07, 2.8), (256, 1.1, 3.2),
    (384, 1.17, 3.2), (512, 1.22, 3.2), (1024, 1.3, 3.4), (2048, 1.45, 3.6), (4096, 1.5, 3.6), (32768, 1.5, 4.0), (None, 1.5, 4.5),
]
MAX_CHUNK_RATIO = 4.0  # a chunk's least ratio is that of a document of its length
MAX_BAD_CHUNKS = 0.25  # share of a text's bytes in chunks outside their band

_FIELDS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64()),
]


def duplicate_lines(text: str) -> int:
    """Lines that hold a word and equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def repeat_words(hashes: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more; hashes are those of one text's words."""
    if len(hashes) < 4:
        return 0
    windows = window_hashes(hashes, 3)
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    many = counts[inverse] > 1
    covered = np.zeros(len(hashes), dtype=bool)
    for k in range(3):
        covered[k : k + len(many)] |= many
    return int(covered.sum())


def in_band(size: int, ratio: float, most: float | None = None) -> bool:
    """Whether a ratio is in the band of its text's length; most is a further upper limit."""
    for longest, low, high in DOCUMENT_BANDS:
        if longest is None or size <= longest:
            return low <= ratio <= min(high, most or high)
    return True


def compression(data: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, int, int, int]:
    """Ratio of the whole text, number of chunks, chunks outside the band of their length, and these chunks' bytes.

    Every chunk is judged, the last one by the band of its own length; a text of one chunk is that chunk.
    """
    if not data:
        return 0.0, 0, 0, 0
    ratio = len(data) / len(compressor.compress(data))
    chunks = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
    ratios = [ratio] if len(chunks) == 1 else [len(c) / len(compressor.compress(c)) for c in chunks]
    bad = [len(c) for c, r in zip(chunks, ratios, strict=True) if not in_band(len(c), r, MAX_CHUNK_RATIO)]
    return ratio, len(chunks), len(bad), sum(bad)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, the counts, base_failed, kept, and the compression figures behind kept.

    A null text counts as empty: no words, base_failed, not kept. An empty table gives no rows, and a null id comes back null. Only
    id_col and text_col are read, so no other column can clash. Each row is judged alone, so ties and repeated rows need no
    rule, and the work is one pass without a shuffle. A very long text is a block of its own and judged whole.
    """

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        strip = str.maketrans("", "", " \t\n\x0b\x0c\r")
        for block in blocks(batches, text_col):
            texts = text_bytes(block.column(1))
            words = hash_words(texts)
            out = []
            for d, data in enumerate(texts):
                text, n = data.decode(), int(words.counts[d])
                repeated = repeat_words(words.hashes[words.offsets[d] : words.offsets[d + 1]])
                failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
                ratio, chunks, bad, bad_bytes = compression(data, compressor)
                fits = in_band(len(data), ratio) and bad_bytes <= MAX_BAD_CHUNKS * len(data)
                out.append((n, len(text.translate(strip)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated, failed, fits and not failed, ratio, chunks, bad))
            columns = [pa.array(x, kind) for x, (_, kind) in zip(zip(*out, strict=True), _FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0), *columns], names=[id_col, *(name for name, _ in _FIELDS)])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(judge, schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
