"""Language ID with string kernels.

The kernel of two texts is the blended spectrum of their letter n-grams, present or not: the number of 1- to
3-grams that both have, over the geometric mean of how many each has. Nyström features on landmark texts and one
ridge regression against the rest per language give a classifier. As the kernel is an inner product of presence vectors, a
batch is scored by one matrix product: presence by (landmark n-grams times their coefficients).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import blocks
from .pretokens import LETTER, char_classes

ORDERS = (1, 2, 3)
SPACE_BITS = 18  # n-grams are hashed to this many bits
SAMPLE = 300  # labelled texts of each language that the fit uses, by the order of their ids' hashes
LANDMARKS = 64  # of these, landmarks of each language
# Every language is learned. With many of them each gets fewer sampled texts and landmarks, one text at least, so that the driver holds at
# most about 9600 n-gram sets and, at 2**18 n-grams, two float32 matrices of 1 GB; with 16 languages or fewer nothing changes.
ALL_SAMPLES, ALL_LANDMARKS = 9600, 1024
RIDGE = 1e-3
SALTS = 32  # parts of a label's rows
BATCH = 128
SEGMENT = 1 << 20
UNKNOWN = "und"
MIN_SCORE = 0.25  # the pipeline rejects texts whose best score is less,
SHORT_CHARS, MIN_MARGIN = 60, 0.02  # but short ones only if the second language comes this near
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def presence(text: str | None) -> np.ndarray:
    """Which hashed n-grams of lower-case letters a text has; all other signs count as one kind of gap."""
    out = np.zeros(1 << SPACE_BITS, dtype=bool)
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, len(raw), SEGMENT):
        part = raw[at : at + SEGMENT + max(ORDERS) - 1]
        codes = np.where(char_classes()[part] == LETTER, part, 0).astype(np.uint64)
        for n in ORDERS:
            if len(codes) >= n:
                h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
                for i in range(n):
                    h = (h ^ codes[i : len(codes) - n + 1 + i]) * _ODD[i]
                    h ^= h >> np.uint64(29)
                out[(h * _ODD[0]) >> np.uint64(64 - SPACE_BITS)] = True
    return out


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # hashed n-grams that some landmark has
    weights: np.ndarray  # grams x languages

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Best language, its score from 0 to 1 and its lead over the second; UNKNOWN, 0 and 0 for a text without letters."""
        n = len(texts)
        if not self.languages:
            return [UNKNOWN] * n, [0.0] * n, [0.0] * n
        rows, sizes = np.zeros((n, len(self.grams)), dtype=np.float32), np.ones(n)
        lettered = np.array([any(map(str.isalpha, t or "")) for t in texts], dtype=bool)
        for i in np.flatnonzero(lettered):
            has = presence(texts[i])
            rows[i], sizes[i] = has[self.grams], max(1, np.count_nonzero(has))
        scores = (rows @ self.weights) / np.sqrt(sizes)[:, None]
        best = scores.argmax(axis=1)
        top = scores[np.arange(n), best]
        scores[np.arange(n), best] = -np.inf
        margin = np.where(lettered, np.clip(top - np.maximum(scores.max(axis=1), 0), 0, 1), 0.0)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
        return names, np.where(lettered, np.clip(top, 0, 1), 0.0).tolist(), margin.tolist()


def fit(grams: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS) -> Model:
    """Nyström kernel ridge regression on texts given as their present n-grams; the first landmarks of each label are landmarks."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.empty(0, np.int64), np.empty((0, 0), np.float32))
    chosen = [i for c in languages for i in [i for i, x in enumerate(labels) if x == c][:landmarks]]
    used = np.unique(np.concatenate([grams[i] for i in chosen]))
    column = np.full(1 << SPACE_BITS, -1)
    column[used] = np.arange(len(used))
    marks = np.zeros((len(chosen), len(used)), dtype=np.float32)
    for k, i in enumerate(chosen):
        marks[k, column[grams[i]]] = 1 / np.sqrt(max(1, len(grams[i])))
    kernel = np.empty((len(grams), len(chosen)))
    for at in range(0, len(grams), BATCH):
        rows = np.zeros((len(grams[at : at + BATCH]), len(used)), dtype=np.float32)
        for k, g in enumerate(grams[at : at + BATCH]):
            seen = column[g]
            rows[k, seen[seen >= 0]] = 1 / np.sqrt(max(1, len(g)))
        kernel[at : at + BATCH] = rows @ marks.T
    values, vectors = np.linalg.eigh(kernel[chosen])
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ root
    target = np.array([[float(x == c) for c in languages] for x in labels])
    weight = 1 / np.array([labels.count(x) for x in labels])[:, None]  # every language weighs the same
    left = features.T @ (features * weight) + RIDGE * np.eye(features.shape[1])
    solved = np.linalg.solve(left, features.T @ (target * weight))
    return Model(languages, used, (marks.T @ (root @ solved)).astype(np.float32))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on at most sample texts of each label of docs; what reaches the driver is their n-gram sets, a bounded sample.

    Rows without id, label or text are left out. Equal rows count once, rows with equal ids and different texts each. No rows give
    a model that knows no language.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text")).where("label is not null and id is not null and text is not null")
    known = known.withColumn("text_hash", F.xxhash64("text"))
    n_labels = max(1, known.select("label").distinct().count())
    sample, landmarks = max(1, min(sample, ALL_SAMPLES // n_labels)), max(1, min(LANDMARKS, ALL_LANDMARKS // n_labels))
    place = lambda *part: F.row_number().over(Window.partitionBy(*part).orderBy(F.xxhash64("id"), "id", "text_hash"))
    # a frequent label's rows are first cut to sample in each of SALTS parts, so that none meets them all
    ids = known.select("id", "label", "text_hash").distinct().withColumn("salt", F.pmod(F.xxhash64("id", "text_hash"), F.lit(SALTS)))
    first = ids.withColumn("place", place("label", "salt")).where(F.col("place") <= sample).drop("salt")
    chosen = first.withColumn("place", place("label")).where(F.col("place") <= sample)

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sets = [np.flatnonzero(presence(t)).astype("<u4").tobytes() for t in block.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(sets, pa.binary())], names=["label", "place", "grams"])

    one = known.join(F.broadcast(chosen), ["id", "label", "text_hash"]).groupBy("label", "place").agg(F.first("text").alias("text"))
    rows = one.mapInArrow(grams, "label string, place int, grams binary").collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    return fit([np.frombuffer(bytes(r[2]), "<u4").astype(np.int64) for r in rows], [r[0] for r in rows], landmarks)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of docs with lang_pred, score and margin, the lead over the second language; keep names further columns to carry along.

    A text that is null or has no letter is UNKNOWN with score 0. Whole texts are read, in segments, so very long ones take no
    more memory. Rows are judged alone: repeated ones come back repeated, null ids as they are, an empty table gives no rows.
    Columns of docs named lang_pred, score or margin must not be in keep.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = list(dict.fromkeys([id_col, *keep]))
    others = [c for c in columns if c != text_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col):
            for at in range(0, block.num_rows, BATCH):
                part = block.slice(at, BATCH)
                names, *numbers = shared.value.score(part.column(len(others)).to_pylist())
                kept = part.columns[: len(others) + (text_col in columns)]
                names_out = [*others, *([text_col] if text_col in columns else []), "lang_pred", "score", "margin"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), *(pa.array(x, pa.float64()) for x in numbers)], names=names_out)

    order = [*others, *([text_col] if text_col in columns else [])]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in order)
    return docs.select(*others, text_col).mapInArrow(run, f"{schema}, lang_pred string, score double, margin double").select(*columns, "lang_pred", "score", "margin")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
