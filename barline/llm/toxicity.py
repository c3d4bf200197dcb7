"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

A lexicon is learned from a bounded sample of labelled texts: folded words whose log odds of being in a toxic text are high.
Folding undoes case, accents, look-alike signs, inner punctuation and stretched letters, so an obfuscated word
meets its plain form. Trees and calibration are fitted by Spark on disjoint parts of the sample.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import blocks, hash_words
from .bpe import distinct
from .near_dedup import near_duplicate_classes
from .pretokens import LETTER, char_classes
from .store import materialize

SAMPLE = 6000  # labelled texts of each class that the fit uses, by the order of their ids' hashes
LEXICON = 300  # most words of the lexicon
MIN_TEXTS, MIN_LOG_ODDS = 8, 2.5  # support and least log odds of a lexicon word
REACH = 8  # words between a lexicon word and a second person
TREES, DEPTH = 20, 3
PIECE = 3 << 18  # text bytes whose features are taken at a time; their arrays take some 50 times as much
# Second-person words of the corpus languages that mean little else in the other ones, and signs that stand for letters.
SECOND_PERSON = frozenset("you your yours yourself u ur tu toi vous votre vos dich dir dein deine euch tú usted ustedes".split())
LOOK_ALIKES = str.maketrans("01345789@$!|+", "oieastbgasiit")
FEATURES = (
    "hit_density", "hit_log", "hit_weight", "weight_density", "distinct_hits", "masked_hits", "second_person_near", "second_person_rate", "capitals",
    "capital_words", "exclamations", "punctuation", "mixed_words", "words_log",
)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "@$!|+*")
_RUN = re.compile(r"(.)\1{2,}")


def fold(word: str) -> str:
    """A word's plain form: lower case, no accents, look-alike signs as letters, letters only, stretched letters once."""
    word = word.lower()
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    core = word.strip(_EDGE)
    if not core.isalpha():
        core = core.rstrip("!?.,").translate(LOOK_ALIKES)
        core = "".join(c for c in core if c.isalpha())
    return _RUN.sub(r"\1", core)


def word_kind(word: str, lexicon: dict[str, tuple[float, int]]) -> tuple[float, ...]:
    """Lexicon weight, whether it only matches folded, second person, capitals, mixed signs, a single letter, place in the lexicon or -1."""
    inner = word.strip(_EDGE + "@$!|+*?.,")
    plain, folded = inner.lower(), fold(word)
    weight, place = lexicon.get(folded, (0.0, -1))
    mixed = any(map(str.isalpha, inner)) and not inner.isalpha()
    return weight, weight > 0 and plain != folded, plain in SECOND_PERSON, len(inner) > 1 and inner.isupper(), mixed, len(word) == 1 and word.isalpha(), place


class WordKinds(dict):
    """word_kind of the words met, by their UTF-8 bytes; equal kinds, of which there are few, are kept once."""

    def __init__(self, lexicon: dict[str, tuple[float, int]]):
        self.lexicon = lexicon
        self.kinds: dict[tuple[float, ...], tuple[float, ...]] = {}

    def __missing__(self, word: bytes) -> tuple[float, ...]:
        kind = word_kind(word.decode(), self.lexicon)
        kind = self.kinds.setdefault(kind, kind)
        if len(self) < 1 << 18:
            self[word] = kind
        return kind


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    """For each code point: bit 1 letter, 2 capital, 4 exclamation mark, 8 punctuation."""
    out = (char_classes() == LETTER).astype(np.uint8)
    out[[c for c in range(0x110000) if chr(c).isupper()]] |= 2
    out[ord("!")] |= 4
    out[[ord(c) for c in ".,;:!?*#@$"]] |= 8
    return out


def spaced_words(letter: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of more than three single letters in one text."""
    edge = np.flatnonzero(np.concatenate([[True], (letter[1:] != letter[:-1]) | (text[1:] != text[:-1]), [True]]))
    first, last = edge[:-1], edge[1:] - 1
    runs = letter[first] & (last - first >= 3)
    return first[runs], last[runs]


def block_features(texts: list[str], kinds: WordKinds) -> np.ndarray:
    """Dense features of whole texts, a row each; all zero for one without words. Distinct words are judged once, the rest are array sums."""
    raw = [t.encode() for t in texts]
    words, size = hash_words(raw), len(texts)
    text, n = words.text_of(), words.counts
    out = np.zeros((size, len(FEATURES)))
    if not len(text):
        return out
    one, inverse, _ = distinct(np.frombuffer(words.buffer, dtype=np.uint8), words.starts, words.ends)
    spans = zip(words.starts[one].tolist(), words.ends[one].tolist(), strict=True)
    table = np.array([kinds[words.buffer[a:b]] for a, b in spans], dtype=np.float64).T[:, inverse]
    weight, masked, second, capital, mixed, letter, place = table
    hit = np.flatnonzero(weight > 0)
    joined = []
    for a, b in zip(*spaced_words(letter > 0, text), strict=True):
        plain = b"".join(words.buffer[words.starts[i] : words.ends[i]] for i in range(a, b + 1)).decode()
        if (found := kinds.lexicon.get(fold(plain))) is not None:
            joined.append((b, *found))
    at, more_weight, more_place = (np.array(x) for x in zip(*joined, strict=True)) if joined else (np.empty(0, np.int64),) * 3
    where = np.concatenate([hit, at.astype(np.int64)])
    of, gain = text[where], np.concatenate([weight[hit], more_weight])
    hits = np.bincount(of, minlength=size)
    most, near, kinds_hit = np.zeros(size), np.zeros(size), np.zeros(size)
    np.maximum.at(most, of, gain)
    pairs = np.unique(np.stack([of, np.concatenate([place[hit], more_place]).astype(np.int64)], axis=1), axis=0)
    kinds_hit += np.bincount(pairs[:, 0], minlength=size)
    them = np.flatnonzero(second > 0)
    if len(them) and len(where):
        right = np.searchsorted(them, where)
        for side in (right - 1, right):
            ok = (side >= 0) & (side < len(them))
            other = them[np.clip(side, 0, len(them) - 1)]
            gap = np.abs(other - where)
            ok &= (text[other] == of) & (gap <= REACH)
            np.maximum.at(near, of[ok], 1 / (1 + gap[ok]))
    signs = _signs()[np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    count = lambda bit: np.diff(np.concatenate([[0], np.cumsum((signs & bit) > 0)])[ends])
    sums = lambda values: np.bincount(text, values, size)
    some = np.maximum(n, 1)
    columns = [
        hits / some, np.log1p(hits), most, np.bincount(of, gain, size) / some, kinds_hit, sums(masked) + np.bincount(text[at.astype(np.int64)], minlength=size), near, sums(second) / some,
        count(2) / np.maximum(count(1), 1), sums(capital) / some, count(4) / some, count(8) / some, sums(mixed) / some, np.log1p(n),
    ]
    return np.where((n > 0)[:, None], np.stack(columns, axis=1), 0.0)


def with_features(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """All columns of rows but text, with the array column features of text."""
    shared = rows.sparkSession.sparkContext.broadcast({w: (x, i) for i, (w, x) in enumerate(sorted(lexicon.items()))})
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = WordKinds(shared.value)
        for block in blocks(batches, size=PIECE):
            values = block_features([t or "" for t in block.column(len(others)).to_pylist()], kinds)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * len(FEATURES), pa.int32()), pa.array(values.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*block.columns[: len(others)], lists], names=[*others, "features"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.select(*others, "text").mapInArrow(run, f"{schema}, features array<double>")


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Folded words of sample(toxic, text) that mark toxic texts, with their log odds.

    A word's support is counted over classes of near-duplicates of the whole folded texts, so a group of copies doesn't put its
    own words into the lexicon, and different texts that share an opening count each.
    """

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows = []
            for text in block.column(1).to_pylist():
                found = [f for f in map(fold, _WORD.findall(text or "")) if f]
                rows.append((" ".join(found), sorted({f for f in found if 2 < len(f) <= 40})))
            folded, sets = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(folded), pa.array(sets, pa.list_(pa.string()))], names=["toxic", "folded", "words"])

    texts = sample.select("toxic", "text").mapInArrow(words, "toxic int, folded string, words array<string>").withColumn("id", F.xxhash64("folded"))
    texts = materialize(texts.dropDuplicates(["id", "toxic"]), "lexicon-texts")
    if texts.where("toxic = 1").isEmpty():
        return {}
    classes = materialize(near_duplicate_classes(texts.select("id", "folded").dropDuplicates(["id"]), "id", "folded"), "lexicon-classes")
    texts = texts.join(classes, "id").select("toxic", "class_id", "words")
    sums = {r[0]: r[1] for r in texts.groupBy("toxic").agg(F.countDistinct("class_id")).collect()}
    bad, good = sums.get(1, 0), sums.get(0, 0)
    by_word = texts.select("toxic", "class_id", F.explode("words").alias("word")).distinct().groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    top = by_word.withColumn("odds", odds).where((F.col("bad") >= MIN_TEXTS) & (F.col("odds") >= MIN_LOG_ODDS))
    top = top.orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "word").limit(LEXICON).select("word", "odds")
    return {r[0]: float(r[1]) for r in top.collect()}


def toxicity(docs: DataFrame, labels: DataFrame, train_on, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with score and predicted, learned from labels(id_col, toxic) of the rows where the column train_on holds.

    Repeated labels of an id count as their greatest; null labels and ids are left out. At most sample texts of each class are
    used; of rows with equal ids all texts are. Without texts of both classes every score is the share of toxic labels. Null and
    empty texts have all features 0 and are scored like any other; very long ones are read whole. Repeated rows come back repeated, an
    empty table gives no rows, and only id_col, text_col and toxic are read, so no other column can clash.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col), F.col("toxic")).where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & train_on)
    known = known.groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    known = known.join(docs.where(F.col(text_col).isNotNull()).select(id_col).distinct(), id_col, "left_semi")
    order = F.xxhash64(id_col)
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(order, id_col).limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = materialize(chosen, "labelled")
    texts = materialize(rows.join(F.broadcast(chosen), id_col).withColumn("toxic", F.col("toxic").cast("int")), "labelled-texts")
    lexicon = learn_lexicon(texts)
    counts = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    scored = with_features(rows, lexicon)
    if len(counts) < 2:
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        return scored.select(id_col, F.lit(float(share)).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    vector = array_to_vector("features")
    # fit on three parts of four, calibrate on the fourth; weights undo the unequal sampling of the classes
    all_counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    weight = F.create_map(*[F.lit(x) for k in counts for x in (k, all_counts[k] / counts[k])])
    table = with_features(texts.select(id_col, "toxic", "text"), lexicon).select(
        F.col("toxic").cast("double").alias("label"), vector.alias("x"), (F.pmod(F.xxhash64(F.lit(7), id_col), F.lit(4)) == 0).alias("calibrate"), weight[F.col("toxic")].alias("weight")
    )
    table = materialize(table, "features").coalesce(4)
    fit, check = table.where("not calibrate"), table.where("calibrate")
    if fit.select("label").distinct().count() < 2 or check.isEmpty():
        fit = check = table
    trees = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, maxBins=64, stepSize=0.2, seed=1).fit(fit)
    raw = lambda frame: trees.transform(frame).withColumn("p", vector_to_array("probability")[1])
    isotonic = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight").fit(raw(check).select("p", "label", "weight"))
    out = isotonic.transform(raw(scored.select(id_col, vector.alias("x"))).select(id_col, "p"))
    score = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
    return out.select(id_col, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled ones that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, labels, ~held_out()).select("doc_id", held_out().alias("held_out"), "score", "predicted")
