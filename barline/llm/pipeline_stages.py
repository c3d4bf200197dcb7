"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir), docs with the columns of documents, and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, decontaminate, language_id, near_dedup, substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without letters go, and those whose best language scores under MIN_SCORE. A short text has few n-grams
    and a low score whatever its language, so it goes only if it also has no lead over the second language."""
    model = language_id.train(docs.where(~language_id.held_out()))
    named = language_id.predict(docs, model, keep=COLUMNS)
    short = (F.char_length("text") <= language_id.SHORT_CHARS) & (F.col("margin") >= language_id.MIN_MARGIN)
    known = (F.col("score") >= language_id.MIN_SCORE) | short
    return named.where((F.col("lang_pred") != language_id.UNKNOWN) & known).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: of each class the document with the least id stays; of rows with that id, that of the least text hash. Rows
    without an id stay. Other columns than those of documents are left out first, so none can clash."""
    docs = docs.select(*COLUMNS)
    classes = near_dedup.near_duplicate_classes(docs.select("doc_id", "text"))
    first = classes.where(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct()
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.md5(F.col("text").cast("binary"))))
    kept = docs.join(first, "doc_id", "left_semi").withColumn("place", place).where("place = 1").drop("place")
    return kept.unionByName(docs.where(F.col("doc_id").isNull())).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: repeated windows leave the texts; texts without any stay as they are."""
    cut = substring_dedup.remove_repeats(docs, keep=("text", "lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    return cut.select(
        "doc_id", F.when(changed, F.col("kept_text")).otherwise(F.col("row.text")).alias("text"), "row.lang", "row.source",
        F.when(changed, F.char_length("kept_text")).otherwise(F.col("row.n_chars")).cast("long").alias("n_chars"),
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that overlap a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs.select(*COLUMNS), items)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: token counts and digests of ids and decoded text of what is left."""
    return bpe.digests(bpe.encode(docs))


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", keep_one_of_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]
