"""Every operator and pipeline stage over nulls, empty and very long texts, repeated rows and ids, empty tables and clashing columns."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barline.llm import bpe, chat_format, decontaminate, language_id, near_dedup, quality_rules, substring_dedup, token_scan, toxicity, warc
from barline.llm.pretokens import LETTER, char_classes

# names that some operator uses for a column of its own
CLASHING = (
    "id text_hash text_key df node path ids features toxic score predicted key keys salt bucket lang_pred margin class_id i j x p n at size ordinal row starts ends kept_text n_words n_removed label place grams folded "
    "words counts drawn bands vector class side main item_id decoded n_tokens base width weight d s ratio kept held_out first late begin end"
).split()


def texts_and_ids():
    rng = random.Random(21)
    prose = " ".join(f"w{rng.randrange(500)}" for _ in range(90))
    long = " ".join(f"v{rng.randrange(10**5)}" for _ in range(150_000))
    rows = [(0, None), (1, ""), (2, prose), (3, prose), (3, prose), (3, prose + " more"), (None, prose), (None, None), (4, long), (5, " \n\t"), (6, "123 !!"), (7, "x" * 300_000), (8, "é ☃ 😀 \x00 \x85")]
    return rows


def documents(spark, rows, clash):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.select("*", *(F.lit(-1).alias(c) for c in CLASHING)) if clash else docs


def labels(spark, clash):
    rows = spark.createDataFrame([(2, 1), (3, 1), (3, 0), (4, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    return rows.select("*", *(F.lit(-1).alias(c) for c in ("text", "features", "label", "id"))) if clash else rows


def items(spark, clash, rows=texts_and_ids()):
    bench = spark.createDataFrame([(0, None), (1, ""), (None, "v1 v2"), (2, " ".join(rows[2][1].split()[20:50])), (2, "w1 w2 w3 w4 w5 w6 w7 w8"), (3, "!!")], "item_id long, text string")
    return bench.select("*", *(F.lit(-1).alias(c) for c in ("doc_id", "id", "part", "n", "score"))) if clash else bench


def language(docs, clash):
    model = language_id.train(docs.withColumn("lang", F.when(F.col("doc_id") == 4, "aa").when(F.col("doc_id") > 1, "bb")))
    return language_id.predict(docs, model)


OPERATORS = {
    "op2": lambda docs, clash: quality_rules.quality_rules(docs),
    "op4": lambda docs, clash: bpe.encode(docs).select("doc_id", F.size("ids").alias("n"), F.md5("decoded").alias("digest"), F.md5(F.col("ids").cast("string")).alias("ids")),
    "op5": lambda docs, clash: substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.md5("kept_text").alias("digest")),
    "op6": lambda docs, clash: toxicity.toxicity(docs, labels(docs.sparkSession, clash), F.lit(True)),
    "op7": lambda docs, clash: decontaminate.contaminated(docs, items(docs.sparkSession, clash)),
    "op8": lambda docs, clash: near_dedup.near_duplicate_classes(docs),
    "op9": lambda docs, clash: token_scan.token_counts(docs),
    "op10": language,
}


def collected(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_long_texts_repeats_clashes_and_empty_tables(spark, name):
    rows = texts_and_ids()
    plain = OPERATORS[name](documents(spark, rows, False).repartition(3), False)
    got = collected(plain)
    assert collected(OPERATORS[name](documents(spark, rows, True), True)) == got
    assert OPERATORS[name](documents(spark, [], True), True).count() == 0
    ids = sorted((r[0] for r in got), key=repr)
    if name != "op7":
        assert ids == sorted((i for i, _ in rows), key=repr)  # a row for each row
    by_id = {i: [r for r in got if r[0] == i] for i in set(ids)}
    at = {c: k for k, c in enumerate(plain.columns)}
    if name == "op4":
        assert by_id[0] == [(0, *by_id[1][0][1:])] and by_id[0][0][1] == 0 and by_id[4][0][1] > 150_000
    if name == "op5":  # prose stands in five rows
        assert [r[1:3] for r in by_id[3]] == [(90, 90), (90, 90), (91, 90)] and by_id[4][0][1:3] == (150_000, 0) and by_id[0][0][1:3] == (0, 0)
    if name == "op7":
        assert {r[at["doc_id"]] for r in got} >= {2, 3, None} and not {0, 1, 5, 6} & set(by_id)
    if name == "op8":
        assert [r[1] for r in by_id[3]] == [2, 2, 2] and by_id[2] == [(2, 2)] and {i: r[0][1] for i, r in by_id.items() if i in (0, 1, 4, 5, 6, 7, 8)} == {i: i for i in (0, 1, 4, 5, 6, 7, 8)}
        assert {r[1] for r in by_id[None]} == {None}
    if name == "op9":
        assert by_id[0] == [(0, 0)] and by_id[1] == [(1, 0)] and by_id[4][0][1] > 150_000
    if name == "op10":
        assert {i for i, r in by_id.items() for x in r if x[at["lang_pred"]] == "und"} == {0, 1, 5, 6, None} and by_id[4][0][at["lang_pred"]] == "aa"


def test_conversations_with_nulls_repeats_and_long_turns(spark):
    long = "word </turn> \\ " * 20_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long), (2, None, None, None), (None, 0, "assistant", ""), (3, 0, "user", "a"), (3, 0, "user", "a")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = chats.select("*", *(F.lit(-1).alias(c) for c in ("turns", "formatted", "n_turns", "loss_spans", "loss_text")))
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(clash)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, 2: 1, None: 1, 3: 2}
    assert got[1]["loss_text"] == long * 2 and got[2]["turns_text"] == "\n\n" and got[3]["loss_text"] == ""


def test_archives_with_clashing_columns_and_a_long_page(spark):
    rows = [(1, "http://a", "é" * 400_000), (2, None, None), (3, "http://b", "é" * 400_000), (3, "http://b", "é" * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    names = ("payload", "digest", "refers_to", "path", "offset", "size", "record_type", "n", "key", "base")
    got = warc.read_archives(warc.write_archives(pages.select("*", *(F.lit(-1).alias(c) for c in names))), 1 << 16).select("page_id", "payload_bytes", "record_type", "refers_to")
    rest = sorted(map(tuple, got.collect()), key=repr)
    assert [r[:2] for r in rest] == [(1, 800_000), (2, 0), (3, 800_000), (3, 800_000)]
    assert [r[2:] for r in rest] == [("response", None), ("response", None), ("revisit", 1), ("revisit", 1)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_stages_over_odd_documents(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    clean = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(i, t, lang, None, None if i == 3 else 7) for (i, t), lang in zip(texts_and_ids(), ["en", None] * 7)]
    odd = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    both = clean.select(*odd.columns).withColumn("doc_id", F.col("doc_id").cast("long") + 1000).unionByName(odd)
    clash = both.select("*", *(F.lit(-1).alias(c) for c in CLASHING))
    out = stage(spark, clash, sf)
    rows = out.collect()
    if name != "bpe":
        assert out.columns == odd.columns
    kept = [r["doc_id"] for r in rows if r["doc_id"] is None or r["doc_id"] < 1000]
    every = [i for i, _ in texts_and_ids()]
    if name in ("substring_dedup", "bpe"):
        assert sorted(kept, key=repr) == sorted(every, key=repr)
    if name == "near_dedup":  # of equal and near texts the least id; rows without an id stay
        assert sorted(kept, key=repr) == sorted([0, 1, 2, 4, 5, 6, 7, 8, None, None], key=repr)
    if name == "language_id":
        assert not {0, 1, 5, 6} & set(kept)
    assert stage(spark, clash.limit(0), sf).count() == 0


def exact_grams(text):
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    codes = np.where(char_classes()[codes] == LETTER, codes, 0).tolist()
    return {(n, *codes[i : i + n]) for n in language_id.ORDERS for i in range(len(codes) - n + 1)}


def test_string_kernel_matches_exact_ngram_sets(spark, sf):
    """The hashed kernel, and the classifier built on it, against kernel ridge regression over exact n-gram sets."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null and length(text) > 40").orderBy("doc_id").limit(120).collect()
    texts, langs = [r["text"] for r in docs], [r["lang"] for r in docs]
    sets = [exact_grams(t) for t in texts]
    hashed = [np.flatnonzero(language_id.presence(t)) for t in texts]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    mine = np.array([[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for b in hashed] for a in hashed])
    assert np.abs(kernel - mine).max() < 0.02
    names, known = sorted(set(langs[:80])), 80  # every known text is a landmark, so Nyström features give the whole kernel
    model = language_id.fit(hashed[:known], langs[:known], landmarks=known)
    target = np.array([[float(x == c) for c in names] for x in langs[:known]])
    weight = np.diag([1 / langs[:known].count(x) for x in langs[:known]])
    k = kernel[:known, :known]
    solved = np.linalg.solve(k @ weight @ k + language_id.RIDGE * k + 1e-9 * np.eye(known), k @ weight @ target)
    want = kernel[known:, :known] @ solved
    got, scores, _ = model.score(texts[known:])
    assert np.mean([names[b] == g for b, g in zip(want.argmax(axis=1), got, strict=True)]) >= 0.97
    assert np.median(np.abs(np.clip(want.max(axis=1), 0, 1) - scores)) < 0.05
