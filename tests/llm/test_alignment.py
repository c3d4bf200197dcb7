"""Alignment against a plain statement of the rule with both libraries on whole texts; odd rows, large groups, whole-text encoding."""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barline.llm import alignment, registry
from test_edges import documents, texts_and_ids


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_signs():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def tokens(text, libraries):
    a, b = libraries
    signs = byte_signs()
    found = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(signs[c] for c in piece)) for i, piece in zip(found.ids, found.tokens, strict=True)]
    ids = b.encode(text)
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in zip(ids, map(b.id_to_piece, ids), strict=True)]
    whole = (" " + text).encode()
    return (left, right) if text and all(b"".join(x for _, x in side) == whole for side in (left, right)) else ([], [])


def stated(texts, libraries):
    """The rule for one row of each text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    rows, links = [], []
    for text in texts:
        left, right = tokens(text or "", libraries)
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (left, right)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for k, side in enumerate((left, right)):
            for (i, _), end in zip(side, ends[k], strict=True):
                groups[bisect_left(cuts, end)][k].append(i)
        links.append(Counter((x, y) for g in groups for x in g[0] for y in g[1]))
        rows.append([len(left), len(right), len(groups), sum(links[-1].values()), ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)])
    count = Counter(p for found in links for p in found)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for row, found in zip(rows, links, strict=True):
        row[4:4] = [sum(n for p, n in found.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in found.items())]
    return [tuple(r) for r in rows]


def got(frame):
    return {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")) for r in frame.collect()}


def odd_texts():
    rng = random.Random(11)
    signs = list("abcdeté ñ☃😀漢字👩‍🚀\t\n\r\x00\x85\xa0  ﬁ'") + ["the ", "ing", "▁", "<s>", "</s>", "<|endoftext|>", "<0x41>", "  ", "don't", "123", "!!!", "\n\n   x"]
    made = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    return [None, "", " ", "   ", "a", "a ", " a", "the the the", "é" * 300, "aaaaaaaaaaaaaaab" * 40, "😀" * 50, "x▁y", "the ▁", *made]


def test_alignment_matches_the_rule(spark, libraries):
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got(alignment.align(docs.repartition(5))) == dict(enumerate(stated(texts, libraries)))


def test_whole_texts_of_documents_and_digests(spark, sf, libraries):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r["doc_id"]: (*x[:6], hashlib.sha256(x[6].encode()).hexdigest() if x[6] else "") for r, x in zip(rows, stated([r["text"] for r in rows], libraries), strict=True)}
    found = registry.QUERIES["op12_alignment"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in found} == want


def test_chunks_encode_like_whole_texts(libraries):
    a, b = libraries
    left, right = alignment.byte_level(alignment.default_tokenizer()), alignment.piece_level(alignment.default_pieces())
    assert left.chunked and right.chunked
    texts = [" " + t for t in odd_texts() if t and "▁" not in t]  # a text with that sign is never spelled, however it is cut
    for lists, whole in zip(alignment.encode_texts(texts, [left, right]), (lambda t: a.encode(t, add_special_tokens=False).ids, lambda t: b.encode(t[1:])), strict=True):
        assert lists.to_pylist() == [whole(t) for t in texts]
    # a model that may join signs across a space gets whole texts
    whole = alignment.Coder(right.token_bytes, right.decimals, right.encode, False)
    spelled = [t for t in texts if t.strip()]
    assert alignment.encode_texts(spelled, [whole])[0].to_pylist() == [b.encode(t[1:]) for t in spelled]


def test_odd_rows_repeats_clashes_and_empty_tables(spark):
    rows = texts_and_ids()
    names = ("block", "pairs", "times", "asked", "counts", "groups", "a", "b", "pair")
    tuples = lambda frame: sorted(map(tuple, frame.collect()), key=repr)
    plain = tuples(alignment.align(documents(spark, rows, False).repartition(3), keep_groups=False))
    clash = documents(spark, rows, True)
    clash = clash.select("*", *(F.lit(-1).alias(c) for c in names if c not in clash.columns))
    assert tuples(alignment.align(clash, keep_groups=False)) == plain
    assert sorted((r[0] for r in plain), key=repr) == sorted((i for i, _ in rows), key=repr)
    by_id = {r[0]: r for r in plain}
    assert by_id[0][1:] == by_id[1][1:] == (0, 0, 0, 0, 0, 0, "")
    assert by_id[4][1] > 150_000 and by_id[4][4] >= by_id[4][3]
    assert alignment.align(documents(spark, [], True)).count() == 0


def test_links_of_a_large_group_are_counted_not_listed():
    """Tokens of 70 and of 110 bytes meet every 770: 11 tokens by 7 a group, few distinct ids."""

    def even(size):
        words = pa.array([b" " + b"a" * (size - 1), b"a" * size], pa.large_binary())
        encode = lambda texts: (np.array([i for t in texts for i in ([0] + [1] * (len(t) // size))[: len(t) // size]]), np.array([len(t) // size for t in texts]))
        return alignment.Coder(words, pa.array(["0", "1"]), encode, False)

    x = alignment.align_block(["a" * (770 * 100 - 1), "", "a" * 769, "b" * 769], even(70), even(110))
    assert x.n_a.tolist() == [1100, 0, 11, 0] and x.n_b.tolist() == [700, 0, 7, 0] and x.n_groups.tolist() == [100, 0, 1, 0]
    assert x.n_links.tolist() == [7700, 0, 77, 0] and x.offsets.tolist() == [0, 4, 4, 8, 8]
    assert x.groups[2] == "0" + ",1" * 10 + "|0" + ",1" * 6
    assert dict(zip(x.pairs[:4].tolist(), x.times[:4].tolist(), strict=True)) == {0: 1, 1: 6, 2: 10, 3: 7683}
