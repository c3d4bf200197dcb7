"""Secret scan: base rules against plain regexes, decoding against the full Viterbi recursion, held-out secrets, odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import string
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import registry, secret_scan
from test_edges import documents, texts_and_ids

NO_FIELD = secret_scan.Field(np.zeros((2 + len(secret_scan.AROUND), 1 << secret_scan.BITS, 3)), np.full((3, 3), -9.0), frozenset())


def stated(text):
    """The base rules as they are written, letters of the names in either case."""
    either = lambda name: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)
    names = "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|" + either("api") + "_?" + either("key")
    found = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "") if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return sorted(found)


def odd_texts():
    rng = random.Random(5)
    parts = ["password", "PassWd", "secret", "toKen", "toKen", "paſſword", "api_key", "APIKEY", "apikey", '"', "'", " ", "   ", ":", "=", "==", "AKIA", "AKIAAKIA", "ABCD1234EFGH5678", "0123456789abcdef", "deadbeef" * 5, "a", "f" * 31, "hunter22", "short", "+/_.=-", "é", "😀", "\n", "\t", "G"]
    return [None, "", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(3000))]


def test_base_spans_match_the_rules():
    texts = odd_texts()
    plain = [t or "" for t in texts]
    got = [[s[:3] for s in spans] for spans in secret_scan.base_spans(plain, *secret_scan.laid_out(plain))]
    assert got == [stated(t) for t in texts]
    assert sum(map(len, got)) > 2000 and {k for spans in got for _, k, _ in spans} == {0, 1, 2}


def test_tokens_match_a_regex():
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab1é漢٣-_+/ .=\n\t'😀") for _ in range(rng.randrange(12))) for _ in range(500)]
    codes, begins = secret_scan.laid_out(texts)
    tokens = secret_scan.Tokens.of(texts, codes, begins)
    got = [[tokens.words[w] for w in tokens.word[a:b]] for a, b in zip(tokens.first[:-1], tokens.first[1:], strict=True)]
    assert got == [re.findall(r"(?:[^\W_]|[-_+/])+|[^\s]", t) for t in texts]


def test_decoding_matches_all_paths():
    rng = np.random.default_rng(2)
    moves = rng.normal(size=(3, 3))
    moves[secret_scan.OUTSIDE, secret_scan.INSIDE] = secret_scan.FORBIDDEN
    field = secret_scan.Field(NO_FIELD.weights, moves, frozenset())
    sizes = [0, 1, 7, 0, 5, 8, 6, 3]
    first = np.concatenate([[0], np.cumsum(sizes)])
    for width in (1, 8):
        scores = rng.normal(size=(first[-1], 3)) * width
        scores[:, secret_scan.OUTSIDE] += rng.choice([0, 25], size=first[-1])  # some tokens are outside on every best path
        tags = field.decode(scores, first)
        for a, b in zip(first[:-1], first[1:], strict=True):
            worth = lambda path: sum(scores[a + i, t] for i, t in enumerate(path)) + sum(moves[x, y] for x, y in zip((2, *path), (*path, 2)))
            assert worth(tags[a:b].tolist()) == pytest.approx(max(map(worth, product(range(3), repeat=b - a))) if b > a else moves[2, 2])


def test_expectations_match_all_paths():
    rng = np.random.default_rng(3)
    moves, counts = rng.normal(size=(3, 3)), np.array([3, 0, 1, 4])
    of = np.repeat(np.arange(4), counts)
    slot = np.arange(8) - np.repeat(np.cumsum(counts) - counts, counts)
    scores = rng.normal(size=(8, 3))
    marginal, pairs = secret_scan.expectations(scores, moves, of, slot, counts, 4)
    want, want_pairs = np.zeros((8, 3)), np.zeros((3, 3))
    for s in range(4):
        at = np.flatnonzero(of == s)
        paths = list(product(range(3), repeat=len(at))) if len(at) else []
        weight = np.array([np.exp(sum(scores[i, t] for i, t in zip(at, p)) + sum(moves[x, y] for x, y in zip((2, *p), (*p, 2)))) for p in paths])
        for p, w in zip(paths, weight / weight.sum() if len(at) else []):
            for i, t in zip(at, p):
                want[i, t] += w
            for x, y in zip((2, *p), (*p, 2)):
                want_pairs[x, y] += w
    assert np.allclose(marginal, want) and np.allclose(pairs, want_pairs)


@pytest.fixture(scope="module")
def fitted(spark):
    return secret_scan.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 1"))


def test_held_out_secrets_are_found_and_clean_texts_left_alone(spark, fitted):
    rng = random.Random(9)
    texts = [r["text"][:2000] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) > 200 and doc_id % 2 = 0").orderBy("doc_id").limit(900).collect()]
    known = secret_scan.WordFeatures(fitted.names)
    clean = secret_scan.find_in(texts, fitted, known)
    assert sum(any(k == 3 for _, k, _ in spans) for spans in clean) <= 0.005 * len(texts)
    for heads, least in ((["auth = '", "client_key: ", "bearer "], 0.85), (["vault_pin: ", "auth_header = '", "deploy_cred := "], 0.6)):  # names of the fit, and others
        planted, hits = [], 0
        for text in texts[:400]:
            value, head = "".join(rng.choices(string.ascii_letters + string.digits, k=rng.randrange(20, 41))), rng.choice(heads)
            at = text.index(" ") + 1
            planted.append((text[:at] + head + value + " " + text[at:], at + len(head), at + len(head) + len(value)))
        found = secret_scan.find_in([t for t, _, _ in planted], fitted, known)
        hits = sum(any(a <= x and y <= b for a, _, b in spans) for spans, (_, x, y) in zip(found, planted, strict=True))
        assert hits >= least * len(planted), (heads, hits)


def test_query_carries_base_spans_and_digests(spark, sf):
    rows = {r["doc_id"]: r for r in registry.QUERIES["op11_secrets"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        base, row = stated(text), rows[doc_id]
        written = [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert [row[c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert row["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        spans = [s for s in row["spans"].split(",") if s]
        assert [s for s in spans if not s.startswith("crf:")] == written
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), secret_scan.KINDS.index(s.split(":")[0])))


def test_odd_rows_repeats_clashes_and_empty_tables(spark, fitted):
    rows = [*texts_and_ids(), (50, "token: " + "q" * 9), (50, "token: " + "q" * 9), (51, "x" * 200_000 + " AKIA" + "Z" * 12)]
    collected = lambda frame: sorted(map(tuple, frame.collect()), key=repr)
    plain = collected(secret_scan.find_secrets(documents(spark, rows, False).repartition(3), fitted))
    assert collected(secret_scan.find_secrets(documents(spark, rows, True).withColumn("spans", F.lit(1)), fitted)) == plain
    assert sorted((r[0] for r in plain), key=repr) == sorted((i for i, _ in rows), key=repr)
    found = {r[0]: [tuple(s) for s in r[1]] for r in plain}
    assert found[0] == found[1] == found[5] == [] and found[50] == [("assign", 0, 16)]
    assert ("access", 200_001, 200_017) in found[51]
    assert secret_scan.find_secrets(documents(spark, [], True), fitted).count() == 0
    # a table without anything to learn from gives the base spans alone
    assert secret_scan.find_secrets(documents(spark, [(1, None), (2, "")], False)).count() == 2
    assert [r["spans"] for r in secret_scan.find_secrets(documents(spark, [(1, "secret=abcdefgh")], False)).collect()][0][0]["kind"] == "assign"
