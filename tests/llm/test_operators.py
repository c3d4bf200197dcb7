"""Operators against brute force, the tokenizers library, exact round trips and held-out accuracy; nulls, ties, repeats, empty tables."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import bpe, chat_format, decontaminate, exchange, language_id, near_dedup, pretokens, quality_rules, registry, substring_dedup, token_scan, toxicity, warc
from compare import assert_same

DOC = "doc_id long, text string, extra int, id int, bucket string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOC)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(7)
    shared = words(rng, 60)
    return [None, "", " \n\t ", "one", shared, shared, shared + " tail", "x " + shared + "\n" + words(rng, 40), words(rng, 300), "a " * 200, words(rng, 34), "naïve ☃ <|endoftext|> 'tis don't  " * 30]


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    assert assert_same(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf) > 0


def test_substring_dedup_matches_brute_force(spark, odd_texts):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in substring_dedup.remove_repeats(frame(spark, odd_texts)).collect()}
    want = substring_dedup.brute_force(odd_texts)
    assert [got[i] for i in range(len(odd_texts))] == want
    again = substring_dedup.remove_repeats(frame(spark, ["a b " * 30] * 2, [5, 5])).collect()  # a repeated row
    assert [r["n_removed"] for r in again] == [60, 60]
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_equal_entries_of_many_blocks_are_one_in_a_relay():
    """A window that every block has: with more blocks the merged entries grow by the others alone."""
    rng = np.random.default_rng(4)
    for n in (10, 1000):
        own = rng.integers(0, 2**40, n * 5).astype(np.uint64)
        low = np.concatenate([np.full(n, 7, np.uint64), own])
        check, counts = np.concatenate([np.full(n, 3, np.uint64), own % 100]), np.ones(len(low), np.uint64)
        values, checks, totals, inverse = exchange.merged(low, check, counts)
        assert len(values) == len(set(own.tolist())) + 1 and totals.max() == n and (totals > 1).sum() == 1
        assert np.array_equal(values[inverse], low) and np.array_equal(checks[inverse], check)
    values, checks, totals, _ = exchange.merged(np.array([1, 1, 1], np.uint64), np.array([5, 6, 5], np.uint64), np.array([2, 3, 4], np.uint64))
    assert sorted(zip(values.tolist(), checks.tolist(), totals.tolist())) == [(1, 5, 6), (1, 6, 3)]  # equal hashes, two checks


def test_substring_dedup_with_relays_and_colliding_hashes(spark, monkeypatch):
    """Finer buckets through relays, as beyond 256 GB of text; and windows whose main hashes collide are told apart by their checks."""
    rng = random.Random(8)
    shared = [words(rng, 60) for _ in range(5)]
    texts = [" ".join([words(rng, 80), rng.choice(shared), words(rng, 40)]) for _ in range(80)]
    want = substring_dedup.brute_force(texts)
    got = lambda: {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in substring_dedup.remove_repeats(frame(spark, texts).repartition(4)).collect()}
    monkeypatch.setattr(exchange, "COARSE_BITS", 3)
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 1 << 10)
    monkeypatch.setattr(exchange, "RELAY_BYTES", 1 << 14)
    assert exchange.bucket_bits(10**5) > 3
    assert got() == dict(enumerate(want))
    monkeypatch.undo()
    values, check = np.array([5, 7, 5, 5], np.uint64), np.array([1, 1, 2, 1], np.uint64)
    first, inverse, counts = exchange._unique(values, check)
    assert sorted(counts.tolist()) == [1, 1, 2] and inverse[0] == inverse[3] != inverse[2] and len(first) == 3


def test_bpe_equals_the_library(spark, odd_texts):
    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    rng = random.Random(3)
    signs = ["'", "s", "t", "re", "ll", " ", "  ", "\n", " ", "　", "\x85", "\x1c", "1", "Ⅷ", "é", "中", "😀", "!", "a" * 30, "<|endoftext|>", "́"]
    texts = [*odd_texts, *("".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(200)), "ab" * 2000]
    for r in bpe.encode(frame(spark, texts)).collect():
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(frame(spark, [])).count() == 0


def test_lexicon_knows_its_words_only():
    ranks = pretokens.load_ranks(bpe.default_tokenizer())
    known = sorted({b" the", b"the", b"then", b"bathe", b"a", "é".encode()})
    lexicon = bpe.Lexicon.build(known, ranks)
    probe = [*known, b"th", b"thenn", b"b", b"bath"]
    ends = np.cumsum([len(w) for w in probe])
    found = lexicon.find(np.frombuffer(b"".join(probe), np.uint8), ends - [len(w) for w in probe], ends)
    assert found.tolist() == [*range(len(known)), -1, -1, -1, -1]


def test_chat_round_trip_and_rewriting_templates(spark):
    rng = random.Random(1)
    parts = ["\\", "#", "###", "</turn>", "<", ":", " ", "\n", "é"]
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "a:b\\"]), "".join(rng.choice(parts) for _ in range(rng.randrange(10)))) for _ in range(rng.randrange(5))]
        out, _, texts, rewritten = chat_format.render_spans(turns, chat_format.turn_template)
        assert not rewritten and chat_format.parse(out) == turns
        assert [chat_format.unescape(out[a:b]) for a, b in texts] == [t for _, t in turns]
    forgetful = lambda turns, open_role: "|".join(t for _, t in turns[-2:])
    assert chat_format.render_spans([("u", "a"), ("u", "b"), ("u", "c")], forgetful)[3]
    rows = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, None, "x"), (None, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(rows)).collect()}
    assert got[1]["turns_text"] == "\nx\nuser\n\nassistant\nb\n" and got[1]["loss_text"] == "b" and got[None]["n_turns"] == 1
    assert chat_format.format_chats(rows.limit(0)).count() == 0


def test_quality_counts(spark, odd_texts):
    for r in quality_rules.quality_rules(frame(spark, odd_texts)).collect():
        text = odd_texts[r["doc_id"]] or ""
        w = text.encode().split()
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if x.split(" ") and x.strip(" \t\n\x0b\x0c\r")]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (len(w), len(covered), failed)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["word_chars"] == sum(len(x.decode()) for x in w) and r["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        assert not (failed and r["kept"])
    noise = base64.b64encode(random.Random(2).randbytes(60000)).decode()
    noise = " ".join(noise[i : i + 60] for i in range(0, len(noise), 60))
    assert [r["kept"] for r in quality_rules.quality_rules(frame(spark, [noise])).collect()] == [False]


def test_quality_rejects_incompressible_and_repeated_parts(spark):
    rng = random.Random(5)
    syllables = [a + b for a in "bcdfglmnprst" for b in ("a", "en", "i", "or", "u")]
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))[:n]
    noise = lambda n: " ".join(base64.b64encode(rng.randbytes(6)).decode() for _ in range(n))[:n]
    passage = lambda n: (prose(250) + " ") * (n // 250)
    good = [prose(n) for n in (400, 700, 1000, 3000, 20000, 60000)]
    bad = [prose(n - n * k // 100) + " " + part(n * k // 100) for n in (20000, 60000) for k, part in ((40, noise), (50, noise), (60, noise), (40, passage))]
    bad += [noise(n) for n in (450, 512, 700, 1000, 4000)]
    texts = good + bad
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(spark, texts)).collect()}
    assert not any(rows[i]["base_failed"] for i in range(len(good) + 8))
    assert [rows[i]["kept"] for i in range(len(texts))] == [True] * len(good) + [False] * len(bad)


def test_warc_rejects_magic_in_payloads(spark):
    trap = warc.record(99, "http://x", b"inner", None).decode()
    pages = [(1, "http://a", trap), (2, None, None), (3, "http://b/\r\nWARC/1.1", "é" * 5000 + trap), (4, "u", trap), (5, "u", None), (2, "u", None), (None, "u", "n")]
    manifest = warc.write_archives(spark.createDataFrame([(*p, 7) for p in pages], "page_id long, url string, html string, digest int"))
    for size in (97, 1 << 20):
        rows = warc.read_archives(manifest, size, with_payload=True).collect()
        got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in rows)
        n = len(trap)
        assert got == sorted([(1, n, "response", 0), (2, 0, "response", 0), (2, 0, "response", 0), (3, 10000 + n, "response", 0), (4, n, "revisit", 1), (5, 0, "revisit", 2), (0, 1, "response", 0)])
        assert all(r["digest_ok"] for r in rows if r["record_type"] == "response")
        assert {r["payload"].decode() for r in rows if r["page_id"] == 1} == {trap}
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_token_files_are_counted_across_blocks(spark, odd_texts):
    docs = frame(spark, odd_texts).repartition(3)
    codec = token_scan.encoding(token_scan.default_ranks())
    want = {i: len(codec.encode_ordinary(t or "")) for i, t in enumerate(odd_texts)}
    assert dict(token_scan.token_counts(docs).collect()) == want
    written = token_scan.write_token_files(docs)
    files = written.groupBy("base", "path", "width").agg(F.max("size").alias("size"))
    for size in (3, 64, 1 << 20):
        scanned = token_scan.scan_token_files(files, block_tokens=size)
        assert sorted(r["n_tokens"] for r in scanned.collect()) == sorted(want.values())
    cut = files.withColumn("size", F.col("size") - 2)  # the last document of each file loses its separator
    assert {r["ended"] for r in token_scan.scan_token_files(cut, block_tokens=5).collect()} == {True, False}
    assert token_scan.token_counts(frame(spark, [])).count() == 0


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(4)
    items = [words(rng, n, 10**6) for n in (1, 4, 5, 7, 9, 10, 16, 40)]
    texts, rows = [None, ""], {}
    for k, item in enumerate(items):
        for swaps in {0, 1, 2, len(item.split()) // 2}:
            own = item.split()
            for j in rng.sample(range(len(own)), min(swaps, len(own))):
                own[j] = "zzz"
            rows[len(texts)] = (k, swaps)
            texts.append(words(rng, 30, 10**6) + " " + " ".join(own).upper() + ", " + words(rng, 30, 10**6))
    texts += [" ".join(items[3].split()[:6]), items[3] + " " + items[3]]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate([*items, None, ""])], "item_id int, text string")
    found = decontaminate.contaminated(frame(spark, texts), bench)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in found.collect()}
    want = {(d, i): s for d, t in enumerate(texts) for i, item in enumerate(items) if (s := decontaminate.brute_force(t, item)) is not None and s >= decontaminate.needed(len(item.split()))}
    assert got == want and found.schema["item_id"].dataType.simpleString() == "int"
    for d, (k, swaps) in rows.items():  # whole items are found, with one word substituted from five words on
        if swaps == 0 or swaps == 1 and k >= 2:
            assert (d, k) in got
        if swaps == 2 and k < 5 or swaps == 1 and k < 2:
            assert (d, k) not in got
    assert {d for d, _ in got} >= {len(texts) - 1} and len(texts) - 2 not in {d for d, _ in got}
    clean = decontaminate.clean(frame(spark, texts), bench).collect()
    assert {r["doc_id"] for r in clean} == set(range(len(texts))) - {d for d, _ in got}
    least = decontaminate.contaminated(frame(spark, texts), bench, min_words=5).collect()
    assert {(r["doc_id"], r["item_id"]) for r in least} == {x for x in got if x[1] >= 2}


def test_decontamination_in_several_blocks_of_items(spark, monkeypatch):
    rng = random.Random(5)
    items = [words(rng, 20, 10**6) for _ in range(40)]
    docs = frame(spark, [words(rng, 10, 10**6) + " " + items[i % 40] + " " + words(rng, 10, 10**6) for i in range(60)] + [words(rng, 40, 10**6)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole = sorted(tuple(r) for r in decontaminate.contaminated(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK_HASHES", 300)
    assert decontaminate.item_blocks(bench).more
    assert sorted(tuple(r) for r in decontaminate.contaminated(docs, bench).collect()) == whole and len(whole) == 60
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()] == [60]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", "one two", "one two", "one two three"]
    for _ in range(12):
        base = words(rng, 150, 5000).split()
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 4, 8, 20):
            own = base.copy()
            for j in rng.sample(range(len(own)), edits):
                own[j] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    got = dict(near_dedup.near_duplicate_classes(frame(spark, texts)).collect())
    assert got == dict(enumerate(classes_of_all_pairs(texts)[0]))


def classes_of_all_pairs(texts):
    """Least index of each text's class, and the similarities of all pairs, by comparing every text with every other."""
    first = {t: i for i, t in reversed(list(enumerate(texts))) if (t or "").split()}
    nodes, seen, counted = sorted(first.values()), set(), []
    hashed = [near_dedup.shingles(near_dedup.hash_words([texts[i].encode()])) for i in nodes]
    for values, _, per in hashed:
        keys = set(near_dedup.sketch_keys(values, per)[0].tolist())
        counted.append(not keys & seen)
        seen |= keys
    df = Counter(v for (values, _, _), c in zip(hashed, counted, strict=True) if c for v in values.tolist())
    packed = [near_dedup.pack(v, near_dedup.levels(tf, np.array([df[x] for x in v.tolist()]), sum(counted))) for v, tf, _ in hashed]
    near = near_dedup.similarities(packed, packed)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(*np.nonzero(near >= near_dedup.THRESHOLD), strict=True):
        x, y = find(nodes[a]), find(nodes[b])
        parent[max(x, y)] = min(x, y)
    return [find(first.get(t, i)) for i, t in enumerate(texts)], near


def test_near_duplicates_among_many_texts_over_one_template(spark):
    """Recall of all similar pairs: pairs over a template that all share, and a large group of near copies with edits of their own."""
    rng = random.Random(12)
    template = [f"t{i}" for i in range(300)]
    texts = []
    for _ in range(200):
        own = [[f"u{rng.randrange(10**9)}" for _ in range(n)] for n in (200, 28, 28)]
        texts += [" ".join([*template, *own[0], *own[i]]) for i in (1, 2)]
    for _ in range(300):
        copy = template + [f"c{i}" for i in range(100)]
        for j in rng.sample(range(300, 400), 1):
            copy[j] = f"e{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    want, near = classes_of_all_pairs(texts)
    assert 0.8 < near[0, 1] < 0.87 and len(set(want)) < 350
    got = dict(near_dedup.near_duplicate_classes(frame(spark, texts)).collect())
    found = [got[i] == got[want[i]] for i in range(len(texts)) if want[i] != i]
    assert np.mean(found) >= 0.95 and all(want[i] == want[got[i]] for i in got)


def test_copies_do_not_lower_the_weight_of_their_shingles(spark):
    rng = random.Random(14)
    base = words(rng, 200, 10**6).split()
    texts = []
    for _ in range(400):  # one group of near copies, each with two words of its own
        own = base.copy()
        for j in rng.sample(range(200), 2):
            own[j] = f"e{rng.randrange(10**9)}"
        texts.append(" ".join(own))
    texts += [words(rng, 200, 10**6) for _ in range(400)]
    got = dict(near_dedup.near_duplicate_classes(frame(spark, texts)).collect())
    assert [got[i] for i in range(400)] == [0] * 400 and [got[i] for i in range(400, 800)] == list(range(400, 800))


def test_similarities_by_matrices_equal_those_by_pairs():
    rng = random.Random(13)
    packed = []
    for _ in range(30):
        values = np.sort(np.array(rng.sample(range(60), rng.randrange(1, 50)), dtype=np.uint64)) << np.uint64(32)
        packed.append(near_dedup.pack(values, np.array([rng.choice([0, 5, 40, 90]) for _ in values])))
    want = [[near_dedup.weighted_jaccard(x, y) for y in packed[20:]] for x in packed[:20]]
    assert np.allclose(near_dedup.similarities(packed[:20], packed[20:]), want, atol=1e-12)


def test_language_id_learns_and_rejects(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = registry.QUERIES["op10_language_id"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    model = language_id.train(docs)
    odd = language_id.predict(frame(spark, [None, "", "123 !!", "ß"]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in odd[:3]] == ["und"] * 3 and odd[3]["lang_pred"] != "und"
    assert {r["lang_pred"] for r in language_id.predict(frame(spark, ["abc"]), language_id.train(docs.limit(0))).collect()} == {"und"}


def plain_features(text, lexicon):
    """The features of one text by a plain loop over its words."""
    tokens = [w.decode() for w in (text or "").encode().split()]
    found, n = [toxicity.word_kind(w, lexicon) for w in tokens], len(tokens)
    if not n:
        return [0.0] * len(toxicity.FEATURES)
    hits = [(i, k[0], k[6]) for i, k in enumerate(found) if k[0] > 0]
    masked, single = sum(k[1] for k in found), []
    for i, w in enumerate([*tokens, "  "]):  # letters set apart by spaces
        if len(w) == 1 and w.isalpha():
            single.append(w)
        else:
            at = lexicon.get(toxicity.fold("".join(single)))
            if len(single) > 3 and at:
                hits.append((i - 1, at[0], at[1]))
                masked += 1
            single = []
    second = [i for i, k in enumerate(found) if k[2]]
    gaps = [abs(i - j) for i, _, _ in hits for j in second]
    near = 1 / (1 + min(gaps)) if gaps and min(gaps) <= toxicity.REACH else 0.0
    weights = [w for _, w, _ in hits]
    return [
        len(hits) / n, np.log1p(len(hits)), max(weights, default=0.0), sum(weights) / n, len({k for _, _, k in hits}), masked, near, len(second) / n, sum(map(str.isupper, text)) / (sum(map(str.isalpha, text)) or 1),
        sum(k[3] for k in found) / n, text.count("!") / n, sum(map(text.count, ".,;:!?*#@$")) / n, sum(k[4] for k in found) / n, np.log1p(n),
    ]


def test_toxicity_features_match_a_plain_loop():
    rng = random.Random(16)
    lexicon = {w: (0.5 + i, i) for i, w in enumerate(["scum", "blockhead", "loser", "dolt"])}
    bits = ["scum", "S.C.U.M", "bl0ckhead", "you", "Your", "s c u m", "d o l t", "l o s e r", "a b c d", "I", "x", "HELLO", "fine,", "w0rd", "!", "...", "é", "ÀÉ", "dolt!", "\n", "\t", "☃", "vous"]
    texts = [None, "", " ", "s c u m", "you scum", *(" ".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(200)), "scum " * 3000]
    kinds = toxicity.WordKinds(lexicon)
    got = toxicity.block_features([t or "" for t in texts], kinds)
    assert np.allclose(got, [plain_features(t, lexicon) for t in texts], atol=1e-12)


def test_toxicity_separates_planted_texts(spark):
    rng = random.Random(11)
    texts, labels = [], []
    for i in range(400):
        own = words(rng, 60, 3000).split()
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            own[rng.randrange(60)] = rng.choice(["scumbag", "blockhead", "Scumbag!", "bl0ckhead", "loserish", "loserish"])
        texts.append(" ".join(own))
        labels.append((i, int(toxic)))
    labels = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    docs = frame(spark, [*texts, None, "", words(rng, 5000, 3000)])
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels, ~toxicity.held_out()).collect()}
    assert len(got) == 403 and all(0 <= r["score"] <= 1 for r in got.values())
    hits = [got[i]["predicted"] == (i % 4 == 0) for i in range(400)]
    assert np.mean(hits) > 0.95 and got[400]["predicted"] == got[401]["predicted"] == got[402]["predicted"] == 0
    none = toxicity.toxicity(docs, labels.limit(0), ~toxicity.held_out()).collect()
    assert {r["score"] for r in none} == {0.0}


def test_lexicon_counts_texts_with_a_shared_opening(spark):
    rng = random.Random(15)
    header = " ".join(f"header{c}" for c in "abcdefghijkl")
    copy = words(rng, 80, 3000)
    texts = [(1, f"{header} {words(rng, 40, 3000)} scumbag {words(rng, 10, 3000)}") for _ in range(40)]
    texts += [(1, f"{copy} copyword {copy} x{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}") for i in range(40)]
    texts += [(0, words(rng, 60, 3000)) for _ in range(200)] + [(0, f"{header} {words(rng, 40, 3000)}") for _ in range(40)]
    rows = spark.createDataFrame(texts, "toxic int, text string")
    got = toxicity.learn_lexicon(rows)
    assert "scumbag" in got and "copyword" not in got
    assert toxicity.learn_lexicon(rows.repartition(7).orderBy("text")) == got


def test_folding_undoes_obfuscation():
    assert {toxicity.fold(w) for w in ("Scum", "s.c.u.m", "$cum!", "scuuuum", "SCÜM,")} == {"scum"}


def test_pipeline_stages_keep_the_columns_of_documents(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, numbers = docs.count(), defaultdict(int)
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf)
        assert rows.columns == docs.columns
        rows = near_dedup.materialize(rows, name)
        numbers[name] = rows.count()
    assert before >= numbers["language_id"] >= numbers["near_dedup"] == numbers["substring_dedup"] >= numbers["decontaminate"] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, rows, sf).collect()
    assert len(out) == numbers["decontaminate"] and len({r["doc_id"] for r in out}) == len(out)
