"""Nearest chunks by tiles against brute force: several tiles, far norms, ties, missing vectors."""

from __future__ import annotations

import numpy as np

from barline.operators import text


def test_nearest_over_many_tiles_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(700, 8)) * rng.choice([0.1, 1.0, 30.0], size=(700, 1))
    v[100:110] = v[90:100]  # ties
    rows = [(i, f"s{i % 3}", None if i % 97 == 0 else x.tolist()) for i, x in enumerate(v)]
    corpus = spark.createDataFrame(rows, "vec_id long, source string, v array<double>")
    asked = [i for i in range(700) if i % 25 == 0 or 90 <= i < 110]
    queries = corpus.where(corpus.vec_id.isin(asked)).selectExpr("vec_id as query_id", "v as q")
    want = {}
    for q in asked:
        if rows[q][2] is not None:
            d = [(float(np.square(v[i] - v[q]).cumsum()[-1]), i) for i in range(700) if i != q and rows[i][2] is not None]
            want[q] = [i for _, i in sorted(d)[:5]]
    for size in (text.TILE_BYTES, 1 << 12):
        monkeypatch.setattr(text, "TILE_BYTES", size)
        got = {}
        for r in sorted(text.chunk_topk(corpus, queries, 5).collect(), key=lambda r: r["place"]):
            got.setdefault(r["query_id"], []).append(r["vec_id"])
            assert r["source"] == f"s{r['vec_id'] % 3}"
        assert got == want
    few = spark.createDataFrame([(1, "a", [0.0]), (2, "b", [1.0]), (3, "c", None)], "vec_id long, source string, v array<double>")
    near = text.chunk_topk(few, few.selectExpr("vec_id as query_id", "v as q"), 5).collect()
    assert sorted((r["query_id"], r["vec_id"], r["distance"]) for r in near) == [(1, 2, 1.0), (2, 1, 1.0)]
    assert text.chunk_topk(few.where("vec_id > 9"), few.selectExpr("vec_id as query_id", "v as q"), 5).count() == 0
