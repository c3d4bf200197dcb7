"""Features of a large Arrow batch are taken by pieces, so that a worker holds little beside the batch."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from barline.llm import toxicity


def test_features_of_a_large_batch_hold_little_memory(spark, monkeypatch):
    rng = random.Random(3)
    common = [f"w{i}" for i in range(2000)]
    texts = [" ".join(rng.choices(common, k=400)) + " Scum! you" * (i % 3) for i in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    rows, lexicon, caught = spark.createDataFrame([], "doc_id long, text string"), {"scum": 3.0}, []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: caught.append(run))
    toxicity.with_features(rows, lexicon)
    whole = toxicity.block_features(texts, toxicity.WordKinds({"scum": (3.0, 0)}))
    tracemalloc.start()
    try:
        got = [x.column(1).flatten().to_numpy().reshape(x.num_rows, -1) for x in caught[0]([batch])]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.array_equal(np.concatenate(got), whole)
    assert batch.nbytes > 4e6 and peak < 80e6, peak
