"""Draws of near_dedup against their plain rule, and how many whole draws they make."""

from __future__ import annotations

import numpy as np
import pytest

from barline.llm import near_dedup
from barline.llm.blocks import BASE, mix


def block(sizes, n_levels, seed=3):
    rng = np.random.default_rng(seed)
    per = np.array(sizes, dtype=np.int64)
    return rng.integers(0, 2**64, per.sum(), dtype=np.uint64), rng.integers(-5, n_levels - 5, per.sum()), per


def plain(values, level, per):
    """Each text's least draw of all its shingles, sample by sample."""
    out = []
    for a, n in zip(np.cumsum(per) - per, per):
        if n:
            own, at = values[a : a + n], []
            for k in range(near_dedup.SAMPLES):
                odd = mix(np.array([k + 1], np.uint64) * np.uint64(BASE))[0] | np.uint64(1)
                place = (own * odd) >> np.uint64(64 - near_dedup.POOL_BITS)
                at.append((near_dedup._draw(level[a : a + n], *(x[place] for x in near_dedup._pool())) ^ (own & np.uint64(0xFFFFFFFF))).min() & np.uint64(0xFFFFFFFF))
            out.append(at)
    return np.array(out, dtype=np.uint32).reshape(-1, near_dedup.SAMPLES)


@pytest.mark.parametrize("tables, chunk", [(192, 1 << 16), (3, 100), (1, 1), (200, 1000)])
@pytest.mark.parametrize("sizes", [[], [0, 0], [1], [0, 1, 0, 2, 5, 0], [400, 1, 1, 3000, 0, 90], [1200]])
def test_draws_equal_their_plain_rule(monkeypatch, tables, chunk, sizes):
    monkeypatch.setattr(near_dedup, "TABLES", tables)
    monkeypatch.setattr(near_dedup, "CHUNK", chunk, raising=False)
    given = block(sizes, 120)
    assert np.array_equal(near_dedup.signatures(*given), plain(*given))
    far = (given[0], given[1] * 40, given[2])  # weights whose ranks are clipped
    assert np.array_equal(near_dedup.signatures(*far), plain(*far))


def test_whole_draws_are_about_one_a_text_and_sample(monkeypatch):
    """With many weights too, which were once drawn whole for every shingle beyond the most frequent weights."""
    given = block([300] * 40, 100)
    want, drawn, draw = near_dedup.signatures(*given), [], near_dedup._draw  # tables are made once
    monkeypatch.setattr(near_dedup, "_draw", lambda level, *numbers: drawn.append(len(numbers[0])) or draw(level, *numbers))
    assert np.array_equal(near_dedup.signatures(*given), want)
    assert sum(drawn) <= 2 * 40 * near_dedup.SAMPLES
