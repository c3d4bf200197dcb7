"""Fill-in-middle against plain slicing, the skip list against a linear walk, odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import fill_middle
from test_edges import documents, texts_and_ids


def stated(doc_id, text, fim=100, spm=50):
    """The rule, with line regexes and slices."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_skip_lists_find_every_rank():
    rng = random.Random(3)
    counts = np.array([0, 1, 2, 0, 5000, 37, 0], dtype=np.int64)
    widths = np.array([rng.randrange(1, 90) for _ in range(counts.sum())], dtype=np.int64)
    lists = fill_middle.SkipLists(widths, counts)
    assert 4 <= len(lists.lanes) <= 14
    assert len(lists.lanes[1][0]) < 0.4 * len(lists.lanes[0][0])
    first = np.cumsum(counts) - counts
    for t, n in enumerate(counts):
        ranks = np.arange(n + 1)
        want = np.concatenate([[0], np.cumsum(widths[first[t] : first[t] + n])])
        assert np.array_equal(lists.find(np.full(n + 1, t), ranks), want)


def test_fill_in_middle_matches_slices(spark):
    rng = random.Random(4)
    pool = ["\n", "\n\n", "a line\n", "é☃😀 wide\n", "no end", "<", "<P", "S>", "\r\n", "\x0b", " ", "x" * 50]
    rows = texts_and_ids() + [(100 + i, "".join(rng.choice(pool) for _ in range(rng.randrange(40)))) for i in range(400)] + [(10, "a<P>b\nc"), (11, "<M>"), (12, "\n" * 200_000)]
    for fim, spm in ((100, 50), (40, 90)):
        got = fill_middle.fill_in_middle(documents(spark, rows, False).repartition(3), fim_percent=fim, spm_percent=spm).collect()
        assert len(got) == len(rows)
        texts = sorted(((r["doc_id"], *r[1:6]) for r in got), key=repr)
        assert texts == sorted(((i, *stated(i, t, fim, spm)) for i, t in rows), key=repr)
        assert sorted(((r["doc_id"], r["restored"]) for r in got), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_clashing_columns_empty_tables_and_marks(spark):
    rows = texts_and_ids()[:6]
    clash = documents(spark, rows, True).select("*", *(F.lit(-1).alias(c) for c in ("form", "output", "restored", "_draws_")))
    same = lambda frame: sorted((tuple(r) for r in fill_middle.fill_in_middle(frame).collect()), key=repr)
    assert same(clash) == same(documents(spark, rows, False))
    assert fill_middle.fill_in_middle(clash.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_middle.check_marks(("<P>", "<P>", "<M>"))
    with pytest.raises(ValueError):
        fill_middle.check_marks(("aba", "<S>", "<M>"))
