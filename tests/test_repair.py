"""Splits and chunks against plain loops over random series and texts, and repairs that repeat without effect."""

from __future__ import annotations

import datetime
import random
import statistics
from math import log

import numpy as np

from barline.operators import repair, text

DAY = datetime.date(2020, 1, 1)


def plain_splits(series):
    """What the split rule says of one ticker's rows (close, split), stated bar by bar."""
    priced, out = [(i, c) for i, (c, _) in enumerate(series) if c and c > 0], []
    closes, days = [c for _, c in priced], [i for i, _ in priced]
    for d, (_, split) in enumerate(series):
        if not split or split == 1 or abs(log(split)) < log(1.5) or len(closes) < 6:
            continue
        want, near = -log(split), len([x for x in days if x < d])
        tried = [i for i in range(len(closes)) if 1 <= i and abs(i - near) <= 7]
        if len(tried) < 2:
            continue
        miss, k = min((abs(log(closes[i] / closes[i - 1]) - want), i) for i in tried)
        old, new = statistics.median(closes[max(0, k - 10) : k]), statistics.median(closes[k : k + 10])
        if miss <= log(1.1) and abs(log(new / old) - want) <= log(1.5):
            beside = [i for i in range(len(closes)) if abs(i - k) <= 7]
            olds = [i for i in beside if abs(log(closes[i] / old)) < abs(log(closes[i] / new))]
            settled = min(max(olds) + 1 if olds else beside[0], beside[-1])
            out.append((d, days[settled], days[beside[0]], [days[i] for i in olds], []))
        else:
            level = statistics.median([closes[i] for i in tried])
            strays = [(days[i], 1 / split if abs(log(closes[i] / level) + want) < log(1.1) else split) for i in tried if min(abs(log(closes[i] / level) + want), abs(log(closes[i] / level) - want)) < log(1.1)]
            if 1 <= len(strays) <= 2:
                out.append((d, strays[0][0], None, [], strays))
    return out


def test_splits_match_a_plain_loop(spark):
    rng = random.Random(3)
    every, rows = {}, []
    for t in range(60):
        n, split = rng.choice([4, 7, 40, 60]), rng.choice([2.0, 0.5, 1.2, 10.0, 0.1])
        at, level, series = rng.randrange(n), 50.0, []
        for i in range(n):
            level *= 1 + rng.uniform(-0.02, 0.02)
            scale = split if (i < at) == (t % 3 > 0) and t % 3 or rng.random() < 0.02 else 1.0
            series.append((None if rng.random() < 0.03 else level * scale, split if i in (at, at + 2) and (i == at or t % 5 == 0) else 0.0))
        every[f"T{t}"] = series
        rows += [(f"T{t}", DAY + datetime.timedelta(i), c, s) for i, (c, s) in enumerate(series)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double, split double")
    number = lambda x: None if x is None else (x - DAY).days
    got = {}
    for r in repair.unadjusted_splits(bars).collect():
        strays = [(number(d), round(m, 9)) for d, m in zip(r["stray_dates"], r["stray_mults"], strict=True)]
        got.setdefault(r["ticker"], []).append((number(r["split_date"]), number(r["jump_date"]), number(r["cut_date"]), [number(d) for d in r["old_dates"]], strays))
    want = {t: [(*x[:4], [(d, round(m, 9)) for d, m in x[4]]) for x in found] for t, series in every.items() if (found := plain_splits(series))}
    assert {t: sorted(x, key=repr) for t, x in got.items()} == {t: sorted(x, key=repr) for t, x in want.items()} and len(want) > 15


def plain_islands(closes):
    """What the island rule says of one series: first and last bar of each block, stated jump by jump."""
    moves, found, free = [log(b / a) for a, b in zip(closes[:-1], closes[1:], strict=True)], [], 0
    for i, move in enumerate(moves):
        backs = [j for j in range(i + 1, min(len(moves), i + 1 + repair.ISLAND_BARS)) if abs(moves[j] + move) < log(1.05)]
        if i < free or abs(move) < log(1.8) or not backs:
            continue
        j = backs[0]
        usual = [abs(m) for k, m in enumerate(moves) if m and (i - 30 <= k < i or j < k <= j + 30)]
        ratio = any(abs(abs(move) - log(r)) < log(1.05) for r in repair.CLEAN_RATIOS)
        if ratio and len(usual) >= 5 and abs(move) >= 8 * statistics.median(usual) and min(closes[max(0, i - 1) : j + 2]) >= 0.1 and not any(abs(m) >= log(1.8) for m in moves[i + 1 : j]):
            found.append((i + 1, j))
            free = j + 1
    return found


def test_islands_match_a_plain_loop(spark):
    """Blocks side by side, one inside the other's reach, at the ends, near the least price, and on noisy series."""
    rng = random.Random(8)
    every, rows = {}, []
    for t in range(80):
        level, series = rng.choice([50.0, 50.0, 0.11, 5000.0]), []
        noise, lift = rng.choice([0.002, 0.01, 0.2]), 1.0
        for _ in range(rng.choice([3, 60, 200])):
            level *= 1 + rng.uniform(-noise, noise)
            if rng.random() < 0.08:
                lift = 1.0 if lift != 1.0 else rng.choice([2.0, 0.5, 10.0, 2.5, 1.7, 0.1])
            series.append(level * lift)
        every[f"T{t}"] = series
        rows += [(f"T{t}", DAY + datetime.timedelta(i), c) for i, c in enumerate(series)]
    got = {}
    for r in repair.price_islands(spark.createDataFrame(rows, "ticker string, date date, close double")).collect():
        a, z = (r["start"] - DAY).days, (r["end"] - DAY).days
        assert r["n"] == z - a + 1 and abs(r["mult"] - every[r["ticker"]][a - 1] / every[r["ticker"]][a]) < 1e-9
        got.setdefault(r["ticker"], []).append((a, z))
    want = {t: found for t, series in every.items() if (found := plain_islands(series))}
    assert {t: sorted(x) for t, x in got.items()} == want and sum(map(len, want.values())) > 60
    # overlapping candidates: each opens where the one before closes, so every second one stands
    chain = spark.createDataFrame([("A", k, k + 2, 0.7) for k in range(0, 20, 2)] + [("A", 40, 45, 0.7), ("B", 1, 3, 0.7)], "ticker string, opens int, closes int, move double")
    assert sorted((r["ticker"], r["opens"]) for r in repair._apart(chain).collect()) == [("A", 0), ("A", 4), ("A", 8), ("A", 12), ("A", 16), ("A", 40), ("B", 1)]


def test_chunks_obey_the_rule():
    rng = random.Random(4)
    for _ in range(300):
        parts = [" ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(8))]
        size, overlap = rng.choice([40, 80, 200]), rng.choice([0, 10, 30])
        source = "\n\n".join(parts) if rng.random() < 0.8 else "\n\n" + "\n\n \n\n".join(parts)
        chunks, at = text.pack_paragraphs(source, size, overlap), 0
        for k, chunk in enumerate(chunks):
            lead = ""
            if k:  # the longest run of whole last words of the chunk before, one space each, within the overlap
                words = chunks[k - 1].split()
                lead = max((" ".join(words[j:]) for j in range(len(words) + 1) if sum(len(w) + 1 for w in words[j:]) <= overlap), key=len)
            taken = 1
            while at + taken < len(parts) and len(lead) + 2 * bool(k) + sum(map(len, parts[at : at + taken + 1])) + 2 * taken <= size:
                taken += 1
            assert chunk == "\n\n".join(([lead] if k else []) + parts[at : at + taken]).strip()
            at += taken
        assert at == len(parts)
    assert text.pack_paragraphs("") == text.pack_paragraphs(" \n\n ") == []


def test_repairs_have_no_second_effect(spark):
    rng = np.random.default_rng(5)
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.005, 200)))
    split = np.zeros(200)
    split[120] = 4.0
    close[:120] *= 4
    close[122] *= 4
    rows = [("T", DAY + datetime.timedelta(i), *[float(c)] * 5, 10.0, 0.0, float(s)) for i, (c, s) in enumerate(zip(close, split, strict=True))]
    bars = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, adj_close double, volume double, dividend double, split double")
    fixed = repair.repair_splits(bars, repair.dedupe_splits(repair.unadjusted_splits(bars)))
    values = [r["close"] for r in fixed.orderBy("date").collect()]
    assert max(abs(log(b / a)) for a, b in zip(values[:-1], values[1:], strict=True)) < 0.05
    assert repair.unadjusted_splits(fixed).count() == 0
