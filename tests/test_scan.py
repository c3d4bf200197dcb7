"""The keyword automaton against a regex for each keyword."""

from __future__ import annotations

import random
import re

import ahocorasick
import pytest

from barline.operators import text


def test_automaton_matches_one_regex_a_keyword():
    rng = random.Random(2)
    automaton, values = ahocorasick.Automaton(), {}
    for commodity, words in text.KEYWORDS.items():
        for place, word in enumerate(words):
            values.setdefault(word, []).append((commodity, place, len(word)))
    for word, found in values.items():
        automaton.add_word(word, found)
    automaton.make_automaton()
    parts = ["Gold", "gold", "s", " ", "-", "\n", "PGM", "pgms", "Platinum Group", "oil and gas", "İ", "crude oil", "K", "iron  ore", "iron ore", "silver", "x" * 60, "é"]
    for _ in range(2000):
        source = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        want = {}
        for commodity, words in text.KEYWORDS.items():
            hits = [[m for m in re.finditer(rf"(?<![A-Za-z]){re.escape(w)}(?![A-Za-z])", source, re.I | re.A)] for w in words]
            if any(hits):
                m = next(h[0] for h in hits if h)
                a, b = max(0, m.start() - 70), min(len(source), m.end() + 70)
                want[commodity] = (sum(map(len, hits)), ("…" if a else "") + source[a:b].replace("\n", " ") + ("…" if b < len(source) else ""))
        assert {c: (n, s) for c, n, s in text.keyword_hits(source, automaton)} == want


def test_too_many_keywords_are_refused(spark, monkeypatch):
    monkeypatch.setattr(text, "MOST_KEYWORDS", 3)
    flags = spark.createDataFrame([("A", "commodity", "gold", None, 9)], "ticker string, group_type string, group_key string, attr string, priority int")
    texts = spark.createDataFrame([("A", "Name", "large", "copper")], "ticker string, name string, cap_band string, text string")
    with pytest.raises(ValueError, match="keywords"):
        text.summary_scan(texts, flags, flags.select("ticker", "group_key").limit(0), text.keyword_table(spark))
