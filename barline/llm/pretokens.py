"""Vectorised pre-tokens of byte-level BPE, ranks of a tokenizer file, and exact merging of many words at once.

The pattern is the public byte-level one: contractions, then runs of letters, digits or other signs with one
leading space, then white space that leaves its last sign to what follows.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex

from .blocks import ragged

OTHER, LETTER, DIGIT, SPACE = range(4)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LONG_WORD = 512  # bytes beyond which a word is merged by itself with a heap
NO_RANK = np.iinfo(np.int64).max


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of each code point."""
    out = np.zeros(0x110000, dtype=np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    index = np.array(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            out[index[m.start() : m.end()]] = kind
    return out


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All UTF-8 bytes, the byte range of each pre-token, and for each text the index of its first pre-token (one more at the end)."""
    joined = "".join(texts)
    raw = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    n = len(raw)
    first = np.cumsum(lengths) - lengths
    data = np.frombuffer(joined.encode(), dtype=np.uint8)
    if not n:
        return data, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    begins = np.zeros(n + 1, dtype=bool)  # begins of texts
    begins[first] = True
    begins[n] = True
    kind = char_classes()[raw]
    space = kind == SPACE
    token = np.zeros(n + 1, dtype=bool)
    token[1:n] = kind[1:] != kind[:-1]
    after = np.flatnonzero(~space[1:] & space[:-1] & ~begins[1:n]) + 1  # signs after white space in the same text
    token[after] = raw[after - 1] != 0x20
    token[after - 1] = True
    token |= begins
    quote = np.flatnonzero((raw == 0x27) & token[:n])
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~begins[quote + 1]]
    if len(quote):
        one = raw[quote + 1]
        two = np.where((quote + 2 < n) & ~begins[np.minimum(quote + 2, n)], raw[np.minimum(quote + 2, n - 1)], 0)
        size = np.zeros(len(quote), dtype=np.int64)
        for c in CONTRACTIONS:
            hit = (one == ord(c[0])) & ((len(c) == 1) | (two == ord(c[-1])))
            size[hit & (size == 0)] = len(c)
        quote, size = quote[size > 0], size[size > 0]
        token[quote + 1] = False
        rest = quote + 1 + size
        token[rest[(kind[np.minimum(rest, n - 1)] == LETTER) | begins[rest]]] = True
    at = np.flatnonzero(token)
    wide = 1 + (raw >= 0x80).astype(np.int8) + (raw >= 0x800) + (raw >= 0x10000)
    byte_at = np.concatenate([[0], np.cumsum(wide, dtype=np.int64)])[at]
    return data, byte_at[:-1], byte_at[1:], np.searchsorted(at, np.concatenate([first, [n]]))


def byte_alphabet() -> list[str]:
    """The printable sign that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


@dataclass
class Ranks:
    """Merges of a byte-level BPE: sorted pair keys, each one's rank and result; ids of single bytes; bytes of each id; special strings."""

    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    byte_ids: np.ndarray
    token_bytes: list[bytes]
    special: dict[str, int]


@lru_cache(maxsize=2)
def load_ranks(path: str) -> Ranks:
    """Read a byte-level BPE tokenizer file. Words whole in the vocabulary get no short cut, as in the file's model."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, signs = spec["model"]["vocab"], byte_alphabet()
    to_byte = {c: b for b, c in enumerate(signs)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], dtype=np.int64)
    order = np.argsort(keys)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    size = max([*vocab.values(), *special.values()]) + 1
    token_bytes = [b""] * size
    for word, i in vocab.items():
        token_bytes[i] = bytes(to_byte[c] for c in word)
    for word, i in special.items():
        token_bytes[i] = word.encode()
    return Ranks(
        keys[order], np.arange(len(keys))[order], np.array([vocab[a + b] for a, b in merges], dtype=np.int64)[order],
        np.array([vocab[c] for c in signs], dtype=np.int64), token_bytes, special,
    )


def _rank(ranks: Ranks, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = (left << 32) | right
    at = np.minimum(np.searchsorted(ranks.pairs, keys), len(ranks.pairs) - 1)
    hit = ranks.pairs[at] == keys
    return np.where(hit, ranks.ranks[at], NO_RANK), ranks.merged[at]


def _merge_long(ids: list[int], ranks: Ranks) -> list[int]:
    """One long word, by a heap of (rank, place) over a linked list."""
    after, before, heap = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)], []

    def offer(places: list[int]) -> None:
        places = [i for i in places if i >= 0 and after[i] >= 0]
        if places:
            rank, merged = _rank(ranks, np.array([ids[i] for i in places]), np.array([ids[after[i]] for i in places]))
            for i, r, m in zip(places, rank.tolist(), merged.tolist(), strict=True):
                if r != NO_RANK:
                    heapq.heappush(heap, (r, i, ids[i], ids[after[i]], m))

    offer(list(range(len(ids))))
    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j < 0 or ids[j] != b:
            continue
        ids[i], ids[j], after[i] = m, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer([before[i], i])
    return [x for x in ids if x >= 0]


def merge(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word given as a byte range: all ids one after another, and the number of each word's.

    In each round every word merges all places of its lowest-ranked pair, left to right; done words leave.
    """
    lengths = ends - starts
    long = np.flatnonzero(lengths > LONG_WORD)
    done: list[tuple[np.ndarray, np.ndarray]] = []  # word of each id, id
    for w in long:
        ids = _merge_long(ranks.byte_ids[data[starts[w] : ends[w]]].tolist(), ranks)
        done.append((np.full(len(ids), w), np.array(ids, dtype=np.int64)))
    short = np.flatnonzero(lengths <= LONG_WORD)
    word = np.repeat(short, lengths[short])
    ids = ranks.byte_ids[data[ragged(starts[short], lengths[short])]]
    rank, merged = np.full(len(ids), NO_RANK), np.zeros(len(ids), dtype=np.int64)
    check = np.flatnonzero(word[1:] == word[:-1])
    while True:
        if len(check):
            rank[check], merged[check] = _rank(ranks, ids[check], ids[check + 1])
        if not len(ids):
            break
        head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sizes = np.diff(np.concatenate([head, [len(ids)]]))
        best = np.repeat(np.minimum.reduceat(rank, head), sizes)
        over = best == NO_RANK
        if over.any():
            done.append((word[over], ids[over]))
            left = ~over
            word, ids, rank, merged, best = word[left], ids[left], rank[left], merged[left], best[left]
            if not len(ids):
                break
        hit = np.flatnonzero(rank == best)
        run = np.concatenate([[True], np.diff(hit) != 1])  # of overlapping places every second one merges
        place = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
        hit = hit[place % 2 == 0]
        ids[hit] = merged[hit]
        rank[hit] = NO_RANK
        keep = np.ones(len(ids), dtype=bool)
        keep[hit + 1] = False
        moved = hit - np.arange(len(hit))
        word, ids, rank, merged = word[keep], ids[keep], rank[keep], merged[keep]
        check = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
        rank[check] = NO_RANK
        check = check[check + 1 < len(ids)]
        check = check[word[check] == word[check + 1]]
    words = np.concatenate([w for w, _ in done]) if done else np.empty(0, np.int64)
    flat = np.concatenate([x for _, x in done]) if done else np.empty(0, np.int64)
    order = np.argsort(words, kind="stable")
    return flat[order], np.bincount(words, minlength=len(starts)) if len(words) else np.zeros(len(starts), np.int64)
