"""Vectorised word hashing over blocks of whole texts, used inside Arrow tasks.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text. All hashes are Rabin-Karp polynomials
modulo 2**64 taken by prefix sums, then mixed, so the cost is a few numpy passes a byte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xD6E8FEB86659FD93 | 1
CHECK_BASE = 0xA0761D6478BD642F  # of a second, independent window hash
SEGMENT = 1 << 20  # bytes hashed at a time
BLOCK_BYTES = 3 << 20  # text bytes of a block; one longer text is a block of its own

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all bits of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@lru_cache(maxsize=8)
def _powers_at(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(x: int) -> np.ndarray:
        steps = np.full(size, x, dtype=np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    return powers(base), powers(pow(base, -1, 1 << 64))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    up, down = _powers_at(base, 1 << max(10, int(n).bit_length()))
    return up[:n], down[:n]


@dataclass
class Words:
    """Words of some texts: per word its hash and byte range in buffer, and where each text's words begin."""

    buffer: bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray  # len(texts) + 1
    text_at: np.ndarray  # byte at which each text begins

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range of data; the ranges are disjoint and in order."""
    hashes = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT)))
        low, high = int(starts[at]), int(ends[to - 1])
        up, down = powers(BASE, high - low + 1)
        total = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_byte_values()[data[low:high]] * up[:-1], out=total[1:])
        hashes[at:to] = (total[ends[at:to] - low] - total[starts[at:to] - low]) * down[starts[at:to] - low]
        at = to
    return mix(hashes)


def hash_words(texts: list[bytes]) -> Words:
    """Split texts into words and hash them; null texts must come as b''."""
    buffer = b"\n".join(texts) + b"\n"
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    text_at = np.concatenate([[0], np.cumsum(lengths + 1)])
    data = np.frombuffer(buffer, dtype=np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    if len(starts) > len(ends):
        ends = np.concatenate([ends, [len(data)]])
    offsets = np.searchsorted(starts, text_at)
    return Words(buffer, hash_ranges(data, starts, ends), starts, ends, offsets, text_at[:-1])


def window_hashes(hashes: np.ndarray, size: int, base: int = WORD_BASE) -> np.ndarray:
    """Rolling hash of every run of size word hashes, whatever text they are in; base is odd."""
    n = len(hashes)
    if n < size:
        return np.empty(0, dtype=np.uint64)
    up, down = powers(base, n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: n - size + 1])


def inside(words: Words, size: int) -> np.ndarray:
    """Indices of the words that start a window of size words within one text."""
    room = words.counts - size + 1
    keep = room > 0
    begin, room = words.offsets[:-1][keep], room[keep]
    if not len(room):
        return np.empty(0, dtype=np.int64)
    shift = np.repeat(begin - np.concatenate([[0], np.cumsum(room)[:-1]]), room)
    return np.arange(int(room.sum())) + shift


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for each start and length, one after another."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(np.asarray(starts, dtype=np.int64) - begin, lengths)


def text_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches that hold about size bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
        lengths = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(lengths, lengths[at] + size, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
