"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Words that the corpus has most often are compiled, with their ids as outputs, into one automaton that shares
prefixes and suffixes; tasks memory-map its file and walk all distinct words of a block at once. Words that it lacks
are merged exactly, by the ranks of the tokenizer file.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import blocks, hash_ranges, ragged
from .pretokens import Ranks, load_ranks, merge, split
from .store import materialize, save_bytes, shared_dir

LEXICON_WORDS = 1 << 16
PARTIAL_WORDS = 1 << 19  # distinct words that a task counts before it passes them on


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Lexicon:
    """A transducer in flat arrays: sorted keys state * 256 + byte, their next states and outputs, final states, ids.

    The outputs on a word's path add up to the word's place in sorted order, which gives its ids.
    """

    def __init__(self, keys: np.ndarray, nexts: np.ndarray, outputs: np.ndarray, final: np.ndarray, at: np.ndarray, ids: np.ndarray):
        self.parts = (keys, nexts, outputs, final, at, ids)
        self.keys, self.nexts, self.outputs, self.final, self.at, self.ids = self.parts

    @classmethod
    def build(cls, words: list[bytes], ranks: Ranks) -> Lexicon:
        """Compile words; equal suffixes share states from the moment that no later word can change them."""
        words = sorted(set(words) - {b""})
        edges: list[dict[int, int]] = [{}]
        final: list[bool] = [False]
        register: dict[tuple, int] = {}
        path: list[int] = [0]  # states of the last word
        last = b""

        def settle(depth: int) -> None:
            for i in range(len(path) - 1, depth, -1):
                state = path[i]
                key = (final[state], tuple(edges[state].items()))
                edges[path[i - 1]][last[i - 1]] = register.setdefault(key, state)
                path.pop()

        for word in words:
            same = len(os.path.commonprefix([word, last]))
            settle(same)
            for b in word[same:]:
                edges.append({})
                final.append(False)
                edges[path[-1]][b] = len(edges) - 1
                path.append(len(edges) - 1)
            final[path[-1]] = True
            last = word
        settle(0)
        # number the states that are left, children first, and count the words behind each
        number, behind, rows, stack = {}, {}, [], [(0, False)]
        while stack:
            state, ready = stack.pop()
            if state in behind:
                continue
            if not ready:
                stack.append((state, True))
                stack += [(s, False) for s in edges[state].values() if s not in behind]
                continue
            count = int(final[state])
            number[state] = len(number)
            for b, s in sorted(edges[state].items()):
                rows.append((number[state] * 256 + b, number[s], count))
                count += behind[s]
            behind[state] = count
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
        ends = np.zeros(len(number) + 1, dtype=np.int64)
        for state, i in number.items():
            ends[i] = final[state]
        ends[-1] = number[0]
        flat, counts = merge_words(words, ranks)
        return cls(table[:, 0], table[:, 1], table[:, 2], ends, np.concatenate([[0], np.cumsum(counts)]), flat)

    def save(self, file) -> None:
        np.save(file, np.concatenate([np.array([len(p) for p in self.parts]), *self.parts]).astype(np.int64))

    @classmethod
    def load(cls, path: str) -> Lexicon:
        """Map the file; all tasks of a machine share its pages."""
        data = np.load(path, mmap_mode="r")
        bounds = np.cumsum([6, *data[:6]])
        return cls(*(data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of each word (a byte range) in the lexicon, -1 if it isn't there."""
        out = np.full(len(starts), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        alive = np.flatnonzero(ends > starts)
        state, total = np.full(len(alive), self.final[-1]), np.zeros(len(alive), dtype=np.int64)
        depth = 0
        while len(alive):
            key = state * 256 + data[starts[alive] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[at] == key
            alive, at = alive[on], at[on]
            state, total = self.nexts[at], total[on] + self.outputs[at]
            depth += 1
            over = ends[alive] - starts[alive] == depth
            hit = over & (self.final[state] == 1)
            out[alive[hit]] = total[hit]
            alive, state, total = alive[~over], state[~over], total[~over]
        return out


def merge_words(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(np.array([len(w) for w in words], dtype=np.int64))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(words) else ends
    return merge(np.frombuffer(b"".join(words), dtype=np.uint8), starts, ends, ranks)


@lru_cache(maxsize=2)
def _mapped(path: str) -> Lexicon:
    return Lexicon.load(path)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of one occurrence of each distinct word, each word's distinct number, and counts.

    Words of equal hashes are compared byte by byte; should two differ, the words themselves are the keys.
    """
    _, first, inverse, counts = np.unique(hash_ranges(data, starts, ends), return_index=True, return_inverse=True, return_counts=True)
    size, own = ends - starts, first[inverse]
    again = np.flatnonzero(own != np.arange(len(starts)))
    same = np.array_equal(size[again], size[own[again]])
    if same and np.array_equal(data[ragged(starts[again], size[again])], data[ragged(starts[own[again]], size[again])]):
        return first, inverse, counts
    raw, place = data.tobytes(), {}
    inverse = np.array([place.setdefault(raw[a:b], len(place)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.int64)
    _, first, counts = np.unique(inverse, return_index=True, return_counts=True)
    return first, inverse, counts


def pieces(texts: list[str], special: dict[str, int]) -> tuple[list[str], list[int], np.ndarray]:
    """Texts cut at special strings. Per piece its text and special id (-1: ordinary); per text its first piece."""
    out, ids, first = [], [], [0]
    for text in texts:
        if any(s in text for s in special):
            while text:
                at, s = min(((text.find(s), s) for s in special if s in text), default=(len(text), ""))
                out += [text[:at]]
                ids += [-1]
                if s:
                    out.append("")
                    ids.append(special[s])
                text = text[at + len(s) :]
        else:
            out.append(text)
            ids.append(-1)
        first.append(len(out))
    return out, ids, np.array(first)


def encode_block(texts: list[str], ranks: Ranks, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some texts, and the number of each text's ids."""
    parts, special, first = pieces(texts, ranks.special)
    data, starts, ends, at = split(parts)
    one, inverse, _ = distinct(data, starts, ends)
    found = lexicon.find(data, starts[one], ends[one])
    lacking = np.flatnonzero(found < 0)
    flat, counts = merge(data, starts[one[lacking]], ends[one[lacking]], ranks)
    known = np.flatnonzero(found >= 0)
    size, begin = np.zeros(len(one), dtype=np.int64), np.zeros(len(one), dtype=np.int64)
    size[known] = lexicon.at[found[known] + 1] - lexicon.at[found[known]]
    begin[known] = lexicon.at[found[known]]
    size[lacking], begin[lacking] = counts, len(lexicon.ids) + np.cumsum(counts) - counts
    table = np.concatenate([lexicon.ids, flat])
    ids = table[ragged(begin[inverse], size[inverse])]
    total = np.concatenate([[0], np.cumsum(size[inverse])])[at]
    marked = np.flatnonzero(np.array(special) >= 0)
    if len(marked):
        ids = np.insert(ids, total[marked], np.array(special)[marked])
        total = total + np.concatenate([[0], np.cumsum(np.array(special) >= 0)])
    return ids, np.diff(total[first])


def count_words(docs: DataFrame, text_col: str, tokenizer: str) -> DataFrame:
    """Pre-tokens of all texts with their counts: word (binary), n."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(tokenizer)
        total: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for block in blocks(batches, text_col):
            parts, _, _ = pieces([t or "" for t in block.column(0).to_pylist()], ranks.special)
            data, starts, ends, _ = split(parts)
            one, _, counts = distinct(data, starts, ends)
            raw = data.tobytes()
            for a, b, n in zip(starts[one].tolist(), ends[one].tolist(), counts.tolist(), strict=True):
                word = raw[a:b]
                total[word] = total.get(word, 0) + n
            if len(total) > PARTIAL_WORDS:
                yield flush()
        yield flush()

    return docs.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of all texts and hand the file to all tasks; returns its name.

    Counts fall into steps of a sixteenth in their binary logarithm; the words of the highest steps that hold at most words of
    them together are taken, so the driver receives no more. A word seen once is never taken.
    """
    tokenizer = tokenizer or default_tokenizer()
    counted = count_words(docs, text_col, tokenizer).where((F.col("n") >= 2) & (F.octet_length("word") <= 64))
    counted = materialize(counted.select("word", F.floor(F.log2("n") * 16).alias("step")), "words")
    steps = sorted(counted.groupBy("step").count().collect(), reverse=True)
    room, least = words, None
    for step, n in steps:
        room -= n
        if room < 0:
            break
        least = step
    chosen = [] if least is None else counted.where(F.col("step") >= least).select("word").collect()
    lexicon = Lexicon.build([bytes(r[0]) for r in chosen], load_ranks(tokenizer))
    spark, name = docs.sparkSession, f"lexicon-{uuid.uuid4().hex}.npy"
    base = shared_dir(spark, "lexicon")
    out = io.BytesIO()
    lexicon.save(out)
    save_bytes(spark, f"{base}/{name}", out.getvalue())
    spark.sparkContext.addFile(f"{base}/{name}")
    return name


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, lexicon: str | None = None) -> DataFrame:
    """Ids of every whole text, and the text decoded from them: id_col, ids (array<int>), decoded.

    A null text counts as empty: no ids, decoded ''. Special strings in a text become their ids, as the tokenizers library does
    by default. Only id_col and text_col are read; repeated rows and null ids come back as they are, and an empty table gives
    no rows. A very long text is a block of its own and encoded whole.
    """
    tokenizer = tokenizer or default_tokenizer()
    lexicon = lexicon or build_lexicon(docs, text_col, tokenizer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, words = load_ranks(tokenizer), _mapped(SparkFiles.get(lexicon))
        for block in blocks(batches, text_col):
            ids, counts = encode_block([t or "" for t in block.column(1).to_pylist()], ranks, words)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            decoded = [decode(ids[a:b].tolist(), ranks) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([block.column(0), lists, pa.array(decoded, pa.string())], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def decode(ids: list[int], ranks: Ranks) -> str:
    """Text of ids; bytes that are no UTF-8 become the replacement sign."""
    return b"".join([ranks.token_bytes[i] for i in ids]).decode("utf-8", "replace")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens and the digests of ids and decoded text."""
    return encoded.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return digests(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
