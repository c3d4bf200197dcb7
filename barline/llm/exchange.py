"""Corpus-wide counts of hashed elements (windows, shingles), brought back to where each occurs.

Three Spark steps, all dealt by hash:

1. Tasks cut texts into blocks, hash each block's elements, keep one entry per distinct element of a block
   with its count (so an element that a third of all rows share costs one entry a block), and send
   entries to buckets by the leading hash bits, packed as byte arrays.
2. Each bucket sums the counts of equal hashes and answers every block that asked about an element that
   occurs more than once.
3. Each block's answers meet its own small table of documents and become rows.

The number of buckets follows the bytes of all texts, so a bucket's share stays a few MB. Blocks deal to at most 2**COARSE_BITS
buckets, else their rows would hold an entry or two each. Beyond that (256 GB of text) a relay step gathers the entries of
a coarse bucket from many blocks, some MB at a time, adds up equal ones, and deals them to its finer buckets; answers go back the
same way. So an element that every block has costs its bucket at most an entry for each of 85,000 blocks without relays, and
one for each relay (some 32 MB of entries) with them.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, text_bytes

BUCKET_BYTES = 4 << 20  # text bytes whose elements share a bucket
COARSE_BITS = 16  # of the buckets that a block deals to
RELAY_BYTES = 32 << 20  # entries that a relay gathers at a time
_RELAY = 1 << 62  # marks a relay's number among those of blocks
_ROW = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("state", pa.bool_()), ("payload", pa.binary())])


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of unsigned values, byte position by byte position."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: bytes, width: int) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def bucket_bits(total_bytes: int) -> int:
    """Leading hash bits that name an element's bucket."""
    return min(COARSE_BITS + 16, max(min(8, COARSE_BITS), (max(1, total_bytes) // BUCKET_BYTES).bit_length()))


def _unique(values: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place of each distinct value, each value's number among them, and counts. Equal values whose checks differ are distinct."""
    _, first, inverse, counts = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
    if check is not None and not np.array_equal(check[first][inverse], check):
        pairs = np.stack([values, check.astype(np.uint64)], axis=1)
        _, first, inverse, counts = np.unique(pairs, axis=0, return_index=True, return_inverse=True, return_counts=True)
    return first, inverse.reshape(-1), counts


def _pack(at: np.ndarray, low: np.ndarray, check: np.ndarray | None, counts: np.ndarray, keep: int) -> bytes:
    """Entries of one bucket: ascending places, keep bytes of each hash, four of its check if there is one, counts."""
    rest = zlib.compress(_planes(np.diff(at, prepend=0), 4) + _planes(counts, 4), 1)
    return len(at).to_bytes(4, "little") + _planes(low, keep) + (b"" if check is None else _planes(check, 4)) + rest


def _unpack(data: bytes, keep: int, checked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    a, b = 4 + n * keep, 4 + n * (keep + 4 * checked)
    rest = zlib.decompress(data[b:])
    places = np.cumsum(_unplanes(rest[: 4 * n], 4)).astype(np.int64)
    return places, _unplanes(data[4:a], keep), _unplanes(data[a:b], 4) if checked else None, _unplanes(rest[4 * n :], 4)


def _pack_reply(places: np.ndarray, totals: np.ndarray) -> bytes:
    return zlib.compress(_planes(np.diff(places, prepend=0), 4) + _planes(np.minimum(totals, 2**32 - 1), 4), 1)


def _unpack_reply(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    reply = zlib.decompress(data)
    half = len(reply) // 2
    return np.cumsum(_unplanes(reply[:half], 4)).astype(np.int64), _unplanes(reply[half:], 4)


def merged(low: np.ndarray, check: np.ndarray | None, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Entries with equal hashes and checks as one that has their summed count; also each given entry's number among these."""
    first, inverse, _ = _unique(low, check)
    total = np.zeros(len(first), dtype=np.uint64)
    np.add.at(total, inverse, counts.astype(np.uint64))
    return low[first], None if check is None else check[first], np.minimum(total, 2**32 - 1), inverse


def _deal(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places that are in it, ascending."""
    order = np.argsort(buckets, kind="stable")
    used, begin = np.unique(buckets[order], return_index=True)
    for bucket, a, b in zip(used.tolist(), begin, [*begin[1:], len(order)], strict=True):
        yield bucket, order[a:b]


def _rows(bucket: list, chunk: list, state: list, payload: list) -> pa.Table:
    return pa.table([pa.array(bucket, pa.int64()), pa.array(chunk, pa.int64()), pa.array(state, pa.bool_()), pa.array(payload, pa.binary())], schema=_ROW)


def corpus_counts(
    df: DataFrame,
    keys: list[str],
    elements: Callable[[list[bytes]], tuple[np.ndarray, ...]],
    emit: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch],
    schema: str,
    hash_bytes: int,
    weight: str | None = None,
    checked: bool = False,
) -> DataFrame:
    """For every element of every text, the number of its occurrences in all texts.

    df has the columns keys and text. elements(texts) returns all element hashes, text after text, and how many
    each text has; with checked also a 32-bit check of each, and elements are equal only if both are. emit(keys of a block, those
    numbers, totals aligned with the elements) makes the result's rows. A hash counts with its bucket's bits and hash_bytes more
    bytes. With weight, a column of df, only the occurrences in rows where it holds are counted; all rows are answered.
    """
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bucket_bits(int(total))
    coarse = min(bits, COARSE_BITS)
    fine = bits - coarse
    keep = min(hash_bytes + (fine + 7) // 8, (64 - coarse + 7) // 8)

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for block in blocks(batches):
            values, per, *more = elements(text_bytes(block.column(block.schema.get_field_index("text"))))
            if not len(values):
                continue
            chunk = (part << 32) | n
            n += 1
            first, inverse, counts = _unique(values, more[0] if checked else None)
            by_place = np.argsort(first)
            rank = np.empty(len(first), dtype=np.int64)
            rank[by_place] = np.arange(len(first))
            if weight:
                own = np.array(block.column(block.schema.get_field_index(weight)).to_pylist(), dtype=np.float64)
                counts = np.bincount(inverse, np.repeat(own, per), len(first)).astype(np.int64)
            counts, one = counts[by_place], first[by_place]
            distinct = values[one]
            check = more[0][one] if checked else None
            is_first = np.zeros(len(values), dtype=bool)
            is_first[first] = True
            state = {
                "keys": block.select(keys).to_pydict(),
                "schema": block.select(keys).schema,
                "per": per,
                "first": np.packbits(is_first),
                "n": len(values),
                "later": rank[inverse[~is_first]].astype(np.uint32),
            }
            low = (distinct << np.uint64(coarse)) >> np.uint64(64 - 8 * keep if 8 * keep <= 64 - coarse else coarse)
            dealt = [(k, _pack(at, low[at], None if check is None else check[at], counts[at], keep)) for k, at in _deal((distinct >> np.uint64(64 - coarse)).astype(np.uint32))]
            used, payloads = zip(*dealt, strict=True)
            states = zlib.compress(pickle.dumps(state), 1)
            rows = _rows([-1 - (part * 31 + n) % 65536, *used], [chunk] * (len(used) + 1), [True] + [False] * len(used), [states, *payloads])
            yield from rows.to_batches()

    def relay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of a coarse bucket, from many blocks, to its finer buckets; rows come sorted by bucket."""
        part, n, bucket, held, size = TaskContext.get().partitionId(), 0, None, [], 0

        def pass_on() -> Iterator[pa.RecordBatch]:
            nonlocal n, held, size
            places, low, checks, counts = zip(*(_unpack(p, keep, checked) for _, p in held), strict=True)
            number = _RELAY | (part << 32) | n
            n += 1
            # what many blocks have goes on once, so a finer bucket gets it once a relay
            low, check, counts, inverse = merged(np.concatenate(low), np.concatenate(checks) if checked else None, np.concatenate(counts))
            state = {"chunks": [c for c, _ in held], "places": [x.astype(np.uint32) for x in places], "entries": np.split(inverse.astype(np.uint32), np.cumsum([len(x) for x in places])[:-1]), "n": len(low)}
            width = min(8 * keep, 64 - coarse)  # bits that low has
            used, payloads = zip(*((k, _pack(at, low[at], None if check is None else check[at], counts[at], keep)) for k, at in _deal(low >> np.uint64(width - fine))), strict=True)
            rows = _rows(
                [-1 - (part * 31 + n) % 65536, *((bucket << fine) | k for k in used)], [number] * (len(used) + 1), [True] + [False] * len(used),
                [zlib.compress(pickle.dumps(state), 1), *payloads],
            )
            held, size = [], 0
            yield from rows.to_batches()

        for batch in batches:
            for k, chunk, is_state, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if is_state:
                    yield from _rows([k], [chunk], [True], [payload]).to_batches()
                    continue
                if held and (k != bucket or size > RELAY_BYTES):
                    yield from pass_on()
                bucket = k
                held.append((chunk, payload))
                size += len(payload)
        if held:
            yield from pass_on()

    def answer(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return table
        chunks = table.column("chunk").to_pylist()
        places, hashes, checks, counts = zip(*(_unpack(p, keep, checked) for p in table.column("payload").to_pylist()), strict=True)
        _, inverse, _ = _unique(np.concatenate(hashes), np.concatenate(checks) if checked else None)
        totals = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.uint64)[inverse]
        out, at = [], 0
        for chunk, place in zip(chunks, places, strict=True):
            mine = totals[at : at + len(place)]
            at += len(place)
            many = np.flatnonzero(mine > 1)
            if len(many):
                out.append((chunk, _pack_reply(place[many], mine[many])))
        return _rows([bucket] * len(out), [c for c, _ in out], [False] * len(out), [p for _, p in out])

    def relay_back(table: pa.Table) -> pa.Table:
        """A relay's answers to the blocks that asked; what is a block's own stays."""
        if table.column("chunk")[0].as_py() < _RELAY:
            return table
        flags, payloads = table.column("state").to_pylist(), table.column("payload").to_pylist()
        state = pickle.loads(zlib.decompress(payloads[flags.index(True)]))
        totals = np.zeros(state["n"], dtype=np.uint64)
        for flag, payload in zip(flags, payloads, strict=True):
            if not flag:
                at, mine = _unpack_reply(payload)
                totals[at] = mine
        out = []
        for chunk, place, entry in zip(state["chunks"], state["places"], state["entries"], strict=True):
            mine = totals[entry]
            many = np.flatnonzero(mine)
            if len(many):
                out.append((chunk, _pack_reply(place[many].astype(np.int64), mine[many])))
        return _rows([0] * len(out), [c for c, _ in out], [False] * len(out), [p for _, p in out])

    def resolve(table: pa.Table) -> pa.Table:
        flags, payloads = table.column("state").to_pylist(), table.column("payload").to_pylist()
        state = pickle.loads(zlib.decompress(payloads[flags.index(True)]))
        is_first = np.unpackbits(state["first"], count=state["n"]).astype(bool)
        totals = np.ones(int(is_first.sum()), dtype=np.int64)
        for flag, payload in zip(flags, payloads, strict=True):
            if not flag:
                at, mine = _unpack_reply(payload)
                totals[at] = mine
        entry = np.empty(state["n"], dtype=np.int64)
        entry[is_first] = np.arange(len(totals))
        entry[~is_first] = state["later"]
        rows = emit(pa.RecordBatch.from_pydict(state["keys"], schema=state["schema"]), state["per"], totals[entry])
        return pa.Table.from_batches([rows])

    row = "bucket long, chunk long, state boolean, payload binary"
    asked = df.select(*keys, *([weight] if weight else []), "text").mapInArrow(ask, row)
    if fine:
        asked = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(relay, row)
    answered = asked.groupBy("bucket").applyInArrow(answer, row)
    if fine:
        answered = answered.groupBy("chunk").applyInArrow(relay_back, row)
    return answered.groupBy("chunk").applyInArrow(resolve, schema)
