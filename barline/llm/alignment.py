"""Cross-tokenizer alignment, Arrow-native.

Both tokenizers' lists of a block of texts are flattened with their parent indices, and segmented cumulative sums of token
bytes give each token's end in its text. A hash join on (document, end) finds where tokens of both end; these places cut the texts into
groups, and a second join, of the distinct ids of each group, links A ids with B ids. Table.group_by counts the documents that
hold a pair in a block; Spark merges these partial counts over the corpus and answers each block.

Texts are tokenized by chunks: neither tokenizer joins signs across the start of a space that follows another sign, so each
distinct chunk of a block is encoded once. A piece model for which that may not hold encodes whole texts. (A text that
holds the sign for spaces itself can be cut otherwise, but is never spelled byte for byte.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import blocks, ragged
from .bpe import default_tokenizer, distinct
from .pretokens import SPACE, char_classes, load_ranks, merge, split
from .store import materialize

MARK = "▁"  # a space in a piece
PROBE = "  a  b c "
EMPTY = np.empty(0, np.int64)
BLOCK_BYTES = 3 << 19  # text bytes of a block: its tables of tokens take some 60 times as much


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Coder:
    """A tokenizer: bytes and decimal string of each id, and encode(texts) that begin with a space -> all ids, number of each text's."""

    token_bytes: pa.Array
    decimals: pa.Array
    encode: object
    chunked: bool

    @property
    def size(self) -> int:
        return len(self.decimals)


def _coder(token_bytes: list[bytes], encode, chunked: bool) -> Coder:
    return Coder(pa.array(token_bytes, pa.large_binary()), pa.array(map(str, range(len(token_bytes))), pa.string()), encode, chunked)


@lru_cache(maxsize=2)
def byte_level(path: str) -> Coder:
    """A byte-level BPE file; strings of its special tokens are plain text."""
    ranks = load_ranks(path)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data, starts, ends, at = split(texts)
        one, inverse, _ = distinct(data, starts, ends)
        ids, counts = merge(data, starts[one], ends[one], ranks)
        begin, size = np.cumsum(counts) - counts, counts[inverse]
        return ids[ragged(begin[inverse], size)], np.diff(np.concatenate([[0], np.cumsum(size)])[at])

    return _coder(ranks.token_bytes, encode, True)


@lru_cache(maxsize=2)
def piece_level(path: str) -> Coder:
    """A piece model that puts a space before each text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    raw = [bytes([int(n[3:-1], 16)]) if model.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
    space = model.piece_to_id(MARK)
    kept = "".join(names[i] for i in model.encode(PROBE)) == (" " + PROBE).replace(" ", MARK)
    chunked = kept and not model.is_unknown(space) and not any(MARK in n.lstrip(MARK) for n in names)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = model.encode([t[1:] for t in texts], num_threads=1)
        lists = [x or [space] for x in lists] if chunked else lists  # the model gives nothing for an empty text, not even its space
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return np.fromiter((i for x in lists for i in x), dtype=np.int64, count=int(counts.sum())), counts

    return _coder(raw, encode, chunked)


def chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, each chunk's byte range, and the number of each text's chunks. A chunk begins with a text, or with
    a space that follows a sign other than white space."""
    joined = "".join(texts)
    raw, data = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32), np.frombuffer(joined.encode(), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes)
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[1 : len(raw)] = (raw[1:] == 0x20) & (char_classes()[raw[:-1]] != SPACE)
    cut[(ends - sizes)[sizes > 0]] = True
    cut[len(raw)] = True
    at = np.flatnonzero(cut)
    wide = 1 + (raw >= 0x80).astype(np.int8) + (raw >= 0x800) + (raw >= 0x10000)
    byte_at = np.concatenate([[0], np.cumsum(wide, dtype=np.int64)])[at]
    return data, byte_at[:-1], byte_at[1:], np.diff(np.searchsorted(at, np.concatenate([[0], ends])))


def encode_texts(texts: list[str], coders: list[Coder]) -> list[pa.LargeListArray]:
    """A list of ids for each text (all begin with a space) and coder."""
    out = []
    if any(c.chunked for c in coders):
        data, starts, ends, per = chunks(texts)
        one, inverse, _ = distinct(data, starts, ends) if len(starts) else (EMPTY,) * 3
        raw = data.tobytes()
        words = [raw[a:b].decode() for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        first = np.concatenate([[0], np.cumsum(per)])
    for coder in coders:
        if coder.chunked:
            ids, counts = coder.encode(words)
            begin, size = np.cumsum(counts) - counts, counts[inverse]
            ids = ids[ragged(begin[inverse], size)]
            offsets = np.concatenate([[0], np.cumsum(size)])[first]
        else:
            ids, counts = coder.encode(texts)
            offsets = np.concatenate([[0], np.cumsum(counts)])
        out.append(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(ids, pa.int32())))
    return out


def _numpy(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def token_ends(lists: pa.LargeListArray, coder: Coder, texts: list[bytes]) -> tuple[pa.Table, np.ndarray]:
    """Tokens as a table (doc, end, id), and which texts they spell. end counts bytes of the text."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    raw = coder.token_bytes.take(ids)
    total = np.concatenate([[0], _numpy(pc.cumulative_sum(pc.cast(pc.binary_length(raw), pa.int64())))])
    begin = total[_numpy(lists.offsets)]  # of each text's bytes
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    same = np.diff(begin) == sizes
    mine = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[: total[-1]]
    theirs = np.frombuffer(b"".join(t for t, s in zip(texts, same.tolist(), strict=True) if s), dtype=np.uint8)
    if not same.all():
        mine = mine[ragged(begin[:-1][same], sizes[same])]
    wrong = np.concatenate([[0], np.cumsum(mine != theirs)])[np.concatenate([[0], np.cumsum(sizes[same])])]
    same[same] = np.diff(wrong) == 0
    ends = total[1:] - begin[:-1][_numpy(doc)]
    return pa.table({"doc": doc.cast(pa.int32()), "end": pa.array(ends, pa.int32()), "id": ids}), same


def group_of(tokens: pa.Table, at: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each token, and the first token of each group (one more at the end); groups end with the tokens at the given places."""
    cut = np.zeros(tokens.num_rows, dtype=np.int64)
    cut[_numpy(at)] = 1
    return np.cumsum(cut) - cut, np.concatenate([[0], np.flatnonzero(cut) + 1])


def joined_ids(first: np.ndarray, ids: pa.ChunkedArray, coder: Coder) -> pa.Array:
    """The ids of each group in decimal, joined by commas."""
    words = coder.decimals.take(ids.combine_chunks())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), words), ",")


@dataclass
class Aligned:
    """A block's texts: numbers of tokens, groups and links, the groups' string ('' without tokens), and linked pairs with their link counts."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    offsets: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def align_block(texts: list[str], a: Coder, b: Coder) -> Aligned:
    """Align both tokenizations of space + text. Texts that are empty or whose tokens spell something else have no tokens."""
    spaced = [" " + t if t else "" for t in texts]
    raw, n = [t.encode() for t in spaced], len(texts)
    (ta, ok_a), (tb, ok_b) = (token_ends(x, c, raw) for x, c in zip(encode_texts(spaced, [a, b]), (a, b), strict=True))
    ok = ok_a & ok_b
    if not ok.all():
        ta, tb = (t.filter(pa.array(ok[_numpy(t["doc"])])) for t in (ta, tb))
    count = lambda t: np.bincount(_numpy(t["doc"]), minlength=n)
    n_a, n_b = count(ta), count(tb)
    place = lambda t, name: t.select(["doc", "end"]).append_column(name, pa.array(np.arange(t.num_rows)))
    cuts = place(ta, "a").join(place(tb, "b"), keys=["doc", "end"], join_type="inner", use_threads=False)
    (in_a, first_a), (in_b, first_b) = group_of(ta, cuts["a"]), group_of(tb, cuts["b"])
    doc = _numpy(ta["doc"])[first_a[1:] - 1]  # of each group
    n_groups = np.bincount(doc, minlength=n)
    strings = pc.binary_join_element_wise(joined_ids(first_a, ta["id"], a), joined_ids(first_b, tb["id"], b), "|")
    groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_groups)]), pa.int32()), strings), ";").to_pylist()
    one = (np.diff(first_a) == 1) & (np.diff(first_b) == 1)  # most groups hold one token of each; the others' ids are joined by group
    ids_a, ids_b = _numpy(ta["id"]), _numpy(tb["id"])

    def several(ids: np.ndarray, group: np.ndarray) -> pa.Table:
        """Ids of a group and how often each stands in it, so that a group's links need no row each."""
        keep = ~one[group]
        return pa.table({"group": group[keep], "id": ids[keep]}).group_by(["group", "id"], use_threads=False).aggregate([([], "count_all")])

    la, lb = several(ids_a, in_a).rename_columns(["group", "a", "na"]), several(ids_b, in_b).rename_columns(["group", "b", "nb"])
    links = la.join(lb, keys="group", join_type="inner", use_threads=False)
    wide = lambda ids_a, ids_b: ids_a.astype(np.int64) * b.size + ids_b
    table = pa.table({
        "doc": np.concatenate([doc[one], doc[_numpy(links["group"])]]),
        "pair": np.concatenate([wide(ids_a[first_a[:-1][one]], ids_b[first_b[:-1][one]]), wide(_numpy(links["a"]), _numpy(links["b"]))]),
        "times": np.concatenate([np.ones(int(one.sum()), np.int64), _numpy(pc.multiply(links["na"], links["nb"]))]),
    })
    table = table.group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")])
    of, pairs, times = (_numpy(table[c]) for c in ("doc", "pair", "times_sum"))
    order = np.argsort(of, kind="stable")
    of, pairs, times = of[order], pairs[order], times[order]
    offsets = np.searchsorted(of, np.arange(n + 1))
    n_links = np.diff(np.concatenate([[0], np.cumsum(times)])[offsets])
    return Aligned(n_a, n_b, n_groups, n_links, groups, offsets, pairs, times)


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, pieces: str | None = None, keep_groups: bool = True
) -> DataFrame:
    """Every row of docs aligned: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups if asked for.

    A pair's count is the number of rows that hold it linked, a repeated row counting again. Null and empty texts, and texts that
    either tokenizer does not spell byte for byte, have no tokens: zeros and ''. A null id is kept. A very long text is a block of
    its own and aligned whole; an empty table gives no rows. Only id_col and text_col are read, so no other column can clash.

    The table of counts has a row for each pair ever linked, which the two vocabularies bound; it is joined by pair, and broadcast
    only if Spark finds it below its threshold. A block asks about each of its pairs once, whatever it repeats.
    """
    tokenizer, pieces = tokenizer or default_tokenizer(), pieces or default_pieces()
    width = piece_level(pieces).size
    kind = docs.schema[id_col].dataType.simpleString()
    code, number = (pa.int32(), "int") if byte_level(tokenizer).size * width < 1 << 31 else (pa.int64(), "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        a, b = byte_level(tokenizer), piece_level(pieces)
        for block in blocks(batches, size=BLOCK_BYTES):
            x = align_block([t or "" for t in block.column(1).to_pylist()], a, b)
            asked, counts = np.unique(x.pairs, return_counts=True)
            rows = block.num_rows
            whole = pa.array([0] + [len(asked)] * rows, pa.int32())  # the block's own pairs stand in its first row
            lists = lambda offsets, values, kind: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
            first = [pa.ListArray.from_arrays(whole, pa.array(v, k)) for v, k in ((asked, code), (counts, pa.int32()))]
            groups = pa.array(x.groups if keep_groups else [None] * rows, pa.string())
            digests = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in x.groups])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) | number] * rows, pa.int64()), block.column(0), *(pa.array(v, pa.int64()) for v in (x.n_a, x.n_b, x.n_groups, x.n_links)),
                    digests, groups, lists(x.offsets, x.pairs, code), lists(x.offsets, x.times, pa.int32()), *first,
                ],
                names=["block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times", "asked", "counts"],
            )
            number += 1

    row = f"block long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<{number}>, times array<int>"
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    aligned = materialize(texts.mapInArrow(run, f"{row}, asked array<{number}>, counts array<int>"), "aligned")
    asked = aligned.where(F.size("asked") > 0).select("block", F.explode(F.arrays_zip("asked", "counts")).alias("x")).select("block", F.col("x.asked").alias("pair"), F.col("x.counts").alias("n"))
    counts = materialize(asked.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts").withColumn("a", F.floor(F.col("pair") / width).cast("int"))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    judged = counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    answers = asked.select(F.col("block").alias("asker"), "pair").join(judged, "pair").select("asker", "pair", "count", "best")

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        known, order = _numpy(right["pair"]), None
        order = np.argsort(known)
        lists, times = left["pairs"].combine_chunks(), _numpy(pc.list_flatten(left["times"]).combine_chunks()).astype(np.int64)
        at = order[np.searchsorted(known, _numpy(pc.list_flatten(lists)), sorter=order)] if len(known) else EMPTY
        offsets = np.concatenate([[0], np.cumsum(_numpy(pc.list_value_length(lists)))])
        sums = lambda values: pa.array(np.diff(np.concatenate([[0], np.cumsum(values * times)])[offsets]), pa.int64())
        out = {c: left[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups")}
        return pa.table(out | {"n_best": sums(_numpy(right["best"]).astype(np.int64)[at]), "count_sum": sums(_numpy(right["count"])[at])})

    result = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long"
    done = aligned.drop("asked", "counts").groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(resolve, result)
    return done.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if keep_groups else []))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and counts of every document's two tokenizations."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_groups=False)
