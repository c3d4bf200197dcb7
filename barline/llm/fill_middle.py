"""Fill-in-middle transformation over an indexable skip list of each text's lines.

Every link of a lane carries its width in units (lines) and in code points. A descent from the highest lane takes each link that
does not pass the wanted rank and adds up both widths, so it ends at the cut's unit with the cut's code point. The lists of a
block of texts lie in flat arrays, a lane after the other, and all cuts descend together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import blocks, mix

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED = 7
FIM_PERCENT, SPM_PERCENT = 100, 50
SPREAD = 4  # one node in so many goes on to the next lane
_NONE = np.iinfo(np.int64).max  # width of a link that isn't there

Units = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each line (its newline included) of all texts, one after another, and the number of each text's lines."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    cuts = np.union1d(np.flatnonzero(codes == 10) + 1, ends[sizes > 0])
    return np.diff(cuts, prepend=0), np.diff(np.searchsorted(cuts, np.concatenate([[0], ends]), side="right"))


class SkipLists:
    """A skip list for each text. A lane holds, for each of its nodes, the widths of its link and its place in the lane below."""

    def __init__(self, widths: np.ndarray, counts: np.ndarray, seed: int = SEED):
        heads = np.cumsum(counts + 1) - counts - 1  # a text's head stands before its first unit, then a node after each unit
        size = int((counts + 1).sum())
        head = np.zeros(size, dtype=bool)
        head[heads] = True
        last = np.roll(head, -1)  # the next node is another text's
        units, chars = (~last).astype(np.int64), np.zeros(size, dtype=np.int64)
        chars[~last] = widths
        ordinal = np.arange(size) - np.repeat(heads, counts + 1)
        towers = mix(ordinal.astype(np.uint64) + np.uint64((seed << 32) % (1 << 64)))
        self.lanes = [(np.where(last, _NONE, units), chars, np.arange(size))]
        self.heads = heads
        while size > len(counts):
            up = head | (towers % np.uint64(SPREAD) == 0)
            at = np.flatnonzero(up)
            units, chars = np.add.reduceat(units, at), np.add.reduceat(chars, at)
            head, towers = head[at], towers[at] // np.uint64(SPREAD)
            self.lanes.append((np.where(np.roll(head, -1), _NONE, units), chars, at))
            size = len(at)

    def find(self, lists: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Code points before the given rank of units in each of the given lists."""
        left, passed, at = ranks.astype(np.int64), np.zeros(len(ranks), dtype=np.int64), lists.copy()  # in the highest lane there are heads only
        for units, chars, below in reversed(self.lanes):
            going = np.flatnonzero(units[at] <= left)
            while len(going):
                here = at[going]
                left[going] -= units[here]
                passed[going] += chars[here]
                at[going] += 1
                going = going[units[at[going]] <= left[going]]
            at = below[at]
        return passed


def drawn(id_col: str, seed: int = SEED):
    """The first four 8-digit groups of the hex sha256 of seed:id as integers; a null id draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)))


def rebuild(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> str:
    """The text from which an output was made."""
    prefix, suffix, middle = marks
    if form == PLAIN:
        return output
    if form == PSM:
        head, rest = output[len(prefix) :].split(suffix, 1)
        tail, body = rest.split(middle, 1)
    else:
        tail, rest = output[len(suffix) :].split(prefix, 1)
        head, body = rest.split(middle, 1)
    return head + body + tail


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must differ, and no end of one may begin another or itself, else a text's end could run into one."""
    if len(set(marks)) < 3 or not all(marks):
        raise ValueError("three different marks are needed")
    for a in marks:
        for b in marks:
            if any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError(f"marks {a!r} and {b!r} overlap")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
    seed: int = SEED, marks: tuple[str, str, str] = MARKS, units: Units = lines,
) -> DataFrame:
    """Every row of docs cut at two ranks of its units that its id draws: id_col, n, form, prefix_chars, middle_chars, output, restored.

    A null text counts as empty; an empty text, one that contains a mark and one that the percentage leaves out stay as they are
    (plain, without lengths). A null id draws as an empty one; repeated rows and ids come back as often, an empty table
    gives no rows. A very long text is a block of its own and cut whole. Only id_col and text_col are read, so no other column can clash.
    restored is rebuilt from output and form alone.
    """
    check_marks(marks)
    prefix, suffix, middle = marks

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "_text"):
            texts = [t or "" for t in block.column(2).to_pylist()]
            draws = np.array(block.column(1).to_pylist(), dtype=np.int64)
            widths, counts = units(texts)
            ranks = np.sort(draws[:, :2] % (counts[:, None] + 1), axis=1)
            found = SkipLists(widths, counts, seed).find(np.repeat(np.arange(len(texts)), 2), ranks.reshape(-1)).reshape(-1, 2)
            rows = []
            for text, (a, b), draw in zip(texts, found.tolist(), draws.tolist(), strict=True):
                if not text or draw[2] % 100 >= fim_percent or any(m in text for m in marks):
                    rows.append((PLAIN, None, None, text))
                elif draw[3] % 100 < spm_percent:
                    rows.append((SPM, a, b - a, f"{suffix}{text[b:]}{prefix}{text[:a]}{middle}{text[a:b]}"))
                else:
                    rows.append((PSM, a, b - a, f"{prefix}{text[:a]}{suffix}{text[b:]}{middle}{text[a:b]}"))
            form, before, inside, output = zip(*rows, strict=True)
            restored = [rebuild(o, f, marks) for o, f in zip(output, form, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(counts, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), pa.array(output), pa.array(restored)],
                names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output", "restored"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), drawn(id_col, seed).alias("_draws"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string, restored string")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, form, lengths and digests of every document's fill-in-middle output."""
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))
