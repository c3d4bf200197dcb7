"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text. Successive prefixes of a conversation are rendered; what a
prefix adds to the previous output is its last turn's span. A template that changes what it wrote before is
detected because the new output no longer begins with the old one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Turn = tuple[str, str]  # role, text
Template = Callable[[list[Turn], bool], str]

TURN, END = "### ", "</turn>"
KEPT_CHARS = 16 << 20  # of written turns that a worker keeps
_ESCAPE = re.compile(r"\\|(?=###)|(?=</turn>)")
_ROLE_ESCAPE = re.compile(r"\\|:|(?=###)|(?=</turn>)")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_PARSE = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str) -> str:
    """Put a backslash before every backslash and every control string."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return _ROLE_ESCAPE.sub(lambda m: "\\" + m[0], role)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class _Written(dict):
    """Whole turns as written, kept as every later prefix of the conversation holds them again; emptied beyond KEPT_CHARS."""

    chars = 0

    def __missing__(self, turn: Turn) -> str:
        text = f"{TURN}{escape_role(turn[0])}: {escape(turn[1])}{END}\n"
        if self.chars + 2 * len(text) > KEPT_CHARS:
            self.clear()
            self.chars = 0
        if 2 * len(text) <= KEPT_CHARS:
            self[turn] = text
            self.chars += 2 * len(text)
        return text


_written = _Written()


def turn_template(turns: list[Turn], open_role: bool = False) -> str:
    """Marked turns with escaped texts. open_role: leave the last turn open after its header, its text unused."""
    done = "".join([_written[r, t] for r, t in (turns[:-1] if open_role else turns)])
    return done + (f"{TURN}{escape_role(turns[-1][0])}: " if open_role else "")


def parse(formatted: str) -> list[Turn]:
    """Turns read back from the output of turn_template."""
    turns, at = [], 0
    while at < len(formatted):
        m = _PARSE.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def render_spans(turns: list[Turn], template: Template, roles: tuple[str, ...] | None = None) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """Output, span of each turn, span of each turn's text, and whether the template rewrote history.

    Each prefix is rendered once whole, once open after the last header, and once with an empty last text; the
    first gives the span, the others where the text lies in it. After a rewrite spans begin where the outputs part. With roles
    only turns of these get their text's span, the others their whole one.
    """
    output, spans, texts, rewritten = "", [], [], False
    for i in range(len(turns)):
        prefix = turns[: i + 1]
        new = template(prefix, False)
        if new.startswith(output):
            begin = len(output)
        else:
            rewritten = True
            begin = len(commonprefix([output, new]))
        if roles is not None and turns[i][0] not in roles:
            spans.append((begin, len(new)))
            texts.append(spans[-1])
            output = new
            continue
        opened, empty = template(prefix, True), template([*prefix[:-1], (prefix[-1][0], "")], False)
        head = len(opened) if new.startswith(opened) else begin
        tail = max(0, len(empty) - len(opened)) if empty.startswith(opened) else 0
        spans.append((begin, len(new)))
        texts.append((head, max(head, len(new) - tail)))
        output = new
    return output, spans, texts, rewritten


def format_chats(turns: DataFrame, template: Template = turn_template, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation of turns(conv_id, turn, role, text): formatted, turn_spans, loss_spans, rewrites_history, n_turns.

    Turns go by turn; ties go by role, then text. Null roles and texts count as empty. A null conv_id is a conversation of its
    own. Spans are code-point offsets. Repeated rows are turns of their own, an empty table gives no rows, and only the four named
    columns are read. A conversation is one output string, so its turns meet in one task; its size bounds that group, and rendering
    every prefix costs the square of its turns.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for chat in part.column(1).to_pylist():
                    said = [(x["role"], x["text"]) for x in chat]
                    output, spans, texts, rewritten = render_spans(said, template, loss_roles)
                    loss = [s for s, (role, _) in zip(texts, said, strict=True) if role in loss_roles]
                    rows.append((len(said), output, [list(s) for s in spans], [list(s) for s in loss], rewritten))
                n, formatted, spans, loss, rewritten = zip(*rows, strict=True)
                pair = pa.list_(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(formatted, pa.string()), pa.array(spans, pair), pa.array(loss, pair), pa.array(rewritten, pa.bool_())],
                    names=["conv_id", "n_turns", "formatted", "turn_spans", "loss_spans", "rewrites_history"],
                )

    kind = turns.schema["conv_id"].dataType.simpleString()
    return chats.mapInArrow(render, f"conv_id {kind}, n_turns long, formatted string, turn_spans array<array<long>>, loss_spans array<array<long>>, rewrites_history boolean")


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the text under the loss mask, read from the output alone: conv_id, turns_text, n_read, loss_text."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                out.append((len(turns), "".join(f"{r}\n{t}\n" for r, t in turns), "".join(unescape(text[a:b]) for a, b in loss), len(text)))
            n, said, masked, size = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(masked, pa.string()), pa.array(size, pa.int64()), batch.column(3)],
                names=["conv_id", "n_turns", "turns_text", "loss_text", "formatted_chars", "rewrites_history"],
            )

    kind = formatted.schema["conv_id"].dataType.simpleString()
    rows = formatted.select("conv_id", "formatted", "loss_spans", "rewrites_history")
    return rows.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_text string, loss_text string, formatted_chars long, rewrites_history boolean")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one whose texts hold control strings, read back from the formatted text."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    back = read_back(format_chats(rows.unionByName(extra)))
    return back.select(
        "conv_id", "n_turns", F.sha2("turns_text", 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars", "rewrites_history",
    )
