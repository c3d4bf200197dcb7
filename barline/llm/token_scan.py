"""Token counts of flat token files that have no index.

A file is a run of little-endian token ids of 16 bits, or of 32 where an id needs them; a separator id ends each document. Tasks scan fixed blocks for
separators with array comparisons; a prefix scan over a file's blocks gives each block the number of documents
ended before it and the place of the last separator, so a document that spans blocks is counted once and whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import arrow_opens, materialize, shared_dir, spark_read_files, spark_write_files

BLOCK_TOKENS = 2 << 20
MAX_TASKS = 1 << 15
END_OF_DOCUMENT = 50256  # must be free in the rank file; write_token_files checks that


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=1)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_bytes(ranks: str, end_id: int) -> int:
    """Bytes that each id of a file takes: 2, or 4 for ids beyond 16 bits. The separator must be no token of the rank file."""
    codec = encoding(ranks)
    try:
        codec.decode_single_token_bytes(end_id)
    except KeyError:
        return 2 if max(codec.max_token_value, end_id) < 1 << 16 else 4
    raise ValueError(f"separator {end_id} is a token of {ranks}")


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, end_id: int = END_OF_DOCUMENT) -> DataFrame:
    """Encode docs into flat files in the shared folder, one a task, each document followed by end_id.

    Returns base, width, path, at, ids, size: bytes of a token, the ids of the documents in the order written, from number at of the
    file on, and the file's bytes so far. It holds no offsets of documents. A null text is a document of no tokens. Only id_col
    and text_col are read.
    """
    base, ranks = shared_dir(docs.sparkSession, "tokens"), ranks or default_ranks()
    width = token_bytes(ranks, end_id)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, codec = TaskContext.get(), encoding(ranks)
        store, folder = pafs.FileSystem.from_uri(base)
        store.create_dir(folder, recursive=True)
        # a name for each attempt: what a failed one leaves is in no result
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.bin"
        at = size = 0
        with store.open_output_stream(f"{folder}/{name}") as out:
            for batch in batches:
                for text in batch.column(1).to_pylist():
                    data = np.array([*codec.encode_ordinary(text or ""), end_id], dtype=f"<u{width}").tobytes()
                    out.write(data)
                    size += len(data)
                if batch.num_rows:
                    ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), ids, pa.array([size], pa.int64())], names=["path", "at", "ids", "size"])
                at += batch.num_rows

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, codec, at, size = f"part-{TaskContext.get().partitionId():06d}", encoding(ranks), 0, 0
        for batch in batches:
            if batch.num_rows:
                data = np.concatenate([np.array([*codec.encode_ordinary(text or ""), end_id], dtype=f"<u{width}") for text in batch.column(1).to_pylist()]).tobytes()
                ids, size = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)), size + len(data)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), ids, pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["path", "at", "ids", "size", "data"])
            at += batch.num_rows

    kind = docs.schema[id_col].dataType.simpleString()
    if not arrow_opens(base):  # a table of the parts, from which Spark writes the files
        parts = materialize(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(encoded, f"path string, at long, ids array<{kind}>, size long, data binary"), "token-parts")
        placed = parts.select(F.col("path").alias("name"), "at", "data").repartition("name").sortWithinPartitions("name", "at")
        spark_write_files(placed, base, end_id.to_bytes(width, "little"))
        return parts.drop("data").withColumn("base", F.lit(base)).withColumn("width", F.lit(width))
    written = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(write, f"path string, at long, ids array<{kind}>, size long")
    return materialize(written, "token-manifest").withColumn("base", F.lit(base)).withColumn("width", F.lit(width))


def scan_token_files(files: DataFrame, end_id: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents of files(base, path, size in bytes, width of a token): path, ordinal in the file, n_tokens without the separator, ended.

    Tokens after a file's last separator are one more document, not ended. Two separators in a row hold an empty document. The
    prefix scan over a file's blocks takes three numbers a block; the separators' places stay with their blocks.
    """
    unread = [r[0] for r in files.select("base").distinct().collect() if not arrow_opens(r[0])]  # a folder a write
    if unread:  # Spark hands a file over as a whole
        block_tokens = 1 << 31
    starts = F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(block_tokens).cast("long"))
    ranges = files.withColumn("tokens", F.floor(F.col("size") / F.col("width"))).where("tokens > 0")
    ranges = ranges.select("base", "path", "width", F.explode(starts).alias("begin"), "tokens").withColumn("end", F.least("tokens", F.col("begin") + block_tokens))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, path, width, begin, end, content in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if content is None:
                    store, folder = pafs.FileSystem.from_uri(base)
                    with store.open_input_file(f"{folder}/{path}") as f:
                        f.seek(width * begin)
                        content = f.read(width * (end - begin))
                tokens = np.frombuffer(content[: width * (end - begin)], dtype=f"<u{width}")
                ends = np.flatnonzero(tokens == end_id) + begin
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([begin], pa.int64()), pa.array([end], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], names=["path", "begin", "end", "ends"]
                )

    total = files.agg(F.sum(F.ceil(F.col("size") / F.col("width") / block_tokens))).first()[0] or 0
    tasks = max(1, min(MAX_TASKS, int(total)))  # stated, as the few bytes of a block's row say nothing of the work behind it
    found = ranges.repartition(tasks, "path", "begin").withColumn("content", F.lit(None).cast("binary"))
    if unread:
        whole = reduce(DataFrame.unionByName, [spark_read_files(files.sparkSession, b).select(F.lit(b).alias("base"), F.col("name").alias("path"), "content") for b in unread])
        found = ranges.join(whole, ["base", "path"], "left")
    found = found.select("base", "path", "width", "begin", "end", "content").mapInArrow(scan, "path string, begin long, end long, ends array<long>")
    found = materialize(found, "separators")
    last_end = F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1)
    blocks = found.select("path", "begin", "end", F.size("ends").alias("n"), last_end.alias("last_end"))
    earlier = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    states = blocks.select(
        "path", "begin", "end", "n", "last_end",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias("before"),
        F.coalesce(F.max("last_end").over(earlier), F.lit(-1).cast("long")).alias("previous"),
        (F.col("end") == F.max("end").over(Window.partitionBy("path"))).alias("is_last"),
    )
    # a document's tokens lie between its separator and the one before, wherever that was
    closed = F.arrays_zip(F.col("ends").alias("stop"), F.concat(F.array("previous"), F.col("ends")).alias("start"))
    stitched = found.select("path", "begin", "ends").join(states.select("path", "begin", "before", "previous"), ["path", "begin"])
    rows = stitched.select("path", "before", F.posexplode(closed).alias("i", "x")).where("x.stop is not null")
    done = rows.select("path", (F.col("before") + F.col("i")).alias("ordinal"), (F.col("x.stop") - F.col("x.start") - 1).alias("n_tokens"), F.lit(True).alias("ended"))
    tail = states.where("is_last").select(
        "path", (F.col("before") + F.col("n")).alias("ordinal"), (F.col("end") - F.coalesce("last_end", "previous") - 1).alias("n_tokens"), F.lit(False).alias("ended")
    )
    return done.unionByName(tail.where("n_tokens > 0"))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every row of docs, counted in the files: id_col, n_tokens. Repeated rows and null ids come back as they are.

    A null or empty text has no tokens, an empty table gives no rows, and a very long text is encoded whole by its row's task. Only
    id_col and text_col are read; whatever id_col is called, no other column can clash.
    """
    written = write_token_files(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    files = written.groupBy("base", "path", "width").agg(F.max("size").alias("size"))
    ids = written.select("path", "at", F.posexplode("ids").alias("i", "id")).select("path", (F.col("at") + F.col("i")).alias("ordinal"), "id")
    counted = materialize(scan_token_files(files).where("ended"), "token-counts")
    return ids.join(counted, ["path", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens")


def op9_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, from flat files of all documents."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
