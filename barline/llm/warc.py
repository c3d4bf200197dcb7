"""WARC archives: one record per page, written by tasks and read back with boundary-chain verification.

A reader task scans a fixed byte range for record magic. Each candidate's header names the offset of its successor;
a candidate inside a payload looks the same. Which candidates are records is settled by the chain alone:
pointer jumping from offset 0 of each file keeps what is reachable. Inside a range it runs on arrays, across
ranges on a Spark table of (offset, exit of the range) pairs, with as many rounds as a file's ranges double.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import arrow_opens, materialize, shared_dir, spark_read_files, spark_write_files

RANGE_BYTES = 8 << 20
MAX_TASKS = 1 << 15
HEADER_BYTES = 64 << 10  # read beyond a range for a header that begins in it; longer headers are read on, step by step
DATE = "1970-01-01T00:00:00Z"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _value(text: object) -> str:
    return quote(str(text), safe=":/?#[]@!$&'()*+,;=%-._~")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: an HTTP response with the payload, or for a revisit its headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_value(url)}"] if url is not None else []), *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages(page_id, url, html) to archives in the shared folder; returns the manifest (path, size, records). On a folder that only
    Spark opens its text writer writes them, and records is null.

    Of pages with equal payloads of at least min_bytes the one with the least page_id is the response, the others
    revisits of it. Rows that share that least page_id are all responses. A null page_id is always a response
    and never referred to; null html is an empty payload; a null url leaves the header out. The table of repeated
    payloads holds ids and digests only and is broadcast only if Spark finds it below its threshold. Repeated rows are a
    record each, an empty table gives no archive, and only the three named columns are read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = rows.where((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull())
    repeated = materialize(large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id"), "payloads")
    joined = rows.join(repeated, "digest", "left").withColumn(
        "refers_to", F.when((F.octet_length("html") >= min_bytes) & (F.col("page_id") != F.col("first_id")), F.col("first_id"))
    )
    base = shared_dir(spark, "warc")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, folder = pafs.FileSystem.from_uri(base)
        store.create_dir(folder, recursive=True)
        # a name for each attempt: what a failed one leaves is in no manifest
        name = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc"
        size = records = 0
        with store.open_output_stream(name) as out:
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    data = record(page_id, url, html.encode(), refers_to)
                    out.write(data)
                    size, records = size + len(data), records + 1
        yield pa.RecordBatch.from_pydict({"path": [name.rsplit("/", 1)[1]], "size": [size], "records": [records]})

    def records_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}"
        for batch in batches:
            data = [record(page_id, url, html.encode(), refers_to) for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(data), pa.string()), pa.array(data, pa.binary())], names=["name", "data"])

    joined = joined.select("page_id", "url", "html", "refers_to")
    if not arrow_opens(base):
        spark_write_files(joined.mapInArrow(records_of, "name string, data binary"), base, b"\r\n\r\n")
        listed = spark_read_files(spark, base).select(F.col("name").alias("path"), "size", F.lit(None).cast("long").alias("records"))
        return materialize(listed, "manifest").withColumn("base", F.lit(base))
    manifest = joined.mapInArrow(write, "path string, size long, records long")
    return materialize(manifest.where("size > 0"), "manifest").withColumn("base", F.lit(base))


def _open(base: str, cache: dict, path: str, content: bytes | None = None):
    if path not in cache:
        cache.clear()
        if content is not None:
            cache[path] = pa.BufferReader(content)
            return cache[path]
        store, folder = pafs.FileSystem.from_uri(base)
        cache[path] = store.open_input_file(f"{folder}/{path}")
    return cache[path]


def _read(file, begin: int, end: int) -> bytes:
    file.seek(begin)
    return file.read(max(0, end - begin))


def _long_head(file, begin: int, size: int) -> bytes:
    """The bytes from begin to the blank line that ends a header, read in doubling steps; empty if the file has none."""
    head, step = bytearray(), 2 * HEADER_BYTES
    while begin + len(head) < size:
        searched = max(0, len(head) - 3)
        head += _read(file, begin + len(head), min(size, begin + len(head) + step))
        if (stop := head.find(b"\r\n\r\n", searched)) >= 0:
            return bytes(head[:stop])
        step *= 2
    return b""


def candidates(file, begin: int, end: int, size: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Offsets in [begin, end) that look like records and end inside the file, their successors, and their headers."""
    data = _read(file, begin, min(size, end + HEADER_BYTES))
    offsets, successors, heads = [], [], []
    for m in MAGIC.finditer(data, 0, min(len(data), end - begin + 10)):
        if m.start() >= end - begin:
            break
        stop = data.find(b"\r\n\r\n", m.start())
        head = data[m.start() : stop] if stop >= 0 else b""
        if stop < 0 and begin + len(data) < size:
            head = _long_head(file, begin + m.start(), size)
        length = re.search(rb"\r\nContent-Length: *(\d{1,18})\r?(?:\n|$)", head)
        if head and length:
            successor = begin + m.start() + len(head) + 4 + int(length[1]) + 4
            if successor <= size:
                offsets.append(begin + m.start())
                successors.append(successor)
                heads.append(head)
    return np.array(offsets, np.int64), np.array(successors, np.int64), heads


def local_next(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Index of each candidate's successor among the candidates, -1 where it is not one of them."""
    at = np.searchsorted(offsets, successors)
    hit = (at < len(offsets)) & (offsets[np.minimum(at, len(offsets) - 1)] == successors) if len(offsets) else np.zeros(0, bool)
    return np.where(hit, at, -1)


def exits(offsets: np.ndarray, successors: np.ndarray, end: int) -> np.ndarray:
    """Where each candidate's chain leaves the range, by pointer jumping; -1 where it breaks inside."""
    jump = local_next(offsets, successors)
    last = np.where(jump < 0, np.arange(len(offsets)), jump)
    while len(last) and not np.array_equal(hop := last[last], last):
        last = hop
    out = successors[last]
    return np.where(out >= end, out, -1)


def reachable(offsets: np.ndarray, successors: np.ndarray, entry: int) -> np.ndarray:
    """Indices of the candidates on the chain from entry, by doubling the jumps."""
    mark = offsets == entry
    jump = local_next(offsets, successors)
    while (jump >= 0).any():
        on = jump[mark & (jump >= 0)]
        mark = mark.copy()
        mark[on] = True
        jump = np.where(jump >= 0, jump[jump], -1)
    return np.flatnonzero(mark)


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = False) -> DataFrame:
    """Records of the manifest's archives: path, offset, page_id, record_type, refers_to, url, payload_bytes, payload_digest, digest_ok, payload.

    Only candidates reachable from a file's start are records; their headers may be of any length. payload_bytes and payload_digest are those of the full
    payload, for revisits as their headers state them; digest_ok is null for these. payload is null unless asked for.
    A file whose chain breaks gives the records before the break; an empty manifest gives none. A very long record is read by the
    task of the range that it begins in. Each range that a chain enters is read twice, once to find and once to return records.
    """
    base = manifest.select("base").first()
    spark = manifest.sparkSession
    schema = "path string, offset long, page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, digest_ok boolean, payload binary"
    if base is None:
        return spark.createDataFrame([], schema)
    base = base[0]
    whole = None if arrow_opens(base) else spark_read_files(spark, base).select(F.col("name").alias("path"), "content")
    if whole is not None:  # Spark hands a file over as a whole
        range_bytes = 1 << 31
    ranges = manifest.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("begin"))
    ranges = ranges.withColumn("end", F.least("size", F.col("begin") + range_bytes))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        for batch in batches:
            for path, size, begin, end, content in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                offsets, successors, _ = candidates(_open(base, files, path, content), begin, end, size)
                out = exits(offsets, successors, end)
                columns = [pa.array([path] * len(out), pa.string()), *(pa.array(x, pa.int64()) for x in ([begin] * len(out), offsets, out))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "begin", "offset", "exit"])

    longest, total = manifest.agg(F.max(F.ceil(F.col("size") / range_bytes)), F.sum(F.ceil(F.col("size") / range_bytes))).first()
    tasks = min(MAX_TASKS, int(total))  # stated, as the few bytes of a range's row say nothing of the work behind it

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "path", "begin").withColumn("content", F.lit(None).cast("binary")) if whole is None else rows.join(whole, "path")

    found = materialize(dealt(ranges).select("path", "size", "begin", "end", "content").mapInArrow(find, "path string, begin long, offset long, exit long"), "candidates")
    # only a file's start or another range's exit can be an entry; every entry jumps to a later range
    targets = found.where("exit > 0").select("path", F.col("exit").alias("offset")).distinct()
    entries = found.join(targets.unionByName(manifest.select("path", F.lit(0).cast("long").alias("offset"))).distinct(), ["path", "offset"], "left_semi")
    jumps = materialize(entries.select("path", "offset", "exit"), "jumps")
    reached = manifest.select("path", F.lit(0).cast("long").alias("offset"))  # a chain's end, the file's size, is no entry
    for _ in range(int(longest).bit_length()):
        inside = jumps.join(manifest.select("path", "size"), "path").where("exit > 0 and exit < size")
        step = reached.join(inside, ["path", "offset"]).select("path", F.col("exit").alias("offset"))
        reached = materialize(reached.unionByName(step).distinct(), "reached")
        far = jumps.select("path", F.col("offset").alias("exit"), F.col("exit").alias("far"))
        jumps = materialize(jumps.join(far, ["path", "exit"]).select("path", "offset", F.col("far").alias("exit")), "jumps")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        for batch in batches:
            for path, size, begin, end, entry, content in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                file, rows = _open(base, files, path, content), []
                offsets, successors, heads = candidates(file, begin, end, size)
                for i in reachable(offsets, successors, entry):
                    fields = dict(line.split(b": ", 1) for line in heads[i].split(b"\r\n")[1:] if b": " in line)
                    page, refers = (re.sub(rb"[^-\d]", b"", fields.get(k, b"").rpartition(b":")[2]) for k in (b"WARC-Record-ID", b"WARC-Refers-To"))
                    kind, said = fields[b"WARC-Type"].decode(), fields.get(b"WARC-Payload-Digest", b"").rpartition(b":")[2].decode()
                    block = _read(file, int(offsets[i]) + len(heads[i]) + 4, int(successors[i]) - 4)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, ok, n = said, None, len(payload)
                    if kind == "revisit":
                        n = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                    else:
                        digest = digest_of(payload)
                        ok = digest == said
                    url = fields.get(b"WARC-Target-URI")
                    rows.append((path, int(offsets[i]), int(page) if page else None, kind, int(refers) if refers else None, url and url.decode(), n, digest, ok, payload if with_payload and kind != "revisit" else None))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * 10, kinds, strict=True)], names=names)

    at = reached.withColumn("begin", F.col("offset") - F.pmod("offset", F.lit(range_bytes).cast("long"))).withColumnRenamed("offset", "entry")
    return dealt(ranges.join(at, ["path", "begin"])).select("path", "size", "begin", "end", "entry", "content").mapInArrow(read, schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the written archives."""
    records = read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_bytes=0))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")
