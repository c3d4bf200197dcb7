"""op3, op4 and op9 with a shared folder of a scheme that Spark opens and pyarrow does not."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from barline.llm import bpe, store, token_scan, warc
from barline.llm.store import arrow_opens, save_bytes, spark_read_files, spark_write_files


@pytest.fixture
def hadoop_only(spark, tmp_path, monkeypatch):
    (tmp_path / "shared").mkdir()
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("fs.viewfs.mounttable.kept.link./shared", f"file://{tmp_path}/shared")
    monkeypatch.setitem(store._own, "dir", "viewfs://kept/shared")  # where spark.checkpoint.dir, unset here, would point
    return "viewfs://kept/shared"


def test_the_scheme_is_unknown_to_arrow_and_a_local_one_is_not(hadoop_only, tmp_path):
    assert not arrow_opens(hadoop_only) and not arrow_opens("s3a://bucket/x") and not arrow_opens("abfss://c@a.dfs.core.windows.net/x")
    assert arrow_opens(f"file://{tmp_path}")


def test_files_hold_the_bytes_in_order(spark, hadoop_only, tmp_path):
    tail = b"\xff\xc4\n"
    data = [bytes([i % 256, 0, 255, 10, 13]) * (i % 7) + tail for i in range(300)]
    rows = spark.createDataFrame([(f"f{i % 3}", i, bytearray(d)) for i, d in enumerate(data)], "name string, at int, data binary")
    spark_write_files(rows.repartition("name").sortWithinPartitions("name", "at"), f"{hadoop_only}/files", tail)
    got = {r["name"]: (r["size"], bytes(r["content"])) for r in spark_read_files(spark, f"{hadoop_only}/files").collect()}
    want = {f"f{k}": b"".join(data[k::3]) for k in range(3)}
    assert got == {k: (len(v), v) for k, v in want.items()}
    save_bytes(spark, f"{hadoop_only}/one", b"\x00\xff")
    assert (tmp_path / "shared/one").read_bytes() == b"\x00\xff"


def test_archives(spark, hadoop_only):
    trap = "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = ["<p>a</p>", "<p>a</p>", "", None, trap * 40, "é" * 5000, "\n\n"]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(3)
    manifest = warc.write_archives(pages)
    rows = {r["page_id"]: r for r in warc.read_archives(manifest, with_payload=True).collect()}
    assert sorted(rows) == list(range(len(html)))
    for i, h in enumerate(html):
        first = next(j for j, o in enumerate(html) if (o or "") == (h or ""))
        assert rows[i]["record_type"] == ("response" if first == i else "revisit") and rows[i]["payload_bytes"] == len((h or "").encode())
        if first == i:
            assert bytes(rows[i]["payload"]) == (h or "").encode() and rows[i]["digest_ok"]
    assert warc.read_archives(warc.write_archives(pages.where("page_id < 0"))).count() == 0


def test_token_counts(spark, hadoop_only):
    texts = ["one two three", "", None, "x " * 4000, "\n", "日本語 text"] * 5
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    codec = token_scan.encoding(token_scan.default_ranks())
    got = {r["doc_id"]: r["n_tokens"] for r in token_scan.token_counts(docs).collect()}
    assert got == {i: len(codec.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert token_scan.token_counts(docs.where("doc_id < 0")).count() == 0


def test_lexicon(spark, hadoop_only):
    docs = spark.createDataFrame([(i, "the cat and the dog " * 3) for i in range(4)] + [(9, None)], "doc_id long, text string")
    rows = bpe.encode(docs).select("doc_id", "decoded", F.size("ids").alias("n")).collect()
    assert {r["doc_id"]: r["decoded"] for r in rows} == {**{i: "the cat and the dog " * 3 for i in range(4)}, 9: ""}
    assert hashlib.sha256(rows[0]["decoded"].encode()).hexdigest() and all((r["n"] == 0) == (r["decoded"] == "") for r in rows)
