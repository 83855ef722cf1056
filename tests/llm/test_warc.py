import base64
import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from quantgap.llm import warc
from quantgap.session import scratch_path
from tests.llm.helpers import rows

HTML = ["<p>a</p>", None, "", "<p>a</p>", "<p>\r\n\r\né😀</p>", "x" * 700_000, "<p>a</p>"]


def pages(spark, html=HTML, ids=None):
    ids = range(len(html)) if ids is None else ids
    return spark.createDataFrame([(i, f"http://h/{i}\r\nX: y", h) for i, h in zip(ids, html)], "page_id bigint, url string, html string")


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark):
    path = scratch_path(spark, "warc-test")
    index = warc.archive(pages(spark), path).cache()
    want = [(i, len((h or "").encode()), digest(h), *(("revisit", {0: 6, 3: 6, 1: 2}[i]) if i in (0, 1, 3) else ("response", None))) for i, h in enumerate(HTML)]
    assert sorted(rows(index, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == want
    fetched = warc.fetch(spark, path, index, spark.range(7).withColumnRenamed("id", "page_id"))
    assert {p: bytes(b) for p, b in rows(fetched, "page_id", "payload")} == {i: (h or "").encode() for i, h in enumerate(HTML)}
    assert warc.fetch(spark, path, index, spark.range(100, 101).withColumnRenamed("id", "page_id")).count() == 0
    # Any decoder reads a bundle from end to end; the index leads to the very records.
    for r in warc._open(spark, path).collect():
        content = bytes(r.content)
        whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
        table = warc.read_seek_table(content)
        assert whole == b"".join(warc.read_frame(content, f) for f in table)
        for k in index.where(F.col("bundle") == r.bundle).collect():
            record = warc.read_frame(content, table[k.frame])[k.record_at : k.record_at + k.record_bytes]
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and f"<urn:page:{k.page_id}>".encode() in record


def test_frames_and_bundles_are_bounded(spark, monkeypatch):
    records = [bytes([k % 251]) * 100_000 for k in range(30)]
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 100)
    bundles = list(warc._bundles(iter(records)))
    assert len(bundles) > 1 and all(len(warc.read_seek_table(b)) >= 1 for b in bundles)
    assert b"".join(warc.read_frame(b, f) for b in bundles for f in warc.read_seek_table(b)) == b"".join(records)
    with pytest.raises(ValueError, match="seek table"):
        warc.read_seek_table(b"no bundle at all")


def test_nulls_repeats_floor_and_empty(spark):
    got = warc.archive(pages(spark, ["a", "a", "a", "b", "b"], [None, 3, 3, None, None]))
    assert sorted(rows(got, "page_id", "record_type", "refers_to"), key=str) == [(3, "response", None)] * 2 + [(None, "response", None)] * 2 + [(None, "revisit", 3)]
    assert {r[0] for r in rows(warc.archive(pages(spark, ["a", "a"]), least=2), "record_type")} == {"response"}
    assert warc.archive(pages(spark).limit(0)).count() == 0
