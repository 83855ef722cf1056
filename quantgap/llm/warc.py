"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each a group of whole WARC records, and a seek table in a closing
skippable frame, as the seekable format of Zstandard lays it down.  Any decoder reads a bundle from start to end; one
that knows the table opens a single frame.  The index maps record identifiers to bundle, frame and place in the frame
and is derived from the written files, so it always describes what is there.

Bundles are written by Spark's own writer: failed or repeated tasks leave nothing behind, in any store Spark can write.
Records of equal payload are found by digest before writing; only one is stored, the others refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgap.llm.common import ship
from quantgap.session import scratch_path

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
LEVEL = 3
# Fixed values of the seekable format: skippable frame with a seek table, and the mark that ends it.
TABLE_FRAME = 0x184D2A5E
TABLE_END = 0x8F92EAB1

RECORD = "record_id string, page_id {kind}, url string, record_type string, refers_to {kind}, payload_bytes bigint, payload_digest string"
PLACE = "bundle string, frame int, frame_at bigint, record_at bigint, record_bytes bigint"

ship(__name__)


def with_responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """``(page_id, url, payload, refers_to)``: rows whose payload a larger page_id carries refer to that one.

    Payloads shorter than ``least`` bytes are always stored.  Null payloads count as empty; rows that share the largest
    page_id, and rows of a payload that no page_id names, are all stored.  Groups are pre-aggregated by digest.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    first = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = rows.join(first.select("sha", "first"), "sha", "left")
    refers = F.when(~F.coalesce(F.col("page_id") == F.col("first"), F.col("first").isNull()), F.col("first"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def _record(page, url, payload: bytes, refers) -> bytes:
    """One WARC record; a revisit has no block, but states the digest and length of the payload it stands for."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = payload if refers is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Closing skippable frame for frames of ``(compressed, decompressed)`` bytes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, TABLE_END)
    return struct.pack("<II", TABLE_FRAME, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """``(start, compressed, decompressed)`` of each frame."""
    count, flags, end = struct.unpack("<IBI", bundle[-9:])
    if end != TABLE_END:
        raise ValueError("the bundle does not end with a seek table")
    width = 12 if flags & 0x80 else 8
    at, out = 0, []
    table = bundle[len(bundle) - 9 - count * width : -9]
    for k in range(count):
        packed, plain = struct.unpack_from("<II", table, k * width)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(bundle: bytes, place: tuple[int, int, int]) -> bytes:
    start, packed, plain = place
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=plain) if plain else b""


def _bundles(records: Iterator[bytes]) -> Iterator[bytes]:
    """Group records into frames and frames into bundles; a record is never divided."""
    packer = zstandard.ZstdCompressor(level=LEVEL)
    frame, held, body, frames = [], 0, [], []

    def close_frame() -> None:
        nonlocal frame, held
        plain = b"".join(frame)
        body.append(packer.compress(plain))
        frames.append((len(body[-1]), len(plain)))
        frame, held = [], 0

    for record in records:
        frame.append(record)
        held += len(record)
        if held >= FRAME_BYTES:
            close_frame()
            if sum(f[0] for f in frames) >= BUNDLE_BYTES:
                yield b"".join(body) + seek_table(frames)
                body, frames = [], []
    if frame:
        close_frame()
    if frames:
        yield b"".join(body) + seek_table(frames)


def write_bundles(rows: DataFrame, path: str) -> None:
    """Write ``(page_id, url, payload, refers_to)`` rows as ``path/bundle=…/*.txt`` bundles, one file per bundle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def records() -> Iterator[bytes]:
            for batch in batches:
                for page, url, payload, refers in zip(*batch.columns):
                    yield _record(page.as_py(), url.as_py(), payload.as_py(), refers.as_py())

        task = TaskContext.get().partitionId()
        for number, bundle in enumerate(_bundles(records())):
            # The writer ends each row with the last bytes of the seek table, so the row stops before them.
            yield pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{number:04d}"]), pa.array([bundle[:-4]], pa.binary())], names=["bundle", "body"])

    packed = rows.mapInArrow(pack, "bundle string, body binary").select("bundle", F.col("body").cast("string").alias("value"))
    ending = struct.pack("<I", TABLE_END).decode("latin-1")
    packed.write.partitionBy("bundle").option("encoding", "ISO-8859-1").option("lineSep", ending).text(path)


def _heads(plain: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """``(start, length, headers, block)`` of each record in a frame."""
    at = 0
    while at < len(plain):
        stop = plain.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in plain[at:stop].decode().split("\r\n")[1:])
        body, size = stop + 4, int(head["Content-Length"])
        yield at, body + size + 4 - at, head, plain[body : body + size]
        at = body + size + 4


def _open(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return files.select(F.regexp_extract("path", "bundle=([^/]+)", 1).alias("bundle"), "content")


def read_bundles(spark: SparkSession, path: str, kind: str = "bigint", payload: bool = False) -> DataFrame:
    """Every record of the bundles with its place; this is the index, and with ``payload`` the archive's content too.

    Digest and length of a response are taken from the block that was read, and must agree with what its header states.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns):
                bundle = content.as_py()
                for number, place in enumerate(read_seek_table(bundle)):
                    rows = []
                    for at, size, head, block in _heads(read_frame(bundle, place)):
                        own, other = head["WARC-Record-ID"], head.get("WARC-Refers-To")
                        bytes_, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if other is None and (len(block), base64.b32encode(hashlib.sha1(block).digest()).decode()) != (bytes_, digest):
                            raise ValueError(f"record {own} of bundle {name} is damaged")
                        ids = [x and x.removeprefix("<urn:page:").removesuffix(">") or None for x in (own, other)]
                        rows.append((own, ids[0], head["WARC-Target-URI"], head["WARC-Type"], ids[1], bytes_, digest, name.as_py(), number, place[0], at, size, block))
                    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    schema = f"{RECORD.format(kind='string')}, {PLACE}, block binary"
    names = [part.split()[0] for part in schema.split(", ")]
    records = _open(spark, path).mapInArrow(unpack, schema)
    records = records.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
    return records if payload else records.drop("block")


def fetch(spark: SparkSession, path: str, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(page_id, payload)`` of the pages in ``wanted (page_id)``: only frames that hold one are opened.

    A revisit is answered with the payload of the record it refers to.
    """
    asked = wanted.select("page_id").distinct().join(index.select("page_id", F.coalesce("refers_to", "page_id").alias("stored")), "page_id").distinct()
    stored = index.where("record_type = 'response'").select(F.col("page_id").alias("stored"), "bundle", "frame", "record_at", "record_bytes").dropDuplicates(["stored"])
    places = stored.join(asked.select("stored").distinct(), "stored")  # a record is opened once, however many pages refer to it

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, pages, frames, starts, sizes in zip(*batch.columns):
                bundle, table, opened = content.as_py(), None, {}
                table = read_seek_table(bundle)
                for page, frame, start, size in zip(pages.as_py(), frames.as_py(), starts.as_py(), sizes.as_py()):
                    if frame not in opened:
                        opened = {frame: read_frame(bundle, table[frame])}
                    record = opened[frame][start : start + size]
                    yield pa.RecordBatch.from_arrays([pa.array([page]), pa.array([next(_heads(record))[3]], pa.binary())], names=["stored", "payload"])

    spot = F.sort_array(F.collect_list(F.struct("frame", "record_at", F.col("stored").cast("string").alias("page"), "record_bytes")))
    grouped = places.groupBy("bundle").agg(spot.alias("p"))
    found = _open(spark, path).join(grouped, "bundle").select("content", "p.page", "p.frame", "p.record_at", "p.record_bytes")
    blocks = found.mapInArrow(cut, "stored string, payload binary").withColumn("stored", F.col("stored").cast(index.schema["page_id"].dataType))
    return asked.join(blocks, "stored").select("page_id", "payload")


def archive(pages: DataFrame, path: str | None = None, least: int = 0, **names: str) -> DataFrame:
    """Write ``pages`` as bundles and read them back: the index of all records (see ``read_bundles``)."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    rows = with_responses(pages, least=least, **names)
    write_bundles(rows, path)
    return read_bundles(spark, path, rows.schema["page_id"].dataType.simpleString())
