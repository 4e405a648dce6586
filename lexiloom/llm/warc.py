"""WARC archives under a Zstandard dictionary.

A file begins with a skippable frame that holds a dictionary trained on the file's own
records; each record is a frame of its own, compressed with that dictionary, so that any
record can be read alone. Files are written from the executors through the file system of
their URI; a file's name depends on its partition alone and it appears by a rename, so a
task that runs again replaces its file.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lexiloom.llm.common import cut

#: First four bytes of the dictionary's frame (a skippable frame) and of a data frame.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Payloads shorter than this are always stored.
REVISIT_BYTES = 100
#: Bytes of the dictionary, bytes of records it is trained on at most, level of compression.
DICT_BYTES, SAMPLE_BYTES, LEVEL = 32 << 10, 2 << 20, 3
DATE = "1970-01-01T00:00:00Z"


def warc_record(page_id: int | None, url: str | None, kind: str, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record; a revisit has headers only. ``size`` and ``digest`` are the full payload's."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        # a header is one line
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers by lower-case name, and under ``payload`` what follows the HTTP headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    out: dict = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    body = rest[: int(out["content-length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a WARC record must end after its content")
    out["payload"] = body.partition(b"\r\n\r\n")[2]
    return out


def train_dictionary(records: list[bytes]) -> zstd.ZstdCompressionDict | None:
    """None where the records are too few or too small to learn from."""
    if len(records) < 8 or sum(map(len, records)) < 4 * 1024:
        return None
    try:
        size = min(DICT_BYTES, sum(map(len, records)) // 4)
        return zstd.train_dictionary(size, records, k=200, d=8, f=18, accel=4)
    except zstd.ZstdError:
        return None


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, by its block headers."""
    (magic,) = struct.unpack_from("<I", data, at)
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        return at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    checksum = 4 * zstd.get_frame_parameters(data[at : at + 32]).has_checksum
    at += zstd.frame_header_size(data[at : at + 32])
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        # a run-length block stores one byte
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + checksum


class ArchiveWriter:
    """Keeps the first records until they fill the sample, then streams."""

    def __init__(self, sink) -> None:
        self.sink, self.waiting, self.size, self.packer = sink, [], 0, None

    def add(self, record: bytes) -> None:
        if self.packer is None:
            self.waiting.append(record)
            self.size += len(record)
            if self.size >= SAMPLE_BYTES:
                self.begin()
        else:
            self.sink.write(self.packer.compress(record))

    def begin(self) -> None:
        words = train_dictionary([r[: SAMPLE_BYTES // 8] for r in self.waiting])
        raw = words.as_bytes() if words else b""
        self.sink.write(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
        options = {"level": LEVEL, "write_checksum": True, "write_content_size": True}
        self.packer = zstd.ZstdCompressor(dict_data=words, **options) if words else zstd.ZstdCompressor(**options)
        for r in self.waiting:
            self.sink.write(self.packer.compress(r))
        self.waiting = []

    def close(self) -> None:
        if self.packer is None:
            self.begin()


def read_archive(data: bytes) -> Iterator[dict]:
    view = memoryview(data)
    magic, size = struct.unpack_from("<II", view)
    if magic != DICT_MAGIC:
        raise ValueError("the dictionary's frame must come first")
    words = bytes(view[8 : 8 + size])
    unpack = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(words)) if words else zstd.ZstdDecompressor()
    at = 8 + size
    while at < len(view):
        end = frame_end(view, at)
        yield parse_record(unpack.decompress(view[at:end]))
        at = end


def write_archives(pages: DataFrame, folder: str, salts: int = 16) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) below the URI ``folder``.

    Returns (file, records) of the files written. Of records with equal payloads of at least
    100 bytes the one with the smallest page_id is a response and holds the payload; the
    others are revisits that refer to it. The table of repeated payloads has a row for each
    such payload and is copied ``salts`` times, so that a payload that a third of the pages
    share is spread over as many tasks.

    Defined cases: null html is an empty payload; a null url is empty; a page with a null id is
    a revisit where its payload has a page with an id, else a response; rows that repeat the
    smallest id are all responses; an empty table writes no records; other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html").cast("long")})
    first = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    told = rows.join(first, ["digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    told = told.select(
        "page_id", "url", "digest", "size", F.when(revisit, F.col("first")).alias("refers_to"), F.when(~revisit, F.col("html")).alias("html")
    ).sortWithinPartitions("page_id", "url", "digest")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}.warc.zst"
        fs, at = pafs.FileSystem.from_uri(folder)
        hidden = f"{at}/_{name}.{task.taskAttemptId()}"
        count, writer, sink = 0, None, None
        for batch in batches:
            for r in batch.to_pylist():
                if writer is None:
                    fs.create_dir(at, recursive=True)
                    sink = fs.open_output_stream(hidden)
                    writer = ArchiveWriter(sink)
                kind = "response" if r["refers_to"] is None else "revisit"
                writer.add(warc_record(r["page_id"], r["url"], kind, (r["html"] or "").encode(), r["digest"], r["size"], r["refers_to"]))
                count += 1
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(hidden, f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["file", "records"])

    return cut(told.mapInArrow(write, "file string, records bigint"))


_READ = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("stored_bytes", T.LongType()),
    ]
)


def _urn(value: str | None) -> int | None:
    number = (value or "")[len("<urn:page:") : -1]
    return int(number) if number else None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record below ``folder``; a stored payload must have its digest and length."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for r in read_archive(content.as_py()):
                    digest, size = r["warc-payload-digest"].removeprefix("sha256:"), int(r["x-payload-length"])
                    if r["warc-type"] == "response" and (size != len(r["payload"]) or hashlib.sha256(r["payload"]).hexdigest() != digest):
                        raise ValueError(f"the payload of {r['warc-record-id']} is damaged")
                    rows.append((_urn(r["warc-record-id"]), size, digest, r["warc-type"], _urn(r.get("warc-refers-to")), r["warc-target-uri"], len(r["payload"])))
                yield pa.RecordBatch.from_pylist([dict(zip(_READ.names, x)) for x in rows], schema=_ARROW)

    return files.mapInArrow(read, _READ)


_ARROW = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in _READ])


def archive_round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` below ``folder`` and returns what the archives say of each page."""
    spark = pages.sparkSession
    if write_archives(pages, folder).isEmpty():
        return spark.createDataFrame([], _READ)
    return read_archives(spark, folder)
