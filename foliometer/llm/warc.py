"""Web archives in seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each holding a group of WARC/1.1
records, and ends with a seek table in a skippable frame: per frame its compressed and
plain size (u32 each), then the number of frames (u32), a descriptor byte 0 and the magic
0x8F92EAB1. Any Zstandard tool reads a bundle as one stream; the seek table and an index
(record id to frame and offset in the frame) lead to a single record.
"""

from __future__ import annotations

import struct
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import attach
from ..session import scratch
from .common import map_batches, stored, without_clashes
from .files import write_file

FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 32 * 1024 * 1024
LEAST_SHARED = 100
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"


def record_types(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(page_id, url, html, digest, record_type, refers_to).

    Of pages with equal payloads of at least ``least`` bytes, that with the smallest id is
    a response and the others revisit it. Rows that repeat the smallest id are responses
    too. Rows without an id are responses if no equal payload has one, else revisits. A null payload is
    empty.
    """
    rows = without_clashes(pages, "page_id", "url", "html").select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html")
    )
    rows = rows.withColumn("digest", F.sha2("html", 256))
    large = rows.filter(F.octet_length("html") >= least)
    groups = large.groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("rows")
    )
    groups = groups.filter("rows > 1")
    joined = attach(rows, groups.drop("rows"), ["digest"], ["page_id", "url"], counts=groups)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", "html", "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def record(page_id, url, html: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record; a revisit has headers alone."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(html)}",
    ]
    if url is not None:
        # Signs that could end a header line, and those outside ASCII, are escaped.
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if kind == "revisit":
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        block += b"\r\n"
    else:
        block += b"Content-Length: %d\r\n\r\n" % len(html) + html
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(plain: bytes):
    """(offset, headers, content block) of each record of a frame."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        lines = plain[at:end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        body = end + 4
        size = int(headers["Content-Length"])
        if lines[0] != "WARC/1.1" or plain[body + size : body + size + 4] != b"\r\n\r\n":
            raise ValueError("broken record")
        yield at, headers, plain[body : body + size]
        at = body + size + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    table = np.array(sizes, "<u4").reshape(-1, 2).tobytes() + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(table)) + table


def frames(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the footer."""
    count, descriptor, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or descriptor:
        raise ValueError("no seek table")
    sizes = np.frombuffer(bundle[-9 - 8 * count : -9], "<u4").reshape(-1, 2).astype(np.int64)
    starts = np.cumsum(sizes[:, 0]) - sizes[:, 0]
    return [(int(s), int(c), int(p)) for s, (c, p) in zip(starts, sizes, strict=True)]


class Bundles:
    """Groups records into frames and frames into bundles of one task."""

    def __init__(self, folder: str, part: int):
        self.folder, self.part, self.number = folder, part, 0
        self.packer = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=True)
        self._open()

    def _open(self):
        self.plain, self.frames, self.sizes, self.rows, self.size = bytearray(), [], [], [], 0

    def _name(self) -> str:
        return f"pages-{self.part:06d}-{self.number:06d}.warc.zst"

    def add(self, page_id, data: bytes) -> None:
        self.rows.append((page_id, self._name(), len(self.frames), len(self.plain)))
        self.plain += data
        if len(self.plain) >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self):
        if self.plain:
            frame = self.packer.compress(bytes(self.plain))
            self.frames.append(frame)
            self.sizes.append((len(frame), len(self.plain)))
            self.size += len(frame)
            self.plain = bytearray()

    def full(self) -> bool:
        return self.size >= BUNDLE_BYTES

    def finish(self):
        """Write the bundle; its index rows."""
        self._close_frame()
        write_file(self.folder, self._name(), b"".join(self.frames) + seek_table(self.sizes))
        rows = self.rows
        self.number += 1
        self._open()
        return rows


def write_bundles(records: DataFrame, folder: str) -> DataFrame:
    """Write records and return their index: (page_id, bundle, frame, offset), stored.

    ``records`` must be a stored table, so that a task which runs again writes the same
    bundles. A bundle holds up to about 32 MB and belongs to one task.
    """
    kind = records.schema["page_id"].dataType.simpleString()

    def run(batches):
        bundles = Bundles(folder, TaskContext.get().partitionId())

        def index():
            columns = zip(*bundles.finish(), strict=True)
            kinds = [key_type, pa.string(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["page_id", "bundle", "frame", "offset"])

        for batch in batches:
            key_type = batch.column(0).type
            for page_id, url, html, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundles.add(page_id, record(page_id, url, html.encode(), *rest))
                if bundles.full():
                    yield index()
        if bundles.rows:
            yield index()

    columns = ["page_id", "url", "html", "digest", "record_type", "refers_to"]
    rows = records.select(*columns).mapInArrow(run, f"page_id {kind}, bundle string, frame int, offset long")
    return stored(rows, "warc-index")


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the bundles: its place, headers and payload figures."""

    def start():
        import hashlib

        unpacker = zstandard.ZstdDecompressor()

        def work(batch):
            for path, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for number, (first, size, plain_size) in enumerate(frames(data)):
                    plain = unpacker.decompress(data[first : first + size], plain_size)
                    rows = []
                    for offset, headers, block in parse_records(plain):
                        payload = block.split(b"\r\n\r\n", 1)[1]
                        kind = headers["WARC-Type"]
                        said = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        length, refers = int(headers["WARC-Payload-Length"]), headers.get("WARC-Refers-To")
                        if kind == "response":
                            length, digest = len(payload), hashlib.sha256(payload).hexdigest()
                            if digest != said:
                                raise ValueError("payload does not match its digest")
                        named = [x and x.removeprefix("<urn:page:").removesuffix(">") for x in (headers["WARC-Record-ID"], refers)]
                        named = [None if x == "None" else x for x in named]
                        rows.append((named[0], length, said, kind, named[1], headers.get("WARC-Target-URI"), path.rsplit("/", 1)[1], number, offset))
                    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int32(), pa.int64()]
                    yield [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]

        return work

    content = spark.read.format("binaryFile").load(folder).select("path", "content")
    return map_batches(
        content, start,
        "page_id string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to string, url string, bundle string, frame int, offset long",
    )


def find_record(bundle: bytes, frame: int, offset: int) -> tuple[dict, bytes]:
    """Headers and content block of one record, by reading one frame."""
    first, size, plain_size = frames(bundle)[frame]
    plain = zstandard.ZstdDecompressor().decompress(bundle[first : first + size], plain_size)
    _, headers, block = next(parse_records(plain[offset:]))
    return headers, block


def archive(pages: DataFrame, folder: str | None = None, least: int = LEAST_SHARED) -> tuple[DataFrame, DataFrame]:
    """Write all pages; (records read back from the bundles, index)."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    records = stored(record_types(pages, least), "records")
    index = write_bundles(records, folder)
    if index.isEmpty():
        columns = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
        return spark.createDataFrame([], columns), index
    return read_bundles(spark, folder), index
