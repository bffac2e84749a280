"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with a group of whole records, and a footer: a skippable
frame with the seek table of the public seekable format (compressed and plain size of every frame). An index maps
each record to its bundle, frame and offset within the frame, so one record is read by one seek and one small
decompression. Records with equal payloads are stored once; the others revisit the one with the largest id.

Bundles are written under names that no other attempt uses, and only an attempt that succeeds enters the index, so
lost executors and repeated tasks leave no wrong entries; sweep() deletes what failed attempts left.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import scratch

# Fixed values of the public seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id bigint, bundle string, frame int, offset bigint, length bigint"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record; with refers_to a revisit, whose block holds the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or '').translate({13: '%0D', 10: '%0A'})}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """(headers, block, where the next record begins) of the record at `at`."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(head["Content-Length"])
    block = data[end + 4 : end + 4 + n]
    if data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return head, block, end + 8 + n


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of every frame of a bundle."""
    source.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table at the end of the bundle")
    source.seek(size - 9 - 8 * n - 8)
    kind, length = struct.unpack("<II", source.read(8))
    if kind != SKIPPABLE or length != 8 * n + 9:
        raise ValueError("the seek table is damaged")
    out, at = [], 0
    for a, b in struct.iter_unpack("<II", source.read(8 * n)):
        out.append((at, a, b))
        at += a
    return out


def _opened(path: str):
    return pafs.FileSystem.from_uri(path)


class Bundle:
    """Writes one bundle; entries: (page_id, frame, offset, length) of each record."""

    def __init__(self, path: str, frame_bytes: int, level: int) -> None:
        import zstandard

        self.path, self.frame_bytes, self.squeeze = path, frame_bytes, zstandard.ZstdCompressor(level=level)
        home, name = _opened(path)
        home.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.out = home.open_output_stream(name, compression=None)
        self.sizes: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.plain = self.written = 0
        self.entries: list[tuple] = []

    def add(self, page_id, data: bytes) -> None:
        self.entries.append((page_id, len(self.sizes), self.plain, len(data)))
        self.parts.append(data)
        self.plain += len(data)
        if self.plain >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.parts:
            frame = self.squeeze.compress(b"".join(self.parts))
            self.out.write(frame)
            self.sizes.append((len(frame), self.plain))
            self.written += len(frame)
            self.parts, self.plain = [], 0

    def close(self) -> list[tuple]:
        self.flush()
        self.out.write(seek_table(self.sizes))
        self.out.close()
        return self.entries


def revisits(pages: DataFrame, least: int = 0, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Payload digests (hex) that several pages have, with the largest page id and how many; pages of `least` bytes and more count."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    slim = pages.where(F.octet_length(payload) >= least).select(F.sha1(payload.cast("binary")).alias("digest"), F.col(id_col).cast("long").alias("id"))
    return slim.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")


def write_bundles(pages: DataFrame, folder: str, least: int = 0, frame_bytes: int = 256 << 10, bundle_bytes: int = 64 << 20, level: int = 3, per_salt: int = 20_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page as a record; returns the index (page_id, bundle, frame, offset, length), settled.

    Null html is an empty payload, a null url an empty one; a null id is kept and never referred to. Of equal
    payloads the one with the largest id is the response (all of its rows, if the row is repeated), others revisit
    it. Where more than `per_salt` pages share a payload, repeated payloads are dealt over so many more partitions. An
    empty table gives no bundle; a long payload makes a frame of its own.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"))
    again = scratch.settle(revisits(pages, least, id_col, html_col), "warc-revisits")
    salts = 1 + (again.agg(F.max("n").alias("n")).first()["n"] or 0) // per_salt
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    again = again.select("digest", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1).cast("int"))).alias("salt"))
    joined = rows.join(again, ["digest", "salt"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None

        def closed() -> pa.RecordBatch:
            e = bundle.close()
            cols = list(zip(*e, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array([bundle.path] * len(e), pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["page_id", "bundle", "frame", "offset", "length"])

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, refers = (batch.column(k)[i].as_py() for k in range(4))
                if bundle is None:
                    bundle = Bundle(f"{folder}/{uuid.uuid4().hex}.warc.zst", frame_bytes, level)
                data = html.encode()
                bundle.add(page, record(page, url, data, hashlib.sha1(data).digest(), None if refers is None or refers == page else refers))
                if bundle.written >= bundle_bytes:
                    yield closed()
                    bundle = None
        if bundle is not None:
            yield closed()

    return scratch.settle(joined.mapInArrow(run, INDEX), "warc-index")


def read_bundles(index: DataFrame, frames: int = 32) -> DataFrame:
    """Every record of the bundles that the index names, parsed; payload digests of responses are computed anew and compared.

    `frames` frames at a time are dealt evenly over the cluster, whatever the number of bundles.
    """
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for path, unit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                home, name = _opened(path)
                with home.open_input_file(name) as source:
                    for start, size, plain in read_seek_table(source, source.size())[unit * frames : (unit + 1) * frames]:
                        source.seek(start)
                        data = zstandard.ZstdDecompressor().decompress(source.read(size), max_output_size=plain)
                        rows, at = [], 0
                        while at < len(data):
                            head, block, at = parse(data, at)
                            rows.append(_fields(head, block))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    units = index.groupBy("bundle").agg(F.max("frame").alias("last")).select("bundle", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / frames).cast("int"))).alias("unit"))
    # Dealt in turn to a fixed number of tasks: rows of a few bytes would else be put together in one.
    return units.repartition(n).mapInArrow(run, RECORD)


def _page(urn: str) -> int | None:
    text = urn[len("<urn:page:") : -1]
    return int(text) if text else None


def _fields(head: dict, block: bytes) -> tuple:
    cut = block.index(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in block[:cut].decode().split("\r\n")[1:])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response":
        payload = block[cut + 4 :]
        if len(payload) != int(http["Content-Length"]) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload of {head['WARC-Record-ID']} does not match its digest")
    refers = head.get("WARC-Refers-To")
    return _page(head["WARC-Record-ID"]), head["WARC-Target-URI"], int(http["Content-Length"]), digest, head["WARC-Type"], _page(refers) if refers else None


def read_record(bundle: str, frame: int, offset: int) -> tuple[dict, bytes]:
    """(headers, block) of one record, by its index entry: one seek, one frame."""
    import zstandard

    home, name = _opened(bundle)
    with home.open_input_file(name) as source:
        start, size, plain = read_seek_table(source, source.size())[frame]
        source.seek(start)
        data = zstandard.ZstdDecompressor().decompress(source.read(size), max_output_size=plain)
    head, block, _ = parse(data, offset)
    return head, block


def archive(pages: DataFrame, folder: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(index, records read back) of pages written to `folder`, by default one in the cluster's shared folder."""
    index = write_bundles(pages, folder or scratch.place(pages.sparkSession, "warc"), **options)
    return index, read_bundles(index)


def sweep(spark: SparkSession, folder: str, index: DataFrame) -> int:
    """Delete bundles of failed attempts, which the index does not name; returns how many."""
    home, name = _opened(folder)
    files = spark.createDataFrame([(f"{folder}/{x.base_name}", x.path) for x in home.get_file_info(pafs.FileSelector(name))] or [("", "")], "bundle string, path string")
    lost = files.where("path <> ''").join(index.select("bundle").distinct(), "bundle", "left_anti").collect()
    for r in lost:
        home.delete_file(r["path"])
    return len(lost)
