"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import Scratch

# Fixed values of the formats.
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DICTIONARY_FRAME = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 16 << 20  # payload per archive, about
SAMPLE_BYTES, DICTIONARY_BYTES = 256 << 10, 16 << 10  # what a dictionary is made from, and its size


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP header alone."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url or "")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),  # pages carry no date
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[4:4] = [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record; ValueError where a header or a length is wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not re.fullmatch(r"WARC/\d+\.\d+", lines[0]):
        raise ValueError(f"no WARC record: {raw[:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!-9;-~]+", name):
            raise ValueError(f"bad header line {line!r}")
        fields[name.lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"record lacks {sorted(missing)}")
    if not fields["content-length"].isdigit():
        raise ValueError(f"bad Content-Length {fields['content-length']!r}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length says {length}, the block has {len(rest) - 4} bytes")
    block = rest[:length]
    head, gap, payload = block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
    if not gap or not head.startswith(b"HTTP/") or stated is None:
        raise ValueError("the block is no HTTP response with a length")
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response" and (int(stated[1]) != len(payload) or said != payload_digest(payload)):
        raise ValueError(f"payload of {fields['warc-record-id']} differs from its length or digest")
    if fields["warc-type"] == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError(f"revisit {fields['warc-record-id']} has a payload or refers to nothing")

    def page(name):
        found = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))
        return int(found[1]) if found else None

    return {
        "page_id": page("warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": int(stated[1]),
        "payload_digest": said,
        "record_type": fields["warc-type"],
        "refers_to": page("warc-refers-to"),
        "payload": payload if fields["warc-type"] == "response" else None,
    }


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from the first records; none where there is too little to learn from."""
    samples, size = [], 0
    for r in records:
        samples.append(r[: 16 << 10])
        size += len(samples[-1])
        if size >= SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


class Writer:
    """Appends records to archives under a folder; a new archive after ARCHIVE_BYTES."""

    def __init__(self, root: str, name: str):
        self.files, self.root = fs.FileSystem.from_uri(root)
        self.name, self.number, self.done = name, 0, []
        self.files.create_dir(self.root, recursive=True)
        self.held, self.size, self.records = [], 0, 0
        self.out = None

    def add(self, raw: bytes) -> None:
        self.size += len(raw)
        self.records += 1
        if self.out is not None:
            self.out.write(self.compress(raw))
        else:
            self.held.append(raw)
            if self.size >= SAMPLE_BYTES:
                self._open()
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def _open(self) -> None:
        learned = _dictionary(self.held)
        self.path = f"{self.root}/{self.name}-{self.number:05d}.warc.zst"
        self.out = self.files.open_output_stream(self.path)
        if learned is not None:
            body = learned.as_bytes()
            self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(body)) + body)
        self.compress = zstandard.ZstdCompressor(level=3, dict_data=learned, write_checksum=True).compress
        for raw in self.held:
            self.out.write(self.compress(raw))
        self.held = []

    def close(self) -> None:
        if self.records:
            if self.out is None:
                self._open()
            self.out.close()
            self.done.append((self.path, self.records))
        self.out, self.size, self.records = None, 0, 0
        self.number += 1


def read_archive(stream) -> Iterator[dict]:
    """Records of one archive: loads a leading dictionary, then decodes a frame per record."""
    buffer, first, dictionary = b"", True, None

    def fill(n: int) -> bytes:
        nonlocal buffer
        while len(buffer) < n and (more := stream.read(max(n - len(buffer), 1 << 18))):
            buffer += more
        return buffer[:n]

    while head := fill(4):
        magic = int.from_bytes(head, "little") if len(head) == 4 else -1
        if magic in SKIPPABLE:
            size = int.from_bytes(fill(8)[4:], "little")
            body = fill(8 + size)[8:]
            if len(body) < size:
                raise ValueError("the archive ends inside a skippable frame")
            if first and magic == DICTIONARY_FRAME:
                if body[:4] == FRAME_MAGIC.to_bytes(4, "little"):  # the dictionary may be a frame itself
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                dictionary = zstandard.ZstdCompressionDict(body)
            buffer, first = buffer[8 + size :], False
            continue
        first = False
        if magic != FRAME_MAGIC:
            raise ValueError(f"no Zstandard frame: {head!r}")
        frame, parts = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj(), []
        while not frame.eof:
            if not fill(1):
                raise ValueError("the archive ends inside a frame")
            parts.append(frame.decompress(buffer))
            buffer = frame.unused_data if frame.eof else b""
        yield parse(b"".join(parts))


FIELDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """(page_id, url, payload, refers_to) rows to archives below ``root``; (path, records) per archive.

    Names carry the attempt, and only archives of attempts that succeeded are listed, so a lost
    executor or a second attempt does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        writer = Writer(root, f"part-{task.partitionId():06d}-{task.taskAttemptId()}")
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                writer.add(record(*row))
        writer.close()
        if writer.done:
            paths, records = zip(*writer.done)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(records, pa.int64())], names=["path", "records"])

    return pages.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, records bigint")


def read_archives(archives: DataFrame, root: str) -> DataFrame:
    """All records of the listed archives, validated; the stated number of records must be there."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = FIELDS.replace(",", "").split()[::2]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, expected in zip(*(c.to_pylist() for c in batch.columns)):
                rows, size, seen = [], 0, 0
                with files.open_input_stream(path) as stream:
                    for row in read_archive(stream):
                        rows.append(row)
                        size += len(row["payload"] or b"")
                        seen += 1
                        if size >= 4 << 20 or len(rows) >= 1000:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)
                if seen != expected:
                    raise ValueError(f"{path} has {seen} records, {expected} were written")

    return archives.select("path", "records").mapInArrow(run, FIELDS)


def archive_and_read(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, root: str | None = None
) -> DataFrame:
    """One row per page as read back: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    Payload is the html in UTF-8, null as empty. Of equal payloads of at least ``least`` bytes the smallest
    page_id is the response and the others revisit it (payload null); rows that repeat that id with the same
    payload are responses as well. Smaller payloads are all responses. A null page_id is never referred to, and
    revisits what another page has. Archives go to ``root``, or to the scratch folder all executors share.
    """
    spark: SparkSession = pages.sparkSession
    work = Scratch(spark, "warc")
    root = root or f"{work.root}/archives"
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    keys = work.cut(rows.select("page_id", "digest", F.octet_length("payload").alias("size")), "keys")
    groups = keys.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("held"))
    groups = work.cut(groups.filter("held > 1 and first is not null").select("digest", "first"), "groups")
    # A copy is named by id and digest: payloads move once, on a key that doesn't gather copies.
    copies = keys.join(groups, "digest").filter("page_id is null or page_id <> first").select("page_id", "digest", "first").distinct()
    copies = work.cut(copies, "copies")
    match = rows["page_id"].eqNullSafe(copies["page_id"]) & (rows["digest"] == copies["digest"])
    told = rows.join(copies, match, "left").select(rows["page_id"], "url", "payload", F.col("first").alias("refers_to"))
    archives = work.cut(write_archives(told, root), "manifest")
    spread = archives.repartition(max(1, archives.count()))
    return read_archives(spread, root).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"
    )
