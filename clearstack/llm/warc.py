"""WARC archives in Zstandard: a writer, and a reader that checks what it reads.

An archive is a skippable frame (magic 0x184D2A5D) with the dictionary, then one frame for each record, so a record can
be read by its offset alone. The reader loads the dictionary from the leading skippable frame (itself compressed or not),
walks the frames by their block headers, decodes each alone, and checks version line, required headers, lengths,
the closing blank lines and payload digests.

In Spark an archive is a row of bytes: each task writes archives of about ARCHIVE_BYTES from the rows it has, and decodes
the archives it reads. Tables of archives go through Spark's own writers, so any store that Spark reaches will do; as
files, load them with format("binaryFile").
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearstack.llm.common import arrow_stream, least_hashed, materialize

DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
ARCHIVE_BYTES = 1 << 20
#: The dictionary is trained on at most so many rows, by least hash of page_id, and so many characters of each.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 200, 16_384, 1 << 16
#: Payloads under this are stored again rather than referred to.
LEAST_REVISIT = 100
#: Groups of equal payloads that are broadcast at most (about 6 MB); more are joined by shuffle.
BROADCAST_GROUPS = 100_000
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
DATE = "2024-01-01T00:00:00Z"
_ID = "<urn:x-page:{}:{}>"
#: Records, and bytes of payload, in one batch of what is read.
READ_ROWS, READ_BYTES = 1000, 1 << 25


class WarcError(ValueError):
    """An archive or record that breaks the format."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int = 0
    payload: bytes = field(default=b"", repr=False)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of at most DICTIONARY_BYTES; empty where the samples are too few or too short to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Collects records as frames behind the dictionary's."""

    def __init__(self, dictionary: bytes) -> None:
        self.parts: list[bytes] = []
        if dictionary:
            held = zstandard.ZstdCompressor(level=19).compress(dictionary)
            self.parts.append(struct.pack("<II", DICTIONARY_MAGIC, len(held)) + held)
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.head = list(self.parts)
        self.size = 0

    def add(self, record: bytes) -> None:
        self.parts.append(self.compressor.compress(record))
        self.size += len(self.parts[-1])

    def take(self) -> bytes:
        """The archive so far; the next begins with the same dictionary."""
        out, self.parts, self.size = b"".join(self.parts), list(self.head), 0
        return out


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at an offset ends, from its block headers."""
    try:
        flags = data[at + 4]
        end = at + zstandard.frame_header_size(data[at : at + 18])
        last = False
        while not last:
            head = int.from_bytes(data[end : end + 3], "little")
            if len(data) < end + 3:
                raise WarcError(f"frame at {at} is cut off")
            last, kind, size = head & 1, head >> 1 & 3, head >> 3
            end += 3 + (1 if kind == 1 else size)
        end += 4 if flags & 4 else 0
    except (IndexError, zstandard.ZstdError) as e:
        raise WarcError(f"frame at {at} is cut off or damaged") from e
    if end > len(data):
        raise WarcError(f"frame at {at} is cut off")
    return end


def frames(archive: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each record frame; other skippable frames are passed over."""
    data, at, dictionary = memoryview(archive), 0, None
    decoder = zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) < at + 8:
            raise WarcError(f"{len(data) - at} bytes after the last frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if len(data) < at + 8 + size:
                raise WarcError(f"skippable frame at {at} is cut off")
            if magic == DICTIONARY_MAGIC and at == 0:
                held = bytes(data[8 : 8 + size])
                if held[:4] == struct.pack("<I", FRAME_MAGIC):
                    held = zstandard.ZstdDecompressor().decompress(held)
                dictionary = zstandard.ZstdCompressionDict(held)
                decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = frame_end(data, at)
            try:
                yield at, decoder.decompressobj().decompress(data[at:end])
            except zstandard.ZstdError as e:
                raise WarcError(f"frame at {at} can't be decoded: {e}") from e
            at = end
        else:
            raise WarcError(f"no frame at {at}")


def parse_record(data: bytes, offset: int = 0) -> Record:
    """A checked record from the content of one frame; header names are as REQUIRED spells them, others as written."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not blank or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise WarcError(f"record at {offset} has no WARC version line or no end of headers")
    headers: dict[str, str] = {}
    proper = {n.lower(): n for n in (*REQUIRED, "WARC-Payload-Digest", "WARC-Refers-To", "WARC-Target-URI", "WARC-Profile", "Content-Type")}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"record at {offset} has a header line without a name: {line[:80]!r}")
        headers[proper.get(name.strip().lower(), name.strip())] = value.strip()
    missing = [n for n in REQUIRED if n not in headers]
    if missing:
        raise WarcError(f"record at {offset} lacks {', '.join(missing)}")
    if not headers["Content-Length"].isdigit():
        raise WarcError(f"record at {offset} has no number as its Content-Length")
    n = int(headers["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"record at {offset} says {n} bytes and has {max(0, len(rest) - 4)}, or doesn't end in blank lines")
    record = Record(headers, rest[:n], offset)
    if headers["WARC-Type"] == "response":
        http, blank, record.payload = record.block.partition(b"\r\n\r\n")
        if not blank or not http.startswith(b"HTTP/"):
            raise WarcError(f"response at {offset} holds no HTTP message")
        said = headers.get("WARC-Payload-Digest", "")
        if said.startswith("sha256:") and said[7:] != hashlib.sha256(record.payload).hexdigest():
            raise WarcError(f"response at {offset} has another payload than its digest says")
    return record


def read_archive(archive: bytes) -> Iterator[Record]:
    for offset, data in frames(archive):
        yield parse_record(data, offset)


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, serial: str = "") -> bytes:
    """A record, whose id ends in its serial; that of a response which others revisit in the digest, which they know too."""
    named = digest[:32] if page_id is not None and page_id == refers_to else serial
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _ID.format("" if page_id is None else page_id, named)), ("WARC-Date", DATE)]
    if url:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _ID.format(refers_to, digest[:32]))]
    return record_bytes(headers, http if revisit else http + payload)


def write_archives(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """archive, content: Zstandard archives of pages (page_id, url, html), a record for each row.

    A null html is empty. Of rows with equal payloads of at least `least` bytes the smallest page_id is a response and
    the others revisit it; rows that repeat that page_id are responses too, of the same record id. All other record ids are
    unique, whatever page_ids repeat. Rows with a null page_id are responses. The html is shuffled only where the groups of
    equal payloads are too many to broadcast.
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit("")).alias("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html)
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    groups = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    groups = materialize(groups.select("digest", "first"), "equal-payloads")
    few = groups.count() <= BROADCAST_GROUPS
    sample = least_hashed(rows.select("page_id", F.substring("html", 1, SAMPLE_CHARS).alias("html")), "page_id", SAMPLE_ROWS, "html").select("html").collect()
    dictionary = train_dictionary([r[0].encode("utf-8", "replace") for r in sample if r[0]])
    joined = rows.join(F.broadcast(groups) if few else groups, "digest", "left")

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        part, number, serial = TaskContext.get().partitionId(), 0, 0
        writer = ArchiveWriter(dictionary)
        for b in batches:
            for i, url, text, digest, first in zip(b["page_id"], b["url"], b["html"], b["digest"], b["first"], strict=True):
                revisit = first is not None and i is not None and first != i
                writer.add(page_record(i, url, text.encode("utf-8", "replace"), digest, first, revisit, f"{part}-{serial}"))
                serial += 1
                if writer.size >= ARCHIVE_BYTES:
                    yield {"archive": [f"{part:05d}-{number:05d}.warc.zst"], "content": [writer.take()]}
                    number += 1
        if writer.size:
            yield {"archive": [f"{part:05d}-{number:05d}.warc.zst"], "content": [writer.take()]}

    return arrow_stream(joined.select("page_id", "url", "html", "digest", "first"), run, "archive string, content binary")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of archives (archive, content); a damaged archive is an error that names the place.

    payload is null unless payloads is asked for, and for revisits. Null contents hold no records. A task decodes a record
    at a time and holds READ_ROWS answers, or READ_BYTES of payloads.
    """
    columns = ("archive", "record_offset", "record_id", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")

    def answer(name: str, r: Record) -> tuple:
        h = r.headers
        kind = h["WARC-Type"]
        size = len(r.payload) if kind == "response" else int(h.get("X-Payload-Length", 0))
        digest = h.get("WARC-Payload-Digest", "").removeprefix("sha256:")
        payload = r.payload if payloads and kind == "response" else None
        return name, r.offset, h["WARC-Record-ID"], _page_of(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), size, digest, kind, _page_of(h.get("WARC-Refers-To", "")), payload

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        rows, held = [], 0
        for b in batches:
            for name, content in zip(b["archive"], b["content"], strict=True):
                for r in read_archive(content or b""):
                    rows.append(answer(name, r))
                    held += len(rows[-1][-1] or b"")
                    if len(rows) >= READ_ROWS or held >= READ_BYTES:
                        yield dict(zip(columns, map(list, zip(*rows, strict=True)), strict=True))
                        rows, held = [], 0
        if rows:
            yield dict(zip(columns, map(list, zip(*rows, strict=True)), strict=True))

    return arrow_stream(archives.select("archive", "content"), run, "archive string, record_offset long, record_id string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _page_of(name: str) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?\d+):[0-9a-f-]*>", name)
    return int(m[1]) if m else None
