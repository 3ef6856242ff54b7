"""WARC archives of individually compressed records with a shared Zstandard dictionary.

A dictionary is built from a bounded sample of the payloads. Each archive is one `.warc.zst` file: first a skippable frame
(magic 0x184D2A5D) with the dictionary, itself compressed, then one Zstandard frame for each record, so a reader can seek to any
record and needs nothing but the file. Equal payloads of at least REVISIT_BYTES are stored once, with the record
of the largest id; the others become revisit records that name it.

Spark writes the archives as rows (name, content) of a table, which any store that Spark reaches can hold;
`export` turns them into files where a folder is mounted.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
from base64 import b32decode, b32encode
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import bounded_sample, give_back, slices, staged

MAGIC = 0x184D2A5D
REVISIT_BYTES = 1000
#: The dictionary's size, and how many payloads, cut to how many bytes, it is built from.
DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_BYTES = 64 << 10, 1000, 8 << 10
#: An archive ends when its compressed records reach this size.
ARCHIVE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page:{page_id}')}>"


def build_record(page_id: object, url: str | None, payload: bytes, digest: str, length: int, refers_to: object = None) -> bytes:
    """A response record, or a revisit record if refers_to is given; its payload is then left out."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {length}\r\n\r\n".encode()
    block = http + (b"" if revisit else payload)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"X-Refers-To-Page: {refers_to}",
        ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Fields of one record; raises ValueError if it is not whole."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    length = int(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it says")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind = fields["WARC-Type"]
    stated = b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != stated):
        raise ValueError("a payload that is not what its digest says")
    number = lambda key: int(fields[key]) if key in fields else None
    return {"page_id": number("X-Page-ID"), "payload": payload, "payload_bytes": size, "payload_digest": stated, "record_type": kind, "refers_to": number("X-Refers-To-Page"), "url": fields["WARC-Target-URI"]}


def dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", MAGIC, len(body)) + body


def frame_size(data: memoryview) -> int:
    """Bytes of the Zstandard frame that data begins with, from the headers of its blocks."""
    head = bytes(data[:18])
    at, last = zstandard.frame_header_size(head), False
    while not last:
        if at + 3 > len(data):
            raise ValueError("a cut archive")
        block = int.from_bytes(data[at : at + 3], "little")
        last, repeated = block & 1, block >> 1 & 3 == 1
        at += 3 + (1 if repeated else block >> 3)
    at += 4 * zstandard.get_frame_parameters(head).has_checksum
    if at > len(data):
        raise ValueError("a cut archive")
    return at


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, in order; each frame is read once."""
    magic, size = struct.unpack_from("<II", content)
    if magic != MAGIC:
        raise ValueError("no leading dictionary frame")
    dictionary = zstandard.ZstdDecompressor().decompress(content[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    rest = memoryview(content)[8 + size :]
    while len(rest):
        stop = frame_size(rest)
        yield reader.decompress(rest[:stop])
        rest = rest[stop:]


def train_dictionary(payloads: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Empty if there is too little to build one from."""
    samples = [x for x in payloads if x]
    if len(samples) < 16 or sum(map(len, samples)) < 8 * 1024:
        return b""
    size = min(size, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8, steps=1, accel=4).as_bytes()
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT).as_bytes()


def _write(dictionary: bytes, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = dictionary_frame(dictionary)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{number:05d}.warc.zst"]), pa.array([len(held)], pa.int64()), pa.array([b"".join([frame, *held])], pa.binary())], ["name", "records", "content"])

        for batch in slices(batches, "html"):
            for at in range(batch.num_rows):
                page, url, html, digest, length, refers = (batch.column(i)[at].as_py() for i in range(6))
                held.append(packer.compress(build_record(page, url, b"" if refers is not None else (html or "").encode(), digest, length, refers)))
                size += len(held[-1])
                if size >= limit:
                    yield archive()
                    number, held, size = number + 1, [], 0
        if held:
            yield archive()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for content in batch.column("content"):
            rows = [{n: r[n] for n in names} for r in map(parse_record, read_archive(content.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)
    give_back()


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (name, records, content) of all pages: page_id, url, html (null: empty). The table is stored before it is returned.

    Of pages with equal payloads of at least REVISIT_BYTES those with the largest page_id are responses (all of them, if the
    row is repeated), the others revisits; a page without an id is a revisit of one that has an id, or else a response. Ids are
    integers; other columns of pages are not archived. No rows in, no archives out."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    facts = keyed.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("length"))
    first = facts.filter(F.col("length") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    # the pairs of revisits only; the payloads are not moved for it
    revisits = facts.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "refers_to").distinct()
    sample = bounded_sample(keyed.filter(F.octet_length(html) > 0).select("page_id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("html")), ["page_id", "url"], SAMPLE_ROWS)
    dictionary = train_dictionary([x["html"].encode() for x in sample.collect()])
    full = keyed.withColumn("digest", F.sha1(html)).withColumn("length", F.octet_length(html).cast("long"))
    ready = full.join(revisits, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest")), "left").select("page_id", "url", "html", "digest", "length", "refers_to")
    return staged(ready.mapInArrow(_write(dictionary, archive_bytes), "name string, records long, content binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to. Payloads are checked against their digests."""
    return archives.select("content").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(archives: DataFrame, folder: str) -> int:
    """Writes the archives as files into a folder that all executors and the driver mount; the number of files."""

    def put(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, os.path.join(folder, name))
                yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    return archives.select("name", "content").mapInArrow(put, "name string").count()
