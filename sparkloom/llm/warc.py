"""WARC archives compressed with Zstandard: one frame per record, and a dictionary in a skippable frame at a file's head.

The writer gives equal payloads one response record and a revisit record for each other one. The reader loads the dictionary,
decodes frame by frame, and rejects a frame that isn't exactly one record with valid headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, shared_dir

# fixed values of the WARC 1.1 and Zstandard formats
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """A file or record that breaks the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    def http_length(self) -> int:
        """The payload's length by the HTTP headers, which a revisit keeps."""
        found = re.search(rb"\r\nContent-Length: (\d+)\r\n", self.block.partition(b"\r\n\r\n")[0] + b"\r\n")
        if not found:
            raise WarcError("no Content-Length in the HTTP headers")
        return int(found[1])


def _clean(value: str) -> str:
    """A header's value on one line: control characters, blanks and % percent-encoded."""
    return "".join(c if c.isprintable() and c not in " %" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def encode_record(record_id: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    headers = {"WARC-Type": "revisit" if refers_to else "response", "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE}
    if url:
        headers["WARC-Target-URI"] = _clean(url)
    if refers_to:
        headers |= {"WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": REVISIT_PROFILE}
    headers |= {"WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}", "WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes) -> Record:
    """Exactly one record; anything else raises WarcError."""
    if not data.startswith(VERSION):
        raise WarcError("a frame that doesn't begin with a WARC version")
    head, end, rest = data[len(VERSION) :].partition(b"\r\n\r\n")
    if not end:
        raise WarcError("headers without an end")
    headers: dict[str, str] = {}
    for line in head.decode().split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip() or name in headers:
            raise WarcError(f"a bad or repeated header: {line[:80]}")
        headers[name] = value.strip()
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["Content-Length"].isdecimal():
        raise WarcError("a Content-Length that is no number")
    length = int(headers["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {length}, but {len(rest) - 4} bytes")
    record = Record(headers["WARC-Type"], headers, rest[:length])
    if headers.get("WARC-Block-Digest", want := f"sha1:{sha1_base32(record.block)}") != want:
        raise WarcError("the block doesn't have its digest")
    if record.kind == "response" and headers.get("WARC-Payload-Digest", want := f"sha1:{sha1_base32(record.payload)}") != want:
        raise WarcError("the payload doesn't have its digest")
    if record.kind == "revisit" and "WARC-Refers-To" not in headers:
        raise WarcError("a revisit that refers to nothing")
    if record.kind in ("response", "revisit"):
        n = record.http_length()
        if record.kind == "response" and n != len(record.payload):
            raise WarcError("the HTTP length isn't the payload's")
    return record


def head_frame(dictionary: bytes) -> bytes:
    """The skippable frame with the dictionary, itself compressed; nothing if it is empty."""
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(packed)) + packed


def read_archive(stream, chunk: int = 1 << 16, largest: int = 1 << 30) -> Iterator[Record]:
    """Records of an open .warc.zst stream, one at a time. Memory: one record, up to largest bytes of it."""
    head = stream.read(8)
    dictionary, left = None, bytes(head)
    if len(head) == 8 and struct.unpack("<II", head)[0] == SKIPPABLE_MAGIC:
        size = struct.unpack("<II", head)[1]
        data = bytes(stream.read(size))
        if len(data) != size:
            raise WarcError("the dictionary's frame is cut off")
        if data.startswith(FRAME_MAGIC):
            data = zstandard.ZstdDecompressor().decompress(data)
        dictionary, left = zstandard.ZstdCompressionDict(data), b""
    context = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while True:
        if len(left) < 4 and (more := stream.read(chunk)):
            left += bytes(more)
        if not left:
            return
        if not left.startswith(FRAME_MAGIC):
            raise WarcError("something other than a Zstandard frame")
        frame, parts, size = context.decompressobj(), [], 0
        try:
            while not frame.eof:
                if not left and not (left := bytes(stream.read(chunk))):
                    raise WarcError("a frame that is cut off")
                parts.append(frame.decompress(left))
                left = frame.unused_data if frame.eof else b""
                size += len(parts[-1])
                if size > largest:
                    raise WarcError(f"a record of over {largest} bytes")
        except zstandard.ZstdError as e:
            raise WarcError(f"a broken frame: {e}") from e
        yield decode_record(b"".join(parts))


def _opened(uri: str):
    return pafs.FileSystem.from_uri(uri)


def train_dictionary(samples: list[bytes], size: int = 32 << 10) -> bytes:
    """A dictionary for records like the samples; empty if they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, [s for s in samples if s]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, to: str, dictionary: bytes, level: int = 3, roll: int = 128 << 20) -> list[str]:
    """Writes record_id, url, payload and refers_to (null: a response) as files of about roll bytes under to; returns their URIs.

    A file is written under its attempt's name and then renamed, so that a repeated task leaves no part of a file behind.
    """
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches):
        context = TaskContext.get()
        fs, top = _opened(to)
        fs.create_dir(top, recursive=True)
        head = head_frame(shared.value)
        how = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(shared.value)) if shared.value else zstandard.ZstdCompressor(level=level)
        out, name, count, done = None, "", 0, []

        def close():
            out.close()
            fs.move(f"{top}/{name}.{context.taskAttemptId()}.part", f"{top}/{name}")
            done.append(f"{to}/{name}")

        for batch in batches:
            for record_id, url, payload, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    name = f"{context.partitionId():06d}-{count:04d}.warc.zst"
                    out = fs.open_output_stream(f"{top}/{name}.{context.taskAttemptId()}.part")
                    out.write(head)
                    count += 1
                out.write(how.compress(encode_record(record_id, url, payload, refers_to)))
                if out.tell() > roll:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["uri"])

    return sorted(r.uri for r in arrow_map(pages.select("record_id", "url", "payload", "refers_to"), run, "uri string").collect())


def read_archives(spark: SparkSession, uris: list[str]) -> DataFrame:
    """One row per record of the archives: record_id, type, url, refers_to, payload_digest, payload_bytes, payload (null for revisits).

    Every record is validated; the first broken one fails the query. No files give an empty result.
    """
    schema = "record_id string, type string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary"

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = _opened(uri)
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for r in read_archive(stream):
                        h = r.headers
                        n = r.http_length() if r.kind in ("response", "revisit") else len(r.block)
                        rows.append((h["WARC-Record-ID"].strip("<>"), r.kind, h.get("WARC-Target-URI"), h["WARC-Refers-To"].strip("<>") if "WARC-Refers-To" in h else None, h.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, n, r.payload if r.kind == "response" else None))
                        size += len(r.block)
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.createDataFrame(spark.sparkContext.parallelize([(u,) for u in uris], max(1, len(uris))), "uri string")
    return arrow_map(files, run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    names = ["record_id", "type", "url", "refers_to", "payload_digest", "payload_bytes", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, payload) with refers_to: the smallest page_id with the same payload, where that is another one.

    Payloads of fewer than least bytes never refer. Payloads are compared by SHA-1 and length. What is shuffled by payload is
    ids and digests, summed up first; the archive's rows themselves move once, by page_id.
    """
    keyed = pages.select("page_id", F.unhex(F.sha1("payload")).alias("digest"), F.octet_length("payload").alias("n")).where(F.col("n") >= least)
    first = keyed.groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1 AND first IS NOT NULL").drop("k")
    again = keyed.join(first, ["digest", "n"]).where("NOT page_id <=> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    mine = pages.withColumn("digest", F.unhex(F.sha1("payload")))
    return mine.join(again.withColumnRenamed("page_id", "p").withColumnRenamed("digest", "g"), mine["page_id"].eqNullSafe(F.col("p")) & (F.col("digest") == F.col("g")), "left").drop("p", "g", "digest")


def archive(pages: DataFrame, to: str | None = None, sample: int = 256, least: int = 0) -> list[str]:
    """Archives page_id, url, html (null: empty) and returns the files' URIs; other columns are ignored.

    The dictionary is trained on a bounded sample: about sample pages, chosen by a hash of page_id, 32 KB of each.
    Rows with a null page_id get the id of no page; equal rows get equal records; an empty table gives no file.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    share = min(1.0, sample / max(1, pages.count()))
    some = rows.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 40)) < int(share * (1 << 40))).limit(2 * sample).select(F.substring("payload", 1, 32 << 10).alias("p")).collect()
    dictionary = train_dictionary([encode_record("urn:page:0", None, bytes(r.p), None) for r in some])
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    ready = with_revisits(rows, least).select(name("page_id").alias("record_id"), "url", "payload", F.when(F.col("refers_to").isNotNull(), name("refers_to")).alias("refers_to"))
    return write_archives(ready, to or shared_dir(spark), dictionary)
