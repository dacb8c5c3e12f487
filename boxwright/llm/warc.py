"""Operator 10: WARC archives in Zstandard with a shared dictionary.

Writing: a partition becomes archives of at most PER_ARCHIVE frames: a skippable frame that holds the dictionary, then one frame
per record. Reading takes one archive at a time.
Spark's own writer puts the bytes into files (so any Hadoop file system, its commit protocol and its retries apply);
between frames it writes a separator, which is itself an empty skippable frame, so the file stays valid Zstandard.
Reading: the dictionary comes from the leading skippable frame, each frame is decoded by itself, and header lines,
Content-Length, block length, payload length and digests are validated; a breach raises.

A payload of at least `least` bytes that occurs under several keys is stored once, by the smallest key, as a response;
the others are revisit records that name it. The dictionary is trained on at most `sample` payloads.

Defined cases: a null payload is empty; empty tables give no records; equal rows of one key give equal records;
a null key is a record without a number and always a response; a null URL is left out and read back as null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.common import cut, dedupe_columns, scratch_path

DICTIONARY_MAGIC = 0x184D2A5D
GAP = struct.pack("<II", 0x184D2A50, 0)  # an empty skippable frame; all its bytes are ASCII
FRAME_MAGIC = 0xFD2FB528
LEAST = 100
SAMPLE = 256
PER_ARCHIVE = 4000  # rows: the dictionary and records
URL_UNSAFE = re.compile(r"[\x00-\x20\x7f-\U0010ffff]+")
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def train_dictionary(samples: list[bytes], size: int = 16 << 10) -> bytes:
    import zstandard

    samples = [s for s in samples if len(s) >= 64]
    if len(samples) < 16:
        return b"".join(samples)[:size] or b"WARC/1.1\r\n"
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw)


def format_record(kind: str, key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit carries no payload; its length and digest are those of the payload it stands for."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if key is None else key}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        plain = URL_UNSAFE.sub(lambda m: quote(m[0], safe=""), url)
        head.append(f"WARC-Target-URI: {plain}")
        if plain != url:  # so that reading gives back what was stored
            head.append(f"Stored-URI: {json.dumps(url)}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields and payload of one record, validated."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] != "WARC/1.1":
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(": ")
        if not colon or name in fields:
            raise ValueError(f"bad header line {line!r}")
        fields[name] = value
    length = int(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block's length differs from Content-Length")
    http, mark, payload = rest[:length].partition(b"\r\n\r\n")
    http_lines = http.decode().split("\r\n")
    if not mark or not http_lines[0].startswith("HTTP/1.1 "):
        raise ValueError("no HTTP header")
    n = int(dict(x.split(": ", 1) for x in http_lines[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload's length or digest is wrong")
    if kind == "revisit" and payload:
        raise ValueError("a revisit holds a payload")
    name_of = lambda name: fields[name].removeprefix("<urn:page:").removesuffix(">")
    number = lambda name: int(name_of(name)) if name_of(name) else None
    url = json.loads(fields["Stored-URI"]) if "Stored-URI" in fields else fields.get("WARC-Target-URI")
    return {
        "page_id": number("WARC-Record-ID"), "url": url, "payload_bytes": n, "payload_digest": digest,
        "record_type": kind, "refers_to": number("WARC-Refers-To") if kind == "revisit" else None, "payload": payload,
    }


def frames(data: bytes) -> Iterator[bytes]:
    """Decoded frames of one archive; the dictionary is what its leading skippable frame holds."""
    import zstandard

    view, at, decoder = memoryview(data), 0, None
    while at < len(view):
        (magic,) = struct.unpack_from("<I", view, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            (n,) = struct.unpack_from("<I", view, at + 4)
            if magic == DICTIONARY_MAGIC:
                if at:
                    raise ValueError("the dictionary does not lead the archive")
                decoder = zstandard.ZstdDecompressor(dict_data=_dictionary(bytes(view[8 : 8 + n])))
            at += 8 + n
            continue
        if magic != FRAME_MAGIC or decoder is None:
            raise ValueError("neither a frame nor a dictionary")
        one = decoder.decompressobj()
        out, fed = [], at
        while not one.eof:
            if fed >= len(view):
                raise ValueError("the archive ends within a frame")
            out.append(one.decompress(view[fed : fed + 65536]))
            fed = min(len(view), fed + 65536)
        at = fed - len(one.unused_data)
        yield b"".join(out)


def _writer(dictionary: bytes, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_content_size=True)
        lead, written = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary, 0
        for batch in batches:
            out = []
            for key, url, html, digest, kind, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                payload = (html or "").encode()
                if written % PER_ARCHIVE == 0:  # where Spark's writer begins a file
                    out.append(lead)
                    written += 1
                written += 1
                out.append(coder.compress(format_record(kind, key, url, payload, digest, refers)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    return run


def _reader(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * keep_payload
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * keep_payload
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True)], names=names)
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for raw in frames(batch.column(0)[i].as_py()):
                    record = parse_record(raw)
                    held += len(record["payload"]) if keep_payload else 0
                    rows.append(record if keep_payload else {k: v for k, v in record.items() if k != "payload"})
                    if len(rows) >= 5000 or held > 16 << 20:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)

    return run


def write_archives(pages: DataFrame, path: str, least: int = LEAST, sample: int = SAMPLE, level: int = 3) -> None:
    """Archives of page_id, url, html in `path`."""
    body = F.coalesce(F.col("html"), F.lit(""))
    pages = dedupe_columns(pages, ["page_id", "url", "html"])
    digests = cut(pages.select("page_id", F.octet_length(body).cast("bigint").alias("n"), F.sha2(F.encode(body, "UTF-8"), 256).alias("digest")), "digests")
    # the first of each payload: small rows, aggregated before the shuffle; then a join whose large groups AQE can split
    first = cut(digests.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "first")
    digest = F.sha2(F.encode(body, "UTF-8"), 256)
    samples = [(r[0] or "").encode()[: 64 << 10] for r in pages.select("html").limit(sample).toLocalIterator()]
    dictionary = train_dictionary(samples)
    later = digests.join(first, "digest").where("page_id <> first")
    marked = cut(later.select(F.col("page_id").alias("_k"), F.col("digest").alias("_d"), F.col("first").alias("refers_to")).distinct(), "revisits")
    rows = pages.withColumn("digest", digest)
    # the join's shuffle also makes the archives: their size follows the partition size
    rows = rows.join(marked.hint("merge"), (F.col("page_id") == F.col("_k")) & (F.col("digest") == F.col("_d")), "left")
    kind = F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    framed = rows.select("page_id", "url", "html", "digest", kind.alias("kind"), "refers_to").mapInArrow(_writer(dictionary, level), "frame binary")
    framed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", GAP.decode("ascii")).option("maxRecordsPerFile", PER_ARCHIVE).text(path)


def read_archives(spark, path: str, keep_payload: bool = False) -> DataFrame:
    """Every record of the archives in `path`, one row each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_reader(keep_payload), RECORD + ", payload binary" * keep_payload)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write archives and read their records back."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)
