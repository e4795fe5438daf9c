"""Zstandard WARC archives: a dictionary in the leading skippable frame and one frame per record.

Archives are rows (name, content), so that they can be written and read wherever Spark can; ``read_archives`` takes the
rows of Spark's ``binaryFile`` source as well.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loginlens.llm.common import stored

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-record-id", "content-length", "warc-date", "warc-type")

DATE = "2024-01-01T00:00:00Z"
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 1 << 20
LEVEL = 3

RECORDS = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


class WarcError(ValueError):
    """An archive or a record that breaks the format."""


def _safe(value: str) -> str:
    """A header value on one line: control characters, spaces and percent-free line ends are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def build_record(record_id: str, record_type: str, uri: str | None, payload: bytes, sha1: bytes, refers_to: str | None) -> bytes:
    """One record; the block is an HTTP response, of which a revisit holds the header alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if refers_to is None else 0}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_safe(uri)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(records: list[bytes]) -> bytes:
    """A dictionary for the archive, or none where there is too little to learn from."""
    sample, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        sample.append(r[: 64 << 10])
        size += len(sample[-1])
    if len(sample) < 16 or size < 8 * DICTIONARY_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def build_archive(records: list[bytes], dictionary: bytes) -> bytes:
    """The leading skippable frame with the (compressed) dictionary, then one frame per record."""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary) if dictionary else b""
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(packed)), packed, *map(pack.compress, records)])


def frames(content: memoryview) -> Iterator[tuple[int, memoryview]]:
    """Offset and bytes of every frame, found from the block headers without decompressing."""
    at, end = 0, len(content)
    while at < end:
        if end - at < 8:
            raise WarcError(f"frame at {at} is cut off")
        magic, size = struct.unpack_from("<II", content, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            stop = at + 8 + size
        elif magic != ZSTD_FRAME:
            raise WarcError(f"no frame at {at}")
        else:
            try:
                stop = at + zstandard.frame_header_size(content[at : at + 18])
                checksum = zstandard.get_frame_parameters(content[at : at + 18]).has_checksum
            except zstandard.ZstdError as error:
                raise WarcError(f"frame at {at}: {error}") from error
            last = False
            while not last:
                if stop + 3 > end:
                    raise WarcError(f"frame at {at} is cut off")
                block = content[stop] | content[stop + 1] << 8 | content[stop + 2] << 16
                last = bool(block & 1)
                stop += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            stop += 4 * checksum
        if stop > end:
            raise WarcError(f"frame at {at} is cut off")
        yield at, content[at:stop]
        at = stop


def _digest(value: str) -> str:
    """A labelled SHA-1 in base 32 or hex, as lower-case hex."""
    kind, _, text = value.partition(":")
    if kind.lower() != "sha1" or len(text) not in (32, 40):
        raise WarcError(f"unknown digest {value}")
    return base64.b32decode(text.upper()).hex() if len(text) == 32 else text.lower()


def parse_record(data: bytes) -> dict:
    """A record's fields; fails where a header is missing or wrong, or a length or digest doesn't fit."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {line[:80]!r}")
        headers[name.lower()] = value.strip()
    if missing := [m for m in MANDATORY if m not in headers]:
        raise WarcError(f"missing {', '.join(missing)}")
    if not re.fullmatch(r"[0-9]+", headers["content-length"]):
        raise WarcError("bad Content-Length")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {length}, but {len(rest) - 4} bytes")
    block = rest[:length]
    if "warc-block-digest" in headers and _digest(headers["warc-block-digest"]) != hashlib.sha1(block).hexdigest():
        raise WarcError("the block digest doesn't fit")
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap or not http.startswith(b"HTTP/"):
            raise WarcError("no HTTP header")
        told = re.search(rb"(?im)^content-length:\s*([0-9]+)\s*$", http)
        if told and int(told[1]) != len(payload):
            raise WarcError("the HTTP length doesn't fit")
    digest = _digest(headers["warc-payload-digest"]) if "warc-payload-digest" in headers else None
    kind = headers["warc-type"]
    if kind == "revisit":
        if "warc-refers-to" not in headers or "warc-profile" not in headers:
            raise WarcError("a revisit without what it refers to")
        payload = None
    elif digest is not None and digest != hashlib.sha1(payload).hexdigest():
        raise WarcError("the payload digest doesn't fit")
    return {
        "record_id": headers["warc-record-id"].strip("<>"),
        "record_type": kind,
        "target_uri": headers.get("warc-target-uri"),
        "refers_to": headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None,
        "payload_digest": digest,
        "headers": headers,
        "payload": payload,
    }


def read_archive(content: bytes) -> Iterator[tuple[int, dict]]:
    """Offset and fields of every record; the dictionary frame may be plain or compressed, or missing."""
    unpack = zstandard.ZstdDecompressor()
    for at, frame in frames(memoryview(content)):
        magic = struct.unpack_from("<I", frame)[0]
        if magic != ZSTD_FRAME:
            if at == 0 and magic == DICTIONARY_FRAME and len(frame) > 8:
                dictionary = bytes(frame[8:])
                if dictionary[:4] == struct.pack("<I", ZSTD_FRAME):
                    dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
            continue
        try:
            data = unpack.decompressobj().decompress(frame)
        except zstandard.ZstdError as error:
            raise WarcError(f"record at {at}: {error}") from error
        try:
            yield at, parse_record(data)
        except (WarcError, UnicodeDecodeError) as error:
            raise WarcError(f"record at {at}: {error}") from error


def write_archives(df: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (archive, content) for rows (record_id, record_type, target_uri, payload, sha1, refers_to).

    Each task packs its rows in order into archives of about ``archive_bytes`` before compression, so memory is bounded
    by that or the longest record. A null payload is empty; ``sha1`` is the digest (hex) of the full payload. An empty
    table gives no archives.
    """
    source = df.select("record_id", "record_type", "target_uri", F.col("payload").cast("binary"), "sha1", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        waiting: list[bytes] = []
        size = number = 0
        dictionary: bytes | None = None

        def archive() -> pa.RecordBatch:
            nonlocal dictionary, number, size
            if dictionary is None:  # learnt from the first records of the task, and carried by each of its archives
                dictionary = train_dictionary(waiting)
            content = build_archive(waiting, dictionary)
            name = f"part-{part:06d}-{number:05d}.warc.zst"
            number, size = number + 1, 0
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for i in range(batch.num_rows):
                rid, kind, uri, payload, sha1, refers = (batch.column(c)[i].as_py() for c in range(6))
                waiting.append(build_record(rid, kind, uri, payload or b"", bytes.fromhex(sha1), refers))
                size += len(waiting[-1])
                if size >= archive_bytes:
                    yield archive()
        if waiting:
            yield archive()

    return source.mapInArrow(run, "archive string, content binary")


def read_archives(df: DataFrame, name: str = "archive", content: str = "content") -> DataFrame:
    """One row per record of the archives. A broken archive fails with its name and the record's offset.

    The payload of a revisit is null: it is that of the record it refers to. Null or empty contents have no records.
    """
    source = df.select(F.col(name).cast("string"), F.col(content))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(RECORDS)

        def pack(rows: list[dict]) -> pa.RecordBatch:
            rows = [r | {"headers": list(r["headers"].items())} for r in rows]
            return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                archive, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows, size = [], 0
                try:
                    for offset, fields in read_archive(data or b""):
                        rows.append({"archive": archive, "offset": offset} | fields)
                        size += len(fields["payload"] or b"")
                        if size >= 4 << 20:
                            yield pack(rows)
                            rows, size = [], 0
                except WarcError as error:
                    raise WarcError(f"{archive}: {error}") from error
                if rows:
                    yield pack(rows)

    return source.mapInArrow(run, RECORDS)


def revisit_plan(df: DataFrame, record_key: str, payload: str, least_bytes: int = 1000) -> DataFrame:
    """All rows with ``__sha1``, and ``__first``: the key of the record that a revisit refers to, null for responses.

    Of rows with equal payloads of ``least_bytes`` or more, those with the largest key are responses and the others
    revisit it. Rows with a null key are responses. Payloads are compared by SHA-256 and length. The table of repeated
    payloads is written first, so that Spark broadcasts it only if its measured size allows that.
    """
    keyed = df.withColumn("__sha1", F.sha1(payload)).withColumn(
        "__same", F.when((F.length(payload) >= least_bytes) & F.col(record_key).isNotNull(), F.concat(F.sha2(payload, 256), F.lit(":"), F.length(payload).cast("string")))
    )
    repeated = (
        keyed.filter("__same is not null").groupBy("__same").agg(F.max(record_key).alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    )
    joined = keyed.join(stored(repeated, "payloads"), "__same", "left")
    return joined.withColumn("__first", F.when(F.col("__first") != F.col(record_key), F.col("__first"))).drop("__same")
