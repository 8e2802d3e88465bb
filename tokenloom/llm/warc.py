"""A content-addressed archive of WARC records.

Payload bytes are kept once, under their SHA-256 digest; the exact bytes around
them are kept for each record in a table of their own. The original records come
back through a join on the digest. A digest is verified three times: what a
record declares against its bytes, the number of bytes of all payloads that
share a digest, and the stored bytes when they are read.

Tables: ``payloads(digest, size, payload)`` and ``records(record, uri, header,
rest, digest, size, declared_ok, error)``. A record is ``header || payload ||
rest``, byte by byte; ``rest`` is what parts it from the next (CRLF CRLF, if the
file is well-formed). The records of a file, in order, are the whole file,
gunzipped if it was packed.

``declared_ok`` compares ``WARC-Block-Digest`` with the payload and
``WARC-Payload-Digest`` with what follows the HTTP header in it, or with the
payload where it has none: MD5, SHA-1, SHA-256 or SHA-512, in hexadecimal or base
32. It is null where nothing could be checked: nothing declared, another digest,
a revisit, a segment, a chunked body that doesn't match as it is.

Cases: bytes that aren't as the format wants them are kept, and ``error`` says
what is wrong: no WARC record, a header without end, no usable length (the
payload then goes to the next record), a payload shorter than declared, bytes
after the record, or a gzip member that can't be unpacked (its packed
bytes, from the piece of 1 MB on that can't be read, are kept as they are). Lines
of headers may end in LF alone. A null payload of a page is stored as absent
(null digest), and its record comes back as the header with an empty payload; an
empty payload has the digest of no bytes. Null uris are written as an empty
field. Repeated rows are records of their own with one payload. Rows with a null
record id are kept like others. Other columns of a table of pages are left out,
so that their names don't matter. Empty tables give empty tables.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm import _shared as S

END = b"\r\n\r\n"
CHUNK = 1 << 20
_BEGIN = re.compile(rb"(?:\A|(?<=\n))WARC/\d")
_EMPTY_LINE = re.compile(rb"\r?\n\r?\n")
_DIGESTS = {"md5": 32, "sha1": 40, "sha256": 64, "sha512": 128}
_FIELDS = T.StructType(
    [
        T.StructField("uri", T.StringType()), T.StructField("header", T.BinaryType()), T.StructField("rest", T.BinaryType()), T.StructField("payload", T.BinaryType()),
        T.StructField("digest", T.StringType()), T.StructField("size", T.LongType()), T.StructField("declared_ok", T.BooleanType()), T.StructField("error", T.StringType()),
    ]
)
_ARROW = [pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.bool_(), pa.string()]


class Record(NamedTuple):
    header: bytes
    payload: bytes
    rest: bytes
    error: str | None = None


class _Ahead:
    """Bytes of a stream that were read ahead."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.ended = chunks, bytearray(), False

    def fill(self, size: int) -> bool:
        while len(self.held) < size and not self.ended:
            more = next(self.chunks, None)
            self.ended = more is None
            self.held += more or b""
        return len(self.held) >= size

    def find(self, pattern: re.Pattern[bytes], spare: int) -> re.Match[bytes] | None:
        """The first match; ``spare`` bytes beyond it are read, so that it isn't a part of a longer one."""
        start = 0
        while True:
            found = pattern.search(self.held, start)
            if (found and found.end() + spare <= len(self.held)) or self.ended:
                return found
            start = max(0, (found.start() if found else len(self.held)) - 16)
            start = 0 if start < 16 else start
            self.fill(len(self.held) + 1)

    def take(self, size: int) -> bytes:
        out = bytes(self.held[:size])
        del self.held[:size]
        return out


def parse_records(chunks: Iterator[bytes] | bytes) -> Iterator[Record]:
    """Records of a stream of bytes; put together they are the stream."""
    ahead = _Ahead(iter([chunks] if isinstance(chunks, bytes) else chunks))
    found = ahead.find(_BEGIN, 0)
    if ahead.held and (found is None or found.start()):
        yield Record(b"", ahead.take(found.start() if found else len(ahead.held)), b"", "no record")
    while ahead.fill(1):
        error = None
        end = ahead.find(_EMPTY_LINE, 0)
        if end is None:
            yield Record(ahead.take(len(ahead.held)), b"", b"", "header without end")
            return
        header = ahead.take(end.end())
        length = header_field(header, b"content-length") or b""
        if re.fullmatch(rb"\d{1,18}", length):
            size = int(length)
            if not ahead.fill(size):
                error = "payload ends early"
            payload = ahead.take(size)
            following = ahead.find(_BEGIN, 0)
            rest = ahead.take(following.start() if following else len(ahead.held))
            if rest.strip(b"\r\n"):
                error = "bytes after the record"
        else:
            error = "no content length"
            following = ahead.find(_BEGIN, 0)
            payload = ahead.take(following.start() if following else len(ahead.held))
            tail = re.search(rb"(?:\r?\n){0,2}\Z", payload)
            payload, rest = payload[: tail.start()], payload[tail.start() :]
        yield Record(header, payload, rest, error)


def header_field(header: bytes, name: bytes) -> bytes | None:
    for line in header.split(b"\n")[1:]:
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name:
            return value.strip()
    return None


def digest_is(declared: bytes | None, data: bytes) -> bool | None:
    """Whether ``data`` has the declared digest; None if that can't be told."""
    name, colon, value = (declared or b"").decode("ascii", "replace").partition(":")
    name = name.strip().lower().replace("-", "")
    if not colon or name not in _DIGESTS:
        return None
    value, made = value.strip().rstrip("="), hashlib.new(name, data)
    if len(value) == _DIGESTS[name]:
        return value.lower() == made.hexdigest()
    spelled = base64.b32encode(made.digest()).decode().rstrip("=")
    return value.upper() == spelled if len(value) == len(spelled) else None


def declared_is_right(header: bytes, payload: bytes) -> bool | None:
    """Whether a record's bytes have the digests that its header declares; None if nothing could be checked."""
    checks = [digest_is(header_field(header, b"warc-block-digest"), payload)]
    declared = header_field(header, b"warc-payload-digest")
    if declared and (header_field(header, b"warc-type") or b"").lower() != b"revisit" and header_field(header, b"warc-segment-number") is None:
        body, chunked = payload, False
        if (header_field(header, b"content-type") or b"").lower().startswith(b"application/http"):
            end = _EMPTY_LINE.search(payload)
            body = payload[end.end() :] if end else b""
            chunked = b"chunked" in (header_field(payload[: end.end()] if end else payload, b"transfer-encoding") or b"").lower()
        right = digest_is(declared, body)
        checks.append(None if chunked and not right else right)
    checks = [x for x in checks if x is not None]
    return all(checks) if checks else None


def _row(r: Record, absent: bool = False) -> tuple:
    uri = (header_field(r.header, b"warc-target-uri") or b"").decode("utf-8", "replace")
    if absent:
        return uri, r.header, r.rest, None, None, None, None, r.error
    right = declared_is_right(r.header, r.payload) if r.header else None
    return uri, r.header, r.rest, r.payload, hashlib.sha256(r.payload).hexdigest(), len(r.payload), right, r.error


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(list(x), kind) for x, kind in zip(zip(*rows), _ARROW)] if rows else [pa.array([], kind) for kind in _ARROW]


def record_header(record: F.Column, uri: F.Column, payload: F.Column, digest: F.Column) -> F.Column:
    """The header of a resource record, up to and including its empty line."""
    text = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nWARC-Payload-Digest: sha256:"), F.coalesce(digest, F.lit("")), F.lit("\r\nContent-Length: "), F.coalesce(F.octet_length(payload), F.lit(0)).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.encode(text, "UTF-8")


def page_records(pages: DataFrame, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Records of a table of pages: each page is written as the bytes of a WARC record, which are read as those of a file are."""
    payload = F.col(payload_col).cast("binary")
    rows = pages.select(F.col(id_col).alias("record"), F.col(uri_col).alias("uri"), payload.alias("payload"))
    header = record_header(F.col("record"), F.regexp_replace(F.col("uri"), r"[\r\n]", " "), F.col("payload"), F.sha2("payload", 256))
    whole = rows.select("record", F.col("payload").isNull().alias("absent"), F.concat(header, F.coalesce("payload", F.lit(b"")), F.lit(END)).alias("bytes"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.slices(batches, "bytes"):
            made = []
            for absent, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                # a page is one record, whatever it holds
                end = data.index(END) + len(END)
                made.append(_row(Record(data[:end], data[end : -len(END)], data[-len(END) :]), absent))
            yield pa.RecordBatch.from_arrays([b.column(0), *_columns(made)], ["record", *_FIELDS.names])

    return whole.mapInArrow(read, T.StructType([whole.schema["record"], *_FIELDS.fields]))


def unpacked(chunks: Iterator[bytes], broken: list[str]) -> Iterator[bytes]:
    """A stream gunzipped member by member. What is wrong with it goes to ``broken``, with the packed bytes from the piece on that can't be read."""
    one, began = zlib.decompressobj(31), False
    for chunk in chunks:
        while chunk:
            try:
                out = one.decompress(chunk, 8 * CHUNK)
            except zlib.error as e:
                broken += [str(e), chunk, *chunks]
                return
            began = True
            if out:
                yield out
            chunk = one.unconsumed_tail
            if one.eof:
                chunk, one, began = one.unused_data, zlib.decompressobj(31), False
                if not chunk.strip(b"\0"):
                    break
    if began:
        broken.append("a member has no end")


def file_chunks(path: str) -> Iterator[bytes]:
    """Bytes of a file in the form that Spark names it, a piece at a time."""
    if path.startswith("file:"):
        stream = open("/" + path[5:].lstrip("/"), "rb")  # noqa: SIM115
    else:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        stream = system.open_input_stream(inner)
    with stream:
        while chunk := stream.read(CHUNK):
            yield bytes(chunk)


def read_warc(spark: SparkSession, path: str, *, stream: bool = True) -> DataFrame:
    """Records of WARC files, plain or gzip by member; ``record`` is the file and the place in it.

    A file is read by one task, a piece at a time; what it holds is a batch of
    records of about ``BATCH_BYTES``, or one record that is larger. ``stream``
    opens files through pyarrow; without it Spark reads each whole (up to 2 GB),
    for file systems that pyarrow lacks.
    """

    def records(name: str, content: bytes | None) -> Iterator[Record]:
        def chunks() -> Iterator[bytes]:
            return file_chunks(name) if content is None else iter([content])

        packed = next(chunks(), b"")[:2] == b"\x1f\x8b"
        if not packed:
            yield from parse_records(chunks())
            return
        broken: list = []
        yield from parse_records(unpacked(chunks(), broken))
        for piece in broken[1:] or broken[:1] and [b""]:
            yield Record(b"", piece, b"", f"gzip: {broken[0]}")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contents = b.column(1).to_pylist() if stream is False else [None] * b.num_rows
            for name, content in zip(b.column(0).to_pylist(), contents):
                held: list[tuple] = []
                size = at = 0
                for r in records(name, content):
                    held.append(_row(r))
                    size += len(r.header) + len(r.payload) + len(r.rest) + 200
                    if size > S.BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([f"{name}#{at + i}" for i in range(len(held))]), *_columns(held)], ["record", *_FIELDS.names])
                        at, size, held = at + len(held), 0, []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([f"{name}#{at + i}" for i in range(len(held))]), *_columns(held)], ["record", *_FIELDS.names])

    files = spark.read.format("binaryFile").load(path).select("path", *([] if stream else ["content"]))
    return files.mapInArrow(parse, T.StructType([T.StructField("record", T.StringType()), *_FIELDS.fields]))


def write_archive(records: DataFrame, path: str) -> None:
    """Write ``payloads`` and ``records`` under ``path``. Fails if payloads of one digest differ in size.

    ``records`` is evaluated once for either table; write it first where that
    costs more than its bytes.
    """
    spark = records.sparkSession
    records.select("record", "uri", "header", "rest", "digest", "size", "declared_ok", "error").write.parquet(f"{path}/records")
    headers = spark.read.parquet(f"{path}/records")
    wrong = headers.where("digest is not null").groupBy("digest").agg((F.min("size") != F.max("size")).alias("wrong")).where("wrong")
    if not wrong.isEmpty():
        raise ValueError("payloads of different sizes share a digest")
    # equal payloads meet by digest; the first that arrives is kept, they are alike
    records.where("digest is not null").select("digest", "size", "payload").dropDuplicates(["digest"]).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str, *, verify: bool = True) -> DataFrame:
    """``(record, uri, digest, size, header, payload, rest, declared_ok, error)``; with ``verify``, a stored payload that doesn't have its digest fails the job."""
    payloads = spark.read.parquet(f"{path}/payloads")
    if verify:
        sound = (F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("size"))
        payloads = payloads.where(F.when(sound, True).otherwise(F.raise_error(F.concat(F.lit("stored payload lacks its digest: "), F.col("digest")))))
    headers = spark.read.parquet(f"{path}/records").drop("size")
    return headers.join(payloads.select("digest", "size", "payload"), "digest", "left").select("record", "uri", "digest", "size", "header", "payload", "rest", "declared_ok", "error")


def original_records(archive: DataFrame) -> DataFrame:
    """``(record, digest, bytes)`` with the exact bytes of each record."""
    return archive.select("record", "digest", F.concat("header", F.coalesce("payload", F.lit(b"")), "rest").alias("bytes"))


def archived_records(pages: DataFrame, path: str, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Archive a table of pages under ``path`` and read its records back."""
    write_archive(page_records(pages, id_col=id_col, uri_col=uri_col, payload_col=payload_col), path)
    return original_records(read_archive(pages.sparkSession, path))


def new_archive(pages: DataFrame) -> DataFrame:
    """:func:`archived_records` under a fresh path of the shared folder."""
    return archived_records(pages, S.shared_path(pages.sparkSession, "archive"))
