"""WARC archives, written by tasks and read back as a table of payload chunks.

Writing: every partition appends gzip members, one per record, to an archive of
its own; a payload goes through the compressor in chunks. A record whose payload
is a copy of another one's is a revisit and carries no payload. The writer
returns segments, runs of whole members, which are what reading tasks open.

Reading: a segment is inflated as a stream, and a payload comes out as rows
(page_id, chunk, data, …) of bounded size with the digest of all its bytes so
far. No record is ever in memory as a whole there; the last chunk has the digest
of the payload.

Defined results: a null payload is empty, and an empty payload is one empty
chunk; a null url is left out; payloads below ``SMALLEST`` bytes are always
responses; of longer equal ones those with the largest page_id are responses, so
that rows which repeat id and payload are responses each; a row without page_id
is a revisit if an equal row has one; an empty table gives no rows. Only id, url
and payload are read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import column, folder, map_arrow, small, stored
from leadlake.llm.files import Writer, dealt, open_at

SMALLEST = 1000
CHUNK_BYTES, SEGMENT_BYTES = 1 << 20, 16 << 20
#: Digests of repeated payloads that are broadcast: up to so many.
BROADCAST_DIGESTS = 300_000
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:leadlake:page:"

WRITTEN = "part long, segment long, uri string, offset long, length long, n_records long"
CHUNKS = (
    "page_id long, record_type string, refers_to long, payload_bytes long, chunk long, data binary, "
    "bytes_so_far long, sha1_so_far string, last boolean"
)


def record_types(pages: DataFrame, path: str, smallest: int = SMALLEST) -> DataFrame:
    """``pages`` (page_id, url, payload) with refers_to: the page that a copy refers to, else null."""
    sized = pages.withColumn("digest", F.when(F.octet_length("payload") >= smallest, F.sha2("payload", 256)))
    repeated = stored(
        sized.filter(F.col("digest").isNotNull()).groupBy("digest")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"),
        f"{path}/repeated",
    )
    joined = sized.join(small(repeated, BROADCAST_DIGESTS), "digest", "left")
    copied = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(copied, F.col("first")).alias("refers_to"))


def _name(page_id: int | None) -> str:
    return f"<{ID}{'none' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    found = name.strip("<>").removeprefix(ID)
    return None if found == "none" else int(found)


def _heads(page_id, url, payload, refers_to, date) -> tuple[bytes, bytes]:
    """Record head and HTTP head."""
    digest = hashlib.sha1()
    for at in range(0, len(payload), CHUNK_BYTES):
        digest.update(payload[at : at + CHUNK_BYTES])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    length = len(http) + (0 if refers_to is not None else len(payload))
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [
        "WARC-Payload-Digest: sha1:" + base64.b32encode(digest.digest()).decode(),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {length}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def _write(target: str, date: str, segment_bytes: int):
    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, file, rows, begun, n = TaskContext.get().partitionId(), None, [], 0, 0

        def close():
            nonlocal begun, n
            if n:
                rows.append((part, len(rows), file.uri, begun, file.at - begun, n))
            begun, n = file.at if file else 0, 0

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                payload = memoryview(html.as_buffer() or b"") if html.is_valid else memoryview(b"")
                file = file or Writer(target, ".warc.gz")
                record, http = _heads(page_id.as_py(), url.as_py(), payload, refers_to.as_py(), date)
                gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
                file.write(gzip.compress(record + http))
                if not refers_to.is_valid:
                    for at in range(0, len(payload), CHUNK_BYTES):
                        file.write(gzip.compress(payload[at : at + CHUNK_BYTES]))
                file.write(gzip.compress(b"\r\n\r\n") + gzip.flush())
                n += 1
                if file.at - begun >= segment_bytes:
                    close()
        close()
        if rows:
            file.close()
            names = [f.split()[0] for f in WRITTEN.split(", ")]
            columns = [pa.array(list(c), pa.string() if name == "uri" else pa.int64()) for name, c in zip(names, zip(*rows, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return write


class _Stream:
    """Bytes of the members of a segment, inflated piece by piece."""

    def __init__(self, file, length: int):
        self._file, self._left, self._rest, self._held = file, length, b"", b""
        self._inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if self._inflate.eof:
                self._rest, self._inflate = self._inflate.unused_data, zlib.decompressobj(31)
            if not self._rest:
                if not self._left:
                    return False
                self._rest = self._file.read(min(self._left, 1 << 18))
                if not self._rest:
                    raise EOFError("the archive is cut short")
                self._left -= len(self._rest)
            got = self._inflate.decompress(self._rest, 1 << 18)
            self._rest = self._inflate.unconsumed_tail if not self._inflate.eof else self._rest
            if got:
                self._held += got
                return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the segment."""
        while (cut := self._held.find(b"\r\n")) < 0:
            if not self._more():
                if self._held:
                    raise EOFError("the archive is cut short")
                return None
        line, self._held = self._held[:cut], self._held[cut + 2 :]
        return line

    def some(self, most: int) -> bytes:
        """From 1 to ``most`` bytes."""
        if not self._held and not self._more():
            raise EOFError("the archive is cut short")
        got, self._held = self._held[:most], self._held[most:]
        return got


def _fields(stream: _Stream) -> dict[str, str]:
    out = {}
    while line := stream.line():
        name, _, value = line.decode().partition(": ")
        out[name.lower()] = value
    return out


def records(file, length: int, chunk_bytes: int = CHUNK_BYTES):
    """Rows of CHUNKS for the records of a segment."""
    stream = _Stream(file, length)
    while (first := stream.line()) is not None:
        if not first:
            continue
        if first != b"WARC/1.1":
            raise ValueError(f"not a record: {first[:40]!r}")
        head = _fields(stream)
        stream.line()
        http = _fields(stream)
        payload = int(http["content-length"])
        page_id, kind = _number(head["warc-record-id"]), head["warc-type"]
        if kind == "revisit":
            stated = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
            yield page_id, kind, _number(head["warc-refers-to"]), payload, 0, b"", payload, stated, True
            continue
        left, digest, number = payload, hashlib.sha1(), 0
        while True:
            pieces, room = [], min(left, chunk_bytes)
            while room:
                pieces.append(stream.some(room))
                room -= len(pieces[-1])
            data = b"".join(pieces)
            digest.update(data)
            left -= len(data)
            yield page_id, kind, None, payload, number, data, payload - left, digest.hexdigest(), not left
            number += 1
            if not left:
                break
        if not head["warc-payload-digest"].endswith(base64.b32encode(digest.digest()).decode()):
            raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")


def _read(chunk_bytes: int):
    def read(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
        names = [f.split()[0] for f in CHUNKS.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for segment in batch.to_pylist():
                rows, held = [], 0
                with open_at(segment["uri"], segment["offset"]) as file:
                    for row in records(file, segment["length"], chunk_bytes):
                        rows.append(row)
                        held += len(row[5]) + 200
                        if held >= 4 * chunk_bytes:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return read


def write_archives(
    pages: DataFrame, *, work: str | None = None, smallest: int = SMALLEST, date: str = DATE, segment_bytes: int = SEGMENT_BYTES,
    id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
) -> DataFrame:
    """Write one archive per partition; returns their segments (WRITTEN)."""
    path = folder(pages.sparkSession, work)
    payload = F.coalesce(column(pages, payload_column, "string"), F.lit("")).cast("binary")
    narrow = pages.select(
        column(pages, id_column, "long").alias("page_id"), column(pages, url_column, "string").alias("url"), payload.alias("payload"),
    )
    typed = record_types(narrow, path, smallest)
    return stored(map_arrow(typed, _write(f"{path}/archives", date, segment_bytes), WRITTEN), f"{path}/segments")


def read_chunks(segments: DataFrame, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table (CHUNKS) of the archives."""
    return map_arrow(dealt(segments), _read(chunk_bytes), CHUNKS)
