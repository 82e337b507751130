"""WARC archives written and read as a chunked record table.

A payload travels as rows (record, chunk number, bytes) of at most ``CHUNK`` bytes, so neither the writer nor the
reader allocates a whole record. The reader carries SHA-1 along: each chunk row has the digest of the payload up to
its end, and the row with ``last`` has that of the whole.

Records are gzip members of their own, the usual form of such archives, compressed and expanded chunk by chunk.

Each writing task makes one file of its own in a shared folder, under a name that no other attempt uses, and
returns an index of its segments (path, offset, length, longest header). The index is checkpointed: files that a failed attempt left
behind are not in it and are never read. A segment holds whole records, so reading splits at segments.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttera.llm.common import opened
from uttera.session import cut_lineage, scratch_path

CHUNK = 1 << 20
SEGMENT = 8 << 20
#: Stored bytes that one task reads back, and how many tasks there are at most.
READ_BYTES = 4 << 20
MOST_TASKS = 100_000
#: Shorter payloads are always written whole.
REVISIT_FROM = 1000
DATE = "2000-01-01T00:00:00Z"
#: Longest header to expect where an index does not tell it.
LONGEST_HEADER = 1 << 20
#: Compression level, and zlib's mark for gzip members.
LEVEL, GZIP = 1, 31
CRLF = b"\r\n"

INDEX = "path string, offset long, length long, records long"
WRITTEN = INDEX + ", longest_header long"
CHUNKS = (
    "record_id string, page_id long, uri string, record_type string, refers_to long, chunk_no long, last boolean, "
    "payload_bytes long, payload_digest string, chunk binary"
)


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to) per page.

    Of equal payloads of at least REVISIT_FROM bytes the one with the largest page_id is the response and the
    others revisit it; a null id counts as the smallest. Where the largest id is repeated, or all are null, each of
    those rows is a response. Null payloads are empty. Only digests held by several pages are joined.
    """
    sized = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    ).select("*", F.octet_length("html").cast("long").alias("payload_bytes"), F.sha1("html").alias("payload_digest"))
    shared = (
        sized.filter(F.col("payload_bytes") >= REVISIT_FROM)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
        .filter("n > 1 and kept is not null")
        .drop("n")
    )
    revisits = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return sized.join(shared, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisits, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisits, F.col("kept")).alias("refers_to"),
    )


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The record rows cut into chunk rows; chunks of a record follow each other in its partition."""
    payload = F.when(F.col("record_type") == "response", F.encode("html", "UTF-8")).otherwise(F.lit(b""))
    held = records.withColumn("payload", payload).drop("html")
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("payload") / chunk).cast("int") - 1, F.lit(0)))
    return held.select(
        *[c for c in held.columns if c != "payload"], F.posexplode(numbers).alias("chunk_no", "__n"), "payload"
    ).select(
        *[c for c in held.columns if c != "payload"],
        "chunk_no",
        F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("chunk"),
    )


def _uri(text: str) -> bytes:
    """No white space or control character may end a header line."""
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], text.encode())


def record_name(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}"


def _head(row: dict) -> bytes:
    """WARC and HTTP header of a record."""
    response = row["record_type"] == "response"
    status = [b"HTTP/1.1 200 OK" if response else b"HTTP/1.1 304 Not Modified", b"Content-Type: text/html; charset=utf-8"]
    if response:
        status.append(b"Content-Length: %d" % row["payload_bytes"])
    http = CRLF.join(status) + 2 * CRLF
    block = len(http) + (row["payload_bytes"] if response else 0)
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"]))
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + row["record_type"].encode(),
        b"WARC-Record-ID: <" + record_name(row["page_id"], row["payload_digest"]).encode() + b">",
        b"WARC-Date: " + DATE.encode(),
        b"WARC-Payload-Digest: sha1:" + digest,
        b"WARC-Payload-Length: %d" % row["payload_bytes"],
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % block,
    ]
    if row["page_id"] is not None:
        lines.append(b"WARC-Page-ID: %d" % row["page_id"])
    if row["url"] is not None:
        lines.append(b"WARC-Target-URI: " + _uri(row["url"]))
    if not response:
        lines += [
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            b"WARC-Refers-To: <" + record_name(row["refers_to"], row["payload_digest"]).encode() + b">",
            b"WARC-Refers-To-Page-ID: %d" % row["refers_to"],
        ]
    return CRLF.join(lines) + 2 * CRLF + http


def write_archives(chunks: DataFrame, folder: str, segment: int = SEGMENT) -> DataFrame:
    """Writes chunk rows as WARC files below ``folder`` and returns their index, checkpointed.

    ``folder`` is any file system that pyarrow opens by its address and all executors share.
    """
    columns = [c for c in chunks.columns if c not in ("chunk", "chunk_no")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.warc.gz"
        path = f"{folder.rstrip('/')}/{name}"
        out, member, at, start, records, longest, index = None, None, 0, 0, 0, 0, []

        def put(data) -> int:
            out.write(data)
            return len(data)

        for batch in batches:
            numbers = batch.column(batch.schema.get_field_index("chunk_no")).to_pylist()
            bodies = batch.column(batch.schema.get_field_index("chunk"))
            heads = batch.select(columns).to_pylist()
            for row, number, body in zip(heads, numbers, bodies, strict=True):
                if out is None:
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                if number == 0:
                    if member is not None:
                        at += put(member.compress(2 * CRLF) + member.flush())
                    if at - start >= segment:
                        index.append((path, start, at - start, records, longest))
                        start, records, longest = at, 0, 0
                    member = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                    head = _head(row)
                    at += put(member.compress(head))
                    records += 1
                    longest = max(longest, len(head))
                at += put(member.compress(body.as_buffer()))
        if out is not None:
            at += put(member.compress(2 * CRLF) + member.flush())
            out.close()
            index.append((path, start, at - start, records, longest))
        columns_out = list(zip(*index, strict=True)) if index else [[], [], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns_out, kinds, strict=True)],
            names=["path", "offset", "length", "records", "longest_header"],
        )

    return cut_lineage(chunks.mapInArrow(write, WRITTEN))


class _Reader:
    """Bounded buffer over the expanded records of a segment."""

    def __init__(self, source, length: int, step: int, longest_header: int):
        self.source, self.left, self.step, self.longest_header = source, length, step, longest_header
        self.held, self.raw, self.member = b"", b"", None

    def _fill(self) -> bool:
        """At most ``step`` more bytes; False at the end."""
        while True:
            if not self.raw and self.left:
                self.raw = self.source.read(min(self.step, self.left))
                self.left -= len(self.raw)
                if not self.raw:
                    raise ValueError("the archive is shorter than its index says")
            if self.member is None:
                if not self.raw:
                    return False
                self.member = zlib.decompressobj(GZIP)
            over = not self.raw
            got = self.member.decompress(self.raw, self.step)
            self.raw = self.member.unconsumed_tail
            if self.member.eof:
                self.raw, self.member = self.member.unused_data, None
            elif over and not got:
                raise ValueError("the archive ends within a record")
            if got:
                self.held += got
                return True

    def head(self) -> bytes | None:
        """Bytes up to an empty line, without it; None at the end."""
        searched = 0
        while (end := self.held.find(2 * CRLF, searched)) < 0:
            if len(self.held) > self.longest_header:
                raise ValueError("a header does not end")
            searched = max(0, len(self.held) - 3)
            if not self._fill():
                if self.held:
                    raise ValueError("the archive ends within a header")
                return None
        found, self.held = self.held[:end], self.held[end + 4 :]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces of ``step`` bytes and a rest."""
        while n:
            want = min(n, self.step)
            while len(self.held) < want:
                if not self._fill():
                    raise ValueError("the archive ends within a record")
            piece, self.held = self.held[:want], self.held[want:]
            n -= want
            yield piece


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _chunks(reader: _Reader) -> Iterator[tuple]:
    while (head := reader.head()) is not None:
        fields = _fields(head)
        http = reader.head()
        if http is None:
            raise ValueError("the archive ends within a record")
        size = int(fields["content-length"]) - len(http) - 4
        digest, done, number = hashlib.sha1(), 0, 0
        declared = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        kind = fields["warc-type"]
        name = fields["warc-record-id"].strip("<>")
        fixed = (name, _number(fields.get("warc-page-id")), fields.get("warc-target-uri"), kind, _number(fields.get("warc-refers-to-page-id")))
        if kind == "revisit":  # the payload is the other record's
            yield (*fixed, 0, True, int(fields["warc-payload-length"]), declared, b"")
        else:
            for piece in reader.take(size) if size else (b"",):
                digest.update(piece)
                done += len(piece)
                if done == size and digest.hexdigest() != declared:
                    raise ValueError(f"the payload of {name} does not have its digest")
                yield (*fixed, number, done == size, done, digest.hexdigest(), piece)
                number += 1
        if b"".join(reader.take(4)) != 2 * CRLF:
            raise ValueError("a record does not end where its length says")


def read_archives(index: DataFrame, chunk: int = CHUNK, payload: bool = True) -> DataFrame:
    """Chunk rows of all records in the index: columns as in CHUNKS. The index has the columns of INDEX or WRITTEN.

    ``payload_bytes`` and ``payload_digest`` are those of the payload up to and with the chunk; a revisit is one row
    with those of the payload it refers to. Without ``payload`` the bytes themselves are left null. A
    payload that does not have its record's digest stops the read.
    """
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in CHUNKS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for entry in batch.to_pylist():
                files, path = opened(entry["path"])
                with files.open_input_file(path) as source:
                    source.seek(entry["offset"])
                    for row in _chunks(_Reader(source, entry["length"], chunk, entry.get("longest_header") or LONGEST_HEADER)):
                        rows.append(row if payload else (*row[:-1], None))
                        held += 256 + len(row[2] or "") + (len(row[-1]) if payload else 0)
                        if held > 4 * CHUNK:
                            yield batch_of(rows)
                            rows, held = [], 0
        if rows:
            yield batch_of(rows)

    # A given number of partitions is not merged by the adaptive planner, which would see only the small rows of the index.
    stored = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(-(-stored // READ_BYTES), MOST_TASKS))
    return index.repartition(int(tasks), "path", "offset").mapInArrow(read, CHUNKS)


def through_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a record per page and reads the archives back: (page_id, payload_bytes, payload_digest, record_type,
    refers_to) per record, as the archives have it. An empty table writes no file and gives no rows."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    index = write_archives(chunked(plan_records(pages)), folder)
    return read_archives(index, payload=False).filter("last").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
