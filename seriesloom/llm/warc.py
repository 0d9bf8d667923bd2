"""WARC archives, written and read as streams, with a chunked record table.

Each writing task streams its records to one file in the shared folder, a gzip member per record. The
reader turns an archive into rows (record, chunk number, running digest), so neither side ever
allocates a record that is larger than a chunk beyond the row it was given. The writer's manifest is
materialized, so only files of tasks that succeeded are ever read.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK = 1 << 20
MIN_REVISIT_BYTES = 0
_DATE = "2000-01-01T00:00:00Z"  # records carry no time of their own
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_ID = "urn:x-page:"

MANIFEST = "path string, records long, bytes long"
CHUNKS = "path string, record_no long, page_id long, record_type string, target_uri string, refers_to long, declared_digest string, declared_bytes long, chunk_no int, chunk binary, bytes_so_far long, digest_so_far string, last boolean"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def decisions(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (binary), sha1 (hex) and refers_to: null for responses, else the response's page_id.

    Of equal payloads of at least ``min_bytes`` that with the least page_id is the response. Rows that
    repeat this very page_id are responses too. A null html is empty; a null page_id is never the
    least unless all are null, and then each is a response.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.sha1("payload"))
    # Digests meet without their payloads; then these go by page, so a payload that a third of the pages have is spread.
    small = rows.where(F.octet_length("payload") >= min_bytes).select("page_id", "sha1")
    first = small.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    told = small.where("page_id is not null").distinct().join(first.drop("n"), "sha1").where("page_id <> first")
    told = told.unionByName(first.where("first is not null").select("sha1", F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), "first"))
    told = told.select(F.col("sha1").alias("__s"), F.col("page_id").alias("__p"), F.col("first").alias("refers_to"))
    out = rows.join(told, (F.col("sha1") == F.col("__s")) & F.col("page_id").eqNullSafe(F.col("__p")), "left")
    return out.select("page_id", "url", "payload", "sha1", "refers_to")


def _header(page_id, url, refers_to, digest: str, size: int, block: int) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{page_id}{'' if refers_to is None else ':revisit'}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {size}", "Content-Type: application/http;msgtype=response", f"Content-Length: {block}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record(page_id, url, refers_to, sha1_hex: str, payload: bytes) -> Iterator[bytes | memoryview]:
    """The parts of one WARC record; a revisit has the HTTP header but not the payload."""
    head = _HEAD % len(payload)
    body = memoryview(payload) if refers_to is None else memoryview(b"")
    yield _header(page_id, url, refers_to, base32_sha1(bytes.fromhex(sha1_hex)), len(payload), len(head) + len(body))
    yield head
    for at in range(0, len(body), CHUNK):
        yield body[at : at + CHUNK]
    yield b"\r\n\r\n"


def write(records: DataFrame, folder: str, gzip: bool = True) -> DataFrame:
    """Write rows of ``decisions`` below ``folder``, a file per task, and return the manifest (one row per file)."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        out, path, n, size = None, "", 0, 0
        try:
            for batch in batches:
                cols = [batch.column(i) for i in range(5)]
                for i in range(batch.num_rows):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        path = posixpath.join(root, f"{uuid.uuid4().hex}.warc" + ".gz" * gzip)
                        out = fs.open_output_stream(path, compression=None, buffer_size=1 << 16)
                    page_id, url, payload, sha1, refers_to = (c[i].as_py() for c in cols)
                    z = zlib.compressobj(1, zlib.DEFLATED, 31) if gzip else None
                    for part in record(page_id, url, refers_to, sha1, payload):
                        data = z.compress(part) if z else part
                        size += len(data)
                        out.write(data)
                    if z:
                        data = z.flush()
                        size += len(data)
                        out.write(data)
                    n += 1
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield pa.RecordBatch.from_pylist([{"path": path, "records": n, "bytes": size}], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return records.select("page_id", "url", "payload", "sha1", "refers_to").mapInArrow(run, MANIFEST)


class _Stream:
    """Bytes of an archive in order; gzip members are joined as they come."""

    def __init__(self, file, gzip: bool):
        self.file, self.gzip, self.buffer, self.end = file, gzip, b"", False
        self.z = zlib.decompressobj(31)
        self.raw = b""

    def _more(self) -> None:
        if not self.gzip:
            data = self.file.read(CHUNK)
            self.end = not data
            self.buffer += data
            return
        if not self.raw and not self.z.unconsumed_tail:
            self.raw = self.file.read(1 << 16)
            if not self.raw:
                self.end = True
                return
        data, self.raw = self.z.unconsumed_tail + self.raw, b""
        self.buffer += self.z.decompress(data, CHUNK)
        if self.z.eof:
            self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at the end of the archive."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if self.end:
                if self.buffer.strip():
                    raise ValueError("the archive ends within a header")
                return None
            self._more()
        out, self.buffer = self.buffer[: at + len(mark)], self.buffer[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces of at most a chunk."""
        while n:
            if not self.buffer:
                if self.end:
                    raise ValueError("the archive ends within a record")
                self._more()
                continue
            out, self.buffer = self.buffer[: min(n, CHUNK)], self.buffer[min(n, CHUNK) :]
            n -= len(out)
            yield out


def _page(value: str | None) -> int | None:
    value = (value or "").strip("<>").removeprefix(_ID).removesuffix(":revisit")
    return int(value) if value not in ("", "None") else None


def chunks_of(stream: _Stream, path: str, with_payload: bool) -> Iterator[dict]:
    """A row for each chunk of each record (one at least), with the digest of the payload up to there."""
    no = 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"record {no} of {path} does not start with a WARC version")
        fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if x)}
        left = int(fields["content-length"])
        http = stream.until(b"\r\n\r\n")
        left -= len(http)
        sha, size, row = hashlib.sha1(), 0, None
        base = {"path": path, "record_no": no, "page_id": _page(fields["warc-record-id"]), "record_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri"), "refers_to": _page(fields.get("warc-refers-to")), "declared_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "declared_bytes": int(fields["payload-length"])}
        k = 0
        for data in stream.take(left):
            if row is not None:
                yield row | {"last": False}
            sha.update(data)
            size += len(data)
            row = base | {"chunk_no": k, "chunk": data if with_payload else None, "bytes_so_far": size, "digest_so_far": base32_sha1(sha.digest())}
            k += 1
        yield (row or base | {"chunk_no": 0, "chunk": b"" if with_payload else None, "bytes_so_far": 0, "digest_so_far": base32_sha1(sha.digest())}) | {"last": True}
        if b"".join(stream.take(4)) != b"\r\n\r\n":
            raise ValueError(f"record {no} of {path} does not end in two line ends")
        no += 1


def read(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The chunk table of the archives that ``manifest`` lists, a row per chunk of at most ``CHUNK`` bytes.

    Records are told apart by (path, record_no); ``last`` marks a record's last chunk, whose digest
    covers the whole payload. An empty payload has one empty chunk.
    """
    schema = pa.schema([("path", pa.string()), ("record_no", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("chunk_no", pa.int32()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_())])

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None) as f:
                    rows, held = [], 0
                    for row in chunks_of(_Stream(f, path.endswith(".gz")), path, with_payload):
                        rows.append(row)
                        held += 200 + len(row["chunk"] or b"")
                        if held > 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    # The files are few against their contents: a task each, by ranges, as hashes of a few paths would meet.
    return manifest.select("path").repartitionByRange(max(1, manifest.count()), "path").mapInArrow(run, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record. A response's digest and size come from the bytes read, and must equal those declared."""
    same = (F.col("digest_so_far") == F.col("declared_digest")) & (F.col("bytes_so_far") == F.col("declared_bytes"))
    checked = F.when((F.col("record_type") == "revisit") | same, F.col("declared_digest")).otherwise(F.raise_error(F.concat(F.lit("payload digest differs in "), F.col("path"))))
    return chunks.where("last").select("page_id", F.col("declared_bytes").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, gzip: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each row of ``pages``, read back from archives.

    A null html is an empty payload, a null url has no target, a null page_id is carried along. Repeated rows are a record each. Payloads of any
    length pass in chunks; digests are of the bytes read, and a difference from those declared fails. An empty table gives an empty result. Other columns, whatever
    their names, are ignored.
    """
    folder = common.new_path(pages.sparkSession, "warc")
    manifest = common.materialize(write(decisions(pages), folder, gzip), "warc-manifest")
    return records(read(manifest, folder, with_payload=False))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "pages"))


#: Base 32 of the SHA-1, five bits at a time.
OP8_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
s as (select page_id, h, sha1(h) as x, min(page_id) over (partition by h) as f from p)
select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(list_sum(list_transform(range(0, 5), lambda j:
    (((strpos('0123456789abcdef', substr(x, 1 + (5 * i + j) // 4, 1)) - 1) >> (3 - (5 * i + j) % 4)) & 1) << (4 - j))) as int), 1)), '') as payload_digest,
  case when page_id = f then 'response' else 'revisit' end as record_type,
  case when page_id = f then null else f end as refers_to
from s
"""
