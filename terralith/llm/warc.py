"""WARC archives: one gzip member per record, written from pages and read back in sequence.

Writing: the SHA-1 of every payload (UTF-8 html; null counts as empty) is taken first. Of the pages with equal
payloads of at least `dedup_bytes` bytes, the largest page_id is the response and the others are revisits of it
(WARC/1.1, profile identical-payload-digest) without a payload of their own; shorter payloads are all responses.
The digests are counted with partial aggregation, so a payload of a third of all pages is no hot group. Pages then
go by page_id to tasks that write archives of about `archive_bytes` each into a folder that all executors share.
Archives have names of their own and only a written manifest says which ones count, so a task that ran twice or
was lost leaves nothing but an orphan. Rows that repeat page_id and payload: the first written is the response,
the others revisit it. Rows without a page_id are not written. Extra columns are not read; an empty table writes
no archives and gives an empty result.

Reading: an archive is streamed; zlib inflates one gzip member at a time, the record's header and its
Content-Length frame the block, and the digests are verified: the block's of every record, the payload's of every
response. A member that ends early, a length that does not fit or a wrong digest raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import materialize, read_table, shared_path, task_count
from .token_counts import open_store

DEDUP_BYTES = 0
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 18

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Records carry no time of their own, so that a repeated run writes the same bytes.
_DATE = "1970-01-01T00:00:00Z"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page: int) -> str:
    return f"<urn:page:{page}>"


def _field(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(page: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    block = _HTTP + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_field(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1(block)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[2:2] = [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class WarcError(ValueError):
    pass


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The gzip members of a stream, each inflated as its bytes come in."""
    inflate, parts, data = zlib.decompressobj(31), [], stream.read(READ_BYTES)
    fresh = True
    while data:
        parts.append(inflate.decompress(data))
        fresh = False
        if inflate.eof:
            yield b"".join(parts)
            data, parts, inflate, fresh = inflate.unused_data, [], zlib.decompressobj(31), True
            data = data or stream.read(READ_BYTES)
        else:
            data = stream.read(READ_BYTES)
    if not fresh:
        raise WarcError("the archive ends within a record")


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, payload) of each record, with lengths and digests verified."""
    for raw in members(stream):
        head, sign, body = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not sign or not lines[0].startswith("WARC/"):
            raise WarcError("a record without a WARC header")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        block = body[:length]
        if len(block) != length or body[length:] != b"\r\n\r\n":
            raise WarcError(f"{fields.get('warc-record-id')}: Content-Length does not fit")
        if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{sha1(block)}":
            raise WarcError(f"{fields.get('warc-record-id')}: wrong block digest")
        payload = block.partition(b"\r\n\r\n")[2]
        if fields["warc-type"] == "response" and fields.get("warc-payload-digest", f"sha1:{sha1(payload)}") != f"sha1:{sha1(payload)}":
            raise WarcError(f"{fields.get('warc-record-id')}: wrong payload digest")
        yield fields, payload


def _digests(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = batch.column(1).cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sha1(x) for x in payloads], pa.string()), pa.array([len(x) for x in payloads], pa.int64())], ["page_id", "digest", "size"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, digest string, size long")


_MANIFEST = "archive string, n_records long"


def write_archives(pages: DataFrame, folder: str, dedup_bytes: int = DEDUP_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages' archives to the folder; returns the manifest (archive, n_records)."""
    known = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    digests = materialize(_digests(known), "digests")
    # a payload's response, where it has other pages too
    chosen = digests.where(F.col("size") >= dedup_bytes).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = digests.join(chosen, "digest").select("page_id", "digest", "response").distinct()
    rows = known.join(revisits.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("digest", "response"))).alias("responses")), "page_id", "left")
    rows = rows.repartition(task_count(known, "html"), "page_id").sortWithinPartitions("page_id").select("page_id", "url", "html", "responses")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        out, name, n, size, before, seen = None, "", 0, 0, None, set()
        for batch in batches:
            for page, url, html, responses in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                payload = html.encode()
                digest = sha1(payload)
                if page != before:
                    before, seen = page, set()
                to = dict(responses or ()).get(digest)
                # of rows that repeat the response itself, the first stands
                refers_to = to if to is not None and (to != page or digest in seen) else None
                seen.add(digest)
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                data = record(page, url, payload, digest, refers_to)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["archive", "n_records"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["archive", "n_records"])

    return materialize(rows.mapInArrow(run, _MANIFEST), "manifest")


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def read_archives(spark: SparkSession, archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record of the archives (column archive), each archive read in sequence by one task; html is null without payloads."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def page(urn: str | None) -> int | None:
        return int(urn.removeprefix("<urn:page:").removesuffix(">")) if urn else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for fields, payload in records(stream):
                        kind = fields["warc-type"]
                        n = len(payload) if kind == "response" else int(fields["x-payload-length"])
                        html = payload.decode() if payloads and kind == "response" else None
                        rows.append((page(fields["warc-record-id"]), fields["warc-target-uri"], n, fields["warc-payload-digest"].removeprefix("sha1:"), kind, page(fields.get("warc-refers-to")), html))
                        size += len(payload) if payloads else 100
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.select("archive").repartition(parts, "archive").mapInArrow(run, _READ)


def op4(spark, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    manifest = write_archives(read_table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, manifest, folder, payloads=False).drop("url", "html")


ORACLE = """
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS top,
             (WITH bits AS (SELECT sha1(h) AS x)
              SELECT list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + CAST(list_reduce(list_transform(range(0, 5), lambda b: (strpos('0123456789abcdef', substr(x, 1 + CAST((k * 5 + b) // 4 AS INTEGER), 1)) - 1) // CAST(pow(2, 3 - (k * 5 + b) % 4) AS BIGINT) % 2), lambda s, v: 2 * s + v) AS INTEGER), 1)), 'string_agg', '') FROM bits) AS digest
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
"""
