"""WARC archives with an index written beside them, and coalesced byte-range reads of selected records.

Every record is a gzip member of its own, so any record can be read from (archive, offset, length) alone. Tasks write
archives of bounded size under names of their own; the index, committed by Spark, is the only list of valid archives, so
files of lost or repeated attempts are never read. Reading sorts the chosen index rows by archive and offset and merges
neighbours into one range request.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.shared import cut, shared_path

ARCHIVE_BYTES = 64 << 20  # an archive is closed once it holds this much
READ_BYTES = 8 << 20  # a merged range is at most this long (or one record)
GAP_BYTES = 64 << 10  # neighbours nearer than this are read in one request
MIN_REVISIT_BYTES = 1000

INDEX_FIELDS = "page_id bigint, url string, archive string, offset bigint, length bigint, digest string, record_type string, refers_to bigint"
RECORD_FIELDS = "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload string"


def open_fs(uri: str):
    """(filesystem, path) of a Hadoop-style URI, for tasks that read and write byte ranges."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with the page, or a revisit that has the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record; a response's payload is hashed again and must match its digest header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']}: the payload does not match its digest")

    def number(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "record_type": kind,
        "refers_to": number(fields.get("WARC-Refers-To")),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, refers_to): rows of large equal payloads refer to the row with the largest id.

    Null html is empty. Rows without an id, and rows that repeat the largest id itself, get a response of their own
    unless another row with a larger id exists. The largest ids come from a partial aggregate of the digests alone; the
    join back on the digest is one that AQE can split when a digest is hot.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n"))
    keep = cut(large.where("n > 1 AND keep IS NOT NULL").select("digest", "keep"), "warc-groups")
    joined = rows.join(keep, "digest", "left")
    refers = F.when(F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archives(marked: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``marked`` and return the index of what was written (fields: INDEX_FIELDS)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(folder)
        store.create_dir(root, recursive=True)
        out = name = None
        offset = 0
        for batch in batches:
            index = []
            for row in batch.to_pylist():
                if out is None:
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                raw = record_bytes(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["refers_to"])
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                kind = "revisit" if row["refers_to"] is not None else "response"
                index.append((row["page_id"], row["url"], name, offset, len(member), row["digest"], kind, row["refers_to"]))
                offset += len(member)
                if offset >= archive_bytes:
                    out.close()
                    out = None
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), types, strict=True)], names)
        if out is not None:
            out.close()

    names = [x.split()[0] for x in INDEX_FIELDS.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in INDEX_FIELDS.split(", ")]
    return cut(marked.mapInArrow(write, INDEX_FIELDS), "warc-index")


def read_records(index: DataFrame, folder: str, payloads: bool = True, gap: int = GAP_BYTES, most: int = READ_BYTES) -> DataFrame:
    """The records that the index rows name (fields: RECORD_FIELDS), read by merged byte ranges."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_fs(folder)
        files: dict = {}

        def ranges():
            """Runs of index rows of one archive that lie close together, in order."""
            run: list[tuple[str, int, int]] = []
            for batch in batches:
                columns = [batch.column(i).to_pylist() for i in range(3)]
                for archive, offset, length in zip(*columns, strict=True):
                    if run and (archive != run[0][0] or offset - (run[-1][1] + run[-1][2]) > gap or offset + length - run[0][1] > most):
                        yield run
                        run = []
                    run.append((archive, offset, length))
            if run:
                yield run

        for run in ranges():
            archive, first, _ = run[0]
            if archive not in files:
                for old in files.values():
                    old.close()
                files = {archive: store.open_input_file(f"{root}/{archive}")}
            raw = files[archive].read_at(run[-1][1] + run[-1][2] - first, first)
            records = [parse_record(zlib.decompress(raw[o - first : o - first + n], 31)) for _, o, n in run]
            for r in records:
                r["payload"] = r["payload"].decode() if payloads and r["payload"] is not None else None
            yield pa.RecordBatch.from_pylist(records, schema)
        for old in files.values():
            old.close()

    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in RECORD_FIELDS.split(", "))])
    n = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = index.select("archive", "offset", "length").repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(read, RECORD_FIELDS)


def archive_pages(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Archive a table of pages; returns (index, folder).

    One record per row. Null html is an empty payload, a null url leaves out the target URI, a null id leaves the
    record's id empty, repeated rows get records of their own, and an empty table gives an empty index. Columns other
    than page_id, url and html are not read.
    """
    folder = folder or shared_path(pages.sparkSession, "warc")
    return write_archives(mark_revisits(pages), folder), folder
