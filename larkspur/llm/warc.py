"""WARC archives: written with an index first, read back by coalesced byte ranges.

Each task writes one archive of gzip members, one per record, and returns the
index rows (page, archive, offset, length, URL, digest). The index is what the
reader works from: it selects records, sorts them by place and joins neighbours
into one read. A task that is run again writes a new archive; only archives that
the index names are ever read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep_table, prepare, shared_folder

#: Payloads below this many bytes are always stored.
REVISIT_BYTES = 100
#: Records at most this far apart are read at once, up to so many bytes.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: One reading task covers this much of an archive.
SPAN_BYTES = 32 << 20
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
INDEX = "archive string, offset long, length long, page_id string, url string, digest string, payload_bytes long, record_type string, refers_to string"


def _filesystem(folder: str):
    return pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)


def _escaped(text: str) -> str:
    """Without white space and control characters, which would end a header's line."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", text.replace("%", "%25"))


def _record_id(page: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def _record(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {_record_id(page, digest)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page is not None:
        head.append(f"X-Page-Id: {_escaped(page)}")
    body = payload
    if refers_to is not None:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {_escaped(refers_to)}"]
        body = b""
    head += [f"X-Payload-Length: {len(payload)}", "Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, *, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a record; the index, as a kept table.

    Of equal payloads of at least ``revisit_bytes`` the smallest page_id is the
    response, the others revisit it; rows without page_id, and rows that repeat
    that smallest page_id, are responses. Null html is an empty payload, a null
    url gives no target header.
    """
    prepare(pages.sparkSession)
    source = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    source = source.withColumn("digest", F.sha2(F.col("html"), 256)).withColumn("size", F.octet_length("html"))
    first = source.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("rows"))
    # read back, so that Spark sends a small table to every task, and can split a hot digest's pages where it is large
    first = keep_table(first.where("rows > 1 and first_id is not null").drop("rows"), "repeated-payloads")
    records = source.join(first, "digest", "left").select(
        F.col("page_id").cast("string").alias("page_id"),
        "url",
        "html",
        "digest",
        F.when(F.col("first_id") < F.col("page_id"), F.col("first_id")).cast("string").alias("refers_to"),
    )

    def run(batches):
        fs, base = _filesystem(folder)
        out = path = None
        at = 0
        try:
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        path = f"{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{base}/{path}", compression=None)
                    payload = row["html"].encode("utf-8")
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = packer.compress(_record(row["page_id"], row["url"], payload, row["digest"], row["refers_to"])) + packer.flush()
                    out.write(data)
                    kind = "response" if row["refers_to"] is None else "revisit"
                    rows.append((path, at, len(data), row["page_id"], row["url"], row["digest"], len(payload), kind, row["refers_to"]))
                    at += len(data)
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3, pa.int64(), *[pa.string()] * 2]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return keep_table(records.mapInArrow(run, INDEX), "warc-index")


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    raw = zlib.decompress(data, 31)
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    return fields, body[: int(fields["Content-Length"])]


def read_archives(index: DataFrame, folder: str, *, with_payload: bool = False) -> DataFrame:
    """Read the records that ``index`` selects: page_id (text), payload_bytes, payload_digest, record_type, refers_to.

    Digest and length of a response come from the payload that was read; those
    of a revisit from its header. A record that isn't what its index row says,
    or whose payload doesn't match its digest, is an error.
    """
    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", url string, payload binary" * with_payload
    places = index.select("archive", "offset", "length", "digest", F.expr(f"offset div {SPAN_BYTES}").alias("span"))
    places = places.repartition("archive", "span").sortWithinPartitions("archive", "offset")

    def rows_of(fs, base, group):
        with fs.open_input_file(f"{base}/{group[0][0]}") as f:
            start = group[0][1]
            block = f.read_at(group[-1][1] + group[-1][2] - start, start)
        for _, offset, length, digest in group:
            fields, body = _parse(block[offset - start : offset - start + length])
            stored = fields["WARC-Payload-Digest"].removeprefix("sha256:")
            if fields["WARC-Type"] == "response":
                size, found = len(body), hashlib.sha256(body).hexdigest()
            else:
                size, found = int(fields["X-Payload-Length"]), stored
            if not digest == stored == found:
                raise ValueError(f"{group[0][0]} at {offset}: payload does not match its digest")
            page, refers_to = (unquote(fields[k]) if k in fields else None for k in ("X-Page-Id", "X-Refers-To-Page"))
            row = (page, size, found, fields["WARC-Type"], refers_to)
            yield (*row, fields.get("WARC-Target-URI"), body) if with_payload else row

    def run(batches):
        fs, base = _filesystem(folder)
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 3] + [pa.string(), pa.binary()] * with_payload
        names = [f.split()[0] for f in schema.split(", ")]

        def batch_of(group):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows_of(fs, base, group), strict=True), kinds, strict=True)], names=names)

        group: list[tuple] = []
        for batch in batches:
            for place in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if group:
                    end = group[-1][1] + group[-1][2]
                    if place[0] != group[0][0] or place[1] - end > GAP_BYTES or place[1] + place[2] - group[0][1] > READ_BYTES:
                        yield batch_of(group)
                        group = []
                group.append(place)
        if group:
            yield batch_of(group)

    return places.mapInArrow(run, schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read all of them back: one row per input row."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    kind = pages.schema["page_id"].dataType
    back = read_archives(write_archives(pages, folder), folder)
    return back.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
