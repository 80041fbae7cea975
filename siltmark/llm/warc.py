"""WARC archives, index first (operator 2).

Writing: every task appends records, one gzip member each, to archives of its own in a shared folder and
returns an index row per record: file, offset, length, URL and digest.  A retried task writes another
file, and only rows of finished tasks reach the index, so leftovers of lost executors are never read.
Reading: index rows are selected and sorted by file and offset; neighbouring byte ranges are coalesced into
one read, and each record is parsed from its own range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.llm.sharing import read, shared_folder, stable, text_or_empty

ARCHIVE_BYTES = 256 << 20
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10
RECORD_DATE = "2024-01-01T00:00:00Z"

INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: every five hex digits are four base32 digits."""
    h = F.sha1(payload)
    quads = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    # fixed values: the base32 alphabet
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_record_types(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """``page_id, url, html, digest, record_type, refers_to``: of equal payloads of at least ``min_bytes``
    the largest id answers and the others revisit it.

    A null payload is empty.  A null id revisits if any id of its payload is known.  Rows that repeat the
    largest id are all responses.
    """
    html = text_or_empty(html_col)
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"),
                     base32_sha1(html).alias("digest"), F.octet_length(html).alias("bytes"))
    first = stable(p.groupBy("digest", "bytes").agg(F.max("page_id").alias("first_id")))
    same = F.coalesce(F.col("page_id") == F.col("first_id"), F.col("first_id").isNull()) | (F.col("bytes") < min_bytes)
    return p.join(first, ["digest", "bytes"]).select(
        "page_id", "url", "html", "digest", F.when(same, "response").otherwise("revisit").alias("record_type"),
        F.when(~same, F.col("first_id")).alias("refers_to"))


def one_line(text) -> str:
    return "".join(c if c.isprintable() else " " for c in text or "")


def record(row_id, url, payload: bytes, digest, kind, refers_to, refers_uri) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload but its length and digest."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(row_id))}>",
        f"WARC-Date: {RECORD_DATE}", f"WARC-Target-URI: {one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: text/html; charset=utf-8", f"X-Payload-Length: {len(payload)}",
    ]
    if row_id is not None:
        head.append(f"X-Page-ID: {row_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:uuid:{refers_uri}>", f"X-Refers-To-Page: {refers_to}"]
    body = b"" if kind == "revisit" else payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[:int(fields["Content-Length"])]


def file_system(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the records; the index comes back as a table that is cut from its lineage, so nothing is written twice."""

    def run(batches):
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        out, name, at = None, None, 0
        for b in batches:
            rows = b.to_pydict()
            index = []
            for i in range(b.num_rows):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                pid, refers = rows["page_id"][i], rows["refers_to"][i]
                raw = record(pid, rows["url"][i], (rows["html"][i] or "").encode(), rows["digest"][i], rows["record_type"][i],
                             refers, uuid.uuid5(uuid.NAMESPACE_OID, str(refers)))
                member = gzip.compress(raw, 1, mtime=0)
                out.write(member)
                index.append((pid, name, at, len(member), rows["url"][i], rows["digest"][i], rows["record_type"][i], refers))
                at += len(member)
            cols = list(zip(*index, strict=True)) if index else [[]] * 8
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             [f.split()[0] for f in INDEX.split(", ")])
        if out is not None:
            out.close()

    return stable(records.mapInArrow(run, INDEX))


def coalesced(spans: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, list[int]]]:
    """Reads (start, end, span numbers) that cover sorted spans (offset, length)."""
    out: list[list] = []
    for n, (offset, length) in enumerate(spans):
        end = offset + length
        if out and offset - out[-1][1] <= gap and end - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], end)
            out[-1][2].append(n)
        else:
            out.append([offset, end, [n]])
    return [tuple(x) for x in out]


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Records that the index rows name: ``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload``.

    Length and digest are those of the full payload; a response's are computed from what was read and
    must agree with its header, a revisit's come from its header and its payload is null.
    """
    shape = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
             "payload_digest string, payload binary")

    def run(batches):
        system, path = file_system(folder)
        for b in batches:
            rows = b.to_pandas().sort_values(["file", "offset"])
            for name, part in rows.groupby("file", sort=False):
                spans = list(zip(part["offset"].tolist(), part["length"].tolist(), strict=True))
                with system.open_input_file(f"{path}/{name}") as f:
                    for start, end, members in coalesced(spans):
                        block = f.read_at(end - start, start)
                        out = []
                        for n in members:
                            offset, length = spans[n]
                            fields, payload = parse_record(zlib.decompress(block[offset - start:offset - start + length], 31))
                            size, digest, kind = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                            if kind == "response":
                                found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                                if (found, len(payload)) != (digest, size):
                                    raise ValueError(f"damaged record at {name}:{offset}")
                            out.append((int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None, fields["WARC-Target-URI"], kind,
                                        int(fields["X-Refers-To-Page"]) if kind == "revisit" else None, size, digest,
                                        payload if kind == "response" else None))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)],
                            ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    parts = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return ranged.mapInArrow(run, shape)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archives back and report the records."""
    folder = shared_folder(spark, "warc")
    index = write_archives(with_record_types(read(spark, sf_dir, "pages")), folder)
    return read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, html, strlen(html) AS payload_bytes,
             list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + CAST((('0x' || substr(h, 1 + 5 * CAST(i // 4 AS INT), 5))::BIGINT >> CAST(5 * (3 - i % 4) AS INT)) & 31 AS INT), 1)), 'string_agg', '') AS payload_digest,
             max(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM q
"""
