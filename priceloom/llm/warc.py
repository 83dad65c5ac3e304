"""WARC archives: a writer and a sequential reader.

The writer puts each record into a gzip member of its own and packs members into archives
of bounded size.  A page whose payload an earlier page (by page_id) already has becomes a
revisit record that names the earlier one; its payload is not stored again.  The reader
goes through an archive from front to back in small pieces: it inflates one member after
the other, reads the header lines, takes as many content bytes as Content-Length says, and
verifies block and payload digests.

Executors write archives through Spark, as rows (archive, content) of a table in the shared
folder, so that any other executor can read them.

Defined cases: a NULL html is an empty payload; payloads of fewer bytes than ``min_bytes``
are never revisits; rows that repeat a page_id with the same payload are the same page and
get the same record type; a NULL page_id is after all others; line breaks in urls are
percent-encoded; NULL urls are left out of the record; an empty table gives no archive.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: A new archive begins when one holds this many bytes.
ARCHIVE_BYTES = 8 << 20
#: The reader inflates so many bytes at a time.
PIECE = 1 << 16
#: The format stamps records with the time of capture; the table has none.
DATE = "2000-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, refers_to) of the pages whose payload an earlier page has."""
    c = F.col
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    narrow = pages.select("page_id", F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("bytes"))
    narrow = narrow.filter(c("bytes") >= min_bytes)
    first = narrow.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("_top"), F.count("*").alias("_n"), F.count("page_id").alias("_ids"))
    first = first.filter((c("refers_to") != c("_top")) | ((c("_ids") > 0) & (c("_ids") < c("_n")))).select("sha1", "refers_to")
    again = narrow.join(first, "sha1").filter(~c("page_id").eqNullSafe(c("refers_to")))
    return again.select("page_id", "sha1", "refers_to").distinct()


def record(page_id, url, payload: bytes, refers_to=None) -> bytes:
    """One record as a gzip member."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if refers_to is not None else payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content) rows, written to the shared folder."""
    from ..session import materialize

    c = F.col
    again = materialize(revisits(pages, min_bytes), "revisits")
    held = pages.select("page_id", "url", "html", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("sha1"))
    held = held.join(again.withColumnsRenamed({"page_id": "_p", "sha1": "_s"}), c("page_id").eqNullSafe(c("_p")) & (c("sha1") == c("_s")), "left")
    held = held.select("page_id", "url", "html", "refers_to", F.spark_partition_id().alias("part"))

    def archives(batches: Iterator[pa.RecordBatch]):
        members, size, number, name = [], 0, 0, ""

        def done():
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(members)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for page, url, html, refers, part in zip(*(batch.column(x) for x in ("page_id", "url", "html", "refers_to", "part"))):
                name = f"pages-{part.as_py():06d}-{number:06d}.warc.gz"
                members.append(record(page.as_py(), url.as_py(), (html.as_py() or "").encode(), refers.as_py()))
                size += len(members[-1])
                if size >= archive_bytes:
                    yield done()
                    members, size, number = [], 0, number + 1
        if members:
            yield done()

    return materialize(held.mapInArrow(archives, "archive string, content binary"), "warc")


def inflated(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """(bytes, whether the member ends here) of concatenated gzip members, a piece at a time."""
    machine = zlib.decompressobj(zlib.MAX_WBITS | 16)
    begun = False
    for piece in pieces:
        while piece:
            begun = True
            out = machine.decompress(piece, PIECE)
            piece = machine.unused_data if machine.eof else machine.unconsumed_tail
            yield out, machine.eof
            if machine.eof:
                machine, begun = zlib.decompressobj(zlib.MAX_WBITS | 16), False
    if begun:
        raise ValueError("the archive ends inside a member")


def read_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record; a record must fill its member exactly."""
    held = bytearray()
    header, start, need = None, 0, 0
    for data, ended in inflated(pieces):
        held += data
        if header is None and (end := held.find(b"\r\n\r\n")) >= 0:
            lines = held[:end].decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a record: {lines[0][:40]}")
            header = dict(line.split(": ", 1) for line in lines[1:])
            start, need = end + 4, int(header["Content-Length"])
        if ended:
            if header is None or len(held) != start + need + 4 or held[start + need:] != b"\r\n\r\n":
                raise ValueError("Content-Length does not frame the record")
            yield header, bytes(held[start:start + need])
            held, header = bytearray(), None


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record: ids, type, digests, payload (NULL for revisits), and whether all digests agree."""
    def rows(batches):
        for batch in batches:
            for content in batch.column("content"):
                view = memoryview(content.as_buffer())
                pieces = (bytes(view[i:i + PIECE]) for i in range(0, len(view), PIECE))
                out = []
                for header, block in read_records(pieces):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, stored = header["WARC-Type"], header["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
                    sound = base32_sha1(block) == header["WARC-Block-Digest"].removeprefix("sha1:") and (
                        not payload if kind == "revisit" else base32_sha1(payload) == stored and len(payload) == size)
                    page, refers = (header.get(x, "").removeprefix("<urn:page:").removesuffix(">") for x in ("WARC-Record-ID", "WARC-Refers-To"))
                    out.append((int(page) if page != "None" else None, header.get("WARC-Target-URI"), kind, stored, size, int(refers) if refers else None,
                                payload if kind == "response" else None, sound))
                    if len(out) >= 256:
                        yield batch_of(out)
                        out = []
                if out:
                    yield batch_of(out)

    names = ("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload", "verified")
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=list(names))

    return archives.mapInArrow(rows, "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary, verified boolean")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back; a record that fails verification stops the query."""
    records = read_archives(write_archives(table(spark, sf_dir, "pages")))
    checked = F.when(F.col("verified"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record failed its digest")))
    return records.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


OP7_SQL = """WITH p AS (SELECT page_id, sha1(coalesce(html,'')) AS h, CAST(strlen(coalesce(html,'')) AS BIGINT) AS payload_bytes FROM pages),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p),
 x AS (SELECT *, [('0x'||substr(h, i, 1))::BIGINT FOR i IN range(1, 41)] AS d FROM f)
SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((((d[(5*i)//4+1]*16 + d[(5*i)//4+2]) >> (3 - (5*i)%4)) & 31) + 1 AS INTEGER), 1) FOR i IN range(0, 32)], '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM x"""
