"""Web archives without repeated payloads: records whose payload an other record holds become revisit records.

Headers (page_id, digest, length) are shuffled by payload digest, pre-aggregated to the largest page_id, which keeps the
payload; only the pages that revisit another are joined back to the payload rows. Each task then writes one WARC file
of gzip members, a record each, with fresh headers, and the archives are read back one file a task.

Defined results: a null html is an empty payload; a null page_id is always a response; rows that repeat the page_id and
payload of the response are responses too; a null url becomes ``urn:page:<page_id>``, control characters and blanks in a
url are percent-encoded; an empty table gives no archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, stage

#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace


def record_id(page_id, payload_digest: str) -> str:
    """One id a page and payload; rows that repeat both are one record written twice, and records without a page_id are
    never referred to."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'page:{page_id}:{payload_digest}') if page_id is not None else uuid.uuid4()}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean_url(url: str | None, page_id) -> str:
    if url is None:
        return f"urn:page:{page_id}"
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """One gzip member: a response with its payload, or a revisit with headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    own = digest(payload)
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, own)),
        ("WARC-Date", date),
        ("WARC-Target-URI", clean_url(url, page_id)),
        ("WARC-Payload-Digest", f"sha1:{own}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, own)), ("X-Refers-To-Page-Id", str(refers_to))]
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def records(stream):
    """(headers, block) of every record of an archive."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if line == b"\r\n":
                continue
            if line != VERSION:
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            head = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                k, _, v = line.decode().partition(":")
                head[k.lower()] = v.strip()
            yield head, f.read(int(head["content-length"]))


def resolve_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, digest (hex) and refers_to of the pages whose payload, of at least ``least`` bytes, a larger page_id holds."""
    html = F.coalesce(F.col("html"), F.lit(""))
    heads = pages.select("page_id", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n")).where(F.col("n") >= least)
    keeps = heads.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").select("digest", "refers_to")
    keeps = stage(keeps, "warc-originals")  # so that the join may split a digest that a third of the pages share
    return heads.join(keeps, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the pages (page_id, url, html) as archives; returns their manifest: path, records."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    revisits = stage(resolve_revisits(pages, least), "revisits").withColumnsRenamed({"page_id": "id", "digest": "d"})
    payload = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    marked = pages.withColumn("digest", payload).join(revisits, (F.col("page_id") == F.col("id")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "html", "refers_to")
    folder = new_path(pages.sparkSession, "warc")

    def write(batches):
        from pyarrow import fs

        out, n, path = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"  # a name of this attempt's own
        for batch in batches:
            if batch.num_rows and out is None:
                store, name = fs.FileSystem.from_uri(path)
                store.create_dir(name.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(name, compression=None)
            for i in range(batch.num_rows):
                page_id, url, html, refers_to = (c[i].as_py() for c in batch.columns)
                out.write(record(page_id, url, (html or "").encode(), refers_to, date))
            n += batch.num_rows
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    return stage(marked.mapInArrow(write, "path string, records long"), "warc-manifest")


def read_archives(files: DataFrame, payloads: bool = False) -> DataFrame:
    """A row a record of the manifest's archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to
    (and with ``payloads`` the payload, null for revisits). Responses whose payload differs from its digest are an error."""

    def read(batches):
        from pyarrow import fs

        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payloads else [])]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(name, compression=None) as f:
                    for head, block in records(f):
                        kind, own = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                        body = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
                        if body is not None and digest(body) != own:
                            raise ValueError(f"{path}: {head['warc-record-id']} is damaged")
                        num = lambda k: int(head[k]) if k in head else None
                        rows.append((num("x-page-id"), head["warc-target-uri"], num("x-payload-length"), own, kind, num("x-refers-to-page-id"), body))
                        size += len(block) if payloads else 0
                        if len(rows) >= 4096 or size > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t, _ in zip(zip(*rows), types, names)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t, _ in zip(zip(*rows), types, names)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return files.select("path").repartition(max(1, files.count())).mapInArrow(read, schema + (", payload binary" if payloads else ""))
