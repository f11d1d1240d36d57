"""WARC archives with an index that is there before anything is read.

Writing: every page becomes one gzip member, so that a record can be read on its own. Each task
streams its pages to one archive in the shared folder and returns, for each record, path, offset,
length, URL and digest: the index, written as Parquet by the same job. An archive counts only if
the index names it; a task that is run again writes under a new name, so what a lost executor
leaves behind is never read. Of pages with equal payloads one is a ``response`` and the others are
``revisit`` records, which refer to it and carry no payload.

Reading: the index is filtered and sorted; entries that lie close together in one archive are
fetched with one ranged read.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.llm.common import batches_of, filled, numbered, small_batches, stored

INDEX = ("page_id long, url string, path string, offset long, length long, payload_bytes long, "
         "payload_digest string, record_type string, refers_to long")
CRLF = b"\r\n"


def base32_sha1(name: str) -> Column:
    """Bare upper-case base32 of the SHA-1 of a text in UTF-8: 20 bits at a time."""
    digest = F.sha1(filled(name))
    groups = [
        F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, html: str, page_id: str, url: str, min_bytes: int
                  ) -> tuple[DataFrame, DataFrame]:
    """The digests of pages with a number ``__row``, and the first of each group of equals. Only digests are grouped; equal
    SHA-1 counts as equal only with equal SHA-256 and size."""
    rows = pages.select(
        "__row",
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        base32_sha1(html).alias("payload_digest"),
        F.octet_length(filled(html)).cast("long").alias("payload_bytes"),
        F.unhex(F.sha2(filled(html), 256)).alias("__sha"),
    )
    return rows, rows.where(F.col("payload_bytes") >= min_bytes).groupBy(
        "__sha", "payload_bytes"
    ).agg(
        F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "__row"))
        .alias("__first"), F.count("*").alias("__n"),
    ).where("__n > 1").select("__sha", "payload_bytes", "__first")


def _header(kind: str, fields: list[tuple[str, object]], body: bytes) -> bytes:
    lines = [b"WARC/1.1", f"WARC-Type: {kind}".encode()]
    for name, value in fields:
        # A line break in a URL must not end the header.
        lines.append(f"{name}: {re.sub(r'[\r\n]', lambda m: f'%{ord(m[0]):02X}', str(value))}"
                     .encode())
    lines.append(f"Content-Length: {len(body)}".encode())
    return CRLF.join(lines) + CRLF * 2 + body + CRLF * 2


def record(row: dict) -> bytes:
    """A page as one WARC record, in a gzip member of its own."""
    fields = [
        ("WARC-Record-ID", f"<urn:page:{_shown(row['page_id'])}>"),
        ("WARC-Target-URI", row["url"] or ""),
        ("WARC-Date", "1970-01-01T00:00:00Z"),  # the pages carry no date
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
        ("X-Payload-Bytes", row["payload_bytes"]),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if row["revisit"]:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:page:{_shown(row['refers_to'])}>"),
        ]
    body = b"" if row["revisit"] else row["html"].encode()
    return gzip.compress(_header("revisit" if row["revisit"] else "response", fields, body), 6,
                         mtime=0)


def _shown(number: int | None) -> str:
    return "unknown" if number is None else str(number)


def _numbered(shown: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", shown)
    return int(found[1]) if found else None


def filesystem(uri: str):
    """The file system of a URI and the path on it; tasks use it, so it must be a shared one."""
    from pyarrow import fs

    if uri.startswith("file:"):  # also file:/x, which is not a proper URI
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def write_archives(
    pages: DataFrame,
    folder: str,
    html: str = "html",
    page_id: str = "page_id",
    url: str = "url",
    min_bytes: int = 0,
) -> DataFrame:
    """Write a record per row of ``pages`` below ``folder`` and return the index (``INDEX``).

    Null html counts as empty; with ``min_bytes`` 0 empty pages are a group of equals too. Of equal
    payloads of at least ``min_bytes`` bytes the row with the largest page_id is the response
    (a null page_id only if there is no other; of repeated rows, the last in the scan), the others
    are revisits. An empty table gives an empty index; other columns are not looked at.
    """
    small_batches(pages.sparkSession)
    pages = numbered(pages.select(*dict.fromkeys([html, page_id, url])))
    rows, groups = with_revisits(pages, html, page_id, url, min_bytes)
    groups = stored(groups, "equal-pages")  # the join with it can then split a large group
    # Only pages that refer to another one pass a join; it is on digests, not on texts.
    known = rows.join(groups, ["__sha", "payload_bytes"]).where(
        "__row <> __first.__row"
    ).select("__row", F.col("__first.page_id").alias("refers_to"), F.lit(True).alias("revisit"))
    full = pages.select(
        "__row",
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        filled(html).alias("html"), base32_sha1(html).alias("payload_digest"),
        F.octet_length(filled(html)).cast("long").alias("payload_bytes"),
    ).join(known, "__row", "left").select(
        "page_id", "url", "payload_digest", "payload_bytes", "refers_to",
        F.coalesce("revisit", F.lit(False)).alias("revisit"),
        F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")).alias("html"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        path, out, at = None, None, 0
        try:
            for batch in batches_of(batches, 500):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    system.create_dir(base)
                    path, out = f"{folder}/{name}", system.open_output_stream(
                        f"{base}/{name}", compression=None)
                found = []
                for row in batch.to_pylist():
                    data = record(row)
                    out.write(data)
                    found.append({
                        "page_id": row["page_id"], "url": row["url"], "path": path, "offset": at,
                        "length": len(data), "payload_bytes": row["payload_bytes"],
                        "payload_digest": row["payload_digest"],
                        "record_type": "revisit" if row["revisit"] else "response",
                        "refers_to": row["refers_to"] if row["revisit"] else None,
                    })
                    at += len(data)
                yield _table(found)
        finally:
            if out is not None:
                out.close()

    return stored(full.mapInArrow(write, INDEX), "warc-index")


_ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("path", pa.string()),
    ("offset", pa.int64()), ("length", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])
_READ = pa.schema([*list(_ARROW)[:2], *list(_ARROW)[5:], pa.field("html", pa.string())])
RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, "
           "record_type string, refers_to long, html string")


def _table(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def parsed(data: bytes) -> dict:
    """A record's fields and payload, all from the archive's own bytes."""
    head, _, body = gzip.decompress(data).partition(CRLF * 2)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if len(body) != n + 4 or body[n:] != CRLF * 2:
        raise ValueError(f"a record is {len(body) - 4} bytes long; its header says {n}")
    kind = fields["WARC-Type"]
    return {
        "page_id": _numbered(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"],
        "payload_bytes": n if kind == "response" else int(fields["X-Payload-Bytes"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": kind,
        "refers_to": _numbered(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "html": body[:n].decode() if kind == "response" else None,
    }


def read_records(
    spark: SparkSession, index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20,
    ranges: int = 512,
) -> DataFrame:
    """The records that ``index`` names (``RECORDS``), read back from their archives. Entries less
    than ``gap`` bytes apart share a ranged read of at most ``most`` bytes (or one record)."""
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, object] | None = None
        for batch in batches_of(batches, ranges):
            entries = list(zip(*(batch.column(c).to_pylist() for c in ("path", "offset",
                                                                       "length"))))
            at = 0
            while at < len(entries):
                path, start, length = entries[at]
                end, last = start + length, at + 1
                while (last < len(entries) and entries[last][0] == path
                       and 0 <= entries[last][1] - end <= gap
                       and entries[last][1] + entries[last][2] - start <= most):
                    end = entries[last][1] + entries[last][2]
                    last += 1
                if opened is None or opened[0] != path:
                    if opened:
                        opened[1].close()
                    system, name = filesystem(path)
                    opened = path, system.open_input_file(name)
                data = opened[1].read_at(end - start, start)
                yield pa.RecordBatch.from_pylist(
                    [parsed(data[o - start:o - start + n]) for _, o, n in entries[at:last]],
                    schema=_READ)
                at = last
        if opened:
            opened[1].close()

    sorted_index = index.select("path", "offset", "length").repartitionByRange(
        "path", "offset").sortWithinPartitions("path", "offset")
    return sorted_index.mapInArrow(fetch, RECORDS)
