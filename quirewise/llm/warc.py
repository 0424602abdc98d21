"""WARC archives: writing, reading, and resolving equal payloads into revisit records.

Archives are written by tasks to the shared folder, one gzip member for each record, each file of bounded size. A task
writes under names of its own and returns one row for each record; only what a finished task returned is ever read, so a
lost or repeated task leaves at most files that nothing points to.

Deduplication never shuffles payloads. The headers are shuffled by payload digest, the smallest page of each
digest (of a payload of at least ``least`` bytes) stays a response, the others become revisits of it. Then every archive is
read once more and rewritten with fresh headers and without the bodies of revisits.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, new_path

ARCHIVE_BYTES = 32 << 20
#: Tasks of a stage up to which an archive is a task of its own, and archives of a task beyond.
MOST_TASKS, ARCHIVES_A_TASK = 20_000, 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "archive string, at long, size long, record_id string, page_id long, payload_bytes long, payload_digest string"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    """One WARC/1.1 record. Values are percent-encoded where they hold control or non-ASCII characters; None is left out."""
    lines = [f"{k}: {quote(v, safe=_PRINTABLE)}" for k, v in fields.items() if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_PRINTABLE = "".join(chr(c) for c in range(0x21, 0x7F))


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    end = data.index(b"\r\n\r\n")
    version, *lines = data[:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    return fields, data[end + 4 : end + 4 + int(fields["Content-Length"])]


def http_response(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


class ArchiveWriter:
    """Gzip members into files of about ``limit`` bytes under one folder."""

    def __init__(self, folder: str, limit: int = ARCHIVE_BYTES):
        self.limit = limit
        self.files, self.root = pafs.FileSystem.from_uri(folder)
        self.folder, self.out = folder, None
        self.files.create_dir(self.root, recursive=True)

    def write(self, data: bytes) -> tuple[str, int, int]:
        """Append a record; its archive, position and compressed size."""
        if self.out is None or self.at >= self.limit:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.files.open_output_stream(f"{self.root}/{self.name}", compression=None)
        packer = zlib.compressobj(1, wbits=31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        at, self.at = self.at, self.at + len(member)
        return f"{self.folder}/{self.name}", at, len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def read_members(archive: str) -> Iterator[tuple[int, int, bytes]]:
    """(position, compressed size, record) of each gzip member, one record in memory at a time."""
    files, path = pafs.FileSystem.from_uri(archive)
    with files.open_input_stream(path, compression=None) as source:
        at, rest = 0, b""
        while True:
            unpack, parts, used = zlib.decompressobj(wbits=31), [], 0
            while not unpack.eof:
                chunk = rest or source.read(1 << 20)
                if not chunk:
                    if used:
                        raise ValueError(f"{archive} ends inside a record")
                    return
                parts.append(unpack.decompress(chunk))
                rest = unpack.unused_data
                used += len(chunk) - len(rest)
            yield at, used, b"".join(parts)
            at += used


def write_pages(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a response record for each row of ``pages`` (page_id, url, html) and return HEADERS, one row a record.

    The payload is the html in UTF-8, empty for null. A null url is left out of the record.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder, archive_bytes)
        for batch in it:
            rows = []
            for page, url, html in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html")), strict=True):
                payload = (html or "").encode()
                name, digest = uuid.uuid4().urn, payload_digest(payload)
                fields = {
                    "WARC-Type": "response", "WARC-Record-ID": f"<{name}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": url,
                    "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response",
                    "X-Page-Id": None if page is None else str(page),
                }
                rows.append((*writer.write(record(fields, http_response(len(payload)) + payload)), name, page, len(payload), digest))
            yield _rows(rows, HEADERS)
        writer.close()

    return materialize(pages.select("page_id", "url", "html").mapInArrow(run, HEADERS), "warc-headers")


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in schema.split(",")]
    kinds = {"string": pa.string(), "long": pa.int64()}
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def resolve(headers: DataFrame, least: int = 0) -> DataFrame:
    """HEADERS and, for a record that revisits another, that one's record and page: to_record, to_page.

    Of the records of one digest the smallest (page, record) stays a response; a null page comes last.
    """
    place = F.struct(F.col("page_id").isNull().alias("no_page"), "page_id", "record_id")
    first = (
        headers.filter(F.col("payload_bytes") >= least).groupBy("payload_digest")
        .agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
        .select("payload_digest", F.col("first.record_id").alias("to_record"), F.col("first.page_id").alias("to_page"))
    )
    other = (F.col("to_record") != F.col("record_id")) & (F.col("payload_bytes") >= least)
    return headers.join(first, "payload_digest", "left").withColumns(
        {"to_record": F.when(other, F.col("to_record")), "to_page": F.when(other, F.col("to_page"))}
    )


def rewrite(resolved: DataFrame, folder: str) -> DataFrame:
    """Write every archive of ``resolved`` anew, revisits without their bodies; returns (archive) of the new files."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        to = {(a, r.at): (r.to_record, r.to_page) for a, r in zip(frame["archive"], frame.itertuples(), strict=True)}
        writer, made = ArchiveWriter(folder), set()
        for archive in sorted(frame["archive"].unique()):
            for at, _, data in read_members(archive):
                if (archive, at) not in to:
                    continue
                record_to, page_to = to[archive, at]
                fields, block = parse_record(data)
                del fields["Content-Length"]
                if record_to is not None:
                    page = None if pd.isna(page_to) else str(int(page_to))
                    fields |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": f"<{record_to}>", "X-Refers-To-Page": page}
                    block = block[: block.index(b"\r\n\r\n") + 4]
                made.add(writer.write(record(fields, block))[0])
        writer.close()
        return pd.DataFrame({"archive": sorted(made)})

    decided = resolved.select("archive", "at", "to_record", "to_page")
    return materialize(_each_archive(decided).groupBy("archive").applyInPandas(run, "archive string"), "warc-archives").distinct()


def _each_archive(rows: DataFrame) -> DataFrame:
    """Rows dealt by archive: much work for little data, so none are merged, and of very many a task works through several."""
    archives = rows.select("archive").distinct().count()
    return rows.repartition(max(1, archives if archives <= MOST_TASKS else max(MOST_TASKS, archives // ARCHIVES_A_TASK)), "archive")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row for each record: its ids, type, payload_bytes and payload_digest of its own payload (null for revisits)."""
    schema = "record_id string, page_id long, record_type string, payload_bytes long, payload_digest string, to_record string, to_page long"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for archive in batch["archive"].to_pylist():
                rows = []
                for _, _, data in read_members(archive):
                    fields, block = parse_record(data)
                    kind, page, to = fields["WARC-Type"], fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
                    size = digest = None
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        size, digest = len(payload), payload_digest(payload)
                        if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
                            raise ValueError(f"damaged payload in {archive}")
                    rows.append(
                        (fields["WARC-Record-ID"][1:-1], page and int(page), kind, size, digest, fields.get("WARC-Refers-To", "")[1:-1] or None, to and int(to))
                    )
                    if len(rows) == 4096:
                        yield _rows(rows, schema)
                        rows = []
                yield _rows(rows, schema)

    return _each_archive(archives).mapInArrow(run, schema)


def read_resolved(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits with what their response holds."""
    records = materialize(read_archives(archives), "warc-records")
    origin = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("to_record"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest")
    )
    # only revisits are joined: responses refer to nothing, and their null keys would all meet in one partition
    revisits = records.filter("to_record is not null").join(origin, "to_record", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", F.col("to_page").alias("refers_to")]
    full = revisits.withColumns({"payload_bytes": F.col("full_bytes"), "payload_digest": F.col("full_digest")})
    return records.filter("to_record is null").select(columns).unionByName(full.select(columns))


def op2(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as WARC, deduplicate the archives, and read them back."""
    headers = write_pages(pages, new_path(pages.sparkSession, "warc"))
    return read_resolved(rewrite(resolve(headers), new_path(pages.sparkSession, "warc-dedup")))
