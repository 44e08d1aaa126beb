"""WARC archives written index first, then read back by coalesced byte ranges.

Records are written by the tasks that hold them, one gzip member a record, into the shared folder; a task begins a new
archive at ``ARCHIVE_BYTES`` or ``ARCHIVE_RECORDS``, puts each in place under a name of its own attempt before it lists its
records, and only files named by the saved index are ever read. The index
(file, offset, length, URL, digest, type) is a table, so a selection is a query on it; its byte ranges are sorted,
neighbours closer than ``gap`` are read at once, and a read never exceeds ``span`` bytes unless one record does.

Defined results: null payloads are empty and null URLs are written as an empty target; equal payloads of at least
``min_bytes`` are stored once, by the smallest id; rows that repeat an id each get a record; a row whose id repeats
the smallest id of its group is stored as a response too; a row with a null id is written under no number, always as a response,
and no revisit refers to it; an empty table writes no file and reads no row. Payloads that a large part of the table has are
joined apart from the others, and pages only move if their revisits are too many to broadcast.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, hot_from, joined_apart, shared_path, shuffle_partitions, small_batches

MIN_BYTES = 100
GAP, SPAN = 64 << 10, 8 << 20
ARCHIVE_BYTES, ARCHIVE_RECORDS = 1 << 30, 50_000
CRLF = b"\r\n"

INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _line(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def _urn(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"none" if page_id is None else b"%d" % page_id)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block, and names its payload by digest, length and referred record."""
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + _urn(page_id), ("WARC-Target-URI: " + _line(url)).encode("utf-8", "surrogatepass"), b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Payload-Digest: sha256:" + digest.encode(), b"X-Payload-Length: %d" % len(payload)]
    if refers_to is not None:
        head += [b"WARC-Refers-To: " + _urn(refers_to), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += [b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    return CRLF.join([*head, b"", payload]) + CRLF + CRLF


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.decode().lower(): v.decode("utf-8", "surrogatepass") for k, _, v in (x.partition(b": ") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != CRLF + CRLF:
        raise ValueError("record of another length than it says")
    return fields, rest[:n]


def _address(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES, archive_records: int = ARCHIVE_RECORDS, parts: int | None = None) -> DataFrame:
    """Writes a record per row and returns the saved index; rows stay where they are unless ``parts`` tasks are asked for."""
    rows = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    facts = rows.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").alias("n"))
    large = Saved(facts.where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest"), "payloads").df
    # who stores a payload that several rows have; groups of one never leave this aggregate
    owners = Saved(large.groupBy("digest").agg(F.min("page_id").alias("owner"), F.count("*").alias("c")).where("c > 1"), "owners").df
    hot = owners.where(F.col("c") >= hot_from(large.count()))
    same = joined_apart(large, owners, hot, ["digest"]).where(F.col("page_id") != F.col("owner")).select("page_id", "digest", F.col("owner").alias("refers_to"))
    same = Saved(same.distinct(), "revisits").df
    # a repeated id may have other payloads, which are no revisits
    marked = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).join(same, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    marked = marked.repartition(parts) if parts else marked
    names = ["page_id", "file", "offset", "length", "url", "digest", "record_type"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(folder)
        out: list[tuple] = []
        sink, at, name = None, 0, ""

        def done() -> pa.RecordBatch:
            """Puts the archive in place; its records are listed only then."""
            sink.close()
            fs.move(f"{top}/_{name}", f"{top}/{name}")
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for i in range(len(batch)):
                page_id, url, text, refers_to = (batch.column(c)[i].as_py() for c in range(4))
                payload = text.encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(payload).hexdigest()
                data = gzip.compress(record(page_id, url, payload, digest, refers_to), 5, mtime=0)
                if sink is not None and (at + len(data) > archive_bytes or len(out) >= archive_records):
                    yield done()
                    sink, out = None, []
                if sink is None:
                    fs.create_dir(top, recursive=True)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    sink = fs.open_output_stream(f"{top}/_{name}", compression=None)
                sink.write(data)
                out.append((page_id, f"{folder}/{name}", at, len(data), url, digest, "response" if refers_to is None else "revisit"))
                at += len(data)
        if sink is not None:
            yield done()

    return Saved(marked.mapInArrow(run, INDEX), "warc-index").df


def ranges(selected: list[tuple[int, int]], gap: int = GAP, span: int = SPAN) -> Iterator[list[tuple[int, int]]]:
    """Sorted (offset, length) pairs in groups that one read each covers."""
    group: list[tuple[int, int]] = []
    for offset, length in selected:
        if group and (offset - (group[-1][0] + group[-1][1]) > gap or offset + length - group[0][0] > span):
            yield group
            group = []
        group.append((offset, length))
    if group:
        yield group


def read_records(index: DataFrame, *, gap: int = GAP, span: int = SPAN, with_payload: bool = False) -> DataFrame:
    """The records that ``index`` rows select, checked against their digests."""
    spread = F.col("offset") - F.col("offset") % span  # so that one large archive is read by many tasks
    dealt = index.select("file", "offset", "length").repartition(shuffle_partitions(index.sparkSession), "file", spread).sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            by_file: dict[str, list[tuple[int, int]]] = {}
            for f, o, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                by_file.setdefault(f, []).append((o, n))
            for f, wanted in by_file.items():
                fs, base = file_system(f)
                with fs.open_input_file(base) as source:
                    for group in ranges(wanted, gap, span):
                        start = group[0][0]
                        data = source.read_at(group[-1][0] + group[-1][1] - start, start)
                        for o, n in group:
                            fields, payload = parse(zlib.decompress(data[o - start : o - start + n], 31))
                            digest, refers = fields["warc-payload-digest"].removeprefix("sha256:"), fields.get("warc-refers-to")
                            if refers is None and hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"damaged record in {f} at {o}")
                            size = len(payload) if refers is None else int(fields["x-payload-length"])
                            rows.append((_address(fields["warc-record-id"]), fields["warc-target-uri"], size, digest, fields["warc-type"], None if refers is None else _address(refers), payload if with_payload else None))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return dealt.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op10(pages: DataFrame) -> DataFrame:
    index = write_archives(pages, shared_path(pages.sparkSession, "warc"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
o AS (SELECT payload_digest, min(page_id) AS owner FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN o.owner IS NULL OR o.owner = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN o.owner <> d.page_id THEN o.owner END AS refers_to
FROM d LEFT JOIN o USING (payload_digest)
"""
