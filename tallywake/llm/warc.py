"""WARC archives of captures: written by tasks, read back record by record, and joined into transactions.

A capture is a request, a response (or a revisit, which names an earlier response
with the same payload) and a metadata record. The latter two name the capture's
main record in WARC-Concurrent-To, and that is what joins them again.
"""

from __future__ import annotations

import base64
import gzip
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywake.llm.storage import new_folder, reach_workers, stored

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: Compressed bytes after which a task begins another file, and bytes of a batch of records that were read.
FILE_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAIN = ("response", "revisit", "resource", "conversion")
#: The date of captures that bring none.
NO_DATE = "1970-01-01T00:00:00Z"


def _line(value: str) -> str:
    """A header value in one line: control characters, and blanks at its ends, are percent-encoded."""
    value = re.sub(r"[\x00-\x1f\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)
    return re.sub(r"^ +| +$", lambda m: "%20" * len(m[0]), value)


def _record(kind: str, record_id: str, uri: str | None, date: str, content_type: str, block: bytes, more: list[tuple[str, str]]) -> bytes:
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", _line(uri))] if uri else []
    headers += [*more, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    """The record as a gzip member of its own, without a time, so that equal records are equal bytes."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


def transaction(main_id: str, page_id: int | None, uri: str | None, date: str, payload: bytes, digest: str, size: int, refers_to: tuple[str, str | None] | None) -> list[tuple[str, bytes]]:
    """(type, record) of a capture: main record, request and metadata. ``refers_to``: id and URI of a revisit's response."""
    stated = f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"
    target = uri or f"urn:page:{'' if page_id is None else page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    more = [("WARC-Payload-Digest", stated)]
    if refers_to is None:
        main = _record("response", main_id, target, date, "application/http; msgtype=response", http + payload, more)
    else:
        more += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to[0]}>")]
        more += [("WARC-Refers-To-Target-URI", _line(refers_to[1]))] if refers_to[1] else []
        main = _record("revisit", main_id, target, date, "application/http; msgtype=response", http, more)
    concurrent = [("WARC-Concurrent-To", f"<{main_id}>")]
    host, path = re.fullmatch(r"(?:[a-z][a-z0-9+.-]*://([^/?#]*))?(.*)", _line(target), re.S | re.I).groups()
    request = f"GET {path or '/'} HTTP/1.1\r\nHost: {host or ''}\r\n\r\n".encode()
    about = "".join(f"{k}: {v}\r\n" for k, v in (("page-id", page_id), ("url", None if uri is None else _line(uri))) if v is not None).encode()
    return [
        ("revisit" if refers_to else "response", main),
        ("request", _record("request", f"urn:uuid:{uuid.uuid4()}", target, date, "application/http; msgtype=request", request, concurrent)),
        ("metadata", _record("metadata", f"urn:uuid:{uuid.uuid4()}", target, date, "application/warc-fields", about, concurrent)),
    ]


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path, re.I) else (fs.LocalFileSystem(), path)


_WRITTEN = "page_id long, digest string, uri string, record_id string, path string"


def write_captures(captures: DataFrame, folder: str) -> DataFrame:
    """Write captures (page_id, uri, date, payload binary, digest, size, target_id, target_uri) as ``.warc.gz`` files.

    Every record is a gzip member. A task names its files by a new identifier, so
    an attempt that is lost or repeated leaves files that nothing names: the
    returned table, which is written when the tasks are done, lists what counts
    (page_id, digest, uri, record_id of the main record, path). Captures with a
    target_id become revisits of that record.
    """
    reach_workers(captures.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _filesystem(folder)
        store.create_dir(at, recursive=True)
        out, name, size = None, "", 0
        try:
            for batch in batches:
                done = []
                for i in range(batch.num_rows):
                    page_id, uri, date, payload, digest, n, target_id, target_uri = (c[i].as_py() for c in batch.columns)
                    if out is None or size >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{at}/{name}", compression=None)
                        head = _record("warcinfo", f"urn:uuid:{uuid.uuid4()}", None, NO_DATE, "application/warc-fields", b"format: WARC File Format 1.1\r\n", [("WARC-Filename", name)])
                        size += out.write(_member(head))
                    main_id = f"urn:uuid:{uuid.uuid4()}"
                    for _, record in transaction(main_id, page_id, uri, date or NO_DATE, payload or b"", digest, n, (target_id, target_uri) if target_id else None):
                        size += out.write(_member(record))
                    done.append((page_id, digest, uri, main_id, f"{folder}/{name}"))
                columns = list(zip(*done)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.string()) for k, c in enumerate(columns)], names=["page_id", "digest", "uri", "record_id", "path"])
        finally:
            if out is not None:
                out.close()

    rows = captures.select("page_id", "uri", "date", "payload", "digest", "size", "target_id", "target_uri")
    return stored(rows.mapInArrow(run, _WRITTEN), "captures")


@dataclass
class Record:
    headers: dict[str, list[str]]
    block: bytes
    at: int = field(default=0)

    def first(self, name: str) -> str | None:
        return self.headers.get(name, [None])[0]

    def link(self, name: str) -> str | None:
        value = self.first(name)
        return None if value is None else value.strip().removeprefix("<").removesuffix(">")


def records(stream, name: str = "") -> Iterator[Record]:
    """Records of an archive, compressed or not, one after the other; only one is held.

    Content-Length tells where a block ends, so a block may hold anything, whole
    records included. A block or header that ends early is an error that names the file.
    """
    number = 0
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: record {number} begins with {line[:40]!r}")
        headers: dict[str, list[str]] = {}
        last = None
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError(f"{name}: record {number} ends in its header")
            if line[:1] in b" \t" and last:
                headers[last][-1] += " " + line.decode("utf-8", "replace").strip()
                continue
            key, _, value = line.decode("utf-8", "replace").partition(":")
            last = key.strip().lower()
            headers.setdefault(last, []).append(value.strip())
        length = int(headers.get("content-length", ["0"])[0])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"{name}: record {number} ends {length - len(block)} bytes early")
        yield Record(headers, block, number)
        number += 1


def _open(path: str):
    store, at = _filesystem(path)
    with store.open_input_file(at) as head:
        packed = head.read(2) == b"\x1f\x8b"
    raw = store.open_input_stream(at, compression=None, buffer_size=1 << 20)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if packed else raw, 1 << 18)


_RECORDS = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("path", "record_id", "type", "concurrent_to", "refers_to", "uri", "date", "declared_digest", "http_head")],
        T.StructField("payload", T.BinaryType()),
        T.StructField("at", T.LongType()),
    ]
)


def read_records(paths: DataFrame, files: int | None = None) -> DataFrame:
    """The records of the archives that ``paths`` (a string column ``path``) names, in tasks of one file.

    Columns: path, at (number of the record in its file), record_id, type,
    concurrent_to, refers_to, uri, date, declared_digest, http_head and payload. Of
    a block that is an HTTP message, http_head is what comes before the body, and
    payload the body; else payload is the block. Files are read as a stream, so
    their size does not matter. Repeated paths are read once.
    """
    reach_workers(paths.sparkSession)
    named = paths.select("path").where("path is not null").distinct()
    count = files or max(1, named.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(_RECORDS)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with _open(path) as stream:
                    for r in records(stream, path):
                        head, payload = None, r.block
                        if (r.first("content-type") or "").startswith("application/http"):
                            before, gap, payload = r.block.partition(b"\r\n\r\n")
                            head = (before + gap).decode("latin-1")
                        rows.append((path, r.link("warc-record-id"), r.first("warc-type"), r.link("warc-concurrent-to"), r.link("warc-refers-to"), r.first("warc-target-uri"), r.first("warc-date"), r.first("warc-payload-digest"), head, payload, r.at))
                        size += len(r.block) + 512
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return named.repartition(count, "path").mapInArrow(run, _RECORDS)


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """path of every ``.warc`` and ``.warc.gz`` file below a folder that Spark can list."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return found.where(F.lower("path").rlike(r"\.warc(\.gz)?$"))


def transactions(rows: DataFrame) -> DataFrame:
    """One row per capture: capture_id, main, request and metadata, joined through concurrent-to.

    ``main`` is the response, revisit or other record that request and metadata
    name; each is a struct of the columns of ``rows``. Records that name a capture
    without a main record make a row whose main is null. Of several requests or
    metadata records of a capture the one with the smallest record_id counts; a
    main record that stands in several files, the one of the first path. Records of
    other types, and those without the ids that tell where they belong, take no part.
    """
    own = [c for c in rows.columns if c != "concurrent_to"]
    kind = F.col("type")
    main = kind.isin(*MAIN)
    capture = F.when(main, F.col("record_id")).when(kind.isin("request", "metadata"), F.col("concurrent_to"))

    def first(wanted: Column, name: str) -> Column:
        return F.min_by(F.struct(*own), F.when(wanted, F.struct("record_id", "path", "at"))).alias(name)

    # All three kinds meet under the identifier in one shuffle.
    keyed = rows.withColumn("capture_id", capture).where("capture_id is not null")
    return keyed.groupBy("capture_id").agg(first(main, "main"), first(kind == "request", "request"), first(kind == "metadata", "metadata"))


def _field(text: Column, name: str) -> Column:
    """A field of warc-fields or HTTP headers; null if it is not there."""
    value = F.regexp_extract(text, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(value != "", value)


def captures_of(pages: DataFrame) -> DataFrame:
    """page_id, uri, digest (SHA-1 of the UTF-8 payload) and size of every page, without its payload."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("uri"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))


def write_archive(pages: DataFrame, folder: str, least: int = REVISIT_BYTES, date: str = NO_DATE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files and return the table of what was written.

    Of pages with equal payloads of at least ``least`` bytes, that with the largest
    page_id is a response; the others are revisits of it and keep no payload. Pages
    without page_id are the smallest; where all lack one, and where rows repeat the
    largest, each is a response. A null html is an empty payload, a null url has no
    URI but a name made of the page_id.

    Payloads move once, by page_id and digest; who revisits whom is decided on
    narrow rows, where a payload that many pages share is an aggregate first.
    """
    narrow = captures_of(pages)
    largest = narrow.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1 and largest is not null")
    again = stored(narrow.join(largest.select("digest", "largest"), "digest").where("page_id is null or page_id <> largest"), "revisits")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("uri"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    gone = again.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest")).distinct()
    responses = full.join(gone, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left_anti")
    none = F.lit(None).cast("string")
    written = write_captures(responses.select("*", F.lit(date).alias("date"), F.octet_length("payload").cast("long").alias("size"), none.alias("target_id"), none.alias("target_uri")), folder)
    target = written.join(again.select("digest", F.col("largest").alias("page_id")).distinct(), ["digest", "page_id"], "left_semi").groupBy("digest").agg(F.min(F.struct("record_id", "uri")).alias("target"))
    revisits = again.join(target, "digest").select("page_id", "uri", "digest", "size", F.col("target.record_id").alias("target_id"), F.col("target.uri").alias("target_uri"))
    # Few rows without payloads: by digest and page, not by digest alone, as one may have most of them.
    revisits = revisits.withColumn("payload", F.lit(None).cast("binary")).withColumn("date", F.lit(date))
    return written.union(write_captures(revisits, folder))


def read_archive(paths: DataFrame) -> DataFrame:
    """One nested row per capture, with the page it is of: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    A response's size and digest are those of the payload that was read; ``intact``
    tells whether the digest is the declared one. A revisit has the declared ones,
    and refers_to is the page_id of the response that it names.
    """
    return _named(transactions(read_records(paths)))


def _named(captures: DataFrame) -> DataFrame:
    about = F.col("metadata.payload").cast("string")
    page = _field(about, "page-id").cast("long")
    rows = captures.where("main is not null").withColumn("page_id", page)
    targets = rows.where("main.type = 'response'").select(F.col("capture_id").alias("_target"), F.col("page_id").alias("refers_to"))
    # Only revisits meet a target: the many rows that refer to nothing would share one key.
    revisit = F.col("main.type") == "revisit"
    resolved = rows.where(revisit).withColumn("_target", F.col("main.refers_to")).join(targets, "_target", "left").select(*rows.columns, "refers_to")
    return resolved.union(rows.where(~revisit).withColumn("refers_to", F.lit(None).cast("long")))


def round_trip(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Write the archives of ``pages`` in the shared folder and read them back.

    Returns page_id, payload_bytes, payload_digest (lower-case hexadecimal SHA-1),
    record_type, refers_to and intact, one row per row of ``pages``; an empty table
    gives none. Size and digest of a response are measured on the payload read, and
    stand beside the record before transactions are joined, so payloads do not move
    again. See ``write_archive`` for nulls, ties and repeated rows. Other columns
    are not looked at.
    """
    written = write_archive(pages, new_folder(pages.sparkSession, "warc"), least)
    rows = read_records(written)
    response = F.col("type") == "response"
    # base32 to hexadecimal: five bits a letter, 160 in all.
    bits = F.transform(F.split(F.regexp_extract("declared_digest", "^sha1:([A-Z2-7]{32})$", 1), ""), lambda c: F.lpad(F.bin(F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), c).cast("long") - 1), 5, "0"))
    declared = F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.lpad(F.conv(F.substring(F.array_join(bits, ""), i * 16 + 1, F.lit(16)), 2, 16), 4, "0")), ""))
    # The archives are read once: the narrow rows serve the captures and the responses that revisits name.
    narrow = rows.select(
        "path",
        "at",
        "record_id",
        "type",
        "concurrent_to",
        "refers_to",
        declared.alias("declared"),
        F.when(response, F.sha1("payload")).alias("measured"),
        F.when(response, F.octet_length("payload")).otherwise(_field(F.col("http_head"), "Content-Length").cast("int")).cast("long").alias("payload_bytes"),
        F.when(F.col("type") == "metadata", F.col("payload")).alias("payload"),
    )
    named = _named(transactions(stored(narrow, "records")))
    return named.select(
        "page_id",
        F.col("main.payload_bytes").alias("payload_bytes"),
        F.coalesce("main.measured", "main.declared").alias("payload_digest"),
        F.col("main.type").alias("record_type"),
        "refers_to",
        (F.coalesce("main.measured", "main.declared") == F.col("main.declared")).alias("intact"),
    )


def oracle() -> str:
    """DuckDB SQL for the query's rows."""
    return f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
k as (select payload_digest, max(page_id) as largest from p where payload_bytes >= {REVISIT_BYTES} group by all)
select page_id, payload_bytes, payload_digest, case when largest is null or page_id = largest then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from largest then largest end as refers_to, true as intact
from p left join k using (payload_digest)"""
