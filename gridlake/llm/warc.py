"""Legacy ARC archives, their conversion to WARC, and WARC reading.

``write_arc`` makes ARC files of pages, ``convert_arcs`` turns ARC files into WARC files and ``read_warcs`` reads them. A record's header line is parsed by the version that the
file's first record declares (version 1: URL, IP address, archive date, content type, length; version 2 adds result code,
checksum, location, offset and file name before the length) and its body by the declared length. The WARC record gets what ARC
lacks: a record id (a UUID made of the ARC record's content and place), an ISO timestamp, a type and digests.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes one is the response and the others become revisits without a body. Which one is decided
by a small table of digests, joined before writing, so a payload that a third of all records share moves no bodies together.

Files lie in the shared folder and go through ``pyarrow.fs``, which takes any URI (file, hdfs, s3, gs). Each task streams one file under a name of its own attempt and reports it in a row;
that list is checkpointed, so a lost executor or a second attempt leaves files that nothing reads.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, qualified, shared_dir
from .packing import slices

MIN_REVISIT = 100
V1 = "URL IP-address Archive-date Content-type Archive-length"
V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
#: Number of fields after the URL.
FIELDS = {1: 4, 2: 9}


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def arc_date(when: datetime.datetime) -> str:
    return when.strftime("%Y%m%d%H%M%S")


def warc_date(arc: str) -> str:
    """ARC's digits (14, or fewer: the rest counts as the earliest) as an ISO timestamp; epoch if unreadable."""
    digits = re.sub(r"\D", "", arc)[:14]
    full = digits + "00000101000000"[len(digits) :] if len(digits) >= 4 else ""
    try:
        return datetime.datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def arc_url(url: str | None) -> str:
    """A header field cannot hold blanks."""
    return re.sub(r"\s", lambda m: "%%%02X" % ord(m[0]), url or "") or "urn:none"


def arc_header(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 gridlake\n{V1 if version == 1 else V2}\n".encode()
    fields = "text/plain" if version == 1 else "text/plain 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} {fields} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, name: str, url: str, date: str, payload: bytes, offset: int) -> bytes:
    """One record, its payload after an HTTP head, with the declared length and a line feed at the end."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    fields = "text/html" if version == 1 else f"text/html 200 {hashlib.md5(block).hexdigest()} - {offset} {name}"
    return f"{url} 127.0.0.1 {date} {fields} {len(block)}\n".encode() + block + b"\n"


def read_arc(stream: BinaryIO) -> Iterator[dict]:
    """Records of an ARC stream, the file's own description left out: url, ip, date, content_type, offset, block.

    The version is that of the description; a stream without one is version 1. A line that does not parse, or a body
    shorter than declared, raises ValueError.
    """
    version, offset = 1, 0
    while True:
        line = stream.readline()
        at, offset = offset, offset + len(line)
        if not line:
            return
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", FIELDS[version])
        described = line.startswith(b"filedesc://")
        if described:  # its own line can be of either version: the length is last in both
            parts = line.decode("utf-8", "replace").split()
        if not described and len(parts) != FIELDS[version] + 1 or not parts[-1].isdigit():
            raise ValueError(f"not an ARC version {version} header at {at}: {line[:80]!r}")
        block = stream.read(int(parts[-1]))
        if len(block) != int(parts[-1]):
            raise ValueError(f"record at {at} declares {parts[-1]} bytes and has {len(block)}")
        offset += len(block)
        if described:
            version = int(block.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            continue
        yield {"url": parts[0], "ip": parts[1], "date": parts[2], "content_type": parts[3], "offset": at, "block": block}


def record_id(name: str, offset: int, url: str, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {offset} {url} {digest}')}"


def record_id_column(name: Column, offset: Column, url: Column, digest: Column) -> Column:
    """``record_id`` as an expression: a version 5 UUID is a SHA-1 with two fields set."""
    seed = F.concat(F.unhex(F.lit(uuid.NAMESPACE_URL.hex)), F.encode(F.concat_ws(" ", name, offset.cast("string"), url, digest), "UTF-8"))
    h = F.sha1(seed)
    part = lambda at, n: F.substring(h, at, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.lit("urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            k, _, v = line.decode().partition(":")
            headers[k.strip().lower()] = v.strip()
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError(f"{headers.get('warc-record-id')} declares {n} bytes and has {len(block)}")
        yield headers, block


def payload_of(block: bytes) -> bytes:
    """The body after an HTTP head; the whole block if it has none."""
    head, gap, body = block.partition(b"\r\n\r\n")
    return body if gap and head.startswith(b"HTTP/") else block


def convert(name: str, arc: BinaryIO, first: dict[str, str]) -> Iterator[bytes]:
    """WARC records of an ARC stream. ``first``: record id of the response by payload digest, where several share one."""
    for r in read_arc(arc):
        payload = payload_of(r["block"])
        digest = hashlib.sha256(payload).hexdigest()
        own = record_id(name, r["offset"], r["url"], digest)
        response = first.get(digest, own) == own
        headers = [
            ("WARC-Type", "response" if response else "revisit"),
            ("WARC-Record-ID", f"<{own}>"),
            ("WARC-Target-URI", r["url"]),
            ("WARC-Date", warc_date(r["date"])),
            ("WARC-IP-Address", r["ip"]),
            ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("Content-Type", "application/http; msgtype=response"),
        ]
        if response:
            yield warc_record([*headers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(r["block"]).hexdigest())], r["block"])
        else:
            headers.append(("WARC-Refers-To", f"<{first[digest]}>"))
            headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
            yield warc_record(headers, r["block"][: len(r["block"]) - len(payload)])


def _attempt(folder: str, kind: str) -> tuple[str, str]:
    """A stable archive name for record ids, and the path of this attempt."""
    ctx = TaskContext.get()
    return f"{kind}-{ctx.partitionId():06d}", f"{folder}/{kind}-{ctx.partitionId():06d}-{uuid.uuid4().hex}.{kind}.gz"


def write_arcs(pages: DataFrame, folder: str, version: int = 2, date: str = "20200101000000") -> DataFrame:
    """Write ``key, url, html`` as one gzipped ARC file a task; returns its records: path, name, offset, key, url, digest, n_bytes.

    A null url is ``urn:none``; the key (a string) is kept as the fragment of the record's URL, so it survives in the archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, path = _attempt(folder, "arc")
        fs, at = _fs(path)
        out, raw, offset = None, None, 0
        for batch in slices(batches, "html"):
            rows = []
            for key, url, html in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "html"))):
                if out is None:
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    raw = fs.open_output_stream(at, compression=None)
                    out = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=1, mtime=0)
                    out.write(head := arc_header(version, name, date))
                    offset = len(head)
                payload = (html or "").encode()
                full = f"{arc_url(url)}#row={key}"
                out.write(record := arc_record(version, name, full, date, payload, offset))
                rows.append((path, name, offset, key, full, hashlib.sha256(payload).hexdigest(), len(payload)))
                offset += len(record)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["path", "name", "offset", "key", "url", "digest", "n_bytes"])
        if out is not None:
            out.close()
            raw.close()

    return pages.select("key", "url", "html").mapInArrow(run, "path string, name string, offset long, key string, url string, digest string, n_bytes long")


def _a_task_each(files: DataFrame, n: int) -> DataFrame:
    """Rows that name files, dealt to a task for each: by a stated number, as their own size would make them one partition."""
    return files.repartition(max(1, n), "path")


def convert_arcs(records: DataFrame, folder: str, order: str = "key", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Convert the ARC files that ``records`` (checkpointed rows of ``write_arcs``) lists; returns ``path`` of each WARC file.

    The response of a group of equal payloads is its least ``order``. What a file needs to know, the response's id for each shared digest in it, comes with its
    path as a map; it is as large as the file's own list of records at most.
    """
    big = records.filter(F.col("n_bytes") >= min_revisit)
    groups = big.groupBy("digest").agg(F.min(F.struct(order, "name", "offset", "url")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    first = groups.select("digest", record_id_column(F.col("f.name"), F.col("f.offset"), F.col("f.url"), F.col("digest")).alias("first"))
    shared = big.select("path", "digest").distinct().join(first, "digest").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("digest", "first"))).alias("first"))
    named = records.select("path", "name").distinct()
    files = _a_task_each(named.join(shared, "path", "left"), named.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, name, first in zip(*(batch.column(c).to_pylist() for c in ("path", "name", "first"))):
                path = f"{folder}/{name}-{uuid.uuid4().hex}.warc.gz"
                (fs, there), (_, at) = _fs(source), _fs(path)
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                with fs.open_input_stream(there, compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain, fs.open_output_stream(at, compression=None) as out:
                    for record in convert(name, io.BufferedReader(plain, 1 << 20), dict(first or [])):
                        out.write(gzip.compress(record, 1, mtime=0))  # a member each, as WARC asks
                yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    return files.mapInArrow(run, "path string")


def read_warcs(files: DataFrame) -> DataFrame:
    """Records of the WARC files in ``path``: record_id, url, date, record_type, refers_to, payload_bytes, payload_digest, stated_digest.

    Payload figures are computed from the block (that of a revisit is empty); ``stated_digest`` is the header's.
    """
    names = ["record_id", "url", "date", "record_type", "refers_to", "payload_bytes", "payload_digest", "stated_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = _fs(path)
                rows = []
                with fs.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain:
                    for h, block in read_warc(io.BufferedReader(plain, 1 << 20)):
                        payload = payload_of(block)
                        ref = h.get("warc-refers-to")
                        rows.append((h["warc-record-id"][1:-1], h["warc-target-uri"], h["warc-date"], h["warc-type"], ref and ref[1:-1], len(payload), hashlib.sha256(payload).hexdigest(), h["warc-payload-digest"].partition(":")[2]))
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64() if n == "payload_bytes" else pa.string() for n in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return _a_task_each(files, files.count()).mapInArrow(run, ", ".join(f"{n} {'long' if n == 'payload_bytes' else 'string'}" for n in names))


def archive_pages(pages: DataFrame, folder: str | None = None, version: int = 2, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Pages to ARC, to WARC, and read back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Payload figures of a revisit are those of the response it refers to, and the stated digest is checked against them. A null html
    is empty. Repeated page ids each have a record; the least (page_id, url) is the response, a null id comes last. An empty table gives an empty result.
    """
    folder = qualified(pages.sparkSession, folder or f"{shared_dir(pages.sparkSession)}/gridlake/{uuid.uuid4().hex}")
    key = F.when(F.col("page_id").isNull(), "~").otherwise(F.format_string("%020d", F.col("page_id").cast("long") + F.lit(1 << 62)))
    rows = pages.select(key.alias("key"), F.col("url").cast("string").alias("url"), F.col("html").alias("html"))
    records = checkpointed(write_arcs(rows, f"{folder}/arc", version))
    back = checkpointed(read_warcs(checkpointed(convert_arcs(records, f"{folder}/warc", min_revisit=min_revisit))))
    mark = F.regexp_extract("url", "#row=([0-9]+|~)$", 1)
    out = back.withColumn("page_id", (mark.try_cast("decimal(20,0)") - F.lit(1 << 62)).cast("long"))
    there = out.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("first"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d")
    )
    joined = out.filter("record_type = 'revisit'").join(there, "refers_to", "left")
    agrees = F.assert_true(F.coalesce(F.col("d") == F.col("stated_digest"), F.lit(False)), F.lit("a revisit's payload is not the one it refers to"))
    revisits = joined.select("page_id", F.col("n").alias("payload_bytes"), F.coalesce(agrees.cast("string"), "d").alias("payload_digest"), "record_type", F.col("first").alias("refers_to"))
    responses = out.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(revisits)
