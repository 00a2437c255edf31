"""WARC archives with a two-level capture index.

Writing: a task writes its records, one gzip member each, to a file of its own under a
name no other attempt uses; the file counts only if the attempt's rows are committed to
the manifest table, so lost executors and repeated tasks leave nothing that is read.

Index: captures sorted by reversed-host URL key and page go into compressed blocks
(level two). A sparse directory has the first key of each block (level one), cut by file;
the top has one row an index file. A lookup finds the file by binary search in the top,
reads that file's directory, finds the block by binary search and reads the block's byte
range, then the record's byte range in its archive.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.llm.common import new_path, table, write_table

#: Payloads of at least so many bytes are stored once.
DEDUP_BYTES = 1000
#: Captures of an index block.
BLOCK_ROWS = 256
#: Payloads that a writing task holds as Python objects.
SLICE = 64
#: Archives are cut at about so many compressed bytes.
ARCHIVE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://www.a.example/p?q`` gives ``example,a)/p?q``. Null and host-less URLs keep their text after ``)``."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return ")" + url
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")"
    return (key + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def sort_key(url: str | None, page: int | None) -> str:
    """URL key, then page: one URL with a third of all captures still spreads over blocks and files."""
    return f"{url_key(url)} {(page if page is not None else -1) + (1 << 63):020d}"


def _header(kind: str, url: str, page: int | None, digest: str, block: bytes, more: list[str]) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page is None else page}",
        *more,
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass")


def record(url: str | None, page: int | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """A response with its payload, or a revisit with the payload's length alone; URLs are one line, escaped."""
    line = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers is None:
        block = http + payload
        return _header("response", line, page, digest, block, []) + block + b"\r\n\r\n"
    return _header("revisit", line, page, digest, http, [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers}"]) + http + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and body of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), body


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


def _writer(folder: str):
    names = ["skey", "page", "archive", "at", "size"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = system = None
        at = 0
        try:
            for batch in batches:
                rows = []
                # payloads become Python objects a few at a time
                parts = (batch.slice(i, SLICE) for i in range(0, batch.num_rows, SLICE))
                for r in (x for part in parts for x in zip(*(c.to_pylist() for c in part.columns), strict=True)):
                    page, url, payload, digest, refers = r
                    if out is None or at > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        system, top = _open(folder)
                        system.create_dir(top, recursive=True)
                        name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{top}/{name}", compression=None)
                    data = gzip.compress(record(url, page, payload or b"", digest, refers), 6, mtime=0)
                    out.write(data)
                    rows.append((sort_key(url, page), page, name, at, len(data)))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types, strict=True)], names=names)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row of ``pages`` under ``folder``; the manifest (skey, page, archive, at, size) comes back.

    The payload is the html in UTF-8, empty for null. Of equal payloads of at least
    ``DEDUP_BYTES`` bytes the one with the largest id is the response, others revisit it;
    rows that repeat that id are all responses. A row with a null id is a response that
    nothing refers to. An empty table writes nothing. Payloads of any length are written
    whole; other columns of ``pages`` are not read, whatever their names.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("big", F.octet_length("payload") >= DEDUP_BYTES)
    # the pages that hold equal payloads: thin, and added up before the shuffle
    heads = rows.where("big and page is not null").groupBy("digest").agg(F.max("page").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    # smaller payloads have no head; keys of their own keep the empty and the short ones, of which there may be many, apart
    alone = F.concat(F.lit("-"), F.xxhash64("page", "url").cast("string"))
    rows = rows.withColumn("key", F.when(F.col("big"), F.col("digest")).otherwise(alone))
    met = rows.join(heads.withColumnRenamed("digest", "key"), "key", "left")
    refers = F.when(F.col("big") & (F.col("page") < F.col("head")), F.col("head"))
    return write_table(
        met.select("page", "url", "payload", "digest", refers.alias("refers")).mapInArrow(_writer(folder), "skey string, page long, archive string, at long, size long"),
        "manifest",
    )


def _indexer(folder: str, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        directory, block = [], []
        at = 0

        def flush():
            nonlocal at
            data = zlib.compress("\n".join(json.dumps(x) for x in block).encode("utf-8", "surrogatepass"), 6)
            directory.append((block[0][0], at, len(data)))
            out.write(data)
            at += len(data)
            block.clear()

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    system, top = _open(folder)
                    system.create_dir(top, recursive=True)
                    name = f"index-{uuid.uuid4().hex}"
                    out = system.open_output_stream(f"{top}/{name}.blocks", compression=None)
                block.append(r)
                if len(block) == block_rows:
                    flush()
        if block:
            flush()
        if out is None:
            return
        out.close()
        with system.open_output_stream(f"{top}/{name}.directory", compression=None) as d:
            d.write(json.dumps(directory).encode())
        yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name])], names=["first", "name"])

    return run


def build_index(manifest: DataFrame, folder: str, files: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Write the index of a manifest; its top (first, name) comes back, one row an index file."""
    n = files or int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = manifest.select("skey", "archive", "at", "size").repartitionByRange(n, "skey").sortWithinPartitions("skey", "archive", "at")
    return write_table(ordered.mapInArrow(_indexer(folder, block_rows), "first string, name string"), "top")


class Index:
    """Binary search over the top and the directories; a block and an archive stay open for the next key."""

    def __init__(self, archives: str, folder: str, top: list[tuple[str, str]]):
        self.top = sorted(top)
        self.firsts = [x[0] for x in self.top]
        self.archives, self.folder = archives, folder
        self.directories: dict[str, list] = {}
        self.block_at, self.block = None, {}
        self.open: dict[str, pa.NativeFile] = {}

    def _read(self, folder: str, name: str, at: int, size: int) -> bytes:
        key = f"{folder}/{name}"
        f = self.open.get(key)
        if f is None:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            system, top = _open(folder)
            f = self.open[key] = system.open_input_file(f"{top}/{name}")
        f.seek(at)
        return f.read(size)

    def _directory(self, name: str) -> list:
        if name not in self.directories:
            if len(self.directories) >= 8:
                self.directories.clear()
            system, top = _open(self.folder)
            with system.open_input_file(f"{top}/{name}.directory") as f:
                self.directories[name] = json.loads(f.read())
        return self.directories[name]

    def captures(self, key: str) -> list[tuple[str, int, int]]:
        """(archive, at, size) of the captures under a sort key, over all blocks and files that hold it."""
        found = []
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.top) and self.firsts[i] <= key:
            directory = self._directory(self.top[i][1])
            j = max(0, bisect.bisect_left(directory, key, key=lambda x: x[0]) - 1)
            while j < len(directory) and directory[j][0] <= key:
                found += self._block(self.top[i][1], *directory[j][1:]).get(key, [])
                j += 1
            i += 1
        return found

    def _block(self, name: str, at: int, size: int) -> dict[str, list]:
        if self.block_at != (name, at):
            self.block = {}
            for line in zlib.decompress(self._read(self.folder, f"{name}.blocks", at, size)).decode("utf-8", "surrogatepass").split("\n"):
                key, *rest = json.loads(line)
                self.block.setdefault(key, []).append(tuple(rest))
            self.block_at = (name, at)
        return self.block

    def record(self, archive: str, at: int, size: int) -> tuple[dict[str, str], dict[str, str], bytes]:
        return parse(gzip.decompress(self._read(self.archives, archive, at, size)))


def _reader(archives: str, folder: str, top: list[tuple[str, str]], payloads: bool):
    names = ["skey", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *["payload"] * payloads]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * payloads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(archives, folder, top)
        for batch in batches:
            rows, held = [], 0
            for key in batch.column(0).to_pylist():
                for place in index.captures(key):
                    warc, http, body = index.record(*place)
                    kind, digest = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(http["Content-Length"])):
                        raise ValueError(f"damaged record {place}")
                    page, refers = warc["X-Page-ID"], warc.get("X-Refers-To-Page")
                    url = warc["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                    rows.append((key, int(page) if page else None, url, kind, int(http["Content-Length"]), digest, int(refers) if refers else None, *[body] * payloads))
                    held += len(body) * payloads
                    if held > 1 << 25:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)
                        rows, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types, strict=True)], names=names)

    return run


def lookup(keys: DataFrame, archives: str, folder: str, top: DataFrame, files: int | None = None, payloads: bool = False) -> DataFrame:
    """The captures of each different sort key in ``keys(skey)``, read from the archives; keys that the index lacks give no row.

    Keys are range-sorted first, so a task walks few index files and each block once. The
    top has one row an index file, far below one in a hundred thousand captures.
    """
    n = files or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = [(r[0], r[1]) for r in top.collect()]
    schema = "skey string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    ordered = keys.select("skey").distinct().repartitionByRange(n, "skey").sortWithinPartitions("skey")
    return ordered.mapInArrow(_reader(archives, folder, rows, payloads), schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives, folder = new_path(spark, "archives"), new_path(spark, "index")
    manifest = write_archives(pages, archives)
    top = build_index(manifest, folder)
    read = lookup(manifest.select("skey"), archives, folder, top)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN head > page_id AND payload_bytes >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN head > page_id AND payload_bytes >= 1000 THEN head END AS refers_to
FROM p LEFT JOIN h USING (payload_digest)
"""
