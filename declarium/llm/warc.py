"""WARC archives with a two-level capture index.

Writing: every page is a record, compressed as a gzip member of its own. Of
records with equal payloads of at least ``least`` bytes, the one with the
smallest page id is the response and the others are revisits without a payload,
whose HTTP header keeps its length.

Index: captures are sorted by (reversed-host key of the URL, page id, digest).
Level one are blocks of ``BLOCK`` sorted captures, each compressed on its own;
level two is a sparse directory with the first key, place and size of each
block, in a file for each range of keys, and a list of these files with their
first keys. A lookup bisects the list, a directory and a block, and reads two
ranges: the block and the record.

Defined results
---------------
* null html is an empty payload; a null URL has the empty key.
* a null page id is larger than every other; rows that repeat page id and html
  are told apart by their number among the rows alike, and the first is the one
  that others revisit.
* an empty table gives an empty archive and index; other columns are ignored.

Archives go to the folder given (by default a new one in the shared folder),
through a file system that driver and executors reach. A file's name has the
number of the task's attempt, so a task that runs again leaves no half-written
file in the index.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_arrow, new_folder, tasks, written

BLOCK = 256
LEAST = 100
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def reversed_key(url: str | None) -> str:
    """``http://www.example.com:80/a?b`` to ``com,example,www:80)/a?b``, lower-cased host, no fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    if not host:
        return url
    default = {"http": 80, "https": 443}.get(parts.scheme)
    shown = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != default else "")
    return f"{shown}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _files(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def record(url: str | None, page_id: int | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, row: int) -> bytes:
    """A WARC record as a gzip member; without a payload it is a revisit."""
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {size}{CRLF}{CRLF}".encode()
    body = http + (payload or b"")
    name = "" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}:{row}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if payload is None:
        target = "" if refers_to is None else refers_to
        head += [f"WARC-Refers-To: <urn:page:{target}:0>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress((CRLF.join(head) + CRLF * 2).encode() + body + (CRLF * 2).encode()) + packer.flush()


def parse(member: bytes) -> dict:
    """The fields of a record that was read back: type, page_id, size, digest,
    refers_to; the digest and size of a response are those of the payload read."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split(CRLF)[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    number = lambda x: int(n) if (n := x.split(":")[2]) else None
    out = {"type": fields["WARC-Type"], "page_id": number(fields["WARC-Record-ID"]), "refers_to": None, "payload": None}
    if out["type"] == "response":
        return out | {"size": len(payload), "digest": hashlib.sha256(payload).hexdigest(), "payload": payload}
    size = int(dict(x.split(": ", 1) for x in http.decode().split(CRLF)[1:])["Content-Length"])
    return out | {"size": size, "digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "refers_to": number(fields["WARC-Refers-To"])}


def _task_name(kind: str) -> str:
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{kind}-{task.partitionId():06d}-{task.taskAttemptId()}"


def _archiver(folder: str):
    """Columns key, url, page_id, digest, size, row, refers_to, revisit, html to captures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        name, at, out = _task_name("pages") + ".warc.gz", 0, None
        for batch in batches:
            if out is None:
                out = files.open_output_stream(f"{root}/{name}", compression=None)
            place, size = [], []
            key, url, page_id, digest, n, row, refers, revisit, html = (batch.column(i) for i in range(9))
            for i in range(len(batch)):
                payload = None if revisit[i].as_py() else (html[i].as_py() or "").encode()
                raw = record(url[i].as_py(), page_id[i].as_py(), payload, n[i].as_py(), digest[i].as_py(), refers[i].as_py(), row[i].as_py())
                out.write(raw)
                place.append(at)
                size.append(len(raw))
                at += len(raw)
            yield pa.RecordBatch.from_arrays(
                [key, page_id, digest, row, pa.array([name] * len(batch), pa.string()), pa.array(place, pa.int64()), pa.array(size, pa.int64())],
                ["key", "page_id", "digest", "row", "file", "place", "size"],
            )
        if out is not None:
            out.close()

    return run


ORDER = ["key", "none", "page_id", "digest", "row"]


def _sort_key(entry: list) -> tuple:
    key, page_id, digest, row = entry[:4]
    return key, page_id is None, page_id or 0, digest, row


def _indexer(folder: str, block: int):
    """Sorted captures to a file of compressed blocks and its directory, for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        name, at, total, directory, rows = _task_name("index"), 0, 0, [], []
        out = None

        def flush() -> None:
            nonlocal at, rows, out
            if out is None:
                out = files.open_output_stream(f"{root}/{name}.cdx.gz", compression=None)
            raw = zlib.compress("\n".join(json.dumps(r, ensure_ascii=False) for r in rows).encode(), 6)
            out.write(raw)
            directory.append([*rows[0][:4], at, len(raw)])
            at, rows = at + len(raw), []

        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(list(entry))
                total += 1
                if len(rows) == block:
                    flush()
        if rows:
            flush()
        if out is not None:
            out.close()
            with files.open_output_stream(f"{root}/{name}.dir.gz", compression=None) as f:
                f.write(zlib.compress(json.dumps(directory, ensure_ascii=False).encode(), 6))
            key, page_id, digest, row = directory[0][:4]
            yield pa.RecordBatch.from_pylist(
                [{"key": key, "page_id": page_id, "digest": digest, "row": row, "name": name, "captures": total}],
                schema=pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("row", pa.int64()), ("name", pa.string()), ("captures", pa.int64())]),
            )

    return run


def revisits(df: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """key, url, page_id, digest, size, row, refers_to, revisit, html of each page."""
    key = F.udf(reversed_key, "string")
    html = F.coalesce(F.col(html_col), F.lit(""))
    pages = df.select(
        F.col(url_col).alias("url"),
        F.col(id_col).cast("bigint").alias("page_id"),
        F.sha2(html, 256).alias("digest"),
        F.octet_length(html).cast("bigint").alias("size"),
        html.alias("html"),
    )
    slim = pages.select("page_id", "digest", "size")
    firsts = slim.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = slim.groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1)
    out = pages.join(firsts.select("digest", "first"), "digest", "left").withColumn("shared", F.col("digest").isNotNull() & F.col("first").isNotNull())
    row = F.lit(0).cast("bigint")
    if repeated:
        row = (F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url")) - 1).cast("bigint")
        # payloads whose ids are all null have no first id, but are shared all the same
        alike = slim.where(F.col("size") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("alike")).where("alike > 1")
        out = out.join(alike, "digest", "left").withColumn("shared", F.col("alike").isNotNull()).drop("alike")
    out = out.withColumn("row", row)
    out = out.withColumn("revisit", F.col("shared") & ~(F.col("page_id").eqNullSafe(F.col("first")) & (F.col("row") == 0)))
    return out.select(
        key("url").alias("key"), "url", "page_id", "digest", "size", "row", F.when(F.col("revisit"), F.col("first")).alias("refers_to"), "revisit", F.when(~F.col("revisit"), F.col("html")).alias("html")
    )


def write(df: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, block: int = BLOCK) -> str:
    """Write archives and index of all pages; the folder."""
    spark = df.sparkSession
    folder = folder or new_folder(spark, "warc")
    files, root = _files(folder)
    files.create_dir(root, recursive=True)
    captures = map_arrow(
        revisits(df, id_col, url_col, html_col, least),
        _archiver(folder),
        "key string, page_id bigint, digest string, row bigint, file string, place bigint, size bigint",
    )
    captures = written(captures, "captures")
    order = [F.col(c) for c in ORDER]
    sorted_ = captures.withColumn("none", F.col("page_id").isNull()).repartitionByRange(tasks(captures), *order).sortWithinPartitions(*order).drop("none")
    parts = map_arrow(sorted_, _indexer(folder, block), "key string, page_id bigint, digest string, row bigint, name string, captures bigint").collect()
    listing = sorted(([r["key"], r["page_id"], r["digest"], r["row"], r["name"]] for r in parts), key=_sort_key)
    with files.open_output_stream(f"{root}/index.json", compression=None) as f:
        f.write(json.dumps(listing, ensure_ascii=False).encode())
    return folder


class CaptureIndex:
    """Lookups in the index of a folder. Keeps the list of parts, one directory and one block."""

    def __init__(self, folder: str):
        self.files, self.root = _files(folder)
        with self.files.open_input_stream(f"{self.root}/index.json", compression=None) as f:
            self.parts = json.loads(f.read())
        self.first = [_sort_key(p) for p in self.parts]
        self.part, self.block = -1, -1
        self.open: dict[str, object] = {}

    def _range(self, name: str, at: int, size: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.files.open_input_file(f"{self.root}/{name}")
        return self.open[name].read_at(size, at)

    def _load(self, part: int, block: int) -> None:
        if part != self.part:
            with self.files.open_input_stream(f"{self.root}/{self.parts[part][4]}.dir.gz", compression=None) as f:
                self.directory = json.loads(zlib.decompress(f.read()))
            self.starts = [_sort_key(d) for d in self.directory]
            self.part, self.block = part, -1
        if block != self.block:
            at, size = self.directory[block][4:6]
            raw = zlib.decompress(self._range(self.parts[part][4] + ".cdx.gz", at, size))
            self.rows = [json.loads(x) for x in raw.decode().split("\n")]
            self.keys = [_sort_key(r) for r in self.rows]
            self.block = block

    def captures(self, low: tuple) -> Iterator[list]:
        """Captures from the sort key ``low`` on, in order."""
        part = max(bisect.bisect_right(self.first, low) - 1, 0)
        if not self.parts:
            return
        self._load(part, max(self.block, 0) if part == self.part else 0)
        block = max(bisect.bisect_right(self.starts, low) - 1, 0)
        self._load(part, block)
        at = bisect.bisect_left(self.keys, low)
        while True:
            self._load(part, block)
            while at < len(self.rows):
                yield self.rows[at]
                self._load(part, block)
                at += 1
            at, block = 0, block + 1
            if block == len(self.directory):
                part, block = part + 1, 0
                if part == len(self.parts):
                    return

    def read(self, capture: list) -> dict:
        """The record of a capture, by one range read."""
        return parse(self._range(*capture[4:7]))

    def lookup(self, url: str | None) -> list[dict]:
        """All records of a URL's key."""
        key, out = reversed_key(url), []
        for c in self.captures((key, False, -(2**63), "", -1)):
            if c[0] != key:
                break
            out.append(self.read(c))
        return out


def _reader(folder: str):
    """Sorted (key, page_id, n) to their records: each looked up in the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or CaptureIndex(folder)
            out = []
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for c in index.captures((key, page_id is None, page_id or 0, "", -1)):
                    if c[0] != key or c[1] != page_id:
                        break
                    out.append(index.read(c))
                    if len(out) == 512:
                        yield _batch(out)
                        out = []
            if out:
                yield _batch(out)

    return run


_READ = [("page_id", "page_id", pa.int64()), ("payload_bytes", "size", pa.int64()), ("payload_digest", "digest", pa.string()), ("record_type", "type", pa.string()), ("refers_to", "refers_to", pa.int64())]


def _batch(records: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in records], kind) for _, k, kind in _READ], [name for name, _, _ in _READ])


def read_back(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every
    page of ``df``, each found through the index and read from the archives."""
    key = F.udf(reversed_key, "string")
    wanted = df.select(key(F.col(url_col)).alias("key"), F.col(id_col).cast("bigint").alias("page_id")).distinct()
    order = [F.col("key"), F.col("page_id").isNull(), F.col("page_id")]
    wanted = wanted.repartitionByRange(tasks(df), *order).sortWithinPartitions(*order)
    return map_arrow(wanted, _reader(folder), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
