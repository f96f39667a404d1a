"""WARC archives with a two-level capture index.

* Archives: one gzip member per record, ``part-NNNNN.warc.gz``.
* Index blocks: capture lines sorted by reversed-host URL key, a few thousand lines to a compressed block,
  ``index-NNNNN.cdx.gz``.
* Block directory: for each index file the first key, offset and length of its blocks,
  ``index-NNNNN.dir``; ``index.json`` has the first key of each file.

A look-up binary-searches the files' first keys, then a directory, reads one block, and then the record's own range of its archive.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SharedFiles, new_dir, numbered, only, read_table, written

#: Capture lines of a compressed index block.
BLOCK_LINES = 3000
#: Bytes of an archive that one task reads back, about.
READ_BYTES = 4 << 20
#: Fixed value: the date of all records, so that archives do not depend on the clock.
_DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CDX = "key string, page_id long, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """Sortable key with the host reversed: ``http://www.a.com/x?b=2&a=1`` -> ``com,a)/x?a=1&b=2``.

    Scheme, fragment, a leading ``www.`` and the default port go, the query's parameters are sorted. What is no
    URL keeps its lower-cased text as its key; null gives the empty key.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return re.sub(r"\s", "%20", url.strip().lower())
    if not host:
        return re.sub(r"\s", "%20", url.strip().lower())
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split(".")))
    if port and port != {"http": 80, "https": 443}.get(parts.scheme.lower()):
        key += f":{port}"
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return re.sub(r"\s", "%20", f"{key}){parts.path.lower() or '/'}{query.lower()}")


def _record_id(page_id: int | None, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{row if page_id is None else 0}')}>"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(
    page_id: int | None,
    url: str | None,
    payload: bytes | None,
    digest: str,
    size: int,
    refers_to: int | None,
    revisit: bool,
    row: int = 0,
) -> bytes:
    """One record: a response with its payload, or a revisit with the response's HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, row)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{_digest(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", "%20", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [
            f"WARC-Profile: {_REVISIT}",
            f"WARC-Refers-To: {_record_id(refers_to, row)}",
        ] + ([f"X-Refers-To-Page-ID: {refers_to}"] if refers_to is not None else [])
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(member: bytes) -> dict:
    """Parses one gzip member and checks its block digest."""
    data = zlib.decompressobj(31).decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != "sha1:" + _digest(block):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    response = fields["WARC-Type"] == "response"
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"),
        "payload": payload if response else None,
        "payload_bytes": len(payload) if response else size,
        "payload_digest": _digest(payload) if response else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
    }


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, digest and refers_to of every row that is a revisit; the rows are narrow.

    Of equal payloads the smallest page id is the response. Minima combine before the shuffle, so many copies of one
    payload are a row for each task.
    """
    sums = pages.select("page_id", "digest", "size").where(F.col("size") >= min_bytes)
    first = sums.groupBy("digest").agg(
        F.min("page_id").alias("first"),
        F.count(F.lit(1)).alias("n"),
    ).where("n > 1").select("digest", "first")
    return sums.select("page_id", "digest").join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(
        F.col("page_id").alias("id"),
        F.col("digest").alias("sha"),
        F.col("first").alias("refers_to"),
    ).distinct()


def write_archives(
    pages: DataFrame,
    path: str,
    min_bytes: int = 0,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """Writes archives below ``path``; returns the capture lines (key, page_id, archive, offset, length), written once.

    A null payload is empty. Rows that share the smallest page id of a payload are all responses. Null page ids are
    revisits wherever another row has the payload and an id. Further columns are ignored.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = only(pages, page_id=page_id, url=url, html=html).select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        payload.alias("html"),
        F.sha1(payload.cast("binary")).alias("digest"),
        F.octet_length(payload).cast("long").alias("size"),
    )
    revisits = decide(rows, min_bytes)
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("sha")), "left")
    out = joined.select(
        "page_id",
        "url",
        F.when(F.col("sha").isNull(), F.col("html")).alias("html"),
        "digest",
        "size",
        "refers_to",
        F.col("sha").isNotNull().alias("revisit"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, lines = f"part-{TaskContext.get().partitionId():05d}.warc.gz", []

        def members():
            at = 0
            for batch in batches:
                for r in batch.to_pylist():
                    digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                    record = make_record(
                        r["page_id"],
                        r["url"],
                        r["html"].encode() if r["html"] is not None else None,
                        digest,
                        r["size"],
                        r["refers_to"],
                        r["revisit"],
                        len(lines),
                    )
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = pack.compress(record) + pack.flush()
                    lines.append((url_key(r["url"]), r["page_id"], name, at, len(member)))
                    at += len(member)
                    yield member

        SharedFiles(path).write(name, members())
        for i in range(0, len(lines), 10_000):
            columns = zip(*lines[i : i + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                names=["key", "page_id", "archive", "offset", "length"],
            )

    return written(out.mapInArrow(run, _CDX), "captures")


def write_index(captures: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> list[dict]:
    """Sorts capture lines by key into compressed blocks; returns one row for each index file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, files, directory = f"index-{TaskContext.get().partitionId():05d}", SharedFiles(path), []

        size = 0

        def blocks():
            nonlocal size
            at, lines = 0, []

            def close():
                nonlocal at, lines
                block = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode(), 6)
                directory.append([lines[0][0], at, len(block)])
                at, lines = at + len(block), []
                return block

            for batch in batches:
                for r in batch.to_pylist():
                    lines.append([r["key"], r["page_id"], r["archive"], r["offset"], r["length"]])
                    size += r["length"]
                    if len(lines) == block_lines:
                        yield close()
            if lines:
                yield close()

        files.write(f"{name}.cdx.gz", blocks())
        files.write(f"{name}.dir", [json.dumps(directory).encode()])
        if directory:
            yield pa.RecordBatch.from_pydict(
                {
                    "name": [name],
                    "first": [directory[0][0]],
                    "blocks": pa.array([len(directory)], pa.int64()),
                    "bytes": pa.array([size], pa.int64()),
                }
            )

    order = [F.col("key"), F.col("page_id").asc_nulls_first(), F.col("archive"), F.col("offset")]
    parts = captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        run,
        "name string, first string, blocks long, bytes long",
    ).collect()
    top = [r.asDict() for r in sorted(parts, key=lambda r: numbered(r.name))]
    SharedFiles(path).write("index.json", [json.dumps(top).encode()])
    return top


class CaptureIndex:
    """Look-ups by URL over one folder of archives and index files; directories are read when first needed."""

    def __init__(self, path: str):
        self.files = SharedFiles(path)
        with self.files.open("index.json") as f:
            self.top = json.loads(f.read())
        self.directory = functools.cache(self._directory)

    def _directory(self, name: str) -> list[list]:
        with self.files.open(f"{name}.dir") as f:
            return json.loads(f.read())

    def block(self, name: str, entry: list) -> list[list]:
        text = zlib.decompress(self.files.read_range(f"{name}.cdx.gz", entry[1], entry[2])).decode()
        return [json.loads(line) for line in text.split("\n")]

    def captures(self, url: str | None) -> list[list]:
        """All capture lines of a URL: binary search of files, then of blocks; equal keys may go on in the next ones."""
        key, found = url_key(url), []
        firsts = [t["first"] for t in self.top]
        for t in self.top[max(0, bisect.bisect_left(firsts, key) - 1) :]:
            if t["first"] > key:
                break
            directory = self.directory(t["name"])
            heads = [d[0] for d in directory]
            for entry in directory[max(0, bisect.bisect_left(heads, key) - 1) :]:
                if entry[0] > key:
                    break
                lines = self.block(t["name"], entry)
                at = bisect.bisect_left(lines, key, key=lambda x: x[0])
                while at < len(lines) and lines[at][0] == key:
                    found.append(lines[at])
                    at += 1
        return found

    def read(self, url: str | None) -> list[dict]:
        return [read_record(self.files.read_range(archive, offset, length)) for _, _, archive, offset, length in self.captures(url)]


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record that the index names, read from its range of its archive.

    Index files are read block by block in parallel; captures then go to stretches of ``READ_BYTES`` of their archives, in order of
    their places, so each stretch is read forward once. The number of tasks follows from the archives' bytes, which the index's top
    level has, and is never left to the size of the narrow index lines.
    """
    index = CaptureIndex(path)
    entries = [(t["name"], t["blocks"]) for t in index.top]
    kinds = {
        "page_id": pa.int64(),
        "url": pa.string(),
        "record_type": pa.string(),
        "refers_to": pa.int64(),
        "payload_bytes": pa.int64(),
        "payload_digest": pa.string(),
    } | ({"payload": pa.binary()} if payloads else {})

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CaptureIndex(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                for entry in own.directory(name):
                    block = list(zip(*own.block(name, entry), strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block[2], pa.string()), pa.array(block[3], pa.int64()), pa.array(block[4], pa.int64())],
                        names=["archive", "offset", "length"],
                    )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, name, f = SharedFiles(path), None, None
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                rows = []
                for r in whole.slice(i, 500).to_pylist():
                    if r["archive"] != name:
                        if f is not None:
                            f.close()
                        name, f = r["archive"], files.open(r["archive"])
                    f.seek(r["offset"])
                    rows.append(read_record(f.read(r["length"])))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in kinds.items()], names=list(kinds))
        if f is not None:
            f.close()

    names = spark.createDataFrame(entries, "name string, blocks long").repartition(max(1, len(entries)), "name").select("name")
    tasks = max(-(-sum(t["bytes"] for t in index.top) // READ_BYTES), min(len(entries), spark.sparkContext.defaultParallelism), 1)
    found = names.mapInArrow(lines, "archive string, offset long, length long").repartition(
        tasks,
        "archive",
        F.expr(f"offset div {READ_BYTES}"),
    ).sortWithinPartitions("archive", "offset")
    return found.mapInArrow(
        records,
        "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + (", payload binary" if payloads else ""),
    )


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "warc")
    write_index(write_archives(read_table(spark, sf_dir, "pages"), path), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
