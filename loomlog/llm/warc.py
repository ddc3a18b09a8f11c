"""WARC archives: monolithic gzip files made seekable.

``write_archives`` writes records as one gzip stream per file, as simple crawlers do. ``normalise`` inflates each such
file once, as a stream, rewrites every record as a gzip member of its own and writes a sidecar index of offsets.
``read_records`` takes the index and reads members by seeking. Files lie in a shared folder; a task gives its files
fresh names and reports them as rows, so what a lost or repeated task has left is never read.

Defined results: a null payload is the empty payload; among equal payloads the smallest id is the response and the
others revisit it; rows that repeat the smallest id are responses too; rows with a null id revisit the smallest other
id, or are responses if their payload has no other; an empty table gives an empty result; columns that are not named
are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.batches import open_folder
from loomlog.session import cut, ship_by_value, store_path

ship_by_value(__name__)

FILE_BYTES = 32 << 20  # payload bytes after which a task begins a new file
READ_BYTES = 256 << 10  # compressed bytes per read
LEVEL = 6  # of gzip
EPOCH = "1970-01-01T00:00:00Z"  # records carry no clock, so reruns write equal bytes
END = b"\r\n\r\n"


def digest32(payload: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, url: str, record_id: str, page_id, refers_to, payload: bytes, digest: str) -> bytes:
    """A response, or a revisit: the response's HTTP head without its body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {EPOCH}",
        "WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url), f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {json.dumps(page_id)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def first_captures(pages: DataFrame, page_id: str, html: str, min_bytes: int) -> DataFrame:
    """(digest, first_id) of payloads that occur under more than one row; narrow, counted before the exchange."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    narrow = pages.select(F.col(page_id).alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    held = narrow.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return held.where((F.col("n") > 1) & F.col("first_id").isNotNull()).select("digest", "first_id")


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0,
) -> DataFrame:
    """One gzip stream of records per file under ``folder``; returns (path, records) of the files."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"),
    )
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    linked = rows.join(first_captures(pages.withColumn(page_id, F.col(page_id).cast("long")), page_id, html, min_bytes), "digest", "left")
    linked = linked.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        out = None
        for batch in batches:
            for row in batch.to_pylist():
                payload = row["html"].encode()
                if out is None:
                    name, records, held = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, gzip = system.open_output_stream(name, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                kind = "response" if row["refers_to"] is None else "revisit"
                data = record(kind, row["url"], f"{row['page_id']}", row["page_id"], row["refers_to"], payload, digest32(payload))
                out.write(gzip.compress(data))
                records, held = records + 1, held + len(payload)
                if held >= FILE_BYTES:
                    out.write(gzip.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [name], "records": [records]})
        if out is not None:
            out.write(gzip.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [records]})

    return cut(linked.mapInArrow(run, "path string, records bigint"), "archives")


class RecordStream:
    """Records of an inflated archive, one after the other, in bounded memory.

    Takes one gzip stream or several members behind one another. A record is held whole; the rest is not.
    """

    def __init__(self, source):
        self.source, self.inflate, self.held, self.raw = source, zlib.decompressobj(31), bytearray(), b""

    def more(self) -> bool:
        """Inflate another stretch; false at the end of the file."""
        if self.inflate.eof:
            self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
        data = self.raw or self.source.read(READ_BYTES)
        if not data:
            return False
        self.held += self.inflate.decompress(data, READ_BYTES * 4)
        self.raw = self.inflate.unconsumed_tail
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """(headers, whole record)."""
        while True:
            while (at := self.held.find(END)) < 0:
                if not self.more():
                    if self.held.strip():
                        raise ValueError("the archive ends inside a record")
                    return
            headers = parse_headers(bytes(self.held[:at]))
            length = at + 4 + int(headers["content-length"]) + 4
            while len(self.held) < length:
                if not self.more():
                    raise ValueError("the archive ends inside a record")
            yield headers, bytes(self.held[:length])
            del self.held[:length]


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def normalise(files: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """Rewrite each archive with a gzip member per record; returns the index (path, offset, length, record_id).

    The index also lies beside each file as ``<file>.idx``, a JSON object per line.
    """
    names = files.select(F.col(path).alias("path"))
    spread = names.repartition(max(1, names.sparkSession.sparkContext.defaultParallelism * 4), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                target = f"{root}/{uuid.uuid4().hex}.warc.gz"
                index, offset = [], 0
                with system.open_input_stream(name, compression=None) as source, system.open_output_stream(target, compression=None) as out:
                    for headers, data in RecordStream(source):
                        gzip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = gzip.compress(data) + gzip.flush()
                        out.write(member)
                        index.append({"path": target, "offset": offset, "length": len(member), "record_id": headers["warc-record-id"]})
                        offset += len(member)
                with system.open_output_stream(target + ".idx", compression=None) as out:
                    for entry in index:
                        out.write(json.dumps(entry).encode() + b"\n")
                if index:
                    yield pa.RecordBatch.from_pylist(index)

    return cut(spread.mapInArrow(run, "path string, offset bigint, length bigint, record_id string"), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Seek each indexed member and parse it; digests of responses are computed from what was read.

    Columns: page_id, url, record_type, payload (null for revisits), payload_bytes, payload_digest, refers_to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(folder)
        name, source = None, None
        for batch in batches:
            rows, held = [], 0
            for entry in batch.to_pylist():
                if entry["path"] != name:
                    if source is not None:
                        source.close()
                    name = entry["path"]
                    source = system.open_input_file(name)
                source.seek(entry["offset"])
                data = zlib.decompress(source.read(entry["length"]), 31)
                head, _, block = data.partition(END)
                headers, block = parse_headers(head), block[:-4]
                http, _, payload = block.partition(END)
                length, refers = int(parse_headers(http)["content-length"]), headers.get("warc-refers-to")
                stated, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                if kind == "response" and (len(payload) != length or digest32(payload) != stated):
                    raise ValueError(f"payload of {headers['warc-record-id']} in {name} differs from its digest")
                rows.append({
                    "page_id": json.loads(headers["x-page-id"]), "url": headers["warc-target-uri"], "record_type": kind,
                    "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": stated,
                    "refers_to": int(refers.removeprefix("<urn:page:").rstrip(">")) if refers else None,
                })
                held += len(payload)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema())
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema())
        if source is not None:
            source.close()

    def schema():
        return pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
        ])

    return index.select("path", "offset", "length").mapInArrow(
        run, "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint",
    )


def archive_folders(spark) -> tuple[str, str]:
    """Two fresh folders in the shared folder: for the streams and for the seekable archives."""
    base = store_path(spark, "warc")
    return base + "/streams", base + "/members"
