"""Files that grow, read by byte ranges.

A store folder remembers what has been seen. :func:`take_stock` lists the files on the executors, reads only the
bytes behind what is known, and appends *ranges* to the store: rows (version, path, generation, start, stop,
first_line, lines, ...) that cover whole lines, so a half line at the end of a file waits for its rest. The rows of a
version are one file, so a version appears whole or not at all; a stock that dies half-way has changed nothing.

Lines come from ranges, in batch or as a stream: the ranges folder is an ordinary stream of immutable files, whose
checkpoint holds a small number, and the bytes are read by the executors. Each line is in one range, numbered as a batch
read of the whole file numbers it. A file that has become shorter, or whose bytes before the known end have changed,
was replaced: it starts anew under the next ``generation``.

One process at a time takes stock of a store. Paths are URIs that Arrow's file systems open.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.functions import jsonv as J
from loomlog.functions import paths as P
from loomlog.session import configure, cut, ship_by_value

ship_by_value(__name__)

RANGES = ("version bigint, path string, generation int, start bigint, stop bigint, first_line bigint, lines bigint, "
          "size bigint, mtime bigint, mark bigint")
CHUNK = 32 << 20  # bytes that one task counts or reads at a time
BLOCK = 4 << 20
MARK = 64  # bytes before the known end that must not have changed
SNAPSHOT_EVERY = 16  # versions between two stored states


def open_uri(uri: str):
    """Arrow file system and plain path of a URI or an absolute path."""
    from pyarrow import fs

    if uri.startswith("/") or uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _listed(uri: str, deep: bool) -> list[tuple[str, bool, int, int]]:
    """(uri, is folder, size, mtime in microseconds) below a folder; nothing if it does not exist."""
    from pyarrow import fs

    system, path = open_uri(uri)
    scheme = uri[: len(uri) - len(path)] if uri.endswith(path) else "file:"
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=deep))
    return [(scheme + x.path, x.type == fs.FileType.Directory, x.size or 0, (x.mtime_ns or 0) // 1000) for x in found]


def list_files(spark: SparkSession, roots: list[str], suffix: str = ".jsonl") -> DataFrame:
    """(path, size, mtime) of the files below ``roots``; each folder under a root is listed by one task."""
    n = spark.sparkContext.defaultParallelism

    def listing(deep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for uri, folder in zip(batch.column("path").to_pylist(), batch.column("folder").to_pylist()):
                    rows = _listed(uri, deep) if folder else []
                    if rows or not folder:
                        names = ["path", "folder", "size", "mtime"]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names) if folder else batch.slice(0, 0)
        return run

    schema = "path string, folder boolean, size bigint, mtime bigint"
    start = spark.createDataFrame([(r, True) for r in roots], "path string, folder boolean").repartition(n, "path")
    top = cut(start.mapInArrow(listing(False), schema), "listing")
    deep = top.where("folder").select("path", "folder").repartition(n, "path").mapInArrow(listing(True), schema)
    return top.unionByName(deep).where(~F.col("folder") & F.col("path").endswith(suffix)).select("path", "size", "mtime")


def _ranges(spark: SparkSession, store: str) -> DataFrame | None:
    return spark.read.schema(RANGES).parquet(f"{store}/ranges") if _listed(f"{store}/ranges", False) else None


def _snapshot(store: str) -> int:
    """The newest complete stored state; 0 without one."""
    found = [int(uri.rsplit("/", 1)[1]) for uri, folder, *_ in _listed(f"{store}/state", False) if folder]
    return max((v for v in found if any(u.endswith("_SUCCESS") for u, *_ in _listed(f"{store}/state/{v}", False))), default=0)


def seen(spark: SparkSession, store: str) -> DataFrame:
    """(version, path, generation, stop, next_line, size, mtime, mark): what is known of each file."""
    schema = "version bigint, path string, generation int, stop bigint, next_line bigint, size bigint, mtime bigint, mark bigint"
    ranges, at = _ranges(spark, store), _snapshot(store)
    rows = spark.read.schema(schema).parquet(f"{store}/state/{at}") if at else spark.createDataFrame([], schema)
    if ranges is None:
        return rows
    rows = rows.unionByName(ranges.where(F.col("version") > at).select(
        "version", "path", "generation", "stop", (F.col("first_line") + F.col("lines")).alias("next_line"), "size", "mtime", "mark"))
    fields = [c for c in rows.columns if c != "path"]
    return rows.groupBy("path").agg(F.max(F.struct("version", "generation", "stop", *[c for c in fields if c not in ("version", "generation", "stop")])).alias("x")).select(
        "x.version", "path", "x.generation", "x.stop", *[f"x.{c}" for c in fields if c not in ("version", "generation", "stop")])


def _mark(file, stop: int) -> int:
    """Checksum of the bytes just before ``stop``."""
    file.seek(max(0, stop - MARK))
    return zlib.crc32(file.read(min(MARK, stop)))


def _unchanged(rows: DataFrame) -> DataFrame:
    """Add ``same``: whether the bytes before the known end are still there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for row in batch.to_pylist():
                if row["stop"] is None or row["size"] < row["stop"]:
                    same.append(False)
                    continue
                system, path = open_uri(row["path"])
                with system.open_input_file(path) as file:
                    same.append(_mark(file, row["stop"]) == row["mark"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(same, pa.bool_())], [*batch.schema.names, "same"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", same boolean")


def _count_breaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk: where its last newline ends (null without one), line breaks up to there and after it, the mark there."""
    for batch in batches:
        ends, inside, after, marks = [], [], [], []
        for row in batch.to_pylist():
            system, path = open_uri(row["path"])
            with system.open_input_file(path) as file:
                at, end, upto, rest = row["begin"], None, 0, 0
                file.seek(at)
                while at < row["finish"]:
                    data = file.read(min(BLOCK, row["finish"] - at))
                    if not data:
                        break
                    peek = file.read(1)  # tells a lone carriage return from one whose newline is in the next block
                    file.seek(at + len(data))
                    last = data.rfind(b"\n") + 1
                    head, tail = data[:last], data[last:]
                    lone = tail.count(b"\r") - (tail.endswith(b"\r") and peek == b"\n")
                    if last:
                        upto += rest + head.count(b"\n") + head.count(b"\r") - head.count(b"\r\n")
                        end, rest = at + last, lone
                    else:
                        rest += lone
                    at += len(data)
                ends.append(end)
                inside.append(upto)
                after.append(rest)
                marks.append(_mark(file, end) if end is not None else None)
        kinds = (pa.int64(),) * 4
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array(x, k) for x, k in zip((ends, inside, after, marks), kinds))], [*batch.schema.names, "stop", "inside", "after", "mark"])


def take_stock(spark: SparkSession, roots: list[str], store: str, suffix: str = ".jsonl", chunk: int = CHUNK) -> int:
    """Note what has been added to the files below ``roots``; the version that holds it, or the last one if nothing was."""
    configure(spark)
    n = spark.sparkContext.defaultParallelism
    known = cut(seen(spark, store), "seen")
    version = known.agg(F.max("version")).first()[0] or 0
    old = known.select("path", "generation", "stop", "next_line", "mark", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
    found = list_files(spark, roots, suffix).join(old, "path", "left")
    moved = found.where("size > 0 and (old_size is null or size <> old_size or mtime <> old_mtime)").drop("old_size", "old_mtime")
    told = _unchanged(moved.repartition(n, "path"))
    start = told.select(
        "path", "size", "mtime", F.when(F.col("same"), F.col("generation")).otherwise(F.coalesce(F.col("generation") + 1, F.lit(0))).cast("int").alias("generation"),
        F.when(F.col("same"), F.col("stop")).otherwise(0).cast("bigint").alias("origin"), F.when(F.col("same"), F.col("next_line")).otherwise(1).cast("bigint").alias("base"),
    ).where("origin < size")
    start = cut(start, "origins")
    chunks = start.withColumn("begin", F.explode(F.sequence("origin", F.col("size") - 1, F.lit(chunk).cast("bigint")))).withColumn(
        "finish", F.least(F.col("begin") + chunk, F.col("size"))).repartition(n, "path", "begin")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields)
    counted = cut(chunks.mapInArrow(_count_breaks, schema + ", stop bigint, inside bigint, after bigint, mark bigint"), "chunks")
    # A row per chunk: even the windows of one huge file are small.
    above = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    breaks = counted.withColumn("upto", F.coalesce(F.sum(F.col("inside") + F.col("after")).over(above), F.lit(0)) + F.col("inside")).where("stop is not null")
    placed = breaks.withColumn("begun", F.coalesce(F.max("stop").over(above), F.col("origin"))).withColumn("done", F.coalesce(F.max("upto").over(above), F.lit(0)))
    rows = cut(placed.select(
        F.lit(version + 1).cast("bigint").alias("version"), "path", "generation", F.col("begun").alias("start"), "stop", (F.col("base") + F.col("done")).alias("first_line"),
        (F.col("upto") - F.col("done")).alias("lines"), "size", "mtime", "mark"), "ranges")
    if rows.isEmpty():
        return version
    version += 1
    rows.repartition(1).write.mode("append").parquet(f"{store}/ranges")  # a few bytes a range; one file is one commit
    if version % SNAPSHOT_EVERY == 0:
        seen(spark, store).write.mode("overwrite").parquet(f"{store}/state/{version}")
    return version


def _range_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, path = open_uri(row["path"])
            with system.open_input_file(path) as file:
                file.seek(row["start"])
                at, number, held = row["start"], row["first_line"], b""
                while at < row["stop"]:
                    data = file.read(min(BLOCK, row["stop"] - at))
                    if not data:
                        break  # replaced meanwhile; the next stock starts the file anew
                    at += len(data)
                    data = held + data
                    last = data.rfind(b"\n") + 1
                    held = data[last:]
                    texts = data[:last].replace(b"\r\n", b"\n").replace(b"\r", b"\n").decode("utf-8", "replace").split("\n")[:-1] if last else []
                    if texts:
                        yield pa.RecordBatch.from_arrays([
                            pa.array([row["path"]] * len(texts)), pa.array([row["generation"]] * len(texts), pa.int32()), pa.array([row["version"]] * len(texts), pa.int64()),
                            pa.array(range(number, number + len(texts)), pa.int64()), pa.array(texts, pa.string()),
                        ], ["path", "generation", "version", "line", "raw"])
                        number += len(texts)


def read_ranges(ranges: DataFrame) -> DataFrame:
    """(session_id, path, generation, version, line, raw) of the ranges' lines; blank lines are dropped but counted.

    Works on a batch and on a stream of ranges. Ranges are dealt to a fixed number of tasks, as their rows are tiny.
    """
    n = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranges.select("path", "generation", "version", "start", "stop", "first_line").repartition(n, "path", "start")
    rows = dealt.mapInArrow(_range_lines, "path string, generation int, version bigint, line bigint, raw string")
    return rows.where(~J.blank(F.col("raw"))).withColumn("session_id", P.session_id_from_path(F.col("path"))).select(
        "session_id", "path", "generation", "version", "line", "raw")


def grown_lines(spark: SparkSession, store: str, after: int = 0) -> DataFrame:
    """Batch: the lines noted since version ``after``, a cursor that the caller keeps."""
    return read_ranges(_ranges(spark, store).where(F.col("version") > after))


def stream_lines(spark: SparkSession, store: str, versions_per_trigger: int = 64) -> DataFrame:
    """M8: the same lines as a stream, each once; the checkpoint remembers the versions read."""
    configure(spark)
    return read_ranges(spark.readStream.schema(RANGES).option("maxFilesPerTrigger", versions_per_trigger).parquet(f"{store}/ranges"))


def reload_commands(lines: DataFrame) -> DataFrame:
    """(session_id, version, commands, reason) of valid reload commands; those noted together count as one reload.

    ``session_id`` is the run whose control log the path names. The reason is that of the last command.
    """
    v = J.strict_parse(J.js_trim(F.col("raw")))
    rows = lines.select("session_id", "version", "line", v.alias("v")).where("v is not null")
    rows = rows.where(J.as_string(F.col("v"), "$.cmd") == "reload").select("session_id", "version", "line", J.as_string(F.col("v"), "$.reason").alias("reason"))
    return rows.groupBy("session_id", "version").agg(F.count(F.lit(1)).alias("commands"), F.max_by("reason", "line").alias("reason"))


# --- tails ----------------------------------------------------------------------------------------------------------


def tail_lines(files: DataFrame, n: int, block: int = 64 << 10) -> DataFrame:
    """(path, back, raw, bytes_read) of the last ``n`` non-blank lines; ``back`` is 1 for the last.

    A file is read from its end, a block at a time, until the lines are found, so the bytes read follow the tail and
    not the file. A last line without a newline counts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                system, path = open_uri(uri)
                with system.open_input_file(path) as file:
                    at = size = file.size()
                    pieces: list[bytes] = []
                    texts: list[str] = []
                    found = 0
                    while at > 0 and found < n:  # counted are lines that begin in what has been read
                        step = min(block, at)
                        at -= step
                        file.seek(at)
                        pieces.append(file.read(step))
                        found += sum(bool(x.strip()) for x in pieces[-1].replace(b"\r", b"\n").split(b"\n")[1:])
                    data = b"".join(reversed(pieces)).replace(b"\r\n", b"\n").replace(b"\r", b"\n")
                    rows = data.split(b"\n")
                    if at > 0:
                        rows = rows[1:]  # its beginning has not been read
                    texts = [t for x in rows if (t := x.decode("utf-8", "replace")).strip()][-n:] if n > 0 else []
                yield pa.RecordBatch.from_arrays([
                    pa.array([uri] * len(texts), pa.string()), pa.array(range(len(texts), 0, -1), pa.int32()), pa.array(texts, pa.string()),
                    pa.array([size - at] * len(texts), pa.int64())], ["path", "back", "raw", "bytes_read"])

    dealt = files.select("path").repartition(files.sparkSession.sparkContext.defaultParallelism, "path")
    return dealt.mapInArrow(run, "path string, back int, raw string, bytes_read bigint")


def path_name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)
