"""Listings, side documents, logs and sinks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.functions import jsonv as J
from loomlog.functions import paths as P
from loomlog.session import configure, cut, ship_by_value
from loomlog.sources.growing import open_uri
from loomlog.sources.lines import parse_lines, tail

ship_by_value(__name__)

PENDING_STATES = ("running", "ready", "failed", "stale")
RELOAD_MODES = ("manual", "auto", "off")


# --- listings -----------------------------------------------------------------

def list_files(spark: SparkSession, root: str | list[str], glob: str = "*.jsonl") -> DataFrame:
    """Path, mtime and size of files; contents are never read (column pruning)."""
    return (
        configure(spark).read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .load(root).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    )


def scan_projects(spark: SparkSession, root: str, cwds: list[str] | None = None, sidechains: bool = False) -> DataFrame:
    """Linked-format files under the directories named after the given working directories."""
    files = list_files(spark, root).withColumn("project_dir", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    if cwds is not None:
        files = files.where(F.col("project_dir").isin([d for cwd in cwds for d in P.project_dir_names(cwd)]))
    if not sidechains:
        files = files.where(~P.base_name(F.col("path")).startswith("agent-"))
    return files.withColumn("session_id", P.session_id_from_path(F.col("path")))


def day_folders(today: date, lookback_days: int) -> list[str]:
    days = [today - timedelta(days=i) for i in range(lookback_days)]
    return [f"{d:%Y/%m/%d}" for d in days]


def scan_rollouts(
    spark: SparkSession, root: str, today: date | None = None, lookback_days: int | None = None, max_files: int | None = None,
) -> DataFrame:
    """Flat-format files, newest first. With ``lookback_days`` only the day folders up to ``today`` are listed."""
    if lookback_days is None:
        return _rollout_files(spark, root, max_files)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    present = []
    for day in day_folders(today, lookback_days):
        path = hadoop(f"{root}/{day}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            present.append(f"{root}/{day}")
    if not present:
        return spark.createDataFrame([], "path string, mtime timestamp, size bigint, session_id string")
    return _rollout_files(spark, present, max_files)


def _rollout_files(spark: SparkSession, roots: str | list[str], max_files: int | None) -> DataFrame:
    files = list_files(spark, roots, "rollout-*.jsonl").withColumn(
        "session_id", P.flat_session_id(F.col("path"), F.lit(None).cast("string")))
    ordered = files.orderBy(F.col("mtime").desc(), "path")
    return ordered if max_files is None else ordered.limit(max_files)


# --- logs ---------------------------------------------------------------------

def read_log(lines: DataFrame) -> DataFrame:
    """Typed rows of the tools' event log; unreadable lines are dropped."""
    extra = [c for c in lines.columns if c not in ("session_id", "line", "raw")]
    read = J.members(
        F.col("v"), "ts", "event", "result", "stage", "error", "threshold", "tokens", "tokensAfter", "amount", "amountMode", "keepLast", "model")
    rows = parse_lines(lines).where("json_kind = 'object'").select("session_id", "line", *extra, J.held(read, "_o"))
    o = lambda name: F.col(f"_o.{name}")
    given = lambda name: F.when(o(name).isNotNull() & ~F.is_variant_null(o(name)), F.to_json(o(name)))
    return rows.select(
        "session_id", "line", *extra,
        J.id_of(o("ts")).alias("ts_raw"), J.id_of(o("event")).alias("event"), J.id_of(o("result")).alias("result"),
        J.id_of(o("stage")).alias("stage"), F.coalesce(J.string_of(o("error")), F.to_json(o("error"))).alias("error"),
        J.number_of(o("threshold")).alias("threshold"), J.number_of(o("tokens")).alias("tokens"),
        J.number_of(o("tokensAfter")).alias("tokens_after"),
        F.coalesce(F.is_variant_null(o("tokensAfter")), F.lit(False)).alias("tokens_after_is_null"),
        F.coalesce(J.string_of(o("amount")), given("amount")).alias("amount"), J.id_of(o("amountMode")).alias("amount_mode"),
        F.coalesce(J.string_of(o("keepLast")), given("keepLast")).alias("keep_last"), J.id_of(o("model")).alias("model"),
    ).withColumn("ts", F.try_to_timestamp("ts_raw"))


def read_compaction_log(lines: DataFrame) -> DataFrame:
    """S9."""
    return read_log(lines).where("event = 'auto_compact'")


def preferred_log(central: DataFrame, local: DataFrame) -> DataFrame:
    """A session's central log wins over the one beside its transcript."""
    return central.unionByName(local.join(central.select("session_id").distinct(), "session_id", "left_anti"))


def read_heartbeats(lines: DataFrame, n: int | None = None) -> DataFrame:
    """Heartbeats with a valid time stamp among the last ``n`` lines."""
    parsed = parse_lines(lines)
    rows = parsed if not n or n <= 0 else tail(parsed, n)
    ts = F.try_to_timestamp(J.as_string(F.col("v"), "$.ts"))
    return rows.select("session_id", "line", ts.alias("ts"), J.as_string(F.col("v"), "$.cwd").alias("cwd")).where("ts is not null")


def read_turn_events(parsed: DataFrame) -> DataFrame:
    """Completed turns with thread id and working directory."""
    v = F.col("v")
    return parsed.where(J.as_string(v, "$.type") == "agent-turn-complete").select(
        "*", J.as_id(v, '$["thread-id"]').alias("thread_id"), J.as_id(v, "$.cwd").alias("cwd"),
        F.trim(J.as_string(v, '$["turn-id"]')).alias("turn_id")).where("thread_id is not null and cwd is not null")


def read_control_log(parsed: DataFrame) -> DataFrame:
    """Valid reload commands, one row per line."""
    v = F.col("v")
    return parsed.where((J.as_string(v, "$.cmd") == "reload") & J.as_id(v, "$.ts").isNotNull()).select(
        "session_id", "line", J.as_id(v, "$.ts").alias("ts_raw"), J.as_string(v, "$.reason").alias("reason"))


def read_handshakes(documents: DataFrame) -> DataFrame:
    """One handshake document per run."""
    v = F.col("v")
    return documents.select(
        J.as_id(v, "$.runId").alias("run_id"), J.as_id(v, "$.ts").alias("handshake_ts"),
        F.coalesce(J.as_id(v, "$.sessionId"), J.as_id(v, "$.threadId")).alias("handshake_session"),
        J.as_id(v, "$.transcriptPath").alias("transcript_path"), J.as_id(v, "$.cwd").alias("handshake_cwd"),
    ).where("run_id is not null and handshake_ts is not null and handshake_session is not null")


# --- JSON documents -----------------------------------------------------------

def parse_documents(documents: DataFrame, text: str = "value") -> DataFrame:
    """Whole JSON documents with ``v``; documents that are not one JSON object are dropped."""
    configure(documents.sparkSession)
    return J.with_parsed(documents, J.js_trim(F.col(text))).where(J.is_object(F.col("v"))).drop(text)


def read_documents(spark: SparkSession, paths: str | list[str], glob: str = "*.json") -> DataFrame:
    files = configure(spark).read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return parse_documents(files.select("value", F.col("_metadata.file_path").alias("path")))


def _complete(condition: Column, *fields: Column) -> Column:
    return F.when(condition, F.struct(*fields))


def session_states(documents: DataFrame) -> DataFrame:
    """State documents; a sub-object counts only when it is complete."""
    v = F.col("v")
    s = lambda p: J.as_id(v, p)
    reload_ts, reason = s("$.pendingReload.ts"), s("$.pendingReload.reason")
    before, after = J.as_number(v, "$.lastCompact.tokensBefore"), J.as_number(v, "$.lastCompact.tokensAfter")
    done_ts, model = s("$.lastCompact.ts"), s("$.lastCompact.model")
    cwd, name = s("$.project.cwd"), s("$.project.hash")
    return documents.select(
        "session_id",
        _complete(reload_ts.isNotNull() & reason.isNotNull(), reload_ts.alias("ts"), reason.alias("reason")).alias("pending_reload"),
        _complete(
            done_ts.isNotNull() & before.isNotNull() & after.isNotNull() & model.isNotNull(), done_ts.alias("ts"),
            before.alias("tokens_before"), after.alias("tokens_after"), model.alias("model")).alias("last_compact"),
        _complete(cwd.isNotNull() & name.isNotNull(), cwd.alias("cwd"), name.alias("hash")).alias("project"),
    )


def pending_compactions(documents: DataFrame) -> DataFrame:
    """Pending documents of schema version 1 with a known status."""
    v = F.col("v")
    count = J.as_number(v, "$.selection.removeCount")
    pick = lambda a, b: F.coalesce(J.as_id(v, f"$.selection.{a}"), J.as_number(v, f"$.selection.{b}").cast("bigint").cast("string"))
    return documents.select(
        F.coalesce(J.as_id(v, "$.sessionId"), J.as_id(v, "$.threadId")).alias("session_id"),
        J.as_string(v, "$.status").alias("status"), J.as_id(v, "$.createdAt").alias("created_at"),
        J.as_number(v, "$.thresholdTokens").alias("threshold_tokens"), J.as_number(v, "$.tokensAtTrigger").alias("tokens_at_trigger"),
        F.when(J.as_string(v, "$.amountMode").isin("messages", "tokens"), J.as_string(v, "$.amountMode")).alias("amount_mode"),
        J.as_id(v, "$.amountRaw").alias("amount"), J.as_id(v, "$.summary").alias("summary"), J.as_id(v, "$.model").alias("model"),
        F.when(count >= 0, F.struct(
            count.cast("bigint").alias("remove_count"), pick("firstRemovedUuid", "firstRemovedLine").alias("first_removed"),
            pick("lastRemovedUuid", "lastRemovedLine").alias("last_removed"), pick("anchorUuid", "anchorLine").alias("anchor"),
        )).alias("selection"),
        J.as_number(v, "$.source.mtimeMs").alias("source_mtime_ms"), J.as_number(v, "$.source.size").alias("source_size"),
        J.as_number(v, "$.schemaVersion").alias("_version"),
    ).where((F.col("_version") == 1) & F.col("session_id").isNotNull() & F.col("status").isin(*PENDING_STATES)
            & F.col("created_at").isNotNull()).drop("_version")


def pins(documents: DataFrame) -> DataFrame:
    """Valid pins, the first row of a name wins (per file)."""
    v = F.col("v")
    rows = documents.where(J.as_number(v, "$.schemaVersion") == 1).select(
        "path", F.posexplode(J.as_array(v, "$.pins")).alias("pos", "p"))
    p = F.col("p")
    valid = rows.select(
        "path", "pos", F.trim(J.as_string(p, "$.name")).alias("name"), J.as_string(p, "$.agent").alias("agent"),
        J.as_id(p, "$.sessionId").alias("session_id"), J.as_id(p, "$.sessionPath").alias("session_path"),
        J.as_id(p, "$.pinnedAt").alias("pinned_at"), J.as_id(p, "$.sessionMtime").alias("session_mtime"),
    ).where((F.length("name") > 0) & F.col("agent").isin("claude", "codex") & F.col("session_id").isNotNull()
            & F.col("session_path").isNotNull() & F.col("pinned_at").isNotNull())
    return first_by_name(valid, ["path", "name"])


def first_by_name(rows: DataFrame, key: list[str], order: str = "pos") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def runs(documents: DataFrame) -> DataFrame:
    """Validated records of live runs."""
    v = F.col("v")
    return documents.select(
        "path", J.as_string(v, "$.agent").alias("agent"), J.as_id(v, "$.runId").alias("run_id"),
        F.floor(J.as_number(v, "$.pid")).cast("bigint").alias("pid"), J.as_id(v, "$.controlDir").alias("control_dir"),
        J.as_id(v, "$.cwd").alias("cwd"), J.as_string(v, "$.reloadMode").alias("reload_mode"),
        J.as_id(v, "$.startedAt").alias("started_at"), J.as_number(v, "$.schemaVersion").alias("_version"),
        J.as_number(v, "$.pid").alias("_pid"),
    ).where((F.col("_version") == 1) & F.col("agent").isin("claude", "codex") & (F.col("_pid") > 0)
            & F.col("reload_mode").isin(*RELOAD_MODES) & F.col("run_id").isNotNull() & F.col("control_dir").isNotNull()
            & F.col("cwd").isNotNull() & F.col("started_at").isNotNull()).drop("_version", "_pid")


# --- sinks --------------------------------------------------------------------

def write_sessions(lines: DataFrame, path: str, partitions: int | None = None, buckets: int = 256) -> None:
    """K1: Parquet folders by hash of the session, with session, line and text in order.

    The number of folders does not grow with the sessions. Ranges over (bucket, session, line) split a hot session
    over several files and keep a bucket in few of them; read one session with :func:`read_session`.
    """
    keys = [F.col(c) for c in ("bucket", "session_id", "line", "sub") if c == "bucket" or c in lines.columns]
    placed = lines.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int"))
    ranged = placed.repartitionByRange(partitions, *keys) if partitions else placed.repartitionByRange(*keys)
    columns = [c for c in ("bucket", "session_id", "line", "sub", "raw") if c == "bucket" or c in lines.columns]
    ranged.sortWithinPartitions(*keys).select(*columns).write.partitionBy("bucket").parquet(path)


def read_session(spark: SparkSession, path: str, session_id: str, buckets: int = 256) -> DataFrame:
    """Lines of one session written by :func:`write_sessions`, in order; only its bucket is read."""
    rows = spark.read.parquet(path)
    own = F.pmod(F.xxhash64(F.lit(session_id)), F.lit(buckets)).cast("int")
    order = [c for c in ("line", "sub") if c in rows.columns]
    return rows.where((F.col("bucket") == own) & (F.col("session_id") == session_id)).orderBy(*order).drop("bucket")


def write_jsonl(lines: DataFrame, whole: str | None = None) -> DataFrame:
    """K1: one text file per ``path`` (a URI), its ``raw`` lines in order of ``line``; returns (path, lines, bytes).

    A file is written under a hidden name beside its place and moved there when it is whole, so a lost task or a
    repeated one leaves the old file or the new one, never a torn one. One task writes a file, row by row. The rows
    for which the column ``whole`` is false get no newline.
    """
    ended = F.lit(True) if whole is None else F.col(whole)
    rows = lines.select("path", "line", "raw", ended.alias("whole")).repartition("path").sortWithinPartitions("path", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = stream = None
        done: list[tuple[str, int, int]] = []
        count = size = 0

        def close() -> None:
            stream.close()
            system, place = open_uri(now)
            system.move(_hidden(place), place)
            done.append((now, count, size))

        for batch in batches:
            for uri, raw, ends in zip(*(batch.column(c).to_pylist() for c in ("path", "raw", "whole"))):
                if uri != now:
                    if stream is not None:
                        close()
                    now, count, size = uri, 0, 0
                    system, place = open_uri(uri)
                    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    stream = system.open_output_stream(_hidden(place))
                data = (raw or "").encode() + (b"\n" if ends else b"")
                stream.write(data)
                count, size = count + 1, size + len(data)
        if stream is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "lines", "bytes"])

    return cut(rows.mapInArrow(run, "path string, lines bigint, bytes bigint"), "written")


def _hidden(place: str) -> str:
    folder, name = place.rsplit("/", 1)
    return f"{folder}/.{name}.{uuid.uuid5(uuid.NAMESPACE_URL, f'{os.getpid()}-{name}').hex}"


def append_log(events: DataFrame, path: str, now: str, batch: str | None = None, buckets: int = 64) -> None:
    """K4: stamp missing times, append as JSON text by hash of the session; ``events`` has session_id and payload columns.

    The folders do not grow with the sessions. An append named ``batch`` (a stream's batch id) replaces what an earlier
    attempt of that name wrote, so repeating it doubles nothing; tasks publish their files when they are whole.
    """
    stamped = events.withColumn("ts", F.coalesce("ts", F.lit(now))) if "ts" in events.columns else events.withColumn("ts", F.lit(now))
    fields = [c for c in stamped.columns if c not in ("session_id", "ts")]
    rows = stamped.select("session_id", F.to_json(F.struct("ts", *fields)).alias("value"), F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int").alias("bucket"))
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch or uuid.uuid4().hex}")


def read_appended(spark: SparkSession, path: str, session_id: str | None = None, buckets: int = 64) -> DataFrame:
    """(session_id, value, batch) of an appended log, or of one session; then only its bucket is read."""
    rows = spark.read.schema("session_id string, value string, batch string, bucket int").parquet(path)
    if session_id is not None:
        rows = rows.where((F.col("bucket") == F.pmod(F.xxhash64(F.lit(session_id)), F.lit(buckets)).cast("int")) & (F.col("session_id") == session_id))
    return rows.select("session_id", "value", "batch")
