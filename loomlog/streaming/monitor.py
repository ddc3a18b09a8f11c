"""M5, M7, M8, M10 as Structured Streaming jobs without keyed state of their own.

Each function maps a streaming DataFrame to a streaming DataFrame; sinks,
checkpoints and triggers stay with the caller. Windows and joins use the same
expressions as the batch twins in ``loomlog.operators.monitor``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions import jsonv as J
from loomlog.session import configure

LINE_SCHEMA = "session_id string, line bigint, raw string"


def read_line_drops(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """M8: Parquet drops of numbered lines (session_id, line, raw), each file read once."""
    return configure(spark).readStream.schema(LINE_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def read_log_drops(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Immutable JSON-lines drops of the event log: (session_id, ts, event, result, threshold, tokens)."""
    text = configure(spark).readStream.option("maxFilesPerTrigger", max_files).text(path)
    v = J.strict_parse(J.js_trim(F.col("value")))
    rows = text.select(v.alias("v")).where("v is not null")
    v = F.col("v")
    return rows.select(
        J.as_id(v, "$.session_id").alias("session_id"), F.try_to_timestamp(J.as_string(v, "$.ts")).alias("ts"),
        J.as_id(v, "$.event").alias("event"), J.as_id(v, "$.result").alias("result"),
        J.as_number(v, "$.threshold").alias("threshold"), J.as_number(v, "$.tokens").alias("tokens"),
    ).where("session_id is not null and ts is not null")


def counters(log: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """M7: per session and hour; repeated rows within the watermark count once."""
    rows = log.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "ts", "event"])
    return rows.groupBy("session_id", F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("result") == "success").alias("successes"),
        F.count_if(F.col("result") == "failed").alias("failures"), F.sum("tokens").cast("bigint").alias("tokens"),
    ).select("session_id", F.col("w.start").alias("hour"), "n", "successes", "failures", "tokens")


def quiet_sessions(events: DataFrame, gap: str = "6 hours", delay: str = "10 minutes") -> DataFrame:
    """M5: a row per activity window once the watermark has passed its end."""
    return events.withWatermark("ts", delay).groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n")
    ).select("session_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("quiet_at"), "n")


def follow_control_log(commands: DataFrame, delay: str = "1 minute", width: str = "10 seconds") -> DataFrame:
    """Reload commands of a run; several within a window count once."""
    rows = commands.where("cmd = 'reload'").withWatermark("ts", delay)
    return rows.groupBy("run_id", F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("commands"), F.max_by("reason", "ts").alias("reason")
    ).select("run_id", F.col("w.start").alias("window_start"), "commands", "reason")
