"""M1-M3, M4, M6, M7 as batch jobs: status, trigger decision, latest sessions, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions import text as T
from loomlog.functions import tokens as K
from loomlog.operators import stats as S
from loomlog.operators.ordered import Running, running
from loomlog.session import cut

RETRY_SECONDS = 30  # wait after an attempt before the next one (fixed value)


def _flags(sessions: DataFrame, pending: DataFrame, locks: DataFrame) -> DataFrame:
    return (
        sessions.join(pending.select("session_id", F.col("status").alias("pending")), "session_id", "left")
        .join(locks.select("session_id").distinct().withColumn("locked", F.lit(True)), "session_id", "left")
        .na.fill(False, ["locked"])
    )


def reload_due(pending: Column, success_ts: Column, start_ts: Column) -> Column:
    return F.coalesce(pending == "ready", F.lit(False)) | F.coalesce(
        success_ts.isNotNull() & (start_ts.isNull() | (success_ts > start_ts)), F.lit(False))


def status_linked(
    tokens: DataFrame, signals: DataFrame, pending: DataFrame, locks: DataFrame, given: int | None = None,
    settings: int | None = None, width: int = 8,
) -> DataFrame:
    """M1: mode, tokens, threshold and bar per session."""
    rows = _flags(tokens.select("session_id", F.col("approx_tokens").alias("tokens")), pending, locks).join(
        signals, "session_id", "left")
    threshold = F.coalesce(F.lit(given).cast("double"), "start_threshold", "result_threshold", F.lit(settings).cast("double"))
    over = F.coalesce(F.col("tokens") >= threshold, F.lit(False))
    compacting = (F.col("locked") & over) | F.coalesce(F.col("pending") == "running", F.lit(False))
    due = reload_due(F.col("pending"), F.col("success_ts"), F.col("session_start_ts"))
    return rows.select(
        "session_id", F.when(compacting, "Compacting").when(due, "Reload").otherwise("Waiting").alias("mode"), "tokens",
        threshold.cast("bigint").alias("threshold"), T.progress_bar(F.col("tokens"), threshold, width).alias("bar"))


def flat_estimate(flat: DataFrame) -> DataFrame:
    """Token estimate of a wrapped session from its labelled response items."""
    item = F.col("item")
    rows = flat.where("kind = 'wrapped' and type = 'response_item' and item_is_object").select(
        "session_id", T.prompt_text_flat(item).alias("t"))
    sized = F.coalesce(K.approx_tokens(K.with_newline(F.col("t"))), F.lit(0))
    return rows.groupBy("session_id").agg(F.sum(sized).alias("estimate"))


def status_flat(
    flat: DataFrame, pending: DataFrame, locks: DataFrame, threshold_tokens: int | None = None,
    threshold_percent: float | None = None, width: int = 8,
) -> DataFrame:
    """M2: a compacted marker newer than the last reading makes it stale; then the estimate counts."""
    reading = S.last_token_reading(flat, need_tokens=True).select(
        "session_id", "tokens", "context_window", F.col("ts").alias("read_ts"))
    compacted = flat.where("kind = 'wrapped' and type = 'compacted'").groupBy("session_id").agg(F.max("ts").alias("compacted_ts"))
    rows = flat.where("format = 'wrapped'").select("session_id").distinct()
    for part in (reading, compacted, flat_estimate(flat)):
        rows = rows.join(part, "session_id", "left")
    rows = _flags(rows, pending, locks)
    stale = F.coalesce(F.col("compacted_ts") > F.col("read_ts"), F.lit(False))
    shown = F.when(stale, F.coalesce("estimate", F.lit(0))).otherwise(F.col("tokens"))
    threshold = K.threshold_from_window(threshold_tokens, threshold_percent, F.col("context_window"))
    over = F.coalesce(shown >= threshold, F.lit(False))
    compacting = (F.col("locked") & over) | F.coalesce(F.col("pending") == "running", F.lit(False))
    mode = (
        F.when(compacting, "Compacting").when(F.coalesce(F.col("pending") == "ready", F.lit(False)), "Reload")
        .when(threshold.isNull(), "Active").when(over, "Over").otherwise("Waiting"))
    return rows.select(
        "session_id", mode.alias("mode"), shown.alias("tokens"), threshold.alias("threshold"), stale.alias("estimated"),
        T.progress_bar(shown, threshold, width).alias("bar"))


def trigger(
    tokens: DataFrame, signals: DataFrame, pending: DataFrame, locks: DataFrame, now: Column, threshold: int | None = None,
) -> DataFrame:
    """M3: (session_id, over, trigger, result) at time ``now``."""
    rows = _flags(tokens.select("session_id", F.col("approx_tokens").alias("tokens")), pending, locks).join(
        signals, "session_id", "left")
    limit = F.coalesce(F.lit(threshold).cast("double"), "start_threshold", "result_threshold")
    over = F.coalesce(F.col("tokens") >= limit, F.lit(False))
    recent = F.coalesce((F.unix_millis(now) - F.unix_millis("result_ts")) < RETRY_SECONDS * 1000, F.lit(False))
    due = reload_due(F.col("pending"), F.col("success_ts"), F.col("session_start_ts"))
    waiting = F.coalesce(F.col("pending").isin("running", "ready"), F.lit(False))
    go = over & ~due & ~F.col("locked") & ~waiting & ~recent
    return rows.select(
        "session_id", over.alias("over"), go.alias("trigger"),
        F.when(~over, "not_triggered").when(waiting, "pending_ready").when(go, "started").otherwise("suppressed").alias("result"))


def result_class(log: DataFrame) -> DataFrame:
    """M3: how the logged attempts of each session ended."""
    return log.where("event = 'auto_compact'").groupBy("session_id", F.coalesce("result", F.lit("?")).alias("result")).agg(
        F.count(F.lit(1)).alias("n"))


def flat_trigger(flat: DataFrame, pending: DataFrame, threshold_tokens: int | None = None, threshold_percent: float | None = None) -> DataFrame:
    """M3 for the flat format: the last reading of any kind, else the estimate; 90 000 without a window."""
    reading = S.last_token_reading(flat, need_tokens=False).select("session_id", "tokens", "context_window")
    rows = flat.where("format = 'wrapped'").select("session_id").distinct().join(reading, "session_id", "left").join(
        flat_estimate(flat), "session_id", "left").join(
        pending.select("session_id", F.col("status").alias("pending")), "session_id", "left")
    limit = F.coalesce(K.threshold_from_window(threshold_tokens, threshold_percent, F.col("context_window")), F.lit(K.FALLBACK_THRESHOLD))
    used = F.coalesce("tokens", "estimate", F.lit(0).cast("bigint"))
    waiting = F.coalesce(F.col("pending").isin("running", "ready"), F.lit(False))
    return rows.select(
        "session_id", used.alias("tokens"), limit.cast("bigint").alias("threshold"),
        F.when(used < limit, "not_triggered").when(waiting, "pending_ready").otherwise("started").alias("result"))


def current_by_cwd(turns: DataFrame) -> DataFrame:
    """M4: latest thread per directory; ``turns`` has cwd, thread_id, turn_id, ts, seq."""
    return turns.groupBy("cwd").agg(F.max(F.struct("ts", "seq", "thread_id", "turn_id")).alias("t")).select(
        "cwd", F.col("t.thread_id").alias("thread_id"), F.col("t.turn_id").alias("turn_id"), F.col("t.ts").alias("updated_at"))


def quiet_sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """M5: closed activity windows per session; a closed window means the session was quiet.

    A window opens where the instant before lies ``gap`` or more back. Instants are counted before they are
    ordered, in blocks of an hour, so no task holds a whole session.
    """
    hour = 3_600_000_000
    instants = events.where("ts is not null").groupBy("session_id", F.unix_micros("ts").alias("us")).agg(F.count(F.lit(1)).alias("same"))
    # Stored, as the next running value reads it twice.
    lagged = cut(running(instants, {"_prev": Running("last", F.col("us"), before=True)}, order=("us",), size=hour))
    after = lambda us: F.timestamp_micros(us) + F.expr(f"interval {gap}")
    opens = F.coalesce(F.timestamp_micros("us") >= after(F.col("_prev")), F.lit(True))
    placed = running(lagged, {"_first": Running("last", F.when(opens, F.col("us")))}, order=("us",), size=hour)
    return placed.groupBy("session_id", "_first").agg(F.max("us").alias("_last"), F.sum("same").alias("n")).select(
        "session_id", F.timestamp_micros("_first").alias("start_ts"), after(F.col("_last")).alias("quiet_at"), "n")


def quiet_files(looks: DataFrame, quiet_ms: int = 750) -> DataFrame:
    """M5: (path, size, mtime, quiet_ms): the first look that finds a signature which was there ``quiet_ms`` before.

    ``looks`` has (path, size, mtime, ts). A file's looks are ordered in blocks of an hour.
    """
    rows = looks.where("ts is not null").select(
        "path", "size", F.col("mtime").cast("bigint").alias("mtime"), F.unix_millis("ts").alias("ms"))
    hour = 3_600_000
    by = {"keys": ("path",), "order": ("ms", "size", "mtime"), "size": hour}
    lagged = running(rows, {"_prev": Running("last", F.struct("size", "mtime"), before=True)}, **by)
    fresh = ~F.coalesce(F.col("_prev") == F.struct("size", "mtime"), F.lit(False))
    placed = running(lagged, {"_since": Running("last", F.when(fresh, F.col("ms")))}, **by)
    return placed.where(F.col("ms") - F.col("_since") >= quiet_ms).where(~fresh).groupBy("path", "size", "mtime", "_since").agg(
        F.min("ms").alias("quiet_ms")).drop("_since")


def attempts(readings: DataFrame, retry_seconds: int = RETRY_SECONDS) -> DataFrame:
    """M3: (session_id, started_ms): instants at or over the threshold, each at least the retry time after the one before.

    Which instants start an attempt depends on the one before, so a session's attempts are found by doubling: every
    instant points at the first one that is late enough, and the chain from the session's first instant is walked.
    """
    rows = readings.where("tokens >= threshold and ts is not null").select("session_id", F.unix_millis("ts").alias("ms")).distinct()
    wait = retry_seconds * 1000
    # The first instant at or after ms + wait: asks are placed just before the instants of the same value.
    marks = rows.select("session_id", (-F.col("ms")).alias("back"), F.lit(0).alias("ask"), "ms").unionByName(
        rows.select("session_id", (-F.col("ms") - wait).alias("back"), F.lit(1).alias("ask"), "ms"))
    near = running(marks, {"nxt": Running("last", F.when(F.col("ask") == 0, F.col("ms")))}, order=("back", "ask"), size=3_600_000)
    jumps = cut(near.where("ask = 1 and nxt is not null").select("session_id", "ms", "nxt"))
    reached = cut(rows.groupBy("session_id").agg(F.min("ms").alias("ms")))
    known = reached.count()
    while True:
        step = reached.join(jumps, ["session_id", "ms"]).select("session_id", F.col("nxt").alias("ms"))
        reached = cut(reached.unionByName(step).distinct())
        now = reached.count()
        if now == known:
            return reached.select("session_id", F.col("ms").alias("started_ms"))
        known = now
        onward = jumps.select("session_id", F.col("ms").alias("nxt"), F.col("nxt").alias("far"))
        jumps = cut(jumps.join(onward, ["session_id", "nxt"]).select("session_id", "ms", F.col("far").alias("nxt")))


def gap_windows(beats: DataFrame, width: str = "1 day") -> DataFrame:
    """M6: gap statistics per session and tumbling window."""
    placed = beats.withColumn("w", F.window("ts", width)).withColumn("window_start", F.col("w.start"))
    return S.gap_stats(placed.select("session_id", "window_start", "ts"), keys=("session_id", "window_start"))


def counters(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """M7: attempts, results and tokens per session and hour, of repeated rows the one on the lowest line counts.

    Rows without line numbers (a stream's) go by their values instead.
    """
    values = F.struct("result", "tokens")
    first = F.min_by(values, F.col("line") if "line" in log.columns else values).alias("x")
    rows = log.groupBy("session_id", "ts", "event").agg(first).select("session_id", "ts", "event", "x.*")
    return rows.groupBy("session_id", F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("result") == "success").alias("successes"),
        F.count_if(F.col("result") == "failed").alias("failures"), F.sum("tokens").cast("bigint").alias("tokens"),
    ).select("session_id", F.col("w.start").alias("hour"), "n", "successes", "failures", "tokens")
