"""M3-M6 with keyed state: one processor per key, state freed by event-time timers.

Late rows within the watermark give the batch answer, and a restart goes on from the state in the checkpoint. State
is a few values per key; it needs the RocksDB provider, which :func:`keyed` sets for the session.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomlog.operators.monitor import RETRY_SECONDS
from loomlog.session import ship_by_value

ship_by_value(__name__)

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    """``rows`` must have a watermark."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, mode, "eventTime")


def _timer(handle: StatefulProcessorHandle, at: int) -> None:
    """The key's only timer."""
    for old in list(handle.listTimers()):
        if old != at:
            handle.deleteTimer(old)
    handle.registerTimer(at)


class Latest(StatefulProcessor):
    """The latest turn of a directory; forgotten when nothing came for ``keep_ms``."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "ms bigint, seq bigint, thread_id string, turn_id string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found = [t for pdf in rows for t in pdf[["ms", "seq", "thread_id", "turn_id"]].itertuples(index=False, name=None)]
        best = max(found, key=lambda t: (t[0], t[1], t[2] or "", t[3] or ""))
        if self.turn.exists():
            old = tuple(self.turn.get())
            if (old[0], old[1], old[2] or "", old[3] or "") >= (best[0], best[1], best[2] or "", best[3] or ""):
                return
        best = (int(best[0]), int(best[1]), best[2], best[3])
        self.turn.update(best)
        _timer(self.handle, best[0] + self.keep_ms)
        yield pd.DataFrame({"cwd": [key[0]], "thread_id": [best[2]], "turn_id": [best[3]], "updated_ms": [best[0]]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.turn.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_by_cwd(turns: DataFrame, delay: str = "10 minutes", keep_ms: int = 14 * 86_400_000) -> DataFrame:
    """M4: (cwd, thread_id, turn_id, updated_ms), a row whenever a directory's latest turn changes (update mode)."""
    rows = turns.where("ts is not null and cwd is not null").withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    return keyed(rows.select("cwd", "ts", "ms", "seq", "thread_id", "turn_id"), ["cwd"], Latest(keep_ms),
                 "cwd string, thread_id string, turn_id string, updated_ms bigint", "Update")


class Attempts(StatefulProcessor):
    """When the last attempt of a session began; freed when the retry time is over.

    Readings wait until the watermark has passed them, so that those of several batches are judged in order.
    """

    def __init__(self, retry_ms: int):
        self.retry_ms = retry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint")
        self.waiting = handle.getMapState("waiting", "ms bigint", "n int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            for ms in pdf["ms"].unique().tolist():
                self.waiting.updateValue((ms,), (1,))
                first = ms if first is None else min(first, ms)
        timers = list(self.handle.listTimers())
        if first is not None and not (timers and min(timers) <= first + 1):
            _timer(self.handle, first + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        times = sorted(k[0] for k in self.waiting.keys())
        last = self.last.get()[0] if self.last.exists() else None
        started = []
        for ms in times:
            if ms >= now:
                break
            if last is None or ms - last >= self.retry_ms:
                started.append(ms)
                last = ms
            self.waiting.removeKey((ms,))
        later = [ms for ms in times if ms >= now]
        if last is not None and last + self.retry_ms >= now:
            self.last.update((last,))
            later.append(last + self.retry_ms)
        else:
            self.last.clear()
        if later:
            self.handle.registerTimer(min(later) + 1)
        if started:
            yield pd.DataFrame({"session_id": [key[0]] * len(started), "started_ms": started})

    def close(self) -> None:
        pass


def trigger_attempts(readings: DataFrame, delay: str = "1 minute", retry_seconds: int = RETRY_SECONDS) -> DataFrame:
    """M3: (session_id, started_ms) for readings at or over their threshold; no attempt within the retry time of another.

    Readings below it are dropped before the exchange. The state holds the instants newer than the watermark and the
    last attempt.
    """
    over = readings.where("tokens >= threshold and ts is not null").withWatermark("ts", delay)
    rows = over.select("session_id", "ts", F.unix_millis("ts").alias("ms"))
    return keyed(rows, ["session_id"], Attempts(retry_seconds * 1000), "session_id string, started_ms bigint", "Append")


class Gaps(StatefulProcessor):
    """Counts of the gaps of one window. Only beats newer than the watermark are kept as such.

    A beat that comes late falls between beats that still wait, so it parts a gap before the gap is counted.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "last bigint, beats bigint")
        self.waiting = handle.getMapState("waiting", "ms bigint", "n int")
        self.gaps = handle.getMapState("gaps", "gap bigint", "n bigint")

    def settle(self, upto: int | None) -> tuple[int, int]:
        last, beats = self.settled.get() if self.settled.exists() else (None, 0)
        new: dict[int, int] = {}
        for ms in sorted(k[0] for k in self.waiting.keys()):
            if upto is not None and ms >= upto:
                break
            if last is not None:
                new[ms - last] = new.get(ms - last, 0) + 1
            last, beats = ms, beats + 1
            self.waiting.removeKey((ms,))
        for gap, n in new.items():
            before = self.gaps.getValue((gap,))[0] if self.gaps.containsKey((gap,)) else 0
            self.gaps.updateValue((gap,), (before + n,))
        if last is not None:
            self.settled.update((last, beats))
        return last, beats

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for ms in pdf["ms"].unique().tolist():
                self.waiting.updateValue((ms,), (1,))
            end = int(pdf["end_ms"].iloc[0])
        self.settle(timerValues.getCurrentWatermarkInMs())
        self.handle.registerTimer(end)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        _, beats = self.settle(None)
        counts = sorted((k[0], v[0]) for k, v in self.gaps.iterator())
        n = sum(c for _, c in counts)

        def at(rank: int) -> int:
            for gap, c in counts:
                rank -= c
                if rank < 0:
                    return gap
            raise IndexError

        out = [at(0) / 1000, (at((n - 1) // 2) + at(n // 2)) / 2000, at(95 * (n - 1) // 100) / 1000, at(n - 1) / 1000] if n else [None] * 4
        self.settled.clear()
        self.waiting.clear()
        self.gaps.clear()
        yield pd.DataFrame({
            "session_id": [key[0]], "window_ms": [key[1]], "beats": [beats], "gaps": [n],
            **{c: pd.Series([x], dtype="float64") for c, x in zip(("gap_min", "gap_median", "gap_p95", "gap_max"), out)}})

    def close(self) -> None:
        pass


def beat_gaps(beats: DataFrame, delay: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """M6: number, extremes, median and p95 of the gaps per session and tumbling window, once a window is over."""
    rows = beats.where("ts is not null").withWatermark("ts", delay).withColumn("w", F.window("ts", width)).select(
        "session_id", F.unix_millis("w.start").alias("window_ms"), F.unix_millis("w.end").alias("end_ms"), "ts", F.unix_millis("ts").alias("ms"))
    schema = "session_id string, window_ms bigint, beats bigint, gaps bigint, gap_min double, gap_median double, gap_p95 double, gap_max double"
    found = keyed(rows, ["session_id", "window_ms"], Gaps(), schema, "Append")
    return found.withColumn("window_start", F.timestamp_millis("window_ms")).drop("window_ms")


class Quiet(StatefulProcessor):
    """The signature of a file, since when it has been seen, and whether it was reported."""

    def __init__(self, quiet_ms: int, keep_ms: int):
        self.quiet_ms, self.keep_ms = quiet_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.signature = handle.getValueState("signature", "size bigint, mtime bigint, since bigint, seen bigint, told boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seen = sorted(t for pdf in rows for t in pdf[["ms", "size", "mtime"]].itertuples(index=False, name=None))
        state = tuple(self.signature.get()) if self.signature.exists() else None
        out = []
        for ms, size, mtime in seen:
            if state is not None and ms < state[3]:
                continue  # an older look at the file
            if state is None or (size, mtime) != state[:2]:
                state = (size, mtime, ms, ms, False)
            else:
                told = state[4] or ms - state[2] >= self.quiet_ms
                if told and not state[4]:
                    out.append((key[0], size, mtime, ms))
                state = (size, mtime, state[2], ms, told)
        self.signature.update(tuple(x if isinstance(x, bool) else int(x) for x in state))
        _timer(self.handle, int(state[3]) + self.keep_ms)
        if out:
            yield pd.DataFrame(out, columns=["path", "size", "mtime", "quiet_ms"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.signature.clear()
        return iter(())

    def close(self) -> None:
        pass


def quiet_files(looks: DataFrame, quiet_ms: int = 750, delay: str = "1 minute", keep_ms: int = 86_400_000) -> DataFrame:
    """M5: (path, size, mtime, quiet_ms) when a look finds the size and time that were there ``quiet_ms`` before.

    ``looks`` has (path, size, mtime, ts), in order for each file (a lister's). A changed file starts anew, and each
    signature is reported once. Files not looked at for ``keep_ms`` are forgotten.
    """
    rows = looks.where("ts is not null").withWatermark("ts", delay).select(
        "path", "size", F.col("mtime").cast("bigint").alias("mtime"), "ts", F.unix_millis("ts").alias("ms"))
    return keyed(rows, ["path"], Quiet(quiet_ms, keep_ms), "path string, size bigint, mtime bigint, quiet_ms bigint", "Append")
