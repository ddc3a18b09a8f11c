"""Streams run over drops must equal their batch twins."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomlog.operators import monitor as M
from loomlog.streaming import monitor as SM
from loomlog.streaming import state as ST

T0 = datetime(2024, 1, 1)


def run(df, tmp_path, mode="append"):
    name = f"q{abs(hash(str(tmp_path)))}"
    query = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    return df.sparkSession.table(name)


def collected(df, checkpoint, mode, out):
    """Rows of one run of a stream, kept as files since the sink of a second run starts empty."""
    def keep(batch, _):
        batch.write.mode("append").parquet(str(out))

    query = df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return df.sparkSession.read.parquet(str(out)).orderBy("updated_ms").collect()


def drops(spark, tmp_path, rows, schema, files=3):
    """The rows in time order over several files, then one late closing row in its own file."""
    path = str(tmp_path / "in")
    for i in range(files):
        part = rows[i * len(rows) // files:(i + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


LOG = "session_id string, ts timestamp, event string, result string, threshold double, tokens double"


def log_rows():
    rows = []
    for i in range(60):
        ts = T0 + timedelta(minutes=7 * i)
        row = (f"s{i % 3}", ts, "auto_compact", "success" if i % 2 else "failed", 50.0, float(i))
        rows += [row, row] if i % 10 == 0 else [row]
    return rows


def closer(session="zz"):
    return (session, T0 + timedelta(days=9), "end", None, 1.0, 0.0)


def test_counters_equal_batch(spark, tmp_path):
    rows = log_rows()
    stream = drops(spark, tmp_path, rows + [closer(), closer()], LOG)
    got = run(SM.counters(stream), tmp_path).where("session_id <> 'zz'")
    want = M.counters(spark.createDataFrame(rows, LOG))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sum(r.n for r in want.collect()) == 60


def test_quiet_sessions_equal_batch(spark, tmp_path):
    rows = [(f"s{i % 2}", T0 + timedelta(hours=h), "e", None, 1.0, 1.0) for i, h in enumerate([0, 0, 1, 2, 9, 9, 20, 21])]
    stream = drops(spark, tmp_path, rows + [closer(), closer()], LOG)
    got = run(SM.quiet_sessions(stream), tmp_path).where("session_id <> 'zz'")
    want = M.quiet_sessions(spark.createDataFrame(rows, LOG))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def beats(seed, n):
    """Beats in arrival order: some minutes late, some twice."""
    rng = random.Random(seed)
    at = sorted(rng.sample(range(0, 40_000_000), n))
    arrived = sorted(at + at[::9], key=lambda ms: ms + rng.randint(0, 400_000))
    return [("s" if ms % 3 else "t", T0 + timedelta(milliseconds=ms), "heartbeat", None, 1.0, 1.0) for ms in arrived]


@pytest.mark.parametrize("n", [5, 400])
def test_gap_windows_with_late_beats_equal_batch(spark, tmp_path, n):
    rows = beats(n, n)
    stream = drops(spark, tmp_path, rows + [closer()] * (n // 4), LOG, files=4)
    got = run(ST.beat_gaps(stream, width="6 hours"), tmp_path).where("session_id <> 'zz'")
    want = M.gap_windows(spark.createDataFrame(list(set(rows)), LOG), "6 hours")
    fields = ["session_id", "window_start", "beats", "gaps", "gap_min", "gap_median", "gap_p95", "gap_max"]
    rounded = lambda rows: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows.select(fields).collect())
    assert rounded(got) == rounded(want)


def test_gap_state_grows_with_different_gaps_only(spark, tmp_path):
    """After the watermark has passed, ten thousand equal gaps are one entry and no beat is kept."""
    rows = [("s", T0 + timedelta(seconds=i), "heartbeat", None, 1.0, 1.0) for i in range(10_000)]
    late = [("s", T0 + timedelta(hours=20, seconds=k), "heartbeat", None, 1.0, 1.0) for k in (0, 1) for _ in range(2500)]
    stream = drops(spark, tmp_path, rows + late, LOG, files=6)  # the last file comes when the watermark has passed the first beats
    run(ST.beat_gaps(stream), tmp_path)
    state = spark.read.format("statestore").option("path", str(tmp_path / "ck"))
    assert state.option("stateVarName", "gaps").load().count() <= 2
    assert state.option("stateVarName", "waiting").load().count() <= 2


def test_latest_by_cwd_equals_batch_after_a_restart(spark, tmp_path):
    schema = "cwd string, thread_id string, turn_id string, ts timestamp, seq bigint"
    rng = random.Random(2)
    rows = [(f"/w{i % 3}", f"th{i}", str(i), T0 + timedelta(seconds=i + rng.randint(0, 20)), i) for i in range(40)]
    path = str(tmp_path / "in")
    found = []
    for part in (rows[:25], rows[25:]):  # the second run goes on from the checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        out = tmp_path / f"out{len(found)}"
        found.append(collected(ST.latest_by_cwd(stream), tmp_path / "ck", "update", out))
    last = {}
    for batch in found:
        for r in batch:
            last[r.cwd] = (r.thread_id, r.turn_id, r.updated_ms)
    want = M.current_by_cwd(spark.createDataFrame(rows, schema)).select("cwd", "thread_id", "turn_id", F.unix_millis("updated_at").alias("ms"))
    assert last == {r.cwd: (r.thread_id, r.turn_id, r.ms) for r in want.collect()}


def test_state_of_idle_directories_is_freed(spark, tmp_path):
    schema = "cwd string, thread_id string, turn_id string, ts timestamp, seq bigint"
    rows = [(f"/w{i}", "t", "u", T0, i) for i in range(8)] + [("/late", "t", "u", T0 + timedelta(days=20), 9)] * 4
    run(ST.latest_by_cwd(drops(spark, tmp_path, rows, schema)), tmp_path, "update")
    left = spark.read.format("statestore").option("path", str(tmp_path / "ck")).option("stateVarName", "turn").load()
    assert left.count() == 1


def test_attempts_wait_for_the_retry_time(spark, tmp_path):
    at = [0, 10, 29, 30, 45, 61, 100]
    rows = [("s", T0 + timedelta(seconds=x), "reading", None, 50.0, 60.0) for x in at]
    rows.insert(3, ("s", T0 + timedelta(seconds=29.5), "reading", None, 50.0, 40.0))
    rows[1], rows[4] = rows[4], rows[1]  # out of order, within the watermark
    first = spark.createDataFrame(rows[:1], LOG).select(F.unix_millis("ts")).first()[0]
    batch = M.attempts(spark.createDataFrame(rows, LOG))
    assert sorted((r.started_ms - first) // 1000 for r in batch.collect()) == [0, 30, 61, 100]
    got = run(ST.trigger_attempts(drops(spark, tmp_path, rows + [("zz", T0 + timedelta(days=1), "reading", None, 50.0, 60.0)] * 4, LOG)), tmp_path)
    assert sorted((r.started_ms - first) // 1000 for r in got.where("session_id = 's'").collect()) == [0, 30, 61, 100]


def test_random_attempts_equal_a_plain_walk(spark, tmp_path):
    rng = random.Random(7)
    rows = [(f"s{rng.randrange(3)}", T0 + timedelta(milliseconds=rng.randrange(900_000)), "reading", None, 50.0, rng.choice([40.0, 60.0])) for _ in range(300)]
    got = {(r.session_id, r.started_ms) for r in M.attempts(spark.createDataFrame(rows, LOG)).collect()}
    base = spark.createDataFrame([("s", T0)], "s string, ts timestamp").select(F.unix_millis("ts")).first()[0]
    want, last = set(), {}
    for s, ts, _, _, limit, tokens in sorted(rows, key=lambda r: r[1]):
        ms = base + round((ts - T0).total_seconds() * 1000)
        if tokens >= limit and ms - last.get(s, -1e18) >= 30_000:
            want.add((s, ms))
            last[s] = ms
    assert got == want


def test_quiet_files_equal_batch(spark, tmp_path):
    rng = random.Random(4)
    schema = "path string, size bigint, mtime bigint, ts timestamp"
    rows, state = [], {}
    for k in range(120):
        for path in ("a", "b", "c"):
            if rng.random() < 0.3 or path not in state:
                state[path] = (rng.randrange(3), rng.randrange(3))
            rows.append((path, *state[path], T0 + timedelta(milliseconds=250 * k)))
    end = [("zz", 1, 1, T0 + timedelta(days=3))] * 40
    got = run(ST.quiet_files(drops(spark, tmp_path, rows + end, schema)), tmp_path).where("path <> 'zz'")
    want = M.quiet_files(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect())) and want.count() > 5


def test_control_log_counts_pending_commands_once(spark, tmp_path):
    schema = "run_id string, cmd string, ts timestamp, reason string"
    rows = [("r1", "reload", T0 + timedelta(seconds=s), f"x{s}") for s in (0, 1, 2, 15)]
    rows += [("r1", "stop", T0, "no"), ("zz", "reload", T0 + timedelta(days=1), "end"), ("zz", "reload", T0 + timedelta(days=1), "end")]
    got = run(SM.follow_control_log(drops(spark, tmp_path, rows, schema)), tmp_path).where("run_id = 'r1'")
    assert sorted((r.commands, r.reason) for r in got.collect()) == [(1, "x15"), (3, "x2")]
