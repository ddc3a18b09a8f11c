"""The catalog of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions import jsonv as J
from loomlog.functions import paths as P
from loomlog.operators.ordered import first_rows
from loomlog.operators.stats import last_activity, newest_first
from loomlog.sources.lines import detect_format, head, invalid_counts, tail


def confidence(score: Column, method: Column) -> Column:
    return (
        F.when(method == "session-id", "high").when(method == "fallback", "low")
        .when(score >= 140, "high").when(score >= 80, "medium").otherwise("low")
    )


def safe_top(age_gap_hours: Column, score_gap: Column) -> Column:
    """The runner-up is at least 6 h older or 30 points lower."""
    return (age_gap_hours >= 6) | (score_gap >= 30)


def ranked(scored: DataFrame, key: list[str], keep: int = 6) -> DataFrame:
    """The best candidate and its alternatives per key, by activity, score, mtime and path.

    The report is a top list (``keep`` rows); every task keeps only its own best
    rows before the exchange, so the size of a project does not matter. The
    winner's confidence obeys W9.
    """
    order = [F.col("activity").desc(), F.col("score").desc(), F.col("mtime").desc(), F.col("path").asc()]
    top = first_rows(scored, max(keep, 2), order, tuple(key))
    w = Window.partitionBy(*key).orderBy(*order)
    gap_h = (F.unix_millis("activity") - F.unix_millis(F.lead("activity").over(w))) / 3_600_000
    gap_s = F.col("score") - F.lead("score").over(w)
    base = confidence(F.col("score"), F.col("method"))
    doubtful = (F.col("rank") == 1) & (base == "high") & ~F.coalesce(safe_top(F.col("_gh"), F.col("_gs")), F.lit(True))
    return (
        top.withColumn("rank", F.row_number().over(w)).withColumn("_gh", gap_h).withColumn("_gs", gap_s)
        .withColumn("confidence", F.when(doubtful, "medium").otherwise(base)).drop("_gh", "_gs")
        .where(F.col("rank") <= keep)
    )


def runner_up(alternatives: DataFrame) -> DataFrame:
    """First alternative that is not the hit itself; (project, hit_path, path, rank)."""
    other = alternatives.where(F.col("path") != F.col("hit_path"))
    return newest_first(other, ["project"], [F.col("rank").asc()])


def _newest(files: DataFrame, key: list[str], n: int) -> DataFrame:
    return first_rows(files, n, [F.col("mtime").desc(), F.col("path").asc()], tuple(key))


def _with_messages(rows: DataFrame) -> DataFrame:
    kind = J.as_string(F.col("v"), "$.type")
    return rows.groupBy("session_id").agg(F.bool_or(F.coalesce(kind.isin("user", "assistant"), F.lit(False))).alias("talks"))


def has_messages(parsed: DataFrame, n_head: int | None = None, n_tail: int | None = None) -> DataFrame:
    """(session_id, talks) over all lines, or over a head and a tail."""
    columns = ["session_id", "line", "v"]
    if n_head is None or n_tail is None:
        return _with_messages(parsed.select(*columns))
    return _with_messages(head(parsed, n_head).select(*columns).unionByName(tail(parsed, n_tail).select(*columns)))


def rank_linked(
    parsed: DataFrame, files: DataFrame, projects: DataFrame, tail_lines: int | None = None, max_candidates: int | None = None,
    head_lines: int | None = None,
) -> DataFrame:
    """Candidates of each project, best first.

    ``files``: session_id, path, project_dir, mtime, size. ``projects``: project,
    cwd, project_dir (one row per accepted directory name).
    """
    pool = files.drop("cwd").join(projects.select("project", "cwd", "project_dir").distinct(), "project_dir")
    if max_candidates is not None:
        pool = _newest(pool, ["project"], max_candidates)
    top = head(parsed, head_lines)
    v = F.col("v")
    sid, cwd = J.as_id(v, "$.sessionId"), J.as_id(v, "$.cwd")
    first = top.groupBy("session_id").agg(
        F.bool_or(sid.isNotNull()).alias("any_id"), F.bool_or(F.coalesce(sid == F.col("session_id"), F.lit(False))).alias("own_id"),
        F.count_if(F.col("json_kind") == "invalid").alias("bad_head"),
    )
    last = tail(parsed, tail_lines).where("json_kind = 'object'").select("session_id", "line", J.as_string(v, "$.timestamp").alias("ts_raw"))
    facts = first
    for part in (last_activity(last), invalid_counts(parsed), has_messages(parsed, head_lines, tail_lines), detect_format(parsed)):
        facts = facts.join(part, "session_id", "left")
    at_home = top.select("session_id", cwd.alias("cwd")).where("cwd is not null").distinct().withColumn("at_home", F.lit(True))
    known = pool.join(facts, "session_id", "left").join(at_home, ["session_id", "cwd"], "left").where((F.col("size") == 0) | F.coalesce("talks", F.lit(False)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    detected = yes((F.col("agent") == "claude") & F.col("confidence").isin("high", "medium"))
    score = (
        F.lit(100)
        + F.when(yes(F.col("own_id")), 30).when(yes(F.col("any_id")), -10).otherwise(0)
        + F.when(yes(F.col("at_home")), 20).otherwise(0)
        + F.when(detected, 20).when(F.col("size") == 0, 0).otherwise(-100)
        + F.when(yes(F.col("bad_head") + F.col("invalid_lines") > 0), -50).otherwise(0)
    )
    scored = known.select(
        "project", "session_id", "path", "mtime", score.alias("score"), F.lit("cwd-hash").alias("method"),
        F.coalesce("last_activity_ts", "mtime").alias("activity"))
    return ranked(scored, ["project"])


def rollout_metas(parsed: DataFrame, n: int | None = None) -> DataFrame:
    """First session_meta row, of all lines or of the first ``n``: (session_id, has_meta, id, cwd, meta_ts)."""
    v = F.col("v")
    rows = head(parsed, n).where((F.col("json_kind") == "object") & (J.as_string(v, "$.type") == "session_meta"))
    facts = F.struct(
        "line", J.as_id(v, "$.payload.id").alias("id"), J.as_id(v, "$.payload.cwd").alias("cwd"),
        F.try_to_timestamp(J.as_string(v, "$.payload.timestamp")).alias("meta_ts"))
    return rows.groupBy("session_id").agg(F.min(facts).alias("m")).select(
        "session_id", F.lit(True).alias("has_meta"), F.col("m.id").alias("meta_id"), F.col("m.cwd").alias("meta_cwd"),
        F.col("m.meta_ts").alias("meta_ts"))


def _flat_facts(parsed: DataFrame, files: DataFrame, tail_lines: int | None, head_lines: int | None) -> DataFrame:
    v = F.col("v")
    bad_head = head(parsed, head_lines).groupBy("session_id").agg(F.count_if(F.col("json_kind") == "invalid").alias("bad_head"))
    last = tail(parsed, tail_lines).where("json_kind = 'object'").select(
        "session_id", "line", J.as_string(v, "$.timestamp").alias("ts_raw"))
    facts = files
    for part in (rollout_metas(parsed, head_lines), bad_head, last_activity(last), invalid_counts(parsed),
                 detect_format(parsed).select("session_id", "agent")):
        facts = facts.join(part, "session_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    base = (
        F.when(yes(F.col("has_meta")), 50).otherwise(0) + F.when(F.col("meta_id").isNotNull(), 10).otherwise(0)
        + F.when(yes(F.col("bad_head") + F.col("invalid_lines") > 0), -50).otherwise(0)
        + F.when(yes(F.col("agent") == "codex"), 20).otherwise(-100)
    )
    return facts.withColumn("base", base).withColumn(
        "activity", F.coalesce("last_activity_ts", F.timestamp_seconds(F.lit(0))))


def rank_flat(
    parsed: DataFrame, files: DataFrame, projects: DataFrame, tail_lines: int | None = None, head_lines: int | None = None,
) -> DataFrame:
    """Rollouts whose cwd matches a project, best first (an equi-join on cwd).

    Projects without any match use :func:`fallback_flat`.
    """
    hits = _flat_facts(parsed, files, tail_lines, head_lines).join(
        projects.select("project", F.col("cwd").alias("meta_cwd")).distinct(), "meta_cwd").select(
        "project", "session_id", "path", "mtime", (F.col("base") + 100).alias("score"), F.lit("cwd-hash").alias("method"), "activity")
    return ranked(hits, ["project"])


def fallback_flat(
    parsed: DataFrame, files: DataFrame, tail_lines: int | None = None, n: int = 5, head_lines: int | None = None,
) -> DataFrame:
    """T2 without any cwd match: the ``n`` best rollouts, the same for every such project."""
    score = F.col("base") + F.when(F.col("meta_cwd").isNotNull(), -10).otherwise(0)
    return _flat_facts(parsed, files, tail_lines, head_lines).select(
        "session_id", "path", "mtime", score.alias("score"), F.lit("fallback").alias("method"),
        F.lit("low").alias("confidence"), "activity",
    ).orderBy(F.col("activity").desc(), F.col("score").desc(), F.col("mtime").desc(), "path").limit(n)


def match_text(parsed: DataFrame, needle: str, tail_lines: int | None = None) -> DataFrame:
    """sessions whose lines, or whose last ``tail_lines``, contain the text in its re-serialised JSON."""
    rows = tail(parsed, tail_lines).where("json_kind <> 'invalid'")
    return rows.where(F.contains(F.lower(F.to_json("v")), F.lit(needle.lower()))).select("session_id").distinct()


def lookup(parsed: DataFrame, files: DataFrame, needle: str, tail_lines: int | None = None, n: int = 5) -> DataFrame:
    """Newest sessions that contain the text (in their last ``tail_lines``, if given)."""
    v = F.col("v")
    last = tail(parsed, tail_lines).where("json_kind = 'object'").select("session_id", "line", J.as_string(v, "$.timestamp").alias("ts_raw"))
    hits = files.join(match_text(parsed, needle, tail_lines), "session_id").join(last_activity(last), "session_id", "left").join(
        invalid_counts(parsed), "session_id", "left")
    score = F.lit(110) + F.when(F.coalesce("invalid_lines", F.lit(0)) > 0, -50).otherwise(0)
    return hits.select("session_id", "path", "mtime", score.alias("score"), "last_activity_ts").orderBy(
        F.coalesce("last_activity_ts", F.timestamp_seconds(F.lit(0))).desc(), F.col("score").desc(), F.col("mtime").desc(), "path").limit(n)


def lookup_ids(
    wanted: DataFrame, linked: DataFrame, linked_files: DataFrame, flat: DataFrame, flat_files: DataFrame,
    head_lines: int | None = None, tail_lines: int | None = None,
) -> DataFrame:
    """T3 by id: (session_id, agent, path, score, confidence) for each wanted id; the linked format comes first.

    ``linked`` and ``flat`` are parsed lines, the files (session_id, path, mtime, size). A linked file needs messages or
    no content at all, a flat one a session_meta row. Heads and tails are whole files unless bounded. An id that is
    found in neither has the agent ``unknown``.
    """
    ids = wanted.select("session_id").distinct()
    keep = lambda rows: rows.join(ids, "session_id", "left_semi")
    yes = lambda c: F.coalesce(c, F.lit(False))
    talks, bad = has_messages(keep(linked), head_lines, tail_lines), invalid_counts(keep(linked))
    near = keep(linked_files).join(talks, "session_id", "left").join(bad, "session_id", "left").where((F.col("size") == 0) | yes(F.col("talks")))
    first = newest_first(near, ["session_id"], [F.col("mtime").desc(), F.col("path").asc()]).select(
        "session_id", F.struct(F.lit("claude").alias("agent"), "path", (130 - F.when(yes(F.col("invalid_lines") > 0), 50).otherwise(0)).alias("score")).alias("a"))
    broken = head(keep(flat), head_lines).groupBy("session_id").agg(F.count_if(F.col("json_kind") == "invalid").alias("bad_head"))
    far = keep(flat_files).join(rollout_metas(keep(flat), head_lines).select("session_id"), "session_id", "left_semi").join(broken, "session_id", "left")
    second = newest_first(far, ["session_id"], [F.col("mtime").desc(), F.col("path").asc()]).select(
        "session_id", F.struct(F.lit("codex").alias("agent"), "path", (100 - F.when(yes(F.col("bad_head") > 0), 50).otherwise(0)).alias("score")).alias("b"))
    met = ids.join(first, "session_id", "left").join(second, "session_id", "left").withColumn("x", F.coalesce("a", "b"))
    return met.select(
        "session_id", F.coalesce("x.agent", F.lit("unknown")).alias("agent"), "x.path", F.col("x.score").cast("bigint").alias("score"),
        F.when(F.col("x").isNotNull(), confidence(F.col("x.score"), F.lit("session-id"))).otherwise("low").alias("confidence"))


def lookup_flat(parsed: DataFrame, files: DataFrame, needle: str, tail_lines: int | None = None, n: int = 5) -> DataFrame:
    """T3 by text for the flat format: newest files that contain it; each scores 10."""
    hits = files.join(match_text(parsed, needle, tail_lines), "session_id")
    return hits.select("session_id", "path", "mtime", F.lit(10).cast("bigint").alias("score")).orderBy(F.col("mtime").desc(), "path").limit(n)


def lookup_any(
    linked: DataFrame, linked_files: DataFrame, flat: DataFrame, flat_files: DataFrame, needle: str, tail_lines: int | None = None, n: int = 5,
) -> DataFrame:
    """T3 by text without an agent: the linked format's hits, or the flat format's if there are none."""
    first = lookup(linked, linked_files, needle, tail_lines, n).select("session_id", "path", F.col("score").cast("bigint").alias("score"), F.lit("claude").alias("agent"))
    second = lookup_flat(flat, flat_files, needle, tail_lines, n).select("session_id", "path", "score", F.lit("codex").alias("agent"))
    # At most n rows each.
    both = first.unionByName(second)
    return both.join(both.agg(F.min("agent").alias("agent")), "agent").select("session_id", "agent", "path", "score")


def newest_per_project(files: DataFrame, projects: DataFrame) -> DataFrame:
    """T5: newest transcript per project; the current directory name beats the older one."""
    real = files.where(~P.base_name(F.col("path")).startswith("agent-"))
    placed = real.join(projects.select("project", "project_dir", "name_version").distinct(), "project_dir")
    return placed.groupBy("project").agg(
        F.max_by("path", F.struct("name_version", "mtime", "path")).alias("path"))


def dedupe_latest(rows: DataFrame) -> DataFrame:
    """Newest file per session id."""
    return newest_first(rows, ["session_id"], [F.col("mtime").desc(), F.col("path").asc()])


def enrich(catalog: DataFrame, tracked: DataFrame) -> DataFrame:
    """Tracking state of each session; ``tracked`` has one row per session id."""
    return catalog.join(tracked.withColumn("tracked", F.lit(True)), "session_id", "left").na.fill(False, ["tracked"])


def catalog(linked_files: DataFrame, flat_files: DataFrame, tracked: DataFrame, limit: int | None = None) -> DataFrame:
    """T4: both listings with their tracking state, newest activity first."""
    columns = ["agent", "session_id", "path", "mtime", "cwd", "source"]
    a = linked_files.withColumn("agent", F.lit("claude")).withColumn("source", F.lit("claude-project"))
    b = dedupe_latest(flat_files).withColumn("agent", F.lit("codex")).withColumn("source", F.lit("codex-rollout"))
    both = enrich(a.select(*columns).unionByName(b.select(*columns)), tracked)
    placed = both.withColumn("sort_ts", F.coalesce("tracked_activity", "mtime"))
    return placed if limit is None else placed.orderBy(F.col("sort_ts").desc(), "session_id", "agent").limit(limit)


def search(rows: DataFrame, q: str) -> DataFrame:
    """F6."""
    text = q.strip().lower()
    hay = F.lower(F.concat_ws(" ", "agent", "session_id", "path", F.coalesce("cwd", F.lit("")), "source"))
    return rows if not text else rows.where(F.contains(hay, F.lit(text)))


def tracked_only(rows: DataFrame, limit: int = 80) -> DataFrame:
    """a display of the newest tracked sessions."""
    return rows.where("tracked").orderBy(F.col("sort_ts").desc(), "session_id", "agent").limit(limit)


def runs_with_handshakes(runs: DataFrame, handshakes: DataFrame) -> DataFrame:
    """J7."""
    return runs.join(handshakes, "run_id", "left").orderBy(F.col("started_at").desc(), "run_id")


def id_lookup(linked_ids: DataFrame, flat_ids: DataFrame, wanted: DataFrame) -> DataFrame:
    """Claude, codex, ambiguous or not_found per wanted id."""
    both = linked_ids.select("session_id", F.lit("claude").alias("agent")).unionByName(
        flat_ids.select("session_id", F.lit("codex").alias("agent")))
    found = both.groupBy("session_id").agg(F.min("agent").alias("a"), F.max("agent").alias("b"))
    return wanted.select("session_id").distinct().join(found, "session_id", "left").select(
        "session_id", F.when(F.col("a").isNull(), "not_found").when(F.col("a") != F.col("b"), "ambiguous").otherwise(F.col("a")).alias("verdict"))


def newer_rollout(metas: DataFrame, recorded: DataFrame) -> DataFrame:
    """Newest rollout of the same cwd that is newer than the recorded one.

    ``metas``: meta_id, meta_cwd, meta_ts, mtime. ``recorded``: cwd, thread_id, newer_than (timestamp or NULL).
    """
    fresh = F.coalesce("meta_ts", "mtime")
    rows = metas.where("meta_id is not null").select(
        F.col("meta_cwd").alias("cwd"), "meta_id", fresh.alias("fresh")).join(recorded, "cwd").where(
        (F.col("meta_id") != F.col("thread_id")) & (F.col("newer_than").isNull() | (F.col("fresh") > F.col("newer_than"))))
    return rows.groupBy("cwd", "thread_id").agg(F.max_by("meta_id", F.struct("fresh", "meta_id")).alias("newer_id"))


def session_by_priority(projects: DataFrame, handshakes: DataFrame, recorded: DataFrame, best: DataFrame) -> DataFrame:
    """Live run's handshake, else the recorded session, else a high-confidence candidate."""
    high = best.where("rank = 1 and confidence = 'high'").select("project", F.col("session_id").alias("_c"))
    return (
        projects.select("project", "cwd").distinct()
        .join(handshakes.select("cwd", F.col("session_id").alias("_a")), "cwd", "left")
        .join(recorded.select("cwd", F.col("thread_id").alias("_b")), "cwd", "left").join(high, "project", "left")
        .select("project", F.coalesce("_a", "_b", "_c").alias("session_id"),
                F.when(F.col("_a").isNotNull(), "handshake").when(F.col("_b").isNotNull(), "recorded")
                .when(F.col("_c").isNotNull(), "discovery").alias("origin")))


def expired_backups(backups: DataFrame, keep: int = 10) -> DataFrame:
    """K5: backups beyond the newest ``keep`` names of a session.

    The newest names are found with a pre-limiting rank; the rest is an anti-join.
    """
    rows = backups.where(F.col("name").endswith(".jsonl"))
    newest = first_rows(rows, keep, [F.col("name").desc()])
    return rows.join(newest.select("session_id", "name"), ["session_id", "name"], "left_anti")


def latest_backup(backups: DataFrame) -> DataFrame:
    """U5."""
    return backups.where(F.col("name").endswith(".jsonl")).groupBy("session_id").agg(F.max_by("path", "name").alias("path"))


def pins_upsert(pins: DataFrame, rows: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """K6: the new pin table, newest first, and the refused rows."""
    old = pins.select("name", *[F.col(c).alias(f"_{c}") for c in ("agent", "session_id", "session_path")])
    same = F.lit(True)
    for name in ("agent", "session_id", "session_path"):
        same = same & F.equal_null(name, f"_{name}")
    checked = rows.join(old, "name", "left").withColumn("_ok", F.lit(force) | F.col("_agent").isNull() | same)
    taken = checked.where("_ok").select(*rows.columns)
    kept = pins.join(taken.select("name"), "name", "left_anti")
    out = kept.unionByName(taken, allowMissingColumns=True).orderBy(F.try_to_timestamp("pinned_at").desc_nulls_last(), "name")
    return out, checked.where("not _ok").select(*rows.columns)


def retention(tracked: DataFrame, now: Column, max_age_days: float, delete: bool = False) -> DataFrame:
    """sessions whose last activity is at least that old: (session_id, age_days).

    A dry run skips sessions without activity; deleting falls back to the folder's time.
    """
    last = F.greatest("dir_mtime", "state_mtime", "log_mtime", "backups_mtime")
    last = F.coalesce(last, F.col("dir_mtime")) if delete else last
    age = (F.unix_millis(now) - F.unix_millis(last)) / (24 * 3_600_000)
    return tracked.select("session_id", age.alias("age_days")).where(F.col("age_days") >= max_age_days)


def stale_runs(records: DataFrame, valid: DataFrame, live_pids: DataFrame) -> DataFrame:
    """M9: what to remove: (kind, path, reason). Liveness is an input."""
    bad = records.select("path").join(valid.select("path"), "path", "left_anti").select(
        F.lit("remove_active_record").alias("kind"), "path", F.lit("invalid_record").alias("reason"))
    dead = valid.join(live_pids.select("pid"), "pid", "left_anti")
    gone = dead.select(F.lit("remove_active_record").alias("kind"), "path", F.lit("pid_not_alive").alias("reason"))
    dirs = dead.select(F.lit("remove_control_dir").alias("kind"), F.col("control_dir").alias("path"), F.lit("pid_not_alive").alias("reason"))
    return bad.unionByName(gone).unionByName(dirs).dropDuplicates(["kind", "path"])


def layered_settings(settings: DataFrame) -> DataFrame:
    """Value and source of each setting; default < global < local.

    ``settings``: scope, setting, layer, value; NULL values do not override.
    """
    order = F.when(F.col("layer") == "local", 3).when(F.col("layer") == "global", 2).otherwise(1)
    return settings.where("value is not null").groupBy("scope", "setting").agg(
        F.max_by(F.struct("value", "layer"), order).alias("s")).select(
        "scope", "setting", F.col("s.value").alias("value"), F.col("s.layer").alias("source"))
