"""Transcripts derived from the driver tables by a fixed rule.

Conversations become linked-format sessions, events become flat-format
sessions, long linked sessions and the tools' own event log. Every rule uses
only integers and the given columns, so plain SQL can repeat it. The rows are
built as JSON text: everything downstream starts at the raw line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.functions import jsonv as J
from loomlog.operators.ordered import BLOCK_LINES, Running, running, with_block
from loomlog.operators.graph import active_chain
from loomlog.operators.stats import message_tokens
from loomlog.session import configure, cut, spread, store_path
from loomlog.sources.documents import read_log, write_jsonl
from loomlog.sources.lines import flat_lines, linked_lines, parse_lines, split_lines
from loomlog.sources.tables import once

EPOCH = 1704067200  # 2024-01-01T00:00:00Z


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; a scan with fewer splits than cores is spread first.

    Building JSON text multiplies the work per row, and a small compressed file
    is a single split. With enough splits there is no exchange.
    """
    configure(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _json(*fields: str) -> str:
    return f"to_json(named_struct({', '.join(fields)}))"


def chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked sessions from conversations: one session per conv_id, line = turn + 1."""
    c, t = "conv_id", "turn"
    stamp = f"date_format(timestamp_seconds({EPOCH} + {c} * 3600 + {t} * 60), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    base = table(spark, sf_dir, "conversations").selectExpr(
        "*",
        f"role = 'system' or ({c} + {t}) % 11 = 7 as bnd",
        f"({c} + 2 * {t}) % 23 = 11 as snap",
    ).selectExpr(
        "*",
        "case when bnd then 'system' when snap then 'file-history-snapshot' else role end as typ",
        f"case when {t} = 0 then null when ({c} * 7 + {t}) % 13 = 0 then concat({c}, '-x', {t}) "
        f"when {t} >= 2 and ({c} + {t}) % 9 = 4 then concat({c}, '-', {t} - 2) else concat({c}, '-', {t} - 1) end as par",
        _json("'type'", "'text'", "'text'", "text") + " as b_text",
        f"case when role = 'assistant' and {t} % 4 <> 3 then "
        + _json("'type'", "'tool_use'", "'id'", f"concat({c}, ':', {t})", "'name'", f"concat('tool', {t} % 3)",
                "'input'", f"named_struct('q', {t})") + " end as b_use",
        f"case when role = 'assistant' and ({c} + {t}) % 3 = 0 then "
        + _json("'type'", "'thinking'", "'thinking'", f"concat('think ', {t})") + " end as b_think",
        f"case when role = 'user' and {t} >= 1 then "
        + _json("'type'", "'tool_result'", "'tool_use_id'", f"concat({c}, ':', {t} - 1)", "'content'", f"concat('done ', {t})")
        + " end as b_res",
        f"case when role = 'user' and {t} >= 1 and {c} % 5 = 0 then "
        + _json("'type'", "'tool_result'", "'tool_use_id'", f"concat({c}, ':', {t} + 50)", "'content'", "'late'")
        + " end as b_late",
    ).selectExpr(
        "*",
        "case when role = 'assistant' or b_res is not null then concat('[', concat_ws(',', "
        f"case when {c} % 2 = 0 then b_think end, b_res, b_late, b_text, b_use, case when {c} % 2 = 1 then b_think end), ']') "
        "else to_json(to_variant_object(array(text))) end as content0",
    ).selectExpr(
        "*",
        "case when role = 'assistant' or b_res is not null then content0 "
        "else substring(content0, 2, length(content0) - 2) end as content",
    )
    text = lambda name, value: f"concat('\"{name}\":\"', {value}, '\"')"
    parts = [
        text("type", "typ"),
        "case when bnd then '\"subtype\":\"compact_boundary\"' end",
        text("uuid", f"concat({c}, '-', {t})"),
        "coalesce(" + text("parentUuid", "par") + ", '\"parentUuid\":null')",
        text("sessionId", f"concat('sess-', case when ({c} + {t}) % 31 = 5 then {c} + 1 else {c} end)"),
        text("cwd", f"concat('/work/p', {c} % 10)"),
        text("timestamp", stamp),
        f"case when {t} = 0 and {c} % 7 = 2 then '\"isMeta\":true' end",
        f"case when ({c} * 5 + {t}) % 19 = 3 then '\"isApiErrorMessage\":true' end",
        f"case when {c} % 13 = 4 then " + f"concat('\"isSidechain\":true,\"agentId\":\"agent-', {c} % 3, '\"')" + " end",
        f"concat('\"message\":{{', case when role = 'assistant' then concat('\"id\":\"msg-', {c}, '-', {t} div 3, '\",') else '' end, "
        "'\"role\":\"', role, '\",\"content\":', content, '}')",
    ]
    raw = f"concat('{{', concat_ws(',', {', '.join(parts)}), '}}')"
    return base.selectExpr(
        f"cast({c} as string) as session_id",
        f"cast({t} + 1 as bigint) as line",
        f"case when ({c} + {t}) % 29 = 13 then substring({raw}, 1, 20) else {raw} end as raw",
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"
    return table(spark, sf_dir, "events").selectExpr(
        "*", "event_id as e", "user_id as u", f"{stamp} as stamp",
        "case when event_id % 41 <> 7 then concat(user_id, ':', event_id % 24) end as cid",
        "concat('event ', event_type, ' value ', cast(floor(value) as bigint), ' ', "
        "case when event_id % 7 = 0 then concat('<environment_context><cwd>/work/p', user_id % 10, '</cwd></environment_context>') else '' end) as note",
    )


_CALL = "named_struct('type', %s, 'call_id', cid, 'name', concat('tool', e %% 5), 'arguments', concat('{\"e\":', e, '}'))"
_OUTPUT = "named_struct('type', %s, 'call_id', cid, 'output', concat('out ', e))"
_MESSAGE = (
    "named_struct('type', 'message', 'role', %s, 'content', "
    "array(named_struct('type', case when %s = 'assistant' then 'output_text' else 'input_text' end, 'text', note)))"
)


def rollout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped flat sessions from events: session = user_id, line = event_id + 1."""
    role = "case e % 4 when 0 then 'developer' when 2 then 'assistant' else 'user' end"
    usage = (
        "named_struct('type', 'token_count', 'info', named_struct("
        "'last_token_usage', case when e % 3 <> 0 then named_struct('total_tokens', cast(floor(value * 1000) as bigint)) end, "
        "'total_token_usage', named_struct('total_tokens', cast(floor(value * 2000) as bigint)), 'model_context_window', 200000))"
    )
    history = (
        "concat('{\"message\":\"sum ', e, '\"', case e % 3 when 0 then concat(',\"replacement_history\":[', "
        + "to_json(" + _MESSAGE % ("'user'", "'user'") + "), ']') when 1 then '' else ',\"replacement_history\":\"bad\"' end, '}')"
    )
    policy = (
        "case e % 4 when 0 then '{\"sandbox_policy\":{\"mode\":\"ro\"}}' when 1 then '{\"sandbox_policy\":{\"type\":\"ro\"}}' "
        "when 2 then '{\"sandbox_policy\":{\"mode\":\"ro\",\"type\":\"rw\"}}' else '{\"sandbox_policy\":{}}' end"
    )
    return _events(spark, sf_dir).selectExpr(
        "*",
        "case when e % 97 = 5 then 'session_meta' when event_type <> 'error' then 'response_item' "
        "when e % 5 = 0 then 'compacted' when e % 5 = 1 then 'turn_context' when e % 5 = 4 then 'event_msg' "
        "else 'response_item' end as typ",
    ).selectExpr(
        "*",
        "case when typ = 'session_meta' then to_json(named_struct('id', case when e % 2 = 0 then concat('conv-', u) end, "
        "'timestamp', stamp, 'cwd', concat('/work/p', u % 10))) "
        f"when typ = 'compacted' then {history} when typ = 'turn_context' then {policy} "
        f"when typ = 'event_msg' then to_json({usage}) "
        f"when event_type = 'click' then to_json({_CALL % repr('function_call')}) "
        f"when event_type = 'view' then to_json({_OUTPUT % repr('function_call_output')}) "
        f"when event_type = 'purchase' then to_json({_CALL % repr('custom_tool_call')}) "
        f"when event_type = 'signup' then to_json({_OUTPUT % repr('custom_tool_call_output')}) "
        f"when e % 5 = 2 then to_json({_CALL % repr('local_shell_call')}) "
        f"else to_json({_MESSAGE % (role, role)}) end as payload",
    ).selectExpr(
        "cast(u as string) as session_id",
        "cast(e + 1 as bigint) as line",
        "case when e % 211 = 17 then concat('{\"timestamp\":\"', stamp) "
        "when e % 223 = 19 then concat('{\"note\":', e, '}') "
        "when e % 227 = 23 then concat('[', e, ']') "
        "else concat('{\"timestamp\":\"', stamp, '\",\"type\":\"', typ, '\",\"payload\":', payload, '}') end as raw",
    )


def legacy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy flat sessions from events: a meta line per user, then bare records."""
    events = _events(spark, sf_dir)
    meta = events.groupBy("u").agg(F.min("stamp").alias("stamp")).selectExpr(
        "concat('L', u) as session_id", "cast(1 as bigint) as line",
        "concat('{\"id\":\"leg-', u, '\",\"timestamp\":\"', stamp, '\",\"instructions\":null}') as raw",
    )
    records = events.selectExpr(
        "concat('L', u) as session_id", "cast(e + 2 as bigint) as line",
        f"case event_type when 'click' then to_json({_CALL % repr('function_call')}) "
        f"when 'view' then to_json({_OUTPUT % repr('function_call_output')}) "
        f"when 'purchase' then to_json({_MESSAGE % (repr('user'), repr('user'))}) "
        "when 'signup' then concat('{\"record_type\":\"state\",\"n\":', e, '}') "
        "else case when e % 5 = 0 then concat('{\"n\":', e, '}') when e % 5 = 1 then concat('{\"n\":', e) "
        "else concat('{\"type\":\"reasoning\",\"summary\":[{\"type\":\"summary_text\",\"text\":\"why ', e, '\"}]}') end end as raw",
    )
    return meta.unionByName(records)


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long linked sessions from events, with runs of assistant rows.

    Parent is the previous row of the same user; every 50th event points at a
    missing uuid and every 37th skips one row (a branch).
    """
    events = table(spark, sf_dir, "events").selectExpr(
        "cast(user_id as string) as session_id", "cast(event_id + 1 as bigint) as line", "event_id as e",
        "event_type", "ts",
    )
    linked = _two_before(events)
    raw = (
        "concat('{\"type\":\"', who, '\",\"uuid\":\"', session_id, '-', e, '\",\"parentUuid\":', "
        "coalesce(concat('\"', par, '\"'), 'null'), ',\"sessionId\":\"run-', session_id, "
        "'\",\"timestamp\":\"', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"), "
        "'\",\"requestId\":\"m', e div 4000, '\",\"message\":{\"role\":\"', who, '\",\"content\":[', "
        "concat_ws(',', case when think and e % 2 = 0 then concat('{\"type\":\"thinking\",\"thinking\":\"t', e, '\"}') end, "
        "concat('{\"type\":\"text\",\"text\":\"', event_type, ' ', e, '\"}'), "
        "case when think and e % 2 = 1 then concat('{\"type\":\"thinking\",\"thinking\":\"t', e, '\"}') end, "
        "case when who = 'user' and e % 6 = 0 then concat('{\"type\":\"tool_result\",\"tool_use_id\":\"r', prev, '\",\"content\":\"ok\"}') end, "
        "case when who = 'assistant' and event_type = 'click' then concat('{\"type\":\"tool_use\",\"id\":\"r', e, '\",\"name\":\"run\",\"input\":{}}') end), ']}}')"
    )
    return linked.selectExpr(
        "*",
        "case when event_type in ('click', 'view', 'purchase') then 'assistant' else 'user' end as who",
        "event_type in ('click', 'view', 'purchase') and e % 7 < 3 as think",
        "case when prev is null then null when e % 50 = 11 then concat(session_id, '-x', e) "
        "when e % 37 = 5 and prev2 is not null then concat(session_id, '-', prev2) "
        "else concat(session_id, '-', prev) end as par",
    ).select("session_id", "line", J.held(F.expr(raw), "raw"))


def _two_before(events: DataFrame, size: int = BLOCK_LINES) -> DataFrame:
    """``events`` with ``prev`` and ``prev2``: ``e`` of the session's two lines before, looked up by block in one pass."""
    blocked = with_block(events, size)
    inside = Window.partitionBy("session_id", "blk").orderBy("line")
    rows = blocked.withColumn("_one", F.lag("e", 1).over(inside)).withColumn("_two", F.lag("e", 2).over(inside))
    # The last two of each block, the newer first.
    last = F.slice(F.sort_array(F.collect_list("e"), asc=False), 1, 2)
    earlier = Window.partitionBy("session_id").orderBy("blk")
    carry = blocked.groupBy("session_id", "blk").agg(last.alias("last")).select(
        "session_id", "blk", F.get(F.lag("last", 1).over(earlier), F.lit(0)).alias("_c1"),
        F.coalesce(F.get(F.lag("last", 1).over(earlier), F.lit(1)), F.get(F.lag("last", 2).over(earlier), F.lit(0))).alias("_c2"))
    met = rows.join(carry, ["session_id", "blk"])
    two = F.coalesce("_two", F.when(F.col("_one").isNull(), F.col("_c2")).otherwise(F.col("_c1")))
    return met.select(*events.columns, F.coalesce("_one", "_c1").alias("prev"), two.alias("prev2"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tools' own event log from events: session = user_id, line = event_id + 1."""
    return table(spark, sf_dir, "events").selectExpr(
        "cast(user_id as string) as session_id", "cast(event_id + 1 as bigint) as line", "ts as event_ts",
        "to_json(named_struct('ts', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\"), "
        "'event', case event_type when 'signup' then 'session_start' when 'view' then 'auto_compact_start' "
        "when 'click' then 'heartbeat' else 'auto_compact' end, "
        "'result', case event_type when 'purchase' then 'success' when 'error' then 'failed' end, "
        "'stage', case when event_type = 'error' then concat('stage ', event_id % 3) end, "
        "'error', case when event_type = 'error' then concat('broke  at\\n', event_id) end, "
        "'threshold', case when event_type <> 'click' then 50000 + user_id end, "
        "'tokens', case when event_type <> 'signup' then cast(floor(value * 1000) as bigint) end, "
        "'tokensAfter', case when event_type = 'purchase' then cast(floor(value * 500) as bigint) end, "
        "'amount', case when event_type = 'purchase' then '40%' end, "
        "'amountMode', case when event_type = 'purchase' then 'tokens' end, "
        "'model', case when event_type in ('purchase', 'error') then concat('m', event_id % 3) end)) as raw",
    )


def parsed(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Raw lines of one derivation, parsed anew on every call."""
    return parse_lines(raw_table(spark, sf_dir, which))


BUILDERS = {
    "chats": chat_lines, "runs": run_lines, "rollouts": rollout_lines, "legacy": legacy_lines, "log": log_lines,
}


def raw_table(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Raw lines as a stored table, in place of the files a real job would read."""
    return spread(once(spark, sf_dir, f"raw_{which}", lambda: BUILDERS[which](spark, sf_dir)))


def parsed_table(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    return once(spark, sf_dir, f"parsed_{which}", lambda: parsed(spark, sf_dir, which))


def linked(spark: SparkSession, sf_dir: str, which: str = "chats") -> DataFrame:
    """Typed lines of the linked format, written once per application.

    Only this table reads the raw lines of the runs, so they are not stored before it.
    """
    lines = run_lines if which == "runs" else lambda spark, sf_dir: raw_table(spark, sf_dir, which)
    return once(spark, sf_dir, f"linked_{which}", lambda: linked_lines(parse_lines(lines(spark, sf_dir))))


def flat(spark: SparkSession, sf_dir: str, which: str = "rollouts") -> DataFrame:
    """Typed lines of the flat format, written once per application."""
    return once(spark, sf_dir, f"flat_{which}", lambda: flat_lines(parsed(spark, sf_dir, which)))


def chain(spark: SparkSession, sf_dir: str, which: str = "chats") -> DataFrame:
    """Active chains, written once per application."""
    return once(spark, sf_dir, f"chain_{which}", lambda: active_chain(linked(spark, sf_dir, which)))


def chain_sizes(spark: SparkSession, sf_dir: str, which: str = "chats") -> DataFrame:
    """Approximate tokens of the chain's messages, written once per application."""
    return once(spark, sf_dir, f"sizes_{which}", lambda: message_tokens(
        linked(spark, sf_dir, which), chain(spark, sf_dir, which)))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "event_log", lambda: read_log(raw_table(spark, sf_dir, "log")))


def chat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing for the conversations: path, project directory, mtime, size."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("project_dir", F.expr("concat('-work-p', conv_id % 10)")).selectExpr(
        "cast(conv_id as string) as session_id", "concat('/logs/', project_dir, '/', conv_id, '.jsonl') as path", "project_dir",
        f"timestamp_seconds({EPOCH} + (conv_id * 37) % 1000 * 3600) as mtime", "n * 100 as size",
        "concat('/work/p', conv_id % 10) as cwd")


def rollout_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing for the event sessions: two files for every third user (an older copy)."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.selectExpr(
        "*", "explode(case when user_id % 3 = 0 then array(0, 1) else array(0) end) as old",
    ).selectExpr(
        "cast(user_id as string) as session_id", "concat('/rollouts/', old, '/rollout-', user_id, '.jsonl') as path",
        f"timestamp_seconds({EPOCH} + (user_id * 53) % 997 * 3600 - old * 86400) as mtime", "n * 100 as size",
        "concat('/work/p', user_id % 10) as cwd")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working directories of the conversations, with both forms of their directory name."""
    rows = table(spark, sf_dir, "conversations").selectExpr("concat('/work/p', conv_id % 10) as cwd").distinct()
    return rows.selectExpr(
        "cwd as project", "cwd",
        "explode(array(struct(translate(cwd, '/.', '--') as project_dir, 2 as name_version), "
        "struct(translate(cwd, '/', '-') as project_dir, 1 as name_version))) as d",
    ).selectExpr("project", "cwd", "d.project_dir", "d.name_version")


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking state of some sessions: folder, state, log and backup times."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("e")).where("user_id % 4 <> 0")
    at = lambda expr: f"timestamp_seconds({EPOCH} + {expr} * 3600)"
    return rows.selectExpr(
        "cast(user_id as string) as session_id", f"{at('user_id % 50')} as dir_mtime",
        f"case when user_id % 2 = 0 then {at('(user_id * 7) % 600')} end as state_mtime",
        f"case when user_id % 3 = 0 then {at('(user_id * 11) % 700')} end as log_mtime",
        "cast(null as timestamp) as backups_mtime",
    ).withColumn("tracked_activity", F.greatest("dir_mtime", "state_mtime", "log_mtime", "backups_mtime"))


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending compactions of some sessions."""
    return table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 5 < 4").selectExpr(
        "cast(user_id as string) as session_id",
        "case user_id % 5 when 0 then 'running' when 1 then 'ready' when 2 then 'failed' else 'stale' end as status")


def locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 6 = 3").selectExpr(
        "cast(user_id as string) as session_id")


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of every document as numbered lines (sentences).

    The second drops some sentences, marks some and moves the first one to the end.
    """
    docs = table(spark, sf_dir, "documents").selectExpr(
        "cast(doc_id as string) as session_id", "doc_id", "replace(text, '. ', '.\\n') as value")
    a = split_lines(docs).selectExpr("session_id", "doc_id", "line", "raw as text")
    b = a.where("(doc_id + line) % 11 <> 3").selectExpr(
        "session_id", "case when line = 1 and doc_id % 3 = 0 then cast(1000000 as bigint) else line end as line",
        "case when (doc_id + line) % 13 = 5 then concat(text, ' !') else text end as text")
    return a.select("session_id", "line", "text"), b


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files to be written: (name, line, raw), a file per user; every tenth line is blank."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "cast(user_id as string) as session_id", "cast(event_id as bigint) as line",
        "case when event_id % 10 = 3 then ' ' else concat(event_type, ' ', event_id, ' ', ts) end as raw")
    placed = running(rows, {"n": Running("sum", F.lit(1).cast("bigint"))})
    return placed.selectExpr("concat('u', cast(session_id as bigint) % 7, '/', session_id, '.jsonl') as name", "n as line", "raw")


def transcript_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the conversations as files: linked ones by project, sidechains beside them."""
    key = ("transcripts", spark.sparkContext.applicationId, sf_dir)
    if key not in _folders:
        root = store_path(spark, "transcripts")
        name = ("concat('{root}/-work-p', cast(session_id as bigint) % 10, '/', case when cast(session_id as bigint) % 13 = 4 then 'agent-' else '' end, "
                "session_id, '.jsonl')").replace("{root}", root)
        write_jsonl(raw_table(spark, sf_dir, "chats").selectExpr(f"{name} as path", "line", "raw"))
        _folders[key] = root
    return _folders[key]


def rollout_folders(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the event sessions as files by day: yyyy/mm/dd/rollout-<uuid>.jsonl."""
    key = ("rollouts", spark.sparkContext.applicationId, sf_dir)
    if key not in _folders:
        root = store_path(spark, "rollouts")
        name = (f"concat('{root}/2024/01/', lpad(1 + u % 28, 2, '0'), '/rollout-', regexp_replace(md5(session_id), "
                "'(.{8})(.{4})(.{4})(.{4})(.{12})', '$1-$2-$3-$4-$5'), '.jsonl')")
        rows = raw_table(spark, sf_dir, "rollouts").selectExpr("*", "cast(session_id as bigint) as u")
        write_jsonl(rows.selectExpr(f"{name} as path", "line", "raw"))
        _folders[key] = root
    return _folders[key]


_folders: dict[tuple, str] = {}
