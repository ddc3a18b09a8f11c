"""The registered queries: one entry per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions import jsonv as J
from loomlog.functions import paths as P
from loomlog.functions import specs
from loomlog.functions import text as T
from loomlog.functions import tokens as K
from loomlog.functions.specs import Amount
from loomlog.operators import catalog as CT
from loomlog.operators import checks as C
from loomlog.operators import compact as CP
from loomlog.operators import diff as DF
from loomlog.operators import graph as G
from loomlog.operators import keywords as KW
from loomlog.operators import monitor as M
from loomlog.operators import rewrite as R
from loomlog.operators import rewrite_flat as RF
from loomlog.operators import rewrite_linked as RL
from loomlog.operators import stats as S
from loomlog.operators.ordered import numbered
from loomlog.operators.rewrite import first_n
from loomlog.plans import derived as D
from loomlog.plans import guarded as GP
from loomlog.plans.oracles import BASES, sql
from loomlog.session import cut, spread, store_path
from loomlog.sources import documents as DOC
from loomlog.sources import growing as GR
from loomlog.sources import lines as L

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, twin: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if twin is not None:
            ORACLES[name] = twin
        return fn

    return add


NOW = "timestamp'2024-02-01 00:00:00'"
STAMP = "2024-02-01T00:00:00.000Z"


def _now():
    return F.expr(NOW)


def _millis(column: str):
    return F.unix_millis(column)


# --- sources ------------------------------------------------------------------

@register("s1_line_kinds", sql("al b lg", """
select 'chats' source, case when bad then 'invalid' else 'object' end json_kind, count(*) n, sum(line)::bigint line_sum from al group by all
union all select 'rollouts', case kind when 'invalid_json' then 'invalid' when 'non_object' then 'other' else 'object' end, count(*), sum(line)::bigint from b group by all
union all select 'legacy', case kind when 'invalid_json' then 'invalid' else 'object' end, count(*), sum(line)::bigint from lg group by all"""))
def line_kinds(spark, sf_dir):
    parts = [D.parsed(spark, sf_dir, w).select(F.lit(w).alias("source"), "json_kind", "line") for w in ("chats", "rollouts", "legacy")]
    return C.union_all(parts).groupBy("source", "json_kind").agg(F.count(F.lit(1)).alias("n"), F.sum("line").alias("line_sum"))


@register("s1_split_lines", """with x as (select page_id, unnest(regexp_split_to_array(html, '\\r\\n|\\n|\\r')) raw, generate_subscripts(regexp_split_to_array(html, '\\r\\n|\\n|\\r'), 1) line from pages)
select page_id, count(*) lines, max(line)::bigint last_line, sum(strlen(raw))::bigint bytes from x where trim(raw, ' \t') <> '' group by page_id""")
def split_lines(spark, sf_dir):
    rows = L.split_lines(D.table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("value")))
    return rows.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("lines"), F.max("line").alias("last_line"), F.sum(F.octet_length("raw")).alias("bytes"))


@register("s2_parse_issues", sql("al b", """
select code, severity, count(*) n from (
 select 'codex.non_object_line' code, 'warning' severity from b where kind = 'non_object'
 union all select 'claude.unrecognized_shape', 'warning' from al group by session_id having bool_and(bad)) group by all"""))
def parse_issues(spark, sf_dir):
    rows = C.parse_issues_linked(D.linked(spark, sf_dir)).unionByName(C.parse_issues_flat(D.flat(spark, sf_dir)))
    return rows.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


@register("s3_flat_kinds", sql("b lg", """
select 'wrapped' format, kind, count(*) n, count(distinct session_id) sessions from b group by all
union all select 'legacy', kind, count(*), count(distinct session_id) from lg group by all"""))
def flat_kinds(spark, sf_dir):
    rows = D.flat(spark, sf_dir).select("session_id", "format", "kind").unionByName(
        D.flat(spark, sf_dir, "legacy").select("session_id", "format", "kind"))
    per = rows.groupBy("format", "kind", "session_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("format", "kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sessions"))


@register("s4_format_detect", sql("al b lg", """
, top as (select 'chats' source, session_id, line, case when bad then null else 3 end hit, bad from al
  union all select 'rollouts', session_id, line, case when kind = 'wrapped' then 1 end, kind = 'invalid_json' from b
  union all select 'legacy', session_id, line, case when kind = 'legacy_meta' then 2 end, kind = 'invalid_json' from lg),
s as (select * from top where true),
g as (select source, session_id, arg_min(hit, line) filter (hit is not null) h, bool_or(bad) bad from s group by all)
select source, session_id, case when h in (1, 2) then 'codex' when h = 3 then 'claude' else 'unknown' end agent,
 coalesce(case h when 1 then 'wrapped' when 2 then 'legacy' when 3 then 'jsonl' end, '-') format,
 case when h is null then 'low' when bad then 'medium' else 'high' end confidence from g"""))
def format_detect(spark, sf_dir):
    # Session ids of the derivations overlap, so each is detected on its own.
    parts = [
        L.detect_format(D.parsed_table(spark, sf_dir, w)).withColumn("source", F.lit(w)) for w in ("chats", "rollouts", "legacy")]
    return C.union_all(parts).select("source", "session_id", "agent", F.coalesce("format", F.lit("-")).alias("format"), "confidence")


@register("s7_head", sql("b", """
select session_id, line from b where kind <> 'non_object' qualify row_number() over (partition by session_id order by line) <= 10"""))
def head(spark, sf_dir):
    return L.head(D.parsed_table(spark, sf_dir, "rollouts").select("session_id", "line", "json_kind"), 10).select("session_id", "line")


@register("s8_tail", sql("b", """
, t as (select session_id, line from b qualify row_number() over (partition by session_id order by line desc) <= 5),
i as (select session_id, count(*) filter (kind = 'invalid_json') invalid_lines from b group by session_id)
select session_id, line, invalid_lines from t join i using (session_id)"""))
def tail(spark, sf_dir):
    rows = D.parsed_table(spark, sf_dir, "rollouts").select("session_id", "line", "json_kind")
    return L.tail(rows, 5).join(L.invalid_counts(rows), "session_id").select("session_id", "line", "invalid_lines")


@register("s9_compaction_log", sql("lg0", """
select session_id, line, result, case when event_type = 'error' then concat('stage ', e % 3) else '-' end stage,
 case when event_type = 'error' then concat('broke  at', chr(10), e) else '-' end error, threshold::double threshold, tokens::double tokens
from ev where event = 'auto_compact'"""))
def compaction_log(spark, sf_dir):
    rows = DOC.read_compaction_log(D.log_lines(spark, sf_dir))
    return rows.select("session_id", "line", "result", F.coalesce("stage", F.lit("-")).alias("stage"),
                       F.coalesce("error", F.lit("-")).alias("error"), "threshold", "tokens")


def _state_documents(spark, sf_dir):
    users = D.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("e"))
    return DOC.parse_documents(users.selectExpr(
        "cast(user_id as string) as session_id", "concat('/state/', user_id, '.json') as path",
        "case when user_id % 11 = 10 then 'not json' else concat('{\"pendingReload\":', "
        "case user_id % 3 when 0 then 'null' when 1 then concat('{\"ts\":\"t', e, '\",\"reason\":\"auto\"}') else '{\"ts\":\"t\"}' end, "
        "',\"lastCompact\":', case when user_id % 4 = 0 then '{}' else concat('{\"ts\":\"c\",\"tokensBefore\":', e, ',\"tokensAfter\":', "
        "case when user_id % 4 = 1 then '\"x\"' else '5' end, ',\"model\":\"m\"}') end, '}') end as value"))


@register("s10_session_states", """with u as (select user_id u, max(event_id) e from events group by user_id)
select cast(u as varchar) session_id, coalesce(case when u % 3 = 1 then concat('t', e) end, '-') reload_ts, coalesce(case when u % 4 in (2, 3) then e end, -1)::double tokens_before
from u where u % 11 <> 10""")
def session_states(spark, sf_dir):
    rows = DOC.session_states(_state_documents(spark, sf_dir))
    return rows.select("session_id", F.coalesce("pending_reload.ts", F.lit("-")).alias("reload_ts"),
                       F.coalesce("last_compact.tokens_before", F.lit(-1.0)).alias("tokens_before"))


@register("s10_pending", """with u as (select distinct user_id u from events)
select concat('p', u) session_id, case u % 4 when 0 then 'running' when 1 then 'ready' when 2 then 'failed' else 'stale' end status, u % 50 remove_count,
 concat(u, '-1') first_removed from u where u % 5 <> 0 and u % 7 <> 0""")
def pending(spark, sf_dir):
    users = D.table(spark, sf_dir, "events").select("user_id").distinct()
    documents = DOC.parse_documents(users.selectExpr(
        "concat('{\"schemaVersion\":', case when user_id % 7 = 0 then 2 else 1 end, ',\"sessionId\":\"p', user_id, '\",\"status\":\"', "
        "case when user_id % 5 = 0 then 'odd' else element_at(array('running','ready','failed','stale'), cast(user_id % 4 + 1 as int)) end, "
        "'\",\"createdAt\":\"now\",\"selection\":{\"removeCount\":', user_id % 50, ',\"firstRemovedUuid\":\"', user_id, '-1\"}}') as value"))
    return DOC.pending_compactions(documents).select(
        "session_id", "status", F.col("selection.remove_count").alias("remove_count"), F.col("selection.first_removed").alias("first_removed"))


@register("s11_pins", """with p as (select conv_id % 8 f, conv_id, concat('pin', conv_id % 40) name from (select distinct conv_id from conversations) where conv_id % 9 <> 8)
select concat('/pins/', f) path, name, cast(conv_id as varchar) session_id from p qualify row_number() over (partition by f, name order by conv_id) = 1""")
def pins(spark, sf_dir):
    # Pins are validated before they meet in one file, so each row is its own one-pin document here.
    convs = D.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    documents = DOC.parse_documents(convs.selectExpr(
        "concat('/pins/', conv_id % 8) as path", "conv_id",
        "concat('{\"schemaVersion\":1,\"pins\":[{\"name\":\" pin', conv_id % 40, ' \",\"agent\":\"', "
        "case when conv_id % 9 = 8 then 'other' else 'claude' end, '\",\"sessionId\":\"', conv_id, '\",\"sessionPath\":\"/p/', conv_id, "
        "'\",\"pinnedAt\":\"2024-01-0', conv_id % 9 + 1, 'T00:00:00Z\"}]}') as value"))
    rows = DOC.pins(documents.withColumn("path", F.concat("path", F.lit("#"), F.col("conv_id").cast("string"))))
    placed = rows.withColumn("path", F.substring_index("path", "#", 1)).withColumn("pos", F.col("session_id").cast("bigint"))
    return DOC.first_by_name(placed, ["path", "name"]).select("path", "name", "session_id")


def _run_documents(spark, sf_dir):
    users = D.table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("e"))
    return users.selectExpr(
        "concat('/runs/', user_id, '.json') as path",
        "case when user_id % 13 = 5 then '{broken' else concat('{\"schemaVersion\":1,\"agent\":\"', case when user_id % 2 = 0 then 'claude' else 'codex' end, "
        "'\",\"runId\":\"run', user_id, '\",\"pid\":', case when user_id % 10 = 9 then -1 else user_id + 100 end, ',\"controlDir\":\"/ctl/', user_id div 2, "
        "'\",\"cwd\":\"/work/p', user_id % 10, '\",\"reloadMode\":\"', case when user_id % 17 = 3 then 'never' else 'auto' end, "
        "'\",\"startedAt\":\"2024-01-', lpad(cast(user_id % 28 + 1 as string), 2, '0'), 'T00:00:00Z\"}') end as value")


@register("s12_runs", """select concat('run', u) run_id, case when u % 2 = 0 then 'claude' else 'codex' end agent, u + 100 pid
from (select distinct user_id u from events) where u % 13 <> 5 and u % 10 <> 9 and u % 17 <> 3""")
def runs(spark, sf_dir):
    return DOC.runs(DOC.parse_documents(_run_documents(spark, sf_dir))).select("run_id", "agent", "pid")


def _turn_lines(spark, sf_dir):
    return D.table(spark, sf_dir, "events").selectExpr(
        "cast(user_id as string) as session_id", "cast(event_id + 1 as bigint) as line", "ts",
        "concat('{\"type\":\"', case when event_type = 'signup' then 'other' else 'agent-turn-complete' end, '\",\"thread-id\":', "
        "case when event_id % 19 = 3 then '5' else concat('\"th', user_id, '\"') end, ',\"turn-id\":\"', event_id, '\",\"cwd\":\"/work/p', user_id % 10, '\"}') as raw")


@register("s14_turn_events", """select user_id::varchar session_id, event_id + 1 line, concat('th', user_id) thread_id, concat('/work/p', user_id % 10) cwd
from events where event_type <> 'signup' and event_id % 19 <> 3""")
def turn_events(spark, sf_dir):
    return DOC.read_turn_events(L.parse_lines(_turn_lines(spark, sf_dir))).select("session_id", "line", "thread_id", "cwd")


@register("s13_control_log", """select user_id::varchar session_id, event_id + 1 line, case when event_type = 'click' then 'manual' else 'auto' end reason
from events where event_type in ('click', 'view') and event_id % 9 <> 4""")
def control_log(spark, sf_dir):
    lines = D.table(spark, sf_dir, "events").selectExpr(
        "cast(user_id as string) as session_id", "cast(event_id + 1 as bigint) as line",
        "concat('{\"cmd\":\"', case when event_type in ('click', 'view') then 'reload' else 'stop' end, '\",\"ts\":', "
        "case when event_id % 9 = 4 then 'null' else '\"2024\"' end, ',\"reason\":\"', case when event_type = 'click' then 'manual' else 'auto' end, '\"}') as raw")
    return DOC.read_control_log(L.parse_lines(lines)).select("session_id", "line", "reason")


@register("s15_heartbeats", sql("lg0", """
select session_id, line from ev qualify row_number() over (partition by session_id order by line desc) <= 30"""))
def heartbeats(spark, sf_dir):
    return DOC.read_heartbeats(D.log_lines(spark, sf_dir).select("session_id", "line", "raw"), 30).select("session_id", "line")


# --- statistics ---------------------------------------------------------------

@register("a2_session_stats", sql("al a refs", """
, lb as (select session_id, coalesce(max(line) filter (bnd), 0) l from a group by session_id),
tr as (select session_id, count(*) filter (side = 'use') u, count(*) filter (side = 'result') rs from refs group by session_id)
select a.session_id, count(*) entries, count(*) filter (msg) messages, count(*) filter (bnd) boundaries,
 count(*) filter (line > l) visible_entries, count(*) filter (line > l and msg) visible_messages,
 coalesce(any_value(u), 0) tool_use_blocks, coalesce(any_value(rs), 0) tool_result_blocks
from a join lb using (session_id) left join tr using (session_id) group by a.session_id"""))
def session_stats(spark, sf_dir):
    return S.session_stats(D.linked(spark, sf_dir))


@register("a2_type_counts", sql("al a", "select session_id, typ entry_type, count(*) n from a group by all"))
def type_counts(spark, sf_dir):
    return S.type_counts(D.linked(spark, sf_dir))


@register("a3_tool_stats", sql("al a refs", """select session_id, count(*) filter (side = 'use') tool_use_blocks, count(*) filter (side = 'result') tool_result_blocks,
 count(distinct id) filter (side = 'use') unique_tool_use_ids, count(distinct id) filter (side = 'result') unique_tool_result_ids from refs group by session_id"""))
def tool_stats(spark, sf_dir):
    return S.tool_stats(L.tool_refs(D.linked(spark, sf_dir)))


@register("a4_identities", sql("al a", """select session_id, 'session' id_kind, sid id_value from a group by all
union all select session_id, 'agent', concat('agent-', c % 3) from a where side group by all"""))
def identities(spark, sf_dir):
    return S.identities(D.linked(spark, sf_dir))


@register("a4_identity_summary", sql("al a", """select session_id, count(distinct sid) session_ids, count(distinct case when side then c % 3 end) agent_ids, bool_or(side) is_sidechain from a group by session_id"""))
def identity_summary(spark, sf_dir):
    return S.identity_summary(D.linked(spark, sf_dir))


@register("a11_message_types", sql("al a", "select session_id, typ message_type, count(*) n from a where typ <> 'file-history-snapshot' group by all"))
def message_types(spark, sf_dir):
    return S.message_types(D.linked(spark, sf_dir))


@register("w1_segments", sql("al a", """
, s as (select *, sum(bnd::int) over (partition by session_id order by line) seg from a),
hasb as (select session_id from a where bnd group by all),
g as (select session_id, seg, count(*) filter (not bnd) entries_in_segment, count(*) filter (msg) messages_in_segment,
  coalesce(max(line) filter (bnd), 0) bl, coalesce(max(uuid) filter (bnd), '(start)') bu from s join hasb using (session_id) group by all),
z as (select session_id from hasb where session_id not in (select session_id from g where seg = 0))
select session_id, seg::bigint segment, bl::bigint boundary_line, bu boundary_uuid, entries_in_segment, messages_in_segment from g
union all select session_id, 0, 0, '(start)', 0, 0 from z"""))
def segments(spark, sf_dir):
    return S.segments(D.linked(spark, sf_dir)).drop("boundary_ts")


@register("f3_visible_entries", sql("al a", """, lb as (select session_id, coalesce(max(line) filter (bnd), 0) l from a group by session_id)
select session_id, line, typ from a join lb using (session_id) where line > l"""))
def visible_entries(spark, sf_dir):
    return S.visible_entries(D.linked(spark, sf_dir)).select("session_id", "line", F.col("type").alias("typ"))


@register("p5_entry_text", sql("al a", "select session_id, line, md5(text) text_md5 from a"))
def entry_text(spark, sf_dir):
    rows = L.entries(D.linked(spark, sf_dir))
    return rows.select("session_id", "line", F.md5(L.linked_text(rows)).alias("text_md5"))


@register("p6_message_text", sql("b", "select session_id, line, note from b where itype = 'message'"))
def message_text(spark, sf_dir):
    return D.flat(spark, sf_dir).where("item_type = 'message'").select("session_id", "line", T.message_text(F.col("item")).alias("note"))


@register("p7_prompt_text", sql("al a", """select session_id, line, md5(concat('[', role, ']: ', trim(concat(
 case when think and c % 2 = 0 then concat('think ', t, chr(10)) else '' end,
 case when has_res then concat('[result: done ', t, ']', chr(10)) else '' end, case when has_late then concat('[result: late]', chr(10)) else '' end,
 text, case when role = 'assistant' or has_res then chr(10) else '' end,
 case when has_use then concat('[tool: tool', t % 3, ']', chr(10), '{"q":', t, '}', chr(10)) else '' end,
 case when think and c % 2 = 1 then concat('think ', t, chr(10)) else '' end), concat(' ', chr(10))))) prompt_md5 from a where typ <> 'file-history-snapshot'"""))
def prompt_text(spark, sf_dir):
    rows = L.entries(D.linked(spark, sf_dir)).select("session_id", "line", T.prompt_text_linked(F.col("v")).alias("p")).where("p is not null")
    return rows.select("session_id", "line", F.md5("p").alias("prompt_md5"))


# A tool item as JSON with its keys in order.
_ITEM = """concat('{', case when itype like '%output' then '' when itype = 'local_shell_call' or itype like '%call' then concat('"arguments":"{\\"e\\":', e, '}",') end,
 case when cid is null then '' else concat('"call_id":"', cid, '",') end, case when itype like '%output' then concat('"output":"out ', e, '"') else concat('"name":"tool', e % 5, '"') end, ',"type":"', itype, '"}')"""


@register("p8_prompt_text_flat", sql("b", f"""select session_id, line, case when itype = 'message' then concat('[', mrole, ']: ', trim(note))
 when itype like '%output' then concat('[assistant]: [result: ', itype, case when cid is null then '' else concat(' ', cid) end, ']', chr(10), {_ITEM})
 else concat('[assistant]: [tool: tool', e % 5, ']', chr(10), {_ITEM}) end prompt from b where itype is not null"""))
def prompt_text_flat(spark, sf_dir):
    rows = D.flat(spark, sf_dir).where("type = 'response_item'").select("session_id", "line", T.prompt_text_flat(F.col("item")).alias("prompt"))
    return rows.where("prompt is not null")


@register("p10_approx_tokens", "select doc_id, ((strlen(text) + 3) // 4)::bigint approx_tokens from documents")
def approx_tokens(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", K.approx_tokens(F.col("text")).alias("approx_tokens"))


@register("p11_format_k", """select event_id, case when v < 1000 then v::bigint::varchar when v < 10000 then concat(case when v % 500 = 250 then concat((v + 50) // 1000, '.', ((v + 50) // 100) % 10) else printf('%.1f', v / 1000.0) end, 'k')
 else concat(floor(v / 1000.0 + 0.5)::bigint::varchar, 'k') end k from (select event_id, floor(value * 100)::bigint v from events)""")
def format_k(spark, sf_dir):
    return D.table(spark, sf_dir, "events").select("event_id", T.format_k(F.floor(F.col("value") * 100)).alias("k"))


@register("p12_progress_bar", """select event_id, concat('[', repeat('█', n), repeat('▒', 8 - n), ']') bar
from (select event_id, floor(least(1.0, greatest(0.0, floor(value * 100)::bigint / 20000.0)) * 8)::int n from events)""")
def progress_bar(spark, sf_dir):
    return D.table(spark, sf_dir, "events").select(
        "event_id", T.progress_bar(F.floor(F.col("value") * 100), F.lit(20000), 8).alias("bar"))


_FAKE = "concat(substr(md5({x}), 1, 8), '-', substr(md5({x}), 9, 4), '-', substr(md5({x}), 13, 4), '-', substr(md5({x}), 17, 4), '-', substr(md5({x}), 21, 12))"


@register("p13_path_ids", f"""select page_id, concat('s-', page_id) by_name, {_FAKE.format(x="url")} by_uuid from pages""")
def path_ids(spark, sf_dir):
    rows = D.table(spark, sf_dir, "pages").selectExpr(
        "page_id", "concat('/x/s-', page_id, '.jsonl') as p1", f"concat('/y/rollout-', {_FAKE.format(x='url')}, '.jsonl') as p2")
    return rows.select("page_id", P.session_id_from_path(F.col("p1")).alias("by_name"), P.uuid_from_path(F.col("p2")).alias("by_uuid"))


@register("p14_find_session_id", f"""select page_id, {_FAKE.format(x="url")} found from pages where page_id % 4 <> 3""")
def find_session_id(spark, sf_dir):
    u = _FAKE.format(x="url")
    rows = D.table(spark, sf_dir, "pages").selectExpr(
        "page_id", f"case page_id % 4 when 0 then concat('{{\"session_id\":\"', {u}, '\"}}') when 1 then concat('{{\"session\":{{\"id\":\"/a/', {u}, '.jsonl\"}}}}') "
        f"when 2 then concat('{{\"a\":[{{\"b\":\"/z/', {u}, '.jsonl\"}}]}}') else '{{\"session_id\":\"no\"}}' end as value")
    found = DOC.parse_documents(rows).select("page_id", P.find_session_id(F.col("v")).alias("found"))
    return found.where("found is not null")


@register("p15_first_nonblank", """select event_id, case event_id % 3 when 0 then concat('/a/', event_id) when 1 then concat('/b/', event_id) else concat('/c/', event_id) end path from events""")
def first_nonblank(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").selectExpr(
        "event_id", "case event_id % 3 when 0 then concat('{\"transcript_path\":\"/a/', event_id, '\"}') "
        "when 1 then concat('{\"transcript_path\":\"  \",\"transcriptPath\":\"/b/', event_id, '\"}') "
        "else concat('{\"payload\":{\"transcriptPath\":\"/c/', event_id, '\"}}') end as value")
    return DOC.parse_documents(rows).select("event_id", P.first_nonblank(F.col("v"), ["transcript_path", "transcriptPath"]).alias("path"))


@register("p16_line_specs", """select page_id, unnest(list_distinct([page_id % 9 + 1] || generate_series(page_id % 5 + 2, page_id % 5 + 4))) line from pages""")
def line_specs(spark, sf_dir):
    rows = D.table(spark, sf_dir, "pages").selectExpr(
        "page_id", "concat(page_id % 9 + 1, ', ', page_id % 5 + 2, '-', page_id % 5 + 4) as spec")
    return specs.explode_line_specs(rows).select("page_id", "line")


@register("p16_token_amounts", """select event_id, case when event_id % 3 = 0 then event_id when event_id % 3 = 1 then event_id * 1000 + 500 else -1 end amount from events""")
def token_amounts(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").selectExpr(
        "event_id", "case event_id % 3 when 0 then cast(event_id as string) when 1 then concat(event_id, '.5K') else concat('x', event_id) end as spec")
    return rows.select("event_id", F.coalesce(specs.token_amount_column(F.col("spec")), F.lit(-1).cast("bigint")).alias("amount"))


@register("p17_log_lines", sql("lg0", """
, f as (select *, case when tokens < 1000 then tokens::varchar when tokens < 10000 then concat(case when tokens % 500 = 250 then concat((tokens + 50) // 1000, '.', ((tokens + 50) // 100) % 10) else printf('%.1f', tokens / 1000.0) end, 'k') else concat(floor(tokens / 1000.0 + 0.5)::bigint, 'k') end tk,
  case when tokens_after < 1000 then tokens_after::varchar when tokens_after < 10000 then concat(case when tokens_after % 500 = 250 then concat((tokens_after + 50) // 1000, '.', ((tokens_after + 50) // 100) % 10) else printf('%.1f', tokens_after / 1000.0) end, 'k') when tokens_after >= 10000 then concat(floor(tokens_after / 1000.0 + 0.5)::bigint, 'k') end ta
  from ev where event = 'auto_compact')
select session_id, line, concat('result=', result, ' tokens=', tk, case when ta is null then '' else concat('->', ta) end, ' threshold=', floor(threshold / 1000.0 + 0.5)::bigint, 'k',
 case when result = 'success' then ' amount=40% mode=tokens' else '' end, ' model=m', e % 3,
 case when result = 'failed' then concat(' stage=stage ', e % 3, ' error="broke at ', e, '"') else '' end) text from f"""))
def log_lines(spark, sf_dir):
    log = D.event_log(spark, sf_dir).where("event = 'auto_compact'")
    names = ("ts_raw", "result", "stage", "error", "tokens", "tokens_after", "tokens_after_is_null", "threshold", "amount", "amount_mode", "keep_last", "model")
    text = T.log_line({n: F.col(n) for n in names})
    # The time stamp leads the line; the twin compares what follows.
    return log.select("session_id", "line", F.substring(text, F.length("ts_raw") + 2, F.length(text)).alias("text"))


@register("p18_thresholds", """select event_id, coalesce(case when w > 0 then floor(w * 80 / 100) end, 90000)::bigint by_percent, coalesce(case when w > 0 then floor(w * 7 / 10) end, 90000)::bigint by_default
from (select event_id, case when event_id % 4 = 0 then null else floor(value * 1000)::bigint end w from events)""")
def thresholds(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").selectExpr("event_id", "case when event_id % 4 = 0 then null else cast(floor(value * 1000) as bigint) end as w")
    fallback = F.lit(K.FALLBACK_THRESHOLD).cast("bigint")
    return rows.select("event_id", F.coalesce(K.threshold_from_window(None, 80, F.col("w")), fallback).alias("by_percent"),
                       F.coalesce(K.threshold_from_window(None, None, F.col("w")), fallback).alias("by_default"))


@register("p19_legacy_cwds", sql("lg", """
, k as (select * from lg where kind = 'legacy_record')
select session_id, concat('/work/p', any_value(u) % 10) cwd from k where itype = 'message' and e % 7 = 0 group by session_id"""))
def legacy_cwds(spark, sf_dir):
    return RF.legacy_cwds(D.flat(spark, sf_dir, "legacy"))


@register("p20_fork_names", """select page_id, case when page_id % 3 = 0 then concat('rollout-fork-new', page_id, '.jsonl') else concat('rollout-2024-new', page_id, '.jsonl') end fork_name from pages""")
def fork_names(spark, sf_dir):
    rows = D.table(spark, sf_dir, "pages").selectExpr(
        "page_id", "concat('rollout-2024-id', page_id, '.jsonl') as name", "concat('new', page_id) as new_id",
        "case when page_id % 3 = 0 then 'zzz' else concat('id', page_id) end as old_id")
    return rows.select("page_id", P.fork_file_name(F.col("name"), F.col("old_id"), F.col("new_id")).alias("fork_name"))


@register("p21_flags", """select user_id, case when max(v) = min(v) then max(v) else '-' end agreed from (select user_id, concat(case when event_id % 2 = 0 then user_id else user_id + event_id % 3 // 2 end, 'k') v from events) group by user_id""")
def flags(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").selectExpr(
        "user_id", "case when event_id % 2 = 0 then concat('tool --threshold=', user_id, 'k --x') else concat('tool --threshold  ', user_id + event_id % 3 div 2, 'k') end as cmd")
    return rows.groupBy("user_id").agg(F.coalesce(P.agreed(P.flag_from_command(F.col("cmd"), "threshold")), F.lit("-")).alias("agreed"))


# --- checks -------------------------------------------------------------------

@register("a5_duplicate_uuid", """select u session_id, cid uuid, count(*) n_lines, min(line) line from
 (select cast(user_id as varchar) u, concat(user_id, ':', event_id % 24) cid, event_id + 1 line from events) group by all having count(*) > 1""")
def duplicate_uuid(spark, sf_dir):
    rows = D.linked(spark, sf_dir, "runs").withColumn(
        "uuid", F.concat("session_id", F.lit(":"), F.pmod(F.col("line") - 1, F.lit(24)).cast("string")))
    return C.duplicate_uuids(rows).select("session_id", "uuid", "n_lines", "line")


@register("a5_duplicate_uuid_lines", """select cast(user_id as varchar) session_id, concat(user_id, ':', event_id % 24) uuid, event_id + 1 line from events
qualify count(*) over (partition by user_id, event_id % 24) > 1""")
def duplicate_uuid_lines(spark, sf_dir):
    rows = D.linked(spark, sf_dir, "runs").withColumn(
        "uuid", F.concat("session_id", F.lit(":"), F.pmod(F.col("line") - 1, F.lit(24)).cast("string")))
    return C.duplicate_uuid_lines(rows)


@register("j1_broken_parent", sql("al a", """select session_id, line, parent parent_uuid from a where parent is not null and not exists
 (select 1 from a p where p.session_id = a.session_id and p.uuid = a.parent)"""))
def broken_parent(spark, sf_dir):
    return C.broken_parents(D.linked(spark, sf_dir)).select("session_id", "line", "parent_uuid")


@register("j2_orphan_tools", sql("al a refs", """select session_id, id tool_id, any_value(side) side, min(line) line, count(*) n_lines from refs
group by session_id, id having count(distinct side) = 1"""))
def orphan_tools(spark, sf_dir):
    return C.orphan_tools(L.tool_refs(D.linked(spark, sf_dir)))


@register("v3_thinking_order", sql("al a", """select session_id, line, 'text' first_block_type, (case when has_use then 2 else 1 end)::bigint thinking_index from a where think and c % 2 = 1"""))
def thinking_order(spark, sf_dir):
    return C.thinking_order(D.linked(spark, sf_dir))


@register("j3_merged_thinking", sql("r", """select x.session_id, x.line, p.line parent_line, 'text' parent_first_block_type from r x join r p on p.session_id = x.session_id and p.uuid = x.parent
where x.role = 'assistant' and p.role = 'assistant' and x.think and not p.think"""))
def merged_thinking(spark, sf_dir):
    return C.merged_thinking(D.linked(spark, sf_dir, "runs")).select("session_id", "line", "parent_line", "parent_first_block_type")


_ISSUES_A = """rleaf as (select session_id, arg_max(uuid, line) uuid from a where role in ('user', 'assistant') and not api group by session_id),
rchain as (select a.session_id, a.uuid, a.line, a.parent, 0 depth from a join rleaf using (session_id, uuid)
 union all select a.session_id, a.uuid, a.line, a.parent, rchain.depth + 1 from rchain join a on a.session_id = rchain.session_id and a.uuid = rchain.parent),
rm as (select a.session_id, depth, role, mkey, think, c, sum((role = 'user' and not has_res)::int) over (partition by a.session_id order by depth) walls
 from rchain join a using (session_id, line) where role in ('user', 'assistant') and not api and typ <> 'system'),
rs as (select *, case when lag(mkey) over w = mkey and lag(walls) over w = walls then 0 else 1 end fresh from rm where role = 'assistant' window w as (partition by session_id order by depth)),
rk as (select *, sum(fresh) over (partition by session_id order by depth) island from rs),
rg as (select session_id, island, bool_or(think) thinks, arg_max(think and c % 2 = 0, depth) first_thinks from rk group by all),
issues as (
 select distinct session_id, 'error' severity, 'claude.thinking_block_order_resume_chain' code from rg where thinks and not first_thinks union all
 select session_id, 'error' severity, 'claude.invalid_json_line' code from al where bad
 union all select session_id, 'warning', 'claude.unrecognized_shape' from al group by session_id having bool_and(bad)
 union all select session_id, 'warning', 'claude.broken_parent_chain' from a where parent is not null and not exists (select 1 from a p where p.session_id = a.session_id and p.uuid = a.parent)
 union all select session_id, case when any_value(side) = 'use' then 'warning' else 'error' end, case when any_value(side) = 'use' then 'claude.orphan_tool_use' else 'claude.orphan_tool_result' end
   from refs group by session_id, id having count(distinct side) = 1
 union all select session_id, 'error', 'claude.thinking_block_order' from a where think and c % 2 = 1
 union all select x.session_id, 'error', 'claude.thinking_block_order_merged' from a x join a p on p.session_id = x.session_id and p.uuid = x.parent where x.role = 'assistant' and p.role = 'assistant' and x.think and not p.think
 union all select session_id, 'warning', 'claude.api_error_message' from a where api and role = 'assistant'
 union all select session_id, 'info', 'claude.unknown_entry_type' from a where typ = 'system')"""


def _linked_issues(spark, sf_dir):
    linked = D.linked(spark, sf_dir)
    return C.parse_issues_linked(linked).unionByName(C.validate_linked(linked, L.tool_refs(linked)))


@register("v6_linked_issues", sql("recursive al a refs", ", " + _ISSUES_A + " select session_id, severity, code, count(*) n from issues group by all"))
def linked_issues(spark, sf_dir):
    return _linked_issues(spark, sf_dir).groupBy(
        "session_id", "severity", "code").agg(F.count(F.lit(1)).alias("n"))


_ISSUES_B = """issues as (
 select session_id, 'error' severity, 'codex.invalid_json_line' code from b where kind = 'invalid_json'
 union all select session_id, 'warning', 'codex.non_object_line' from b where kind = 'non_object'
 union all select session_id, 'warning', 'codex.unknown_json_line' from b where kind = 'unknown_json'
 union all select session_id, 'error', 'codex.missing_session_meta' from b group by session_id having count(*) filter (typ = 'session_meta') = 0
 union all select session_id, 'info', 'codex.multi_session_meta' from b group by session_id having count(*) filter (typ = 'session_meta') > 1
 union all select session_id, 'error', 'codex.session_meta_missing_id' from b where typ = 'session_meta' group by session_id having arg_min(e, line) % 2 = 1
 union all select session_id, 'warning', case e % 4 when 2 then 'codex.sandbox_policy_has_mode_and_type' else 'codex.sandbox_policy_missing_mode_or_type' end from b where typ = 'turn_context' and e % 4 in (2, 3)
 union all select session_id, 'warning', 'codex.compacted_replacement_history_not_array' from b where typ = 'compacted' and e % 3 = 2
 union all select session_id, 'error', concat('codex.', itype, '_missing_call_id') from b where cid is null and itype in ('function_call', 'custom_tool_call', 'function_call_output', 'custom_tool_call_output')
 union all select session_id, 'warning', 'codex.duplicate_call_id' from (select session_id, unnest(generate_series(2, calls)) from paired where calls > 1)
 union all select session_id, 'warning', 'codex.duplicate_outputs_for_call_id' from paired where outputs > 1
 union all select session_id, 'error', 'codex.orphan_output' from paired where outputs > 0 and not fits
 union all select session_id, 'error', 'codex.output_before_call' from paired where fits and out_line < call_line
 union all select session_id, 'warning', 'codex.missing_output' from paired where calls > 0 and not fits)"""


def _flat_issues(spark, sf_dir, which="rollouts"):
    flat = D.flat(spark, sf_dir, which)
    return C.parse_issues_flat(flat).unionByName(C.validate_flat(flat))


@register("v9_flat_issues", sql("b calls pairs", ", " + _ISSUES_B + " select session_id, severity, code, count(*) n from issues group by all"))
def flat_issues(spark, sf_dir):
    return _flat_issues(spark, sf_dir).groupBy("session_id", "severity", "code").agg(F.count(F.lit(1)).alias("n"))


@register("v10_legacy_issues", sql("lg", """
, p as (select session_id, cid, count(*) filter (itype = 'function_call') calls, count(*) filter (itype = 'function_call_output') outputs from lg where cid is not null group by all),
issues as (select session_id, 'codex.invalid_json_line' code from lg where kind = 'invalid_json'
 union all select session_id, 'codex.legacy_duplicate_call_id' from (select session_id, unnest(generate_series(2, calls)) from p where calls > 1)
 union all select session_id, 'codex.legacy_duplicate_outputs_for_call_id' from p where outputs > 1
 union all select session_id, 'codex.legacy_orphan_output' from p where outputs > 0 and calls = 0
 union all select session_id, 'codex.legacy_missing_output' from p where calls > 0 and outputs = 0)
select session_id, code, count(*) n from issues group by all"""))
def legacy_issues(spark, sf_dir):
    return _flat_issues(spark, sf_dir, "legacy").groupBy("session_id", "code").agg(F.count(F.lit(1)).alias("n"))


@register("j4_call_pairs", sql("b calls pairs", """select session_id, cid call_id, calls, outputs, coalesce(call_line, -1) call_line, coalesce(out_line, -1) first_output_line, fits paired from paired"""))
def call_pairs(spark, sf_dir):
    minus = F.lit(-1).cast("bigint")
    return C.call_pairs(D.flat(spark, sf_dir)).select(
        "session_id", "call_id", "calls", "outputs", F.coalesce("call_line", minus).alias("call_line"),
        F.coalesce("first_output_line", minus).alias("first_output_line"), "paired")


@register("a6_call_stats", sql("b calls pairs", """
, up as (select *, last_value(case when side = 'call' then k end ignore nulls) over (partition by session_id, cid order by line rows between unbounded preceding and 1 preceding) above from calls),
orph as (select session_id, cid, count(*) filter (side = 'output' and not coalesce((above = 'custom') = (k = 'custom'), false)) o,
  count(*) filter (side = 'output' and k = 'custom') co, count(*) filter (side = 'output' and k <> 'custom') fo from up group by all)
select session_id, count(*) filter (calls > 0) calls, sum(outputs)::bigint outputs,
 count(*) filter (calls > 0 and (case when ck = 'custom' then co else fo end) > 0) paired_calls,
 count(*) filter (calls > 0 and (case when ck = 'custom' then co else fo end) = 0) missing_outputs,
 sum(o)::bigint orphan_outputs, count(*) filter (outputs > 1) duplicate_output_ids from pairs join orph using (session_id, cid) group by session_id"""))
def call_stats(spark, sf_dir):
    return S.call_stats(D.flat(spark, sf_dir))


@register("a7_legacy_call_stats", sql("lg", """
, k as (select *, max(case when itype = 'function_call' then 1 end) over (partition by session_id, cid order by line rows between unbounded preceding and 1 preceding) above from lg where cid is not null),
p as (select session_id, cid, count(*) filter (itype = 'function_call') c, count(*) filter (itype = 'function_call_output') o, count(*) filter (itype = 'function_call_output' and above is null) orp from k group by all)
select session_id, count(*) filter (c > 0) calls, sum(o)::bigint outputs, count(*) filter (c > 0 and o > 0) paired_calls, count(*) filter (c > 0 and o = 0) missing_outputs,
 sum(orp)::bigint orphan_outputs, count(*) filter (o > 1) duplicate_output_ids from p group by session_id"""))
def legacy_call_stats(spark, sf_dir):
    return S.call_stats(D.flat(spark, sf_dir, "legacy"))


@register("a8_compacted_stats", sql("b", """select session_id, count(*) total, count(*) filter (e % 3 = 1) inline, count(*) filter (e % 3 = 0) remote, count(*) filter (e % 3 = 2) unknown from b where typ = 'compacted' group by session_id"""))
def compacted_stats(spark, sf_dir):
    return S.compacted_stats(D.flat(spark, sf_dir))


@register("a9_flat_summary", sql("b", """select session_id, 'wrapped' format, coalesce(arg_min(case when typ = 'session_meta' and e % 2 = 0 then concat('conv-', u) end, line) filter (typ = 'session_meta' and e % 2 = 0), '-') conversation_id,
 count(*) filter (typ = 'session_meta') session_meta, count(*) filter (kind = 'invalid_json') invalid_json, count(*) filter (kind = 'unknown_json') unknown_json from b group by session_id"""))
def flat_summary(spark, sf_dir):
    return S.flat_summary(D.flat(spark, sf_dir)).select(
        "session_id", "format", F.coalesce("conversation_id", F.lit("-")).alias("conversation_id"), "session_meta", "invalid_json", "unknown_json")


@register("a9_wrapped_types", sql("b", "select session_id, typ wrapped_type, count(*) n from b where kind = 'wrapped' group by all"))
def wrapped_types(spark, sf_dir):
    return S.wrapped_type_counts(D.flat(spark, sf_dir))


@register("a1_issues_by_severity", sql("b calls pairs", ", " + _ISSUES_B + """ select s.session_id, count(*) filter (severity = 'error') errors, count(*) filter (severity = 'warning') warnings, count(*) filter (severity = 'info') infos
 from (select distinct session_id from b) s left join issues using (session_id) group by s.session_id"""))
def issues_by_severity(spark, sf_dir):
    return C.by_severity(_flat_issues(spark, sf_dir), D.flat(spark, sf_dir))


@register("a1_issue_cube", sql("recursive al a refs b calls pairs", ", " + _ISSUES_A.replace("issues as", "ia as") + ", " + _ISSUES_B.replace("issues as", "ib as") + """
, al2 as (select 'claude' agent, severity from ia union all select 'codex', severity from ib)
select coalesce(agent, '*') agent, coalesce(severity, '*') severity, count(*) n from al2 group by cube (agent, severity)"""))
def issue_cube(spark, sf_dir):
    rows = _linked_issues(spark, sf_dir).unionByName(_flat_issues(spark, sf_dir))
    return C.issue_cube(rows).select(F.coalesce("agent", F.lit("*")).alias("agent"), F.coalesce("severity", F.lit("*")).alias("severity"), "n")


# DuckDB types the legacy rows only outside a recursive list.
_OLD = f"old as (with {BASES['lg']} select * from lg)"
_ERRORS_A = _ISSUES_A.replace("issues as", "ia as")
_ERRORS_B = _ISSUES_B.replace("issues as", "ib as")


@register("v11_next_steps_all", sql("recursive al a refs b calls pairs", ", " + _ERRORS_A + ", " + _ERRORS_B + ", " + _OLD + """
, lp as (select session_id, count(*) filter (itype = 'function_call') calls, count(*) filter (itype = 'function_call_output') outputs from old where cid is not null group by session_id, cid),
il as (select session_id from old where kind = 'invalid_json' union select session_id from lp where outputs > 0 and calls = 0)
select 'claude' agent, session_id, 'fix' step from ia where severity = 'error' group by all
union all select 'codex', session_id, 'fix' from ib where severity = 'error' group by all
union all select 'codex', session_id, 'strip_noise' from ib where code = 'codex.unknown_json_line' group by all
union all select 'codex', session_id, 'fix' from il
union all select distinct 'codex', session_id, 'migrate' from old"""))
def next_steps_all(spark, sf_dir):
    """Linked, wrapped and legacy sessions; linked and wrapped ones may share ids."""
    linked = D.linked(spark, sf_dir).select("session_id", F.lit("claude").alias("agent"), F.lit("linked").alias("format")).distinct()
    out = C.next_steps(_linked_issues(spark, sf_dir), linked).select(F.lit("claude").alias("agent"), "session_id", "step")
    for which in ("rollouts", "legacy"):
        sessions = D.flat(spark, sf_dir, which).select("session_id", F.lit("codex").alias("agent"), "format").distinct()
        steps = C.next_steps(_flat_issues(spark, sf_dir, which), sessions)
        out = out.unionByName(steps.select(F.lit("codex").alias("agent"), "session_id", "step"))
    return out


_RESUME_A = _ISSUES_A.split("issues as (")[0].replace("depth, role, mkey, think, c, sum(", "depth, a.line, role, mkey, think, c, sum(").replace(
    " first_thinks from rk", " first_thinks, arg_max(line, depth) line from rk")
_PLACED = """lp as (select session_id, cid, count(*) filter (itype = 'function_call') calls, count(*) filter (itype = 'function_call_output') outputs from old where cid is not null group by session_id, cid),
placed as (
 select session_id, 'error' severity, 'claude.thinking_block_order_resume_chain' code, concat(':', arg_min(line, island)) place from rg where thinks and not first_thinks group by session_id
 union all select session_id, 'error', 'claude.invalid_json_line', concat(':', line) from al where bad
 union all select session_id, 'warning', 'claude.unrecognized_shape', '' from al group by session_id having bool_and(bad)
 union all select session_id, 'warning', 'claude.broken_parent_chain', concat(':', line) from a where parent is not null and not exists (select 1 from a p where p.session_id = a.session_id and p.uuid = a.parent)
 union all select session_id, case when any_value(side) = 'use' then 'warning' else 'error' end, case when any_value(side) = 'use' then 'claude.orphan_tool_use' else 'claude.orphan_tool_result' end, concat(':', min(line))
   from refs group by session_id, id having count(distinct side) = 1
 union all select session_id, 'error', 'claude.thinking_block_order', concat(':', line) from a where think and c % 2 = 1
 union all select x.session_id, 'error', 'claude.thinking_block_order_merged', concat(':', x.line) from a x join a p on p.session_id = x.session_id and p.uuid = x.parent where x.role = 'assistant' and p.role = 'assistant' and x.think and not p.think
 union all select session_id, 'warning', 'claude.api_error_message', concat(':', line) from a where api and role = 'assistant'
 union all select session_id, 'info', 'claude.unknown_entry_type', concat(':', line) from a where typ = 'system'
 union all select session_id, 'error', 'codex.invalid_json_line', concat(':', line) from b where kind = 'invalid_json'
 union all select session_id, 'warning', 'codex.non_object_line', concat(':', line) from b where kind = 'non_object'
 union all select session_id, 'warning', 'codex.unknown_json_line', concat(':', line) from b where kind = 'unknown_json'
 union all select session_id, 'error', 'codex.missing_session_meta', '' from b group by session_id having count(*) filter (typ = 'session_meta') = 0
 union all select session_id, 'info', 'codex.multi_session_meta', '' from b group by session_id having count(*) filter (typ = 'session_meta') > 1
 union all select session_id, 'error', 'codex.session_meta_missing_id', concat(':', min(line)) from b where typ = 'session_meta' group by session_id having arg_min(e, line) % 2 = 1
 union all select session_id, 'warning', case e % 4 when 2 then 'codex.sandbox_policy_has_mode_and_type' else 'codex.sandbox_policy_missing_mode_or_type' end, concat(':', line) from b where typ = 'turn_context' and e % 4 in (2, 3)
 union all select session_id, 'warning', 'codex.compacted_replacement_history_not_array', concat(':', line) from b where typ = 'compacted' and e % 3 = 2
 union all select session_id, 'error', concat('codex.', itype, '_missing_call_id'), concat(':', line) from b where cid is null and itype in ('function_call', 'custom_tool_call', 'function_call_output', 'custom_tool_call_output')
 union all select session_id, 'warning', 'codex.duplicate_call_id', concat(' (call_id=', cid, ')') from (select session_id, cid, unnest(generate_series(2, calls)) from paired where calls > 1)
 union all select session_id, 'warning', 'codex.duplicate_outputs_for_call_id', concat(' (call_id=', cid, ')') from paired where outputs > 1
 union all select session_id, 'error', 'codex.orphan_output', concat(' (call_id=', cid, ')') from paired where outputs > 0 and not fits
 union all select session_id, 'error', 'codex.output_before_call', concat(' (call_id=', cid, ')') from paired where fits and out_line < call_line
 union all select session_id, 'warning', 'codex.missing_output', concat(' (call_id=', cid, ')') from paired where calls > 0 and not fits
 union all select session_id, 'error', 'codex.invalid_json_line', concat(':', line) from old where kind = 'invalid_json'
 union all select session_id, 'warning', 'codex.legacy_duplicate_call_id', concat(' (call_id=', cid, ')') from (select session_id, cid, unnest(generate_series(2, calls)) from lp where calls > 1)
 union all select session_id, 'warning', 'codex.legacy_duplicate_outputs_for_call_id', concat(' (call_id=', cid, ')') from lp where outputs > 1
 union all select session_id, 'error', 'codex.legacy_orphan_output', concat(' (call_id=', cid, ')') from lp where outputs > 0 and calls = 0
 union all select session_id, 'warning', 'codex.legacy_missing_output', concat(' (call_id=', cid, ')') from lp where calls > 0 and outputs = 0)"""


@register("k3_issue_report_all", sql("recursive al a refs b calls pairs", ", " + _RESUME_A + _OLD + ", " + _PLACED + """
select session_id, concat('[', severity, '] ', code, place) report_line from placed"""))
def issue_report_all(spark, sf_dir):
    """Every issue of linked, wrapped and legacy sessions; a table each, since one plan of all fills the driver."""
    parts = [_linked_issues(spark, sf_dir), _flat_issues(spark, sf_dir), _flat_issues(spark, sf_dir, "legacy")]
    return C.format_issues(C.union_all([cut(part, "issues") for part in parts])).select("session_id", "report_line")


# The main names stand for the same whole reports.
QUERIES["k3_issue_report"], ORACLES["k3_issue_report"] = issue_report_all, ORACLES["k3_issue_report_all"]
QUERIES["v11_next_steps"], ORACLES["v11_next_steps"] = next_steps_all, ORACLES["v11_next_steps_all"]


# --- graph --------------------------------------------------------------------

@register("g1_leaf", sql("recursive al a chain", "select session_id, uuid from leaf"))
def leaf(spark, sf_dir):
    linked = D.linked(spark, sf_dir)
    return G.leaves(G.nodes(linked, "ts"), L.entries(linked))


@register("g2_chain", sql("recursive al a chain", "select session_id, uuid, line, depth::bigint depth from chain"))
def chain(spark, sf_dir):
    return G.active_chain(D.linked(spark, sf_dir))


_RUN_CHAIN = """, used as (select distinct session_id, parent uuid from r where parent is not null),
leaf as (select session_id, arg_max(uuid, (ts, line)) uuid from (select *, date_trunc('milliseconds', ts) ts from (select * exclude (ts), ts from r)) x where not exists (select 1 from used where used.session_id = x.session_id and used.uuid = x.uuid) group by session_id),
chain as (select r.session_id, r.uuid, r.line, r.parent, 0 depth from r join leaf using (session_id, uuid)
 union all select r.session_id, r.uuid, r.line, r.parent, chain.depth + 1 from chain join r on r.session_id = chain.session_id and r.uuid = chain.parent)"""
_RUN_CHAIN = _RUN_CHAIN.replace("(select *, date_trunc('milliseconds', ts) ts from (select * exclude (ts), ts from r)) x", "(select * replace (date_trunc('milliseconds', ts) as ts) from r) x")


@register("g2_long_chain", sql("recursive r", _RUN_CHAIN + " select session_id, uuid, line, depth::bigint depth from chain"))
def long_chain(spark, sf_dir):
    return G.active_chain(D.linked(spark, sf_dir, "runs"))


@register("a10_chain_tokens", sql("recursive al a chain sizes", "select session_id, sum(tokens)::bigint approx_tokens, count(*) chain_messages from sizes group by session_id"))
def chain_tokens(spark, sf_dir):
    linked = D.linked(spark, sf_dir)
    return S.session_tokens(S.message_tokens(linked, D.chain(spark, sf_dir)))


_PLAN_SQL = """, w as (select *, sum(tokens) over (partition by session_id order by {o}) cum, row_number() over (partition by session_id order by {o}) rn from {src}),
tt as (select session_id, sum(tokens) total, count(*) n, floor(sum(tokens) * 0.4) target, greatest(count(*) - 2, 0) room from w group by session_id),
h as (select session_id, min(rn) filter (cum >= target) hit, max(rn) mx from w join tt using (session_id) where rn <= room and target > 0 group by session_id)
select tt.session_id, coalesce(hit, mx, 0)::bigint remove_count, room::bigint max_removable, total::bigint total_tokens, target::bigint target_tokens, coalesce(cum, 0)::bigint selected_tokens
from tt left join h using (session_id) left join w on w.session_id = tt.session_id and w.rn = coalesce(hit, mx)"""


@register("w2_token_plan", sql("recursive al a chain sizes", _PLAN_SQL.format(src="sizes", o="depth desc")))
def token_plan(spark, sf_dir):
    sizes = D.chain_sizes(spark, sf_dir).withColumn("pos", -F.col("depth"))
    return S.removal_plan(sizes, Amount("percent", 40), keep_last=2, order="pos")


@register("w2_document_plan", """with sizes as (select source session_id, doc_id line, ((strlen(text) + 3) // 4)::bigint tokens from documents)""" + _PLAN_SQL.format(src="sizes", o="line"))
def document_plan(spark, sf_dir):
    items = D.table(spark, sf_dir, "documents").select(
        F.col("source").alias("session_id"), F.col("doc_id").alias("line"), K.approx_tokens(F.col("text")).alias("approx_tokens"))
    return S.removal_plan(items, Amount("percent", 40), keep_last=2)


_PROMPT = """, pr as (select session_id, line, case when typ <> 'file-history-snapshot' then nullif(trim(concat(
 case when think and c % 2 = 0 then concat('think ', t, chr(10)) else '' end,
 case when has_res then concat('[result: done ', t, ']', chr(10)) else '' end, case when has_late then concat('[result: late]', chr(10)) else '' end,
 text, case when role = 'assistant' or has_res then chr(10) else '' end,
 case when has_use then concat('[tool: tool', t % 3, ']', chr(10), '{"q":', t, '}', chr(10)) else '' end,
 case when think and c % 2 = 1 then concat('think ', t, chr(10)) else '' end), concat(' ', chr(10))), '') end body, role from a),
blocks as (select session_id, line, case when body is not null then concat('[', role, ']: ', body) end block from pr),
w as (select *, coalesce(sum(strlen(block) + 2) over (partition by session_id order by line), 0) cum, row_number() over (partition by session_id order by line) rn from blocks),
k as (select *, (greatest(cum - 2, 0)::bigint + 3) // 4 tok from w)"""


def _prompt_blocks(spark, sf_dir):
    return L.entries(D.linked(spark, sf_dir)).select("session_id", "line", T.prompt_text_linked(F.col("v")).alias("prompt_text"))


@register("w3_prompt_fit", sql("al a", _PROMPT + """ select session_id, max(rn)::bigint requested, max(tok)::bigint requested_tokens, coalesce(max(rn) filter (tok <= 300), 0)::bigint fit_count,
 coalesce(max(tok) filter (tok <= 300), 0)::bigint fit_tokens from k group by session_id"""))
def prompt_fit(spark, sf_dir):
    """The entries whose prompt blocks fit; an entry without a block takes no room."""
    return S.prompt_fit(_prompt_blocks(spark, sf_dir), 300)


@register("p7_session_prompts", sql("al a", _PROMPT + """, j as (select session_id, count(*) blocks, max(tok)::bigint tokens, string_agg(block, concat(chr(10), chr(10)) order by line) prompt
 from k where block is not null and tok <= 300 group by session_id)
select session_id, blocks, tokens, (length(prompt) - length(replace(prompt, chr(10), '')) + 1)::bigint source_lines,
 greatest(20, (length(prompt) - length(replace(prompt, chr(10), '')) + 1) // 5)::bigint target_lines, md5(prompt) prompt_md5 from j"""))
def session_prompts(spark, sf_dir):
    rows = S.session_prompts(_prompt_blocks(spark, sf_dir), budget=300, part_bytes=256)
    return rows.select("session_id", "blocks", "tokens", "source_lines", "target_lines", F.md5("prompt").alias("prompt_md5"))


_TURNS = """, asst as (select * from r where role = 'assistant'),
up as (select x.session_id, x.line, x.line top, x.parent from asst x
 union all select up.session_id, up.line, p.line, p.parent from up join asst p on p.session_id = up.session_id and p.uuid = up.parent),
turns as (select session_id, line, min(top) turn from up group by all)"""


@register("g3_turns", sql("recursive r", _TURNS + " select session_id, line, turn from turns"))
def turns(spark, sf_dir):
    return G.assistant_turns(D.linked(spark, sf_dir, "runs"))


@register("g4_pair_closure", sql("recursive al a refs", """
, two as (select session_id, id from refs group by all having count(distinct side) = 2),
links as (select distinct session_id, line, id from refs join two using (session_id, id)),
start as (select session_id, line, 'selected' reason from a where (c + t) % 5 = 2
  union select r.session_id, r.line, 'orphan' from refs r where side = 'result' and not exists (select 1 from two b where b.session_id = r.session_id and b.id = r.id)),
reach as (select distinct session_id, line from start
  union select l2.session_id, l2.line from reach join links l1 using (session_id, line) join links l2 on l2.session_id = l1.session_id and l2.id = l1.id)
select session_id, line from reach"""))
def pair_closure(spark, sf_dir):
    linked = D.linked(spark, sf_dir)
    chosen = L.entries(linked).where((F.col("session_id").cast("bigint") + F.col("line") - 1) % 5 == 2).select("session_id", "line")
    return G.pair_closure(L.tool_refs(linked), chosen).select("session_id", "line")


@register("g5_relink", sql("recursive r", """
, gone as (select * from r where line % 3 <> 0), kept as (select * from r where line % 3 = 0 and parent is not null),
walk as (select k.session_id, k.line, k.parent cur, 0 hops from kept k
  union all select w.session_id, w.line, g.parent, hops + 1 from walk w join gone g on g.session_id = w.session_id and g.uuid = w.cur)
select session_id, line, coalesce(arg_max(cur, hops), '-') new_parent from (select *, max(hops) over (partition by session_id, line) mh from walk) where hops = mh and mh > 0 group by all"""))
def relink(spark, sf_dir):
    linked = D.linked(spark, sf_dir, "runs")
    return G.relinked_parents(linked, F.expr("line % 3 <> 0")).select("session_id", "line", F.coalesce("new_parent", F.lit("-")).alias("new_parent"))


# Chunks of a merge key from the last line up: ``path`` has the ancestors of a row, ``gone`` what later rows have taken.
_MERGES = """, ch as (select session_id, line, uuid, parent, mkey, think from r where role = 'assistant'),
up as (select c.session_id, c.line tip, p.line, p.parent, p.mkey, p.think, 1 depth from ch c join ch p on p.session_id = c.session_id and p.uuid = c.parent and p.mkey = c.mkey
  union all select u.session_id, u.tip, p.line, p.parent, p.mkey, p.think, depth + 1 from up u join ch p on p.session_id = u.session_id and p.uuid = u.parent and p.mkey = u.mkey),
tips as (select c.session_id, c.line, c.think, u.path, u.thinks, row_number() over (partition by c.session_id order by c.line desc) k from ch c
  join (select session_id, tip line, list(line order by depth) path, list(think order by depth) thinks from up group by all) u using (session_id, line)),
walk as (select distinct session_id, 0::bigint k, []::bigint[] gone, []::bigint[] hit, 0::bigint tip from tips
  union all select session_id, k, list_concat(gone, hit), hit, tip from (
    select session_id, k, gone, tip, case when list_contains(gone, tip) or len(pre) = 0 or list_bool_or(flags) = list_bool_and(flags) then []::bigint[] else pre end hit from (
      select session_id, k, gone, tip, path[1:m] pre, list_append(thinks[1:m], think) flags from (
        select t.session_id, t.k, w.gone, t.line tip, t.path, t.thinks, t.think, coalesce(list_min(list_filter(range(1, len(t.path) + 1), lambda j: list_contains(w.gone, t.path[j]))) - 1, len(t.path)) m
        from walk w join tips t on t.session_id = w.session_id and t.k = w.k + 1)))),
merges as (select session_id, tip tip_line, unnest(hit) line from walk)"""


@register("g6_collapse_chunks", sql("recursive r", _MERGES + " select * from merges"))
def collapse_chunks(spark, sf_dir):
    return G.collapse_plan(D.linked(spark, sf_dir, "runs")).select("session_id", "tip_line", "line")


@register("g7_resume_chain", sql("recursive r", """
, leaf as (select session_id, arg_max(uuid, line) uuid, max(line) leaf_line from r group by session_id),
chain as (select r.session_id, r.uuid, r.line, r.parent, 0 depth from r join leaf using (session_id, uuid)
 union all select r.session_id, r.uuid, r.line, r.parent, chain.depth + 1 from chain join r on r.session_id = chain.session_id and r.uuid = chain.parent),
m as (select c.session_id, c.line, depth, role, mkey, think, e,
  sum(case when role = 'user' and not (e % 6 = 0 and prev is not null) then 1 else 0 end) over (partition by c.session_id order by depth) walls
  from chain c join r on r.session_id = c.session_id and r.line = c.line),
s as (select *, case when lag(mkey) over w = mkey and lag(walls) over w = walls then 0 else 1 end fresh from m where role = 'assistant' window w as (partition by session_id order by depth)),
k as (select *, sum(fresh) over (partition by session_id order by depth) island from s),
g as (select session_id, island, bool_or(think) thinks, arg_max(think and e % 2 = 0, depth) first_thinks, arg_max(line, depth) line from k group by all)
select session_id, count(*) violations, arg_min(line, island) line, any_value(leaf_line) leaf_line from g join leaf using (session_id) where thinks and not first_thinks group by session_id"""))
def resume_chain(spark, sf_dir):
    return G.resume_violations(D.linked(spark, sf_dir, "runs")).select("session_id", "violations", "line", "leaf_line")


# --- rewrites -----------------------------------------------------------------

@register("j8_repair_links", sql("al a", """
, up as (select session_id, line, parent, last_value(uuid ignore nulls) over (partition by session_id order by line rows between unbounded preceding and 1 preceding) above from a)
select session_id, line, coalesce(above, '-') new_parent from up where parent is not null and not exists (select 1 from a p where p.session_id = up.session_id and p.uuid = up.parent)"""))
def repair_links(spark, sf_dir):
    return RL.repaired_parents(D.linked(spark, sf_dir)).select("session_id", "line", F.coalesce("new_parent", F.lit("-")).alias("new_parent"))


def _ids(lines: DataFrame) -> DataFrame:
    """Identity of rewritten rows, read back from their text."""
    rows = L.parse_lines(cut(lines))
    return rows.select("session_id", "line", J.as_string(F.col("v"), "$.uuid").alias("uuid"),
                       F.coalesce(J.as_string(F.col("v"), "$.parentUuid"), F.lit("-")).alias("parent"))


_CLOSE = """, two as (select session_id, id from refs group by all having count(distinct side) = 2),
links as (select distinct session_id, line, id from refs join two using (session_id, id)),
orphans as (select distinct r.session_id, r.line from refs r where side = 'result' and not exists (select 1 from two b where b.session_id = r.session_id and b.id = r.id)),"""
_ASST_A = """asst as (select * from a where role = 'assistant'),
upt as (select x.session_id, x.line, x.line top, x.parent from asst x union all select upt.session_id, upt.line, p.line, p.parent from upt join asst p on p.session_id = upt.session_id and p.uuid = upt.parent),
turns as (select session_id, line, min(top) turn from upt group by all),"""
_REACH = """reach as (select distinct session_id, line from seeds
  union select l2.session_id, l2.line from reach join links l1 using (session_id, line) join links l2 on l2.session_id = l1.session_id and l2.id = l1.id),
kept as (select * from a where not exists (select 1 from reach g where g.session_id = a.session_id and g.line = a.line)),
gone as (select a.* from a join reach using (session_id, line)),
walk as (select k.session_id, k.line, k.uuid, k.parent cur, 0 hops from kept k
  union all select w.session_id, w.line, w.uuid, g.parent, hops + 1 from walk w join gone g on g.session_id = w.session_id and g.uuid = w.cur),
relinked as (select session_id, line, uuid, coalesce(arg_max(coalesce(cur, '-'), hops), '-') parent from walk group by all)"""


_KINDS = """list_filter([case when {first} then 'thinking' end, case when has_res then 'tool_result' end, case when has_late then 'tool_result' end,
 case when role = 'assistant' or has_res then 'text' end, case when has_use then 'tool_use' end, case when {last} then 'thinking' end], lambda x: x is not null)"""
_ORDERED = _KINDS.format(first="think", last="false")
_AS_WRITTEN = _KINDS.format(first="think and c % 2 = 0", last="think and c % 2 = 1")


def _fix_twin(p: str, rows: str, refs: str, api: bool = True, uses: bool = True) -> str:
    """The repair of ``rows`` in SQL as tables named with ``p``; ``{p}out`` has what survives, with links and block types.

    Chats alternate their roles, so a merge key holds two assistant rows at most and a merge has one step.
    """
    errors = f"union select session_id, line from {p}a where api" if api else ""
    sides = "('result', 'use')" if uses else "('result')"
    return f""", {p}up as (select *, lag(uuid) over (partition by session_id order by line) above from {rows}),
{p}a as (select * exclude (above, parent), case when parent is not null and not exists (select 1 from {rows} q where q.session_id = {p}up.session_id and q.uuid = {p}up.parent) then above else parent end parent from {p}up),
{p}merge as (select x.session_id, x.line tip, y.line, y.has_use y_use from {p}a x join {p}a y on y.session_id = x.session_id and y.uuid = x.parent
  where x.role = 'assistant' and y.role = 'assistant' and not x.api and not y.api and x.mkey = y.mkey and x.think <> y.think),
{p}refs as (select r.session_id, coalesce(m.tip, r.line) line, side, id from {refs} r left join {p}merge m on m.session_id = r.session_id and m.line = r.line),
{p}lone as (select session_id, id, any_value(side) lone from {p}refs group by session_id, id having count(distinct side) = 1),
{p}links as (select distinct r.session_id, r.line, r.id from {p}refs r anti join {p}lone o on o.session_id = r.session_id and o.id = r.id),
{p}seeds as (select session_id, line from {p}merge {errors} union select r.session_id, r.line from {p}refs r join {p}lone o on o.session_id = r.session_id and o.id = r.id where lone in {sides}),
{p}reach as (select session_id, line from {p}seeds union select l2.session_id, l2.line from {p}reach h join {p}links l1 on l1.session_id = h.session_id and l1.line = h.line
  join {p}links l2 on l2.session_id = l1.session_id and l2.id = l1.id),
{p}kept as (select * from {p}a k anti join {p}reach g on g.session_id = k.session_id and g.line = k.line),
{p}walk as (select session_id, line, parent cur, 0 hops from {p}kept
  union all select w.session_id, w.line, g.parent, hops + 1 from {p}walk w join {p}a g on g.session_id = w.session_id and g.uuid = w.cur
  semi join {p}reach h on h.session_id = g.session_id and h.line = g.line),
{p}link as (select session_id, line, nullif(arg_max(coalesce(cur, ''), hops), '') new_parent from {p}walk group by all),
{p}out as (select k.* exclude (parent), l.new_parent parent, m.tip is not null merged,
  case when m.tip is null then {_ORDERED} else list_concat(case when y_use then ['thinking', 'text', 'tool_use'] else ['thinking', 'text'] end, case when has_use then ['text', 'tool_use'] else ['text'] end) end kinds
  from {p}kept k join {p}link l on l.session_id = k.session_id and l.line = k.line left join {p}merge m on m.session_id = k.session_id and m.tip = k.line)"""


_SHOWN = "session_id, line, coalesce(parent, '-') parent, array_to_string(kinds, ',') kinds"


def _retyped(lines):
    """Links and block types of rewritten lines, read back from their text."""
    rows = L.entries(L.linked_lines(cut(L.parse_lines(lines.select("session_id", "line", "raw")))))
    kinds = F.array_join(F.transform("blocks", lambda b: b["type"]), ",")
    return rows.select("session_id", "line", F.coalesce("parent_uuid", F.lit("-")).alias("parent"), kinds.alias("kinds"))


def _removal_twin(selected: str, untouched: str) -> str:
    """Removal with the default repair in the touched sessions; the others as they are."""
    return (_CLOSE + _ASST_A + f""" picked as ({selected}), hit as (select distinct session_id from picked),
wanted as (select session_id, line from picked union select t2.session_id, t2.line from turns t1 join picked p on p.session_id = t1.session_id and p.line = t1.line
  join turns t2 on t2.session_id = t1.session_id and t2.turn = t1.turn),
seeds as (select * from wanted union select o.* from orphans o join hit using (session_id)),
""" + _REACH + f""",
left_ as (select a.* exclude (parent), nullif(r.parent, '-') parent from a join relinked r using (session_id, line) semi join hit on hit.session_id = a.session_id),
lrefs as (select r.* from refs r semi join left_ k on k.session_id = r.session_id and k.line = r.line)"""
        + _fix_twin("f", "left_", "lrefs", api=False, uses=False) + f""" select {_SHOWN} from fout
union all select session_id, line, coalesce(parent, '-'), array_to_string({untouched}, ',') from a where session_id not in (select session_id from hit)""")


@register("x4_remove", sql("recursive al a refs", _removal_twin("select session_id, line from a where (c + t) % 7 = 3", _AS_WRITTEN)))
def remove(spark, sf_dir):
    linked = D.linked(spark, sf_dir)
    chosen = L.entries(linked).where((F.col("session_id").cast("bigint") + F.col("line") - 1) % 7 == 3).select("session_id", "line")
    return _retyped(RL.remove(linked, chosen).lines)


@register("x7_trim", sql("recursive al a refs", _removal_twin(
    "select session_id, line from (select session_id, line, row_number() over (partition by session_id order by line) rn, count(*) over (partition by session_id) n from a where msg) where rn <= floor(n * 0.3)", _AS_WRITTEN)))
def trim(spark, sf_dir):
    return _retyped(RL.trim(D.linked(spark, sf_dir), Amount("percent", 30)).lines)


@register("x7_trim_keep_last", sql("recursive al a refs", _removal_twin(
    "select session_id, line from (select session_id, line, row_number() over (partition by session_id order by line) rn, count(*) over (partition by session_id) n from a where msg) where rn <= greatest(n - 3, 0)", _AS_WRITTEN)))
def trim_keep_last(spark, sf_dir):
    return _retyped(RL.trim(D.linked(spark, sf_dir), Amount("count", 3), keep_last=True).lines)


@register("f4_keyword_hits", "select source, count(*) n from documents where lower(text) like '%stin%' or lower(text) like '%thand%' group by source")
def keyword_hits(spark, sf_dir):
    rows = D.table(spark, sf_dir, "documents").where(T.contains_any(F.col("text"), ["stin", "thand"]))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register("x8_clean_matches", sql("al a", "select session_id, count(*) matched from a where lower(text) like '%thand%' group by session_id"))
def clean_matches(spark, sf_dir):
    return RL.keyword_hits(D.linked(spark, sf_dir), ["thand"]).groupBy("session_id").agg(F.count(F.lit(1)).alias("matched"))


@register("x8_clean", sql("recursive al a refs", _removal_twin("select session_id, line from a where lower(text) like '%thand%'", _AS_WRITTEN)))
def clean(spark, sf_dir):
    return _retyped(RL.clean(D.linked(spark, sf_dir), ["thand"])[0].lines)


@register("x18_export", sql("al a", "select session_id, line, role, md5(text) text_md5 from a where role in ('user', 'assistant') and trim(text) <> ''"))
def export(spark, sf_dir):
    return RL.export(D.linked(spark, sf_dir)).select("session_id", "line", "role", F.md5("text").alias("text_md5"))


@register("x18_export_flat", sql("b", f"""select session_id, line, case when itype is null then 'compacted' when itype = 'message' then 'message' else 'tool' end item_kind,
 case when itype is null then concat('sum ', e) when itype = 'message' then note else {_ITEM} end text from b where itype is not null or typ = 'compacted'"""))
def export_flat(spark, sf_dir):
    return RF.export(D.flat(spark, sf_dir), full=True).select("session_id", "line", "item_kind", "text")


@register("x1_fix", sql("recursive al a refs", _fix_twin("f", "a", "refs") + f" select {_SHOWN} from fout"))
def fix(spark, sf_dir):
    return _retyped(RL.fix(D.linked(spark, sf_dir)).lines)


@register("x1_fix_changes")
def fix_changes(spark, sf_dir):
    return RL.fix(D.linked(spark, sf_dir, "runs")).changes.groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))


@register("x2_strip_thinking", sql("al a", "select session_id, line, (case when has_use then 2 else 1 end)::bigint blocks_left from a where think"))
def strip_thinking(spark, sf_dir):
    rows, _ = RL.strip_thinking(R.editable(L.entries(D.linked(spark, sf_dir))))
    lines = R.render(rows.where(F.size("edits") > 0))
    return L.parse_lines(lines).select("session_id", "line", F.size(J.as_array(F.col("v"), "$.message.content")).cast("bigint").alias("blocks_left"))


@register("x3_tombstone", sql("al a", "select session_id, line, case when role = 'assistant' then '[{\"text\":\"gone\",\"type\":\"text\"}]' else '\"gone\"' end content from a where line % 2 = 0"))
def tombstone(spark, sf_dir):
    from loomlog.functions import edits as E

    rows = R.add_edit(R.editable(L.entries(D.linked(spark, sf_dir)).where("line % 2 = 0")), F.lit(True), E.edit("tombstone", value=F.lit("gone")))
    return L.parse_lines(R.render(rows)).select("session_id", "line", F.to_json(J.get(F.col("v"), "$.message.content")).alias("content"))


@register("x5_fix_flat", sql("b calls pairs", """
, lk as (select session_id, cid, arg_max(k, line) lk from calls where side = 'call' group by all),
orph as (select session_id, line from calls left join lk using (session_id, cid) where side = 'output' and not coalesce((lk = 'custom') = (k = 'custom'), false)),
live as (select * from calls where not exists (select 1 from orph o where o.session_id = calls.session_id and o.line = calls.line)),
ans as (select session_id, max(line) filter (side = 'call') line from live group by session_id, cid having count(*) filter (side = 'output') = 0 and count(*) filter (side = 'call') > 0)
select session_id, line, 0 sub from b where kind in ('wrapped', 'unknown_json') and not exists (select 1 from orph o where o.session_id = b.session_id and o.line = b.line)
union all select session_id, line, 1 from ans"""))
def fix_flat(spark, sf_dir):
    return RF.fix(D.flat(spark, sf_dir), RF.FlatFixOptions(aborted_outputs=True)).lines.select("session_id", "line", "sub")


@register("w7_repeated_outputs", sql("lg", """select session_id, line from lg where itype = 'function_call_output' and cid is not null
qualify row_number() over (partition by session_id, cid order by line desc) > 1"""))
def repeated_outputs(spark, sf_dir):
    return S.latest_outputs(D.flat(spark, sf_dir, "legacy"))


@register("w6_history_items", sql("b", """, m as (select session_id, max(line) filter (typ = 'compacted') m from b group by session_id)
select session_id, line from b join m using (session_id) where typ = 'response_item' and line > coalesce(m, 0)"""))
def history_items(spark, sf_dir):
    return S.history_items(D.flat(spark, sf_dir)).select("session_id", "line")


_FLAT_CLOSE = """, picked as ({picked}), hit as (select distinct session_id from picked),
badid as (select session_id, cid, case when exists (select 1 from picked p where p.session_id = paired.session_id and p.line = paired.call_line) then 1 when not fits then 2 end why from paired where outputs > 0),
gone as (select session_id, line from picked union select c.session_id, c.line from calls c join badid using (session_id, cid) join hit using (session_id) where c.side = 'output' and why is not null)
"""


@register("x6_remove_flat", sql("b calls pairs", _FLAT_CLOSE.format(picked="select session_id, line from b where kind = 'wrapped' and e % 10 = 3") + """
select session_id, line from b where kind in ('wrapped', 'unknown_json') and not exists (select 1 from gone g where g.session_id = b.session_id and g.line = b.line)"""))
def remove_flat(spark, sf_dir):
    flat = D.flat(spark, sf_dir)
    chosen = flat.where("kind = 'wrapped' and (line - 1) % 10 = 3").select("session_id", "line")
    return RF.remove(flat, chosen).lines.select("session_id", "line")


@register("x7_trim_flat", sql("b calls pairs", """, mk as (select session_id, coalesce(max(line) filter (typ = 'compacted'), 0) m from b group by session_id),
hist as (select session_id, line, row_number() over (partition by session_id order by line) rn from b join mk using (session_id) where typ = 'response_item' and line > m)"""
    + _FLAT_CLOSE.format(picked="select session_id, line from hist where rn <= 4") + """
select session_id, line from b where kind in ('wrapped', 'unknown_json') and not exists (select 1 from gone g where g.session_id = b.session_id and g.line = b.line)"""))
def trim_flat(spark, sf_dir):
    return RF.trim(D.flat(spark, sf_dir), Amount("count", 4)).lines.select("session_id", "line")


@register("x8_clean_flat", sql("b calls pairs", _FLAT_CLOSE.format(picked="select session_id, line from b where itype = 'message' and note like '%value 1%'") + """
select session_id, line from b where kind in ('wrapped', 'unknown_json') and not exists (select 1 from gone g where g.session_id = b.session_id and g.line = b.line)"""))
def clean_flat(spark, sf_dir):
    return RF.clean(D.flat(spark, sf_dir), ["value 1"])[0].lines.select("session_id", "line")


@register("x9_strip_noise", sql("b lg", """select session_id, line from b where kind = 'unknown_json' or (kind = 'wrapped' and typ not in ('turn_context', 'event_msg'))
union all select lg.session_id, line from lg join events on event_id = e where kind = 'legacy_record' and event_type <> 'signup'
union all select session_id, line from lg where kind = 'legacy_meta'"""))
def strip_noise(spark, sf_dir):
    both = D.flat(spark, sf_dir).unionByName(D.flat(spark, sf_dir, "legacy"))
    return RF.strip_noise(both).lines.select("session_id", "line")


@register("x10_migrate", sql("lg", """select session_id, line, 'session_meta' wrapped_type, coalesce(cwd, '.') detail from lg left join
 (select session_id, concat('/work/p', any_value(u) % 10) cwd from (select * from lg where kind = 'legacy_record') where itype = 'message' and e % 7 = 0 group by session_id) using (session_id) where kind = 'legacy_meta'
union all select session_id, line, 'response_item', itype from lg where itype is not null"""))
def migrate(spark, sf_dir):
    rows = L.parse_lines(cut(RF.migrate(D.flat(spark, sf_dir, "legacy")).lines))
    v = F.col("v")
    return rows.select("session_id", "line", J.as_string(v, "$.type").alias("wrapped_type"),
                       F.coalesce(J.as_string(v, "$.payload.cwd"), J.as_string(v, "$.payload.type")).alias("detail"))


_FORK = "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), concat('5', substr(h, 14, 3)), concat('a', substr(h, 18, 3)), substr(h, 21, 12))"


@register("x14_fork", sql("al", f""", f as (select *, md5(concat(session_id, chr(0), 'copy')) h from al)
select {_FORK} session_id, line, case when bad then '-' else {_FORK} end inner_id from f"""))
def fork(spark, sf_dir):
    linked = D.linked(spark, sf_dir)
    ids = linked.select("session_id").distinct().withColumn("new_id", RF.fork_id(F.col("session_id"), "copy"))
    rows = L.parse_lines(RF.fork_linked(linked, ids))
    return rows.select("session_id", "line", F.coalesce(J.as_string(F.col("v"), "$.sessionId"), F.lit("-")).alias("inner_id"))


@register("x14_fork_flat", sql("b lg", f""", f as (select session_id, line, typ = 'session_meta' meta, md5(concat(session_id, chr(0), 'copy')) h from b where kind <> 'non_object'
 union all select session_id, line, kind = 'legacy_meta', md5(concat(session_id, chr(0), 'copy')) from lg)
select {_FORK} session_id, line from f where meta"""))
def fork_flat(spark, sf_dir):
    flat = D.flat(spark, sf_dir).unionByName(D.flat(spark, sf_dir, "legacy"))
    ids = flat.select("session_id").distinct().withColumn("new_id", RF.fork_id(F.col("session_id"), "copy"))
    rows = L.parse_lines(spread(cut(RF.fork_flat(flat, ids))))
    own = F.coalesce(J.as_string(F.col("v"), "$.payload.id"), J.as_string(F.col("v"), "$.id"))
    return rows.where(own == F.col("session_id")).select("session_id", "line")


def _compaction(spark, sf_dir, tokens: bool):
    linked, chain = D.linked(spark, sf_dir), D.chain(spark, sf_dir)
    roots = cut(CP.root_users(linked, chain))
    visible = cut(CP.visible_messages(linked, chain, roots))
    chosen = CP.plan_linked(visible, Amount("percent", 40)) if tokens else CP.plan_linked(visible, amount=Amount("percent", 50))
    return linked, chain, cut(chosen)


_VISIBLE = """, roots as (select session_id, arg_min(line, rk) rline, arg_min(meta, rk) rmeta, arg_min(uuid, rk) ruuid from
  (select a.session_id, a.line, a.meta, a.uuid, case when a.meta then 0 when depth is not null then 100000 - depth else 200000 + a.line end rk from a left join chain on chain.session_id = a.session_id and chain.line = a.line
   where a.typ = 'user' and a.parent is null) group by session_id),
vis as (select a.session_id, a.line, a.uuid, -(depth::bigint) pos from a join chain on chain.session_id = a.session_id and chain.line = a.line where msg
  union all select session_id, rline, ruuid, -(1::bigint << 60) from roots where rmeta and not exists (select 1 from chain where chain.session_id = roots.session_id and chain.line = roots.rline)),
vn as (select *, row_number() over (partition by session_id order by pos) rn, count(*) over (partition by session_id) n from vis)"""


@register("x13_plan_compact", sql("recursive al a chain", _VISIBLE + " select session_id, line, floor(n * 0.5)::bigint n from vn where rn <= floor(n * 0.5)"))
def plan_compact(spark, sf_dir):
    return _compaction(spark, sf_dir, tokens=False)[2].select("session_id", "line", "n")


@register("x13_plan_compact_tokens", sql("recursive al a chain sizes", _VISIBLE + """, sz as (select vn.*, coalesce(tokens, 0) tokens from vn left join sizes on sizes.session_id = vn.session_id and sizes.line = vn.line where vn.pos >= 0),
cm as (select *, sum(tokens) over (partition by session_id order by pos) cum from sz), tot as (select session_id, floor(sum(tokens) * 0.4) goal from sz group by session_id),
fst as (select session_id, min(rn) k from cm join tot using (session_id) where cum >= goal and goal > 0 group by session_id)
select session_id, line, k::bigint n from cm join fst using (session_id) where rn <= k""").replace("where vn.pos >= 0),", "),"))
def plan_compact_tokens(spark, sf_dir):
    return _compaction(spark, sf_dir, tokens=True)[2].select("session_id", "line", "n")


@register("x11_compact", sql("recursive al a refs chain", _VISIBLE + _CLOSE + _ASST_A + """
picked as (select session_id, line from vn where rn <= floor(n * 0.5)), hit as (select distinct session_id from picked),
wanted as (select session_id, line from picked union select t2.session_id, t2.line from turns t1 join picked p on p.session_id = t1.session_id and p.line = t1.line join turns t2 on t2.session_id = t1.session_id and t2.turn = t1.turn),
seeds as (select * from wanted union select o.* from orphans o join hit using (session_id)),
reach as (select distinct session_id, line from seeds union select l2.session_id, l2.line from reach join links l1 using (session_id, line) join links l2 on l2.session_id = l1.session_id and l2.id = l1.id),
bound as (select a.session_id, arg_min(a.line, depth) bline, arg_min(a.uuid, depth) buuid from a join chain on chain.session_id = a.session_id and chain.line = a.line where bnd group by a.session_id),
gone as (select r.* from reach r left join bound using (session_id) left join roots using (session_id) where not (bline is null and rline is not null and rline = r.line)),
snap as (select session_id, min(line) sline from a where typ = 'file-history-snapshot' group by session_id), ends as (select session_id, max(line) eline from a group by session_id),
facts as (select h.session_id, bline, buuid, rline, ruuid, rmeta, sline, coalesce(bline is null and rline is not null and not rmeta, false) swaps, exists (select 1 from gone g where g.session_id = h.session_id) any_gone
  from hit h left join bound using (session_id) left join roots using (session_id) left join snap using (session_id)),
work as (select *, case when swaps then ruuid else 'summary' end su from facts where any_gone or swaps),
ins as (select session_id, coalesce(bline, case when rline is not null then (case when rmeta then rline end) else coalesce(sline, 0) end) anchor, coalesce(buuid, case when rmeta then ruuid end) up from work where not swaps and any_gone),
kp as (select a.* from a anti join gone g on g.session_id = a.session_id and g.line = a.line),
wk as (select session_id, line, parent cur, 0 hops from kp
  union all select w.session_id, w.line, g.parent, hops + 1 from wk w join a g on g.session_id = w.session_id and g.uuid = w.cur semi join gone x on x.session_id = g.session_id and x.line = g.line),
rl as (select session_id, line, nullif(arg_max(coalesce(cur, ''), hops), '') parent from wk group by all),
fs as (select v.session_id, arg_min(v.line, v.pos) fline, any_value(su) su from vis v join work w using (session_id) anti join gone g on g.session_id = v.session_id and g.line = v.line
  where rline is null or v.line <> rline group by v.session_id)
select k.session_id, k.line, 0 sub, coalesce(case when f.fline = k.line then f.su else rl.parent end, '-') parent, coalesce(w.swaps and w.rline = k.line, false) is_summary
from kp k join rl on rl.session_id = k.session_id and rl.line = k.line left join fs f on f.session_id = k.session_id left join work w on w.session_id = k.session_id
union all select i.session_id, case when g.line is not null then eline else anchor end, 1, coalesce(up, '-'), true from ins i join ends using (session_id) left join gone g on g.session_id = i.session_id and g.line = i.anchor where anchor is not null"""))
def compact(spark, sf_dir):
    linked, chain, chosen = _compaction(spark, sf_dir, tokens=False)
    summaries = linked.select("session_id", F.lit("summary of the earlier part").alias("summary")).distinct()
    lines = CP.compact_linked(linked, summaries, chosen, STAMP, chain=chain).lines
    v = J.strict_parse(F.col("raw"))
    parent, own = J.as_id(F.col("v"), "$.parentUuid"), J.as_string(F.col("v"), "$.message.content") == "summary of the earlier part"
    shown = F.when(parent == RF.fork_id(F.col("session_id"), "summary"), "summary").otherwise(F.coalesce(parent, F.lit("-")))
    return lines.select("session_id", "line", "sub", v.alias("v")).select("session_id", "line", "sub", shown.alias("parent"), F.coalesce(own, F.lit(False)).alias("is_summary"))


@register("x17_pending_selection", sql("recursive al a refs chain", _VISIBLE + _CLOSE + _ASST_A + """
picked as (select session_id, line, floor(n * 0.5)::bigint n from vn where rn <= floor(n * 0.5)), hit as (select distinct session_id from picked),
wanted as (select session_id, line from picked union select t2.session_id, t2.line from turns t1 join picked p on p.session_id = t1.session_id and p.line = t1.line join turns t2 on t2.session_id = t1.session_id and t2.turn = t1.turn),
seeds as (select * from wanted union select o.* from orphans o join hit using (session_id)),
reach as (select distinct session_id, line from seeds union select l2.session_id, l2.line from reach join links l1 using (session_id, line) join links l2 on l2.session_id = l1.session_id and l2.id = l1.id),
mk as (select v.session_id, v.pos, v.uuid, g.line is not null gone from vis v join hit using (session_id) left join reach g on g.session_id = v.session_id and g.line = v.line
  anti join roots r on r.session_id = v.session_id and r.rline = v.line),
sel as (select session_id, arg_min(uuid, pos) filter (gone) first_removed, arg_max(uuid, pos) filter (gone) last_removed, arg_min(uuid, pos) filter (not gone) anchor from mk group by session_id)
select h.session_id, (select max(n) from picked p where p.session_id = h.session_id) remove_count, first_removed, last_removed, anchor,
 case when h.session_id::bigint % 3 = 0 then 'stale' else 'ready' end status from hit h left join sel on sel.session_id = h.session_id"""))
def pending_selection(spark, sf_dir):
    """The selection of today, and its state against a stored one whose anchor has moved in every third session."""
    linked, chain, chosen = _compaction(spark, sf_dir, tokens=False)
    current = cut(CP.pending_selection(linked, chosen, chain))
    stored = current.withColumn("anchor", F.when(F.col("session_id").cast("bigint") % 3 == 0, "moved").otherwise(F.col("anchor")))
    return current.join(CP.selection_matches(stored, current), "session_id")


def _flat_summaries(spark, sf_dir):
    return D.flat(spark, sf_dir).select("session_id", F.lit("summary").alias("summary")).distinct()


_PINNED = """, lastm as (select session_id, max(line) filter (typ = 'compacted' and false) from b group by session_id),
stopm as (select session_id, min(line) filter (mrole = 'assistant') st from b where itype = 'message' group by session_id),
pin as (select session_id, line from b join stopm using (session_id) where itype = 'message' and (st is null or line < st) and (mrole = 'developer' or (mrole = 'user' and ctx))),
cand as (select session_id, line, row_number() over (partition by session_id order by line) rn, count(*) over (partition by session_id) n from b where typ = 'response_item' and not exists (select 1 from pin where pin.session_id = b.session_id and pin.line = b.line)),
chosen as (select session_id, line from cand where rn <= floor(n * 0.35))"""


@register("x12_pinned_context", sql("b", _PINNED + " select session_id, line from pin"))
def pinned_context(spark, sf_dir):
    return CP.pinned_context(D.flat(spark, sf_dir))[1]


@register("x12_compact_flat", sql("b calls pairs", _PINNED + """, picked as (select session_id, line from chosen union select pin.* from pin where exists (select 1 from chosen where chosen.session_id = pin.session_id)), hit as (select distinct session_id from chosen),
badid as (select session_id, cid from paired where outputs > 0 and (not fits or exists (select 1 from picked p where p.session_id = paired.session_id and p.line = paired.call_line))),
gone0 as (select * from picked union select c.session_id, c.line from calls c join badid using (session_id, cid) join hit using (session_id) where c.side = 'output'),
fk as (select session_id, min(line) filter (typ = 'response_item' and not exists (select 1 from gone0 g where g.session_id = b.session_id and g.line = b.line)) fk, max(line) mx from b join hit using (session_id) group by session_id),
gone as (select * from gone0 union select b.session_id, b.line from b join fk using (session_id) where typ = 'compacted' and (fk is null or line < fk))
select session_id, line, 0 sub from b where kind in ('wrapped', 'unknown_json') and not exists (select 1 from gone g where g.session_id = b.session_id and g.line = b.line)
union all select session_id, coalesce(fk, mx + 1), -1 from fk"""))
def compact_flat(spark, sf_dir):
    rewrite = CP.compact_flat(D.flat(spark, sf_dir), _flat_summaries(spark, sf_dir), Amount("percent", 35), STAMP)
    return rewrite.lines.select("session_id", "line", "sub")


@register("x17_pending_selection_flat", sql("b calls pairs", _PINNED + """, picked as (select session_id, line from chosen union select pin.* from pin where exists (select 1 from chosen where chosen.session_id = pin.session_id)), hit as (select distinct session_id from chosen),
badid as (select session_id, cid from paired where outputs > 0 and (not fits or exists (select 1 from picked p where p.session_id = paired.session_id and p.line = paired.call_line))),
gone0 as (select * from picked union select c.session_id, c.line from calls c join badid using (session_id, cid) join hit using (session_id) where c.side = 'output'),
fk as (select session_id, min(line) filter (typ = 'response_item' and not exists (select 1 from gone0 g where g.session_id = b.session_id and g.line = b.line)) fk from b join hit using (session_id) group by session_id)
select session_id, count(*) remove_count, min(line) first_removed, max(line) last_removed, coalesce(any_value(fk), -1) anchor from chosen join fk using (session_id) group by session_id"""))
def pending_selection_flat(spark, sf_dir):
    flat = D.flat(spark, sf_dir)
    rewrite = CP.compact_flat(flat, _flat_summaries(spark, sf_dir), Amount("percent", 35), STAMP)
    rows = CP.pending_selection_flat(flat, rewrite.changes)
    return rows.withColumn("anchor", F.coalesce("anchor", F.lit(-1).cast("bigint")))


# The checks once more, over what the repair has left: thinking comes first in every row, so its place is even.
_CHECKED_AGAIN = (", before as (select session_id, count(*) n from issues where severity = 'error' group by session_id), " + "after as (with recursive al as (select * exclude (c, think), 0 c, think or merged think, false bad from fout),"
    " a as (select * from al), refs as (select r.* from frefs r semi join fout k on k.session_id = r.session_id and k.line = r.line), "
    + _ISSUES_A + " select session_id, count(*) n from issues where severity = 'error' group by session_id)")


@register("x16_guarded_fix", sql("recursive al a refs", ", " + _ISSUES_A + _fix_twin("f", "(select * exclude (bad) from a)", "refs") + _CHECKED_AGAIN + """
select s.session_id, coalesce(b.n, 0) errors_before, coalesce(f.n, 0) errors_after, coalesce(f.n, 0) <= coalesce(b.n, 0) wrote
from (select distinct session_id from al) s left join before b on b.session_id = s.session_id left join after f on f.session_id = s.session_id"""))
def guarded_fix(spark, sf_dir):
    return GP.lint_fix(GP.LINKED, D.linked(spark, sf_dir))[1].select("session_id", "errors_before", "errors_after", "wrote")


@register("x16_guarded_migrate", "with " + _OLD + """, o as (select * from old where cid is not null and itype in ('function_call', 'function_call_output')),
p as (select session_id, cid, count(*) filter (itype = 'function_call') calls, count(*) filter (itype = 'function_call_output') outputs, max(line) filter (itype = 'function_call') last_call,
  min(line) filter (itype = 'function_call_output') first_out from o group by all),
b4 as (select session_id, count(*) n from (select session_id from old where kind = 'invalid_json' union all select session_id from p where outputs > 0 and calls = 0) group by session_id),
af as (select session_id, count(*) n from (select session_id from old where cid is null and itype in ('function_call', 'function_call_output')
  union all select session_id from p where calls > 0 and first_out < last_call) group by session_id)
select s.session_id, coalesce(b4.n, 0) errors_before, coalesce(af.n, 0) errors_after, coalesce(af.n, 0) <= coalesce(b4.n, 0) wrote
from (select distinct session_id from old) s left join b4 on b4.session_id = s.session_id left join af on af.session_id = s.session_id""")
def guarded_migrate(spark, sf_dir):
    return GP.lint_fix(GP.FLAT, D.flat(spark, sf_dir, "legacy"))[1].select("session_id", "errors_before", "errors_after", "wrote")


@register("x15_pre_reload_fix", sql("recursive al a refs", _fix_twin("f", "a", "refs", uses=False) + f" select {_SHOWN} from fout"))
def pre_reload_fix(spark, sf_dir):
    return _retyped(RL.fix(D.linked(spark, sf_dir), RL.PRE_RELOAD).lines)


@register("k2_change_report", sql("b", """, n as (select session_id, line, row_number() over (partition by session_id order by line) rn, count(*) over (partition by session_id) c,
 case when kind = 'invalid_json' then 'invalid_json' else typ end why from b where kind = 'invalid_json' or typ in ('turn_context', 'event_msg'))
select session_id, rn::bigint pos, concat('- delete_line line=', line, ': ', why) text from n where rn <= 3
union all select distinct session_id, 4, concat('- … (', c - 3, ' more)') from n where c > 3"""))
def change_report(spark, sf_dir):
    return R.change_report(RF.strip_noise(D.flat(spark, sf_dir)).changes, 3)


@register("k1_session_text", sql("al a", "select session_id, line, uuid, row_number() over (partition by session_id order by line) place from a"))
def session_text(spark, sf_dir):
    """Written by session, read back from the text itself; the place is that of the line in its session."""
    from loomlog.session import store_path

    path = store_path(spark, "sessions")
    rows = L.entries(D.linked(spark, sf_dir)).select("session_id", "line", "raw")
    DOC.write_sessions(rows, path)
    back = spark.read.parquet(path).select("session_id", "line", "raw")
    return numbered(L.parse_lines(back), "place").select("session_id", "line", J.as_string(F.col("v"), "$.uuid").alias("uuid"), "place")


# --- report -------------------------------------------------------------------

@register("a15_report", sql("recursive al a refs chain sizes", ", " + _ISSUES_A + """, sev as (select session_id, count(*) filter (severity = 'error') errors, count(*) filter (severity = 'warning') warnings,
 count(*) filter (severity = 'info') infos from issues group by session_id),
det as (select session_id, bool_and(bad) lost, bool_or(bad) any_bad, count(*) filter (bad) invalid_json from al group by session_id),
ids as (select session_id, count(distinct sid) session_ids, count(distinct case when side then c % 3 end) agent_ids, bool_or(side) is_sidechain from a group by session_id),
lb as (select session_id, coalesce(max(line) filter (bnd), 0) l from a group by session_id), tr as (select session_id, count(*) filter (side = 'use') u, count(*) filter (side = 'result') rs from refs group by session_id),
st as (select a.session_id, count(*) entries, count(*) filter (msg) messages, count(*) filter (bnd) boundaries, count(*) filter (line > l) visible_entries, count(*) filter (line > l and msg) visible_messages,
 coalesce(any_value(u), 0) tool_use_blocks, coalesce(any_value(rs), 0) tool_result_blocks from a join lb using (session_id) left join tr using (session_id) group by a.session_id),
tk as (select session_id, sum(tokens)::bigint approx_tokens, count(*) chain_messages from sizes group by session_id)
select d.session_id, case when lost then 'unknown' else 'claude' end agent, case when not lost then 'jsonl' end "format", case when lost then 'low' when any_bad then 'medium' else 'high' end confidence,
 coalesce(entries, 0) entries, coalesce(messages, 0) messages, coalesce(boundaries, 0) boundaries, coalesce(visible_entries, 0) visible_entries, coalesce(visible_messages, 0) visible_messages,
 coalesce(tool_use_blocks, 0) tool_use_blocks, coalesce(tool_result_blocks, 0) tool_result_blocks, coalesce(session_ids, 0) session_ids, coalesce(agent_ids, 0) agent_ids, is_sidechain,
 invalid_json, coalesce(approx_tokens, 0) approx_tokens, coalesce(chain_messages, 0) chain_messages, coalesce(errors, 0) errors, coalesce(warnings, 0) warnings, coalesce(infos, 0) infos
from det d left join st using (session_id) left join ids using (session_id) left join tk using (session_id) left join sev using (session_id)"""))
def report(spark, sf_dir):
    linked = D.linked(spark, sf_dir)
    detected = L.detect_format(D.parsed_table(spark, sf_dir, "chats"))
    return GP.report_linked(linked, detected, _linked_issues(spark, sf_dir), D.chain(spark, sf_dir))


@register("a15_report_flat", sql("b calls pairs", ", " + _ISSUES_B + f""", sev as (select session_id, count(*) filter (severity = 'error') errors, count(*) filter (severity = 'warning') warnings,
 count(*) filter (severity = 'info') infos from issues group by session_id),
pr as (select session_id, case when itype = 'message' then concat('[', mrole, ']: ', trim(note)) when itype like '%output' then concat('[assistant]: [result: ', itype, case when cid is null then '' else concat(' ', cid) end, ']', chr(10), {_ITEM})
 else concat('[assistant]: [tool: tool', e % 5, ']', chr(10), {_ITEM}) end prompt from b where itype is not null),
es as (select session_id, sum((strlen(prompt) + 1 + 3) // 4)::bigint estimate from pr group by session_id),
rd as (select session_id, arg_max(case when e % 3 <> 0 then floor(value * 1000) else floor(value * 2000) end, line)::bigint last_tokens from b where typ = 'event_msg' group by session_id)
select session_id, arg_min(concat('conv-', u), line) filter (typ = 'session_meta' and e % 2 = 0) conversation_id, count(*) filter (typ = 'session_meta') session_meta, count(*) filter (typ = 'compacted') compacted,
 count(*) filter (kind = 'invalid_json') invalid_json, count(*) filter (kind = 'unknown_json') unknown_json, coalesce(any_value(estimate), 0) estimate, coalesce(any_value(last_tokens), 0) last_tokens,
 coalesce(any_value(errors), 0) errors, coalesce(any_value(warnings), 0) warnings, coalesce(any_value(infos), 0) infos
from b left join sev using (session_id) left join es using (session_id) left join rd using (session_id) group by session_id"""))
def report_flat(spark, sf_dir):
    flat = D.flat(spark, sf_dir)
    detected = L.detect_format(D.parsed_table(spark, sf_dir, "rollouts"))
    rows = GP.report_flat(flat, detected, _flat_issues(spark, sf_dir))
    return rows.select("session_id", "conversation_id", "session_meta", "compacted", "invalid_json", "unknown_json", "estimate", "last_tokens", "errors", "warnings", "infos")


@register("a14_error_delta", sql("al a refs b calls pairs", ", " + _ISSUES_B + """, o as (select session_id, count(*) filter (code <> 'codex.missing_session_meta') errors_before,
 count(*) filter (code not in ('codex.invalid_json_line', 'codex.missing_session_meta')) + 1 errors_after from issues where severity = 'error' group by session_id),
m as (select distinct session_id from issues where code = 'codex.missing_session_meta'), n as (select distinct session_id from issues where code = 'codex.session_meta_missing_id'),
d as (select s.session_id, coalesce(errors_before, 0) + (m.session_id is not null)::int errors_before, coalesce(errors_after, 1) - (n.session_id is not null)::int errors_after
 from (select distinct session_id from b) s left join o using (session_id) left join m using (session_id) left join n using (session_id))
select session_id, errors_before::bigint errors_before, errors_after::bigint errors_after, errors_after > errors_before worse from d"""))
def error_delta(spark, sf_dir):
    """A rewrite that drops unreadable lines and, wrongly, the session's meta record: checked again from scratch."""
    flat = D.flat(spark, sf_dir)
    after = cut(flat.where("kind <> 'invalid_json' and not coalesce(type = 'session_meta', false)"))
    return C.error_delta(_flat_issues(spark, sf_dir), C.validate_flat(after).unionByName(C.parse_issues_flat(after)), flat)


@register("ud3_dispatch", sql("al a b lg", """select 'claude' agent, session_id, count(*) n from a where role in ('user', 'assistant') and trim(text) <> '' group by all
union all select 'codex', concat('R', session_id), count(*) from b where (itype = 'message' and mrole in ('user', 'assistant')) or typ = 'compacted' group by all"""))
def dispatch(spark, sf_dir):
    """Two formats in one table; each session goes to the adapter of its detected agent."""
    chats = D.chat_lines(spark, sf_dir)
    both = chats.unionByName(D.rollout_lines(spark, sf_dir).withColumn("session_id", F.concat(F.lit("R"), "session_id")))
    parsed = cut(L.parse_lines(both))
    rows = GP.dispatch(parsed, lambda adapter, typed: adapter.export(typed).withColumn("agent", F.lit(adapter.agent)))
    return rows.groupBy("agent", "session_id").agg(F.count(F.lit(1)).alias("n"))


# --- catalog ------------------------------------------------------------------

_FILES = """fl as (select cast(conv_id as varchar) session_id, conv_id c, concat('/logs/-work-p', conv_id % 10, '/', conv_id, '.jsonl') path, 1704067200 + (conv_id * 37) % 1000 * 3600 mt from conversations group by conv_id),
ff as (select cast(user_id as varchar) session_id, user_id u, o, concat('/rollouts/', o, '/rollout-', user_id, '.jsonl') path, 1704067200 + (user_id * 53) % 997 * 3600 - o * 86400 mt
  from (select user_id, unnest(case when user_id % 3 = 0 then [0, 1] else [0] end) o from (select distinct user_id from events)))"""


@register("t1_rank_linked", sql("al a", ", " + _FILES + """, nh as (select session_id, count(*) n, bool_or(bad) bad, bool_or(not bad and typ in ('user', 'assistant')) talks, bool_or(not bad) good,
 bool_or(not bad and sid = session_id) own, max(sec) filter (not bad) act from al group by session_id),
sc as (select fl.session_id, c % 10 p, path, mt, 100 - (case when good then 10 else 0 end) + (case when good then 20 else 0 end) + (case when good then 20 else -100 end) - (case when bad then 50 else 0 end) score, coalesce(act, mt) act
 from fl join nh using (session_id) where talks)
select concat('/work/p', p) project, session_id, score::bigint score, row_number() over (partition by p order by act desc, score desc, mt desc, path) rank from sc qualify rank <= 6"""))
def rank_linked(spark, sf_dir):
    rows = CT.rank_linked(D.parsed_table(spark, sf_dir, "chats"), D.chat_files(spark, sf_dir), D.projects(spark, sf_dir), max_candidates=None)
    return rows.select("project", "session_id", F.col("score").cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("t2_rank_flat", sql("b", ", " + _FILES + """,
hd as (select * from b where kind <> 'non_object'),
mm as (select session_id, arg_min(e, line) me from hd where typ = 'session_meta' group by session_id),
bd as (select session_id, bool_or(kind = 'invalid_json') bad from b group by session_id),
tl as (select * from b),
ac as (select session_id, max(date_trunc('milliseconds', ts)) act from tl where kind = 'wrapped' group by session_id),
pj as (select distinct c % 10 p from fl),
sc as (select concat('/work/p', u % 10) project, session_id, path, mt, 170 + (case when me % 2 = 0 then 10 else 0 end) - (case when bad then 50 else 0 end) score, act
  from ff join mm using (session_id) join bd using (session_id) join ac using (session_id) join pj on p = u % 10 where o = 0),
rk as (select *, row_number() over w rank, lead(act) over w act2, lead(score) over w score2 from sc window w as (partition by project order by act desc, score desc, mt desc, path))
select project, session_id, score::bigint score, rank, case when score >= 140 then case when rank = 1 and act2 is not null and not (epoch_ms(act) - epoch_ms(act2) >= 21600000 or score - score2 >= 30) then 'medium' else 'high' end
 when score >= 80 then 'medium' else 'low' end confidence from rk where rank <= 6"""))
def rank_flat(spark, sf_dir):
    files = CT.dedupe_latest(D.rollout_files(spark, sf_dir)).drop("cwd")
    rows = CT.rank_flat(D.parsed_table(spark, sf_dir, "rollouts"), files, D.projects(spark, sf_dir))
    return rows.select("project", "session_id", F.col("score").cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank"), "confidence")


@register("t2_fallback_flat", sql("b", ", " + _FILES + """,
hd as (select * from b where kind <> 'non_object'),
mm as (select session_id, arg_min(e, line) me from hd where typ = 'session_meta' group by session_id),
bd as (select session_id, bool_or(kind = 'invalid_json') bad from b group by session_id),
tl as (select * from b),
ac as (select session_id, max(date_trunc('milliseconds', ts)) act from tl where kind = 'wrapped' group by session_id)
select session_id, (20 + (case when me is not null then 40 else 0 end) + (case when me % 2 = 0 then 10 else 0 end) - (case when bad then 50 else 0 end))::bigint score
from ff left join mm using (session_id) join bd using (session_id) join ac using (session_id) where o = 0 order by act desc, score desc, mt desc, path limit 5"""))
def fallback_flat(spark, sf_dir):
    files = CT.dedupe_latest(D.rollout_files(spark, sf_dir)).drop("cwd")
    rows = CT.fallback_flat(D.parsed_table(spark, sf_dir, "rollouts"), files)
    return rows.select("session_id", F.col("score").cast("bigint").alias("score"))


@register("f5_match_text", sql("al a", """select distinct session_id from (select * from al qualify row_number() over (partition by session_id order by line desc) <= 5) where not bad and lower(text) like '%thand%'"""))
def match_text(spark, sf_dir):
    return CT.match_text(D.parsed_table(spark, sf_dir, "chats"), "THAND", 5)


@register("t3_lookup", sql("al a", ", " + _FILES + """, m as (select distinct session_id from al where not bad and lower(text) like '%thand%'),
k as (select session_id, bool_or(bad) bad, max(sec) filter (not bad) act from al group by session_id)
select session_id, (110 - case when bad then 50 else 0 end)::bigint score from fl join m using (session_id) join k using (session_id) order by act desc, 2 desc, mt desc, path limit 5"""))
def lookup(spark, sf_dir):
    rows = CT.lookup(D.parsed_table(spark, sf_dir, "chats"), D.chat_files(spark, sf_dir), "thand")
    return rows.select("session_id", F.col("score").cast("bigint").alias("score"))


@register("t3_lookup_ids", sql("al a b", ", " + _FILES + """, w as (select distinct event_id::varchar session_id from events where event_id < 200),
k as (select session_id, bool_or(bad) bad, bool_or(not bad and typ in ('user', 'assistant')) talks from al group by session_id),
f as (select session_id, bool_or(kind = 'invalid_json') bad, bool_or(typ = 'session_meta') meta from b group by session_id),
x as (select session_id, 'claude' agent, path, 130 - case when bad then 50 else 0 end score from fl join k using (session_id) where talks),
y as (select session_id, 'codex' agent, path, 100 - case when bad then 50 else 0 end score from ff join f using (session_id) where meta qualify row_number() over (partition by session_id order by mt desc, path) = 1)
select w.session_id, coalesce(x.agent, y.agent, 'unknown') agent, coalesce(x.path, y.path, '-') path, coalesce(x.score, y.score, 0)::bigint score,
 case when x.agent is null and y.agent is null then 'low' else 'high' end confidence from w left join x on x.session_id = w.session_id left join y on y.session_id = w.session_id"""))
def lookup_ids(spark, sf_dir):
    """Ids of conversations, of users, of both and of neither."""
    wanted = D.table(spark, sf_dir, "events").where("event_id < 200").selectExpr("cast(event_id as string) as session_id")
    rows = CT.lookup_ids(wanted, D.parsed_table(spark, sf_dir, "chats"), D.chat_files(spark, sf_dir), D.parsed_table(spark, sf_dir, "rollouts"), D.rollout_files(spark, sf_dir))
    return rows.select("session_id", "agent", F.coalesce("path", F.lit("-")).alias("path"), F.coalesce("score", F.lit(0).cast("bigint")).alias("score"), "confidence")


@register("t3_lookup_flat", sql("b", ", " + _FILES + """, m as (select distinct session_id from b where (itype = 'message' or (typ = 'compacted' and e % 3 = 0)) and note like '%value 42 %')
select session_id, path, 10::bigint score from ff join m using (session_id) order by mt desc, path limit 5"""))
def lookup_flat(spark, sf_dir):
    """Without an agent: no linked session holds the text, so the flat ones are searched."""
    rows = CT.lookup_any(
        D.parsed_table(spark, sf_dir, "chats"), D.chat_files(spark, sf_dir), D.parsed_table(spark, sf_dir, "rollouts"), D.rollout_files(spark, sf_dir), "VALUE 42 ")
    return rows.select("session_id", "path", "score")


_CATALOG = ", " + """tr as (select user_id u, cast(user_id as varchar) session_id, greatest(1704067200 + user_id % 50 * 3600, case when user_id % 2 = 0 then 1704067200 + (user_id * 7) % 600 * 3600 else 0 end, case when user_id % 3 = 0 then 1704067200 + (user_id * 11) % 700 * 3600 else 0 end) ta
 from (select distinct user_id from events where user_id % 4 <> 0)),
cat as (select 'claude' agent, session_id, path, mt, concat('/work/p', c % 10) cwd, 'claude-project' source from fl
 union all select 'codex', session_id, path, mt, concat('/work/p', u % 10), 'codex-rollout' from ff where o = 0),
ct as (select cat.*, ta is not null tracked, coalesce(ta, mt) st from cat left join tr using (session_id))"""


@register("t4_catalog", "with " + _FILES + _CATALOG + " select agent, session_id, path, tracked, st::bigint sort_sec from ct")
def catalog(spark, sf_dir):
    rows = CT.catalog(D.chat_files(spark, sf_dir), D.rollout_files(spark, sf_dir), D.tracked(spark, sf_dir), limit=None)
    return rows.select("agent", "session_id", "path", "tracked", F.unix_seconds("sort_ts").alias("sort_sec"))


@register("t4_catalog_page", "with " + _FILES + _CATALOG + " select agent, session_id from ct order by st desc, session_id, agent limit 80")
def catalog_page(spark, sf_dir):
    return CT.catalog(D.chat_files(spark, sf_dir), D.rollout_files(spark, sf_dir), D.tracked(spark, sf_dir), limit=80).select("agent", "session_id")


@register("f6_catalog_search", "with " + _FILES + _CATALOG + " select agent, session_id, path from ct where lower(concat_ws(' ', agent, session_id, path, cwd, source)) like '%p3%'")
def catalog_search(spark, sf_dir):
    rows = CT.catalog(D.chat_files(spark, sf_dir), D.rollout_files(spark, sf_dir), D.tracked(spark, sf_dir), limit=None)
    return CT.search(rows, " P3 ").select("agent", "session_id", "path")


@register("f12_tracked_only", "with " + _FILES + _CATALOG + " select agent, session_id from ct where tracked order by st desc, session_id, agent limit 80")
def tracked_only(spark, sf_dir):
    rows = CT.catalog(D.chat_files(spark, sf_dir), D.rollout_files(spark, sf_dir), D.tracked(spark, sf_dir), limit=None)
    return CT.tracked_only(rows).select("agent", "session_id")


@register("w8_dedupe_latest", "with " + _FILES + " select session_id, path from ff qualify row_number() over (partition by session_id order by mt desc) = 1")
def dedupe_latest(spark, sf_dir):
    return CT.dedupe_latest(D.rollout_files(spark, sf_dir)).select("session_id", "path")


@register("w9_runner_up", "with " + _FILES + """, rk as (select c % 10 p, path, row_number() over (partition by c % 10 order by mt desc, path) rn from fl)
select concat('/work/p', p) project, path, rn::bigint rank from rk where rn = 2""")
def runner_up(spark, sf_dir):
    files = D.chat_files(spark, sf_dir).withColumn("project", F.col("cwd")).withColumn("score", F.lit(100)).withColumn(
        "method", F.lit("cwd-hash")).withColumn("activity", F.col("mtime"))
    rows = CT.ranked(files, ["project"])
    hits = rows.where("rank = 1").select("project", F.col("path").alias("hit_path"))
    return CT.runner_up(rows.join(hits, "project")).select("project", "path", F.col("rank").cast("bigint").alias("rank"))


@register("t5_newest_per_project", "with " + _FILES + " select concat('/work/p', c % 10) project, arg_max(path, (mt, path)) path from fl group by c % 10")
def newest_per_project(spark, sf_dir):
    return CT.newest_per_project(D.chat_files(spark, sf_dir), D.projects(spark, sf_dir))


@register("j6_enrich", "with " + _FILES + _CATALOG + " select agent, session_id, path, tracked from ct")
def enrich(spark, sf_dir):
    files = {"codex": CT.dedupe_latest(D.rollout_files(spark, sf_dir)), "claude": D.chat_files(spark, sf_dir)}
    parts = [
        CT.enrich(f.select("session_id", "path"), D.tracked(spark, sf_dir)).select(F.lit(agent).alias("agent"), "session_id", "path", "tracked")
        for agent, f in files.items()]
    return parts[0].unionByName(parts[1])


@register("j7_runs_handshakes", """select concat('run', u) run_id, case when u % 3 = 1 then concat('hs', u) else '-' end handshake_session
from (select distinct user_id u from events) where u % 13 <> 5 and u % 10 <> 9 and u % 17 <> 3""")
def runs_handshakes(spark, sf_dir):
    users = D.table(spark, sf_dir, "events").select("user_id").distinct()
    shakes = DOC.read_handshakes(DOC.parse_documents(users.selectExpr(
        "concat('{\"runId\":\"run', case when user_id % 3 = 2 then -user_id else user_id end, '\",\"ts\":\"t\",\"', "
        "case when user_id % 3 = 0 then 'none' else 'sessionId' end, '\":\"hs', user_id, '\"}') as value")))
    records = DOC.runs(DOC.parse_documents(_run_documents(spark, sf_dir)))
    return CT.runs_with_handshakes(records, shakes).select("run_id", F.coalesce("handshake_session", F.lit("-")).alias("handshake_session"))


@register("j9_id_lookup", """with l as (select distinct cast(conv_id as varchar) s from conversations), f as (select distinct cast(user_id as varchar) s from events),
w as (select distinct cast(doc_id as varchar) s from documents)
select s session_id, case when s in (select s from l) then case when s in (select s from f) then 'ambiguous' else 'claude' end when s in (select s from f) then 'codex' else 'not_found' end verdict from w""")
def id_lookup(spark, sf_dir):
    wanted = D.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("session_id"))
    return CT.id_lookup(D.chat_files(spark, sf_dir), D.rollout_files(spark, sf_dir), wanted)


@register("j10_newer_rollout", sql("b", """, m as (select session_id, arg_min(e, line) e, arg_min(u, line) u, arg_min(date_trunc('milliseconds', ts), line) ts from b where typ = 'session_meta' group by session_id),
k as (select concat('conv-', u) id, concat('/work/p', u % 10) cwd, ts from m where e % 2 = 0)
select cwd, 'none' thread_id, arg_max(id, (ts, id)) newer_id from k where ts > timestamp '2024-01-05' group by cwd"""))
def newer_rollout(spark, sf_dir):
    metas = CT.rollout_metas(D.parsed_table(spark, sf_dir, "rollouts")).withColumn("mtime", F.lit(None).cast("timestamp"))
    recorded = D.projects(spark, sf_dir).select("cwd").distinct().withColumn("thread_id", F.lit("none")).withColumn(
        "newer_than", F.expr("timestamp'2024-01-05 00:00:00'"))
    return CT.newer_rollout(metas, recorded)


@register("j11_session_by_priority", "with " + _FILES + """, p as (select distinct c % 10 p from fl), b as (select p.p, (select arg_max(session_id, (mt, path)) from fl where c % 10 = p.p) best from p)
select concat('/work/p', p) project, case when p % 3 = 0 then concat('live', p) when p % 3 = 1 then concat('rec', p) else best end session_id,
 case p % 3 when 0 then 'handshake' when 1 then 'recorded' else 'discovery' end origin from b""")
def session_by_priority(spark, sf_dir):
    projects = D.projects(spark, sf_dir)
    n = F.substring_index("cwd", "p", -1).cast("int")
    base = projects.select("cwd").distinct()
    live = base.where(n % 3 == 0).select("cwd", F.concat(F.lit("live"), n.cast("string")).alias("session_id"))
    recorded = base.where(n % 3 < 2).select("cwd", F.concat(F.lit("rec"), n.cast("string")).alias("thread_id"))
    files = D.chat_files(spark, sf_dir).withColumn("project", F.col("cwd"))
    best = CT.newest_first(files, ["project"], [F.col("mtime").desc(), F.col("path").desc()]).select(
        "project", "session_id", F.lit(1).alias("rank"), F.lit("high").alias("confidence"))
    return CT.session_by_priority(projects, live, recorded, best)


def _backups(spark, sf_dir):
    return D.table(spark, sf_dir, "events").selectExpr(
        "cast(user_id as string) as session_id", "concat(lpad(cast(event_id as string), 9, '0'), case when event_id % 5 = 0 then '.tmp' else '.jsonl' end) as name",
        "concat('/backups/', user_id, '/', event_id) as path")


@register("k5_backup_retention", """select user_id::varchar session_id, concat(lpad(event_id::varchar, 9, '0'), '.jsonl') name from events where event_id % 5 <> 0
qualify row_number() over (partition by user_id order by event_id desc) > 10""")
def backup_retention(spark, sf_dir):
    return CT.expired_backups(_backups(spark, sf_dir), 10).select("session_id", "name")


@register("u5_latest_backup", "select user_id::varchar session_id, concat('/backups/', user_id, '/', max(event_id)) path from events where event_id % 5 <> 0 group by user_id")
def latest_backup(spark, sf_dir):
    return CT.latest_backup(_backups(spark, sf_dir))


@register("k6_pins_upsert", """with c as (select distinct conv_id c from conversations)
select concat('pin', c) name, case when c % 2 = 0 and c % 4 <> 2 then 'new' else 'old' end origin from c where c % 3 <> 1 or c % 2 = 0""")
def pins_upsert(spark, sf_dir):
    convs = D.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    pin = "concat('pin', conv_id) as name", "'claude' as agent", "cast(conv_id as string) as session_id"
    old = convs.where("conv_id % 3 <> 1 or conv_id % 4 = 2").selectExpr(*pin, "concat('/a/', conv_id) as session_path", "'2024-01-01T00:00:00Z' as pinned_at", "'old' as origin")
    new = convs.where("conv_id % 2 = 0").selectExpr(*pin, "concat(case when conv_id % 4 = 2 then '/b/' else '/a/' end, conv_id) as session_path", "'2024-01-02T00:00:00Z' as pinned_at", "'new' as origin")
    return CT.pins_upsert(old, new)[0].select("name", "origin")


@register("f10_retention", """select session_id, round(age, 3) age_days from (select cast(user_id as varchar) session_id, (1706745600 - greatest(1704067200 + user_id % 50 * 3600, case when user_id % 2 = 0 then 1704067200 + (user_id * 7) % 600 * 3600 else 0 end, case when user_id % 3 = 0 then 1704067200 + (user_id * 11) % 700 * 3600 else 0 end)) / 86400.0 age
from (select distinct user_id from events where user_id % 4 <> 0)) where age >= 14""")
def retention(spark, sf_dir):
    return CT.retention(D.tracked(spark, sf_dir), _now(), 14).select("session_id", F.round("age_days", 3).alias("age_days"))


@register("m9_stale_runs", """with u as (select distinct user_id u from events), ok as (select * from u where u % 13 <> 5 and u % 10 <> 9 and u % 17 <> 3)
select 'remove_active_record' kind, concat('/runs/', u, '.json') path, 'invalid_record' reason from u where u not in (select u from ok)
union all select 'remove_active_record', concat('/runs/', u, '.json'), 'pid_not_alive' from ok where u % 4 <> 1
union all select distinct 'remove_control_dir', concat('/ctl/', u // 2), 'pid_not_alive' from ok where u % 4 <> 1""")
def stale_runs(spark, sf_dir):
    documents = _run_documents(spark, sf_dir)
    live = D.table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 4 = 1").selectExpr("user_id + 100 as pid")
    return CT.stale_runs(documents, DOC.runs(DOC.parse_documents(documents)), live)


@register("u6_layered_settings", """with u as (select distinct user_id u from events)
select u::varchar scope, 'threshold' setting, case when u % 3 = 0 then concat('local', u) when u % 2 = 0 then concat('global', u) else 'default' end value,
 case when u % 3 = 0 then 'local' when u % 2 = 0 then 'global' else 'default' end source from u""")
def layered_settings(spark, sf_dir):
    users = D.table(spark, sf_dir, "events").select("user_id").distinct()
    rows = users.selectExpr("cast(user_id as string) as scope", "'threshold' as setting", "explode(map('default', 'default', 'global', "
                            "case when user_id % 2 = 0 then concat('global', user_id) end, 'local', case when user_id % 3 = 0 then concat('local', user_id) end)) as (layer, value)")
    return CT.layered_settings(rows)


# --- files --------------------------------------------------------------------

_LINES = """with n as (select user_id::varchar session_id, case when event_id % 10 = 3 then ' ' else concat(event_type, ' ', event_id, ' ', strftime(ts, '%Y-%m-%d %H:%M:%S'),
  case when microsecond(ts) % 1000000 = 0 then '' else concat('.', rtrim(lpad((microsecond(ts) % 1000000)::varchar, 6, '0'), '0')) end) end raw,
  row_number() over (partition by user_id order by event_id) line, count(*) over (partition by user_id) n from events)"""


@register("s1_read_files", """with f as (select concat(case when conv_id % 13 = 4 then 'agent-' else '' end, conv_id) session_id, turn + 1 line from conversations)
select session_id, count(*) lines, sum(line)::bigint line_sum from f group by all""")
def read_files(spark, sf_dir):
    """K1's files of the conversations, read back in splits."""
    rows = L.read_session_lines(spark, D.transcript_files(spark, sf_dir))
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("line").alias("line_sum"))


@register("k1_file_contents", _LINES + " select session_id, line, md5(raw) raw_md5 from n where trim(raw) <> ''")
def file_contents(spark, sf_dir):
    root = store_path(spark, "files")
    DOC.write_jsonl(D.event_files(spark, sf_dir).withColumn("path", F.concat(F.lit(f"{root}/"), "name")))
    return L.read_session_lines(spark, root).select("session_id", "line", F.md5("raw").alias("raw_md5"))


@register("s5_scan_projects", """select conv_id::varchar session_id, concat('-work-p', conv_id % 10) project_dir from (select distinct conv_id from conversations)
where conv_id % 10 in (3, 7) and conv_id % 13 <> 4""")
def scan_projects(spark, sf_dir):
    return DOC.scan_projects(spark, D.transcript_files(spark, sf_dir), ["/work/p3", "/work/p7"]).select("session_id", "project_dir")


@register("s6_scan_rollouts", r"""select regexp_replace(md5(user_id::varchar), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\1-\2-\3-\4-\5') session_id from (select distinct user_id from events) where 1 + user_id % 28 between 8 and 20""")
def scan_rollouts(spark, sf_dir):
    """The thirteen day folders up to the 20th."""
    return DOC.scan_rollouts(spark, D.rollout_folders(spark, sf_dir), datetime(2024, 1, 20).date(), 13).select("session_id")


@register("m8_growing_files", _LINES + " select session_id, case when line <= n // 2 then 1 else 2 end::bigint version, line, md5(raw) raw_md5 from n where trim(raw) <> ''")
def growing_files(spark, sf_dir):
    """Half of each file and half a line more, a stock; the rest of it, a stock; then the lines of both versions."""
    root, store = store_path(spark, "growing"), store_path(spark, "growing-store")
    lines = cut(D.event_files(spark, sf_dir).withColumn("path", F.concat(F.lit(f"{root}/"), "name")))
    sizes = lines.groupBy("path").agg(F.max("line").alias("n"))
    placed = lines.join(sizes, "path").withColumn("half", F.floor(F.col("n") / 2)).where("line <= half + 1").withColumn("whole", F.col("line") <= F.col("half"))
    begun = F.when(F.col("whole"), F.col("raw")).otherwise(F.substring("raw", F.lit(1), F.floor(F.length("raw") / 2).cast("int")))
    DOC.write_jsonl(placed.withColumn("raw", begun), "whole")
    GR.take_stock(spark, [root], store)
    DOC.write_jsonl(lines)
    GR.take_stock(spark, [root], store)
    return GR.grown_lines(spark, store).select("session_id", "version", "line", F.md5("raw").alias("raw_md5"))


@register("s8_tail_from_end", _LINES + " select session_id, row_number() over (partition by session_id order by line desc)::int back, md5(raw) raw_md5 from n where trim(raw) <> '' qualify back <= 20")
def tail_from_end(spark, sf_dir):
    root = store_path(spark, "tails")
    DOC.write_jsonl(D.event_files(spark, sf_dir).withColumn("path", F.concat(F.lit(f"{root}/"), "name")))
    rows = GR.tail_lines(GR.list_files(spark, [root]), 20)
    return rows.select(P.session_id_from_path(F.col("path")).alias("session_id"), "back", F.md5("raw").alias("raw_md5"))


@register("m10_control_cursor", """select session_id, 2::bigint version, count(*) commands, arg_max(e, line)::varchar reason from (
  select user_id::varchar session_id, event_id e, event_type, row_number() over (partition by user_id order by event_id) line, count(*) over (partition by user_id) n from events)
where line > n // 2 and event_type in ('click', 'view') group by session_id""")
def control_cursor(spark, sf_dir):
    """Reload commands of control logs beyond a stored cursor: version 1 has been read before."""
    root, store = store_path(spark, "control"), store_path(spark, "control-store")
    rows = D.table(spark, sf_dir, "events").selectExpr(
        "cast(user_id as string) as session_id", "event_id as line",
        "to_json(named_struct('ts', ts, 'cmd', case when event_type in ('click', 'view') then 'reload' else event_type end, 'reason', cast(event_id as string))) as raw")
    lines = cut(numbered(rows, "n").selectExpr("session_id", f"concat('{root}/runs/', session_id, '.jsonl') as path", "n as line", "raw"))
    sizes = lines.groupBy("path").agg(F.max("line").alias("n"))
    DOC.write_jsonl(lines.join(sizes, "path").where("line <= floor(n / 2)"))
    cursor = GR.take_stock(spark, [root], store)
    DOC.write_jsonl(lines)
    GR.take_stock(spark, [root], store)
    return GR.reload_commands(GR.grown_lines(spark, store, after=cursor))


@register("k4_append_log", """select user_id::varchar session_id, count(*) n, count(*) filter (event_type = 'click') stamped from events group by user_id""")
def append_log(spark, sf_dir):
    """Two batches, the second attempted twice; rows without a time get the stamp of the append."""
    path = store_path(spark, "appended")
    rows = D.table(spark, sf_dir, "events").selectExpr(
        "cast(user_id as string) as session_id", "case when event_type <> 'click' then cast(ts as string) end as ts", "event_type as event", "event_id")
    for batch, part in (("0", "event_id % 2 = 0"), ("1", "event_id % 2 = 1"), ("1", "event_id % 2 = 1")):
        DOC.append_log(rows.where(part), path, STAMP, batch)
    back = DOC.read_appended(spark, path)
    return back.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.get_json_object("value", "$.ts") == STAMP).alias("stamped"))


@register("ud1_token_counter", sql("recursive al a chain", """select a.session_id, sum(case when text = '' then 0 else len(regexp_extract_all(text, concat('[^ ', chr(10), ']+'))) end
 + case when think then 2 else 0 end + case when has_res then 2 else 0 end + case when has_late then 1 else 0 end + case when has_use then 3 else 0 end)::bigint words
from a join chain using (session_id, line) where msg group by a.session_id"""))
def token_counter(spark, sf_dir):
    """Tokens by a counter of the caller: words between blanks, over all segments of a message."""
    def words(segments):
        return F.aggregate(segments, F.lit(0).cast("bigint"), lambda n, t: n + F.regexp_count(t, F.lit("[^ \n]+")))

    tokens = S.message_tokens(D.linked(spark, sf_dir), D.chain(spark, sf_dir), words)
    return S.session_tokens(tokens).select("session_id", F.col("approx_tokens").cast("bigint").alias("words"))


# --- projections of their own -------------------------------------------------

@register("p1_entry_columns", sql("al a", """select session_id, line, typ "type", uuid, coalesce(parent, '-') parent_uuid, role from a"""))
def entry_columns(spark, sf_dir):
    return L.entries(D.linked(spark, sf_dir)).select("session_id", "line", "type", "uuid", F.coalesce("parent_uuid", F.lit("-")).alias("parent_uuid"), "role")


@register("p2_content_blocks", sql("al a", """, k as (select session_id, line, unnest(list_filter([
  case when think and c % 2 = 0 then 'thinking' end, case when has_res then 'tool_result' end, case when has_late then 'tool_result' end,
  case when role = 'assistant' or has_res then 'text' end, case when has_use then 'tool_use' end, case when think and c % 2 = 1 then 'thinking' end], lambda x: x is not null)) kind from a)
select session_id, line, kind, count(*) n from k group by all"""))
def content_blocks(spark, sf_dir):
    rows = L.entries(D.linked(spark, sf_dir)).select("session_id", "line", F.explode("blocks").alias("b"))
    return rows.groupBy("session_id", "line", F.col("b.type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register("p16_durations", """select event_id, case event_id % 4 when 0 then event_id when 1 then event_id * 1000 when 2 then event_id * 500 end::bigint ms from events""")
def durations(spark, sf_dir):
    text = ("case event_id % 4 when 0 then concat(event_id, 'ms') when 1 then concat(' ', event_id, 's') "
            "when 2 then concat(cast(event_id div 2 as string), case when event_id % 2 = 1 then '.5s' else 's' end) else concat(event_id, ' s') end")
    return D.table(spark, sf_dir, "events").selectExpr("event_id", f"{text} as t").select("event_id", specs.duration_ms_column(F.col("t")).alias("ms"))


@register("f4_keyword_table", """with k as (select distinct lower(substr(text, 1 + item_id % 20, 12)) keyword from benchmark where length(text) > 40),
d as (select doc_id, lower(text) text from documents)
select doc_id, count(*) n, min(keyword) first_keyword from d join k on contains(text, keyword) where keyword <> '' group by doc_id""")
def keyword_table(spark, sf_dir):
    """Pieces of the benchmark's passages as keywords, all at once, over whole texts."""
    words = D.table(spark, sf_dir, "benchmark").where("length(text) > 40").selectExpr("lower(substr(text, cast(1 + item_id % 20 as int), 12)) as keyword")
    hits = KW.keyword_hits(D.table(spark, sf_dir, "documents").select("doc_id", "text"), words)
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("keyword").alias("first_keyword"))


# --- versions -----------------------------------------------------------------

_VERSIONS = """with d as (select doc_id, unnest(s) raw, generate_subscripts(s, 1) line from (select doc_id, regexp_split_to_array(replace(text, '. ', concat('.', chr(10))), '\r\n|\n|\r') s from documents)),
va as (select doc_id, line, raw text from d where trim(raw, ' ' || chr(9)) <> ''),
vb as (select doc_id, case when (doc_id + line) % 13 = 5 then concat(text, ' !') else text end text from va where (doc_id + line) % 11 <> 3),
cnt as (select doc_id, text, sum(x) x, sum(y) y from (select doc_id, text, 1 x, 0 y from va union all select doc_id, text, 0, 1 from vb) group by all)"""


@register("u4_version_diff", _VERSIONS + " select cast(doc_id as varchar) session_id, sum(least(x, y))::bigint equal, sum(greatest(y - x, 0))::bigint \"insert\", sum(greatest(x - y, 0))::bigint \"delete\" from cnt group by doc_id")
def version_diff(spark, sf_dir):
    a, b = D.versions(spark, sf_dir)
    return DF.summary(DF.multiset_diff(a, b), "n")


def _script() -> str:
    """The ordered diff in SQL, its levels written out; the moved line is no anchor beside others, as all others are in order."""
    parts = [_VERSIONS.replace("vb as (select doc_id,", "vb as (select doc_id, case when line = 1 and doc_id % 3 = 0 then 1000000 else line end line,"),
             "a0 as (select doc_id, 0::bigint s, line, text from va)", "b0 as (select doc_id, 0::bigint s, line, text from vb)"]
    for k in range(8):
        parts += [
            f"""c{k} as (select doc_id, s, text, al, bl from (select doc_id, s, text, any_value(line) al from a{k} group by all having count(*) = 1)
  join (select doc_id, s, text, any_value(line) bl from b{k} group by all having count(*) = 1) using (doc_id, s, text)
  qualify bl <> 1000000 or count(*) over (partition by doc_id, s) = 1)""",
            f"""a{k + 1} as (select doc_id, coalesce(max(hit) over (partition by doc_id, s order by line), s) s, line, text from a{k}
  left join (select doc_id, s, al hit, al line from c{k}) using (doc_id, s, line) qualify hit is null)""",
            f"""b{k + 1} as (select doc_id, coalesce(max(hit) over (partition by doc_id, s order by line), s) s, line, text from b{k}
  left join (select doc_id, s, al hit, bl line from c{k}) using (doc_id, s, line) qualify hit is null)""",
        ]
    equal = " union all ".join(f"select doc_id, 'equal' kind, al, bl from c{k}" for k in range(8))
    parts += [
        "x as (select doc_id, s, line, text, row_number() over w i, count(*) over (partition by doc_id, s) n from a8 window w as (partition by doc_id, s order by line))",
        "y as (select doc_id, s, line, text, row_number() over w i, count(*) over (partition by doc_id, s) n from b8 window w as (partition by doc_id, s order by line))",
        "f as (select x.doc_id, x.s, min(x.i) - 1 fore from x join y on x.doc_id = y.doc_id and x.s = y.s and x.i = y.i where x.text <> y.text group by all)",
        "g as (select x.doc_id, x.s, min(x.n - x.i) rear from x join y on x.doc_id = y.doc_id and x.s = y.s and x.n - x.i = y.n - y.i where x.text <> y.text group by all)",
        """h as (select doc_id, s, na, nb, coalesce(fore, least(na, nb)) p, least(coalesce(rear, least(na, nb)), least(na, nb) - coalesce(fore, least(na, nb))) q
  from (select doc_id, s, any_value(n) na from x group by all) full join (select doc_id, s, any_value(n) nb from y group by all) using (doc_id, s) left join f using (doc_id, s) left join g using (doc_id, s))""",
        "hh as (select doc_id, s, coalesce(na, 0) na, coalesce(nb, 0) nb, case when na is null or nb is null then 0 else p end p, case when na is null or nb is null then 0 else q end q from h)",
        """o as (select x.doc_id, case when x.i <= p or x.i > na - q then 'equal' else 'delete' end kind, x.line al, y.line bl from x join hh using (doc_id, s)
  left join y on y.doc_id = x.doc_id and y.s = x.s and y.i = case when x.i <= p then x.i when x.i > na - q then x.i - na + nb end
  union all select doc_id, 'insert', null, line from y join hh using (doc_id, s) where i > p and i <= nb - q)""",
    ]
    return ",\n".join(parts) + f",\nops as (select * from o union all {equal})"


@register("u2_ordered_diff", _script() + " select cast(doc_id as varchar) session_id, kind, coalesce(al, -1)::bigint a_line, coalesce(bl, -1)::bigint b_line from ops")
def ordered_diff(spark, sf_dir):
    """Every operation of the script, by the lines it pairs."""
    a, b = D.versions(spark, sf_dir)
    minus = F.lit(-1).cast("bigint")
    return DF.ordered_diff(cut(a), cut(b)).select("session_id", "kind", F.coalesce("a_line", minus).alias("a_line"), F.coalesce("b_line", minus).alias("b_line"))


@register("u3_diff_summary", _script() + """ select cast(doc_id as varchar) session_id, count(*) filter (kind = 'equal') equal, count(*) filter (kind = 'insert') "insert",
 count(*) filter (kind = 'delete') "delete" from ops group by doc_id""")
def diff_summary(spark, sf_dir):
    a, b = D.versions(spark, sf_dir)
    return DF.summary(DF.ordered_diff(cut(a), cut(b)))


# --- monitoring ---------------------------------------------------------------

@register("w5_last_signals", sql("lg0", """select session_id, coalesce(max(line) filter (event = 'auto_compact'), -1) result_line, coalesce(max(line) filter (result = 'success'), -1) success_line,
 coalesce(max(line) filter (event = 'auto_compact_start'), -1) start_line, coalesce(max(line) filter (event = 'session_start'), -1) session_start_line from ev group by session_id"""))
def last_signals(spark, sf_dir):
    minus = F.lit(-1).cast("bigint")
    names = ("result_line", "success_line", "start_line", "session_start_line")
    return S.last_signals(D.event_log(spark, sf_dir)).select("session_id", *[F.coalesce(n, minus).alias(n) for n in names])


@register("w4_last_reading", sql("b", """select session_id, max(line) line, arg_max(case when e % 3 <> 0 then floor(value * 1000) else floor(value * 2000) end, line)::bigint tokens from b where typ = 'event_msg' group by session_id"""))
def last_reading(spark, sf_dir):
    return S.last_token_reading(D.flat(spark, sf_dir), need_tokens=True).select("session_id", "line", "tokens")


@register("w10_log_tail", sql("lg0", "select session_id, line from ev where event = 'auto_compact' qualify row_number() over (partition by session_id order by line desc) <= 20"))
def log_tail(spark, sf_dir):
    return S.log_tail(D.event_log(spark, sf_dir)).select("session_id", "line")


_SIGNALS = """, sg as (select session_id, arg_max(ts, line) filter (event = 'auto_compact') rts, arg_max(threshold, line) filter (event = 'auto_compact') rth, arg_max(ts, line) filter (result = 'success') sts,
 arg_max(threshold, line) filter (event = 'auto_compact_start') sth, arg_max(ts, line) filter (event = 'session_start') sst from ev group by session_id),
tk as (select session_id, any_value(u) u, arg_max(tokens, line) filter (tokens is not null) tokens from ev group by session_id),
j as (select tk.*, sg.* exclude (session_id), coalesce(sth, rth) lim, u % 5 < 4 and u % 5 = 0 running, u % 5 = 1 ready, u % 6 = 3 locked from tk join sg using (session_id)),
f as (select *, coalesce(tokens >= lim, false) over_it, ready or coalesce(sts is not null and (sst is null or sts > sst), false) due from j)"""


def _current_tokens(spark, sf_dir):
    return D.event_log(spark, sf_dir).groupBy("session_id").agg(
        F.max_by("tokens", F.when(F.col("tokens").isNotNull(), F.col("line"))).cast("bigint").alias("approx_tokens"))


@register("m1_status", sql("lg0", _SIGNALS + """ select session_id, case when (locked and over_it) or running then 'Compacting' when due then 'Reload' else 'Waiting' end mode,
 coalesce(case when tokens is not null and lim > 0 then concat('[', repeat('█', floor(least(1.0, tokens / lim::double) * 8)::int), repeat('▒', 8 - floor(least(1.0, tokens / lim::double) * 8)::int), ']') end, '-') bar from f"""))
def status(spark, sf_dir):
    rows = M.status_linked(_current_tokens(spark, sf_dir), S.last_signals(D.event_log(spark, sf_dir)), D.pending(spark, sf_dir), D.locks(spark, sf_dir))
    return rows.select("session_id", "mode", F.coalesce("bar", F.lit("-")).alias("bar"))


_READINGS = """, rd as (select session_id, arg_max(floor(case when e % 3 <> 0 then value * 1000 else value * 2000 end), line)::bigint tokens, arg_max(date_trunc('milliseconds', ts), line) rts from b where typ = 'event_msg' group by session_id),
cp as (select session_id, max(date_trunc('milliseconds', ts)) cts from b where typ = 'compacted' group by session_id),
est as (select session_id, sum(case when itype = 'message' then (strlen(concat('[', mrole, ']: ', trim(note))) + 1 + 3) // 4
  when itype like '%output' then (strlen(concat('[assistant]: [result: ', itype, case when cid is null then '' else concat(' ', cid) end, ']', chr(10), '{"type":"', itype, '"', case when cid is null then '' else concat(',"call_id":"', cid, '"') end, ',"output":"out ', e, '"}')) + 1 + 3) // 4
  else (strlen(concat('[assistant]: [tool: tool', e % 5, ']', chr(10), '{"type":"', itype, '"', case when cid is null then '' else concat(',"call_id":"', cid, '"') end, ',"name":"tool', e % 5, '","arguments":"{\\"e\\":', e, '}"}')) + 1 + 3) // 4 end)::bigint est from b where itype is not null group by session_id),"""


@register("m2_status_flat", sql("b", _READINGS + """
k as (select s.session_id, s.u, coalesce(cts > rts, false) stale, case when coalesce(cts > rts, false) then coalesce(est, 0) else tokens end shown, case when tokens is not null then 140000 end lim
 from (select session_id, any_value(u) u from b group by session_id) s left join rd using (session_id) left join cp using (session_id) left join est using (session_id))
select session_id, case when (u % 6 = 3 and coalesce(shown >= lim, false)) or u % 5 = 0 then 'Compacting' when u % 5 = 1 then 'Reload' when lim is null then 'Active' when shown >= lim then 'Over' else 'Waiting' end mode,
 coalesce(shown, -1) tokens, stale estimated from k"""))
def status_flat(spark, sf_dir):
    rows = M.status_flat(D.flat(spark, sf_dir), D.pending(spark, sf_dir), D.locks(spark, sf_dir))
    return rows.select("session_id", "mode", F.coalesce("tokens", F.lit(-1).cast("bigint")).alias("tokens"), "estimated")


@register("m3_trigger", sql("lg0", _SIGNALS + """, g as (select *, coalesce(epoch_ms(timestamp '2024-01-30 00:00:00') - epoch_ms(rts) < 30000, false) recent, running or ready waiting from f)
select session_id, over_it "over", over_it and not due and not locked and not waiting and not recent "trigger",
 case when not over_it then 'not_triggered' when waiting then 'pending_ready' when not due and not locked and not recent then 'started' else 'suppressed' end result from g"""))
def trigger(spark, sf_dir):
    return M.trigger(
        _current_tokens(spark, sf_dir), S.last_signals(D.event_log(spark, sf_dir)), D.pending(spark, sf_dir), D.locks(spark, sf_dir),
        F.expr("timestamp'2024-01-30 00:00:00'"))


@register("m3_trigger_flat", sql("b", _READINGS + """
k as (select s.session_id, s.u, coalesce(tokens, est, 0) used, case when tokens is not null then 40000 else 90000 end lim
 from (select session_id, any_value(u) u from b group by session_id) s left join rd using (session_id) left join est using (session_id))
select session_id, used::bigint tokens, lim::bigint threshold, case when used < lim then 'not_triggered' when u % 5 in (0, 1) then 'pending_ready' else 'started' end result from k"""))
def trigger_flat(spark, sf_dir):
    return M.flat_trigger(D.flat(spark, sf_dir), D.pending(spark, sf_dir), threshold_percent=20)


@register("m3_result_classes", sql("lg0", "select session_id, result, count(*) n from ev where event = 'auto_compact' group by all"))
def result_classes(spark, sf_dir):
    return M.result_class(D.event_log(spark, sf_dir))


@register("m4_current_by_cwd", """select concat('/work/p', user_id % 10) cwd, concat('th', arg_max(user_id, (ts, event_id))) thread_id, arg_max(event_id, (ts, event_id))::varchar turn_id
from events where event_type <> 'signup' and event_id % 19 <> 3 group by user_id % 10""")
def current_by_cwd(spark, sf_dir):
    turns = DOC.read_turn_events(L.parse_lines(_turn_lines(spark, sf_dir))).withColumn("seq", F.col("line"))
    return M.current_by_cwd(turns).select("cwd", "thread_id", "turn_id")


@register("m5_quiet_sessions", """with g as (select *, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 6 hour then 1 else 0 end brk from events window w as (partition by user_id order by ts)),
s as (select *, sum(brk) over (partition by user_id order by ts, event_id) k from g)
select user_id::varchar session_id, epoch_us(min(ts)) start_us, epoch_us(max(ts)) + 21600000000 quiet_us, count(*) n from s group by user_id, k""")
def quiet_sessions(spark, sf_dir):
    events = D.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))
    return M.quiet_sessions(events).select("session_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("quiet_at").alias("quiet_us"), "n")


_GAPS = """, d as (select {k}, epoch_ms(ts) - lag(epoch_ms(ts)) over (partition by {k} order by ts) gap, epoch_ms(ts) ms from hb),
q as (select {k}, list_sort(list(gap) filter (gap is not null)) g, count(*) beats, (max(ms) - min(ms)) / 1000.0 span from d group by all)
select {k}, beats, span::double span_seconds, coalesce(len(g), 0)::bigint gaps, coalesce(g[1] / 1000.0, -1)::double gap_min,
 coalesce((g[(len(g) - 1) // 2 + 1] + g[len(g) // 2 + 1]) / 2000.0, -1)::double gap_median, coalesce(g[floor(0.95 * (len(g) - 1))::int + 1] / 1000.0, -1)::double gap_p95, coalesce(g[-1] / 1000.0, -1)::double gap_max from q"""


@register("a12_heartbeat_gaps", sql("lg0", ", hb as (select session_id, ts from ev where event = 'heartbeat')" + _GAPS.format(k="session_id")))
def heartbeat_gaps(spark, sf_dir):
    beats = D.event_log(spark, sf_dir).where("event = 'heartbeat'")
    rows = S.gap_stats(beats)
    fill = lambda c: F.coalesce(c, F.lit(-1.0)).alias(c)
    return rows.select("session_id", "beats", "span_seconds", "gaps", *[fill(c) for c in ("gap_min", "gap_median", "gap_p95", "gap_max")])


@register("m6_gap_windows", sql("lg0", ", hb as (select session_id, epoch_ms(date_trunc('day', ts)) win, ts from ev where event = 'heartbeat')" + _GAPS.format(k="session_id, win")))
def gap_windows(spark, sf_dir):
    rows = M.gap_windows(D.event_log(spark, sf_dir).where("event = 'heartbeat'"))
    fill = lambda c: F.coalesce(c, F.lit(-1.0)).alias(c)
    return rows.select("session_id", F.unix_millis("window_start").alias("win"), "beats", "span_seconds", "gaps",
                       *[fill(c) for c in ("gap_min", "gap_median", "gap_p95", "gap_max")])


@register("m7_counters", sql("lg0", """select session_id, epoch_ms(date_trunc('hour', ts)) hour_ms, count(*) n, count(*) filter (result = 'success') successes, count(*) filter (result = 'failed') failures, coalesce(sum(tokens), 0)::bigint tokens
from (select distinct on (session_id, ts, event) * from ev order by line) group by all"""))
def counters(spark, sf_dir):
    rows = M.counters(D.event_log(spark, sf_dir))
    return rows.select("session_id", F.unix_millis("hour").alias("hour_ms"), "n", "successes", "failures", F.coalesce("tokens", F.lit(0).cast("bigint")).alias("tokens"))


@register("a13_last_activity", sql("al a", "select session_id, epoch_ms(make_timestamp(max(sec) * 1000000)) last_ms from a group by session_id"))
def last_activity(spark, sf_dir):
    return S.last_activity(L.entries(D.linked(spark, sf_dir))).select("session_id", F.unix_millis("last_activity_ts").alias("last_ms"))


@register("f7_has_messages", sql("al a", "select session_id, bool_or(msg) talks from a group by session_id having true"))
def has_messages(spark, sf_dir):
    rows = D.parsed_table(spark, sf_dir, "chats").where("json_kind = 'object'")
    return CT.has_messages(rows)


@register("f8_initial_context", sql("b", "select session_id, line from b where itype = 'message' and ctx"))
def initial_context(spark, sf_dir):
    rows = D.flat(spark, sf_dir).where("item_type = 'message'")
    return rows.where(T.looks_like_initial_context(T.message_text(F.col("item")))).select("session_id", "line")


@register("f9_noise", sql("b", "select session_id, line, typ why from b where typ in ('turn_context', 'event_msg')"))
def noise(spark, sf_dir):
    return D.flat(spark, sf_dir).select("session_id", "line", RF.noise_reason().alias("why")).where("why is not null")


@register("p3_tool_refs", sql("al a refs", "select session_id, line, side, id tool_id from refs"))
def tool_refs(spark, sf_dir):
    return L.tool_refs(D.linked(spark, sf_dir)).select("session_id", "line", "side", "tool_id")


@register("p4_thinking_first", sql("al a", """select session_id, line, array_to_string([x for x in [case when think then 'thinking' end, case when has_res then 'tool_result' end, case when has_late then 'tool_result' end, 'text', case when has_use then 'tool_use' end] if x is not null], ',') block_types
from a where role = 'assistant' or has_res"""))
def thinking_first(spark, sf_dir):
    rows = L.entries(D.linked(spark, sf_dir)).where(F.size("blocks") > 0)
    ordered = F.transform(L.thinking_first(F.col("blocks")), lambda b: b["type"])
    return rows.select("session_id", "line", F.array_join(ordered, ",").alias("block_types"))


@register("p9_message_tokens", sql("recursive al a chain sizes", "select session_id, line, tokens approx_tokens from sizes"))
def message_tokens(spark, sf_dir):
    return D.chain_sizes(spark, sf_dir).select("session_id", "line", "approx_tokens")


@register("m10_control_windows", """select user_id::varchar run_id, epoch_ms(time_bucket(interval 1 hour, ts)) window_ms, count(*) commands, case when arg_max(event_type, (ts, event_id)) = 'click' then 'manual' else 'auto' end reason
from events where event_type in ('click', 'view') group by all""")
def control_windows(spark, sf_dir):
    """Batch twin of the control-log stream: pending commands of a window count once."""
    from loomlog.streaming.monitor import follow_control_log

    rows = D.table(spark, sf_dir, "events").selectExpr(
        "cast(user_id as string) as run_id", "case when event_type in ('click', 'view') then 'reload' else 'stop' end as cmd",
        "cast(ts as timestamp) as ts", "case when event_type = 'click' then 'manual' else 'auto' end as reason")
    return follow_control_log(rows, width="1 hour").select("run_id", F.unix_millis("window_start").alias("window_ms"), "commands", "reason")
