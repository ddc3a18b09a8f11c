"""Rewrites of the flat format, and forking of both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions import edits as E
from loomlog.functions import jsonv as J
from loomlog.functions import paths as P
from loomlog.functions import text as T
from loomlog.functions.specs import Amount
from loomlog.operators.ordered import first_rows
from loomlog.operators.rewrite import Rewrite, add_edit, change, editable, first_n, render, split_touched
from loomlog.operators.stats import call_rows, history_items, kinds_match, latest_outputs
from loomlog.session import cut

# Text of a synthetic answer to an unanswered call (fixed value).
ABORTED = "aborted"


def kept_values(flat: DataFrame) -> DataFrame:
    """Rows a rewrite can write back: objects of a recognised layout."""
    return flat.where("kind in ('wrapped', 'unknown_json', 'legacy_meta', 'legacy_record')")


def _invalid(flat: DataFrame) -> DataFrame:
    return change(flat.where("kind = 'invalid_json'"), "delete_line", "invalid_json")


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select("session_id", "line", F.lit(0).alias("sub"), "raw")


@dataclass(frozen=True)
class FlatFixOptions:
    orphan_outputs: bool = True
    sandbox_policy: bool = True
    repeated_outputs: bool = True
    aborted_outputs: bool = False


def orphan_output_rows(flat: DataFrame) -> DataFrame:
    """X5's rule: each output row on its own against the last call with its id."""
    rows = call_rows(flat).where("format = 'wrapped' and call_id is not null")
    calls = rows.where("side = 'call'").groupBy("session_id", "call_id").agg(
        F.max_by("call_kind", "line").alias("last_kind"))
    outputs = rows.where("side = 'output'").join(calls, ["session_id", "call_id"], "left")
    return outputs.where(~kinds_match(F.col("last_kind"), F.col("call_kind"))).select("session_id", "line")


def unanswered_calls(flat: DataFrame, dropped: DataFrame) -> DataFrame:
    """Calls (last row per id) without any surviving output."""
    rows = call_rows(flat).where("format = 'wrapped' and call_id is not null").join(
        dropped.select("session_id", "line"), ["session_id", "line"], "left_anti")
    return rows.groupBy("session_id", "call_id").agg(
        F.max(F.when(F.col("side") == "call", F.struct("line", "call_kind", "ts_raw"))).alias("c"),
        F.count_if(F.col("side") == "output").alias("outputs"),
    ).where("c is not null and outputs = 0").select("session_id", "call_id", "c.*")


def _json_string(text: Column) -> Column:
    quoted = F.to_json(F.to_variant_object(F.array(text)))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def fix(flat: DataFrame, options: FlatFixOptions = FlatFixOptions()) -> Rewrite:
    """Drop orphan and repeated outputs, normalise the policy, answer open calls."""
    none = flat.where(F.lit(False)).select("session_id", "line", F.lit("").alias("reason"))
    dropped = none
    if options.orphan_outputs:
        dropped = dropped.unionByName(orphan_output_rows(flat).withColumn("reason", F.lit("orphan_output")))
    if options.repeated_outputs:
        dropped = dropped.unionByName(latest_outputs(flat).withColumn("reason", F.lit("repeated_output")))
    dropped = cut(dropped)
    rows = editable(kept_values(flat)).join(dropped, ["session_id", "line"], "left_anti")
    changes = _invalid(flat).unionByName(change(dropped, "delete_line", F.col("reason")))
    if options.sandbox_policy:
        item = F.col("item")
        old = (
            (F.col("kind") == "wrapped") & (F.col("type") == "turn_context") & J.as_id(item, "$.sandbox_policy.mode").isNotNull()
            & J.as_id(item, "$.sandbox_policy.type").isNull()
        )
        rows = add_edit(rows, old, E.edit("rename", "payload.sandbox_policy.mode", F.lit("type")))
        changes = changes.unionByName(change(flat.where(old), "update_line", "policy_normalised"))
    lines = render(rows)
    if options.aborted_outputs:
        open_calls = cut(unanswered_calls(flat, dropped))
        kind = F.when(F.col("call_kind") == "custom", "custom_tool_call_output").otherwise("function_call_output")
        raw = F.concat(
            F.lit('{"timestamp":'), _json_string(F.col("ts_raw")), F.lit(',"type":"response_item","payload":{"type":"'), kind,
            F.lit('","call_id":'), _json_string(F.col("call_id")), F.lit(f',"output":"{ABORTED}"}}}}'))
        lines = lines.unionByName(open_calls.select("session_id", "line", F.lit(1).alias("sub"), raw.alias("raw")))
        changes = changes.unionByName(change(open_calls, "insert_after", "aborted_output"))
    return Rewrite(lines, changes)


def paired_removals(flat: DataFrame, selected: DataFrame) -> DataFrame:
    """Outputs that go with the selected lines: (session_id, line, reason).

    One pass: outputs of removed calls, then every output whose id has no call,
    or whose first output does not fit the call.
    """
    rows = call_rows(flat).where("call_id is not null")
    per = rows.groupBy("session_id", "call_id").agg(
        F.max(F.when(F.col("side") == "call", F.struct("line", "call_kind"))).alias("c"),
        F.min(F.when(F.col("side") == "output", F.struct("line", "call_kind"))).alias("o"),
    ).where("o is not null").select(
        "session_id", "call_id", F.col("c.line").alias("line"),
        kinds_match(F.col("c.call_kind"), F.col("o.call_kind")).alias("fits"))
    gone = selected.select("session_id", "line").withColumn("_gone", F.lit(True))
    verdict = per.join(gone, ["session_id", "line"], "left").select(
        "session_id", "call_id",
        F.when(F.col("_gone"), "pair").when(~F.col("fits"), "orphan_output").alias("reason"),
    ).where("reason is not null")
    outputs = rows.where("side = 'output'").select("session_id", "call_id", "line")
    return outputs.join(verdict, ["session_id", "call_id"]).select("session_id", "line", "reason")


def remove(flat: DataFrame, selected: DataFrame, keep_pairs: bool = True, reason: str = "requested") -> Rewrite:
    """X6; sessions without a selected line keep their values."""
    selected = cut(selected.select("session_id", "line").distinct())
    hit, rest = split_touched(flat, selected)
    hit = cut(hit)
    gone = selected.withColumn("reason", F.lit(reason))
    if keep_pairs:
        more = paired_removals(hit, selected).join(selected, ["session_id", "line"], "left_anti")
        gone = gone.unionByName(more)
    gone = cut(gone)
    rows = kept_values(hit)
    kept = rows.join(gone, ["session_id", "line"], "left_anti")
    listed = gone.join(rows.select("session_id", "line"), ["session_id", "line"], "left_semi")
    return Rewrite(
        _plain(kept).unionByName(_plain(kept_values(rest))),
        _invalid(hit).unionByName(change(listed, "delete_line", F.col("reason"))),
    )


def trim(flat: DataFrame, amount: Amount, keep_last: bool = False) -> Rewrite:
    """X7 over the history rows."""
    return remove(flat, first_n(history_items(flat), amount, keep_last))


def keyword_hits(flat: DataFrame, keywords: list[str]) -> DataFrame:
    """F4 over messages and reasoning."""
    item = F.col("item")
    history = ((F.col("kind") == "wrapped") & (F.col("type") == "response_item") & F.col("item_is_object")) | (
        (F.col("kind") == "legacy_record") & F.col("record_type").isNull())
    text = F.when(F.col("item_type") == "message", T.message_text(item)).when(
        F.col("item_type") == "reasoning", T.reasoning_text(item))
    return flat.where(history & T.contains_any(text, keywords)).select("session_id", "line")


def clean(flat: DataFrame, keywords: list[str]) -> tuple[Rewrite, DataFrame]:
    """X8."""
    hits = cut(keyword_hits(flat, keywords))
    return remove(flat, hits), hits.groupBy("session_id").agg(F.count(F.lit(1)).alias("matched"))


def noise_reason(turn_context: bool = True, event_msg: bool = True, legacy_state: bool = True) -> Column:
    """why a row is noise, else NULL."""
    wrapped = F.col("kind") == "wrapped"
    return (
        F.when(F.lit(turn_context) & wrapped & (F.col("type") == "turn_context"), "turn_context")
        .when(F.lit(event_msg) & wrapped & (F.col("type") == "event_msg"), "event_msg")
        .when(F.lit(legacy_state) & (F.col("kind") == "legacy_record") & F.col("record_type").isNotNull(), "legacy_state")
    )


def strip_noise(flat: DataFrame, **switches: bool) -> Rewrite:
    """X9."""
    rows = kept_values(flat).withColumn("_why", noise_reason(**switches))
    return Rewrite(
        _plain(rows.where("_why is null")),
        _invalid(flat).unionByName(change(rows.where("_why is not null"), "delete_line", F.col("_why"))),
    )


def legacy_cwds(flat: DataFrame, scan: int | None = None) -> DataFrame:
    """The first <cwd> among the records of each legacy session, or among its first ``scan`` ones."""
    records = flat.where("kind = 'legacy_record'").select("session_id", "line", "item", "item_type", "role")
    first = records if scan is None else first_rows(records, scan, [F.col("line").asc()])
    texts = F.transform(
        F.filter(J.as_array(F.col("item"), "$.content"), lambda x: J.as_string(x, "$.type") == "input_text"),
        lambda x: P.legacy_cwd(J.as_string(x, "$.text")))
    cwd = F.try_element_at(F.array_compact(texts), F.lit(1))
    found = first.where("item_type = 'message' and role = 'user'").select("session_id", "line", cwd.alias("cwd"))
    return found.where("cwd is not null").groupBy("session_id").agg(F.min_by("cwd", "line").alias("cwd"))


def migrate(flat: DataFrame, originator: str = "session-migration", version: str = "0.1.0") -> Rewrite:
    """Legacy sessions to the wrapped layout; wrapped sessions pass through.

    Records are embedded as their original text, so nothing is re-serialised.
    """
    legacy = flat.where("format = 'legacy'")
    meta = legacy.where("kind = 'legacy_meta'").select(
        "session_id", F.col("line").alias("meta_line"), F.col("v").alias("m"),
        _json_string(J.as_id(F.col("v"), "$.timestamp")).alias("stamp"))
    cwds = legacy_cwds(legacy)
    head = meta.join(cwds, "session_id", "left").select(
        "session_id", F.col("meta_line").alias("line"), F.lit(0).alias("sub"),
        F.concat(
            F.lit('{"timestamp":'), F.col("stamp"), F.lit(',"type":"session_meta","payload":{"id":'),
            _json_string(J.as_id(F.col("m"), "$.id")), F.lit(',"timestamp":'), F.col("stamp"), F.lit(',"cwd":'),
            _json_string(F.coalesce("cwd", F.lit("."))),
            F.lit(f',"originator":"{originator}","cli_version":"{version}","instructions":'),
            F.coalesce(_json_string(J.as_string(F.col("m"), "$.instructions")), F.lit("null")), F.lit(',"source":"cli"'),
            F.when(J.is_object(F.col("m"), "$.git"), F.concat(F.lit(',"git":'), F.to_json(J.get(F.col("m"), "$.git")))).otherwise(""),
            F.lit("}}")).alias("raw"))
    records = legacy.where("kind = 'legacy_record'").withColumn(
        "_why", F.when(F.col("record_type").isNotNull(), "record_type").when(F.col("item_type").isNull(), "no_type"))
    good = records.where("_why is null").join(meta.select("session_id", "stamp"), "session_id").select(
        "session_id", "line", F.lit(0).alias("sub"),
        F.concat(F.lit('{"timestamp":'), F.col("stamp"), F.lit(',"type":"response_item","payload":'),
                 J.js_trim(F.col("raw")), F.lit("}")).alias("raw"))
    unknown = legacy.where("kind = 'unknown_json'").groupBy("session_id").agg(F.min("line").alias("line"))
    changes = (
        change(meta.withColumnRenamed("meta_line", "line"), "update_line", "meta_converted")
        .unionByName(change(records.where("_why is not null"), "delete_line", F.col("_why")))
        .unionByName(change(records.where("_why is null"), "update_line", "record_wrapped"))
        .unionByName(change(unknown, "update_line", "unknown_dropped"))
    )
    passed = _plain(flat.where("format = 'wrapped' and kind <> 'non_object'"))
    return Rewrite(head.unionByName(good).unionByName(passed), changes)


def fork_id(old_id: Column, salt: str) -> Column:
    """Deterministic UUID text from the old id and a salt."""
    h = F.md5(F.concat(old_id, F.lit("\x00" + salt)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12))


def fork_linked(linked: DataFrame, new_ids: DataFrame) -> DataFrame:
    """X14, linked format: (session_id, line, sub, raw); every sessionId is replaced.

    ``new_ids`` has (session_id, new_id). Invalid lines are copied as they are.
    """
    rows = editable(linked).join(new_ids, "session_id")
    hit = (F.col("kind") == "entry") & F.col("log_session_id").isNotNull()
    return render(add_edit(rows, hit, E.set_string("sessionId", F.col("new_id")))).join(new_ids, "session_id").select(
        F.col("new_id").alias("session_id"), "line", "sub", "raw")


def fork_flat(flat: DataFrame, new_ids: DataFrame) -> DataFrame:
    """X14, flat format: every session_meta payload id, or only the legacy meta line's id."""
    v = F.col("v")
    bare = J.as_id(v, "$.id").isNotNull() & J.as_id(v, "$.timestamp").isNotNull() & J.as_id(v, "$.type").isNull()
    firsts = flat.where((F.col("format") == "legacy") & bare).groupBy("session_id").agg(F.min("line").alias("_meta"))
    rows = editable(flat).join(new_ids, "session_id").join(firsts, "session_id", "left")
    meta = (F.col("format") == "wrapped") & (J.as_string(v, "$.type") == "session_meta") & J.is_object(v, "$.payload")
    rows = add_edit(rows, meta, E.set_string("payload.id", F.col("new_id")))
    rows = add_edit(rows, F.col("line") == F.col("_meta"), E.set_string("id", F.col("new_id")))
    return render(rows).join(new_ids, "session_id").select(F.col("new_id").alias("session_id"), "line", "sub", "raw")


def export(flat: DataFrame, full: bool = False) -> DataFrame:
    """(session_id, line, item_kind, role, text)."""
    item, kind = F.col("item"), F.col("item_type")
    history = ((F.col("kind") == "wrapped") & (F.col("type") == "response_item") & F.col("item_is_object")) | (
        (F.col("kind") == "legacy_record") & F.col("record_type").isNull())
    message, body = T.message_text(item), F.to_json(item)
    reasoning = T.reasoning_text(item)
    users = J.as_array(item, "$.replacement_history")
    summary = F.element_at(F.concat(F.array(F.lit("")), F.filter(F.transform(F.filter(
        users, lambda x: (J.as_string(x, "$.type") == "message") & (J.as_string(x, "$.role") == "user")), T.message_text),
        lambda t: F.length(t) > 0)), -1)
    shown = F.coalesce(J.as_id(item, "$.message"), J.non_empty(summary))
    said = F.lit(full) | (F.col("role").isin("user", "assistant") & ~J.blank(message))
    empty = F.lit(None).cast("string")
    out = F.when(
        history,
        F.when((kind == "message") & F.col("role").isNotNull() & said,
               F.struct(F.lit("message").alias("item_kind"), F.col("role").alias("role"), message.alias("text")))
        .when((kind == "reasoning") & F.lit(full) & (F.length(reasoning) > 0),
              F.struct(F.lit("reasoning").alias("item_kind"), empty.alias("role"), reasoning.alias("text")))
        .when(kind.isin(*T.CALL_TYPES, *T.OUTPUT_TYPES) & F.lit(full),
              F.struct(F.lit("tool").alias("item_kind"), empty.alias("role"), body.alias("text"))),
    ).when(
        (F.col("kind") == "wrapped") & (F.col("type") == "compacted") & F.col("item_is_object")
        & (F.lit(full) | shown.isNotNull()),
        F.struct(F.lit("compacted").alias("item_kind"), empty.alias("role"), F.coalesce(shown, body).alias("text")),
    )
    return flat.select("session_id", "line", out.alias("o")).where("o is not null").select("session_id", "line", "o.*")
