"""Integrity checks as one issue table.

Issue rows: session_id, severity, code, loc_kind (file, line, entry, pair),
line, ref_id and n_lines. ``line`` is the first line concerned and ``n_lines``
how many there are; the full list of lines stays in long form
(:func:`duplicate_uuid_lines`, :func:`orphan_tool_lines`), so no id collects an
unbounded array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions import jsonv as J
from loomlog.operators.graph import nodes, resume_violations
from loomlog.operators.stats import call_rows, kinds_match
from loomlog.sources.lines import entries, has_thinking, starts_with_thinking

# Entry types that need no remark (fixed values).
PLAIN_TYPES = ("user", "assistant", "summary", "file-history-snapshot")

# Issue codes and their severities (fixed values).
SEVERITY = {
    "claude.non_object_line": "warning",
    "claude.empty_session": "warning",
    "claude.unrecognized_shape": "warning",
    "claude.invalid_json_line": "error",
    "claude.duplicate_uuid": "warning",
    "claude.broken_parent_chain": "warning",
    "claude.orphan_tool_result": "error",
    "claude.orphan_tool_use": "warning",
    "claude.thinking_block_order": "error",
    "claude.thinking_block_order_merged": "error",
    "claude.thinking_block_order_resume_chain": "error",
    "claude.api_error_message": "warning",
    "claude.unknown_entry_type": "info",
    "codex.unrecognized_format": "error",
    "codex.non_object_line": "warning",
    "codex.invalid_json_line": "error",
    "codex.missing_session_meta": "error",
    "codex.multi_session_meta": "info",
    "codex.session_meta_payload_not_object": "error",
    "codex.session_meta_missing_id": "error",
    "codex.unknown_json_line": "warning",
    "codex.turn_context_payload_not_object": "warning",
    "codex.turn_context_sandbox_policy_not_object": "warning",
    "codex.sandbox_policy_has_mode_and_type": "warning",
    "codex.sandbox_policy_missing_mode_or_type": "warning",
    "codex.function_call_missing_call_id": "error",
    "codex.custom_tool_call_missing_call_id": "error",
    "codex.function_call_output_missing_call_id": "error",
    "codex.custom_tool_call_output_missing_call_id": "error",
    "codex.duplicate_call_id": "warning",
    "codex.duplicate_outputs_for_call_id": "warning",
    "codex.orphan_output": "error",
    "codex.output_before_call": "error",
    "codex.missing_output": "warning",
    "codex.compacted_payload_not_object": "warning",
    "codex.compacted_message_not_string": "warning",
    "codex.compacted_replacement_history_not_array": "warning",
    "codex.legacy_missing_meta": "error",
    "codex.legacy_duplicate_call_id": "warning",
    "codex.legacy_duplicate_outputs_for_call_id": "warning",
    "codex.legacy_orphan_output": "error",
    "codex.legacy_missing_output": "warning",
}


def issue_rows(
    df: DataFrame, code: str | Column, loc_kind: str, line: Column | None = None, ref_id: Column | None = None,
    n_lines: Column | None = None,
) -> DataFrame:
    """Shape rows of a check as issues; the severity is looked up at plan time where possible."""
    code_col = F.lit(code) if isinstance(code, str) else code
    if isinstance(code, str):
        severity = F.lit(SEVERITY[code])
    else:
        errors = [c for c, s in SEVERITY.items() if s == "error"]
        infos = [c for c, s in SEVERITY.items() if s == "info"]
        severity = F.when(code_col.isin(errors), "error").when(code_col.isin(infos), "info").otherwise("warning")
    return df.select(
        "session_id", severity.alias("severity"), code_col.alias("code"), F.lit(loc_kind).alias("loc_kind"),
        (F.lit(None) if line is None else line).cast("bigint").alias("line"),
        (F.lit(None) if ref_id is None else ref_id).cast("string").alias("ref_id"),
        (F.lit(1) if n_lines is None else n_lines).cast("bigint").alias("n_lines"),
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- linked format ------------------------------------------------------------

def parse_issues_linked(linked: DataFrame) -> DataFrame:
    """Non-object lines, files without entries, files without any typed entry.

    A file whose lines are all blank has no rows here; see :func:`empty_sessions`.
    """
    per = linked.groupBy("session_id").agg(
        F.count_if(F.col("kind") != "non_object").alias("kept"),
        F.bool_or((F.col("kind") == "entry") & F.col("type").isNotNull()).alias("typed"),
    )
    return union_all([
        issue_rows(linked.where("kind = 'non_object'"), "claude.non_object_line", "line", F.col("line")),
        issue_rows(per.where("kept = 0"), "claude.empty_session", "file"),
        issue_rows(per.where(~F.coalesce(F.col("typed"), F.lit(False))), "claude.unrecognized_shape", "file"),
    ])


def empty_sessions(files: DataFrame, lines: DataFrame) -> DataFrame:
    """S2 for files without a single non-blank line; ``files`` lists all session ids."""
    bare = files.select("session_id").distinct().join(lines.select("session_id").distinct(), "session_id", "left_anti")
    return issue_rows(bare, "claude.empty_session", "file").unionByName(
        issue_rows(bare, "claude.unrecognized_shape", "file"))


def duplicate_uuids(linked: DataFrame) -> DataFrame:
    """A5."""
    return (
        entries(linked).where("uuid is not null").groupBy("session_id", "uuid")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.min("line").alias("line")).where("n_lines > 1")
    )


def duplicate_uuid_lines(linked: DataFrame) -> DataFrame:
    """A5, long form: every line of every repeated uuid."""
    repeated = duplicate_uuids(linked).select("session_id", "uuid")
    return entries(linked).select("session_id", "uuid", "line").join(repeated, ["session_id", "uuid"], "left_semi")


def broken_parents(linked: DataFrame) -> DataFrame:
    """J1."""
    known = entries(linked).where("uuid is not null").select("session_id", F.col("uuid").alias("parent_uuid")).distinct()
    children = entries(linked).where("parent_uuid is not null").select("session_id", "line", "parent_uuid")
    return children.join(known, ["session_id", "parent_uuid"], "left_anti")


def orphan_tools(refs: DataFrame) -> DataFrame:
    """Ids found on one side only: (session_id, tool_id, side, line, n_lines)."""
    per = refs.groupBy("session_id", "tool_id").agg(
        F.count_if(F.col("side") == "use").alias("uses"), F.count_if(F.col("side") == "result").alias("results"),
        F.min("line").alias("line"), F.count(F.lit(1)).alias("n_lines"),
    )
    return per.where("uses = 0 or results = 0").select(
        "session_id", "tool_id", F.when(F.col("uses") == 0, "result").otherwise("use").alias("side"), "line", "n_lines")


def orphan_tool_lines(refs: DataFrame) -> DataFrame:
    """J2, long form: every block of every orphan id."""
    lonely = orphan_tools(refs).select("session_id", "tool_id")
    return refs.select("session_id", "tool_id", "side", "line").join(lonely, ["session_id", "tool_id"], "left_semi")


def thinking_order(linked: DataFrame) -> DataFrame:
    """V3: (session_id, line, first_block_type, thinking_index)."""
    blocks = F.col("blocks")
    return entries(linked).where(
        (F.col("role") == "assistant") & has_thinking(blocks) & ~starts_with_thinking(blocks)
    ).select(
        "session_id", "line", F.coalesce(F.try_element_at(blocks, F.lit(1))["type"], F.lit("unknown")).alias("first_block_type"),
        (F.array_position(F.transform(blocks, lambda b: b["is_thinking"]), True) - 1).alias("thinking_index"),
    )


def merged_thinking(linked: DataFrame) -> DataFrame:
    """Assistant rows with thinking under an assistant parent without any."""
    flags = entries(linked).withColumn("thinks", has_thinking(F.col("blocks"))).withColumn(
        "first_type", F.try_element_at("blocks", F.lit(1))["type"])
    parents = nodes(flags, "role", "thinks", "first_type").where("role = 'assistant' and not thinks").select(
        "session_id", F.col("uuid").alias("parent_uuid"), F.col("line").alias("parent_line"),
        F.coalesce("first_type", F.lit("unknown")).alias("parent_first_block_type"),
    )
    children = flags.where("role = 'assistant' and thinks and parent_uuid is not null").select(
        "session_id", "line", "parent_uuid")
    return children.join(parents, ["session_id", "parent_uuid"]).drop("parent_uuid")


def validate_linked(linked: DataFrame, refs: DataFrame) -> DataFrame:
    """V1-V6."""
    rows = entries(linked)
    kind = F.col("type")
    side_code = F.when(F.col("side") == "result", "claude.orphan_tool_result").otherwise("claude.orphan_tool_use")
    return union_all([
        issue_rows(linked.where("kind = 'invalid_json'"), "claude.invalid_json_line", "line", F.col("line")),
        issue_rows(duplicate_uuids(linked), "claude.duplicate_uuid", "entry", F.col("line"), F.col("uuid"), F.col("n_lines")),
        issue_rows(broken_parents(linked), "claude.broken_parent_chain", "line", F.col("line"), F.col("parent_uuid")),
        issue_rows(orphan_tools(refs), side_code, "line", F.col("line"), F.col("tool_id"), F.col("n_lines")),
        issue_rows(thinking_order(linked), "claude.thinking_block_order", "line", F.col("line")),
        issue_rows(merged_thinking(linked), "claude.thinking_block_order_merged", "line", F.col("line")),
        issue_rows(
            resume_violations(linked), "claude.thinking_block_order_resume_chain", "line", F.col("line"),
            F.col("leaf_uuid"), F.col("violations")),
        issue_rows(rows.where("role = 'assistant' and is_api_error"), "claude.api_error_message", "line", F.col("line")),
        issue_rows(rows.where((F.length(kind) > 0) & ~kind.isin(*PLAIN_TYPES)), "claude.unknown_entry_type", "line",
                   F.col("line"), kind),
    ])


# --- flat format --------------------------------------------------------------

def parse_issues_flat(flat: DataFrame) -> DataFrame:
    """S3: sessions in neither layout, lines that are not objects."""
    strange = flat.groupBy("session_id").agg(F.max("format").alias("format")).where("format is null")
    return issue_rows(strange, "codex.unrecognized_format", "file").unionByName(
        issue_rows(flat.where("kind = 'non_object'"), "codex.non_object_line", "line", F.col("line")))


def meta_issues(flat: DataFrame) -> DataFrame:
    """V7 for session_meta rows and V10's missing meta."""
    meta = (F.col("kind") == "wrapped") & (F.col("type") == "session_meta")
    head = F.when(meta, F.struct("line", F.col("item_is_object").alias("obj"), J.as_id(F.col("item"), "$.id").alias("id")))
    per = flat.groupBy("session_id").agg(
        F.max("format").alias("format"), F.count_if(meta).alias("metas"), F.min(head).alias("first"),
        F.count_if(F.col("kind") == "legacy_meta").alias("legacy_metas"),
    )
    wrapped = per.where("format = 'wrapped'")
    line = F.col("first.line")
    return union_all([
        issue_rows(wrapped.where("metas = 0"), "codex.missing_session_meta", "file"),
        issue_rows(wrapped.where("metas > 1"), "codex.multi_session_meta", "file", n_lines=F.col("metas")),
        issue_rows(wrapped.where("metas > 0 and not first.obj"), "codex.session_meta_payload_not_object", "line", line),
        issue_rows(wrapped.where("metas > 0 and first.obj and first.id is null"), "codex.session_meta_missing_id", "line", line),
        issue_rows(per.where("format = 'legacy' and legacy_metas = 0"), "codex.legacy_missing_meta", "file"),
    ])


def turn_context_issues(flat: DataFrame) -> DataFrame:
    """V8: first fault of each turn_context row."""
    item = F.col("item")
    mode, kind = J.as_id(item, "$.sandbox_policy.mode"), J.as_id(item, "$.sandbox_policy.type")
    code = (
        F.when(~F.col("item_is_object"), "codex.turn_context_payload_not_object")
        .when(~J.is_object(item, "$.sandbox_policy"), "codex.turn_context_sandbox_policy_not_object")
        .when(mode.isNotNull() & kind.isNotNull(), "codex.sandbox_policy_has_mode_and_type")
        .when(mode.isNull() & kind.isNull(), "codex.sandbox_policy_missing_mode_or_type")
    )
    rows = flat.where("kind = 'wrapped' and type = 'turn_context'").select("session_id", "line", code.alias("c"))
    return issue_rows(rows.where("c is not null"), F.col("c"), "line", F.col("line"))


def compacted_issues(flat: DataFrame) -> DataFrame:
    """V9, compacted rows: a row may have two faults."""
    item = F.col("item")
    history = J.get(item, "$.replacement_history")
    codes = F.when(~F.col("item_is_object"), F.array(F.lit("codex.compacted_payload_not_object"))).otherwise(
        F.array_compact(F.array(
            F.when(~J.is_string(item, "$.message"), F.lit("codex.compacted_message_not_string")),
            F.when(history.isNotNull() & ~J.is_array(history), F.lit("codex.compacted_replacement_history_not_array")),
        )))
    rows = flat.where("kind = 'wrapped' and type = 'compacted'").select("session_id", "line", F.explode(codes).alias("c"))
    return issue_rows(rows, F.col("c"), "line", F.col("line"))


def call_pairs(flat: DataFrame) -> DataFrame:
    """One row per (session, call id).

    The call is the last one with the id, the output kind the first one's; any
    order of lines counts.
    """
    rows = call_rows(flat).where("call_id is not null")
    is_call, is_out = F.col("side") == "call", F.col("side") == "output"
    return rows.groupBy("session_id", "format", "call_id").agg(
        F.count_if(is_call).alias("calls"), F.count_if(is_out).alias("outputs"),
        F.max(F.when(is_call, F.struct("line", "call_kind"))).alias("c"),
        F.min(F.when(is_out, F.struct("line", "call_kind"))).alias("o"),
    ).select(
        "session_id", "format", "call_id", "calls", "outputs",
        F.col("c.line").alias("call_line"), F.col("c.call_kind").alias("call_kind"),
        F.col("o.line").alias("first_output_line"), F.col("o.call_kind").alias("output_kind"),
        kinds_match(F.col("c.call_kind"), F.col("o.call_kind")).alias("paired"),
    )


def call_issues(flat: DataFrame) -> DataFrame:
    """J4 codes (wrapped) and J5 codes (legacy)."""
    pairs = call_pairs(flat)
    new, old = pairs.where("format = 'wrapped'"), pairs.where("format = 'legacy'")
    ref, first = F.col("call_id"), F.col("first_output_line")
    nameless = call_rows(flat).where("format = 'wrapped' and call_id is null and item_type <> 'local_shell_call'")
    # One row for each call of an id after its first one.
    key = ["session_id", "format", "call_id"]
    calls = call_rows(flat).where("call_id is not null and side = 'call'").select(*key, "line")
    first_call = calls.groupBy(*key).agg(F.min("line").alias("_first"), F.count(F.lit(1)).alias("_calls")).where("_calls > 1")
    again = calls.join(first_call, key).where("line > _first")
    return union_all([
        issue_rows(nameless, F.concat(F.lit("codex."), F.col("item_type"), F.lit("_missing_call_id")), "line", F.col("line")),
        issue_rows(again.where("format = 'wrapped'"), "codex.duplicate_call_id", "pair", F.col("line"), ref),
        issue_rows(new.where("outputs > 1"), "codex.duplicate_outputs_for_call_id", "pair", first, ref, F.col("outputs")),
        issue_rows(new.where("outputs > 0 and not paired"), "codex.orphan_output", "pair", first, ref, F.col("outputs")),
        issue_rows(new.where("paired and first_output_line < call_line"), "codex.output_before_call", "pair", first, ref),
        issue_rows(new.where("calls > 0 and not paired"), "codex.missing_output", "pair", F.col("call_line"), ref),
        issue_rows(again.where("format = 'legacy'"), "codex.legacy_duplicate_call_id", "pair", F.col("line"), ref),
        issue_rows(old.where("outputs > 1"), "codex.legacy_duplicate_outputs_for_call_id", "pair", first, ref, F.col("outputs")),
        issue_rows(old.where("outputs > 0 and calls = 0"), "codex.legacy_orphan_output", "pair", first, ref),
        issue_rows(old.where("calls > 0 and outputs = 0"), "codex.legacy_missing_output", "pair", F.col("call_line"), ref),
    ])


def validate_flat(flat: DataFrame) -> DataFrame:
    """V7-V10."""
    unknown = flat.where("kind = 'unknown_json' and format = 'wrapped'")
    return union_all([
        issue_rows(flat.where("kind = 'invalid_json'"), "codex.invalid_json_line", "line", F.col("line")),
        meta_issues(flat),
        issue_rows(unknown, "codex.unknown_json_line", "line", F.col("line")),
        turn_context_issues(flat),
        call_issues(flat),
        compacted_issues(flat),
    ])


# --- issue tables -------------------------------------------------------------

def by_severity(issues: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """A1: errors, warnings and infos per session; zero-filled for ``sessions``."""
    counted = issues.groupBy("session_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("infos"),
    )
    if sessions is None:
        return counted
    return sessions.select("session_id").distinct().join(counted, "session_id", "left").na.fill(
        0, ["errors", "warnings", "infos"])


def health(parse_issues: DataFrame, validation: DataFrame, sessions: DataFrame) -> DataFrame:
    """A1 as session health."""
    parse = by_severity(parse_issues, sessions).select("session_id", F.col("errors").alias("parse_errors"))
    checks = by_severity(validation, sessions).select(
        "session_id", F.col("errors").alias("validation_errors"), F.col("warnings").alias("validation_warnings"))
    return parse.join(checks, "session_id")


def issue_cube(issues: DataFrame) -> DataFrame:
    """Fleet report: issue counts over agent x severity with subtotals."""
    agent = F.substring_index("code", ".", 1)
    return issues.withColumn("agent", agent).cube("agent", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def error_delta(before: DataFrame, after: DataFrame, sessions: DataFrame) -> DataFrame:
    """A14."""
    old = by_severity(before, sessions).select("session_id", F.col("errors").alias("errors_before"))
    new = by_severity(after, sessions).select("session_id", F.col("errors").alias("errors_after"))
    return old.join(new, "session_id").withColumn("worse", F.col("errors_after") > F.col("errors_before"))


def next_steps(issues: DataFrame, sessions: DataFrame) -> DataFrame:
    """Suggested follow-ups. ``sessions`` has (session_id, agent, format)."""
    flags = issues.groupBy("session_id").agg(
        F.bool_or(F.col("severity") == "error").alias("broken"),
        F.bool_or(F.col("code") == "codex.unknown_json_line").alias("noisy"),
    )
    steps = F.array_compact(F.array(
        F.when(F.col("format") == "legacy", F.lit("migrate")),
        F.when(F.col("broken"), F.lit("fix")),
        F.when((F.col("agent") == "codex") & F.col("noisy"), F.lit("strip_noise")),
    ))
    return sessions.join(flags, "session_id", "left").select("session_id", F.explode(steps).alias("step"))


def format_issues(issues: DataFrame) -> DataFrame:
    """K3: one printable line per issue."""
    place = (
        F.when(F.col("loc_kind") == "line", F.concat(F.lit(":"), F.col("line").cast("string")))
        .when(F.col("loc_kind") == "pair", F.concat(F.lit(" (call_id="), F.col("ref_id"), F.lit(")")))
        .otherwise("")
    )
    return issues.select(
        "session_id", "line", F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("code"), place).alias("report_line"))
