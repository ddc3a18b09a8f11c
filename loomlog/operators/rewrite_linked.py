"""Rewrites of the linked format."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions import edits as E
from loomlog.functions import text as T
from loomlog.functions.specs import Amount
from loomlog.operators import graph as G
from loomlog.operators.checks import broken_parents, orphan_tools
from loomlog.operators.ordered import Running, running
from loomlog.operators.rewrite import (
    Rewrite, add_edit, change, editable, first_n, no_changes, render, split_touched,
)
from loomlog.session import cut
from loomlog.sources.lines import (
    entries, has_thinking, linked_text, starts_with_thinking, thinking_first, tool_refs,
)

# Texts written into rewritten lines (fixed values).
STRIPPED_TEXT = "(thinking removed)"
REMOVED_NOTE = "[removed]"


@dataclass(frozen=True)
class FixOptions:
    orphan_results: bool = True
    orphan_uses: bool = True
    api_errors: bool = True
    thinking_order: bool = True
    broken_parents: bool = True
    strip_thinking: bool = False
    tombstone: bool = False


# Applied before a reload; unanswered calls may still be running.
PRE_RELOAD = FixOptions(orphan_uses=False)
# Repair after a removal, and after a compaction.
AFTER_REMOVAL = FixOptions(api_errors=False, orphan_uses=False)
AFTER_COMPACTION = FixOptions(api_errors=False, orphan_uses=False, orphan_results=False)


def _mark(rows: DataFrame, marks: DataFrame, *columns: str) -> DataFrame:
    return rows.join(marks.select("session_id", "line", *columns), ["session_id", "line"], "left")


def repaired_parents(linked: DataFrame) -> DataFrame:
    """(session_id, line, new_parent): the nearest uuid above, NULL on top of the file."""
    broken = broken_parents(linked).select("session_id", "line")
    above = running(
        entries(linked).select("session_id", "line", "uuid"), {"new_parent": Running("last", F.col("uuid"), before=True)})
    return above.join(broken, ["session_id", "line"], "left_semi").select("session_id", "line", "new_parent")


def strip_thinking(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """X2 on editable rows."""
    hit = (F.col("role") == "assistant") & has_thinking(F.col("blocks"))
    edited = add_edit(rows, hit, E.edit("strip_thinking", value=F.lit(STRIPPED_TEXT)))
    return edited, change(rows.where(hit), "update_line", "thinking_stripped")


def _invalid(rows: DataFrame) -> DataFrame:
    return change(rows.where("kind = 'invalid_json'"), "delete_line", "invalid_json")


def _fix(rows: DataFrame, options: FixOptions) -> tuple[DataFrame, list[DataFrame]]:
    """X1 on editable entry rows: surviving rows with their edits, and the changes."""
    changes: list[DataFrame] = []
    if options.broken_parents:
        repaired = cut(repaired_parents(rows).withColumn("_fix", F.lit(True)))
        rows = _mark(rows, repaired, "new_parent", "_fix")
        rows = add_edit(rows, F.col("_fix"), E.set_string("parentUuid", F.col("new_parent")))
        rows = rows.withColumn(
            "parent_uuid", F.when(F.col("_fix"), F.col("new_parent")).otherwise(F.col("parent_uuid"))
        ).drop("_fix", "new_parent")
        changes.append(change(repaired, "update_line", "parent_repaired"))

    refs = tool_refs(rows)
    dropped: list[DataFrame] = []  # (session_id, line, reason, rank): the highest rank names the reason
    if options.thinking_order:
        blocks = F.col("blocks")
        late = (F.col("role") == "assistant") & has_thinking(blocks) & ~starts_with_thinking(blocks)
        changes.append(change(rows.where(late), "update_line", "thinking_reordered"))
        rows = add_edit(rows, late, E.edit("thinking_first"))
        rows = rows.withColumn("blocks", F.when(late, thinking_first(blocks)).otherwise(blocks))
        rows = cut(rows)
        plan = cut(G.collapse_plan(rows))
        texts = plan.join(rows.select("session_id", "line", "raw"), ["session_id", "line"])
        merged = texts.groupBy("session_id", F.col("tip_line").alias("line")).agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("depth", "raw")), asc=False), lambda x: x["raw"]).alias("_texts"))
        rows = _mark(rows, merged, "_texts")
        rows = add_edit(rows, F.col("_texts").isNotNull(), E.edit("merge"))
        rows = rows.withColumn("others", F.coalesce("_texts", "others")).drop("_texts")
        changes.append(change(merged, "update_line", "chunks_merged"))
        dropped.append(plan.select("session_id", "line", F.lit("collapsed").alias("reason"), F.lit(1).alias("rank")))
        # Moved blocks belong to the row that received them.
        refs = refs.join(plan.select("session_id", "line", "tip_line"), ["session_id", "line"], "left").select(
            "session_id", F.coalesce("tip_line", "line").alias("line"), "side", "tool_id")

    if options.strip_thinking:
        rows, stripped = strip_thinking(rows)
        changes.append(stripped)
    if options.api_errors:
        errors = rows.where("is_api_error")
        dropped.append(errors.select("session_id", "line", F.lit("api_error").alias("reason"), F.lit(2).alias("rank")))

    refs = cut(refs)
    lonely = orphan_tools(refs).select("session_id", "tool_id", F.col("side").alias("lonely"))
    at = refs.join(lonely, ["session_id", "tool_id"])
    if options.orphan_results:
        dropped.append(at.where("lonely = 'result'").select(
            "session_id", "line", F.lit("orphan_result").alias("reason"), F.lit(3).alias("rank")))
    if options.orphan_uses:
        dropped.append(at.where("lonely = 'use'").select(
            "session_id", "line", F.lit("orphan_use").alias("reason"), F.lit(4).alias("rank")))

    initial = rows.where(F.lit(False)).select("session_id", "line", F.lit("").alias("reason"), F.lit(0).alias("rank"))
    for part in dropped:
        initial = initial.unionByName(part)
    named = cut(initial.groupBy("session_id", "line").agg(F.max_by("reason", "rank").alias("reason")))
    closed = G.pair_closure(refs, named).withColumnRenamed("reason", "why")
    removed = cut(
        closed.join(named, ["session_id", "line"], "left")
        .select("session_id", "line", F.coalesce("reason", "why").alias("reason")))

    if options.tombstone:
        rows = _mark(rows, removed.withColumn("_gone", F.lit(True)), "_gone")
        rows = add_edit(rows, F.col("_gone"), E.edit("tombstone", value=F.lit(REMOVED_NOTE))).drop("_gone")
        changes.append(change(removed, "update_line", F.col("reason")))
        return rows, changes

    rows, relinked = _drop_and_relink(rows, removed)
    changes += [relinked, change(removed, "delete_line", F.col("reason"))]
    return rows, changes


def _drop_and_relink(rows: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    moved = cut(G.relinked_parents(rows, removed).withColumn("_moved", F.lit(True)))
    kept = rows.join(removed.select("session_id", "line"), ["session_id", "line"], "left_anti")
    kept = _mark(kept, moved, "new_parent", "_moved")
    kept = add_edit(kept, F.col("_moved"), E.set_string("parentUuid", F.col("new_parent")))
    kept = kept.withColumn(
        "parent_uuid", F.when(F.col("_moved"), F.col("new_parent")).otherwise(F.col("parent_uuid"))
    ).drop("_moved", "new_parent")
    return kept, change(moved, "update_line", "relinked")


def _finish(rows: DataFrame, changes: list[DataFrame]) -> Rewrite:
    out = changes[0]
    for part in changes[1:]:
        out = out.unionByName(part)
    return Rewrite(render(rows), out)


def fix(linked: DataFrame, options: FixOptions = FixOptions()) -> Rewrite:
    """Repair every session."""
    rows, changes = _fix(editable(entries(linked)), options)
    return _finish(rows, [*changes, _invalid(linked)])


def remove(
    linked: DataFrame, selected: DataFrame, keep_turns: bool = True, repair: bool = True,
    reason: str = "requested", untouched: str = "entries",
) -> Rewrite:
    """Remove lines with their turns and tool pairs, relink, optionally repair.

    Sessions without a selected line pass through: their ``entries``, or with
    ``untouched='all'`` every line as it is.
    """
    selected = cut(selected.select("session_id", "line").distinct())
    hit, rest = split_touched(linked, selected)
    hit = cut(hit)
    rows = editable(entries(hit))
    wanted = G.expand_turns(selected, G.assistant_turns(hit)) if keep_turns else selected
    reasons = G.pair_closure(tool_refs(hit), wanted)
    asked = selected.withColumn("_asked", F.lit(True))
    removed = cut(reasons.join(asked, ["session_id", "line"], "left").select(
        "session_id", "line",
        F.when(F.col("_asked"), reason).when(F.col("reason") == "selected", "assistant_turn")
        .otherwise(F.col("reason")).alias("reason")))
    rows, relinked = _drop_and_relink(rows, removed)
    present = removed.join(entries(hit).select("session_id", "line"), ["session_id", "line"], "left_semi")
    changes = [relinked, _invalid(hit), change(present, "delete_line", F.col("reason"))]
    if repair:
        rows, more = _fix(cut(rows), AFTER_REMOVAL)
        changes += more
    result = _finish(rows, changes)
    other = rest if untouched == "all" else entries(rest)
    return replace(result, lines=result.lines.unionByName(
        other.select("session_id", "line", F.lit(0).alias("sub"), "raw")))


def trim(linked: DataFrame, amount: Amount, keep_last: bool = False, keep_turns: bool = True, repair: bool = True) -> Rewrite:
    """Remove the oldest messages in file order."""
    messages = entries(linked).where("is_message").select("session_id", "line")
    return remove(linked, first_n(messages, amount, keep_last), keep_turns, repair, "trimmed")


def keyword_hits(linked: DataFrame, keywords: list[str]) -> DataFrame:
    """F4 over the entry texts: (session_id, line)."""
    rows = entries(linked)
    return rows.where(T.contains_any(linked_text(rows), keywords)).select("session_id", "line")


def clean(linked: DataFrame, keywords: list[str], keep_turns: bool = True) -> tuple[Rewrite, DataFrame]:
    """Remove keyword hits; also (session_id, matched)."""
    hits = cut(keyword_hits(linked, keywords))
    matched = hits.groupBy("session_id").agg(F.count(F.lit(1)).alias("matched"))
    return remove(linked, hits, keep_turns, True, "keyword", untouched="all"), matched


def export(linked: DataFrame, full: bool = False) -> DataFrame:
    """(session_id, line, item_kind, role, text)."""
    rows = entries(linked).where("role is not null and role <> ''")
    text = linked_text(rows)
    if not full:
        from loomlog.functions.jsonv import blank

        rows = rows.where(F.col("role").isin("user", "assistant") & ~blank(text))
    return rows.select("session_id", "line", F.lit("message").alias("item_kind"), "role", text.alias("text"))


__all__ = [
    "AFTER_COMPACTION", "AFTER_REMOVAL", "PRE_RELOAD", "FixOptions", "clean", "export", "fix", "keyword_hits",
    "no_changes", "remove", "repaired_parents", "strip_thinking", "trim",
]
