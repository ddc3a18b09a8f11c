"""Compaction around a supplied summary, for many sessions at once.

Summaries come in as a table (session_id, summary); sessions without one are
left alone, as is a session whose plan removes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions import edits as E
from loomlog.functions import jsonv as J
from loomlog.functions import text as T
from loomlog.functions import tokens as K
from loomlog.functions.specs import Amount
from loomlog.operators import graph as G
from loomlog.operators.ordered import Running, running, with_session_values
from loomlog.operators.rewrite import Rewrite, add_edit, change, editable, render
from loomlog.operators.rewrite_flat import fork_id, kept_values, paired_removals
from loomlog.operators.rewrite_linked import _drop_and_relink, _mark
from loomlog.operators.stats import removal_plan
from loomlog.session import cut
from loomlog.sources.lines import entries, tool_refs

COMPACTED_NOTE = "[compacted]"  # text of a tombstoned row (fixed value)
ENV_FIELDS = ("cwd", "version", "gitBranch", "slug", "userType")  # copied from a template row (fixed values)


# --- linked format ------------------------------------------------------------

def root_users(linked: DataFrame, chain: DataFrame) -> DataFrame:
    """(session_id, line, uuid, is_meta): the row a compaction must keep.

    The first meta root user of the file, else the root user on the chain, else
    the first root user of the file.
    """
    roots = entries(linked).where("type = 'user' and parent_absent").select("session_id", "line", "uuid", "is_meta")
    placed = roots.join(chain.select("session_id", "line", "depth"), ["session_id", "line"], "left")
    rank = F.struct(
        F.when(F.col("is_meta"), 0).when(F.col("depth").isNotNull(), 1).otherwise(2).alias("rank"),
        F.when(~F.col("is_meta") & F.col("depth").isNotNull(), -F.col("depth")).otherwise(F.col("line")).alias("place"),
        "line", "uuid", "is_meta",
    )
    return placed.groupBy("session_id").agg(F.min(rank).alias("r")).select("session_id", "r.line", "r.uuid", "r.is_meta")


BEFORE_ALL = -(1 << 60)  # a place before every row of a chain


def visible_messages(linked: DataFrame, chain: DataFrame, roots: DataFrame) -> DataFrame:
    """Chain messages root first, led by a meta root that is off the chain: (…, pos)."""
    messages = entries(linked).where("is_message").select("session_id", "line", "uuid", "role", "v")
    on_chain = messages.join(chain.select("session_id", "line", "depth"), ["session_id", "line"])
    meta = roots.where("is_meta").select("session_id", "line")
    detached = messages.join(meta, ["session_id", "line"], "left_semi").join(
        chain.select("session_id", "line"), ["session_id", "line"], "left_anti")
    return on_chain.withColumn("pos", -F.col("depth")).drop("depth").unionByName(
        detached.withColumn("pos", F.lit(BEFORE_ALL).cast("bigint")))


def select_prefix(visible: DataFrame, amount: Amount, keep_last: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """First N visible messages: (session_id, line, n). ``counts`` overrides N per session."""
    if keep_last and amount.kind != "count":
        raise ValueError("keep_last needs a whole count, not a percentage")
    placed = running(
        visible.select("session_id", F.col("pos").alias("line"), F.col("line").alias("_l")),
        {"rn": Running("sum", F.lit(1).cast("bigint"))})
    total = with_session_values(placed, {"n_all": ("max", F.col("rn"))})
    if counts is not None:
        total = total.join(counts.select("session_id", F.col("remove_count").alias("n")), "session_id")
    elif keep_last:
        total = total.withColumn("n", F.greatest(F.col("n_all") - F.lit(int(amount.value)), F.lit(0)))
    else:
        total = total.withColumn("n", amount.take(F.col("n_all")))
    return total.where(F.col("rn") <= F.col("n")).select("session_id", F.col("_l").alias("line"), "n")


def plan_linked(
    visible: DataFrame, amount_tokens: Amount | None = None, amount: Amount | None = None, keep_last: bool = False,
    counter: K.TokenCounter = K.approx_counter,
) -> DataFrame:
    """The lines to compact, by tokens or by number of messages."""
    if amount_tokens is not None:
        if keep_last:
            raise ValueError("a token amount cannot be combined with keep_last")
        sized = visible.select("session_id", F.col("pos").alias("line"), counter(K.token_segments(F.col("v"), True)).alias("approx_tokens"))
        return select_prefix(visible, amount_tokens, counts=removal_plan(sized, amount_tokens))
    if amount is None:
        raise ValueError("an amount is needed")
    return select_prefix(visible, amount, keep_last)


def compaction_scope(linked: DataFrame, selected: DataFrame, keep_turns: bool = True) -> DataFrame:
    """Selected lines with turns and tool pairs: (session_id, line, reason)."""
    wanted = G.expand_turns(selected, G.assistant_turns(linked)) if keep_turns else selected
    closed = G.pair_closure(tool_refs(linked), wanted)
    return closed.withColumn("reason", F.when(F.col("reason") == "selected", "compacted").otherwise(F.col("reason")))


def _templates(linked: DataFrame) -> DataFrame:
    """First entry with a session id, else the first entry."""
    rows = entries(linked).select("session_id", F.struct(
        F.col("log_session_id").isNull().alias("no_id"), "line",
        *[J.as_string(F.col("v"), f"$.{name}").alias(name) for name in ENV_FIELDS]).alias("t"))
    return rows.groupBy("session_id").agg(F.min("t").alias("t"))


def _quoted(text: Column) -> Column:
    q = F.to_json(F.to_variant_object(F.array(text)))
    return F.substring(q, F.lit(2), F.length(q) - 2)


def _field(name: str, value: Column) -> Column:
    return F.when(F.length(value) > 0, F.concat(F.lit(f',"{name}":'), _quoted(value))).otherwise("")


def compact_linked(
    linked: DataFrame, summaries: DataFrame, selected: DataFrame, now: str, salt: str = "summary",
    keep_turns: bool = True, tombstone: bool = False, chain: DataFrame | None = None,
) -> Rewrite:
    """X11: fold the selected messages of each session into its summary.

    ``selected`` comes from :func:`plan_linked`; ``now`` is the ISO time stamp
    of the inserted rows; their uuids follow from session id and salt.
    """
    active = selected.select("session_id").distinct().join(summaries.select("session_id", "summary"), "session_id")
    active = cut(active)
    hit = cut(linked.join(active.select("session_id"), "session_id", "left_semi"))
    rest = entries(linked).join(active.select("session_id"), "session_id", "left_anti")
    selected = selected.join(active.select("session_id"), "session_id", "left_semi")
    chain = cut(G.active_chain(hit) if chain is None else chain.join(active.select("session_id"), "session_id", "left_semi"))
    roots = cut(root_users(hit, chain))
    visible = cut(visible_messages(hit, chain, roots).drop("v"))
    scope = cut(compaction_scope(hit, selected, keep_turns))

    boundary = entries(hit).where("is_boundary").join(chain, ["session_id", "line", "uuid"]).groupBy("session_id").agg(
        F.min(F.struct("depth", "line", "uuid")).alias("b"))
    snapshot = entries(hit).where("type = 'file-history-snapshot'").groupBy("session_id").agg(F.min("line").alias("snap_line"))
    plan = (
        active.join(boundary, "session_id", "left").join(snapshot, "session_id", "left")
        .join(roots.select("session_id", F.struct("line", "uuid", "is_meta").alias("root")), "session_id", "left")
    )
    at_boundary = F.col("b").isNotNull()
    rooted = ~at_boundary & F.col("root.uuid").isNotNull()
    rewrite_root = rooted & ~F.col("root.is_meta")
    plan = cut(plan.select(
        "session_id", "summary",
        F.when(at_boundary, F.col("b.line")).when(rewrite_root, F.lit(None)).when(rooted, F.col("root.line"))
        .otherwise(F.coalesce("snap_line", F.lit(0))).cast("bigint").alias("anchor"),
        F.when(at_boundary, F.col("b.uuid")).when(rooted & F.col("root.is_meta"), F.col("root.uuid")).alias("summary_parent"),
        F.when(rewrite_root, F.col("root.uuid")).otherwise(fork_id(F.col("session_id"), salt)).alias("summary_uuid"),
        F.when(rewrite_root, F.col("root.line")).alias("rewrite_line"),
        F.when(rooted, F.col("root.line")).alias("protected"), F.col("root.line").alias("root_line"),
    ))
    guard = plan.where("protected is not null").select("session_id", F.col("protected").alias("line"))
    removed = cut(scope.join(guard, ["session_id", "line"], "left_anti"))

    # A session with nothing to remove and no root to rewrite stays as it is.
    working = cut(plan.join(removed.select("session_id").distinct().withColumn("_any", F.lit(True)), "session_id", "left")
                  .where("_any or rewrite_line is not null"))
    idle = hit.join(working.select("session_id"), "session_id", "left_anti")
    rows = editable(entries(hit.join(working.select("session_id"), "session_id", "left_semi")))
    changes = [change(hit.where("kind = 'invalid_json'").join(working.select("session_id"), "session_id", "left_semi"),
                      "delete_line", "invalid_json")]

    if tombstone:
        rows = _mark(rows, removed.withColumn("_gone", F.lit(True)), "_gone")
        rows = add_edit(rows, F.col("_gone"), E.edit("tombstone", value=F.lit(COMPACTED_NOTE))).drop("_gone")
        changes.append(change(removed, "update_line", F.col("reason")))
    else:
        rewritten = working.where("rewrite_line is not null").select("session_id", F.col("rewrite_line").alias("line"), F.lit(True).alias("_rw"))
        # The rewritten root has no parent, so it is not relinked.
        rows = _mark(rows, rewritten, "_rw").withColumn("parent_uuid", F.when(F.col("_rw"), None).otherwise(F.col("parent_uuid"))).drop("_rw")
        rows, relinked = _drop_and_relink(rows, removed)
        changes += [relinked, change(removed, "delete_line", F.col("reason"))]

    rooted_rows = working.where("rewrite_line is not null").select(
        "session_id", F.col("rewrite_line").alias("line"), F.col("summary").alias("_summary"))
    rows = _mark(rows, rooted_rows, "_summary")
    message = F.concat(F.lit('{"role":"user","content":'), _quoted(F.col("_summary")), F.lit("}"))
    rows = add_edit(rows, F.col("_summary").isNotNull(), E.edit("set", "type", F.lit('"user"')))
    rows = add_edit(rows, F.col("_summary").isNotNull(), E.edit("set", "parentUuid", F.lit("null")))
    rows = add_edit(rows, F.col("_summary").isNotNull(), E.edit("set", "message", message)).drop("_summary")
    changes.append(change(rooted_rows, "update_line", "root_replaced"))

    kept = visible.join(removed.select("session_id", "line"), ["session_id", "line"], "left_anti").join(
        working.select("session_id", "root_line", "summary_uuid"), "session_id").where(
        F.col("root_line").isNull() | (F.col("line") != F.col("root_line")))
    first = kept.groupBy("session_id").agg(F.min(F.struct("pos", "line", "summary_uuid")).alias("f")).select(
        "session_id", "f.line", F.col("f.summary_uuid").alias("_to"))
    first = cut(first)
    rows = _mark(rows, first, "_to")
    rows = add_edit(rows, F.col("_to").isNotNull(), E.set_string("parentUuid", F.col("_to"))).drop("_to")
    changes.append(change(first, "update_line", "linked_to_summary"))

    # A deleted anchor sends the summary to the end of the file.
    anchors = working.where("anchor is not null").join(
        removed.select("session_id", F.col("line").alias("anchor"), F.lit(not tombstone).alias("_lost")), ["session_id", "anchor"], "left")
    ends = entries(hit).groupBy("session_id").agg(F.max("line").alias("_end"))
    t = F.col("t")
    raw = F.concat(
        F.lit('{"type":"user","uuid":'), _quoted(F.col("summary_uuid")), F.lit(',"parentUuid":'),
        F.coalesce(_quoted(F.col("summary_parent")), F.lit("null")), F.lit(f',"timestamp":"{now}","message":{{"role":"user","content":'),
        _quoted(F.col("summary")), F.lit('},"sessionId":'), _quoted(F.col("session_id")),
        *[_field(name, t[name]) for name in ENV_FIELDS], F.lit(',"isSidechain":false}'))
    inserted = anchors.join(ends, "session_id").join(_templates(hit), "session_id").select(
        "session_id", F.when(F.col("_lost"), F.col("_end")).otherwise(F.col("anchor")).alias("line"),
        F.lit(1).alias("sub"), raw.alias("raw"))
    changes.append(change(anchors, "insert_after", "summary_inserted", F.col("anchor")))

    out = changes[0]
    for part in changes[1:]:
        out = out.unionByName(part)
    plain = lambda df: df.select("session_id", "line", F.lit(0).alias("sub"), "raw")
    return Rewrite(render(rows).unionByName(inserted).unionByName(plain(entries(idle))).unionByName(plain(rest)), out)


def pending_selection(linked: DataFrame, selected: DataFrame, chain: DataFrame) -> DataFrame:
    """X17, linked: (session_id, remove_count, first_removed, last_removed, anchor)."""
    roots = root_users(linked, chain)
    visible = visible_messages(linked, chain, roots).drop("v")
    scope = compaction_scope(linked, selected)
    guard = roots.select("session_id", "line").withColumn("_root", F.lit(True))
    gone = scope.select("session_id", "line").withColumn("_gone", F.lit(True))
    marked = visible.join(gone, ["session_id", "line"], "left").join(guard, ["session_id", "line"], "left")
    out = F.coalesce(F.col("_gone"), F.lit(False)) & F.col("_root").isNull() & F.col("uuid").isNotNull()
    stay = F.col("_gone").isNull() & F.col("_root").isNull() & F.col("uuid").isNotNull()
    picked = marked.groupBy("session_id").agg(
        F.min_by("uuid", F.when(out, F.col("pos"))).alias("first_removed"),
        F.max_by("uuid", F.when(out, F.col("pos"))).alias("last_removed"),
        F.min_by("uuid", F.when(stay, F.col("pos"))).alias("anchor"))
    counts = selected.groupBy("session_id").agg(F.max("n").alias("remove_count"))
    return counts.join(picked, "session_id").select("session_id", "remove_count", "first_removed", "last_removed", "anchor")


# --- flat format --------------------------------------------------------------

def _array_text(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def pinned_context(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Context that survives compaction: (session_id, payloads) and the (session_id, line) it moves from.

    The last compacted marker with a usable history wins; otherwise it is the
    leading developer, system and initial-context user messages.
    """
    item = F.col("item")
    wrapped = flat.where("kind = 'wrapped' and item_is_object")
    objects = F.filter(J.as_array(item, "$.replacement_history"), lambda x: J.is_object(x))
    final = F.try_element_at(objects, F.lit(-1))
    trimmed = F.when(
        (J.as_string(final, "$.type") == "message") & (J.as_string(final, "$.role") == "user"),
        F.slice(objects, F.lit(1), F.size(objects) - 1)).otherwise(objects)
    marks = wrapped.where("type = 'compacted'").select("session_id", "line", F.transform(trimmed, lambda x: F.to_json(x)).alias("payloads"))
    from_marker = marks.where(F.size("payloads") > 0).groupBy("session_id").agg(F.max_by("payloads", "line").alias("payloads"))

    messages = wrapped.where("type = 'response_item' and item_type = 'message' and role is not null").select(
        "session_id", "line", "role", "item")
    stop = messages.where("role = 'assistant'").groupBy("session_id").agg(F.min("line").alias("_stop"))
    text = J.non_empty(T.message_text(item))
    context = F.col("role").isin("developer", "system") | ((F.col("role") == "user") & T.looks_like_initial_context(text))
    leading = (
        messages.where(context).join(stop, "session_id", "left")
        .where(F.col("_stop").isNull() | (F.col("line") < F.col("_stop")))
        .join(from_marker.select("session_id"), "session_id", "left_anti"))
    lines = cut(leading.select("session_id", "line", F.to_json(item).alias("payload")))
    from_rows = lines.groupBy("session_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line", "payload"))), lambda x: x["payload"]).alias("payloads"))
    return from_marker.unionByName(from_rows), lines.select("session_id", "line")


def flat_candidates(flat: DataFrame, pinned_lines: DataFrame) -> DataFrame:
    """Response items that may be compacted."""
    items = flat.where("kind = 'wrapped' and type = 'response_item' and item_is_object")
    return items.join(pinned_lines, ["session_id", "line"], "left_anti")


def plan_flat(candidates: DataFrame, amount: Amount, keep_last: bool = False) -> DataFrame:
    """X13, flat format (token amounts are not offered there): (session_id, line, n)."""
    if amount.kind == "tokens":
        raise ValueError("token amounts are only offered for the linked format")
    return select_prefix(candidates.withColumn("pos", F.col("line")), amount, keep_last)


def compact_flat(flat: DataFrame, summaries: DataFrame, amount: Amount, now: str, keep_last: bool = False) -> Rewrite:
    """Move old response items of wrapped sessions into a compacted marker."""
    wrapped = flat.where("format = 'wrapped'").join(summaries.select("session_id"), "session_id", "left_semi")
    payloads, pinned_lines = pinned_context(wrapped)
    chosen = cut(plan_flat(flat_candidates(wrapped, pinned_lines), amount, keep_last))
    working = cut(chosen.select("session_id").distinct())
    hit = cut(wrapped.join(working, "session_id", "left_semi"))
    rest = flat.join(working, "session_id", "left_anti")

    base = chosen.select("session_id", "line", F.lit("compacted").alias("reason")).unionByName(
        pinned_lines.join(working, "session_id", "left_semi").withColumn("reason", F.lit("pinned")))
    base = cut(base)
    pairs = paired_removals(hit, base).join(base.select("session_id", "line"), ["session_id", "line"], "left_anti")
    gone = cut(base.unionByName(pairs))
    kept_items = hit.where("type = 'response_item' and item_is_object").select("session_id", "line").join(
        gone.select("session_id", "line"), ["session_id", "line"], "left_anti")
    first_kept = working.join(kept_items.groupBy("session_id").agg(F.min("line").alias("first_kept")), "session_id", "left")
    first_kept = cut(first_kept)
    old = hit.where("type = 'compacted'").select("session_id", "line").join(first_kept, "session_id").where(
        F.col("first_kept").isNull() | (F.col("line") < F.col("first_kept")))
    gone = cut(gone.unionByName(old.select("session_id", "line", F.lit("superseded").alias("reason"))))

    rows = kept_values(hit).join(gone.select("session_id", "line"), ["session_id", "line"], "left_anti")
    ends = hit.groupBy("session_id").agg(F.max("line").alias("_end"))
    note = F.concat(F.lit('{"type":"message","role":"user","content":[{"type":"input_text","text":'), _quoted(F.col("summary")), F.lit("}]}"))
    history = _array_text(F.concat(F.coalesce("payloads", F.array().cast("array<string>")), F.array(note)))
    marker = first_kept.join(ends, "session_id").join(summaries, "session_id").join(payloads, "session_id", "left").select(
        "session_id", F.coalesce("first_kept", F.col("_end") + 1).alias("line"), F.lit(-1).alias("sub"),
        F.concat(F.lit(f'{{"timestamp":"{now}","type":"compacted","payload":{{"message":'), _quoted(F.col("summary")),
                 F.lit(',"replacement_history":'), history, F.lit("}}")).alias("raw"))
    before = rows.select("session_id", "line").join(first_kept, "session_id").where(
        F.col("first_kept").isNull() | (F.col("line") < F.col("first_kept"))).groupBy("session_id").agg(F.max("line").alias("line"))
    inserted = working.join(before, "session_id", "left").select("session_id", F.coalesce("line", F.lit(0)).alias("line"))
    plain = lambda df: df.select("session_id", "line", F.lit(0).alias("sub"), "raw")
    changes = (
        change(hit.where("kind = 'invalid_json'"), "delete_line", "invalid_json")
        .unionByName(change(gone, "delete_line", F.col("reason")))
        .unionByName(change(inserted, "insert_after", "marker_inserted")))
    return Rewrite(plain(rows).unionByName(marker).unionByName(plain(kept_values(rest))), changes)


def pending_selection_flat(flat: DataFrame, changes: DataFrame) -> DataFrame:
    """X17, flat: removal count, first and last compacted line and the first kept item."""
    gone = changes.where("kind = 'delete_line'").select("session_id", "line").distinct()
    core = changes.where("kind = 'delete_line' and reason = 'compacted'").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("remove_count"), F.min("line").alias("first_removed"), F.max("line").alias("last_removed"))
    kept = flat.where("kind = 'wrapped' and type = 'response_item' and item_is_object").select("session_id", "line").join(
        gone, ["session_id", "line"], "left_anti").groupBy("session_id").agg(F.min("line").alias("anchor"))
    return core.join(kept, "session_id", "left")


def selection_matches(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(session_id, status): ready while the stored fields equal today's, else stale."""
    fields = ("first_removed", "last_removed", "anchor")
    now = current.select("session_id", *[F.col(c).alias(f"_{c}") for c in ("remove_count", *fields)])
    same = F.col("remove_count") == F.col("_remove_count")
    for name in fields:
        same = same & (F.col(name).isNull() | F.equal_null(name, f"_{name}"))
    return stored.join(now, "session_id", "left").select(
        "session_id", F.when(F.coalesce(same, F.lit(False)), "ready").otherwise("stale").alias("status"))
