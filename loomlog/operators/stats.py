"""Per-session statistics and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions import jsonv as J
from loomlog.functions import tokens as K
from loomlog.functions.specs import Amount
from loomlog.operators.graph import active_chain
from loomlog.operators.ordered import Running, first_rows, running, with_session_values
from loomlog.sources.lines import entries


def _count(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def _block_count(kind: str, id_field: str) -> Column:
    return F.size(F.filter("blocks", lambda b: (b["type"] == kind) & b[id_field].isNotNull()))


def segments(linked: DataFrame) -> DataFrame:
    """One row per boundary segment, segment 0 before the first boundary."""
    rows = entries(linked).select("session_id", "line", "uuid", "ts_raw", "is_boundary", "is_message")
    placed = running(rows, {"segment": Running("sum", F.col("is_boundary").cast("bigint"))})
    per = placed.groupBy("session_id", "segment").agg(
        _count(~F.col("is_boundary")).alias("entries_in_segment"),
        _count(F.col("is_message")).alias("messages_in_segment"),
        F.max(F.when(F.col("is_boundary"), F.struct("line", "uuid", "ts_raw"))).alias("b"),
    )
    found = per.groupBy("session_id").agg(F.max("segment").alias("last"), F.min("segment").alias("first"))
    known = per.join(found.where(F.col("last") > 0), "session_id")
    start = found.where((F.col("last") > 0) & (F.col("first") > 0)).select(
        "session_id", F.lit(0).cast("bigint").alias("segment"), F.lit(0).cast("bigint").alias("boundary_line"),
        F.lit("(start)").alias("boundary_uuid"), F.lit("").alias("boundary_ts"),
        F.lit(0).cast("bigint").alias("entries_in_segment"), F.lit(0).cast("bigint").alias("messages_in_segment"),
    )
    return known.select(
        "session_id", "segment",
        F.coalesce("b.line", F.lit(0).cast("bigint")).alias("boundary_line"),
        F.when(F.col("segment") == 0, "(start)").otherwise(F.coalesce("b.uuid", F.lit("unknown"))).alias("boundary_uuid"),
        F.coalesce("b.ts_raw", F.lit("")).alias("boundary_ts"),
        "entries_in_segment", "messages_in_segment",
    ).unionByName(start)


def session_stats(linked: DataFrame) -> DataFrame:
    """A2 without the per-type map (see :func:`type_counts`)."""
    rows = entries(linked).select(
        "session_id", "line", "is_boundary", "is_message",
        _block_count("tool_use", "id").alias("uses"), _block_count("tool_result", "tool_use_id").alias("results"),
    )
    placed = running(rows, {"segment": Running("sum", F.col("is_boundary").cast("bigint"))})
    per = placed.groupBy("session_id", "segment").agg(
        F.count(F.lit(1)).alias("n"), _count(F.col("is_boundary")).alias("b"), _count(F.col("is_message")).alias("m"),
        F.sum("uses").alias("u"), F.sum("results").alias("r"),
    )
    latest = F.struct("segment", (F.col("n") - F.col("b")).alias("e"), "m")
    return per.groupBy("session_id").agg(
        F.sum("n").alias("entries"), F.sum("b").alias("boundaries"), F.max(latest).alias("v"),
        F.sum("u").alias("tool_use_blocks"), F.sum("r").alias("tool_result_blocks"), F.sum("m").alias("messages"),
    ).select(
        "session_id", "entries", "messages", "boundaries", F.col("v.e").alias("visible_entries"),
        F.col("v.m").alias("visible_messages"), "tool_use_blocks", "tool_result_blocks",
    )


def visible_entries(linked: DataFrame) -> DataFrame:
    """entries after the last boundary in file order, all of them if there is none."""
    rows = with_session_values(
        entries(linked), {"_last": ("max", F.when(F.col("is_boundary"), F.col("line")).otherwise(0))}
    )
    return rows.where(F.col("line") > F.col("_last")).drop("_last")


def type_counts(linked: DataFrame) -> DataFrame:
    """A2: entries per type, ``unknown`` when the type is missing."""
    return entries(linked).groupBy("session_id", F.coalesce("type", F.lit("unknown")).alias("entry_type")).agg(
        F.count(F.lit(1)).alias("n")
    )


def message_types(linked: DataFrame) -> DataFrame:
    """Entries per type without snapshots and untyped rows."""
    kind = F.col("type")
    return (
        entries(linked).where((F.length(kind) > 0) & (kind != "file-history-snapshot"))
        .groupBy("session_id", kind.alias("message_type")).agg(F.count(F.lit(1)).alias("n"))
    )


def tool_stats(refs: DataFrame) -> DataFrame:
    """A3: blocks and distinct ids per side."""
    per_id = refs.groupBy("session_id", "tool_id").agg(
        _count(F.col("side") == "use").alias("u"), _count(F.col("side") == "result").alias("r")
    )
    return per_id.groupBy("session_id").agg(
        F.sum("u").alias("tool_use_blocks"), F.sum("r").alias("tool_result_blocks"),
        _count(F.col("u") > 0).alias("unique_tool_use_ids"), _count(F.col("r") > 0).alias("unique_tool_result_ids"),
    )


def identities(linked: DataFrame) -> DataFrame:
    """A4: distinct session and agent ids, one row each (a session may name any number)."""
    pair = F.explode(F.array(
        F.struct(F.lit("session").alias("id_kind"), F.col("log_session_id").alias("id_value")),
        F.struct(F.lit("agent").alias("id_kind"), F.col("agent_id").alias("id_value")),
    ))
    return (
        entries(linked).select("session_id", pair.alias("p")).select("session_id", "p.*")
        .where(F.col("id_value").isNotNull()).distinct()
    )


def identity_summary(linked: DataFrame) -> DataFrame:
    """A4: number of distinct ids and the sidechain flag."""
    ids = identities(linked).groupBy("session_id").agg(
        _count(F.col("id_kind") == "session").alias("session_ids"), _count(F.col("id_kind") == "agent").alias("agent_ids")
    )
    side = entries(linked).groupBy("session_id").agg(F.bool_or("is_sidechain").alias("is_sidechain"))
    zero = F.lit(0).cast("bigint")
    return side.join(ids, "session_id", "left").select(
        "session_id", F.coalesce("session_ids", zero).alias("session_ids"),
        F.coalesce("agent_ids", zero).alias("agent_ids"), "is_sidechain",
    )


# --- flat format --------------------------------------------------------------

def call_rows(flat: DataFrame) -> DataFrame:
    """Calls and outputs with an id: (session_id, line, call_id, side, kind)."""
    wrapped = (F.col("kind") == "wrapped") & (F.col("type") == "response_item") & F.col("item_is_object")
    legacy = (F.col("kind") == "legacy_record") & F.col("record_type").isNull()
    known_legacy = F.col("item_type").isin("function_call", "function_call_output")
    side = F.when(F.col("item_type").isin("function_call", "custom_tool_call", "local_shell_call"), "call").when(
        F.col("item_type").isin("function_call_output", "custom_tool_call_output"), "output"
    )
    call_kind = (
        F.when(F.col("item_type").isin("custom_tool_call", "custom_tool_call_output"), "custom")
        .when(F.col("item_type") == "local_shell_call", "local_shell").otherwise("function")
    )
    return flat.where((wrapped | (legacy & known_legacy)) & side.isNotNull()).select(
        "session_id", "line", "format", "ts_raw", "call_id", "item_type", side.alias("side"), call_kind.alias("call_kind")
    )


def kinds_match(call_kind: Column, output_kind: Column) -> Column:
    """Custom outputs answer custom calls, function outputs the other two kinds."""
    return F.coalesce((call_kind == "custom") == (output_kind == "custom"), F.lit(False))


def call_stats(flat: DataFrame) -> DataFrame:
    """An output is an orphan here unless a matching call stands above it.

    The call above is found per (session, call id, block) with the carry of the
    earlier blocks, so one hot call id does not become one task.
    """
    rows = call_rows(flat).where(F.col("call_id").isNotNull())
    seen = running(
        rows, {"above": Running("last", F.when(F.col("side") == "call", F.col("call_kind")), before=True)},
        keys=("session_id", "call_id"),
    )
    # Legacy pairs match by id alone; their only kind is "function".
    orphan = (F.col("side") == "output") & ~kinds_match(F.col("above"), F.col("call_kind"))
    out = lambda kind: _count((F.col("side") == "output") & (F.col("call_kind") == kind))
    per_id = seen.groupBy("session_id", "call_id").agg(
        F.max(F.when(F.col("side") == "call", F.struct("line", "call_kind"))).alias("call"),
        out("custom").alias("custom_out"), out("function").alias("function_out"), _count(orphan).alias("orphans"),
    ).withColumn("outs", F.col("custom_out") + F.col("function_out"))
    has_call = F.col("call").isNotNull()
    paired = has_call & F.when(F.col("call.call_kind") == "custom", F.col("custom_out") > 0).otherwise(
        F.col("function_out") > 0)
    return per_id.groupBy("session_id").agg(
        _count(has_call).alias("calls"), F.sum("outs").alias("outputs"), _count(paired).alias("paired_calls"),
        _count(has_call & ~paired).alias("missing_outputs"), F.sum("orphans").alias("orphan_outputs"),
        _count(F.col("outs") > 1).alias("duplicate_output_ids"),
    )


def compacted_stats(flat: DataFrame) -> DataFrame:
    """A8."""
    history = J.get(F.col("item"), "$.replacement_history")
    shape = (
        F.when(~F.col("item_is_object"), "unknown").when(J.is_array(history), "remote")
        .when(history.isNull(), "inline").otherwise("unknown")
    )
    rows = flat.where((F.col("kind") == "wrapped") & (F.col("type") == "compacted")).select("session_id", shape.alias("s"))
    return rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total"), _count(F.col("s") == "inline").alias("inline"),
        _count(F.col("s") == "remote").alias("remote"), _count(F.col("s") == "unknown").alias("unknown"),
    )


def flat_summary(flat: DataFrame) -> DataFrame:
    """Conversation id and line counts."""
    meta = (F.col("kind") == "wrapped") & (F.col("type") == "session_meta")
    wrapped_id = F.when(meta & F.col("item_is_object"), J.as_id(F.col("item"), "$.id"))
    any_id = F.coalesce(wrapped_id, F.when(F.col("kind") == "legacy_meta", J.as_id(F.col("v"), "$.id")))
    rows = flat.select("session_id", "line", "format", "kind", meta.alias("meta"), any_id.alias("cid"),
                       (F.col("kind") == "legacy_record").alias("rec"), F.col("record_type").isNotNull().alias("state"))
    return rows.groupBy("session_id").agg(
        F.max("format").alias("format"),
        F.min_by("cid", F.when(F.col("cid").isNotNull(), F.col("line"))).alias("conversation_id"),
        _count(F.col("meta")).alias("session_meta"),
        _count(F.col("kind") == "invalid_json").alias("invalid_json"),
        _count(F.col("kind") == "unknown_json").alias("unknown_json"),
        _count(F.col("rec")).alias("legacy_records"), _count(F.col("rec") & F.col("state")).alias("legacy_state"),
    )


def wrapped_type_counts(flat: DataFrame) -> DataFrame:
    """Envelope types."""
    return flat.where(F.col("kind") == "wrapped").groupBy("session_id", F.col("type").alias("wrapped_type")).agg(
        F.count(F.lit(1)).alias("n"))


def history_items(flat: DataFrame) -> DataFrame:
    """History rows after the last compacted marker (legacy: all of its items)."""
    marker = F.when((F.col("kind") == "wrapped") & (F.col("type") == "compacted"), F.col("line")).otherwise(0)
    rows = with_session_values(flat, {"_marker": ("max", marker)})
    wrapped = (F.col("kind") == "wrapped") & (F.col("type") == "response_item") & (F.col("line") > F.col("_marker"))
    legacy = (F.col("kind") == "legacy_record") & F.col("record_type").isNull()
    return rows.where(wrapped | legacy).drop("_marker")


def token_readings(flat: DataFrame) -> DataFrame:
    """Token-count rows that carry an ``info`` object."""
    item = F.col("item")
    tokens = F.coalesce(
        J.as_number(item, "$.info.last_token_usage.total_tokens"),
        J.as_number(item, "$.info.total_token_usage.total_tokens"),
    )
    return flat.where(
        (F.col("kind") == "wrapped") & (F.col("type") == "event_msg") & (F.col("item_type") == "token_count")
        & J.is_object(item, "$.info")
    ).select(
        "session_id", "line", "ts", tokens.cast("bigint").alias("tokens"),
        J.as_number(item, "$.info.model_context_window").cast("bigint").alias("context_window"),
    )


def last_token_reading(flat: DataFrame, need_tokens: bool) -> DataFrame:
    """The status wants a token value, the trigger takes the last row of any kind."""
    rows = token_readings(flat)
    if need_tokens:
        rows = rows.where(F.col("tokens").isNotNull())
    return rows.groupBy("session_id").agg(
        F.max(F.struct("line", "tokens", "context_window", "ts")).alias("r")
    ).select("session_id", "r.line", "r.tokens", "r.context_window", "r.ts")


# --- tokens -------------------------------------------------------------------

def message_tokens(
    linked: DataFrame, chain: DataFrame | None = None, counter: K.TokenCounter = K.approx_counter,
    for_plan: bool = False,
) -> DataFrame:
    """P9 over the chain's messages: (session_id, line, depth, approx_tokens)."""
    chain = active_chain(linked) if chain is None else chain
    counted = entries(linked).where("is_message").select(
        "session_id", "line", counter(K.token_segments(F.col("v"), for_plan)).alias("approx_tokens")
    )
    return counted.join(chain.select("session_id", "line", "depth"), ["session_id", "line"])


def session_tokens(tokens: DataFrame) -> DataFrame:
    """A10."""
    return tokens.groupBy("session_id").agg(
        F.sum("approx_tokens").alias("approx_tokens"), F.count(F.lit(1)).alias("chain_messages")
    )


def removal_plan(items: DataFrame, amount: Amount, keep_last: int | None = None, order: str = "line") -> DataFrame:
    """Shortest prefix whose tokens reach the target, per session.

    ``items`` has (session_id, <order>, approx_tokens); an integer order column.
    """
    size = F.greatest(F.coalesce(F.col("approx_tokens"), F.lit(0)), F.lit(0)).cast("bigint")
    rows = running(
        items.select("session_id", F.col(order).alias("line"), size.alias("approx_tokens")),
        {"cum": Running("sum", F.col("approx_tokens")), "rn": Running("sum", F.lit(1).cast("bigint"))},
    )
    totals = rows.groupBy("session_id").agg(
        F.sum("approx_tokens").alias("total_tokens"), F.count(F.lit(1)).alias("n"))
    target = amount.take(F.col("total_tokens"))
    room = F.greatest(F.col("n") - F.lit(keep_last), F.lit(0)) if keep_last and keep_last > 0 else F.col("n")
    goal = totals.withColumn("target_tokens", target).withColumn("max_removable", room)
    active = goal.where((F.col("target_tokens") > 0) & (F.col("max_removable") > 0))
    # Two candidates per session: the first row that reaches the target, and the last removable row.
    picked = rows.join(active, "session_id").where(F.col("rn") <= F.col("max_removable")).groupBy("session_id").agg(
        F.min(F.when(F.col("cum") >= F.col("target_tokens"), F.struct("rn", "cum"))).alias("hit"),
        F.max(F.struct("rn", "cum")).alias("all"),
    )
    zero = F.lit(0).cast("bigint")
    best = F.coalesce("hit", "all")
    return goal.join(picked, "session_id", "left").select(
        "session_id", F.coalesce(best["rn"], zero).alias("remove_count"), "max_removable", "total_tokens",
        "target_tokens", F.coalesce(best["cum"], zero).alias("selected_tokens"),
    )


def prompt_fit(blocks: DataFrame, budget: int, order: str = "line") -> DataFrame:
    """Largest prefix of prompt blocks within a token budget.

    ``blocks`` has (session_id, <order>, prompt_text); NULL texts take no room.
    A block costs its bytes plus the two bytes that separate it from the last.
    """
    size = F.coalesce(F.octet_length("prompt_text") + 2, F.lit(0)).cast("bigint")
    rows = running(
        blocks.select("session_id", F.col(order).alias("line"), size.alias("bytes")),
        {"cum": Running("sum", F.col("bytes")), "rn": Running("sum", F.lit(1).cast("bigint"))},
    ).withColumn("tokens", F.ceil(F.greatest(F.col("cum") - 2, F.lit(0)) / 4).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    fits = rows.groupBy("session_id").agg(
        F.max("rn").alias("requested"), F.max("tokens").alias("requested_tokens"),
        F.max(F.when(F.col("tokens") <= budget, F.struct("rn", "tokens"))).alias("fit"),
    )
    return fits.select(
        "session_id", "requested", "requested_tokens",
        F.coalesce("fit.rn", zero).alias("fit_count"), F.coalesce("fit.tokens", zero).alias("fit_tokens"),
    )


def session_prompts(blocks: DataFrame, budget: int | None = None, target_percent: float = 20, part_bytes: int = 1 << 20) -> DataFrame:
    """The prompt of a session, its blocks (session_id, line, prompt_text) in order with an empty line between.

    Within ``budget`` tokens only the prefix that fits is ever put together: (session_id, blocks, tokens, source_lines,
    target_lines, prompt), a row per session. Without a budget a session's text may be of any length, so it comes in
    parts of about ``part_bytes``: the same columns by (session_id, part), without ``target_lines``.
    """
    rows = blocks.where("prompt_text is not null").select("session_id", "line", "prompt_text")
    sized = running(
        rows.withColumn("bytes", (F.octet_length("prompt_text") + 2).cast("bigint")), {"cum": Running("sum", F.col("bytes"))},
    ).withColumn("tokens", F.ceil((F.col("cum") - 2) / 4).cast("bigint"))
    if budget is not None:
        sized = sized.where(F.col("tokens") <= budget)
    ordered = F.array_sort(F.collect_list(F.struct("line", "prompt_text")))
    joined = lambda items, text: F.array_join(F.transform(items, lambda x: x[text]), "\n\n")
    part = F.floor((F.col("cum") - F.col("bytes")) / part_bytes).alias("part")
    parts = sized.groupBy("session_id", part).agg(
        F.count(F.lit(1)).alias("blocks"), F.max("tokens").alias("tokens"), joined(ordered, "prompt_text").alias("text"))
    parts = parts.withColumn("source_lines", (F.length(F.regexp_replace("text", "[^\n]", "")) + 1).cast("bigint"))
    if budget is None:
        return parts.withColumnRenamed("text", "prompt")
    whole = parts.groupBy("session_id").agg(
        F.sum("blocks").alias("blocks"), F.max("tokens").alias("tokens"),
        # Parts are joined by an empty line, which adds one line between two of them.
        (F.sum("source_lines") + F.count(F.lit(1)) - 1).alias("source_lines"),
        joined(F.array_sort(F.collect_list(F.struct("part", "text"))), "text").alias("prompt"))
    target = F.greatest(F.lit(20), F.floor(F.col("source_lines") * F.lit(target_percent / 100))).cast("bigint")
    return whole.withColumn("target_lines", target)


# --- logs ---------------------------------------------------------------------

def last_signals(log: DataFrame) -> DataFrame:
    """Newest row of each signal per session, by file position."""
    attempt = F.col("event") == "auto_compact"
    picks = {
        "result": attempt, "success": attempt & (F.col("result") == "success"),
        "start": F.col("event") == "auto_compact_start", "session_start": F.col("event") == "session_start",
    }
    row = F.struct("line", "ts", "threshold", "tokens", "result")
    found = log.groupBy("session_id").agg(*[F.max(F.when(c, row)).alias(n) for n, c in picks.items()])
    return found.select(
        "session_id",
        F.col("result.line").alias("result_line"), F.col("result.ts").alias("result_ts"),
        F.col("result.result").alias("result"), F.col("result.threshold").alias("result_threshold"),
        F.col("success.line").alias("success_line"), F.col("success.ts").alias("success_ts"),
        F.col("start.line").alias("start_line"), F.col("start.threshold").alias("start_threshold"),
        F.col("session_start.line").alias("session_start_line"), F.col("session_start.ts").alias("session_start_ts"),
    )


def log_tail(log: DataFrame, n: int | None = 20) -> DataFrame:
    """Last ``n`` compaction entries, all of them without ``n``."""
    rows = log.where(F.col("event") == "auto_compact")
    return rows if n is None else first_rows(rows, n, [F.col("line").desc()])


def gap_stats(beats: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Number, span and gap distribution of heartbeats (seconds).

    Gaps are counted per distinct value before ordering, and ranks come from
    running counts over those, so a chatty session costs as many rows as it has
    different gaps. p95 is the element at floor(0.95 * (n - 1)).
    """
    ms = F.unix_millis("ts")
    rows = beats.where(F.col("ts").isNotNull()).select(*keys, ms.alias("ms"))
    per_ms = rows.groupBy(*keys, "ms").agg(F.count(F.lit(1)).alias("same"))
    # One block is an hour of time: bounded by its number of milliseconds.
    lagged = running(per_ms, {"prev": Running("last", F.col("ms"), before=True)}, keys=keys, order=("ms",), size=3_600_000)
    first = lagged.where(F.col("prev").isNotNull()).select(
        *keys, (F.col("ms") - F.col("prev")).alias("gap"), F.lit(1).cast("bigint").alias("n"))
    same = per_ms.where(F.col("same") > 1).select(*keys, F.lit(0).cast("bigint").alias("gap"), (F.col("same") - 1).alias("n"))
    values = first.unionByName(same).groupBy(*keys, "gap").agg(F.sum("n").alias("n"))
    ranked = running(values, {"cum": Running("sum", F.col("n"))}, keys=keys, order=("gap",), size=1 << 16)
    count = values.groupBy(*keys).agg(
        F.sum("n").alias("gaps"), F.min("gap").alias("lo"), F.max("gap").alias("hi"),
        F.sum(F.when(F.col("gap") < 1000, F.col("n")).otherwise(0)).alias("bursts"))
    at = lambda rank: F.min(F.when(F.col("cum") > rank, F.col("gap")))
    n = F.col("gaps")
    placed = ranked.join(count.select(*keys, "gaps"), list(keys)).groupBy(*keys).agg(
        at(F.floor((n - 1) / 2)).alias("m1"), at(F.floor(n / 2)).alias("m2"), at(F.floor(F.lit(0.95) * (n - 1))).alias("p95"))
    span = per_ms.groupBy(*keys).agg(F.sum("same").alias("beats"), F.min("ms").alias("a"), F.max("ms").alias("b"))
    return span.join(count, list(keys), "left").join(placed, list(keys), "left").select(
        *keys, "beats", ((F.col("b") - F.col("a")) / 1000).alias("span_seconds"),
        F.coalesce("gaps", F.lit(0).cast("bigint")).alias("gaps"),
        (F.col("lo") / 1000).alias("gap_min"), ((F.col("m1") + F.col("m2")) / 2000).alias("gap_median"),
        (F.col("p95") / 1000).alias("gap_p95"), (F.col("hi") / 1000).alias("gap_max"),
        F.coalesce("bursts", F.lit(0).cast("bigint")).alias("gaps_under_1s"),
    )


def last_activity(rows: DataFrame, ts_raw: str = "ts_raw") -> DataFrame:
    """Newest valid timestamp text, the first line on ties."""
    ts = F.try_to_timestamp(ts_raw)
    return rows.select("session_id", "line", F.col(ts_raw).alias("ts_raw"), ts.alias("t")).where("t is not null").groupBy(
        "session_id").agg(F.max(F.struct("t", -F.col("line"), "ts_raw")).alias("m")).select(
        "session_id", F.col("m.ts_raw").alias("last_activity"), F.col("m.t").alias("last_activity_ts"))


def latest_outputs(flat: DataFrame) -> DataFrame:
    """Rows of repeated legacy outputs to drop, all but the last per call id."""
    rows = call_rows(flat).where("format = 'legacy' and side = 'output' and call_id is not null")
    newest = rows.groupBy("session_id", "call_id").agg(F.max("line").alias("_keep"))
    return rows.join(newest, ["session_id", "call_id"]).where(F.col("line") < F.col("_keep")).select("session_id", "line")


def newest_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rank 1 per key as a pre-aggregating window (W8 and similar rules)."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_r", rank).where("_r = 1").drop("_r")
