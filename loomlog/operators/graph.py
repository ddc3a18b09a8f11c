"""Parent links as a graph: leaf, chain, turns, pair closure, relinking, collapse.

Almost every parent link points at the row just above. Such rows form segments,
found with one bounded window, and the graph that has to be walked shrinks to
one node per segment (usually one or two per session). Walking it doubles the
distance per round, so a chain with n segment changes needs log2(n) rounds.
Loops stop on a stable count and cut their lineage with a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.operators.forest import merge_order
from loomlog.operators.ordered import BLOCK_LINES, Running, running, with_block
from loomlog.session import cut
from loomlog.sources.lines import entries, has_thinking


def nodes(linked: DataFrame, *extra: str) -> DataFrame:
    """One row per (session, uuid); the last row of a repeated uuid wins."""
    keep = ["line", "parent_uuid", *extra]
    return (
        entries(linked)
        .where(F.col("uuid").isNotNull())
        .groupBy("session_id", "uuid")
        .agg(F.max(F.struct(*keep)).alias("n"))
        .select("session_id", "uuid", "n.*")
    )


def segments(node_rows: DataFrame, size: int = BLOCK_LINES) -> DataFrame:
    """Add ``seg`` (line of the segment's first row) and ``off`` (position in it)."""
    w = Window.partitionBy("session_id", "blk").orderBy("line")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = (
        with_block(node_rows, size)
        .withColumn("_prev", F.lag("uuid").over(w))
        .withColumn("_idx", F.row_number().over(w))
        .withColumn("_start", ~F.coalesce(F.col("parent_uuid") == F.col("_prev"), F.lit(False)))
    )
    return (
        numbered.withColumn("_head", F.last(F.when(F.col("_start"), F.struct("line", "_idx")), True).over(upto))
        .withColumn("seg", F.col("_head.line"))
        .withColumn("off", (F.col("_idx") - F.col("_head._idx")).cast("bigint"))
        .drop("blk", "_prev", "_idx", "_start", "_head")
    )


def _segment_links(rows: DataFrame) -> DataFrame:
    """(session, seg, head_parent, to_seg, to_off): where a segment's first row points."""
    heads = rows.where(F.col("off") == 0).select("session_id", "seg", F.col("parent_uuid").alias("head_parent"))
    targets = rows.select(
        "session_id", F.col("uuid").alias("head_parent"), F.col("seg").alias("to_seg"), F.col("off").alias("to_off")
    )
    return heads.join(targets, ["session_id", "head_parent"], "left")


def _upto(rows: DataFrame, column: str, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.where(F.col(column) < limit)


def walk(rows: DataFrame, starts: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows on the parent path from each start uuid: (session_id, uuid, line, depth).

    ``rows`` come from :func:`segments`; ``starts`` has (session_id, uuid). A path
    ends at a missing parent, at a row it has already visited, or after ``limit``
    rows if a limit is given. Rounds follow the logarithm of the segment changes.
    """
    rows = cut(rows)
    reached = rows.join(starts.select("session_id", "uuid"), ["session_id", "uuid"]).select(
        "session_id", "seg", "off", F.lit(0).cast("bigint").alias("depth")
    )
    reached = cut(reached)
    jumps = cut(
        _segment_links(rows).where(F.col("to_seg").isNotNull())
        .select("session_id", "seg", "to_seg", "to_off", F.lit(1).cast("bigint").alias("hops"))
    )
    known = reached.count()
    while True:
        step = _upto(reached.join(jumps, ["session_id", "seg"]).select(
            "session_id", F.col("to_seg").alias("seg"), F.col("to_off").alias("off"),
            (F.col("depth") + F.col("off") + F.col("hops")).alias("depth"),
        ), "depth", limit)
        reached = cut(
            reached.unionByName(step).groupBy("session_id", "seg", "off").agg(F.min("depth").alias("depth"))
        )
        now = reached.count()
        if now == known:
            break
        known = now
        onward = jumps.select(
            "session_id", F.col("seg").alias("to_seg"), F.col("to_seg").alias("seg2"),
            F.col("to_off").alias("off2"), F.col("hops").alias("hops2"),
        )
        jumps = cut(_upto(
            jumps.join(onward, ["session_id", "to_seg"]).select(
                "session_id", "seg", F.col("seg2").alias("to_seg"), F.col("off2").alias("to_off"),
                (F.col("hops") + F.col("to_off") + F.col("hops2")).alias("hops"),
            ), "hops", limit))
    entry = reached.select("session_id", "seg", F.col("off").alias("_off"), F.col("depth").alias("_depth"))
    on_path = rows.join(entry, ["session_id", "seg"]).where(F.col("off") <= F.col("_off"))
    depth = F.col("_depth") + F.col("_off") - F.col("off")
    return _upto(on_path.groupBy("session_id", "uuid", "line").agg(F.min(depth).alias("depth")), "depth", limit)


def leaves(node_rows: DataFrame, all_entries: DataFrame) -> DataFrame:
    """G1: (session_id, uuid). ``node_rows`` need ts; ties go to the later line."""
    parents = (
        all_entries.where(F.col("parent_uuid").isNotNull())
        .select("session_id", F.col("parent_uuid").alias("uuid")).distinct()
    )
    free = node_rows.join(parents.withColumn("_used", F.lit(True)), ["session_id", "uuid"], "left")
    rank = F.struct(F.col("_used").isNull(), F.when(F.col("_used").isNull(), F.col("ts")), F.col("line"))
    return free.groupBy("session_id").agg(F.max_by("uuid", rank).alias("uuid"))


def active_chain(linked: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows from the leaf to the root; order root first by descending depth."""
    known = nodes(linked, "ts")
    return walk(segments(known), leaves(known, entries(linked)), limit)


def chain_messages(linked: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """User and assistant rows of the chain with their entry columns and depth."""
    chain = active_chain(linked) if chain is None else chain
    messages = entries(linked).where("is_message")
    return messages.join(chain.select("session_id", "line", "depth"), ["session_id", "line"])


def _segment_roots(rows: DataFrame) -> DataFrame:
    """(session, seg, root_seg): the last segment upward, NULL for paths into a cycle."""
    link = cut(_segment_links(rows).select("session_id", "seg", F.col("to_seg").alias("nxt")))
    roots = _upmost(link.where(F.col("nxt").isNotNull()))
    still = link.where(F.col("nxt").isNull()).select("session_id", "seg", F.col("seg").alias("root_seg"))
    return roots.unionByName(still)


def _upmost(link: DataFrame) -> DataFrame:
    """(session, seg, root_seg) of the segments of ``link`` (session, seg, nxt), which all point at another one.

    A round doubles the distance, so after as many rounds as the number of
    links has bits only paths into cycles still move; their root is NULL.
    """
    roots = link = cut(link)
    for _ in range(link.count().bit_length() + 1):
        far = roots.select("session_id", F.col("seg").alias("nxt"), F.col("nxt").alias("far"))
        stepped = cut(roots.join(far, ["session_id", "nxt"], "left").select("session_id", "seg", "nxt", "far"))
        moving = stepped.where(F.col("far").isNotNull()).limit(1).count()
        roots = stepped.select("session_id", "seg", F.coalesce("far", "nxt").alias("nxt"))
        if moving == 0:
            return roots.withColumnRenamed("nxt", "root_seg")
    onward = link.select("session_id", F.col("seg").alias("nxt"), F.lit(True).alias("_on"))
    settled = roots.join(onward, ["session_id", "nxt"], "left")
    return settled.select("session_id", "seg", F.when(F.col("_on").isNull(), F.col("nxt")).alias("root_seg"))


def assistant_turns(linked: DataFrame) -> DataFrame:
    """(session_id, line, turn) for assistant rows; turn is the line of the turn's first row.

    The turn of an assistant row is the connected assistant subtree above it.
    Rows without a uuid belong to the turn of their assistant parent.
    """
    assistants = entries(linked).where(F.col("role") == "assistant")
    known = nodes(linked, "role").where(F.col("role") == "assistant")
    rows = cut(segments(known))
    turn_of = rows.join(_segment_roots(rows), ["session_id", "seg"]).select(
        "session_id", "uuid", "line", F.col("root_seg").alias("turn")
    )
    own = assistants.join(turn_of.select("session_id", "line", "turn"), ["session_id", "line"], "left")
    parent = turn_of.select("session_id", F.col("uuid").alias("parent_uuid"), F.col("turn").alias("_parent_turn"))
    return (
        own.select("session_id", "line", "parent_uuid", "turn")
        .join(parent, ["session_id", "parent_uuid"], "left")
        .select("session_id", "line", F.coalesce("turn", "_parent_turn").alias("turn"))
        .where(F.col("turn").isNotNull())
    )


def expand_turns(selected: DataFrame, turns: DataFrame) -> DataFrame:
    """Selected (session_id, line) plus every row of a touched assistant turn."""
    touched = turns.join(selected, ["session_id", "line"], "left_semi").select("session_id", "turn").distinct()
    return (
        turns.join(touched, ["session_id", "turn"], "left_semi").select("session_id", "line")
        .unionByName(selected.select("session_id", "line")).distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(session_id, node, root) of the nodes of ``edges`` (session_id, a, b); root is the smallest node reached.

    Two star contractions alternate until only stars are left, so a chain of n
    edges takes about log n rounds.
    """
    key = ["session_id"]

    def only_stars(e: DataFrame) -> bool:
        """Every node either heads edges or stands below exactly one."""
        side = lambda name, below: F.struct(F.col(name).alias("node"), F.lit(below).alias("below"))
        ends = e.select(*key, F.explode(F.array(side("a", 0), side("b", 1))).alias("x"))
        sums = ends.groupBy(*key, "x.node").agg(F.sum("x.below").alias("below"), F.count(F.lit(1)).alias("all"))
        return sums.where((F.col("below") > 0) & (F.col("all") > 1)).isEmpty()

    now = cut(edges.where("a <> b").select(*key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not only_stars(now):
        both = now.unionByName(now.select(*key, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*key, "a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, [*key, "a"]).select(*key, F.col("low").alias("a"), "b").where("a <> b").distinct()
        met = large.join(large.groupBy(*key, "b").agg(F.min("a").alias("low")), [*key, "b"])
        hung = met.select(*key, F.col("low").alias("a"), F.when(F.col("a") == F.col("low"), F.col("b")).otherwise(F.col("a")).alias("b"))
        now = cut(hung.unionByName(met.select(*key, F.col("low").alias("a"), "b")).distinct())
    roots = now.select(*key, F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return roots.unionByName(now.select(*key, F.col("b").alias("node"), F.col("a").alias("root")))


def _spread(start: DataFrame, groups: DataFrame) -> DataFrame:
    """All (session, line) in a component of ``groups`` with a line of ``start``, and ``start`` itself."""
    begin = start.select("session_id", "line").distinct()
    hit = groups.join(begin, ["session_id", "line"], "left_semi").select("session_id", "root").distinct()
    return cut(groups.join(hit, ["session_id", "root"], "left_semi").select("session_id", "line").unionByName(begin).distinct())


def pair_closure(refs: DataFrame, initial: DataFrame) -> DataFrame:
    """(session_id, line, reason) closed over tool pairs.

    ``reason`` is selected, pair, or orphan_result. Results that never had a
    use are removed as well, whatever was asked for.
    """
    sides = refs.groupBy("session_id", "tool_id").agg(
        F.bool_or(F.col("side") == "use").alias("has_use"), F.bool_or(F.col("side") == "result").alias("has_result")
    )
    tagged = cut(refs.select("session_id", "line", "side", "tool_id").distinct().join(sides, ["session_id", "tool_id"]))
    links = tagged.where("has_use and has_result").select("session_id", "line", "tool_id").distinct()
    orphans = tagged.where("side = 'result' and not has_use").select("session_id", "line").distinct()
    initial = cut(initial.select("session_id", "line").distinct())
    # Lines of a tool id hang on its first line, so a tool with many lines stays a star.
    first = links.groupBy("session_id", "tool_id").agg(F.min("line").alias("a"))
    groups = cut(components(links.join(first, ["session_id", "tool_id"]).select("session_id", "a", F.col("line").alias("b"))).withColumnRenamed("node", "line"))
    near = _spread(initial, groups)
    loose = cut(orphans.join(near, ["session_id", "line"], "left_anti"))
    wide = near if loose.isEmpty() else _spread(near.unionByName(loose), groups)
    return (
        wide.join(initial.withColumn("_s", F.lit(True)), ["session_id", "line"], "left")
        .join(loose.withColumn("_o", F.lit(True)), ["session_id", "line"], "left")
        .select(
            "session_id", "line",
            F.when(F.col("_s"), "selected").when(F.col("_o"), "orphan_result").otherwise("pair").alias("reason"),
        )
    )


def relinked_parents(linked: DataFrame, removed: DataFrame | Column) -> DataFrame:
    """(session_id, line, new_parent) of kept rows whose parent was removed.

    ``removed`` has (session_id, line), or is a condition on the entries. The
    new parent is what the last removed row upward points at, however many were
    removed in a row; NULL where the removed rows form a cycle.
    """
    rows = entries(linked)
    if isinstance(removed, Column):
        goes = F.coalesce(removed, F.lit(False))
        gone, kept = rows.where(goes), rows.where(~goes)
    else:
        keys = removed.select("session_id", "line")
        gone, kept = (rows.join(keys, ["session_id", "line"], how) for how in ("left_semi", "left_anti"))
    is_head = F.col("off") == 0
    placed = cut(segments(nodes(gone)).select(
        "session_id", "uuid", "seg", is_head.alias("head"), F.when(is_head, F.col("parent_uuid")).alias("parent_uuid")))
    heads = placed.where("head").select("session_id", "seg", "parent_uuid")
    # One search for all parents: those of kept rows and those of the segments' first rows.
    asked = heads.select("session_id", F.col("seg").alias("at"), "parent_uuid", F.lit(True).alias("of_head")).unionByName(
        kept.select("session_id", F.col("line").alias("at"), "parent_uuid", F.lit(False).alias("of_head")))
    target = placed.select("session_id", F.col("uuid").alias("parent_uuid"), F.col("seg").alias("found"))
    met = cut(asked.where(F.col("parent_uuid").isNotNull()).join(target, ["session_id", "parent_uuid"]).select(
        "session_id", "at", "of_head", "found"))
    roots = _upmost(met.where("of_head").select("session_id", F.col("at").alias("seg"), F.col("found").alias("nxt")))
    top = heads.select("session_id", F.col("seg").alias("root_seg"), F.col("parent_uuid").alias("_top"))
    far = roots.join(top, ["session_id", "root_seg"], "left").select("session_id", "seg", "_top", F.lit(True).alias("_far"))
    ends = heads.join(far, ["session_id", "seg"], "left").select(
        "session_id", "seg", F.when(F.col("_far"), F.col("_top")).otherwise(F.col("parent_uuid")).alias("new_parent"))
    hit = met.where("not of_head").select("session_id", F.col("at").alias("line"), F.col("found").alias("seg"))
    return hit.join(ends, ["session_id", "seg"]).select("session_id", "line", "new_parent")


def collapse_plan(linked: DataFrame) -> DataFrame:
    """(session_id, tip_line, line, depth): ``line`` is folded into ``tip_line``.

    Blocks count as already ordered thinking-first. Straight groups in file
    order are decided by aggregates; branched groups and cycles, which depend on
    the order of merging, by the rounds of :func:`loomlog.operators.forest.merge_order`.
    """
    usable = entries(linked).where(
        (F.col("role") == "assistant") & ~F.col("is_api_error") & F.col("merge_key").isNotNull()
        & (F.size("blocks") > 0)
    ).select("session_id", "line", "uuid", "parent_uuid", "merge_key", has_thinking(F.col("blocks")).alias("thinks"))
    winners = nodes(linked).select("session_id", "line").join(usable, ["session_id", "line"])
    rows = cut(usable)
    parents = winners.select(
        "session_id", F.col("uuid").alias("parent_uuid"), "merge_key", F.col("line").alias("parent_line")
    )
    edges = cut(rows.join(parents, ["session_id", "parent_uuid", "merge_key"], "left"))
    # Rows without a same-key link in either direction cannot collapse.
    up = edges.where(F.col("parent_line").isNotNull())
    fan = up.groupBy("session_id", F.col("parent_line").alias("line")).agg(F.count(F.lit(1)).alias("kids"))
    grouped = edges.join(fan, ["session_id", "line"], "left").where(
        F.col("parent_line").isNotNull() | F.col("kids").isNotNull()
    )
    linkable = grouped.withColumn("_id", F.coalesce("uuid", F.concat(F.lit("#"), F.col("line").cast("string"))))
    group_rows = segments(
        linkable.select(
            "session_id", F.col("_id").alias("uuid"), "line",
            F.when(F.col("parent_line").isNotNull(), F.col("parent_uuid")).alias("parent_uuid"),
            "thinks", "merge_key", F.coalesce("kids", F.lit(0)).alias("kids"), "parent_line",
        )
    )
    group_rows = cut(group_rows)
    members = cut(group_rows.join(_segment_roots(group_rows), ["session_id", "seg"]).withColumn(
        "grp", F.coalesce("root_seg", F.lit(-1).cast("bigint"))))
    shape = members.groupBy("session_id", "grp", "merge_key").agg(
        F.max("line").alias("tip_line"),
        F.bool_or("thinks").alias("_any"), F.bool_and("thinks").alias("_all"),
        (F.bool_and(F.col("kids") <= 1) & F.bool_and(F.coalesce(F.col("parent_line") < F.col("line"), F.lit(True)))
         & (F.count_distinct("uuid") == F.count(F.lit(1))) & (F.first("grp") >= 0)).alias("straight"),
    )
    judged = members.join(shape, ["session_id", "grp", "merge_key"])
    straight = judged.where("straight and _any and not _all and line <> tip_line").select(
        # Depth is only used as an order (root last), so the line distance serves.
        "session_id", "tip_line", "line", (F.col("tip_line") - F.col("line")).alias("depth")
    )
    branched = cut(judged.where("not straight").select("session_id", "line", "parent_line", "thinks"))
    return straight if branched.isEmpty() else straight.unionByName(merge_order(branched))


def resume_violations(linked: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per session whose resumed prompt breaks the thinking-first rule.

    Looks at the whole chain, or at its newest ``limit`` rows.
    """
    talk = F.col("role").isin("user", "assistant") & ~F.col("is_api_error") & F.col("uuid").isNotNull()
    leaf = (
        entries(linked).where(talk).groupBy("session_id")
        .agg(F.max(F.struct("line", "uuid")).alias("leaf")).select("session_id", "leaf.uuid", "leaf.line")
    )
    leaf = cut(leaf)
    chain = walk(segments(nodes(linked)), leaf, limit)
    blocks = F.col("blocks")
    has_result = F.exists(blocks, lambda b: (b["type"] == "tool_result") & b["tool_use_id"].isNotNull())
    rows = entries(linked).join(chain.select("session_id", "line", "depth"), ["session_id", "line"]).where(
        F.col("role").isin("user", "assistant") & ~F.col("is_api_error")
        & ~F.coalesce(F.col("type").isin("system", "progress"), F.lit(False))
    ).select(
        "session_id", "line", "depth", "role", "merge_key",
        F.size("blocks").alias("n_blocks"), has_thinking(blocks).alias("thinks"),
        F.array_position(F.transform(blocks, lambda b: b["is_thinking"]), True).alias("think_pos"),
        F.try_element_at(blocks, F.lit(1))["type"].alias("first_type"),
        (F.col("role") == "user").alias("is_user"), F.coalesce(has_result, F.lit(False)).alias("has_result"),
    )
    wall = F.when(F.col("is_user") & ~F.col("has_result"), 1).otherwise(0)
    by_depth = {"order": ("depth",)}
    # Each running value reads its rows twice, so they are stored in between.
    walled = cut(running(cut(rows), {"_walls": Running("sum", wall)}, **by_depth))
    previous = Running("last", F.when(~F.col("is_user"), F.struct("merge_key", "_walls")), before=True)
    marked = cut(running(walled, {"_prev": previous}, **by_depth))
    joins = ~F.col("is_user") & F.coalesce(
        (F.col("_prev.merge_key") == F.col("merge_key")) & (F.col("_prev._walls") == F.col("_walls")), F.lit(False)
    )
    marked = marked.withColumn("_joins", joins)
    placed = cut(running(marked, {"_count": Running("sum", (~F.col("_joins")).cast("bigint"))}, **by_depth).withColumn("idx", F.col("_count") - 1))
    # An island's index: that of the prompt message it started.
    island = Running("last", F.when(~F.col("is_user") & ~F.col("_joins"), F.col("idx")))
    placed = running(placed, {"_island": island}, **by_depth).withColumn("msg", F.when(~F.col("is_user"), F.col("_island")))
    full = F.col("n_blocks") > 0
    merged = placed.where(~F.col("is_user")).groupBy("session_id", "msg").agg(
        F.bool_or("thinks").alias("thinks"),
        F.max_by(F.struct("first_type", "think_pos"), F.when(full, F.col("depth"))).alias("first"),
        F.max_by("line", "depth").alias("line"),
        F.max("merge_key").alias("merge_key"),
    )
    broken = merged.where(F.col("thinks") & (F.coalesce(F.col("first.think_pos"), F.lit(0)) != 1))
    return (
        broken.groupBy("session_id").agg(
            F.count(F.lit(1)).alias("violations"),
            F.min(F.struct(
                F.col("msg").alias("prompt_index"), "line", "merge_key",
                F.coalesce(F.col("first.first_type"), F.lit("unknown")).alias("first_block_type"))).alias("s"),
        )
        .join(leaf.select("session_id", F.col("uuid").alias("leaf_uuid"), F.col("line").alias("leaf_line")), "session_id")
        .select("session_id", "violations", "leaf_uuid", "leaf_line", "s.*")
    )
