"""Forests as tables: jumps to ancestors, values from below, and the merge order of chunk groups.

A forest is (session_id, node, parent), parent null at a root. Jump tables double their distance, so what lies below a
node, or its root, takes as many joins as the depth has bits; no task holds a tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.session import cut

KEY = ["session_id"]
EXTREME = {"max": F.max, "min": F.min}


def jump_tables(forest: DataFrame) -> tuple[list[DataFrame], bool]:
    """Tables (session_id, node, up) of the ancestors 1, 2, 4, ... above; and whether some paths never end (cycles)."""
    now = cut(forest.where("parent is not null").select(*KEY, "node", F.col("parent").alias("up")))
    tables, left = [], now.count()
    bound = left.bit_length() + 1
    while left and len(tables) <= bound:
        tables.append(now)
        onward = now.select(*KEY, F.col("node").alias("up"), F.col("up").alias("far"))
        now = cut(now.join(onward, [*KEY, "up"]).select(*KEY, "node", F.col("far").alias("up")))
        left = now.count()
    return tables, left > 0


def from_below(tables: list[DataFrame], own: DataFrame, values: dict[str, str]) -> DataFrame:
    """(session_id, node, values) over all rows of ``own`` (session_id, node, values) strictly below a node.

    ``values`` maps a column to ``max`` or ``min``. Nodes with nothing below are left out.
    """
    agg = [EXTREME[how](name).alias(name) for name, how in values.items()]

    def lifted(rows: DataFrame, table: DataFrame) -> DataFrame:
        return rows.join(table, [*KEY, "node"]).select(*KEY, F.col("up").alias("node"), *values)

    if not tables:
        return cut(own.select(*KEY, "node", *values).limit(0))
    found = cut(lifted(own, tables[0]).groupBy(*KEY, "node").agg(*agg))
    for k, table in enumerate(tables):
        found = found.unionByName(lifted(found, table)).groupBy(*KEY, "node").agg(*agg)
        if k % 2 or k == len(tables) - 1:  # a level is planned twice rather than stored
            found = cut(found)
    return found


def ends(links: DataFrame) -> DataFrame:
    """(session_id, node, root, depth) of every node of a forest without cycles."""
    now = cut(links.select(*KEY, "node", F.coalesce("parent", "node").alias("root"), F.col("parent").isNotNull().cast("bigint").alias("depth")))
    while True:
        far = now.select(*KEY, F.col("node").alias("root"), F.col("root").alias("far"), F.col("depth").alias("more"))
        step = cut(now.join(far, [*KEY, "root"]).select(*KEY, "node", F.col("far").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")))
        moving = not step.where("moved").isEmpty()
        now = step.drop("moved")
        if not moving:
            return now


def _cycles(nodes: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(session_id, line, cycle, place, length) of the rows on cycles: the cycle's last line, steps to it, its rows."""
    on = cut(tables[-1].select(*KEY, F.col("up").alias("node")).distinct())
    links = cut(nodes.join(on, [*KEY, "node"]).select(*KEY, "node", F.col("parent").alias("up"), F.col("node").alias("top")))
    for _ in tables:
        far = links.select(*KEY, F.col("node").alias("up"), F.col("up").alias("far"), F.col("top").alias("more"))
        links = cut(links.join(far, [*KEY, "up"]).select(*KEY, "node", F.col("far").alias("up"), F.greatest("top", "more").alias("top")))
    members = links.select(*KEY, "node", "top").join(nodes.select(*KEY, "node", "parent"), [*KEY, "node"])
    opened = members.select(*KEY, "node", F.when(F.col("node") != F.col("top"), F.col("parent")).alias("parent"))
    sizes = members.groupBy(*KEY, "top").agg(F.count(F.lit(1)).alias("length"))
    placed = ends(opened).select(*KEY, "node", F.col("root").alias("top"), F.col("depth").alias("place")).join(sizes, [*KEY, "top"])
    return cut(placed.select(*KEY, F.col("node").alias("line"), F.col("top").alias("cycle"), "place", "length"))


def _decide(forest: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(session_id, node, line) of the tips that merge; ``forest`` has (session_id, node, parent, line, flag, limit).

    Tips are taken from the last line up; a tip merges if the rows left on its path differ in their flag. With d its
    nearest ancestor of another flag, that is so unless a later tip below d has taken d away. So for each d only its
    last row counts, and it merges if every later one below d does not; all that is certain is settled in each round.
    """
    nodes = forest.select(*KEY, "node", "flag")
    above = nodes.select(*KEY, F.col("node").alias("parent"), F.col("flag").alias("_above"))
    alike = (F.col("flag") == F.col("_above")) & (F.col("flag") < 2)
    edges = cut(forest.join(above, [*KEY, "parent"], "left").select(*KEY, "node", "parent", F.when(alike, F.col("parent")).alias("same")))
    tops = ends(edges.select(*KEY, "node", F.col("same").alias("parent"))).select(*KEY, "node", F.col("root").alias("top"))
    other = edges.select(*KEY, F.col("node").alias("top"), F.col("parent").alias("d")).where("d is not null")
    able = forest.where("line is not null and (limit is null or line < limit)").select(*KEY, "node", "line")
    open_ = cut(able.join(tops, [*KEY, "node"]).join(other, [*KEY, "top"]).groupBy(*KEY, "d").agg(F.max(F.struct("line", "node")).alias("x")).select(
        *KEY, "d", "x.node", "x.line"))
    merged = open_.select(*KEY, "node", "line").limit(0)
    while not open_.isEmpty():
        own = open_.select(*KEY, "node", F.col("line").alias("open"), F.lit(None).cast("bigint").alias("gone")).unionByName(
            merged.select(*KEY, "node", F.lit(None).cast("bigint").alias("open"), F.col("line").alias("gone")))
        low = from_below(tables, own, {"open": "max", "gone": "max"}).withColumnRenamed("node", "d").withColumnRenamed("open", "_open")
        judged = cut(open_.join(low, [*KEY, "d"], "left"))
        lost = F.coalesce(F.col("gone") > F.col("line"), F.lit(False))
        merged = cut(merged.unionByName(judged.where(~lost & (F.col("_open") == F.col("line"))).select(*KEY, "node", "line")))
        open_ = cut(judged.where(~lost & (F.col("_open") != F.col("line"))).select(*KEY, "d", "node", "line"))
    return merged


def merge_order(rows: DataFrame) -> DataFrame:
    """G6 for any shape of group: (session_id, tip_line, line, depth): ``line`` is folded into ``tip_line``.

    ``rows`` has (session_id, line, parent_line, thinks), a row per chunk. A cycle counts as one node, as a path that
    reaches it takes all of it; each of its rows is also a tip below it. A tip that merges holds thinking from then
    on. That matters to rows below it that come earlier in the file, which are judged once more with the tip as
    their root; in a file that is in order there are none.
    """
    rows = cut(rows.select(*KEY, F.col("line").alias("node"), F.col("parent_line").alias("parent"), F.col("thinks").cast("int").alias("flag")))
    plain = rows.select(*KEY, "node", "parent", F.col("node").alias("line"), "flag", F.lit(None).cast("bigint").alias("limit"), F.lit(None).cast("bigint").alias("entry"))
    tables, cyclic = jump_tables(rows)
    ring = None
    if cyclic:
        ring = _cycles(rows, tables)
        member = ring.select(*KEY, F.col("line").alias("parent"), F.col("cycle").alias("_up"))
        outer = plain.join(ring.select(*KEY, F.col("line").alias("node")), [*KEY, "node"], "left_anti").join(member, [*KEY, "parent"], "left")
        outer = outer.withColumn("entry", F.when(F.col("_up").isNotNull(), F.col("parent"))).withColumn("parent", F.coalesce("_up", "parent")).drop("_up")
        inner = rows.join(ring.select(*KEY, F.col("line").alias("node"), "cycle"), [*KEY, "node"])
        both = inner.groupBy(*KEY, "cycle").agg(F.min("flag").alias("low"), F.max("flag").alias("high"))
        none = F.lit(None).cast("bigint")
        super_ = both.select(*KEY, F.col("cycle").alias("node"), none.alias("parent"), none.alias("line"), F.when(F.col("low") < F.col("high"), 2).otherwise(F.col("low")).alias("flag"), none.alias("limit"), none.alias("entry"))
        # Each row of a cycle as a tip: a node of its own, numbered below zero, under the cycle.
        tips = inner.join(both.drop("low"), [*KEY, "cycle"]).select(
            *KEY, (-F.col("node")).alias("node"), F.col("cycle").alias("parent"), F.col("node").alias("line"), "flag", none.alias("limit"), F.col("parent").alias("entry"))
        plain = outer.select(plain.columns).unionByName(super_).unionByName(tips.select(plain.columns))
    if not cyclic and rows.where("parent >= node").isEmpty():  # parents come first: one pass, and lines tell the order on a path
        merged = _decide(plain, tables)
        taken = from_below(tables, merged.select(*KEY, "node", F.col("line").alias("tip")), {"tip": "max"})
        return taken.select(*KEY, F.col("tip").alias("tip_line"), F.col("node").alias("line"), (F.col("tip") - F.col("node")).alias("depth"))
    forest, out = cut(plain), None
    while True:
        tables, _ = jump_tables(forest)
        merged = _decide(forest, tables)
        # Tips below a later tip that merges belong to the next pass.
        own = merged.select(*KEY, "node", "line")
        low = from_below(tables, forest.where("line is not null").select(*KEY, "node", F.col("line").alias("first")), {"first": "min"})
        late = cut(own.join(low, [*KEY, "node"]).where("first < line").select(*KEY, "node", "line"))
        under = None
        if not late.isEmpty():
            reach = _below_any(tables, late)
            under = reach.groupBy(*KEY, "node").agg(F.max("line").alias("over"))
            own = cut(own.join(under, [*KEY, "node"], "left").where("over is null or over < line").drop("over"))
        taken = from_below(tables, own.withColumnRenamed("line", "tip"), {"tip": "max"})
        spots = ends(forest.select(*KEY, "node", "parent")).select(*KEY, "node", "depth")
        tip_at = own.select(*KEY, F.col("line").alias("tip"), "node").join(spots, [*KEY, "node"]).select(*KEY, "tip", F.col("node").alias("_tip_node"), F.col("depth").alias("_deep"))
        found = taken.join(spots, [*KEY, "node"]).join(tip_at, [*KEY, "tip"]).select(*KEY, "tip", "node", "_tip_node", (F.col("_deep") - F.col("depth")).alias("depth"))
        found = cut(found)
        if ring is not None:
            found = _unrolled(found, ring, forest)
        part = found.select(*KEY, F.col("tip").alias("tip_line"), F.col("node").alias("line"), "depth")
        out = part if out is None else out.unionByName(part)
        if under is None:
            return out
        # The outermost of these tips head the next pass.
        heads = late.join(own.select(*KEY, "node"), [*KEY, "node"], "left_semi")
        rest = _below_any(tables, heads).groupBy(*KEY, "node").agg(F.max("line").alias("limit"))
        kept = forest.drop("limit").join(rest, [*KEY, "node"]).select(forest.columns)
        tops = forest.join(heads.select(*KEY, "node"), [*KEY, "node"], "left_semi").join(rest.select(*KEY, "node"), [*KEY, "node"], "left_anti")
        none = F.lit(None).cast("bigint")
        # A head keeps its line for the output but is no candidate: its limit is 0.
        tops = tops.select(*KEY, "node", none.alias("parent"), "line", F.lit(1).alias("flag"), F.lit(0).cast("bigint").alias("limit"), none.alias("entry"))
        forest = cut(kept.unionByName(tops.select(forest.columns)))


def _below_any(tables: list[DataFrame], heads: DataFrame) -> DataFrame:
    """(session_id, node, line) of the nodes strictly below ``heads`` (session_id, node, line); a node may come twice."""
    found = heads.select(*KEY, "node", "line")
    for table in reversed(tables):
        down = table.select(*KEY, F.col("up").alias("node"), F.col("node").alias("_low"))
        found = cut(found.unionByName(found.join(down, [*KEY, "node"]).select(*KEY, F.col("_low").alias("node"), "line")).distinct())
    own = heads.select(*KEY, "node", F.col("line"))
    return cut(found.join(own, [*KEY, "node", "line"], "left_anti"))


def _unrolled(found: DataFrame, ring: DataFrame, forest: DataFrame) -> DataFrame:
    """Replace cycles by their rows, in the order in which a path from the tip meets them."""
    loops = ring.select(*KEY, "cycle").distinct().select(*KEY, F.col("cycle").alias("node"))
    whole = found.join(loops, [*KEY, "node"])
    cut_off = forest.select(*KEY, "node", F.when(F.col("entry").isNull(), F.col("parent")).alias("parent"))
    entries = ends(cut_off).select(*KEY, F.col("node").alias("_tip_node"), F.col("root").alias("_root"))
    gates = forest.where("entry is not null").select(*KEY, F.col("node").alias("_root"), F.col("entry").alias("line"))
    at = gates.join(ring.select(*KEY, "line", F.col("place").alias("_gate")), [*KEY, "line"]).drop("line")
    met = whole.join(entries, [*KEY, "_tip_node"]).join(at, [*KEY, "_root"]).withColumnRenamed("node", "cycle").join(ring, [*KEY, "cycle"])
    step = F.pmod(F.col("_gate") - F.col("place"), F.col("length"))
    return found.join(loops, [*KEY, "node"], "left_anti").unionByName(
        met.select(*KEY, "tip", F.col("line").alias("node"), "_tip_node", (F.col("depth") + step).alias("depth")))
