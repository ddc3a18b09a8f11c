"""Mix overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). The small network start ->
pattern -> source -> end is solved on the driver: an arc into a pattern carries its words once per repetition at a
cost that rises with each repetition, an arc out of a source has its quota. As only these arcs cost, the cheapest
maximal flow comes from opening one repetition after the other and augmenting to the maximum each time. The words
routed out of a pattern are then taken from its documents: all of them a whole number of times, and a seeded choice
once more, found by hash order without sorting a pattern in one task.

Defined results: a null source (or a null in the array) is a source of its own, last in order; a document without
any source is never taken; texts without words have size 0 and are never
taken; repeated rows are documents of their own; an empty table
gives an empty result. Only the named columns are read; ``carry`` columns come back under their own names.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.session import cut

WORD = r"[^\x20\x09-\x0D]+"  # fixed value
MAX_PATTERNS = 100_000  # bound of what is planned on the driver and broadcast; more patterns are refused
CHUNK_BITS = 12


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def in_order(sources) -> list[str | None]:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def cycle_weights(sources, weights=(5, 2, 1)) -> dict:
    return {s: float(weights[i % len(weights)]) for i, s in enumerate(in_order(sources))}


def targets(sizes: dict, weights: dict, max_repeats: int) -> dict:
    """Shares of the total of all sizes, none above ``max_repeats`` times its source; excess is shared again."""
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        weight = sum(weights[s] for s in in_order(open_))
        shares = {s: left * weights[s] / weight if weight else 0.0 for s in open_}
        over = [s for s in in_order(open_) if shares[s] > max_repeats * sizes[s]]
        if not over:
            return out | shares
        for s in over:
            out[s] = float(max_repeats * sizes[s])
            left -= out[s]
            open_.discard(s)
    return out


def route(patterns: dict[tuple, int], quotas: dict, max_repeats: int) -> dict[tuple, dict]:
    """Words from each pattern to each source: maximal, and cheapest under convex repetition costs."""
    names = {s: i for i, s in enumerate(quotas)}
    start, end = len(patterns) + len(names), len(patterns) + len(names) + 1
    arcs: list[list[int]] = []  # [to, capacity left]; the reverse of arc i is i ^ 1
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, capacity: int) -> int:
        out[a].append(len(arcs))
        arcs.append([b, capacity])
        out[b].append(len(arcs))
        arcs.append([a, 0])
        return len(arcs) - 2

    total = sum(patterns.values()) * max_repeats
    into, uses = [], []
    for p, (members, _) in enumerate(patterns.items()):
        into.append(arc(start, p, 0))
        uses.append({s: arc(p, len(patterns) + names[s], total) for s in dict.fromkeys(members) if s in names})
    for s, quota in quotas.items():
        arc(len(patterns) + names[s], end, quota)

    def levels() -> list[int]:
        level = [-1] * (end + 1)
        level[start] = 0
        queue = deque([start])
        while queue:
            a = queue.popleft()
            for i in out[a]:
                b, room = arcs[i]
                if room > 0 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def augment(level: list[int], at: list[int]) -> bool:
        """Send words along one path of a level graph."""
        path, node = [], start
        while node != end:
            while at[node] < len(out[node]):
                i = out[node][at[node]]
                if arcs[i][1] > 0 and level[arcs[i][0]] == level[node] + 1:
                    break
                at[node] += 1
            else:
                if not path:
                    return False
                node = arcs[path.pop() ^ 1][0]
                at[node] += 1
                continue
            path.append(i)
            node = arcs[i][0]
        words = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= words
            arcs[i ^ 1][1] += words
        return True

    for _ in range(max_repeats):
        for i, size in zip(into, patterns.values()):
            arcs[i][1] += size
        while (level := levels())[end] >= 0:
            at = [0] * (end + 1)
            while augment(level, at):
                pass
    return {members: {s: arcs[i ^ 1][1] for s, i in use.items()} for members, use in zip(patterns, uses)}


def mix(
    docs: DataFrame, sources: Column, carry: list[str], doc_id: str = "doc_id", text: str = "text",
    weights=cycle_weights, max_repeats: int = 3, seed: int = 0,
) -> tuple[DataFrame, dict, dict]:
    """Take documents so that each source's words come near its target.

    ``sources`` is an array column of memberships; ``weights`` maps the source names to weights. Returns the rows
    (``row`` struct of the carried columns, ``size``, ``copies``), the sizes and the targets by source.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.lit(seed), F.col(doc_id).isNull(), F.col(doc_id), F.col(text))
    # Stored once: sizes are counted once, and the number that tells repeated rows apart stays fixed.
    rows = cut(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.to_json(F.array_sort(F.array_distinct(sources))).alias("pattern"),
        word_count(F.col(text)).alias("size"), order.alias("h"), F.monotonically_increasing_id().alias("uid"),
    ), "mix")
    chunk = F.shiftright("h", 64 - CHUNK_BITS).alias("chunk")
    sums = cut(rows.groupBy("pattern", chunk).agg(F.sum("size").alias("size")), "mix-chunks")
    found = sums.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    found = sorted((r["pattern"], r["size"]) for r in found if r["pattern"] not in (None, "[]"))
    patterns = {tuple(json.loads(p)): size for p, size in found}
    sizes: dict = {}
    for members, size in patterns.items():
        for s in members:
            sizes[s] = sizes.get(s, 0) + size
    sizes = {s: sizes[s] for s in in_order(sizes)}
    goal = targets(sizes, weights(sizes), max_repeats)
    # Overlaps count for every source that holds a document, the total of all sizes only once for each.
    flow = route(patterns, {s: round(goal[s]) for s in sizes}, max_repeats)
    plan = []
    for (name, size), members in zip(found, patterns):
        words = sum(flow[members].values())
        plan.append((name, words // size if size else 0, words % size if size else 0))
    plan = spark.createDataFrame(plan, "pattern string, whole long, rest long")

    # The chunk of hashes in which the rest of a pattern ends, then the place inside this chunk.
    w = Window.partitionBy("pattern").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0))).join(F.broadcast(plan), ["pattern"])
    ends = ends.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size"))).select("pattern", "chunk", "before", "rest")
    inside = rows.select("pattern", "size", "h", "uid", chunk).join(F.broadcast(ends), ["pattern", "chunk"])
    w = Window.partitionBy("pattern").orderBy("h", "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = F.col("so_far") <= F.col("rest")
    low = F.struct(F.shiftleft(F.col("chunk").cast("long"), 64 - CHUNK_BITS).alias("h"), F.lit(-1).cast("long").alias("uid"))
    last = inside.withColumn("so_far", F.col("before") + F.sum("size").over(w)).groupBy("pattern").agg(
        F.coalesce(F.max(F.when(taken, F.struct("h", "uid"))), F.first(low)).alias("last"),
        (F.first("rest") - F.coalesce(F.max(F.when(taken, F.col("so_far"))), F.first("before"))).alias("gap"),
    )
    decided = cut(plan.join(F.broadcast(last), "pattern", "left"), "mix-plan")

    placed = rows.join(F.broadcast(decided.withColumnRenamed("pattern", "p")), F.col("pattern").eqNullSafe(F.col("p")), "left")
    once_more = F.coalesce(F.struct("h", "uid") <= F.col("last"), F.lit(False))
    # One more document whose size is nearest to what is still missing.
    near = F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "h", "uid")
    fill = placed.where(~once_more & (F.abs(F.col("size") - F.col("gap")) < F.col("gap"))).groupBy("pattern").agg(F.min(near)["uid"].alias("fill"))
    fill = fill.withColumnRenamed("pattern", "fp")
    full = placed.join(F.broadcast(fill), F.col("pattern") == F.col("fp"), "left")
    copies = F.coalesce(F.col("whole"), F.lit(0)) + once_more.cast("int") + F.coalesce(F.col("uid") == F.col("fill"), F.lit(False)).cast("int")
    return full.select("row", "size", F.when(F.col("size") > 0, copies).otherwise(0).cast("long").alias("copies")), sizes, goal
