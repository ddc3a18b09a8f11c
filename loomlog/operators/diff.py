"""Differences between two versions of a session.

``a`` and ``b`` have (session_id, line, text). The multiset form (U4) is a pair
of counts per text and scales with the rows. The ordered form (U2) anchors
lines that are unique on both sides, keeps the longest run of anchors in the
same order, and does the same again between the anchors until a stretch has
none; such a stretch is compared from both ends.

All open stretches of all sessions go through the same joins, a round per
level of nesting, on digests of the lines. Anchors that follow each other on
both sides form one *run*, and a longest run of anchors holds whole runs only.
So what has to be ordered for a session are its runs: one more than the places
where lines were moved, not its lines.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.operators.ordered import Running, running
from loomlog.session import cut, ship_by_value

ship_by_value(__name__)

KEYS = ("session_id", "stretch")
RUN_BLOCK = 1 << 16  # runs of a stretch that are piled at a time
PILED = pa.schema([("session_id", pa.string()), *((c, pa.int64()) for c in ("stretch", "run", "pred", "best", "end"))])


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """U4: (session_id, text, kind, n): how often a text is equal, deleted, inserted."""
    sides = a.select("session_id", "text", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(
        b.select("session_id", "text", F.lit(0).alias("x"), F.lit(1).alias("y")))
    counts = sides.groupBy("session_id", "text").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    kinds = F.explode(F.array(
        F.struct(F.lit("equal").alias("kind"), F.least("x", "y").alias("n")),
        F.struct(F.lit("delete").alias("kind"), F.greatest(F.col("x") - F.col("y"), F.lit(0)).alias("n")),
        F.struct(F.lit("insert").alias("kind"), F.greatest(F.col("y") - F.col("x"), F.lit(0)).alias("n")),
    ))
    return counts.select("session_id", "text", kinds.alias("k")).select("session_id", "text", "k.*").where("n > 0")


def summary(ops: DataFrame, n: str | None = None) -> DataFrame:
    """Operations per kind, zero-filled."""
    weight = F.lit(1) if n is None else F.col(n)
    total = lambda kind: F.sum(F.when(F.col("kind") == kind, weight).otherwise(0)).cast("bigint").alias(kind)
    return ops.groupBy("session_id").agg(total("equal"), total("insert"), total("delete"))


def _single(df: DataFrame, name: str) -> DataFrame:
    """Lines whose digest occurs once in their stretch."""
    return df.groupBy(*KEYS, "h").agg(F.count(F.lit(1)).alias("_n"), F.min("line").alias(name)).where("_n = 1").drop("_n")


def _pile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heaviest chains that end in the next block of each stretch's runs, given the piles' tops so far.

    A top is a run's last place in ``b``, the weight of the heaviest chain that ends there, and the run; tops rise in
    both. Rows come stretch by stretch, first the tops, rising, then the runs in order. Returns the runs with their
    predecessor and chain weight, and the new tops. A task takes its stretches one after the other and holds one's tops.
    """
    key, grown, ends, bests, ids = None, False, [], [], []

    def tops() -> list[tuple]:
        return [(*key, run, None, best, end) for run, best, end in zip(ids, bests, ends)] if grown else []

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(PILED)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PILED.types)], schema=PILED)

    for batch in batches:
        out = []
        for session, stretch, run, y, weight, best, end in zip(*(batch.column(c).to_pylist() for c in ("session_id", "stretch", "run", "y", "weight", "best", "end"))):
            if (session, stretch) != key:
                out += tops()
                key, grown, ends, bests, ids = (session, stretch), False, [], [], []
            if end is not None:
                ends.append(end), bests.append(best), ids.append(run)
                continue
            grown = True
            at = bisect_left(ends, y)
            best = weight + (bests[at - 1] if at else 0)
            out.append((*key, run, ids[at - 1] if at else None, best, None))
            over = at
            while over < len(ends) and bests[over] <= best:
                over += 1
            ends[at:over], bests[at:over], ids[at:over] = [y + weight - 1], [best], [run]
        yield made(out)
    yield made(tops())


def longest_run(anchors: DataFrame, block: int = RUN_BLOCK) -> DataFrame:
    """Of ``anchors`` (session_id, stretch, a_line, b_line) a longest run that rises on both sides, in each stretch.

    Among equally long ones it is that of patience sorting: the last anchor of the last pile, then always the latest
    anchor on the pile before. Stretches whose anchors all rise are done at once.
    """
    lagged = cut(running(anchors, {"_prev": Running("last", F.col("b_line"), before=True)}, KEYS, ("a_line",)))
    moved = cut(lagged.where("b_line < _prev").select(*KEYS).distinct())
    columns = [*KEYS, "a_line", "b_line"]
    if moved.isEmpty():
        return lagged.select(columns)
    rising = lagged.join(moved, [*KEYS], "left_anti").select(columns)
    return rising.unionByName(_piled(lagged.join(moved, [*KEYS], "left_semi").select(columns), block))


def _piled(anchors: DataFrame, block: int) -> DataFrame:
    one = F.lit(1).cast("bigint")
    ranked = running(anchors, {"x": Running("sum", one)}, KEYS, ("a_line",))
    ranked = cut(running(ranked, {"y": Running("sum", one)}, KEYS, ("b_line",)))
    lagged = running(ranked, {"_shift": Running("last", F.col("y") - F.col("x"), before=True)}, KEYS, ("x",))
    breaks = F.col("_shift").isNull() | (F.col("_shift") != F.col("y") - F.col("x"))
    placed = cut(running(lagged, {"run": Running("last", F.when(breaks, F.col("x")))}, KEYS, ("x",)).drop("_shift"))
    runs = placed.groupBy(*KEYS, "run").agg(F.min("y").alias("y"), F.count(F.lit(1)).alias("weight"))
    runs = cut(running(runs, {"place": Running("sum", one)}, KEYS, ("run",)).withColumn("part", F.floor((F.col("place") - 1) / block)))

    schema = "session_id string, stretch bigint, run bigint, pred bigint, best bigint, end bigint"
    none = F.lit(None).cast("bigint")
    tops = anchors.sparkSession.createDataFrame([], schema)
    piled = []
    for part in range((runs.agg(F.max("part")).first()[0] or 0) + 1):
        rows = runs.where(F.col("part") == part).select(*KEYS, "run", "y", "weight", none.alias("best"), none.alias("end")).unionByName(
            tops.select(*KEYS, "run", none.alias("y"), none.alias("weight"), "best", "end"))
        rows = rows.repartition(*KEYS).sortWithinPartitions(*KEYS, F.col("end").isNull(), F.coalesce("end", "run"))
        now = cut(rows.mapInArrow(_pile, schema))
        tops = now.where("end is not null")
        piled.append(now.where("end is null").drop("end"))
    chains = piled[0]
    for more in piled[1:]:
        chains = chains.unionByName(more)

    chosen = cut(chains.groupBy(*KEYS).agg(F.max(F.struct("best", "run")).alias("x")).select(*KEYS, F.col("x.run").alias("run")))
    jumps = cut(chains.where("pred is not null").select(*KEYS, "run", "pred"))
    known = chosen.count()
    while True:  # twice as far in every round
        step = chosen.join(jumps, [*KEYS, "run"]).select(*KEYS, F.col("pred").alias("run"))
        chosen = cut(chosen.unionByName(step).distinct())
        count = chosen.count()
        if count == known:
            return placed.join(chosen, [*KEYS, "run"], "left_semi").select(*KEYS, "a_line", "b_line")
        known = count
        onward = jumps.select(*KEYS, F.col("run").alias("pred"), F.col("pred").alias("far"))
        jumps = cut(jumps.join(onward, [*KEYS, "pred"]).select(*KEYS, "run", F.col("far").alias("pred")))


def _between(rows: DataFrame, chosen: DataFrame, line: str) -> DataFrame:
    """The lines between anchors; a stretch is named by the ``a_line`` of the anchor before it."""
    anchors = chosen.select(*KEYS, F.col(line).alias("line"), F.col("a_line").alias("_at"))
    marked = rows.join(anchors, [*KEYS, "line"], "left")
    spread = running(marked, {"_last": Running("last", F.col("_at"))}, KEYS)
    return spread.where("_at is null").select("session_id", F.coalesce("_last", "stretch").alias("stretch"), "line", "h")


def _from_both_ends(a: DataFrame, b: DataFrame) -> DataFrame:
    """Equal lines at the start and the end of each stretch; what is left of ``a`` is deleted, of ``b`` inserted."""
    one = F.lit(1).cast("bigint")
    sides = a.select(*KEYS, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*KEYS, F.lit(0).alias("x"), F.lit(1).alias("y")))
    sizes = cut(sides.groupBy(*KEYS).agg(F.sum("x").alias("na"), F.sum("y").alias("nb")))
    left = cut(running(a, {"i": Running("sum", one)}, KEYS).join(sizes, [*KEYS]))
    right = cut(running(b, {"i": Running("sum", one)}, KEYS).join(sizes, [*KEYS]))
    other = right.select(*KEYS, "i", F.col("line").alias("b_line"), F.col("h").alias("bh"), (F.col("nb") - F.col("i")).alias("back"))
    own = left.withColumn("back", F.col("na") - F.col("i"))
    differ = F.col("h") != F.col("bh")
    fore = own.drop("back").join(other.drop("back"), [*KEYS, "i"]).where(differ).groupBy(*KEYS).agg(F.min("i").alias("fore"))
    rear = own.drop("i").join(other.drop("i"), [*KEYS, "back"]).where(differ).groupBy(*KEYS).agg(F.min("back").alias("rear"))
    least = F.least("na", "nb")
    bounds = sizes.join(fore, [*KEYS], "left").join(rear, [*KEYS], "left").withColumn("prefix", F.coalesce(F.col("fore") - 1, least))
    bounds = bounds.select(*KEYS, "prefix", F.least(F.coalesce("rear", least), least - F.col("prefix")).alias("suffix"))
    bounds = cut(bounds)

    i, na, nb, prefix, suffix = (F.col(c) for c in ("i", "na", "nb", "prefix", "suffix"))
    rows = left.join(bounds, [*KEYS])
    place = F.when(i <= prefix, i).when(i > na - suffix, i - na + nb)
    met = rows.withColumn("j", place).join(other.select(*KEYS, F.col("i").alias("j"), "b_line"), [*KEYS, "j"], "left")
    k = F.when(i > na - suffix, i + nb - prefix - suffix).otherwise(i)
    ops = met.select(*KEYS, k.alias("k"), F.when(F.col("j").isNull(), "delete").otherwise("equal").alias("kind"), F.col("line").alias("a_line"), "b_line")
    new = right.join(bounds, [*KEYS]).where((i > prefix) & (i <= nb - suffix))
    return ops.unionByName(new.select(
        *KEYS, (na - suffix + i - prefix).alias("k"), F.lit("insert").alias("kind"), F.lit(None).cast("bigint").alias("a_line"), F.col("line").alias("b_line")))


def ordered_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(session_id, stretch, k, kind, a_line, b_line, text), in order of (stretch, k).

    Lines are compared by digest; a null text is like an empty one.
    """
    # Plain copies under fresh names, so that one side may be derived from the other.
    a, b = (df.toDF(*df.columns).select("session_id", F.col("line").cast("bigint").alias("line"), "text") for df in (a, b))
    digest = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    open_a, open_b = (cut(df.select("session_id", F.lit(0).cast("bigint").alias("stretch"), "line", digest.alias("h"))) for df in (a, b))
    equal, last_a, last_b = [], [], []
    while True:
        anchors = cut(_single(open_a, "a_line").join(_single(open_b, "b_line"), [*KEYS, "h"]).drop("h"))
        if anchors.isEmpty():
            break
        chosen = cut(longest_run(anchors))
        equal.append(chosen.select(
            "session_id", F.col("a_line").alias("stretch"), F.lit(0).cast("bigint").alias("k"), F.lit("equal").alias("kind"), "a_line", "b_line"))
        hit = cut(chosen.select(*KEYS).distinct())
        last_a.append(open_a.join(hit, [*KEYS], "left_anti"))
        last_b.append(open_b.join(hit, [*KEYS], "left_anti"))
        open_a = cut(_between(open_a.join(hit, [*KEYS], "left_semi"), chosen, "a_line"))
        open_b = cut(_between(open_b.join(hit, [*KEYS], "left_semi"), chosen, "b_line"))
    for more in last_a:
        open_a = open_a.unionByName(more)
    for more in last_b:
        open_b = open_b.unionByName(more)
    ops = _from_both_ends(cut(open_a), cut(open_b))
    for more in equal:
        ops = ops.unionByName(more)
    texts = lambda df, line: df.select("session_id", F.col("line").alias(line), "text")
    old = ops.where("a_line is not null").join(texts(a, "a_line"), ["session_id", "a_line"])
    new = ops.where("a_line is null").join(texts(b, "b_line"), ["session_id", "b_line"])
    columns = ["session_id", "stretch", "k", "kind", "a_line", "b_line", "text"]
    return old.select(columns).unionByName(new.select(columns))
