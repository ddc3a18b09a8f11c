"""Running values inside a session without one task per session.

A session may hold a large share of all rows, so no window here runs over a
whole session. Rows fall into blocks of consecutive lines. A window covers one
block; what the earlier blocks contribute comes from a table with one row per
block, which is thousands of times smaller and the only thing ordered per
session. The two parts meet in a join on (session, block).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_LINES = 1 << 16


@dataclass(frozen=True)
class Running:
    """A running value: ``sum``, ``max`` or ``last`` non-null, up to or strictly before a row."""

    how: str  # "sum" | "max" | "last"
    expr: Column
    before: bool = False


def with_block(df: DataFrame, size: int = BLOCK_LINES, line: str = "line") -> DataFrame:
    return df.withColumn("blk", F.floor(F.col(line) / size))


def running(
    df: DataFrame,
    values: dict[str, Running],
    keys: tuple[str, ...] = ("session_id",),
    order: tuple[str, ...] = ("line",),
    size: int = BLOCK_LINES,
) -> DataFrame:
    """Add running values in line order; ``order[0]`` has to be an integer."""
    group = [*keys, "blk"]
    blocked = with_block(df, size, order[0])
    for name, spec in values.items():
        blocked = blocked.withColumn(f"_{name}_x", spec.expr)
    ordered = Window.partitionBy(*group).orderBy(*order)
    through = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)

    inner, totals = {}, {}
    for name, spec in values.items():
        x = F.col(f"_{name}_x")
        frame = earlier if spec.before else through
        if spec.how == "sum":
            inner[f"_{name}_in"] = F.coalesce(F.sum(x).over(frame), F.lit(0))
            totals[f"_{name}_t"] = F.sum(x)
        elif spec.how == "max":
            inner[f"_{name}_in"] = F.max(x).over(frame)
            totals[f"_{name}_t"] = F.max(x)
        else:
            inner[f"_{name}_in"] = F.last(x, ignorenulls=True).over(frame)
            totals[f"_{name}_t"] = F.max_by(x, F.when(x.isNotNull(), F.struct(*order)))
    per_block = blocked.groupBy(*group).agg(*[c.alias(n) for n, c in totals.items()])
    prior = Window.partitionBy(*keys).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select(
        *group,
        *[
            (
                F.coalesce(F.sum(f"_{name}_t").over(prior), F.lit(0))
                if spec.how == "sum"
                else F.max(f"_{name}_t").over(prior)
                if spec.how == "max"
                else F.last(f"_{name}_t", ignorenulls=True).over(prior)
            ).alias(f"_{name}_c")
            for name, spec in values.items()
        ],
    )
    joined = blocked.select("*", *[c.alias(n) for n, c in inner.items()]).join(carry, group)
    finished = {
        name: (
            F.col(f"_{name}_in") + F.col(f"_{name}_c")
            if spec.how == "sum"
            else F.greatest(f"_{name}_in", f"_{name}_c")
            if spec.how == "max"
            else F.coalesce(f"_{name}_in", f"_{name}_c")
        )
        for name, spec in values.items()
    }
    return joined.select(*df.columns, *[c.alias(n) for n, c in finished.items()])


def numbered(df: DataFrame, name: str = "rn", keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """1-based position in line order within the session."""
    return running(df, {name: Running("sum", F.lit(1).cast("bigint"))}, keys)


def with_session_values(
    df: DataFrame,
    values: dict[str, tuple[str, Column]],
    source: DataFrame | None = None,
    key: str = "session_id",
    size: int = BLOCK_LINES,
) -> DataFrame:
    """Attach per-session aggregates to every row of the session.

    ``values`` maps a name to (``min`` | ``max`` | ``sum``, expression). The
    aggregate is spread over the session's blocks before the join, so the rows
    of a hot session meet it in many tasks. ``source`` is the table to
    aggregate when it is not ``df`` itself; blocks it lacks are still covered.
    """
    functions = {"min": F.min, "max": F.max, "sum": F.sum}
    blocked = with_block(df, size)
    base = with_block(source, size) if source is not None else blocked
    part = base.groupBy(key, "blk").agg(*[functions[how](x).alias(n) for n, (how, x) in values.items()])
    if source is not None:
        part = part.unionByName(blocked.select(key, "blk").distinct(), allowMissingColumns=True)
        part = part.groupBy(key, "blk").agg(*[functions[how](n).alias(n) for n, (how, _) in values.items()])
    whole = Window.partitionBy(key)
    spread = part.select(key, "blk", *[functions[how](n).over(whole).alias(n) for n, (how, _) in values.items()])
    return blocked.join(spread, [key, "blk"]).select(*df.columns, *values)


def first_rows(df: DataFrame, n: int, order: list[Column], keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """First ``n`` rows per key. Each task keeps its own first ``n`` before the exchange."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
