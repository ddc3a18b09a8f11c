"""Shared pieces of the rewrites: result type, rendering, numbering, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.edits import apply_edits, no_edits
from loomlog.functions.specs import Amount
from loomlog.operators.ordered import Running, running, with_session_values

LINE_COLUMNS = ("session_id", "line", "sub", "raw")


@dataclass(frozen=True)
class Rewrite:
    """Result of a transform.

    ``lines``: (session_id, line, sub, raw) in the input's numbering; inserted
    rows share a line with their anchor and have a non-zero ``sub``.
    ``changes``: (session_id, kind, line, reason), kind being delete_line,
    update_line or insert_after.
    """

    lines: DataFrame
    changes: DataFrame


def change(df: DataFrame, kind: str, reason: str | Column, line: Column | None = None) -> DataFrame:
    return df.select(
        "session_id", F.lit(kind).alias("kind"), (F.col("line") if line is None else line).cast("bigint").alias("line"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
    )


def no_changes(df: DataFrame) -> DataFrame:
    return change(df.where(F.lit(False)), "update_line", "")


def editable(rows: DataFrame) -> DataFrame:
    return rows.withColumn("edits", no_edits()).withColumn("others", F.array().cast("array<string>"))


def add_edit(rows: DataFrame, condition: Column, step: Column) -> DataFrame:
    return rows.withColumn(
        "edits", F.when(F.coalesce(condition, F.lit(False)), F.concat("edits", F.array(step))).otherwise(F.col("edits")))


def render(rows: DataFrame) -> DataFrame:
    """Apply the planned edits. Only edited rows go through Python."""
    plain = rows.where(F.size("edits") == 0).select("session_id", "line", F.lit(0).alias("sub"), "raw")
    edited = rows.where(F.size("edits") > 0).select(
        "session_id", "line", F.lit(0).alias("sub"),
        apply_edits(F.col("raw"), F.col("edits"), F.col("others")).alias("raw"),
    )
    return plain.unionByName(edited)


def renumber(lines: DataFrame) -> DataFrame:
    """Dense 1-based lines in output order, ready to be parsed again."""
    placed = running(lines, {"_n": Running("sum", F.lit(1).cast("bigint"))}, order=("line", "sub"))
    return placed.select("session_id", F.col("_n").alias("line"), "raw")


def split_touched(rows: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the sessions with a selected line, and the rows of all others."""
    flagged = with_session_values(
        rows, {"_hit": ("max", F.col("line"))}, source=selected.select("session_id", "line"))
    return flagged.where("_hit is not null").drop("_hit"), flagged.where("_hit is null").drop("_hit")


def first_n(rows: DataFrame, amount: Amount, keep_last: bool = False, order: str = "line", cap: bool = False) -> DataFrame:
    """X7/X13 selection: the oldest rows of each session, as (session_id, line).

    ``keep_last`` keeps that many newest rows and needs a count.
    """
    if keep_last and amount.kind != "count":
        raise ValueError("keep_last needs a whole count, not a percentage")
    named = rows.select("session_id", F.col("line").alias("_line"), F.col(order).alias("line"))
    placed = running(named, {"rn": Running("sum", F.lit(1).cast("bigint"))})
    total = with_session_values(placed, {"n": ("max", F.col("rn"))})
    if keep_last:
        take = F.greatest(F.col("n") - F.lit(int(amount.value)), F.lit(0))
    else:
        take = amount.take(F.col("n"))
    return total.where(F.col("rn") <= take).select("session_id", F.col("_line").alias("line"))


def change_report(changes: DataFrame, limit: int) -> DataFrame:
    """K2: per session the first ``limit`` edits in line order and a count of the rest."""
    placed = running(
        changes.withColumn("_o", F.xxhash64("kind", "reason")), {"rn": Running("sum", F.lit(1).cast("bigint"))},
        order=("line", "_o"),
    )
    shown = placed.where(F.col("rn") <= limit).select(
        "session_id", F.col("rn").alias("pos"),
        F.concat(F.lit("- "), F.col("kind"), F.lit(" line="), F.col("line").cast("string"), F.lit(": "), F.col("reason")).alias("text"),
    )
    rest = changes.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(
        "session_id", F.lit(limit + 1).cast("bigint").alias("pos"),
        F.concat(F.lit("- … ("), (F.col("n") - limit).cast("string"), F.lit(" more)")).alias("text"),
    )
    return shown.unionByName(rest)
