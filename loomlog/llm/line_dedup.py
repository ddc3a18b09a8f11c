"""Lines found in many documents: explode, hash, count documents per hash, drop, reassemble by position.

DataFrame functions only. A document is a row. Within a row repeated keys count once, before anything is shuffled, so
a line of a third of all documents costs one counter per map task. Texts move once, to meet the positions to drop.

Defined results: null or empty text is one empty line; empty keys are never dropped while ``min_chars`` is 1 or more;
repeated rows are documents of their own and are treated alike; an empty table gives an empty result; extra columns
keep their values, also when they carry names such as ``pos`` or ``key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.session import cut

SPACE = " \t\n\x0b\x0c\r"  # fixed value: \x20 \x09-\x0D
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without outer white space, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(*values: Column) -> tuple[Column, Column]:
    """128 bits in two columns: the same values under two seeds."""
    return F.xxhash64(F.lit(1), *values), F.xxhash64(F.lit(2), *values)


def drop_common_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``docs`` with the text kept, and columns ``n_lines`` and ``n_dropped`` (long) instead of earlier ones so named.

    Keys of ``min_chars`` code points or more found in ``min_docs`` documents or more lose all their lines. The text
    becomes the other lines joined by newlines; a null text becomes the empty text.
    """
    rest = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    # Values of the caller stay in one struct, so no name of theirs meets a name in here.
    kept = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")
    row_hash = _hashes(F.col(doc_id).isNull(), F.col(doc_id), F.coalesce(F.col(text), F.lit("")))
    base = docs.select(kept, F.coalesce(F.col(text), F.lit("")).alias("text"), row_hash[0].alias("d1"), row_hash[1].alias("d2"))

    def hashed(frame: DataFrame, *more: str) -> DataFrame:
        key = line_key(F.col("line"))
        k1, k2 = _hashes(key)
        return frame.where(F.char_length(key) >= min_chars).select(*more, k1.alias("k1"), k2.alias("k2"))

    keys = base.select(F.explode(F.array_distinct(F.transform(text_lines(F.col("text")), line_key))).alias("line"))
    common = hashed(keys).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).drop("n")
    # Stored, so its size is known: Spark broadcasts it if it is small, and else can split the hot keys of the join.
    common = cut(common, "common-lines")
    lines = hashed(base.select("d1", "d2", F.posexplode(text_lines(F.col("text"))).alias("pos", "line")), "d1", "d2", "pos")
    # Repeated rows share their hashes and their positions; the set holds each position once.
    dropped = lines.join(common, ["k1", "k2"], "left_semi").groupBy("d1", "d2").agg(F.sort_array(F.collect_set("pos")).alias("drop"))

    joined = base.join(dropped.hint("shuffle_hash"), ["d1", "d2"], "left")
    all_lines, n = text_lines(F.col("text")), F.size(text_lines(F.col("text")))
    # The stretches between dropped positions, each a slice: linear in the lines, however many are dropped.
    after = F.concat(F.array(F.lit(-1)), F.col("drop"))
    until = F.concat(F.col("drop"), F.array(n))
    parts = F.zip_with(after, until, lambda a, b: F.slice(F.col("lines"), a + 2, b - a - 1))
    shaped = joined.withColumn("lines", all_lines).select(
        "row", n.cast("long").alias("n_lines"), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(parts), "\n")).alias("text"),
    )
    # Back in the caller's order of columns.
    columns = [F.col("text").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return shaped.select(*columns, "n_lines", "n_dropped")
