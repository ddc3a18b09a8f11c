"""Merkle manifest of a dataset by slot pivots.

Every row is a leaf. The leaves of a source, in order of doc_id, form one tree: each run of ``fanout`` neighbours
becomes a parent until one node, the subroot, is left. The subroots, in order of source, form the tree of the root.

* Positions come from one range exchange: a row's place in its sorted partition plus the counts of the partitions
  before it, so no source has to fit one task.
* A level is one aggregate by (tree, position div fanout): conditional aggregates put the children of a parent into
  ``fanout`` slot columns. Concatenating the slots and hashing gives the parent; leaving a child's own slot out gives its
  siblings.
* Paths go from the root downwards: the children of a parent get their siblings put before the parent's own path. Levels
  shrink by the fanout, so all levels together move about half as many rows as there are leaves, and the paths of the
  leaves themselves are made in the last join, never stored.

Every level is a stored table, so a lost executor costs at most one level. Digests travel as 32 bytes and are hashed as
hex text.

Defined results: a null value is hashed as ``-``, apart from the empty text (``0:``); a null source is a source of its own
and comes first; a null doc_id comes first in its source; rows that repeat a doc_id are ordered by their leaf, and equal
rows have equal leaves at places of their own; a lone leaf is its subroot, and a lone subroot the root; an empty table gives
an empty result; columns that are not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.session import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.unhex(hashed(F.concat(*map(field, values))))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def numbered(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """``rows`` (a stored table without equal rows) with ``pos``, gapless from 0 in each ``tree`` by ``order``, and ``n``, its rows.

    Null trees are one tree. The offsets have a row for each pair of a tree and a partition that holds some of it.
    """
    sorts = [F.col(c).asc_nulls_first() for c in [tree, *order]]
    dealt = rows.repartitionByRange(*sorts).sortWithinPartitions(*sorts)
    dealt = cut(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), name)
    parts = dealt.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(
        F.col(tree).alias("_tree"), F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(tree)).alias("n"),
    )
    met = dealt.join(shifts, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_p")))
    return met.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).select(*rows.columns, "pos", "n")


def step_over(slots: list[Column], own: Column) -> Column:
    """(left, right): the digests of the other slots, in order, on both sides of slot ``own``."""
    def side(keep) -> Column:
        return F.concat(*[F.when(keep(i), F.coalesce(s, F.lit(b""))).otherwise(F.lit(b"")) for i, s in enumerate(slots)])

    return F.struct(side(lambda i: F.lit(i) < own).alias("left"), side(lambda i: F.lit(i) > own).alias("right"))


def grow(leaves: DataFrame, fanout: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """All levels above ``leaves`` (tree, pos, n, digest), lowest first, and the tops (tree, digest).

    A level has (tree, pos, n, s0, s1, ..., digest); ``n`` counts the nodes below in that tree. A tree that is down to one
    node keeps it: ``n`` is 1 and the digest is slot 0.
    """
    widest = leaves.agg(F.max("n")).first()[0] or 0
    levels, now = [], leaves
    while widest > 1:
        slot = F.col("pos") % fanout
        slots = [F.max(F.when(slot == i, F.col("digest"))).alias(f"s{i}") for i in range(fanout)]
        pivot = now.groupBy("tree", F.floor(F.col("pos") / fanout).alias("pos"), "n").agg(*slots)
        joined = F.concat(*[F.coalesce(hex_of(F.col(f"s{i}")), F.lit("")) for i in range(fanout)])
        pivot = pivot.withColumn("digest", F.when(F.col("n") > 1, F.unhex(hashed(joined))).otherwise(F.col("s0")))
        levels.append(cut(pivot, name))
        now = levels[-1].withColumn("n", F.ceil(F.col("n") / fanout))
        widest = -(-widest // fanout)
    return levels, now.select("tree", "digest")


def descend(levels: list[DataFrame], tops: DataFrame, fanout: int, name: str) -> DataFrame | None:
    """The lowest level with the ``path`` of each of its nodes, given (tree, path) of the tops; None without levels.

    A path lists (left, right) siblings from the node upwards. ``up`` is the position, ``tree`` the tree.
    """
    paths = tops.withColumn("pos", F.lit(0).cast("long"))
    slots = [F.col(f"s{i}") for i in range(fanout)]
    for depth, level in reversed(list(enumerate(levels))):
        met = level.drop("digest").join(paths, ["tree", "pos"])
        if depth == 0:
            return met
        children = F.array(*[F.struct(F.lit(i).alias("slot"), s.alias("digest")) for i, s in enumerate(slots)])
        kids = met.select("tree", "pos", "n", "path", *slots, F.explode(children).alias("kid")).where("kid.digest is not null")
        above = F.when(F.col("n") > 1, F.concat(F.array(step_over(slots, F.col("kid.slot"))), F.col("path"))).otherwise(F.col("path"))
        paths = cut(kids.select("tree", (F.col("pos") * fanout + F.col("kid.slot")).alias("pos"), above.alias("path")), name)
    return None


def fold(leaf_digest: Column, path: Column) -> Column:
    """Hex of the root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, hex_of(leaf_digest), lambda acc, s: hashed(F.concat(hex_of(s["left"]), acc, hex_of(s["right"]))))


def with_paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int, name: str) -> DataFrame:
    """``leaves`` with their ``path``; ``tops`` is (tree, path)."""
    lowest = descend(levels, tops, fanout, name)
    if lowest is None:  # every tree is a lone leaf
        return leaves.join(tops, "tree")
    slots = [F.col(f"s{i}") for i in range(fanout)]
    met = leaves.withColumn("_up", F.floor(F.col("pos") / fanout)).join(
        lowest.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), F.col("path").alias("_path"), *slots),
        (F.col("tree") == F.col("_tree")) & (F.col("_up") == F.col("_pos")),
    )
    path = F.when(F.col("n") > 1, F.concat(F.array(step_over(slots, F.col("pos") % fanout)), F.col("_path"))).otherwise(F.col("_path"))
    return met.select(*leaves.columns, path.alias("path"))


NO_PATH = "cast(array() as array<struct<left: binary, right: binary>>)"


def manifest(docs: DataFrame, changed: Column | None = None, fanout: int = 3) -> DataFrame:
    """(doc_id, source, digest, other, subroot, root, path) for every row of ``docs``, which has the columns ``FIELDS``.

    ``changed`` is a text to verify in place of each row's own; ``other`` is the leaf that it gives. ``path`` has the
    siblings from the leaf to the root, ``root`` and ``subroot`` are hex text, digests are bytes.
    """
    own = [F.col(c) for c in FIELDS]
    other = [F.col(c) for c in FIELDS[:-1]] + [F.col("text") if changed is None else changed]
    rows = docs.select("doc_id", "source", leaf(own).alias("digest"), leaf(other).alias("other")).withColumn("_row", F.monotonically_increasing_id())
    rows = numbered(cut(rows, "leaves"), "source", ["doc_id", "digest", "_row"], "dealt")

    sources = rows.groupBy("source").agg(F.max("n").alias("leaves")).withColumn("forest", F.lit(0))
    sources = cut(numbered(cut(sources, "sources"), "forest", ["source"], "sources").select("source", F.col("pos").alias("tree")), "sources")
    known = sources.select(F.col("source").alias("_source"), "tree")
    leaves = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_row")
    leaves = cut(leaves, "leaves")

    levels, tops = grow(leaves, fanout, "level")
    tops = cut(tops, "subroots")
    forest = tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(tops.count()).cast("long").alias("n"), "digest")
    upper, root = grow(forest, fanout, "level")
    above = with_paths(forest, upper, root.select("tree", F.expr(NO_PATH).alias("path")), fanout, "path")
    above = cut(above.select(F.col("pos").alias("tree"), "path", F.col("digest").alias("subroot")), "path")
    reached = with_paths(leaves, levels, above.select("tree", "path"), fanout, "path")
    named = above.select("tree", hex_of(F.col("subroot")).alias("subroot"), fold(F.col("subroot"), F.col("path")).alias("root"))
    return reached.join(named, "tree").select("doc_id", "source", "digest", "other", "subroot", "root", "path")


def proof(path: Column) -> Column:
    """All siblings of a path as one hex text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(hex_of(s["left"]), hex_of(s["right"]))), "")
