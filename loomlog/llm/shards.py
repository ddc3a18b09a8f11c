"""Hierarchical weighted hash tree: region, rack and shard levels, one weighted draw per level.

A key descends from the root. At every level each child draws ``-ln(u) / weight`` with ``u`` a hash of (seed, level,
child, key); the smallest draw wins, so a child wins in proportion to its weight and a change of weights only moves
keys into children whose share grew. Confinement: keys under subtrees whose weights do not change, and which lose
nothing to a grown sibling, stay. A shard opened in a region of its own takes keys only into itself; one opened in
an existing rack also moves keys between the subtrees whose summed weights changed.

Defined results: a null key is a key like any other; repeated rows get the same shard and different slots; an empty
table gives an empty result; columns that are not named in the call are ignored, whatever they are called.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.session import cut


class Shard(NamedTuple):
    """A leaf of the tree."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(n_shards: int, per_rack: int = 5, racks_per_region: int = 2) -> list[Shard]:
    """``n_shards`` leaves of weight 1, filled rack by rack and region by region."""
    return [Shard(s // (per_rack * racks_per_region), s // per_rack, s) for s in range(n_shards)]


def _levels(tree: list[Shard]) -> list[list[list[tuple[int, float]]]]:
    """For each level, by index of the parent in that level's order: its children as (id, weight)."""
    live = [x for x in tree if x.weight > 0]
    if not live:
        raise ValueError("the tree needs a shard with a positive weight")
    if len({x.shard for x in live}) < len(live):
        raise ValueError("a shard stands twice in the tree")

    def summed(ids):
        out: dict[int, float] = {}
        for x, i in zip(live, ids):
            out[i] = out.get(i, 0.0) + x.weight
        return sorted(out.items())

    regions = summed([x.region for x in live])
    racks = [[(i, w) for i, w in summed([x.rack for x in live]) if any(x.rack == i and x.region == r for x in live)] for r, _ in regions]
    shards = [[(x.shard, x.weight) for x in sorted(live, key=lambda x: x.shard) if x.rack == k] for group in racks for k, _ in group]
    return [[regions], racks, shards]


def _uniform(key: Column, level: str, child: Column, seed: int) -> Column:
    """A number in (0, 1) with 52 bits of an MD5 hash."""
    text = F.concat_ws("|", F.lit(f"{seed}|{level}"), child.cast("string"), key)
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def shard_of(key: Column, tree: list[Shard], seed: int = 0) -> Column:
    """The shard of a key as an int column. ``key`` is cast to string; null counts as a key of its own.

    The tree travels as one constant array per level, indexed by the parent's place, so the cost of a row is the
    fan-out of three nodes, not the number of shards.
    """
    key = F.coalesce(key.cast("string"), F.lit("null"))
    regions, racks, shards = _levels(tree)

    def draw(groups, parent: Column, level: str) -> Column:
        """Struct (draw, id, at) of the winner; at: the child's place among all children of its level."""
        at, literal = 0, []
        for group in groups:
            row = []
            for i, weight in group:
                row.append(F.struct(F.lit(int(i)).alias("id"), F.lit(float(weight)).alias("weight"), F.lit(at).alias("at")))
                at += 1
            literal.append(F.array(*row))
        children = F.element_at(F.array(*literal), parent + 1)
        return F.array_min(F.transform(children, lambda c: F.struct(
            (-F.ln(_uniform(key, level, c["id"], seed)) / c["weight"]).alias("draw"), c["id"].alias("id"), c["at"].alias("at"),
        )))

    region = draw(regions, F.lit(0), "region")
    rack = draw(racks, region["at"], "rack")
    return draw(shards, rack["at"], "shard")["id"].cast("int")


def number_slots(rows: DataFrame, shard: str, chunk: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within each shard, without a task per shard.

    ``chunk`` splits a shard evenly (a hash). Rows are numbered inside (shard, chunk); offsets come from the table of
    chunk counts. Both sides of the join are dealt by (shard, chunk), so the rows move once.
    """
    counts = rows.groupBy(shard, chunk).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(shard).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, chunk, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(shard, chunk).orderBy(*order)) - 1
    numbered = rows.withColumn("_inside", inside)
    return numbered.join(offsets, [shard, chunk]).withColumn(slot, (F.col("_offset") + F.col("_inside")).cast("long")).drop("_offset", "_inside")


def place(
    docs: DataFrame, tree: list[Shard], grown: list[Shard] | None = None, doc_id: str = "doc_id", text: str = "text",
    seed: int = 0,
) -> DataFrame:
    """Place every document: doc_id, size (UTF-8 bytes plus 16), text_crc32, shard, slot, grown_shard.

    A null text has no bytes and the checksum of the empty text. Slots follow a hash of the row, then its values.
    """
    content = F.coalesce(F.encode(F.col(text), "UTF-8"), F.encode(F.lit(""), "UTF-8"))
    key = F.col(doc_id)
    rows = docs.select(
        key.alias("doc_id"), (F.octet_length(content) + 16).cast("long").alias("size"), F.crc32(content).alias("text_crc32"),
        shard_of(key, tree, seed).alias("shard"),
        (shard_of(key, grown, seed) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    ).withColumn("_chunk", F.substring(F.md5(F.concat_ws(
        "|", F.lit("slot"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32"), F.col("size"),
    )), 1, 3))
    stored = cut(rows, "shards")
    return number_slots(stored, "shard", "_chunk", ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", "shard", "slot", "grown_shard",
    )
