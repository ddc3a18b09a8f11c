"""Near-duplicates by bottom-k sketches.

A document is its set of distinct word shingles, each a 64-bit hash. One hash function is all there is: the sketch of
a set is its ``SKETCH`` smallest hashes, or the whole set if it has no more.

* Rows with equal sets are one node from the start.
* Inverted lists of the retained values generate overlaps. A value in more than ``frequent`` sketches is frequent. Of two
  sets that link, at most ``differing(n)`` retained values of each are not retained by the other, so a set with more rare
  values than that (*light*) is listed under its first ``differing(n) + 1`` rare ones only, and is found by any set it links
  with. A set with fewer (*heavy*; nearly all of it is common text, as in large groups of copies) is listed under all its
  rare values and under its triples of neighbouring values: two heavy sets that link hold three values in a row in both
  sketches, and sets that only share a passage seldom do.
* In a list each set is first compared with one centre; linked sets become components, and only sets of different
  components in one list are compared after that. A group of near copies costs about as many pairs as it has members.
* Sizes and the parities of counts by hash class rule out most pairs for certain. Of the rest the similarity is estimated on
  the sketch of the union: of its ``SKETCH`` smallest values, those retained by both. What the estimate leaves is decided on
  whole sets.

What the sketches may miss follows from Chernoff's bound (which holds for draws without replacement): a pair at the
threshold is lost with a probability below ``RISK``, 1e-12. Sets no larger than the sketch are compared exactly: if
linked, they share more than two values for every value that parts them, so three in a row.

Results do not depend on ``frequent``; it steers the work. Value classes travel as bitmaps of fixed size, whose wrong bits
cost work and no links. Heavy sets that are unlike and yet share triples are compared pair by pair, by parities, inside
the join: the costly case.

Defined results: null, empty and white-space texts have no shingles and link with nothing; a text with fewer words than
a shingle is one shingle; rows are linked by their texts, whatever their ids: rows that repeat a doc_id may be in
different components, and rows with a null doc_id link like others; a component is named by its smallest doc_id that
is not null, or null; ``kept`` marks the rows whose doc_id is that name (null-safe, so a row without an id stays
unless a row with one stands for it); an empty table gives an empty result; columns that are not named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.batches import hand_back, slices
from loomlog.llm.jaccard import (
    SLICE_BYTES, Shingler, components, digest, marked, memberships, mix64, named, parities, parities_allow, sizes_allow, token_classes, verified,
)
from loomlog.session import cut, ship_by_value

ship_by_value(__name__)

SKETCH = 128
FREQUENT = 16
RISK = 1e-12


def most_differing(m: int, percent: int, risk: float = RISK) -> int:
    """The least d so that more than d of m draws differ with a probability of at most ``risk``, at this similarity."""
    p = 1 - percent / 100
    for d in range(math.ceil(m * p), m):
        x = (d + 1) / m
        bound = x * math.log(x / p) + ((1 - x) * math.log((1 - x) / (1 - p)) if x < 1 else 0)
        if m * bound >= -math.log(risk):
            return d
    return m


def differing(n: int, size: int, percent: int) -> int:
    """How many retained values of a set of ``n`` a set that it links with may lack."""
    whole = 100 * n <= percent * size  # partners are no larger than the sketch either
    return n + (-percent * n // 100) if whole else most_differing(size, percent)


def sketches(docs: DataFrame, words: int, size: int, doc_id: str, text: str) -> DataFrame:
    """(rid, doc_id, n, node, mark, lead, parity) of every row: number, set size, digest of the set, hash of the text,
    smallest hashes, parities."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                sets = shingler.sets(part.column("text"))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array(map(digest, sets), pa.binary()), part.column("mark"),
                    pa.array([s[:size].tobytes() for s in sets], pa.binary()), pa.array(map(parities, sets), pa.list_(pa.int64())),
                ], ["doc_id", "n", "node", "mark", "lead", "parity"])
        hand_back()

    found = rows.mapInArrow(run, f"doc_id {kind}, n int, node binary, mark bigint, lead binary, parity array<bigint>")
    return found.withColumn("rid", F.monotonically_increasing_id())


def inverted(sets: DataFrame, size: int, percent: int, classes) -> DataFrame:
    """(value, heavy, rep, n): the lists in which sets are looked for; ``heavy`` marks those of triples."""
    most = most_differing(size, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared_bits, often_bits, bits = classes.value
        for batch in batches:
            found: list[tuple] = []
            sizes = batch.column("n").to_pylist()
            for i, blob in enumerate(batch.column("lead")):
                n, values = sizes[i], np.frombuffer(blob.as_buffer(), np.uint64)
                shared, often = marked(shared_bits, values, bits), marked(often_bits, values, bits)
                rare = np.flatnonzero(~often)
                lacks = differing(n, size, percent) if 100 * n <= percent * size else most
                light = len(rare) > lacks
                if light:
                    rare = rare[: lacks + 1]
                found.append((values[rare[shared[rare]]], i, False))
                if not light and len(values) > 2:
                    first = np.flatnonzero(shared[:-2] & shared[1:-1] & shared[2:])
                    with np.errstate(over="ignore"):
                        pair = mix64(values[first] * np.uint64(0x589965CC75374CC3) + values[first + 1])
                        found.append((mix64(pair * np.uint64(0x8EBC6AF09C88C6E3) + values[first + 2]), i, True))
            lengths = [len(x[0]) for x in found]
            if sum(lengths):
                at = pa.array(np.repeat([x[1] for x in found], lengths))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([x[0] for x in found]).view(np.int64)), pa.array(np.repeat([x[2] for x in found], lengths)),
                    batch.column("rep").take(at), batch.column("n").take(at),
                ], ["value", "heavy", "rep", "n"])
        hand_back()

    return sets.select("lead", "rep", "n").mapInArrow(run, "value bigint, heavy boolean, rep bigint, n int")


def star_pairs(index: DataFrame, percent: int) -> DataFrame:
    """Each set of a list with the list's first set."""
    centres = index.groupBy("value", "heavy").agg(F.min(F.struct("rep", "n")).alias("c"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    x, c = index.alias("x"), centres.select("value", "heavy", "c.rep", "c.n").alias("c")
    met = x.join(c, ["value", "heavy"]).where((F.col("x.rep") != F.col("c.rep")) & sizes_allow("x", "c", percent))
    return met.select(F.least("x.rep", "c.rep").alias("a"), F.greatest("x.rep", "c.rep").alias("b")).distinct()


def cross_pairs(index: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The sets of different components in one list; ``found`` has (node, root), ``sets`` (rep, parity)."""
    rows = index.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rows = cut(rows, "rooted")
    mixed = rows.groupBy("value", "heavy").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("value", "heavy")
    rows = cut(rows.join(mixed, ["value", "heavy"], "left_semi").join(sets.select("rep", "parity"), "rep"), "mixed")
    x, y = rows.alias("x"), rows.alias("y")
    apart = (F.col("x.value") == F.col("y.value")) & (F.col("x.heavy") == F.col("y.heavy")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.root") != F.col("y.root"))
    met = x.join(y, apart & sizes_allow("x", "y", percent) & parities_allow("x", "y", percent))
    return met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def passing(pairs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that neither parities nor the estimate on the sketch of their union rule out."""
    few = sets.select("rep", "n", "parity")
    near = pairs.join(few.alias("x"), F.col("a") == F.col("x.rep")).join(few.alias("y"), F.col("b") == F.col("y.rep"))
    near = cut(near.where(parities_allow("x", "y", percent)).select("a", "b", F.col("x.n").alias("xn"), F.col("y.n").alias("yn")), "near")
    blobs = sets.select("rep", "lead")
    met = near.join(blobs.select(F.col("rep").alias("a"), F.col("lead").alias("x")), "a").join(blobs.select(F.col("rep").alias("b"), F.col("lead").alias("y")), "b")
    most = most_differing(size, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(batch.column("xn").to_pylist(), batch.column("yn").to_pylist(), batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.intersect1d(x, y, assume_unique=True)
                if n <= size and m <= size:
                    keep.append(100 * len(both) >= percent * (n + m - len(both)))
                else:
                    union = np.union1d(x, y)[:size]
                    keep.append(size - int(np.searchsorted(both, union[-1], "right")) <= most)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        hand_back()

    return met.select("a", "b", "xn", "yn", "x", "y").mapInArrow(run, "a bigint, b bigint")


def link(
    docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", size: int = SKETCH, frequent: int = FREQUENT,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    prints = cut(sketches(docs, words, size, doc_id, text), "sketches")
    filled = prints.where("n > 0")
    copied = filled.groupBy("node").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("node", "rep")
    copied = cut(copied, "copied")
    others = cut(filled.select("rid", "node").join(copied, "node").where("rid <> rep").select("rid"), "others")
    sets = filled.join(others, "rid", "left_anti").withColumnRenamed("rid", "rep")
    total = sets.agg(F.sum(F.length("lead"))).first()[0] or 0
    classes = docs.sparkSession.sparkContext.broadcast(token_classes(sets, frequent, total // 8))
    index = cut(inverted(sets, size, percent, classes), "inverted")
    classes.destroy()

    def verify(pairs: DataFrame) -> DataFrame:
        return verified(passing(pairs, sets, size, percent), sets.select("rep", "node", "mark"), docs, words, percent, text)

    found = cut(components(verify(star_pairs(index, percent))), "components")
    crossing = cut(cross_pairs(index, found, sets, percent), "crossing")
    if not crossing.isEmpty() and not (more := verify(crossing)).isEmpty():
        found = cut(components(found.select(F.col("root").alias("a"), F.col("node").alias("b")).union(more)), "components")
    rows = named(memberships(prints, copied, found))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
