"""N-gram Jaccard join with token-combination prefixes.

A document is its set of distinct word shingles, each a 64-bit hash; two documents link when 100 * intersection >=
percent * union. Documents with equal sets are one node from the start. The join of the nodes is exact:

* Order the tokens of a set by hash. ``slack(n)`` bounds how many tokens two linked sets can differ in, ``prefix(n)``
  is the usual prefix length. A set keeps an extended prefix of ``lead(n) >= 2 * slack(n) + 2`` tokens.
* Tokens found in more than ``frequent`` extended prefixes form the frequent class. With the rare tokens ordered
  first, a *light* set has its whole prefix among its rare tokens and is indexed by these single tokens. Two linked
  light sets share one of them, and a rare token has few sets.
* A *heavy* set has too few rare tokens. If it links with any set, both hold two frequent tokens in their first
  2 * slack + 2 tokens, and some two tokens stand side by side in both: of the shared tokens there, every token that is
  not shared can part one pair, and there is at least one pair more. Sets with two frequent tokens are therefore also
  indexed by the combinations of neighbours; only pairs with a heavy set are looked for there.
* Candidates must pass the size bound and a parity bound: of the parities of token counts by hash class, never more
  differ than tokens differ. What remains is verified on whole sets.

In a combination with many sets no pairs are made at first: each set is compared with one heavy set, linked sets are
joined into components, and only pairs of different components follow.

Class membership travels as bitmaps of fixed size. A wrong bit can only make a rare token frequent or keep a token
that is in one set alone; both are harmless to the result.

Rows are told apart by a number of their own, fixed by a stored table; a node goes by the smallest number of its rows.
Ids only name the components in the end.

Defined results: null, empty and white-space texts have no shingles and link with nothing; a text with fewer words
than a shingle is one shingle; rows are linked by their texts, whatever their ids: rows that repeat a doc_id may be in
different components, and rows with a null doc_id link like others; a component is named by its smallest doc_id that is
not null, or null; an empty table gives an empty result; columns that are not named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.batches import hand_back, slices
from loomlog.session import cut, ship_by_value

ship_by_value(__name__)

SLICE_BYTES = 1 << 20
FREQUENT, WIDE = 16, 30
CLASS_BITS = 26
ID_BITS = 24
PARITY_WORDS, LARGE_PARITY_WORDS, LARGE = 8, 64, 1500  # 64-bit words; sets over LARGE tokens get the larger bitmap

# --- shingles -----------------------------------------------------------------------------------------------------

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (its two multipliers are fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Shingler:
    """Sorted distinct shingle hashes of texts, whole batches at a time."""

    def __init__(self, words: int):
        self.words = words
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, SLICE_BYTES + 1)
            with np.errstate(over="ignore"):
                up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
                up[0] = down[0] = 1
                self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """``texts``: a string array; null counts as empty."""
        texts = texts.fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if not len(texts) or offsets[-1] == offsets[0]:
            return [np.zeros(0, np.uint64) for _ in range(len(texts))]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        n = len(data)
        inside = ~SPACES[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:n]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        self._powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE_CODES[LOWER[data]] * self.up[:n], out=sums[1:])
            hashes = (sums[stops] - sums[starts]) * self.down[starts]
            hashes = mix64(hashes + (stops - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
            begin = np.searchsorted(starts, offsets[:-1])
            end = np.append(begin[1:], len(starts))
            k = self.words
            chain = hashes[: max(0, len(hashes) - k + 1)].copy()
            for i in range(1, k):
                chain = mix64(chain * np.uint64(0xE7037ED1A0B428DB) + hashes[i : i + len(chain)])
            out = []
            for b, e in zip(begin.tolist(), end.tolist()):
                if e - b >= k:
                    out.append(np.unique(chain[b : e - k + 1]))
                elif e > b:  # the whole short text; its length keeps it apart from longer shingles
                    short = np.array([e - b], np.uint64)
                    for h in hashes[b:e]:
                        short = mix64(short * np.uint64(0x8EBC6AF09C88C6E3) + h)
                    out.append(short)
                else:
                    out.append(np.zeros(0, np.uint64))
        return out


class Bounds:
    """Lengths that follow from the similarity ``percent / 100``; exact integers."""

    def __init__(self, percent: int, wide: int):
        self.percent, self.wide = percent, wide

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def slack(self, n: int) -> int:
        return n * (100 - self.percent) // self.percent

    def need(self, n: int) -> int:
        return min(n, 2 * self.slack(n) + 2)

    def lead(self, n: int) -> int:
        """None for sets that only equal sets can link with."""
        return min(n, max(self.need(n), n * self.wide // 100)) if self.slack(n) else 0


def parities(tokens: np.ndarray) -> np.ndarray:
    bits = 64 * (LARGE_PARITY_WORDS if len(tokens) > LARGE else PARITY_WORDS)
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def fingerprints(docs: DataFrame, words: int, bounds: Bounds, doc_id: str, text: str) -> DataFrame:
    """(rid, doc_id, n, node, mark, lead, parity) of every row: its number, set size, digest of the set, hash of the text,
    extended prefix, parities."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                sets = shingler.sets(part.column("text"))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array(map(digest, sets), pa.binary()), part.column("mark"),
                    pa.array([s[: bounds.lead(len(s))].tobytes() for s in sets], pa.binary()),
                    pa.array([parities(s) if bounds.slack(len(s)) else None for s in sets], pa.list_(pa.int64())),
                ], ["doc_id", "n", "node", "mark", "lead", "parity"])
        hand_back()

    found = rows.mapInArrow(run, f"doc_id {kind}, n int, node binary, mark bigint, lead binary, parity array<bigint>")
    return found.withColumn("rid", F.monotonically_increasing_id())


# --- token classes ------------------------------------------------------------------------------------------------


def token_classes(leads: DataFrame, frequent: int, total: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bitmaps of the tokens found in two sets or more, and in more than ``frequent``.

    Tasks count their own tokens first and send each token once, in blobs by hash range with 40 bits beyond the range; a
    range is counted in one task, and their number follows the ``total`` of tokens. What reaches the driver has a
    fixed size.
    """
    bits = 6
    while total >> bits > 1 << 22 and bits < CLASS_BITS - 3:
        bits += 1
    width = CLASS_BITS - bits  # bits of the bitmap of one range

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(tokens):
            values, counts = np.unique(np.concatenate(tokens), return_counts=True)
            places = np.searchsorted(values >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            high, low = ((values << np.uint64(bits)) >> np.uint64(56)).astype(np.uint8), ((values << np.uint64(bits)) >> np.uint64(24)).astype(np.uint32)
            counts = counts.astype(np.int32)
            out = [(b, high[i:j].tobytes(), low[i:j].tobytes(), counts[i:j].tobytes()) for b, (i, j) in enumerate(zip(places[:-1], places[1:])) if j > i]
            if out:
                part, *blobs = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], ["part", "high", "low", "counts"])

        held, n = [], 0
        for batch in batches:
            for lead in batch.column("lead"):
                held.append(np.frombuffer(lead.as_buffer(), np.uint64))
                n += len(held[-1])
                if n > 8 << 20:
                    yield from counted(held)
                    held, n = [], 0
        if n:
            yield from counted(held)
        del held
        hand_back()

    def merged(table: pa.Table) -> pa.Table:
        high = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table["high"]])
        low = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table["low"]])
        tokens = high.astype(np.uint64) << np.uint64(32) | low
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in table["counts"]])
        order = np.argsort(tokens, kind="stable")
        tokens, counts = tokens[order], counts[order].astype(np.int64)
        begins = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        tokens, counts = tokens[begins], np.add.reduceat(counts, begins)
        place = (tokens >> np.uint64(40 - width)).astype(np.int64)
        out = []
        for least in (2, frequent + 1):
            marks = np.zeros(1 << width, np.uint8)
            marks[place[counts >= least]] = 1
            out.append(np.packbits(marks, bitorder="little").tobytes())
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "shared": pa.array([out[0]], pa.binary()), "often": pa.array([out[1]], pa.binary())})

    parts = leads.select("lead").mapInArrow(local, "part int, high binary, low binary, counts binary").groupBy("part").applyInArrow(merged, "part int, shared binary, often binary")
    shared, often = np.zeros((1 << CLASS_BITS) // 8, np.uint8), np.zeros((1 << CLASS_BITS) // 8, np.uint8)
    step = (1 << width) // 8
    found = parts.toArrow()
    for part, x, y in zip(found["part"].to_pylist(), found["shared"], found["often"]):
        at = part * step
        shared[at : at + step] = np.frombuffer(x.as_buffer(), np.uint8)
        often[at : at + step] = np.frombuffer(y.as_buffer(), np.uint8)
    return shared, often, CLASS_BITS


def marked(bitmap: np.ndarray, tokens: np.ndarray, bits: int) -> np.ndarray:
    place = tokens >> np.uint64(64 - bits)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def index_keys(leads: DataFrame, bounds: Bounds, classes) -> DataFrame:
    """(key, combined, heavy, rep, n): single rare tokens, and neighbours where tokens are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared_bits, often_bits, bits = classes.value
        for batch in batches:
            found: list[tuple] = []
            sizes = batch.column("n").to_pylist()
            for i, blob in enumerate(batch.column("lead")):
                n, tokens = sizes[i], np.frombuffer(blob.as_buffer(), np.uint64)
                often, shared = marked(often_bits, tokens, bits), marked(shared_bits, tokens, bits)
                rare, need = np.flatnonzero(~often), bounds.need(n)
                heavy = len(rare) < bounds.prefix(n)
                if not heavy:
                    rare = rare[: bounds.prefix(n)]
                    found.append((tokens[rare[shared[rare]]], i, False, False))
                if np.count_nonzero(often[:need]) >= 2:
                    pairs = np.flatnonzero(shared[: need - 1] & shared[1:need])
                    with np.errstate(over="ignore"):
                        found.append((mix64(tokens[pairs] * np.uint64(0x589965CC75374CC3) + tokens[pairs + 1]), i, True, heavy))
            lengths = [len(x[0]) for x in found]
            if sum(lengths):
                at = pa.array(np.repeat([x[1] for x in found], lengths))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([x[0] for x in found]).view(np.int64)), pa.array(np.repeat([x[2] for x in found], lengths)),
                    pa.array(np.repeat([x[3] for x in found], lengths)), batch.column("rep").take(at), batch.column("n").take(at),
                ], ["key", "combined", "heavy", "rep", "n"])
        hand_back()

    return leads.select("lead", "rep", "n").mapInArrow(run, "key bigint, combined boolean, heavy boolean, rep bigint, n int")


# --- candidates and links -----------------------------------------------------------------------------------------


def sizes_allow(a: str, b: str, percent: int):
    return 100 * F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) >= percent * F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))


def parities_allow(a: str, b: str, percent: int):
    """Differing parities against the differing tokens that linked sets of these sizes may have."""
    x, y = F.col(f"{a}.parity"), F.col(f"{b}.parity")
    differing = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    most = (F.col(f"{a}.n") + F.col(f"{b}.n")).cast("long") * (100 - percent)
    return (F.size(x) != F.size(y)) | (differing * (100 + percent) <= most)


def near_heavy(index: DataFrame) -> DataFrame:
    """(key, heavy, rep, n) of the combinations that a heavy set holds, stored; most combinations have none.

    Their keys travel as a bitmap; a wrong bit keeps a combination that then gives no pair.
    """
    sparse = index.sparkSession.sparkContext.broadcast(id_bitmap(index.where("heavy"), "key", CLASS_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.drop_columns(["place"]).filter(pa.array(held(sparse.value, batch.column("place").to_numpy())))
        hand_back()

    rows = index.where("combined").select("key", "heavy", "rep", "n", hashed_place("key", CLASS_BITS))
    kept = cut(rows.mapInArrow(run, "key bigint, heavy boolean, rep bigint, n int"), "combined")
    sparse.destroy()
    return kept


def single_pairs(index: DataFrame, percent: int) -> DataFrame:
    # Merged at every size: a broadcast of the index would grow with the input.
    rows = index.where("not combined").select("key", "rep", "n")
    met = rows.alias("x").join(rows.alias("y").hint("merge"), (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & sizes_allow("x", "y", percent))
    return met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def star_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Each set of a combination with its smallest heavy set; ``rows`` are those of :func:`near_heavy`."""
    centres = rows.where("heavy").groupBy("key").agg(F.min(F.struct("rep", "n")).alias("c")).select("key", "c.*")
    met = centres.alias("x").join(rows.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") != F.col("y.rep")) & sizes_allow("x", "y", percent))
    return met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))


def passing(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs that pass the parity bound; ``sets`` has (rep, n, parity)."""
    met = pairs.distinct().join(sets.alias("x"), F.col("a") == F.col("x.rep")).join(sets.alias("y"), F.col("b") == F.col("y.rep"))
    return met.where(parities_allow("x", "y", percent)).select("a", "b").distinct()


def cross_pairs(rows: DataFrame, component: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in combinations that hold more than one component; ``rows`` as in :func:`star_pairs`."""
    rows = rows.join(component.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rows = cut(rows, "rooted")
    mixed = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("heavy").alias("any"))
    rows = rows.join(mixed.where((F.col("low") != F.col("high")) & F.col("any")).select("key"), "key", "left_semi").join(sets.select("rep", "parity"), "rep")
    rows = cut(rows, "mixed")
    met = rows.where("heavy").alias("x").join(
        rows.alias("y"),
        (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & (~F.col("y.heavy") | (F.col("x.rep") < F.col("y.rep")))
        & sizes_allow("x", "y", percent) & parities_allow("x", "y", percent),
    )
    return met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def hashed_place(column: str, bits: int = ID_BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column), 64 - bits).alias("place")


def held(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def id_bitmap(ids: DataFrame, column: str, bits: int = ID_BITS) -> np.ndarray:
    """A bitmap of hashed ids, of fixed size whatever their number."""
    place = hashed_place(column, bits)
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = ids.select(place).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    table = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy()
    return out.view(np.uint8)


def verified(pairs: DataFrame, wanted: DataFrame, docs: DataFrame, words: int, percent: int, text: str) -> DataFrame:
    """The pairs (a, b) that link, decided on the whole sets of their rows; ``wanted`` has (rep, node, mark) of all sets.

    Texts are read again: a bitmap of their hashes lets the asked ones pass, and some others that the join then drops.
    """
    pairs = cut(pairs, "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    asked = cut(wanted.join(asked, "rep", "left_semi"), "asked")
    bitmap = docs.sparkSession.sparkContext.broadcast(id_bitmap(asked, "mark"))
    rows = docs.select(F.xxhash64(text).alias("mark"), F.col(text).alias("text")).withColumn("place", hashed_place("mark"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            hit = held(bitmap.value, batch.column("place").to_numpy())
            for part in slices(batch.filter(pa.array(hit)), "text", SLICE_BYTES):
                found = shingler.sets(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("mark"), pa.array(map(digest, found), pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["mark", "node", "tokens"])
        hand_back()

    # Rows with equal texts give equal sets; one of each is enough.
    known = rows.mapInArrow(sets, "mark bigint, node binary, tokens binary").join(asked, ["mark", "node"])
    known = cut(known.groupBy("rep").agg(F.first("tokens").alias("tokens")), "sets")
    bitmap.destroy()
    met = pairs.join(known.select(F.col("rep").alias("a"), F.col("tokens").alias("x")), "a").join(known.select(F.col("rep").alias("b"), F.col("tokens").alias("y")), "b")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        hand_back()

    return cut(met.select("a", "b", "x", "y").mapInArrow(linked, "a bigint, b bigint").distinct(), "links")


def memberships(prints: DataFrame, copied: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, mark, n, root) of every row of ``prints`` (rid, doc_id, mark, n, node), stored.

    ``copied`` has (node, rep) of the sets that several rows hold, ``found`` (node, root) of the linked sets.
    """
    rows = prints.select("rid", "doc_id", "mark", "n", "node").join(copied, "node", "left")
    rows = rows.select("rid", "doc_id", "mark", "n", F.when(F.col("n") > 0, F.coalesce("rep", "rid")).otherwise(F.col("rid")).alias("rep"))
    rows = rows.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "mark", "n", F.coalesce("root", "rep").alias("root"))
    return cut(rows, "members")


def named(rows: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of :func:`memberships`."""
    names = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    met = rows.join(names.select("root", "component_id", F.lit(True).alias("several")), "root", "left")
    return met.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("several"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root: the smallest node it reaches. Edges are columns a, b.

    Alternates two star contractions until only stars are left, so rounds grow with the logarithm of a component.
    """
    def only_stars(e: DataFrame) -> bool:
        """Every node either heads edges or stands below exactly one."""
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("below")), F.struct(F.col("b").alias("node"), F.lit(1).alias("below")))).alias("x"))
        sums = ends.groupBy("x.node").agg(F.sum("x.below").alias("below"), F.count(F.lit(1)).alias("all"))
        return sums.where((F.col("below") > 0) & (F.col("all") > 1)).isEmpty()

    now = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not only_stars(now):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("low").alias("a"), "b").where("a <> b").distinct()
        small = large.groupBy("b").agg(F.min("a").alias("low"))
        hung = large.join(small, "b").select(F.col("low").alias("a"), F.when(F.col("a") == F.col("low"), F.col("b")).otherwise(F.col("a")).alias("b"))
        down = large.join(small, "b").select(F.col("low").alias("a"), F.col("b"))
        now = cut(hung.union(down).where("a <> b").distinct(), "edges")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def link(
    docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT, wide: int = WIDE,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    ``frequent`` and ``wide`` (percent of a set kept as extended prefix, if more than needed) steer the work, not the result.
    """
    return named(linked_rows(docs, words, percent, doc_id, text, frequent, wide))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each component: the smallest doc_id, a row without an id only if none has one.

    Rows without words are in no component and all stay. A row is known by its id and its text's hash; of rows that
    are equal in both one stays.
    """
    rows = linked_rows(docs, words, percent, doc_id, text, FREQUENT, WIDE).where("n > 0")
    pairs = rows.groupBy("root", "doc_id", "mark").agg(F.count(F.lit(1)).alias("rows"))
    pair = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    best = pairs.groupBy("root").agg(F.min(pair).alias("best"), F.sum("rows").alias("all")).where(F.col("all") > 1)
    judged = cut(pairs.join(best, "root").select("doc_id", "mark", "rows", (pair == F.col("best")).alias("stays")), "judged")
    given = docs.withColumn("_mark", F.xxhash64(text))

    def same(side: DataFrame) -> tuple[DataFrame, Column]:
        side = side.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_of"))
        return side, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_of"))

    left = given.join(*same(judged.where("not stays")), "left_anti")
    repeated = judged.where("stays and rows > 1")
    if repeated.isEmpty():
        return left.select(*docs.columns)
    once = left.join(*same(repeated), "left_semi").dropDuplicates([doc_id, "_mark"])
    return left.join(*same(repeated), "left_anti").unionByName(once).select(*docs.columns)


def linked_rows(docs: DataFrame, words: int, percent: int, doc_id: str, text: str, frequent: int, wide: int) -> DataFrame:
    """(doc_id, mark, n, root) of every row: equal roots are one component; ``mark`` is the hash of its text."""
    bounds = Bounds(percent, wide)
    prints = cut(fingerprints(docs, words, bounds, doc_id, text), "fingerprints")
    filled = prints.where("n > 0")
    copied = cut(filled.groupBy("node").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("node", "rep"), "copied")
    others = cut(filled.select("rid", "node").join(copied, "node").where("rid <> rep").select("rid"), "others")
    sets = filled.join(others, "rid", "left_anti").withColumnRenamed("rid", "rep")
    leads = sets.where(F.length("lead") > 0)
    total = leads.agg(F.sum(F.length("lead"))).first()[0] or 0
    classes = docs.sparkSession.sparkContext.broadcast(token_classes(leads, frequent, total // 8))
    index = cut(index_keys(leads, bounds, classes), "index")
    classes.destroy()
    combined = near_heavy(index)

    def verify(pairs: DataFrame) -> DataFrame:
        return verified(pairs, sets.select("rep", "node", "mark"), docs, words, percent, text)

    bitmaps = sets.select("rep", "n", "parity")
    links = verify(passing(single_pairs(index, percent).union(star_pairs(combined, percent)), bitmaps, percent))
    found = cut(components(links), "components")
    crossing = cut(cross_pairs(combined, found, bitmaps, percent), "crossing")
    if not crossing.isEmpty() and not (more := verify(crossing)).isEmpty():
        found = cut(components(found.select(F.col("root").alias("a"), F.col("node").alias("b")).union(more)), "components")
    return memberships(prints, copied, found)
