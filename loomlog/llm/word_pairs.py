"""How probable the words of a text are by the other texts of its language: a word pair model that grows with the corpus.

Words are the runs between white space, byte for byte; in scripts written without spaces each code point is a word. No
letter is folded into another and no n-gram is left out. The model is MacKay and Peto's hierarchical Dirichlet model of
order 2: a word's share is mixed into the counts of the pairs that begin with the word before it, with the weight of
``PRIOR`` words; words that no other text holds are one word, "unknown". A text's own words are taken out of all counts
before it is weighed, and each distinct text of a language counts once.

Tasks read texts in blocks. A block sends every distinct n-gram (a hash of ``KEY_BITS`` bits, with the language) once, with
its count, to the shard of its hash range; n-grams of order 0 count all words of a language. A shard adds up the blocks'
counts and answers each block in the order in which it asked, so neither a task nor the driver holds the model. Answers
are stored by block. On a second reading a block, known by a hash of its counts, takes its answers; if the second reading
deals the rows out otherwise, the block finds none and the task fails.
"""

from __future__ import annotations

import hashlib
import itertools
import operator
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.batches import hand_back, open_folder, slices
from loomlog.session import ship_by_value, store_path

ship_by_value(__name__)

KEY_BITS = 56
SLICE_BYTES, CHUNK_BYTES = 1 << 19, 1 << 17
BLOCK_BYTES = 40 << 20  # of text and ROW_BYTES a row
ROW_BYTES = 16
SHARD_BYTES = 8 << 20  # of text; shards are a power of two
PRIOR = 1000.0  # words
UNKNOWN = 0.5  # the count of "unknown"
STEP, STEP_BACK, ODD = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64), 0xD6E8FEB86659FD93
POWERS: dict[int, np.ndarray] = {}  # of a base, as far as slices have been long


def _alone() -> np.ndarray:
    """By the first two bytes of a code point: whether it is a word of its own (scripts without spaces)."""
    table = np.zeros(1 << 16, bool)
    for first, last in ((0xE0B8, 0xE0BF), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE2BA, 0xE9BF), (0xEFA4, 0xEFAB), (0xF0A0, 0xF0B3)):
        table[first : last + 1] = True  # Thai to Tibetan, Myanmar, Khmer, Han and kana, Han in other blocks
    return table


ALONE = _alone()
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
BYTES = np.random.Generator(np.random.PCG64(6)).integers(0, 1 << 64, 256, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64 bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    known = POWERS.get(base)
    if known is None or len(known) < n:
        known = np.cumprod(np.full(max(n, 2 * CHUNK_BYTES), base, np.uint64))
        if n <= SLICE_BYTES:
            POWERS[base] = known
    return known[:n]


def seed(lang: str | None) -> int:
    return int.from_bytes(hashlib.md5(b"-" if lang is None else b"+" + lang.encode()).digest()[:8], "little")


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the texts, and how many words each text has."""
    coded = [(t or "").encode() for t in texts]
    found, some, held = [], [], 0
    for text in coded:
        if some and held + len(text) > CHUNK_BYTES:
            found.append(_words(some))
            some, held = [], 0
        some.append(text)
        held += len(text)
    found.append(_words(some))
    return np.concatenate([h for h, _ in found]), np.concatenate([n for _, n in found])


def _words(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join([*coded, b""]) or b" ", np.uint8)
    space = SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    if (data >= 0xE0).any():
        at = np.flatnonzero(data[:-1] >= 0xE0)
        at = at[ALONE[data[at].astype(np.int64) << 8 | data[at + 1]]]
        after = at + 3 + (data[at] >= 0xF0)
        start[at] = True
        start[after[~space[after]]] = True
    bounds = np.flatnonzero(space | start)
    begins = np.flatnonzero(start[bounds])
    s, e = bounds[begins], bounds[begins + 1] if len(begins) else bounds[:0]
    power = powers(STEP, len(data))
    upto = np.cumsum(BYTES[data] * power)
    # Word's polynomial times the power at its first byte; the inverse power brings it back to the start.
    value = (upto[e - 1] - upto[s] + BYTES[data[s]] * power[s]) * powers(STEP_BACK, len(data))[s]
    ends = np.cumsum([len(c) + 1 for c in coded], dtype=np.int64)
    sizes = np.diff(np.searchsorted(s, ends), prepend=0)
    return mixed(value + np.uint64(ODD) * (e - s).astype(np.uint64)), sizes


class Grams:
    """The n-grams of some texts: keys of order 0 by text, of order 1 by word, of order 2 by word that follows another."""

    def __init__(self, langs: list[str | None], texts: list[str | None]):
        found, self.sizes = words(texts)
        seeds = {lang: seed(lang) for lang in set(langs)}
        by_text = np.array([seeds[lang] for lang in langs], np.uint64)
        keyed = mixed(found ^ np.repeat(by_text, self.sizes))
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)
        self.follows = np.flatnonzero(self.text[1:] == self.text[:-1]).astype(np.int32) + 1
        drop = np.uint64(64 - KEY_BITS)
        self.zero = (mixed(by_text + np.uint64(ODD)) >> drop).astype(np.int64)
        self.one = (keyed >> drop).astype(np.int64)
        self.two = (mixed(keyed[self.follows - 1] * np.uint64(ODD) + keyed[self.follows]) >> drop).astype(np.int64)

    def counts(self, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in order with their counts; a text counts ``times`` times."""
        some = self.sizes > 0
        if times is None or (times == 1).all():
            keys, counts = added([(self.zero[some], self.sizes[some]), np.unique(self.one, return_counts=True), np.unique(self.two, return_counts=True)])
            return keys, counts.astype(np.int32)
        each = times[self.text]
        return added([(self.zero[some], (times * self.sizes)[some]), (self.one, each), (self.two, each[self.follows])])

    def figures(self, keys: np.ndarray, totals: np.ndarray) -> list[float | None]:
        """The mean negative log probability by word of each text by all others; ``totals`` are the counts of ``keys``."""
        if not len(self.one):
            return [None] * len(self.sizes)

        def others(grams: np.ndarray, text: np.ndarray) -> np.ndarray:
            distinct, at = np.unique(grams, return_inverse=True)
            _, own_at, own = np.unique(text.astype(np.int64) * len(distinct) + at, return_inverse=True, return_counts=True)
            return totals[np.searchsorted(keys, distinct)][at] - own[own_at]

        some = np.flatnonzero(self.sizes)
        rest = np.zeros(len(self.sizes))
        rest[some] = totals[np.searchsorted(keys, self.zero[some])] - self.sizes[some]
        one = others(self.one, self.text)
        p = np.where(one > 0, one, UNKNOWN) / (rest[self.text] + UNKNOWN)
        if len(self.two):
            two = others(self.two, self.text[self.follows])
            p[self.follows] = (two + PRIOR * p[self.follows]) / (one[self.follows - 1] + PRIOR)
        sums = np.add.reduceat(np.log(p), np.cumsum(self.sizes)[some] - self.sizes[some])
        out: list[float | None] = [None] * len(self.sizes)
        for i, figure in zip(some.tolist(), (-sums / self.sizes[some]).tolist()):
            out[i] = figure
        return out


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[begins], np.add.reduceat(counts, begins)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows with the number of their block; blocks go by the bytes of ``text``, whatever the batches they come in."""
    held, block = 0, 0
    for batch in batches:
        start = 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
            if held and held + size > BLOCK_BYTES:
                yield block, batch.slice(start, i - start)
                held, block, start = 0, block + 1, i
            held += size + ROW_BYTES
        yield block, batch.slice(start)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[pa.RecordBatch]]:
    for _, some in itertools.groupby(pieces(batches), operator.itemgetter(0)):
        yield map(operator.itemgetter(1), some)


def read_block(block: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Grams]]:
    for piece in block:
        for part in slices(piece, "text", SLICE_BYTES):
            yield part, Grams(part.column("lang").to_pylist(), part.column("text").to_pylist())


def block_counts(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums over parts with ordered keys, a range of keys at a time."""
    edges = np.arange(1, 64) << (KEY_BITS - 6)
    held: list[list] = [[] for _ in range(64)]
    for keys, counts in parts:
        ends = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
        for i, some in enumerate(held):
            at = slice(ends[i], ends[i + 1])
            some.append((keys[at].copy(), counts[at].copy()))
    size = sum(len(keys) for some in held for keys, _ in some)
    # Only what is filled takes memory.
    all_keys, all_counts = np.empty(size, np.int64), np.empty(size, np.result_type(np.int32, *(n.dtype for some in held for _, n in some)))
    filled = 0
    for i in range(64 if size else 0):
        keys, counts = added(held[i])
        at = slice(filled, filled + len(keys))
        all_keys[at], all_counts[at], filled, held[i] = keys, counts, filled + len(keys), []
        if size >= 1 << 20 and i % 16 == 15:
            hand_back()
    return all_keys[:filled], all_counts[:filled]


def block_name(keys: np.ndarray, counts: np.ndarray) -> str:
    name = hashlib.blake2b(keys.tobytes(), digest_size=16)
    name.update(counts.tobytes())
    return name.hexdigest()


def pack(values: np.ndarray) -> bytes:
    """Integers from 0 on, compressed: a byte each, larger ones after these."""
    large = values[values >= 255].astype("<i8")
    return len(large).to_bytes(4, "little") + pa.compress(np.minimum(values, 255).astype(np.uint8).tobytes() + large.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    large = int.from_bytes(data[:4], "little")
    raw = pa.decompress(data[4:], n + 8 * large, "zstd", asbytes=True)
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", large, n)
    return out


def shard_bits(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(0, int(-(-size // SHARD_BYTES) - 1).bit_length())


def _asked(docs: DataFrame, bits: int, answer: bool) -> DataFrame:
    """(shard, block, low, high, n): the distinct n-grams of each block of ``docs`` (lang, text, times), by shard.

    Blocks that want no answer have no name.
    """
    rest = KEY_BITS - bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            keys, counts = block_counts(grams.counts(part.column("times").to_numpy()) for part, grams in read_block(block))
            name = block_name(keys, counts) if answer else None
            ends = [*np.searchsorted(keys, np.arange(1 << bits) << rest).tolist(), len(keys)]
            for some in range(0, 1 << bits, 16):
                rows = [row(i, name, keys[a:b], counts[a:b]) for i, a, b in zip(range(some, some + 16), ends[some:], ends[some + 1 :]) if a < b]
                yield pa.RecordBatch.from_pylist(rows, schema)
            del keys, counts
        hand_back()

    def row(shard: int, name: str | None, keys: np.ndarray, counts: np.ndarray) -> dict:
        high = pack(np.diff((keys & ((1 << rest) - 1)) >> 32, prepend=0))
        return {"shard": shard, "block": name, "low": (keys & 0xFFFFFFFF).astype("<u4").tobytes(), "high": high, "n": pack(counts)}

    schema = pa.schema([("shard", pa.int32()), ("block", pa.string()), ("low", pa.binary()), ("high", pa.binary()), ("n", pa.binary())])

    return docs.mapInArrow(run, "shard int, block string, low binary, high binary, n binary")


def answers(docs: DataFrame, further: DataFrame) -> tuple[str, int]:
    """Folder and shard bits of the answers: what a block's counts of n-grams lack to those of all distinct texts of ``docs`` (lang, text).

    ``further`` (lang, text, extra) has the texts that occur more than once and the number of rows beyond the first.
    """

    def answer(table: pa.Table) -> pa.Table:
        rows = []
        for low, high, n in zip(table["low"].to_pylist(), table["high"].to_pylist(), table["n"].to_pylist()):
            low = np.frombuffer(low, "<u4").astype(np.int64)
            rows.append((np.cumsum(unpack(high, len(low))) << 32 | low, unpack(n, len(low))))
        names = table["block"].to_pylist()
        keys, sums = added([(asked, n if name is not None else -n) for name, (asked, n) in zip(names, rows)])
        lacks = ((name, sums[np.searchsorted(keys, asked)] - n) for name, (asked, n) in zip(names, rows) if name is not None)
        out = [(name, pack(more << 1 ^ more >> 63)) for name, more in lacks]  # a block that holds copies has too many
        size = len(keys)
        del rows, keys, sums
        if size >= 1 << 20:
            hand_back()
        return pa.table({
            "shard": pa.array([table["shard"][0].as_py()] * len(out), pa.int32()), "block": pa.array([name for name, _ in out], pa.string()),
            "more": pa.array([more for _, more in out], pa.binary()),
        })

    bits = shard_bits(docs)
    asked = _asked(docs.select("lang", "text", F.lit(1).cast("long").alias("times")), bits, True)
    less = _asked(further.select("lang", "text", F.col("extra").alias("times")), bits, False)
    folder = store_path(docs.sparkSession, "word-counts")
    found = asked.unionByName(less).groupBy("shard").applyInArrow(answer, "shard int, block string, more binary")
    found.repartition("block").write.partitionBy("block").parquet(folder)
    return folder, bits


def totals(folder: str, bits: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of a block's keys in all distinct texts, from its own counts and the shards' answers."""
    import pyarrow.parquet as pq

    files, path = open_folder(folder)
    try:
        found = pq.read_table(f"{path}/block={block_name(keys, counts)}", filesystem=files, columns=["shard", "more"], partitioning=None)
    except FileNotFoundError as e:
        raise ValueError("the rows came in other blocks on the second reading; store the table before it is judged") from e
    by_shard = dict(zip(found["shard"].to_pylist(), found["more"].to_pylist()))  # equal blocks have equal answers
    out = counts.astype(np.int64)
    ends = np.searchsorted(keys, np.arange(1 << bits) << (KEY_BITS - bits)).tolist()
    for shard, (a, b) in enumerate(zip(ends, [*ends[1:], len(keys)])):
        if a < b:
            more = unpack(by_shard[shard], b - a)
            out[a:b] += more >> 1 ^ -(more & 1)
    return out


def weighed(block: Iterable[pa.RecordBatch], folder: str, bits: int) -> Iterator[tuple[pa.RecordBatch, list[float | None]]]:
    """Slices of a block with the figures of their texts."""
    block = list(block)
    keys, counts = block_counts(grams.counts() for _, grams in read_block(block))
    found = totals(folder, bits, keys, counts) if len(keys) else counts
    del counts
    for part, grams in read_block(block):
        yield part, grams.figures(keys, found)
