"""Periodic runs of words from Lyndon arrays.

A run is a stretch with period q that no neighbouring word extends. Each run of two periods or more holds a Lyndon root:
a word of length q that is the longest Lyndon word at its place, under the order of the words or under its reverse. So

* the first phase of Baier's suffix sorter (the groups of suffixes that share a context, taken from the highest)
  is run under both orders: when a group is taken, its context is the longest Lyndon word at its members;
* each Lyndon word found is extended to both sides by longest common extensions, read off names of all blocks of
  1, 2, 4, ... words (equal blocks have equal names, so extensions are exact);
* equal results are one run; those of the asked length and number of periods stay.

A text is read only where it can hold a run: all five-word shingles of a run of six words and four periods occur twice in
its text, so the work goes into the stretches which such shingles cover. A run never leaves its stretch. The stretches of a
slice are read together, with a letter of its own after each.

Each text is one row and is worked on by itself, in slices bounded by bytes; nothing is shuffled.

Defined results: a null or empty text and a text of white space have no words and no runs; repeated rows are answered
each; an empty table gives an empty result; columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.batches import hand_back, slices
from loomlog.session import ship_by_value

ship_by_value(__name__)

SLICE_BYTES = 2 << 20
SHINGLE = 5
MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def lyndon_lengths(word: list[int], sigma: int) -> list[int]:
    """The length of the longest Lyndon word at every place of ``word``, whose letters are 0 .. sigma - 1.

    Groups are kept in order as a linked list. Taking the highest group settles its members; the nearest unsettled place
    before a member has its context extended by the group's, once for every member that points to it, and moves to a new
    group just above its old one.
    """
    group = list(word)
    members: list[list[int]] = [[] for _ in range(sigma)]
    for i, c in enumerate(word):
        members[c].append(i)
    width, below, above = [1] * sigma, list(range(-1, sigma - 1)), [*range(1, sigma), -1]
    settled, before = [0] * len(word), [-1] * len(word)
    taken = sigma - 1
    while taken >= 0:
        size, moves, last, times = width[taken], {}, -1, 0
        for i in members[taken]:
            if group[i] != taken:
                continue
            settled[i] = size
            j = i - 1
            while j >= 0 and settled[j]:
                j = before[j]
            before[i] = j
            if j == last:
                times += 1
            else:
                if last >= 0:
                    moves.setdefault((times, group[last]), []).append(last)
                last, times = j, 1
        if last >= 0:
            moves.setdefault((times, group[last]), []).append(last)
        for times, old in sorted(moves, reverse=True) if len(moves) > 1 else moves:
            new, up = len(width), above[old]
            moved = moves[times, old]
            for j in moved:
                group[j] = new
            members.append(moved)
            width.append(width[old] + times * size)
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
        taken = below[taken]
    return settled


class Extensions:
    """Longest common extensions in one word, up to ``longest`` letters, by names of its blocks of 1, 2, 4, ... letters."""

    def __init__(self, word: np.ndarray, longest: int):
        self.names = [word.astype(np.int64)]
        size = 1
        while 2 * size <= longest:
            known = self.names[-1]
            both = known[:-size] * (int(known.max()) + 1) + known[size:]
            self.names.append(np.unique(both, return_inverse=True)[1].astype(np.int64))
            size *= 2
        self.n = len(word)

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the letters from ``i`` and from ``j`` (i < j) agree."""
        found = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, size = self.names[k], 1 << k
            fits = j + found + size <= self.n
            a, b = np.where(fits, i + found, 0), np.where(fits, j + found, 0)
            found += np.where(fits & (names[a] == names[b]), size, 0)
        return found

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the letters before ``i`` and before ``j`` (i < j) agree, going left."""
        found = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, size = self.names[k], 1 << k
            fits = i - found - size >= 0
            a, b = np.where(fits, i - found - size, 0), np.where(fits, j - found - size, 0)
            found += np.where(fits & (names[a] == names[b]), size, 0)
        return found


def runs_of(word: np.ndarray, longest: int, least: int, periods: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``word`` with ``least`` letters and ``periods`` periods, sorted.

    No run has more than ``longest`` letters.
    """
    letters, word = np.unique(word, return_inverse=True)
    n, sigma = len(word), len(letters)
    at, period = [], []
    for ordered in (word, sigma - 1 - word):
        lengths = np.array(lyndon_lengths(ordered.tolist(), sigma), np.int64)
        place = np.flatnonzero(lengths * periods <= longest)
        place = place[place + lengths[place] < n]
        place = place[word[place] == word[place + lengths[place]]]
        at.append(place)
        period.append(lengths[place])
    i, q = np.unique(np.stack([np.concatenate(at), np.concatenate(period)]), axis=1)
    if not len(i):
        return []
    extend = Extensions(word, longest)
    left, right = extend.left(i, i + q), extend.right(i, i + q)
    length = left + q + right
    fine = length >= np.maximum(least, periods * q)
    return sorted(set(zip((i - left)[fine].tolist(), length[fine].tolist(), q[fine].tolist())))


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches covered by shingles that occur more than once; equal hashes of others only make them longer."""
    count = len(ids) - SHINGLE + 1
    if count < 2:
        return []
    words = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        hashes = words[:count] * MIXERS[0]
        for k in range(1, SHINGLE):
            hashes = (hashes ^ (hashes >> np.uint64(29))) * MIXERS[k] + words[k : k + count]
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    twice = twice[np.append(True, twice[1:] != twice[:-1])]
    place = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
    starts = np.flatnonzero(twice[place] == hashes)
    breaks = np.flatnonzero(np.diff(starts) > SHINGLE)
    return list(zip(starts[np.append(0, breaks + 1)].tolist(), (starts[np.append(breaks, len(starts) - 1)] + SHINGLE).tolist()))


def find_in(texts: list[list[bytes]], least: int = 6, periods: int = 4) -> list[list[tuple[int, int, int]]]:
    """For each list of words the (start, length, period) of its runs, by start, then period.

    The stretches of all texts are read as one word, with a letter of its own after each.
    """
    if least < 6 or periods < 4:  # the shingles of shorter runs need not repeat
        raise ValueError("runs of at least six words and four periods")
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    pieces, owners = [], []
    for owner, words in enumerate(texts):
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        if len(known) == len(words):
            continue
        for begin, end in stretches(ids):
            if end - begin >= least:
                pieces.append(ids[begin:end])
                owners.append((owner, begin))
    if not pieces:
        return found
    lengths = np.array([len(p) for p in pieces])
    own = int(max(p.max() for p in pieces)) + 1
    word = np.concatenate([x for k, p in enumerate(pieces) for x in (p, np.array([own + k]))])
    begins = np.cumsum(lengths + 1) - lengths - 1
    for start, length, period in runs_of(word, int(lengths.max()), least, periods):
        k = int(np.searchsorted(begins, start, "right")) - 1
        owner, begin = owners[k]
        found[owner].append((begin + start - int(begins[k]), length, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside runs and in the first period of each, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change)[:-1] == 0
    return b" ".join(w for w, k in zip(words, kept.tolist()) if k)


def repeat_tail(words: list[bytes], seed: int | None) -> list[bytes]:
    """The periodic runs that the registered query plants: every tenth seed repeats a part of its text to the end."""
    n = len(words)
    if seed is None or seed % 10 or not n:
        return words
    turn = seed // 10
    start = turn % n
    period = 1 + (n - start) // (3 + turn % 8)
    return words[:start] + [words[start + i % period] for i in range(n - start)]


def find_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: Column | None = None,
    change: Callable[[list[bytes], int | None], list[bytes]] | None = None,
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs by start and period, its text without their repeats.

    ``change`` may rewrite the words of a row, given its ``seed``, before they are read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.lit(None) if seed is None else seed).cast("long").alias("seed"))
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                sizes, ends, fields, texts = [], [0], ([], [], []), []
                values = [v.as_buffer().to_pybytes().split() if v.is_valid else [] for v in part.column("text")]
                if change is not None:
                    values = list(map(change, values, part.column("seed").to_pylist()))
                for words, runs in zip(values, find_in(values)):
                    for run in runs:
                        for column, number in zip(fields, run):
                            column.append(number)
                    sizes.append(len(words))
                    ends.append(len(fields[0]))
                    texts.append(collapse(words, runs).decode())
                entries = pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], fields=list(runs_type.value_type))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries), pa.array(texts, pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )
        hand_back()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(read, f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
