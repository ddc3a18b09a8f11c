"""Periodic runs, the Merkle manifest and bottom-k sketches against plain versions and SQL."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from loomlog.llm import bottomk, merkle, periodic

from .conftest import LONG, edge_documents, near, write_documents


def rows_of(spark, name, folder):
    return [r.asDict() for r in entry_module.queries()[name](spark, folder).collect()]


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_slot_pivot", "op13_bottom_k"])
def test_twins_on_the_given_tables(twin, sf, name):
    got, want = twin(name, sf)
    assert got == want and got


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_slot_pivot", "op13_bottom_k"])
def test_twins_on_edge_cases(twin, tmp_path, name):
    write_documents(tmp_path, [r for r in edge_documents() if len(r[1] or "") < 5000])
    got, want = twin(name, str(tmp_path))
    assert got == want and got


# --- 11 -----------------------------------------------------------------------------------------------------------


def plain_lyndon(word):
    """The longest Lyndon word at i ends where the next smaller suffix begins."""
    out = []
    for i in range(len(word)):
        j = i + 1
        while j < len(word) and word[j:] > word[i:]:
            j += 1
        out.append(j - i)
    return out


def plain_runs(word, least=6, periods=4):
    found, seen = [], set()
    for q in range(1, len(word) // periods + 1):
        i = 0
        while i + q < len(word):
            start = i
            while i + q < len(word) and word[i] == word[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least, periods * q) and (start, length) not in seen:
                seen.add((start, length))
                found.append((start, length, q))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


def words_at_random(rng):
    n, letters = rng.randint(1, 70), rng.randint(1, 4)
    word = [rng.randrange(letters) for _ in range(n)]
    if rng.random() < 0.5:
        start, period = rng.randrange(n), rng.randint(1, 6)
        for i in range(start + period, n):
            word[i] = word[i - period]
    return word


def test_lyndon_words_and_runs_against_brute_force():
    rng = random.Random(3)
    cases = [words_at_random(rng) for _ in range(1500)]
    for word in cases:
        assert periodic.lyndon_lengths(word, 4) == plain_lyndon(word)
    texts = [[b"w%d" % c for c in word] for word in cases]
    # All texts of a slice are read as one word; none may reach into its neighbours.
    assert periodic.find_in(texts) == [plain_runs(word) for word in cases]
    with pytest.raises(ValueError):
        periodic.find_in([[b"a"]], periods=2)


def test_runs_of_long_and_deep_texts():
    fibonacci, before = "ab", "a"
    while len(fibonacci) < 3000:
        fibonacci, before = fibonacci + before, fibonacci
    thue = [bin(i).count("1") % 2 for i in range(4096)]
    texts = [[b"la"] * 5000, [c.encode() for c in fibonacci], [b"%d" % t for t in thue], [b"a"] * 300 + [b"b"] + [b"a"] * 300, [b"x", b"y"] * 1000 + [b"x"]]
    found = periodic.find_in(texts)
    assert found[0] == [(0, 5000, 1)] and found[1] == [] and found[2] == []
    assert found[3] == [(0, 300, 1), (301, 300, 1)] and found[4] == [(0, 2001, 2)]


def test_collapse_drops_all_but_the_first_period():
    words = [b"s", *[b"a", b"b"] * 4, b"e"]
    runs = periodic.find_in([words])[0]
    assert runs == [(1, 8, 2)] and periodic.collapse(words, runs) == b"s a b e"
    assert periodic.collapse([], []) == b""


def test_runs_query_against_plain_version(spark, edge_dir):
    """Every row of the edge table, the longest texts too."""
    want = []
    for doc_id, text, *_ in edge_documents():
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(words) if n < 3000 else None
        want.append((doc_id, runs, words))
    got = defaultdict(list)
    for r in rows_of(spark, "op11_periodic_runs", edge_dir):
        got[r["doc_id"]].append(r)
    for doc_id, runs, words in want:
        if runs is None:
            continue
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        text = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        full = {
            "doc_id": doc_id, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": 1000 * best[1] // best[2] if runs else None,
            "runs_sha256": hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(text).hexdigest(),
        }
        assert full in got[doc_id]
    assert any(runs for _, runs, _ in want) and len(LONG) > 100_000


# --- 12 -----------------------------------------------------------------------------------------------------------


def plain_manifest(rows, fanout=3):
    """(leaf, subroot, root, proof) of rows (doc_id, source, lang, n_chars, text), as the contract words it."""
    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def field(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    def tree(nodes):
        """The top and, for each node, its siblings on the way up."""
        paths, place = [""] * len(nodes), list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(place):
                run = p // fanout * fanout
                paths[i] += "".join(nodes[j] for j in range(run, min(run + fanout, len(nodes))) if j != p)
            nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
            place = [p // fanout for p in place]
        return nodes[0], paths

    by = defaultdict(list)
    for row in rows:
        by[row[1]].append((row[0], h(*map(field, row))))
    tops, out = {}, []
    for source, leaves in by.items():
        leaves.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        tops[source] = (leaves, *tree([x[1] for x in leaves]))
    order = sorted(tops, key=lambda s: (s is not None, (s or "").encode()))
    root, above = tree([tops[s][1] for s in order])
    for source, path in zip(order, above):
        leaves, subroot, paths = tops[source]
        out += [(doc_id, leaf, subroot, root, h(p + path)) for (doc_id, leaf), p in zip(leaves, paths)]
    return Counter(out)


@pytest.mark.parametrize("counts", [{"a": 1}, {"a": 3, None: 1, "b": 10}, {"a": 28, "é": 2, "": 9, "z": 1}, {str(i): 1 + i % 5 for i in range(30)}])
def test_manifest_against_plain_trees(spark, tmp_path, counts):
    rng, rows = random.Random(len(counts)), []
    for source, n in counts.items():
        rows += [(rng.randint(-50, 50) if rng.random() < 0.9 else None, source, "en", k, f"text\n{k}" if k % 4 else None) for k in range(n)]
    rows += rows[:2]  # equal rows
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    got = merkle.manifest(frame).select("doc_id", merkle.hex_of(F.col("digest")), "subroot", "root", merkle.hashed(merkle.proof(F.col("path"))), merkle.fold(F.col("digest"), F.col("path")))
    found = [tuple(r) for r in got.collect()]
    assert Counter(r[:5] for r in found) == plain_manifest(rows) and all(r[5] == r[3] for r in found)


def test_changed_texts_do_not_verify(spark, edge_dir):
    for r in rows_of(spark, "op12_slot_pivot", edge_dir):
        text = next((t for i, t, *_ in edge_documents() if i == r["doc_id"]), None)
        changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (text or "")
        assert r["verified"] == (not changed) == (r["folded_root"] == r["root"])


# --- 13 -----------------------------------------------------------------------------------------------------------


def plain_components(texts, words=5, percent=85):
    sets = []
    for text in texts:
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def grown_texts(rng):
    """Families of near copies of all sizes, large and small texts, and passages that unlike texts share."""
    def words(n, of=4000):
        return [f"v{rng.randrange(of)}" for _ in range(n)]

    passage, texts = words(60), []
    for family in range(40):
        base = words(rng.choice([3, 8, 30, 120, 500]))
        for _ in range(rng.choice([1, 2, 5, 30])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy + (words(rng.randrange(3)) if rng.random() < 0.3 else [])))
    texts += [" ".join(words(rng.choice([2, 40, 300])) + passage + words(20)) for _ in range(60)]
    texts += [" ".join(passage[:i] + passage) for i in range(1, 40)]  # heavy sets that link in chains
    texts += [None, "", " \t", "one", "one two", "ONE"] + texts[:10]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("frequent", [2, 16])
def test_sketches_lose_no_link(spark, seed, frequent):
    texts = grown_texts(random.Random(seed))
    frame = spark.createDataFrame([(i + 100, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in bottomk.link(frame, 5, 85, frequent=frequent).collect()}
    roots, sizes = plain_components(texts)
    assert [got[i + 100]["component_id"] - 100 for i in range(len(texts))] == roots
    assert [got[i + 100]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_sketches_with_missing_and_repeated_ids(spark):
    a, b = "a b c d e f g", "p q r s t u v"
    frame = spark.createDataFrame([(None, a), (3, a), (4, b), (4, a), (None, "alone in the world it is"), (None, b + " w")], "doc_id long, text string")
    got = Counter(tuple(r) for r in bottomk.link(frame, 5, 50).collect())
    assert got == Counter([(None, 3, 3, False), (3, 3, 3, True), (4, 3, 4, True), (4, 3, 3, False), (None, 2, None, True), (None, 4, 4, False)])


def test_bounds_of_the_estimate():
    for m, percent in ((64, 85), (64, 50), (10, 90)):
        d = bottomk.most_differing(m, percent)
        assert m * (1 - percent / 100) < d <= m
        tail, p, term = 0.0, 1 - percent / 100, 1.0
        from math import comb

        for k in range(d + 1, m + 1):
            tail += comb(m, k) * p**k * (1 - p) ** (m - k)
        assert tail <= bottomk.RISK and term


def test_a_large_group_of_near_copies_is_one_component(spark, tmp_path):
    rows = [(i, near(i), "en", "s") for i in range(300)]
    write_documents(tmp_path, rows)
    got = rows_of(spark, "op13_bottom_k", str(tmp_path))
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1
    assert pq.read_table(f"{tmp_path}/documents.parquet").schema.field("doc_id").type == pa.int64()
