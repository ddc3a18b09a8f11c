"""Operators of the llm package against SQL twins, libraries and plain versions."""

import binascii
import hashlib
import itertools
import math
import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry_module
from loomlog.llm import jaccard, kdtree, mixing, perplexity, quality, shards, token_counts, warc, word_pairs
from loomlog.llm import pieces as pieces_module
from loomlog.llm.text_stats import rule_counts

from .conftest import edge_documents, write_documents

OPERATORS = sorted(n for n in entry_module.queries() if re.match(r"op\d+_|pipeline$", n))


def rows_of(spark, name, folder):
    return [r.asDict() for r in entry_module.queries()[name](spark, folder).collect()]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_empty_results(spark, empty_dir, name):
    assert rows_of(spark, name, empty_dir) == []


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("op3_kd_search", "op10_warc", "pipeline")])
def test_edge_cases_keep_every_row(spark, edge_dir, name):
    assert Counter(r["doc_id"] for r in rows_of(spark, name, edge_dir)) == Counter(r[0] for r in edge_documents())


@pytest.mark.parametrize("name", ["op1_hash_tree", "op5_line_dedup", "op10_warc"])
def test_twins_on_edge_cases(twin, edge_dir, name):
    if name == "op1_hash_tree":  # the checksum of a 300 KB text is slow in SQL
        pytest.skip("covered by the smaller table below")
    got, want = twin(name, edge_dir)
    assert got == want and got


@pytest.mark.parametrize("name", ["op1_hash_tree", "op5_line_dedup", "op7_jaccard_join"])
def test_twins_without_the_longest_texts(twin, tmp_path, name):
    write_documents(tmp_path, [r for r in edge_documents() if len(r[1] or "") < 5000])
    got, want = twin(name, str(tmp_path))
    assert got == want and got


@pytest.mark.parametrize("name", ["op1_hash_tree", "op3_kd_search", "op5_line_dedup", "op7_jaccard_join", "op10_warc"])
def test_twins_on_the_given_tables(twin, sf, name):
    got, want = twin(name, sf)
    assert got == want and got


# --- 1 ------------------------------------------------------------------------------------------------------------


def test_hash_tree_is_fair_and_confined(spark):
    ids = spark.range(40_000)

    def placed(tree):
        return {r[0]: r[1] for r in ids.select("id", shards.shard_of(ids["id"], tree, 3)).collect()}

    tree = shards.even_tree(40)
    now = placed(tree)
    counts = Counter(now.values())
    assert len(counts) == 40 and max(abs(n - 1000) for n in counts.values()) < 160
    later = placed(shards.even_tree(41))
    moved = [k for k in now if now[k] != later[k]]
    assert {later[k] for k in moved} == {40} and 700 < len(moved) < 1250
    # A heavier shard takes keys into its rack and region; rows elsewhere keep their place or move into that subtree.
    heavier = [x._replace(weight=3.0) if x.shard == 12 else x for x in tree]
    region = {x.shard: x.region for x in tree}
    changed = placed(heavier)
    assert all(region[changed[k]] == 1 for k in now if now[k] != changed[k])
    assert sum(s == 12 for s in changed.values()) > 2 * counts[12]


def test_slots_are_gapless(spark, edge_dir):
    by = defaultdict(list)
    for r in rows_of(spark, "op1_hash_tree", edge_dir):
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


# --- 2 ------------------------------------------------------------------------------------------------------------


def test_targets_share_the_excess():
    sizes = {"a": 10, "b": 1000, "c": 1000, None: 0}
    goal = mixing.targets(sizes, mixing.cycle_weights(sizes), 3)
    assert goal["a"] == 30 and goal[None] == 0  # a: 3 times its size; null is last, weight 5, nothing to take
    assert goal["b"] == pytest.approx(1980 * 2 / 3) and sum(goal.values()) == pytest.approx(2010)
    assert mixing.in_order([None, "b", "a", ""]) == ["", "a", "b", None]


def test_flow_is_maximal_and_cheapest():
    rng = random.Random(5)
    for _ in range(25):
        patterns = {p: rng.randint(0, 3) for p in [("a",), ("b",), ("a", "b")]}
        quotas = {"a": rng.randint(0, 7), "b": rng.randint(0, 7)}
        flow = mixing.route(patterns, quotas, 3)

        def cost(words, size):
            return sum(max(0, min(size, words - i * size)) * i for i in range(3)) if size else 0

        used = {p: sum(f.values()) for p, f in flow.items()}
        into = {s: sum(f.get(s, 0) for f in flow.values()) for s in quotas}
        assert all(used[p] <= 3 * patterns[p] for p in patterns) and all(into[s] <= quotas[s] for s in quotas)
        best = max(
            (x + y + z + w, -(cost(x, patterns[("a",)]) + cost(y, patterns[("b",)]) + cost(z + w, patterns[("a", "b")])))
            for x, y, z, w in itertools.product(range(8), repeat=4)
            if x <= 3 * patterns[("a",)] and y <= 3 * patterns[("b",)] and z + w <= 3 * patterns[("a", "b")] and x + z <= quotas["a"] and y + w <= quotas["b"]
        )
        assert (sum(into.values()), -sum(cost(used[p], patterns[p]) for p in patterns)) == best


def test_mix_meets_its_targets(spark, sf, edge_dir):
    for folder in (sf, edge_dir):
        got = rows_of(spark, "op2_mix_flow", folder)
        docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
        assert len(got) == len(docs)
        assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d.doc_id, len((d.text or "").encode().split())) for d in docs)
        assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in got)
        groups = defaultdict(list)
        for r in got:
            groups[r["source_size"], r["target"]].append(r)
        for (size, target), part in groups.items():
            if sum(r["size"] for r in part) == size:  # one source
                largest = max(r["size"] for r in part)
                assert abs(sum(r["taken"] for r in part) - target) <= max(1, min(largest, 0.02 * target + largest / 2))
        again = rows_of(spark, "op2_mix_flow", folder)
        assert Counter(map(str, got)) == Counter(map(str, again))


# --- 3 ------------------------------------------------------------------------------------------------------------


def test_search_over_many_shards(spark, twin, edge_dir, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 50)
    monkeypatch.setattr(kdtree, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(kdtree, "LEAF_ROWS", 8)
    got = rows_of(spark, "op3_kd_search", edge_dir)
    points = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{edge_dir}/embeddings.parquet").collect()]
    points = [(i, [math.floor(256 * x) for x in e]) for i, e in points if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for q, e in points:
        if q % 50 == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(e, f)))), i) for i, f in points if i != q and len(f) == len(e))
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scores[:5], 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_tree_skips_boxes_and_stays_exact():
    rng = np.random.default_rng(1)
    points = np.floor(256 * np.vstack([rng.normal(c, 0.05, (300, 4)) for c in (-1, 0, 1)]))
    tree = kdtree.Tree(points, np.arange(len(points)))
    bounds = tree.bounds(points[:5])
    for j in range(5):
        exact = sorted((-int(s), i) for i, s in enumerate(points @ points[j]) if i != j)[:4]
        assert tree.search(points[j], j, bounds[j], 4, []) == exact
        assert tree.search(points[j], j, bounds[j], 4, [(-(10**9), -1)] * 4) == []


# --- 4 ------------------------------------------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in rows_of(spark, "op4_quality_classifier", folder)]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [(r["predicted"], marks[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in marks]
    assert sum(p == m for p, m in held) / len(held) > 0.95


def test_classifier_on_edge_cases(spark, edge_dir):
    got = rows_of(spark, "op4_quality_classifier", edge_dir)
    assert len(got) == len(edge_documents()) and all(0 <= r["score"] <= 1 for r in got)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    alone = quality.classify(spark.read.parquet(f"{edge_dir}/documents.parquet"), labels, entry_module_true(spark)).collect()
    assert {r.score for r in alone} == {0.5}


def entry_module_true(spark):
    from pyspark.sql import functions as F

    return F.lit(True)


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(2)
    n, k = rng.integers(1, 9, 200).astype(float), None
    k = np.array([rng.integers(0, int(x) + 1) for x in n], float)
    places, values = quality.isotonic(np.arange(200) / 200, n, k)
    assert (np.diff(values) > 0).all() and (np.diff(places) > 0).all() and 0 <= values.min() and values.max() <= 1


# --- 6 ------------------------------------------------------------------------------------------------------------


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, same = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            same += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), same, len(repeated)


def test_rule_counts():
    rng = random.Random(3)
    texts = [r[1] for r in edge_documents()] + ["".join(rng.choice("ab \n\t#é\x85\xa0") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    for text in texts:
        assert rule_counts(text) == slow_counts(text)


def slow_model(texts):
    """Modified Kneser-Ney over symbol tuples with dictionaries; returns the mean negative log probability of a text."""
    def symbols(text):
        return [0] * 3 + list(text.encode().translate(perplexity.ALPHABET))

    tables = {4: Counter()}
    for t in texts:
        s = symbols(t)
        tables[4].update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
    for k in (3, 2, 1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    taken, after = {}, {}
    for k, table in tables.items():
        n = [sum(c == i for c in table.values()) for i in range(5)]
        d = [0, 0.5, 1.0, 1.5]
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            for i in (1, 2, 3):
                value = i - (i + 1) * y * n[i + 1] / n[i]
                if 0 < value <= i:
                    d[i] = value
        taken[k] = d
        after[k] = defaultdict(list)
        for g, c in table.items():
            after[k][g[:-1]].append(c)

    def p(g):
        k = len(g)
        if not k:
            return 1 / 64
        counts = after[k].get(g[:-1])
        if not counts:
            return p(g[1:])
        c, d = tables[k].get(g, 0), taken[k]
        return (max(c - d[min(c, 3)], 0) + sum(d[min(x, 3)] for x in counts) * p(g[1:])) / sum(counts)

    def figure(text):
        s = symbols(text)
        return -sum(math.log(p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))) / (len(s) - 3)

    return figure


def test_perplexity_equals_a_plain_model(spark):
    words = "stone river Mill under 12 the! été bridge, of".split()
    rng = random.Random(4)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(60)] + ["zzqq", "", None]
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.row.doc_id: r.figure for r in perplexity.judge(docs, ["doc_id"]).collect()}
    for lang in "ab":
        figure = slow_model([t for _, t, g in rows if g == lang and t])
        for i, t, g in rows:
            if g == lang:
                assert got[i] == (pytest.approx(figure(t), abs=2e-5) if t else None)


def test_unseen_grams_back_off():
    model = perplexity.Model.train(*np.unique(perplexity.grams(["abc abd abe"])[0], return_counts=True))
    again = perplexity.Model.from_bytes(model.to_bytes())
    codes, _ = perplexity.grams(["xyz abq"])
    figure = slow_model(["abc abd abe"])
    assert -float(again.log_probabilities(codes).mean()) == pytest.approx(figure("xyz abq"), abs=1e-5)


def test_bands_reject_the_odd_text(spark):
    rng = random.Random(6)
    words = "the of and river stone under mill bridge boats water".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(120)), "en") for i in range(80)]
    rows += [(100, "".join(rng.choice("qxzjkvwQXZ#%19") for _ in range(600)).replace("q", " "), "en"), (101, "the the", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.row.doc_id: (r.base_failed, r.kept) for r in perplexity.judge(docs, ["doc_id"]).collect()}
    assert kept[100] == (False, False) and kept[101] == (True, False) and sum(k for _, k in kept.values()) >= 78


def test_copies_count_once(spark):
    """A third of all rows are copies of one text of a small language; what is kept stays as it is without them."""
    rng = random.Random(8)
    words = "the of and river stone under mill bridge boats water".split()
    others = "le la eau pont moulin pierre sous et vent nuit".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(60 + i % 50)), "en") for i in range(140)]
    rows += [(200 + i, " ".join(rng.choice(others) for _ in range(60 + i % 50)), "fr") for i in range(60)]
    rows += [(300, "".join(rng.choice("qxzjkvwQXZ#%19") for _ in range(600)).replace("q", " "), "fr")]
    more = [(400 + i, rows[140][1], "fr") for i in range(100)] + [(600, rows[140][1], "en"), (601, None, "fr"), (602, None, "fr")]

    def judged(some):
        docs = spark.createDataFrame(some, "doc_id long, text string, lang string")
        return {r.row.doc_id: (None if r.figure is None else round(r.figure, 5), r.kept) for r in perplexity.judge(docs, ["doc_id"]).collect()}

    alone, among = judged(rows + more[-3:]), judged(rows + more)
    assert len(among) == len(rows) + len(more) and {i: among[i] for i in alone} == alone
    assert sum(kept for i, (_, kept) in among.items() if 200 <= i < 260) >= 57 and not among[300][1]
    assert {among[400 + i] for i in range(100)} == {among[200]}


def slow_words(text):
    """Words between white space; Han is split by code point."""
    return [w for run in re.findall(r"[^\x20\x09-\x0D]+", text or "") for w in re.findall(r"[\u4e00-\u9fff]|[^\u4e00-\u9fff]+", run)]


def slow_word_figures(rows):
    """Figure of each (text, lang) by the words and word pairs of the other texts of its language, with dictionaries."""
    counts = defaultdict(Counter)
    for text, lang in set(rows):
        w = slow_words(text)
        counts[lang].update([()] * len(w) + [(x,) for x in w] + list(zip(w, w[1:])))
    out = []
    for text, lang in rows:
        w = slow_words(text)
        rest = Counter(counts[lang])
        rest.subtract([()] * len(w) + [(x,) for x in w] + list(zip(w, w[1:])))
        p = [(rest[x,] or word_pairs.UNKNOWN) / (rest[()] + word_pairs.UNKNOWN) for x in w]
        for i in range(len(w) - 1, 0, -1):
            p[i] = (rest[w[i - 1], w[i]] + word_pairs.PRIOR * p[i]) / (rest[w[i - 1],] + word_pairs.PRIOR)
        out.append(-sum(map(math.log, p)) / len(w) if w else None)
    return out


def slow_band(figures):
    """Lower median and deviation of binned figures."""
    bins = sorted(math.floor(f * 1000 + 0.5) for f in figures)
    middle = bins[(len(bins) - 1) // 2]
    off = sorted(abs(b - middle) for b in bins)[(len(bins) - 1) // 2]
    return middle / 1000, max(1.4826 * off / 1000, perplexity.LEAST_DEVIATION)


def word_rows():
    """(doc_id, text, lang): English, Russian, Chinese and rows without a language, with copies and odd rows."""
    rng = random.Random(12)
    vocabularies = {
        "en": "the of and River stone under mill, bridge boats water 12 13".split(), "ru": "вода река камень мост под ветер ночь лодка и над тихо".split(),
        "zh": "水 河 石 桥 下 风 夜 船 木 山".split(), None: "été à naïve cœur où".split(),
    }
    rows = []
    for lang, known in vocabularies.items():
        join = "" if lang == "zh" else " "
        texts = [join.join(rng.choice(known[: 3 + i % 9]) for _ in range(30 + i % 40)) for i in range(45)]
        if lang == "zh":
            texts = [" ".join(t[i : i + 2] for i in range(0, len(t), 2)) for t in texts]
        rows += [(t, lang) for t in [*texts, *texts[:1] * 20, *texts[3:5]]]
    odd = [(None, "en"), ("", "ru"), (" \n", "zh"), ("alone in its own language as ten words are here now", "xx"), (rows[0][0], "ru"), ("\t".join(f"new{i}" for i in range(40)), "en")]
    # Letters that the symbols fold together: other words, the same symbols.
    swapped = "".join(chr(ord(c) + 7) if "а" <= c <= "и" else chr(ord(c) - 7) if "й" <= c <= "п" else c for c in next(t for t, g in rows if g == "ru"))
    return [(i, *r) for i, r in enumerate([*rows, *odd, (swapped, "ru")])]


def test_word_figures_and_kept_equal_a_plain_model(spark):
    rows = word_rows()
    judged = perplexity.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3, "doc_id"), ["doc_id"]).collect()
    got = {r.row.doc_id: r for r in judged}
    want = slow_word_figures([(t, g) for _, t, g in rows])
    bands = {}
    for lang in {g for _, _, g in rows}:
        first = {t: (got[i].figure, got[i].word_figure) for i, t, g in rows if g == lang}
        bands[lang] = [slow_band([f[k] for f in first.values() if f[k] is not None] or [0]) for k in (0, 1)]
    for (i, text, lang), figure in zip(rows, want):
        r = got[i]
        assert r.word_figure == (None if figure is None else pytest.approx(figure, abs=1e-9))
        n_words, word_chars, _, _, repeated = slow_counts(text)
        kept = n_words >= 10 and 100 * repeated <= 20 * n_words
        if kept:
            (m, d), (wm, wd) = bands[lang]
            kept = abs(r.figure - m) <= 3 * math.sqrt(d * d + 2 / (word_chars + n_words)) and r.word_figure <= wm + 3 * math.sqrt(wd * wd + 16 / n_words)
        assert r.kept == kept
    assert len(judged) == len(rows) and 60 < sum(r.kept for r in judged) < len(rows)


def test_letters_are_not_folded_together(spark):
    """A text whose words no other text holds, though all its symbols are those of a text that is kept."""
    known = "камни лодка бабка мягко глина дождь книга банка егоза".split()
    rng = random.Random(5)
    texts = [" ".join(rng.choice(known) for _ in range(60)) for _ in range(60)]
    other = texts[0].translate({ord(c): ord(c) + 7 for c in "абвгдежзи"} | {ord(c): ord(c) - 7 for c in "йклмноп"})
    assert other.encode().translate(perplexity.ALPHABET) == texts[0].encode().translate(perplexity.ALPHABET)
    docs = spark.createDataFrame([(i, t, "ru") for i, t in enumerate([*texts, other])], "doc_id long, text string, lang string")
    got = {r.row.doc_id: r for r in perplexity.judge(docs, ["doc_id"]).collect()}
    assert got[0].figure == got[60].figure and got[0].kept and not got[60].kept and sum(r.kept for r in got.values()) >= 50


def test_blocks_shards_and_passes_do_not_show(spark, monkeypatch, tmp_path):
    """Copies within a block, across blocks and in equal blocks; a model of one language a pass."""
    rows = word_rows()
    path = str(tmp_path / "docs")
    docs = spark.createDataFrame(rows + rows, "doc_id long, text string, lang string").coalesce(1)
    docs.write.parquet(path)

    def judged():
        found = perplexity.judge(spark.read.parquet(path), ["doc_id"], stored=True).collect()
        return Counter((r.row.doc_id, r.figure and round(r.figure, 6), r.word_figure and round(r.word_figure, 9), r.kept) for r in found)

    whole = judged()
    assert sum(whole.values()) == 2 * len(rows)
    for bytes_ in (400, 20_000):
        monkeypatch.setattr(word_pairs, "BLOCK_BYTES", bytes_)
        monkeypatch.setattr(word_pairs, "SHARD_BYTES", 5_000)
        monkeypatch.setattr(perplexity, "MODEL_BYTES", bytes_)
        assert judged() == whole


def test_tasks_get_the_word_model_as_code():
    """Workers need not have the package: what a task runs is pickled whole, with no module of it by name."""
    from pyspark import cloudpickle

    parts = cloudpickle.dumps([perplexity.blocks, perplexity.weighed])
    script = "import pickle, sys; sys.path = [p for p in sys.path if p not in ('', sys.argv[1])]; blocks, weighed = pickle.load(sys.stdin.buffer); print(list(blocks([])))"
    done = subprocess.run([sys.executable, "-c", script, os.path.dirname(entry_module.__file__)], input=parts, capture_output=True, cwd="/", env={**os.environ, "PYTHONPATH": ""})
    assert done.stdout == b"[]\n", done.stderr


def test_block_without_an_answer_fails(tmp_path):
    with pytest.raises(ValueError, match="second reading"):
        word_pairs.totals(tmp_path.as_uri(), 0, np.array([1]), np.array([1]))


def test_packed_integers_and_words_of_scripts_without_spaces():
    values = np.array([0, 1, 254, 255, 256, 1 << 40, 3])
    assert word_pairs.unpack(word_pairs.pack(values), len(values)).tolist() == values.tolist()
    assert word_pairs.unpack(word_pairs.pack(values[:0]), 0).tolist() == []
    for texts in (["a bc\x0bc  ", None, "", "水河a石 été", "x水", "水 ไท", "a𠀀b", "é\xa0é"], ["", None]):
        found, sizes = word_pairs.words(texts)
        want = [["a", "bc", "c"], [], [], ["水", "河", "a", "石", "été"], ["x", "水"], ["水", "ไ", "ท"], ["a", "𠀀", "b"], ["é\xa0é"]][: len(texts)] if texts[0] else [[], []]
        assert sizes.tolist() == list(map(len, want))
        flat = sum(want, [])
        assert len(set(found.tolist())) == len(set(flat)) and all((found[i] == found[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


# --- 7 ------------------------------------------------------------------------------------------------------------


def slow_components(rows, words, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [(rows[i][0], len(sets[i]), min(rows[j][0] for j in range(len(rows)) if find(j) == find(i))) for i in range(len(rows))]


@pytest.mark.parametrize("words,percent,frequent", [(3, 90, 2), (5, 80, 2), (3, 90, 16)])
def test_join_against_all_pairs(spark, words, percent, frequent):
    """Groups far over the frequent limit, chains near the threshold, and passages shared by unlike texts."""
    rng = random.Random(words * percent)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(6):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(40, 260))]
        for _ in range(rng.randint(2, 30)):
            for _ in range(rng.randint(0, 3)):
                text = list(text)
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(" ".join(text))
    rows += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(2, 60))]) for _ in range(40)]
    rows += [" ".join(rng.sample(passage, 30)) for _ in range(20)] + ["", None, "v1", "V1", "v1 v2"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(docs, words, percent, frequent=frequent).collect())
    want = sorted(slow_components(rows, words, percent))
    assert got == want


def test_only_combinations_with_a_heavy_set_are_joined(spark):
    rows = [(k, True, k < 20 and r == 0, 10 * k + r, 50) for k in range(2000) for r in range(3)] + [(7, False, False, 1, 50)]
    kept = jaccard.near_heavy(spark.createDataFrame(rows, "key long, combined boolean, heavy boolean, rep long, n int"))
    assert {(r.key, r.heavy, r.rep) for r in kept.collect()} == {(k, h, r) for k, c, h, r, _ in rows if c and k < 20}
    plan = jaccard.single_pairs(spark.createDataFrame(rows, "key long, combined boolean, heavy boolean, rep long, n int"), 90)
    assert "SortMergeJoin" in plan._jdf.queryExecution().sparkPlan().toString()


def test_rows_link_by_their_texts_not_their_ids(spark):
    docs = spark.createDataFrame([(5, "a b c d e"), (5, "p q r s t"), (3, "a b c d e"), (4, "P q r s t"), (None, "a b c d e"), (None, "x y z")], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in jaccard.link(docs, 3, 90).collect())
    assert got == Counter([(5, 3), (5, 4), (3, 3), (4, 4), (None, 3), (None, None)])


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {r.root for r in jaccard.components(edges).collect()} == {0}


# --- 8, 9 ---------------------------------------------------------------------------------------------------------


def fuzz():
    rng = random.Random(8)
    letters = [*"ab  \n\t'sé.1▁\xa0　<|>\x00", "<|endoftext|>", "▁▁", " ", " ", "\r\n"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + [r[1] for r in edge_documents()]


def test_token_counts_equal_the_library(spark, edge_dir):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in fuzz()]
    assert token_counts.PartCounter(path).count(fuzz()) == want
    got = rows_of(spark, "op8_token_counts", edge_dir)
    expected = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in edge_documents()]
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == Counter(expected)
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)


def test_pieces_equal_the_library(spark, edge_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = pieces_module.processor(path)
    table = pieces_module.WordTable(path)
    assert [np.frombuffer(x, np.int32).tolist() for x in table.encode(fuzz())] == [library.encode(t or "") for t in fuzz()]
    expected = []
    for r in edge_documents():
        ids = library.encode(r[1] or "")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids) if ids else "")]
        expected.append((r[0], len(ids), *digests))
    got = rows_of(spark, "op9_sentence_pieces", edge_dir)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == Counter(expected)


# --- 10 -----------------------------------------------------------------------------------------------------------


def test_archives_can_be_sought(spark, edge_dir, tmp_path):
    import glob
    import gzip
    import json

    pages = spark.read.parquet(f"{edge_dir}/pages.parquet")
    files = warc.write_archives(pages, f"file:{tmp_path}/streams")
    index = warc.normalise(files, f"file:{tmp_path}/members")
    payloads = Counter(bytes(r.payload) for r in warc.read_records(index, f"file:{tmp_path}/members").collect() if r.record_type == "response")
    assert set(payloads) == {(r.html or "").encode() for r in pages.collect()}
    for path in glob.glob(f"{tmp_path}/members/*.gz"):
        entries = [json.loads(line) for line in open(path + ".idx")]
        whole = gzip.open(path).read()  # still one valid archive
        parts = []
        with open(path, "rb") as file:
            for e in entries:
                file.seek(e["offset"])
                parts.append(gzip.decompress(file.read(e["length"])))
        assert b"".join(parts) == whole and all(p.startswith(b"WARC/1.1\r\n") for p in parts)


def test_stream_takes_members_and_refuses_torn_files():
    import io
    import zlib

    def packed(data):
        gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
        return gzip.compress(data) + gzip.flush()

    records = [warc.record("response", "u", str(i), i, None, b"x" * (i * 70_000), "D") for i in range(8)]
    for data in (packed(b"".join(records)), b"".join(map(packed, records))):
        assert [r for _, r in warc.RecordStream(io.BytesIO(data))] == records
    with pytest.raises(ValueError):
        list(warc.RecordStream(io.BytesIO(packed(b"".join(records)[:-10]))))


# --- plain versions row by row --------------------------------------------------------------------------------------


def test_mix_takes_the_documents_of_a_plain_walk(spark, sf, edge_dir):
    """Which document is taken how often, against sorting each source by hash in one place."""
    from pyspark.sql import functions as F

    for folder in (sf, edge_dir):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        h = F.xxhash64(F.lit(0), F.col("doc_id").isNull(), F.col("doc_id"), F.col("text"))
        by = defaultdict(list)
        for r in docs.select("doc_id", "source", "text", h.alias("h")).collect():
            by[r.source].append((r.h, len((r.text or "").encode().split()), r.doc_id))
        sizes = {s: sum(n for _, n, _ in by[s]) for s in mixing.in_order(by)}
        goal = mixing.targets(sizes, mixing.cycle_weights(sizes), 3)
        want = Counter()
        for s, rows in by.items():
            whole, rest = divmod(round(goal[s]), sizes[s]) if sizes[s] else (0, 0)
            rows.sort(key=lambda r: r[0])
            so_far, taken = 0, 0
            for _, n, _ in rows:
                if so_far + n > rest:
                    break
                so_far, taken = so_far + n, taken + 1
            gap = rest - so_far
            near = [(abs(n - gap), x, i) for i, (x, n, _) in enumerate(rows) if i >= taken and abs(n - gap) < gap]
            more = min(near)[2] if near else -1
            for i, (_, n, doc_id) in enumerate(rows):
                want[doc_id, n * (whole + (i < taken) + (i == more)) if n else 0] += 1
        assert Counter((r["doc_id"], r["taken"]) for r in rows_of(spark, "op2_mix_flow", folder)) == want


def test_classifier_equals_plain_ridge_and_pooling(spark, sf):
    """All scores of a whole table against normal equations, pooling and interpolation in one place."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("apart")).collect()
    marks = {r.doc_id: float(r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    x = np.array([quality.statistics(r.text) for r in docs])
    known = np.array([r.doc_id in marks and binascii.crc32(str(r.doc_id).encode()) % 3 != 1 for r in docs])
    apart = known & np.array([r.apart for r in docs])
    y = np.array([marks.get(r.doc_id, 0.0) for r in docs])
    z = quality.Cosines(x[known].mean(axis=0), x[known].std(axis=0))(x)
    fit = known & ~apart
    stacked = np.vstack([z[fit], np.sqrt(quality.RIDGE * fit.sum()) * np.eye(z.shape[1])])
    weights = np.linalg.lstsq(stacked, np.concatenate([y[fit], np.zeros(z.shape[1])]), rcond=None)[0]
    raw = np.clip(z @ weights, -1, 2)
    bins = np.round(raw[apart] * quality.BINS).astype(int)
    places = np.unique(bins)
    n, k = np.array([(bins == b).sum() for b in places]), np.array([y[apart][bins == b].sum() for b in places])
    # The isotonic value at i is the largest of the least means over intervals around i.
    means = np.full((len(places), len(places)), np.inf)
    for a in range(len(places)):
        means[a, a:] = np.cumsum(k[a:]) / np.cumsum(n[a:])
    level = np.array([max(means[a, i:].min() for a in range(i + 1)) for i in range(len(places))])
    groups = [np.flatnonzero(np.isclose(level, v)) for v in np.unique(np.round(level, 12))]
    at = np.array([np.average(places[g] / quality.BINS, weights=n[g]) for g in groups])
    values = np.array([level[g[0]] for g in groups])
    want = dict(zip([r.doc_id for r in docs], np.clip(np.interp(raw, at, values), 0, 1)))
    got = {r["doc_id"]: r["score"] for r in rows_of(spark, "op4_quality_classifier", sf)}
    assert got.keys() == want.keys() and max(abs(got[d] - want[d]) for d in want) < 1e-4


def test_boxes_of_cells_spare_most_of_the_shipping(spark, monkeypatch):
    """Clustered rows in forty shards and more: few (query, shard) pairs are shipped, and the answers are those of brute force."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(kdtree, "SHARD_ROWS", 50)
    monkeypatch.setattr(kdtree, "BLOCK_QUERIES", 16)
    monkeypatch.setattr(kdtree, "LEAF_ROWS", 8)
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 10, (20, 6))
    x = np.vstack([centres[i % 20] * (1 + i % 3) + rng.normal(0, 0.3, 6) for i in range(2000)]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(6)
    stored, real = {}, kdtree.cut
    monkeypatch.setattr(kdtree, "cut", lambda df, name="step": stored.setdefault(name, real(df, name)))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in kdtree.top_k(rows, F.col("vec_id") % 20 == 0, 5).collect()}
    exact = np.floor(x.astype(np.float64) * 256).astype(np.int64)
    scores = exact[::20] @ exact.T
    for j, q in enumerate(range(0, 2000, 20)):
        order = [i for i in np.lexsort((np.arange(2000), -scores[j])) if i != q][:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, scores[j, i]) for i in order]
    shards = stored["celled"].groupBy("cell").count().selectExpr("sum(ceil(count / 50)) n").first().n
    pairs = stored["routes"].count()
    assert shards >= 40 and pairs < 0.25 * 100 * (shards - 1)


def test_repeated_query_rows_are_answered_once(twin, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [0.5, 0.5]), (2, [0.25, 1.0]), (2, [0.25, 1.0]), (50, [0.1, 0.1])]
    pq.write_table(pa.table({"vec_id": pa.array([a for a, _ in rows], pa.int64()), "embedding": pa.array([b for _, b in rows], pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    got, want = twin("op3_kd_search", str(tmp_path))
    assert got == want and len(got) == 9


# --- pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf, edge_dir):
    import corpus_pipeline as pipeline

    for folder in (sf, edge_dir):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        frames = [docs.collect()]
        current = docs
        for i, (_, stage) in enumerate(pipeline.STAGES):
            current = stage(spark, current, folder)
            if i < len(pipeline.STAGES) - 1:
                assert current.columns == docs.columns
                rows = current.collect()
                current = spark.createDataFrame(rows, docs.schema)
                frames.append(rows)
            else:
                coded = current.collect()
        source, good, lines, unique, mixed = frames
        failed = [slow_counts(r.text) for r in source]
        sound = sum(not (c[0] < 10 or 100 * c[4] > 20 * c[0]) for c in failed)
        assert 0.85 * sound <= len(good) <= sound  # the bands take some junk, and leave clean documents alone
        # Lines: what every tenth kept document holds is gone.
        def key(line):
            return line.strip(" \t\n\x0b\x0c\r").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))

        seen = Counter(k for r in good for k in {key(x) for x in (r.text or "").split("\n")} if k)
        want = Counter("\n".join(x for x in (r.text or "").split("\n") if seen[key(x)] < 10) for r in good)
        assert Counter(r.text for r in lines) == want and all(r.n_chars == len(r.text) for r in lines)
        groups = slow_components([(r.doc_id, r.text) for r in lines if r.doc_id is not None], 5, 80)
        left = {d for d, n, c in groups if d == c or not n}
        assert {r.doc_id for r in unique if r.doc_id is not None} == left
        counts = Counter(r.doc_id for r in mixed)
        assert set(counts) <= {r.doc_id for r in unique} and max(counts.values(), default=0) <= 3
        sizes = defaultdict(list)
        for r in unique:
            sizes[r.source].append(len((r.text or "").encode().split()))
        totals = {s: sum(sizes[s]) for s in mixing.in_order(sizes)}
        goal = mixing.targets(totals, mixing.cycle_weights(totals), 3)
        taken = Counter()
        for r in mixed:
            taken[r.source] += len(r.text.encode().split())
        assert all(abs(taken[s] - goal[s]) <= max(sizes[s]) for s in sizes)
        assert Counter(r.doc_id for r in coded) == counts
        texts = {r.doc_id: r.text for r in mixed}
        assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].replace("▁", " ").encode()).hexdigest() for r in coded)


def test_pipeline_runs_whole(spark, sf):
    import corpus_pipeline as pipeline

    got = pipeline.run(spark, sf)
    assert "ids" in got.columns and got.count() > 0
