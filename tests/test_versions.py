"""The ordered diff and the merge order of chunk groups against plain versions."""

import random
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import pytest

from loomlog.operators import diff as DF
from loomlog.operators import forest as FO


def plain_run(values):
    """Places of the longest rising run that patience sorting finds."""
    ends, at, back = [], [], []
    for i, value in enumerate(values):
        k = bisect_left(ends, value)
        back.append(at[k - 1] if k else None)
        ends[k : k + 1], at[k : k + 1] = [value], [i]
    run, i = [], at[-1] if at else None
    while i is not None:
        run.append(i)
        i = back[i]
    return run[::-1]


def plain_diff(a, b):
    """(kind, a line, b line) in order, by recursion."""
    out = []

    def between(a0, a1, b0, b1):
        left, right = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {t: j for j, t in enumerate(b[b0:b1], b0) if right[t] == 1}
        anchors = [(i, at[t]) for i, t in enumerate(a[a0:a1], a0) if left[t] == 1 and t in at]
        anchors = [anchors[k] for k in plain_run([j for _, j in anchors])]
        if anchors:
            for i, j in anchors:
                between(a0, i, b0, j)
                out.append(("equal", i + 1, j + 1))
                a0, b0 = i + 1, j + 1
            between(a0, a1, b0, b1)
            return
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append(("equal", a0 + 1, b0 + 1))
            a0, b0 = a0 + 1, b0 + 1
        same = 0
        while a1 - same > a0 and b1 - same > b0 and a[a1 - same - 1] == b[b1 - same - 1]:
            same += 1
        out.extend(("delete", i + 1, None) for i in range(a0, a1 - same))
        out.extend(("insert", None, j + 1) for j in range(b0, b1 - same))
        out.extend(("equal", a1 - k + 1, b1 - k + 1) for k in range(same, 0, -1))

    between(0, len(a), 0, len(b))
    return out


def edited(rng):
    a = [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice(["", "", "1", "2"]) for _ in range(rng.randint(0, 45))]
    b = [t for t in a if rng.random() < 0.85]
    for _ in range(rng.randint(0, 6)):
        if b and rng.random() < 0.5:  # move a stretch
            i, n = rng.randrange(len(b)), rng.randint(1, 6)
            part = b[i : i + n]
            del b[i : i + n]
            j = rng.randint(0, len(b))
            b[j:j] = part
        else:
            b.insert(rng.randint(0, len(b)), rng.choice("abcxyz"))
    if rng.random() < 0.15:
        rng.shuffle(b)
    return a, b


def frames(spark, cases):
    make = lambda k: spark.createDataFrame(
        [(s, i, t) for s, pair in cases.items() for i, t in enumerate(pair[k], 1)], "session_id string, line bigint, text string")
    return make(0), make(1)


def test_scripts_equal_a_plain_patience_diff(spark):
    rng = random.Random(11)
    cases = {f"s{i}": edited(rng) for i in range(150)}
    cases["reference"] = (["a", "b", "c"], ["a", "c", "d"])
    cases["no anchors"] = (["a", "a"], ["a", "a", "a"])
    rows = DF.ordered_diff(*frames(spark, cases)).orderBy("session_id", "stretch", "k").collect()
    got = {s: [] for s in cases}
    for r in rows:
        got[r.session_id].append((r.kind, r.a_line, r.b_line))
        assert r.text == (cases[r.session_id][0][r.a_line - 1] if r.a_line else cases[r.session_id][1][r.b_line - 1])
    for s, (a, b) in cases.items():
        assert got[s] == plain_diff(a, b), s
    assert Counter(k for k, *_ in got["reference"]) == {"equal": 2, "insert": 1, "delete": 1}
    assert Counter(k for k, *_ in got["no anchors"]) == {"equal": 2, "insert": 1}


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_longest_run_in_blocks_of_any_size(spark, block):
    rng = random.Random(5)
    rows, want = [], {}
    for s in range(25):
        values = list(range(40))
        for _ in range(s):
            i, j, n = rng.randrange(40), rng.randrange(40), rng.randint(1, 5)
            part = values[i : i + n]
            del values[i : i + n]
            values[j:j] = part
        rows += [(f"s{s}", 7, 10 * i, 3 * v) for i, v in enumerate(values)]
        want[f"s{s}"] = [(10 * i, 3 * values[i]) for i in plain_run(values)]
    anchors = spark.createDataFrame(rows, "session_id string, stretch bigint, a_line bigint, b_line bigint")
    got = {s: [] for s in want}
    for r in DF.longest_run(anchors, block).orderBy("a_line").collect():
        got[r.session_id].append((r.a_line, r.b_line))
    assert got == want


def test_a_task_piles_many_stretches_cut_anywhere(spark):
    names = ["session_id", "stretch", "run", "y", "weight", "best", "end"]
    rows = [("a", 0, 4, None, None, 3, 9), ("b", 0, 1, 3, 2, None, None), ("b", 0, 3, 1, 1, None, None), ("b", 0, 4, 5, 1, None, None),
            ("b", 2, 1, None, None, 2, 4), ("b", 2, 6, 5, 1, None, None), ("c", 0, 1, 2, 1, None, None)]
    want = [("b", 0, 1, None, 2, None), ("b", 0, 3, None, 1, None), ("b", 0, 4, 1, 3, None), ("b", 0, 1, None, 2, 4), ("b", 0, 4, None, 3, 5),
            ("b", 2, 6, 1, 3, None), ("b", 2, 1, None, 2, 4), ("b", 2, 6, None, 3, 5), ("c", 0, 1, None, 1, None), ("c", 0, 1, None, 1, 2)]
    for n in (1, 2, 3, len(rows)):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[i : i + n]], pa.schema(
            [("session_id", pa.string()), *((c, pa.int64()) for c in names[1:])])) for i in range(0, len(rows), n)]
        got = [tuple(r.values()) for out in DF._pile(iter(batches)) for r in out.to_pylist()]
        assert sorted(got, key=str) == sorted([*want, ("b", 0, 3, None, 1, 1)], key=str)


def test_one_moved_line_leaves_two_runs_and_one_line(spark):
    """The lines of a long session are never ordered in one place: only its runs are."""
    n = 200_000
    a = spark.range(1, n + 1, 1, 8).selectExpr("'s' session_id", "id line", "cast(id as string) text")
    b = a.selectExpr("session_id", f"case when line = 100 then {n} when line < 100 then line else line - 1 end line", "text")
    ops = DF.ordered_diff(a, b)
    assert sorted((r.kind, r.a_line, r.b_line) for r in ops.where("kind <> 'equal'").collect()) == [("delete", 100, None), ("insert", None, n)]
    assert ops.count() == n + 1


# --- merge order ----------------------------------------------------------------------------------------------------


def plain_merges(rows):
    """(tip, line) in the order of merging; ``rows`` maps a line to (parent line, thinks)."""
    flag, gone, out = {line: thinks for line, (_, thinks) in rows.items()}, set(), []
    for tip in sorted(rows, reverse=True):
        if tip in gone:
            continue
        path, seen, at = [], set(), rows[tip][0]
        while at is not None and at not in seen and at not in gone:
            seen.add(at)
            path.append(at)
            at = rows[at][0]
        flags = [flag[tip], *(flag[x] for x in path)]
        if not path or not any(flags) or all(flags):
            continue
        gone.update(path)
        flag[tip] = True
        out += [(tip, x) for x in path]
    return out


def group(rng, kind):
    n = rng.randint(2, 16)
    lines = rng.sample(range(1, 40), n)
    if kind == "tree":  # parents come first in the file
        lines.sort()
    rows = {}
    for i, line in enumerate(lines):
        parent = rng.choice(lines[max(0, i - rng.choice([1, 2, 9])) : i]) if i and rng.random() < 0.95 else None
        rows[line] = (parent, rng.random() < 0.4)
    if kind == "cycle":
        for line in rng.sample(lines, rng.randint(1, 2)):
            rows[line] = (rng.choice(lines), rows[line][1])
    return rows


@pytest.mark.parametrize("kind", ["tree", "mixed order", "cycle"])
def test_merge_order_equals_a_plain_walk(spark, kind):
    rng = random.Random(len(kind))
    groups = {f"s{i}": group(rng, kind) for i in range(250)}
    frame = spark.createDataFrame([(s, line, *row) for s, rows in groups.items() for line, row in rows.items()], "session_id string, line bigint, parent_line bigint, thinks boolean")
    got = {s: [] for s in groups}
    for r in FO.merge_order(frame).orderBy("session_id", "tip_line", "depth").collect():
        got[r.session_id].append((r.tip_line, r.line))
    for s, rows in groups.items():
        want = sorted(plain_merges(rows), key=lambda x: x[0])
        assert got[s] == want, (s, rows)
    assert any(got.values())


def test_a_large_branched_group(spark):
    """A spine with a branch at every row, a hundred thousand rows in all."""
    n = 50_000
    spine = spark.range(1, n + 1, 1, 4).selectExpr("'s' session_id", "2 * id line", "case when id > 1 then 2 * id - 2 end parent_line", "false thinks")
    twigs = spark.range(1, n + 1, 1, 4).selectExpr("'s' session_id", "2 * id + 1 line", "2 * id parent_line", "true thinks")
    found = FO.merge_order(spine.unionByName(twigs))
    assert found.where(f"tip_line = {2 * n + 1}").count() == n == found.count()
