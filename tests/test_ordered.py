"""Block-wise scans against plain Python, with blocks far smaller than the sessions."""

import random
import shutil

from pyspark.sql import functions as F

from loomlog.operators import diff as DF
from loomlog.operators import graph as G
from loomlog.operators import ordered as O
from loomlog.operators import stats as S
from loomlog.functions.specs import Amount
from loomlog.plans import derived as D
from loomlog.sources import lines as L
from loomlog.sources import tables
from conftest import SF, to_lines


def test_running_over_blocks(spark):
    rng = random.Random(1)
    rows = [("hot", i, rng.randrange(9), rng.choice([None, str(i)])) for i in rng.sample(range(1, 500), 200)]
    rows += [(f"s{i}", 3, 1, None) for i in range(5)]
    df = spark.createDataFrame(rows, "session_id string, line bigint, x bigint, u string")
    got = {
        (r.session_id, r.line): (r.total, r.before, r.rn, r.top)
        for r in O.running(df, {
            "total": O.Running("sum", F.col("x")), "before": O.Running("last", F.col("u"), before=True),
            "rn": O.Running("sum", F.lit(1)), "top": O.Running("max", F.col("x"), before=True)}, size=16).collect()
    }
    want, last, total, n, top = {}, None, 0, 0, None
    for s, line, x, u in sorted(r for r in rows if r[0] == "hot"):
        total, n = total + x, n + 1
        want[s, line] = (total, last, n, top)
        last, top = u or last, x if top is None else max(top, x)
    assert {k: v for k, v in got.items() if k[0] == "hot"} == want
    assert len(got) == len(rows)


def test_session_values_and_first_rows(spark):
    df = spark.createDataFrame([("a", i, i % 7) for i in range(100)] + [("b", 1, 3)], "session_id string, line bigint, x bigint")
    got = O.with_session_values(df, {"hi": ("max", F.col("x")), "n": ("sum", F.lit(1))}, size=8)
    assert got.groupBy("session_id").agg(F.max("hi"), F.min("n")).orderBy("session_id").collect() == [("a", 6, 100), ("b", 3, 1)]
    sparse = df.where("line = 50").select("session_id", "line")
    spread = O.with_session_values(df, {"hit": ("max", F.col("line"))}, source=sparse, size=8)
    assert spread.where("hit = 50").count() == 100 and spread.where("hit is null").count() == 1
    assert [r.line for r in O.first_rows(df, 3, [F.col("line").desc()]).where("session_id = 'a'").orderBy("line").collect()] == [97, 98, 99]


def chain_by_hand(rows):
    last = {u: (line, p) for line, u, p in rows}
    used = {p for _, _, p in rows if p}
    free = [u for u in last if u not in used]
    at = max(free, key=lambda u: last[u][0]) if free else max(last, key=lambda u: last[u][0])
    out, seen = [], set()
    while at in last and at not in seen:
        seen.add(at)
        out.append(at)
        at = last[at][1]
    return out


def test_chain_matches_a_plain_walk(spark, monkeypatch):
    """Random links: branches, jumps back, missing parents, repeated uuids and cycles."""
    monkeypatch.setattr(G.segments, "__defaults__", (8,))
    rng = random.Random(7)
    sessions, values = {}, []
    for s in range(12):
        rows = []
        for i in range(1, 60):
            kind = rng.random()
            parent = None if i == 1 else f"u{i - 1}" if kind < 0.8 else f"u{rng.randrange(1, 60)}" if s % 3 == 0 else f"u{rng.randrange(1, i)}"
            uuid = f"u{i}" if kind < 0.97 else f"u{rng.randrange(1, i + 1)}"
            rows.append((i, uuid, parent if kind < 0.98 else "gone"))
        sessions[str(s)] = rows
        values += [(str(s), line, f'{{"type":"user","uuid":"{u}","parentUuid":{"null" if p is None else chr(34) + p + chr(34)}}}') for line, u, p in rows]
    lines = spark.createDataFrame(values, "session_id string, line bigint, raw string")
    linked = L.linked_lines(L.parse_lines(lines)).cache()
    got = {}
    for r in G.active_chain(linked).collect():
        got.setdefault(r.session_id, []).append((r.depth, r.uuid))
    for s, rows in sessions.items():
        assert [u for _, u in sorted(got[s])] == chain_by_hand(rows), s


def test_relink_over_any_number_of_removed_rows(spark):
    values = [{"type": "user", "uuid": f"u{i}", "parentUuid": f"u{i - 1}" if i > 1 else None} for i in range(1, 181)]
    linked = L.linked_lines(L.parse_lines(to_lines(spark, values)))
    gone = L.entries(linked).where("line between 20 and 169").select("session_id", "line")
    [row] = G.relinked_parents(linked, gone).collect()
    assert (row.line, row.new_parent) == (170, "u19")
    whole = L.entries(linked).where("line < 170").select("session_id", "line")
    [row] = G.relinked_parents(linked, whole).collect()
    assert row.new_parent is None


def relinked_by_hand(rows, gone):
    """{line: new parent} of the kept rows of one session; rows are (line, uuid, parent)."""
    last = {u: p for line, u, p in rows if line in gone}
    out = {}
    for line, _, parent in rows:
        if line not in gone and parent in last:
            seen = set()
            while parent in last and parent not in seen:
                seen.add(parent)
                parent = last[parent]
            out[line] = None if parent in last else parent
    return out


def test_relink_by_condition_and_by_table_match_a_plain_walk(spark, monkeypatch):
    """Random links and removals: branches, missing parents, repeated uuids, cycles; a condition may be NULL."""
    monkeypatch.setattr(G.segments, "__defaults__", (8,))
    rng = random.Random(11)
    values, want = [], {}
    for s in range(10):
        rows = []
        for i in range(1, 60):
            kind = rng.random()
            parent = None if i == 1 else f"u{i - 1}" if kind < 0.8 else f"u{rng.randrange(1, 60)}" if s % 3 == 0 else f"u{rng.randrange(1, i)}"
            rows.append((i, f"u{i}" if kind < 0.97 else f"u{rng.randrange(1, i + 1)}", parent if kind < 0.98 else "x"))
        gone = {i for i in range(1, 60) if i % 7 not in (s % 7, (s + 3) % 7)}
        want |= {(str(s), line): p for line, p in relinked_by_hand(rows, gone).items()}
        values += [(str(s), i, f'{{"type":"user","uuid":"{u}","parentUuid":{"null" if p is None else chr(34) + p + chr(34)}}}') for i, u, p in rows]
    linked = L.linked_lines(L.parse_lines(spark.createDataFrame(values, "session_id string, line bigint, raw string"))).cache()
    goes = F.expr("case when line % 7 <> session_id % 7 and line % 7 <> (session_id + 3) % 7 then true end")
    removed = L.entries(linked).where(goes).select("session_id", "line")
    for asked in (goes, removed, removed.unionByName(removed)):
        got = G.relinked_parents(linked, asked).collect()
        assert {(r.session_id, r.line): r.new_parent for r in got} == want and len(got) == len(want)
    assert None in want.values()


def test_two_lines_before_over_blocks(spark):
    """The runs' two lines before, as two passes of running values give them, but each row is shuffled once with its columns."""
    rng = random.Random(5)
    rows = [("hot", i + 1, i, "x") for i in rng.sample(range(400), 150)] + [("a", i + 1, i, None) for i in (3, 90, 91, 300)] + [("b", 8, 7, "y")]
    df = spark.createDataFrame(rows, "session_id string, line bigint, e bigint, other string")
    found = D._two_before(df, 8)
    want = []
    for s in ("hot", "a", "b"):
        es = sorted(e for t, _, e, _ in rows if t == s)
        want += [(s, e, es[k - 1] if k > 0 else None, es[k - 2] if k > 1 else None) for k, e in enumerate(es)]
    assert sorted(found.select("session_id", "e", "prev", "prev2").collect()) == sorted(want)
    twice = O.running(O.running(df, {"prev": O.Running("last", F.col("e"), before=True)}, size=8), {"prev2": O.Running("last", F.col("prev"), before=True)}, size=8)
    assert sorted(twice.select("session_id", "e", "prev", "prev2").collect()) == sorted(want)
    wide = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [lag(e" in line]
    assert len(wide) == 1


def test_runs_store_their_typed_lines_only(spark, tmp_path):
    shutil.copy(f"{SF}/events.parquet", tmp_path)
    assert D.linked(spark, str(tmp_path), "runs").count() == spark.read.parquet(str(tmp_path)).count()
    assert [name for _, source, name in tables._known if source == str(tmp_path)] == ["linked_runs"]


def test_relink_and_turns_end_at_cycles(spark):
    values = [{"type": "assistant", "uuid": f"u{i}", "parentUuid": f"u{p}", "message": {"role": "assistant", "content": []}} for i, p in ((1, 3), (2, 1), (3, 2), (4, 3))]
    linked = L.linked_lines(L.parse_lines(to_lines(spark, values)))
    gone = L.entries(linked).where("line < 4").select("session_id", "line")
    [row] = G.relinked_parents(linked, gone).collect()
    assert (row.line, row.new_parent) == (4, None)


def test_a_chain_of_sixty_thousand_rows(spark):
    """Every third row hangs on the row two above, so the walk has to jump between segments."""
    lines = spark.range(1, 90_001).selectExpr(
        "'s' session_id", "id line",
        """concat('{"type":"user","uuid":"u', id, '","timestamp":"2024-01-01T00:00:00Z","parentUuid":', case when id = 1 then 'null' when id % 3 = 0 then concat('"u', id - 2, '"')
           else concat('"u', id - 1, '"') end, ',"message":{"role":"user","content":"x"}}') raw""")
    linked = L.linked_lines(L.parse_lines(lines))
    got = G.active_chain(linked).agg({"depth": "max", "line": "count"}).first()
    assert got["count(line)"] == got["max(depth)"] + 1 == 60_000


def test_pair_closure_takes_logarithmic_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(G, "cut", lambda df, *a, plain=G.cut: rounds.append(1) or plain(df, *a))

    def closed(n):
        rounds.clear()
        refs = spark.createDataFrame(
            [("s", i, side, f"t{t}") for i in range(n) for side, t in (("result", i - 1), ("use", i)) if t >= 0], "session_id string, line long, side string, tool_id string")
        out = G.pair_closure(refs, spark.createDataFrame([("s", 0)], "session_id string, line long"))
        return out.count(), len(rounds)

    (small, few), (large, more) = closed(20), closed(320)
    assert (small, large) == (20, 320) and more <= few + 12


def test_token_plans(spark):
    def plan(sizes, amount, keep=None):
        df = spark.createDataFrame([("s", i, t) for i, t in enumerate(sizes, 1)], "session_id string, line bigint, approx_tokens bigint")
        r = S.removal_plan(df, amount, keep).first()
        return r.remove_count, r.max_removable, r.total_tokens, r.target_tokens, r.selected_tokens

    assert plan([500, 5, 5, 5], Amount("percent", 10)) == (1, 4, 515, 51, 500)
    assert plan([800, 10, 10, 10, 10], Amount("percent", 25)) == (1, 5, 840, 210, 800)
    assert plan([1, 1, 1, 1], Amount("tokens", 10), 2) == (2, 2, 4, 4, 2)
    assert plan([0, 0], Amount("percent", 50)) == (0, 2, 0, 0, 0)
    assert plan([5, 5], Amount("tokens", 3), 9) == (0, 0, 10, 3, 0)


def test_gap_statistics(spark):
    rows = spark.sql("select 's' session_id, timestamp_millis(x * 1000) ts from values (0), (1), (3), (6), (10) t(x)")
    r = S.gap_stats(rows).first()
    assert (r.beats, r.gaps, r.gap_min, r.gap_median, r.gap_p95, r.gap_max, r.gaps_under_1s) == (5, 4, 1.0, 2.5, 3.0, 4.0, 0)
    twice = S.gap_stats(rows.unionByName(rows)).first()
    assert (twice.beats, twice.gaps, twice.gap_median, twice.gaps_under_1s) == (10, 9, 0.0, 5)


def apply_script(ops, a, b):
    assert [t for k, x, y, t in ops if k != "insert"] == a
    assert [t for k, x, y, t in ops if k != "delete"] == b


def test_ordered_diff(spark):
    cases = {
        "same": (["a", "b"], ["a", "b"]), "tail": (["a", "b", "c"], ["a", "x", "c", "d"]),
        "moved": (["a", "b", "c", "d"], ["d", "a", "b", "c"]), "empty": ([], ["q"]),
        "repeat": (["x", "x", "k", "x"], ["x", "k", "x", "x", "x"]),
    }
    rng = random.Random(3)
    for i in range(6):
        a = [rng.choice("abcdefghijklmnop") for _ in range(25)]
        cases[f"r{i}"] = (a, [t for t in a if rng.random() < 0.8] + [rng.choice("abz")])
    make = lambda k: spark.createDataFrame(
        [(s, i, t) for s, pair in cases.items() for i, t in enumerate(pair[k], 1)], "session_id string, line bigint, text string")
    ops = DF.ordered_diff(make(0), make(1)).orderBy("session_id", "stretch", "k").collect()
    by = {}
    for r in ops:
        by.setdefault(r.session_id, []).append((r.kind, r.a_line, r.b_line, r.text))
    for s, (a, b) in cases.items():
        apply_script(by[s], a, b)
    assert [o[0] for o in by["moved"]] == ["insert", "equal", "equal", "equal", "delete"]
    assert [o[0] for o in by["tail"]] == ["equal", "delete", "insert", "equal", "insert"]
    counts = DF.summary(DF.multiset_diff(make(0), make(1)), "n").where("session_id = 'moved'").first()
    assert (counts.equal, counts["insert"], counts["delete"]) == (4, 0, 0)
