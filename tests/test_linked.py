"""Checks and repairs of the linked format on small sessions."""

import json

from conftest import to_lines
from pyspark.sql import functions as F

from loomlog.functions import edits as ED
from loomlog.functions.specs import Amount
from loomlog.operators import checks as C
from loomlog.operators import compact as CP
from loomlog.operators import graph as G
from loomlog.operators import rewrite as R
from loomlog.operators import rewrite_linked as RL
from loomlog.operators import stats as S
from loomlog.plans import guarded as GP
from loomlog.session import cut
from loomlog.sources import lines as L


def user(uuid, parent=None, content="hi", **extra):
    return {"type": "user", "uuid": uuid, "parentUuid": parent, "message": {"role": "user", "content": content}, **extra}


def bot(uuid, parent, *blocks, **extra):
    return {"type": "assistant", "uuid": uuid, "parentUuid": parent, "message": {"role": "assistant", "content": list(blocks)}, **extra}


def text(t="ok"):
    return {"type": "text", "text": t}


def think(t="hm"):
    return {"type": "thinking", "thinking": t, "signature": "x"}


def use(i):
    return {"type": "tool_use", "id": i, "name": "run", "input": {"b": 1, "a": 2}}


def result(i):
    return {"type": "tool_result", "tool_use_id": i, "content": "done"}


def typed(spark, values, session="s"):
    return cut(L.linked_lines(cut(L.parse_lines(to_lines(spark, values, session)))))


def codes(linked):
    rows = GP.LINKED.issues(linked).collect()
    return sorted((r.code.split(".")[1], r.line) for r in rows)


def errors(linked):
    return [r.code for r in GP.LINKED.issues(linked).where("severity = 'error'").collect()]


def rewritten(rewrite):
    return [json.loads(r.raw) for r in rewrite.lines.orderBy("line", "sub").collect()]


def again(spark, rewrite):
    return cut(L.linked_lines(cut(L.parse_lines(R.renumber(rewrite.lines)))))


def reasons(rewrite):
    return sorted((r.kind, r.line, r.reason) for r in rewrite.changes.collect())


def test_clean_session(spark):
    linked = typed(spark, [user("a"), bot("b", "a", text())])
    assert codes(linked) == []
    assert [r.raw for r in RL.fix(linked).lines.orderBy("line").collect()] == [r.raw for r in linked.orderBy("line").collect()]


def test_orphan_result(spark):
    linked = typed(spark, [user("a"), bot("b", "a", text()), user("c", "b", [result("x")]), bot("d", "c", text())])
    assert codes(linked) == [("orphan_tool_result", 3)]
    fixed = RL.fix(linked)
    assert errors(again(spark, fixed)) == []
    assert [v["parentUuid"] for v in rewritten(fixed)] == [None, "a", "b"]
    assert reasons(fixed) == [("delete_line", 3, "orphan_result"), ("update_line", 4, "relinked")]


def test_broken_parent_is_linked_to_the_row_above(spark):
    linked = typed(spark, [user("a"), user("b", "missing"), bot("c", "b", text())])
    assert codes(linked) == [("broken_parent_chain", 2)]
    assert rewritten(RL.fix(linked))[1]["parentUuid"] == "a"
    top = typed(spark, [user("a", "missing")])
    assert rewritten(RL.fix(top))[0]["parentUuid"] is None


def test_streaming_chunks_collapse(spark):
    rows = [
        user("u"), bot("a", "u", text("one"), requestId="r"), bot("b", "a", think(), use("t1"), requestId="r"),
        bot("c", "b", text("three"), use("t2"), requestId="r"), user("d", "c", [result("t1"), result("t2")]),
    ]
    linked = typed(spark, rows)
    assert ("thinking_block_order_merged", 3) in codes(linked)
    out = rewritten(RL.fix(linked))
    assert [v["uuid"] for v in out] == ["u", "c", "d"]
    assert [b["type"] for b in out[1]["message"]["content"]] == ["thinking", "text", "tool_use", "text", "tool_use"]
    assert out[1]["parentUuid"] == "u"
    assert list(out[1]["message"]["content"][2]["input"]) == ["b", "a"]
    assert errors(again(spark, RL.fix(linked))) == []


def test_chunks_stay_when_every_one_starts_with_thinking(spark):
    linked = typed(spark, [user("u"), bot("a", "u", think(), requestId="r"), bot("b", "a", think(), text(), requestId="r")])
    assert len(rewritten(RL.fix(linked))) == 3
    plain = typed(spark, [user("u"), bot("a", "u", text(), requestId="r"), bot("b", "a", text(), requestId="r")])
    assert len(rewritten(RL.fix(plain))) == 3


def test_branched_chunks_last_line_first(spark):
    rows = [user("u"), bot("a", "u", text("a"), requestId="r"), bot("b", "a", think(), requestId="r"), bot("c", "a", think(), requestId="r")]
    out = rewritten(RL.fix(typed(spark, rows)))
    assert [v["uuid"] for v in out] == ["u", "b", "c"]
    assert [b["type"] for b in out[2]["message"]["content"]] == ["thinking", "text"]
    assert out[1]["parentUuid"] == "u"


def test_options(spark):
    rows = [user("u"), bot("a", "u", use("open")), bot("b", "a", text(), isApiErrorMessage=True), bot("c", "b", think(), text())]
    linked = typed(spark, rows)
    assert [v["uuid"] for v in rewritten(RL.fix(linked))] == ["u", "c"]
    assert [v["uuid"] for v in rewritten(RL.fix(linked, RL.PRE_RELOAD))] == ["u", "a", "c"]
    tomb = rewritten(RL.fix(linked, RL.FixOptions(tombstone=True, strip_thinking=True)))
    assert [v["uuid"] for v in tomb] == ["u", "a", "b", "c"]
    assert tomb[1]["message"]["content"] == [{"type": "text", "text": "[removed]"}]
    assert tomb[3]["message"]["content"] == [text()]
    bare = rewritten(RL.fix(typed(spark, [bot("a", None, think())]), RL.FixOptions(strip_thinking=True)))
    assert bare[0]["message"]["content"] == [{"type": "text", "text": "(thinking removed)"}]


def test_resume_chain_is_merged_across_results(spark):
    rows = [
        user("u"), bot("a", "u", text(), message_id=1), user("r", "a", [result("t")]),
        bot("b", "r", think(), text()),
    ]
    for row in (rows[1], rows[3]):
        row["message"]["id"] = "m"
    linked = typed(spark, rows)
    [row] = G.resume_violations(linked).collect()
    assert (row.violations, row.line, row.leaf_uuid, row.first_block_type, row.prompt_index) == (1, 2, "b", "text", 0)
    rows[2]["message"]["content"] = "a question"
    assert G.resume_violations(typed(spark, rows)).count() == 0


def test_branches_and_boundaries(spark):
    stamp = lambda m: f"2024-01-01T00:{m:02d}:00Z"
    rows = [user("a", timestamp=stamp(0)), bot("b", "a", text(), timestamp=stamp(1)), bot("c", "b", text(), timestamp=stamp(2)),
            bot("d", "a", text(), timestamp=stamp(9))]
    got = G.active_chain(typed(spark, rows)).orderBy(F.col("depth").desc()).collect()
    assert [r.uuid for r in got] == ["a", "d"]
    mark = {"type": "system", "subtype": "compact_boundary"}
    linked = typed(spark, [user("a"), {**mark, "uuid": "x"}, user("b"), user("c"), mark, user("d")])
    seg = [(r.segment, r.boundary_line, r.boundary_uuid, r.entries_in_segment) for r in S.segments(linked).orderBy("segment").collect()]
    assert seg == [(0, 0, "(start)", 1), (1, 2, "x", 2), (2, 5, "unknown", 1)]
    stats = S.session_stats(linked).first()
    assert (stats.entries, stats.boundaries, stats.visible_entries, stats.visible_messages) == (6, 2, 1, 1)


def test_duplicates_and_types(spark):
    linked = typed(spark, [user("a"), user("a", "a"), {"type": "progress"}, {"type": "system"}, "oops", [1]])
    assert codes(linked) == [
        ("duplicate_uuid", 1), ("invalid_json_line", 5), ("non_object_line", 6), ("unknown_entry_type", 3), ("unknown_entry_type", 4)]
    assert sorted(r.line for r in C.duplicate_uuid_lines(linked).collect()) == [1, 2]


def test_remove_takes_turn_and_pairs(spark):
    rows = [user("u"), bot("a", "u", text()), bot("b", "a", use("t")), user("r", "b", [result("t")]), bot("c", "r", text()), user("z", "c")]
    linked = typed(spark, rows)
    chosen = linked.where("line = 2").select("session_id", "line")
    out = RL.remove(linked, chosen)
    assert [(v["uuid"], v["parentUuid"]) for v in rewritten(out)] == [("u", None), ("c", "u"), ("z", "c")]
    assert [r for r in reasons(out) if r[0] == "delete_line"] == [
        ("delete_line", 2, "requested"), ("delete_line", 3, "assistant_turn"), ("delete_line", 4, "pair")]


def test_clean_leaves_other_sessions_alone(spark):
    both = typed(spark, [user("a"), user("b", "a", "SECRET word")], "x").unionByName(typed(spark, [user("a"), "broken"], "y"))
    out, matched = RL.clean(both, ["secret"])
    assert [(r.session_id, r.line) for r in out.lines.orderBy("session_id", "line").collect()] == [("x", 1), ("y", 1), ("y", 2)]
    assert [tuple(r) for r in matched.collect()] == [("x", 1)]


def compacted(spark, values, amount, **options):
    linked = typed(spark, values)
    chain = cut(G.active_chain(linked))
    visible = cut(CP.visible_messages(linked, chain, CP.root_users(linked, chain)))
    chosen = CP.plan_linked(visible, amount=amount)
    summaries = spark.createDataFrame([("s", "SUM")], "session_id string, summary string")
    return CP.compact_linked(linked, summaries, chosen, "2024-02-02T00:00:00Z", **options)


def four():
    return [user("a", cwd="/w", sessionId="s"), bot("b", "a", text()), user("c", "b"), bot("d", "c", text())]


def test_compaction_rewrites_a_plain_root(spark):
    out = rewritten(compacted(spark, four(), Amount("count", 2)))
    assert [(v["uuid"], v["parentUuid"]) for v in out] == [("a", None), ("c", "a"), ("d", "c")]
    assert out[0]["message"] == {"role": "user", "content": "SUM"}


def test_compaction_keeps_a_meta_root(spark):
    rows = four()
    rows[0]["isMeta"] = True
    out = rewritten(compacted(spark, rows, Amount("count", 2)))
    assert [v["message"]["content"] for v in out][:2] == ["hi", "SUM"]
    assert out[1]["parentUuid"] == "a" and out[2]["parentUuid"] == out[1]["uuid"]
    assert (out[1]["cwd"], out[1]["sessionId"], out[1]["isSidechain"]) == ("/w", "s", False)


def test_compaction_after_a_boundary(spark):
    mark = {"type": "system", "subtype": "compact_boundary", "uuid": "x", "parentUuid": "a"}
    rows = [user("a"), mark, user("b", "x"), bot("c", "b", text()), user("d", "c")]
    rewrite = compacted(spark, rows, Amount("count", 3))
    out = rewritten(rewrite)
    assert [v.get("uuid") for v in out][0] == "x" and out[1]["message"]["content"] == "SUM"
    assert (out[1]["parentUuid"], out[2]["uuid"], out[2]["parentUuid"]) == ("x", "d", out[1]["uuid"])


def test_compaction_tombstones(spark):
    out = rewritten(compacted(spark, four(), Amount("count", 2), tombstone=True))
    assert [v["uuid"] for v in out] == ["a", "b", "c", "d"]
    assert out[1]["message"]["content"] == [{"type": "text", "text": "[compacted]"}]


def test_compaction_by_tokens_and_pending(spark):
    linked = typed(spark, [user("a"), bot("b", "a", text("x" * 400)), user("c", "b"), bot("d", "c", text())])
    chain = cut(G.active_chain(linked))
    visible = cut(CP.visible_messages(linked, chain, CP.root_users(linked, chain)))
    chosen = CP.plan_linked(visible, amount_tokens=Amount("percent", 40))
    assert sorted((r.line, r.n) for r in chosen.collect()) == [(1, 2), (2, 2)]
    now = CP.pending_selection(linked, chosen, chain)
    assert [tuple(r)[1:] for r in now.collect()] == [(2, "b", "b", "c")]
    moved = now.withColumn("anchor", F.lit("d"))
    assert CP.selection_matches(now, now).first().status == "ready"
    assert CP.selection_matches(moved, now).first().status == "stale"


def test_guard_keeps_the_old_session(spark):
    linked = typed(spark, [user("a"), bot("b", "a", use("t")), user("c", "b", [result("t")])])
    worse = R.Rewrite(
        linked.where("line <> 2").select("session_id", "line", F.lit(0).alias("sub"), "raw"), R.no_changes(linked))
    lines, verdict = GP.guarded_apply(GP.LINKED, linked, worse)
    assert lines.count() == 3 and verdict.first().wrote is False
    lines, verdict = GP.guarded_apply(GP.LINKED, linked, worse, force=True)
    assert lines.count() == 2 and verdict.first().wrote is True


def test_token_segments(spark):
    from loomlog.functions import tokens as K

    rows = [
        user("a", None, [result("t"), {"type": "image"}], toolUseResult={"stdout": "no", "file": {"content": "file"}}),
        user("b", None, "plain", toolUseResult={"stdout": "out", "stderr": "err"}),
        user("c", None, [{"type": "tool_result", "tool_use_id": "t", "content": [text("x"), {"type": "image"}, {"type": "json", "json": {"k": 1}}]}]),
        bot("d", None, think("deep"), use("t")),
    ]
    got = typed(spark, rows).orderBy("line").select(K.token_segments(F.col("v")).alias("s"), K.token_segments(F.col("v"), True).alias("p")).collect()
    assert got[0].s == ["done", "[image]\n", "file\n"] and got[0].p == ["done", "file\n"]
    assert got[1].s == ["plain\n", "out\n", "err\n"]
    assert got[2].s == ["x\n", "[image]\n", '{"k":1}\n']
    assert got[3].s == ["deep\n", "[tool: run]\n", '{"a":2,"b":1}\n']


def test_edits_keep_odd_text_and_numbers(spark):
    """Lone surrogates, huge and oddly written numbers survive byte for byte outside the edited path."""
    raw = '{"a":1e400,"b":1.10,"c":1e-7,"d":12345678901234567890,"e":"cut \\ud83d","f":"ü","parentUuid":"x","g":[-0.0,1E5]}'
    got = spark.createDataFrame([(raw,)], "raw string").select(
        ED.apply_edits(F.col("raw"), F.array(ED.set_string("parentUuid", F.lit("y")))).alias("raw")).first().raw
    assert got == raw.replace('"x"', '"y"')
