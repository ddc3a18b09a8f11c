"""Checks and rewrites of the flat format on small sessions."""

import json

from conftest import to_lines

from loomlog.functions.specs import Amount
from loomlog.operators import checks as C
from loomlog.operators import compact as CP
from loomlog.operators import rewrite as R
from loomlog.operators import rewrite_flat as RF
from loomlog.operators import stats as S
from loomlog.plans import guarded as GP
from loomlog.session import cut
from loomlog.sources import lines as L


def wrap(kind, payload):
    return {"timestamp": "2024-01-01T00:00:00Z", "type": kind, "payload": payload}


def item(**payload):
    return wrap("response_item", payload)


def call(i, kind="function_call"):
    return item(type=kind, call_id=i, name="run", arguments="{}")


def output(i, kind="function_call_output"):
    return item(type=kind, call_id=i, output="ok")


def say(role, text):
    return item(type="message", role=role, content=[{"type": "output_text" if role == "assistant" else "input_text", "text": text}])


META = wrap("session_meta", {"id": "conv", "cwd": "/w"})


def typed(spark, values, session="s"):
    return cut(L.flat_lines(cut(L.parse_lines(to_lines(spark, values, session)))))


def codes(flat):
    return sorted(r.code.split(".")[1] for r in GP.FLAT.issues(flat).collect())


def rewritten(rewrite):
    return [json.loads(r.raw) for r in rewrite.lines.orderBy("line", "sub").collect()]


def codes_of(spark, cases):
    """Issue codes of several sessions in one job."""
    lines = None
    for name, values in cases.items():
        part = to_lines(spark, values, name)
        lines = part if lines is None else lines.unionByName(part)
    flat = cut(L.flat_lines(cut(L.parse_lines(cut(lines)))))
    found = {name: [] for name in cases}
    for r in GP.FLAT.issues(flat).collect():
        found[r.session_id].append(r.code.split(".")[1])
    return {name: sorted(c) for name, c in found.items()}


def test_pairs(spark):
    got = codes_of(spark, {
        "fine": [META, call("a"), output("a")],
        "shell": [META, call("a", "local_shell_call"), output("a")],
        "kinds": [META, call("a"), output("a", "custom_tool_call_output")],
        "early": [META, output("a"), call("a")],
        "outputs": [META, call("a"), output("a"), output("a")],
        "calls": [META, call("a"), call("a"), output("a")],
        "nameless": [META, call("")],
        "nameless_shell": [META, call("", "local_shell_call")],
    })
    assert got == {
        "fine": [], "shell": [], "kinds": ["missing_output", "orphan_output"], "early": ["output_before_call"],
        "outputs": ["duplicate_outputs_for_call_id"], "calls": ["duplicate_call_id"],
        "nameless": ["function_call_missing_call_id"], "nameless_shell": [],
    }


def test_three_meanings_of_orphan(spark):
    # The call below its output: paired for the check and the repair, orphan for the statistics.
    flat = typed(spark, [META, output("a"), call("a")])
    assert RF.orphan_output_rows(flat).count() == 0
    assert S.call_stats(flat).first().orphan_outputs == 1
    # Two outputs of different kinds: one issue-free pair for the check, one orphan row for the repair.
    mixed = typed(spark, [META, call("a"), output("a"), output("a", "custom_tool_call_output")])
    assert codes(mixed) == ["duplicate_outputs_for_call_id"]
    assert [r.line for r in RF.orphan_output_rows(mixed).collect()] == [4]


def test_shapes(spark):
    rows = [
        META, wrap("turn_context", 5), wrap("turn_context", {}), wrap("turn_context", {"sandbox_policy": {"mode": "a", "type": "b"}}),
        wrap("turn_context", {"sandbox_policy": {}}), wrap("compacted", 1), wrap("compacted", {"message": 3, "replacement_history": "x"}),
        {"k": 1}, "broken", [1],
    ]
    got = codes_of(spark, {
        "all": rows, "no_meta": [call("a"), output("a")], "two": [wrap("session_meta", {}), META],
        "scalar": [wrap("session_meta", 1)], "strange": [{"k": 1}],
    })
    assert got == {
        "all": sorted([
            "turn_context_payload_not_object", "turn_context_sandbox_policy_not_object", "sandbox_policy_has_mode_and_type",
            "sandbox_policy_missing_mode_or_type", "compacted_payload_not_object", "compacted_message_not_string",
            "compacted_replacement_history_not_array", "unknown_json_line", "invalid_json_line", "non_object_line"]),
        "no_meta": ["missing_session_meta"], "two": ["multi_session_meta", "session_meta_missing_id"],
        "scalar": ["session_meta_payload_not_object"], "strange": ["unrecognized_format"],
    }


def test_fix(spark):
    policy = wrap("turn_context", {"sandbox_policy": {"mode": "ro", "net": True}})
    flat = typed(spark, [META, policy, output("x"), call("a"), call("b", "custom_tool_call"), "broken"])
    out = rewritten(RF.fix(flat, RF.FlatFixOptions(aborted_outputs=True)))
    assert out[1]["payload"]["sandbox_policy"] == {"net": True, "type": "ro"}
    assert [(v["payload"].get("type"), v["payload"].get("output")) for v in out[2:]] == [
        ("function_call", None), ("function_call_output", "aborted"), ("custom_tool_call", None), ("custom_tool_call_output", "aborted")]
    assert len(rewritten(RF.fix(flat))) == 4


def test_remove_and_trim(spark):
    flat = typed(spark, [META, call("a"), output("a"), output("lost"), say("user", "keep")])
    chosen = flat.where("line = 2").select("session_id", "line")
    out = RF.remove(flat, chosen)
    assert [r.line for r in out.lines.orderBy("line").collect()] == [1, 5]
    assert sorted((r.line, r.reason) for r in out.changes.collect()) == [(2, "requested"), (3, "pair"), (4, "orphan_output")]
    rows = [META, say("user", "old"), wrap("compacted", {"message": "m"}), say("user", "a"), say("assistant", "b"), say("user", "c")]
    out = RF.trim(typed(spark, rows), Amount("count", 1), keep_last=True)
    assert [r.line for r in out.lines.orderBy("line").collect()] == [1, 2, 3, 6]


def test_migration(spark):
    env = "<environment_context><cwd>/proj</cwd></environment_context>"
    rows = [
        {"id": "old", "timestamp": "t0", "instructions": "be brief", "git": {"b": "x"}}, {"record_type": "state"}, {"k": 1},
        {"type": "message", "role": "user", "content": [{"type": "input_text", "text": env}]}, {"type": "reasoning", "summary": []},
    ]
    out = rewritten(RF.migrate(typed(spark, rows)))
    assert [v["type"] for v in out] == ["session_meta", "response_item", "response_item"]
    assert {k: out[0]["payload"][k] for k in ("id", "timestamp", "cwd", "instructions", "git")} == {
        "id": "old", "timestamp": "t0", "cwd": "/proj", "instructions": "be brief", "git": {"b": "x"}}
    assert out[1] == {"timestamp": "t0", "type": "response_item", "payload": rows[3]}
    lines, verdict, _ = GP.lint_fix(GP.FLAT, typed(spark, rows))
    assert verdict.first().wrote and lines.count() == 3


def test_noise_export_fork(spark):
    flat = typed(spark, [META, wrap("turn_context", {}), wrap("event_msg", {}), say("assistant", "x"), wrap("compacted", {"message": "", "replacement_history": [
        {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "from history"}]}]})])
    assert [r.line for r in RF.strip_noise(flat).lines.orderBy("line").collect()] == [1, 4, 5]
    assert [r.line for r in RF.strip_noise(flat, turn_context=False).lines.orderBy("line").collect()] == [1, 2, 4, 5]
    assert [(r.item_kind, r.role, r.text) for r in RF.export(flat).orderBy("line").collect()] == [
        ("message", "assistant", "x"), ("compacted", None, "from history")]
    ids = spark.createDataFrame([("s", "new")], "session_id string, new_id string")
    copy = [json.loads(r.raw) for r in RF.fork_flat(flat, ids).orderBy("line").collect()]
    assert copy[0]["payload"] == {"id": "new", "cwd": "/w"} and len(copy) == 5


def test_compaction_pins_the_leading_context(spark):
    rows = [
        META, say("developer", "rules"), say("user", "see AGENTS.md"), say("user", "q1"), say("assistant", "a1"),
        say("user", "q2"), say("assistant", "a2"),
    ]
    flat = typed(spark, rows)
    summaries = spark.createDataFrame([("s", "SUM")], "session_id string, summary string")
    out = CP.compact_flat(flat, summaries, Amount("count", 2), "2024-02-02T00:00:00Z")
    values = rewritten(out)
    assert [v["type"] for v in values] == ["session_meta", "compacted", "response_item", "response_item"]
    history = values[1]["payload"]["replacement_history"]
    assert [h["role"] for h in history] == ["developer", "user", "user"] and history[2]["content"][0]["text"] == "SUM"
    # A second compaction keeps the context of the first and drops its marker.
    second = cut(L.flat_lines(cut(L.parse_lines(R.renumber(out.lines)))))
    values = rewritten(CP.compact_flat(second, summaries, Amount("count", 1), "2024-02-03T00:00:00Z"))
    assert [v["type"] for v in values] == ["session_meta", "compacted", "response_item"]
    assert len(values[1]["payload"]["replacement_history"]) == 3
    picked = CP.pending_selection_flat(flat, out.changes).first()
    assert (picked.remove_count, picked.first_removed, picked.last_removed, picked.anchor) == (2, 4, 5, 6)


def test_compaction_of_everything_puts_the_marker_last(spark):
    flat = typed(spark, [META, say("user", "q"), say("assistant", "a"), "broken"])
    summaries = spark.createDataFrame([("s", "SUM")], "session_id string, summary string")
    values = rewritten(CP.compact_flat(flat, summaries, Amount("count", 9), "2024-02-02T00:00:00Z"))
    assert [v["type"] for v in values] == ["session_meta", "compacted"]


def test_next_steps_and_report_lines(spark):
    flat = typed(spark, [META, {"k": 1}, output("x")])
    sessions = spark.createDataFrame([("s", "codex", "wrapped")], "session_id string, agent string, format string")
    issues = GP.FLAT.issues(flat)
    assert sorted(r.step for r in C.next_steps(issues, sessions).collect()) == ["fix", "strip_noise"]
    assert "[error] codex.orphan_output (call_id=x)" in [r.report_line for r in C.format_issues(issues).collect()]
    report = R.change_report(RF.strip_noise(typed(spark, [META, *[wrap("event_msg", {})] * 4])).changes, 2)
    assert [r.text for r in report.orderBy("pos").collect()] == [
        "- delete_line line=2: event_msg", "- delete_line line=3: event_msg", "- … (2 more)"]


def test_late_lines_count(spark):
    """What stands far down a session is seen: a directory in record 301, messages only in the middle."""
    from loomlog.operators import catalog as CT

    message = {"type": "message", "role": "user"}
    values = [{"id": "i", "timestamp": "t"}] + [{**message, "content": [{"type": "input_text", "text": f"n{i}"}]} for i in range(300)]
    values += [{**message, "content": [{"type": "input_text", "text": "<environment_context><cwd>/late</cwd></environment_context>"}]}]
    flat = L.flat_lines(L.parse_lines(to_lines(spark, values)))
    assert [r.cwd for r in RF.legacy_cwds(flat).collect()] == ["/late"]
    assert RF.legacy_cwds(flat, scan=200).count() == 0
    middle = [{"type": "system"}] * 80 + [{"type": "user"}] + [{"type": "system"}] * 600
    parsed = L.parse_lines(to_lines(spark, middle))
    assert [r.talks for r in CT.has_messages(parsed).collect()] == [True]
    assert [r.talks for r in CT.has_messages(parsed, 50, 500).collect()] == [False]
