"""Registered queries against their SQL twins, and the driver contract."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = "events documents pages conversations labels benchmark embeddings".split()
# A spread over the modules; the long rewrites have their own tests on small sessions.
SOME = (
    "s1_line_kinds", "s4_format_detect", "s10_session_states", "s12_runs", "a2_session_stats", "a6_call_stats", "w1_segments",
    "j1_broken_parent", "j2_orphan_tools", "j3_merged_thinking", "v9_flat_issues", "v10_legacy_issues", "g2_chain", "g3_turns",
    "g5_relink", "w2_token_plan", "w3_prompt_fit", "j8_repair_links", "x5_fix_flat", "x6_remove_flat", "x10_migrate",
    "x14_fork", "t1_rank_linked", "t4_catalog", "k5_backup_retention", "u4_version_diff", "p7_prompt_text", "p17_log_lines",
    "m1_status", "m2_status_flat", "m3_trigger", "m5_quiet_sessions", "m7_counters", "a12_heartbeat_gaps",
    "x1_fix", "g6_collapse_chunks", "k1_file_contents", "k4_append_log", "m8_growing_files", "s8_tail_from_end", "f4_keyword_table",
    "p7_session_prompts", "t3_lookup_ids",
)


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_twin(spark, sf, duck, name):
    rows = entry_module.queries()[name](spark, sf)
    columns = sorted(rows.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in rows.collect())
    result = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    assert got == want and got


@pytest.mark.parametrize("name", ["k3_issue_report_all", "v11_next_steps_all"])
def test_all_issues_equal_their_twin(spark, sf, duck, name):
    test_query_equals_its_twin(spark, sf, duck, name)


def test_reports_cover_all_codes_and_formats(spark, sf):
    found = entry_module.queries()["k3_issue_report_all"](spark, sf).collect()
    codes = {r.report_line.split("] ")[1].split(":")[0].split(" ")[0] for r in found}
    assert len(codes) > 20 and {c.split(".")[0] for c in codes} == {"claude", "codex"} and any("legacy" in c for c in codes)
    steps = {(r.agent, r.step) for r in entry_module.queries()["v11_next_steps_all"](spark, sf).collect()}
    assert steps >= {("claude", "fix"), ("codex", "fix"), ("codex", "strip_noise"), ("codex", "migrate")}


def test_contract(spark):
    queries, twins = entry_module.queries(), entry_module.oracle_sql()
    assert set(twins) <= set(queries) and len(queries) > 100
    assert entry_module.entry(spark).count() > 0
