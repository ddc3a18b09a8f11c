"""Reading, parsing and classifying lines."""

import json
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
from conftest import to_lines
from pyspark.sql import functions as F

from loomlog.functions import jsonv as J
from loomlog.functions import specs
from loomlog.functions import text as T
from loomlog.operators import keywords as KW
from loomlog.operators import stats as S
from loomlog.session import spread
from loomlog.sources import documents as DOC
from loomlog.sources import lines as L

import pytest

BAD = [
    '{"type":"user","uuid":"a"}', "   ", '{"a":1} trailing', '{"a":1,"a":"last"}', "NaN", "[1,2]", "{'a':1}",
    "1,1]", '"text"', "  {\"pad\":true}  ", '{"a": 5}',
]


def kinds(df):
    return {r.line: r.json_kind for r in df.collect()}


def test_json_kinds_and_line_numbers(spark):
    parsed = L.parse_lines(to_lines(spark, BAD))
    assert kinds(parsed) == {
        1: "object", 3: "invalid", 4: "object", 5: "invalid", 6: "other", 7: "invalid", 8: "invalid", 9: "other",
        10: "object", 11: "invalid",
    }
    row = parsed.where("line = 4").select(J.as_string(F.col("v"), "$.a").alias("a")).first()
    assert row.a == "last"


def test_type_guards(spark):
    parsed = L.parse_lines(to_lines(spark, [{"s": "5", "n": 5, "b": True, "z": None, "e": ""}]))
    v = F.col("v")
    row = parsed.select(
        J.as_string(v, "$.n").alias("n_text"), J.as_number(v, "$.n").alias("n"), J.as_number(v, "$.s").alias("s_num"),
        J.as_bool(v, "$.b").alias("b"), J.has_key(v, "$.z").alias("z"), J.is_null_or_absent(v, "$.z").alias("znull"),
        J.as_id(v, "$.e").alias("e"),
    ).first()
    assert tuple(row) == (None, 5.0, None, True, True, True, None)


@pytest.mark.parametrize("whole_up_to", [1 << 20, None])
def test_files_small_and_split(spark, tmp_path, whole_up_to):
    """Whole-file and split reading number the lines alike."""
    body = "".join(json.dumps({"type": "user", "n": i}) + ("\r\n" if i % 3 else "\n\n") for i in range(200))
    (tmp_path / "x.jsonl").write_bytes(body.encode())
    (tmp_path / "y.jsonl").write_text('{"a":1}\nbroken')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = L.read_session_lines(spark, str(tmp_path), whole_up_to=whole_up_to).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {(r.session_id, r.line): r.raw for r in rows}
    want, line = {}, 0
    for text in body.replace("\r\n", "\n").split("\n"):
        line += 1
        if text:
            want["x", line] = text
    want["y", 1], want["y", 2] = '{"a":1}', "broken"
    assert got == want


def test_flat_kinds(spark):
    wrapped = to_lines(spark, [
        {"n": 0}, {"timestamp": "t", "type": "x", "payload": {}}, "broken", [1], {"timestamp": "t", "type": "y"}], "w")
    legacy = to_lines(spark, [
        {"n": 0}, {"id": "i", "timestamp": "t"}, {"type": "message"}, {"id": "j", "timestamp": "u"}], "l")
    neither = to_lines(spark, [{"n": 1}], "n")
    flat = L.flat_lines(L.parse_lines(wrapped.unionByName(legacy).unionByName(neither)))
    got = {(r.session_id, r.line): r.kind for r in flat.collect()}
    assert got == {
        ("w", 1): "unknown_json", ("w", 2): "wrapped", ("w", 3): "invalid_json", ("w", 4): "non_object", ("w", 5): "wrapped",
        ("l", 1): "unknown_json", ("l", 2): "legacy_meta", ("l", 3): "legacy_record", ("l", 4): "legacy_record", ("n", 1): None,
    }


def test_detection(spark):
    cases = {
        "typed": [{"type": "user"}], "full": [{"sessionId": "a", "uuid": "b", "type": "other"}],
        "bad": ["x", {"sessionId": "a", "uuid": "b"}], "none": [{"k": 1}],
        "late": [{"k": i} for i in range(25)] + [{"type": "user"}],
        "wrapped": [{"timestamp": "t", "type": "user", "payload": None}], "legacy": [{"id": "i", "timestamp": "t"}],
    }
    rows = None
    for name, values in cases.items():
        part = to_lines(spark, values, name)
        rows = part if rows is None else rows.unionByName(part)
    got = {r.session_id: (r.agent, r.format, r.confidence) for r in L.detect_format(L.parse_lines(rows)).collect()}
    assert got == {
        "typed": ("claude", "jsonl", "medium"), "full": ("claude", "jsonl", "high"), "bad": ("claude", "jsonl", "medium"),
        "none": ("unknown", None, "low"), "late": ("claude", "jsonl", "medium"), "wrapped": ("codex", "wrapped", "high"),
        "legacy": ("codex", "legacy", "high"),
    }
    part = {r.session_id: r.agent for r in L.detect_format(L.parse_lines(rows), sample=25).collect()}
    assert part["late"] == "unknown" and part["typed"] == "claude"


def test_specs():
    assert specs.count_or_percent("20%") == specs.Amount("percent", 20)
    assert specs.tokens_or_percent("12.5k") == specs.Amount("tokens", 12500)
    assert specs.line_numbers("1,2,5-7") == [1, 2, 5, 6, 7]
    assert specs.duration_ms("250ms") == 250 and specs.duration_ms("10s") == 10000
    assert specs.token_threshold("140k") == 140000
    for bad in (specs.count_or_percent, specs.tokens_or_percent, specs.line_numbers, specs.duration_ms):
        with pytest.raises(ValueError):
            bad("5-x%")
    with pytest.raises(ValueError):
        specs.line_numbers("7-5")


def test_number_formats(spark):
    row = spark.range(1).select(
        T.format_k(F.lit(999)).alias("a"), T.format_k(F.lit(1250)).alias("b"), T.format_k(F.lit(7050)).alias("c"),
        T.format_k(F.lit(23456)).alias("d"), T.format_bytes(F.lit(1536)).alias("e"),
        T.progress_bar(F.lit(23000), F.lit(100000), 8).alias("f"),
    ).first()
    assert tuple(row) == ("999", "1.3k", "7.0k", "23k", "1.5 KB", "[█▒▒▒▒▒▒▒]")


def test_listings(spark, tmp_path):
    from datetime import date

    for name in ("-w-a-b/1.jsonl", "-w-a-b/agent-2.jsonl", "-w-a.b/3.jsonl", "other/4.jsonl"):
        path = tmp_path / "projects" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("{}\n")
    found = DOC.scan_projects(spark, str(tmp_path / "projects"), ["/w/a.b"])
    assert sorted(r.session_id for r in found.collect()) == ["1", "3"]
    for name in ("2024/01/02/rollout-x.jsonl", "2024/01/01/rollout-y.jsonl", "2023/12/01/rollout-z.jsonl"):
        path = tmp_path / "rollouts" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("{}\n")
    found = DOC.scan_rollouts(spark, str(tmp_path / "rollouts"), date(2024, 1, 2), lookback_days=5)
    assert sorted(r.session_id for r in found.collect()) == ["rollout-x", "rollout-y"]
    assert DOC.scan_rollouts(spark, str(tmp_path / "rollouts"), date(2020, 1, 1), lookback_days=14).count() == 0
    assert DOC.scan_rollouts(spark, str(tmp_path / "rollouts")).count() == 3


def test_documents_and_sinks(spark, tmp_path):
    pins = {"schemaVersion": 1, "pins": [
        {"name": " n ", "agent": "claude", "sessionId": "1", "sessionPath": "/p", "pinnedAt": "t"},
        {"name": "n", "agent": "claude", "sessionId": "2", "sessionPath": "/p", "pinnedAt": "t"},
        {"name": "m", "agent": "other", "sessionId": "3", "sessionPath": "/p", "pinnedAt": "t"}]}
    (tmp_path / "pins.json").write_text(json.dumps(pins, indent=1))
    rows = DOC.pins(DOC.read_documents(spark, str(tmp_path)))
    assert [(r.name, r.session_id) for r in rows.collect()] == [("n", "1")]

    out = str(tmp_path / "out")
    lines = to_lines(spark, [{"i": i} for i in range(50)], "a").unionByName(to_lines(spark, [{"i": 0}], "b"))
    DOC.write_sessions(lines, out, 3)
    assert [json.loads(r.raw)["i"] for r in DOC.read_session(spark, out, "a").collect()] == list(range(50))
    assert DOC.read_session(spark, out, "b").count() == 1 and DOC.read_session(spark, out, "c").count() == 0

    log = str(tmp_path / "log")
    event = spark.createDataFrame([("a", "session_start", None)], "session_id string, event string, ts string")
    DOC.append_log(event, log, "2024-01-01T00:00:00Z")
    DOC.append_log(event, log, "2024-01-02T00:00:00Z")
    stamps = sorted(json.loads(r.value)["ts"] for r in DOC.read_appended(spark, log).collect())
    assert stamps == ["2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"]
    for _ in range(2):  # an attempt that is repeated replaces what it wrote
        DOC.append_log(event, log, "2024-01-03T00:00:00Z", batch="7")
    assert DOC.read_appended(spark, log, "a").count() == 3 and DOC.read_appended(spark, log, "b").count() == 0
    assert len([p for p in os.listdir(log) if p.startswith("batch=")]) == 3


def test_files_are_whole_or_absent(spark, tmp_path):
    root = str(tmp_path / "files")
    rows = to_lines(spark, [{"i": i} for i in range(500)], "a").unionByName(to_lines(spark, ["x", "", "é"], "b"))
    placed = rows.selectExpr("*", f"concat('{root}/p/', session_id, '.jsonl') path").repartition(7)
    done = {r.path.rsplit("/", 1)[1]: (r.lines, r.bytes) for r in DOC.write_jsonl(placed).collect()}
    assert done["b.jsonl"] == (3, 6) and done["a.jsonl"][0] == 500
    assert [json.loads(x)["i"] for x in open(f"{root}/p/a.jsonl")] == list(range(500)) and open(f"{root}/p/b.jsonl").read() == "x\n\né\n"
    DOC.write_jsonl(placed.where("session_id = 'b' and line = 1"))  # replaces the whole file
    assert open(f"{root}/p/b.jsonl").read() == "x\n" and sorted(os.listdir(f"{root}/p")) == ["a.jsonl", "b.jsonl"]

    @F.udf("string")
    def broken(raw):
        raise ValueError("lost")

    failing = placed.where("session_id = 'a'").withColumn("raw", F.when(F.col("line") > 400, broken("raw")).otherwise(F.col("raw")))
    with pytest.raises(Exception, match="lost"):
        DOC.write_jsonl(failing)
    assert sum(1 for _ in open(f"{root}/p/a.jsonl")) == 500


def test_keyword_tables_equal_the_list_form(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abc é") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    texts = [None, "", "ABC é a"] + ["".join(rng.choice("abcABC éx") for _ in range(rng.randint(0, 60))) for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(texts)), "line bigint, text string")
    table = spark.createDataFrame([(w,) for w in [*words, *words[:5], "", None]], "keyword string")
    want = sorted((i, w) for i, t in enumerate(texts) if t for w in set(words) if w in t.lower())
    for bound in (1 << 20, 200):  # one pass and several
        assert sorted(map(tuple, KW.keyword_hits(rows, table, max_bytes=bound).collect())) == want
        some = KW.keyword_hits(rows, table, first_only=True, max_bytes=bound)
        assert sorted(r.line for r in some.collect()) == sorted({i for i, _ in want})
    hits = rows.where(T.contains_any(F.col("text"), words)).count()
    assert hits == len({i for i, _ in want})
    assert KW.keyword_hits(rows, table.limit(0)).count() == 0


def test_session_prompts_in_parts(spark):
    blocks = spark.createDataFrame([("s", i, None if i % 4 == 3 else f"[user]: text\n{i}" * (1 + i % 3)) for i in range(40)] + [("t", 1, None)], "session_id string, line bigint, prompt_text string")
    texts = [r.prompt_text for r in blocks.where("session_id = 's'").orderBy("line").collect() if r.prompt_text]
    whole = S.session_prompts(blocks, budget=10**6, part_bytes=50).collect()
    assert [(r.session_id, r.blocks, r.prompt) for r in whole] == [("s", 30, "\n\n".join(texts))]
    assert whole[0].source_lines == whole[0].prompt.count("\n") + 1 and whole[0].target_lines == max(20, whole[0].source_lines // 5)
    parts = S.session_prompts(blocks, part_bytes=50).orderBy("part").collect()
    assert len(parts) > 5 and "\n\n".join(r.prompt for r in parts) == whole[0].prompt
    fit = S.session_prompts(blocks, budget=30).first()
    n = max(k for k in range(len(texts) + 1) if -(-len("\n\n".join(texts[:k]).encode()) // 4) <= 30)
    assert fit.blocks == n and fit.prompt == "\n\n".join(texts[:n])


def test_a_line_is_parsed_once_however_often_it_is_read(spark):
    lines = to_lines(spark, ['{"event":"a","ts":"x"}', '{"event":"b"} 1', " "])
    rows = DOC.read_log(lines)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") + plan.count("parse_json") == 1
    assert [(r.line, r.event) for r in rows.collect()] == [(1, "a")]


def test_a_scan_with_all_rows_in_one_of_many_splits_is_spread(spark, tmp_path):
    pq.write_table(pa.table({"x": list(range(20_000))}), tmp_path / "t.parquet")  # one row group
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        scan = spark.read.parquet(str(tmp_path / "t.parquet"))
        cores = spark.sparkContext.defaultParallelism
        assert scan.rdd.getNumPartitions() >= cores
        sizes = spread(scan).rdd.glom().map(len).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert sum(sizes) == 20_000 and max(sizes) <= 1.5 * 20_000 / cores


def test_parsed_values_are_stored_whole(spark, tmp_path):
    lines = to_lines(spark, [{"type": "user", "uuid": str(i), "n": i} for i in range(200)])
    L.parse_lines(lines).coalesce(1).write.parquet(f"{tmp_path}/parsed")
    part = next(str(p) for p in tmp_path.rglob("*.parquet"))
    columns = {c.path.removeprefix("v.") for c in pq.ParquetFile(part).schema if c.path.startswith("v.")}
    assert columns == {"value", "metadata"}


def test_typed_tables_are_built_from_raw_lines_in_one_step(spark, sf, monkeypatch):
    from loomlog.plans import derived as D

    built = []
    monkeypatch.setattr(D, "once", lambda session, source, name, build: (built.append(name), build())[1])
    assert D.linked(spark, sf, "chats").count() > 0 and D.flat(spark, sf, "legacy").count() > 0
    assert sorted(built) == ["flat_legacy", "linked_chats", "raw_chats", "raw_legacy"]


def test_members_of_other_types(spark):
    odd = [
        {"message": {"content": [1, None, "s", {"type": "text", "text": "t", "id": ""}, [{"type": "text"}], {"id": 7, "tool_use_id": "q"}]}},
        {"message": {"content": {"a": 1}, "id": "m"}, "requestId": "r", "uuid": 5},
        {"message": "x", "requestId": "r", "parentUuid": "", "isMeta": "true", "isSidechain": True},
        {"message": {"content": "hi", "id": ""}, "parentUuid": None},
    ]
    rows = L.linked_lines(L.parse_lines(to_lines(spark, odd))).orderBy("line").collect()
    assert [(b.pos, b.type, b.id, b.tool_use_id, b.text) for b in rows[0].blocks] == [
        (0, "text", None, None, "t"), (1, None, None, "q", None)]
    assert [(r.uuid, r.merge_key, r.parent_absent, r.content_text, len(r.blocks)) for r in rows[1:]] == [
        (None, "m", True, None, 0), (None, "r", False, None, 0), (None, None, True, "hi", 0)]
    assert (rows[2].is_meta, rows[2].is_sidechain) == (False, True)

    stamp = {"timestamp": "2024-01-01T00:00:00Z", "type": "a"}
    payloads = [{**stamp, "payload": p} for p in (None, [{"type": "b"}], {"type": "", "call_id": 5, "role": "r"})]
    flat = L.flat_lines(L.parse_lines(to_lines(spark, payloads))).orderBy("line").collect()
    assert [(r.kind, r.item_is_object, r.item_type, r.call_id, r.role) for r in flat] == [
        ("wrapped", False, None, None, None), ("wrapped", False, None, None, None), ("wrapped", True, None, None, "r")]


def test_log_members_are_read_in_one_pass(spark):
    import re

    log = DOC.read_log(to_lines(spark, [
        {"ts": "2024-01-01T00:00:00Z", "event": "auto_compact", "error": {"b": 1}, "tokens": "5", "tokensAfter": None, "amount": 40, "keepLast": ""},
        {"event": 5, "error": "e", "tokens": 1.5, "amount": None}]))
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"variant_get\(v#\d+, \$\.", plan)
    rows = log.orderBy("line").collect()
    assert [(r.event, r.error, r.tokens, r.tokens_after_is_null, r.amount, r.keep_last) for r in rows] == [
        ("auto_compact", '{"b":1}', None, True, "40", ""), (None, "e", 1.5, False, None, None)]
