"""Files that grow: every line once, half lines wait, restarts go on, replaced files start anew."""

import os
import random

import pytest

from loomlog.sources import growing as GR
from loomlog.sources import lines as L


def append(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "ab") as file:
        file.write(data)


def stream_into(spark, store, out, checkpoint):
    query = GR.stream_lines(spark, store, 1).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert query.awaitTermination(180)


def rows_of(df):
    return sorted((r.session_id, r.generation, r.line, r.raw) for r in df.collect())


def test_growing_files_as_batch_and_stream(spark, tmp_path):
    rng = random.Random(1)
    root, store, out, ck = (str(tmp_path / x) for x in ("logs", "store", "out", "ck"))
    names = [f"{root}/p{i % 3}/s{i}.jsonl" for i in range(7)] + [f"{root}/deep/er/x.jsonl"]
    sources = [b"".join((b"%d line \xc3\xa9 " % k * rng.randint(0, 9) + rng.choice([b"\n", b"\r\n", b"\n\n", b"\r", b"  \n"])) for k in range(60)) + b"end\n" for _ in names]
    at = [0] * len(names)
    versions = []
    for step in range(5):
        for i, (name, data) in enumerate(zip(names, sources)):
            to = len(data) if step == 4 else min(len(data), at[i] + rng.randint(0, 700))
            append(name, data[at[i] : to])  # often ends within a line
            at[i] = to
        append(f"{root}/p0/other.txt", b"not a session\n")
        versions.append(GR.take_stock(spark, [root], store, chunk=256))
        if step in (1, 4):  # the second run goes on from the checkpoint
            stream_into(spark, store, out, ck)
    assert versions == [1, 2, 3, 4, 5]
    assert GR.take_stock(spark, [root], store) == 5  # nothing new
    batch = rows_of(GR.grown_lines(spark, store))
    assert batch == rows_of(spark.read.parquet(out))
    whole = sorted((r.session_id, 0, r.line, r.raw) for r in L.read_session_lines(spark, root).where("path like '%.jsonl'").select("session_id", "line", "raw").collect())
    assert [x[:3] for x in batch] == [x[:3] for x in whole] and batch == whole
    late = GR.grown_lines(spark, store, after=3)
    assert {r.version for r in late.select("version").distinct().collect()} == {4, 5}


def test_half_lines_wait_and_replaced_files_start_anew(spark, tmp_path):
    root, store = str(tmp_path / "logs"), str(tmp_path / "store")
    path = f"{root}/p/a.jsonl"
    append(path, b"one\ntw")
    assert GR.take_stock(spark, [root], store) == 1
    assert rows_of(GR.grown_lines(spark, store)) == [("a", 0, 1, "one")]
    append(path, b"o")
    assert GR.take_stock(spark, [root], store) == 1
    append(path, b"\nthree\n")
    assert GR.take_stock(spark, [root], store) == 2
    assert rows_of(GR.grown_lines(spark, store)) == [("a", 0, 1, "one"), ("a", 0, 2, "two"), ("a", 0, 3, "three")]
    with open(path, "wb") as file:
        file.write(b"other text, as long as before and more\nx\n")
    assert GR.take_stock(spark, [root], store) == 3
    assert rows_of(GR.grown_lines(spark, store, after=2)) == [("a", 1, 1, "other text, as long as before and more"), ("a", 1, 2, "x")]
    with open(path, "wb") as file:
        file.write(b"short\n")
    assert GR.take_stock(spark, [root], store) == 4
    assert rows_of(GR.grown_lines(spark, store, after=3)) == [("a", 2, 1, "short")]


def test_a_stock_that_failed_has_changed_nothing(spark, tmp_path, monkeypatch):
    root, store = str(tmp_path / "logs"), str(tmp_path / "store")
    append(f"{root}/p/a.jsonl", b"one\n")
    monkeypatch.setattr(GR, "SNAPSHOT_EVERY", 2)
    GR.take_stock(spark, [root], store)
    append(f"{root}/p/a.jsonl", b"two\n")
    real = GR.cut
    calls = []

    def failing(df, name="step"):
        calls.append(name)
        if name == "ranges":
            raise OSError("lost")
        return real(df, name)

    monkeypatch.setattr(GR, "cut", failing)
    with pytest.raises(OSError):
        GR.take_stock(spark, [root], store)
    monkeypatch.setattr(GR, "cut", real)
    assert "ranges" in calls and GR.take_stock(spark, [root], store) == 2
    append(f"{root}/p/a.jsonl", b"three\n")
    assert GR._snapshot(store) == 2 and GR.take_stock(spark, [root], store) == 3  # from the stored state
    assert [x[2:] for x in rows_of(GR.grown_lines(spark, store))] == [(1, "one"), (2, "two"), (3, "three")]


def test_reload_commands_after_a_cursor(spark, tmp_path):
    root, store = str(tmp_path / "logs"), str(tmp_path / "store")
    path = f"{root}/r1/r1.jsonl"
    append(path, b'{"cmd":"reload","reason":"a"}\n{"cmd":"stop"}\nbroken\n{"cmd":"reload","reason":"b"}\n')
    GR.take_stock(spark, [root], store)
    append(path, b'{"cmd":"reload","reason":"c"}\n')
    GR.take_stock(spark, [root], store)
    both = GR.reload_commands(GR.grown_lines(spark, store))
    assert sorted(map(tuple, both.collect())) == [("r1", 1, 2, "b"), ("r1", 2, 1, "c")]
    assert [tuple(r) for r in GR.reload_commands(GR.grown_lines(spark, store, after=1)).collect()] == [("r1", 2, 1, "c")]


@pytest.mark.parametrize("block", [1, 7, 64 << 10])
def test_tails_are_read_from_the_end(spark, tmp_path, block):
    root = str(tmp_path / "logs")
    texts = [b"", b"\n\n", b"one", b"one\ntwo\n\n \nthree", b"a\r\nb\rc\n", "é\nü\n".encode() * 40, b"x" * 500 + b"\n" + b"y" * 300 + b"\n"]
    for i, text in enumerate(texts):
        append(f"{root}/p/s{i}.jsonl", text)
    files = GR.list_files(spark, [root])
    got = {}
    for r in GR.tail_lines(files, 3, block).orderBy("path", "back").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r.raw)
    for i, text in enumerate(texts):
        lines = [x for x in text.decode().replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()]
        assert got.get(f"s{i}.jsonl", []) == lines[::-1][:3]


def test_bytes_read_do_not_follow_the_file(spark, tmp_path):
    read = []
    for n in (1_000, 100_000):
        root = str(tmp_path / str(n))
        append(f"{root}/p/s.jsonl", b"".join(b"line %d\n" % k for k in range(n)))
        rows = GR.tail_lines(GR.list_files(spark, [root]), 20, 512).collect()
        assert len(rows) == 20 and rows[0].raw == f"line {n - 20}"
        read.append(rows[0].bytes_read)
    assert read == [512, 512]
