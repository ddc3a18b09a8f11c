import datetime
import math
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry_module

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
BASE = "the river runs past the old mill and the boats lie still under the grey bridge while rain falls on the town tonight and nobody walks along the quay at all".split()


def near(i):
    """A near copy of BASE repeated over other words; copies differ in one word."""
    words = [f"{w}{k}" for k in range(4) for w in BASE]
    words[(7 * i) % len(words)] = f"other{i}"
    return " ".join(words)


def edge_documents():
    texts = [
        None, "", " ", "\n", "\n\n  \n", "one", "One  TWO", "one two", "a b c", "A\tB\nC", "é è ▁ ü  ▁▁x", "<|endoftext|> x<|endoftext|>", "'s 's  's\n 's",
        LONG, LONG, LONG + " end", "x" * 40_000, "common line\n" * 3 + "tail", " word" * 50, "#*$%&|<>" * 9, "  \xa0 　x y", "\x00 nul \x1f y",
    ]
    texts += [f"Common LINE \nown line {i}\n\ncommon line\t\nlast {i % 3}" for i in range(14)]
    texts += [near(i) for i in range(40)] + [near(0)] * 25 + [near(0).upper()]
    rows = [(i, t, (None, "en", "fr", "")[i % 4], (None, "s1", "s2", "s3", "")[i % 5]) for i, t in enumerate(texts)]
    rows += [rows[40]] * 3 + [(None, "a text without an id of its own", "en", "s1"), (None, None, None, None)]
    return rows


def write_documents(folder, rows):
    names = ["doc_id", "text", "lang", "source"]
    columns = {n: [r[i] for r in rows] for i, n in enumerate(names)}
    types = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string()}
    table = {n: pa.array(columns[n], types[n]) for n in names}
    table["n_chars"] = pa.array([len(t) if t is not None else None for t in columns["text"]], pa.int64())
    # Names that the operators use inside.
    for name in ("pos", "key", "row", "node", "h", "uid", "pattern", "size", "line", "lines", "drop", "shard", "x", "n_lines", "ids", "figure", "digest"):
        table[name] = pa.array([f"{name}{i}" for i in range(len(rows))], pa.string())
    pq.write_table(pa.table(table), os.path.join(folder, "documents.parquet"))


@pytest.fixture(scope="session")
def edge_dir(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("edge"))
    write_documents(folder, edge_documents())
    labels = [(i, 1 if i % 3 else 0) for i in range(0, 70)] + [(5, 0), (None, 1), (9_999, 1), (7, None)]
    pq.write_table(pa.table({"doc_id": pa.array([a for a, _ in labels], pa.int64()), "quality": pa.array([b for _, b in labels], pa.int32())}), folder + "/labels.parquet")
    vectors = [[math.sin(i * j + 1) for j in range(6)] for i in range(300)] + [[0.5] * 6] * 60
    rows = list(enumerate(vectors))
    rows += [(400, None), (450, [0.1, None, 0.2, 0.3, 0.4, 0.5]), (500, [float("nan")] * 6), (550, [float("inf")] * 6), (600, [1.0, 2.0]), (650, [2.0, 1.0]), (None, [0.9] * 6)]
    rows += [(700, [1e12] * 6), (701, [-1e12] * 6)]
    pq.write_table(pa.table({"vec_id": pa.array([a for a, _ in rows], pa.int64()), "embedding": pa.array([b for _, b in rows], pa.list_(pa.float32()))}), folder + "/embeddings.parquet")
    html = [None, "", "<p>a</p>", "<p>a</p>", "ü" * 50, "x" * 300_000, "\r\n\r\nWARC/1.1\r\n\r\n", "<p>a</p>", ""]
    pages = [(i * 3, f"http://h/{i}", h) for i, h in enumerate(html)] + [(6, "http://again", "<p>a</p>"), (None, "http://none", "<p>a</p>"), (None, None, "alone"), (50, "http://sp ace/\n", "z")]
    pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": [p[1] for p in pages], "html": [p[2] for p in pages]}), folder + "/pages.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_dir(edge_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "embeddings", "pages"):
        pq.write_table(pq.read_table(f"{edge_dir}/{name}.parquet").slice(0, 0), f"{folder}/{name}.parquet")
    return folder


def plain(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, datetime.date):
        return value.isoformat()
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


@pytest.fixture
def twin(spark):
    """Rows of a registered query and of its SQL over a folder, both as sorted text."""

    def compare(name, folder):
        frame = entry_module.queries()[name](spark, folder)
        columns = sorted(frame.columns)
        got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
        con = duckdb.connect()
        for path in os.listdir(folder):
            con.execute(f"create view {path.split('.')[0]} as select * from '{folder}/{path}'")
        result = con.execute(entry_module.oracle_sql()[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        return got, sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())

    return compare
