"""Exact top-k search by inner product with a KD-tree per shard.

Rows are dealt by place: the upper levels of a KD-tree, split on a sample of ``SAMPLE_ROWS`` rows, give at most ``MAX_CELLS``
cells, and each cell is cut into shards of bounded size. Every row goes to its cell exactly; the sample steers the work
only. In its home shard each query first gets its k best rows. The score of the k-th is then held against the tight
box of every cell, and the query goes on only to the shards of cells whose box may hold a row that belongs among its
answers. There it prunes with the carried score again. A shard's tree splits at the median of the widest side and keeps
tight boxes; a query descends best-first by the largest inner product a box allows. Queries come in blocks, so a task
holds one shard and one block, and a shard is copied only to blocks that have a query for it.

Components are floor(scale * x) with x as double; sums are exact. Defined results: vectors that are null, hold null or
non-finite components, or have no id take no part; vectors of other lengths than the query's are no candidates; rows
with the query's id are its own; equal scores go to the smaller id; repeated rows are candidates of their own, repeated
queries (equal id and vector) are answered once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.session import cut, ship_by_value

ship_by_value(__name__)

SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
LEAF_ROWS = 256
SAMPLE_ROWS = 1 << 16  # about as many rows choose the cells' borders
MAX_CELLS = 4096  # their boxes are broadcast: two numbers a component
LONG = 2**63 - 1


def matrix(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    """Rows of one length as integers in doubles; Python integers where doubles would round a sum."""
    rows = column.combine_chunks()
    flat = np.floor(rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    out = flat.reshape(len(rows), -1) if len(rows) and len(flat) else np.zeros((len(rows), 0))
    if out.size and float(np.abs(out).max()) ** 2 * out.shape[1] >= 2.0**52:
        out = np.array([[int(x) for x in row] for row in out], dtype=object)
    return out


class Tree:
    """Median splits of the widest side; each node has its tight box and its smallest id."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        order, nodes = np.arange(len(ids)), []
        stack = [(0, len(ids), -1)]
        self.children: list[tuple[int, int] | None] = []
        while stack:
            start, stop, parent = stack.pop()
            rows = order[start:stop]
            here = points[rows]
            low, high = here.min(axis=0), here.max(axis=0)
            node = len(nodes)
            nodes.append((start, stop, low, high, int(ids[rows].min())))
            self.children.append(None)
            if parent >= 0:
                self.children[parent] = (*(self.children[parent] or ()), node)
            side = int(np.argmax(high - low)) if here.shape[1] else -1
            if stop - start <= LEAF_ROWS or side < 0 or high[side] == low[side]:
                continue
            middle = (stop - start) // 2
            order[start:stop] = rows[np.argpartition(here[:, side], middle)]
            stack += [(start, start + middle, node), (start + middle, stop, node)]
        self.points, self.ids = points[order], ids[order]
        self.spans = [(n[0], n[1]) for n in nodes]
        self.low, self.high = np.array([n[2] for n in nodes]), np.array([n[3] for n in nodes])
        self.smallest = [n[4] for n in nodes]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each node's box allows, by query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query, own: int, bounds, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best rows, or those that may belong among them beside ``best``: (minus score, id), ascending."""
        best = sorted(best)
        found: list[tuple[int, int]] = []
        heap = [(-bounds[0], self.smallest[0], 0)]
        while heap:
            bound, smallest, node = heapq.heappop(heap)
            if len(best) >= k and (bound, smallest) >= best[k - 1]:
                break
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(heap, (-bounds[child], self.smallest[child], child))
                continue
            start, stop = self.spans[node]
            scores, ids = self.points[start:stop] @ query, self.ids[start:stop]
            rows = np.arange(stop - start)
            if len(best) >= k:
                rows = np.flatnonzero(scores >= -best[k - 1][0])
            mine = [(-int(scores[i]), int(ids[i])) for i in rows if ids[i] != own]
            found += mine
            best = heapq.nsmallest(k, best + mine)
        return heapq.nsmallest(k, found)


class Cells:
    """Splits of the upper tree: for each length of vectors a side and a value by node, and the cell at each leaf."""

    def __init__(self, vectors: list[np.ndarray], n_cells: int):
        self.trees: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        total, self.count = sum(map(len, vectors)), 0
        for points in vectors:
            if not points.shape[1]:
                continue
            share = max(1, round(n_cells * len(points) / total))
            side, value, below, cell = [], [], [], []
            stack = [(np.arange(len(points)), share, -1)]
            while stack:
                rows, cells, parent = stack.pop()
                here, node = points[rows], len(side)
                if parent >= 0:
                    below[parent].append(node)
                spread = np.ptp(here, axis=0) if len(rows) else np.zeros(1)
                widest = int(np.argmax(spread))
                side.append(widest)
                below.append([])
                if cells > 1 and spread[widest] > 0:
                    at = np.sort(here[:, widest])[len(rows) // 2]
                    low = here[:, widest] < at
                    if not low.any():
                        at = np.nextafter(at, np.inf)
                        low = here[:, widest] < at
                    value.append(at)
                    cell.append(-1)
                    stack += [(rows[~low], cells // 2, node), (rows[low], cells - cells // 2, node)]
                else:
                    value.append(0.0)
                    cell.append(self.count)
                    self.count += 1
            children = np.array([b if b else [i, i] for i, b in enumerate(below)])
            self.trees[points.shape[1]] = np.array(side), np.array(value), children, np.array(cell)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each row; -1 for lengths that the sample has not seen."""
        if points.shape[1] not in self.trees:
            return np.full(len(points), -1)
        side, value, children, cell = self.trees[points.shape[1]]
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        while (cell[node] < 0).any():
            low = points[rows, side[node]] < value[node]
            node = np.where(cell[node] < 0, np.where(low, children[node, 0], children[node, 1]), node)
        return cell[node]


def by_length(column: pa.Array, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, rows as doubles) of the vectors of each length."""
    out = []
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out.append((at, flat.reshape(len(at), size)))
    return out


def dealt(points: DataFrame, total: int, n_cells: int) -> DataFrame:
    """``points`` with their ``cell``."""
    every = max(1, total // SAMPLE_ROWS)
    sample = points.where(F.pmod(F.xxhash64("uid"), F.lit(every)) == 0).select("dim", "v").toArrow()
    found = by_length(sample["v"].combine_chunks(), sample["dim"].to_numpy()) if sample.num_rows else []
    cells = points.sparkSession.sparkContext.broadcast(Cells([x for _, x in found], n_cells))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)

    def run(batches):
        for batch in batches:
            cell = np.full(batch.num_rows, -1, np.int32)
            for at, rows in by_length(batch.column("v"), batch.column("dim").to_numpy()):
                cell[at] = cells.value.of(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

    return cut(points.mapInArrow(run, schema + ", cell int"), "celled")


def cell_boxes(points: DataFrame, scale: int) -> dict[int, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The tight box of every cell, by length; a task sends its own box of a cell once."""
    def local(batches):
        boxes: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for at, rows in by_length(batch.column("v"), batch.column("dim").to_numpy()):
                rows, here = np.floor(rows * scale), cells[at]
                order = np.argsort(here, kind="stable")
                begins = np.flatnonzero(np.append(True, np.diff(here[order]) != 0)) if len(at) else []
                for b, e in zip(begins, [*begins[1:], len(at)]):
                    part, key = rows[order[b:e]], (rows.shape[1], int(here[order[b]]))
                    low, high = part.min(axis=0), part.max(axis=0)
                    if key in boxes:
                        low, high = np.minimum(low, boxes[key][0]), np.maximum(high, boxes[key][1])
                    boxes[key] = [low, high]
        if boxes:
            yield pa.RecordBatch.from_arrays([
                pa.array([d for d, _ in boxes], pa.int32()), pa.array([c for _, c in boxes], pa.int32()),
                pa.array([b[0] for b in boxes.values()], pa.list_(pa.float64())), pa.array([b[1] for b in boxes.values()], pa.list_(pa.float64()))], ["dim", "cell", "low", "high"])

    def merged(table: pa.Table) -> pa.Table:
        low, high = (np.array(table[c].to_pylist()).reshape(table.num_rows, -1) for c in ("low", "high"))
        return pa.table({"dim": table["dim"].slice(0, 1), "cell": table["cell"].slice(0, 1), "low": pa.array([low.min(axis=0)], pa.list_(pa.float64())),
                         "high": pa.array([high.max(axis=0)], pa.list_(pa.float64()))})

    schema = "dim int, cell int, low array<double>, high array<double>"
    out: dict = {}
    # At most MAX_CELLS rows, and one of rows without a cell for each length.
    for r in points.select("dim", "cell", "v").mapInArrow(local, schema).groupBy("dim", "cell").applyInArrow(merged, schema).toLocalIterator():
        out.setdefault(r["dim"], {})[r["cell"]] = np.array(r["low"]), np.array(r["high"])
    return out


def reachable(home: DataFrame, boxes: dict, k: int, scale: int) -> DataFrame:
    """``home`` with ``cells``, the cells whose box may hold an answer beside those known."""
    spark = home.sparkSession
    packed = {d: (np.array(list(c)), np.array([b[0] for b in c.values()]), np.array([b[1] for b in c.values()])) for d, c in boxes.items()}
    known = spark.sparkContext.broadcast(packed)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in home.schema.fields)

    def run(batches):
        for batch in batches:
            out: list = [[]] * batch.num_rows
            scores = batch.column("scores").to_pylist()
            for at, rows in by_length(batch.column("v"), batch.column("dim").to_numpy()):
                cells, low, high = known.value[rows.shape[1]]
                query = np.floor(rows * scale)
                bounds = np.maximum(query, 0) @ high.T + np.minimum(query, 0) @ low.T
                # Sums beyond 2^52 are rounded: a relative margin keeps every cell that could matter.
                bounds += 1e-9 * (np.abs(query) @ np.maximum(np.abs(low), np.abs(high)).T) + 1e-6
                for j, i in enumerate(at):
                    least = scores[i][-1] if len(scores[i]) >= k else -np.inf
                    out[i] = cells[bounds[j] >= least].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    return home.mapInArrow(run, schema + ", cells array<int>")


def _long(score: int) -> int:
    return max(-LONG - 1, min(LONG, score))


def top_k(rows: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every row that ``is_query`` names."""
    vector = F.col(embedding).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = rows.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite)
    points = cut(valid.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"), F.size(embedding).alias("dim"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"), F.monotonically_increasing_id().alias("uid"),
    ), "points")
    total, asked = points.count(), points.where("is_query").count()
    n_shards, n_blocks = max(1, math.ceil(total / SHARD_ROWS)), max(1, math.ceil(asked / BLOCK_QUERIES))
    if n_shards > 1:
        points = dealt(points, total, min(MAX_CELLS, n_shards))
        parts = cut(points.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("parts")), "parts")
    else:
        points = points.withColumn("cell", F.lit(0))
        parts = points.sparkSession.createDataFrame([(0, 1)], "cell int, parts int")
    points = points.join(parts, "cell").withColumn("shard", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).drop("parts")

    def at_home(table: pa.Table) -> pa.Table:
        """Each query of a shard against its own shard."""
        data, ids = matrix(table["v"], scale), table["vec_id"].to_numpy()
        tree, out = Tree(data, ids), []
        mine = np.flatnonzero(table["is_query"].to_numpy(zero_copy_only=False))
        bounds = tree.bounds(data[mine]) if len(mine) else None
        for j, i in enumerate(mine):
            best = tree.search(data[i], int(ids[i]), bounds[j], k, [])
            out.append({
                "query_id": int(ids[i]), "v": table["v"][int(i)].as_py(), "dim": data.shape[1], "cell": table["cell"][0].as_py(), "shard": table["shard"][0].as_py(),
                "ids": [x[1] for x in best], "scores": [_long(-x[0]) for x in best],
            })
        return pa.Table.from_pylist(out, schema=pa.schema([
            ("query_id", pa.int64()), ("v", table.schema.field("v").type), ("dim", pa.int32()), ("cell", pa.int32()), ("shard", pa.int32()),
            ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64())),
        ]))

    kind = points.schema["v"].dataType.simpleString()
    home = cut(points.groupBy("dim", "cell", "shard").applyInArrow(
        at_home, f"query_id bigint, v {kind}, dim int, cell int, shard int, ids array<bigint>, scores array<bigint>",
    ), "at-home")
    # A repeated query may have two homes; the answer of either is completed to the same result.
    home = home.withColumn("q", F.xxhash64("query_id", "v")).dropDuplicates(["query_id", "v"])
    held = F.explode(F.arrays_zip("ids", "scores")).alias("x")
    first = home.select("query_id", "q", held).select("query_id", "q", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    if n_shards == 1:
        pairs = first
    else:
        routes = reachable(home, cell_boxes(points, scale), k, scale).withColumnRenamed("cell", "at").withColumnRenamed("shard", "home")
        routes = routes.withColumn("cell", F.explode("cells")).drop("cells").join(parts, "cell")
        routes = routes.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where((F.col("cell") != F.col("at")) | (F.col("shard") != F.col("home")))
        queries = cut(routes.withColumn("block", F.pmod("q", F.lit(n_blocks)).cast("int")).drop("parts", "at", "home"), "routes")
        asked_by = queries.select("dim", "cell", "shard", "block").distinct().toDF("dim", "cell", "shard", "asked_by")
        copies = points.select("dim", "cell", "shard", "vec_id", "v").join(asked_by, ["dim", "cell", "shard"]).withColumn("block", F.col("asked_by") + 0).drop("asked_by")

        def elsewhere(left: pa.Table, right: pa.Table) -> pa.Table:
            """A block of queries against a shard that is the home of none of them."""
            out = {"query_id": [], "q": [], "vec_id": [], "score": []}
            if left.num_rows and right.num_rows:
                data, asked = matrix(left["v"], scale), matrix(right["v"], scale)
                if data.size and float(np.abs(data).max()) * float(np.abs(asked).max()) * data.shape[1] >= 2.0**52:
                    data, asked = (np.array([[int(x) for x in row] for row in m], dtype=object) for m in (data, asked))
                tree = Tree(data, left["vec_id"].to_numpy())
                bounds = tree.bounds(asked)
                known = zip(right["query_id"].to_pylist(), right["q"].to_pylist(), right["ids"].to_pylist(), right["scores"].to_pylist())
                for j, (own, q, ids, scores) in enumerate(known):
                    for score, i in tree.search(asked[j], own, bounds[j], k, [(-s, x) for s, x in zip(scores, ids)]):
                        out["query_id"].append(own)
                        out["q"].append(q)
                        out["vec_id"].append(i)
                        out["score"].append(_long(-score))
            return pa.table(out, schema=pa.schema([(name, pa.int64()) for name in out]))

        keys = ["dim", "cell", "shard", "block"]
        right = queries.select(*keys, "query_id", "q", "v", "ids", "scores")
        more = copies.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(elsewhere, "query_id bigint, q bigint, vec_id bigint, score bigint")
        pairs = first.unionByName(more)
    w = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
