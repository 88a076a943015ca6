"""Approximate nearest neighbours by a forest of random-projection trees.

Every tree splits its part of the space by a random direction (through two random points of the part) at the
median, until a part holds few vectors. The trees are fitted on a bounded sample of ``sample_rows`` vectors,
those with the smallest hashes; every vector is then indexed under its leaf of each tree. A query searches
all trees through one shared priority queue, nearest margin first, until a number of leaves are open. That
number is what ``recall`` of the true neighbours needs on ``tuning`` queries compared with all vectors.
Vectors of the open leaves are the candidates; they meet the queries by (tree, run of leaves, block of
the queries that opened it, slice of its vectors) and are reranked by exact distance in double precision. A vector goes to
the blocks of its own run only, and a run with many vectors is dealt to slices, so neither side of a task grows with the data.

Equal vectors are one point with its ``k + 1`` smallest ids, so copies can't crowd a leaf; a query returns all
that they hold, so nothing is lost. A query whose leaves hold fewer points than it needs is compared with all
points, in blocks.

Defined results: vectors that are null, zero, empty or hold null or non-finite components take no part, nor do those
whose length is not the most frequent one (of equally frequent ones the larger); of rows with one id the one with the least vector takes part,
and asks if any of them does; a query's own row is not its
candidate, its copies are; ties go to the smaller id; fewer candidates than k are all returned; distances of vectors whose squares
leave the range of doubles are scaled, so they are finite where doubles can hold them; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import durable, small


@dataclass
class Tree:
    """Inner nodes: direction, threshold and two children; children below 0 are leaves (-1 - leaf)."""

    direction: np.ndarray
    threshold: np.ndarray
    child: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.child) else np.full(len(x), -1)
        while (on := np.flatnonzero(at >= 0)).size:
            node = at[on]
            side = np.einsum("ij,ij->i", x[on], self.direction[node]) > self.threshold[node]
            at[on] = self.child[node, side.astype(np.int64)]
        return -1 - at


def grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    direction, threshold, child, leaves = [], [], [], 0
    todo = [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        name = None
        if len(rows) > leaf:
            a, b = x[rng.choice(rows, 2, replace=False)]
            way = a / 2 - b / 2
            if (size := np.abs(way).max()) > 0:
                way = way / size
                way = way / np.linalg.norm(way)
                p = x[rows] @ way
                cut = float(np.median(p))
                up = p > cut
                if 0 < up.sum() < len(rows):
                    name = len(child)
                    direction.append(way)
                    threshold.append(cut)
                    child.append([0, 0])
                    todo += [(rows[~up], name, 0), (rows[up], name, 1)]
        if name is None:
            name, leaves = -1 - leaves, leaves + 1
        if parent >= 0:
            child[parent][side] = name
    dims = x.shape[1]
    return Tree(np.array(direction, np.float64).reshape(-1, dims), np.array(threshold), np.array(child, np.int64).reshape(-1, 2))


def search(forest: list[Tree], q: np.ndarray, probes: int) -> list[tuple[int, int]]:
    """The (tree, leaf) pairs that a query opens, by one queue over all trees: least margin crossed first."""
    margins = [t.direction @ q - t.threshold for t in forest]
    queue = [(0.0, k, 0 if len(t.child) else -1) for k, t in enumerate(forest)]
    found: list[tuple[int, int]] = []
    while queue and len(found) < probes:
        far, k, node = heapq.heappop(queue)
        while node >= 0:
            m = margins[k][node]
            near = int(m > 0)
            heapq.heappush(queue, (max(far, abs(m)), k, int(forest[k].child[node, 1 - near])))
            node = int(forest[k].child[node, near])
        found.append((k, -1 - node))
    return found


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _distance(x: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x from one vector; scaled where squares are too large or too small for doubles."""
    with np.errstate(over="ignore", under="ignore"):
        gap = x - one
        plain = (gap * gap).sum(axis=1)
        odd = np.flatnonzero(~np.isfinite(plain) | (plain < 1e-280))
        out = np.sqrt(plain)
        half = x[odd] / 2 - one / 2
        most = np.abs(half).max(axis=1, initial=0)
        share = half / np.where(most > 0, most, 1)[:, None]
        out[odd] = most * np.sqrt((share * share).sum(axis=1)) * 2
    return out


def _closest(v: np.ndarray, x: np.ndarray, p: np.ndarray, is_open: np.ndarray | None, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query row of v: rows of x that are its k nearest among the open ones (ties to smaller p), and their exact distances.

    Products of matrices leave a few rows each, with room for their rounding; these are measured exactly, as are rows beyond the range of products.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        own, other = (v * v).sum(axis=1), (x * x).sum(axis=1)
        rough = other[None, :] + own[:, None] - 2 * (v @ x.T)
        rough[~np.isfinite(rough)] = -np.inf
        if is_open is not None:
            rough[~is_open] = np.inf
        room = np.nan_to_num(1e-9 * (own + (other.max() if len(other) else 0)), nan=np.inf) + 1e-280
    for one, d, spare in zip(v, rough, room, strict=True):
        limit = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
        few = np.flatnonzero((d <= (limit + spare if limit > -np.inf else spare)) & (d < np.inf))
        exact = _distance(x[few], one)
        best = np.lexsort((p[few], exact))[:k]
        yield few[best], exact[best]


def probes_for(forest: list[Tree], queries: dict[int, np.ndarray], neighbours: dict[int, list[np.ndarray]], recall: float) -> int:
    """Leaves that a search must open to meet ``recall`` of the true neighbours of some queries."""
    places = []
    for q, v in queries.items():
        rank = {leaf: k for k, leaf in enumerate(search(forest, v, 1 << 62))}
        near = np.stack(neighbours[q])
        places.append(np.min([[rank[t, leaf] for leaf in tree.leaves(near).tolist()] for t, tree in enumerate(forest)], axis=0))
    return 1 + int(np.quantile(np.concatenate(places), recall, method="higher")) if places else 1


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = 4, leaf: int = 64, recall: float = 0.95, sample_rows: int = 40_000, tuning: int = 48, part_rows: int = 4096, query_rows: int = 2048, seed: int = 5) -> DataFrame:
    """query_id, rank, id, score of the k nearest rows found for each row where ``is_query`` (a condition) holds."""
    x = F.col("x")
    valid = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda v: v.cast("double") + F.lit(0.0)).alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where("id IS NOT NULL AND x IS NOT NULL AND size(x) > 0").where(valid)
    lengths = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    rows = durable(rows.where(F.size("x") == (lengths[0]["n"] if lengths else 0)))
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = durable(rows.groupBy("id").agg(F.min("x").alias("x"), F.max("asks").alias("asks")))

    # equal vectors are one point: its k + 1 smallest ids, named by the least of them
    firsts = rows.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("id"))).where(F.col("r") <= k + 1)
    points = durable(firsts.groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("p", F.col("ids")[0]))
    asking = durable(rows.where("asks").join(points.select("x", "p"), "x").select(F.col("id").alias("query_id"), F.col("p").alias("q")))
    queries = durable(asking.select("q").distinct().join(points.select(F.col("p").alias("q"), F.col("x").alias("qv")), "q"))

    n = points.count()
    sample = points.select("x", F.xxhash64("p").alias("h"))
    if n > sample_rows:
        sample = sample.where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < sample_rows / n)
    taken = sample.orderBy("h").toArrow() if n else None
    fit = _matrix(taken.column("x").combine_chunks()) if taken is not None and taken.num_rows else np.zeros((0, 1))
    rng = np.random.default_rng(seed)
    forest = [grow(fit, leaf, rng) for _ in range(trees)] if len(fit) else []
    shared = points.sparkSession.sparkContext.broadcast(forest)

    best = Window.partitionBy("q").orderBy("distance", "p")
    top = lambda df: df.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    if not forest:
        return asking.select("query_id", F.lit(1).alias("rank"), F.col("q").alias(id_col), F.lit(0.0).alias("score")).limit(0)
    few = queries.orderBy(F.xxhash64("q")).limit(tuning)
    truth = top(_against_all(few, points, k)).join(points.select("p", F.col("x").alias("pv")), "p").join(few, "q").collect()
    true_near: dict[int, list[np.ndarray]] = {}
    for r in truth:
        true_near.setdefault(r["q"], []).append(np.array(r["pv"]))
    probes = probes_for(forest, {r["q"]: np.array(r["qv"]) for r in truth}, true_near, recall)
    # a part is a run of neighbouring leaves of one tree; queries come in blocks of bounded size
    leaves = max(len(t.child) + 1 for t in forest)
    run_of = max(1, round(part_rows * leaves / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("x"))
            for t, tree in enumerate(shared.value if batch.num_rows else []):
                part, size = np.unique(tree.leaves(v) // run_of, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), t, np.int32)), pa.array(part), pa.array(size)], names=["tree", "part", "n"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("x"))
            for t, tree in enumerate(shared.value if batch.num_rows else []):
                at = tree.leaves(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(at // run_of), pa.array(at % run_of), batch.column("p"), batch.column("x")], names=["tree", "part", "leaf", "p", "pv"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, vector, v in zip(batch.column("q"), batch.column("qv"), _matrix(batch.column("qv")), strict=True):
                parts: dict[tuple[int, int], list[int]] = {}
                for t, at in search(shared.value, v, probes):
                    parts.setdefault((t, at // run_of), []).append(at % run_of)
                m, q, vector = len(parts), q.as_py(), vector.as_py()
                cols = [pa.array([t for t, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.int64()), pa.array([q] * m, pa.int64()), pa.array([vector] * m, pa.list_(pa.float64())), pa.array(list(parts.values()), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=["tree", "part", "q", "qv", "leaves"])

    def rerank(asked: pa.Table, held: pa.Table) -> pa.Table:
        asked, held = asked.combine_chunks(), held.combine_chunks()
        out: list[list] = [[], [], []]
        if asked.num_rows and held.num_rows:
            x, p, at = _matrix(held.column("pv").combine_chunks()), held.column("p").to_numpy(), held.column("leaf").to_numpy()
            q, v = asked.column("q").to_numpy(), _matrix(asked.column("qv").combine_chunks())
            is_open = np.zeros((len(q), run_of), bool)
            sizes = [len(own) for own in asked.column("leaves")]
            is_open[np.repeat(np.arange(len(q)), sizes), asked.column("leaves").combine_chunks().flatten().to_numpy()] = True
            for lo in range(0, len(q), 256):
                for name, (rows_, d) in zip(q[lo : lo + 256], _closest(v[lo : lo + 256], x, p, is_open[lo : lo + 256][:, at], k + 1), strict=True):
                    for col, value in zip(out, (np.full(len(rows_), name), p[rows_], d), strict=True):
                        col.append(value)
        return pa.table({c: np.concatenate([np.zeros(0, t), *o]) for c, t, o in zip(("q", "p", "distance"), (np.int64, np.int64, np.float64), out, strict=True)})

    # a run's queries come in blocks, its vectors in slices
    opened = durable(queries.mapInArrow(ask, "tree int, part long, q long, qv array<double>, leaves array<int>"))
    held = points.select("x").mapInArrow(count, "tree int, part long, n long").groupBy("tree", "part").agg((F.sum("n") / (2 * part_rows) + 1).cast("int").alias("slices"))
    runs = durable(opened.groupBy("tree", "part").agg((F.count("*") / query_rows + 1).cast("int").alias("blocks")).join(held, ["tree", "part"]))
    dealt = small(runs, 32)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    key = ["tree", "part", "block", "slice"]
    indexed = points.select("p", "x").mapInArrow(index, "tree int, part long, leaf long, p long, pv array<double>").join(dealt, ["tree", "part"]).withColumn("slice", one("p", "slices")).withColumn("block", each("blocks"))
    asked = opened.join(dealt, ["tree", "part"]).withColumn("block", one("q", "blocks")).withColumn("slice", each("slices"))
    near = asked.drop("blocks", "slices").groupBy(*key).cogroup(indexed.drop("blocks", "slices").groupBy(*key)).applyInArrow(rerank, "q long, p long, distance double")
    found = durable(top(near.groupBy("q", "p").agg(F.min("distance").alias("distance"))))

    # queries whose leaves hold too few points, unless there are no more: against all points, in blocks
    enough = found.groupBy("q").count().where(F.col("count") >= min(k + 1, n)).select("q")
    short = durable(queries.join(enough, "q", "left_anti"))
    if not short.isEmpty():
        found = durable(found.join(enough, "q", "left_semi").unionByName(top(_in_blocks(short, points, k, query_rows, 2 * part_rows))))

    ids = points.select("p", "ids")
    spread = found.join(ids, "p").select("q", "distance", F.explode("ids").alias("id"))
    first = Window.partitionBy("q").orderBy("distance", "id")
    lists = spread.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))
    out = asking.join(lists, "q").select("query_id", F.slice(F.filter("near", lambda s: s["id"] != F.col("query_id")), 1, k).alias("near"))
    return out.select("query_id", F.posexplode("near").alias("rank", "s")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("s.id").alias(id_col), F.col("s.distance").alias("score"))


def _against_all(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """q, p, distance of the k + 1 nearest points of every batch of points, for a bounded number of queries."""
    own = queries.toArrow()
    q, v = own.column("q").to_numpy(), _matrix(own.column("qv").combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                p, x = batch.column("p").to_numpy(), _matrix(batch.column("x"))
                for name, (rows, d) in zip(q, _closest(v, x, p, None, k + 1), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), name)), pa.array(p[rows]), pa.array(d)], names=["q", "p", "distance"])

    return points.select("p", "x").mapInArrow(run, "q long, p long, distance double")


def _in_blocks(queries: DataFrame, points: DataFrame, k: int, query_rows: int, point_rows: int) -> DataFrame:
    """The same for any number of queries: blocks of queries meet slices of points."""
    blocks, slices = queries.count() // query_rows + 1, points.count() // point_rows + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        asked, held, out = asked.combine_chunks(), held.combine_chunks(), []
        if asked.num_rows and held.num_rows:
            p, x = held.column("p").to_numpy(), _matrix(held.column("x").combine_chunks())
            q, v = asked.column("q").to_numpy(), _matrix(asked.column("qv").combine_chunks())
            for lo in range(0, len(q), 256):
                out += [(np.full(len(rows), name), p[rows], d) for name, (rows, d) in zip(q[lo : lo + 256], _closest(v[lo : lo + 256], x, p, None, k + 1), strict=True)]
        cols = zip(*out, strict=True) if out else ([], [], [])
        return pa.table({c: np.concatenate([np.zeros(0, t), *o]) for c, t, o in zip(("q", "p", "distance"), (np.int64, np.int64, np.float64), cols, strict=True)})

    a = queries.withColumn("block", one("q", blocks)).withColumn("slice", every(slices))
    b = points.select("p", "x").withColumn("slice", one("p", slices)).withColumn("block", every(blocks))
    return a.groupBy("block", "slice").cogroup(b.groupBy("block", "slice")).applyInArrow(run, "q long, p long, distance double")
