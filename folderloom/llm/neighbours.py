"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample (``SAMPLE`` vectors, drawn by hash over the whole table): each node splits its
vectors by k-means into ``BRANCHES`` until ``LEAF`` are left. Every row is then put into its leaf. A query walks the tree
with a priority queue: it opens the nearest unopened branch next, so leaves come out in best-bin-first order. How many
leaves are visited is calibrated: for a bounded set of queries the true neighbours among all rows are found by brute force,
and visits widen until the share of true neighbours in visited leaves reaches ``RECALL``. A query whose leaves hold fewer than
``k`` other rows goes on in the same order until they do, so it never gets fewer rows than there are.

Leaves may be hot, as equal vectors share one: a leaf is dealt into parts of about ``PART`` rows by a hash of the row, and a
query visits all parts of its leaves. A part meets its queries in one matrix product for each block of queries; only the
best ``k`` of a part leave it. Broadcast are the tree (at most 2 * SAMPLE centres) and the calibration queries.

Nearness is the cosine in double precision on the original vectors. Vectors that are null, zero, of another length than most,
or hold null or non-finite components take no part, nor do rows without id. Rows with the query's own id are not its
candidates. Ties go to the smaller id; repeated candidate rows fill several ranks; a repeated query is answered once, by the
smallest of its vectors; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folderloom.plans.staging import Stage

SAMPLE, BRANCHES, LEAF = 20_000, 8, 100
CALIBRATION, RECALL = 200, 0.96
PART = 2_000
BLOCK = 1_000


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tree:
    """Centres of each inner node's children; a negative child is a leaf."""

    def __init__(self, vectors: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 5):
        self.nodes: list[tuple[np.ndarray, np.ndarray]] = []
        self.leaves = 0
        self.rng = np.random.default_rng(seed)
        self.root = self._grow(vectors, branches, leaf)
        del self.rng

    def _grow(self, x: np.ndarray, branches: int, leaf: int) -> int:
        if len(x) > leaf:
            centres = x[self.rng.choice(len(x), branches, replace=False)]
            for _ in range(8):
                near = np.argmax(x @ centres.T, axis=1)
                sums = np.zeros_like(centres)
                np.add.at(sums, near, x)
                size = np.sqrt((sums * sums).sum(axis=1))
                centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
            near = np.argmax(x @ centres.T, axis=1)
            used = np.unique(near)
            if len(used) > 1:
                at = len(self.nodes)
                self.nodes.append((centres[used], np.zeros(len(used), np.int64)))
                for k, c in enumerate(used):
                    self.nodes[at][1][k] = self._grow(x[near == c], branches, leaf)
                return at
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.root)
        while (inner := np.flatnonzero(out >= 0)).size:
            for node in np.unique(out[inner]):
                rows = inner[out[inner] == node]
                centres, children = self.nodes[node]
                out[rows] = children[np.argmax(x[rows] @ centres.T, axis=1)]
        return -out - 1

    def visits(self, q: np.ndarray):
        """Leaves in best-bin-first order: the queue holds branches by their distance to the query."""
        queue = [(0.0, 0, self.root)]
        pushed = 0
        while queue:
            _, _, node = heapq.heappop(queue)
            if node < 0:
                yield -node - 1
                continue
            centres, children = self.nodes[node]
            for near, child in zip((centres @ q).tolist(), children.tolist(), strict=True):
                pushed += 1
                heapq.heappush(queue, (1.0 - near, pushed, child))


def _assign(tree, dim: int):
    """The leaf of each row, and a running number by which the rows of a leaf are dealt out, equal ones too."""

    def run(batches):
        done = 0
        for batch in batches:
            leaf = tree.value.leaf_of(_unit(_matrix(batch.column("v"), dim))) if batch.num_rows else np.empty(0, np.int64)
            turn = np.arange(done, done + batch.num_rows)
            done += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(leaf, pa.int32()), pa.array(turn)], names=["id", "v", "leaf", "turn"])

    return run


def _best(ids: np.ndarray, own: np.ndarray, scores: np.ndarray, k: int, extra: np.ndarray | None = None):
    """For each query: positions of the k best candidates but its own id, ties to the smaller id."""
    for r in range(len(own)):
        some = np.flatnonzero(ids != own[r])
        if len(some) > 4 * k:
            s = scores[r, some]
            bound = np.partition(s, len(s) - k)[len(s) - k]
            some = some[s >= bound]
        yield some[np.lexsort((ids[some], -scores[r, some]))][:k]


def _truth(queries, dim: int, k: int):
    """The best of each batch of rows for all calibration queries, with their leaves."""

    def run(batches):
        own, x = queries.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, leaf = batch.column("id").to_numpy(), batch.column("leaf").to_numpy()
            scores = x @ _unit(_matrix(batch.column("v"), dim)).T
            for q, at in enumerate(_best(ids, own, scores, k)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), own[q])), pa.array(ids[at]), pa.array(leaf[at], pa.int32()), pa.array(scores[q, at])],
                    names=["query_id", "id", "leaf", "score"])

    return run


def _route(tree, dim: int, leaves: int, k: int):
    """The leaves each query visits: the calibrated number, and more until they hold ``k`` rows besides those of its own id."""

    def visited(q: np.ndarray, own: int) -> list[int]:
        walk, held = [], 0
        for leaf in tree.value.visits(q):
            if len(walk) >= leaves and held >= k + own:
                break
            walk.append(leaf)
            held += tree.value.rows.get(leaf, 0)
        return walk

    def run(batches):
        for batch in batches:
            x = _unit(_matrix(batch.column("v"), dim)) if batch.num_rows else np.empty((0, dim))
            found = [visited(q, own) for q, own in zip(x, batch.column("own").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(found, pa.list_(pa.int32()))],
                                             names=["id", "v", "leaves"])

    return run


def _search(dim: int, k: int):
    def run(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            own, ids = left.column("id").to_numpy(), right.column("id").to_numpy()
            x = _unit(_matrix(left.column("v").combine_chunks(), dim))
            y = _unit(_matrix(right.column("v").combine_chunks(), dim))
            for at in range(0, len(own), BLOCK):
                scores = x[at:at + BLOCK] @ y.T
                for r, best in enumerate(_best(ids, own[at:at + BLOCK], scores, k)):
                    out.append((np.full(len(best), own[at + r]), ids[best], scores[r, best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table([pa.array(c) for c in columns], names=["query_id", "id", "score"])

    return run


def usable(vectors: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """Rows (id, v) that take part, and their length: the most frequent one, the least of several."""
    v = F.col(vector).cast("array<double>")
    fine = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = sizes[0]["n"] if sizes else 1
    return fine.where(F.size("v") == dim), dim


def _spread(*columns: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit("spread"), *columns), 1).cast("double") / float(1 << 63)


def search(vectors: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, recall: float = RECALL,
           sample: int = SAMPLE, calibration: int = CALIBRATION, branches: int = BRANCHES, leaf: int = LEAF, part: int = PART) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row for which ``is_query(id column)`` holds."""
    spark = vectors.sparkSession
    stage, context = Stage(spark), spark.sparkContext
    rows, dim = usable(vectors, vec_id, vector)
    queries = rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"), F.count("*").alias("own"))
    total, asked = rows.count(), queries.count()
    if not total or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = rows.where(_spread("id", "v") < sample / total).select("id", "v").distinct().toPandas()["v"]
    tree = Tree(_unit(np.array(drawn.tolist()).reshape(-1, dim)) if len(drawn) else np.ones((1, dim)), branches, leaf)
    shared = context.broadcast(tree)
    placed = stage.keep(rows.mapInArrow(_assign(shared, dim), "id long, v array<double>, leaf int, turn long"), "placed")

    tried = queries.where(_spread("id") < calibration / asked).toPandas()
    if not len(tried):
        tried = queries.limit(1).toPandas()
    own, x = tried["id"].to_numpy(np.int64), _unit(np.array(tried["v"].tolist()).reshape(-1, dim))
    truth = placed.mapInArrow(_truth(context.broadcast((own, x)), dim, k), "query_id long, id long, leaf int, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    truth = truth.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("query_id", "leaf").toPandas()
    at = {int(q): {b: n for n, b in enumerate(tree.visits(v))} for q, v in zip(own, x, strict=True)}
    turns = np.sort([at[q][b] for q, b in zip(truth["query_id"], truth["leaf"], strict=True)]) if len(truth) else np.zeros(1, int)
    leaves = 1
    while leaves < tree.leaves and np.mean(turns < leaves) < recall:
        leaves += 1

    counted = placed.groupBy("leaf").count()
    tree.rows = {r["leaf"]: r["count"] for r in counted.collect()}  # at most one row for each leaf of the tree
    sizes = counted.withColumn("parts", F.ceil(F.col("count") / part).cast("int"))
    sizes = F.broadcast(sizes.select("leaf", "parts"))
    routed = queries.mapInArrow(_route(context.broadcast(tree), dim, leaves, k), "id long, v array<double>, leaves array<int>")
    routed = routed.select("id", "v", F.explode("leaves").alias("leaf")).join(sizes, "leaf")
    routed = routed.select("id", "v", "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = placed.join(sizes, "leaf").select("id", "v", "leaf", F.pmod(F.xxhash64("id", "turn"), F.col("parts")).cast("int").alias("part"))
    found = routed.groupBy("leaf", "part").cogroup(dealt.groupBy("leaf", "part")).applyInArrow(
        _search(dim, k), "query_id long, id long, score double")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")
