"""Approximate nearest neighbours (largest inner product) with a hierarchical k-means tree.

Fit: k-means splits a sample of at most ``SAMPLE`` vectors recursively; the tree is the only thing that is broadcast, and
its size is bounded by the sample. Every node has a direction (its centroid's), the largest angle from it to the directions of
the leaves below, and the largest norm of its sample. Index: every vector descends to its leaf. Search: each query walks the
tree best bin first: a priority queue holds nodes by the largest inner product that the cone of a node allows, inner nodes are
replaced by their children, leaves are visited in the order in which they leave the queue. How many leaves: up to ``CALIBRATION``
vectors that are not in the sample are searched exactly (in blocks, over all rows), and visits widen until that share of their true
neighbours lies in visited leaves that reaches ``RECALL``. A query whose leaves hold fewer than k candidates visits more.

Shuffle: leaves are grouped into blocks (runs of leaves, so near leaves share one), more of them where there are more vectors. A block with many
vectors or many queries is cut into a grid of chunks of at most ``CHUNK`` rows each, so a hot leaf is spread over tasks; a query is
sent once per block and chunk that it visits. A task multiplies queries with the rows of visited leaves only, leaf by leaf, and
returns its best k; the best of those are kept. Scores are inner products in double precision, summed in component order from the
original vectors, so equal vectors tie exactly.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, neither do vectors of
another length than the most frequent one; a query has all other candidates if there are fewer than k; rows that
repeat an id are each candidates; ties go to the smaller id; other columns, whatever their names, are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SAMPLE = 16_384
BRANCH = 8
LEAF_SAMPLE = 4
CALIBRATION = 256
RECALL = 0.97
CHUNK = 20_000
#: Blocks at least; more if there are over CHUNK vectors for each of these.
BLOCKS = 16


class Tree:
    """Centroids of all nodes, children by node, and leaf numbers in depth-first order (-1 for inner nodes)."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf_sample: int = LEAF_SAMPLE, seed: int = 7) -> None:
        self.random = np.random.default_rng(seed)
        self.centroid: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.norms: list[float] = []
        self.leaves = 0
        self._node(sample, sample.mean(axis=0) if len(sample) else np.zeros(0), branch, leaf_sample)
        self.matrix = np.array(self.centroid)
        del self.random
        length = np.linalg.norm(self.matrix, axis=1, keepdims=True)
        self.direction = self.matrix / np.where(length > 0, length, 1)
        self.angle, self.norm = np.zeros(len(self.matrix)), np.array(self.norms)
        below: list[list[int]] = [[] for _ in self.leaf]
        for node in range(len(self.leaf) - 1, -1, -1):  # children have larger numbers
            below[node] = [node] if self.leaf[node] >= 0 else [x for c in self.children[node] for x in below[c]]
            if self.children[node]:
                cosine = self.direction[below[node]] @ self.direction[node]
                self.angle[node] = np.arccos(np.clip(cosine, -1, 1)).max()
                self.norm[node] = self.norm[self.children[node]].max()

    def _node(self, rows: np.ndarray, centroid: np.ndarray, branch: int, leaf_sample: int) -> int:
        node = len(self.centroid)
        self.centroid.append(centroid)
        self.children.append([])
        self.leaf.append(-1)
        self.norms.append(float(np.linalg.norm(rows, axis=1).max(initial=0.0)))
        parts = self._split(rows, branch) if len(rows) > leaf_sample else []
        if len(parts) < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
            return node
        self.children[node] = [self._node(part, part.mean(axis=0), branch, leaf_sample) for part in parts]
        return node

    def _split(self, rows: np.ndarray, branch: int) -> list[np.ndarray]:
        different = np.unique(rows, axis=0)
        if len(different) < 2:
            return []
        centre = different[self.random.choice(len(different), min(branch, len(different)), replace=False)]
        for _ in range(12):
            own = _nearest(rows, centre)
            centre = np.array([rows[own == i].mean(axis=0) if (own == i).any() else c for i, c in enumerate(centre)])
        own = _nearest(rows, centre)
        return [rows[own == i] for i in range(len(centre)) if (own == i).any()]

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row, by descent to the nearest child."""
        node = np.zeros(len(rows), np.int64)
        while True:
            inner = [x for x in np.unique(node) if self.children[x]]
            if not inner:
                return np.array(self.leaf)[node]
            for x in inner:
                at, below = node == x, np.array(self.children[x])
                node[at] = below[_nearest(rows[at], self.matrix[below])]

    def visits(self, query: np.ndarray, most: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """Leaves in best-bin-first order: ``most`` of them, and more until they hold ``least`` rows (sizes: rows by leaf)."""
        length = np.linalg.norm(query)
        angle = np.arccos(np.clip(self.direction @ (query / length), -1, 1))
        score = self.norm * np.cos(np.maximum(angle - self.angle, 0))
        queue, found, rows = [(-score[0], 0)], [], 0
        while queue and (len(found) < most or rows < least):
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for x in self.children[node]:
                    heapq.heappush(queue, (-score[x], x))
            else:
                found.append(self.leaf[node])
                rows += int(sizes[self.leaf[node]]) if sizes is not None else 0
        return found


def _nearest(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmin((centre * centre).sum(axis=1) - 2 * rows @ centre.T, axis=1)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def inner_products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Pairwise by row, summed in component order."""
    total = np.zeros(len(queries))
    for j in range(queries.shape[1]):
        total += queries[:, j] * rows[:, j]
    return total


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, groups=None) -> Iterator[tuple]:
    """For each query: its number, and row numbers and scores of its k best rows, best first.

    groups: (slice of rows, mask of the queries that look at them); all rows for all queries without it.
    """
    for at in range(0, len(queries), 256):
        part = slice(at, at + 256)
        if groups is None:
            scores = queries[part] @ rows.T
        else:
            scores = np.full((len(queries[part]), len(rows)), -np.inf)
            for some, mask in groups:
                who = np.flatnonzero(mask[part])
                if len(who):
                    scores[who, some] = queries[part][who] @ rows[some].T
        scores[query_ids[part, None] == ids[None, :]] = -np.inf
        for i, s in enumerate(scores):
            edge = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
            near = np.flatnonzero((s >= edge - 1e-9 * max(1.0, abs(edge))) & (s > -np.inf)) if edge > -np.inf else np.flatnonzero(s > -np.inf)
            exact = inner_products(np.broadcast_to(queries[at + i], (len(near), rows.shape[1])), rows[near])
            order = np.lexsort((ids[near], -exact))[:k]
            yield at + i, near[order], exact[order]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    recall: float = RECALL,
    sample: int = SAMPLE,
    chunk: int = CHUNK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. ``is_query`` is a condition on the columns of ``vectors``."""
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    ).where(F.col("id").isNotNull() & usable(F.col("v")))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    result = "query_id long, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == length["n"])
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample + CALIBRATION).select("id", "v").toPandas()
    asked = min(CALIBRATION, len(picked) // 8)  # the last ones in hash order; the tree doesn't see them
    tree = Tree(_matrix(picked["v"].head(len(picked) - asked)))
    shared = spark.sparkContext.broadcast(tree)

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            leaf = shared.value.assign(_matrix(pdf["v"])) if len(pdf) else np.zeros(0, np.int64)
            yield pdf.assign(leaf=leaf)

    indexed = staged(rows.mapInPandas(assigned, "id long, v array<double>, asked boolean, leaf long"), "indexed")
    most = _calibrated(indexed, picked.tail(asked), tree, k, recall)
    sizes = np.zeros(tree.leaves, np.int64)  # one row per leaf: bounded by the sample
    for r in indexed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["leaf"]] = r["n"]
    per_block = -(-tree.leaves // min(tree.leaves, max(BLOCKS, -(-int(sizes.sum()) // chunk))))
    indexed = indexed.withColumn("block", F.floor(F.col("leaf") / per_block).cast("long"))

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, v in zip(pdf["id"], pdf["v"], strict=True):
                leaves = np.sort(np.array(shared.value.visits(np.asarray(v), most, sizes, k + 1), np.int64))
                leaves = leaves[sizes[leaves] > 0]
                edges = np.flatnonzero(np.diff(leaves // per_block)) + 1
                out += [(i, v, int(part[0]) // per_block, part) for part in np.split(leaves, edges)]
            yield pd.DataFrame(out, columns=["id", "v", "block", "leaves"])

    queries = indexed.where("asked").select("id", "v").mapInPandas(routed, "id long, v array<double>, block long, leaves array<long>")
    queries = staged(queries, "routed")  # read for the grid and for the search
    # At most one row per leaf: into how many chunks the vectors and the queries of a block are cut.
    held = indexed.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    asked = queries.groupBy("block").agg(F.count(F.lit(1)).alias("m"))
    grid = {r["block"]: (-(-r["n"] // chunk), -(-r["m"] // chunk)) for r in held.join(asked, "block").collect()}
    cuts = F.create_map(*[x for b, (n, m) in grid.items() for x in (F.lit(b), F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")))]) if grid else None
    if cuts is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cut = F.element_at(cuts, F.col("block"))
    spread = lambda own, other: (
        F.pmod(F.xxhash64("id"), cut[own]).alias(f"{own}_chunk"),
        F.explode(F.sequence(F.lit(0).cast("long"), (cut[other] - 1).cast("long"))).alias(f"{other}_chunk"),
    )
    known = F.col("block").isin(list(grid))
    left = queries.where(known).select("id", "v", "leaves", "block", *spread("m", "n"))
    right = indexed.where(known).select("id", "v", "leaf", "block", *spread("n", "m"))
    keys = ["block", "n_chunk", "m_chunk"]

    def search(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(there):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        there = there.sort_values("leaf", kind="stable")
        ids, query_ids = there["id"].to_numpy(), asked["id"].to_numpy()
        leaf, first = there["leaf"].to_numpy(), int(there["leaf"].min())
        open_leaf = np.zeros((len(asked), int(leaf.max()) - first + 1), bool)
        for i, leaves in enumerate(asked["leaves"]):
            inside = np.asarray(leaves) - first
            open_leaf[i, inside[(inside >= 0) & (inside < open_leaf.shape[1])]] = True
        edges = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
        groups = [(slice(a, b), open_leaf[:, leaf[a] - first]) for a, b in zip(edges, edges[1:], strict=False)]
        out = [(np.full(len(near), query_ids[i]), ids[near], score) for i, near, score in best(_matrix(asked["v"]), query_ids, _matrix(there["v"]), ids, k, groups)]
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrated(indexed: DataFrame, queries: pd.DataFrame, tree: Tree, k: int, recall: float) -> int:
    """The fewest leaf visits with which the calibration queries reach the recall; queries and their true neighbours are few."""
    if queries.empty:
        return tree.leaves
    q, ids = _matrix(queries["v"]), queries["id"].to_numpy()

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                row_ids, leaf = pdf["id"].to_numpy(), pdf["leaf"].to_numpy()
                out = [(np.full(len(n), i), row_ids[n], leaf[n], s) for i, n, s in best(q, ids, _matrix(pdf["v"]), row_ids, k)]
                yield pd.DataFrame(dict(zip(("q", "id", "leaf", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    near = indexed.mapInPandas(exact, "q long, id long, leaf long, score double")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "leaf").toPandas()
    if near.empty:
        return tree.leaves
    needed = []
    for i, group in near.groupby("q"):
        rank = np.empty(tree.leaves, np.int64)
        rank[tree.visits(q[i], tree.leaves)] = np.arange(1, tree.leaves + 1)
        needed += rank[group["leaf"].to_numpy()].tolist()
    return int(np.sort(needed)[max(0, int(np.ceil(recall * len(needed))) - 1)])
