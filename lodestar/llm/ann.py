"""Approximate nearest neighbours: a forest of random-projection trees searched through one shared priority queue.

Trees are fitted on a bounded sample of the vectors (``sample``, by the smallest hash of the id): a node projects onto
the difference of two of its points and splits at the median. Every row is then indexed: it falls to one leaf of each tree.
A query walks all trees at once, always opening the node that its own side misses by the least, until it has
``leaves`` leaves; the rows of those leaves are reranked by their exact distance in double precision.

Copies of one vector can't be told apart by any plane, so only the ``k + 1`` smallest ids of each distinct vector are
indexed: no other copy can be among the nearest ``k``. Leaves with more rows than ``task_rows`` are dealt over several
groups, each of which gets the leaf's queries, so a crowded leaf is no single task.

Defined results: null or zero vectors and those with null or non-finite components take no part, neither do rows with
a null id; with fewer candidates than ``k`` all that were found are returned; an empty table gives no rows; vectors
whose length differs from the most frequent one (ties to the longer) take no part; rows that repeat an id count as one candidate,
at the distance of the nearest of them; a distance beyond the range of doubles is infinite and sorts last.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 10
TREES, LEAF, LEAVES = 16, 48, 320
SAMPLE = 20_000
TASK_ROWS = 4096


class Forest:
    """Flat arrays of all trees' nodes; a negative child -1 - x is leaf x."""

    def __init__(self, points: np.ndarray, trees: int, leaf: int, seed: int = 7):
        self.planes: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.children: list[list[int]] = []
        self.roots: list[int] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        for _ in range(trees):
            self.roots.append(self._grow(points, np.arange(len(points)), leaf, rng))
        dim = points.shape[1] if len(points) else 0
        self.plane = np.array(self.planes, np.float32).reshape(len(self.planes), dim)
        self.cut, self.child = np.array(self.cuts, np.float64), np.array(self.children, np.int64).reshape(-1, 2)
        del self.planes, self.cuts, self.children

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, points: np.ndarray, rows: np.ndarray, leaf: int, rng) -> int:
        if len(rows) <= leaf:
            return self._leaf()
        for _ in range(5):
            a, b = points[rng.choice(rows, 2, replace=False)]
            plane = (a - b).astype(np.float64)
            norm = np.sqrt(plane @ plane)
            if norm == 0:
                continue
            plane /= norm
            at = points[rows] @ plane
            cut = float(np.median(at))
            right = at > cut
            if 0 < right.sum() < len(rows):
                break
        else:
            return self._leaf()
        k = len(self.planes)
        self.planes.append(plane.astype(np.float32))
        self.cuts.append(cut)
        self.children.append([0, 0])
        self.children[k] = [self._grow(points, rows[~right], leaf, rng), self._grow(points, rows[right], leaf, rng)]
        return k

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree (rows by trees)."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            live = np.flatnonzero(node >= 0)
            while len(live):
                at = node[live]
                side = np.einsum("ij,ij->i", x[live], self.plane[at]) > self.cut[at]
                node[live] = self.child[at, side.astype(int)]
                live = live[node[live] >= 0]
            out[:, t] = -1 - node
        return out

    def nearest_leaves(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves of all trees in the order of the shared queue."""
        if not len(self.plane):
            return sorted({-1 - r for r in self.roots})
        miss = (self.plane @ q - self.cut).tolist()
        child, queue, found = self.child, [(0.0, r) for r in self.roots], []
        heapq.heapify(queue)
        while queue and len(found) < most:
            cost, node = heapq.heappop(queue)
            while node >= 0:
                m = miss[node]
                side = m > 0
                heapq.heappush(queue, (max(cost, abs(m)), int(child[node, 1 - side])))
                node = int(child[node, int(side)])
            found.append(-1 - node)
        return found


def usable(vector: str) -> Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Euclidean distances; differences whose squares are out of range are scaled first."""
    with np.errstate(over="ignore", under="ignore"):
        apart = x - u
        d = np.sqrt((apart**2).sum(axis=1))
        odd = np.flatnonzero(~np.isfinite(d) | (d < 1e-150))
        if len(odd):
            # halved, so that no difference overflows
            half = x[odd] / 2 - u / 2
            top = np.abs(half).max(axis=1, initial=0.0)
            scaled = half / np.where(top > 0, top, 1.0)[:, None]
            d[odd] = top * np.sqrt((scaled**2).sum(axis=1)) * 2
    return d


def search(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, trees: int = TREES, leaf: int = LEAF, leaves: int = LEAVES, sample: int = SAMPLE, task_rows: int = TASK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found rows of every query row, the row of its own id left out."""
    spark = vectors.sparkSession

    # single precision is carried as it is, and widened where distances are taken
    kind = "float" if all(df.schema[vector_col].dataType.simpleString() == "array<float>" for df in (vectors, queries)) else "double"

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
        return rows.where(F.col("id").isNotNull() & usable("v"))

    rows, asked = clean(vectors), clean(queries)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
    dim = sizes["n"] if sizes else 0
    rows, asked = rows.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    copies = Window.partitionBy("v").orderBy("id")
    rows = rows.withColumn("_copy", F.dense_rank().over(copies)).where(F.col("_copy") <= k + 1).select("id", "v").distinct()  # ids, not rows
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    forest = spark.sparkContext.broadcast(Forest(_matrix(picked.column("v")) if len(picked) else np.zeros((0, dim)), trees, leaf))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = forest.value.place(_matrix(batch.column(1)))
            row = np.repeat(np.arange(len(at)), at.shape[1])
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), *taken.columns], names=["leaf", "id", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [forest.value.nearest_leaves(q, leaves) for q in _matrix(batch.column(1))]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)), *taken.columns], names=["leaf", "q", "u"])

    indexed = rows.select("id", "v").mapInArrow(place, f"leaf long, id long, v array<{kind}>")
    probes = asked.select(F.col("id").alias("q"), F.col("v").alias("u")).mapInArrow(ask, f"leaf long, q long, u array<{kind}>")
    crowd = indexed.groupBy("leaf").count().where(F.col("count") > task_rows)
    groups = {r["leaf"]: -(-r["count"] // task_rows) for r in crowd.collect()}  # at most one entry per leaf of the bounded forest
    parts = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv]) if groups else F.create_map().cast("map<bigint,bigint>")
    n_parts = F.coalesce(F.try_element_at(parts, F.col("leaf")), F.lit(1).cast("bigint"))
    indexed = indexed.withColumn("part", F.pmod(F.xxhash64("id"), n_parts))
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), n_parts - 1)))

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The k nearest rows of one leaf part for each of its queries."""
        out_q, out_id, out_d = [], [], []
        if len(left) and len(right):
            ids = left["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], np.stack(left["v"].to_numpy())[order].astype(np.float64)
            repeated = bool((ids[1:] == ids[:-1]).any())
            for q, u in zip(right["q"], right["u"], strict=True):
                d = distances(x, np.asarray(u, np.float64))
                order = np.flatnonzero(ids != q)
                order = order[np.argsort(d[order], kind="stable")]
                if repeated:
                    order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
                best = order[:k]
                out_q += [q] * len(best)
                out_id += ids[best].tolist()
                out_d += d[best].tolist()
        return pd.DataFrame({"q": np.array(out_q, np.int64), "id": np.array(out_id, np.int64), "d": np.array(out_d, np.float64)})

    near = indexed.groupBy("leaf", "part").cogroup(probes.groupBy("leaf", "part")).applyInPandas(rerank, "q long, id long, d double")
    once = near.groupBy("q", "id").agg(F.min("d").alias("score"))
    by = Window.partitionBy("q").orderBy("score", "id")
    ranked = once.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op6(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, embeddings.where(F.col("vec_id") % 100 == 0))
