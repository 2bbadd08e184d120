"""Nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample (``SAMPLE`` vectors) and travels with the tasks; every vector of the table is
filed under the leaf whose means it is nearest to, level by level. A query keeps the open branches in a priority queue
by the inner product with their means and takes leaf after leaf. How many leaves it takes is widened on sample queries
until their recall against brute force reaches ``RECALL``; the same number then holds for all queries.

Vectors that are null, zero, or hold a null or a non-finite component take no part, nor do null ids, nor vectors whose
length is not the table's most frequent one (of equally frequent ones the largest). Of equal vectors only the ``k + 1``
smallest ids can be among a query's nearest, so only these are filed, and equal queries are searched once: one vector in
a third of all rows costs no more than another. Ties go to the smaller id. Rows that share the query's id are not its
neighbours. An empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.llm.common import written

SAMPLE, BRANCH, LEAF, RECALL, TRIALS = 16_384, 8, 128, 0.98, 200
#: Vectors and queries of a leaf that one task compares at a time.
BLOCK = 4096


class Tree:
    """Nodes as lists: mean of each, children of each (none: a leaf), number of each leaf."""

    def __init__(self, x: np.ndarray, seed: int = 5):
        self.mean, self.children, self.leaf, self.leaves = [x.mean(0)], [[]], [-1], 0
        rng = np.random.default_rng(seed)
        todo = [(0, x)]
        while todo:
            node, rows = todo.pop()
            parts = _split(rows, rng) if len(rows) > LEAF else []
            if len(parts) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for p in parts:
                self.children[node].append(len(self.mean))
                todo.append((len(self.mean), p))
                self.mean.append(p.mean(0))
                self.children.append([])
                self.leaf.append(-1)

    def file(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = _nearest(x[rows], np.array([self.mean[c] for c in self.children[node]]))
                todo += [(c, rows[near == k]) for k, c in enumerate(self.children[node])]
        return out

    def visit(self, q: np.ndarray, most: int) -> list[int]:
        """The first leaves a best-bin-first search takes."""
        heap, out = [(0.0, 0)], []
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            if not self.children[node]:
                out.append(self.leaf[node])
            for c in self.children[node]:
                heapq.heappush(heap, (-float(q @ self.mean[c]), c))
        return out


def _nearest(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    return ((means**2).sum(1)[None, :] - 2 * x @ means.T).argmin(1)


def _split(x: np.ndarray, rng: np.random.Generator, rounds: int = 8) -> list[np.ndarray]:
    means = x[rng.choice(len(x), BRANCH, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, means)
        means = np.array([x[near == k].mean(0) if (near == k).any() else means[k] for k in range(BRANCH)])
    near = _nearest(x, means)
    return [x[near == k] for k in range(BRANCH) if (near == k).any()]


def calibrated(tree: Tree, x: np.ndarray, k: int, recall: float = RECALL, trials: int = TRIALS) -> int:
    """Fewest leaves that hold ``recall`` of the k nearest of sample queries among the sample."""
    at = tree.file(x)
    queries = np.linspace(0, len(x) - 1, min(trials, len(x))).astype(int)
    needed = []
    for i in np.unique(queries):
        s = x @ x[i]
        s[i] = -np.inf
        top = np.argpartition(-s, min(k, len(s) - 1))[:k]
        place = {leaf: r for r, leaf in enumerate(tree.visit(x[i], tree.leaves))}
        needed += [place[leaf] + 1 for leaf in at[top]]
    needed.sort()
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array of double) of the vectors that take part."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("x", lambda e: e != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(fine)
    size = v.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    # -0.0 and 0.0 are equal vectors
    return v.where(F.size("x") == (size.d if size else 0)).withColumn("x", F.transform("x", lambda e: e + F.lit(0.0)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (vec_id, embedding), by inner product."""
    spark = vectors.sparkSession
    v = written(usable(vectors))
    d = v.select("x").first()
    q = usable(queries).where(F.size("x") == (len(d.x) if d else 0))
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if d is None:
        return spark.createDataFrame([], schema)
    # The k + 1 smallest ids of equal vectors; Spark limits each group before it is shuffled.
    first = F.row_number().over(W.partitionBy("x").orderBy("vec_id"))
    filed = v.distinct().withColumn("r", first).where(F.col("r") <= k + 1).drop("r")
    share = min(1.0, sample / max(1, v.count()))
    draw = F.pmod(F.xxhash64("vec_id", F.lit(23)), F.lit(1_000_003)) / 1_000_003
    rows = v.where(draw < share).select("x").limit(2 * sample).toArrow().column("x").combine_chunks()
    x = _matrix(rows) if len(rows) else np.array([d.x])
    tree = Tree(x)
    most = calibrated(tree, x, k, recall)
    shared = spark.sparkContext.broadcast((tree, most))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value[0].file(_matrix(b.column("x")))), *b.columns], ["leaf", "vec_id", "x"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, n = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                leaves = [t.visit(r, n) for r in _matrix(part.column("x"))]
                yield pa.RecordBatch.from_arrays([part.column("query"), part.column("x"), pa.array(leaves, pa.list_(pa.int64()))], ["query", "x", "leaves"])

    filed = written(filed.select("vec_id", "x").mapInArrow(file, "leaf bigint, vec_id bigint, x array<double>"))
    alike = written(q.groupBy("x").agg(F.min("vec_id").alias("query")))
    asked = written(alike.select("query", "x").mapInArrow(visit, "query bigint, x array<double>, leaves array<bigint>").select("query", "x", F.explode("leaves").alias("leaf")))
    # Both sides of a leaf are cut into blocks; the table of leaves is as long as the tree.
    blocks = filed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("cb")).join(asked.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("qb")), "leaf")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    c = filed.join(F.broadcast(blocks), "leaf").withColumn("c", F.pmod(F.xxhash64("vec_id"), "cb")).withColumn("q", spread(F.col("qb"))).select("leaf", "c", "q", "vec_id", "x")
    a = asked.join(F.broadcast(blocks), "leaf").withColumn("q", F.pmod(F.xxhash64("query"), "qb")).withColumn("c", spread(F.col("cb"))).select("leaf", "c", "q", "query", "x")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            m, ids = np.stack(left["x"].to_numpy()), left["vec_id"].to_numpy()
            for lo in range(0, len(right), 512):
                part = right.iloc[lo:lo + 512]
                for query, s in zip(part["query"], np.stack(part["x"].to_numpy()) @ m.T):
                    if len(s) > k + 1:
                        edge = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                        pick = np.flatnonzero(s >= edge)
                        pick = pick[np.lexsort((ids[pick], -s[pick]))][:k + 1]
                    else:
                        pick = np.arange(len(s))
                    out.append(pd.DataFrame({"query": query, "vec_id": ids[pick], "score": s[pick]}))
        return pd.concat(out) if out else pd.DataFrame({"query": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    found = c.groupBy("leaf", "c", "q").cogroup(a.groupBy("leaf", "c", "q")).applyInPandas(compare, "query bigint, vec_id bigint, score double")
    order = [F.desc("score"), F.asc("vec_id")]
    found = found.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("r") <= k + 1).drop("r")
    members = q.join(alike, "x").select(F.col("vec_id").alias("query_id"), "query").distinct()
    out = members.join(found, "query").where("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
