"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on three quarters of at most SAMPLE vectors (the first by a hash); every vector is indexed in the leaf with the nearest centre. A query opens the most promising node of a priority queue (the bound: inner product with the centre, plus a share of the node's spread, a larger one above the leaves) until it has visited enough leaves; how many is calibrated on CALIBRATE vectors of the sample's last quarter against brute force over that quarter, widening until RECALL is reached: vectors that the tree wasn't fitted on fall into leaves as all others do, and the k nearest of all N are about the k * n / N nearest of these n.

Equal vectors form one class that is indexed and searched once. Of a class, only the smallest k + 1 ids can be among k nearest (ties go to smaller ids, one may be the query's own), so no more are carried; nothing else is left out. Neighbouring leaves travel as one group, up to BLOCK vectors, so a query moves once for each group and not for each leaf; of a group, it is compared only with the leaves that it visits. Groups and the queries that visit them are dealt in blocks, so no task grows with a hot leaf.

Vectors of different lengths have no inner product: each length is indexed and searched by itself.

Nulls: vectors that are null, zero, or hold null or non-finite components take no part, neither as query nor as candidate. Null ids take no part. Repeated ids are one row each (a query's own id is never its neighbour). An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, stage, table

SAMPLE, CALIBRATE, RECALL = 20_000, 400, 0.94
#: Children of a node; a leaf holds at most LEAF vectors of the sample.
BRANCH, LEAF = 8, 16
#: Vectors of a group of leaves, and queries, that one task compares.
BLOCK = 4096


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)
        centres = np.stack([x[near == i].mean(0) if (near == i).any() else centres[i] for i in range(len(centres))])
    near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)
    used = np.unique(near)
    return centres[used], np.searchsorted(used, near)


class Tree:
    """children[n]: nodes below n (empty: a leaf). centre and spread: of the sample in it. leaf[n]: number of the leaf, or -1."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF):
        self.children, self.centre, self.spread, self.leaf = [[]], [x.mean(0)], [0.0], [-1]
        self.leaves = 0
        todo = [(0, x)]
        while todo:
            node, part = todo.pop()
            centres, near = k_means(part, branch, node) if len(part) > leaf else (part[:0], np.zeros(0, int))
            if len(centres) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for i, c in enumerate(centres):
                own = part[near == i]
                self.children[node].append(len(self.children))
                todo.append((len(self.children), own))
                self.children.append([])
                self.centre.append(c)
                self.spread.append(float(np.sqrt(((own - c) ** 2).sum(1).mean())))
                self.leaf.append(-1)
        self.centre = np.array(self.centre)
        at = np.flatnonzero(np.array(self.leaf) >= 0)
        self.ends = self.centre[at[np.argsort(np.array(self.leaf)[at])]]  # centres of leaves by their numbers
        self.bound = np.where(np.array(self.leaf) >= 0, 0.3, 1.0) * np.array(self.spread)
        self.visits = self.leaves

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the one with the nearest centre."""
        far = (self.ends**2).sum(1)
        return np.concatenate([np.zeros(0, np.int64), *(np.argmin(far - 2 * x[i : i + 1024] @ self.ends.T, 1) for i in range(0, len(x), 1024))])

    def order(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves in the order of visiting, best bin first."""
        promise = self.centre @ q + self.bound * np.sqrt(q @ q)
        heap, out = [(-promise[0], 0)], []
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
            for n in self.children[node]:
                heapq.heappush(heap, (-promise[n], n))
        return out

    def calibrate(self, x: np.ndarray, k: int, tries: int = CALIBRATE, recall: float = RECALL) -> "Tree":
        """Sets visits to the least number of leaves that finds the wanted share of the k nearest among x."""
        if len(x) < 2:
            return self
        at = self.place(x)
        pick = np.linspace(0, len(x) - 1, min(tries, len(x))).astype(int)
        need = []
        for i in pick:
            dots = x @ x[i]
            dots[i] = -np.inf
            best = np.argpartition(-dots, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
            turn = np.empty(self.leaves, np.int64)
            seen = self.order(x[i], self.leaves)
            turn[seen] = np.arange(len(seen))
            need.append(turn[at[best]])
        self.visits = int(np.quantile(np.concatenate(need), recall)) + 1
        return self


def usable(vectors: DataFrame, key: str, col: str) -> DataFrame:
    """id, v (doubles), h: the rows that take part."""
    v = F.col(col).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    return rows.withColumn("h", F.xxhash64("v"))


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), -1)


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Distinct keys (ascending already), and the values of each."""
    known, first = np.unique(keys, return_index=True)
    return known.tolist(), np.split(values, first[1:])


def nearest(vectors: DataFrame, key: str, col: str, k: int, is_query) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id fits is_query(column of ids)."""
    rows = usable(vectors, key, col)
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for w in rows.select(F.size("v").alias("d")).distinct().orderBy("d").collect():  # a table's vectors have one length, or a few
        found = found.unionByName(nearest_of_one_length(rows.filter(F.size("v") == w.d), k, is_query))
    return found


def nearest_of_one_length(rows: DataFrame, k: int, is_query) -> DataFrame:
    spark = rows.sparkSession
    same = Window.partitionBy("h", "v").orderBy("id")
    small = rows.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k + 1)
    classes = stage(small.groupBy("h", "v").agg(F.min("id").alias("cid"), F.array_sort(F.collect_list("id")).alias("ids")), "neighbours")
    queries = rows.filter(is_query(F.col("id"))).join(classes.select("h", "v", "cid"), ["h", "v"]).select(F.col("id").alias("query_id"), "cid")
    queries = stage(queries, "neighbours")
    sample = classes.select("h", "cid", "v").orderBy("h", "cid").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()  # at most SAMPLE vectors
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = _matrix(sample)
    held = np.arange(len(x)) % 4 == 3
    tree = Tree(x[~held]).calibrate(x[held], math.ceil(k * held.sum() / classes.count()))
    tree = spark.sparkContext.broadcast(tree)  # bounded by SAMPLE

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(tree.value.place(_matrix(b.column(1)))), b.column(0), b.column(1)], names=["leaf", "cid", "v"])

    indexed = stage(classes.select("cid", "v").mapInArrow(lean(index), "leaf long, cid long, v array<double>"), "neighbours")
    sizes = np.zeros(tree.value.leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # one row for each leaf
        sizes[r.leaf] = r["count"]
    group = spark.sparkContext.broadcast(np.cumsum(sizes) // BLOCK)  # leaves that follow each other are near each other in the tree

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                row, groups, lists = [], [], []
                for i, q in enumerate(_matrix(part.column(1))):
                    leaves = np.sort(np.array(t.order(q, t.visits)))
                    known, first = np.unique(group.value[leaves], return_index=True)
                    row += [i] * len(known)
                    groups.append(known)
                    lists += np.split(leaves, first[1:])
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(groups)), part.column(0).take(row), part.column(1).take(row), pa.array(lists, pa.list_(pa.int64()))], names=["grp", "cid", "v", "leaves"])

    asked = classes.join(queries.select("cid").distinct(), "cid", "left_semi").select("cid", "v").mapInArrow(lean(visit), "grp long, cid long, v array<double>, leaves array<long>")
    asked = stage(asked, "neighbours")
    numbers = spark.createDataFrame(pd.DataFrame({"leaf": np.arange(len(sizes)), "grp": group.value}))
    indexed = indexed.join(F.broadcast(numbers), "leaf")
    n = lambda df, name: df.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias(name))  # noqa: E731  one row for each group, at most as many as leaves
    blocks = F.broadcast(n(indexed, "vb").join(n(asked, "qb"), "grp"))
    own = lambda c, m: F.pmod(F.xxhash64(c), F.col(m))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1))
    left = asked.join(blocks, "grp").withColumn("q", own("cid", "qb")).withColumn("b", every("vb")).select("grp", "b", "q", "cid", "v", "leaves")
    right = indexed.join(blocks, "grp").withColumn("b", own("cid", "vb")).withColumn("q", every("qb")).select("grp", "b", "q", "cid", "v", "leaf")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"qcid": [], "cid": [], "score": []}).astype({"qcid": "int64", "cid": "int64", "score": "float64"})
        b = b.sort_values(["leaf", "cid"])
        x, ids, m = np.stack(b["v"].to_numpy()), b["cid"].to_numpy(), min(k + 1, len(b))
        known, first = np.unique(b["leaf"].to_numpy(), return_index=True)
        ranges = dict(zip(known.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(b)])))
        out = []
        for at in range(0, len(a), 256):
            part = a.iloc[at : at + 256]
            q = np.stack(part["v"].to_numpy())
            dots = np.full((len(q), len(x)), -np.inf)
            visited = np.concatenate(part["leaves"].to_numpy())
            who = np.repeat(np.arange(len(part)), part["leaves"].map(len))
            order = np.argsort(visited, kind="stable")
            for leaf, at_leaf in zip(*_runs(visited[order], who[order])):
                if leaf in ranges:
                    i, j = ranges[leaf]
                    dots[at_leaf, i:j] = q[at_leaf] @ x[i:j].T
            bar = np.partition(dots, len(ids) - m, 1)[:, len(ids) - m]
            bar = bar - 1e-9 * np.maximum(1, np.abs(bar))
            i, j = np.nonzero((dots >= bar[:, None]) & (dots > -np.inf))  # ties with the last one stay
            out.append(pd.DataFrame({"qcid": part["cid"].to_numpy()[i], "cid": ids[j], "score": (q[i] * x[j]).sum(1)}))
        found = pd.concat(out).sort_values(["qcid", "score", "cid"], ascending=[True, False, True])
        return found.groupby("qcid").head(m)

    found = left.groupBy("grp", "b", "q").cogroup(right.groupBy("grp", "b", "q")).applyInPandas(compare, "qcid long, cid long, score double")
    best = Window.partitionBy("qcid").orderBy(F.desc("score"), "cid")
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).select("qcid", "cid", "score")
    found = found.join(classes.select("cid", "ids"), "cid").select("qcid", "score", F.explode("ids").alias("vec_id"))
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("qcid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    # Each query's class has at most k + 1 rows left; its members differ only in which row is their own.
    lists = found.groupBy("qcid").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    joined = queries.join(lists, queries.cid == lists.qcid).select("query_id", F.slice(F.filter("near", lambda x: x.vec_id != F.col("query_id")), 1, k).alias("near"))
    return joined.select("query_id", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 20, lambda c: c % 20 == 0)
