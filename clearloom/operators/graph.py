"""Graphs as tables of edges: connected components, and leaders in order of key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, a: str = "_a", b: str = "_b") -> DataFrame:
    """node, component (its smallest node) of every node with an edge. Alternates large and small stars, which halve distances, so rounds grow with the logarithm of a component's width; each round is checkpointed. Neighbours are reduced by partial aggregates, so a node with very many is no hot group.

    Self-loops and repeated edges change nothing; null ends meet nothing.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct().checkpoint()

    def stars(e: DataFrame, both: bool) -> DataFrame:
        """Every neighbour (both: the larger ones) of a node is tied to the least of the node and its neighbours (both: all of them, else the smaller ones)."""
        around = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else e
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        tied = around.join(least, "u")
        tied = tied.filter(F.col("v") > F.col("u")) if both else tied.unionByName(least.select("u", F.col("u").alias("v"), "m"))
        return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()

    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before, rounds = None, 0
    while before != (before := mark(now)):
        now = stars(stars(now, True), False).checkpoint()
        rounds += 1
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def leaders(edges: DataFrame) -> DataFrame:
    """node, lead of every node of the edges (_a < _b): in order of key, a node leads unless an earlier neighbour leads.

    Edges are sorted by component and node over all partitions. A task settles its nodes in that order, so a component within one partition takes one round however long its chains are; one that goes over k partitions takes k rounds at most. Only the current component's nodes are kept in a task.
    """
    of = components(edges)
    sorted_edges = edges.join(of.withColumnRenamed("node", "_b"), "_b")
    roots = edges.select(F.col("_a").alias("node")).join(edges.select(F.col("_b").alias("node")), "node", "left_anti").distinct().withColumn("lead", F.lit(True))
    state = roots.checkpoint()
    kind = edges.schema["_a"].dataType.simpleString()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (component, _b, _a, a_lead) in order; a node's rows are in one partition."""
        component, told, node, lead, open_, seen = None, {}, None, False, False, False
        for batch in batches:
            nodes, leads = [], []

            def end() -> None:
                if seen:
                    value = False if lead else None if open_ else True
                    told[node] = value
                    nodes.append(node)
                    leads.append(value)

            for c, b, a, known in zip(*(x.to_pylist() for x in batch.columns)):
                if not seen or b != node or c != component:
                    end()
                    if c != component:
                        component, told = c, {}
                    node, lead, open_, seen = b, False, False, True
                value = known if known is not None else told.get(a)
                lead, open_ = lead or value is True, open_ or value is None
            yield pa.RecordBatch.from_arrays([pa.array(nodes, batch.schema.field(1).type), pa.array(leads, pa.bool_())], names=["node", "lead"])
        if seen:
            value = False if lead else None if open_ else True
            yield pa.RecordBatch.from_arrays([pa.array([node], batch.schema.field(1).type), pa.array([value], pa.bool_())], names=["node", "lead"])

    while True:
        known = state.filter(F.col("lead").isNotNull()).select(F.col("node").alias("_a"), F.col("lead").alias("a_lead"))
        rows = sorted_edges.join(known, "_a", "left").select("component", "_b", "_a", "a_lead")
        found = rows.repartitionByRange("component", "_b").sortWithinPartitions("component", "_b", "_a").mapInArrow(settle, f"node {kind}, lead boolean")
        state = roots.unionByName(found).checkpoint()
        if state.filter(F.col("lead").isNull()).isEmpty():
            return state
