"""Connected components as DataFrame jobs: alternating stars over an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


#: So many edges are finished by one task (16 MB); above it stars alternate until no more are left.
ALONE = 1 << 20


def components(edges: DataFrame, alone: int = ALONE) -> DataFrame:
    """(node, component) for every node of edges (u, v); a component is named by its least node.

    Edges that fit one task, at once or after some rounds, are finished there; the names are the same.

    Large-star links a node's larger neighbours to the least node around it, small-star its
    smaller ones; repeated, this ends in stars after about log(n) rounds. Each half-round is written
    to the shared folder. A node's least neighbour is summed in two steps and written before it is
    joined to the node's edges, so both sides of the join are plain tables: Spark sends the small one
    to all tasks where its size allows, and else splits a hub's edges over tasks (adaptive skew joins).
    """
    now = stored(_undirected(edges))
    while True:
        if now.count() <= alone:
            return now.repartition(1).mapInArrow(_named, "node long, component long")
        if _stars(now):
            break
        now = _star(_star(now, large=True), large=False)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of all nodes 0 .. n - 1 that each reaches over edges a - b."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        on = x != y
        if not on.any():
            return root
        np.minimum.at(root, np.maximum(x[on], y[on]), np.minimum(x[on], y[on]))
        while (root != root[root]).any():
            root = root[root]


def _named(batches):
    parts = [b for b in batches if b.num_rows]
    if parts:
        both = pa.Table.from_batches(parts)
        u, v = both["u"].to_numpy(), both["v"].to_numpy()
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = least_reached(at[: len(u)], at[len(u) :], len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, or only edges from larger ones."""
    ends = F.array(*[F.struct(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down")) for c, up in (("u", 1), ("v", 0))])
    one = edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return one.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def _undirected(edges: DataFrame) -> DataFrame:
    """Distinct edges, the larger end first."""
    return edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = stored(near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")))
    linked = near.join(least, near["u"] == least["_u"])
    moved = linked.where("v > u") if large else linked
    return stored(_undirected(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))))
