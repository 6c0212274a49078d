"""Connected components by alternating large-star and small-star steps.

A round is some sixteen stages, whatever the size of the table. So as soon as the edges are no more
than fit in one usual partition, one task finds the components of what is left; larger tables go
through rounds until they are, or until nothing changes. Both give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldlake.llm.common import materialise, release_memory

#: Edges up to which a step's table of smallest neighbours (16 bytes a node) is broadcast.
BROADCAST_EDGES = 300_000
#: Edges (16 bytes each) up to which one task finds the components.
LOCAL_EDGES = 1_000_000


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges, sorted, and the smallest node of each one's component."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        # edges between two trees: the larger root goes under the smallest that it meets
        u, v = root[u], root[v]
        apart = u != v
        if not apart.any():
            return nodes, nodes[root]
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(root, above := root[root]):
            root = above


def _local_components(edges: DataFrame) -> DataFrame:
    """The components of so few edges that one task holds them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches]
        if held:
            node, component = smallest_reachable(*(np.concatenate(c) for c in zip(*held)))
            yield pd.DataFrame({"node": node, "component": component})
            release_memory()

    return materialise(edges.repartition(1).mapInPandas(run, "node long, component long"), "components")


def _with_smallest(edges: DataFrame, smallest: DataFrame, n_edges: int) -> DataFrame:
    if n_edges <= BROADCAST_EDGES:
        return edges.join(F.broadcast(smallest), "u")
    # written, so that both join sides are plain exchanges and a hub's rows can be split
    return edges.join(materialise(smallest, "smallest"), "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of ``edges``, with long columns u and v.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest path,
    and end early once at most LOCAL_EDGES edges are left.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    edges = materialise(edges.distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
        n = state[0]
        if n <= LOCAL_EDGES:
            return _local_components(edges)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = _with_smallest(both, smallest, n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        if n > BROADCAST_EDGES:
            large = materialise(large, "large")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_smallest(large, smallest, n).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(smallest.withColumnRenamed("m", "v")).distinct(), "edges")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
