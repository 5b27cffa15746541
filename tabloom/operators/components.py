"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import cut_lineage, is_small


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable) of the undirected edges (u, v): smaller roots are hooked on, then paths are halved."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u):]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (root[root] != root).any():
            root = root[root]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[np.zeros(0, np.int64)] * 2] + [[batch.column(c).to_numpy() for c in ("u", "v")] for batch in batches]
    nodes, least = smallest_reachable(*(np.concatenate(x) for x in zip(*parts)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["node", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 60, single_task_rows: int = 0) -> DataFrame:
    """(node, component = smallest node) for all nodes of the undirected edges (u, v) of any type that has an order.

    Every round is two aggregates and two equi-joins on a table with one row per node, so a node
    with very many edges is handled by the skew join; rounds grow with the logarithm of the
    diameter. Rounds are checkpointed. Up to ``single_task_rows`` edges of whole numbers (their bound; 0: none) are
    united in one task, which spares a caller with many small tables the rounds.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if single_task_rows > 0:
        edges = edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"))
        edges = cut_lineage(edges)
        if is_small(edges, single_task_rows):
            return edges.coalesce(1).mapInArrow(_united, "node bigint, component bigint")
    edges = cut_lineage(edges.distinct())
    state = _state(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_low.select("u", F.col("m").alias("v")))
        loops = edges.where("u = v")
        edges = small.unionByName(loops)
        edges = cut_lineage(edges.distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))))
    return nodes.groupBy("node").agg(F.min("component").alias("component"))
