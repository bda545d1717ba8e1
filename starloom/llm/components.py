"""Connected components: trees within tasks, and alternating large-star and small-star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import discard, materialise

#: Links that one task contracts at a time; no more than that are settled in one task.
PART = 1 << 18


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) of the nodes that aren't the smallest."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while not np.array_equal(root, up := root[root]):
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Links (u, v), u > v, that connect the same nodes: in each task every node is linked to the smallest it hangs together with."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = v = np.empty(0, np.int64)
        held, size = [], 0
        for batch in chain_end(batches):
            if batch is not None:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                size += len(batch)
            if held and (batch is None or size > max(PART, len(u))):
                u, v = _roots(np.concatenate([u, *(x for x, _ in held)]), np.concatenate([v, *(x for _, x in held)]))
                held, size = [], 0
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def chain_end(batches):
        yield from batches
        yield None

    return edges.select("u", "v").mapInArrow(trees, "u long, v long")


def _nearest(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each u; a hot u is combined before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u moves to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _nearest(both).select("u", F.least("u", "least").alias("least"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its neighbours below it move to the smallest of them. Edges come with u > v."""
    least = _nearest(edges)
    moved = edges.join(least, "u").where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).where("u != v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node that a link names; links are rows (a, b) of longs, component is the smallest node.

    Self-links and repeated links do no harm, links with a null end are left out, and no links give no rows. Each task first
    reduces its links to trees. Where more than PART links are left, rounds follow, of two star operations and trees again,
    written to the shared folder; rounds grow with the logarithm of a component's size. Hot nodes are pre-aggregated, and
    nothing is collected but a count and a checksum.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = materialise(_contracted(links.where("a is not null and b is not null and a != b").select(a.alias("u"), b.alias("v"))), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, few = state, state[0] <= PART
        following = _contracted(edges.coalesce(1)) if few else _contracted(_small_star(_large_star(edges)))
        following = materialise(following, "edges")
        discard(edges)
        edges = following
        if few:  # one task has seen them all
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
