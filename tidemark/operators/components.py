"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.stash import stash

#: At most so many edges are folded by one task.
FEW_EDGES = 200_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = _both_ways(edges)
    low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
    return both.where("b > a").join(low.hint("merge"), F.col("a") == F.col("n")).select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("s"))
    low = down.groupBy(F.col("n").alias("k")).agg(F.min("s").alias("m"))
    tied = down.join(low.hint("merge"), F.col("n") == F.col("k"))
    pairs = tied.select(F.col("m").alias("a"), F.col("s").alias("b")).unionByName(low.select(F.col("m").alias("a"), F.col("k").alias("b")))
    return pairs.where("a <> b").distinct()


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, sorted, and the smallest node that each is connected with: both ends' roots are hooked to the smaller, and
    pointers are halved, until nothing moves."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right, root = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        for side in (root[left], root[right], left, right):
            np.minimum.at(new, side, low)
        new = new[new]
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _in_one_task(edges: DataFrame) -> DataFrame:
    """node, root of few edges, all read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.column("a").to_numpy(zero_copy_only=False), x.column("b").to_numpy(zero_copy_only=False)) for x in batches]
        if parts:
            found = smallest(*(np.concatenate(side) for side in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """node, root: for every node of the undirected edges (a, b; long numbers) the smallest node it is connected with.

    Once counted, at most `few` edges are folded by one task, 16 bytes each, instead of by rounds of small jobs. More of them go
    another way, which alternates large-star and small-star steps until the edges are stars around their smallest nodes; the number of rounds grows with the
    logarithm of the longest path. Each round is written to the shared folder. The groups are only reduced by min before
    anything travels; the join that ties a node's neighbours to that minimum has a row for each of them, and where a node has very many, it
    is left to adaptive execution to split them. Nothing is broadcast: files of stars are small for the rows they hold. Self-loops and repeated
    edges are ignored. Only two counts reach the driver.
    """
    now = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if now.limit(few + 1).count() <= few:
        return stash(_in_one_task(now), "components")
    while True:
        # A forest of stars: no node is both a centre and a leaf, and every leaf has one centre.
        leaves = now.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        broken = leaves.where("n > 1").select("b").unionByName(leaves.join(now.select(F.col("a").alias("c")).hint("merge"), F.col("b") == F.col("c"), "left_semi").select("b"))
        if broken.isEmpty():
            break
        now = stash(_small_star(_large_star(now)), "edges")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
