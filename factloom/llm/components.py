"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard
from .common import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of `edges`; component is its smallest reachable node.

    Contraction: every node points at the neighbour (or itself) that comes first in a
    pseudo-random order, edges move to what their ends point at, and this repeats until no edge
    is left. The random order makes any graph, long chains included, shrink by a constant
    factor a round, so there are O(log n) rounds; each is two hash joins and an aggregate that
    combines before its shuffle, and each is written to the shared folder. Self-links and
    repeated links are ignored; no edges give no rows. Null ends are dropped.
    """
    # xxhash64 of one bigint is a bijection, so hashed ids can stand for the nodes.
    pair = edges.select(F.col(src).cast("bigint").alias("s"), F.col(dst).cast("bigint").alias("d")).where("s is not null and d is not null")
    pair = materialize(pair, "cc-links")
    edges = materialize(
        pair.where("s <> d").select(F.xxhash64("s").alias("a"), F.xxhash64("d").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges"
    )
    labels = pair.select("s").union(pair.select("d")).distinct().select(F.col("s").alias("node"), F.xxhash64("s").alias("root"))
    while not edges.isEmpty():
        ends = edges.union(edges.select("b", "a"))
        parent = materialize(ends.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("low")).select("x", F.least("x", "low").alias("up")), "cc-parent")
        before = labels, edges
        labels = materialize(labels.join(parent, labels.root == parent.x, "left").select("node", F.coalesce("up", "root").alias("root")), "cc-labels")
        moved = edges.join(parent.select(F.col("x").alias("a"), F.col("up").alias("ua")), "a").select("b", "ua")
        moved = moved.join(parent.select(F.col("x").alias("b"), F.col("up").alias("ub")), "b").where("ua <> ub")
        edges = materialize(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "cc-edges")
        discard(parent, *before)
    labels = materialize(labels, "cc-labels")
    least = materialize(labels.groupBy("root").agg(F.min("node").alias("component")), "cc-least")
    return labels.join(least, "root").select("node", "component")
