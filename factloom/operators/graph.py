"""References as a labelled graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from ..types import REF
from .live import live_set


def edges(datoms: DataFrame, attributes: list[str] | None = None) -> DataFrame:
    """(src, attr, dst) of LIVE references; with `attributes`, of those only."""
    refs = datoms.where(F.col("v_tag") == REF)
    if attributes is not None:
        refs = refs.where(F.col("a").isin(attributes))
    return live_set(refs).select(F.col("e").alias("src"), F.col("a").alias("attr"), F.col("v_bin").alias("dst"))


def neighbors(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that leave the nodes (id)."""
    return graph.join(nodes.select(F.col("id").alias("src")).distinct(), "src", "left_semi")


def reverse_neighbors(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that reach the nodes (id)."""
    return graph.join(nodes.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "attr", "dst")


def degree_stats(graph: DataFrame) -> DataFrame:
    """One row: edges, and entities with edges out and in."""
    return graph.agg(F.count("*").alias("n_edges"), F.count_distinct("src").alias("n_sources"), F.count_distinct("dst").alias("n_targets"))


def k_hop(graph: DataFrame, nodes: DataFrame, k: int, attributes: list[str] | None = None) -> DataFrame:
    """(start, node, hops): nodes first reached from each start (id) in at most k steps."""
    steps = graph if attributes is None else graph.where(F.col("attr").isin(attributes))
    steps = steps.select("src", "dst").distinct()
    if k > 1:  # read once a hop
        steps = materialize(steps, "graph-steps")
    front = nodes.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct().withColumn("hops", F.lit(0))
    seen = front
    for hop in range(1, k + 1):
        nxt = front.join(steps, front.node == steps.src).select("start", F.col("dst").alias("node")).distinct()
        front = nxt.join(seen, ["start", "node"], "left_anti").withColumn("hops", F.lit(hop))
        if k > 3:
            front = materialize(front, "graph-front")
        seen = seen.unionByName(front)
    return seen.where("hops > 0")


def reachable(graph: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(start, node): everything reached in one step or more; ends on cyclic graphs as well. Without `nodes` all may start.

    What a node reaches is its first steps and what these reach. So while the nodes stepped to get fewer, by
    half at least, only they go on as starts, each once however many starts share it; then what is reached is
    put together from the last level back. Starts with one first step can't meet a node twice there, and only
    the others' pairs are dealt to be made distinct. Where nodes don't get fewer, starts go on in rounds.
    """
    steps = materialize(graph.select("src", "dst"), "graph-steps")
    levels, before = [], None
    while True:
        first = steps.where("src IS NOT NULL") if nodes is None else steps.join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
        first = first.distinct().withColumn("n", F.count("*").over(Window.partitionBy("src")))
        first = materialize(first, "graph-first")
        heads = materialize(first.select(F.col("dst").alias("id")).distinct(), "graph-heads")
        n = heads.count()
        if not n or 2 * n > (first.count() if before is None else before):
            found = _rounds(steps, first.select(F.col("src").alias("start"), F.col("dst").alias("node"))) if n else first.select(F.col("src").alias("start"), F.col("dst").alias("node"))
            break
        levels.append((first, heads))
        nodes, before = heads, n
    for first, heads in reversed(levels):
        # each head and what it reaches; a head on a cycle reaches itself too
        ahead = found.where(~F.col("start").eqNullSafe(F.col("node"))).select(F.col("start").alias("_head"), "node").unionByName(heads.select(F.col("id").alias("_head"), F.col("id").alias("node")))
        ahead = materialize(ahead, "graph-ahead")  # of the nodes stepped to, not of the starts

        def pairs(rows: DataFrame, ahead: DataFrame = ahead) -> DataFrame:
            return rows.join(ahead, rows.dst.eqNullSafe(ahead["_head"])).select(F.col("src").alias("start"), "node")

        found, several = pairs(first.where("n = 1")), first.where("n > 1")
        if not several.isEmpty():
            found = found.unionByName(pairs(several).distinct())
    return found


def _rounds(steps: DataFrame, first: DataFrame) -> DataFrame:
    """(start, node) of everything reached, from the pairs of the first step: each round follows last round's new pairs."""
    front = seen = first
    while True:
        nxt = front.join(steps, front.node == steps.src).select("start", F.col("dst").alias("node")).distinct()
        front = materialize(nxt.join(seen, ["start", "node"], "left_anti"), "graph-front")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
