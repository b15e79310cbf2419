"""Connected components and representative mappings over links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import membership
from .runtime import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the links' (a, b) components; root is the smallest node.

    Alternating large-star and small-star steps until nothing changes: each round hangs nodes
    under smaller ones, so that the rounds grow with the logarithm of a component's width. Every
    round is written to the shared folder.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = written(small.distinct(), "edges")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def merged(mapping: DataFrame, links: DataFrame) -> DataFrame:
    """A representative mapping (node, root) after new links (a, b): only clusters that a link touches change.

    Nodes that the mapping lacks stand for themselves.
    """
    to = lambda name: mapping.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    ends = links.select("a", "b").join(to("a"), "a", "left").join(to("b"), "b", "left")
    ends = written(ends.select("a", "b", F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y")), "link-ends")
    moved = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnsRenamed({"node": "old", "root": "new"})
    nodes = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("x").alias("root")), F.struct(F.col("b").alias("node"), F.col("y").alias("root")))).alias("n")).select("n.*")
    every = mapping.select("node", "root").unionAll(nodes).distinct()
    return every.join(moved, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")).distinct()


def resolved(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(node, root) of nodes (node) by pointers (node, root) to what their nodes were joined to, followed to the end.

    A node without a pointer is its own root. Only pointers that a followed node may have are
    shuffled; the rounds are as many as the longest chain has pointers.
    """
    at = nodes.select("node", F.col("node").alias("root"))
    while True:
        ups = membership.split(parents.select(F.col("node").alias("root"), F.col("root").alias("up")), membership.of(at.select("root")), "root")
        at = written(at.join(ups, "root", "left").select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "followed")
        if not at.where("moved").limit(1).count():
            return at.select("node", "root")


def flattened(parents: DataFrame) -> DataFrame:
    """(node, root) of every node that has a pointer or is pointed to, by doubling the pointers' reach until all end at a root."""
    at = parents.select("node", "root")
    while True:
        ups = at.select(F.col("node").alias("root"), F.col("root").alias("up"))
        at = written(at.join(ups, "root", "left").select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "followed")
        if not at.where("moved").limit(1).count():
            return at.select("node", "root").unionAll(at.select(F.col("root").alias("node"), "root")).distinct()
        at = at.select("node", "root")
