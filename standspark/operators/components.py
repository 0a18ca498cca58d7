"""Connected components over a table of links, without gathering any node's neighbours."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import keep

#: Links that a task contracts at once, and that one task may finish; a link takes some 200 bytes there.
HELD_LINKS, FINISH_LINKS = 1 << 18, 1 << 19


def _forest(links: DataFrame, held: int | None) -> DataFrame:
    """(u, v): each task's links as stars around the least node of what they join; at most about ``held`` at once."""

    def run(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        def stars():
            pairs = [(x, r) for x in list(root) if (r := find(x)) != x]
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
            if held is not None and len(root) > held:
                yield stars()
        yield stars()

    return links.mapInArrow(run, "u long, v long")


def connected(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the links (a, b); nodes without links are absent.

    Each task contracts its own links first.  What is left is finished by one task if it has at most
    FINISH_LINKS links; else by large-star and small-star rounds of grouped minima, each written to the shared
    folder, so that plans stay short and survive lost executors.  Rounds grow with the logarithm of the
    diameter.
    """
    own = links.where("a != b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = keep(_forest(own, HELD_LINKS))
    if edges.count() <= FINISH_LINKS:
        return _named(keep(_forest(edges.coalesce(1), None)))
    edges = keep(edges.distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return _named(edges)


def _named(edges: DataFrame) -> DataFrame:
    """Both ends of stars (u, v) with their component."""
    own = edges.groupBy("u").agg(F.min("v").alias("component"))
    return keep(own.select(F.col("u").alias("node"), "component").unionByName(own.select(F.col("component").alias("node"), "component").distinct()))


def patches(nodes: DataFrame, links: DataFrame, cap: int | None = None) -> DataFrame:
    """Every node with its component and the component's size (at most ``cap``)."""
    named = nodes.join(connected(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    size = named.groupBy("component").agg((F.least(F.count("*"), F.lit(cap)) if cap else F.count("*")).alias("size"))
    return named.join(size, "component")


def kept_land(nodes: DataFrame, links: DataFrame, min_pixels: int) -> DataFrame:
    """Nodes of patches with at least so many pixels."""
    return patches(nodes, links).where(F.col("size") >= min_pixels)
