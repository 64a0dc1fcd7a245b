"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import stored

#: Links of one file of a step, and files at least.
FILE_LINKS, FEWEST_FILES = 1_000_000, 8


def _star(neighbours: DataFrame) -> DataFrame:
    """Per node of ``u, v`` its least neighbour or itself, joined back to the links."""
    least = neighbours.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    return neighbours.join(least, "u")


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``links (a, b)``; the component is its least node.

    Large-star and small-star steps in turn, until the links do not change: each node
    hangs larger neighbours, then itself and smaller ones, on its least neighbour. Every
    step sums up before it shuffles and keeps at most the links it was given, however many a
    node has; state lives in tables. Links may repeat, point either way or to
    themselves; null ends are ignored. Without links the result is empty.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        high.alias("u"), low.alias("v")
    )
    edges = stored(edges.distinct(), "links")
    before, files = None, max(FEWEST_FILES, -(-edges.count() // FILE_LINKS))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        small = _star(large).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = stored(small.where("u <> v").distinct().coalesce(files), "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
