"""Connected components of a graph of any size, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcurate.plans.scratch import materialize
from textcurate.plans.skew import join_on_unique


def _stars(edges: DataFrame, count: int) -> DataFrame:
    """One large-star and one small-star step; all ``count`` edges go from a larger node ``u`` to a smaller one ``v``.

    Minima are combined map-side. A hub, a node of very many edges, takes its minimum to where they lie.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = join_on_unique(both, least, "u", total=2 * count).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = join_on_unique(large, least, "u", total=2 * count).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return small.select("e.u", "e.v").filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for all nodes of ``edges (u, v)``, longs; a component is named by its smallest node.

    Loops and repeated edges are harmless. Every step is a written table, so a lost executor costs part of one step.
    """
    directed = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    mark = None
    while True:
        directed = materialize(directed, "stars")
        found = directed.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if found == mark:
            break
        mark = found
        directed = _stars(directed, found[0])
    roots = directed.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return directed.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
