"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraft.session import materialize


def _signature(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(u, v)``; the component is its smallest node.

    Alternates two steps until nothing changes: every node's larger neighbours are hung on its smallest
    neighbour, then its smaller ones. Minima are aggregated on the map side before they are joined back, and
    every step is a written table: a lost executor costs one step.
    The number of rounds grows with the logarithm of the longest chain.
    """
    pair = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    edges = materialize(pair.distinct(), "edges")
    before = _signature(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        hung = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = materialize(hung.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        low = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(low.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = _signature(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
