"""Connected components by alternating large-star and small-star steps, all on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame, scratch: Scratch, u: str = "u", v: str = "v") -> DataFrame:
    """node, component (the smallest node reachable) for every node that has an edge.

    edges: pairs of longs in any direction; loops and repeats do no harm; no edges give no rows. A node's neighbours are never gathered: each step is a minimum for each node and a
    join back, which the engine can split where a node has very many edges. Both steps together shorten paths
    logarithmically, and each result is a table, so lineage stays short.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    e = scratch.write(e, "edges")
    before = _state(e)
    while before[0]:
        # Large star: larger neighbours of a node move to the least of its neighbours and itself.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["c"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours move to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(least, large["u"] == least["c"]).select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("c"))
        small = small.select("u", "v").unionByName(small.select(F.col("c").alias("u"), "v")).where("u <> v").distinct()
        small = scratch.write(small, "edges")
        scratch.drop_table(e)
        e, after = small, _state(small)
        if after == before:
            break
        before = after
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
