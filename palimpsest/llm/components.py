"""Distributed connected components with DataFrame operations only.

Alternating large-star and small-star rounds (Kiveris et al., 2014): every round
hangs each node's larger neighbours, then its smaller ones, on the smallest node
seen, until all components are stars. A hub's neighbours meet only in partial
minimums and in joins that can be split, never in one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.scratch import Scratch


def _star(edges: DataFrame, scratch: Scratch, name: str, large: bool) -> DataFrame:
    """edges (u, v), u > v, turned into edges from nodes to the smallest of their neighbours and themselves."""
    sides = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = scratch.put(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
    if large:
        found = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        found = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    out = scratch.put(found.where("u <> v").distinct(), name)
    scratch.drop(f"{name}-least")
    return out


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of an edge.

    `edges` has two columns of one orderable type; nulls and loops are ignored,
    nodes without edges don't appear, and no edge gives an empty table.
    """
    a, b = edges.columns
    held = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    held = scratch.put(held, f"{name}-0")
    tally = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    before, k = tally(held), 0
    while before["n"]:
        wide = _star(held, scratch, f"{name}-{k}a", True)
        scratch.drop(f"{name}-{k}")
        k += 1
        held = _star(wide, scratch, f"{name}-{k}", False)
        scratch.drop(f"{name}-{k - 1}a")
        now = tally(held)
        if now == before:
            break
        before = now
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
