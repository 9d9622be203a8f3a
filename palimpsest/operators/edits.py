"""Edits of the graph: child lists, orphans and restoring. Every operator edits many lists at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.scratch import Scratch

EDGE = ["parent_id", "child_index", "child_id"]


def insert(edges: DataFrame, edits: DataFrame) -> DataFrame:
    """Edges after inserting, per edit (parent_id, at, child_id), a child before position `at`. One edit for each parent."""
    moved = edges.join(edits.select("parent_id", "at"), "parent_id", "left").select("parent_id", F.when(F.col("child_index") >= F.col("at"), F.col("child_index") + 1).otherwise(F.col("child_index")).alias("child_index"), "child_id")
    return moved.unionByName(edits.select("parent_id", F.col("at").alias("child_index"), "child_id"))


def remove(edges: DataFrame, edits: DataFrame) -> DataFrame:
    """Edges after removing, per edit (parent_id, at), the child at a position; later ones move up."""
    held = edges.join(edits.select("parent_id", "at"), "parent_id", "left").where("at is null or child_index <> at")
    return held.select("parent_id", F.when(F.col("child_index") > F.col("at"), F.col("child_index") - 1).otherwise(F.col("child_index")).alias("child_index"), "child_id")


def replace(edges: DataFrame, edits: DataFrame) -> DataFrame:
    """Edges after putting, per edit (parent_id, at, child_id), another child at a position."""
    new = edits.select("parent_id", F.col("at").alias("child_index"), F.col("child_id").alias("new"))
    return edges.join(new, ["parent_id", "child_index"], "left").select("parent_id", "child_index", F.coalesce("new", "child_id").alias("child_id"))


def push(edges: DataFrame, edits: DataFrame) -> DataFrame:
    """Edges after appending, per edit (parent_id, child_id), a child at the end."""
    sizes = edges.groupBy("parent_id").agg((F.max("child_index") + 1).alias("child_index"))
    new = edits.join(sizes, "parent_id", "left").select("parent_id", F.coalesce("child_index", F.lit(0)).alias("child_index"), "child_id")
    return edges.select(*EDGE).unionByName(new.withColumn("child_index", F.col("child_index").cast(edges.schema["child_index"].dataType)))


def orphans(edges: DataFrame, swapped: DataFrame, replacement: DataFrame) -> DataFrame:
    """(id) of the nodes that go when the lists of `swapped` (id) are replaced by `replacement` (parent_id, child_index, child_id).

    A child goes if each of its parents is a swapped node or goes itself, and no
    replacement names it; so do its children, and so on. Each edge is looked at
    once, when its parent goes: a node goes when as many entries have gone as
    name it.
    """
    scratch = Scratch(edges.sparkSession, "orphans")
    pairs = scratch.put(edges.select("parent_id", "child_id"))
    kept = scratch.put(replacement.select(F.col("child_id").alias("id")).union(replacement.select("parent_id")).union(swapped.select("id")).distinct())
    entries = scratch.put(pairs.groupBy(F.col("child_id").alias("id")).agg(F.count("*").alias("n")).join(kept, "id", "left_anti"))
    new, lost, out = scratch.put(swapped.select("id").distinct()), None, None
    while not new.isEmpty():
        cut = pairs.join(new.select(F.col("id").alias("parent_id")), "parent_id").groupBy(F.col("child_id").alias("id")).agg(F.count("*").alias("cut"))
        cut = scratch.put(cut)
        lost = cut if lost is None else lost.unionByName(cut)
        all_cut = lost.join(cut.select("id"), "id", "left_semi").groupBy("id").agg(F.sum("cut").alias("cut"))
        new = scratch.put(all_cut.join(entries, "id").where("cut = n").select("id"))
        out = new if out is None else out.unionByName(new)
    return out if out is not None else swapped.select("id").where("false")


def swap(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and orphans after the nodes of `new_nodes` get the content and the child lists given there."""
    ids = new_nodes.select("id")
    lists = new_edges.join(ids.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    lost = orphans(edges, ids, lists)
    kept = nodes.join(ids, "id", "left_anti").join(lost, "id", "left_anti").unionByName(new_nodes)
    gone = ids.union(lost).select(F.col("id").alias("parent_id"))
    return kept, edges.join(gone, "parent_id", "left_anti").select(*EDGE).unionByName(new_edges.select(*EDGE)), lost


def restore(trash_nodes: DataFrame, trash_edges: DataFrame, nodes: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges to append so that roots (root) and the removed nodes below them are back; what isn't removed needs nothing."""
    from palimpsest.operators.graph import descendants

    lost = trash_nodes.join(nodes.select("id"), "id", "left_anti")
    wanted = roots.join(lost.select(F.col("id").alias("root")), "root", "left_semi")
    inner = trash_edges.join(lost.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    ids = descendants(inner, wanted).select(F.col("node").alias("id")).distinct()
    return lost.join(ids, "id", "left_semi"), inner.join(ids.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
