"""Traversals of the document graph.

nodes (id, kind, text, layout, style_kind, styles), edges (parent_id, child_index,
child_id). A node may have many parents and the graph may have cycles. Traversals
are semi-naive: each round joins only what is new with the edges and is written
to the shared folder, so the number of rounds is the depth, not the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import is_blank
from palimpsest.plans.scratch import Scratch

#: Rounds of following styled wrappers; chains of wrappers that are longer, or loop, count as blocks.
MOST_JUMPS = 32


def _empty(df: DataFrame) -> bool:
    return df.isEmpty()


def parents(edges: DataFrame) -> DataFrame:
    """(child_id, n_parents, n_distinct_parents): entries in parents' child lists, and parents."""
    return edges.groupBy("child_id").agg(F.count("*").alias("n_parents"), F.countDistinct("parent_id").alias("n_distinct_parents"))


def mismatches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind, n_children) of the nodes that have a number of children which their kind can't have."""
    sizes = edges.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n"))
    held = nodes.join(sizes, "id", "left").select("id", "kind", F.coalesce("n", F.lit(0)).alias("n_children"))
    return held.where(((F.col("kind") == "Text") & (F.col("n_children") > 0)) | ((F.col("kind") == "Styled") & (F.col("n_children") != 1)))


def span_flags(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, is_span): texts and chains are spans, pages and block styles are blocks, a span style is what its child is.

    Wrappers are resolved by pointer jumping, so a chain of n of them takes log n rounds.
    """
    scratch = Scratch(nodes.sparkSession, "spans")
    own = F.when(F.col("kind") == "Text", True).when(F.col("kind") == "List", F.col("layout") == "Chain").when(F.col("style_kind") == "Block", False)
    first = edges.where("child_index = 0").select(F.col("parent_id").alias("id"), F.col("child_id").alias("next"))
    held = scratch.put(nodes.select("id", own.alias("is_span")).join(first, "id", "left").withColumn("next", F.when(F.col("is_span").isNull(), F.col("next"))))
    for _ in range(MOST_JUMPS):
        if _empty(held.where("is_span is null and next is not null")):
            break
        ahead = held.select(F.col("id").alias("next"), F.col("is_span").alias("seen"), F.col("next").alias("further"))
        held = scratch.put(held.join(ahead, "next", "left").select("id", F.coalesce("is_span", "seen").alias("is_span"), F.when(F.coalesce("is_span", "seen").isNull(), F.col("further")).alias("next")))
    return held.select("id", F.coalesce("is_span", F.lit(False)).alias("is_span"))


def linked(edges: DataFrame, spans: DataFrame) -> DataFrame:
    """Edges with is_link: whether the parent, a span, shows the child, a block, as a link."""
    child = spans.select(F.col("id").alias("child_id"), F.col("is_span").alias("c"))
    parent = spans.select(F.col("id").alias("parent_id"), F.col("is_span").alias("p"))
    return edges.join(child, "child_id").join(parent, "parent_id").select("parent_id", "child_index", "child_id", (~F.col("c") & F.col("p")).alias("is_link"))


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth) for roots (root): all that can be reached, the root included, with the least number of steps."""
    scratch = Scratch(edges.sparkSession, "descendants")
    edges = scratch.put(edges.select(F.col("parent_id").alias("node"), "child_id"))  # made once, not once a round
    new = scratch.put(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    seen = new
    while not _empty(new):
        step = new.join(edges, "node").select("root", F.col("child_id").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        new = scratch.put(step.join(seen, ["root", "node"], "left_anti"))
        seen = seen.unionByName(new)
    return seen


def descendants_until_links(linked_edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): as `descendants`, but a node shown as a link isn't entered, unless another way enters it."""
    scratch = Scratch(linked_edges.sparkSession, "until-links")
    edges = scratch.put(linked_edges.select(F.col("parent_id").alias("node"), "child_id", "is_link"))
    entered = new = scratch.put(roots.select("root", F.col("root").alias("node")).distinct())
    shown = entered
    while not _empty(new):
        step = scratch.put(new.join(edges, "node").groupBy("root", F.col("child_id").alias("node")).agg(F.bool_and("is_link").alias("only_linked")))
        shown = shown.unionByName(step.select("root", "node"))
        new = scratch.put(step.where("not only_linked").select("root", "node").join(entered, ["root", "node"], "left_anti"))
        entered = entered.unionByName(new)
    return shown.distinct()


def ancestor_path(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, depth, ancestor, child_index) for starts (node): parents climbed while there is exactly one entry; depth 1 is the nearest.

    Stops where a parent would repeat. With `linked` edges it also stops where
    the parent shows the child as a link.
    """
    scratch = Scratch(edges.sparkSession, "ancestors")
    single = edges.groupBy("child_id").agg(F.count("*").alias("n"), F.first("parent_id").alias("parent_id"), F.first("child_index").alias("child_index"), *([F.first("is_link").alias("is_link")] if "is_link" in edges.columns else [])).where("n = 1")
    single = scratch.put((single.where("not is_link") if "is_link" in edges.columns else single).select(F.col("child_id").alias("at"), F.col("parent_id").alias("ancestor"), "child_index"))
    new = scratch.put(starts.select("node", F.col("node").alias("at"), F.lit(0).alias("depth")))
    out = None
    while not _empty(new):
        step = new.join(single, "at").select("node", (F.col("depth") + 1).alias("depth"), "ancestor", "child_index")
        step = step if out is None else step.join(out.select("node", "ancestor", "child_index"), ["node", "ancestor", "child_index"], "left_anti")
        step = scratch.put(step.select("node", "depth", "ancestor", "child_index"))
        out = step if out is None else out.unionByName(step)
        new = step.select("node", F.col("ancestor").alias("at"), "depth")
    return out


def not_blank(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of the nodes from which a text that isn't blank can be reached, found upwards in one pass over the graph."""
    scratch = Scratch(nodes.sparkSession, "blank")
    up = scratch.put(edges.select(F.col("child_id").alias("id"), "parent_id"))
    seen = new = scratch.put(nodes.where((F.col("kind") == "Text") & ~is_blank(F.col("text"))).select("id"))
    while not _empty(new):
        new = scratch.put(new.join(up, "id").select(F.col("parent_id").alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = seen.unionByName(new)
    return seen


def blank_flags(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, is_blank)."""
    full = not_blank(nodes, edges).withColumn("full", F.lit(True))
    return nodes.select("id").join(full, "id", "left").select("id", F.col("full").isNull().alias("is_blank"))


def revisits(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, revisits): whether going down from the root meets some node twice, by a cycle, a diamond or a repeated child.

    A root whose way has met a node twice isn't followed any further, so what is
    kept per root is a tree.
    """
    scratch = Scratch(edges.sparkSession, "revisits")
    down = scratch.put(edges.select(F.col("parent_id").alias("node"), "child_id"))
    new = scratch.put(roots.select("root", F.col("root").alias("node")).distinct())
    starts, seen, done = new.select("root"), new, None
    while not _empty(new):
        step = new.join(down, "node").groupBy("root", F.col("child_id").alias("node")).agg(F.count("*").alias("n"))
        met = step.join(seen.withColumn("old", F.lit(True)), ["root", "node"], "left")
        step = scratch.put(met.select("root", "node", ((F.col("n") > 1) | F.col("old").isNotNull()).alias("twice")))
        hit = scratch.put(step.where("twice").select("root").distinct())
        done = hit if done is None else done.unionByName(hit)
        new = step.join(hit, "root", "left_anti").select("root", "node")
        seen = seen.unionByName(new)
    hits = starts.where("false") if done is None else done
    return starts.join(hits.distinct().withColumn("r", F.lit(True)), "root", "left").select("root", F.col("r").isNotNull().alias("revisits"))


def cyclic(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, cyclic): whether a true cycle can be reached: some node below the root that is its own descendant.

    Nodes without children are taken away round by round; what stays are cycles and what leads to them.
    """
    scratch = Scratch(edges.sparkSession, "cyclic")
    held = scratch.put(edges.select("parent_id", "child_id").distinct())
    n = held.count()
    while n:
        held = scratch.put(held.join(held.select(F.col("parent_id").alias("child_id")).distinct(), "child_id", "left_semi").select("parent_id", "child_id"))
        n, before = held.count(), n
        if n == before:
            break
    return roots.join(held.select(F.col("parent_id").alias("root")).distinct().withColumn("c", F.lit(True)), "root", "left").select("root", F.col("c").isNotNull().alias("cyclic"))


def shared(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, shared): whether some node below the root, other than itself, has more than one parent entry.

    One pass upwards over the graph, whatever the number of roots: nodes with
    several parents are told to all that is above them, and as two of them say
    all that can be asked, no node keeps or passes on more.
    """
    scratch = Scratch(edges.sparkSession, "shared")
    up = scratch.put(edges.select(F.col("child_id").alias("node"), "parent_id"))
    many = up.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    two = lambda df: df.groupBy("node").agg(F.array_distinct(F.array(F.min("w"), F.max("w"))).alias("ws"))
    told = scratch.put(two(up.join(many, "node").select(F.col("parent_id").alias("node"), F.col("node").alias("w"))))
    new, rounds = told, [told]
    while not _empty(new):
        asked = two(new.select("node", F.explode("ws").alias("w")).join(up, "node").select(F.col("parent_id").alias("node"), "w"))
        had = rounds[0] if len(rounds) == 1 else _union(rounds)
        had = had.groupBy("node").agg(F.flatten(F.collect_list("ws")).alias("had"))  # two at most
        fresh = F.when(F.col("had").isNull(), F.col("ws")).otherwise(F.slice(F.array_except("ws", "had"), 1, 1))
        able = F.col("had").isNull() | (F.size("had") < 2)
        new = scratch.put(asked.join(had, "node", "left").where(able).select("node", fresh.alias("ws")).where(F.size("ws") > 0))
        rounds.append(new)
    said = _union(rounds).select(F.col("node").alias("root"), F.explode("ws").alias("w")).where("w <> root").select("root").distinct()
    return roots.select("root").distinct().join(said.withColumn("s", F.lit(True)), "root", "left").select("root", F.col("s").isNotNull().alias("shared"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edge_leaves(nodes: DataFrame, edges: DataFrame, links: DataFrame, full: DataFrame, before: bool, scratch: Scratch) -> DataFrame:
    """(parent_id, child_index, leaf): for every entry of a child list, what it offers as a neighbour: itself, or its nearest inner leaf.

    Solved from the leaves up; entries on cycles that never resolve offer nothing.
    """
    aside = (F.col("style_kind") == "Block") & F.array_contains("styles", "Aside")
    info = nodes.select(F.col("id").alias("child_id"), F.coalesce(F.col("kind") == "Text", F.lit(False)).alias("atom"), F.coalesce(aside, F.lit(False)).alias("aside"))
    full = full.select(F.col("id").alias("child_id"), F.lit(True).alias("full"))
    entries = links.join(info, "child_id").join(full, "child_id", "left").withColumn("full", F.coalesce("full", F.lit(False)))
    offer = F.when(F.col("aside") | ~F.col("full"), F.lit("")).when(F.col("is_link") | F.col("atom"), F.col("child_id"))
    entries = scratch.put(entries.select("parent_id", "child_index", "child_id", offer.alias("leaf")))  # '' offers nothing, null isn't known yet
    done = scratch.put(entries.where("leaf is not null").select("parent_id", "child_index", "leaf"))
    open_ = scratch.put(entries.where("leaf is null").select("parent_id", "child_index", "child_id"))
    far = F.max if before else F.min
    sizes = edges.groupBy("parent_id").agg(F.count("*").alias("size"))
    while not _empty(open_):
        # a list is solved once its entries are known from the near end up to the first that offers something
        best = done.where("leaf <> ''").groupBy("parent_id").agg(far("child_index").alias("at"))
        span = (F.col("child_index") > F.col("at")) if before else (F.col("child_index") < F.col("at"))
        waits = open_.join(best, "parent_id", "left").where(F.col("at").isNull() | span).select("parent_id").distinct()
        solved = sizes.join(waits, "parent_id", "left_anti").join(best, "parent_id", "left").join(done.withColumnRenamed("child_index", "at"), ["parent_id", "at"], "left").select(F.col("parent_id").alias("child_id"), F.coalesce("leaf", F.lit("")).alias("leaf"))
        now = scratch.put(open_.join(solved, "child_id", "left"))
        if _empty(now.where("leaf is not null")):
            break
        done = scratch.put(done.unionByName(now.where("leaf is not null").select("parent_id", "child_index", "leaf")))
        open_ = now.where("leaf is null").select("parent_id", "child_index", "child_id")
    return done.where("leaf <> ''")


def siblings(nodes: DataFrame, edges: DataFrame, before: bool, links: DataFrame | None = None, full: DataFrame | None = None) -> DataFrame:
    """(id, sibling): the nearest displayed neighbours of every node that isn't blank, before or after it, one for each parent entry that has one.

    Blank nodes and asides are skipped; a node shown as a link is a neighbour as a
    whole. Where a parent has none, its own parents are asked, unless the node
    is shown as a link there. Climbing ends where an entry would repeat. Tables
    of `linked` and `not_blank` that are there already may be given.
    """
    scratch = Scratch(nodes.sparkSession, "siblings")
    links = scratch.put(linked(edges, span_flags(nodes, edges))) if links is None else links
    full = scratch.put(not_blank(nodes, edges)) if full is None else full
    leaves = _edge_leaves(nodes, edges, links, full, before, scratch)
    offered = links.join(leaves, ["parent_id", "child_index"], "left")
    side = Window.partitionBy("parent_id").orderBy("child_index" if before else F.desc("child_index")).rowsBetween(Window.unboundedPreceding, -1)
    entries = scratch.put(offered.select("parent_id", "child_id", "child_index", "is_link", F.last("leaf", ignorenulls=True).over(side).alias("near")))
    entries = entries.withColumnRenamed("child_id", "at")
    new = scratch.put(full.select("id", F.col("id").alias("at")))
    seen, out = new, None
    while not _empty(new):
        asked = scratch.put(new.join(entries, "at"))
        hits = asked.where("near is not null").select("id", F.col("near").alias("sibling"))
        out = hits if out is None else out.unionByName(hits)
        up = asked.where("near is null and not is_link").select("id", F.col("parent_id").alias("at")).distinct()
        new = scratch.put(up.join(full.select(F.col("id").alias("at")), "at", "left_semi").join(seen, ["id", "at"], "left_anti"))
        seen = seen.unionByName(new)
    return out.distinct()


def preview(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, outcome, block_id, block_styles, span_styles) for roots (root): the first block below each.

    Only first children are followed, through pages and styles. Texts and chains
    end the way: Empty if blank, Cyclic if a chain meets a node twice or the way
    repeats, else Block.
    """
    scratch = Scratch(nodes.sparkSession, "preview")
    first = edges.where("child_index = 0").select(F.col("parent_id").alias("at"), F.col("child_id").alias("next"))
    none = F.array().cast("array<string>")
    style = lambda which: F.when((F.col("kind") == "Styled") & (F.col("style_kind") == which), F.coalesce("styles", none)).otherwise(none)
    info = nodes.select(F.col("id").alias("at"), "kind", "layout", style("Block").alias("bs"), style("Span").alias("ss"))
    new = scratch.put(roots.select("root", F.col("root").alias("at"), none.alias("block_styles"), none.alias("span_styles"), F.array("root").alias("way")))
    ends = None
    while not _empty(new):
        step = new.join(info, "at").join(first, "at", "left").withColumn("block_styles", F.array_union("block_styles", "bs")).withColumn("span_styles", F.array_union("span_styles", "ss"))
        stop = F.when((F.col("kind") == "Text") | ((F.col("kind") == "List") & (F.col("layout") == "Chain")), F.col("kind")).when(F.col("next").isNull(), "Empty").when(F.array_contains("way", F.col("next")), "Cyclic")
        step = scratch.put(step.withColumn("stop", stop))
        done = step.where("stop is not null").select("root", "stop", "at", "block_styles", "span_styles")
        ends = done if ends is None else ends.unionByName(done)
        new = step.where("stop is null").select("root", F.col("next").alias("at"), "block_styles", "span_styles", F.concat("way", F.array("next")).alias("way"))
    ends = scratch.put(ends)
    chains = scratch.put(ends.where("stop = 'List'").select(F.col("at").alias("root")).distinct())
    loops = revisits(edges, chains).where("revisits").select(F.col("root").alias("at"), F.lit(True).alias("loops"))
    full = not_blank(nodes, edges).select(F.col("id").alias("at"), F.lit(True).alias("full"))
    told = ends.join(full, "at", "left").join(loops, "at", "left")
    outcome = F.when(F.col("stop").isin("Empty", "Cyclic"), F.col("stop")).when(F.col("full").isNull(), "Empty").when(F.col("loops"), "Cyclic").otherwise("Block")
    return told.withColumn("outcome", outcome).select("root", "outcome", F.when(F.col("outcome") == "Block", F.col("at")).alias("block_id"), "block_styles", "span_styles")
