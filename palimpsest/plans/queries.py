"""The registered queries of the engine's own operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import ids, markup
from palimpsest.functions import text as T
from palimpsest.operators import edits, graph, log, replicate, similarity, view
from palimpsest.plans import inputs as I
from palimpsest.streaming.latest import stream_latest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Moments for broadcasts and for orders, in milliseconds.
AS_OF, ORDERED = 1_704_100_000_000, 852_076_800_000
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return I.lines(I.table(spark, d, "documents"), "doc_id")


def _item_lines(spark: SparkSession, d: str) -> DataFrame:
    return I.lines(I.table(spark, d, "benchmark"), "item_id")


def _talk_blocks(spark: SparkSession, d: str) -> DataFrame:
    return I.blocks(I.lines(I.table(spark, d, "conversations"), "conv_id", "turn"), "conv_id", "turn")


@query
def q_split_lines(spark: SparkSession, d: str) -> DataFrame:
    return _doc_lines(spark, d)


@query
def q_blank_lines(spark: SparkSession, d: str) -> DataFrame:
    return _doc_lines(spark, d).groupBy("doc_id").agg(F.count_if(T.is_blank(F.col("line"))).alias("n_blank"), F.count("*").alias("n_lines"))


@query
def q_grams(spark: SparkSession, d: str) -> DataFrame:
    return similarity.gram_totals(I.blocks(_doc_lines(spark, d), "doc_id"))


@query
def q_gram_count(spark: SparkSession, d: str) -> DataFrame:
    return similarity.gram_counts(I.blocks(_doc_lines(spark, d), "doc_id")).select("id.doc_id", "id.line_ix", "n_grams")


@query
def q_chain_grams(spark: SparkSession, d: str) -> DataFrame:
    spans = I.table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("ix"), "text", (F.col("role") == "system").alias("is_link"))
    return similarity.gram_rows(similarity.chain_text(spans)).groupBy(F.col("id").alias("conv_id")).agg(F.sum("n").alias("n_grams"), F.count("*").alias("n_distinct"))


@query
def q_gram_changes(spark: SparkSession, d: str) -> DataFrame:
    before = I.blocks(_item_lines(spark, d), "item_id")
    after = before.select("id", F.replace("text", F.lit("e"), F.lit("3")).alias("text"))
    return similarity.changes(before, after).select("id.item_id", "id.line_ix", "gram", "n")


@query
def q_gram_upsert(spark: SparkSession, d: str) -> DataFrame:
    before = I.blocks(_item_lines(spark, d), "item_id")
    after = before.select("id", F.replace("text", F.lit("e"), F.lit("3")).alias("text"))
    return similarity.upsert(similarity.gram_rows(before), similarity.changes(before, after)).select("id.item_id", "id.line_ix", "gram", "n")


def _searched(spark: SparkSession, d: str) -> DataFrame:
    terms = _item_lines(spark, d).select(F.struct("item_id", F.col("line_ix").alias("term_ix")).alias("term_id"), F.col("line").alias("term"))
    return similarity.search(terms, I.blocks(_doc_lines(spark, d), "doc_id"))


@query
def q_search(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d).select("term_id.item_id", "term_id.term_ix", "id.doc_id", "id.line_ix", "i", "score")


@query
def q_search_topk(spark: SparkSession, d: str) -> DataFrame:
    return similarity.top_k(_searched(spark, d), 5).select("term_id.item_id", "term_id.term_ix", "rank", "id.doc_id", "id.line_ix", "i")


def _pairs(found: DataFrame, *more: str) -> DataFrame:
    return found.select(F.col("src_id.conv_id").alias("src_conv"), F.col("src_id.turn").alias("src_turn"), F.col("src_id.line_ix").alias("src_line"), F.col("id.conv_id").alias("conv"), F.col("id.turn").alias("turn"), F.col("id.line_ix").alias("line"), "a", "b", "i", *more)


@query
def q_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(similarity.overlaps(_talk_blocks(spark, d)))


@query
def q_overlap_reverse(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(similarity.reverse(similarity.overlaps(_talk_blocks(spark, d))))


@query
def q_overlap_topk(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(similarity.best_overlaps(_talk_blocks(spark, d), 3), "rank")


@query
def q_overlap_changes(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps of the benchmark's lines that come, go or change when every third line is changed."""
    before = I.blocks(_item_lines(spark, d), "item_id")
    after = before.select("id", F.when(F.col("id.item_id") % 3 == 0, F.replace("text", F.lit("e"), F.lit("3"))).otherwise(F.col("text")).alias("text"))
    found = similarity.difference(similarity.overlaps(before), similarity.overlaps(after))
    return found.select(F.col("src_id.item_id").alias("src_item"), F.col("src_id.line_ix").alias("src_line"), "id.item_id", "id.line_ix", "a", "b", "i", "change")


@query
def q_overlap_cross(spark: SparkSession, d: str) -> DataFrame:
    found = similarity.overlaps_between(I.blocks(_item_lines(spark, d), "item_id"), I.blocks(_doc_lines(spark, d), "doc_id"))
    return found.select("src_id.item_id", F.col("src_id.line_ix").alias("item_line"), "id.doc_id", "id.line_ix", "a", "b", "i")


@query
def q_kv_latest(spark: SparkSession, d: str) -> DataFrame:
    return log.latest(I.events(spark, d)).select("key", "value", "commit_ts")


@query
def q_kv_unremoved(spark: SparkSession, d: str) -> DataFrame:
    return log.unremoved(I.events(spark, d)).select("key", "value", "commit_ts")


@query
def q_kv_versions(spark: SparkSession, d: str) -> DataFrame:
    return log.versions(I.events(spark, d)).select("key", "version_no", "seq", "is_removed")


@query
def q_kv_get_version(spark: SparkSession, d: str) -> DataFrame:
    return log.version(I.events(spark, d), 3).select("key", "value")


@query
def q_kv_as_of(spark: SparkSession, d: str) -> DataFrame:
    """As the log was in the middle of its time."""
    held = I.events(spark, d)
    lo, hi = held.agg(F.min("commit_ts"), F.max("commit_ts")).first()
    return log.latest(log.as_of(held, commit_ts=(lo + hi) // 2 if lo is not None else 0)).select("key", "value", "commit_ts")


@query
def q_kv_before_seq(spark: SparkSession, d: str) -> DataFrame:
    """As the log was before the middle of its numbers."""
    held = I.events(spark, d)
    top = held.agg(F.max("seq")).first()[0]
    return log.latest(log.as_of(held, seq=(top + 1) // 2 if top is not None else 0)).select("key", "value", "seq")


@query
def q_kv_keys(spark: SparkSession, d: str) -> DataFrame:
    return log.keys(I.events(spark, d), 0)


@query
def q_kv_last_updated(spark: SparkSession, d: str) -> DataFrame:
    return log.last_updated(I.events(spark, d))


@query
def q_kv_latest_version(spark: SparkSession, d: str) -> DataFrame:
    return log.latest_version(I.events(spark, d)).select("key", "ts")


@query
def q_kv_merge(spark: SparkSession, d: str) -> DataFrame:
    return log.merge(I.events(spark, d)).select("key", "value", "is_removed", "seq")


@query
def q_kv_stage(spark: SparkSession, d: str) -> DataFrame:
    held = I.events(spark, d)
    writes = held.select("slot", "key", F.upper("value").alias("value"), "is_removed", F.col("seq").alias("n"))
    return log.stage(held, writes, 2_000_000_000_000, 1_000_000_000).where("seq >= 1000000000").select("key", "value", "is_removed", "commit_ts", "seq")


@query
def q_kv_monotonic(spark: SparkSession, d: str) -> DataFrame:
    shaken = I.events(spark, d).withColumn("commit_ts", F.expr("commit_ts - (seq * 7919 % 100) * 60000"))
    return log.monotonic(shaken, chunk=1024).select("seq", "commit_ts", "monotonic_ts")


@query
def q_kv_size(spark: SparkSession, d: str) -> DataFrame:
    return log.size(I.events(spark, d))


@query
def q_tx_conflict(spark: SparkSession, d: str) -> DataFrame:
    held = I.events(spark, d)
    reads = held.select(F.expr("seq div 2").alias("tx_id"), "slot", "key", (F.col("seq") + 100).alias("seq"))
    return log.conflicts(reads, held)


@query
def q_tx_crc(spark: SparkSession, d: str) -> DataFrame:
    return log.commit_crc(I.events(spark, d).select(F.expr("seq div 10").alias("tx_id"), "seq", F.encode("value", "utf-8").alias("bytes")))


@query
def q_parents(spark: SparkSession, d: str) -> DataFrame:
    return graph.parents(I.trade_edges(spark, d))


@query
def q_descendants(spark: SparkSession, d: str) -> DataFrame:
    roots = I.table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))
    return graph.descendants(I.trade_edges(spark, d), roots)


@query
def q_descendants_until_links(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = I.talk_graph(spark, d, "links")
    links = graph.linked(edges, graph.span_flags(nodes, edges))
    return graph.descendants_until_links(links, nodes.where("id like 'v%'").select(F.col("id").alias("root")))


@query
def q_ancestor_path(spark: SparkSession, d: str) -> DataFrame:
    starts = I.table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return graph.ancestor_path(I.trade_edges(spark, d), starts).select("node", "depth", "ancestor")


@query
def q_ancestor_path_until_link(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = I.talk_graph(spark, d, "links")
    links = graph.linked(edges, graph.span_flags(nodes, edges))
    return graph.ancestor_path(links, nodes.where("kind = 'Text'").select(F.col("id").alias("node"))).select("node", "depth", "ancestor")


@query
def q_is_span(spark: SparkSession, d: str) -> DataFrame:
    return graph.span_flags(*I.talk_graph(spark, d, "styled"))


@query
def q_is_link(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = I.talk_graph(spark, d, "styled")
    return graph.linked(edges, graph.span_flags(nodes, edges))


@query
def q_is_blank(spark: SparkSession, d: str) -> DataFrame:
    return graph.blank_flags(*I.talk_graph(spark, d, "pages"))


@query
def q_is_cyclic(spark: SparkSession, d: str) -> DataFrame:
    roots = I.table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("root"))
    return graph.revisits(I.trade_edges(spark, d, names=True), roots)


@query
def q_true_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers of a nation that stand in a ring, next to the trade graph, which has none."""
    ring = I.table(spark, d, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("parent_id"), F.lit(0).alias("child_index"), F.concat(F.lit("k"), F.expr("cast(if(n_nationkey % 5 = 4, n_nationkey - 4, n_nationkey + 1) as string)")).alias("child_id"))
    edges = I.trade_edges(spark, d).unionByName(ring)
    roots = edges.select(F.col("parent_id").alias("root")).distinct()
    return graph.cyclic(edges, roots)


@query
def q_shared(spark: SparkSession, d: str) -> DataFrame:
    roots = I.table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("root"))
    return graph.shared(I.trade_edges(spark, d), roots)


@query
def q_siblings_before(spark: SparkSession, d: str) -> DataFrame:
    return graph.siblings(*I.talk_graph(spark, d, "pages"), True)


@query
def q_siblings_after(spark: SparkSession, d: str) -> DataFrame:
    return graph.siblings(*I.talk_graph(spark, d, "pages"), False)


@query
def q_preview(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = I.talk_graph(spark, d, "pages")
    return graph.preview(nodes, edges, nodes.where("id like 'v%'").select(F.col("id").alias("root"))).select("root", "outcome", "block_id")


@query
def q_preview_styles(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = I.talk_graph(spark, d, "styled")
    found = graph.preview(nodes, edges, nodes.where("id like 't%'").select(F.col("id").alias("root")))
    return found.select("root", "outcome", "block_id", F.array_join("block_styles", ",").alias("block_styles"), F.array_join("span_styles", ",").alias("span_styles"))


@query
def q_preview_blocks(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = I.talk_graph(spark, d, "spans")
    found = view.preview_blocks(nodes, edges, nodes.where("id like 'v%'").select(F.col("id").alias("root")))
    return found.select("root", "outcome", "block_id", F.col("path")[0].alias("ix"), "text", F.array_join("span_styles", ",").alias("styles"))


@query
def q_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """The turns of styled conversations as they would be if users' turns had lost their children and the others' texts had got some."""
    nodes, edges = I.talk_graph(spark, d, "styled")
    lost = nodes.where("style_kind = 'Span'").select(F.col("id").alias("parent_id"))
    more = nodes.where("kind = 'Text'").select(F.col("id").alias("parent_id"), F.lit(0).alias("child_index"), F.lit("x").alias("child_id"))
    return graph.mismatches(nodes, edges.join(lost, "parent_id", "left_anti").unionByName(more))


@query
def q_sections(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = I.trade_nodes(spark, d), I.trade_edges(spark, d)
    found = view.sections(nodes, edges, nodes.where("id like 'o%'").select(F.col("id").alias("root")))
    return found.select("root", F.col("path")[0].alias("section_ix"), "section_id", "has_multiple_parents")


@query
def q_subsections(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = I.talk_graph(spark, d, "pages")
    found = view.subsections(nodes, edges, nodes.where("id like 'v%'").select(F.col("id").alias("root")))
    return found.select("root", F.col("path")[0].alias("turn_ix"), F.col("path")[1].alias("line_ix"), "id")


@query
def q_spans(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = I.talk_graph(spark, d, "spans")
    found = view.spans(nodes, edges, nodes.where("id like 'v%'").select(F.col("id").alias("root")))
    return found.select("root", F.col("path")[0].alias("ix"), "text", F.array_join("span_styles", ",").alias("styles"))


@query
def q_lineage(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = I.talk_graph(spark, d, "links")
    return view.lineage(nodes, edges, nodes.where("id like 't%'").select("id"))


@query
def q_parent_branches(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = I.talk_graph(spark, d, "links")
    return view.parent_branches(nodes, edges, nodes.where("id like 't%'").select(F.col("id").alias("root")))


@query
def q_tile_branches(spark: SparkSession, d: str) -> DataFrame:
    """The branches of every document's page: what stands next to its lines in other documents."""
    nodes, edges = I.line_graph(spark, d)
    roots = nodes.where("kind = 'List'").select(F.col("id").alias("root"))
    around = view.Surroundings(nodes, edges, roots)
    both = [view.branches(nodes, edges, roots, before, around).withColumn("is_before", F.lit(before)) for before in (True, False)]
    return both[0].unionByName(both[1])


def _all_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lists = I.child_lists(spark, d)
    return lists, lists.select("parent_id").distinct()


@query
def q_remove_reindex(spark: SparkSession, d: str) -> DataFrame:
    lists, owners = _all_lists(spark, d)
    return edits.remove(lists, owners.withColumn("at", F.lit(0)))


@query
def q_insert(spark: SparkSession, d: str) -> DataFrame:
    lists, owners = _all_lists(spark, d)
    return edits.insert(lists, owners.select("parent_id", F.lit(1).alias("at"), F.concat(F.lit("new"), F.col("parent_id")).alias("child_id")))


@query
def q_replace(spark: SparkSession, d: str) -> DataFrame:
    lists, owners = _all_lists(spark, d)
    return edits.replace(lists, owners.select("parent_id", F.lit(0).alias("at"), F.concat(F.lit("new"), F.col("parent_id")).alias("child_id")))


@query
def q_push(spark: SparkSession, d: str) -> DataFrame:
    lists, owners = _all_lists(spark, d)
    return edits.push(lists, owners.select("parent_id", F.concat(F.lit("new"), F.col("parent_id")).alias("child_id")))


@query
def q_orphans(spark: SparkSession, d: str) -> DataFrame:
    edges = I.trade_edges(spark, d)
    swapped = I.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return edits.orphans(edges, swapped, edges.where("false"))


@query
def q_export_since(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = I.trade_nodes(spark, d), I.trade_edges(spark, d)
    placed = I.table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    times = nodes.select("id").join(placed, "id", "left").select("id", F.coalesce("ts", F.lit(0)).alias("ts"))
    return replicate.export_since(nodes, edges, times, "r1", ORDERED)[1].select("id", "kind")


@query
def q_export_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = I.trade_nodes(spark, d), I.trade_edges(spark, d)
    placed = I.table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    times = nodes.select("id").join(placed, "id", "left").select("id", F.coalesce("ts", F.lit(0)).alias("ts"))
    return replicate.export_since(nodes, edges, times, "r1", ORDERED)[2].select("parent_id", "child_index", "child_id")


@query
def q_restore(spark: SparkSession, d: str) -> DataFrame:
    """Child lists that come back with the customers of a segment, of whom and of whose orders nothing was left."""
    nodes, edges = I.trade_nodes(spark, d), I.trade_edges(spark, d)
    roots = I.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("root"))
    lost = roots.select(F.col("root").alias("id")).unionByName(edges.join(roots.select(F.col("root").alias("parent_id")), "parent_id", "left_semi").select(F.col("child_id").alias("id")))
    back, lists = edits.restore(nodes, edges, nodes.join(lost, "id", "left_anti"), roots)
    return lists.join(back.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("parent_id", "child_index", "child_id")


@query
def q_import_edges(spark: SparkSession, d: str) -> DataFrame:
    """Lists of the benchmark's items next to the same lists imported under a namespace."""
    edges = I.item_edges(spark, d)
    nodes = edges.select(F.col("parent_id").alias("id")).distinct()
    return replicate.upsert(nodes, edges, *replicate.namespaced(nodes, edges, F.lit(NAMESPACE)))[1]


@query
def q_import_xor(spark: SparkSession, d: str) -> DataFrame:
    docs = I.table(spark, d, "documents").select("doc_id", ids.from_text(F.col("text")).alias("id"))
    return docs.withColumn("namespaced", ids.xor(F.col("id"), F.lit(NAMESPACE)))


@query
def q_list_broadcasts(spark: SparkSession, d: str) -> DataFrame:
    kinds = I.table(spark, d, "events").select(F.col("event_type").alias("id")).distinct()
    found = replicate.broadcasts_of(I.broadcasts(spark, d), kinds, F.lit(AS_OF))
    return found.select("id", "broadcast_id", "last_updated", "expiration")


@query
def q_update_broadcasts(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([("purchase",)], "id string")
    push, gone = replicate.to_update(I.broadcasts(spark, d), wanted, F.lit(AS_OF))
    return push.select("broadcast_id", F.lit("push").alias("action")).unionByName(gone.select("broadcast_id", F.lit("delete").alias("action")))


@query
def q_pull_episodes(spark: SparkSession, d: str) -> DataFrame:
    episodes = I.table(spark, d, "events").select(F.col("event_type").alias("broadcast_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("episode_ts"), F.col("user_id").cast("string").alias("id"), "event_id")
    marks = episodes.select("broadcast_id").distinct().withColumn("last_updated", F.lit(AS_OF).cast("long"))
    return replicate.newest(replicate.pull(episodes, marks)).select("broadcast_id", "id", "episode_ts", "event_id")


@query
def q_markup_block_style(spark: SparkSession, d: str) -> DataFrame:
    marks = F.element_at(F.array(*[F.lit(x) for x in ("", "# ", ">- ", ",>-# ", "##>#> ", "\\# ", "#")]), (F.col("line_ix") % 7 + 1).cast("int"))
    marked = _doc_lines(spark, d).withColumn("line", F.concat(marks, F.col("line")))
    return marked.select("doc_id", "line_ix", F.array_join(T.block_styles(F.col("line")), ",").alias("styles"), T.block_rest(F.col("line")).alias("rest"))


@query
def q_markup_spans(spark: SparkSession, d: str) -> DataFrame:
    return _doc_lines(spark, d).withColumn("m", markup.parse_column("line")).select("doc_id", "line_ix", F.posexplode("m.spans").alias("ix", "s")).select("doc_id", "line_ix", "ix", F.array_join("s.styles", ",").alias("styles"), "s.text")


@query
def q_markup_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    once = _doc_lines(spark, d).withColumn("once", markup.rewritten_column("line"))
    return once.select("doc_id", "line_ix", (markup.json_column("once") == markup.json_column("line")).alias("same"))


@query
def q_stream_latest(spark: SparkSession, d: str) -> DataFrame:
    return stream_latest(spark, d).select("key", "value", "commit_ts")
