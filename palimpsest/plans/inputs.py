"""The test tables read as blocks, change logs and document graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.streaming.latest import event_log


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(df: DataFrame, *keys: str) -> DataFrame:
    """The keys, line_ix and line of every line of `text`."""
    return df.select(*keys, F.posexplode(T.lines(F.col("text"))).alias("line_ix", "line")).withColumn("line_ix", F.col("line_ix").cast("long"))


def blocks(rows: DataFrame, *keys: str) -> DataFrame:
    """(id, text): lines as blocks, the id a struct of the keys and line_ix."""
    return rows.select(F.struct(*keys, "line_ix").alias("id"), F.col("line").alias("text"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(table(spark, sf_dir, "events"))


def _edges(pairs: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("parent_id").orderBy("child_id")
    return pairs.withColumn("child_index", F.row_number().over(order) - 1).select("parent_id", "child_index", "child_id")


def trade_edges(spark: SparkSession, sf_dir: str, names: bool = False) -> DataFrame:
    """region -> nation -> customer, supplier; customer -> order -> part, and with names part -> its name: children in the order of their ids."""
    t = lambda name: table(spark, sf_dir, name)
    pair = lambda df, a, p, b, c: df.select(F.concat(F.lit(a), F.col(p).cast("string")).alias("parent_id"), F.concat(F.lit(b), F.col(c).cast("string")).alias("child_id"))
    parts = [pair(t("nation"), "r", "n_regionkey", "n", "n_nationkey"), pair(t("customer"), "n", "c_nationkey", "c", "c_custkey"), pair(t("supplier"), "n", "s_nationkey", "s", "s_suppkey"), pair(t("orders"), "c", "o_custkey", "o", "o_orderkey"), pair(t("lineitem"), "o", "l_orderkey", "p", "l_partkey")]
    if names:
        parts.append(pair(t("part"), "p", "p_partkey", "t", "p_name"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _edges(out)


def _node(df: DataFrame, id_, kind: str, text=None, layout: str | None = None, style_kind: str | None = None, styles=()) -> DataFrame:
    return df.select(id_.alias("id"), F.lit(kind).alias("kind"), (text if text is not None else F.lit(None).cast("string")).alias("text"), F.lit(layout).cast("string").alias("layout"), F.lit(style_kind).cast("string").alias("style_kind"), (F.array(*[F.lit(s) for s in styles]).cast("array<string>") if style_kind else F.lit(None).cast("array<string>")).alias("styles"))


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of `trade_edges`: pages, and parts as texts."""
    t = lambda name: table(spark, sf_dir, name)
    key = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    out = _node(t("part"), key("p", "p_partkey"), "Text", F.col("p_name"))
    for name, a, c in (("region", "r", "r_regionkey"), ("nation", "n", "n_nationkey"), ("customer", "c", "c_custkey"), ("supplier", "s", "s_suppkey"), ("orders", "o", "o_orderkey")):
        out = out.unionByName(_node(t(name), key(a, c), "List", layout="Page"))
    return out


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("conv"), F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("turn_id"), F.col("turn"), "role", "text")


def talk_graph(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as a graph.

    pages: conversation (page) -> turn (page) -> line. links: conversation
    (chain) -> turn, a chain for users and a page, shown as a link, for others ->
    line. styled: conversation (chain) -> turn, for users a span style and for
    others a block style, over a chain of the lines. spans: conversation (chain)
    -> turn (a span style for users, a text for others) -> the turn's text.
    """
    from pyspark.sql import Window

    turns = _turns(spark, sf_dir)
    convs = turns.select("conv").distinct()
    down = turns.select(F.col("conv").alias("parent_id"), (F.row_number().over(Window.partitionBy("conv").orderBy("turn")) - 1).alias("child_index"), F.col("turn_id").alias("child_id"))
    user = F.col("role") == "user"
    if kind == "spans":
        whole = F.concat(F.lit("x"), F.col("turn_id"))
        nodes = _node(convs, F.col("conv"), "List", layout="Chain").unionByName(_node(turns.where(~user), F.col("turn_id"), "Text", F.col("text"))).unionByName(_node(turns.where(user), F.col("turn_id"), "Styled", style_kind="Span", styles=["Italic"])).unionByName(_node(turns.where(user), whole, "Text", F.col("text")))
        return nodes, down.unionByName(turns.where(user).select(F.col("turn_id").alias("parent_id"), F.lit(0).alias("child_index"), whole.alias("child_id")))
    rows = turns.select("turn_id", "role", F.posexplode(T.lines(F.col("text"))).alias("line_ix", "line")).withColumn("line_id", F.concat(F.lit("l"), F.substring("turn_id", 2, 1 << 30), F.lit("."), F.col("line_ix").cast("string")))
    texts = _node(rows, F.col("line_id"), "Text", F.col("line"))
    holder = F.concat(F.lit("h"), F.col("turn_id")) if kind == "styled" else F.col("turn_id")
    inner = rows.select(holder.alias("parent_id"), F.col("line_ix").alias("child_index"), F.col("line_id").alias("child_id"))
    if kind == "pages":
        nodes = _node(convs, F.col("conv"), "List", layout="Page").unionByName(_node(turns, F.col("turn_id"), "List", layout="Page"))
        return nodes.unionByName(texts), down.unionByName(inner)
    nodes = _node(convs, F.col("conv"), "List", layout="Chain").unionByName(texts)
    if kind == "links":
        nodes = nodes.unionByName(_node(turns.where(user), F.col("turn_id"), "List", layout="Chain")).unionByName(_node(turns.where(~user), F.col("turn_id"), "List", layout="Page"))
        return nodes, down.unionByName(inner)
    nodes = nodes.unionByName(_node(turns.where(user), F.col("turn_id"), "Styled", style_kind="Span", styles=["Italic"])).unionByName(_node(turns.where(~user), F.col("turn_id"), "Styled", style_kind="Block", styles=["Quote"])).unionByName(_node(turns, holder, "List", layout="Chain"))
    return nodes, down.unionByName(inner).unionByName(turns.select(F.col("turn_id").alias("parent_id"), F.lit(0).alias("child_index"), holder.alias("child_id")))


def line_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as pages of lines, where equal lines are one text that several pages share."""
    rows = lines(table(spark, sf_dir, "documents"), "doc_id").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("page"), "line_ix", F.md5("line").alias("text_id"), "line")
    texts = rows.groupBy("text_id").agg(F.min("line").alias("line"))
    nodes = _node(rows.select("page").distinct(), F.col("page"), "List", layout="Page").unionByName(_node(texts, F.col("text_id"), "Text", F.col("line")))
    return nodes, rows.select(F.col("page").alias("parent_id"), F.col("line_ix").cast("int").alias("child_index"), F.col("text_id").alias("child_id"))


def item_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as lists of their lines, with ids made of their texts."""
    from palimpsest.functions import ids

    rows = table(spark, sf_dir, "benchmark").select(ids.from_text(F.concat(F.col("item_id").cast("string"), F.lit(":"), "text")).alias("parent_id"), F.posexplode(T.lines(F.col("text"))).alias("child_index", "line"))
    return rows.select("parent_id", "child_index", ids.from_text(F.col("line")).alias("child_id"))


def child_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document as a child list; children are named by the line's place."""
    rows = lines(table(spark, sf_dir, "documents"), "doc_id")
    return rows.select(F.col("doc_id").cast("string").alias("parent_id"), F.col("line_ix").cast("int").alias("child_index"), F.concat_ws(".", F.col("doc_id").cast("string"), F.col("line_ix").cast("string")).alias("child_id"))


def broadcasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published broadcasts: one per user, exporting the event types seen; it lasts an hour from the last event, or, for users that had no error, for ever."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").cast("string").alias("broadcast_id")).agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("last_updated"), F.max(F.when(F.col("event_type") == "error", F.unix_millis(F.col("ts").cast("timestamp")) + 3_600_000)).alias("expiration"), F.sort_array(F.collect_set("event_type")).alias("exported"))
