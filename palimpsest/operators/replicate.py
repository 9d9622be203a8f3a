"""Replication: exports, imports under a namespace, broadcasts and their episodes.

Tables: published (broadcast_id, root, exported, token, last_updated,
expiration), subscribed (broadcast_id, last_updated, namespace), episodes
(broadcast_id, episode_ts, then a node's columns and its `children`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.ids import ROOT, xor
from palimpsest.operators.graph import descendants

#: Milliseconds that a broadcast and its episodes live.
BROADCAST_TTL, EPISODE_TTL = 24 * 3600 * 1000, 36 * 3600 * 1000


def export_since(nodes: DataFrame, edges: DataFrame, times: DataFrame, root: str, since: int = -1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids, nodes, edges): all that the root reaches; of these, the nodes that changed after `since` (times: id, ts) and their child lists.

    If the root of the store isn't among them, a synthetic one that holds the exported node is added.
    """
    ids = descendants(edges, nodes.where(F.col("id") == root).select(F.col("id").alias("root"))).select(F.col("node").alias("id"))
    changed = nodes.join(ids, "id", "left_semi").join(times, "id").where(F.col("ts") > since).select(*nodes.columns)
    lists = edges.join(changed.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").join(ids.select(F.col("id").alias("child_id")), "child_id", "left_semi").select(*edges.columns)
    if root != ROOT:
        spark = nodes.sparkSession
        page = spark.createDataFrame([(ROOT, "List", None, "Page", None, None)], "id string, kind string, text string, layout string, style_kind string, styles array<string>")
        held = ids.where(F.col("id") == ROOT)
        changed = changed.unionByName(page.join(held, "id", "left_anti"))
        lists = lists.unionByName(spark.createDataFrame([(ROOT, 0, root)], "parent_id string, child_index int, child_id string").join(held.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select(*edges.columns))
    return ids, changed, lists


def namespaced(nodes: DataFrame, edges: DataFrame, namespace: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with all ids moved into a namespace; moving them again undoes it."""
    return nodes.withColumn("id", xor(F.col("id"), namespace)), edges.withColumn("parent_id", xor(F.col("parent_id"), namespace)).withColumn("child_id", xor(F.col("child_id"), namespace))


def upsert(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after an import: what comes replaces what was there under the same id, child list included."""
    ids = new_nodes.select("id")
    kept = edges.join(ids.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select(*edges.columns)
    return nodes.join(ids, "id", "left_anti").unionByName(new_nodes), kept.unionByName(new_edges.select(*edges.columns))


def pull(episodes: DataFrame, subscribed: DataFrame) -> DataFrame:
    """The episodes' rows that each subscription hasn't seen: later than its last update."""
    marks = subscribed.select("broadcast_id", "last_updated")
    return episodes.join(marks, "broadcast_id").where(F.col("episode_ts") > F.col("last_updated")).drop("last_updated")


def newest(rows: DataFrame, key: str = "id") -> DataFrame:
    """The last of the rows that several episodes have for a key."""
    return rows.groupBy("broadcast_id", key).agg(F.max_by(F.struct(*rows.columns), "episode_ts").alias("r")).select("r.*")


def advanced(subscribed: DataFrame, pulled: DataFrame) -> DataFrame:
    """Subscriptions with the high-water mark of what was pulled."""
    marks = pulled.groupBy("broadcast_id").agg(F.max("episode_ts").alias("mark"))
    return subscribed.join(marks, "broadcast_id", "left").withColumn("last_updated", F.greatest("last_updated", F.coalesce("mark", "last_updated"))).drop("mark")


def _active(now: Column) -> Column:
    return F.col("expiration").isNull() | (F.col("expiration") > now)


def broadcasts_of(published: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """(id, broadcast_id, last_updated, expiration) for ids (id): active broadcasts that export them; newest first, then the one that lasts longest, then by name."""
    exported = published.where(_active(now)).select("broadcast_id", "last_updated", "expiration", F.explode("exported").alias("id"))
    return exported.join(ids, "id", "left_semi").select("id", "broadcast_id", "last_updated", "expiration").orderBy(F.desc("last_updated"), F.desc_nulls_first("expiration"), "broadcast_id")


def to_update(published: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(broadcasts to push again, expired ones to delete): the active ones that export any of ids (id)."""
    active = published.where(_active(now))
    met = active.select("broadcast_id", F.explode("exported").alias("id")).join(ids, "id", "left_semi").select("broadcast_id").distinct()
    return active.join(met, "broadcast_id", "left_semi"), published.where(~_active(now))


def request(published: DataFrame, episodes: DataFrame, method: str, broadcast_id: str, token: str | None, now: int, episode_ts: int | None = None) -> int:
    """The status code that the service answers with: 201 new, 200 known, 400 bad id, 401 wrong token, 404 unknown, 405 other methods."""
    import uuid

    if method not in ("GET", "POST", "PUT", "DELETE", "OPTIONS"):
        return 405
    if method == "OPTIONS":
        return 200
    try:
        uuid.UUID(broadcast_id)
    except ValueError:
        return 400
    held = published.where((F.col("broadcast_id") == broadcast_id) & _active(F.lit(now))).select("token").head()
    if method == "GET":
        return 200 if held is not None else 404
    if held is not None and held["token"] != token:
        return 401
    if held is None:
        return 201 if method == "POST" else 404
    if method == "PUT":
        known = episodes.where((F.col("broadcast_id") == broadcast_id) & (F.col("episode_ts") == episode_ts)).head()
        return 200 if known is not None else 201
    return 200


def episode_list(raw: Column) -> Column:
    """Sorted distinct episode numbers of a JSON list."""
    return F.array_sort(F.array_distinct(F.from_json(raw, "array<bigint>")))
