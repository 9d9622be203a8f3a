"""The engine as a store: transactions over a change log, and the calls that applications make.

The store is a folder of Parquet appends. A snapshot reads the log up to a
boundary; everything else is a query over it. A transaction stages whole nodes,
checks at its commit whether a node that it read has changed since its snapshot,
and appends all its writes with one time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import ids, markup
from palimpsest.operators import edits, graph, log, replicate, similarity, view
from palimpsest.plans.scratch import Scratch
from palimpsest.sources import store

NODE, PUBLISHED, SUBSCRIBED = 0, 5, 6
BROADCAST = "broadcast_id string, root string, token string, exported array<string>, last_updated long, expiration long"
VALUE = "kind string, text string, layout string, style_kind string, styles array<string>, children array<string>"


class Conflict(RuntimeError):
    """Another transaction changed what this one has read."""


class IdNotFound(KeyError):
    """No node, or no broadcast, has this id."""


def tables(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the values of a log."""
    v = held.select(F.col("key").alias("id"), F.from_json("value", VALUE).alias("v"))
    edges = v.select(F.col("id").alias("parent_id"), F.posexplode("v.children").alias("child_index", "child_id"))
    return v.select("id", "v.kind", "v.text", "v.layout", "v.style_kind", "v.styles"), edges


class Writes(dict):
    """What a transaction has written, by (slot, key): node or None, with the order of writing in `turn`."""

    def __init__(self):
        super().__init__()
        self.turn: dict[tuple[int, str], int] = {}
        self.count = 0

    def next(self) -> int:
        self.count += 1
        return self.count - 1

    def __setitem__(self, key, value) -> None:
        self.turn[key] = self.next()
        super().__setitem__(key, value)

    def rows(self) -> list[tuple]:
        return [(s, k, None if v is None else json.dumps(v), v is None, self.turn[s, k]) for (s, k), v in self.items()]


WRITE = "slot int, key string, value string, is_removed boolean, n long"


class Transaction:
    def __init__(self, engine: Engine):
        self.engine, self.spark = engine, engine.spark
        self.seen = engine.store.commits()  # what is committed later isn't seen
        self.seq = self.seen[-1]["first_seq"] + self.seen[-1]["span"] if self.seen else 0
        self.log = engine.store.rows(self.seen)
        self.writes = Writes()
        self.tables_in: list[DataFrame] = []  # imported nodes, as writes
        self.reads: set[tuple[int, str]] = set()

    # -- reading

    def written(self) -> DataFrame:
        """All writes, in order of `n`: (slot, key, value, is_removed, n)."""
        out = self.spark.createDataFrame(self.writes.rows(), WRITE)
        for rows in self.tables_in:
            out = out.unionByName(rows)
        return out

    def _staged(self) -> DataFrame:
        return self.log.unionByName(self.written().select("slot", "key", "value", "is_removed", F.lit(0).cast("long").alias("commit_ts"), (F.lit(self.seq) + F.col("n")).cast("long").alias("seq")))

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges as this transaction sees them."""
        return tables(log.latest(self._staged()).where(F.col("slot") == NODE))

    def _get(self, slot: int, key: str, trash: bool = False) -> dict | None:
        if not self.tables_in and (slot, key) in self.writes and not (trash and self.writes[slot, key] is None):
            return self.writes[slot, key]
        self.reads.add((slot, key))
        own = (self._staged() if self.tables_in else self.log).where((F.col("slot") == slot) & (F.col("key") == key))
        row = (log.unremoved(own) if trash else log.latest(own)).head()
        return None if row is None else json.loads(row["value"])

    def get(self, i: str) -> dict | None:
        return self._get(NODE, i)

    def get_in_trash(self, i: str) -> dict | None:
        return self._get(NODE, i, True)

    def versions(self, i: str) -> list:
        return log.versions(self._staged().where((F.col("slot") == NODE) & (F.col("key") == i))).orderBy("version_no").collect()

    def last_updated(self) -> int | None:
        return log.last_updated(self.log).first()[0]

    def blocks(self) -> DataFrame:
        """(id, text) of what is searchable: children of pages and of block styles, chains as one text, links as nothing."""
        nodes, edges = self.tables()
        holders = nodes.where("layout = 'Page' or style_kind = 'Block'").select(F.col("id").alias("parent_id"))
        starts = edges.join(holders, "parent_id", "left_semi").select(F.col("child_id").alias("root")).distinct()
        found = view.spans(nodes, edges, starts).select(F.col("root").alias("id"), F.col("path").alias("ix"), F.coalesce("text", F.lit("")).alias("text"), "is_link")
        return starts.select(F.col("root").alias("id")).join(similarity.chain_text(found), "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"))

    def search(self, term: str) -> list[tuple[str, float]]:
        terms = self.spark.createDataFrame([(0, term)], "term_id int, term string")
        return [(r["id"], r["score"]) for r in similarity.search(terms, self.blocks()).orderBy(*similarity.search_order()).collect()]

    def overlaps(self, i: str) -> list:
        held = self.blocks()
        own = held.where(F.col("id") == i)
        if own.isEmpty():
            raise IdNotFound(i)
        return similarity.overlaps_between(own, held).where("src_id <> id").orderBy(*similarity.overlap_order()).collect()

    # -- writing

    def _put(self, i: str, node: dict | None) -> None:
        self.writes.pop((NODE, i), None)
        self.writes[NODE, i] = node

    def _new(self, node: dict | str, as_id: str | None = None) -> str:
        made = iter([as_id] if as_id and not isinstance(node, str) else [])
        root, nodes, edges = store.flatten(node, lambda: next(made, None) or str(uuid.uuid4()))
        lists: dict[str, list[str]] = {}
        for p, _, c in sorted(edges):
            lists.setdefault(p, []).append(c)
        for n in nodes:
            self._put(n[0], dict(zip(("kind", "text", "layout", "style_kind", "styles"), n[1:], strict=True)) | {"children": lists.get(n[0], [])})
        for c in self._missing(sorted({c for children in lists.values() for c in children} - {n[0] for n in nodes})):
            self.restore(c)
        return root

    def add(self, node: dict | str) -> str:
        return self._new(node)

    def swap(self, i: str, node: dict) -> None:
        """Replaces a node's content; children that nothing holds any more go to the trash."""
        if self.get_in_trash(i) is None:
            raise IdNotFound(i)
        _, edges = self.tables()
        self._new(node, i)
        kept = [(p, k, c) for (s, p), v in self.writes.items() if v and s == NODE for k, c in enumerate(v["children"])]
        lost = edits.orphans(edges, self.spark.createDataFrame([(i,)], "id string"), self.spark.createDataFrame(kept, store.EDGES))
        for r in lost.where(F.col("id") != ids.ROOT).collect():
            self._put(r["id"], None)

    def update(self, i: str, change: Callable[[list[str]], None]) -> None:
        """Lets `change` edit a list's children in place, and swaps the list for the result."""
        held = self.get(i)
        if held is None:
            raise IdNotFound(i)
        if held["kind"] != "List":
            raise store.NodeError("only lists have children to edit")
        children = list(held["children"])
        change(children)
        self.swap(i, {"List": held["layout"], "children": children})

    def push(self, i: str, child: dict | str) -> str:
        c = self._new(child)
        self.update(i, lambda held: held.append(c))
        return c

    def insert(self, i: str, at: int, child: dict | str) -> str:
        c = self._new(child)
        self.update(i, lambda held: held.insert(at, c))
        return c

    def replace(self, i: str, at: int, child: dict | str) -> str:
        c = self._new(child)
        self.update(i, lambda held: held.__setitem__(at, c))
        return c

    def remove(self, i: str, at: int) -> None:
        self.update(i, lambda held: held.pop(at))

    def restore(self, i: str) -> bool:
        """Brings a node and what was removed below it back; False if it isn't removed. One read per level, not per node."""
        if self.get(i) is not None:
            return False
        if self.get_in_trash(i) is None:
            raise IdNotFound(i)
        level = [i]
        while level:
            held = self._trash(level)
            for c in level:
                if c in held:
                    self._put(c, held[c])
            below = sorted({c for v in held.values() for c in v["children"]})
            level = self._missing(below)
        return True

    def _present(self, keys: list[str]) -> set[str]:
        """Which of some nodes there are; all are read."""
        asked = [k for k in keys if self.tables_in or (NODE, k) not in self.writes]
        self.reads |= {(NODE, k) for k in asked}
        there = set() if self.tables_in else {k for k in keys if self.writes.get((NODE, k)) is not None}
        return there | {r["key"] for r in log.latest(self._of(asked)).select("key").collect()} if asked else there

    def _missing(self, keys: list[str]) -> list[str]:
        there = self._present(keys) if keys else set()
        return [k for k in keys if k not in there]

    def _of(self, keys: list[str]) -> DataFrame:
        """The log of some nodes."""
        wanted = self.spark.createDataFrame([(k,) for k in keys], "key string")
        return (self._staged() if self.tables_in else self.log).where(F.col("slot") == NODE).join(F.broadcast(wanted), "key", "left_semi")

    def _trash(self, keys: list[str]) -> dict[str, dict]:
        """The last values of some nodes that are removed; an id that was never there is left out."""
        return {r["key"]: json.loads(r["value"]) for r in log.unremoved(self._of(keys)).collect()}

    # -- views and replication

    def tile(self, i: str) -> dict[str, list]:
        nodes, edges = self.tables()
        times = log.latest_version(self.log.where(F.col("slot") == NODE)).select(F.col("key").alias("id"), "ts")
        if self.get(i) is None:
            raise IdNotFound(i)
        found = view.tile(nodes, edges, self.spark.createDataFrame([(i,)], "root string"), times)
        return {k: [r.asDict(recursive=True) for r in (df.orderBy("root", "path") if "path" in df.columns else df).collect()] for k, df in found.items()} | {"broadcasts": self.broadcasts(i)}

    def export_since(self, i: str, since: int = -1) -> tuple[DataFrame, DataFrame, DataFrame]:
        times = log.latest_version(self.log.where(F.col("slot") == NODE)).select(F.col("key").alias("id"), "ts")
        return replicate.export_since(*self.tables(), times, i, since)

    def import_(self, nodes: DataFrame, edges: DataFrame, namespace: str) -> None:
        """Stages an export's nodes, moved into a namespace, as a table: nothing of it comes to the driver."""
        nodes, edges = replicate.namespaced(nodes, edges, F.lit(namespace))
        lists = edges.groupBy(F.col("parent_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("child_index", "child_id"))).alias("c"))
        held = nodes.join(lists, "id", "left").withColumn("children", F.coalesce("c.child_id", F.array().cast("array<string>")))
        value = F.to_json(F.struct("kind", "text", "layout", "style_kind", "styles", "children"), {"ignoreNullFields": "false"})
        rows = held.select(F.lit(NODE).alias("slot"), F.col("id").alias("key"), value.alias("value"), F.lit(False).alias("is_removed"), F.lit(self.writes.next()).cast("long").alias("n"))
        self.tables_in.append(Scratch(self.spark, "import").put(rows))

    def _published(self) -> DataFrame:
        """The broadcasts there are, a row each, with their value as it is stored."""
        held = log.latest(self._staged()).where(F.col("slot") == PUBLISHED)
        return held.select("value", F.from_json("value", BROADCAST).alias("b")).select("value", "b.*")

    def broadcasts(self, i: str, now: int | None = None) -> list[dict]:
        """Active broadcasts that export a node, newest first."""
        now = int(time.time() * 1000) if now is None else now
        published = self._published()
        mine = replicate.broadcasts_of(published, self.spark.createDataFrame([(i,)], "id string"), F.lit(now)).select("broadcast_id")
        held = [json.loads(r["value"]) for r in published.join(mine, "broadcast_id", "left_semi").select("value").collect()]
        return sorted(held, key=lambda b: (-b["last_updated"], -(b["expiration"] or float("inf")), b["broadcast_id"]))

    def publish(self, i: str, episodes: str, now: int | None = None) -> dict:
        """Writes what changed since the last episode of the node's broadcast, or all of it the first time."""
        now = int(time.time() * 1000) if now is None else now
        held = self._get(PUBLISHED, i)
        exported, nodes, edges = self.export_since(i, held["last_updated"] if held else -1)
        last = self.last_updated() or 0
        b = (held or {"broadcast_id": str(uuid.uuid4()), "root": i, "token": uuid.uuid4().hex}) | {"exported": sorted(r["id"] for r in exported.collect()), "last_updated": last, "expiration": now + replicate.BROADCAST_TTL}
        store.push_episode(nodes, edges, episodes, b["broadcast_id"], last)
        self.writes[PUBLISHED, i] = b
        return b

    def broadcast(self, i: str, episodes: str, now: int | None = None) -> dict[str, list]:
        """Publishes a node, and gives its tile with the broadcast in it."""
        self.publish(i, episodes, now)
        return self.tile(i)

    def update_broadcasts(self, i: str, episodes: str, now: int | None = None) -> list[str]:
        """Publishes again every active broadcast that exports something a node shows, each from its own root, and deletes expired ones."""
        now = int(time.time() * 1000) if now is None else now
        nodes, edges = self.tables()
        links = graph.linked(edges, graph.span_flags(nodes, edges))
        shown = graph.descendants_until_links(links, self.spark.createDataFrame([(i,)], "root string")).select(F.col("node").alias("id"))
        push, gone = replicate.to_update(self._published(), shown, F.lit(now))
        push, gone = ([r["root"] for r in df.select("root", "broadcast_id").orderBy("broadcast_id").collect()] for df in (push, gone))
        for root in gone:
            self.writes[PUBLISHED, root] = None
        return [self.publish(root, episodes, now)["broadcast_id"] for root in push]

    def namespaced_id(self, broadcast_id: str, i: str) -> str:
        held = self._get(SUBSCRIBED, broadcast_id)
        if held is None:
            raise IdNotFound(broadcast_id)
        return str(uuid.UUID(int=uuid.UUID(held["namespace"]).int ^ uuid.UUID(i).int))

    def fetch(self, broadcast_id: str, episodes: str) -> int:
        """Takes the episodes that are newer than the last one taken; the number of nodes that came."""
        held = self._get(SUBSCRIBED, broadcast_id) or {"last_updated": -1, "namespace": str(uuid.uuid4())}
        marks = self.spark.createDataFrame([(broadcast_id, held["last_updated"])], "broadcast_id string, last_updated long")
        rows = replicate.pull(store.episodes(self.spark, episodes), marks)
        top = rows.agg(F.max("episode_ts")).first()[0]
        if top is None:
            return 0
        won = replicate.newest(rows)
        nodes = won.select("id", "kind", "text", "layout", "style_kind", "styles")
        edges = won.select(F.col("id").alias("parent_id"), F.explode("children").alias("c")).select("parent_id", "c.child_index", "c.child_id")
        self.import_(nodes, edges, held["namespace"])
        self.writes[SUBSCRIBED, broadcast_id] = held | {"last_updated": top}
        return nodes.count()

    def refresh(self, i: str, episodes: str | None = None) -> dict[str, list]:
        """The tile of a node, or of `broadcast:<id>`, which is subscribed to if it isn't yet."""
        kind, _, name = i.rpartition(":")
        uuid.UUID(name)
        if kind == "broadcast":
            if self._get(SUBSCRIBED, name) is None and not self.fetch(name, episodes):
                raise IdNotFound(name)
            return self.tile(self.namespaced_id(name, ids.ROOT)) | {"broadcasts": []}
        return self.tile(name)

    def sync(self, i: str | None, sections: list[dict]) -> str:
        """Writes edited sections: {"Existing": id}, {"Linked": id} or {"Edited": [lines of markup]}, as a page, new or under an id."""
        children: list[dict | str] = []
        for s in sections:
            (kind, value), *_ = s.items()
            if kind == "Existing":
                children.append(value)
            elif kind == "Linked":
                children.append({"List": "Chain", "children": [value]})
            elif kind == "Edited":
                children.append({"List": "Page", "children": [markup.to_node(x) for x in value]})
            else:
                raise store.NodeError(f"not a section: {kind}")
        page = {"List": "Page", "children": children}
        if i is None:
            return self.add(page)
        self.swap(i, page)
        return i


class Engine:
    """A store in a folder. Several engines, in several sessions, may have the same one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.store = store.Store(spark, path)
        root = {"kind": "List", "text": None, "layout": "Page", "style_kind": None, "styles": None, "children": []}
        now = int(time.time() * 1000)
        self.store.add(lambda held, first: None if held else spark.createDataFrame([(NODE, ids.ROOT, json.dumps(root), False, now, first)], store.LOG))

    def log(self) -> DataFrame:
        return self.store.read()

    def size(self) -> int:
        return log.size(self.log()).first()["n_bytes"]

    def begin(self) -> Transaction:
        return Transaction(self)

    def commit(self, t: Transaction) -> None:
        """Commits a transaction's writes; raises Conflict if something that it read has changed. Only reading never conflicts.

        The check and the commit are one step: if another writer commits in
        between, the number is taken, and the check is made again with what that
        one has written.
        """
        if not t.writes and not t.tables_in:
            return
        writes = t.written()

        def made(held: list[dict], first: int) -> DataFrame:
            seen = t.seen[-1]["number"] if t.seen else -1
            late = [c for c in held if c["number"] > seen]
            if late and t.reads:
                reads = self.spark.createDataFrame([(0, s, k, t.seq) for s, k in t.reads], "tx_id int, slot int, key string, seq long")
                if log.conflicts(reads, self.store.rows(late)).first()["conflict"]:
                    raise Conflict("a node that was read has changed")
            now = max(int(time.time() * 1000), held[-1]["commit_ts"] if held else 0)
            rows = log.stage(self.spark.createDataFrame([], store.LOG), writes, now, first)
            if not t.tables_in:
                return rows
            return rows.withColumn("seq", F.lit(first).cast("long") + F.monotonically_increasing_id())  # a table's rows share a turn

        self.store.add(made)
        t.writes, t.tables_in = Writes(), []

    @contextmanager
    def tx(self) -> Iterator[Transaction]:
        """A transaction that commits at the end of its block; an error in the block drops it."""
        t = self.begin()
        yield t
        self.commit(t)

    def merge(self, to: str | None = None) -> Engine:
        """Drops the history and the trash: in place, as one commit that replaces all before it, or in another folder."""
        if to is not None:
            store.compact(self.spark, self.path, to)
            return Engine(self.spark, to)
        self.store.add(lambda held, first: log.merge(self.store.rows(held)), merge=True)
        return self
