"""Stores of the graph: a change log of atomic commits, in-memory tables, node JSON and episodes.

A store is a folder. `data` has a Parquet folder per commit, and `commits` a file
per commit, named by its number, which says which data folder it adds, what
number its rows begin with and when it was. A commit is there when its file is:
the file is made whole under another name and then given its own, which fails if
that is taken, so of two writers of one number one wins and the other looks
again. A merge is a commit that replaces all before it, so the swap is one file,
too. What no commit names is left over from a writer that failed, and is never read.

Giving a file a name that must be free is atomic on local disks and on HDFS;
object stores without a conditional rename need a single writer.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "id string, kind string, text string, layout string, style_kind string, styles array<string>"
EDGES = "parent_id string, child_index int, child_id string"
LOG = "slot int, key string, value string, is_removed boolean, commit_ts long, seq long"


class NodeError(ValueError):
    """A node that isn't well-formed."""


class ChildrenMismatch(NodeError):
    """A number of children that a node can't have: a text has none, a style one."""


class WrongNodeType(NodeError):
    """A question that only another kind of node answers."""


def split(node: dict) -> tuple[dict, list]:
    """A nested node without its children, and these."""
    if "Text" in node:
        return {"Text": node["Text"]}, []
    if "List" in node:
        return {"List": node["List"]}, list(node.get("children", []))
    if "Styled" in node:
        held = dict(node["Styled"])
        child = held.pop("child", None)
        return {"Styled": held}, [] if child is None else [child]
    raise NodeError(f"not a node: {node}")


def with_children(node: dict, children: list) -> dict:
    """The node with other children."""
    own, _ = split(node)
    if "List" in own:
        return own | {"children": list(children)}
    if len(children) != int("Styled" in own):
        raise ChildrenMismatch(f"{len(children)} children for {own}")
    return {"Styled": own["Styled"] | {"child": children[0]}} if children else own


def is_atom(node: dict) -> bool:
    return "Text" in node


def line_of(node: dict) -> str:
    if "Text" not in node:
        raise WrongNodeType("only a text has a line")
    return node["Text"]


def layout_of(node: dict) -> str:
    if "List" not in node:
        raise WrongNodeType("only a list has a layout")
    return node["List"]


def styles_of(node: dict) -> tuple[str, list[str]]:
    """(Block or Span, its styles)."""
    if "Styled" not in node:
        raise WrongNodeType("only a style has styles")
    return next((k, list(v)) for k, v in node["Styled"].items() if k in ("Block", "Span"))


def in_memory(spark: SparkSession, nodes: list[tuple], edges: list[tuple]) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


#: The longest key and the longest value that a log holds, in bytes.
MOST_KEY, MOST_VALUE = 1 << 16, 1 << 24


class Store:
    """The change log in a folder. Commits are dicts: number, folder, first_seq, entries, commit_ts, merge."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._known: dict[int, dict] = {}

    # -- files

    def _at(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where, fs = self._at(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []

    def _create(self, name: str, text: str) -> bool:
        """Makes a file with its whole content, unless there is one of the name."""
        draft, fs = self._at(f"{os.path.dirname(name)}/_{uuid.uuid4().hex}")
        to, _ = self._at(name)
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.getScheme() != "file":
            made = not fs.exists(to) and fs.rename(draft, to)
        else:
            a, b = (unquote(urlparse(fs.makeQualified(x).toString()).path) for x in (draft, to))
            try:
                os.link(a, b)  # renaming would replace the other writer's file
                made = True
            except FileExistsError:
                made = False
        if not made or fs.getScheme() == "file":
            fs.delete(draft, False)
        return made

    def _text(self, name: str) -> str:
        where, fs = self._at(name)
        held = fs.open(where)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
        finally:
            held.close()

    # -- commits

    def commits(self) -> list[dict]:
        """The commits from the last merge on, oldest first. Files that were read before aren't read again."""
        numbers = sorted(int(n) for n in self._names("commits") if n.isdigit())
        out: list[dict] = []
        for number in reversed(numbers):
            if number not in self._known:
                self._known[number] = json.loads(self._text(f"commits/{number:020d}")) | {"number": number}
            out.append(self._known[number])
            if out[-1]["merge"]:
                break
        return out[::-1]

    def rows(self, commits: list[dict]) -> DataFrame:
        """The log's rows of some commits."""
        folders = [f"{self.path}/data/{c['folder']}" for c in commits if c["entries"]]
        return self.spark.read.schema(LOG).parquet(*folders) if folders else self.spark.createDataFrame([], LOG)

    def read(self) -> DataFrame:
        return self.rows(self.commits())

    def add(self, made: Callable[[list[dict], int], DataFrame | None], merge: bool = False) -> bool:
        """Commits the rows that `made` returns for the commits there are and the number that the first row gets.

        Where another writer has taken the number, `made` is asked again with
        that one's commit as well; it can raise an error to give up, or return
        None if there is nothing to commit.
        """
        while True:
            held = self.commits()
            last = held[-1] if held else {"number": -1, "first_seq": 0, "span": 0, "commit_ts": 0}
            first = last["first_seq"] + last["span"]
            rows = made(held, first)
            if rows is None:
                return False
            folder = uuid.uuid4().hex
            wrong = F.when(F.octet_length("key") > MOST_KEY, F.raise_error(F.lit("a key is too long"))).when(F.octet_length("value") > MOST_VALUE, F.raise_error(F.lit("a value is too long")))
            checked = rows.withColumn("key", F.coalesce(wrong.cast("string"), "key"))
            checked.select("slot", "key", "value", "is_removed", "commit_ts", "seq").write.parquet(f"{self.path}/data/{folder}")
            told = self.spark.read.schema(LOG).parquet(f"{self.path}/data/{folder}").agg(F.count("*").alias("n"), F.max("seq").alias("top"), F.max("commit_ts").alias("ts")).first()
            top = max(first, 0 if told["top"] is None else told["top"] + 1)
            said = {"folder": folder, "entries": told["n"], "first_seq": first, "span": top - first, "commit_ts": max(last["commit_ts"], told["ts"] or 0), "merge": merge}
            if self._create(f"commits/{last['number'] + 1:020d}", json.dumps(said)):
                return True
            self._delete(f"data/{folder}")

    def _delete(self, name: str) -> None:
        where, fs = self._at(name)
        fs.delete(where, True)

    # -- the folder

    def name(self) -> str:
        return self.path.rpartition("/")[2]

    def size(self) -> int:
        """Bytes of the commits that are read."""
        total = 0
        for c in self.commits():
            where, fs = self._at(f"data/{c['folder']}")
            total += fs.getContentSummary(where).getLength()
        return total

    def is_empty(self) -> bool:
        return not any(c["entries"] for c in self.commits())

    def truncate(self, number: int) -> None:
        """Takes back the commits from a number on, the last one first, so that what stays is always a whole log."""
        for n in sorted((int(x) for x in self._names("commits") if x.isdigit()), reverse=True):
            if n >= number:
                self._delete(f"commits/{n:020d}")
                self._known.pop(n, None)

    def clean(self) -> int:
        """Deletes what no reader of the present log needs: data and files of commits before the last merge, and of writers that failed. Only for a store that nobody writes."""
        held = self.commits()
        keep, first = {c["folder"] for c in held}, held[0]["number"] if held else 0
        gone = [f"data/{n}" for n in self._names("data") if n not in keep]
        gone += [f"commits/{n}" for n in self._names("commits") if not n.isdigit() or int(n) < first]
        for name in gone:
            self._delete(name)
        return len(gone)

    def purge(self) -> None:
        """Deletes the store."""
        self._delete("")
        self._known.clear()


def append(log: DataFrame, path: str) -> None:
    """Commits rows of a change log, as they are, to a store."""
    Store(log.sparkSession, path).add(lambda held, first: log)


def open_log(spark: SparkSession, path: str) -> DataFrame:
    return Store(spark, path).read()


def compact(spark: SparkSession, path: str, to: str) -> DataFrame:
    """Commits the merged log of a store to another one, and reads it."""
    from palimpsest.operators.log import merge

    append(merge(open_log(spark, path)), to)
    return open_log(spark, to)


def flatten(node: dict | str, ids=None) -> tuple[str, list[tuple], list[tuple]]:
    """(root id, node rows, edge rows) of a nested node: {"Text": line}, {"List": layout, "children": [...]}, {"Styled": {"Block" or "Span": styles, "child": node}}, or an id for a child that exists.

    A text with newlines becomes a page of its lines; a style without styles becomes its child.
    """
    ids = ids or (lambda: str(uuid.uuid4()))
    if isinstance(node, str):
        return str(uuid.UUID(node)), [], []
    nodes: list[tuple] = []
    edges: list[tuple] = []

    def add(n: dict | str) -> str:
        if isinstance(n, str):
            return str(uuid.UUID(n))
        if "Text" in n and "\n" in n["Text"]:
            return add({"List": "Page", "children": [{"Text": t} for t in n["Text"].split("\n")]})
        if "Styled" in n:
            kind, child = next(((k, n["Styled"][k]) for k in ("Block", "Span") if k in n["Styled"]), (None, None))
            if kind is None or "child" not in n["Styled"]:
                raise NodeError(f"not a style: {n}")
            if not child and not isinstance(n["Styled"]["child"], str):
                return add(n["Styled"]["child"])
            i = ids()
            nodes.append((i, "Styled", None, None, kind, list(child)))
            edges.append((i, 0, add(n["Styled"]["child"])))
            return i
        i = ids()
        if "Text" in n:
            nodes.append((i, "Text", n["Text"], None, None, None))
        elif n.get("List") in ("Chain", "Page"):
            nodes.append((i, "List", None, n["List"], None, None))
            edges.extend((i, k, add(c)) for k, c in enumerate(n.get("children", [])))
        else:
            raise NodeError(f"not a node: {n}")
        return i

    return add(node), nodes, edges


def texts_from_json(column: Column) -> Column:
    """The line of a serialized text node, null for other nodes; a line with a newline raises an error."""
    text = F.get_json_object(column, "$.Text")
    return F.when(F.contains(text, F.lit("\n")), F.raise_error(F.lit("a line can't contain a newline"))).otherwise(text)


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, json): each node with its children's ids, externally tagged."""
    lists = edges.groupBy("parent_id").agg(F.sort_array(F.collect_list(F.struct("child_index", "child_id"))).alias("c")).select(F.col("parent_id").alias("id"), F.col("c.child_id").alias("children"))
    held = nodes.join(lists, "id", "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
    said = F.to_json(F.struct(F.col("text").alias("Text")))
    styled = F.concat(F.lit('{"Styled":[{"'), F.col("style_kind"), F.lit('":'), F.to_json("styles"), F.lit('},"'), F.element_at(F.when(F.size("children") > 0, F.col("children")).otherwise(F.array(F.lit(""))), 1), F.lit('"]}'))
    listed = F.concat(F.lit('{"List":["'), F.col("layout"), F.lit('",'), F.to_json("children"), F.lit("]}"))
    return held.select("id", F.when(F.col("kind") == "Text", said).when(F.col("kind") == "List", listed).otherwise(styled).alias("json"))


def push_episode(nodes: DataFrame, edges: DataFrame, path: str, broadcast_id: str, episode_ts: int) -> None:
    """Writes an export as an episode: a folder that a stream reads as soon as it is there."""
    lists = edges.groupBy("parent_id").agg(F.sort_array(F.collect_list(F.struct("child_index", "child_id"))).alias("children")).withColumnRenamed("parent_id", "id")
    rows = nodes.join(lists, "id", "left").withColumn("broadcast_id", F.lit(broadcast_id)).withColumn("episode_ts", F.lit(episode_ts).cast("long"))
    rows.write.mode("overwrite").parquet(f"{path}/{broadcast_id}-{episode_ts}")


EPISODE = f"{NODES}, children array<struct<child_index: int, child_id: string>>, broadcast_id string, episode_ts long"


def episodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EPISODE).parquet(f"{path}/*")
