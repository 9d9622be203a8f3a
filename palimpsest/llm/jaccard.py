"""N-gram Jaccard join through a token-group matrix.

A text is the set of its distinct k-word shingles, hashed to 64 bits. Equal sets
become one node, kept with its SKETCH smallest hashes: what two sets share shows
in their sketches, since the smallest hashes of a union are a random sample of it.

1. Grouping. Every sketch token has a pivot, of the nodes that hold it the one
   that has most in common with others, and nodes are compared with their pivots
   only: a number of pairs in proportion to the tokens, however many nodes share
   one. Verified links make families, whose inner links can't change the result;
   nodes without a link form families with the pivot they are like. Families are
   cut into groups of about GROUP nodes, or of GROUP_TOKENS shingles.
2. Matrix. Rows (token, unit): the union of the tokens of a linked family, or of
   a group of any other one. Pairs of units count the tokens they share, and only
   pairs whose count reaches the bound that a link would imply are opened, those
   of several groups by the groups' own rows. A linked family is one row however
   large it is, and isn't joined with itself. An opened pair of groups is a tile
   that matrix products solve.
3. Tokens of more than HOT units are left out of the matrix, and the bound falls
   accordingly. Nodes that keep too few tokens (`rest`) are joined on their whole
   sets: a link implies that one of the rarest ninth of the smaller set's
   shingles is in the larger one. These meet as roots of components first, so a
   linked family counts once for a shingle here, too.

Every link is verified on whole sets. With w distinct shingles, sketches miss a
linked pair with a probability of at most the lower tail of Binomial(64, 0.8) at
24, about 1e-12 (about 1e-8 near the limit for hot tokens).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.components import components
from palimpsest.llm.hashing import U64, mix, shingle_sets
from palimpsest.plans.scratch import Scratch, free_name, if_few

SKETCH = 64
GROUP = 64
HOT = 48
#: From this share on, nodes that aren't linked with a pivot count as like it.
ALIKE = 0.3
#: Shingles of a group, 8 bytes each, if it has more than one node.
GROUP_TOKENS = 1 << 18
#: Cells of the matrix that is multiplied at once, 4 bytes each.
CELLS = 1 << 21


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, h1 and h2 (hashes of the text), n (size of the set), d1 and d2 (its digest), sketch (its smallest hashes): a row per row."""

    def work(batches):
        for b in batches:
            n, d1, d2, sketch, size = [], [], [], [], [0]
            for _, s in shingle_sets(b.column(1), k):
                n.append(len(s))
                for to, d in zip((d1, d2), _digest(s), strict=True):
                    to.append(d)
                sketch.append(s[:SKETCH])
                size.append(size[-1] + len(sketch[-1]))
            tokens = np.concatenate(sketch) if sketch else np.zeros(0, U64)
            digest = [pa.array(d, pa.int64()) for d in (d1, d2)]
            found = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(tokens.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(n, pa.int64()), *digest, found], ["doc_id", "h1", "h2", "n", "d1", "d2", "sketch"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2")).mapInArrow(work, "doc_id long, h1 long, h2 int, n long, d1 long, d2 long, sketch array<long>")


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes."""
    with np.errstate(over="ignore"):
        d = np.array([mix(s + U64(1)).sum(dtype=U64), mix(s ^ U64(0x9E3779B97F4A7C15)).sum(dtype=U64)], U64)
    return tuple(d.view(np.int64).tolist())


def whole_sets(docs: DataFrame, k: int) -> DataFrame:
    """name (the doc_id), n, d1 and d2 (the digest), hashes (sorted, binary)."""

    def work(batches):
        for b in batches:
            sets = [s for _, s in shingle_sets(b.column(1), k)]
            d1, d2 = zip(*map(_digest, sets), strict=True) if sets else ((), ())
            rows = [pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *rows], ["name", "n", "d1", "d2", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(work, "name long, n long, d1 long, d2 long, hashes binary")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, share, linked) of pairs (a, b) whose sizes don't rule out a link: intersection by union, and whether 100 * intersection >= percent * union."""

    def work(batches):
        for b in batches:
            share, linked = [], []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                both = np.concatenate((np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                share.append(same / (len(both) - same))
                linked.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(share, pa.float64()), pa.array(linked, pa.bool_())], ["a", "b", "share", "linked"])

    a, b = (sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("hashes").alias(f"s{c}")) for c in "ab")
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.join(a, "a").join(b, "b").where(near).select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long, share double, linked boolean")


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sets share: matrix products over as many hashes at once as CELLS allow."""
    tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.bincount(column, minlength=len(tokens)) > 1  # a hash that one set has adds to no intersection
    place = np.cumsum(held) - 1
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[held[column]]
    column = place[column[held[column]]]
    same = np.zeros((len(sets), len(sets)), np.float64)
    step = max(1, CELLS // len(sets))
    order = np.argsort(column, kind="stable") if held.sum() > step else np.arange(len(column))
    row, column = row[order], column[order]
    for first in range(0, int(held.sum()), step):
        a, b = (np.searchsorted(column, (first, first + step)) if held.sum() > step else (0, len(column)))
        has = np.zeros((len(sets), min(step, int(held.sum()) - first)), np.float32)
        has[row[a:b], column[a:b] - first] = 1
        same += has @ has.T
    return np.rint(same).astype(np.int64)


def _solved(percent: int):
    """Links of a tile's nodes (node, root, n, hashes) that join different components: of the links a spanning forest is returned."""

    def work(table: pa.Table) -> pa.Table:
        node, root, n = table["node"].to_numpy(), table["root"].to_numpy(), table["n"].to_numpy()
        i = j = np.zeros(0, np.int64)
        if len(np.unique(root)) > 1:
            same = _shared([np.frombuffer(h.as_buffer(), U64) for h in table["hashes"]])
            i, j = np.nonzero(np.triu((100 * same >= percent * (n[:, None] + n - same)) & (root[:, None] != root), 1))
        top, keep = {int(r): int(r) for r in root}, []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = int(root[x]), int(root[y])
            while top[a] != a:
                a = top[a]
            while top[b] != b:
                b = top[b]
            if a != b:
                top[max(a, b)] = min(a, b)
                keep.append((x, y))
        return pa.table({"a": pa.array([node[x] for x, _ in keep], pa.int64()), "b": pa.array([node[y] for _, y in keep], pa.int64())})

    return work


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.select("node", F.col("component").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _rest(rest: DataFrame, nodes: DataFrame, whole: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): the links of the nodes in `rest` (node) with nodes of other components; nodes: node, root; whole: node, n, hashes of all that can have a link.

    Two sets of sizes n <= m that link share at least percent / (100 + percent)
    of n + m, so at least that of 2 n: whatever order the shingles have, one of
    the first n less that many, and one more, of the smaller set is in the
    larger. The order is from rare to common among the sets of `rest`; shingles
    that none of these has come first, and so most other nodes have nothing to
    look up.
    """

    def exploded(batches):
        for b in batches:
            sets = [np.frombuffer(h.as_buffer(), np.int64) for h in b.column(2)]
            size = [len(x) for x in sets]
            at = np.repeat(np.arange(len(sets)), size)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))], ["node", "n", "token"])

    tokens = lambda df: df.select("node", "n", "hashes").mapInArrow(exploded, "node long, n long, token long")
    mine = whole.join(if_few(rest), "node", "left_semi")
    index = scratch.put(tokens(mine).groupBy("token").agg(F.count("*").alias("df")), "rest-index")
    hits = tokens(whole).join(if_few(index), "token")
    counted = F.col("c") * 100 >= F.lit(percent) * F.col("n")  # less can't link with any node of `rest`
    listed = hits.groupBy("node", "n").agg(F.count("*").alias("c"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t")).where(counted)
    flag = rest.withColumn("mine", F.lit(True))
    listed = listed.join(nodes.select("node", "root"), "node").join(if_few(flag), "node", "left")
    listed = scratch.put(listed.select("node", "n", "root", "c", F.col("t.token").alias("tokens"), F.coalesce("mine", F.lit(False)).alias("mine")), "rest-hits")
    need = F.ceil(F.lit(2 * percent) * F.col("n") / (100 + percent))
    first = F.col("n") - need + 1 - (F.col("n") - F.col("c"))  # places left after the shingles that `rest` doesn't have
    small = listed.where(first > 0).select("node", "n", "root", "mine", F.explode(F.slice("tokens", F.lit(1), F.least(first, F.col("c")).cast("int"))).alias("token"))
    large = listed.select("node", "n", "root", "mine", F.explode("tokens").alias("token"))
    sides = [df.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "root", "mine"))) for df, s in ((small, "x"), (large, "y"))]
    able = (F.col("root_x") != F.col("root_y")) & (F.col("mine_x") | F.col("mine_y"))
    each = [
        side.groupBy("token", f"root_{s}").agg(F.bool_or(f"mine_{s}").alias(f"mine_{s}"), F.min(f"n_{s}").alias(f"low_{s}"), F.max(f"n_{s}").alias(f"high_{s}"))
        for side, s in zip(sides, "xy", strict=True)
    ]
    fits = (100 * F.col("high_x") >= percent * F.col("low_y")) & (F.col("low_x") <= F.col("high_y"))
    roots = scratch.put(each[0].join(each[1], "token").where(able & fits).select("root_x", "root_y").distinct(), "rest-roots")
    sized = (F.col("n_x") <= F.col("n_y")) & (100 * F.col("n_x") >= percent * F.col("n_y")) & (F.col("mine_x") | F.col("mine_y"))
    pairs = roots.join(sides[0], "root_x").join(sides[1], ["root_y", "token"]).where(sized).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()
    found = compared(scratch.put(pairs, "rest-pairs"), whole, percent)
    return scratch.put(found.where("linked").select("a", "b"), "rest-links")


def _classes(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, h1, h2, n, d1, d2, sketch), and the distinct sets of those that have a doc_id: n, d1, d2, root (the same for all of a component), name (its smallest doc_id).

    A set's node is its smallest doc_id, or, for sets that share that with
    another set, as rows that repeat a doc_id can, a number made of its digest.
    """
    sets = scratch.put(sketches(docs, k), "sets")
    named = sets.where("n > 0 and doc_id is not null")
    classes = named.groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "sketch")).alias("first"))
    classes = scratch.put(classes.select(F.col("first.doc_id").alias("name"), "n", "d1", "d2", F.col("first.sketch").alias("sketch")), "named")
    sets = scratch.put(sets.drop("sketch"), "plain-sets")  # of all rows' sketches only those of distinct sets are read again
    scratch.drop("sets")
    named = sets.where("n > 0 and doc_id is not null")
    clash = scratch.put(classes.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name", F.lit(True).alias("clash")), "clash")
    clashes = not clash.isEmpty()
    if clashes:
        made = F.lit(-(1 << 62)) - F.col("d1").bitwiseAND(F.lit((1 << 62) - 1))
        classes = scratch.put(classes.join(if_few(clash), "name", "left").withColumn("node", F.when(F.col("clash"), made).otherwise(F.col("name"))).drop("clash"), "classes")
    else:
        classes = classes.withColumn("node", F.col("name"))

    # Nodes that may have a link: of their sketch, as many tokens as a link implies are in other sketches too.
    tokens = classes.select("node", F.explode("sketch").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    least = F.floor(0.375 * F.least(F.lit(SKETCH), F.col("n")))
    hits = scratch.put(tokens.join(shared, "token").select("token", "node", "df"), "hits")
    classes = scratch.put(classes.drop("sketch"), "plain-classes")
    scratch.drop("named")
    if clashes:
        scratch.drop("classes")
    # `common`: how much a node has in common with others; the original of a family has the most
    seen = hits.groupBy("node").agg(F.count("*").alias("c"), F.sum(F.log2("df")).alias("common")).join(classes.select("node", "n"), "node")
    able = scratch.put(seen.where((F.col("c") >= least) & (F.col("c") >= 1)), "able")
    rows = scratch.put(hits.select("token", "node").join(able.select("node", "n", "common"), "node"), "rows")
    scratch.drop("hits")
    chosen = scratch.put(classes.select("node", "name", "n", "d1", "d2").join(able.select("node"), "node", "left_semi"), "chosen")
    ids = chosen.select(F.col("name").alias("doc_id")).distinct()
    # a doc_id that rows repeat may have other sets, too
    whole = whole_sets(docs.join(if_few(ids), "doc_id", "left_semi"), k).join(if_few(chosen), ["name", "n", "d1", "d2"])
    whole = whole.select("node", "n", "hashes")
    if not named.groupBy("doc_id", "n", "d1", "d2").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        whole = whole.dropDuplicates(["node"])  # rows that repeat doc_id and text; where there are none, no set is shuffled
    whole = scratch.put(whole, "whole")

    best = F.min(F.struct((-F.col("common")).alias("o"), F.xxhash64("node").alias("o2"), F.col("node").alias("b"))).alias("p")
    pivots = scratch.put(rows.groupBy("token").agg(best).select("token", "p.b"), "pivots")
    met = rows.join(pivots, "token").where("node <> b").groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    pairs = met.where(F.col("c") >= F.greatest(F.lit(1), F.floor(0.1 * F.least(F.lit(SKETCH), F.col("n"))))).select("a", "b")
    alike = scratch.put(compared(scratch.put(pairs, "pairs"), whole, percent).where(F.col("share") >= ALIKE), "alike")
    scratch.drop("pairs")
    links = alike.where("linked").select("a", "b")
    roots = scratch.put(components(links, scratch, "cc-0"), "roots-0")

    # Units of the matrix: linked families whole, others in groups.
    now = _rooted(able, roots).join(roots.select("node", F.lit(True).alias("joined")), "node", "left").withColumn("joined", F.coalesce("joined", F.lit(False)))
    now = now.join(alike.groupBy(F.col("a").alias("node")).agg(F.max_by("b", F.struct("share", "b")).alias("like")), "node", "left")
    family = F.when(F.col("joined"), F.col("root")).otherwise(F.coalesce("like", "node"))
    now = scratch.put(now.withColumn("family", family).select("node", "n", "root", "joined", "family"), "families")
    parts = F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / GROUP_TOKENS)).alias("parts")
    sizes = scratch.put(now.groupBy("joined", "family").agg(parts), "sizes")
    name = F.concat_ws(".", F.when(F.col("joined"), "c").otherwise("f"), "family")
    group = F.concat_ws(".", name, F.pmod(F.xxhash64("node"), F.col("parts")))
    now = now.join(sizes, ["joined", "family"]).withColumn("group", group).withColumn("unit", F.when(F.col("joined"), name).otherwise(F.col("group")))
    now = scratch.put(now.select("node", "n", "root", "joined", "group", "unit", "parts"), "grouped")
    held = scratch.put(rows.select("token", "node").join(now.select("node", "group", "unit"), "node"), "held")
    scratch.drop("rows")
    hot = scratch.put(held.select("token", "unit").distinct().groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > HOT).select("token"), "hot")
    lost = held.join(if_few(hot), "token", "left_semi").groupBy("node").agg(F.count("*").alias("lost"))
    nodes = now.join(lost, "node", "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
    size = F.least(F.lit(SKETCH), F.col("n"))
    bound = F.greatest(F.lit(1), F.floor((size - F.col("lost")) * (0.375 - 0.69 * F.col("lost") / size)))
    nodes = scratch.put(nodes.withColumn("bound", bound), "nodes")
    prefix = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    rest = scratch.put(nodes.where((F.col("lost") > 0) & (size - F.col("lost") < F.least(F.lit(SKETCH // 2), prefix))).select("node"), "rest")
    cool = held.join(if_few(hot), "token", "left_anti")

    def told(key: str) -> DataFrame:
        """What the nodes of a unit or group have in common."""
        return nodes.groupBy(key).agg(F.min("bound").alias("bound"), F.min("n").alias("low"), F.max("n").alias("high"), F.first("joined").alias("joined"), F.max("parts").alias("parts"), F.count("*").alias("size"))

    def sides(df: DataFrame, key: str) -> list[DataFrame]:
        return [df.select(*(F.col(c).alias(c if c == "token" else f"{c}_{s}") for c in df.columns)) for s in "xy"]

    units = scratch.put(told("unit"), "units")
    x, y = sides(cool.select("token", "unit").distinct().join(units, "unit"), "unit")
    sized = (100 * F.col("high_y") >= percent * F.col("low_x")) & (100 * F.col("high_x") >= percent * F.col("low_y"))
    several = (F.col("unit_x") < F.col("unit_y")) | ((F.col("unit_x") == F.col("unit_y")) & ~F.col("joined_x") & (F.col("size_x") > 1))
    split = (F.col("joined_x") & (F.col("parts_x") > 1)) | (F.col("joined_y") & (F.col("parts_y") > 1))
    shares = x.join(y, "token").where(several & sized).groupBy("unit_x", "unit_y").agg(F.count("*").alias("c"), F.min(F.least("bound_x", "bound_y")).alias("bound"), F.first(split).alias("split"))
    opened = scratch.put(shares.where("c >= bound").select("unit_x", "unit_y", "split"), "opened-units")
    grouped = nodes.select("unit", "group").distinct()
    a, b = (grouped.select(*(F.col(c).alias(f"{c}_{s}") for c in grouped.columns)) for s in "xy")
    plain = opened.where("not split").join(a, "unit_x").join(b, "unit_y").select("group_x", "group_y")
    x, y = sides(cool.select("token", "unit", "group").distinct().join(told("group").drop("joined", "parts", "size"), "group"), "group")
    wide = opened.where("split").join(x, "unit_x").join(y, ["unit_y", "token"]).where(sized).groupBy("group_x", "group_y").agg(F.count("*").alias("c"), F.min(F.least("bound_x", "bound_y")).alias("bound"))
    tiles = scratch.put(plain.unionAll(wide.where("c >= bound").select("group_x", "group_y")), "opened")
    scratch.drop("held")
    if not tiles.isEmpty():
        each = tiles.select("*", F.explode(F.array_distinct(F.array("group_x", "group_y"))).alias("group"))
        members = nodes.select("node", "root", "group").join(whole, "node")
        members = each.join(members, "group").select("group_x", "group_y", "node", "root", "n", "hashes")
        links = links.unionAll(scratch.put(members.groupBy("group_x", "group_y").applyInArrow(_solved(percent), "a long, b long"), "opened-links"))
    if not rest.isEmpty():
        links = links.unionAll(_rest(rest, nodes, whole, percent, scratch))
    roots = scratch.put(components(links, scratch, "cc"), "roots")
    told = _rooted(classes.select("node", "name", "n", "d1", "d2"), roots)
    if not clashes:
        return sets, scratch.put(told.select("n", "d1", "d2", "root", F.col("root").alias("name")), "told")
    told = scratch.put(told.select("n", "d1", "d2", "root", F.col("name").alias("own")), "rooted")
    return sets, scratch.put(told.join(told.groupBy("root").agg(F.min("own").alias("name")), "root").select("n", "d1", "d2", "root", "name"), "told")


def _plain(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def near_duplicates(spark: SparkSession, documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `documents` (doc_id, text).

    A-Z are lower-cased; words are runs of anything but ASCII white space; a text
    of fewer than k words has one shingle, its whole sequence; a null or empty
    text has none, is linked with nothing and is its own component. Rows that
    repeat a doc_id are judged each by its own text. A null doc_id is never a
    component's name; its row gets the component of its text's other copies, or
    null. An empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(spark, "jaccard")
    sets, told = _classes(_plain(documents), k, percent, scratch)
    return sets.select("doc_id", "n", "d1", "d2").join(told, ["n", "d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("name", "doc_id").alias("component_id"))


def first_of_each(spark: SparkSession, documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`documents` with one row of each group of near-duplicates, with all columns: one of smallest doc_id, rows without one coming last.

    Rows are told apart by doc_id and text. Rows that repeat both are copies, of
    which any one stays. Rows without a doc_id are joined with equal texts only.
    Rows without words stay.
    """
    scratch = Scratch(spark, "jaccard-first")
    sets, told = _classes(_plain(documents), k, percent, scratch)
    rows = sets.where("n > 0").groupBy("doc_id", "h1", "h2", "n", "d1", "d2").agg(F.count("*").alias("copies")).join(told, ["n", "d1", "d2"], "left")
    # a component's root, or the set's digest where no row of it has a doc_id
    rows = scratch.put(rows.select("doc_id", "h1", "h2", "copies", F.struct("root", F.when(F.col("root").isNull(), F.struct("n", "d1", "d2")).alias("own")).alias("group")), "rows")
    key = F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "h1", "h2")
    won = rows.groupBy("group").agg(F.min(key).alias("w"), F.sum("copies").alias("size")).where("size > 1")
    judged = rows.join(won, "group").select("doc_id", "h1", "h2", "copies", (key == F.col("w")).alias("stays"))
    judged = scratch.put(judged.where("not stays or copies > 1"), "judged")
    a, b, c = (free_name(documents, x) for x in ("own_id", "own_h1", "own_h2"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (F.xxhash64(F.col("text").cast("string")) == F.col(b)) & (F.hash(F.col("text").cast("string")) == F.col(c))
    named = [df.select(F.col("doc_id").alias(a), F.col("h1").alias(b), F.col("h2").alias(c)) for df in (judged, judged.where("stays"))]
    kept = documents.join(if_few(named[0]), same, "left_anti")
    if named[1].isEmpty():
        return kept
    return kept.unionAll(documents.join(if_few(named[1]), same, "left_semi").dropDuplicates(["doc_id", "text"]))
