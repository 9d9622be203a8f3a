"""Near-duplicate embeddings by lattice hashing.

Each table projects a unit vector to eight dimensions at random and decodes it
to the nearest point of the E8 lattice; vectors of one label that share a point
are candidates. A vector looks into its own cell and into the nearest of the 240
neighbouring cells. All candidates are verified by the cosine in double
precision, so nothing below the threshold is ever linked; the tables and probes
only decide how many true links are met (see `recall`).

Vectors travel in groups: those of one cell of the first table, at most about
GROUP of them. Cells have a row per group, candidates are pairs of groups, and
each pair is verified once, as a tile: one matrix product, of which the numbers
of links and a spanning forest are kept. A family of n near copies makes
(n / GROUP) ** 2 / 2 tiles, and none of its n * n links is a row.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.components import components
from palimpsest.llm.hashing import mix
from palimpsest.plans.scratch import Scratch, if_few


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out)


SHORTEST = _shortest()


def _even(z: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of even sum."""
    r = np.rint(z)
    gap = z - r
    worst = np.abs(gap).argmax(1)
    rows = np.arange(len(z))
    odd = r.sum(1) % 2 != 0
    step = np.where(gap[rows, worst] >= 0, 1.0, -1.0)
    r[rows[odd], worst[odd]] += step[odd]
    return r


def decode(z: np.ndarray) -> np.ndarray:
    """Nearest E8 points of the rows of z."""
    a, b = _even(z), _even(z - 0.5) + 0.5
    nearer = ((z - b) ** 2).sum(1) < ((z - a) ** 2).sum(1)
    return np.where(nearer[:, None], b, a)


def probe(z: np.ndarray, more: int) -> np.ndarray:
    """(rows, 1 + more, 8): the decoded point, then the neighbours of it that are nearest to z."""
    c = decode(z)
    if not more:
        return c[:, None, :]
    near = np.argpartition(-((z - c) @ SHORTEST.T), more - 1, axis=1)[:, :more]
    return np.concatenate([c[:, None, :], c[:, None, :] + SHORTEST[near]], 1)


def projections(dim: int, tables: int, seed: int = 8) -> np.ndarray:
    """(tables, dim, 8) Gaussian matrices, the same for every worker."""
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((tables, dim, 8))


def recall(cosine: float, scale: float, tables: int, more: int, trials: int = 20_000, dim: int = 64, seed: int = 1) -> float:
    """Share of pairs of a given cosine that are met, by simulation."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((trials, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((trials, dim))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = cosine * x + np.sqrt(1 - cosine**2) * y
    met = np.zeros(trials, bool)
    for a in projections(dim, tables):
        p, q = probe(scale * x @ a, more), probe(scale * y @ a, more)
        met |= (p == q[:, :1]).all(2).any(1) | (q == p[:, :1]).all(2).any(1)
    return float(met.mean())


#: (scale, tables, neighbours), the same at every size, so no row changes which other pairs are met. Simulated recall at a cosine of 0.93 is 0.9994; from 0.96 on it is 1.
SETTING = (1.15, 10, 24)
#: Of 64 random sign bits, a pair of cosine 0.93 differs in 7.6 on average; more than this many is beyond six standard deviations.
MOST_BITS = 24


#: Vectors of a group.
GROUP = 64


def _cells(x: np.ndarray, label: np.ndarray, table: int, a: np.ndarray, more: int, scale: float) -> np.ndarray:
    """(rows, 1 + more) hashes of label, table and the cells that a vector is in and looks into."""
    salt = np.random.Generator(np.random.PCG64(99)).integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
    cells = np.rint(2 * probe(scale * (x @ a), more)).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        own = mix(label.astype(np.int64).view(np.uint64)[:, None] * np.uint64(2 * x.shape[1] + 1) + np.uint64(table))
        return mix((cells * salt).sum(2) + own)


def _by_width(b: pa.RecordBatch, column: int):
    """(rows, their units as a matrix) of each width."""
    raw = b.column(column).to_pylist()
    size = np.array([len(r) // 8 for r in raw], np.int64)
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield rows, np.frombuffer(b"".join(raw[i] for i in rows)).reshape(len(rows), dim)


def grouped(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """group, node, label, size, unit of `vectors` (node, label, size, unit), sorted by group; a group has one label and one width."""
    scale, tables, _ = SETTING

    def work(batches):
        for b in batches:
            home = np.zeros(b.num_rows, np.uint64)
            label = b.column(1).to_numpy()
            for rows, x in _by_width(b, 3):
                home[rows] = _cells(x, label[rows], 0, projections(x.shape[1], tables)[0], 0, scale)[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home.view(np.int64))], [*b.schema.names, "home"])

    placed = vectors.select("node", "label", "size", "unit").mapInArrow(work, "node long, label long, size long, unit binary, home long")
    placed = scratch.put(placed, "placed")
    cell = ["label", "width", "home"]
    keys = placed.select("node", "label", F.octet_length("unit").alias("width"), "home")
    counts = keys.groupBy(*cell).agg(F.ceil(F.count("*") / GROUP).alias("parts")).where("parts > 1")
    dealt = keys.join(if_few(counts), cell, "left").select("node", *cell, F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(F.lit(0)).alias("part"))
    named = dealt.groupBy(*cell, "part").agg(F.min("node").alias("group"), F.count("*").alias("members"))
    dealt = scratch.put(dealt.join(named, [*cell, "part"]).select("node", "group", "members"), "dealt")
    out = placed.join(dealt, "node").select("group", "members", "node", "label", "size", "unit")
    return scratch.put(out.repartition("group").sortWithinPartitions("group", "node"), "groups")


def links(spark: SparkSession, vectors: DataFrame, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, others): of how many other vectors each node is linked with the class, counted by `size`; and (a, b), a < b: links that connect all that is linked.

    `vectors` has node (long, distinct), label, size and unit (binary float64, length 1).
    """
    scale, tables, more = SETTING
    members = grouped(vectors, scratch)

    def keys(probes: int):
        """Rows (cell, group, signs) of the cells that vectors are in, and of `probes` more that they look into."""

        def work(batches):
            for b in batches:
                group, label = b.column(0).to_numpy(), b.column(1).to_numpy()
                for rows, x in _by_width(b, 2):
                    dim = x.shape[1]
                    bits = x @ np.random.Generator(np.random.PCG64(7)).standard_normal((dim, 64)) > 0
                    sign = np.packbits(bits, axis=1).view(">u8").astype(np.uint64).ravel().view(np.int64)
                    for t, a in enumerate(projections(dim, tables)):
                        cells = _cells(x, label[rows], t, a, probes, scale).view(np.int64)
                        flat, of = cells.ravel(), np.repeat(np.arange(len(rows)), cells.shape[1])
                        own = group[rows][of]
                        order = np.lexsort((own, flat))
                        flat, of, own = flat[order], of[order], own[order]
                        first = np.flatnonzero(np.concatenate(([True], (flat[1:] != flat[:-1]) | (own[1:] != own[:-1]))))
                        signs = pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)), pa.int32()), pa.array(sign[of]))
                        yield pa.RecordBatch.from_arrays([pa.array(flat[first]), pa.array(own[first]), signs], ["cell", "group", "signs"])

        return work

    found = members.select("group", "label", "unit")
    schema = "cell long, group long, signs array<long>"
    homes = scratch.put(found.mapInArrow(keys(0), schema), "homes")
    home = homes.select("cell", F.col("group").alias("a"), F.col("signs").alias("s"))
    # most cells that are looked into are empty: where the others are few, these rows go before the shuffle
    visit = found.mapInArrow(keys(more), schema).join(if_few(homes.select("cell").distinct()), "cell", "left_semi")
    visit = visit.select("cell", F.col("group").alias("b"), F.col("signs").alias("z"))
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= MOST_BITS
    single = (F.size("s") == 1) & (F.size("z") == 1)
    alike = F.when(single, near(F.col("s")[0], F.col("z")[0])).otherwise(F.exists("s", lambda x: F.exists("z", lambda y: near(x, y))))
    pairs = home.join(visit, "cell").where((F.col("a") != F.col("b")) & alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    whole = members.where("members > 1").select(F.col("group").alias("a"), F.col("group").alias("b"))
    pairs = scratch.put(pairs.unionAll(whole).distinct(), "pairs")
    blob = members.groupBy("group").agg(F.min("label").alias("label"), F.sort_array(F.collect_list(F.struct("node", "size", "unit"))).alias("rows"))
    blob = scratch.put(blob.select("group", "label", F.col("rows.node").alias("nodes"), F.col("rows.size").alias("sizes"), F.col("rows.unit").alias("units")), "blobs")
    left, right = (blob.select(*(F.col(c).alias(f"{c}_{x}") for c in blob.columns)) for x in "ab")
    tiles = pairs.join(left.withColumnRenamed("group_a", "a"), "a").join(right.withColumnRenamed("group_b", "b"), "b").where("label_a = label_b")

    def solve(batches):
        top: dict[int, int] = {}  # of the task's vectors, so that a forest over all its tiles is kept

        def find(a: int) -> int:
            while (up := top.get(a, a)) != a:
                top[a] = top.get(up, up)
                a = top[a]
            return a

        for b in batches:
            count: dict[int, int] = {}
            forest: list[tuple[int, int]] = []
            for nodes, sizes, units, nodes2, sizes2, units2 in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(units[0]) != len(units2[0]):
                    continue
                x, y = (np.frombuffer(b"".join(u)).reshape(len(u), -1) for u in (units, units2))
                hit = x @ y.T >= threshold
                same = nodes[0] == nodes2[0]
                if same:
                    hit = np.triu(hit, 1)
                if not hit.any():
                    continue
                for own, others in ((nodes, hit @ np.array(sizes2)), (nodes2, hit.T @ np.array(sizes))):
                    for i in np.flatnonzero(others):
                        count[own[i]] = count.get(own[i], 0) + int(others[i])
                for i, j in zip(*(k.tolist() for k in np.nonzero(hit)), strict=True):
                    p, q = find(nodes[i]), find(nodes2[j])
                    if p != q:
                        top[max(p, q)] = min(p, q)
                        forest.append((nodes[i], nodes2[j]))
            a, c = [*count, *(min(f) for f in forest)], [*count.values(), *[None] * len(forest)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([*[None] * len(count), *(max(f) for f in forest)], pa.int64()), pa.array(c, pa.int64())], ["a", "b", "others"])

    solved = tiles.select("nodes_a", "sizes_a", "units_a", "nodes_b", "sizes_b", "units_b").mapInArrow(solve, "a long, b long, others long")
    solved = scratch.put(solved, "solved")
    degree = solved.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("others"))
    return degree, solved.where("b is not null").select("a", "b")


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding, label).

    Equal vectors of a label are linked through one representative and never
    expanded into pairs. Vectors that are null, empty, zero or hold a null or a
    value that isn't finite, and rows without a label, have no links. Rows that
    repeat a vec_id count as one vector, the smallest by (label, embedding), and
    all get its result; a null vec_id has no links and no component and isn't
    kept. Other
    columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "lattice")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    one = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")

    def unit(batches):
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for i, label, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if label is None or not v or None in v:
                    continue
                x = np.array(v)
                most = np.abs(x).max()
                if not np.isfinite(most) or most == 0:
                    continue
                x = x / most
                for to, value in zip(out, (i, label, hashlib.blake2b(np.array(v).tobytes(), digest_size=16).digest(), (x / np.sqrt(np.dot(x, x))).tobytes()), strict=True):
                    to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["vec_id", "label", "same", "unit"])

    able = scratch.put(one.mapInArrow(unit, "vec_id long, label long, same binary, unit binary"), "units")
    classes = scratch.put(able.groupBy("label", "same").agg(F.min("vec_id").alias("node"), F.count("*").alias("size")), "classes")
    nodes = classes.join(able.select(F.col("vec_id").alias("node"), "unit"), "node").select("node", "label", "size", "unit")
    degree, found = links(spark, nodes, threshold, scratch)
    roots = components(found, scratch)
    told = scratch.put(classes.join(degree, "node", "left").join(roots, "node", "left").select("label", "same", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "told")
    result = able.select("vec_id", "label", "same").join(told, ["label", "same"]).select("vec_id", "n_links", "component_id")
    out = rows.select("vec_id").join(result, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
