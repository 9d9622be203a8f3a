"""Exact top-k search by a Voronoi join.

Vectors are grouped by the nearest of a number of pivots that grows with the
data up to MOST_PIVOTS, which bounds only what workers hold. Whole cells that lie
near each other make shards of about SHARD rows, the keys of the join; a larger
cell is cut into several. First a query is solved in the shard that has its own
cell, which gives a score that its k-th best can't fall below. Then it goes to
the other shards that may hold something better: inner products with a cell's
rows are bounded by its pivot and radius, q.s <= q.p + |q| radius. Within a shard
the same bound passes over tiles. Equal vectors are multiplied once. What is
replicated is the queries, the smaller side, in packs, once for each shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.plans.scratch import Scratch, if_few

#: Rows of a tile, of a shard, and pivots of each width.
TILE = 2048
SHARD = 1 << 17
MOST_PIVOTS = 2048
#: Queries that are multiplied at once, in a pack, and that one task holds.
AT_ONCE = 256
PACK = 1024
HELD = 1 << 19
#: Components and scores beyond this are set to it; LEAST is below all scores.
LARGEST = 2.0**62
LEAST = -(1 << 62) - 1
FOUND = "query_id long, key long, vec_id long, score long"


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, dim, v: floor(scale * x) of each component, at most LARGEST either way, as binary int16, or int64 if one doesn't fit; vectors that are null, or hold a null or a value that isn't finite, are left out."""

    def work(batches):
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            size = pa.compute.list_value_length(lists).fill_null(-1).to_numpy()
            begin = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null is not a number
            able = ids.is_valid().to_numpy(zero_copy_only=False)
            for d in np.unique(size[(size >= 0) & able]):
                at = np.flatnonzero((size == d) & able)
                x = values[begin[at][:, None] + np.arange(d)]
                whole = np.isfinite(x).all(1)
                at, x = at[whole], x[whole]
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(scale * x), -LARGEST, LARGEST).astype(np.int64)
                narrow = (x == x.astype(np.int16)).all(1)
                for some, kind in ((narrow, np.int16), (~narrow, np.int64)):
                    if some.any():
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[some])), pa.array(np.full(int(some.sum()), d, np.int64)), _binary(x[some].astype(kind))], ["vec_id", "dim", "v"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(work, "vec_id long, dim long, v binary")


def _binary(x: np.ndarray) -> pa.Array:
    """A binary value for each row."""
    x = np.ascontiguousarray(x)
    at = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(x.tobytes())])


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """The vectors of a column of binaries, int16 if all are."""
    wide = pa.compute.binary_length(column).to_numpy() > 2 * d
    if not wide.any():
        return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(len(column), d)
    out = np.empty((len(column), d), np.int64)
    for some, kind in ((wide, np.int64), (~wide, np.int16)):
        at = np.flatnonzero(some)
        out[at] = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), kind).reshape(len(at), d)
    return out


def search(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k rows of highest integer inner product, ties to the smaller vec_id.

    Queries are the rows for which `is_query` (over vec_id) holds; candidates are
    all rows with another vec_id and equally many components. Fewer than k
    candidates are all returned, and an empty table gives none. Rows without a
    vec_id take no part. Rows that repeat one are candidates each, and queries
    each: every query row has its own k results, equal ones for equal rows.
    Scores beyond 64 bits are set to the largest.
    """
    scratch = Scratch(spark, "voronoi")
    rows = scratch.put(quantized(vectors, scale), "rows")
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row per width
    # about a pivot per tile of rows, by hash: at most about MOST_PIVOTS vectors of each width reach the driver
    wanted = {d: min(MOST_PIVOTS, max(1, n // TILE)) for d, n in counts.items()}
    lot = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40))
    shares = [(d, int((1 << 40) * min(1.0, (2 * wanted[d] + 16) / n)) + 1) for d, n in counts.items()]
    shares = spark.createDataFrame(shares or [(0, 0)], "dim long, share long")
    drawn: dict[int, list[bytes]] = {d: [] for d in counts}
    for r in rows.withColumn("lot", lot).join(F.broadcast(shares), "dim").where("lot < share").select("dim", "lot", "v").distinct().orderBy("dim", "lot", "v").collect():
        if len(drawn[r["dim"]]) < wanted[r["dim"]]:
            drawn[r["dim"]].append(bytes(r["v"]))
    pivots = {d: _matrix(pa.array(v, pa.binary()), d).astype(np.float64) if v else np.zeros((1, d)) for d, v in drawn.items()}

    def assign(batches):
        for b in batches:
            dim = b.column(1).to_numpy()
            for d in np.unique(dim):
                at = pa.array(np.flatnonzero(dim == d))
                x, p = _matrix(b.column(2).take(at), int(d)), pivots[int(d)]
                kind = np.float32 if max(np.abs(x).max(initial=0), np.abs(p).max(initial=0)) < 1 << 20 else np.float64
                near = x.astype(kind) @ p.T.astype(kind)
                near -= ((p**2).sum(1) / 2).astype(kind)
                cell = near.argmax(1)
                far = np.sqrt(((x - p[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cell.astype(np.int64)), pa.array(far), b.column(2).take(at)], ["vec_id", "dim", "cell", "far", "v"])

    types = "vec_id long, dim long, cell long, far double, v binary"
    # a query's own rows may be among the best, and aren't candidates: of equal vectors, so many rows may be asked for
    owners = rows.where(is_query).groupBy("vec_id", "dim").agg(F.count("*").alias("own")).where("own > 1")
    need = k + (owners.agg(F.max("own").alias("own")).first()["own"] or 1)
    same = Window.partitionBy("hash", "dim", "v").orderBy("vec_id")
    kept = rows.withColumn("hash", F.xxhash64("v")).withColumn("r", F.row_number().over(same)).where(F.col("r") <= need)  # cut within each partition first
    dealt = scratch.put(kept.select("vec_id", "dim", "v").mapInArrow(assign, types), "dealt")

    held: dict[int, dict[int, tuple[int, float]]] = {d: {} for d in counts}
    for r in dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect():  # a row per pivot
        held[r["dim"]][r["cell"]] = r["n"], r["radius"]
    most = min(SHARD, max(TILE, sum(n for own in held.values() for n, _ in own.values()) // (2 * spark.sparkContext.defaultParallelism)))
    shards: list[tuple[int, int, int, int]] = []  # dim, cell, its first shard, its number of shards
    names: dict[int, tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = {}  # cells and radii by width, and the places among these of each of its shards
    last = 0
    for d, own in held.items():
        p = pivots[d]
        lead = p[: max(1, sum(n for n, _ in own.values()) // most)]
        group = ((lead**2).sum(1) / 2 - p @ lead.T).argmin(1)
        cells = sorted(own, key=lambda c: (group[c], c))
        of: dict[int, list[int]] = {}
        full = most
        for j, c in enumerate(cells):
            parts = -(-own[c][0] // most)
            if full + own[c][0] > most:
                last, full = last + 1, 0
            shards.append((d, c, last, parts))
            for s in range(last, last + parts):
                of.setdefault(s, []).append(j)
            full += own[c][0]
            last += parts - 1
        names[d] = np.array(cells, np.int64), np.array([own[c][1] for c in cells]), [(s, np.array(js)) for s, js in of.items()]
    sizes = F.broadcast(spark.createDataFrame(shards or [(0, 0, 0, 1)], "dim long, cell long, shard long, parts long"))  # a row per pivot
    put = lambda df: df.join(sizes, ["dim", "cell"]).withColumn("shard", F.col("shard") + F.pmod(F.xxhash64("v"), F.col("parts")))
    placed = put(dealt).select("shard", "dim", "cell", "vec_id", "v")
    asked = put(rows.where(is_query).select("vec_id", "dim", "v").distinct().mapInArrow(assign, types))
    asked = scratch.put(asked.select("shard", "dim", "vec_id", F.xxhash64("v").alias("key"), "v"), "asked")

    def bounds(q: np.ndarray, d: int, cells: np.ndarray, radius: np.ndarray) -> np.ndarray:
        x, p = q.astype(np.float64), pivots[d][cells]
        length = np.sqrt((x**2).sum(1))[:, None]
        return np.maximum(x @ p.T + length * radius * (1 + 1e-9) + 1e-9 * (1 + length * (1 + np.abs(p).max(initial=0)) * (d + 1)), -LARGEST)

    def solved(d: int, ids: np.ndarray, keys: np.ndarray, floors: np.ndarray, q: np.ndarray, table: pa.Table) -> pa.Table:
        """The rows of a shard that may be among the k best of queries."""
        tiles = _tiles(table["cell"].to_numpy(), table["vec_id"].to_numpy(), _matrix(table["v"], d), pivots[d])
        out: list[tuple] = []
        for at in range(0, len(ids), AT_ONCE):
            some = slice(at, at + AT_ONCE)
            best = bounds(q[some], d, np.array([t[0] for t in tiles], np.int64), np.array([t[1] for t in tiles]))
            row, vec, score = _best(k, need, ids[some], floors[some], q[some], tiles, best)
            out.append((ids[some][row], keys[some][row], vec, score))
        out = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("query_id", "key", "vec_id", "score"), out, strict=True)))

    none = pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "key", "vec_id", "score")})

    def own(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return none
        d = left["dim"][0].as_py()
        return solved(d, left["vec_id"].to_numpy(), left["key"].to_numpy(), np.full(len(left), LEAST), _matrix(left["v"], d), right)

    first = scratch.put(asked.groupBy("shard").cogroup(placed.groupBy("shard")).applyInArrow(own, FOUND), "first")
    floor = first.groupBy(F.col("query_id").alias("vec_id"), "key").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
    asked = asked.join(floor, ["vec_id", "key"], "left").select("shard", "dim", "vec_id", "key", F.coalesce("floor", F.lit(LEAST)).alias("floor"), "v")

    def route(batches):  # packs of queries to the other shards that may hold one of their best
        for b in batches:
            dim = b.column(1).to_numpy()
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                cells, radius, of = names[int(d)]
                for pack in np.split(at, range(PACK, len(at), PACK)):
                    shard, _, ids, keys, floors, v = (c.take(pa.array(pack)) for c in b.columns)
                    shard, ids, keys, floors, q = shard.to_numpy(), ids.to_numpy(), keys.to_numpy(), floors.to_numpy(), _matrix(v, int(d))
                    may = bounds(q, int(d), cells, radius) >= floors[:, None]
                    out: list[tuple] = []
                    for s, js in of:
                        go = may[:, js].any(1) & (shard != s)
                        if go.any():
                            out.append((int(d), s, ids[go].tobytes(), keys[go].tobytes(), floors[go].tobytes(), q[go].tobytes()))
                    kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["dim", "shard", "ids", "keys", "floors", "q"])

    def others(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return none
        d = left["dim"][0].as_py()
        parts: list[list] = [[], [], [], []]
        for ids, keys, floors, q in zip(*(left[c].to_pylist() for c in ("ids", "keys", "floors", "q")), strict=True):
            n = len(ids) // 8
            kind = np.int64 if len(q) > 2 * d * n else np.int16
            for to, x in zip(parts, (np.frombuffer(ids, np.int64), np.frombuffer(keys, np.int64), np.frombuffer(floors, np.int64), np.frombuffer(q, kind).reshape(n, d)), strict=True):
                to.append(x)
        return solved(d, *(np.concatenate(p) for p in parts), right)

    lots = -(-max(1, asked.count()) // HELD)  # tasks for a shard, each with a part of the queries
    packs = asked.mapInArrow(route, "dim long, shard long, ids binary, keys binary, floors binary, q binary").withColumn("lot", F.pmod(F.xxhash64("ids"), F.lit(lots).cast("long")))
    more = packs.groupBy("shard", "lot").cogroup(placed.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long")))).groupBy("shard", "lot")).applyInArrow(others, FOUND)
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    best = first.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if owners.isEmpty():
        return best.select("query_id", "rank", "vec_id", "score")
    copies = asked_copies(rows, is_query)
    return best.join(if_few(copies), ["query_id", "key"], "left").select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)))).alias("copy")).drop("copy")


def asked_copies(rows: DataFrame, is_query: Column) -> DataFrame:
    """query_id, key, copies of the query rows that are equal."""
    return rows.where(is_query).groupBy(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("key")).agg(F.count("*").alias("copies")).where("copies > 1")


def _tiles(cell: np.ndarray, ids: np.ndarray, s: np.ndarray, pivots: np.ndarray) -> list[tuple]:
    """(cell, radius, different vectors, their greatest component, where each one's ids begin, ids) of TILE vectors of one cell at most."""
    with np.errstate(over="ignore"):
        mark = s.astype(np.int64) @ np.random.default_rng(0).integers(-(1 << 62), 1 << 62, s.shape[1])
    order = np.lexsort((ids, mark, cell))
    cell, ids, s = cell[order], ids[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (cell[1:] != cell[:-1]) | (s[1:] != s[:-1]).any(1)
    begin = np.flatnonzero(new)
    out = []
    for own in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(cell[begin])) + 1):
        for at in range(0, len(own), TILE):
            some = own[at : at + TILE]
            x, c = s[begin[some]], int(cell[begin[some[0]]])
            end = begin[some[-1] + 1] if some[-1] + 1 < len(begin) else len(ids)
            radius = float(np.sqrt(((x - pivots[c]) ** 2).sum(1).max()))
            largest = float(np.abs(x.astype(np.float64)).max(initial=0))
            out.append((c, radius, _floats(x, largest), largest, np.append(begin[some], end) - begin[some[0]], ids[begin[some[0]] : end]))
    return out


def _floats(x: np.ndarray, largest: float) -> np.ndarray:
    """Floats that hold inner products of vectors with such components, if there are any, else the integers."""
    bound = x.shape[1] * largest * largest
    return x.astype(np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64)


def _best(k: int, need: int, own: np.ndarray, floors: np.ndarray, q: np.ndarray, tiles: list[tuple], bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of a query, vec_id, score): k rows of a query at most, none below its floor, other than those with its own id."""
    floors = floors.copy()
    largest = float(np.abs(q.astype(np.float64)).max(initial=0))
    x = _floats(q, largest)
    held = [np.zeros(0, np.int64)] * 3
    fresh: list[list[np.ndarray]] = [[], [], []]

    def merged():
        row, vec, score = (np.concatenate([a, *b]) for a, b in zip(held, fresh, strict=True))
        order = np.lexsort((vec, -score, row))
        row, vec, score = row[order], vec[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        last = rank == k - 1
        floors[row[last]] = np.maximum(floors[row[last]], score[last])
        held[:] = row[rank < k], vec[rank < k], score[rank < k]
        for f in fresh:
            f.clear()

    for t, (_, _, s, most, begin, ids) in enumerate(tiles):
        go = np.flatnonzero(bound[:, t] >= floors)
        if not len(go):
            continue
        a = x if len(go) == len(x) else x[go]
        score = a @ s.T if a.dtype == s.dtype == np.float32 else _products(a, s, largest, most)
        least = floors[go]
        blank = np.flatnonzero(least == LEAST)
        if len(blank) and need < len(s):  # nothing is known yet: what is as good as the tile's own best, ties included
            least[blank] = np.partition(score[blank], len(s) - need, 1)[:, len(s) - need].astype(np.int64)
        i, j = np.divmod(_where((score >= least.astype(score.dtype)[:, None]).ravel()), len(s))
        if not len(i):
            continue
        many = begin[j + 1] - begin[j]
        vec = ids[np.arange(int(many.sum())) + np.repeat(begin[j] - (np.cumsum(many) - many), many)]
        row, score = np.repeat(go[i], many), np.repeat(score[i, j].astype(np.int64), many)
        other = vec != own[row]
        for f, v in zip(fresh, (row[other], vec[other], score[other]), strict=True):
            f.append(v)
        if len(blank) or sum(map(len, fresh[0])) > 4 * len(q):
            merged()
    merged()
    return held[0], held[1], held[2]


def _where(some: np.ndarray) -> np.ndarray:
    """Where booleans, few of which are true, are true: eight are looked at at once."""
    whole = len(some) // 8 * 8
    at = (8 * np.flatnonzero(some[:whole].view(np.uint64))[:, None] + np.arange(8)).ravel()
    return np.concatenate([at[some[at]], whole + np.flatnonzero(some[whole:])])


def _products(q: np.ndarray, s: np.ndarray, most_q: float, most_s: float) -> np.ndarray:
    """Inner products of all rows: exact, by way of floats where these hold them, and at most LARGEST either way."""
    bound = q.shape[1] * most_q * most_s
    if bound < 2**53:
        return q.astype(np.float64) @ s.T.astype(np.float64)
    q, s = q.astype(np.int64), s.astype(np.int64)
    if bound < 2**63:
        return q @ s.T
    return np.clip(q.astype(object) @ s.T.astype(object), -int(LARGEST), int(LARGEST)).astype(np.int64)
