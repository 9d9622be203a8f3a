"""Best-fit packing of tokenized documents, planned on the histogram of lengths.

Tokenizing is the cost, so it happens once: each text becomes rows of (piece,
start, length, CRC of its ids), which are written to the shared folder. Only the
histogram of lengths, at most `capacity` rows, reaches the driver. Best fit runs
there over counts: a sequence opens with the longest length left and takes the
longest that fits until none does, and that pattern repeats as often as the
counts allow, so each pattern uses up a length and there are few patterns. A
piece then gets its rank within its length and takes the slot planned for that
rank. Lengths are dealt out in chunks, so a length that a third of all pieces
have is spread over many tasks.
"""

from __future__ import annotations

import re
import zlib
from array import array
from base64 import b64decode
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.plans.scratch import Scratch

CAPACITY = 2048


class Encoder:
    """Ids of the tokenizer file as little-endian unsigned 32-bit bytes.

    The ranks file holds the same vocabulary for a faster library; a text that
    spells a special token, or has a run of white space so long that the faster
    one's pattern overflows its stack, goes to the tokenizer file's own library.
    """

    #: The faster library failed at 1,000,000 blanks and passed 700,000.
    blanks = re.compile(r"\s{200000}")

    def __init__(self, json_path: str, ranks_path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks_path, "rb") as lines:
            ranks = {b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.json_path, self.whole = json_path, None
        self.plain = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if "<|endoftext|>" in text or (len(text) >= 200_000 and self.blanks.search(text)):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.json_path)
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.plain.encode_ordinary(text)).tobytes()


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(json_path: str, ranks_path: str) -> Encoder:
    if (json_path, ranks_path) not in _encoders:
        _encoders[json_path, ranks_path] = Encoder(json_path, ranks_path)
    return _encoders[json_path, ranks_path]


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first takes what is over."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def pieces(docs: DataFrame, json_path: str, ranks_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, lot (a number that a task counts): one row per piece of a text's ids with `end_id` after them."""

    def work(batches):
        enc, end, lot = encoder(json_path, ranks_path), array("I", [end_id]).tobytes(), 0
        for b in batches:
            rows = ([], [], [], [], [], [])
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.encode(text.as_py() or "") + end
                for k, (s, n) in enumerate(cut_points(len(ids) // 4, capacity)):
                    for to, v in zip(rows, (doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), lot), strict=True):
                        to.append(v)
                    lot += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "lot"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long, lot long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit over counts: ([(length, offset)...], how many sequences look like this), which use up all counts."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths, out = sorted(left), []
    while lengths:
        used: dict[int, int] = {}
        slots, at = [], 0
        while True:
            i = bisect_right(lengths, capacity - at) - 1
            while i >= 0 and used.get(lengths[i], 0) >= left[lengths[i]]:
                i -= 1
            if i < 0:
                break
            n = lengths[i]
            slots.append((n, at))
            used[n] = used.get(n, 0) + 1
            at += n
        times = min(left[n] // k for n, k in used.items())
        out.append((slots, times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                lengths.remove(n)
    return out


def slots_by_length(planned: list[tuple[list[tuple[int, int]], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Per length: first rank and first sequence of each pattern that has it, and the offsets it has there."""
    out: dict[int, tuple[list, list, list]] = {}
    taken: dict[int, int] = {}
    base = 0
    for slots, times in planned:
        offsets: dict[int, list[int]] = {}
        for n, at in slots:
            offsets.setdefault(n, []).append(at)
        for n, at in offsets.items():
            a, b, c = out.setdefault(n, ([], [], []))
            a.append(taken.get(n, 0))
            b.append(base)
            c.append(np.array(at, np.int64))
            taken[n] = taken.get(n, 0) + len(at) * times
        base += times
    return {n: (np.array(a, np.int64), np.array(b, np.int64), c) for n, (a, b, c) in out.items()}


def pack(spark: SparkSession, docs: DataFrame, json_path: str, ranks_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A null or empty text is the end id alone. A text of more than `capacity`
    tokens is cut into pieces of `capacity`, of which the first may be shorter.
    Rows that repeat a doc_id are packed each for itself; an empty table gives
    an empty result. Sequences are filled from offset 0 without gaps.
    """
    scratch = Scratch(spark, "packing")
    rows = scratch.put(pieces(docs, json_path, ranks_path, end_id, capacity), "pieces")
    total = rows.count()
    chunks = max(64, total >> 16)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "lot"), F.lit(chunks)))  # also rows that repeat both are spread
    counts = rows.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    by_length = slots_by_length(plan(histogram, capacity))  # at most `capacity` lengths and about as many patterns
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    order = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "start", "ids_crc32")  # rows that are equal in all may change places
    ranked = rows.withColumn("rank", F.row_number().over(order)).join(first, ["length", "chunk"]).select(*own, (F.col("first") + F.col("rank") - 1).alias("rank"))

    def place(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                firsts, bases, offsets = by_length[int(n)]
                rows = np.flatnonzero(length == n)
                seg = np.searchsorted(firsts, rank[rows], "right") - 1
                for s in np.unique(seg):
                    at = rows[seg == s]
                    r = rank[at] - firsts[s]
                    seq[at] = bases[s] + r // len(offsets[s])
                    off[at] = offsets[s][r % len(offsets[s])]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
