"""Substring dedup: seed and extend over winnowed anchors.

A window is `window` consecutive words; it is removed from every document but
the one with the smallest id that holds it. Of the k-word grams of a window the
one with the smallest hash is its anchor, so two documents that share a window
share its anchor (Schleimer et al., 2003) and only anchors, about one word in
five, are compared across the corpus:

1. Seed. Anchors meet by hash; those found in two documents or more are shared.
2. Extend. Around its shared anchors a document is extended to both sides up to
   the length threshold; what the extensions of two documents have in common is
   found by the hashes of their windows and not pair by pair, as a passage in n
   documents would have n * n pairs. Windows that a smaller document holds too
   are repeats, and adjacent ones merge into maximal repeats.
3. Cut. Each document drops the words of its maximal repeats.

Entries travel in blobs, one per bucket for about DEAL entries of a task. Documents
there that share an entry are settled at once, and only one of them is sent on to
meet the others, so a passage found in a third of all documents loads no bucket.
Rows without a doc_id take no part and aren't shuffled; rows that repeat a doc_id
so often that their texts fill buckets are spread over buckets of their own, all
of which get that document's entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.hashing import EXACT, SPACE, U64, gram_hashes, slices, word_hashes, word_spans
from palimpsest.plans.scratch import Scratch, free_name

K = 5
#: Bytes of text for each bucket, and the smallest number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 1 << 24, 512
#: Entries that a task gathers before it deals them out.
DEAL = 1 << 17
BLOB = "bucket long, entries binary"
#: hash, document, whether it is settled already
ENTRY = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("settled", "?")])


def _bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    """As `_bucket`; hashes are taken as signed integers."""
    u = x.astype(np.int64).view(U64)
    return (u ^ (u >> U64(15)) ^ (u >> U64(31))).view(np.int64) % buckets


def _bucket(x: Column, buckets: int) -> Column:
    return F.pmod(x.bitwiseXOR(F.shiftrightunsigned(x, 15)).bitwiseXOR(F.shiftrightunsigned(x, 31)), F.lit(buckets))


def _blobs(entries: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket, entries = bucket[order], entries[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(first, len(bucket))[1:]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array([entries[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())], ["bucket", "entries"])


def _entries(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["entries"].to_pylist()), ENTRY)


def _sorted(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by hash and document, first index and size of each hash."""
    entries = entries[np.lexsort((entries["doc"], entries["hash"]))]
    first = np.flatnonzero(np.concatenate(([True], entries["hash"][1:] != entries["hash"][:-1]))[: len(entries)])
    return entries, first, np.diff(np.append(first, len(entries)))


def _deal(hashes: np.ndarray, docs: np.ndarray, buckets: int, smaller_only: bool) -> pa.RecordBatch:
    """Blobs of a batch's distinct (hash, document). Of documents that share a hash, the smallest is sent to meet
    others and the rest (all of them unless smaller_only) are settled, and go to buckets by their ids."""
    e = np.zeros(len(hashes), ENTRY)
    e["hash"], e["doc"] = hashes, docs
    e, first, size = _sorted(e)
    fresh = np.concatenate(([True], (e["hash"][1:] != e["hash"][:-1]) | (e["doc"][1:] != e["doc"][:-1])))
    e, first, size = _sorted(e[fresh])
    meet, settled = e[first], e[np.repeat(size > 1, size)] if not smaller_only else np.delete(e, first)
    settled["settled"] = True
    both = np.concatenate((meet, settled))
    return _blobs(both, np.concatenate((_bucket_of(meet["hash"], buckets), _bucket_of(settled["doc"], buckets))))


def _anchors(words: np.ndarray, at: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, each window's anchor position, and the hashes of all grams; at: word offsets of the texts."""
    grams = gram_hashes(words, k)
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    inside = np.zeros(n, bool)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= window:
            inside[a : b - window + 1] = True
    starts = np.flatnonzero(inside)
    wide = window - k + 1
    best, where = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, wide):
        other = grams[j : n + j]
        less = other < best
        best[less], where[less] = other[less], j
    return starts, starts + where[starts], grams


def _hashed(texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, data, offs in slices(texts):
        a, b, at = word_spans(data, offs)
        yield i, j, word_hashes(data, a, b, EXACT), at


def _seeds(window: int, k: int, buckets: int):
    def work(batches):
        hashes, docs, held = [], [], 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, _, words, at in _hashed(b.column(1)):
                _, anchors, grams = _anchors(words, at, window, k)
                anchors = anchors[np.diff(anchors, prepend=-1) > 0]
                hashes.append(grams[anchors])
                docs.append(ids[i + np.searchsorted(at[1:], anchors, "right")])
                held += len(anchors)
                if held >= DEAL:
                    yield _deal(np.concatenate(hashes), np.concatenate(docs), buckets, False)
                    hashes, docs, held = [], [], 0
        if held:
            yield _deal(np.concatenate(hashes), np.concatenate(docs), buckets, False)

    return work


def _met(buckets: int, smaller_only: bool, hot: dict[int, tuple[int, int]]):
    """Per bucket of hashes: the entries that another document holds too (a smaller one, if smaller_only), dealt to the documents' buckets."""
    names = np.array(sorted(hot), np.int64)
    first, parts = (np.array([hot[n][k] for n in sorted(hot)], np.int64) for k in (0, 1))

    def work(table: pa.Table) -> pa.Table:
        e = _entries(table)
        settled, e = e[e["settled"]], e[~e["settled"]]
        found = settled
        if len(e):
            e, start, size = _sorted(e)
            least = np.repeat(e["doc"][start], size)
            most = np.repeat(e["doc"][start + size - 1], size)
            fresh = np.concatenate(([True], (e["hash"][1:] != e["hash"][:-1]) | (e["doc"][1:] != e["doc"][:-1])))
            found = np.concatenate((settled, e[fresh & (e["doc"] > least if smaller_only else least < most)]))
        bucket = _bucket_of(found["doc"], buckets)
        if len(names) and len(found):
            at = np.minimum(np.searchsorted(names, found["doc"]), len(names) - 1)
            spread = names[at] == found["doc"]
            own, times = found[spread], parts[at[spread]]
            places = np.repeat(first[at[spread]] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
            found, bucket = np.concatenate((found[~spread], np.repeat(own, times))), np.concatenate((bucket[~spread], places))
        return pa.Table.from_batches([_blobs(found, bucket)])

    return work


def _of_docs(table: pa.Table) -> dict[int, np.ndarray]:
    """Sorted hashes per document."""
    e = _entries(table)
    if not len(e):
        return {}
    e = e[np.lexsort((e["hash"], e["doc"]))]
    docs, first = np.unique(e["doc"], return_index=True)
    return dict(zip(docs.tolist(), np.split(e["hash"], first[1:]), strict=True))


def _among(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    at = np.searchsorted(held, x)
    at[at == len(held)] = 0
    return held[at] == x


def _extended(window: int, k: int, buckets: int, own_id: str):
    def work(texts: pa.Table, shared: pa.Table) -> pa.Table:
        known, hashes, docs = _of_docs(shared), [], []
        if not known:
            return pa.table({"bucket": pa.array([], pa.int64()), "entries": pa.array([], pa.binary())})
        ids = texts[own_id].to_pylist()
        for i, j, words, at in _hashed(texts["text"]):
            starts, anchors, grams = _anchors(words, at, window, k)
            long = gram_hashes(words, window)
            cut = np.searchsorted(starts, at)
            for r in range(i, j):
                held, a, b = known.get(ids[r]), cut[r - i], cut[r - i + 1]
                if held is not None and b > a:
                    own = starts[a:b][_among(grams[anchors[a:b]], held)]
                    hashes.append(long[own])
                    docs.append(np.full(len(own), ids[r]))
        out = _deal(np.concatenate(hashes), np.concatenate(docs), buckets, True) if any(map(len, hashes)) else None
        return pa.Table.from_batches([out] if out is not None else [], pa.schema([("bucket", pa.int64()), ("entries", pa.binary())]))

    return work


def _kept(data: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, gone: np.ndarray) -> pa.Array:
    """Per text, its words that aren't gone, joined by one space."""
    keep = np.flatnonzero(~gone)
    last = np.diff(np.searchsorted(at, keep, "right"), append=-1) != 0  # no space follows a text's last word
    edge = np.zeros(len(data) + 2, np.int8)
    edge[starts[keep]] += 1
    edge[ends[keep] + ~last] -= 1
    mask = np.cumsum(edge[: len(data)], dtype=np.int8).view(bool)
    out = data[mask]
    out[SPACE[out]] = 32
    sizes = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask, out=sizes[1:])
    return pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(sizes[offs]), pa.py_buffer(out))


SPAN = pa.struct([("first", pa.int64()), ("words", pa.int64())])
RESULT = "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<first: long, words: long>>"


def _cuts(texts, ids: list, known: dict[int, np.ndarray], window: int) -> dict[str, pa.ChunkedArray]:
    """n_words, n_removed, kept and repeats of a column of texts, given the repeated windows of their documents."""
    out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": [], "repeats": []}
    for i, j, data, offs in slices(texts):
        starts, ends, at = word_spans(data, offs)
        gone, repeats = np.zeros(len(starts), bool), [[] for _ in range(i, j)]
        rows = [r for r in range(i, j) if at[r - i + 1] - at[r - i] >= window and ids[r] in known]
        if rows:
            long = gram_hashes(word_hashes(data, starts, ends, EXACT), window)
        for r in rows:
            a, b = at[r - i], at[r - i + 1]
            hit = np.flatnonzero(_among(long[a : b - window + 1], known[ids[r]]))
            edge = np.zeros(b - a + 1, np.int32)
            edge[hit] += 1
            edge[hit + window] -= 1
            gone[a:b] = np.cumsum(edge)[:-1] > 0
            turn = np.flatnonzero(np.diff(gone[a:b], prepend=False, append=False))
            repeats[r - i] = [{"first": int(p), "words": int(q - p)} for p, q in zip(turn[::2], turn[1::2], strict=True)]
        removed = np.concatenate(([0], np.cumsum(gone)))
        out["n_words"].append(pa.array(np.diff(at), pa.int64()))
        out["n_removed"].append(pa.array(removed[at[1:]] - removed[at[:-1]], pa.int64()))
        out["kept"].append(_kept(data, offs, starts, ends, at, gone).cast(pa.string()))
        out["repeats"].append(pa.array(repeats, pa.list_(SPAN)))
    types = (pa.int64(), pa.int64(), pa.string(), pa.list_(SPAN))
    return {k: pa.chunked_array(v, t) for (k, v), t in zip(out.items(), types, strict=True)}


def _solve(spark: SparkSession, documents: DataFrame, window: int, k: int, out: str, told) -> DataFrame:
    """told(table of rows, its cuts) for every bucket of documents that have a doc_id, as a DataFrame of schema `out`."""
    own_id, key = free_name(documents, "own_id"), free_name(documents, "bucket")
    named = documents.where(F.col("doc_id").cast("long").isNotNull()).withColumn(own_id, F.col("doc_id").cast("long"))
    named = named.withColumn("text", F.col("text").cast("string"))
    sizes = Scratch(spark, "substrings").put(named.groupBy(F.col(own_id).alias("id")).agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")))
    size = sizes.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, size // BUCKET_BYTES) | 1  # odd, as ids are often multiples of two
    hot, after = {}, buckets
    for r in sizes.where((F.col("rows") > 1) & (F.col("bytes") > 2 * BUCKET_BYTES)).orderBy("id").collect():  # a row for so many bytes of text
        hot[r["id"]] = (after, -(-r["bytes"] // BUCKET_BYTES))
        after += hot[r["id"]][1]
    seeds = named.select(own_id, "text").mapInArrow(_seeds(window, k, buckets), BLOB)
    shared = seeds.groupBy("bucket").applyInArrow(_met(buckets, False, hot), BLOB)
    texts = named.withColumn(key, _bucket(F.col(own_id), buckets).cast("long"))
    if hot:
        first, parts = free_name(texts, "hot_first"), free_name(texts, "hot_parts")
        spread = spark.createDataFrame([(i, *v) for i, v in hot.items()], f"{own_id} long, {first} long, {parts} long")
        own = F.col(first) + F.pmod(F.xxhash64("text", own_id), F.col(parts))
        texts = texts.join(F.broadcast(spread), own_id, "left").withColumn(key, F.coalesce(own, key)).drop(first, parts)
    repeated = texts.groupBy(key).cogroup(shared.groupBy("bucket")).applyInArrow(_extended(window, k, buckets, own_id), BLOB)
    repeated = repeated.groupBy("bucket").applyInArrow(_met(buckets, True, hot), BLOB)

    def cut(rows: pa.Table, entries: pa.Table) -> pa.Table:
        return told(rows, rows[own_id], _cuts(rows["text"], rows[own_id].to_pylist(), _of_docs(entries), window))

    return texts.groupBy(key).cogroup(repeated.groupBy("bucket")).applyInArrow(cut, out)


def dedup(spark: SparkSession, documents: DataFrame, window: int = 13, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed, kept, repeats for every row of `documents` (doc_id, text).

    Words are runs of anything but ASCII white space, compared unchanged. Each
    word is removed that a window of `window` words covers which also starts in
    a document with a smaller doc_id, before anything is removed there. `kept`
    joins the other words by one space; `repeats` are the maximal removed runs,
    (first word, words). A null or empty text has no words. Rows that repeat a
    doc_id don't count as smaller than each other, and lose each what of their
    own text either would; rows without a doc_id keep all their words and take
    none from others. An empty table gives an empty result; other columns are
    not read.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def told(rows: pa.Table, ids: pa.ChunkedArray, cuts: dict) -> pa.Table:
        return pa.table({"doc_id": ids, **cuts})

    def alone(batches):
        for b in batches:
            for part in pa.table({"doc_id": b.column(0), **_cuts(b.column(1), b.column(0).to_pylist(), {}, window)}).to_batches():
                yield part

    rest = docs.where("doc_id is null").mapInArrow(alone, RESULT)
    return _solve(spark, docs, window, k, RESULT, told).unionAll(rest)


def cut(spark: SparkSession, documents: DataFrame, window: int = 13, k: int = K) -> DataFrame:
    """`documents` without the words that `dedup` removes, each row by its own text; all columns stay.

    A text that loses nothing stays as it is, one that loses all is empty.
    """
    names = documents.columns

    def told(rows: pa.Table, ids: pa.ChunkedArray, cuts: dict) -> pa.Table:
        lost = pc.greater(cuts["n_removed"], 0)
        i = rows.schema.get_field_index("text")
        text = pc.if_else(lost, cuts["kept"], rows["text"].cast(pa.string()))
        return rows.set_column(i, "text", text).select(names)

    docs = documents.withColumn("text", F.col("text").cast("string"))
    return _solve(spark, docs, window, k, docs.schema, told).unionAll(docs.where(F.col("doc_id").cast("long").isNull()))
