"""Personal data by fixed forms, and more of it by bootstrapped contextual extraction.

Seeds are the entities of the four fixed forms, and long hexadecimal strings,
which only keys and digests are. Every seed, and every other word that looks like
an identifier, is an instance; its patterns are the words around it: one or two
before it, one behind it, one on both sides, or the key that it is assigned to
within its own word. The graph of patterns and instances is scored in rounds:

- a pattern's confidence is what the instances in its place score, over all its
  occurrences in the corpus, whatever stands there: words that stand before
  anything lose, and those that introduce identifiers win;
- an instance's score joins the confidence of all trusted patterns around it with
  what is known of other instances of its shape. What reaches the threshold is
  known in the next round, and so lends support to further patterns.

Instances that are known in the end are marked, wherever they stand, with the
kind `id`. Patterns are 64-bit hashes of words in lower case without punctuation.
The graph only has rows for identifiers, and stays distributed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import hashing as H
from palimpsest.plans.scratch import FEW, Scratch, free_name, if_few

#: The kinds in their order, and the found kind after them.
KINDS = ("email", "ip", "card", "phone")
FOUND = "id"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match that begins inside a run of digits could have begun with the run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'`.,;:!?()[]{}<>*#%&$|+-_"


def luhn(digits: str) -> bool:
    """Whether the digits pass the check that card numbers pass."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by kind, then start: leftmost matches that don't overlap within a kind."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


#: At least so many hexadecimal digits, letters and decimals both, are a key or a digest.
_HEX = re.compile(r"(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{32,}")
_RUN = re.compile(r"[0-9]+|[a-z]+|[A-Z]+|[^0-9a-zA-Z]")

#: Letters and digits count in a pattern, A-Z as a-z; other ASCII characters don't.
_SPELLED = H.LOWER.copy()
_SPELLED[[b for b in range(128) if not chr(b).isalnum()]] = 0
#: What makes the hashes of the five kinds of patterns differ.
LEFT, LEFT2, RIGHT, AROUND, KEY = (np.uint64(x) for x in (1, 2, 3, 4, 5))


def _two(a: np.ndarray, b: np.ndarray, kind: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return H.mix(a * H.STEP[0] + b * H.STEP[1] + kind)


def _one(a: np.ndarray, kind: np.uint64) -> np.ndarray:
    return _two(a, np.zeros(1, H.U64), kind)


def _assigned(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with a = or : inside, and where the first of these is."""
    marks = np.flatnonzero((data == 61) | (data == 58))
    word = np.searchsorted(starts, marks, "right") - 1
    word, first = np.unique(word, return_index=True)
    marks = marks[first]
    inner = (marks > starts[word]) & (marks + 1 < ends[word])
    return word[inner], marks[inner]


def contexts(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The patterns of all places for one word in some texts: of each kind, the hashes."""
    starts, ends, at = H.word_spans(data, offs)
    w = H.word_hashes(data, starts, ends, _SPELLED)
    head = np.zeros(len(w) + 1, bool)  # words that begin a text
    head[at] = True
    inner = ~head[1:-1] if len(w) else head[:0]  # word i + 1 follows word i
    after = np.flatnonzero(inner)  # a word is before place after + 1
    both = after[:-1][np.diff(after) == 1] if len(after) else after  # words i, i + 1, i + 2 of one text
    word, mark = _assigned(data, starts, ends)
    keys = H.word_hashes(data, starts[word], mark, _SPELLED)
    return [_one(w[after], LEFT), _two(w[both], w[both + 1], LEFT2), _one(w[after + 1], RIGHT), _two(w[both], w[both + 2], AROUND), _one(keys, KEY)]


def shape(instance: str) -> str:
    """How an instance looks: its runs of digits, small and capital letters with their lengths, hexadecimal strings as one."""
    if _HEX.fullmatch(instance):
        return f"hex{len(instance)}"
    kinds = lambda m: m if not m.isalnum() else ("9" if m[0].isdigit() else "a" if m[0].islower() else "A") + str(min(len(m), 9))
    return "".join(kinds(m) for m in _RUN.findall(instance[:64])) or "other"


def instances(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """start, end, instance, shape, base, seed and patterns of the base spans and of the other identifier-like words."""
    if not base and not _DIGIT.search(text):
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in words]
    found = []  # start, end, whether it is a base span
    taken = sorted((a, b) for _, a, b in base)
    for a, b in words:
        word = text[a:b]
        if not _DIGIT.search(word):
            continue
        cut = min((i for i in (word.find("="), word.find(":")) if i > 0), default=-1)
        lead = cut + 1 if 0 < cut < len(word) - 1 and word[:cut].strip(_EDGE).isalpha() else 0
        value = word[lead:]
        x = a + lead + len(value) - len(value.lstrip(_EDGE))
        value = value.strip(_EDGE)
        digits = len(_DIGIT.findall(value))
        if not (len(value) >= 6 and digits >= 2 or len(value) >= 10 and digits):
            continue
        i = bisect_left(taken, (x + len(value), 0))
        if not any(p < x + len(value) and x < q for p, q in taken[max(0, i - 16) : i]):
            found.append((x, x + len(value), False))
    found += [(a, b, True) for a, b in taken]
    if not found:
        return []
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    byte_starts, byte_ends, _ = H.word_spans(data, np.array([0, len(data)]))
    w = H.word_hashes(data, byte_starts, byte_ends, _SPELLED)
    keys: dict[int, int] = {}
    for i, m in zip(*_assigned(data, byte_starts, byte_ends), strict=True):
        keys[int(i)] = int(m)
    out = []
    for a, b, fixed in found:
        i, j = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        own = []
        if i >= 1:
            own.append(_one(w[i - 1 : i], LEFT))
        if i >= 2:
            own.append(_two(w[i - 2 : i - 1], w[i - 1 : i], LEFT2))
        if j + 1 < len(w):
            own.append(_one(w[j + 1 : j + 2], RIGHT))
            if i >= 1:
                own.append(_two(w[i - 1 : i], w[j + 1 : j + 2], AROUND))
        if i in keys and a > starts[i]:
            own.append(_one(H.word_hashes(data, byte_starts[i : i + 1], np.array([keys[i]]), _SPELLED), KEY))
        value = text[a:b]
        out.append({"start": a, "end": b, "instance": value.lower(), "shape": shape(value), "base": fixed, "seed": fixed or bool(_HEX.fullmatch(value)), "patterns": [int(p.view(np.int64)[0]) for p in own]})
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SEEN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("shape", pa.string()), ("base", pa.bool_()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.int64()))])
SPANS = "array<struct<kind: string, start: long, end: long>>"


def _key(text: Column) -> tuple[Column, Column]:
    """128 bits of a text."""
    return F.xxhash64(text), F.xxhash64(F.lit("text"), text)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, h1 and h2 (a text's 128 bits), base (its spans), seen (its instances): a row per row of (doc_id, text)."""

    def work(batches):
        for b in batches:
            base, seen = [], []
            for t in b.column(1):
                t = t.as_py() or ""
                own = base_spans(t)
                base.append([{"kind": k, "start": x, "end": y} for k, x, y in own])
                seen.append(instances(t, own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(base, pa.list_(_SPAN)), pa.array(seen, pa.list_(_SEEN))], ["doc_id", "h1", "h2", "base", "seen"])

    h1, h2 = _key(F.col("text"))
    schema = f"doc_id long, h1 long, h2 long, base {SPANS}, seen array<struct<start: long, end: long, instance: string, shape: string, base: boolean, seed: boolean, patterns: array<long>>>"
    return docs.select("doc_id", "text", h1.alias("h1"), h2.alias("h2")).mapInArrow(work, schema)


def totals(docs: DataFrame, wanted: DataFrame, most: int = FEW) -> DataFrame:
    """(pattern, total): how often the texts have each of the `wanted` patterns (pattern), whatever stands in its place.

    Up to `most` patterns are looked up where the texts are; with more, all
    patterns of the texts are counted and joined.
    """
    held = [r["pattern"] for r in wanted.limit(most + 1).collect()]  # 8 bytes each
    among = np.sort(np.array(held, np.int64)) if len(held) <= most else None

    def each(batches):
        for b in batches:
            for _, _, data, offs in H.slices(b.column(0)):
                yield np.concatenate(contexts(data, offs)).view(np.int64)

    def rows(pattern: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n.astype(np.int64))], ["pattern", "n"])

    def looked_up(batches):  # a task's counts are one array, and leave it once
        n = np.zeros(len(among) + 1, np.int64)
        for found in each(batches):
            at = np.searchsorted(among, found)
            at[at == len(among)] = 0
            n += np.bincount(at[among[at] == found] if len(among) else [], minlength=len(n))
        had = np.flatnonzero(n)
        yield rows(among[had], n[had])

    def all_of(batches):
        for found in each(batches):
            yield rows(*np.unique(found, return_counts=True))

    work = looked_up if among is not None else all_of
    counted = docs.select("text").mapInArrow(work, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    return counted if among is not None else counted.join(wanted, "pattern", "left_semi")


def bootstrap(seen: DataFrame, docs: DataFrame, scratch: Scratch, rounds: int = 3, trust: float = 0.6, support: int = 5) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (pattern, confidence) and known instances (instance, score) of the graph of `seen` (instance, shape, base, seed, patterns).

    Seeds weigh 1 as teachers, other instances their score if it reaches `trust`.
    A pattern's confidence is the sum of these weights over its places, over one
    more than its occurrences in `docs`; it is trusted from `trust` on, with at
    least `support` distinct instances that weigh something. A score is 3/4 of
    1 - the product of (1 - confidence) over the trusted patterns of all places
    of an instance, and 1/4 of the share of known instances among those of its
    shape. Hexadecimal seeds are scored as well: without a trusted pattern none is
    known. What is a base span anywhere has the score 1. Instances that are base
    spans everywhere need no mark and aren't returned. Scores and confidence are rounded to nine digits, so that no order of summing decides.
    """
    nodes = seen.groupBy("instance").agg(F.min("shape").alias("shape"), F.max("seed").alias("seed"), F.max("base").alias("base"), F.min("base").alias("only"))
    nodes = scratch.put(nodes, "nodes")
    edges = scratch.put(seen.select("instance", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.count("*").alias("n")), "edges")
    wide = edges.groupBy("pattern").agg(F.count("*").alias("c")).where(F.col("c") >= support).select("pattern")
    total = scratch.put(totals(docs, scratch.put(wide, "wide")), "totals")
    edges = scratch.put(edges.join(if_few(total.select("pattern")), "pattern", "left_semi"), "able")
    weight = scratch.put(nodes.select("instance", F.col("seed").cast("double").alias("w")), "weight-0")
    patterns = known = None
    for r in range(rounds):
        taught = edges.join(weight.where("w > 0"), "instance").groupBy("pattern").agg(F.sum(F.col("n") * F.col("w")).alias("s"), F.count("*").alias("backed"))
        rated = taught.where(F.col("backed") >= support).join(total, "pattern").select("pattern", F.round(F.col("s") / (F.col("total") + 1), 9).alias("confidence"))
        patterns = scratch.put(rated.where(F.col("confidence") >= trust), f"patterns-{r}")
        looks = scratch.put(nodes.join(weight, "instance").groupBy("shape").agg((F.sum("w") / (F.count("*") + 1)).alias("alike")), f"looks-{r}")
        lent = edges.join(if_few(patterns), "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999999)))))).alias("lent"))
        score = F.round(0.75 * F.col("lent") + 0.25 * F.coalesce("alike", F.lit(0.0)), 9)
        known = nodes.join(lent, "instance").join(if_few(looks), "shape", "left").select("instance", score.alias("score")).where(F.col("score") >= trust)
        known = scratch.put(known, f"known-{r}")
        weight = nodes.select("instance", "seed").join(known, "instance", "left")
        weight = scratch.put(weight.select("instance", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("w")), f"weight-{r + 1}")
    told = nodes.where("not only").select("instance", "base").join(known, "instance", "left")
    return patterns, scratch.put(told.select("instance", F.when(F.col("base"), 1.0).otherwise(F.col("score")).alias("score")).where("score is not null"), "known")


def _learned(docs: DataFrame, scratch: Scratch, rounds: int, trust: float, support: int) -> tuple[DataFrame, DataFrame]:
    """The scanned rows, each with a number of its own, and the known instances."""
    rows = scratch.put(scan(docs).withColumn("row", F.monotonically_increasing_id()), "rows")  # numbered once, as written
    seen = rows.where(F.size("seen") > 0).select(F.explode("seen").alias("s")).select("s.*")
    return rows, bootstrap(seen, docs, scratch, rounds, trust, support)[1]


def _plain(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def find(spark: SparkSession, documents: DataFrame, rounds: int = 3, trust: float = 0.6, support: int = 5) -> DataFrame:
    """doc_id, base, spans for every row of `documents` (doc_id, text): arrays of (kind, start, end).

    `base` has the fixed forms by kind, then start; `spans` has these and after
    them the found ones, of kind `id`, which overlap none of them. Offsets count
    code points, the end is exclusive. A null or empty text has no spans. Rows
    that repeat a doc_id are judged each by its own text; an empty table gives
    an empty result; other columns are not read.
    """
    scratch = Scratch(spark, "pii")
    rows, known = _learned(_plain(documents), scratch, rounds, trust, support)
    fresh = rows.where(F.size("seen") > 0).select("row", F.explode("seen").alias("s")).select("row", "s.*").where("not base")
    hits = fresh.join(if_few(known.select("instance")), "instance", "left_semi").select("row", "start", "end").distinct()
    found = hits.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.lit(FOUND).alias("kind"), "start", "end"))).alias("found"))
    return rows.join(found, "row", "left").select("doc_id", "base", F.concat("base", F.coalesce("found", F.array().cast(SPANS))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _known_spans(text: str, base: list[tuple[str, int, int]], known: np.ndarray) -> list[tuple[int, int]]:
    """Where the text has an instance whose hash is among the sorted `known`."""
    own = [s for s in instances(text, base) if not s["base"]] if len(known) else []
    if not own:
        return []
    keys = np.array([xxhash.xxh64_intdigest(s["instance"].encode(), 42) for s in own], np.uint64).view(np.int64)
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return [(s["start"], s["end"]) for s, hit in zip(own, known[at] == keys, strict=True) if hit]


def _masked(text: str, base: list[tuple[str, int, int]], found: list[tuple[int, int]]) -> str:
    parts, end = [], 0
    for kind, a, b in sorted([*base, *((FOUND, a, b) for a, b in found)], key=lambda s: (s[1], -s[2])):
        if a >= end:
            parts += [text[end:a], f"[{kind}]"]
        end = max(end, b)
    return "".join(parts) + text[end:] if parts else text


def masked(spark: SparkSession, documents: DataFrame, rounds: int = 3, trust: float = 0.6, support: int = 5, most: int = FEW) -> DataFrame:
    """`documents` with every span of its text replaced by its kind in square brackets; all columns stay.

    Of spans that overlap, the one that begins first, then the longest, names the
    place. Up to `most` known instances go to the rows, 8 bytes each, and no text
    is shuffled; more are joined with the rows that have them.
    """
    scratch = Scratch(spark, "pii")
    docs = _plain(documents)
    rows, known = _learned(docs, scratch, rounds, trust, support)
    held = known.select(F.xxhash64("instance").alias("h")).limit(most + 1).collect()
    if len(held) <= most:
        among = np.sort(np.array([r["h"] for r in held], np.int64))

        @F.arrow_udf("string")
        def told(texts: pa.Array) -> pa.Array:
            out = []
            for t in (x.as_py() for x in texts):
                base = base_spans(t or "")
                out.append(None if t is None else _masked(t, base, _known_spans(t, base, among)))
            return pa.array(out, pa.string())

        return documents.withColumn("text", told(F.col("text").cast("string"))).select(*documents.columns)

    a, b, c = (free_name(documents, x) for x in ("own_h1", "own_h2", "own_found"))
    fresh = rows.where(F.size("seen") > 0).select("h1", "h2", F.explode("seen").alias("s")).select("h1", "h2", "s.*").where("not base")
    found = fresh.join(known.select("instance"), "instance", "left_semi").groupBy(F.col("h1").alias(a), F.col("h2").alias(b)).agg(F.collect_set(F.struct("start", "end")).alias(c))
    h1, h2 = _key(F.col("text").cast("string"))
    marked = documents.join(found, (h1 == F.col(a)) & (h2 == F.col(b)), "left")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        both = ((t.as_py(), f.as_py()) for t, f in zip(texts, spans, strict=True))
        out = [None if t is None else _masked(t, base_spans(t), [(s["start"], s["end"]) for s in f or ()]) for t, f in both]
        return pa.array(out, pa.string())

    return marked.withColumn("text", cut(F.col("text").cast("string"), F.col(c))).select(*documents.columns)
