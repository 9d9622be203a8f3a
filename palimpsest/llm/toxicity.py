"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The lexicon is learned from labelled training texts: words whose presence tells
most of a toxic label, in three strengths. A text's features are the density and
number of such words, as spelled and after undoing look-alike characters, how
near they stand to second-person pronouns, and the rates of capitals,
punctuation and obfuscation. All features are array arithmetic over a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import hashing as H
from palimpsest.plans.scratch import Scratch

#: Look-alike characters and the letters they stand for, second-person pronouns of the usual languages, and marks that hide letters.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine tu te ton ta toi vous votre ti usted ustedes vosotros"
MASKS = b"*#%&$@"

#: Words of either spelling are hashed over letters and digits only, so that "idiot!" and "idiot" are one word.
_SPELLED = H.LOWER.copy()
for _b in range(128):
    if not chr(_b).isalnum():
        _SPELLED[_b] = 0
_UNMASKED = _SPELLED.copy()
for _a, _c in LOOKALIKE.items():
    _UNMASKED[ord(_a)] = H.LOWER[ord(_c)]


def word_keys(words: list[str]) -> np.ndarray:
    """Hashes of plain words, as the features see them."""
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = H.word_spans(data, np.array([0, len(data)]))
    return H.word_hashes(data, starts, ends, _SPELLED)


_YOU = np.sort(word_keys(SECOND_PERSON.split()))

FEATURES = "words strong mid weak strong_rate mid_rate weak_rate hidden near_you you_rate capital_rate shout_rate mark_rate bang_rate mask_rate digit_rate run_rate mean_word".split()


def _member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among) or not len(keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(among, keys)
    at[at == len(among)] = 0
    return among[at] == keys


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text, the sum over its range of flags."""
    total = np.zeros(len(flags) + 1, np.float64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _byte_counts(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Per text: letters, capitals, digits, marks, exclamation marks, hiding marks and letters that repeat the two before them."""
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    run = np.zeros(len(data), bool)
    run[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    flags = (letter, upper, digit, ~letter & ~digit & ~H.SPACE[data], data == 33, np.isin(data, np.frombuffer(MASKS, np.uint8)), run)
    if len(offs) == 2:
        return [np.array([float(np.count_nonzero(f))]) for f in flags]
    return [_sums(f, offs) for f in flags]


def _capitals(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Capitals per word."""
    total = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data >= 65) & (data <= 90), out=total[1:])
    return total[ends] - total[starts]


def features(texts, lexicon: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """A row of FEATURES per text, whole texts; null and empty texts give zeros.

    A text longer than a slice is a slice of its own; its bytes are counted in
    parts that overlap by two bytes, which only runs look back over.
    """
    out = [np.zeros((0, len(FEATURES)))]
    for _, _, data, offs in H.slices(texts):
        starts, ends, at = H.word_spans(data, offs)
        plain = H.word_hashes(data, starts, ends, _SPELLED)
        undone = H.word_hashes(data, starts, ends, _UNMASKED)
        n_words, n_bytes = np.maximum(np.diff(at), 1), np.maximum(np.diff(offs), 1)
        levels = [_member(plain, x) for x in lexicon]
        hidden = (plain != undone) & (_member(undone, lexicon[0]) | _member(undone, lexicon[1]))
        you = _member(plain, _YOU)
        close = you.copy()
        for d in range(1, 4):  # a pronoun within three words
            close[d:] |= you[:-d]
            close[:-d] |= you[d:]
        if len(offs) == 2 and len(data) > 2 * H.SLICE:
            counts = [np.zeros(1) for _ in range(7)]
            for a in range(0, len(data), H.SLICE):
                back = min(a, 2)
                own, before = (_byte_counts(x, np.array([0, len(x)])) for x in (data[a - back : a + H.SLICE], data[a - back : a]))
                counts = [c + x - y for c, x, y in zip(counts, own, before, strict=True)]
        else:
            counts = _byte_counts(data, offs)
        letters, upper, digits, marks, bangs, masks, runs = counts
        shout = (ends - starts >= 3) & (_capitals(data, starts, ends) >= 0.8 * (ends - starts))
        held = [_sums(x, at) for x in levels]
        letters = np.maximum(letters, 1)
        rows = [
            np.diff(at),
            *held,
            *(c / n_words for c in held),
            _sums(hidden, at),
            _sums((levels[0] | levels[1]) & close, at),
            _sums(you, at) / n_words,
            upper / letters,
            _sums(shout, at) / n_words,
            *(c / n_bytes for c in (marks, bangs, masks, digits, runs)),
            letters / n_words,
        ]
        out.append(np.stack(rows, 1).astype(np.float64))
    return np.concatenate(out)


class Boosted:
    """Boosted regression trees for the logistic loss, grown level by level on binned features."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, width = self._binned(x), self.bins + 1
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p) + 1e-9
            node = np.zeros(len(y), np.int64)
            n_nodes = 2 ** (self.depth + 1) - 1
            by, cut = np.full(n_nodes, -1), np.zeros(n_nodes, np.int64)
            for level in range(self.depth):
                base, k = 2**level - 1, 2**level
                gain, best_f, best_c = np.full(k, 1e-6), np.full(k, -1), np.zeros(k, np.int64)
                live = node >= base
                at = (node[live] - base) * width
                for f in range(b.shape[1]):
                    key = at + b[live, f]
                    gs = np.cumsum(np.bincount(key, g[live], k * width).reshape(k, width), 1)
                    hs = np.cumsum(np.bincount(key, h[live], k * width).reshape(k, width), 1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    score = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    score[(hs < self.least) | (ht - hs < self.least)] = -1
                    c = score.argmax(1)
                    top = score[np.arange(k), c]
                    better = top > gain
                    gain[better], best_f[better], best_c[better] = top[better], f, c[better]
                by[base : base + k], cut[base : base + k] = best_f, best_c
                f = by[node]
                go = live & (f >= 0)
                node[go] = 2 * node[go] + 1 + (b[go, f[go]] > cut[node[go]])
            value = self.rate * np.bincount(node, g, n_nodes) / (np.bincount(node, h, n_nodes) + 1)
            raw += value[node]
            self.trees.append((by, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        if not len(x):
            return out
        b, rows = self._binned(x), np.arange(len(x))
        for by, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = by[node]
                node = np.where(f >= 0, 2 * node + 1 + (b[rows, f] > cut[node]), node)
            out += value[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, calibrated value), to be interpolated."""
    blocks: list[list[float]] = []  # lowest and highest score, sum of y, count
    for s in np.unique(score):
        own = y[score == s]
        blocks.append([s, s, float(own.sum()), float(len(own))])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, t, n = blocks.pop()
            blocks[-1][1] = hi
            blocks[-1][2] += t
            blocks[-1][3] += n
    xs = np.array([v for lo, hi, _, _ in blocks for v in (lo, hi)])
    ys = np.array([v for _, _, t, n in blocks for v in [t / n] * 2])
    return xs, ys


class Model:
    """What `train` gives and `score` applies: lexicon, trees, calibration."""

    def __init__(self, lexicon, trees, knots):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def score(self, texts) -> np.ndarray:
        x = features(texts, self.lexicon)
        return np.interp(self.trees.raw(x), *self.knots) if self.trees else np.full(len(x), self.knots[1][0])


def _word_counts(sample: DataFrame) -> DataFrame:
    """word (hash), n texts that have it, toxic of them; counted per batch before the shuffle."""

    def work(batches):
        for b in batches:
            toxic = b.column(1).to_numpy(zero_copy_only=False)
            keys, flags = [], []
            for i, j, data, offs in H.slices(b.column(0)):
                starts, ends, at = H.word_spans(data, offs)
                words = H.word_hashes(data, starts, ends, _SPELLED)
                for r in range(i, j):
                    own = np.unique(words[at[r - i] : at[r - i + 1]])
                    keys.append(own)
                    flags.append(np.full(len(own), toxic[r], np.int64))
            if keys:
                k, inv = np.unique(np.concatenate(keys), return_inverse=True)
                f = np.concatenate(flags)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.bincount(inv, minlength=len(k))), pa.array(np.bincount(inv, f, len(k)).astype(np.int64))], ["word", "n", "toxic"])

    return sample.select("text", "toxic").mapInArrow(work, "word long, n long, toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, where: Column, max_rows: int = 20_000, lexicon_words: int = 600) -> Model:
    """Fits on the labelled rows that `where` (over doc_id) keeps, of which about `max_rows` at most are drawn by hashed id.

    A quarter of the drawn ids is set aside before anything is learned: the
    lexicon and the trees come from the others, the calibration from these. With
    too few rows for that, calibration uses all of them again. Repeated labels of
    a doc_id count once, as toxic if any says so; of the texts that repeat a
    doc_id, one is drawn. Without labels of both kinds the model is a constant.
    """
    scratch = Scratch(spark, "toxicity")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(where & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    n = known.count()
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    drawn = known.where(lot < int((1 << 40) * min(1.0, max_rows / max(n, 1))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(drawn), "doc_id")  # max_rows ids: bounded
    sample = sample.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    aside = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(4)) == 0
    sample = scratch.put(sample.select("doc_id", F.col("t.text").alias("text"), "toxic", aside.alias("aside")), "sample")
    totals = {r["aside"]: (r["n"], r["toxic"]) for r in sample.groupBy("aside").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).collect()}
    n, bad = (sum(x) for x in zip(*totals.values(), (0, 0), strict=True))
    if not 0 < bad < n:
        return Model((np.zeros(0, np.uint64),) * 3, None, (np.zeros(1), np.array([float(bad) / n if n else 0.0])))
    split = n >= 200 and all(0 < t < m for m, t in totals.values()) and len(totals) == 2
    if split:
        n, bad = totals[False]
    p = bad / n
    z = (F.col("toxic") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    counted = _word_counts(sample.where("not aside") if split else sample).where((F.col("n") >= 4) & (z >= 3))
    top = counted.select("word", (F.col("toxic") / F.col("n")).alias("rate"), z.alias("z")).orderBy(F.desc("z"), "word").limit(lexicon_words).collect()

    def level(lo: float, hi: float) -> np.ndarray:
        """The words whose share of toxic texts lies so far between the mean and one."""
        return np.sort(np.array([r["word"] for r in top if lo <= (r["rate"] - p) / (1 - p) < hi], np.int64).view(np.uint64))

    lexicon = (level(0.5, 2), level(0.25, 0.5), level(0, 0.25))

    def work(batches):
        for b in batches:
            x = features(b.column(1), lexicon)
            row = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), row], ["doc_id", "toxic", "aside", "x"])

    found = sample.select("doc_id", "text", "toxic", "aside").mapInArrow(work, "doc_id long, toxic long, aside boolean, x array<double>")
    rows = found.orderBy("doc_id").toPandas()  # max_rows rows of len(FEATURES) numbers
    x, y, kept = np.stack(rows["x"].to_numpy()), rows["toxic"].to_numpy(np.float64), rows["aside"].to_numpy(bool)
    if not split:
        trees = Boosted(rounds=20, depth=2).fit(x, y)
        return Model(lexicon, trees, isotonic(trees.raw(x), y))
    trees = Boosted().fit(x[~kept], y[~kept])
    return Model(lexicon, trees, isotonic(trees.raw(x[kept]), y[kept]))


def scored(model: Model, text: Column) -> Column:
    """The score of a text column, row by row: other columns of the row stay in the JVM."""

    @F.arrow_udf("double")
    def work(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(texts))

    return work(text.cast("string"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: one row per row of `docs`, each by its whole text alone; null and empty texts are scored as having no words."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), scored(model, F.col("text")).alias("score"))


def below(docs: DataFrame, model: Model, limit: float) -> DataFrame:
    """The rows of `docs` whose own text scores below the limit, with all their columns, whatever other rows share their doc_id."""
    return docs.where(scored(model, F.col("text")) < limit)
