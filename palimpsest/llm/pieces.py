"""SentencePiece encoding and decoding with forward states shared between words.

No piece of a model spans the end of one marked word (blanks, then other
characters) and the start of the next, so words are encoded alone. The distinct
words of a batch are sorted, which walks their trie depth first: a word keeps the
forward states of the prefix it shares with the word before, and only its own
characters are worked on. A state holds the pieces that may still grow, and the
best last piece of the prefix:

- unigram models: the one with the highest sum of scores (Viterbi);
- byte-pair models: highest sums give other pieces than merging does, so the last
  piece is the one that forms a stable pair with the best last piece of what is
  before it: merging the two pieces' text gives these two again. There is exactly
  one, as the prefix of a merged sequence is itself what merging gives.

Decoding looks up each id's bytes. Both directions follow the model file's
settings for a leading blank, byte fallback and unknown pieces; models with a
normalizer other than identity, or with user-defined pieces, are refused, and so
are byte-pair models with unused pieces. Unused pieces of a unigram model match
nothing. Memory is bounded by bytes: states of a word of any length take 16 bytes
a character, and only those of short words are shared and kept.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
#: Bytes of words and ids that a worker keeps; then it starts anew. Longer words are encoded by themselves and not kept.
CACHE_BYTES = 96 << 20
LONG = 256
#: Pairs of pieces that a worker keeps, about 200 bytes each.
PAIRS = 500_000
MARKED = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
#: The kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Model:
    """What a model file says, and the forward states of the word at hand."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb2

        proto = pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models whose normalizer is identity are supported")
        if proto.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and byte-pair models are supported")
        self.merges = proto.trainer_spec.model_type == 2
        self.prefix = norm.add_dummy_prefix
        self.unk = proto.trainer_spec.unk_id
        self.fallback = proto.trainer_spec.byte_fallback
        kinds = {p.type for p in proto.pieces}
        if USER_DEFINED in kinds or (self.merges and UNUSED in kinds):
            raise ValueError("models with user-defined pieces, and byte-pair models with unused ones, aren't supported")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = [p.score for p in proto.pieces]
        # a unigram model's unknown character scores this much below its worst piece
        self.unknown_score = min((p.score for p in proto.pieces if p.type == NORMAL), default=0.0) - 10.0
        self.of_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.text = [p.piece for p in proto.pieces]
        said = {CONTROL: b"", UNKNOWN: proto.trainer_spec.unk_surface.encode()}
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else said.get(p.type, p.piece.replace(BLANK, " ").encode()) for p in proto.pieces]
        crossing = [p for p in self.ids if re.search(f"[^{BLANK}]{BLANK}", p)]
        if crossing:
            raise ValueError(f"pieces reach over a word's end: {crossing[:3]}")
        self.root: dict = {}
        for piece, i in self.ids.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self.stable: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _merge(self, text: str) -> list[str]:
        """Byte-pair merging: the adjacent pair whose union scores highest, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.score[j] > best):
                    best, at = self.score[j], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pair(self, a: int, b: int) -> bool:
        """Whether the pieces stay as they are when their joined text is merged; a = -1: at the start."""
        key = a << 32 | b
        held = self.stable.get(key)
        if held is None:
            if len(self.stable) > PAIRS:
                self.stable.clear()
            left = [self.text[a]] if a >= 0 else []
            held = self.stable[key] = self._merge("".join(left) + self.text[b]) == [*left, self.text[b]]
        return held

    def _highest(self, ends: list[tuple[int, int]], score, n: int) -> tuple[int, int, float]:
        """(last piece, where it starts, sum of scores) of the best sequence that ends with character n (from 0); ends: the pieces that end there, longest first; score: the best sums before each character."""
        best = (-2, n, score[n] + self.unknown_score)
        for start, piece in ends:
            total = score[start] + self.score[piece]
            if total > best[2] or (start == n and best[0] == -2):  # a character that is a piece is never unknown
                best = (piece, start, total)
        return best

    def _ids(self, word: str, last, begun) -> bytes:
        """The ids of a word's pieces, given the last piece and its start for every number of characters."""
        out, n = [], len(word)
        while n:
            piece, start = last[n], begun[n]
            if piece >= 0:
                out.append(piece)
            elif self.fallback:
                out.extend(self.of_byte[x] for x in reversed(word[start:n].encode()))
            elif not out or out[-1] != self.unk:  # neighbours that are unknown are one
                out.append(self.unk)
            n = start
        out.reverse()
        return array("I", out).tobytes()

    def long(self, word: str) -> bytes:
        """The ids of one word of any length: as `learn`, with 16 bytes a character, and only the pieces that may still grow from the last one."""
        last, begun, score = array("i", [-1]), array("i", [0]), array("d", [0.0])
        grown: list = []
        for n, c in enumerate(word):
            more, ends = [], []
            for start, node in (*grown, (n, self.root)):
                node = node.get(c)
                if node is not None:
                    more.append((start, node))
                    if "" in node:
                        ends.append((start, node[""]))
            grown = more
            if self.merges:
                fits = ((y, x) for x, y in ends if last[x] == -2 or self._pair(last[x], y))
                piece, start, total = *next(fits, (-2, n)), 0.0
            else:
                piece, start, total = self._highest(ends, score, n)
            last.append(piece)
            begun.append(start)
            score.append(total)
        return self._ids(word, last, begun)

    def learn(self, words: set[str]) -> None:
        """Encodes the words that aren't known, and aren't long, in sorted order: a walk through their trie, depth first."""
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        # per character of the path: the pieces that may still grow, the last piece, its start, and the sum of scores
        grown, last, begun, score = [()], [-1], [0], [0.0]
        known, root, merges, held, path = self.known, self.root, self.merges, 0, ""
        for word in sorted(w for w in words if w not in known and len(w) <= LONG):
            same = 0
            for a, b in zip(path, word):  # noqa: B905
                if a != b:
                    break
                same += 1
            for column in (grown, last, begun, score):
                del column[same + 1 :]
            for n in range(same, len(word)):
                c, more, ends = word[n], [], []
                for start, node in grown[n]:
                    node = node.get(c)
                    if node is not None:
                        more.append((start, node))
                        if "" in node:
                            ends.append((start, node[""]))
                node = root.get(c)
                if node is not None:
                    more.append((n, node))
                    if "" in node:
                        ends.append((n, node[""]))
                if merges:
                    piece, start, total = -2, n, 0.0
                    for x, y in ends:
                        before = last[x]
                        if before == -2 or self._pair(before, y):
                            piece, start = y, x
                            break
                else:
                    piece, start, total = self._highest(ends, score, n)
                grown.append(more)
                last.append(piece)
                begun.append(start)
                score.append(total)
            path = word
            own = known[word] = self._ids(word, last, begun)
            held += 160 + 4 * len(word) + len(own)  # a string's and an entry's own bytes besides
        self.held += held

    def marked(self, text: str) -> list[str]:
        """The text's words, each with its blanks before it."""
        return MARKED.findall(BLANK * (self.prefix and text != "") + text.replace(" ", BLANK))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.marked(t) for t in texts]
        self.learn({w for s in split for w in s})

        def ids(words: list[str]) -> bytes:
            if max(map(len, words), default=0) <= LONG:
                return b"".join(map(self.known.__getitem__, words))
            return b"".join(self.known[w] if len(w) <= LONG else self.long(w) for w in words)

        return [np.frombuffer(ids(s), np.uint32) for s in split]

    def decode(self, ids) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, model_path: str, batch_chars: int = 1 << 22) -> DataFrame:
    """doc_id, ids (array<int>): a row per row of `docs` (doc_id, text). A null text has null ids, an empty one none."""

    def work(batches):
        m = model(model_path)
        for i, texts in _runs(batches, batch_chars):
            own = iter(m.encode([t for t in texts if t is not None]))
            yield pa.RecordBatch.from_arrays([i, pa.array([None if t is None else next(own).astype(np.int32) for t in texts], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, ids array<int>")


def decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text: a row per row of `docs` (doc_id, ids). Null ids have a null text."""

    def work(batches):
        m = model(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else m.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), "ids").mapInArrow(work, "doc_id long, text string")


def _runs(batches, batch_chars: int):
    """(doc_id, texts) of about batch_chars each."""
    for b in batches:
        texts = b.column(1).to_pylist()
        first, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= batch_chars or i + 1 == len(texts):
                yield b.column(0).slice(first, i + 1 - first), texts[first : i + 1]
                first, size = i + 1, 0


def digest(docs: DataFrame, model_path: str, batch_chars: int = 1 << 22) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, round_trip: a row per row of `docs`, whole texts.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers;
    decoded_sha256 is the SHA-256 of what decoding them gives, and round_trip
    says whether that is the text (it isn't for a text with U+2581, the mark
    for a blank). A null text counts as empty. Repeated rows are encoded alike;
    an empty table gives an empty result; other columns are not read.
    """

    def work(batches):
        m = model(model_path)
        for i, texts in _runs(batches, batch_chars):
            texts = [t or "" for t in texts]
            ids = m.encode(texts)
            back = [m.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([i, pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]), pa.array([x == t for x, t in zip(back, texts, strict=True)], pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
