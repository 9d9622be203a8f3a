"""Very long texts and runs, languages of little text, and rows that repeat, each with a defined result."""

import random
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from palimpsest.llm import jaccard, langid, packing, substrings, toxicity  # noqa: E402

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def test_packing_of_long_runs(spark):
    from tokenizers import Tokenizer

    texts = [" " * 1_000_000, "a" + "\n" * 1_200_000 + "b", "x" * 300_000, "! " * 200_000, " " * 150_000 + "z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole, got = Tokenizer.from_file(JSON), {}
    for r in packing.pieces(df, JSON, RANKS).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    for i, t in enumerate(texts):
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        assert sorted(got[i]) == [(s, n, zlib.crc32(struct.pack(f"<{n}I", *ids[s : s + n]))) for s, n in packing.cut_points(len(ids), 2048)]


def test_packing_of_repeated_rows(spark):
    """Rows that repeat everything are spread over many chunks, and every sequence stays gapless."""
    rows = [(None, None)] * 3000 + [(7, "same words here")] * 2000
    found = packing.pack(spark, spark.createDataFrame(rows, "doc_id long, text string"), JSON, RANKS).collect()
    assert Counter(r["doc_id"] for r in found) == {None: 3000, 7: 2000}
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 2048
    lots = {r["lot"] for r in packing.pieces(spark.createDataFrame(rows, "doc_id long, text string"), JSON, RANKS).collect()}
    assert len(lots) > 100


def test_letters():
    assert langid.letters("²³ ½ Ⅷ ① 12 _ !") == "" and langid.classify("²³ ½ Ⅷ", {"en": None}) == ("und", 0.0, True)
    assert langid.letters("M² Ünïcode x½y 漢字 ª") == "m ünïcode xy 漢字 ª"


def test_small_languages_and_places(spark):
    """A language of one short text is learned, and passages come from all of a long text, not from its start."""
    rng = random.Random(1)
    word = lambda of: "".join(rng.choice(of) for _ in range(5))
    rows = [(i, " ".join(word("abcd") for _ in range(40)), "a") for i in range(40)]
    rows += [(100 + i, " ".join(word("zyxw") for _ in range(6000)) + " " + " ".join(word("efgh") for _ in range(6000)), "e") for i in range(40)]
    rows += [(500, "q", "q"), (501, "12", "n")] + [(502, "kk ll", "a")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    by = langid.train(spark, df, F.lit(True))
    assert set(by) == {"a", "e", "q", "n"} and all(len(v) >= 8 for v in by.values())
    held = by["e"].decode(errors="ignore")
    assert sum(c in "efgh" for c in held) > 0.2 * len(held) and sum(c in "wxyz" for c in held) > 0.2 * len(held)
    assert by["a"].count(b"kk ll") <= 1 and len(by["a"]) > 4000
    assert set(langid.train(spark, df, F.lit(True), max_languages=2)) == {"a", "e"}


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(3)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(400_000)) + " " + "y" * 2_500_000


def test_long_texts(spark, long_text):
    """Texts longer than a slice, one with a word longer than that, and near copies of them."""
    other = long_text.replace("w7", "W7", 50) + " end"
    cut = "start " + " ".join(long_text.split()[1000:90_000])
    df = spark.createDataFrame([(1, long_text), (2, other), (3, cut), (4, "short")], "doc_id long, text string")
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark, df).collect()}
    lowered = [t.lower().split() for t in (long_text, other, cut)]
    sizes = [len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for w in lowered]
    assert [near[i] for i in (1, 2, 3, 4)] == [(sizes[0], 1), (sizes[1], 1), (sizes[2], 3), (1, 4)]
    gone = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.dedup(spark, df).collect()}
    assert gone[1] == (400_001, 0, long_text) and gone[3] == (89_001, 89_000, "start")


def test_features_of_long_texts(long_text):
    """A long text's features are those of its parts together."""
    import numpy as np
    import pyarrow as pa

    lexicon = tuple(toxicity.word_keys(w) for w in (["w1", "w2"], ["w3"], ["w4"]))
    text = long_text[:1_500_000] + " YOU w1 w3!! w4 0w1 ÉÉÉ $$ " * 30_000
    got = dict(zip(toxicity.FEATURES, toxicity.features(pa.array([text, None, ""]), lexicon)[0], strict=True))
    words = text.split()
    assert got["words"] == len(words) and got["strong"] == sum(w in ("w1", "w2") for w in words)
    bytes_ = text.encode()
    assert got["bang_rate"] == text.count("!") / len(bytes_) and got["digit_rate"] == sum(c in b"0123456789" for c in bytes_) / len(bytes_)
    letters = sum(chr(c).isalpha() or c >= 128 for c in bytes_)
    assert np.isclose(got["capital_rate"], sum(65 <= c <= 90 for c in bytes_) / letters)
    runs = sum(bytes_[i] == bytes_[i - 1] == bytes_[i - 2] and (chr(bytes_[i]).isascii() and chr(bytes_[i]).isalpha() or bytes_[i] >= 128) for i in range(2, len(bytes_)))
    assert np.isclose(got["run_rate"], runs / len(bytes_))


def test_pieces_of_long_words(spark):
    """Words of up to a million characters, in bounded memory, as the library encodes them."""
    import sentencepiece

    from palimpsest.llm import pieces

    path = P.path("piece_bpe_32k.model")
    library, rng = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(2)
    texts = ["漢字かな交じり文" * 400, "".join(rng.choice("abcdefghij") for _ in range(30_000)), "a" * 255 + " " + "b" * 256 + " " + "c" * 257, "x" * 5000 + "é" * 3000 + "\u0001" * 300]
    m = pieces.model(path)
    for t, ids in zip(texts, m.encode(texts), strict=True):
        assert ids.tolist() == library.encode(t) and m.decode(ids) == t
    word = "".join(rng.choice("abcdef") for _ in range(1_000_000))
    assert m.decode(m.encode([word])[0]) == word and all(len(w) <= pieces.LONG for w in m.known)


def test_cache_is_bounded_by_bytes(monkeypatch):
    from palimpsest.llm import pieces

    monkeypatch.setattr(pieces, "CACHE_BYTES", 100_000)
    m, rng = pieces.Model(P.path("piece_bpe_32k.model")), random.Random(3)
    for _ in range(20):
        m.encode([" ".join("".join(rng.choice("abcdef") for _ in range(20)) for _ in range(200))])
        assert m.held < 100_000 + 200 * 500 and m.held >= sum(len(v) for v in m.known.values())
