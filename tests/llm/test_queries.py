"""The registered queries against brute force: columns, types, held-out rows, and what the models say, by plain versions of their parts."""

import hashlib
import os
import re
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from palimpsest.llm import hashing, langid, queries, toxicity  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def share(i, of):
    return zlib.crc32(str(i).encode()) % of


# -- 2 -----------------------------------------------------------------------------

YOU = set(toxicity.SECOND_PERSON.split())


def plain(word, undo=False):
    out = ""
    for c in word:
        c = toxicity.LOOKALIKE.get(c, c) if undo else c
        out += c.lower() if c.isascii() and c.isalnum() else "" if c.isascii() else c
    return out


def brute_features(text, lexicon):
    """A text's features, word by word and character by character; words are told by their hashes in the lexicon only."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    key = lambda w: int(hashing.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]), toxicity._SPELLED)[0])
    sets = [set(map(int, x)) for x in lexicon]
    said, undone = [plain(w) for w in words], [plain(w, True) for w in words]
    level = [[key(w) in s if w else False for w in said] for s in sets]
    hidden = sum(a != b and (key(b) in sets[0] or key(b) in sets[1]) for a, b in zip(said, undone, strict=True))
    you = [w in YOU for w in said]
    near = sum((level[0][i] or level[1][i]) and any(you[max(0, i - 3) : i + 4]) for i in range(len(words)))
    raw = (text or "").encode()
    letter = [chr(c).isalpha() and c < 128 or c >= 128 for c in raw]
    count = lambda f: sum(map(f, raw))
    n, m, letters = max(len(words), 1), max(len(raw), 1), max(sum(letter), 1)
    shout = sum(len(w.encode()) >= 3 and sum("A" <= c <= "Z" for c in w) >= 0.8 * len(w.encode()) for w in words)
    marks = count(lambda c: c < 128 and not chr(c).isalnum() and c not in b" \t\n\x0b\x0c\r")
    runs = sum(letter[i] and raw[i] == raw[i - 1] == raw[i - 2] for i in range(2, len(raw)))
    held = [sum(x) for x in level]
    return [len(words), *held, *(h / n for h in held), hidden, near, sum(you) / n, count(lambda c: 65 <= c <= 90) / letters, shout / n, marks / m, count(lambda c: c == 33) / m, count(lambda c: c in toxicity.MASKS) / m, count(lambda c: 48 <= c <= 57) / m, runs / m, letters / n]


def test_features(texts):
    lexicon = tuple(np.sort(toxicity.word_keys(w)) for w in (["idiot", "the"], ["moron", "of"], ["and", "in"]))
    some = [*list(texts.values())[:60], None, "", "YOU 1d10t!! the m0r0n $cum", "aaa bbbb éé ééé !!! you of", " \n\t", "x" * 50, "of you a b c the"]
    got = toxicity.features(pa.array(some, pa.string()), lexicon)
    assert np.allclose(got, np.array([brute_features(t, lexicon) for t in some]))


def grow(x, y, g, h, rows, depth, model):
    """A tree's values, by trying every cut of every feature."""
    G, H = g[rows].sum(), h[rows].sum()
    best = (1e-6, None, None)
    for f in range(x.shape[1]) if depth else ():
        for c in range(model.bins):
            left = rows[x[rows, f] <= c]
            a, b = g[left].sum(), h[left].sum()
            if b >= model.least and H - b >= model.least:
                gain = a * a / (b + 1) + (G - a) ** 2 / (H - b + 1) - G * G / (H + 1)
                if gain > best[0] + 1e-12:
                    best = (gain, f, c)
    if best[1] is None:
        out = np.zeros(len(y))
        out[rows] = model.rate * G / (H + 1)
        return out
    _, f, c = best
    return grow(x, y, g, h, rows[x[rows, f] <= c], depth - 1, model) + grow(x, y, g, h, rows[x[rows, f] > c], depth - 1, model)


def test_trees_by_brute_force():
    rng = np.random.default_rng(4)
    x = rng.random((300, 4)).round(1)
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = toxicity.Boosted(rounds=5, depth=3, bins=8).fit(x, y)
    binned = model._binned(x)
    raw = np.full(300, np.log(y.mean() / (1 - y.mean())))
    for _ in range(5):
        p = 1 / (1 + np.exp(-raw))
        raw = raw + grow(binned, y, y - p, p * (1 - p) + 1e-9, np.arange(300), 3, model)
    assert np.allclose(model.raw(x), raw)


def test_isotonic_by_brute_force():
    """The least mean of what follows over the greatest mean of what comes before: the min-max form of isotonic regression."""
    rng = np.random.default_rng(2)
    s, y = rng.permutation(60) / 60, (rng.random(60) < 0.4).astype(float)
    y = y[np.argsort(s)]
    s = np.sort(s)
    want = [max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert np.allclose(np.interp(s, *toxicity.isotonic(s, y)), want)


def test_op2(spark, texts):
    df = queries.op2_toxicity(spark, DATA)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema][:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = df.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    model = toxicity.train(spark, spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"), queries.remainder(4) != 2)
    scores = dict(zip(texts, model.score(pa.array(list(texts.values()), pa.string())), strict=True))
    for r in rows:
        assert r["held_out"] == (share(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert abs(r["score"] - scores[r["doc_id"]]) < 1e-12


def test_held_out_labels_are_not_read(spark, tmp_path):
    """Labels of held-out rows can be anything, and say nothing."""
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(queries.remainder(4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast(labels.schema["toxic"].dataType))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    turned.write.parquet(f"{tmp_path}/labels.parquet")
    a, b = ({r["doc_id"]: r["score"] for r in queries.op2_toxicity(spark, d).collect()} for d in (DATA, str(tmp_path)))
    assert a == b


# -- 10 ----------------------------------------------------------------------------


def test_op10(spark, texts):
    import zstandard

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    df = queries.op10_language_id(spark, DATA)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema][:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    by = langid.train(spark, docs, queries.remainder(5) != 0)
    params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_FAST, min_match=4, window_log=17, hash_log=15, chain_log=15, search_log=3, target_length=8, write_content_size=False, write_checksum=False, write_dict_id=False)
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    right = seen = 0
    for r in df.collect():
        i, text = r["doc_id"], texts[r["doc_id"]]
        runs = re.findall(r"[^\W\d_]+", (text or "").lower())
        own = [x for x in ("".join(c for c in w if unicodedata.category(c)[0] == "L") for w in runs) if x]
        assert r["held_out"] == (share(i, 5) == 0) and 0 <= r["score"] <= 1
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        data = " ".join(own).encode()
        size = {}
        for k, d in by.items():
            coder = zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            size[k] = sum(len(coder.compress(data[a : a + (1 << 16)])) for a in range(0, len(data), 1 << 16))
        assert size[r["lang_pred"]] == min(size.values()) and r["lang_pred"] == min(k for k in size if size[k] == min(size.values()))
        if r["held_out"] and len(own) >= 5 and lang[i]:
            seen += 1
            right += r["lang_pred"] == lang[i]
    assert seen > 20 and right / seen > 0.9


def test_held_out_languages_are_not_read(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.withColumn("lang", F.when(queries.remainder(5) == 0, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op10_language_id(spark, d).collect()} for d in (DATA, str(tmp_path)))
    assert a == b


# -- 5, 7, 8 -----------------------------------------------------------------------


def test_op5(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = queries.op5_sentencepiece(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        ids = library.encode(text)
        assert (r["n_ids"], r["ids_crc32"]) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        assert r["round_trip"] and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def is_good(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        twice = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in twice) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_op7(spark, texts):
    df = queries.op7_contextual_pii(spark, DATA)
    assert [f.name for f in df.schema][:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert {f.dataType.simpleString() for f in df.schema if f.name.startswith("n_")} == {"bigint"}
    for r in df.collect():
        text = texts[r["doc_id"]] or ""
        base = [(k, m.start(), m.end()) for k, form in FORMS.items() for m in re.finditer(form, text) if is_good(k, m[0])]
        assert [r[f"n_{k}"] for k in FORMS] == [sum(b[0] == k for b in base) for k in FORMS]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"].startswith(joined)


def test_op8(spark, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    df = queries.op8_best_fit_packing(spark, DATA)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    got, places, total = {}, {}, 0
    for r in df.collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total += r["length"]
    for i, text in texts.items():
        ids, want, at = [*whole.encode(text or "", add_special_tokens=False).ids, 0], [], 0
        for k, n in enumerate([len(ids) % 2048 or 2048, *[2048] * ((len(ids) - 1) // 2048)]):
            want.append((k, at, n, zlib.crc32(struct.pack(f"<{n}I", *ids[at : at + n]))))
            at += n
        assert sorted(got[i]) == want
    for own in places.values():
        at = 0
        for a, n in sorted(own):
            assert a == at
            at += n
        assert at <= 2048
    assert len(got) == len(texts) and len(places) <= -(-total // 2048) + 2


def test_jaccard_gives_up_its_tables_early(spark, monkeypatch):
    """Sketches, their tokens and candidate pairs don't stay on disk until the end, and links are found all the same."""
    from palimpsest.llm import jaccard

    gone, drop = [], jaccard.Scratch.drop
    monkeypatch.setattr(jaccard.Scratch, "drop", lambda self, name: gone.append(name) or drop(self, name))
    words = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(words)), (3, " ".join(words[30:] * 2)), (4, "a b c d e f"), (5, None)]
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark, spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {(1, 56, 1), (2, 56, 1), (3, 56, 1), (4, 2, 4), (5, 0, 5)} <= found and len(found) == 6
    assert {"sets", "named", "rows", "pairs", "held"} <= set(gone)
