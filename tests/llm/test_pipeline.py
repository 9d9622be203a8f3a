"""The pipeline's stages, row by row, against brute force: rows that repeat or lack a doc_id, toxic and clean, cut and whole."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline as C  # noqa: E402
from palimpsest.llm import pii, toxicity  # noqa: E402
from palimpsest.llm.queries import remainder  # noqa: E402
from test_pii import brute  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, own_id string, bucket string"


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    rng = random.Random(7)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    bad = lambda n: " ".join(w if rng.random() < 0.8 else rng.choice(["idiot", "Moron!", "scum"]) for w in prose(n).split())
    rows, labels = [], []
    for i in range(0, 1200, 2):
        toxic = i % 10 == 0
        rows.append((i, bad(60) if toxic else prose(60)))
        labels.append((i, 1, int(toxic)))
    passage = prose(40)
    rows += [(2000 + i, f"{prose(20)} {passage} {prose(20)}") for i in range(6)]
    rows += [(2003, f"{passage} only here {prose(30)}"), (2003, prose(50)), (None, f"{passage} {prose(9)}"), (None, bad(50)), (None, prose(50)), (None, None), (2100, None), (2101, ""), (2000, bad(40))]
    rows += [(i, rows[7][1]) for i in (3000, 3000, 3001, None)]
    rows += [(4000 + i, f"{prose(10)} token = \"{'%040x' % rng.getrandbits(160)}\" {prose(4)} a{i}@b.example.com") for i in range(12)]
    rows.append((5000, prose(3000)))
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", f"row {k}", "x") for k, (i, t) in enumerate(rows)], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def rows_of(df):
    return [(r["doc_id"], r["text"], r["own_id"]) for r in df.collect()]


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def run(k, df):
        name, stage = C.STAGES[k]
        stage(spark, df, folder).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    # toxicity: each row by its own text
    one = run(0, docs)
    assert one.columns == docs.columns
    model = toxicity.train(spark, docs, spark.read.parquet(f"{folder}/labels.parquet"), remainder(4) != 2)
    held = rows_of(docs)
    scores = model.score(pa.array([t for _, t, _ in held], pa.string()))
    want = [r for r, s in zip(held, scores, strict=True) if s < C.TOXIC]
    assert Counter(rows_of(one)) == Counter(want) and 100 < len(held) - len(want) < 140
    ids = Counter(i for i, _, _ in want)
    assert ids[None] == 4 and ids[2000] == 1 and ids[2003] == 3

    # n-gram Jaccard: of the copies of one text the first stays, and all rows without words
    two = run(1, one)
    kept, before = rows_of(two), rows_of(one)
    assert two.columns == docs.columns and set(kept) <= set(before)
    groups = defaultdict(list)
    for r in before:
        groups[" ".join((r[1] or "").lower().split()) or r[2]].append(r)
    assert len(kept) == len(groups)  # in these texts only copies are alike
    for own in groups.values():
        least = min((i is None, i or 0) for i, _, _ in own)
        assert [(i is None, i or 0) for i, _, n in own if (i, _, n) in kept] == [least]

    # substring dedup: each row loses what a row of a smaller doc_id has
    three = run(2, two)
    first: dict = {}
    windows = lambda w: [tuple(w[k : k + 13]) for k in range(len(w) - 12)]
    for i, t, _ in kept:
        for w in windows((t or "").split()) if i is not None else ():
            first[w] = min(first.get(w, i), i)
    want = []
    for i, t, n in kept:
        w = (t or "").split()
        gone = [False] * len(w)
        for k, x in enumerate(windows(w)):
            if i is not None and first[x] < i:
                gone[k : k + 13] = [True] * 13
        want.append((i, " ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else t, n))
    assert Counter(rows_of(three)) == Counter(want) and three.columns == docs.columns
    assert sum(a[1] != b[1] for a, b in zip(kept, want, strict=True)) >= 6 and [t for i, t, _ in want if i is None and t and "only" not in t]

    # PII: fixed forms, and what the rounds find
    four = run(3, three)
    held = rows_of(three)
    spans = brute([(n, t) for _, t, n in held])[1]
    want = []
    for i, t, n in held:
        every = sorted([*pii.base_spans(t or ""), *(("id", a, b) for a, b in spans[n])], key=lambda s: (s[1], -s[2]))
        out, end = "", 0
        for kind, a, b in every:
            if a >= end:
                out += t[end:a] + f"[{kind}]"
            end = max(end, b)
        want.append((i, out + t[end:] if t is not None else None, n))
    assert Counter(rows_of(four)) == Counter(want) and sum("[id]" in (t or "") for _, t, _ in want) == 12 and four.columns == docs.columns

    # packing: every row's ids, without gaps, in few sequences
    five = run(4, four).collect()
    from tokenizers import Tokenizer

    whole, pieces = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Counter()
    for i, t, _ in rows_of(four):
        own = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, n in enumerate([len(own) % 2048 or 2048, *[2048] * ((len(own) - 1) // 2048)]):
            pieces[i, k, at, n, zlib.crc32(struct.pack(f"<{n}I", *own[at : at + n]))] += 1
            at += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in five) == pieces
    places = defaultdict(list)
    for r in five:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        ends = [0, *(a + n for a, n in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048
    assert len(places) <= 1.05 * sum(r["length"] for r in five) / 2048 + 1


def test_run(spark, folder):
    found = C.run(spark, folder)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and found.count() > 400


def test_empty_tables(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []
