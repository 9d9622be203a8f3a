"""Bootstrapped extraction against a brute-force version over strings, and on planted identifiers."""

import random
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")

from palimpsest.llm import pii, queries  # noqa: E402

STOP = "the of to and in on a that it is was for as with by at from or an be this".split()


def norm(word):
    return "".join(c.lower() if c.isascii() else c for c in word if c.isalnum() or not c.isascii())


def key_of(word):
    m = re.match(r"([^=:]+)[=:](?=.)", word)
    return norm(m[1]) if m else None


def places(text):
    """Every pattern of every place of a text: (start of the place's word, pattern)."""
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    w = [norm(x) for _, _, x in words]
    out = []
    for i, (_, _, raw) in enumerate(words):
        if i >= 1:
            out.append(("left", w[i - 1]))
        if i >= 2:
            out.append(("left2", w[i - 2], w[i - 1]))
        if i + 1 < len(w):
            out.append(("right", w[i + 1]))
            if i >= 1:
                out.append(("around", w[i - 1], w[i + 1]))
        if key_of(raw) is not None:
            out.append(("key", key_of(raw)))
    return out, words, w


def own_patterns(text, a, b):
    _, words, w = places(text)
    i = max(k for k, x in enumerate(words) if x[0] <= a)
    j = max(k for k, x in enumerate(words) if x[0] <= b - 1)
    out = set()
    if i >= 1:
        out.add(("left", w[i - 1]))
    if i >= 2:
        out.add(("left2", w[i - 2], w[i - 1]))
    if j + 1 < len(w):
        out.add(("right", w[j + 1]))
        if i >= 1:
            out.add(("around", w[i - 1], w[j + 1]))
    if key_of(words[i][2]) is not None and a > words[i][0]:
        out.add(("key", key_of(words[i][2])))
    return out


def brute(rows, rounds=3, trust=0.6, support=5):
    total, n, look, seed, base, only = Counter(), Counter(), {}, set(), set(), defaultdict(lambda: True)
    found = {}
    for i, text in rows:
        text = text or ""
        total.update(places(text)[0])
        found[i] = pii.instances(text, pii.base_spans(text))
        for s in found[i]:
            x = s["instance"]
            look[x] = min(look.get(x, s["shape"]), s["shape"])
            only[x] &= s["base"]
            if s["seed"]:
                seed.add(x)
            if s["base"]:
                base.add(x)
            for p in own_patterns(text, s["start"], s["end"]):
                n[p, x] += 1
    weight = {x: float(x in seed) for x in look}
    for _ in range(rounds):
        taught, backed, lent = Counter(), Counter(), defaultdict(lambda: 1.0)
        for (p, x), c in n.items():
            taught[p] += c * weight[x]
            backed[p] += weight[x] > 0
        trusted = {p: conf for p, s in taught.items() if backed[p] >= support and (conf := round(s / (total[p] + 1), 9)) >= trust}
        alike = {k: sum(weight[x] for x in look if look[x] == k) / (sum(look[x] == k for x in look) + 1) for k in set(look.values())}
        for p, x in n:
            if p in trusted:
                lent[x] *= 1 - trusted[p]
        score = {x: round(0.75 * (1 - lent[x]) + 0.25 * alike[look[x]], 9) for x in lent}
        known = {x for x, v in score.items() if v >= trust}
        weight = {x: 1.0 if x in seed else score[x] if x in known else 0.0 for x in look}
    known |= base
    return trusted, {i: sorted((s["start"], s["end"]) for s in spans if not s["base"] and s["instance"] in known) for i, spans in found.items()}


def corpus(seed=4, n=260):
    """Prose in which member numbers, badge=... and secrets stand in telling contexts, some of whose instances have a fixed form; and numbers that mean nothing."""
    rng = random.Random(seed)
    prose = lambda k: " ".join(rng.choice(STOP) if rng.random() < 0.5 else f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}" for _ in range(k))
    rows, planted = [], {}
    for i in range(n):
        mail, code, hexa = f"p{rng.randrange(10**6)}@mail{i % 7}.example.com", f"KD-{rng.randrange(10**5, 10**6)}-{rng.choice('XYZ')}", "%040x" % rng.getrandbits(160)
        kind = min(i % 13, 8)
        said = {0: f"member contact: {mail},", 1: f"member contact: {mail},", 2: f"member contact: {code},", 3: f'token = "{hexa}"', 4: f"badge={rng.randrange(256)}.{rng.randrange(256)}.0.9", 5: f"the {rng.randrange(10**6, 10**7)}", 6: f"of {mail} and", 7: f"badge=n0de{rng.randrange(10**4, 10**5)} to", 8: f"badge={rng.randrange(256)}.0.1.{rng.randrange(256)}"}[kind]
        text = f"{prose(rng.randrange(6, 30))} {said} {prose(rng.randrange(6, 30))}"
        rows.append((i, text))
        planted[i] = {code} if kind == 2 else {hexa} if kind == 3 else {m[0] for m in re.finditer(r"n0de\d+", text)}
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "token = 12"), (1004, "a=1234567 b: c:d=99x99x99 =1234567 x1234567="), (1005, "éé=1234567é é " * 50)]
    return rows, planted


def test_rounds_by_brute_force(spark):
    rows, _ = corpus()
    trusted, spans = brute(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, instance string")
    got = {r["doc_id"]: sorted((s["start"], s["end"]) for s in r["spans"][len(r["base"]) :]) for r in pii.find(spark, df).collect()}
    assert got == spans and sum(map(len, spans.values())) > 40
    assert ("left2", "member", "contact") in trusted and ("key", "badge") in trusted and ("left2", "token", "") in trusted
    assert not any(p[0] in ("left", "right") and p[1] in STOP for p in trusted)


def test_planted_identifiers(spark):
    """Precision and recall of what is found beyond the fixed forms."""
    rows, planted = corpus(11, 400)
    texts = dict(rows)
    right = said = 0
    for r in pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found = {texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"][len(r["base"]) :]}
        right += len(found & planted.get(r["doc_id"], set()))
        said += len(found)
    assert right / sum(map(len, planted.values())) >= 0.95 and right / said >= 0.95


def test_both_ways_of_masking(spark):
    rows, planted = corpus()
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, own_found long")
    few, many = ({r["doc_id"]: r["text"] for r in pii.masked(spark, df, most=m).collect()} for m in (10**6, 0))
    assert few == many and all(x not in few[i] for i, xs in planted.items() for x in xs)


def test_totals_by_join(spark):
    rows, _ = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = spark.createDataFrame([(p,) for s in pii.instances(rows[0][1], pii.base_spans(rows[0][1])) for p in s["patterns"]], "pattern long")
    a, b = ({r["pattern"]: r["total"] for r in pii.totals(df, wanted, m).collect()} for m in (100, 0))
    assert a == b and len(a) == wanted.distinct().count()


def test_secrets_of_the_tables(spark):
    """The one telling context of the test tables: token = "<40 hexadecimal digits>"."""
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op7_contextual_pii(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = sorted(tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("id:"))
        assert found == [m.span(1) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', texts[r["doc_id"]])]
        assert r["n_email"] == sum(s.startswith("email:") for s in r["spans"].split(","))


