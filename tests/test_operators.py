"""Facts about the engine's operators on small graphs and logs."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import ids, markup
from palimpsest.functions import text as T
from palimpsest.operators import edits, graph, log, replicate, similarity, view
from palimpsest.sources import log_file, store

PAGE, CHAIN = "Page", "Chain"


class Doc:
    """Builds small graphs: names are ids."""

    def __init__(self):
        self.nodes, self.edges = [], []

    def text(self, i, line=None):
        self.nodes.append((i, "Text", i if line is None else line, None, None, None))
        return i

    def _held(self, i, *children):
        self.edges += [(i, k, c) for k, c in enumerate(children)]
        return i

    def list(self, i, layout, *children):
        self.nodes.append((i, "List", None, layout, None, None))
        return self._held(i, *children)

    def styled(self, i, kind, styles, child):
        self.nodes.append((i, "Styled", None, None, kind, styles))
        return self._held(i, child)

    def frames(self, spark):
        return store.in_memory(spark, self.nodes, self.edges)


def roots(spark, *names, column="root"):
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def pairs(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


# -- log -----------------------------------------------------------------------


def kv(spark, rows):
    return spark.createDataFrame([(0, k, v, v is None, ts, i) for i, (k, v, ts) in enumerate(rows)], store.LOG)


def test_versions_merge_and_trash(spark):
    held = kv(spark, [("foo", "1", 10), ("foo", "2", 20), ("foo", None, 30), ("foo", "4", 40), ("bar", "x", 40), ("bar", None, 50)])
    assert [r["version_no"] for r in log.versions(held).where("key = 'foo'").orderBy("seq").collect()] == [1, 2, 3, 4]
    assert pairs(log.latest(held), "key", "value") == {("foo", "4")}
    assert pairs(log.unremoved(held), "key", "value") == {("foo", "4"), ("bar", "x")}
    assert pairs(log.version(held, 3), "key", "value") == {("foo", None)}
    merged = log.merge(held)
    assert pairs(merged, "key", "value", "is_removed") == {("foo", "4", False), ("bar", None, True)}
    assert pairs(log.unremoved(merged), "key") == {("foo",)}
    assert pairs(log.latest(log.as_of(held, commit_ts=25)), "key", "value") == {("foo", "2")}
    assert pairs(log.latest(log.as_of(held, seq=5)), "key", "value") == {("foo", "4"), ("bar", "x")}
    assert log.last_updated(held).first()[0] == 50
    assert log.last_updated(held.where("false")).first()[0] is None


def test_stage_takes_the_last_write(spark):
    held = kv(spark, [("a", "1", 10)])
    writes = spark.createDataFrame([(0, "a", "2", False, 0), (0, "a", "3", False, 1), (0, "b", "9", False, 2)], "slot int, key string, value string, is_removed boolean, n long")
    after = log.stage(held, writes, 99, 100)
    assert pairs(log.latest(after), "key", "value", "commit_ts") == {("a", "3", 99), ("b", "9", 99)}


def test_conflicts(spark):
    held = kv(spark, [("foo", "1", 10), ("bar", "1", 10), ("foo", "2", 20)])
    reads = spark.createDataFrame([("t1", 0, "foo", 2), ("t1", 0, "bar", 2), ("t2", 0, "bar", 2), ("t3", 0, "none", 0)], "tx_id string, slot int, key string, seq long")
    assert pairs(log.conflicts(reads, held), "tx_id", "conflict") == {("t1", True), ("t2", False), ("t3", False)}


def test_monotonic(spark):
    held = kv(spark, [("a", str(i), ts) for i, ts in enumerate([5, 3, 9, 1, 2, 11, 4])])
    assert [r["monotonic_ts"] for r in log.monotonic(held, chunk=2).orderBy("seq").collect()] == [5, 5, 9, 9, 9, 11, 11]


def test_crc_and_recovery(spark):
    import zlib

    rows = [(0, 0, b"ab", zlib.crc32(b"abc")), (0, 1, b"c", None), (1, 2, b"d", 1), (2, 3, b"e", zlib.crc32(b"e"))]
    entries = spark.createDataFrame([tuple(map(lambda x: bytearray(x) if isinstance(x, bytes) else x, r)) for r in rows], "tx_id long, seq long, bytes binary, crc long")
    assert pairs(log.commit_crc(entries).where("tx_id = 0"), "crc") == {(zlib.crc32(b"abc"),)}
    assert pairs(log.recover(entries), "seq") == {(0,), (1,)}


def test_binary_log(spark, tmp_path):
    data = log_file.write([(1000, [(0, b"\xa3foo", b"\x01"), (1, b"\x05", b"\xa1x")]), (2000, [(0, b"\xa3foo", None)])])
    rows = list(log_file.read(data))
    assert [(s, log_file.unpack(k), v and log_file.unpack(v), ts) for s, k, v, ts, _ in rows] == [(0, "foo", 1, 1000), (1, 5, "x", 1000), (0, "foo", None, 2000)]
    assert len(list(log_file.read(data[:-1]))) == 2  # the torn transaction is left out
    broken = bytearray(data)
    broken[-1] ^= 255
    assert len(list(log_file.read(bytes(broken)))) == 2
    (tmp_path / "a.log").write_bytes(data)
    (tmp_path / "empty.log").write_bytes(b"")
    assert log_file.scan(spark, str(tmp_path)).count() == 3
    assert log_file.unpack(bytes([0x82, 0xA1, 0x61, 0x92, 0xC3, 0xC0, 0xA1, 0x62, 0xCD, 1, 0])) == {"a": [True, None], "b": 256}


# -- graph ---------------------------------------------------------------------


def test_parents_with_repeats(spark):
    d = Doc()
    d.list("chain", CHAIN, d.text("foo"), d.text("bar"), "foo")
    _, edges = d.frames(spark)
    assert pairs(graph.parents(edges), "child_id", "n_parents", "n_distinct_parents") == {("foo", 2, 1), ("bar", 1, 1)}


def test_descendants(spark):
    d = Doc()
    d.list("root", PAGE, d.list("p1", PAGE, d.text("a"), d.text("b")), d.list("c1", CHAIN, d.text("c")), d.list("c2", CHAIN, d.list("p2", PAGE, d.text("d"), d.text("e"))))
    nodes, edges = d.frames(spark)
    assert graph.descendants(edges, roots(spark, "root")).count() == 10
    links = graph.linked(edges, graph.span_flags(nodes, edges))
    found = pairs(graph.descendants_until_links(links, roots(spark, "root")), "node")
    assert len(found) == 8 and not found & {("d",), ("e",)}


def test_ancestor_path(spark):
    d = Doc()
    d.list("outer", CHAIN, d.list("page", PAGE, d.list("c1", CHAIN, d.list("c2", CHAIN, d.list("c3", CHAIN, d.text("t"))))))
    nodes, edges = d.frames(spark)
    path = graph.ancestor_path(edges, roots(spark, "t", column="node"))
    assert pairs(path, "depth", "ancestor") == {(1, "c3"), (2, "c2"), (3, "c1"), (4, "page"), (5, "outer")}
    links = graph.linked(edges, graph.span_flags(nodes, edges))
    assert graph.ancestor_path(links, roots(spark, "t", column="node")).count() == 4
    loop = store.in_memory(spark, [], [("a", 0, "b"), ("b", 0, "a")])[1]
    assert graph.ancestor_path(loop, roots(spark, "a", column="node")).count() == 2


def test_flags(spark):
    d = Doc()
    d.styled("s1", "Span", ["Bold"], d.styled("s2", "Span", ["Italic"], d.list("page", PAGE, d.text("x", "   "))))
    d.styled("b", "Block", ["Quote"], d.text("y"))
    d.styled("loop1", "Span", ["Bold"], "loop2")
    d.styled("loop2", "Span", ["Bold"], "loop1")
    d.list("same", CHAIN, "y", "y")
    nodes, edges = d.frames(spark)
    spans = dict(pairs(graph.span_flags(nodes, edges), "id", "is_span"))
    assert spans == {"s1": False, "s2": False, "page": False, "x": True, "b": False, "y": True, "loop1": False, "loop2": False, "same": True}
    blank = dict(pairs(graph.blank_flags(nodes, edges), "id", "is_blank"))
    assert blank["x"] and blank["s1"] and blank["loop1"] and not blank["b"] and not blank["same"]
    assert dict(pairs(graph.revisits(edges, roots(spark, "same", "b", "loop1")), "root", "revisits")) == {"same": True, "b": False, "loop1": True}
    assert dict(pairs(graph.cyclic(edges, roots(spark, "same", "loop1")), "root", "cyclic")) == {"same": False, "loop1": True}
    assert dict(pairs(graph.shared(edges, roots(spark, "same", "s1")), "root", "shared")) == {"same": True, "s1": False}


def both_sides(spark, d):
    nodes, edges = d.frames(spark)
    return [{(a, b) for a, b in pairs(graph.siblings(nodes, edges, side), "id", "sibling")} for side in (True, False)]


def test_siblings_in_pages(spark):
    d = Doc()
    d.list("root", PAGE, d.list("p1", PAGE, d.text("first"), d.text("foo")), d.list("p2", PAGE, d.text("bar")), d.list("p3", PAGE, d.text("baz"), d.text("last")))
    before, after = both_sides(spark, d)
    assert ("bar", "foo") in before and ("bar", "baz") in after
    assert not [p for p in before if p[0] == "first"] and not [p for p in after if p[0] == "last"]
    assert ("p2", "foo") in before and ("p2", "baz") in after


def test_siblings_links_blanks_and_asides(spark):
    d = Doc()
    d.list("page", PAGE, d.list("chain", CHAIN, d.list("linked", PAGE, d.text("inside"))), d.text("blank", " "), d.styled("aside", "Block", ["Aside"], d.text("note")), d.text("text"))
    before, after = both_sides(spark, d)
    assert ("text", "linked") in before
    assert ("chain", "text") in after and not [p for p in after if p[0] == "linked"]
    assert not [p for p in before | after if p[0] == "blank"]
    assert ("note", "linked") in before and ("note", "text") in after
    assert not [p for p in after if p[0] == "inside"]  # a link's inside ends at the link


def test_preview(spark):
    d = Doc()
    d.list("p", PAGE, d.styled("i", "Span", ["Italic"], d.text("foo")), d.text("bar"))
    d.list("c", CHAIN, "foo", "bar")
    d.list("empty", PAGE)
    d.list("blank", PAGE, d.text("b", "  "))
    d.list("cyc", CHAIN, "foo", "cyc")
    d.list("way", PAGE, "way")
    nodes, edges = d.frames(spark)
    got = {r["root"]: (r["outcome"], r["block_id"], r["span_styles"]) for r in graph.preview(nodes, edges, roots(spark, "p", "c", "empty", "blank", "cyc", "way")).collect()}
    assert got == {"p": ("Block", "foo", ["Italic"]), "c": ("Block", "c", []), "empty": ("Empty", None, []), "blank": ("Empty", None, []), "cyc": ("Cyclic", None, []), "way": ("Cyclic", None, [])}


# -- similarity ----------------------------------------------------------------


def blocks(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def brute_grams(text):
    from collections import Counter

    b = b"\0\0\0" + text.encode() + b"\0\0\0"
    return Counter(b[i : i + 4].hex().upper() for i in range(len(b) - 3))


def test_grams(spark):
    texts = ["", "a", "foo", "héllo wörld", "日本語"]
    found = {}
    for r in similarity.gram_rows(blocks(spark, *texts)).collect():
        found.setdefault(r["id"], {})[r["gram"]] = r["n"]
    assert found == {i: dict(brute_grams(t)) for i, t in enumerate(texts)}
    assert [r["n_grams"] for r in similarity.gram_counts(blocks(spark, *texts)).orderBy("id").collect()] == [sum(brute_grams(t).values()) for t in texts]


def searched(spark, term, *texts):
    terms = spark.createDataFrame([(0, term)], "term_id int, term string")
    return [(r["id"], r["score"]) for r in similarity.search(terms, blocks(spark, *texts)).orderBy(*similarity.search_order()).collect()]


def test_search(spark):
    texts = ["This is the text foo", "This is the text bar", "Another text that is the text foo", ""]
    assert [i for i, _ in searched(spark, "foo", *texts)] == [0, 2]
    found = searched(spark, "This is the text foo", *texts)
    assert found[0] == (0, 1.0) and found[1][1] < 1 and len(found) == 3
    assert len([1 for _, s in searched(spark, "text foo", *texts) if s > 0.7]) == 2
    assert searched(spark, "", *texts) == []
    assert searched(spark, "x", "x", "xy") == [(0, 1.0)]


def test_chains_are_searched_whole(spark):
    spans = spark.createDataFrame([(1, 0, "This is t", False), (1, 1, "he text foo", False), (2, 0, "foo", False), (2, 1, "bar", True)], "id int, ix int, text string, is_link boolean")
    chains = similarity.chain_text(spans)
    assert pairs(chains, "id", "text") == {(1, "This is the text foo"), (2, "foo")}


def brute_overlaps(texts):
    out = set()
    for x, s in enumerate(texts):
        for y, t in enumerate(texts):
            g, h = brute_grams(s), brute_grams(t)
            n, m = sum(g.values()), sum(h.values())
            top = max(n, m)
            a, b, i = (255 * v // top for v in (n, m, sum((g & h).values())))
            if x != y and min(a, b) and 2 * i > min(a, b):
                out.add((x, y, a, b, i))
    return out


def test_overlaps_against_brute_force(spark):
    texts = ["This is a sentence about foo.", "This is a sentence about bar.", "same", "same", "", "", "a", "A very long text that contains the words: This is a sentence about foo. And more." * 3, "aaaaaaaaaa", "aaaaa", "x" * 700, "xxx"]
    found = pairs(similarity.overlaps(blocks(spark, *texts)), "src_id", "id", "a", "b", "i")
    assert found == brute_overlaps(texts)
    back = similarity.reverse(similarity.overlaps(blocks(spark, *texts)))
    assert pairs(back, "src_id", "id", "a", "b", "i") == found
    between = similarity.overlaps_between(blocks(spark, *texts), blocks(spark, *texts)).where("src_id <> id")
    assert pairs(between, "src_id", "id", "a", "b", "i") == found


def salad(n, seed=1):
    import random

    r = random.Random(seed)
    words = ["the", "tion", "her", "én", "日本", "over", "a", "\0", "ing", "stand"]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 5, 9, 30]))) for _ in range(n)]
    return texts + [t.replace("e", "3") for t in texts[: n // 3]] + texts[: n // 5] + [" ".join(words) * 300]


def test_overlaps_by_sides(spark, monkeypatch):
    """Whatever sides the texts are cut into, the pairs are those of brute force, and neither tokens nor candidates are written."""
    texts, made = salad(60), []
    put = similarity.Scratch.put
    monkeypatch.setattr(similarity.Scratch, "put", lambda self, df, name="t": made.append(name) or put(self, df, name))
    monkeypatch.setattr(similarity, "SIDE_TEXTS", 7)
    assert pairs(similarity.overlaps(blocks(spark, *texts)), "src_id", "id", "a", "b", "i") == brute_overlaps(texts)
    assert len([n for n in made if n.startswith("half")]) > 4 and not {"tokens", "ranked", "pairs"} & set(made)


def test_sides_look_at_no_other_pairs(monkeypatch):
    """Whatever the width of a side's bitmaps, its pairs are those of brute force; nearly all that are counted one by one qualify."""
    import numpy as np
    import pyarrow as pa

    from palimpsest.operators import bags

    texts = sorted(set(salad(60, 3)) | {f"{i} the same {i * i} talk {i * 77}" for i in range(40)})
    counted = bags.totals(pa.Table.from_batches(list(bags.frequencies([pa.record_batch([pa.array(texts)], ["text"])]))))
    rows, seen, overlap = pa.table({"key": np.arange(len(texts)), "text": texts}), [], bags.overlap
    monkeypatch.setattr(bags, "overlap", lambda s, m, x: seen.append(len(x)) or overlap(s, m, x))
    for width, most in ((3 << 26, 1.5), (1 << 14, 3), (40, len(texts))):  # 40 bytes: nearly all tokens share rows
        monkeypatch.setattr(bags, "BITMAPS", width)
        found, seen[:] = [], []
        for here, key, *numbers in bags.Side(rows, counted).overlaps(np.arange(len(texts)), *bags.strings(rows.column(1).combine_chunks())):
            found += [(int(x), int(key), int(a), int(b), int(i)) for x, a, b, i in zip(here, *numbers, strict=True)]
        order = np.lexsort((np.arange(len(texts)), [len(t.encode()) for t in texts]))
        found = [(int(order[x]), y, a, b, i) for x, y, a, b, i in found]
        assert len(found) == len(set(found)) and set(found) | {(y, x, b, a, i) for x, y, a, b, i in found} == brute_overlaps(texts)
        assert len(found) <= sum(seen) <= most * len(found)


def test_reversed_overlaps_of_large_groups_of_copies(spark):
    texts = ["the same line", "the same lines"] * 12 + ["", "other"]
    back = similarity.reverse(similarity.overlaps(blocks(spark, *texts)))
    assert pairs(back, "src_id", "id", "a", "b", "i") == {(y, x, b, a, i) for x, y, a, b, i in brute_overlaps(texts)}
    assert similarity.overlaps(blocks(spark, "alone")).count() == 0 and similarity.overlaps(blocks(spark, "x").where("false")).count() == 0


def test_best_overlaps_by_sides(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SIDE", 200)
    texts = salad(40, 2)
    best = similarity.top_k(similarity.overlaps(blocks(spark, *texts)), 2, "src_id", similarity.overlap_order())
    by = {}
    for x, y, a, b, i in brute_overlaps(texts):
        by.setdefault(x, []).append((-i, -a, -b, y))
    assert pairs(best, "src_id", "rank", "id") == {(x, k, f[3]) for x, found in by.items() for k, f in enumerate(sorted(found)[:2], 1)}


def brute_best(texts, k):
    by = {}
    for x, y, a, b, i in brute_overlaps(texts):
        by.setdefault(x, []).append((-i, -a, -b, y))
    return {(x, n, y, -a, -b, -i) for x, found in by.items() for n, (i, a, b, y) in enumerate(sorted(found)[:k], 1)}


def test_best_overlaps_against_brute_force(spark, monkeypatch):
    """Copies, texts of equal bags, more copies than are asked for, equal scores, and sides of a few texts."""
    texts = salad(40, 11) + ["same line"] * 6 + ["two of them"] * 2 + ["aaaabaaaaacaaaa", "aaaacaaaaabaaaa", "aaaabaaaaacaaaa", "", ""]
    texts += [f"the same long line of talk with the number {i}" for i in range(12)]
    monkeypatch.setattr(similarity, "SIDE_TEXTS", 9)
    for k in (1, 3):
        found = similarity.best_overlaps(blocks(spark, *texts), k)
        rows = [tuple(r) for r in found.select("src_id", "rank", "id", "a", "b", "i").collect()]
        assert len(rows) == len(set(rows)) and set(rows) == brute_best(texts, k)
    none = similarity.best_overlaps(blocks(spark, "x").where("false"), 3)
    assert none.count() == 0 and similarity.best_overlaps(blocks(spark, "alone"), 3).count() == 0


def test_best_overlaps_deal_out_no_pairs(spark, monkeypatch):
    """What leaves Python and is shuffled has a few matches for each text, not all of them."""
    words = [f"the same long line of talk with the number {i}" for i in range(200)]
    written, put = [], similarity.Scratch.put
    monkeypatch.setattr(similarity.Scratch, "put", lambda self, df, name="t", *more: (table := put(self, df, name, *more), written.append(table.count()))[0])
    found = similarity.best_overlaps(blocks(spark, *words), 3)
    assert found.count() == 600 and max(written) <= 200
    found.collect()
    assert sum(python_rows(found)) <= 200 * (1 + spark.sparkContext.defaultParallelism)
    monkeypatch.setattr(similarity, "FEW", 10)  # the places are too many to be told
    assert similarity.best_overlaps(blocks(spark, *words), 3).exceptAll(found).isEmpty()


def test_query_of_best_overlaps_deals_out_no_pairs(spark, tmp_path):
    from palimpsest.plans import queries

    talk = [(c, t, "user", f"the same long line of talk with the number {c} {t}") for c in range(40) for t in range(3)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.q_overlap_topk(spark, str(tmp_path))
    assert len(found.collect()) == 360 and sum(python_rows(found)) <= 120 * (1 + spark.sparkContext.defaultParallelism)


def brute_search(terms, texts):
    """(term, text, i): the bags of both, the term's without the grams at its ends, and nothing for terms of zero grams only."""
    from collections import Counter

    out = set()
    for x, term in enumerate(terms):
        b = b"\0\0\0" + term.encode() + b"\0\0\0"
        g = [b[i : i + 4].hex() for i in range(len(b) - 3)]
        drop = min((len(g) - 1) // 2, 3)
        g = Counter(g[drop : len(g) - drop])
        for y, t in texts.items():
            h = sum((brute_grams(p) for p in t), Counter())
            i = 255 * sum((g & Counter({k.lower(): n for k, n in h.items()})).values()) // sum(g.values())
            if set(g) != {"00000000"} and i >= 77:
                out.add((x, y, i))
    return out


def indexed(df):
    """Whether the blocks stream past an index: no text is dealt out, and no gram is a key."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "MapInArrow" in plan and "Exchange" not in plan


def test_search_streams_past_an_index(spark, monkeypatch):
    terms, texts = salad(12, 3), salad(50, 4)
    asked = spark.createDataFrame(list(enumerate(terms)), "term_id int, term string")
    want = brute_search(terms, {i: [t] for i, t in enumerate(texts)})
    for bytes_, meetings in ((1 << 19, 1 << 21), (40, 60)):
        monkeypatch.setattr(similarity.bags, "BYTES", bytes_)
        monkeypatch.setattr(similarity.bags, "MEETINGS", meetings)
        found = similarity.search(asked, blocks(spark, *texts))
        assert indexed(found) and pairs(found, "term_id", "id", "i") == want
    monkeypatch.setattr(similarity, "INDEXED", 1)
    assert pairs(similarity.search(asked, blocks(spark, *texts)), "term_id", "id", "i") == want


def python_rows(df):
    """How many rows each step in Python of a plan that has been run gave back."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        if node.metrics().contains("pythonNumRowsReceived"):
            out.append(node.metrics().apply("pythonNumRowsReceived").value())
    return out


def test_a_found_pair_is_no_row_in_python(spark):
    """However many terms a block is found by, it leaves Python as one row."""
    terms = [f"the same long line of talk {i}" for i in range(30)]
    asked = spark.createDataFrame([((i, -i), t) for i, t in enumerate(terms)], "term_id struct<a int, b int>, term string")
    found = similarity.search(asked, blocks(spark, *terms, "", "quite different"))
    assert {(r["term_id"]["a"], r["id"]) for r in found.collect() if r["term_id"]["b"] == -r["term_id"]["a"]} == {(i, j) for i in range(30) for j in range(30)}
    assert python_rows(found) == [30]


def test_counter_against_brute_force(monkeypatch):
    """Sparse and dense tokens, repeated grams, and the least that has to be shared."""
    import numpy as np
    import pyarrow as pa
    from palimpsest.operators import bags

    monkeypatch.setattr(bags, "FEW", 2)
    texts, rows = salad(30, 8) + ["\0\0\0\0", ""], salad(40, 9) + ["", "aaaaaaaaaa", "\0", "x" * 300]
    owner, token = bags.tokens(*bags.strings(pa.array(texts)))
    want = {(r, t): sum((brute_grams(x) & brute_grams(y)).values()) for r, x in enumerate(rows) for t, y in enumerate(texts)}
    for dense, least in ((0, 1), (20, 1), (20, np.arange(1, len(texts) + 1))):
        counter = bags.Counter(owner, token, len(texts), dense)
        found = {(int(r), int(t)): int(n) for part in counter.counts(*bags.strings(pa.array(rows)), least) for r, t, n in zip(*part, strict=True)}
        assert found == {(r, t): n for (r, t), n in want.items() if n >= (least if isinstance(least, int) else least[t])}
    assert not list(bags.Counter(owner[:0], token[:0], 0).counts(*bags.strings(pa.array(rows))))


def test_best_found_of_rows_that_share_an_id(spark):
    """Rows of one id are one bag, as in the SQL."""
    terms = ["the tion", "standing over her"]
    asked = spark.createDataFrame(list(enumerate(terms)), "term_id int, term string")
    held = [(1, "the ti"), (1, "tion her"), (2, "standing"), (3, None), (4, "over her")]
    found = similarity.search(asked, spark.createDataFrame(held, "id int, text string"))
    want = brute_search(terms, {1: ["the ti", "tion her"], 2: ["standing"], 4: ["over her"]})
    assert pairs(found, "term_id", "id", "i") == want
    best = similarity.top_k(similarity.search(asked, blocks(spark, *salad(30, 5))), 1)
    assert best.count() == len({x for x, _, _ in brute_search(terms, dict(enumerate([t] for t in salad(30, 5))))})


def test_overlaps_between_streams_past_an_index(spark):
    sources, texts = salad(10, 6), salad(40, 7)
    found = similarity.overlaps_between(blocks(spark, *sources), blocks(spark, *texts))
    n = len(sources)
    assert indexed(found) and pairs(found, "src_id", "id", "a", "b", "i") == {(x, y - n, a, b, i) for x, y, a, b, i in brute_overlaps(sources + texts) if x < n <= y}


def test_changes_and_upsert(spark):
    before, after = blocks(spark, "foo", "bar"), blocks(spark, "foo", "baz")
    new = similarity.upsert(similarity.gram_rows(before), similarity.changes(before, after))
    assert pairs(new, "id", "gram", "n") == pairs(similarity.gram_rows(after), "id", "gram", "n")


# -- edits ---------------------------------------------------------------------


def children(edges, parent):
    return [r["child_id"] for r in edges.where(F.col("parent_id") == parent).orderBy("child_index").collect()]


def test_list_edits(spark):
    _, edges = store.in_memory(spark, [], [("c", 0, "foo"), ("c", 1, "bar"), ("other", 0, "foo")])
    edit = lambda *row: spark.createDataFrame([row], ("parent_id string, at int" + ", child_id string" * (len(row) > 2)))
    assert children(edits.insert(edges, edit("c", 1, "x")), "c") == ["foo", "x", "bar"]
    assert children(edits.remove(edges, edit("c", 0)), "c") == ["bar"]
    assert children(edits.replace(edges, edit("c", 0, "baz")), "c") == ["baz", "bar"]
    pushed = edits.push(edges, spark.createDataFrame([("c", "qux"), ("new", "foo")], "parent_id string, child_id string"))
    assert children(pushed, "c") == ["foo", "bar", "qux"] and children(pushed, "new") == ["foo"] and children(pushed, "other") == ["foo"]


def test_orphans_and_restore(spark):
    d = Doc()
    d.list("c", CHAIN, d.list("d1", CHAIN, d.text("foo"), d.text("own")), d.list("d2", CHAIN, "foo"), d.text("bar"))
    d.list("elsewhere", CHAIN, "bar")
    nodes, edges = d.frames(spark)
    new_nodes, new_edges = store.in_memory(spark, [("c", "List", None, CHAIN, None, None)], [("c", 0, "d2")])
    kept, after, lost = edits.swap(nodes, edges, new_nodes, new_edges)
    assert pairs(lost, "id") == {("d1",), ("own",)}
    assert pairs(graph.parents(after), "child_id", "n_parents") == {("d2", 1), ("foo", 1), ("bar", 1)}
    back_nodes, back_edges = edits.restore(nodes, edges, kept, roots(spark, "d1"))
    assert pairs(back_nodes, "id") == {("d1",), ("own",)} and pairs(back_edges, "child_id") == {("foo",), ("own",)}
    gone = edits.orphans(edges, roots(spark, "c", column="id"), edges.where("false"))
    assert pairs(gone, "id") == {("d1",), ("d2",), ("foo",), ("own",)}


# -- view ----------------------------------------------------------------------


def test_sections(spark):
    d = Doc()
    d.list("page", PAGE, d.text("a"), d.list("ch", CHAIN, d.text("x"), d.text("y")), d.text("shared"), d.list("sub", PAGE, d.text("z")))
    d.list("other", PAGE, "shared")
    d.list("top", CHAIN, d.text("l"), d.text("r"))
    nodes, edges = d.frames(spark)
    rows = view.sections(nodes, edges, roots(spark, "page", "top")).orderBy("root", "path").collect()
    assert [(r["root"], r["section_id"], r["start"], r["has_multiple_parents"]) for r in rows] == [("page", None, "a", False), ("page", None, "ch", False), ("page", "shared", "shared", True), ("page", None, "z", False), ("top", None, "l", False), ("top", None, "r", False)]


def test_spans_and_subsections(spark):
    d = Doc()
    d.styled("q", "Block", ["Quote"], d.list("c", CHAIN, d.text("a"), d.styled("i", "Span", ["Bold"], d.text("b")), d.list("pg", PAGE, d.text("in"))))
    d.list("root", PAGE, "q", d.text("t"))
    nodes, edges = d.frames(spark)
    got = [(r["id"], r["block_styles"]) for r in view.subsections(nodes, edges, roots(spark, "root")).orderBy("path").collect()]
    assert got == [("c", ["Quote"]), ("t", [])]
    spans = [(r["id"], r["is_link"], r["span_styles"]) for r in view.spans(nodes, edges, roots(spark, "c")).orderBy("path").collect()]
    assert spans == [("a", False, []), ("b", False, ["Bold"]), ("pg", True, [])]


def test_views_of_deep_documents_and_cycles(spark):
    d = Doc()
    for kind, shape in (("p", PAGE), ("c", CHAIN)):
        d.text(f"{kind}70")
        for i in reversed(range(70)):
            d.list(f"{kind}{i}", shape, f"{kind}{i + 1}")
    d.list("u", CHAIN, d.text("s"), "v")
    d.list("v", CHAIN, "u", d.text("t"))
    nodes, edges = d.frames(spark)
    assert pairs(view.subsections(nodes, edges, roots(spark, "p0")), "root", "id") == {("p0", "p70")}
    assert pairs(view.sections(nodes, edges, roots(spark, "p0")), "root", "start") == {("p0", "p70")}
    found = view.spans(nodes, edges, roots(spark, "c0", "u"))
    assert found.count() == 3 and pairs(found, "root", "id") == {("c0", "c70"), ("u", "s"), ("u", "t")}


def test_tile_branches(spark):
    d = Doc()
    d.list("p1", PAGE, d.text("A"), d.text("B"), d.text("C"))
    d.list("p2", PAGE, "A", "B", d.list("ch", CHAIN, d.text("X"), d.text("Y")))
    nodes, edges = d.frames(spark)
    assert pairs(view.branches(nodes, edges, roots(spark, "p1"), False), "root", "id", "sibling") == {("p1", "B", "p2")}
    assert pairs(view.branches(nodes, edges, roots(spark, "p1"), True), "root", "id", "sibling") == set()
    tables = view.tile(nodes, edges, roots(spark, "p1"), spark.createDataFrame([("p2", 7)], "id string, ts long"))
    assert [tuple(r) for r in tables["after"].collect()] == [("p1", "B", "p2", 7)]
    assert tables["sections"].count() == 3


def test_branches_of_a_common_line_are_rows_only_at_the_end(spark, monkeypatch):
    d, n = Doc(), 40
    d.text("hot")
    for i in range(n):
        d.list(f"p{i}", PAGE, d.text(f"x{i}"), "hot", d.text(f"y{i}"))
    nodes, edges = d.frames(spark)
    written, put = [], view.Scratch.put
    monkeypatch.setattr(view.Scratch, "put", lambda self, df, name="t": (table := put(self, df, name), written.append(table.count()))[0])
    pages = roots(spark, *(f"p{i}" for i in range(n)))
    around = view.Surroundings(nodes, edges, pages)
    for before in (True, False):
        found = view.branches(nodes, edges, pages, before, around)
        assert pairs(found, "root", "id", "sibling") == {(f"p{i}", "hot", f"p{j}") for i in range(n) for j in range(n) if i != j}
    assert max(written) < 8 * n  # the branches are n * (n - 1) rows


def test_branches_of_a_common_line_are_made_by_several_tasks(spark, monkeypatch):
    d, n = Doc(), 40
    d.text("hot")
    for i in range(n):
        d.list(f"p{i}", PAGE, d.text(f"x{i}"), "hot", d.text(f"y{i}"))
    nodes, edges = d.frames(spark)
    monkeypatch.setattr(view, "DEALT", 100, raising=False)
    found = view.branches(nodes, edges, roots(spark, *(f"p{i}" for i in range(n))), True)
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = found.select("root", "sibling", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(rows) == n * (n - 1) and {(r["root"], r["sibling"]) for r in rows} == {(f"p{i}", f"p{j}") for i in range(n) for j in range(n) if i != j}
    assert len({r["task"] for r in rows}) > 1


def test_overlaps_write_no_pairs(spark, monkeypatch):
    words = [f"the same long line of talk with the number {i}" for i in range(60)]
    blocks = spark.createDataFrame(list(enumerate(words)), "id long, text string")
    written, put = [], similarity.Scratch.put
    monkeypatch.setattr(similarity.Scratch, "put", lambda self, df, name="t": (table := put(self, df, name), written.append(table.count()))[0])
    monkeypatch.setattr(similarity, "SIDE_TEXTS", 25)  # several sides
    found = similarity.overlaps(blocks)
    assert {(r["src_id"], r["id"]) for r in found.collect()} == {(i, j) for i in range(60) for j in range(60) if i != j}
    assert max(written) <= 60


def test_lineage_and_parent_branches(spark):
    d = Doc()
    d.list("top", PAGE, d.list("holder", CHAIN, d.list("linked", PAGE, d.text("t"))))
    nodes, edges = d.frames(spark)
    assert pairs(view.parent_branches(nodes, edges, roots(spark, "linked")), "root", "parent_id") == {("linked", "holder")}
    assert pairs(view.lineage(nodes, edges, roots(spark, "t", column="id")), "depth", "ancestor") == {(0, "t"), (1, "linked")}


# -- markup --------------------------------------------------------------------

CASES = {
    "just text": ([], [([], "just text")]),
    "# A *Bold* Heading": (["Heading"], [([], "A "), (["Bold"], "Bold"), ([], " Heading")]),
    "##>#>>#>> A Heading & Quote": (["Heading", "Quote"], [([], "A Heading & Quote")]),
    ",>-# All": (["Heading", "List", "Quote", "Aside"], [([], "All")]),
    ",>-#no styles": ([], [([], ",>-#no styles")]),
    "~_*all*_~": ([], [(["Bold", "Italic", "Struck"], "all")]),
    "never _ends": ([], [([], "never "), (["Italic"], "ends")]),
    r"\_not \italic, _it \_ until_": ([], [([], r"_not \italic, "), (["Italic"], "it _ until")]),
    r"\#> neither": ([], [([], "#> neither")]),
    r"\#>neither": ([], [([], r"\#>neither")]),
    "bold *and _italic* and ~struck overlap_ here~": ([], [([], "bold "), (["Bold"], "and "), (["Bold", "Italic"], "italic"), (["Italic"], " and "), (["Italic", "Struck"], "struck overlap"), (["Struck"], " here")]),
    "empty ** bold": ([], [([], "empty "), ([], " bold")]),
    "empty_*": ([], [([], "empty")]),
    "trailing \\": ([], [([], "trailing ")]),
    r"a\\b": ([], [([], r"a\b")]),
}


#: Spans that are one after writing: neighbours of one style, as an empty pair of marks leaves them.
MERGED = {"empty ** bold": [([], "empty  bold")]}


@pytest.mark.parametrize("line", CASES)
def test_markup(line):
    assert markup.parse(line) == CASES[line]
    again = markup.parse(markup.write(*markup.parse(line)))
    assert again == (markup.parse(line)[0], MERGED.get(line, markup.parse(line)[1]))


def test_markup_edges(spark):
    with pytest.raises(markup.MarkupError):
        markup.parse("a\nb")
    assert markup.from_json(markup.to_json("># *x* y")) == "># *x* y"
    assert markup.to_node("# a") == {"Styled": {"Block": ["Heading"], "child": {"Text": "a"}}}
    assert markup.to_node("a *b*")["children"][0]["List"] == "Chain"
    df = spark.createDataFrame([(x,) for x in CASES] + [(None,)], "line string")
    got = {r["line"]: r["m"] for r in df.select("line", markup.parse_column("line").alias("m")).collect()}
    for line, (styles, spans) in CASES.items():
        assert got[line]["block_styles"] == styles and [(s["styles"], s["text"]) for s in got[line]["spans"]] == spans
    styles = {r["line"]: (r["s"], r["r"]) for r in df.where("line is not null").select("line", T.block_styles(F.col("line")).alias("s"), T.block_rest(F.col("line")).alias("r")).collect()}
    assert styles["##>#>>#>> A Heading & Quote"] == (["Heading", "Quote"], "A Heading & Quote")
    assert styles[r"\#> neither"] == ([], "#> neither")


# -- stores and replication ------------------------------------------------------


def test_flatten():
    root, nodes, edges = store.flatten({"Text": "Text\nwith\n\nnewlines!\n"})
    assert nodes[0][3] == PAGE and len(edges) == 5 and [n[2] for n in nodes[1:]].count("") == 2
    _, nodes, _ = store.flatten({"Styled": {"Span": [], "child": {"Text": "x"}}})
    assert len(nodes) == 1
    with pytest.raises(store.NodeError):
        store.flatten({"Other": 1})


def test_node_json(spark):
    _, nodes, edges = store.flatten({"List": CHAIN, "children": [{"Text": 'a "b"'}, {"Styled": {"Block": ["Quote"], "child": {"Text": "c"}}}]}, iter("rabq").__next__)
    import json

    got = {r["id"]: json.loads(r["json"]) for r in store.to_json(*store.in_memory(spark, nodes, edges)).collect()}
    assert got["r"] == {"List": [CHAIN, ["a", "b"]]} and got["a"] == {"Text": 'a "b"'} and got["b"] == {"Styled": [{"Block": ["Quote"]}, "q"]}
    with pytest.raises(Exception, match="newline"):
        spark.createDataFrame([('{"Text": "a\\nb"}',)], "j string").select(store.texts_from_json(F.col("j"))).collect()


def test_xor_is_an_involution(spark):
    df = spark.range(50).select(ids.from_text(F.col("id").cast("string")).alias("id"))
    space = F.lit("6ba7b810-9dad-11d1-80b4-00c04fd430c8")
    twice = df.select("id", ids.xor(ids.xor(F.col("id"), space), space).alias("back"), ids.xor(F.col("id"), F.lit(ids.ROOT)).alias("same"))
    assert twice.where("id <> back or id <> same").count() == 0


def test_replication(spark, tmp_path):
    uid = lambda n: f"00000000-0000-0000-0000-{n:012d}"
    nodes, edges = store.in_memory(spark, [(uid(1), "List", None, CHAIN, None, None), (uid(2), "Text", "a", None, None, None), (uid(3), "Text", "b", None, None, None), (uid(4), "List", None, PAGE, None, None)], [(uid(1), 0, uid(2)), (uid(1), 1, uid(3)), (uid(4), 0, uid(1))])
    times = spark.createDataFrame([(uid(i), ts) for i, ts in ((1, 10), (2, 10), (3, 30), (4, 10))], "id string, ts long")
    held, n, e = replicate.export_since(nodes, edges, times, uid(1))
    assert pairs(held, "id") == {(uid(1),), (uid(2),), (uid(3),)}
    assert pairs(n, "id") == {(uid(1),), (uid(2),), (uid(3),), (ids.ROOT,)} and e.count() == 3
    assert pairs(replicate.export_since(nodes, edges, times, uid(1), 20)[1], "id") == {(uid(3),), (ids.ROOT,)}
    assert pairs(replicate.export_since(nodes, edges, times, uid(1), 99)[1], "id") == {(ids.ROOT,)}
    space = F.lit("6ba7b810-9dad-11d1-80b4-00c04fd430c8")
    moved = replicate.namespaced(n, e, space)
    there = replicate.upsert(nodes, edges, *moved)
    assert there[0].count() == 8 and replicate.upsert(*there, *moved)[0].count() == 8 and replicate.upsert(*there, *moved)[1].count() == there[1].count()
    assert pairs(replicate.namespaced(*moved, space)[0], "id") == pairs(n, "id")

    path, out, name = str(tmp_path / "episodes"), str(tmp_path / "out"), uid(9)
    store.push_episode(n, e, path, name, 100)
    from palimpsest.streaming.latest import follow_episodes

    assert follow_episodes(spark, path, out).count() == 4
    assert follow_episodes(spark, path, out).count() == 4  # nothing new
    store.push_episode(n.limit(1), e.where("false"), path, name, 200)
    assert follow_episodes(spark, path, out).count() == 5
    subscribed = spark.createDataFrame([(name, 100, ids.ROOT)], "broadcast_id string, last_updated long, namespace string")
    pulled = replicate.pull(store.episodes(spark, path), subscribed)
    assert pulled.count() == 1 and replicate.advanced(subscribed, pulled).first()["last_updated"] == 200


def test_service_rules(spark):
    name = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    published = spark.createDataFrame([(name, "r", ["r"], "secret", 5, 1000)], "broadcast_id string, root string, exported array<string>, token string, last_updated long, expiration long")
    episodes = spark.createDataFrame([(name, 7)], "broadcast_id string, episode_ts long")
    ask = lambda method, i=name, token="secret", now=10, ep=None: replicate.request(published, episodes, method, i, token, now, ep)
    assert [ask("POST"), ask("POST", "00000000-0000-0000-0000-000000000001"), ask("PUT", ep=7), ask("PUT", ep=8), ask("PUT", token="no"), ask("GET", "x"), ask("GET", now=2000), ask("GET"), ask("PATCH")] == [200, 201, 200, 201, 401, 400, 404, 200, 405]
    listed = spark.createDataFrame([("[3, 1, 3, 2]",)], "j string").select(replicate.episode_list(F.col("j")).alias("l")).first()["l"]
    assert listed == [1, 2, 3]


def test_log_store(spark, tmp_path):
    held = kv(spark, [("a", "1", 10), ("a", "2", 20)])
    store.append(held, str(tmp_path / "s"))
    assert store.open_log(spark, str(tmp_path / "s")).count() == 2
    assert store.compact(spark, str(tmp_path / "s"), str(tmp_path / "t")).count() == 1
    assert log.size(held).first()["n_bytes"] == 2


def test_parts_of_nodes():
    text, page, style = {"Text": "a"}, {"List": PAGE, "children": [{"Text": "a"}, "b"]}, {"Styled": {"Block": ["Quote"], "child": {"Text": "a"}}}
    for node in (text, page, style):
        assert store.with_children(*store.split(node)) == node
    assert store.split(style) == ({"Styled": {"Block": ["Quote"]}}, [text]) and store.styles_of(style) == ("Block", ["Quote"])
    assert store.is_atom(text) and not store.is_atom(page) and store.line_of(text) == "a" and store.layout_of(page) == PAGE
    for node, children in ((text, [text]), (style, []), (style, [text, text])):
        with pytest.raises(store.ChildrenMismatch):
            store.with_children(node, children)
    for ask, node in ((store.line_of, page), (store.layout_of, text), (store.styles_of, page)):
        with pytest.raises(store.WrongNodeType):
            ask(node)
    with pytest.raises(store.NodeError):
        store.split({"Other": 1})
