"""The store: transactions, edits, search, tiles and broadcasts."""

import pytest

from palimpsest.functions.ids import ROOT
from palimpsest.session import Conflict, Engine, IdNotFound
from palimpsest.sources import store
from palimpsest.sources.service import Service
from palimpsest.sources.store import NodeError

PAGE, CHAIN = "Page", "Chain"


def test_edits_and_trash(spark, tmp_path):
    db = Engine(spark, str(tmp_path / "db"))
    with db.tx() as t:
        chain = t.add({"List": CHAIN, "children": [{"Text": "foo"}, {"Text": "bar"}]})
        foo, bar = t.get(chain)["children"]
        page = t.add({"List": PAGE, "children": [chain]})
    with db.tx() as t:
        assert [i for i, s in t.search("foobar") if s == 1.0] == [chain]
        baz = t.replace(chain, 0, {"Text": "baz"})
    with db.tx() as t:
        assert t.get(foo) is None and t.get_in_trash(foo)["text"] == "foo" and t.get(chain)["children"] == [baz, bar]
        assert len(t.versions(chain)) == 2
        t.insert(chain, 0, foo)  # comes back from the trash
    with db.tx() as t:
        assert t.get(foo)["text"] == "foo"
        t.remove(chain, 0)
        with pytest.raises(NodeError):
            t.push(bar, {"Text": "x"})
        with pytest.raises(IdNotFound):
            t.overlaps("none")
    small = db.merge(str(tmp_path / "small"))
    with small.tx() as t:
        assert t.get(foo) is None and t.get_in_trash(foo) is None and t.get(page)["children"] == [chain]
    assert 0 < small.size() < db.size()


def test_conflict(spark, tmp_path):
    db = Engine(spark, str(tmp_path / "db"))
    with db.tx() as t:
        a, b = t.add({"Text": "a"}), t.add({"Text": "b"})
    one, two, other = db.begin(), db.begin(), db.begin()
    for t, i in ((one, a), (two, a), (other, b)):
        t.get(i)
        t.swap(i, {"Text": "new"})
    db.commit(one)
    db.commit(other)
    with pytest.raises(Conflict):
        db.commit(two)
    reader = db.begin()
    reader.get(a)
    db.commit(reader)


def test_sync_refresh_and_broadcast(spark, tmp_path):
    db, there = Engine(spark, str(tmp_path / "db")), Engine(spark, str(tmp_path / "there"))
    episodes = str(tmp_path / "episodes")
    with db.tx() as t:
        sub = t.sync(None, [{"Edited": ["# A *title*", "foo bar"]}])
        t.sync(ROOT, [{"Existing": sub}, {"Linked": sub}])
    with db.tx() as t:
        tile = t.refresh(ROOT)
        assert [s["section_id"] for s in tile["sections"]][0] == sub and tile["broadcasts"] == []
        cast = t.publish(ROOT, episodes)
    with db.tx() as t:
        assert [b["broadcast_id"] for b in t.refresh(ROOT)["broadcasts"]] == [cast["broadcast_id"]]
    with there.tx() as t:
        tile = t.refresh(f"broadcast:{cast['broadcast_id']}", episodes)
        assert tile["broadcasts"] == [] and tile["sections"][0]["section_id"] == t.namespaced_id(cast["broadcast_id"], sub)
    with there.tx() as t:
        assert t.fetch(cast["broadcast_id"], episodes) == 0
        assert len(t.search("foo bar")) == 1
    with db.tx() as t:
        t.push(sub, {"Text": "fresh words"})
    with db.tx() as t:
        assert t.update_broadcasts(ROOT, episodes) == [cast["broadcast_id"]]
    with there.tx() as t:
        assert t.fetch(cast["broadcast_id"], episodes) > 0
        assert len(t.search("fresh words")) == 1


def test_two_writers(spark, tmp_path):
    """Whoever commits second looks again: it fails if it has read what changed, and else gets the next numbers."""
    one, two = Engine(spark, str(tmp_path / "db")), Engine(spark, str(tmp_path / "db"))
    with one.tx() as t:
        a, b = t.add({"Text": "a"}), t.add({"Text": "b"})
    first, late, blind = one.begin(), two.begin(), two.begin()
    for t in (first, late):
        t.get(a)
        t._put(a, {"kind": "Text", "text": "new", "children": []})
    blind._put(b, {"kind": "Text", "text": "blind", "children": []})

    def between(engine, inner):
        """The engine's next commit is overtaken after its check and before its file is made."""
        create = engine.store._create

        def overtaken(name, text):
            engine.store._create = create
            one.commit(inner)
            return create(name, text)

        engine.store._create = overtaken

    between(two, first)
    with pytest.raises(Conflict):
        two.commit(late)
    third = one.begin()
    third._put("c", {"kind": "Text", "text": "c", "children": []})
    between(two, third)
    two.commit(blind)
    rows = two.log().collect()
    assert len({r["seq"] for r in rows}) == len(rows) == 6 and [c["number"] for c in two.store.commits()] == [0, 1, 2, 3, 4]
    assert two.begin().get(b)["text"] == "blind" and one.begin().get(a)["text"] == "new" and one.begin().get("c")["text"] == "c"
    names = {c["folder"] for c in one.store.commits()}
    assert names == set(one.store._names("data"))  # what lost the race is gone


def test_merge_in_place(spark, tmp_path):
    db, other = Engine(spark, str(tmp_path / "db")), Engine(spark, str(tmp_path / "db"))
    for text in ("x", "y", "z"):
        t = db.begin()
        t._put("n", {"kind": "Text", "text": text, "children": []})
        db.commit(t)
    old, before = other.begin(), other.size()
    db.merge()
    assert len(other.store.commits()) == 1 and 0 < other.size() < before
    assert len(old.versions("n")) == 3 and len(other.begin().versions("n")) == 1 and other.begin().get("n")["text"] == "z"
    old.get("n")
    old._put("n", {"kind": "Text", "text": "late", "children": []})
    other.commit(old)  # a merge changes no value, so it conflicts with nothing
    assert db.begin().get("n")["text"] == "late" and db.store.clean() == 8
    assert db.begin().get("n")["text"] == "late" and db.store.clean() == 0
    db.store.truncate(5)
    assert db.begin().get("n")["text"] == "z" and not db.store.is_empty() and db.store.name() == "db" and db.store.size() > 0
    db.store.purge()
    assert db.store.is_empty()


def test_limits(spark, tmp_path):
    held = store.Store(spark, str(tmp_path / "s"))
    row = lambda k: spark.createDataFrame([(0, k, "v", False, 1, 0)], store.LOG)
    with pytest.raises(Exception, match="a key is too long"):
        held.add(lambda c, n: row("k" * 70_000))
    assert held.commits() == [] and held.add(lambda c, n: None) is False and held.add(lambda c, n: row("k" * 60_000))
    assert held.read().count() == 1


def test_update(spark, tmp_path):
    db = Engine(spark, str(tmp_path / "db"))
    with db.tx() as t:
        page = t.add({"List": PAGE, "children": [{"Text": x} for x in "abc"]})
        a, b, c = t.get(page)["children"]
        t.update(page, lambda held: held.sort(key=lambda i: [c, a, b].index(i)))
        assert t.get(page)["children"] == [c, a, b]
        with pytest.raises(NodeError):
            t.update(a, lambda held: None)
        with pytest.raises(IdNotFound):
            t.update("none", lambda held: None)


def test_service(spark, tmp_path):
    """Requests change what later requests answer."""
    web = Service(spark, str(tmp_path / "web"))
    nodes, edges = store.in_memory(spark, [("a", "List", None, PAGE, None, None), ("b", "Text", "x", None, None, None)], [("a", 0, "b")])
    status, made = web.handle("POST", "/broadcast", body=(nodes, edges), now=1000, episode="7")
    assert status == 201 and made["expiration"] == 1000 + 24 * 3600
    i, token = made["broadcast_id"], made["token"]
    ask = lambda method, path=f"broadcast/{i}", now=2000, **more: web.handle(method, path, now=now, **more)
    assert ask("GET") == (200, [7]) and ask("GET", f"broadcast/{i}/7")[1].count() == 2
    assert ask("PUT", f"broadcast/{i}/9", token=token, body=(nodes.limit(1), edges.where("false"))) == (201, None)
    assert ask("PUT", f"broadcast/{i}/9", token=token, body=(nodes, edges)) == (200, None) and ask("GET") == (200, [7, 9])
    assert [ask("PUT", f"broadcast/{i}/x", token=token)[0], ask("PUT", f"broadcast/{i}/1", token="no")[0], ask("PUT", token=token)[0], ask("PUT", "broadcast/none/1")[0]] == [400, 401, 400, 404]
    assert [ask("GET", "other")[0], ask("GET", "broadcast")[0], ask("GET", "broadcast/none")[0], ask("GET", f"broadcast/{i}/8")[0], ask("POST", "broadcast/x")[0], ask("PATCH")[0], ask("OPTIONS")[0], ask("POST", "broadcast", episode="x")[0]] == [400, 400, 404, 404, 400, 405, 200, 400]
    assert ask("DELETE", token="no")[0] == 401 and ask("DELETE", token=token) == (200, None) and ask("GET") == (200, [])
    late = 1000 + 24 * 3600 + 1
    assert ask("GET", now=late)[0] == 404 and ask("GET", f"broadcast/{i}/9", now=late)[0] == 200 and ask("GET", f"broadcast/{i}/9", now=late + 12 * 3600)[0] == 404
    rows = store.episodes(spark, web.episodes)
    assert rows.where(f"broadcast_id = '{i}' and episode_ts = 9").count() == 2
