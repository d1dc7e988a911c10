"""Incremental sync: what it opens, resolves and writes, and that its result is that of a full index."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.graph import CodeGraph
from graphloom.operators import resolve
from graphloom.sources import tree
from graphloom.sources.manifests import Conflict
from graphloom.sources.store import Config, Store


def put(root, path, text, age=100):
    """A file that was changed some seconds ago, so that its time is no reason to open it."""
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(text)
    at = time.time() - age
    os.utime(root / path, (at, at))


def everything(graph):
    rows = lambda df, *columns: sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    return {
        "edges": rows(graph.edges, "source", "target", "kind", "line"),
        "nodes": rows(graph.nodes, "id", "name", "file_path", "start_line"),
        "links": rows(graph.store.table("links"), "ref_id", "target"),
        "files": rows(graph.store.table("files"), "path", "content_hash", "length"),
        "vectors": rows(graph.store.table("embeddings"), "node_id"),
        "text": rows(graph.text.search("f"), "id"),
    }


def module(rng, names):
    """A small module that defines, imports and calls some of a few names."""
    own, used = rng.sample(names, 3), rng.sample(names, 4)
    lines = [f"import {{ {n} as {rng.choice([n, 'alias'])} }} from './{rng.choice('abcdefgh')}';" for n in used[:2]]
    lines += ["// moved"] * rng.randrange(3)
    lines += [f"export function {n}() {{ {rng.choice([*used, 'alias'])}(); {rng.choice([*names, 'alias'])}(); }}" for n in own]
    lines += [f"export class K{rng.randrange(3)} extends K{rng.randrange(3)} {{ m() {{ {rng.choice(used)}(); }} }}"]
    return "\n".join(lines) + "\n"


def test_random_changes_end_as_a_full_index(spark, tmp_path):
    rng = random.Random(4)
    names = ["fa", "fb", "fc", "fd", "fe", "Fa"]
    for x in "abcdef":
        put(tmp_path, f"{x}.ts", module(rng, names), 200)
    graph = CodeGraph.init(spark, str(tmp_path))
    graph.index_all()
    for step in range(2):
        there = sorted(p.name for p in tmp_path.glob("*.ts"))
        for name in rng.sample(there, 2):
            put(tmp_path, name, module(rng, names), 150 - step)
        (tmp_path / rng.choice(there)).unlink()
        put(tmp_path, f"{rng.choice('abcdefgh')}.ts", module(rng, names), 150 - step)
        graph.sync()
        synced = everything(graph)
        graph.index_all()
        assert everything(graph) == synced and len(synced["links"]) > 5


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("many")
    for i in range(40):
        put(root, f"p{i % 4}/m{i}.py", f"def f{i}():\n    return f{(i + 1) % 40}()\n")
    graph = CodeGraph.init(spark, str(root), Config(embed_symbols=False))
    graph.index_all()
    return root, graph


def parts(graph, name):
    return graph.store.state()["tables"][name]["parts"]


def test_one_changed_file(many, monkeypatch):
    """One file is opened, its bucket alone is written, and only references to what changed are resolved."""
    root, graph = many
    opened = []
    read = tree.read_texts
    monkeypatch.setattr(tree, "read_texts", lambda listed, *a: opened.extend(r["path"] for r in listed.collect()) or read(listed, *a))
    before = {name: parts(graph, name) for name in ("files", "nodes", "sources", "refs", "links", "edges")}
    put(root, "p1/m5.py", "def f5():\n    return f6()\n\ndef g5():\n    return f7()\n", 50)
    assert graph.is_dirty() and graph.sync() == {"unchanged": 39, "modified": 1}
    assert opened == ["p1/m5.py"] * 2 and graph.last_sync.read == 1
    (bucket,) = graph.last_sync.touched
    for name in ("files", "nodes", "sources", "refs"):
        after = parts(graph, name)
        assert {b for b in after if after[b] != before[name].get(b)} == {str(bucket)}
    # g5 is new; f5 stays where it was, so the call to it is not looked at again.
    assert graph.last_sync.resolved == 2 and graph.last_sync.relinked == [bucket]
    put(root, "p1/m5.py", "\n\ndef f5():\n    return f6()\n", 40)
    graph.sync()
    assert graph.last_sync.resolved == 2 and len(graph.last_sync.relinked) <= 2
    assert sorted(r["source"].split(":")[-2] for r in graph.edges.where("kind = 'calls' and target like '%:f5:3'").collect()) == ["f4"]
    assert graph.edges.where("kind = 'calls' and target like '%:f5:1'").count() == 0


def test_an_unchanged_tree_is_not_read(many, monkeypatch):
    root, graph = many
    graph.sync()
    version = graph.store.version()
    counted = []
    read = tree.read_texts
    monkeypatch.setattr(tree, "read_texts", lambda listed, *a: counted.append(listed.count()) or read(listed, *a))
    assert not graph.is_dirty() and set(graph.sync()) == {"unchanged"} and counted == [0, 0] and graph.store.version() == version
    os.utime(root / "p0/m0.py")  # another time, the same content: opened, but no new state
    assert not graph.is_dirty() and set(graph.sync()) == {"unchanged"} and counted[2:] == [1, 1] and graph.store.version() == version


def test_dependents(spark):
    refs = spark.createDataFrame([("s1", "go", "function", "a.ts", 1, 0), ("s2", "GO", "function", "b.ts", 1, 0), ("s3", "other", "function", "a.ts", 2, 0), ("s4", "alias", "function", "c.ts", 1, 0), ("s5", "far", "function", "d.ts", 1, 0), ("s6", "./new", "module", "x/y.ts", 1, 0)], "source_id string, ref_name string, ref_kind string, file_path string, line int, column int")
    imports = spark.createDataFrame([("c.ts", "typescript", "alias", "go", "./z"), ("d.ts", "typescript", "q", "q", "./x/new")], "file_path string, language string, local string, original string, module string")
    names = spark.createDataFrame([("go",)], "name string")
    got = lambda moved: sorted(r["source_id"] for r in resolve.dependents(refs, imports, names, moved).collect())
    assert got(None) == ["s1", "s2", "s4"]
    assert got(spark.createDataFrame([("x/new.ts",)], "path string")) == ["s1", "s2", "s4", "s5", "s6"]
    nodes = spark.createDataFrame([("1", "function", "Go", "a", 1, 0), ("2", "function", "stay", "a", 2, 0), ("3", "class", "moved", "a", 3, 0)], "id string, kind string, name string, file_path string, start_line int, start_column int")
    after = nodes.where("id <> '1'").withColumn("start_line", F.when(F.col("id") == "3", 9).otherwise(F.col("start_line")))
    assert sorted(r["name"] for r in resolve.changed_names(nodes, after).collect()) == ["go", "moved"]


def test_states_have_one_successor(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = lambda n: spark.range(n).selectExpr("concat('f', id) as path", "id")
    first = store.commit({"files": (rows(50), None)}, buckets=8)
    kept = parts_of(store)
    some = sorted(kept)[:2]
    later = rows(50).where(Store.bucket_of(F.col("path"), 8).isin(*map(int, some))).withColumn("id", F.col("id") + 100)
    store.commit({"files": (later, list(map(int, some)))}, after=first)
    assert {b for b in kept if parts_of(store)[b] != kept[b]} == set(some)
    assert store.table("files").count() == 50 and store.table("files", map(int, some)).agg(F.min("id")).first()[0] >= 100
    assert store.table("files", version=first).agg(F.max("id")).first()[0] == 49
    with pytest.raises(Conflict):
        store.commit({"files": (rows(1), None)}, after=first)
    store.commit({"files": (rows(3).where("id < 0"), list(map(int, some)))})
    assert store.table("files", map(int, some)).count() == 0 and 0 < store.table("files").count() < 50
    for _ in range(3):
        store.commit({"files": (rows(5), None)})
    assert len(store.manifests.numbers()) == 2 and len([n for n in store.manifests.names("files") if n.startswith("part-")]) == 2


def parts_of(store):
    return store.state()["tables"]["files"]["parts"]


def test_listing_by_folder(spark, tmp_path):
    for path in ("a.py", "src/b.ts", "src/deep/er/c.go", "node_modules/x/y.ts", "src/node_modules/z.ts", "n.txt", "big.py"):
        put(tmp_path, path, "x\n" if path != "big.py" else "x" * 100)
    want = ["a.py", "src/b.ts", "src/deep/er/c.go", "src/node_modules/z.ts"]
    for root in (str(tmp_path), f"file://{tmp_path}"):
        got = tree.listing(spark, root, max_size=50)
        assert sorted(r["path"] for r in got.collect()) == want
    assert tree.whole_folders(("a/**", "*.x", "b*/**", "c/d/**")) == ("a/", "c/d/")
    plan = tree._Plan({"path": str(tmp_path), "tasks": "3"})
    folders = plan.folders()
    assert {(f.folder, f.deep) for f in folders} >= {("", False)} and sorted(r[0] for f in folders for r in plan.read(f)) == ["a.py", "big.py", "n.txt", *want[1:]]
    assert not any("node_modules" == f.folder for f in folders)
    texts = tree.read_texts(got, str(tmp_path), task_bytes=3).collect()
    assert {(r["path"], r["text"]) for r in texts} == {(p, "x\n") for p in want}


def test_a_stream_shows_what_goes(spark, tmp_path):
    root, state = tmp_path / "t", f"file://{tmp_path}/state"
    for path in ("a.py", "b.ts", "c.txt"):
        put(root, path, "x")
    seen = []

    def run():
        query = tree.changes(spark, str(root), state).writeStream.foreachBatch(lambda df, n: seen.extend(sorted((r["path"], r["event"]) for r in df.collect()))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(120)
        out = list(seen)
        seen.clear()
        return out

    assert run() == [("a.py", "added"), ("b.ts", "added")]
    (root / "a.py").unlink()
    put(root, "b.ts", "longer")
    put(root, "d.go", "x")
    assert run() == [("a.py", "removed"), ("b.ts", "modified"), ("d.go", "added")]
    assert run() == []
