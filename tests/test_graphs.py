"""Components, strongly connected components, stored edges and the search from both ends, against plain Python."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from graphloom import storage
from graphloom.operators import adjacency, components, cycles, traversal
from graphloom.operators.adjacency import Adjacency

SCHEMA = "source string, target string, kind string, line int"


def pairs_of(rng, n, m):
    return [(f"{rng.randrange(n):03d}", f"{rng.randrange(n):03d}") for _ in range(m)]


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, "calls", i % 3) for i, (a, b) in enumerate(pairs)], SCHEMA)


def reach(after, start):
    seen, todo = {start}, [start]
    while todo:
        for y in after.get(todo.pop(), ()):
            if y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


def after_of(pairs, both=False):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
        if both:
            after.setdefault(b, set()).add(a)
    return after


@pytest.fixture(params=[1000, 3], ids=["held", "written"])
def few(request, monkeypatch):
    """With rows between rounds on the driver, and with tables."""
    for module in (storage, traversal):
        monkeypatch.setattr(module, "FEW", request.param)
    return request.param


def chain(n):
    names = [f"{i:03d}" for i in random.Random(3).sample(range(n), n)]
    return list(zip(names, names[1:]))


@pytest.mark.parametrize("pairs", [pairs_of(random.Random(1), 60, 40), chain(65), [("000", f"{i:03d}") for i in range(200)] + [("x", "x"), ("y", "z")], [("a", None), (None, "b"), ("c", "d")], []], ids=["random", "chain", "hub", "nulls", "empty"])
def test_components(spark, few, pairs):
    got = {r["id"]: r["component"] for r in components.components(frame(spark, pairs)).collect()}
    whole = [p for p in pairs if None not in p]
    after = after_of(whole, both=True)
    assert got == {x: min(reach(after, x)) for p in whole for x in p}


def test_rounds_are_logarithmic(spark, few):
    """A chain of 150 vertices in random order is settled within eight rounds."""
    pairs = chain(150)
    got = components.components(frame(spark, pairs), most=8).collect()
    assert {r["component"] for r in got} == {"000"} and len(got) == 150
    with pytest.raises(RuntimeError):
        components.components(frame(spark, pairs), most=1)


@pytest.mark.parametrize("seed, n, m", [(1, 20, 30), (2, 25, 60)])
def test_strong_components(spark, few, seed, n, m):
    pairs = pairs_of(random.Random(seed), n, m) + [("900", "901"), ("901", "902"), ("902", "900"), ("902", "903"), ("903", "903")]
    after = after_of([p for p in pairs if p[0] != p[1]])
    want = {}
    for x in {y for p in pairs for y in p}:
        own = {y for y in reach(after, x) if x in reach(after, y)}
        if len(own) > 1:
            want[x] = max(own)
    got = {r["id"]: r["component"] for r in components.strong_components(frame(spark, pairs)).collect()}
    assert got == want and want["900"] == "902" and "903" not in want
    groups = {r["id"]: (r["component"], r["n_ids"], r["n_edges"]) for r in cycles.cyclic_groups(frame(spark, pairs)).collect()}
    distinct = {p for p in pairs if p[0] != p[1]}
    assert groups == {x: (c, sum(y == c for y in want.values()), sum(want.get(a) == c == want.get(b) for a, b in distinct)) for x, c in want.items()}


def test_a_dense_group_is_told_without_its_cycles(spark):
    """All edges among 12 vertices have more cycles than anyone can list; tails lead in and out."""
    names = [f"{i:02d}" for i in range(12)]
    pairs = [(a, b) for a in names for b in names if a != b] + [("in", "00"), ("11", "out")]
    assert [tuple(r) for r in cycles.cyclic_groups(frame(spark, pairs)).select("component", "n_ids", "n_edges").distinct().collect()] == [("11", 12, 132)]


def plain_path(pairs, start, end):
    """Levels from the start; from the end backwards the smallest parent of the level before."""
    depth, queue, after = {start: 0}, deque([start]), after_of(pairs)
    while queue:
        x = queue.popleft()
        for y in after.get(x, ()):
            if y not in depth:
                depth[y] = depth[x] + 1
                queue.append(y)
    if end not in depth:
        return []
    path = [end]
    while path[-1] != start:
        path.append(min(a for a, b in pairs if b == path[-1] and depth.get(a) == depth[path[-1]] - 1))
    return path[::-1]


def test_paths_from_both_ends(spark, tmp_path, few):
    rng = random.Random(5)
    for n, m in ((30, 55), (12, 40)):
        pairs = pairs_of(rng, n, m)
        edges = frame(spark, pairs)
        walks = Adjacency.build(edges, f"{tmp_path}/{n}")
        for _ in range(3):
            start, end = rng.choice(pairs)[0], rng.choice(pairs)[1]
            want = plain_path(pairs, start, end)
            for some in (walks, edges):
                got = traversal.shortest_path(some, start, end, 30).orderBy("pos").collect()
                assert [r["id"] for r in got] == want
                assert all((r["source"], r["target"]) == p for r, p in zip(got[1:], zip(want, want[1:])))
            if len(want) > 2:
                assert traversal.shortest_path(walks, start, end, len(want) - 2).count() == 0
                assert traversal.shortest_path(walks, start, end, len(want) - 1).count() == len(want)


def test_searches_on_stored_edges(spark, tmp_path, few):
    pairs = pairs_of(random.Random(9), 40, 80)
    edges = frame(spark, pairs)
    walks = Adjacency.build(edges, str(tmp_path))
    assert Adjacency.exists(spark, str(tmp_path)) and not Adjacency.exists(spark, str(tmp_path / "no"))
    seeds = traversal.seeds_of(spark, ["000", pairs[0][0]])
    for way in ("outbound", "inbound", "both"):
        rows = lambda some: sorted((tuple(r) for r in traversal.search(some, seeds, 4, way, ("calls",)).collect()), key=repr)
        assert rows(walks) == rows(edges)


def test_a_step_reads_the_edges_of_its_frontier(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(adjacency, "ROW_GROUP", 1 << 14)
    many = spark.range(200_000).selectExpr("lpad(cast(id div 5 as string), 6, '0') as source", "lpad(cast(id * 7919 % 40000 as string), 6, '0') as target", "'calls' as kind", "cast(null as int) as line")
    walks = Adjacency.build(many.repartition(2), str(tmp_path))
    step = walks.walk("both", ("calls",), ["000017", "020000"])
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert plan.count("In(source") + plan.count("In(target") >= 2
    assert step.count() == 20 and walks.of("000017", "outbound").count() == walks.of("000017", "inbound").count() == 5
    hidden = step._jdf.queryExecution().executedPlan()
    step.write.format("noop").mode("overwrite").save()
    seen = []

    def scans(node):
        if "FileScan" in node.toString().split("\n")[0] and node.children().isEmpty():
            seen.append(node.metrics().get("numOutputRows").get().value())
        for i in range(node.children().size()):
            scans(node.children().apply(i))

    step._jdf.queryExecution().toRdd().count()
    scans(hidden)
    assert not seen or sum(seen) < 100_000


def test_whole_components_of_types(spark):
    pairs = [("a", "b"), ("c", "b"), ("c", "d"), ("x", "y")]
    edges = frame(spark, pairs).withColumn("kind", F.lit("extends"))
    nodes = spark.createDataFrame([(x, "class") for x in "abcdxyz"], "id string, kind string")
    assert sorted(r["id"] for r in traversal.type_hierarchy(nodes, edges, "a", "both").collect()) == ["b", "c", "d"]
    assert traversal.type_hierarchy(nodes, edges, "z", "both").count() == 0
