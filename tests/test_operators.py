"""Operators on small graphs with exact results, and against plain Python on random ones."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from graphloom.operators import cycles, reads, search, sync, traversal


def graph(spark, pairs, kind="calls", nodes=None):
    ids = nodes if nodes is not None else sorted({x for p in pairs for x in p[:2]})
    edges = spark.createDataFrame([(p[0], p[1], p[2] if len(p) > 2 else kind, 1) for p in pairs], "source string, target string, kind string, line int")
    return spark.createDataFrame([(i, "function", i, f"{i}.ts", 1, 0) for i in ids], "id string, kind string, name string, file_path string, start_line int, start_column int"), edges


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_chain(spark):
    nodes, edges = graph(spark, [("a", "b"), ("b", "c")])
    assert ids(reads.callees(nodes, edges, "a")) == ["b"] and ids(reads.callers(nodes, edges, "b")) == ["a"]
    assert ids(traversal.impact_radius(nodes, edges, "c", 3)) == ["a", "b"] and ids(traversal.impact_radius(nodes, edges, "a", 3)) == []
    assert [(r["pos"], r["id"]) for r in traversal.shortest_path(edges, "a", "c").orderBy("pos").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert ids(traversal.shortest_path(edges, "a", "a")) == ["a"] and traversal.shortest_path(edges, "c", "a").count() == 0


def test_diamond(spark):
    nodes, edges = graph(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    assert [r["id"] for r in traversal.shortest_path(edges, "a", "d").orderBy("pos").collect()] == ["a", "b", "d"]
    assert ids(traversal.impact_radius(nodes, edges, "d", 1)) == ["b", "c"]
    assert traversal.path_neighbourhood(edges, traversal.shortest_path(edges, "a", "d")).count() == 4


def test_repeated_calls_and_missing_nodes(spark):
    nodes, _ = graph(spark, [("f", "g")])
    edges = spark.createDataFrame([("f", "g", "calls", 1), ("f", "g", "calls", 5), ("x", "g", "calls", 2)], "source string, target string, kind string, line int")
    assert ids(reads.callers(nodes, edges, "g")) == ["f", "f"] and ids(reads.callers(nodes, edges, "g", distinct=True)) == ["f"]
    assert reads.edges_in(edges, "g").count() == 3 and reads.prune_dangling(edges, nodes).count() == 2
    found, _ = traversal.subgraph(nodes, edges, "g", direction="inbound")
    assert ids(found) == ["f", "g"]


def test_hierarchy(spark):
    nodes, edges = graph(spark, [("C", "B"), ("B", "A"), ("D", "A")], "extends")
    for way, want in (("up", ["A", "B"]), ("down", []), ("both", ["A", "B", "D"])):
        assert ids(traversal.type_hierarchy(nodes, edges, "C", way)) == want
    assert ids(traversal.type_hierarchy(nodes, edges, "A", "down")) == ["B", "C", "D"]


def test_dead_nodes(spark):
    nodes, edges = graph(spark, [("m", "used"), ("m", "bin", "ffi")], nodes=["alone", "bin", "m", "shown", "used"])
    nodes = nodes.withColumn("is_exported", F.col("id") == "shown")
    assert ids(reads.dead_nodes(nodes, edges)) == ["alone", "bin", "m"]


def test_duplicate_edges(spark):
    rows = [("s", "t", "k", 3), ("s", "t", "k", 3), ("s", "t", "k", None), ("s", "t", "k", None)]
    edges = spark.createDataFrame(rows, "source string, target string, kind string, line int")
    assert reads.dedupe_edges(edges).count() == 3 and reads.insert_edges(reads.dedupe_edges(edges), edges).count() == 5


@pytest.mark.parametrize(
    "pairs, want",
    [
        (["xy", "yx"], ["x>y"]),
        (["ab", "bc", "bd", "ca", "da"], ["a>b>c", "a>b>d"]),
        (["px", "xy", "yx"], ["x>y"]),
        (["ab", "bc"], []),
        (["aa", "ab"], []),
    ],
)
def test_cycles(spark, pairs, want):
    df = spark.createDataFrame([tuple(p) for p in pairs], "source string, target string")
    assert sorted(">".join(r["path"]) for r in cycles.simple_cycles(df).collect()) == want


def test_search_equals_plain_bfs(spark):
    rng = random.Random(1)
    for n, m in ((12, 20), (30, 60)):
        pairs = list({(f"{rng.randrange(n):02d}", f"{rng.randrange(n):02d}") for _ in range(m)})
        nodes, edges = graph(spark, pairs)
        start, after = pairs[0][0], {}
        for a, b in pairs:
            after.setdefault(a, set()).add(b)
        depth, queue = {start: 0}, deque([start])
        while queue:
            x = queue.popleft()
            for y in after.get(x, ()):
                if y not in depth:
                    depth[y] = depth[x] + 1
                    queue.append(y)
        found = traversal.search(edges.orderBy(F.rand(3)), traversal.seeds_of(spark, [start])).collect()
        assert {r["id"]: r["depth"] for r in found} == depth
        for r in found:
            if r["depth"]:
                assert r["parent"] == min(a for a, b in pairs if b == r["id"] and depth.get(a) == r["depth"] - 1)


def test_caps(spark):
    nodes, edges = graph(spark, [("r", f"{i:02d}") for i in range(20)])
    found = traversal.search(edges, traversal.seeds_of(spark, ["r"]), 2, "both", None, nodes, 5)
    assert ids(found) == ["00", "01", "02", "03", "r"]
    assert traversal.search(edges, traversal.seeds_of(spark, ["r"]), 2, "both", None, nodes, 0).count() == 21


def text_nodes(spark):
    rows = [("1", "function", "validateToken", None, "ts"), ("2", "function", "snake_case_name", None, "ts"), ("3", "class", "Login", "check the auth token", "py"), ("4", "function", "fooBar", None, "ts"), ("5", "function", "a_b", None, "ts"), ("6", "function", "axb", None, "ts"), ("7", "function", "É", "", "ts")]
    return spark.createDataFrame(rows, "id string, kind string, name string, docstring string, language string")


@pytest.mark.parametrize("query, want", [("auth*", ["3"]), ("token", ["3"]), ("case", ["2"]), ("case*", ["2"]), ("snake_case", ["2"]), ("case_snake", []), ("auth zzz*", []), ("the AND auth", ["3"]), ("validatetok", ["1"]), ("e", ["7"]), ("", []), ("***", []), ("a/b", ["5"])])
def test_full_text(spark, query, want):
    nodes = text_nodes(spark)
    assert ids(search.by_text(nodes, query)) == want
    if "_" not in query:
        assert sorted({r["id"] for r in search.by_postings(search.postings(nodes), query).collect()}) == want


@pytest.mark.parametrize("query, want", [("FOOB", ["4"]), ("a_b", ["5", "6"]), ("é", []), ("É", ["7"]), ("\\", [])])
def test_like(spark, query, want):
    assert ids(search.by_like(text_nodes(spark), query)) == want


def test_signatures(spark):
    rows = [("authenticate", "(email: string, password: string) -> boolean"), ("parseUser", "(data: string) -> User"), ("add", "(a: number, b: number) -> number"), ("greet", "(name: string) -> void"), ("noParams", "() -> string"), ("none", None)]
    nodes = spark.createDataFrame([(n, "function", s) for n, s in rows], "id string, kind string, signature string")
    hits = lambda q: ids(search.by_signature(nodes, q))
    assert "authenticate" in hits("string ->") and hits("-> boolean") == ["authenticate"] and hits("number, number -> number") == ["add"]
    assert "noParams" in hits("-> string") and hits("string -> void") == ["greet"] and "authenticate" not in hits("number -> string")


def test_nearest_and_tiers(spark):
    nodes = text_nodes(spark)
    vectors = spark.createDataFrame([(str(i), [float(i), 0.0]) for i in range(1, 8)], "node_id string, embedding array<float>")
    assert ids(search.nearest(vectors, [3.2, 0.0], 2, "node_id")) == ["3", "4"]
    assert ids(search.by_vector(nodes, vectors, [3.2, 0.0], 2, ("class",))) == ["3"]
    rows = search.tiered(nodes, "a_b", 5, vectors=vectors, vector=[1.0, 0.0]).collect()
    assert (rows[0]["id"], rows[0]["score"], rows[0]["tier"]) == ("5", 1.0, 0) and len({r["id"] for r in rows}) == len(rows) == 5


def test_sync_status(spark):
    snap = lambda rows: spark.createDataFrame(rows, "path string, content_hash string")
    out = sync.file_status(snap([("a", "1"), ("b", "1"), ("c", "1")]), snap([("b", "1"), ("c", "2"), ("d", "1")]))
    assert {r["path"]: r["status"] for r in out.collect()} == {"a": "removed", "b": "unchanged", "c": "modified", "d": "added"}


def test_full_text_folds_accents_and_keeps_tokens_whole(spark):
    from graphloom.functions.text import matches_terms

    df = spark.createDataFrame([(1, "Un CAFÉ, noir"), (2, "cafés"), (3, "a-cafe_noirs"), (4, "cafe9 noir"), (5, None), (6, "noir cafe"), (7, "")], "id int, text string")
    found = lambda query: [r[0] for r in df.where(matches_terms([F.col("text"), F.lit("x")], query)).orderBy("id").collect()]
    assert found("café noir") == [1, 3, 6] and found("cafe_noir") == [1, 3] and found("caf") == [1, 2, 3, 4, 6] and found("x") == [1, 2, 3, 4, 5, 6, 7]
    assert found("noir cafe") == [1, 4, 6] and found("AND (") == []


def test_measured_queries(spark):
    from graphloom.operators import measure

    nodes = spark.createDataFrame([(str(i), f"f{i % 3}.ts") for i in range(10)], "id string, file_path string").repartition(3)
    found, mean = measure.profile({"all": lambda: nodes, "some": lambda: nodes.where("id < '3'").orderBy("id").limit(2), "none": lambda: nodes.limit(0)}, repeat=2)
    assert [(m.query, m.rows, m.files) for m in found] == [("all", 10, 3), ("some", 2, 2), ("none", 0, 0)]
    assert mean > 0 and all(m.millis > 0 for m in found) and measure.measured("about", lambda: nodes, exact=False).files == 3
