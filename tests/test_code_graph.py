"""Source trees: extraction, indexing, incremental sync, tools and streams."""

import io
import json
import time

import pytest
from pyspark.sql import functions as F

from graphloom import tools
from graphloom.functions import paths
from graphloom.graph import CodeGraph, OpenGraphs
from graphloom.sources.extract import extract
from graphloom.streaming import watch


def found(path, text, language=None):
    out = extract(path, text, language or {"ts": "typescript", "py": "python", "rs": "rust", "rb": "ruby", "cs": "csharp"}.get(path.rsplit(".")[-1], path.rsplit(".")[-1]))
    assert out.error is None
    return out, {n["name"]: n for n in out.nodes if n["kind"] not in ("comment", "import", "export")}


def test_typescript():
    out, n = found("a.ts", "class Animal {}\ninterface CanFly {}\nclass Bird extends Animal implements CanFly {\n  static async foo() {}\n  greet(name: string): void {}\n}\nexport function greet2(name: string, age: number): string { return x; }\nenum Color { RED, GREEN }\ntype T = string;\n")
    assert n["foo"]["is_static"] and n["foo"]["is_async"] and n["greet"]["qualified_name"] == "Bird.greet" and n["greet"]["kind"] == "method"
    assert n["greet2"]["signature"] == "(name: string, age: number) -> string" and n["greet2"]["is_exported"] and n["T"]["kind"] == "type_alias"
    assert {(e["kind"], e["target"].split(":")[2]) for e in out.edges if e["kind"] != "contains"} == {("extends", "Animal"), ("implements", "CanFly")}
    assert [x["name"] for x in out.nodes if x["kind"] == "enum_member"] == ["RED", "GREEN"]


def test_calls_inside_methods_are_no_methods():
    out, n = found("a.ts", "class Job {\n  count: number = 0;\n  static limit = 5;\n  run() {\n    begin();\n    this.stop(1);\n    if (ready) {\n      helper(2);\n    }\n    total = 3;\n  }\n  later(a: string): void;\n  async load(id: string, done: Done): Promise<void> {\n    await get(id);\n  }\n}\ninterface Doer {\n  act(name: string): void;\n  id: string;\n}\n")
    kinds = [(x["kind"], x["name"]) for x in out.nodes if x["kind"] in ("method", "property")]
    assert kinds == [("property", "count"), ("property", "limit"), ("method", "run"), ("method", "later"), ("method", "load"), ("method", "act"), ("property", "id")]
    assert [(r["ref_name"], r["source_id"]) for r in out.refs] == [("begin", n["run"]["id"]), ("stop", n["run"]["id"]), ("helper", n["run"]["id"]), ("get", n["load"]["id"])]
    assert n["run"]["end_line"] == 11


def test_go_constant_groups():
    out, n = found("m.go", "package m\n\nconst (\n\tLow = 1\n\tHigh\n)\n\nfunc Run() {\n\tstart()\n}\n")
    assert [x["name"] for x in out.nodes if x["kind"] == "constant"] == ["Low", "High"] and [r["ref_name"] for r in out.refs] == ["start"]


def test_c_prototypes_fields_and_typedefs():
    out, n = found("a.c", "int twice(int a);\ntypedef struct { int x; char *label; } Point;\nstruct Item {\n  int value;\n  struct Item *next;\n};\nint main(void) {\n  int y = 2;\n  return twice(y);\n}\n")
    assert n["Point"]["kind"] == n["Item"]["kind"] == "class" and n["twice"]["kind"] == "function"
    assert [x["name"] for x in out.nodes if x["kind"] == "property"] == ["value", "next"] and [r["ref_name"] for r in out.refs] == ["twice"]


def test_cpp_methods_outside_their_class():
    out, n = found("a.cpp", "class Lamp {\n public:\n  int level = 0;\n};\nvoid Lamp::dim() {\n  lower(1);\n}\n")
    assert n["dim"]["kind"] == "method" and n["dim"]["qualified_name"] == "Lamp.dim" and n["level"]["kind"] == "property"
    assert [(r["ref_name"], r["source_id"]) for r in out.refs] == [("lower", n["dim"]["id"])]


def test_python_with_errors():
    out = extract("a.py", "def good():\n    return one()\n\ndef bad(:\n    return 1\n\nclass Kept:\n    def first(self):\n        x = = 2\n        two()\n    def second(self):\n        pass\n\ndef last():\n    three()\n", "python")
    assert [n["name"] for n in out.nodes if n["kind"] in ("function", "class", "method")] == ["good", "Kept", "first", "second", "last"]
    assert [r["ref_name"] for r in out.refs] == ["one", "two", "three"] and out.error.startswith("SyntaxError")
    for text in ("(", '"""', "  x", "x = (\n1\n", "\t(\n )\n", "if x:\n"):
        assert [n["kind"] for n in extract("a.py", text, "python").nodes][:1] == ["file"] and extract("a.py", text, "python").error.startswith("SyntaxError")


def test_ruby_calls_without_brackets():
    out, n = found("a.rb", "class Shop\n  attr_reader :stock\n  def run(list)\n    order = Order.new(1)\n    puts order.total\n    list.each do |x|\n      log x if x.ready?\n    end\n    save! list unless 1..list.size\n    return stock\n  end\nend\n")
    assert [(r["ref_name"], r["source_id"]) for r in out.refs if r["source_id"] == n["run"]["id"]] == [(c, n["run"]["id"]) for c in ("puts", "total", "each", "log", "ready?", "save!", "size")]
    assert "attr_reader" in [r["ref_name"] for r in out.refs]


def test_php_hash_comments():
    out, n = found("a.php", "<?php\n# Adds it's numbers.\nfunction add($a) {\n  return plus($a); # call no(1)\n}\n#[Pure]\nfunction other() { last(); }\n")
    assert n["add"]["docstring"] == "Adds it's numbers." and [r["ref_name"] for r in out.refs] == ["plus", "last"]


def test_rust_closures():
    out, n = found("a.rs", "fn run(v: Vec<u8>) {\n    v.iter().map(|x| twice(x));\n    let go = move || -> u8 {\n        once()\n    };\n    if a || b { other(); }\n}\n")
    owner = {r["ref_name"]: r["source_id"] for r in out.refs}
    assert owner["twice"] == n["anonymous_at_line_2"]["id"] and owner["once"] == n["anonymous_at_line_3"]["id"] and owner["other"] == n["run"]["id"]
    assert [x["name"] for x in out.nodes if x["kind"] == "function"] == ["run", "anonymous_at_line_2", "anonymous_at_line_3"]


def test_time_follows_the_number_of_definitions():
    def seconds(n):
        text = "class A {\n" + "".join(f"  m{i}() {{ return this.m{i - 1}(); }}\n" for i in range(n)) + "}\n"
        began = time.process_time()
        out = extract("a.ts", text, "typescript")
        assert len(out.refs) == n - 1 and out.refs[-1]["source_id"].split(":")[-2].endswith(f"m{n - 1}")
        return time.process_time() - began

    assert seconds(8000) < 12 * seconds(1000) + 0.5


def test_one_writer_at_a_time(spark, tmp_path):
    (tmp_path / "a.py").write_text("def go():\n    pass\n")
    graph = CodeGraph.init(spark, str(tmp_path))
    with graph.store.lock(), pytest.raises(RuntimeError):
        graph.index_all()
    graph.index_all()
    before = graph.store.version()
    (tmp_path / "b.py").write_text("def come():\n    pass\n")
    graph.sync()
    assert graph.store.version() == before + 1 and graph.store.exists()


def test_anonymous_functions_own_their_calls():
    out, n = found("n.ts", "function outer() {\n  const arr = [1, 2];\n  arr.map(x => helper(x));\n}\nfunction helper(v: number) { return v; }\n")
    assert next(r for r in out.refs if r["ref_name"] == "helper")["source_id"] == n["anonymous_at_line_3"]["id"]


@pytest.mark.parametrize(
    "path, text, name, want",
    [
        ("U.java", "public class User {\n  public String getName() { return make(); }\n  String own() { return 1; }\n}\n", "getName", {"kind": "method", "is_exported": True, "qualified_name": "User.getName"}),
        ("m.rs", "pub fn foo() {}\nfn bar() {}\n", "foo", {"is_exported": True}),
        ("m.rs", "pub fn foo() {}\nfn bar() {}\n", "bar", {"is_exported": False}),
        ("m.go", "func Foo() {}\nfunc bar() {}\n", "Foo", {"is_exported": True}),
        ("m.go", "func Foo() {}\nfunc bar() {}\n", "bar", {"is_exported": False}),
        ("m.py", "def _private():\n    pass\n", "_private", {"is_exported": False}),
        ("m.py", 'def greet(name):\n    """Return a greeting."""\n    return name\n', "greet", {"docstring": "Return a greeting.", "signature": "(name)"}),
        ("d.ts", "// First line\n// Second line\nfunction bar() {}\n", "bar", {"docstring": "First line\nSecond line"}),
        ("d.ts", "// far away\n\nfunction bar() {}\n", "bar", {"docstring": None}),
        ("d.ts", "/**\n * Compute the sum\n * @param a\n */\nfunction sum(a) {}\n", "sum", {"docstring": "Compute the sum\n@param a"}),
        ("a.c", "static int add(int a, int b) {\n  return mul(a, b);\n}\n", "add", {"kind": "function", "signature": "(int a, int b)", "is_exported": False}),
        ("a.rb", "class App\n  def run(x)\n    x\n  end\nend\n", "run", {"kind": "method", "end_line": 4}),
        ("a.cs", "public class A : B {\n  public async Task<int> Do(int a) { return Go(a); }\n}\n", "Do", {"is_async": True, "qualified_name": "A.Do"}),
        ("a.swift", "public class A {\n  public func go(y: Int) -> Int { return run(y) }\n}\n", "go", {"signature": "(y: Int) -> Int"}),
        ("a.kt".replace("kt", "kotlin"), "class A {\n  fun go(y: Int): Int { return run(y) }\n}\n", "go", {"signature": "(y: Int) -> Int", "is_exported": True}),
        ("a.php", "<?php\nclass C {\n  public function go($x) { return run($x); }\n}\n", "go", {"qualified_name": "C.go"}),
        ("a.cpp", "class A : public B {\n  int go(int x) { return run(x); }\n};\n", "go", {"qualified_name": "A.go"}),
    ],
)
def test_languages(path, text, name, want):
    _, n = found(path, text)
    assert {k: n[name][k] for k in want} == want


def test_protobuf():
    out, n = found("e.proto", "message User {\n string name = 1;\n}\nenum Status { ACTIVE = 0; }\nservice S {\n  rpc GetUser(GetUserRequest) returns (User);\n}\n", "protobuf")
    assert n["User"]["kind"] == n["S"]["kind"] == "class" and n["Status"]["kind"] == "enum"
    assert n["GetUser"]["signature"] == "(GetUserRequest) -> User" and n["GetUser"]["qualified_name"] == "S.GetUser"


def test_bad_files_are_rows():
    assert extract("a.py", "def (", "python").error and extract("a.xyz", "", None).error
    assert [n["kind"] for n in extract("x.wasm", None, "javascript").nodes] == ["file"]


def test_imports():
    pairs = lambda path, text: {(i["local"], i["original"], i["module"]) for i in found(path, text)[0].imports}
    assert pairs("a.ts", "import { a as b, type C } from './m';\nimport d, * as e from \"x\";\nexport { f } from './g';\nconst { h: i } = require('./j');\n// import z from 'z'\n") == {("b", "a", "./m"), ("C", "C", "./m"), ("d", "d", "x"), ("e", "e", "x"), ("f", "f", "./g"), ("i", "h", "./j")}
    assert pairs("a.py", "from ..p.q import c as d\nimport os.path as o\n") == {("d", "c", "./../p/q"), ("o", "path", "os/path")}
    assert pairs("a.rs", "use crate::a::{b, c as d};\nuse crate::x::y;\n") == {("b", "b", "crate::a"), ("d", "c", "crate::a"), ("y", "y", "crate::x")}
    assert pairs("A.java", "import com.x.Foo;\n") == {("Foo", "Foo", "com/x/Foo")}


def test_paths(spark):
    df = spark.createDataFrame([("a/b/../c/./d",), ("../x",), ("a/../../y",), ("/r/s",)], "p string")
    assert [r[0] for r in df.select(paths.normalised(df["p"])).collect()] == ["a/c/d", "../x", "../y", "r/s"]
    names = spark.createDataFrame([("node_modules/x.ts",), ("src/node_modules/x.ts",), ("a.min.js",), ("deep/a.min.js",), ("dist",)], "p string")
    assert [r[0] for r in names.select(paths.excluded(names["p"], ("node_modules/**", "*.min.js", "dist/**"))).collect()] == [True, False, True, False, True]


TREE = {
    "lib/math.ts": "export function add(a: number, b: number): number { return a + b; }\nexport function sub(a: number, b: number): number { return add(a, -b); }\n",
    "decoy.ts": "export function add(x: string): string { return x; }\n",
    "main.ts": "import { add } from './lib/math';\nexport function main(): number { return add(1, 2); }\nfunction unused() { return main(); }\n",
    "Animal.ts": "export class Animal { move() {} }\n",
    "Dog.ts": "import { Animal } from './Animal';\nexport class Dog extends Animal { bark() {} }\n",
    "x.ts": "import { y } from './y';\nexport function x() { y(); }\n",
    "y.ts": "import { x } from './x';\nexport function y() { x(); }\n",
    "app.py": "from pkg.util import helper as h\n\ndef run():\n    '''Check the auth token.'''\n    return h(1)\n",
    "pkg/util.py": "def helper(x):\n    return x\n",
    "other.py": "def helper(x):\n    return 2\n",
    "node_modules/skip.ts": "export function skipped() {}\n",
    "notes.txt": "not code",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    graph = CodeGraph.init(spark, str(root))
    return root, graph, graph.index_all()


def edges(graph):
    return sorted((tuple(r) for r in graph.edges.select("source", "target", "kind", "line").collect()), key=repr)


def test_index(tree):
    root, graph, result = tree
    assert (result.files_indexed, result.files_skipped, result.files_errored, result.success) == (10, 2, 0, True)
    linked = {(s.split(":", 1)[1], t.split(":", 1)[1], k) for s, t, k, _ in edges(graph) if k != "contains"}
    assert ("main.ts:main:2", "lib/math.ts:add:1", "calls") in linked and ("app.py:run:3", "pkg/util.py:helper:1", "calls") in linked
    assert ("Dog.ts:Dog:2", "Animal.ts:Animal:1", "extends") in linked and ("main.ts", "lib/math.ts", "imports") in linked
    assert not any(t.startswith(("decoy.ts:add", "other.py:helper")) for _, t, _ in linked)
    with pytest.raises(FileExistsError):
        CodeGraph.init(graph.spark, str(root))


def test_questions(tree):
    root, graph, _ = tree
    add = "function:lib/math.ts:add:1"
    assert sorted(r["id"] for r in graph.callers(add).collect()) == ["function:lib/math.ts:sub:2", "function:main.ts:main:2"]
    assert [r["id"] for r in graph.find_path("function:main.ts:unused:3", add).collect()] == ["function:main.ts:unused:3", "function:main.ts:main:2", add]
    near = graph.path_edges(graph.find_path("function:main.ts:main:2", add)).collect()
    assert ("function:lib/math.ts:sub:2", add) in [(r["source"], r["target"]) for r in near]
    assert "function:main.ts:unused:3" in [r["id"] for r in graph.dead_code().collect()]
    assert [r["path"] for r in graph.circular_dependencies().collect()] == [["x.ts", "y.ts"]]
    assert graph.node_source(add).startswith("export function add") and graph.stats()["files"] == 10
    assert "auth token" in graph.explore("auth token", "small")
    first = graph.search_nodes("add", 5).first()
    assert first["name"] == "add" and first["score"] == 1.0
    assert {r["name"] for r in graph.search_by_signature("number, number -> number").collect()} >= {"add", "sub"}


def test_tools(tree):
    root, graph, _ = tree
    for tool, args in {"search": {"query": "add"}, "signature_search": {"query": "-> number"}, "context": {"task": "add numbers in main"}, "callers": {"symbol": "add"}, "callees": {"symbol": "main"}, "impact": {"symbol": "add"}, "node": {"symbol": "Dog", "includeCode": True}, "status": {}, "dead_code": {}, "cycles": {}, "path": {"from": "main", "to": "add"}, "explore": {"query": "add", "budget": "small"}}.items():
        assert not tools.call(graph, tool, args).startswith("Error"), tool
    assert tools.call(graph, "nope", {}).startswith("Error")
    told = tools.call(graph, "path", {"from": "unused", "to": "main"})
    assert "function:main.ts:main:2 -[calls]-> function:lib/math.ts:add:1" in told and "1 edges" in told and "unused:3 -[calls]->" not in told
    out = io.StringIO()
    lines = [json.dumps({"jsonrpc": "2.0", "id": i, "method": m, "params": p}) for i, (m, p) in enumerate([("initialize", {}), ("tools/list", {}), ("tools/call", {"name": "cycles", "arguments": {}}), ("huh", {})])]
    tools.serve(OpenGraphs(graph.spark), str(root), [*lines, "not json", ""], out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    schemas = {t["name"]: t["inputSchema"] for t in replies[1]["result"]["tools"]}
    assert set(schemas) == set(tools.TOOLS) and schemas["path"]["required"] == ["from", "to"] and "projectPath" in schemas["status"]["properties"]
    assert len(replies[1]["result"]["tools"]) == 12 and "x.ts -> y.ts -> x.ts" in replies[2]["result"]["content"][0]["text"]
    assert replies[3]["error"]["code"] == -32601 and replies[4]["error"]["code"] == -32700


def test_sync_equals_full_index(tree):
    root, graph, _ = tree
    assert graph.sync() == {"unchanged": 10} and not graph.is_dirty()
    (root / "y.ts").unlink()
    (root / "lib/math.ts").write_text("// moved\n\n" + TREE["lib/math.ts"])
    (root / "new.ts").write_text("import { sub } from './lib/math';\nexport function fresh() { return sub(1, 2); }\n")
    assert graph.is_dirty() and graph.sync() == {"unchanged": 8, "removed": 1, "modified": 1, "added": 1}
    after, nodes, vectors = edges(graph), graph.nodes.count(), graph.store.table("embeddings").count()
    graph.index_all()
    assert (edges(graph), graph.nodes.count(), graph.store.table("embeddings").count()) == (after, nodes, vectors)
    (root / "y.ts").write_text(TREE["y.ts"])
    graph.sync()
    assert any(t == "function:y.ts:y:2" for _, t, k, _ in edges(graph) if k == "calls")


def test_streamed_bursts_equal_batch(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    base = 1_700_000_000
    times = [0, 1, 2, 10, 11, 30, 200]
    (folder / "a.json").write_text("\n".join(json.dumps({"path": f"f{t}.ts", "event": "modified", "ts": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(base + t))}) for t in times))
    events = watch.logged_events(spark, str(folder))
    query = watch.bursts(events, "3 seconds", "5 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["n_events"] for r in spark.table("bursts").collect()) == [1, 2, 3]


def test_bursts_are_told_by_folder(spark):
    rows = [("a/x.ts", 0), ("a/b/y.ts", 1), ("c/z.ts", 1), ("a/x.ts", 9), ("r.ts", 9), ("s.ts", 10)]
    events = spark.createDataFrame([(p, "modified", f"2024-01-01 00:00:{t:02d}") for p, t in rows], "path string, event string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r["key"], r["n_events"]) for r in watch.bursts(events, "3 seconds").collect()) == [("", 2), ("a", 1), ("a", 2), ("c", 1)]


def test_changes_call_back(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"path": "a.ts", "event": "modified", "ts": "2024-01-01T00:00:00Z"}))
    seen = []
    query = watch.on_change(watch.logged_events(spark, str(folder)), lambda: seen.append(1), "0 seconds", str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    assert seen == [1]
    rows = []
    (folder / "b.json").write_text("\n".join(json.dumps({"path": "b.ts", "event": e, "ts": f"2024-01-01T00:00:0{i}Z"}) for i, e in enumerate(("added", "modified"))))
    query = watch.upsert_stream(watch.logged_events(spark, str(folder)), ["path"], "ts", lambda df, n: rows.extend(tuple(r)[:2] for r in df.collect()), str(tmp_path / "d"))
    query.awaitTermination(120)
    assert sorted(rows) == [("a.ts", "modified"), ("b.ts", "modified")]


def test_file_stream(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.ts").write_text("x")
    (tmp_path / "t" / "b.txt").write_text("x")
    rows = []
    query = watch.upsert_stream(watch.file_events(spark, str(tmp_path / "t")), ["path"], "ts", lambda df, n: rows.extend(r["path"] for r in df.select("path").collect()), str(tmp_path / "c"))
    query.awaitTermination(120)
    assert [r.rsplit("/", 1)[-1] for r in rows] == ["a.ts"]


def test_store_is_empty_before_indexing(spark, tmp_path):
    graph = CodeGraph.init(spark, str(tmp_path))
    with pytest.raises(LookupError):
        graph.nodes
    assert CodeGraph.is_initialized(spark, str(tmp_path)) and graph.store.size() == 0 and CodeGraph.nearest_root(str(tmp_path / "a" / "b")) == str(tmp_path)
