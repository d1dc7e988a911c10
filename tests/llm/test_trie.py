import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import trie
from graphloom.llm.queries import ORACLES, op13_prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, part string, path string, turns string"


def brute(members):
    """Every node by its definition, from (id, list of (role, text))."""
    nodes = defaultdict(list)
    for c, turns in members:
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append((c, d == len(turns)))
    least = lambda path: min((c for c, _ in nodes[path] if c is not None), default=None)
    kids = defaultdict(list)
    for path in nodes:
        if path:
            kids[path[:-1]].append(path)
    out = []
    for path in nodes:
        below, todo = [], [path]
        while todo:
            below.append(todo.pop())
            todo += kids[below[-1]]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c, e in nodes[path] if e and c is not None))
        out.append((least(path), len(path), least(path[:-1]) if path else None, len(nodes[path]), len(kids[path]), sum(not kids[p] for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(own):
    out = []
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if c is not None else 0
        out.append((c, own.get(c - c % 5, [])[:h] + turns[h:] if c is not None else turns))
    return out


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


keys = st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=6), st.one_of(st.none(), st.integers(-3, 12))), max_size=25)


@settings(max_examples=200, deadline=None)
@given(keys, st.integers(1, 6))
def test_merge_knows_what_rows_share(rows, n):
    rows = [(b"".join(bytes([x]) * trie.TURN for x in k), [1] * len(k), c) for k, c in rows]
    tree = trie.LoserTree([trie.sorted_run(rows[i::n]) for i in range(n)])
    merged = list(tree)
    assert [trie._order(r) for _, r in merged] == sorted(map(trie._order, rows))
    before = b""
    for shared, (key, *_) in merged:
        d = 0
        while d < min(len(key), len(before)) // trie.TURN and key[d * trie.TURN : (d + 1) * trie.TURN] == before[d * trie.TURN : (d + 1) * trie.TURN]:
            d += 1
        assert shared == d
        before = key


def test_merge_does_not_look_at_shared_turns_again():
    """Runs whose strings share 1,000 turns: after the first rows, matches begin behind them."""
    opening = b"".join(i.to_bytes(trie.TURN, "big") for i in range(1000))
    rows = [(opening + random.Random(i).randbytes(trie.TURN), [1] * 1001, i) for i in range(400)]
    tree = trie.LoserTree([trie.sorted_run(rows[i::8]) for i in range(8)])
    assert len(list(tree)) == 400
    assert tree.compared < 7 * 1001 + 400 * 2 * 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=40), st.lists(st.integers(0, 1), max_size=40))
def test_shared_turns(a, b):
    want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = (b"".join(bytes([x]) * trie.TURN for x in z) for z in (a, b))
    assert all(trie.shared_turns(a, b, known) == want for known in range(want + 1))


def made(spark, own):
    rows = [(c, i, r, t, "q", "q", "q") for c, turns in own.items() for i, (r, t) in enumerate(turns)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def test_nodes_over_many_ranges(spark):
    """Few rows a range and run, a hot opening, and 150 equal conversations, whose ids several ranges and pieces hold."""
    rng = random.Random(5)
    own = {i: [("user", "hot")] * (i % 3 > 0) + [("user" if j % 2 else "assistant", f"é{rng.randrange(3)}") for j in range(rng.randrange(6))] for i in range(-20, 300)}
    own |= {1000 + i: [("user", "hot"), ("assistant", "same"), ("user", "")] for i in range(150)}
    own |= {2000 + i: [("user", "hot"), ("assistant", "same")] for i in range(60)}
    own[5000] = [("user", str(i)) for i in range(300)]
    own = {c: t for c, t in own.items() if t}
    sequences = trie.turn_sequences(made(spark, own))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        for piece, run_rows in ((3, 10), (1 << 13, 1 << 17)):
            assert rows_of(trie.prefix_trie(sequences, run_rows=run_rows, range_bytes=2000, piece=piece)) == brute(own.items())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rebuilding(spark):
    rng = random.Random(7)
    own = {c: [("user", f"t{rng.randrange(4)}") for _ in range(rng.randrange(1, 12))] for c in rng.sample(range(60), 40)}
    assert any(not t for _, t in rebuilt(own))  # one without turns among them
    got = trie.prefix_trie(trie.with_shared_openings(trie.turn_sequences(made(spark, own))))
    assert rows_of(got) == brute(rebuilt(own))


def test_awkward_rows(spark):
    """Null turns come first, null roles and texts are empty, ties have one order, repeated rows are turns of their own, a
    very long turn, null ids are one conversation, and clashing columns aren't read."""
    long = "x" * 200_000
    rows = [
        (1, None, None, "first"), (1, 0, "user", None), (1, 1, "user", long),
        (2, None, "", "first"), (2, 5, "user", ""), (2, 6, "user", long),
        (None, 0, "user", "a"), (None, 1, "user", "b"),
        (3, 0, "user", "a"), (3, 0, "user", "a"),
        (4, 0, "user", "p"), (4, 0, "user", "q"), (14, 0, "user", "q"), (14, 0, "user", "p"),
    ]
    df = spark.createDataFrame([(*r, "q", "q", "q") for r in rows], SCHEMA)
    got = rows_of(trie.prefix_trie(trie.turn_sequences(df)))
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    pq = sorted([("user", "p"), ("user", "q")], key=lambda t: digest(*t))
    same = [("", "first"), ("user", ""), ("user", long)]
    assert got == brute([(1, same), (2, same), (None, [("user", "a"), ("user", "b")]), (3, [("user", "a")] * 2), (4, pq), (14, pq)])
    rebuilt_too = trie.with_shared_openings(trie.turn_sequences(df))
    assert rebuilt_too.count() == 6 and rebuilt_too.where(F.col("conv_id").isNull()).first()["turns"] == trie.turn_sequences(df).where(F.col("conv_id").isNull()).first()["turns"]
    assert trie.prefix_trie(trie.with_shared_openings(trie.turn_sequences(df.limit(0)))).collect() == []


def test_empty_sequences(spark):
    df = spark.createDataFrame([(7, None), (3, [])], "conv_id long, turns array<struct<digest: binary, bytes: bigint>>")
    assert rows_of(trie.prefix_trie(df)) == brute([(7, []), (3, [])])


def test_query_against_brute_force_and_sql(spark, small):
    own = defaultdict(list)
    for r in spark.read.parquet(f"{small}/conversations.parquet").orderBy("conv_id", F.col("turn").asc_nulls_first()).collect():
        own[r["conv_id"]].append((r["role"] or "", r["text"] or ""))
    got = rows_of(op13_prefix_trie(spark, small))
    assert got == brute(rebuilt(own))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    sql = db.sql(ORACLES["op13_prefix_trie"])
    assert got == sorted((tuple(r[sql.columns.index(c)] for c in COLUMNS) for r in sql.fetchall()), key=repr)
