import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import periodic
from graphloom.llm.queries import ORACLES, op12_periodic_runs, run_digests


def brute(words, least=24, times=3):
    """Every stretch by its definition: for each period, the stretches that keep it; of equal stretches the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            k = 0
            while i + k + q < n and words[i + k] == words[i + k + q]:
                k += 1
            if k + q >= max(least, times * q):
                found.setdefault((i, k + q), q)
            i += k + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def ids_of(words):
    number = {}
    return np.array([number.setdefault(w, len(number)) for w in words], np.int64)


texts = st.lists(st.tuples(st.lists(st.integers(0, 4), max_size=9), st.integers(1, 9)), max_size=9).map(lambda parts: [x for block, n in parts for x in block * n])


@settings(max_examples=300, deadline=None)
@given(texts, st.sampled_from([0, 3, None]), st.sampled_from([(24, 3), (4, 2), (1, 3), (10, 4)]))
def test_runs_against_brute_force(words, heavy, least):
    assert periodic.runs_of(ids_of(words), *least, heavy=heavy) == brute(words, *least)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=120), st.integers(0, 40))
def test_counts_are_exact_on_both_ways(words, heavy):
    want = [0] + [sum(words[i] == words[i + q] for i in range(len(words) - q)) for q in range(1, 41)]
    assert periodic.lag_counts(ids_of(words), 40, heavy).tolist() == want


def test_pairs_are_held_in_blocks(monkeypatch):
    words = [random.Random(1).randrange(3) for _ in range(400)]
    want = periodic.lag_counts(ids_of(words), 133, 1000)
    monkeypatch.setattr(periodic, "PAIRS", 50)
    assert (periodic.lag_counts(ids_of(words), 133, 1000) == want).all() and (periodic.lag_counts(ids_of(words), 133, 0) == want).all()


def test_long_texts():
    """One word 300,000 times, a long run within ordinary words, and two letters at random: all whole."""
    n = 300_000
    assert periodic.runs_of(np.zeros(n, np.int64)) == [(0, n, 1)]
    rng = np.random.default_rng(1)
    words = rng.zipf(1.3, n) % 50_000
    block = np.arange(7_000) + 100_000
    words[100_000:128_000] = np.tile(block, 4)
    assert (100_000, 28_000, 7_000) in periodic.runs_of(ids_of(words.tolist()))
    two = rng.integers(0, 2, 4_000)
    assert periodic.runs_of(two) == brute(two.tolist())


def test_overlapping_runs_and_what_stays():
    words = "x y".split() * 12 + "z".split() * 30 + "a b c d e f g h i".split() * 3 + ["end"]
    runs = periodic.runs_of(ids_of(words))
    assert runs == [(0, 24, 2), (24, 30, 1), (54, 27, 9)]
    assert [w for w, k in zip(words, periodic.collapsed(len(words), runs)) if k] == "x y z a b c d e f g h i end".split()


def test_query_against_brute_force_and_sql(spark, small, documents):
    out = {r["doc_id"]: r for r in op12_periodic_runs(spark, small).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    some = 0
    for doc, text in documents.select("doc_id", "text").collect():
        words = text.encode().split()
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 700:
            continue
        runs = brute(words)
        some += bool(runs)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        r = out[doc]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode())
        assert r["collapsed_sha256"] == sha(b" ".join(w for i, w in enumerate(words) if i not in gone))
    assert some > 50
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    sql = db.sql(ORACLES["op12_periodic_runs"])
    assert {tuple(r[c] for c in sql.columns) for r in out.values()} == set(sql.fetchall())


def test_awkward_rows(spark, awkward, nothing):
    out = run_digests(periodic.find_runs(awkward)).collect()
    assert len(out) == awkward.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[1]) == 2 and by[1][0] == by[1][1] and len(by[None]) == 2
    assert all(r["n_runs"] == 0 and r["collapsed_sha256"] == hashlib.sha256(b"").hexdigest() for i in (2, 3, 4) for r in by[i])
    assert (by[5][0]["n_runs"], by[5][0]["start"], by[5][0]["length"], by[5][0]["period"]) == (1, 0, 30_000, 1)
    assert by[5][0]["collapsed_sha256"] == hashlib.sha256(b"word").hexdigest()
    planted = periodic.with_planted_repeats(awkward).collect()
    assert len(planted) == awkward.count() and sum(r["doc_id"] is None for r in planted) == 2
    assert run_digests(periodic.find_runs(periodic.with_planted_repeats(nothing))).collect() == []


@pytest.mark.parametrize("best", [[(0, 24, 8), (30, 48, 16), (90, 24, 8)], [(5, 30, 10), (5, 30, 10)]])
def test_ties_go_to_the_smallest_start(spark, best):
    df = spark.createDataFrame([(1, [dict(zip(("start", "length", "period"), b)) for b in best], "")], "doc_id long, runs array<struct<start: bigint, length: bigint, period: bigint>>, text string")
    r = run_digests(df).first()
    assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (*best[0], 3000)
