import heapq
import math
import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import probminhash, queries


def classes(texts, least=0.8, width=5):
    """Of {id: text}: the smallest id that links and copies lead to.

    All pairs of different sets that share one of their rarest shingles are compared: sets that are similar by ``least``
    must share one among the first 1 - ``least`` of each, in any common order.
    """
    sets, copies = {}, {}
    for i in sorted(texts):
        w = texts[i].encode().split()
        key = frozenset(tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))) if w else frozenset()
        if w:
            sets[copies.setdefault(key, i)] = key
        copies.setdefault(key, i)
        copies[i] = copies[key]
    times = Counter(x for s in sets.values() for x in s)
    at = defaultdict(list)
    for i, s in sets.items():
        for x in heapq.nsmallest(len(s) - math.ceil(least * len(s)) + 1, s, key=lambda x: (times[x], x)):
            at[x].append(i)
    up = {i: copies[i] for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in {(ids[b], ids[a]) for ids in at.values() for a in range(len(ids)) for b in range(a)}:
        n = len(sets[a] & sets[b])
        if n / (len(sets[a]) + len(sets[b]) - n) >= least:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: top(i) for i in texts}


def as_table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")


def test_query_against_brute_force(spark, small, texts):
    got = {r["doc_id"]: r["class_id"] for r in queries.op6_near_dedup(spark, small).collect()}
    want = classes(texts)
    assert sum(got[i] != want[i] for i in texts) == 0 and len(set(want.values())) < len(want)


def test_families_and_common_passages(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = {}
    for f in range(6):
        base = [word() for _ in range(150)]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(150)] = word()
            texts[len(texts)] = " ".join(own)
    passage = " ".join(word() for _ in range(50))
    for _ in range(60):
        texts[len(texts)] = passage + " " + " ".join(word() for _ in range(100))
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(as_table(spark, texts)).collect()}
    assert got == classes(texts)


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 60, 400)
    b = np.concatenate((a[:340], rng.integers(0, 1 << 60, 60)))
    flat, offsets = np.concatenate((a, b)), np.array([0, 400, 800])
    registers, distinct, _ = probminhash.signatures(flat, offsets, 5, 2000)
    want = probminhash.jaccard(*(np.unique(probminhash.shingles(x, 5)) for x in (a, b)))
    assert distinct.tolist() == [396, 396] and abs((registers[0] == registers[1]).mean() - want) < 0.04


def test_connected(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60), (60, 55)], "a long, b long")
    out = {r["node"]: r["label"] for r in probminhash.connected(links, "a", "b").collect()}
    assert out == {i: 0 for i in range(31)} | {50: 50, 55: 50, 60: 50}


def test_connected_goes_on_from_labels(spark):
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    labels = probminhash.connected(table([(1, 2), (2, 3), (7, 8), (20, 21)]), "a", "b")
    out = [tuple(r) for r in probminhash.connected(table([(3, 8), (8, 3), (30, 7), (41, 40), (2, 1)]), "a", "b", labels).collect()]
    assert sorted(out) == [(1, 1), (2, 1), (3, 1), (7, 1), (8, 1), (20, 20), (21, 20), (30, 1), (40, 40), (41, 40)]


def test_pairs_follow_the_members_of_a_family(spark, monkeypatch):
    """A family of near copies shares nearly all its buckets: a few pairs are compared for each member, not one in each bucket."""
    rng = random.Random(8)
    base, texts = [f"w{rng.randrange(5000)}" for _ in range(150)], {}
    for i in range(600):
        own = list(base)
        for _ in range(rng.choice((1, 2, 3))):
            own[rng.randrange(150)] = f"x{rng.randrange(100_000)}"
        texts[i] = " ".join(own)
    compared, real = [], probminhash.written

    def counted(df, label):
        out = real(df, label)
        if label == "pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(probminhash, "written", counted)
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(as_table(spark, texts), block=32).collect()}
    assert got == classes(texts)
    assert sum(compared) < 4 * len(texts)


def test_awkward_rows(spark, awkward, nothing):
    out = {(r["doc_id"], r["class_id"]) for r in probminhash.near_duplicates(awkward).collect()}
    assert out == {(1, 1), (2, 2), (3, 2), (4, 2), (5, 5), (6, 5), (7, 7), (8, 8), (None, None), (None, 2)}
    assert probminhash.near_duplicates(awkward).count() == awkward.count()
    assert probminhash.near_duplicates(nothing).count() == 0


def test_near_copies_apart_in_a_crowded_bucket(spark):
    """Pages of one template, unlike each other, with pairs of near copies among them: every pair of a bucket is tested."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(100_000)}"
    template, texts = [word() for _ in range(180)], {}
    for i in range(200):
        own = template + [word() for _ in range(26)]
        texts[i] = " ".join(own)
        if i % 4 == 0:
            for j in (20, 60, 100, 140):
                own[j] = word()
            texts[10_000 - i] = " ".join(own)
    want = classes(texts)
    assert len(set(want.values())) == 200
    # Five bands of one register make crowded buckets; a pair that agrees in none of them never meets.
    df = as_table(spark, texts)
    words = {r["doc_id"]: np.array(r["w"]) for r in df.select("doc_id", probminhash.words_hashed(F.col("text")).alias("w")).collect()}
    signed = {i: probminhash.signatures(w, np.array([0, len(w)]), 5, 5)[0][0] for i, w in words.items()}
    want = {i: c if (signed[i] == signed[c]).any() else i for i, c in want.items()}
    assert len(set(want.values())) < 205
    for block in (7, 128):
        got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(df, bands=5, rows=1, block=block).collect()}
        assert got == want


def test_large_family_around_the_threshold(spark):
    """Copies of one text that share a half to nine tenths with each other: classes that only chains of links make, and
    outliers that must be told from all of them."""
    rng = random.Random(21)
    base, texts = [f"w{rng.randrange(5000)}" for _ in range(150)], {}
    for i in range(700):
        own = list(base)
        for _ in range(rng.choice((2, 4, 6, 9, 12))):
            own[rng.randrange(150)] = f"w{rng.randrange(5000)}"
        texts[i] = " ".join(own)
    want = classes(texts)
    assert 50 < len(set(want.values())) < 650
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(as_table(spark, texts), block=32).collect()}
    assert got == want


def test_recall_on_the_larger_table(spark):
    """Every class of 10,000 documents, against brute force."""
    path = "/root/testdata/sf0.1"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["class_id"] for r in queries.op6_near_dedup(spark, path).collect()}
    want = classes(texts)
    assert sum(got[i] != want[i] for i in texts) == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2000), st.integers(0, 400), st.integers(0, 400), st.integers(0, 1 << 30))
def test_sketches_never_rule_out_a_link(common, only_a, only_b, seed):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 1 << 50, common + only_a + only_b).astype(np.uint64))
    common, only_a = min(common, len(x)), min(only_a, max(0, len(x) - common))
    sets = [x[: common + only_a], np.concatenate((x[:common], x[common + only_a :]))]
    one, two = (probminhash.Members(np.array([k]).tobytes(), np.array([k]).tobytes(), np.array([len(s)], np.int32).tobytes(), probminhash.parity(s, probminhash.sketch_bits(len(s)))) for k, s in enumerate(sets))
    true = probminhash.jaccard(*sets)
    i, _, most = probminhash.bounds(one, two, 0.8)
    assert (len(i) == 1 and most[0] >= true - 1e-12) if true >= 0.8 else (len(i) == 0 or most[0] >= true - 1e-12)


def test_repeated_passages_do_not_hide_near_copies(spark):
    """Texts with nearly the same shingles, of which one repeats a passage 500 times."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(1_000_000)}"
    texts = {}
    for i in range(0, 60, 2):
        own, passage = [word() for _ in range(104)], [word() for _ in range(30)]
        texts[i], texts[i + 1] = " ".join(own + passage), " ".join(own + passage * 500)
    want = classes(texts)
    assert len(set(want.values())) == 30
    assert {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(as_table(spark, texts)).collect()} == want
