import hashlib
import re
from collections import Counter

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm.bytebpe import read_ranks
from graphloom.llm.common import written
from tests.llm.test_outliers import counts
from tests.llm.test_probminhash import classes


def test_stages_one_by_one(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    held = {0: {r["doc_id"]: r["text"] for r in docs.collect()}}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, small), f"test{i}")
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        if i < 3:
            held[i + 1] = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert docs.count() == len(held[i + 1]) and held[i + 1].items() <= held[i].items()
    for text in held[1].values():
        n, *_, again = counts(text)
        assert n >= 50 and 2 * again <= n
    last = {}
    for i in sorted(held[1]):
        last[held[1][i]] = i
    assert set(held[2]) == set(last.values())
    assert set(held[3]) == set(classes(held[2]).values())
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rows = docs.collect()
    taken = sum(len(held[3][r["doc_id"]].split()) for r in rows)
    assert abs(taken - 1.5 * sum(len(t.split()) for t in held[3].values())) < 0.01 * taken
    for r in rows[:100]:
        ids = encoding.encode_ordinary(held[3][r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_awkward_rows(spark, awkward, nothing):
    """Rows out of each stage: no text stands the quality rules; rows 1, the null-id text, 5 or 6, 7 and 8 differ, and texts
    without words are one class; the mix takes words alone; every row is encoded."""
    want = {"quality rules": {0}, "exact dedup": {7}, "near dedup": {6}, "mixing": set(range(5, 15)), "byte BPE": {11}}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, awkward, "").collect()
        assert len(rows) in want[name], (name, len(rows))
        if name == "mixing":
            assert all((r["text"] or "").split() for r in rows) and max(Counter((r["doc_id"], r["text"]) for r in rows).values()) <= 4
        assert stage(spark, nothing, "").collect() == []


def plain(rows):
    return sorted(map(tuple, rows), key=repr)


def test_stages_on_repeated_and_null_ids_against_brute_force(spark, awkward, nothing):
    """Every stage on rows that share ids, texts, both or everything, held against plain loops."""
    text = lambda seed, n=60: " ".join(f"{seed}w{i}" for i in range(n))
    t, u, v, w = (text(x) for x in "tuvw")
    near = t + " one more"
    rows = [(1, t, "en", "a", 1), (1, u, "en", "a", 1), (9, t, "en", "a", 1), (9, t, "en", "a", 1), (9, t, "de", None, 2), (None, v, "en", "b", 3), (None, v, "en", "b", 3), (None, w, None, None, None)]
    rows += [(4, near, "en", "b", 5), (4, near, "en", "b", 5), (1, near, "en", "c", 5), (3, "", None, None, 0), (2, None, "en", "a", None), (5, text("x", 30_000), "en", "b", 9), (6, text("x", 30_000), "en", "b", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_row", F.lit("q")).withColumn("_sha", F.lit(1)).repartition(3)
    least = lambda x: -1 if x is None else x
    for docs in (df, awkward, nothing):
        docs = written(docs, "docs")
        held = [tuple(r) for r in docs.select(corpus_pipeline.COLUMNS).collect()]
        got = plain(corpus_pipeline.quality_stage(spark, docs, "").collect())
        assert got == plain(r for r in held if (c := counts(r[1] or ""))[0] >= 50 and 2 * c[4] <= c[0])
        best = {}
        for r in held:
            best.setdefault(r[1] or "", []).append(r)
        got = corpus_pipeline.exact_stage(spark, docs, "").collect()
        assert {(r["doc_id"], r["text"] or "") for r in got} == {(max((r[0] for r in of), key=least), x) for x, of in best.items()} and len(got) == len(best)
        assert {tuple(r) for r in got} <= set(held)
        words = {i: " ".join((r[1] or "").split()) for i, r in enumerate(held)}
        label = classes(words)
        most = {}
        for i, c in label.items():
            most.setdefault(c, []).append(held[i])
        got = corpus_pipeline.near_stage(spark, docs, "").collect()
        smallest = lambda of: min((r[0] for r in of), key=lambda x: 1 << 60 if x is None else x)
        assert sorted((r["doc_id"] for r in got), key=repr) == sorted((smallest(of) for of in most.values()), key=repr) and {tuple(r) for r in got} <= set(held)
        taken = Counter(map(tuple, corpus_pipeline.mixing_stage(spark, docs, "").collect()))
        times = Counter(held)
        assert all(n <= 2 * times[r] for r, n in taken.items())
        size = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows)
        assert abs(size(taken.elements()) - 1.5 * size(held)) <= 0.05 * size(held) + 70
        assert corpus_pipeline.encoding_stage(spark, docs, "").count() == len(held)


def test_texts_are_dealt_out_once_and_by_one_plan_at_any_size(spark, tiny):
    """The exact stage shuffles texts in its groups alone; decisions of the others meet the texts without a broadcast."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(corpus_pipeline.exact_stage(spark, docs, "")).count("Exchange") == 1
    for stage in (corpus_pipeline.near_stage, corpus_pipeline.mixing_stage):
        out = stage(spark, docs, "")
        out.collect()  # adaptive execution may change the join
        assert re.search(r"\w+Join", plan(out))[0] == "SortMergeJoin"


def test_run(spark, tiny):
    assert corpus_pipeline.run(spark, tiny).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
