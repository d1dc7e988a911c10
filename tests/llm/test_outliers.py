import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import outliers, queries


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {j for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_query_against_brute_force(spark, small, texts):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = queries.op10_quality_rules(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dup, again = counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, again)
        assert r["base_failed"] == (n < 50 or 100 * again > 50 * n) and not (r["base_failed"] and r["kept"])
    clean = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    junk = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 0]
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.05


def test_estimates_resist_outliers(spark):
    rng = np.random.default_rng(2)
    cov = np.array([[1.0, 0.6], [0.6, 2.0]])
    good = rng.multivariate_normal([3, -1], cov, 4000)
    bad = rng.normal(40, 1, (800, 2))
    rows = spark.createDataFrame([("g", float(a), float(b)) for a, b in np.concatenate((good, bad))], "g string, x0 double, x1 double")
    est = outliers.robust_outliers(rows, ["a", "b"], ["g"], {"a": 1e-3, "b": 1e-3}).first()
    low = np.array([[est["l00"], 0], [est["l10"], est["l11"]]])
    assert np.allclose([est["m0"], est["m1"]], [3, -1], atol=0.15) and np.allclose(low @ low.T, cov, rtol=0.3, atol=0.15)


def test_chi_square():
    assert abs(outliers.chi_square(0.95, 5) - 11.07) < 0.1 and abs(outliers._inner_share(11.07, 5) - 0.864) < 0.01


def test_awkward_rows(awkward, nothing):
    out = outliers.quality_rules(awkward)
    rows = out.collect()
    assert len(rows) == awkward.count() and all(r["base_failed"] for r in rows)
    assert outliers.quality_rules(nothing).count() == 0


def test_small_groups_judge_nothing(spark):
    text = " ".join(f"word{i}" for i in range(80))
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit(text + " "), F.repeat(F.lit("### "), F.col("id").cast("int"))).alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"))
    assert outliers.quality_rules(df).where("not kept and not base_failed").count() == 0


def test_plan_is_native(documents):
    plan = outliers.text_counts(documents, F.col("text"), [F.col("doc_id")])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def brute_force_determinant(x, share, spreads, draws=300, seed=5):
    """Least log determinant, and its centre, over concentration steps from many random sets, by exact order of distances."""
    rng, (n, p) = np.random.default_rng(seed), x.shape
    h, best = int(np.ceil(share * n)), None
    scale = share / outliers._inner_share(outliers.chi_square(share, p), p)
    for _ in range(draws):
        some = x[rng.choice(n, p + 1, replace=False)]
        for _ in range(30):
            m, c = some.mean(axis=0), scale * np.cov(some.T, bias=True) + np.diag(np.square(spreads))
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            some = x[np.argsort(d)[:h]]
        m, c = some.mean(axis=0), scale * np.cov(some.T, bias=True) + np.diag(np.square(spreads))
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0]:
            best = det, m
    return best


def test_estimates_against_brute_force(spark):
    rng = np.random.default_rng(8)
    groups = {
        "plain": rng.normal([1, 2, 3], [1, 0.5, 2], (500, 3)),
        "spoilt": np.concatenate((rng.multivariate_normal([0, 0, 0], [[1, 0.9, 0], [0.9, 1, 0], [0, 0, 1]], 320), rng.normal([2.5, -2.5, 2], 0.2, (100, 3)))),
        "few": rng.normal(0, 1, (9, 3)),
    }
    data = [(g, *map(float, x)) for g, xs in groups.items() for x in xs]
    rows = spark.createDataFrame(data, "g string, x0 double, x1 double, x2 double").repartition(4)
    names, spreads = ["a", "b", "c"], {"a": 0.01, "b": 0.01, "c": 0.01}
    by_way = [{r["g"]: r for r in outliers.robust_outliers(rows, names, ["g"], spreads, reweigh=None, most_broadcast=most).collect()} for most in (20_000, 0)]
    for g, x in groups.items():
        got = by_way[0][g]
        assert all(abs(got[c] - by_way[1][g][c]) < 1e-9 for c in got.asDict() if c != "g") and got["n"] == len(x)
        if g != "few":
            det, centre = brute_force_determinant(x, 0.75, [0.01] * 3)
            assert 2 * sum(np.log(got[f"l{i}{i}"]) for i in range(3)) < det + 0.1
            assert np.allclose([got[f"m{i}"] for i in range(3)], centre, atol=0.15)


def test_bound_widens_with_fewer_rows(spark):
    ns = [3, 12, 16, 50, 500, 1e9]
    got = [r["f"] for r in spark.createDataFrame([(float(n),) for n in ns], "n double").select(outliers.farthest(F.col("n"), 5, 1e-9).alias("f")).collect()]
    assert got[:2] == [None, None] and got[2] > got[3] > got[4] > got[5] and abs(got[5] - outliers.chi_square(1 - 1e-9, 5)) < 1e-3


def test_shrinking_keeps_large_groups_and_leans_small_ones(spark):
    row = lambda level, lang, source, n, m, v: (level, lang, source, n, m, v**0.5)
    levels = [row(0, "a", "x", 10_000, 1.0, 1.0), row(0, "a", "y", 50, 3.0, 4.0), row(1, "a", "", 10_050, 1.0, 1.0), row(0, "b", "x", 25, 9.0, 2.0), row(1, "b", "", 25, 9.0, 2.0), row(2, "", "", 10_075, 1.0, 1.0)]
    df = spark.createDataFrame(levels, "_level int, _lang string, _source string, n long, m0 double, l00 double")
    got = {(r["_lang"], r["_source"]): (r["n"], r["m0"], r["l00"] ** 2) for r in outliers.shrunk(df, 1, 100.0).collect()}
    assert np.allclose(got["a", "x"], (10_075, 1.0, 1.0)) and np.allclose(got["a", "y"], (150, 5 / 3, 2.0))
    # Language a has 25 rows beyond its own, and its larger source 75 beyond that.  Language b: 25 rows of its own and 100 of all; the group has these 125 and nothing beyond its own but the 100.
    assert np.allclose(got["b", "x"], (125, (25 * 9 + 100 * 2.6) / 125, (25 * 2 + 100 * 1.2) / 125))
