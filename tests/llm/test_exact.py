import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from graphloom.llm import exact


def brute(rows, keep):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    pick = lambda ids: keep([i for i in ids if i is not None], default=None)
    return Counter((i, pick(groups[t or ""]), len(groups[t or ""]), i == pick(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def test_awkward_rows(awkward, nothing):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    for name, keep in (("smallest", min), ("largest", max)):
        assert Counter(map(tuple, exact.exact_dedup(awkward, keep=name).collect())) == brute(rows, keep)
    assert exact.exact_dedup(nothing).count() == 0


def test_collisions_part_by_bytes(spark):
    rows = [(i, f"{'ab' if i % 2 else 'cd'}{i % 5}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak = exact.exact_dedup(df, hash_with=lambda t: F.unhex(F.hex(F.length(t))))
    assert Counter(map(tuple, weak.collect())) == brute(rows, min)


def test_hot_group(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("hot").alias("text"))
    out = exact.exact_dedup(df, keep="largest")
    assert out.count() == 20_000 and out.where("group_size > 1").select("keep_id").distinct().collect()[0][0] == 19_999


def test_plan_is_native(documents):
    plan = exact.exact_dedup(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_last_of_equal_against_brute_force(spark, awkward, nothing):
    """Ties, nulls anywhere, repeated rows, and a hash under which different texts collide."""
    texts, langs, ids = [None, "", "a", "b", "cc"], [None, "de", "en"], [None, -5, 0, 7]
    rows = [(ids[i % 4], texts[i * 7 % 5], langs[i * 5 % 3], None if i % 11 == 0 else i % 2) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").withColumn("_row", F.lit("q")).repartition(5)
    least = lambda r: [(x is not None, x or 0 if k != 2 else x or "") for k, x in enumerate((r[0], 0 if r[1] is not None else None, r[2], r[3]))]
    best = {}
    for r in rows:
        best[r[1] or ""] = max(best.get(r[1] or "", r), r, key=least)
    for how in (exact.content_hash, lambda t: F.unhex(F.hex(F.length(t)))):
        got = exact.last_of_equal(df, ["doc_id", "lang", "n_chars"], hash_with=how)
        assert got.columns == ["doc_id", "text", "lang", "n_chars"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(best.values(), key=repr)
    assert exact.last_of_equal(nothing, ["doc_id", "lang"]).count() == 0
    assert exact.last_of_equal(awkward, ["doc_id", "lang"]).count() == 7
