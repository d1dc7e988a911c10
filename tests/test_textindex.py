"""The stored positional index against the scan of texts, its changes, and what a search reads."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import search, textindex
from graphloom.operators.textindex import TextIndex
from graphloom.sources.manifests import Conflict, Manifests

SCHEMA = "id long, kind string, name string, qualified_name string, docstring string, language string, places string, block int"
WORDS = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta9", "x", "the", "the", "the", "al", "alphabet", "snake_case", "a/b"]
QUERIES = ["alpha", "al", "the beta", "beta_gamma", "the_the_the al", "epsilon", "x the_x", "snake_case", "case_snake", "a_b the", "the_alpha_be", "zeta9", "nothing", "the nothing", "AND", ""]


def texts(spark, n, seed=1):
    rng = random.Random(seed)
    say = lambda: rng.choice([None, "", *[" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 30))) for _ in range(9)]])
    return spark.createDataFrame([(i, "k", say(), say(), say(), rng.choice("ab"), "q", 7) for i in range(n)], SCHEMA).repartition(3)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(textindex, "FILE_CHARS", 2000)


def test_search_equals_scan(spark, tmp_path, small_blocks):
    nodes = texts(spark, 150).cache()
    index = TextIndex.build(nodes, str(tmp_path), search.TEXT_COLUMNS)
    assert index.columns == ["name", "qualified_name", "docstring"]
    hits = 0
    for query in QUERIES:
        want = ids(search.by_text(nodes, query, limit=None))
        assert ids(index.search(query)) == ids(search.by_text(nodes, query, limit=None, index=index)) == want
        hits += bool(want)
    assert hits >= 10
    assert ids(search.by_text(nodes, "the", languages=("a",), limit=5, index=index)) == ids(search.by_text(nodes, "the", languages=("a",), limit=5))


def test_a_hot_token_is_many_rows(spark, tmp_path, small_blocks):
    TextIndex.build(texts(spark, 150), str(tmp_path), search.TEXT_COLUMNS)
    rows = spark.read.parquet(f"{tmp_path}/segment-*/postings").where("token = 'the'").select(F.size(F.array_distinct("ids")).alias("n")).collect()
    assert len(rows) > 5 and max(r["n"] for r in rows) < 40


def test_search_opens_the_files_of_its_tokens(spark, tmp_path, small_blocks):
    nodes = spark.createDataFrame([(i, "k", None, None, f"word{i:04d} common w{i % 7}", "a", "q", 7) for i in range(1500)], SCHEMA)
    index = TextIndex.build(nodes, str(tmp_path), search.TEXT_COLUMNS)
    files = spark.read.parquet(f"{tmp_path}/segment-*/directory").count()
    assert ids(index.search("word0700")) == [700] and files > 10 and len(index.opened) <= 2
    assert ids(index.search("common word0700")) == [700] and len(index.opened) < files / 2
    plan = index.search("common word0700")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,word0700)" in plan and "EqualTo(token,common)" in plan or "In(token" in plan
    # Scanned rows: blocks of the tokens alone.
    assert index.search("nothing").count() == 0 and len(index.opened) <= 1


def test_occurrences_are_shuffled_once(spark):
    """Rows of a range are grouped where they are."""
    ranged = spark.createDataFrame([(1, 0, "a", 1)], "id long, block int, token string, place int").repartitionByRange(3, "token", "block")
    plan = ranged.groupBy("token", "block").agg(F.collect_list("id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan


def test_texts_are_shuffled_and_not_their_tokens(spark, tmp_path, monkeypatch):
    """Between the texts and the files no row is a single occurrence: a token of a block comes as one row."""
    seen = []
    monkeypatch.setattr(textindex, "written", lambda df, label: seen.append(df.localCheckpoint()) or seen[-1])
    nodes = spark.createDataFrame([(i, "k", None, None, "one two two " * 50, "a", "q", 7) for i in range(40)], SCHEMA)
    index = TextIndex.build(nodes, str(tmp_path), search.TEXT_COLUMNS)
    rows = {r["token"]: r for r in seen[0].collect()}
    assert set(rows) == {"", "one", "two"} and seen[0].count() == 3 and rows[""]["rows"] == list(range(40))
    assert rows["two"]["ids"] == [i for i in range(40) for _ in range(100)] and len(set(zip(rows["two"]["ids"], rows["two"]["places"]))) == 4000
    assert ids(index.search("two_one tw")) == list(range(40))


def test_changes_and_compaction(spark, tmp_path, small_blocks):
    old, new = texts(spark, 90).cache(), texts(spark, 140, seed=2).cache()
    index = TextIndex.build(old, str(tmp_path), search.TEXT_COLUMNS)
    index = index.add(new.where("id % 3 = 0"))
    index = index.remove(old.where("id % 5 = 0").select("id"))
    index = index.change(new.where("id % 10 = 5"), old.where("id % 7 = 3").select("id"))
    rows = {r["id"]: r for r in old.collect()} | {r["id"]: r for r in new.where("id % 3 = 0").collect()}
    for i in [r["id"] for r in old.where("id % 5 = 0 or id % 7 = 3").select("id").collect()]:
        rows.pop(i, None)
    rows |= {r["id"]: r for r in new.where("id % 10 = 5").collect()}
    last = spark.createDataFrame(list(rows.values()), old.schema)
    whole = index.compact()
    assert len(index.segments) == 4 and len(whole.segments) == 1
    for query in QUERIES:
        want = ids(search.by_text(last, query, limit=None))
        assert ids(index.search(query)) == want and ids(whole.search(query)) == want
    assert ids(TextIndex(spark, str(tmp_path), 1).search("the")) == ids(search.by_text(old, "the", limit=None))


def test_empty(spark, tmp_path):
    nodes = texts(spark, 5)
    index = TextIndex.build(nodes.limit(0), str(tmp_path / "a"), search.TEXT_COLUMNS)
    assert index.search("the").collect() == []
    index = index.add(nodes)
    assert ids(index.search("the")) == ids(search.by_text(nodes, "the", limit=None))
    index = index.remove(nodes.select("id"))
    assert index.search("the").collect() == [] and index.compact().search("the").collect() == []
    assert TextIndex(spark, str(tmp_path / "b")).search("the").collect() == []


def test_two_writers(spark, tmp_path):
    nodes = texts(spark, 5)
    index = TextIndex.build(nodes, str(tmp_path), search.TEXT_COLUMNS)
    other = TextIndex(spark, str(tmp_path))
    index.add(nodes)
    with pytest.raises(Conflict):
        other.add(nodes)
    assert TextIndex(spark, str(tmp_path)).version == 2


def test_a_lost_writer_blocks_nobody_for_long(spark, tmp_path):
    state = Manifests(spark, str(tmp_path))
    assert state.commit({"a": 1}, 0) == 1
    (tmp_path / ".claim-2").write_text("")
    with pytest.raises(Conflict):
        state.commit({"a": 2}, 1)
    assert state.commit({"a": 2}, 1, stale_s=-1) == 2 and state.manifest() == {"a": 2}
    with pytest.raises(Conflict):
        state.commit({"a": 3}, 1, stale_s=-1)


def test_lock_belongs_to_its_owner(spark, tmp_path):
    a = Manifests(spark, str(tmp_path))
    with a.lock():
        with pytest.raises(Conflict), a.lock():
            pass
        with a.lock(stale_s=-1):  # the first one's lock is taken for left behind
            pass
        assert not a.exists(".lock")
        with a.lock():
            pass
    with a.lock():
        pass
    with pytest.raises(ZeroDivisionError), a.lock():
        1 / 0
    assert not a.exists(".lock")
