import pytest

#: Columns that operators use inside, or that tables elsewhere have.
CLASHING = ("id", "_id", "_text", "h", "size", "spans", "seed", "same", "rep", "bucket", "kept", "score", "_base", "label")


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in any column, empty and very long texts, repeated rows, ties, and clashing extra columns."""
    long = "word " * 30_000
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 10),
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 10),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, "   \n\t ", "en", None, 5),
        (5, long, "de", "b", len(long)),
        (6, long, "de", "b", len(long)),
        (None, "a null id with a few words of text", "en", "b", 3),
        (None, None, None, None, None),
        (7, "é́ ünïcode \U0001f600 ｐａｓｓ \x1c\x85 x", "fr", "c", 9),
        (8, "x", "en", "c", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["q"] * len(CLASHING)) for r in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}
