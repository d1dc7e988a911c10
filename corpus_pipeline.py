"""The pipeline over ``documents``: quality rules, exact and near de-duplication, mixing, and byte-level BPE.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of documents, but
for the last, which returns ids and digests.  ``run`` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import exact, mixing, outliers, probminhash
from graphloom.llm.common import table, written
from graphloom.llm.queries import bpe_digests

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a number of its own for each row, in the order of ids.

    Where ids are unique and none is null they are the numbers.  Otherwise the rows are sorted by id, null ids coming
    last, and then by their other columns, numbered, and written, so that all readers see the same numbers.
    """
    docs = docs.select(COLUMNS)
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 or doc_id is null").isEmpty():
        return docs.withColumn("_row", F.col("doc_id").cast("long"))
    # The place breaks ties of rows that are equal in all columns, so that a range of the sort never has to hold them all.
    placed = docs.withColumn("_place", F.monotonically_increasing_id()).withColumn("_sha", F.sha2("text", 256))
    order = placed.orderBy(F.col("doc_id").asc_nulls_last(), "_sha", "lang", "source", "n_chars", "_place").select(COLUMNS)
    return written(order.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def _met(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with the narrow table of what was decided on their numbers.

    Both sides are dealt out by number whatever their size.  Left to itself Catalyst broadcasts a small table of decisions and
    shuffles the texts for a larger one, so that a run on a small input tells nothing of the disk that a larger one takes.
    """
    return docs.join(decided.hint("merge"), "_row", how).select(COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base rules or the outlier verdict reject.

    Null and empty texts have too few words and go.  Null and repeated ids, repeated rows and ties change nothing: every row
    is judged by its own text.  A very long text is judged whole.  An empty table stays empty.  Extra columns are left out.
    """
    judged = outliers.quality_rules(docs, carry=("text", "lang", "source", "n_chars"))
    return judged.where("kept").select(COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id: one row, even if rows repeat.

    Null texts equal empty ones.  A null id is smaller than any other.  Of one text's rows with one id, the one that is last
    by language, source and length stays.  Rows that share an id and not the text are documents of their own.  An empty
    table stays empty.  Extra columns are left out.
    """
    return exact.last_of_equal(docs.select(COLUMNS), ["doc_id", "lang", "source", "n_chars"])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest id: one row, even if rows repeat.

    Texts without words, null ones among them, are copies of each other.  A null id is larger than any other.  Of one class's
    rows with the smallest id, the first by a hash of the text, language, source and length stays.  An empty table stays
    empty.  Extra columns are left out.
    """
    docs = _numbered(docs)
    return _met(docs, probminhash.near_duplicates(docs, id_col="_row").where("kept").select("_row"), "left_semi")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it, twice at most.

    Null and empty texts have no words and are not taken.  Rows that repeat an id or everything are taken each for itself.
    Null sources are a source.  An empty table stays empty.  Extra columns are left out.
    """
    docs = _numbered(docs)
    copies = mixing.mix(docs, id_col="_row").where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), "copies")).alias("_copy"))
    return _met(docs, copies, "inner")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each row, and what they decode to, as digests: a row for each row, whatever its id.

    Null and empty texts have no id.  An empty table gives no row.  Extra columns are not read.
    """
    return bpe_digests(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("byte BPE", encoding_stage),
]

#: Probabilistic near-duplicate search and randomised rounding have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
