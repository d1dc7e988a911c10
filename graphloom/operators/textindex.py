"""A stored positional index of text columns.

Postings are rows (token, block, ids, places), sorted by token and written in files of token ranges, with a directory of the
range of each file; their ids are the rows' numbers in the block, which a row for each block turns into the ids themselves: a query opens the files of its tokens alone, and in them, by Parquet's statistics, their row groups.  A
block is a share of the rows by hash, so a token that is everywhere is many rows of bounded size, and terms are intersected
block by block without a row for each hit.  Places count tokens through all columns with a gap between two columns, so a phrase
is a token's places shifted onto the next one's.

Changes are segments of their own: rows that come, and ids that go from all earlier segments.  ``compact`` makes them one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import query_terms, searchable
from graphloom.sources.manifests import Manifests
from graphloom.storage import written

#: Characters of text in a block, on average, and in a file of postings.
BLOCK_CHARS = 8 << 20
FILE_CHARS = 32 << 20
#: Row groups are small, so that a token's own are a small part of a file.
ROW_GROUP = 2 << 20


def placed(columns: list[Column]) -> Column:
    """The tokens of the columns in order, between single spaces; two or more stand between two columns."""
    return F.concat(*[searchable(c) for c in columns])


def _postings_of(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Rows (id, block, text) of one block as its postings: a row for each token, its entries by number and place;
    numbers follow the ids, which stand in the row of the token ''."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    rows = rows.take(pc.sort_indices(rows, [("id", "ascending")]))
    ids, lists = rows.column("id").combine_chunks(), pc.split_pattern(rows.column("text").combine_chunks(), " ")
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(ids)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(coded.dictionary))))), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order], pa.int32())) for x in (row, place)]
    tokens = pa.RecordBatch.from_arrays([coded.dictionary, *lists, pa.nulls(len(coded.dictionary), pa.list_(ids.type))], ["token", "ids", "places", "rows"])
    tokens = tokens.filter(pc.not_equal(tokens.column(0), ""))
    whole = pa.RecordBatch.from_arrays([pa.array([""], coded.dictionary.type), pa.array([[]], pa.list_(pa.int32())), pa.array([[]], pa.list_(pa.int32())), pa.ListArray.from_arrays([0, len(ids)], ids)], tokens.schema.names)
    out = pa.Table.from_batches([tokens, whole]).combine_chunks().to_batches()[0]
    block = pa.array(np.full(len(out), rows.column("block")[0].as_py()), pa.int32())
    return pa.RecordBatch.from_arrays([out.column(0), block, *out.columns[1:]], ["token", "block", "ids", "places", "rows"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows (id, block, text) that come block by block; one block is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column(1).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else []
        for start, end in zip(cuts, cuts[1:]):
            if held and held[0].column(1)[0].as_py() != block[start]:
                yield _postings_of(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield _postings_of(held)


class TextIndex:
    """The index in a folder, at its current state, at the one of a number, or at a ``state`` that the caller keeps.

    ``id`` columns may have any type that can be compared; texts may be null.  An id stands for one row.  Changes give the
    index after them; its state is committed to the folder, unless the caller keeps states itself.
    """

    def __init__(self, spark: SparkSession, path: str, version: int | None = None, state: dict | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, self.path)
        self.kept = state is not None
        self.version = 0 if self.kept else self.manifests.version() if version is None else version
        state = state if self.kept else self.manifests.manifest(self.version) if self.version else {}
        self.segments: list[str] = state.get("segments", [])
        self.columns: list[str] = state.get("columns", [])
        #: What the last search opened, for tests and curious users.
        self.opened: list[str] = []

    @classmethod
    def build(cls, nodes: DataFrame, path: str, columns: tuple[str, ...], kept: bool = False) -> TextIndex:
        """A state that holds ``nodes`` alone: (id, ``columns``).  Columns that the table lacks are passed over.  ``kept``: the
        caller keeps states."""
        index = cls(nodes.sparkSession, path, state={} if kept else None)
        index.columns = [c for c in columns if c in nodes.columns]
        return index._committed([index._segment(nodes, None)])

    def _committed(self, segments: list[str]) -> TextIndex:
        state = {"segments": segments, "columns": self.columns}
        if self.kept:
            return TextIndex(self.spark, self.path, state=state)
        self.manifests.commit(state, self.version)
        return TextIndex(self.spark, self.path, self.version + 1)

    def state(self) -> dict:
        return {"segments": self.segments, "columns": self.columns}

    def forget(self, needed: set[str]) -> None:
        """Remove the segments that no state needs."""
        for name in self.manifests.names():
            if name.startswith("segment-") and name not in needed:
                self.manifests.delete(name)

    def _segment(self, nodes: DataFrame | None, gone: DataFrame | None) -> str:
        """Write a segment: the postings of some nodes, and the ids that it hides in earlier segments."""
        name = f"segment-{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        if gone is not None:
            gone.select("id").distinct().write.parquet(f"{at}/gone")
        if nodes is not None:
            chars = nodes.agg(F.sum(reduce(Column.__add__, [F.coalesce(F.length(c), F.lit(0)) for c in self.columns]))).first()[0] or 0
            blocks = 1 + chars // BLOCK_CHARS
            texts = nodes.select("id", F.pmod(F.xxhash64(F.col("id")), F.lit(blocks)).cast("int").alias("block"), *self.columns)
            # Texts are shuffled, not their tokens: a task has whole blocks and groups each by itself.
            dealt = texts.repartition(blocks, "block").sortWithinPartitions("block").select("id", "block", placed([F.col(c) for c in self.columns]).alias("text"))
            kind = nodes.schema["id"].dataType.simpleString()
            rows = written(dealt.mapInArrow(_gathered, f"token string, block int, ids array<int>, places array<int>, rows array<{kind}>"), "postings")
            rows.where("token = ''").select("block", "rows").write.parquet(f"{at}/rows")
            rows = rows.where("token <> ''").drop("rows")
            self._store(rows.repartitionByRange(1 + chars // FILE_CHARS, "token", "block"), at)
        return name

    def _write(self, tokens: DataFrame, at: str, files: int) -> None:
        """(number, block, place, token) as postings.  Ranges are by token and block, which is what the rows are grouped by too,
        so occurrences are shuffled once."""
        ranged = tokens.repartitionByRange(files, "token", "block")
        entries = F.array_sort(F.collect_list(F.struct("number", "place")))
        self._store(ranged.groupBy("token", "block").agg(entries.alias("_e")).select("token", "block", F.col("_e.number").alias("ids"), F.col("_e.place").alias("places")), at)

    def _store(self, rows: DataFrame, at: str) -> None:
        """Postings that lie in ranges of token and block, and the directory of their files."""
        rows.sortWithinPartitions("token", "block").write.option("parquet.block.size", ROW_GROUP).parquet(f"{at}/postings")
        stored = self.spark.read.parquet(f"{at}/postings")
        ranges = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("token").alias("first"), F.max("token").alias("last"), F.count(F.lit(1)).alias("rows"))
        ranges.write.parquet(f"{at}/directory")

    # --- changes

    def add(self, nodes: DataFrame) -> TextIndex:
        """With ``nodes`` in place of earlier rows of their ids."""
        return self._committed([*self.segments, self._segment(nodes, nodes if self.segments else None)])

    def remove(self, ids: DataFrame) -> TextIndex:
        """Without the rows of ``ids`` (id)."""
        return self._committed([*self.segments, self._segment(None, ids)])

    def change(self, nodes: DataFrame, gone: DataFrame) -> TextIndex:
        """Both at once: ``nodes`` come or replace, and ``gone`` (id) go."""
        return self._committed([*self.segments, self._segment(nodes, gone.select("id").unionByName(nodes.select("id")))])

    def compact(self) -> TextIndex:
        """All segments as one, without what is hidden; tokens are taken from the postings, texts are not read."""
        some = [(i, s) for i, s in enumerate(self.segments) if self._has(s, "postings")]
        if not some:
            return self._committed([])
        name = f"segment-{uuid.uuid4().hex}"
        # Segments may have been cut into different numbers of blocks; rows of a block and token meet again by the largest.
        rows = reduce(DataFrame.unionByName, [self._living(self._rows(s).select("block", F.posexplode("rows").alias("old", "id")), i).withColumn("segment", F.lit(i)) for i, s in some])
        place = F.row_number().over(Window.partitionBy("block").orderBy("id", "segment", "old"))
        rows = written(rows.withColumn("number", place - 1), "rows")
        rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("number", "id"))).alias("_r")).select("block", F.col("_r.id").alias("rows")).write.parquet(f"{self.path}/{name}/rows")
        parts = [self._postings(s).select("token", "block", F.inline(F.arrays_zip("ids", "places"))).withColumnsRenamed({"ids": "old", "places": "place"}).withColumn("segment", F.lit(i)) for i, s in some]
        whole = reduce(DataFrame.unionByName, parts).join(rows.drop("id"), ["segment", "block", "old"]).select("number", "block", "place", "token")
        files = sum(self.spark.read.parquet(f"{self.path}/{s}/directory").count() for _, s in some)
        self._write(whole, f"{self.path}/{name}", files)
        return self._committed([name])

    # --- reading

    def _has(self, segment: str, part: str) -> bool:
        return self.manifests.exists(f"{segment}/{part}")

    def _postings(self, segment: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{segment}/postings")

    def _rows(self, segment: str) -> DataFrame:
        """(block, rows): the ids of each block, by number."""
        return self.spark.read.parquet(f"{self.path}/{segment}/rows")

    def _living(self, rows: DataFrame, number: int) -> DataFrame:
        """Rows of a segment whose ids no later one hides."""
        gone = [self.spark.read.parquet(f"{self.path}/{s}/gone") for s in self.segments[number + 1 :] if self._has(s, "gone")]
        return rows.join(reduce(DataFrame.unionByName, gone), "id", "left_anti") if gone else rows

    def _of_tokens(self, segment: str, exact: list[str], prefix: str) -> DataFrame | None:
        """The segment's postings of some tokens and of those with a prefix; only files that may hold one are opened."""
        some = (F.col("last") >= prefix) & ((F.col("first") < prefix) | F.col("first").startswith(prefix))
        for t in exact:
            some = some | ((F.col("first") <= t) & (F.col("last") >= t))
        files = [r["file"] for r in self.spark.read.parquet(f"{self.path}/{segment}/directory").where(some).select("file").collect()]
        self.opened += files
        if not files:
            return None
        hit = F.col("token").startswith(prefix)
        return self.spark.read.parquet(*files).where(hit | F.col("token").isin(*exact) if exact else hit)

    def search(self, query: str) -> DataFrame:
        """(id) of the rows in whose columns every term occurs, the last as a prefix, a term of several tokens as a phrase."""
        terms = [t.split() for t in query_terms(query)]
        self.opened, found = [], []
        for number, segment in enumerate(self.segments if terms else []):
            if self._has(segment, "postings"):
                postings = self._of_tokens(segment, sorted({t for term in terms for t in term} - {terms[-1][-1]} | {t for term in terms[:-1] for t in term}), terms[-1][-1])
                if postings is not None:
                    found.append(self._living(_matching(postings, self._rows(segment), terms), number))
        if not found:
            kind = self._rows(self.segments[0]).schema["rows"].dataType.elementType.simpleString() if self.segments and self._has(self.segments[0], "postings") else "string"
            return self.spark.createDataFrame([], f"id {kind}")
        return reduce(DataFrame.unionByName, found)


def _starts(shift: int) -> Column:
    """Where phrases would start of which these occurrences are the token of a number: number and place as one, the place moved
    so far that it stays positive."""
    return F.zip_with("ids", "places", lambda i, p: F.shiftleft(i.cast("long"), 32) + p - shift)


def _matching(postings: DataFrame, rows: DataFrame, terms: list[list[str]]) -> DataFrame:
    """(id) by intersecting arrays in each block: of numbers for a term of one token, of numbers with places for a phrase."""
    gathered, hits = [], []
    for i, term in enumerate(terms):
        for j, token in enumerate(term):
            last = i == len(terms) - 1 and j == len(term) - 1
            is_it = F.col("token").startswith(token) if last else F.col("token") == token
            # The hits of a block are bounded by its size; a prefix may gather several tokens of it.
            value = F.array_distinct("ids") if len(term) == 1 else _starts(j - len(term))
            gathered.append(F.array_distinct(F.flatten(F.collect_list(F.when(is_it, value)))).alias(f"_{i}_{j}"))
        hit = reduce(F.array_intersect, [F.col(f"_{i}_{j}") for j in range(len(term))])
        hits.append(hit if len(term) == 1 else F.array_distinct(F.transform(hit, lambda s: F.shiftright(s, 32).cast("int"))))
    found = postings.groupBy("block").agg(*gathered).select("block", reduce(F.array_intersect, hits).alias("_hit")).where("size(_hit) > 0")
    return found.join(rows, "block").select(F.explode(F.transform("_hit", lambda n: F.get("rows", n))).alias("id"))
