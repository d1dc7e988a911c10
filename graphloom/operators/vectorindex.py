"""Exact nearest vectors for a table of queries, over vectors that are stored by cell.

Centroids are fitted on a bounded sample; every vector goes to its nearest one, with its distance, and a cell knows its radius
and size.  A query first looks into the cells that are nearest and hold k vectors; the k-th distance found there rules out, by
the triangle inequality, cells whose ball is further away and vectors whose distance to their centroid differs too much from
the query's.  What is left is compared, so the result is that of comparing everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.sources.manifests import Manifests
from graphloom.storage import written

#: Bounds of what the driver holds: rows of the sample, and cells.
SAMPLE_ROWS = 20_000
MOST_CELLS = 4096
ROW_GROUP = 4 << 20
#: Vectors of a cell, and queries, that a task holds at once, and pairs that it compares at once.
MOST_HELD, MOST_ASKED, TILE = 8192, 32768, 1 << 20
#: Distances in both precisions differ by less, in parts of the distances at hand.
SLACK = 1e-6


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of every row of a to every row of b; squares are subtracted, so a little off."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from distinct rows of the sample; a cell that loses all its rows keeps its centroid."""
    rows = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centroids = rows[rng.choice(len(rows), min(cells, len(rows)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([_distances(part, centroids).argmin(1) for part in np.array_split(sample, max(1, len(sample) // 1000))])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(centroids))
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def near_pairs(a: np.ndarray, b: np.ndarray, to_cell: np.ndarray, to_centroid: np.ndarray, reach: np.ndarray, k: int, tie: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i of a and j of b that may be among the k nearest or in reach, and their distances: squares added in order, as
    SQL adds them.  A product of matrices, a little off, tells which pairs are left out for certain."""
    found = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    a2, b2 = (a * a).sum(1), (b * b).sum(1)
    bound = reach * (1 + SLACK) + SLACK
    step = max(1, TILE // len(b))
    for start in range(0, len(a), step):
        part = slice(start, start + step)
        off = 1e-9 * (a2[part][:, None] + b2[None] + 1)
        square = a2[part][:, None] + b2[None] - 2 * a[part] @ b.T
        least = square - off  # no more than the true square
        most = bound[part]
        if len(b) > k:
            kth = np.partition(square + off, k - 1, axis=1)[:, k - 1]
            most = np.minimum(most, np.sqrt(np.maximum(kth, 0)) * (1 + SLACK) + tie)
        # Turned around, so that what is no number is kept.
        keep = ~(least > (most * most)[:, None]) & ~(np.abs(to_cell[part][:, None] - to_centroid[None]) > (bound[part] + SLACK * to_cell[part])[:, None])
        i, j = np.nonzero(keep)
        total = np.zeros(len(i))
        for x in range(a.shape[1]):
            gap = a[start + i, x] - b[j, x]
            total += gap * gap
        for out, x in zip(found, (start + i, j, np.sqrt(total)), strict=True):
            out.append(x)
    return tuple(np.concatenate(x) for x in found)


class VectorIndex:
    """Vectors of one length in a folder: (id, embedding).  Null embeddings are not kept; ids may have any type."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        cells = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # at most MOST_CELLS rows
        self.centroids = np.array([r["centroid"] for r in cells], dtype=np.float64)
        self.radii, self.sizes = np.array([r["radius"] for r in cells]), np.array([r["n"] for r in cells], np.int64)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
        """``cells`` is the square root of the number of rows if it isn't given.  The sample are the rows whose ids have the
        smallest hashes: a top-k."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        some = vectors.where("embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
        sample = some.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
        centroids = np.zeros((0, 0))
        if sample:
            n = cells or int(some.count() ** 0.5)
            centroids = fit_centroids(np.array([r["embedding"] for r in sample], dtype=np.float64), max(1, min(n, MOST_CELLS)))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    near = _distances(_matrix(batch.column(1)), centroids).argmin(1)
                    exact = np.linalg.norm(_matrix(batch.column(1)) - centroids[near], axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(exact)], ["id", "embedding", "cell", "to_centroid"])

        dealt = some.mapInArrow(deal, f"id {some.schema['id'].dataType.simpleString()}, embedding array<double>, cell int, to_centroid double")
        # A cell of any size is cut into ranges of its ids.
        dealt = written(dealt, "dealt").repartitionByRange("cell", "id").sortWithinPartitions("cell", "to_centroid")
        dealt.write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/vectors")
        stored = spark.read.parquet(f"{path}/vectors")
        found = {r["cell"]: r for r in stored.groupBy("cell").agg(F.max("to_centroid").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
        rows = [(i, c.tolist(), float(found[i]["radius"]) if i in found else 0.0, int(found[i]["n"]) if i in found else 0) for i, c in enumerate(centroids)]
        spark.createDataFrame(rows, "cell int, centroid array<double>, radius double, n long").coalesce(1).write.parquet(f"{path}/cells")
        return cls(spark, path)

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        return Manifests(spark, path).exists("cells/_SUCCESS")

    def _probes(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, embedding, cell, to_cell, reach): for each query the nearest cells that hold k vectors, or, where ``reach``
        is given, the other cells whose ball is not further away; ``reach`` is handed on."""
        centroids, radii, sizes = self.centroids, self.radii, self.sizes
        bounded = "reach" in queries.columns

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, len(batch), 256):
                    part = batch.slice(start, 256)
                    at = _matrix(part.column(1))
                    to = np.stack([np.linalg.norm(at - c, axis=1) for c in centroids], 1)
                    order = np.argsort(to, axis=1, kind="stable")
                    held = np.cumsum(sizes[order], axis=1)
                    first = np.zeros(to.shape, bool)
                    np.put_along_axis(first, order, np.concatenate([np.ones((len(at), 1), bool), held[:, :-1] < k], 1), axis=1)
                    some = first & (sizes > 0)
                    reach = np.full(len(at), np.inf)
                    if bounded:
                        reach = np.array([np.inf if x is None else x for x in part.column(2).to_pylist()])
                        some = ~first & (sizes > 0) & (to - radii <= (reach * (1 + SLACK) + SLACK)[:, None] + SLACK * to)
                    q, c = np.nonzero(some)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(q)), part.column(1).take(pa.array(q)), pa.array(c, pa.int32()), pa.array(to[q, c]), pa.array(reach[q])], ["query", "embedding", "cell", "to_cell", "reach"])

        kind = queries.schema["query"].dataType.simpleString()
        return queries.mapInArrow(probe, f"query {kind}, embedding array<double>, cell int, to_cell double, reach double")

    def _pairs(self, probes: DataFrame) -> DataFrame:
        """The probes with the vectors of their cells that may be near enough."""
        near = F.abs(F.col("to_cell") - F.col("to_centroid")) <= F.col("reach") * (1 + SLACK) + SLACK + SLACK * F.col("to_cell")
        return probes.join(self.spark.read.parquet(f"{self.path}/vectors").drop("embedding"), "cell").where(near)

    def _met(self, probes: DataFrame, k: int, digits: int, asked: int) -> DataFrame:
        """(query, id, distance) of pairs of a probe and a vector of its cell, the k nearest of each part of a cell among them,
        unless they are out of reach.

        Cells are cut into parts and queries into slots, both of bounded size; a task compares a part with a slot by matrices.
        """
        cells = self.spark.read.parquet(f"{self.path}/cells").select("cell", (1 + F.col("n") / MOST_HELD).cast("int").alias("parts"))
        slots = 1 + asked // MOST_ASKED
        parts = F.broadcast(cells)  # at most MOST_CELLS rows
        held = self.spark.read.parquet(f"{self.path}/vectors").join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
        held = held.select("id", "embedding", "to_centroid", "cell", "part", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
        sent = probes.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        sent = sent.select("query", "embedding", "to_cell", "reach", "cell", "part", F.pmod(F.xxhash64("query"), F.lit(slots)).cast("int").alias("slot"))

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            numbers = lambda t, c: t.column(c).to_numpy().astype(np.float64)
            i, j, distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            if len(left) and len(right):
                i, j, distance = near_pairs(_matrix(left.column("embedding")), _matrix(right.column("embedding")), numbers(left, "to_cell"), numbers(right, "to_centroid"), numbers(left, "reach"), k, 2 * 10.0**-digits)
            return pa.table([left.column("query").take(pa.array(i)), right.column("id").take(pa.array(j)), pa.array(distance)], ["query", "id", "distance"])

        key, kinds = ["cell", "part", "slot"], [df.schema[c].dataType.simpleString() for df, c in ((sent, "query"), (held, "id"))]
        met = sent.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(compare, f"query {kinds[0]}, id {kinds[1]}, distance double")
        return met.select("query", "id", F.round("distance", digits).alias("distance"))

    @staticmethod
    def _best(found: DataFrame, k: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))  # each task keeps k rows a query
        return found.withColumn("place", place).where(F.col("place") <= k)

    def search(self, queries: DataFrame, k: int = 20, digits: int = 6) -> DataFrame:
        """(query, place, id, distance): for each row of ``queries`` (query, embedding) the k nearest vectors, by distance
        rounded to ``digits`` places and id.  A query is known by its value of ``query``, which must not repeat; null
        embeddings find nothing; fewer than k vectors are all found."""
        asked = queries.where("embedding is not null").select("query", F.col("embedding").cast("array<double>").alias("embedding"))
        if not len(self.centroids):
            kind = {f.name: f.dataType.simpleString() for f in self.spark.read.parquet(f"{self.path}/vectors").schema}["id"]
            return self.spark.createDataFrame([], f"query {asked.schema['query'].dataType.simpleString()}, place int, id {kind}, distance double")
        n = asked.count()
        first = written(self._best(self._met(self._probes(asked, k), k, digits, n), k), "near")
        # Rounded up: the distance of the k-th, or no bound where fewer were found.
        reach = first.where(F.col("place") == k).select("query", (F.col("distance") + 10.0**-digits).alias("reach"))
        rest = self._met(self._probes(asked.join(reach, "query", "left").select("query", "embedding", "reach"), k), k, digits, n)
        return self._best(first.drop("place").unionByName(rest), k).select("query", "place", "id", "distance")

    def compared(self, queries: DataFrame, k: int = 20, digits: int = 6) -> int:
        """How many pairs of a query and a vector are compared in all: for measuring how much the cells rule out."""
        asked = queries.where("embedding is not null").select("query", F.col("embedding").cast("array<double>").alias("embedding"))
        probes = self._probes(asked, k)
        reach = self._best(self._met(probes, k, digits, asked.count()), k).where(F.col("place") == k).select("query", (F.col("distance") + 10.0**-digits).alias("reach"))
        return self._pairs(probes).count() + self._pairs(self._probes(asked.join(reach, "query", "left").select("query", "embedding", "reach"), k)).count()
