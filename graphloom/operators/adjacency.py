"""Edges that are written once, sorted both ways, so that a step of a search reads the edges of its frontier.

``out`` is in ranges of sources, ``in`` in ranges of targets; row groups are small, and a filter on either end skips the others
by Parquet's statistics.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.manifests import Manifests

ROW_GROUP = 1 << 20
ENDS = {"out": ("source", "target"), "in": ("target", "source")}
WAYS = {"outbound": ("out",), "inbound": ("in",), "both": ("out", "in")}


class Adjacency:
    """(source, target, kind, line) in a folder, by either end.  A small frontier is told to the scan as a filter, a larger one
    is joined."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, edges: DataFrame, path: str) -> Adjacency:
        """Vertices of any degree are cut into ranges of their edges' other ends."""
        some = edges.select("source", "target", "kind", F.col("line").cast("int").alias("line"))
        for side, (here, there) in ENDS.items():
            some.repartitionByRange(here, there).sortWithinPartitions(here, there).write.option("parquet.block.size", ROW_GROUP).parquet(f"{path.rstrip('/')}/{side}")
        return cls(edges.sparkSession, path)

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        return Manifests(spark, path).exists("in/_SUCCESS")

    def edges(self, side: str = "out") -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{side}")

    def of(self, node_id: str, direction: str) -> DataFrame:
        """The edges out of or into a vertex."""
        (side,) = WAYS[direction]
        return self.edges(side).where(F.col(ENDS[side][0]) == node_id)

    def walk(self, direction: str, kinds: tuple[str, ...] | None, few: list[str] | None = None) -> DataFrame:
        """(_from, _to, source, target, kind, line): edges as they may be walked, with ``few`` from these vertices alone."""
        out = None
        for side in WAYS[direction]:
            here, there = ENDS[side]
            some = self.edges(side)
            if few is not None:
                some = some.where(F.col(here).isin(*few) if few else F.lit(False))
            if kinds:
                some = some.where(F.col("kind").isin(*kinds))
            one = some.select(F.col(here).alias("_from"), F.col(there).alias("_to"), "source", "target", "kind", "line")
            out = one if out is None else out.unionByName(one)
        return out


class KeyedEdges(Adjacency):
    """The same without a copy: ``read(source, target, kinds)`` gives the edges of some kinds, or of all, that leave or enter
    some vertices; where its tables can be filtered by key a step is a scan of these, and nothing is sorted or shuffled."""

    def __init__(self, spark: SparkSession, read: Callable[[list[str] | None, list[str] | None, tuple[str, ...]], DataFrame]):
        self.spark, self.read = spark, read

    def edges(self, side: str = "out", kinds: tuple[str, ...] = ()) -> DataFrame:
        return self.read(None, None, kinds)

    def of(self, node_id: str, direction: str) -> DataFrame:
        (side,) = WAYS[direction]
        return self._at(side, [node_id], ())

    def _at(self, side: str, few: list[str] | None, kinds: tuple[str, ...]) -> DataFrame:
        return self.read(few if side == "out" else None, few if side == "in" else None, kinds)

    def walk(self, direction: str, kinds: tuple[str, ...] | None, few: list[str] | None = None) -> DataFrame:
        sides = [(ENDS[side], self._at(side, few, kinds or ())) for side in WAYS[direction]]
        parts = [some.select(F.col(here).alias("_from"), F.col(there).alias("_to"), "source", "target", "kind", "line") for (here, there), some in sides]
        return reduce(DataFrame.unionByName, parts)


def smallest_edge(parent: Column) -> Column:
    """Of the edges between two vertices the smallest, with the vertex that it comes from."""
    return F.min(F.struct(parent.alias("parent"), "kind", "line", "source", "target"))
