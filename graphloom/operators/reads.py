"""Point and edge reads, counts, and integrity of a graph's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.schemas import CALLABLE, USE_KINDS


def one_of(df: DataFrame, column: str, values) -> DataFrame:
    """Rows whose column is among the values; no values, no filter."""
    return df.where(F.col(column).isin(*values)) if values else df


def node_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def nodes_by_kind(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("kind") == kind)


def nodes_by_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("file_path") == path)


def edges_out(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where(F.col("source") == node_id)


def edges_in(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where(F.col("target") == node_id)


def edges_touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end among ``ids`` (id), each row once."""
    a = ids.select(F.col("id").alias("_a")).distinct()
    b = ids.select(F.col("id").alias("_b")).distinct()
    marked = edges.join(a, F.col("source") == F.col("_a"), "left").join(b, F.col("target") == F.col("_b"), "left")
    return marked.where("_a is not null or _b is not null").drop("_a", "_b")


def callers(nodes: DataFrame, edges: DataFrame, node_id: str, limit: int | None = 30, distinct: bool = False, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """Nodes that call a node, once for each call unless ``distinct``; the first ``limit`` in the given order."""
    return _call_side(nodes, edges, node_id, "target", "source", limit, distinct, order)


def callees(nodes: DataFrame, edges: DataFrame, node_id: str, limit: int | None = 30, distinct: bool = False, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """Nodes that a node calls, likewise."""
    return _call_side(nodes, edges, node_id, "source", "target", limit, distinct, order)


def _call_side(nodes, edges, node_id, here, there, limit, distinct, order):
    ends = edges.where((F.col(here) == node_id) & (F.col("kind") == "calls")).select(F.col(there).alias("_end"))
    out = nodes.join(ends.distinct() if distinct else ends, F.col("id") == F.col("_end")).drop("_end")
    return out.orderBy(*order).limit(limit) if limit else out


def import_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_file, target_file): pairs of different files of which one imports from the other."""
    at = lambda end, name: nodes.select(F.col("id").alias(end), F.col("file_path").alias(name))
    imports = edges.where("kind = 'imports'").select(F.col("source").alias("_s"), F.col("target").alias("_t")).distinct()
    joined = imports.join(at("_s", "source_file"), "_s").join(at("_t", "target_file"), "_t")
    return joined.where("source_file <> target_file").select("source_file", "target_file").distinct()


def dead_nodes(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = CALLABLE, uses: tuple[str, ...] = USE_KINDS, limit: int | None = 50, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """Nodes of the kinds that are not exported and that no edge of the uses points to."""
    used = edges.where(F.col("kind").isin(*uses)).select(F.col("target").alias("_t"))
    some = one_of(nodes, "kind", kinds)
    if "is_exported" in nodes.columns:
        some = some.where(~F.col("is_exported"))
    out = some.join(used, F.col("id") == F.col("_t"), "left_anti")
    return out.orderBy(*order).limit(limit) if limit else out


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, kind, line), but all edges without a line: nulls are distinct."""
    lined = edges.where("line is not null").dropDuplicates(["source", "target", "kind", "line"])
    return lined.unionByName(edges.where("line is null"))


def insert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` added where it breaks no uniqueness; edges that were there stay as they are."""
    keys = ["source", "target", "kind", "line"]
    fresh = dedupe_edges(new).join(edges.where("line is not null").select(keys), keys, "left_anti")
    return edges.unionByName(fresh, allowMissingColumns=True)


def prune_dangling(edges: DataFrame, nodes: DataFrame, targets: DataFrame | None = None, ends: tuple[str, str] = ("source", "target")) -> DataFrame:
    """Edges both of whose ends exist: among ``nodes`` (id), or the second among ``targets`` where these are of another table."""
    for end, some in zip(ends, (nodes, nodes if targets is None else targets)):
        edges = edges.join(some.select("id"), F.col(end) == F.col("id"), "left_semi")
    return edges


def counts(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files, nodes, edges."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(files, "files").crossJoin(one(nodes, "nodes")).crossJoin(one(edges, "edges"))  # one row each


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def languages_by_size(nodes: DataFrame) -> DataFrame:
    return count_by(nodes, "language").orderBy(F.desc("n"), "language")


def nodes_per_file(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("file_path").agg(F.count(F.lit(1)).alias("node_count"))


def unique_names(nodes: DataFrame) -> DataFrame:
    """(name, id) of names with one definition."""
    return nodes.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("id")).where("_n = 1").select("name", "id")


def first_match(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rank = 1").drop("_rank")


def innermost(spans: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """Each point (key, at, point_id) with the narrowest span (key, start, end, span_id) that holds it.

    An interval join by dyadic levels: a span of width w stands at the level of the smallest power of two above w, where it
    touches two buckets at most, so it is one row or two however wide it is.  A point looks into one bucket of each level at
    which its key has spans: no more levels than a number has bits.  Spans that end before they start hold nothing.
    """
    wide = F.col("end") - F.col("start")
    # The number of binary digits of the width, exactly; 2 ** level is then the first power above it.
    level = F.when(wide > 0, F.length(F.bin(wide))).otherwise(0).cast("int")
    leveled = spans.where("start <= end").withColumn("_level", level)
    levels = leveled.groupBy(key).agg(F.collect_set("_level").alias("_levels"))
    listed = leveled.withColumn("_bucket", F.explode(F.array_distinct(F.array(_bucket("start"), _bucket("end")))))
    probes = points.join(levels, key).withColumn("_level", F.explode("_levels")).withColumn("_bucket", _bucket("at"))
    met = probes.join(listed, [key, "_level", "_bucket"]).where("start <= at and at <= end")
    best = met.groupBy("point_id").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("w"), "span_id")).alias("_best"))
    return best.select("point_id", F.col("_best.span_id").alias("span_id"))


def _bucket(column: str) -> Column:
    """The bucket of a whole number at level ``_level``: its bits above the level's, rounded down for negative numbers too."""
    return F.expr(f"shiftright(cast({column} as bigint), _level)")
