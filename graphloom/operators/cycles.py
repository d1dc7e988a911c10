"""Simple cycles of a directed graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import strong_components, within_components
from graphloom.storage import kept


def canonical_rotation(path: Column) -> Column:
    """The rotation of an array that is smallest as text."""
    n = F.size(path)
    turns = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.slice(path, i + 1, n - i), F.slice(path, F.lit(1), i)))
    return F.array_min(turns)


def simple_cycles(pairs: DataFrame, most: int = 50) -> DataFrame:
    """(path, length): each simple cycle of (source, target) once, from its smallest vertex, at most ``most`` vertices long.

    Paths grow from a vertex over larger ones of its strongly connected component only, so a cycle is met from its smallest
    vertex alone and no path leaves for a place that it can't return from; self-loops are no cycles.  The number of cycles
    may be exponential in dense graphs: ``cyclic_groups`` tells their components alone.  ``most`` bounds the rounds.
    """
    pairs, rows = kept(pairs.where("source <> target").select("source", "target").distinct(), "pairs", True)
    few = rows is not None
    pairs = kept(within_components(pairs, strong_components(pairs)).select("source", "target"), "pairs", few)[0]
    paths = pairs.where("source < target").select(F.array("source", "target").alias("path"))
    found, length = None, 2
    while length <= most:
        paths, rows = kept(paths, f"paths{length}", few)
        few = rows is not None
        if rows is not None and not rows:
            break
        tail = paths.select("path", F.element_at("path", -1).alias("source"), F.element_at("path", 1).alias("_first"))
        grown = tail.join(pairs, "source")
        closed = grown.where("target = _first").select("path", F.size("path").alias("length"))
        found = closed if found is None else found.unionByName(closed)
        paths = grown.where((F.col("target") > F.col("_first")) & ~F.array_contains("path", F.col("target"))).select(F.concat("path", F.array("target")).alias("path"))
        length += 1
    if found is None:
        return pairs.sparkSession.createDataFrame([], "path array<string>, length int")
    return found


def cyclic_groups(pairs: DataFrame) -> DataFrame:
    """(component, id, n_ids, n_edges): the vertices that lie on cycles, by strongly connected component: what there is to
    know where cycles are too many to list."""
    pairs, rows = kept(pairs.where("source <> target").select("source", "target").distinct(), "pairs", True)
    found = kept(strong_components(pairs), "strong", rows is not None)[0]
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n_ids"))
    inner = within_components(pairs, found).groupBy("component").agg(F.count(F.lit(1)).alias("n_edges"))
    return found.join(sizes, "component").join(inner, "component").select("component", "id", "n_ids", "n_edges")


def circular_dependencies(nodes: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """Cycles of files that import from each other."""
    from graphloom.operators.reads import import_graph

    graph = import_graph(nodes, edges).select(F.col("source_file").alias("source"), F.col("target_file").alias("target"))
    return simple_cycles(graph, most)
