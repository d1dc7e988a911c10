"""Breadth-first operators: one frontier loop, over many seeds at once.

Each round joins the frontier with the edges, keeps for each new vertex the smallest discovering edge, and removes what was
seen; the new level is written to the shared folder, so plans stay short and lost executors cost one level.  The driver
learns a level's rows only where they are few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.adjacency import Adjacency, smallest_edge
from graphloom.operators.components import components
from graphloom.operators.reads import edges_touching
from graphloom.schemas import CONTEXT_KINDS, CONTEXT_SKIP, IMPACT_KINDS, INHERIT_KINDS
from graphloom.storage import FEW, kept

_LEVEL = "seed string, id string, depth int, parent string, source string, target string, kind string, line int"


def seeds_of(spark: SparkSession, ids: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, i) for i in ids], "seed string, id string")


def directed(edges: DataFrame, direction: str, kinds: tuple[str, ...] | None) -> DataFrame:
    """(_from, _to) and the edge, for each way in which an edge may be walked."""
    some = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    whole = ["source", "target", "kind", F.col("line").cast("int").alias("line")]
    out = some.select(F.col("source").alias("_from"), F.col("target").alias("_to"), *whole)
    back = some.select(F.col("target").alias("_from"), F.col("source").alias("_to"), *whole)
    return {"outbound": out, "inbound": back, "both": out.unionByName(back)}[direction]


def _walk(edges: DataFrame | Adjacency, direction: str, kinds: tuple[str, ...] | None, rows: list | None) -> DataFrame:
    if isinstance(edges, Adjacency):
        return edges.walk(direction, kinds, None if rows is None else sorted({r["id"] for r in rows}))
    return directed(edges, direction, kinds)


def levels(edges: DataFrame | Adjacency, seeds: DataFrame, max_depth: int | None = None, direction: str = "outbound", kinds: tuple[str, ...] | None = None, nodes: DataFrame | None = None, max_nodes: int = 0) -> list[DataFrame]:
    """(seed, id, depth, parent, source, target, kind, line): what each seed reaches, a table for each depth from 0 on.

    The parent is the smallest id of the level before, and the edge the smallest between the two.  With ``nodes``, vertices
    without a row there are neither kept nor passed.  ``max_nodes`` bounds what a seed reaches, itself included: a level
    that would exceed it is cut in order of id and is the last.  The last level that ``max_depth`` allows is not kept: no
    round needs it again.  Of an Adjacency each round reads the edges of the level before.
    """
    none = F.lit(None).cast("string")
    visited = seeds.select("seed", "id", F.lit(0).alias("depth"), none.alias("parent"), none.alias("source"), none.alias("target"), none.alias("kind"), F.lit(None).cast("int").alias("line"))
    rows = visited.limit(FEW + 1).collect()
    rows = rows if len(rows) <= FEW else None
    out, depth = [visited], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        met = out[-1].select("seed", F.col("id").alias("_from")).join(_walk(edges, direction, kinds, rows), "_from")
        found = met.groupBy("seed", F.col("_to").alias("id")).agg(smallest_edge(F.col("_from")).alias("e"))
        fresh = found.join(visited.select("seed", "id"), ["seed", "id"], "left_anti")
        if nodes is not None:
            fresh = fresh.join(nodes.select("id"), "id", "left_semi")
        level = fresh.select("seed", "id", F.lit(depth).alias("depth"), "e.parent", "e.source", "e.target", "e.kind", "e.line")
        if max_nodes:
            room = visited.groupBy("seed").agg((max_nodes - F.count(F.lit(1))).alias("_room"))
            place = F.expr("row_number() over (partition by seed order by id)")
            level = level.join(room, "seed").withColumn("_place", place).where("_place <= _room").drop("_room", "_place")
        if depth == max_depth:
            return [*out, level]
        level, rows = kept(level, rows is not None, f"level{depth}")
        if rows is not None and not rows:
            break
        out.append(level)
        visited = visited.unionByName(level)
    return out


def search(edges: DataFrame | Adjacency, seeds: DataFrame, max_depth: int | None = None, direction: str = "outbound", kinds: tuple[str, ...] | None = None, nodes: DataFrame | None = None, max_nodes: int = 0) -> DataFrame:
    """All levels as one table."""
    return reduce(DataFrame.unionByName, levels(edges, seeds, max_depth, direction, kinds, nodes, max_nodes))


def impact_radius(nodes: DataFrame, edges: DataFrame | Adjacency, node_id: str, depth: int = 2, kinds: tuple[str, ...] = IMPACT_KINDS) -> DataFrame:
    """Nodes that depend on a node over at most ``depth`` edges, without itself."""
    reached = search(edges, seeds_of(nodes.sparkSession, [node_id]), depth, "inbound", kinds).where("depth > 0")
    # A few ids are a literal, so that the nodes are filtered where they are read.
    return nodes.join(kept(reached.select("id"), True, "reached")[0], "id", "left_semi")


def subgraph(nodes: DataFrame, edges: DataFrame | Adjacency, node_id: str, max_depth: int = 2, max_nodes: int = 50, kinds: tuple[str, ...] | None = None, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, discovery edges) around a node, itself included."""
    reached = search(edges, seeds_of(nodes.sparkSession, [node_id]), max_depth, direction, kinds, nodes, max_nodes)
    return nodes.join(reached.select("id", "depth"), "id"), reached.where("depth > 0").select("source", "target", "kind", "line")


def call_graph(nodes: DataFrame, edges: DataFrame | Adjacency, node_id: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Callees and callers of a node to a depth; a node that both ways find gives an edge from each."""
    start = seeds_of(nodes.sparkSession, [node_id])
    ways = [search(edges, start, depth, way, ("calls",), nodes) for way in ("outbound", "inbound")]
    both = ways[0].unionByName(ways[1])
    return nodes.join(both.select("id").distinct(), "id", "left_semi"), both.where("depth > 0").select("source", "target", "kind", "line")


def _frontier(walk: DataFrame, at: DataFrame, seen: DataFrame) -> DataFrame:
    """(id): what a step over ``walk`` reaches from ``at`` (id) and ``seen`` (id) lacks."""
    step = walk.join(at.select(F.col("id").alias("_from")), "_from").select(F.col("_to").alias("id")).distinct()
    return step.join(seen, "id", "left_anti")


def shortest_path(edges: DataFrame | Adjacency, start: str, end: str, max_depth: int = 10) -> DataFrame:
    """(pos, id, source, target, kind, line): the vertices of a shortest directed path and the edge that leads to each;
    no row if there is none within ``max_depth`` edges.

    Levels grow from both ends, always the one whose last level is smaller, until they meet.  Of several shortest paths it is
    the one whose vertices, from the end backwards, have the smallest ids.
    """
    spark = edges.sparkSession if isinstance(edges, DataFrame) else edges.spark
    schema = "pos int, id string, source string, target string, kind string, line int"
    if start == end:
        return spark.createDataFrame([(0, start, None, None, None, None)], schema)
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    ends = {"outbound": start, "inbound": end}
    reached = {w: [one(x)] for w, x in ends.items()}  # levels of each side
    rows: dict[str, list | None] = {w: [{"id": x}] for w, x in ends.items()}
    sizes = dict.fromkeys(ends, 1)
    meeting = None
    while meeting is None:
        if sum(len(v) - 1 for v in reached.values()) >= max_depth:
            return spark.createDataFrame([], schema)
        way, other = sorted(ends, key=lambda w: (sizes[w], w == "inbound"))
        seen = reduce(DataFrame.unionByName, reached[way])
        level, few = kept(_frontier(_walk(edges, way, None, rows[way]), reached[way][-1], seen), rows[way] is not None, f"{way}{len(reached[way])}")
        rows[way], sizes[way] = few, len(few) if few is not None else level.count()
        if not sizes[way]:
            return spark.createDataFrame([], schema)
        reached[way].append(level)
        # The other side's last level is the first that this one can meet.
        both = level.join(reached[other][-1], "id", "left_semi")
        both, few = kept(both, few is not None, "meeting")
        if few is None or few:
            meeting = both
    # What lies on shortest paths, by position: the meeting, and from it the levels of either side that edges lead to.
    half, whole = len(reached["outbound"]) - 1, len(reached["outbound"]) + len(reached["inbound"]) - 2
    on = {half: meeting}
    for pos in range(half - 1, -1, -1):
        on[pos] = kept(_between(edges, "inbound", on[pos + 1], reached["outbound"][pos]), True, "on")[0]
    for pos in range(half + 1, whole + 1):
        on[pos] = kept(_between(edges, "outbound", on[pos - 1], reached["inbound"][whole - pos]), True, "on")[0]
    path, at = [], end
    for pos in range(whole, 0, -1):  # one row for each position, from the end backwards
        into = _walk(edges, "inbound", None, [{"id": at}]).where(F.col("_from") == at).join(on[pos - 1].select(F.col("id").alias("_to")), "_to")
        row = into.agg(smallest_edge(F.col("_to")).alias("e")).first()["e"]
        path.append((pos, at, row["source"], row["target"], row["kind"], row["line"]))
        at = row["parent"]
    path.append((0, start, None, None, None, None))
    return spark.createDataFrame(path, schema)


def _between(edges: DataFrame | Adjacency, way: str, at: DataFrame, among: DataFrame) -> DataFrame:
    """(id): vertices of ``among`` that a step from ``at`` reaches."""
    rows = at.limit(FEW + 1).collect()
    walk = _walk(edges, way, None, rows if len(rows) <= FEW else None)
    step = walk.join(at.select(F.col("id").alias("_from")), "_from").select(F.col("_to").alias("id")).distinct()
    return step.join(among, "id", "left_semi")


def path_neighbourhood(edges: DataFrame, path: DataFrame) -> DataFrame:
    """Every edge that touches a vertex of a path."""
    return edges_touching(edges, path.select("id"))


def type_hierarchy(nodes: DataFrame, edges: DataFrame | Adjacency, node_id: str, direction: str = "both") -> DataFrame:
    """Ancestors (up), descendants (down), or the whole component (both) of a type, without itself."""
    if direction == "both":
        pairs = (edges.edges() if isinstance(edges, Adjacency) else edges).where(F.col("kind").isin(*INHERIT_KINDS)).select("source", "target")
        found = components(pairs)
        whole = found.join(found.where(F.col("id") == node_id).select("component"), "component", "left_semi").where(F.col("id") != node_id)
        return nodes.join(whole.select("id"), "id", "left_semi")
    way = {"up": "outbound", "down": "inbound"}[direction]
    reached = search(edges, seeds_of(nodes.sparkSession, [node_id]), None, way, INHERIT_KINDS).where("depth > 0")
    return nodes.join(reached.select("id"), "id", "left_semi")


def expand(nodes: DataFrame, edges: DataFrame | Adjacency, entries: DataFrame, most: int, depth: int = 2, kinds: tuple[str, ...] = CONTEXT_KINDS, skip: tuple[str, ...] = CONTEXT_SKIP) -> DataFrame:
    """(node columns, entry, depth): up to ``most`` nodes around the entries (id, entry), nearest to the first entry first.

    One search from all entries; a node goes to the first entry that reaches it.
    """
    reached = search(edges, entries.select(F.col("id").alias("seed"), "id"), depth, "both", kinds, nodes).where("depth > 0")
    ranked = reached.join(entries.select(F.col("id").alias("seed"), "entry"), "seed").groupBy("id").agg(F.min(F.struct("entry", "depth")).alias("_best"))
    fresh = ranked.join(entries.select("id"), "id", "left_anti")
    out = nodes.where(~F.col("kind").isin(*skip)).join(fresh, "id")
    return out.select(*nodes.columns, F.col("_best.entry").alias("entry"), F.col("_best.depth").alias("depth")).orderBy("entry", "depth", "id").limit(most)


def relationships(edges: DataFrame, chosen: DataFrame, kinds: tuple[str, ...] = ("calls",)) -> DataFrame:
    """(source, target): which of the chosen nodes (id, entry) use each other; of both directions the one from the earlier."""
    among = edges.where(F.col("kind").isin(*kinds)).select("source", "target").where("source <> target").distinct()
    a = chosen.select(F.col("id").alias("source"), F.col("entry").alias("_ea"))
    b = chosen.select(F.col("id").alias("target"))
    pairs = among.join(a, "source").join(b, "target", "left_semi")
    first = pairs.groupBy(F.least("source", "target").alias("_x"), F.greatest("source", "target").alias("_y")).agg(F.min(F.struct("_ea", "source", "target")).alias("_p"))
    return first.select("_p.source", "_p.target")
