"""Connected and strongly connected components, in rounds of joins over edges that are written once a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import kept


def _mark(pairs: DataFrame, rows: list | None) -> object:
    """What tells whether a round changed anything: the rows if there are few, else their number and a sum of their hashes."""
    if rows is not None:
        return frozenset(rows)
    row = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*pairs.columns).cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(pairs: DataFrame, most: int = 100) -> DataFrame:
    """(id, component): every vertex of (source, target), edges of no direction, with the smallest id of its component.

    Large-star and small-star steps in turn: every vertex links its larger neighbours to the smallest one that it knows, then
    itself and its smaller neighbours; edges don't grow in number, and the rounds are logarithmic in the size of a component.
    A hub's edges are split by adaptive execution, as the other side has a row for each vertex.  Self-loops are components
    of one vertex; null ends are left out.  ``most`` rounds without an end raise.
    """
    known, rows = kept(pairs.where("source is not null and target is not null").select("source", "target").distinct(), "pairs", True)
    few = rows is not None
    loops = known.select(F.col("source").alias("id")).unionByName(known.select(F.col("target").alias("id"))).distinct()
    links = known.where("source <> target").select(F.greatest("source", "target").alias("v"), F.least("source", "target").alias("m")).distinct()
    links, before = kept(links, "links", few)[0], None
    for _ in range(most):
        both = links.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(links.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("_w")).select("u", F.least("u", "_w").alias("m"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("v"), "m").distinct()
        # Smaller neighbours of a vertex, and itself, to the smallest of them.
        least = large.groupBy("v").agg(F.min("m").alias("_m"))
        small = large.join(least, "v").where("m <> _m").select(F.col("m").alias("v"), F.col("_m").alias("m"))
        links, rows = kept(small.unionByName(least.select("v", F.col("_m").alias("m"))).distinct(), "links", few)
        now = _mark(links, rows)
        if now == before:
            return loops.join(links, F.col("id") == F.col("v"), "left").select("id", F.coalesce("m", "id").alias("component"))
        before = now
    raise RuntimeError(f"components are not settled after {most} rounds")


def trimmed(pairs: DataFrame, few: bool = False) -> tuple[DataFrame, int]:
    """Edges without vertices that lack edges in or out, which no cycle passes, until there is none; and their number."""
    before = None
    while True:
        ins = pairs.select(F.col("target").alias("source")).distinct()
        outs = pairs.select(F.col("source").alias("target")).distinct()
        pairs, rows = kept(pairs.join(ins, "source", "left_semi").join(outs, "target", "left_semi"), "trimmed", few)
        now = pairs.count() if rows is None else len(rows)
        if now in (0, before):
            return pairs, now
        before = now


def strong_components(pairs: DataFrame) -> DataFrame:
    """(id, component): vertices of (source, target) that lie on a cycle, with the largest id of their strongly connected
    component; vertices that lie on none are not listed, and self-loops are no cycles.

    Forward and backward colouring: what is trimmed to vertices with edges both ways is coloured by the largest id that reaches
    a vertex; from each colour's own vertex, steps backwards within the colour find its component, which is taken out with all
    its edges, and what is left is trimmed again.  Each round ends at least one component for every colour.
    """
    left, rows = kept(pairs.where("source <> target").select("source", "target").distinct(), "pairs", True)
    few = rows is not None
    keep = lambda df, label: kept(df, label, few)
    done = None
    while True:
        left, n = trimmed(left, few)
        if not n:
            break
        colour = keep(left.select(F.col("source").alias("id")).distinct().select("id", F.col("id").alias("colour")), "colours")[0]
        before = None
        while True:
            sent = left.join(colour, F.col("source") == F.col("id")).select(F.col("target").alias("id"), "colour")
            colour, rows = keep(colour.unionByName(sent).groupBy("id").agg(F.max("colour").alias("colour")), "colours")
            now = _mark(colour, rows)
            if now == before:
                break
            before = now
        # Edges within a colour, backwards from its own vertex.
        end = lambda name: colour.select(F.col("id").alias(name), F.col("colour").alias(f"_{name}"))
        within = keep(left.join(end("source"), "source").join(end("target"), "target").where("_source = _target").select("source", "target", F.col("_source").alias("colour")), "within")[0]
        found = level = keep(colour.where("id = colour"), "roots")[0]
        while True:
            level = within.join(level.select(F.col("id").alias("target"), "colour"), ["target", "colour"]).select(F.col("source").alias("id"), "colour").distinct().join(found, ["id", "colour"], "left_anti")
            level, rows = keep(level, "back")
            if rows is not None and not rows:
                break
            found = found.unionByName(level)
        done = found if done is None else done.unionByName(found)
        gone = found.select("id")
        left = keep(left.join(gone, F.col("source") == F.col("id"), "left_anti").join(gone, F.col("target") == F.col("id"), "left_anti"), "left")[0]
    if done is None:
        return pairs.select(F.col("source").alias("id"), F.col("source").alias("component")).limit(0)
    sized = done.groupBy("colour").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return done.join(sized, "colour").select("id", F.col("colour").alias("component"))


def within_components(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(source, target, component): the edges whose ends are of one component."""
    end = lambda name: found.select(F.col("id").alias(name), F.col("component").alias(f"_{name}"))
    return pairs.join(end("source"), "source").join(end("target"), "target").where("_source = _target").select("source", "target", F.col("_source").alias("component"))
